"""Rule tables against literal vectors."""
import pytest
from pyspark.sql import functions as F

from lotwise.functions import text as T
from lotwise.operators import alerts as A, comps as K, extract as X, flags as G, normalize as N, score as P, select as H


def at():
    return F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize("disc,n,conf,risk,hours,score,ok", [
    (20.0, 50, 0.8, "low", 1.0, 6.5, True), (15.0, 50, 0.8, "high", 1.0, 2.0, False), (15.0, 10, 0.8, "low", 1.0, 5.5, True),
    (15.0, 9, 0.8, "low", 48.0, 4.5, False), (0.0, 50, 0.5, "unknown", 48.0, 1.0, False)])
def test_base_score(spark, disc, n, conf, risk, hours, score, ok):
    df = spark.createDataFrame([(disc, n, conf, risk, hours)], "discount_pct double, sample_size bigint, confidence double, risk_level string, freshness_hours double")
    got = one(P.score_base(df))
    assert (got["score"], got["is_approved"]) == (score, ok)


@pytest.mark.parametrize("ask,market,n,year,km,gear,score,label", [
    (19000.0, 18500.0, 15, 2018, 120000, "automatic", 3.2, "OVERPRICED"), (18000.0, 24500.0, 22, 2019, 80000, "automatic", 7.7, "EXCEPTIONAL"),
    (11000.0, 12500.0, 18, 2017, 100000, "manual", 4.8, "GOOD"), (11000.0, None, 0, 2017, 100000, "manual", 3.0, "UNKNOWN")])
def test_realtime_score(spark, ask, market, n, year, km, gear, score, label):
    df = spark.createDataFrame([(ask, market, n, year, km, gear, "diesel")],
                               "price_bgn double, avg_price double, n bigint, year int, mileage_km int, gearbox string, fuel string")
    got = one(P.score_realtime(df))
    assert (round(got["score"], 6), got["deal_quality"]) == (score, label)


def test_missing_mileage_differs_between_realtime_and_legacy(spark):
    df = spark.createDataFrame([(100.0, None, 0, 2000, None, "manual", "diesel")],
                               "price_bgn double, avg_price double, n bigint, year int, mileage_km int, gearbox string, fuel string")
    assert one(P.score_realtime(df))["score"] == 3.3
    assert one(P.score_realtime(df, P.LEGACY))["score"] == 5.0


@pytest.mark.parametrize("text,price,currency", [
    ("42 948.01 € 83 999 лв.", 83999, "BGN"), ("194 499 € 380 406.98 лв.", 380406, "BGN"), ("42 948.01 €", 42948, "EUR"), ("по договаряне", None, "BGN"),
    ("83 999 лв.", 83999, "BGN")])
def test_price_text(spark, text, price, currency):
    p, c = X.price_text(F.col("t"))
    got = one(spark.createDataFrame([(text,)], "t string").select(p.alias("p"), c.alias("c")))
    assert (got["p"], got["c"]) == (price, currency)


ALERTS = [
    ("BMW X5 diesel <25000 2016+ <180000km automatic Sofia",
     dict(brand="Bmw", model="X5", price_max=25000, year_min=2016, mileage_max=180000, fuel="diesel", gearbox="automatic", region="Sofia", price_min=None, power_min=None)),
    ("Audi A4 petrol 2018+ <15000", dict(brand="Audi", model="A4", fuel="petrol", year_min=2018, price_max=15000)),
    ("Mercedes C-Class >200hp 2015-2020 automatic", dict(brand="Mercedes", model=None, power_min=200, price_min=None, year_min=2015, year_max=2020, gearbox="automatic")),
    ("VW Golf <10000 2010+ manual Plovdiv", dict(brand="Vw", model="Golf", price_max=10000, gearbox="manual", region="Plovdiv")),
    ("БМВ X3 дизел <30000 2017+ автоматична", dict(brand="Бмв", model="X3", fuel="diesel", gearbox="automatic", price_max=30000)),
    ("джип 2018+ <25000 автоматична дизел", dict(brand="Джип", model=None, body="suv", fuel="diesel", year_min=2018)),
    ("Toyota RAV4 hybrid 2019+ Varna <90km", dict(brand="Toyota", model="Rav4", fuel="hybrid", region="Varna", mileage_max=90000, price_max=None)),
    ("BMW 320 diesel", dict(brand="Bmw", model=None)),
    ("Opel caravan manual", dict(body="van")),  # a keyword inside a longer word counts
]


@pytest.mark.parametrize("text,want", ALERTS)
def test_alert_parse(spark, text, want):
    got = one(A.alert_parse(spark.createDataFrame([(1, text)], "alert_id int, dsl_query string")))
    assert {k: got[k] for k in want} == want


def test_alert_match_case(spark):
    listing = spark.createDataFrame([(1, "bmw", "x5", 2017, "diesel", "automatic", None, 32000.0, 145000, None, None)],
                                    "listing_id int, brand_id string, model_id string, year int, fuel string, gearbox string, body string, price_bgn double, mileage_km int, power_hp int, region string")
    alerts = spark.createDataFrame([(1, "BMW X5 diesel <35000 2015+ automatic", True), (2, "Audi Q7 2018+ <40000", True), (3, "BMW X5 2016+ Sofia", True),
                                    (4, "BMW X5", False), (5, "BMW", True), (6, "BMW X5 >100hp", True)], "alert_id int, dsl_query string, active boolean")
    got = {r[0] for r in A.alert_match(listing, A.alert_parse(alerts)).collect()}
    assert got == {1, 5}


def test_eligibility_cap_holds_inside_a_batch(spark):
    rows = spark.sql("select 1 as alert_id, id as listing_id, timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0,0,cast(id as int)) as created_at from range(30) union all "
                     "select 2, 99, timestamp_ntz'2025-01-01 00:00:00' union all select 3, 98, timestamp_ntz'2025-01-01 11:50:00'")
    alerts = spark.createDataFrame([(1, "Free"), (2, None), (3, "Free")], "alert_id int, plan string")
    sent = spark.createDataFrame([(1, 4)], "alert_id int, sent bigint")
    out = A.alert_eligibility(rows, alerts, sent, A.plan_table(spark), F.lit("2025-01-01 12:00:00").cast("timestamp_ntz")).collect()
    assert sorted(r.listing_id for r in out if r.notify) == [0, 1, 2, 3, 4, 5]
    assert {r.reason for r in out if r.alert_id == 2} == {"no plan"} and {r.reason for r in out if r.alert_id == 3} == {"too fresh"}


def test_eligibility_takes_caps_from_the_plans(spark):
    rows = spark.sql("select 1 as alert_id, id as listing_id, timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0,0,cast(id as int)) as created_at from range(2500)")
    plans = spark.sql("select 'Big' plan, named_struct('max_alerts', 1, 'delay_minutes', 0, 'daily_alert_cap', 2000) limits")
    sent = spark.createDataFrame([(1, 10)], "alert_id int, sent bigint")
    out = A.alert_eligibility(rows, spark.createDataFrame([(1, "Big")], "alert_id int, plan string"), sent, plans, F.lit("2026-01-01 12:00:00").cast("timestamp_ntz"))
    assert sorted(r.listing_id for r in out.filter("notify").collect()) == list(range(1990))


def test_many_aliases_keep_their_entry(spark):
    rows = [(0, "B", "M", "first", "x", [f"a{i}" for i in range(1500)], True), (1, "B", "N", "second", "y", ["a1400"], True)]
    table = spark.createDataFrame(rows, "ord int, brand string, model string, normalized_brand string, normalized_model string, aliases array<string>, active boolean")
    got = {r.model_key: r.norm_brand for r in N.alias_dictionary(table).collect()}
    assert got["a1499"] == "first" and got["a1400"] == "second" and len(got) == 1502


def test_long_pages_and_nested_elements(spark):
    copies = "".join(f'<div class="text-copy">block {i}</div>' for i in range(1200))
    page = f"<html><head><title>t</title></head><body>{copies}</body></html>"
    df = spark.createDataFrame([(1, "https://www.cars.bg/offer/ab", page)], "page_id long, url string, html string")
    assert X.listing_detail_2(df).first().description.endswith("block 1199")
    nested = ('<div class="pic"><div><img src="/a_Small.jpg"></div><div><div><img src="/b.jpg"></div></div></div><div class="description">one<div><div class="x">two</div></div> three</div>'
              '<div class="phone">1<span>2</span></div><p class="sellerName">open')
    row = X.images(X.class_fields(spark.createDataFrame([(1, "u", nested), (2, "u", None), (3, "u", "")], "page_id long, url string, html string"))).orderBy("page_id").collect()
    assert row[0].images == ["https://www.mobile.bg/a.jpg", "https://www.mobile.bg/b.jpg"]
    assert (row[0].description, row[0].phone, row[0].seller) == ("onetwo three", "12", "open")
    assert row[1].description is None and row[2].description is None


@pytest.mark.parametrize("text,base,kind,size,trim", [
    ("308 HDI/USB/NAVI", "308", "diesel", None, "USB/NAVI"), ("C 220 CDI", "C 220", "diesel", None, None), ("320d xDrive", "320d xDrive", "diesel", None, "xDrive"),
    ("Astra 1.6 CDTI", "Astra 1.6", "diesel", 1.6, None), ("Octavia 150 к.с.", "Octavia 150 к.с.", "petrol", None, None)])
def test_model_string(spark, text, base, kind, size, trim):
    got = one(X.model_string_split(spark.createDataFrame([(text,)], "model string")))
    assert (got["model_base"], got["engine_type"], got["engine_size"], got["trim"]) == (base, kind, size, trim)
    assert got["power_hp"] == (150 if "150" in text else None)


def test_page_row(spark):
    html = ('<title>Audi A6, 2019г.</title><p>45 900 лв</p><table><tr><td>Пробег:</td><td>123 456 км</td></tr><tr><td>Гориво</td><td>Дизел</td></tr>'
            '<tr><td>Двигател</td><td>231 к.с. 2967 куб</td></tr></table><div class="pic"><img src="//cdn/a_Small.jpg"><img src="//cdn/a_Small.jpg"><img src="/b.jpg"></div>')
    df = spark.createDataFrame([(1, "https://site.example/obiava-11758305565394920-audi-a6-45tdi", html)], "page_id int, url string, html string")
    got = one(X.page_fields(df))
    assert (got["brand"], got["model"], got["year"], got["price"], got["currency"], got["mileage_km"]) == ("audi", "a6", 2019, 45900, "BGN", 123456)
    assert (got["fuel_raw"], got["power_hp"], got["volume_cc"], got["images"]) == ("Дизел", 231, 2967, ["https://cdn/a.jpg", "https://www.mobile.bg/b.jpg"])
    assert one(N.enum_map(spark.createDataFrame([("Дизел", "ръчна", "джип")], "fuel_raw string, gearbox_raw string, body_raw string")))["body"] == "suv"


@pytest.mark.parametrize("url,ok,ident", [
    ("/obiava-11758305565394920-audi-a6", True, "11758305565394920"), ("/obiava-123-audi", False, "123"), ("/obiava-11758305565394920-audi#x", False, "11758305565394920"),
    ("https://x.example/users/obiava-11758305565394920-a", False, "11758305565394920"), ("", False, None)])
def test_url_predicate(spark, url, ok, ident):
    got = one(X.url_predicate(spark.createDataFrame([(url,)], "url string")))
    assert (got["is_listing"], got["url_id"]) == (ok, ident)


def test_risk_levels(spark):
    df = spark.createDataFrame([("a", "nothing here"), ("b", "First owner, service history"), ("c", "удар и спешно, scratches"), ("d", "urgent")], "title string, description string")
    got = [(r.risk_level, r.rule_confidence, r.needs_llm) for r in G.risk_keywords(df).orderBy("title").collect()]
    assert got == [("low", 0.5, True), ("low", 0.7, False), ("high", 0.8, False), ("medium", 0.6, True)]


def test_red_flags_in_check_order(spark):
    df = spark.createDataFrame([("спешно, последна цена, лизинг", "rhd bmw", 15000.0, 2025), ("bmw за 15000", "", 15000.0, 2024)], "description string, title string, price_bgn double, year int")
    got = [r.red_flags for r in G.red_flags(df, at()).collect()]
    assert [f.split(":")[0] for f in got[0]] == ["🚨 LEASING", "⚠️ RIGHT-HAND DRIVE", "⚠️ SUSPICIOUS"]
    assert got[1] == ["🚨 SUSPICIOUS: New premium car too cheap - possible leasing"]


def test_text_functions(spark):
    got = one(spark.createDataFrame([("  БМВ X5,  (нов!) ", "Word two")], "a string, b string").select(
        T.text_clean(F.col("a")).alias("clean"), F.array_sort(T.trigrams(F.col("b"))).alias("tri")))
    assert got["clean"] == "бмв x5 нов"
    assert got["tri"] == sorted(["  w", " wo", "wor", "ord", "rd ", "  t", " tw", "two", "wo "])


def test_fuzzy_takes_first_entry_and_unknown_is_null(spark):
    df = spark.createDataFrame([("Mercedes", "class c"), ("Mercedes", "c class"), ("Mercedes", "zzz"), (None, "x"), ("BMW", "X 5")], "make string, model_raw string")
    got = {(r.make, r.model_raw): (r.norm_brand, r.norm_model) for r in N.fuzzy_jaccard_join(df, N.alias_dictionary(N.brand_models(spark))).collect()}
    assert got[("Mercedes", "class c")] == ("mercedes-benz", "c-class") and got[("BMW", "X 5")] == ("bmw", "x5")
    assert got[("Mercedes", "zzz")] == (None, None) and got[(None, "x")] == (None, None)


def test_watch_target_missing_attribute_fails(spark):
    df = spark.createDataFrame([(1, 9000.0, 2019, None, "automatic", "diesel", 100), (2, 9000.0, 2019, 10, None, "Plug-in hybrid", None)],
                               "listing_id int, price_bgn double, year int, mileage_km int, gearbox string, fuel string, power_hp int")
    t = ({"name": "a", "mileage_max": 100}, {"name": "b", "fuel_type": "hybrid"}, {"name": "c", "transmission": ["auto"]}, {"name": "d", "power_min": 50})
    assert {(r.target, r.listing_id) for r in H.watch_targets(df, t).collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", 1)}


def test_formula_price(spark):
    got = one(K.formula_price(spark.createDataFrame([(2020, 100000)], "year int, mileage_km int"), at()))
    assert (got["predicted"], got["p10"]) == (10500.0, 8400.0)
    assert one(K.formula_price(spark.createDataFrame([(1980, None)], "year int, mileage_km int"), at()))["predicted"] == 1000.0


def test_enhanced_score_needs_a_mileage_within_bounds(spark):
    df = spark.sql("select id, 20000D price_bgn, 2018 year, km mileage_km, 25000D avg_price, 12L n, timestamp_ntz'2025-01-01 00:00:00' first_seen_at from values (1, 250000), (2, 250001), (3, null), (4, 0), (5, 90000) t(id, km)")
    assert sorted(r.id for r in P.score_enhanced(df, at()).collect()) == [1, 5]
