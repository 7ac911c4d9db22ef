"""Registered queries: page scans and extraction."""
from pyspark.sql import functions as F

from lotwise import rules as R
from lotwise.functions import html as HT
from lotwise.operators import extract as X
from lotwise.plans import base as B
from lotwise.plans.q_score import _list
from lotwise.plans.registry import query
from lotwise.sources import io as IO

D = "::DOUBLE"
WHOLE = "CAST(trunc(price_bgn) AS INTEGER)"
LOW = "priority = '5-LOW'"
GONE = "(status = 'F' AND priority = '1-URGENT')"


def first(spark, d):
    return B.pages_first(B.listings(spark, d))


def real(spark, d):
    return IO.page_scan(spark, B.table(spark, d, "pages"))


@query("page_scan", "SELECT page_id, url, html FROM pages")
def page_scan(spark, d):
    return real(spark, d)


@query("page_url_fields", B.with_l() + f"""SELECT listing_id AS page_id, CASE WHEN NOT {LOW} THEN replace(brand_id, '-', '') END AS url_brand,
  CASE WHEN NOT {LOW} THEN regexp_extract(model_id, '^[a-z]+') END AS url_model FROM l""")
def page_url_fields(spark, d):
    return X.url_fields(first(spark, d)).select("page_id", "url_brand", "url_model")


@query("page_title_year", B.with_l() + r"""SELECT -1 - listing_id AS page_id, make || ' ' || model_raw || ', ' || year || 'г.' AS page_title, year FROM l
  UNION ALL SELECT page_id, trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), NULL FROM pages""")
def page_title_year(spark, d):
    both = first(spark, d).withColumn("page_id", F.lit(-1) - F.col("page_id")).unionByName(real(spark, d))
    return X.title_year(X.with_entries(both)).select("page_id", "page_title", "year")


@query("page_max_price", B.with_l() + f"SELECT listing_id AS page_id, {WHOLE}::BIGINT AS price, currency FROM l")
def page_max_price(spark, d):
    return X.max_price(first(spark, d)).select("page_id", "price", "currency")


SPACED = "replace(format('{:,}', %s), ',', ' ')"


@query("page_kv_map", B.with_l() + f"""SELECT listing_id AS page_id, CASE WHEN gearbox = 'automatic' THEN 'Марка=' || make || '|Модел=' || model_raw || '|' ELSE '' END || 'Пробег=' || {SPACED % 'mileage_km'} || ' км|Гориво=' || fuel_raw
  || '|Скоростна кутия=' || gearbox_raw || coalesce('|Категория=' || body_raw, '') || '|Двигател=' || power_hp || ' к.с. ' || power_hp * 10 || ' куб|Населено място=' || region AS entries, region, CAST(year AS VARCHAR) AS th_year FROM l""")
def page_kv_map(spark, d):
    p = X.with_entries(first(spark, d))
    by_key = F.map_from_entries("entries")
    return p.select("page_id", F.array_join(F.transform("entries", lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("entries"),
                    F.element_at(by_key, R.PAGE_KEYS["region"]).alias("region"), X.header_value(F.col("html"), R.PAGE_KEYS["year"]).alias("th_year"))


TWO_WORDS = "array_to_string(list_filter(string_split(%s, ' '), lambda x: x <> '')[%d:%d], ' ')"


@query("page_brand_fallback", B.with_l() + f"""SELECT listing_id AS page_id, CASE WHEN {LOW} THEN make ELSE replace(brand_id, '-', '') END AS brand,
  CASE WHEN NOT {LOW} THEN regexp_extract(model_id, '^[a-z]+') WHEN gearbox = 'automatic' THEN model_raw ELSE {TWO_WORDS % ('model_raw', 1, 2)} END AS model FROM l""")
def page_brand_fallback(spark, d):
    return X.brand_fallback(X.title_year(X.url_fields(X.with_entries(first(spark, d))))).select("page_id", "brand", "model")


@query("page_numeric_fields", B.with_l() + "SELECT listing_id AS page_id, mileage_km, power_hp, power_hp * 10 AS volume_cc FROM l")
def page_numeric_fields(spark, d):
    return X.numeric_fields(X.with_entries(first(spark, d))).select("page_id", "mileage_km", "power_hp", "volume_cc")


@query("page_class_text", B.with_l() + "SELECT listing_id AS page_id, trim(description) AS description, '0888' || seller_id AS phone, 'Seller ' || seller_id AS seller FROM l")
def page_class_text(spark, d):
    return X.class_fields(first(spark, d)).select("page_id", "description", "phone", "seller")


@query("page_images", B.with_l() + """SELECT listing_id AS page_id, 'https://cdn.example/' || listing_id || '.jpg|https://www.mobile.bg/photo/' || listing_id || '.jpg|https://cdn.example/x.png' AS images FROM l""")
def page_images(spark, d):
    return X.images(first(spark, d)).select("page_id", F.array_join("images", "|").alias("images"))


STOP = "(" + " OR ".join(f"contains(upper({{0}}), '{m}')" for m in R.ENGINE_STOP) + ")"
TRIM_STOP = "upper({0}) IN " + str(R.TRIM_STOP)


@query("model_string_split", B.with_l() + rf"""SELECT listing_id, CAST(nullif(regexp_extract(model_raw, '\b(\d+\.\d+)\b', 1), '') AS DOUBLE) AS engine_size,
  CAST(nullif(regexp_extract(model_raw, '(?i)(\d{{2,3}})\s*(?:hp|к\.с\.|к\.с|ps|ch)', 1), '') AS INTEGER) AS power_hp,
  CASE {' '.join(f"WHEN contains(model_raw, '{m}') THEN '{v}'" for m, v in R.ENGINE_MARKERS)} END AS engine_type,
  CASE WHEN NOT regexp_matches(p1, '^\d\d\d[dDi]$') AND {TRIM_STOP.format('p1')} THEN NULL WHEN p2 IS NULL OR {STOP.format('p2')} OR {TRIM_STOP.format('p2')} THEN p1
   WHEN p3 IS NULL OR {STOP.format('p3')} OR {TRIM_STOP.format('p3')} THEN p1 || ' ' || p2 ELSE p1 || ' ' || p2 || ' ' || p3 END AS model_base,
  nullif(array_to_string(list_filter({_list(R.TRIM_WORDS)}, lambda w: contains(lower(model_raw), lower(w))), '/'), '') AS trim
  FROM (SELECT *, v[1] AS p1, v[2] AS p2, v[3] AS p3 FROM (SELECT *, string_split_regex(model_raw, '[\s/]+') AS v FROM l))""")
def model_string_split(spark, d):
    return X.model_string_split(B.listings(spark, d).drop("power_hp"), "model_raw").select("listing_id", "engine_size", "power_hp", "engine_type", "model_base", "trim")


@query("listing_detail", B.with_l() + f"""SELECT listing_id AS page_id, '17' || lpad(CAST(listing_id AS VARCHAR), 15, '0') AS site_ad_id, title, make AS brand, {TWO_WORDS % ('title', 2, 3)} AS model,
  {WHOLE} AS price, currency, year, mileage_km, fuel, gearbox, split_part(description, ' ', 1) AS description, region, sha256('0888' || seller_id) AS phone_hash,
  '//cdn.example/' || listing_id || '_Small.jpg|//cdn.example/' || listing_id || '_Small.jpg|/photo/' || listing_id || '_Thumb.jpg|/no-image.png' AS images FROM l WHERE NOT {LOW} AND NOT {GONE}""")
def listing_detail(spark, d):
    return X.listing_detail(first(spark, d)).select(
        "page_id", "site_ad_id", "title", "brand", "model", "price", "currency", "year", "mileage_km", "fuel", "gearbox", "description", "region", "phone_hash",
        F.array_join("images", "|").alias("images"))


@query("drop_deleted_pages", B.with_l() + f"SELECT -1 - listing_id AS page_id FROM l WHERE NOT {GONE} UNION ALL SELECT page_id FROM pages WHERE NOT contains(lower(html), 'deleted')")
def drop_deleted_pages(spark, d):
    both = first(spark, d).withColumn("page_id", F.lit(-1) - F.col("page_id")).unionByName(real(spark, d))
    return X.live_pages(both).select("page_id")


@query("jsonld_extract", B.with_l() + f"""SELECT listing_id AS page_id, CASE WHEN fuel <> 'hybrid' THEN title END AS ld_name, CASE WHEN fuel <> 'hybrid' THEN description END AS ld_description,
  CASE WHEN fuel <> 'hybrid' THEN {WHOLE} END{D} AS ld_price, CASE WHEN fuel <> 'hybrid' THEN currency END AS ld_currency,
  CASE WHEN fuel <> 'hybrid' THEN '//cdn.example/' || listing_id || '.jpg' || CASE WHEN image_count > 5 THEN '|/more.jpg' ELSE '' END END AS ld_images FROM l""")
def jsonld_extract(spark, d):
    return X.jsonld(first(spark, d)).select("page_id", "ld_name", "ld_description", "ld_price", "ld_currency", F.array_join("ld_images", "|").alias("ld_images"))


@query("sitemap_detail", B.with_l() + f"""SELECT listing_id AS page_id, title, CASE WHEN fuel = 'hybrid' AND currency = 'BGN' THEN {WHOLE} // 2 ELSE {WHOLE} END{D} AS price,
  CASE WHEN fuel = 'hybrid' THEN 'EUR' ELSE currency END AS currency, year, 0 AS mileage_km, fuel, gearbox FROM l WHERE NOT {LOW}""")
def sitemap_detail(spark, d):
    return X.sitemap_detail(first(spark, d)).select("page_id", "title", "price", "currency", "year", "mileage_km", "fuel", "gearbox")


def _case(table: dict, col: str) -> str:
    return B._case(table, col)


@query("listing_detail_2", B.with_l(r"""t2 AS (SELECT *, 'CARS.BG - ' || make || ' ' || model_raw || ', ' || CAST(trunc(price_bgn) AS INTEGER) || CASE WHEN currency = 'EUR' THEN ' EUR' ELSE ' BGN' END || ', ' || fuel_raw AS tt,
  CASE WHEN status <> 'P' THEN 'Seller ' || seller_id END AS sn FROM l)""")
       + rf"""SELECT listing_id AS page_id, printf('%x', listing_id) AS site_ad_id, make || ' ' || model_raw AS title,
  CAST(regexp_replace(CASE WHEN currency = 'EUR' THEN regexp_extract(tt, '(\d[\d\s,\.]*)\s*EUR', 1) ELSE regexp_extract(tt, '(\d[\d\s,]*)\s*BGN', 1) END, '[^\d.]', '', 'g') AS DOUBLE) AS price, currency, year, mileage_km,
  {_case({'diesel': 'Diesel', 'petrol': 'Petrol', 'hybrid': 'Hybrid'}, 'fuel')} AS fuel, {_case({'automatic': 'Automatic', 'manual': 'Manual'}, 'gearbox')} AS gearbox,
  power_hp, power_hp * 10 AS engine_cc, ({B._arr(B.COLORS)})[seller_id % 4 + 1] AS color, {_case({'1-URGENT': 'Sedan', '2-HIGH': 'SUV', '3-MEDIUM': 'Estate', '5-LOW': 'Hatchback'}, 'priority')} AS body,
  CASE WHEN status = 'O' THEN 'New' ELSE 'Used' END AS condition, region AS location, status = 'P' AS is_dealer, sn AS seller_name, md5('0888' || seller_id) AS phone_hash,
  md5('cars_bg_' || coalesce(sn, region)) AS seller_hash, trim(description) AS description, 'https://g1-bg.cars.bg/2025-10-16_1/' || listing_id || 'o.jpg' AS images FROM t2""")
def listing_detail_2(spark, d):
    return X.listing_detail_2(B.pages_second(B.listings(spark, d))).select(
        "page_id", "site_ad_id", "title", "price", "currency", "year", "mileage_km", "fuel", "gearbox", "power_hp", "engine_cc", "color", "body", "condition", "location",
        "is_dealer", "seller_name", "phone_hash", "seller_hash", "description", F.array_join("images", "|").alias("images"))


@query("brand_dictionary_scan", B.with_l(f"""bs AS (SELECT *, (list_filter({_list(R.TITLE_BRANDS)}, lambda b: contains(upper(title), upper(b))))[1] AS sb FROM l),
 bt AS (SELECT *, trim(substr(title, instr(upper(title), upper(sb)) + length(sb))) AS after FROM bs),
 bw AS (SELECT *, list_filter(string_split(after, ' '), lambda x: x <> '') AS ws FROM bt)""")
       + r"""SELECT listing_id, sb AS scan_brand, CASE WHEN sb IS NOT NULL AND regexp_full_match(after, '[A-Za-z0-9\-\s/\.]+') THEN CASE WHEN len(ws) > 3 THEN array_to_string(ws[1:3], ' ') ELSE after END END AS scan_model FROM bw""")
def brand_dictionary_scan(spark, d):
    return X.brand_dictionary_scan(B.listings(spark, d)).select("listing_id", "scan_brand", "scan_model")


@query("numeric_clean", B.with_l() + f"""SELECT listing_id, CASE WHEN currency = 'EUR' THEN cents / 100.0{D} ELSE {WHOLE} END{D} AS clean_price, currency AS clean_currency, mileage_km AS clean_mileage,
  {_case({'diesel': 'Diesel', 'petrol': 'Petrol', 'hybrid': 'Hybrid'}, 'fuel')} AS clean_fuel FROM l""")
def numeric_clean(spark, d):
    whole = F.col("price_bgn").cast("int")
    eur = F.concat(F.floor(F.col("cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.lit(" EUR"))
    df = B.listings(spark, d).withColumns({
        "p": F.when(F.col("currency") == "EUR", eur).otherwise(F.concat(B.spaced(whole), F.lit(" лв."))), "k": F.concat(B.spaced(F.col("mileage_km")), F.lit(" км")),
        "f": F.concat(F.lit("гориво: "), F.lower("fuel_raw"))})
    return X.numeric_clean(df, "p", "k", "f").select("listing_id", "clean_price", "clean_currency", "clean_mileage", "clean_fuel")


@query("url_predicate", B.with_l() + f"""SELECT listing_id AS page_id, NOT {LOW} AND status <> 'P' AS is_listing, CASE WHEN NOT {LOW} THEN '17' || lpad(CAST(listing_id AS VARCHAR), 15, '0') END AS url_id FROM l""")
def url_predicate(spark, d):
    df = B.listings(spark, d)
    urls = B.pages_first(df).select("page_id", "url").join(df.select(F.col("listing_id").alias("page_id"), "status"), "page_id") \
        .withColumn("url", F.when(F.col("status") == "P", F.concat("url", F.lit("#photos"))).otherwise(F.col("url")))
    return X.url_predicate(urls).select("page_id", "is_listing", "url_id")


@query("outlinks_explode", r"""SELECT DISTINCT page_id, CASE WHEN regexp_matches(u, '^https?://') THEN u WHEN starts_with(u, '//') THEN regexp_extract(url, '^(https?:)', 1) || u WHEN starts_with(u, '/') THEN root || u ELSE root || '/' || u END AS link
  FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS u FROM pages)""")
def outlinks_explode(spark, d):
    return X.outlinks(real(spark, d)).select("page_id", "link")


@query("page_max_link", B.with_l() + "SELECT make AS page_id, CAST(count(DISTINCT model_id) AS INTEGER) AS max_page FROM l GROUP BY 1")
def page_max_link(spark, d):
    # one search page per brand with a link for every result page
    n = B.listings(spark, d).select("make", "model_id").distinct().groupBy("make").agg(F.count(F.lit(1)).alias("n"))
    links = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit('<a href="/carslist.php?page='), i.cast("string"), F.lit('">'), i.cast("string"), F.lit("</a>")))
    pages = n.select(F.col("make").alias("page_id"), F.lit("https://www.cars.bg/").alias("url"), F.array_join(F.reverse(links), " ").alias("html"))
    return X.page_max_link(pages).select("page_id", "max_page")


@query("link_slugs", r"""SELECT slug, first(name ORDER BY page_id, place) AS name FROM (SELECT page_id, generate_subscripts(a, 1) AS place, regexp_extract(unnest(a), 'href="/([^/"]+)', 1) AS slug,
   trim(replace(replace(replace(regexp_replace(unnest(a), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS name FROM (SELECT page_id, regexp_extract_all(html, '(<a\s[^>]*>.*?</a>)', 1, 's') AS a FROM pages))
  WHERE slug <> '' GROUP BY 1""")
def link_slugs(spark, d):
    return X.link_slugs(real(spark, d), "^/").select("slug", "name")
