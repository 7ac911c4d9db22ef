"""Listing views over the star-schema tables, in Spark and as SQL text.

One listing per order that has lines.  Model years are ship years moved forward
by 24 so that they meet the rule tables (2019-2025); listing ages are an eighth
of the ship-date ages, so most listings fall into the rules' look-back spans.
The SQL text is the same view for an independent engine and only checks results.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise import session as S

MAKES = ("BMW", "Audi", "Mercedes", "VW", "Ford", "Toyota", "Mercedes-Benz", "Lexus", "Porsche",
         "Opel", "Renault", "Peugeot", "Mazda", "Nissan", "Honda", "Hyundai", "Kia", "Skoda",
         "Seat", "Fiat", "Dacia", "Volvo", "Subaru", "Jeep", "Tesla")
MODEL_SPELLINGS = ("X5", "x 5", "3 series", "320", "C-Class", "c class", "E-Klasse!", "A4", "а6", "Q5",
                   "Golf", "голф", "Passat", "Focus", "фокус", "Fiesta", "Corolla", "Yaris", "RAV4",
                   "rav 4", "5  Series", "class c", "series 3", "4 rav", "320d xDrive", "Astra 1.6 CDTI",
                   "308 HDI/USB/NAVI", "C 220 CDI", "GTI Sport", "Octavia 150 к.с.")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PHRASES = ("Service history, first owner, perfect condition", "спешно, бърза продажба, удар отпред",
           "лизинг, месечна вноска 300", "десен волан, от англия", "нов внос от германия",
           "scratches and dents, urgent, need money", "редовно обслужвана, личен автомобил",
           "", "катастрофирал, за части, без документи", "запазена кола, реални километри",
           "спешно, последна цена, само обаждане",
           "BMW M пакет, отлично състояние, един собственик, на гаранция")
CITIES = ("Sofia", "Plovdiv", "Varna", "Burgas", "Ruse", "Stara Zagora", "Pleven", "Blagoevgrad")
FUEL_RAW = {"A": "Дизел", "N": "Бензин", "R": "Хибрид"}
FUEL = {"A": "diesel", "N": "petrol", "R": "hybrid"}
GEAR_RAW = {"F": "Автоматична", "O": "Ръчна"}
GEAR = {"F": "automatic", "O": "manual"}
BODY_RAW = {"1-URGENT": "Седан", "2-HIGH": "Джип", "3-MEDIUM": "комби", "5-LOW": "Hatchback"}
BODY = {"1-URGENT": "sedan", "2-HIGH": "suv", "3-MEDIUM": "wagon", "5-LOW": "hatchback"}
SOURCE = {"F": "mobile_bg", "O": "mobile_bg", "P": "cars_bg"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    S.tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words, index: Column) -> Column:
    """Element of a literal list at a zero-based position."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def code(mapping: dict, col: Column) -> Column:
    """CASE over a small code list; unknown codes give NULL."""
    items = list(mapping.items())
    first = F.when(col == items[0][0], F.lit(items[0][1]))
    return reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])), items[1:], first)


ANCHOR = "2025-11-05 00:00:00"
AS_OF = "2025-11-06 00:00:00"


def as_of(*_) -> Column:
    """The reference time of every age rule; never the wall clock."""
    return F.lit(AS_OF).cast("timestamp_ntz")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``L`` as a stored table: written once per application, then scanned with pruned columns."""
    S.tune(spark)
    sources = [table(spark, sf_dir, name) for name in ("lineitem", "orders", "part", "supplier")]
    return S.stored(spark, f"{sf_dir}/listings", lambda: listings_view(spark, sf_dir), sources)


def listings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``L``.  The first line of an order is a map-side combinable minimum,
    so only one row per order and map task is shuffled."""
    line = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                          "l_shipdate", "l_returnflag", "l_linestatus")).alias("x")
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(line).select("l_orderkey", "x.*")
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    made = F.substring("p_brand", 7, 10).cast("int") - 1
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type")) - 1
    age_days = F.floor(F.datediff(F.lit(ANCHOR).cast("timestamp_ntz"), F.expr("l_shipdate + interval 24 years")) / 8).cast("int")
    created = F.lit(ANCHOR).cast("timestamp_ntz") - F.make_dt_interval(age_days) + F.make_dt_interval(
        F.lit(0), F.lit(0), ((F.col("o_custkey") * 7 + F.col("l_partkey")) % 1440).cast("int"))
    joined = (
        first.join(orders, first.l_orderkey == orders.o_orderkey)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.col("o_orderkey").alias("listing_id"),
        pick(MAKES, made).alias("make"),
        pick(MODEL_SPELLINGS, kind * 5 + F.col("p_size") % 5).alias("model_raw"),
        F.lower(pick(MAKES, made)).alias("brand_id"),
        F.concat(F.lower("p_type"), F.lit("-"), (F.col("p_size") % 5).cast("string")).alias("model_id"),
        F.year(F.expr("l_shipdate + interval 24 years")).alias("year"),
        (F.col("l_quantity") * 5000).cast("int").alias("mileage_km"),
        F.col("l_extendedprice").alias("price_bgn"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        code(FUEL_RAW, F.col("l_returnflag")).alias("fuel_raw"),
        code(GEAR_RAW, F.col("l_linestatus")).alias("gearbox_raw"),
        code(BODY_RAW, F.col("o_orderpriority")).alias("body_raw"),
        code(FUEL, F.col("l_returnflag")).alias("fuel"),
        code(GEAR, F.col("l_linestatus")).alias("gearbox"),
        code(BODY, F.col("o_orderpriority")).alias("body"),
        F.when(F.col("o_orderstatus") == "P", "EUR").otherwise("BGN").alias("currency"),
        code(SOURCE, F.col("o_orderstatus")).alias("source"),
        F.col("l_suppkey").alias("seller_id"),
        pick(CITIES, F.col("s_nationkey") % 8).alias("region"),
        (F.lit(60) + F.col("p_size") * 5).cast("int").alias("power_hp"),
        created.alias("created_at"),
        (created - F.make_dt_interval((F.col("o_custkey") % 30).cast("int"))).alias("first_seen_at"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        F.concat_ws(" ", pick(MAKES, made), pick(MODEL_SPELLINGS, kind * 5 + F.col("p_size") % 5), "p_name").alias("title"),
        F.repeat(F.concat(pick(PHRASES, F.col("o_custkey") % 12), F.lit(". ")), F.col("l_linenumber")).alias("description"),
        (F.col("l_linenumber") * 2 - 1).cast("int").alias("image_count"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("customer_id"),
    )


# --- the same view as SQL text ------------------------------------------------
def _arr(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _case(mapping: dict, col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
_CREATED = (f"(TIMESTAMP '{ANCHOR}' - to_days(CAST(floor(date_diff('day', l_shipdate + INTERVAL 24 YEAR, TIMESTAMP '{ANCHOR}') / 8.0) AS INTEGER))"
            " + to_minutes((o_custkey * 7 + l_partkey) % 1440))")

L_BODY = f"""
SELECT o_orderkey AS listing_id,
  ({_arr(MAKES)})[CAST(substr(p_brand, 7) AS INTEGER)] AS make,
  ({_arr(MODEL_SPELLINGS)})[CAST((list_position({_arr(TYPES)}, p_type) - 1) * 5 + p_size % 5 + 1 AS INTEGER)] AS model_raw,
  lower(({_arr(MAKES)})[CAST(substr(p_brand, 7) AS INTEGER)]) AS brand_id,
  lower(p_type) || '-' || CAST(p_size % 5 AS VARCHAR) AS model_id,
  CAST(year(l_shipdate + INTERVAL 24 YEAR) AS INTEGER) AS year,
  CAST(l_quantity * 5000 AS INTEGER) AS mileage_km,
  l_extendedprice AS price_bgn,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  {_case(FUEL_RAW, 'l_returnflag')} AS fuel_raw, {_case(GEAR_RAW, 'l_linestatus')} AS gearbox_raw,
  {_case(BODY_RAW, 'o_orderpriority')} AS body_raw,
  {_case(FUEL, 'l_returnflag')} AS fuel, {_case(GEAR, 'l_linestatus')} AS gearbox,
  {_case(BODY, 'o_orderpriority')} AS body,
  CASE WHEN o_orderstatus = 'P' THEN 'EUR' ELSE 'BGN' END AS currency,
  {_case(SOURCE, 'o_orderstatus')} AS source,
  l_suppkey AS seller_id,
  ({_arr(CITIES)})[s_nationkey % 8 + 1] AS region,
  CAST(60 + p_size * 5 AS INTEGER) AS power_hp,
  {_CREATED} AS created_at, {_CREATED} - to_days(CAST(o_custkey % 30 AS INTEGER)) AS first_seen_at,
  o_orderstatus <> 'F' AS is_active,
  ({_arr(MAKES)})[CAST(substr(p_brand, 7) AS INTEGER)] || ' ' ||
    ({_arr(MODEL_SPELLINGS)})[CAST((list_position({_arr(TYPES)}, p_type) - 1) * 5 + p_size % 5 + 1 AS INTEGER)] || ' ' || p_name AS title,
  repeat(({_arr(PHRASES)})[CAST(o_custkey % 12 + 1 AS INTEGER)] || '. ', l_linenumber) AS description,
  CAST(l_linenumber * 2 - 1 AS INTEGER) AS image_count,
  o_orderpriority AS priority, o_orderstatus AS status, o_custkey AS customer_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_extendedprice, l_quantity, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem) x
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
WHERE rn = 1
"""


def with_l(*ctes: str) -> str:
    """``WITH l AS (...), <ctes...>`` prefix of a checking query."""
    return "WITH " + ", ".join([f"l AS MATERIALIZED ({L_BODY})", *ctes]) + "\n"


# --- stored state derived from the same tables ---------------------------------
def ad_id(col: Column) -> Column:
    """Site ad id of a listing: 17 digits."""
    return F.concat(F.lit("17"), F.lpad(col.cast("string"), 15, "0"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L as the stored normalized table: with raw_id, updated_at and the duplicate mark."""
    return listings(spark, sf_dir).withColumns({
        "raw_id": F.col("listing_id"), "updated_at": F.col("created_at"),
        "is_duplicate": (F.col("status") == "F") & (F.col("priority") == "5-LOW")})


N_CTE = "n AS (SELECT *, listing_id AS raw_id, created_at AS updated_at, (status = 'F' AND priority = '5-LOW') AS is_duplicate FROM l)"


def raw(df: DataFrame) -> DataFrame:
    """The raw table behind the listings: a JSON document per row.

    4-NOT SPECIFIED rows have no document; hybrid rows lack the brand; EUR rows
    spell the price as text.
    """
    doc = F.to_json(F.struct(
        F.when(F.col("fuel") != "hybrid", F.col("make")).alias("brand"), F.col("model_raw").alias("model"),
        F.col("year").cast("string").alias("year"), F.col("cents").alias("price_cents"), F.col("price_bgn").alias("price"),
        F.col("mileage_km"), "fuel", "gearbox", "currency", F.col("region"), "title", "description"))
    return df.select(
        F.col("listing_id").alias("raw_id"), "listing_id", "source", ad_id(F.col("listing_id")).alias("site_ad_id"),
        F.concat(F.lit("https://www.mobile.bg/obiava-"), ad_id(F.col("listing_id")), F.lit("-"), "brand_id").alias("url"),
        F.when(F.col("priority") != "4-NOT SPECIFIED", doc).alias("parsed_data"), "first_seen_at",
        F.col("created_at").alias("last_seen_at"), F.col("created_at").alias("updated_at"), "is_active", "created_at")


R_CTE = """r AS (SELECT listing_id AS raw_id, listing_id, source, ('17' || lpad(CAST(listing_id AS VARCHAR), 15, '0')) AS site_ad_id,
  'https://www.mobile.bg/obiava-' || ('17' || lpad(CAST(listing_id AS VARCHAR), 15, '0')) || '-' || brand_id AS url,
  priority <> '4-NOT SPECIFIED' AS has_doc, CASE WHEN fuel <> 'hybrid' THEN make END AS doc_brand, model_raw AS doc_model,
  year AS doc_year, price_bgn AS doc_price, mileage_km AS doc_km, first_seen_at, created_at AS last_seen_at, created_at AS updated_at,
  is_active, created_at FROM l)"""

SCORED = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def scores(df: DataFrame) -> DataFrame:
    """Stored scores of the listings that were scored before (by priority)."""
    score = F.round(F.lit(1.0) + (F.col("cents") % 901) / 100.0, 2)
    return df.filter(F.col("priority").isin(*SCORED)).select(
        "listing_id", score.alias("score"), F.when(score >= 7.5, "approved").when(score >= 6, "draft").otherwise("rejected").alias("final_state"),
        (F.col("created_at") + F.expr("interval 2 hours")).alias("scored_at"))


S_CTE = f"""s AS (SELECT listing_id, round(1.0 + (cents % 901) / 100.0, 2)::DOUBLE AS score, created_at + INTERVAL 2 HOUR AS scored_at,
  CASE WHEN round(1.0 + (cents % 901) / 100.0, 2) >= 7.5 THEN 'approved' WHEN round(1.0 + (cents % 901) / 100.0, 2) >= 6 THEN 'draft' ELSE 'rejected' END AS final_state
  FROM l WHERE priority IN {SCORED})"""


# --- pages rendered from the listings --------------------------------------------
MONTHS = ("Януари", "Февруари", "Март", "Април", "Май", "Юни", "Юли", "Август", "Септември", "Октомври", "Ноември", "Декември")
COLORS = ("Червен", "Черен", "Бял", "Син")
BODY2 = {"1-URGENT": "Седан", "2-HIGH": "Джип", "3-MEDIUM": "Комби", "5-LOW": "Хечбек"}


def spaced(col: Column) -> Column:
    return F.replace(F.format_number(col, 0), F.lit(","), F.lit(" "))


def pages_first(df: DataFrame) -> DataFrame:
    """First-source pages, one per listing: [page_id, url, html] plus the status columns."""
    c, lit = F.col, F.lit
    whole = c("price_bgn").cast("int")
    td = lambda k, v: F.concat(lit(f"<tr><td>{k}:</td><td>"), v, lit("</td></tr>"))
    eur = c("currency") == "EUR"
    price = F.when(eur, F.concat(spaced(whole), lit(" €"))).otherwise(
        F.concat(spaced(F.floor(whole / 2)), lit(" €<br>"), spaced(whole), lit(" лв.")))
    ld = F.to_json(F.struct(
        c("title").alias("name"), c("description"), F.struct(whole.cast("string").alias("price"), c("currency").alias("priceCurrency")).alias("offers"),
        F.when(c("image_count") <= 5, F.concat(lit("//cdn.example/"), c("listing_id").cast("string"), lit(".jpg"))).alias("image"),
        F.when(c("image_count") > 5, F.array(F.concat(lit("//cdn.example/"), c("listing_id").cast("string"), lit(".jpg")), lit("/more.jpg"))).alias("images")))
    ld = F.regexp_replace(ld, '"images":', '"image":')
    img = lambda *parts: F.concat(lit('<img src="'), *parts, lit('">'))
    id_ = c("listing_id").cast("string")
    gallery = F.concat(lit('<div class="pic big"><div class="frame">'), img(lit("//cdn.example/"), id_, lit("_Small.jpg")), img(lit("//cdn.example/"), id_, lit("_Small.jpg")),
                       lit('</div><div><div>'), img(lit("/photo/"), id_, lit("_Thumb.jpg")), lit('</div></div><img data-src="https://cdn.example/x.png">'), img(lit("/no-image.png")), lit("</div>"))
    rows = F.concat(
        F.when(c("gearbox") == "automatic", F.concat(td("Марка", c("make")), td("Модел", c("model_raw")))).otherwise(""),
        td("Пробег", F.concat(spaced(c("mileage_km")), lit(" км"))), td("Гориво", c("fuel_raw")), td("Скоростна кутия", c("gearbox_raw")),
        F.coalesce(td("Категория", c("body_raw")), lit("")), td("Двигател", F.concat(c("power_hp").cast("string"), lit(" к.с. "), (c("power_hp") * 10).cast("string"), lit(" куб"))),
        td("Населено място", c("region")),
        F.concat(lit("<tr><th>Година</th><td>"), c("year").cast("string"), lit("</td></tr><tr><th>Мощност</th><td>"), c("power_hp").cast("string"), lit(" к.с.</td></tr>")))
    gone = (c("status") == "F") & (c("priority") == "1-URGENT")
    html = F.concat(
        lit("<html><head><title>"), c("make"), lit(" "), c("model_raw"), lit(", "), c("year").cast("string"), lit("г.</title>"),
        F.when(c("fuel") != "hybrid", F.concat(lit('<script type="application/ld+json">'), ld, lit("</script>"))).otherwise(""),
        lit("</head><body><h1>"), c("title"), lit('</h1><div class="Price">'), price, lit("</div>"),
        F.when(gone, "<p>Обявата е изтрита или не е активна</p>").otherwise(""),
        lit("<table>"), rows, lit('</table><div class="description">'), F.replace("description", lit(" "), lit(" <div></div>")), lit("</div>"), gallery,
        lit('<span class="phone">0888'), c("seller_id").cast("string"), lit('</span><div class="sellerName">Seller '), c("seller_id").cast("string"),
        lit('</div><div class="location">'), c("region"), lit("</div></body></html>"))
    url = F.when(c("priority") == "5-LOW", F.concat(lit("https://www.mobile.bg/ad/"), id_)).otherwise(
        F.concat(lit("https://www.mobile.bg/obiava-"), ad_id(c("listing_id")), lit("-"), F.replace(c("brand_id"), lit("-"), lit("")), lit("-"), F.regexp_extract("model_id", "^[a-z]+", 0), lit("-"), id_))
    return df.select(c("listing_id").alias("page_id"), url.alias("url"), html.alias("html"))


def pages_second(df: DataFrame) -> DataFrame:
    """Second-source pages, one per listing."""
    c, lit = F.col, F.lit
    id_ = c("listing_id").cast("string")
    gear = F.when(c("gearbox") == "automatic", "Автоматични").otherwise("Ръчни")
    money = F.concat(c("price_bgn").cast("int").cast("string"), F.when(c("currency") == "EUR", " EUR").otherwise(" BGN"))
    details = F.concat_ws(", ", F.concat(pick(MONTHS, F.month("created_at") - 1), lit(" "), c("year").cast("string")), code(BODY2, c("priority")),
                          F.when(c("status") == "O", "Нов автомобил").otherwise("Употребяван автомобил"), c("fuel_raw"), F.concat(spaced(c("mileage_km")), lit("км")),
                          F.concat(gear, lit(" скорости")), F.concat(c("power_hp").cast("string"), lit("к.с.")), lit("EURO 6"),
                          F.concat((c("power_hp") * 10).cast("string"), lit("см3")), lit("4/5 врати"), pick(COLORS, c("seller_id") % 4))
    html = F.concat(lit("<html><head><title>CARS.BG - "), c("make"), lit(" "), c("model_raw"), lit(", "), money, lit(", "), c("fuel_raw"),
                    lit('</title></head><body><div class="text-copy">'), details, lit('</div><div class="text-copy">'), c("description"),
                    lit('</div><td>'), F.when(c("status") == "P", "Фирма").otherwise("Частно лице"), lit('</td><span class="seller">Seller '), c("seller_id").cast("string"),
                    lit('</span><div class="location">'), c("region"), lit('</div><a href="tel:+359888'), c("seller_id").cast("string"),
                    lit('">call</a><img src="https://g1-bg.cars.bg/2025-10-16_1/'), id_, lit('o.jpg"><img src="https://www.cars.bg/logo.png"></body></html>'))
    return df.select(c("listing_id").alias("page_id"), F.concat(lit("https://www.cars.bg/offer/"), F.lower(F.hex("listing_id"))).alias("url"), html.alias("html"))
