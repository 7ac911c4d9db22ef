"""Registered queries: normalization and table maintenance."""
from pyspark.sql import functions as F

from lotwise import rules as R
from lotwise.functions import text as T
from lotwise.operators import maintain as A, normalize as N
from lotwise.plans import base as B
from lotwise.plans.q_score import _list
from lotwise.plans.q_select import HOLE_CTE, MINED_CTE, _holes, worklist
from lotwise.plans.registry import query
from lotwise.session import scratch
from lotwise.sources import io as IO

D = "::DOUBLE"


def clean_sql(col: str) -> str:
    return rf"regexp_replace(lower(regexp_replace(trim({col}), '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s-]', '', 'g')"


@query("text_clean", B.with_l() + f"SELECT listing_id, {clean_sql('title')} AS clean FROM l")
def text_clean(spark, d):
    return B.listings(spark, d).select("listing_id", T.text_clean(F.col("title")).alias("clean"))


def _mappings(spark, d):
    """Seed dictionary plus the dictionary rows mined from the listings' own make and model spelling."""
    seed = IO.seed(spark, "brand_models")
    mined = B.listings(spark, d).groupBy("make", "model_id").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2").select(
        F.struct(F.lit(1).alias("list"), F.lit(0).alias("at"), F.col("make").alias("a"), F.col("model_id").alias("b")).alias("ord"), F.col("make").alias("brand"), F.col("model_id").alias("model"),
        F.lower("make").alias("normalized_brand"), F.col("model_id").alias("normalized_model"),
        F.array(F.replace("model_id", F.lit("-"), F.lit(" "))).alias("aliases"), F.lit(True).alias("active"))
    first = F.struct(F.lit(0).alias("list"), F.col("ord").alias("at"), F.lit("").alias("a"), F.lit("").alias("b"))
    return seed.withColumn("ord", first).unionByName(mined)


SEED_ROWS = ", ".join(f"({i}, '{b}', '{m}', '{nb}', '{nm}', {_list(al)})" for i, (b, m, nb, nm, al) in enumerate(R.BRAND_MODELS))
SEED_CTE = f"""sd AS (SELECT * FROM (VALUES {SEED_ROWS}) t(ord, brand, model, nb, nm, al)),
 sk AS (SELECT lower(brand) AS bk, lower(k.mk) AS mk, nb, nm, ord * 1000 + k.p AS place FROM sd,
  LATERAL (SELECT unnest(list_prepend(model, al)) AS mk, unnest(range(len(al) + 1)) AS p) k)"""
DICT_CTE = f"""{SEED_CTE}, dm AS (SELECT DISTINCT lower(make) AS bk, model_id, mk FROM (SELECT make, model_id FROM l GROUP BY ALL HAVING count(*) >= 2),
  LATERAL (SELECT unnest([model_id, replace(model_id, '-', ' ')]) AS mk) k)"""


@query("alias_dictionary", B.with_l(DICT_CTE) + "SELECT bk AS brand_key, mk AS model_key, nb AS norm_brand, nm AS norm_model FROM sk UNION ALL SELECT bk, mk, bk, model_id FROM dm")
def alias_dictionary(spark, d):
    return N.alias_dictionary(_mappings(spark, d)).select("brand_key", "model_key", "norm_brand", "norm_model")


PAIR_CTE = f"pr AS (SELECT DISTINCT make, model_raw, {clean_sql('make')} AS b, {clean_sql('model_raw')} AS m FROM l)"


@query("alias_lookup", B.with_l(SEED_CTE, PAIR_CTE) + "SELECT listing_id, nb AS norm_brand, nm AS norm_model FROM l JOIN pr USING (make, model_raw) LEFT JOIN sk ON b = bk AND m = mk")
def alias_lookup(spark, d):
    return N.alias_lookup(B.listings(spark, d), N.alias_dictionary(IO.seed(spark, "brand_models"))).select("listing_id", "norm_brand", "norm_model")


FUZZY_CTE = r"""fz AS (SELECT make, model_raw, arg_min(nb, k) AS nb, arg_min(nm, k) AS nm FROM (SELECT *, CASE WHEN m = mk THEN -1 ELSE place END AS k,
   list_filter(string_split(m, ' '), lambda x: x <> '') AS ta, list_filter(string_split(mk, ' '), lambda x: x <> '') AS tb FROM pr JOIN sk ON b = bk)
  WHERE m = mk OR len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE >= 0.8 GROUP BY ALL)"""


@query("fuzzy_jaccard_join", B.with_l(SEED_CTE, PAIR_CTE, FUZZY_CTE) + "SELECT listing_id, nb AS norm_brand, nm AS norm_model FROM l LEFT JOIN fz USING (make, model_raw)")
def fuzzy_jaccard_join(spark, d):
    return N.fuzzy_jaccard_join(B.listings(spark, d), N.alias_dictionary(IO.seed(spark, "brand_models"))).select("listing_id", "norm_brand", "norm_model")


@query("enum_map", B.with_l() + "SELECT listing_id, fuel, gearbox, body FROM l")
def enum_map(spark, d):
    return N.enum_map(B.listings(spark, d)).select("listing_id", "fuel", "gearbox", "body")


@query("range_validity", B.with_l() + """SELECT listing_id, CASE WHEN km BETWEEN 0 AND 1000000 THEN km END AS mileage_km, CASE WHEN y BETWEEN 1900 AND 2026 THEN y END AS year
  FROM (SELECT listing_id, mileage_km * (seller_id % 9 - 1) AS km, CAST(year + (seller_id % 4) * 2 - 3 AS INTEGER) AS y FROM l)""")
def range_validity(spark, d):
    # stretched values put part of the rows outside both ranges
    df = B.listings(spark, d).withColumns({"mileage_km": F.col("mileage_km") * (F.col("seller_id") % 9 - 1),
                                           "year": (F.col("year") + (F.col("seller_id") % 4) * 2 - 3).cast("int")})
    return N.range_validity(df, F.lit(2025)).select("listing_id", "mileage_km", "year")


@query("fx_convert", B.with_l() + f"""SELECT listing_id, currency, round(CAST(cents * CASE currency WHEN 'EUR' THEN 196 ELSE 100 END AS DECIMAL(18,0)) / 10000, 2){D} AS price_in_bgn FROM l""")
def fx_convert(spark, d):
    return N.fx_convert(B.listings(spark, d)).select("listing_id", "currency", "price_in_bgn")


@query("content_hash", "SELECT doc_id, sha256(text) AS description_hash FROM documents")
def content_hash(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("description_hash"))


@query("seller_key", B.with_l() + """SELECT listing_id, sha256(phone) AS phone_sha, md5(local) AS phone_hash, md5('cars_bg_' || coalesce(name, loc, md5(local))) AS seller_hash
  FROM (SELECT listing_id, 'tel:+359888' || seller_id AS phone, '0888' || seller_id AS local, CASE WHEN status = 'F' THEN 'Seller ' || seller_id END AS name, CASE WHEN status = 'O' THEN region END AS loc FROM l)""")
def seller_key(spark, d):
    df = B.listings(spark, d).withColumns({
        "phone": F.concat(F.lit("tel:+359888"), F.col("seller_id").cast("string")),
        "name": F.when(F.col("status") == "F", F.concat(F.lit("Seller "), F.col("seller_id").cast("string"))).otherwise(F.when(F.col("status") == "O", "")),
        "place": F.when(F.col("status") == "O", F.col("region"))})
    return N.seller_key(df, "name", "place", "phone").select("listing_id", "phone_sha", "phone_hash", "seller_hash")


@query("dictionary_mining", B.with_l() + """SELECT brand, model, listings, replace(brand, '#', '') AS norm_brand, replace(model, '#', '') AS norm_model FROM (
  SELECT lower(make) AS brand, lower(model_raw) AS model, count(*) AS listings FROM l GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 1000)
  WHERE NOT contains(model, '!') AND NOT contains(model, '.') AND NOT contains(model, '/') AND (brand, model) NOT IN (SELECT (lower(brand), lower(model)) FROM (VALUES """
       + ", ".join(f"('{b}', '{m}')" for b, m, *_ in R.BRAND_MODELS) + """) t(brand, model))
  UNION ALL SELECT brand, model, listings, brand, regexp_replace(model, '[!./]', '', 'g') FROM (SELECT lower(make) AS brand, lower(model_raw) AS model, count(*) AS listings FROM l GROUP BY 1, 2
  HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 1000) WHERE contains(model, '!') OR contains(model, '.') OR contains(model, '/')""")
def dictionary_mining(spark, d):
    df = B.listings(spark, d).withColumns({"brand_id": F.lower("make"), "model_id": F.lower("model_raw")})
    return N.dictionary_mining(df, IO.seed(spark, "brand_models")).select("brand", "model", "listings", "norm_brand", "norm_model")


@query("brand_urls", B.with_l() + f"""SELECT brand, slug, 'https://www.mobile.bg/obiavi/avtomobili-dzhipove/' || slug AS url, brand IN {R.PRIORITY_BRANDS} AS priority
  FROM (SELECT DISTINCT make AS brand, replace(lower(make), ' ', '-') AS slug FROM l)""")
def brand_urls(spark, d):
    return worklist(B.listings(spark, d)).filter(F.col("type") == "brand").select("brand", "slug", "url", "priority")


@query("normalize_listings", B.with_l(SEED_CTE, PAIR_CTE, FUZZY_CTE) + f"""SELECT listing_id, nb AS norm_brand, nm AS norm_model, fuel, gearbox, body, mileage_km, year,
  round(CAST(cents * CASE currency WHEN 'EUR' THEN 196 ELSE 100 END AS DECIMAL(18,0)) / 10000, 2){D} AS price_in_bgn, sha256(description) AS description_hash, 1 AS listing_version
  FROM l LEFT JOIN fz USING (make, model_raw)""")
def normalize_listings(spark, d):
    return N.normalize_listings(B.listings(spark, d), N.alias_dictionary(IO.seed(spark, "brand_models")), F.lit(2025)).select(
        "listing_id", "norm_brand", "norm_model", "fuel", "gearbox", "body", "mileage_km", "year", "price_in_bgn", "description_hash", "listing_version")


# --- maintenance ----------------------------------------------------------------------
def sightings(spark, d):
    """Every order line is a sighting of its listing; the address carries the line number."""
    lines = B.table(spark, d, "lineitem")
    ad = B.ad_id(F.col("l_orderkey"))
    return lines.select(
        F.lit("mobile_bg").alias("source"), ad.alias("site_ad_id"), F.concat(F.lit("https://www.mobile.bg/obiava-"), ad, F.lit("?line="), F.col("l_linenumber").cast("string")).alias("url"),
        F.concat(F.lit('{"qty":'), F.col("l_quantity").cast("int").cast("string"), F.lit("}")).alias("parsed_data"), F.expr("l_shipdate + interval 24 years").alias("seen_at"),
        (F.col("l_returnflag") != "R").alias("is_active"))


SEEN_CTE = """sg AS (SELECT ('17' || lpad(CAST(l_orderkey AS VARCHAR), 15, '0')) AS site_ad_id, 'https://www.mobile.bg/obiava-' || ('17' || lpad(CAST(l_orderkey AS VARCHAR), 15, '0')) || '?line=' || l_linenumber AS url,
  '{"qty":' || CAST(l_quantity AS INTEGER) || '}' AS parsed_data, l_shipdate + INTERVAL 24 YEAR AS seen_at, l_returnflag <> 'R' AS is_active FROM lineitem)"""


def stored_raw(spark, d):
    """Raw rows stored before this run: listings of closed and open orders."""
    df = B.listings(spark, d).filter(F.col("status") != "P")
    return B.raw(df).select("source", "site_ad_id", "url", "parsed_data", "first_seen_at", "last_seen_at", "is_active")


@query("upsert_listings", B.with_l(B.R_CTE, SEEN_CTE, """g AS (SELECT site_ad_id, max({'a': seen_at, 'b': url, 'c': is_active}) AS x, min({'a': seen_at, 'b': url, 'c': parsed_data}) AS f FROM sg GROUP BY 1)""",
                                   "o AS (SELECT * FROM r WHERE source = 'mobile_bg')")
       + """SELECT site_ad_id, CASE WHEN o.last_seen_at IS NULL OR x.a >= o.last_seen_at THEN x.b ELSE o.url END AS url, o.first_seen_at IS NULL AS is_new, least(o.first_seen_at, f.a) AS first_seen_at,
  greatest(x.a, o.last_seen_at) AS last_seen_at, CASE WHEN o.last_seen_at IS NULL OR x.a >= o.last_seen_at THEN x.c ELSE o.is_active END AS is_active, CASE WHEN o.first_seen_at IS NULL THEN f.c END AS new_doc FROM o FULL JOIN g USING (site_ad_id)""")
def upsert_listings(spark, d):
    out = A.upsert_listings(stored_raw(spark, d), sightings(spark, d))
    fresh = F.get_json_object("parsed_data", "$.qty").isNotNull()
    return out.select("site_ad_id", "url", fresh.alias("is_new"), "first_seen_at", "last_seen_at", "is_active", F.when(fresh, F.col("parsed_data")).alias("new_doc"))


@query("new_listings_anti", B.with_l(B.R_CTE, SEEN_CTE) + """SELECT site_ad_id, min({'a': seen_at, 'b': url}).b AS url FROM sg WHERE site_ad_id NOT IN (SELECT site_ad_id FROM r WHERE source = 'mobile_bg') GROUP BY 1""")
def new_listings_anti(spark, d):
    return A.new_listings(sightings(spark, d), stored_raw(spark, d)).select("site_ad_id", "url")


@query("inactive_sweep", B.with_l(B.R_CTE) + """SELECT raw_id, CASE WHEN source = 'mobile_bg' AND raw_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount < 0.05) THEN false ELSE is_active END AS is_active FROM r""")
def inactive_sweep(spark, d):
    # this run saw the listings that have a line with a small discount
    seen = B.table(spark, d, "lineitem").filter("l_discount < 0.05").select(F.lit("mobile_bg").alias("source"), B.ad_id(F.col("l_orderkey")).alias("site_ad_id"))
    return A.inactive_sweep(B.raw(B.listings(spark, d)), seen, "mobile_bg").select("raw_id", "is_active")


@query("merge_coalesce", B.with_l(B.N_CTE, HOLE_CTE, B.R_CTE) + """SELECT raw_id, CASE WHEN has_doc THEN coalesce(doc_brand, h.brand_id) ELSE h.brand_id END AS brand_id,
  CASE WHEN has_doc THEN doc_model ELSE h.model_id END AS model_id, h.year, h.price_bgn FROM h JOIN r USING (raw_id)""")
def merge_coalesce(spark, d):
    df = B.normalized(spark, d)
    parsed = A.json_fields(B.raw(df).filter("parsed_data is not null"), "parsed_data", A.DOC_FIELDS).select("raw_id", "brand", "model", "year", "price")
    return A.merge_coalesce(_holes(df), parsed).select("raw_id", "brand_id", "model_id", "year", "price_bgn")


@query("latest_per_key", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn = 1")
def latest_per_key(spark, d):
    t = B.table(spark, d, "conversations")
    return A.latest_per_key(t.filter("role = 'user'"), t.filter("role <> 'user'"), "conv_id", "turn")


@query("repair_from_raw", B.with_l(B.N_CTE, HOLE_CTE, B.R_CTE) + """SELECT raw_id, CASE WHEN fix THEN doc_brand ELSE brand_id END AS brand_id, CASE WHEN fix THEN doc_model ELSE model_id END AS model_id, fix AS repaired
  FROM (SELECT h.raw_id, h.brand_id, h.model_id, doc_brand, doc_model, h.brand_id IS NULL AND has_doc AND doc_brand IS NOT NULL AS fix FROM h JOIN r USING (raw_id))""".replace("h.brand_id, h.model_id", "CASE WHEN h.status = 'O' THEN NULL ELSE h.brand_id END AS brand_id, h.model_id").replace("h.brand_id IS NULL AND", "(h.brand_id IS NULL OR h.status = 'O') AND"))
def repair_from_raw(spark, d):
    # listings of open orders lost their brand
    df = B.normalized(spark, d)
    holes = _holes(df).withColumn("brand_id", F.when(F.col("status") == "O", None).otherwise(F.col("brand_id")))
    return A.repair_from_raw(holes, B.raw(df)).select("raw_id", "brand_id", "model_id", "repaired")


def html_raw(df):
    """Raw rows with page columns: closed orders kept their page, the others only its path."""
    r = B.raw(df).join(df.select(F.col("listing_id").alias("raw_id"), "status"), "raw_id")
    return r.withColumns({"raw_html": F.when(F.col("status") == "F", "<html></html>"), "raw_html_path": F.when(F.col("status") != "P", F.concat(F.lit("raw/"), "site_ad_id", F.lit(".html")))})


@query("cleanup_unusable", B.with_l(B.R_CTE) + """SELECT count(*) FILTER (bad) AS deleted, count(*) FILTER (NOT bad) AS remaining, count(*) FILTER (NOT bad AND status = 'F') AS with_html,
  count(*) FILTER (NOT bad AND has_doc) AS with_document FROM (SELECT r.*, l.status, l.status = 'O' AND NOT has_doc AS bad FROM r JOIN l USING (listing_id))""")
def cleanup_unusable(spark, d):
    return A.cleanup_unusable(html_raw(B.listings(spark, d)))[1]


@query("dim_get_or_create", B.with_l() + """SELECT 'old-' || s_suppkey AS id, s_suppkey AS seller_id FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT sha256(CAST(seller_id AS VARCHAR)), seller_id FROM (SELECT DISTINCT seller_id FROM l WHERE seller_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0))""")
def dim_get_or_create(spark, d):
    dim = B.table(spark, d, "supplier").filter("s_acctbal >= 0").select(F.concat(F.lit("old-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("seller_id"))
    return A.dim_get_or_create(dim, B.listings(spark, d), "seller_id")


def named_raw(df):
    """Raw rows with the source spelled as it arrives; a few come from an unknown source."""
    r = B.raw(df).join(df.select(F.col("listing_id").alias("raw_id"), "status", "image_count"), "raw_id")
    name = F.when(F.col("image_count") == 13, "Unknown.bg").when(F.col("status") == "F", "Mobile.bg").when(F.col("status") == "O", "mobile_bg").otherwise("Cars.bg")
    return r.withColumn("source_name", name)


def dispatched(spark, d):
    df = B.listings(spark, d)
    pages = B.pages_first(df).select(F.col("page_id").alias("raw_id"), "html")
    # pages of open orders were lost
    kept = pages.join(df.filter("status <> 'O'").select(F.col("listing_id").alias("raw_id")), "raw_id", "left_semi")
    return A.source_dispatch(named_raw(df), kept)


DISPATCH_CTE = """dp AS (SELECT l.*, has_doc, doc_brand, CASE WHEN image_count = 13 THEN NULL WHEN status = 'P' THEN 'cars_bg' ELSE 'mobile_bg' END AS src,
  CASE WHEN image_count = 13 THEN 'none' WHEN has_doc THEN 'document' WHEN status = 'F' THEN 'page' ELSE 'none' END AS how FROM l JOIN r USING (listing_id))"""


@query("source_dispatch", B.with_l(B.R_CTE, DISPATCH_CTE) + """SELECT listing_id AS raw_id, src AS source, how AS parsed_by, CASE WHEN how <> 'none' THEN year END AS year, CASE WHEN how <> 'none' THEN mileage_km END AS mileage_km,
  CASE how WHEN 'document' THEN price_bgn WHEN 'page' THEN trunc(price_bgn) END AS price, CASE how WHEN 'document' THEN fuel WHEN 'page' THEN fuel_raw END AS fuel,
  CASE how WHEN 'document' THEN doc_brand WHEN 'page' THEN CASE brand_id WHEN 'mercedes-benz' THEN 'mercedes' ELSE make END END AS brand FROM dp""")
def source_dispatch(spark, d):
    return dispatched(spark, d).select("raw_id", "source", "parsed_by", "year", "mileage_km", "price", "fuel", "brand")


@query("parse_errors", B.with_l(B.R_CTE, DISPATCH_CTE) + """SELECT listing_id AS raw_id, CASE WHEN src IS NULL THEN 'No parser for source' ELSE 'Failed to extract structured data' END AS error FROM dp WHERE how = 'none'""")
def parse_errors(spark, d):
    return A.parse_errors(dispatched(spark, d))


@query("json_fields", B.with_l(B.R_CTE) + """SELECT raw_id, CASE WHEN has_doc THEN doc_brand END AS brand, CASE WHEN has_doc THEN doc_model END AS model, CASE WHEN has_doc THEN doc_year END AS year,
  CASE WHEN has_doc THEN doc_price END AS price, CASE WHEN has_doc THEN doc_km END AS mileage_km FROM r""")
def json_fields(spark, d):
    return A.json_fields(B.raw(B.listings(spark, d)), "parsed_data", A.DOC_FIELDS).select("raw_id", "brand", "model", "year", "price", "mileage_km")


@query("table_scan", B.with_l() + "SELECT CAST(listing_id AS VARCHAR) AS listing_id, CAST(price_bgn AS DECIMAL(10,2))::DOUBLE AS price_bgn, created_at AS seen_at FROM l")
def table_scan(spark, d):
    folder = scratch(spark, "tables")
    ident = F.col("listing_id").cast("string")
    rows = B.listings(spark, d).select(ident.alias("id"), ident.alias("listing_id"), F.col("price_bgn").cast("decimal(10,2)").alias("price_bgn"), F.col("created_at").alias("seen_at"))
    rows.write.parquet(f"{folder}/prices_history")
    return IO.table_scan(spark, folder, "prices_history").select("listing_id", F.col("price_bgn").cast("double").alias("price_bgn"), "seen_at")


# observations come in two appends, partitioned by year
@query("append_log", B.with_l() + "SELECT year(created_at) AS seen_year, count(*) AS n, count(DISTINCT listing_id) AS ids FROM l GROUP BY 1")
def append_log(spark, d):
    path = scratch(spark, "log")
    rows = B.listings(spark, d).select("listing_id", "price_bgn", F.year("created_at").alias("seen_year"))
    IO.append(rows.filter("listing_id % 2 = 0"), path, ["seen_year"])
    IO.append(rows.filter("listing_id % 2 = 1"), path, ["seen_year"])
    return spark.read.parquet(path).groupBy(F.col("seen_year").cast("bigint").alias("seen_year")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("listing_id").alias("ids"))


# seed rows as they are, next to the listings that use them
@query("seed_tables", B.with_l() + f"""SELECT s.brand, s.model, count(l.listing_id) AS listings FROM (VALUES {', '.join(f"('{b}', '{m}')" for b, m, *_ in R.BRAND_MODELS)}) s(brand, model)
  LEFT JOIN l ON lower(s.brand) = l.brand_id GROUP BY ALL""")
def seed_tables(spark, d):
    seed = IO.seed(spark, "brand_models").select("brand", "model", F.lower("brand").alias("brand_id"))
    return seed.join(B.listings(spark, d).select("brand_id", "listing_id"), "brand_id", "left").groupBy("brand", "model").agg(F.count("listing_id").alias("listings"))


@query("config_explode", B.with_l() + """SELECT make AS owner, type, model, estimated FROM (
  SELECT make, 'brand' AS type, NULL AS model, CAST(count(*) AS INTEGER) AS estimated FROM l GROUP BY 1 UNION ALL SELECT make, 'model', model_id, CAST(count(*) AS INTEGER) FROM l GROUP BY 1, 3)""")
def config_explode(spark, d):
    # one configuration document per brand; old documents use the other key spelling
    w = worklist(B.listings(spark, d))
    item = F.struct("type", "brand", "model", "url", "priority", F.col("estimated").cast("int").alias("estimated_listings"))
    lists = w.groupBy("brand").agg(F.collect_list(item).alias("s"))
    old = F.length("brand") % 2 == 0
    docs = lists.select(F.col("brand").alias("owner"), F.when(old, F.to_json(F.struct(F.col("s").alias("search_urls")))).otherwise(F.to_json(F.struct(F.col("s").alias("searches")))).alias("value"))
    path = scratch(spark, "configs")
    docs.write.partitionBy("owner").text(path)
    return IO.config_explode(spark, path).select("owner", "type", "model", "estimated")
