"""Table maintenance: upserts, sweeps, merges, repairs, dimensions, error routing."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lotwise import rules as R
from lotwise.functions import cols as C
from lotwise.operators import extract as X

AD = ["source", "site_ad_id"]


def upsert_listings(current: DataFrame, seen: DataFrame) -> DataFrame:
    """current[source, site_ad_id, url, parsed_data, first_seen_at, last_seen_at, is_active] x sightings.

    A known ad gets its url, last_seen_at and is_active from the newest sighting,
    unless the stored row is newer; its first_seen_at only moves back, and it keeps
    its parsed_data.  An unknown ad starts with its first sighting.  Sightings
    shrink to one row per ad before the join, and may come in any order.
    """
    tie = ("seen_at", "url")
    newest = seen.groupBy(*AD).agg(
        F.max(F.struct(*tie, "is_active")).alias("new"), F.min(F.struct(*tie, "parsed_data")).alias("start"))
    both = current.join(newest, AD, "full_outer")
    later = F.col("new").isNotNull() & (F.col("last_seen_at").isNull() | (F.col("new.seen_at") >= F.col("last_seen_at")))
    return both.select(
        *AD, F.when(later, F.coalesce("new.url", "url")).otherwise(F.col("url")).alias("url"),
        F.when(F.col("first_seen_at").isNull(), F.col("start.parsed_data")).otherwise(F.col("parsed_data")).alias("parsed_data"),
        F.least("first_seen_at", "start.seen_at").alias("first_seen_at"),
        F.greatest("new.seen_at", "last_seen_at").alias("last_seen_at"),
        F.when(later, F.coalesce("new.is_active", F.lit(True))).otherwise(F.col("is_active")).alias("is_active"))


def new_listings(seen: DataFrame, known: DataFrame, key: str = "site_ad_id") -> DataFrame:
    """The first sighting of every ad that is not known yet."""
    first = seen.filter(C.text(F.col(key)).isNotNull()).groupBy(key).agg(F.min(F.struct("seen_at", "url")).alias("x"))
    return first.join(known.select(key), key, "left_anti").select(key, "x.*")


def inactive_sweep(current: DataFrame, seen: DataFrame, source: str) -> DataFrame:
    """Active ads of the source that this run did not see become inactive."""
    ids = seen.filter(F.col("source") == source).select(*AD).distinct().withColumn("here", F.lit(True))
    gone = (F.col("source") == source) & F.col("is_active") & F.col("here").isNull()
    return current.join(ids, AD, "left").withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active"))).drop("here")


# parsed field -> stored column; a later entry wins over an earlier one
FIELD_MAP = (("brand", "brand_id"), ("model", "model_id"), ("year", "year"), ("mileage_km", "mileage_km"), ("fuel", "fuel"),
             ("fuel_type", "fuel"), ("gearbox", "gearbox"), ("body", "body"), ("body_type", "body"), ("price", "price_bgn"),
             ("currency", "currency"), ("region", "region"), ("title", "title"), ("description", "description"))


def merge_coalesce(base: DataFrame, parsed: DataFrame, key: str = "raw_id", field_map=FIELD_MAP) -> DataFrame:
    """A parsed field that is not null replaces the stored one."""
    p = parsed.select(key, *[F.col(c).alias(f"p_{c}") for c in parsed.columns if c != key])
    joined = base.join(p, key, "left")
    stored = {}
    for field, column in field_map:
        if field in parsed.columns and column in base.columns:
            stored[column] = [F.col(f"p_{field}"), *stored.get(column, [F.col(column)])]
    return joined.withColumns({c: F.coalesce(*cols) for c, cols in stored.items()}).select(*base.columns)


def latest_per_key(base: DataFrame, updates: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key: the newest of stored rows and updates; a combinable maximum, no sort."""
    rest = [c for c in base.columns if c not in (key, ts)]
    top = base.unionByName(updates).groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("x"))
    return top.select(key, "x.*")


def repair_from_raw(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """Fills brand and model of rows without a brand from the raw document."""
    doc = raw.select("raw_id", F.get_json_object("parsed_data", "$.brand").alias("doc_brand"), F.get_json_object("parsed_data", "$.model").alias("doc_model"))
    fix = F.col("brand_id").isNull() & F.col("doc_brand").isNotNull()
    return normalized.join(doc, "raw_id", "left").withColumns({
        "model_id": F.when(fix, F.col("doc_model")).otherwise(F.col("model_id")),
        "repaired": fix, "brand_id": F.when(fix, F.col("doc_brand")).otherwise(F.col("brand_id"))}).drop("doc_brand", "doc_model")


def cleanup_unusable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, summary): rows with a page path but neither page nor document go."""
    bad = F.col("raw_html").isNull() & F.col("raw_html_path").isNotNull() & F.col("parsed_data").isNull()
    summary = raw.agg(F.count_if(bad).alias("deleted"), F.count_if(~bad).alias("remaining"),
                      F.count_if(~bad & F.col("raw_html").isNotNull()).alias("with_html"),
                      F.count_if(~bad & F.col("parsed_data").isNotNull()).alias("with_document"))
    return raw.filter(~bad), summary


def dim_get_or_create(dim: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Existing dimension rows plus one new row per unknown key, with a key-derived id."""
    unknown = keys.select(key).dropna().distinct().join(dim.select(key), key, "left_anti")
    return dim.select("id", key).unionByName(unknown.select(F.sha2(F.col(key).cast("string"), 256).alias("id"), key))


# --- parsing stage -------------------------------------------------------------------
def json_fields(df: DataFrame, column: str, fields: dict) -> DataFrame:
    """Typed columns of a JSON document; a value that does not convert is NULL."""
    doc = F.from_json(F.col(column), ", ".join(f"`{f}` string" for f in fields))
    return df.withColumn("doc", doc).withColumns({f: F.col(f"doc.{f}").try_cast(t) for f, t in fields.items()}).drop("doc")


DOC_FIELDS = {"brand": "string", "model": "string", "year": "int", "mileage_km": "int", "price": "double", "currency": "string",
              "fuel": "string", "gearbox": "string", "region": "string", "title": "string", "description": "string"}


def source_dispatch(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """raw[raw_id, source_name, url, parsed_data] x pages[raw_id, html].

    The document comes first, the page second; the second source's model string
    is split into its parts.  Unknown sources and rows with neither have no fields.
    """
    names = F.create_map(*[F.lit(x) for kv in R.SOURCE_ALIASES for x in kv])
    known = raw.withColumn("source", F.element_at(names, F.col("source_name")))
    docs = X.model_string_split(json_fields(known, "parsed_data", DOC_FIELDS))
    second = F.col("source") == "cars_bg"
    docs = docs.withColumns({
        "model": F.when(second, F.coalesce("model_base", "model")).otherwise(F.col("model")),
        "fuel": F.when(second, F.coalesce(C.text(F.col("fuel")), F.initcap("engine_type"))).otherwise(F.col("fuel"))})
    # only pages that will be used are fetched and parsed
    asked = known.filter((F.col("source") == "mobile_bg") & F.col("parsed_data").isNull())
    page = X.page_fields(pages.join(asked.select("raw_id", "url"), "raw_id")).select(
        "raw_id", F.struct(F.col("brand").alias("brand"), F.col("model").alias("model"), F.col("year").alias("year"), F.col("mileage_km").alias("mileage_km"),
                           F.col("price").cast("double").alias("price"), F.col("currency").alias("currency"), F.col("fuel_raw").alias("fuel"),
                           F.col("gearbox_raw").alias("gearbox"), F.col("region").alias("region"), F.col("page_title").alias("title"),
                           F.col("description").alias("description")).alias("page"))
    joined = docs.join(page, "raw_id", "left")
    use_doc = F.col("source").isNotNull() & F.col("parsed_data").isNotNull()
    use_page = F.col("source").isNotNull() & F.col("parsed_data").isNull() & (F.col("source") == "mobile_bg")
    how = F.when(F.col("source").isNull(), "none").when(use_doc, "document").when(use_page & F.col("page").isNotNull(), "page").otherwise("none")
    return joined.select("raw_id", "source", how.alias("parsed_by"),
                         *[F.when(how == "document", F.col(f)).when(how == "page", F.col(f"page.{f}")).alias(f) for f in DOC_FIELDS])


PARSE_ERROR = "Failed to extract structured data"


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Rows that leave the flow, with the recorded text."""
    return parsed.filter(F.col("parsed_by") == "none").select(
        "raw_id", F.when(F.col("source").isNull(), "No parser for source").otherwise(PARSE_ERROR).alias("error"))


def union_all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
