"""Scans and sinks: tables, pages, JSON configuration, logs, seeds."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from lotwise import rules as R
from lotwise.operators import normalize as N
from lotwise.operators.alerts import plan_table

# stored tables of the engine, as DDL
SCHEMAS = {
    "sources": "id string, name string, base_url string, enabled boolean, crawl_interval_s int",
    "listings_raw": "id string, source_id string, site_ad_id string, url string, raw_html_path string, raw_html string, parsed_data string, "
                    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, is_active boolean, http_status int, etag string, "
                    "last_modified string, parse_errors string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "brand_models": "id string, brand string, model string, normalized_brand string, normalized_model string, aliases array<string>, locale string, active boolean",
    "listings_normalized": "id string, raw_id string, brand_id string, model_id string, year int, mileage_km int, fuel string, gearbox string, body string, "
                           "price_bgn decimal(10,2), currency string, region string, title string, description string, features map<string,string>, "
                           "description_hash string, first_image_hash string, listing_version int, is_duplicate boolean, duplicate_of string, "
                           "seller_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "images": "id string, listing_id string, url string, hash string, index int",
    "sellers": "id string, phone_hash string, contact_count int, blacklist boolean",
    "prices_history": "id string, listing_id string, price_bgn decimal(10,2), seen_at timestamp_ntz",
    "comps_cache": "listing_id string, predicted_price_bgn decimal(10,2), discount_pct double, sample_size int, p10 decimal(10,2), p50 decimal(10,2), "
                   "p90 decimal(10,2), computed_at timestamp_ntz, model_version string",
    "evaluations": "listing_id string, flags struct<red_flags:array<struct<category:string,keyword:string>>,positive_flags:array<struct<category:string,keyword:string>>>, "
                   "risk_level string, llm_summary string, llm_confidence double, rule_confidence double, model_versions map<string,string>",
    "scores": "listing_id string, score double, reasons array<string>, freshness_bonus double, liquidity double, risk_penalty double, final_state string, scored_at timestamp_ntz",
    "plans": "name string, limits struct<max_alerts:int,delay_minutes:int,daily_alert_cap:int>, price_bgn double",
    "users": "id string, telegram_id bigint, plan_id string, created_at timestamp_ntz",
    "subscriptions": "id string, user_id string, plan_id string, status string, started_at timestamp_ntz, ends_at timestamp_ntz",
    "alerts": "id string, user_id string, dsl_query string, normalized_filters map<string,string>, active boolean",
    "alert_matches": "alert_id string, listing_id string, matched_at timestamp_ntz, notified boolean",
    "channel_posts": "listing_id string, channel string, posted_at timestamp_ntz",
    "dedupe_signatures": "listing_id string, title_trgm string, title_minhash string, desc_minhash string, first_image_phash string, embedding array<float>",
    "duplicates_log": "listing_id string, duplicate_of string, method string, score double",
}


def table_scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its declared schema: no inference, columns pruned by the reader."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def page_scan(spark: SparkSession, rows: DataFrame, files: str | None = None) -> DataFrame:
    """rows[page_id, url, html(, path)]: the page from the column, else from the file at ``path`` below ``files``.

    Files lie on any file system; paths are compared without scheme and host.
    """
    plain = lambda path: F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:(?://[^/]*)?", "")
    if files is None:
        return rows.select("page_id", "url", "html")
    texts = spark.read.option("recursiveFileLookup", "true").text(files, wholetext=True) \
        .select(F.col("value"), plain(F.input_file_name()).alias("file"))
    at = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(files.rstrip("/") + "/"), "path"))
    return rows.withColumn("file", plain(at)).join(texts, "file", "left").select("page_id", "url", F.coalesce("html", "value").alias("html"))


CONFIG_SCHEMA = (
    "searches array<struct<type:string,brand:string,model:string,url:string,priority:boolean,estimated_listings:int>>, "
    "search_urls array<struct<type:string,brand:string,model:string,url:string,priority:boolean,estimated_listings:int>>")


def config_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    """Search lists of configuration documents, either key spelling, one row per search."""
    parsed = docs.withColumn("c", F.from_json(F.col(column), CONFIG_SCHEMA))
    return parsed.withColumn("s", F.explode(F.coalesce("c.searches", "c.search_urls"))).select(
        *[c for c in docs.columns if c != column], "s.type", "s.brand", "s.model", "s.url",
        F.coalesce("s.priority", F.lit(False)).alias("priority"), F.coalesce("s.estimated_listings", F.lit(0)).alias("estimated"))


def config_explode(spark: SparkSession, path: str) -> DataFrame:
    return config_rows(spark.read.text(path, wholetext=True))


def watch_config(spark: SparkSession, path: str) -> list[dict]:
    """Watch targets of a monitor configuration file (a few dozen at most)."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("watch_targets").alias("t")).select("t.name", "t.filters").collect()
    return [{"name": r["name"], **{k: v for k, v in r["filters"].asDict().items() if v is not None}} for r in rows]


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files as [file, ts, line]; the time is the leading stamp of the line.

    A log in parts, ``file=name/part``, has the name of its folder.
    """
    lines = spark.read.text(path)
    name = F.col("file") if "file" in lines.columns else F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return lines.select(
        name.alias("file"),
        F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1).try_cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("line"))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only logs: price observations, duplicate decisions, alert matches."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replaces only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table bucketed on its join keys, for repeated comparable look-ups without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def seed(spark: SparkSession, name: str) -> DataFrame:
    """Static dimension rows: sources, plans, brand_models."""
    if name == "sources":
        return spark.createDataFrame(list(R.SOURCES), "name string, base_url string, enabled boolean, crawl_interval_s int")
    if name == "plans":
        return plan_table(spark)
    if name == "brand_models":
        return N.brand_models(spark)
    raise ValueError(f"no seed rows for {name}")
