"""The listing chain as one streaming query, and the stored intake: batches against versioned tables.

Every micro-batch goes through parse, normalize, dedupe, price, risk, score and outbox.  It
joins the tables as they were before the batch and commits its own rows under its batch id: the
sinks are folders named by the version, the tables are ``Snapshot``s.  So a batch that is
repeated, after a failure at any point, decides the same and changes nothing twice.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.functions import cols as C, text as T
from lotwise.operators import alerts as AL, comps as K, flags as G, maintain as A, normalize as N, score as P
from lotwise.session import children, staged
from lotwise.sources.snapshots import Snapshot

FIELDS = {**A.DOC_FIELDS, "body": "string"}
SINKS = ("errors", "duplicates", "scores", "outbox")


@dataclass
class Stores:
    """Tables of the chain below one folder."""
    folder: str
    dictionary: Snapshot
    listings: Snapshot
    owners: Snapshot
    cells: Snapshot

    def sink(self, name: str) -> str:
        return f"{self.folder}/{name}"


def stores(spark: SparkSession, folder: str, buckets: int = 16) -> Stores:
    """``dictionary``: mapped spellings. ``listings``: what each listing adds to the prices. ``owners``: the first listing of
    each content. ``cells``: count and sum of prices by brand, model and year, kept by brand and model."""
    table = lambda name, schema, keys: Snapshot(spark, f"{folder}/{name}", schema, keys, buckets)
    return Stores(
        folder,
        table("dictionary", "brand_key string, model_key string, norm_brand string, norm_model string, ord struct<ord:int,alias_pos:int>", ["brand_key", "model_key"]),
        table("listings", "listing_id bigint, brand string, model string, year int, cents bigint, content string, is_duplicate boolean, version bigint", ["listing_id"]),
        table("owners", "content string, owner bigint", ["content"]),
        table("cells", "brand string, model string, year int, n bigint, s bigint", ["brand", "model"]))


def _parse(batch: DataFrame) -> DataFrame:
    """The newest sighting of each listing in the batch, with the fields of its document."""
    last = batch.groupBy("listing_id").agg(F.max(F.struct("created_at", "parsed_data")).alias("x")).select("listing_id", "x.*")
    return A.json_fields(last, "parsed_data", FIELDS).drop("parsed_data")


def _normalize(parsed: DataFrame, dictionary: DataFrame, as_of_year: Column) -> DataFrame:
    named = parsed.withColumnsRenamed({"brand": "make", "model": "model_raw", "price": "price_bgn", "fuel": "fuel_raw", "gearbox": "gearbox_raw", "body": "body_raw"})
    out = N.normalize_listings(named, dictionary, as_of_year)
    return out.select(
        "listing_id", "created_at", "title", "description", "region", "year", "mileage_km", "fuel", "gearbox",
        F.coalesce("norm_brand", F.lower("make")).alias("brand"), F.coalesce("norm_model", F.lower("model_raw")).alias("model"),
        F.col("price_in_bgn").alias("price_bgn"), F.round(F.col("price_in_bgn") * 100).cast("bigint").alias("cents"),
        T.content_hash(F.concat_ws("\n", "title", "description")).alias("content"))


def _dedupe(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds owner: the listing that had this content before the batch, else the earliest of the batch."""
    first = rows.groupBy("content").agg(F.min(F.struct("created_at", "listing_id")).alias("first"))
    claimed = first.join(owners, "content", "left").select("content", F.coalesce("owner", "first.listing_id").alias("owner"))
    return rows.join(claimed, "content").withColumn("is_duplicate", F.col("owner") != F.col("listing_id"))


def _cell_changes(rows: DataFrame, before: DataFrame) -> DataFrame:
    """What the batch adds to the price cells: its listings, less what the same listings added before."""
    usable = (F.col("cents") > 0) & ~F.col("is_duplicate") & F.col("brand").isNotNull() & F.col("model").isNotNull() & F.col("year").isNotNull()
    part = lambda df, sign: df.filter(usable).select("brand", "model", "year", F.lit(sign).cast("bigint").alias("n"), (F.col("cents") * sign).alias("s"))
    old = before.join(rows.select("listing_id"), "listing_id", "left_semi")
    return part(rows, 1).unionByName(part(old, -1)).groupBy("brand", "model", "year").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _add_cells(current: DataFrame, changes: DataFrame) -> DataFrame:
    both = current.unionByName(changes).groupBy("brand", "model", "year").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return both.filter("n > 0")


def _price(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Count and average price over brand, model and year +-2, from the cells."""
    keys = ["brand", "model", "year"]
    asked = rows.select(*keys).distinct()
    around = asked.withColumn("y", F.explode(F.sequence(F.col("year") - K.YEAR_BAND, F.col("year") + K.YEAR_BAND)))
    near = cells.withColumnRenamed("year", "y")
    market = around.join(near, ["brand", "model", "y"]).groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("s") / 100.0 / F.sum("n")).alias("avg_price"))
    return rows.join(market, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def process(db: Stores, as_of_year: Column, min_score: float = 7.0):
    """``foreachBatch`` body over rows listing_id, created_at, parsed_data.

    A listing that comes again replaces what it added to the prices; a document without a
    title or price goes to ``errors``; a duplicate goes to ``duplicates`` and no further.
    The outbox is written last: a batch that has it is finished, and is not done again.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        if "_SUCCESS" in children(batch.sparkSession, f"{db.sink('outbox')}/version={version}"):
            return
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{db.sink(name)}/version={version}")
        parsed = staged(_parse(batch), "chain-parsed")
        broken = C.text(F.col("title")).isNull() | F.col("price").isNull()
        put(parsed.filter(broken).select("listing_id", F.lit(A.PARSE_ERROR).alias("error")), "errors")

        normal = staged(_normalize(parsed.filter(~broken), db.dictionary.read(before=version), as_of_year), "chain-normalized")
        decided = staged(_dedupe(normal, db.owners.read(version, db.owners.touched(normal))), "chain-decided")
        put(decided.filter("is_duplicate").select("listing_id", F.col("owner").alias("duplicate_of"), F.lit("content").alias("method")), "duplicates")

        stored = staged(db.listings.read(version, db.listings.touched(decided)), "chain-stored")
        changes = staged(_cell_changes(decided, stored), "chain-cells")
        claims = decided.filter("NOT is_duplicate").groupBy("content").agg(F.min("owner").alias("owner"))
        db.owners.merge(version, claims, lambda current, new: current.unionByName(new.join(current, "content", "left_anti")))
        mine = decided.withColumn("version", F.lit(version).cast("bigint"))
        db.listings.merge(version, mine, lambda current, new: current.join(new.select("listing_id"), "listing_id", "left_anti").unionByName(new.select(*current.columns)))
        db.cells.merge(version, changes, _add_cells)

        fresh = decided.filter("NOT is_duplicate")
        priced = _price(fresh, db.cells.read(version + 1, db.cells.touched(fresh)))
        scored = staged(P.score_monitor(G.risk_keywords(priced)).drop("flags"), "chain-scored")
        put(scored.select("listing_id", "n", "avg_price", "discount_pct", "score", "risk_level"), "scores")
        sent = scored.filter((F.col("score") >= min_score) & (F.col("risk_level") != "high")).withColumn("reasons", F.lit(None).cast("array<string>"))
        put(AL.message_render(sent).select("listing_id", "score", "channel_text"), "outbox")
    return body


def results(spark: SparkSession, db: Stores) -> DataFrame:
    """One row per listing of all sinks: listing_id, outcome, duplicate_of, n, avg_price, score, risk_level, sent."""
    errors, duplicates, scores, outbox = (spark.read.parquet(db.sink(name)) for name in SINKS)
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, outcome, **known: df.select("listing_id", F.lit(outcome).alias("outcome"), *[
        known.get(c, none(kind)).alias(c) for c, kind in (("duplicate_of", "bigint"), ("n", "bigint"), ("avg_price", "double"), ("score", "double"), ("risk_level", "string"), ("sent", "boolean"))])
    sent = scores.join(outbox.select("listing_id", F.lit(True).alias("sent")), "listing_id", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))
    names = ("n", "avg_price", "score", "risk_level", "sent")
    no = F.lit(False)
    return shape(errors, "error", sent=no).unionByName(shape(duplicates, "duplicate", duplicate_of=F.col("duplicate_of"), sent=no)).unionByName(shape(sent, "scored", **{c: F.col(c) for c in names}))


# --- stored intake ---------------------------------------------------------------------------
AD_SCHEMA = "source string, site_ad_id string, url string, parsed_data string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean"


def ads(spark: SparkSession, path: str, buckets: int = 16) -> Snapshot:
    """The stored table of ads."""
    return Snapshot(spark, path, AD_SCHEMA, list(A.AD), buckets)


def store_sightings(table: Snapshot):
    """``foreachBatch`` body over sightings[source, site_ad_id, url, parsed_data, seen_at, is_active]: upserts them into the stored ads.

    Only the buckets of the ads in the batch are read and written; rows may come in any order and any number of batches late.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        seen = staged(batch, "sightings")
        table.merge(batch_id + 1, seen, A.upsert_listings)
    return body
