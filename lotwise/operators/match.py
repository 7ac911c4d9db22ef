"""Duplicate detection.

Set-at-a-time rule: a listing may only be linked to an *earlier* listing
(created_at, then id), so the result does not depend on processing order.
Every link table has the columns listing_id, duplicate_of and, where the
method measures it, sim.
"""
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.functions import cols as C, text as T
from lotwise.functions.ranges import time_slices
from lotwise.session import remove, scratch, staged, written

WHEN = ("created_at", "listing_id")


def dedupe_signature(df: DataFrame) -> DataFrame:
    parts = [F.lower(C.text(F.col("brand_id"))), F.lower(C.text(F.col("model_id"))),
             C.present(F.col("year")).cast("string"), F.lower(C.text(F.col("fuel"))), F.lower(C.text(F.col("gearbox")))]
    return df.withColumn("signature", F.concat_ws(" ", *parts))


def new_signatures(signatures: DataFrame, stored: DataFrame) -> DataFrame:
    """Signatures are written once per listing."""
    return signatures.join(stored.select("listing_id"), "listing_id", "left_anti")


def first_of_value(df: DataFrame, keys: list[str]) -> DataFrame:
    """Links every row to the earliest row with the same key values: one combinable minimum, no pairs."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*WHEN)).alias("first"))
    return df.join(first, keys).filter(F.struct(*WHEN) > F.col("first")) \
        .select("listing_id", F.col("first.listing_id").alias("duplicate_of"))


def desc_hash_dups(df: DataFrame, text: str = "description") -> DataFrame:
    hashed = df.withColumn("h", T.description_hash(F.col(text))).filter("h is not null")
    return first_of_value(hashed, ["h"])


def image_url_dups(images: DataFrame, first_n: int = 3) -> DataFrame:
    """images[listing_id, created_at, source, index, url]: a shared url among the first images, same source.

    The image with the lowest position that has an earlier owner decides.
    """
    shown = images.filter(F.col("index") < first_n)
    owner = images.filter(F.col("url") != "").groupBy("source", "url").agg(F.min(F.struct(*WHEN)).alias("first"))
    hit = shown.join(owner, ["source", "url"]).filter(F.col("first") < F.struct(*WHEN))
    return hit.groupBy("listing_id").agg(F.min_by("first.listing_id", F.struct("index", "first")).alias("duplicate_of"))


# --- same seller, similar price ---------------------------------------------------
SELLER_KEYS = ["seller_id", "brand_id", "model_id"]
GROUP_BUCKETS = 1 << 16  # groups are counted by buckets, so that the counts stay few
HOT_ROWS = 1_000_000  # the groups of a larger bucket are cut into slices of time of about as many rows
TASK_ROWS = 500_000  # about as many rows as a task sorts


def seller_price_dups(df: DataFrame) -> DataFrame:
    """Newest earlier listing of the same seller, brand and model within 10 % of the price.

    A listing without a price is not held to one: the newest earlier listing counts.
    Each row is shuffled once, to its group and slice of time, and sorted there by time; the
    search (``_newest_earlier``) is exact and holds one slice.  Only a bucket of more than HOT_ROWS
    rows has several slices: what a slice leaves open is then asked of the rows that
    earlier slices hand on, which are the newest ones of each price.
    """
    rows = df.dropna(subset=SELLER_KEYS).filter(~F.coalesce("is_duplicate", F.lit(False))) \
        .select(*SELLER_KEYS, *WHEN, C.present(F.col("cents")).cast("bigint").alias("cents"))
    bucket = F.pmod(F.xxhash64(*SELLER_KEYS), F.lit(GROUP_BUCKETS))
    sizes = staged(rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size")), "seller-sizes")
    total, largest = sizes.agg(F.sum("size"), F.max("size")).first()
    sliced = (largest or 0) > HOT_ROWS
    if sliced:
        rows = time_slices(rows.withColumn("bucket", bucket), "bucket", sizes.filter(F.col("size") > HOT_ROWS), HOT_ROWS).drop("bucket", "slices")
    else:
        rows = rows.withColumn("slice", F.lit(-1))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_ROWS))
    band = {"lo": F.expr("(cents * 9 + 9) div 10"), "hi": F.expr("(cents * 11) div 10"), "kind": F.lit("row")}
    dealt = rows.repartition(tasks, *SELLER_KEYS, "slice").sortWithinPartitions(*SELLER_KEYS, "slice", *WHEN, "cents").withColumns(band)
    id_type = df.schema["listing_id"].dataType.simpleString()
    links = f"listing_id {id_type}, duplicate_of {id_type}"
    if not sliced:
        return dealt.mapInArrow(_newest_earlier(False), links)
    # links, open rows and rows handed on stand in one table
    told = staged(dealt.mapInArrow(_newest_earlier(True), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", duplicate_of {id_type}"), "seller-slices")
    # an open row comes before what its own slice hands on
    later = told.filter("kind <> 'link'").repartition(*SELLER_KEYS).sortWithinPartitions(*SELLER_KEYS, "slice", F.col("kind") == "held", *WHEN, "cents") \
        .select(*dealt.columns).withColumn("slice", F.lit(0))
    return told.filter("kind = 'link'").select("listing_id", "duplicate_of").unionByName(later.mapInArrow(_newest_earlier(False), links))


def _newest_earlier(sliced: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by group, slice and time -> listing_id, duplicate_of of each row that has a match in its slice.

    ``kind`` is ``row``, or ``open`` for a row that only asks and ``held`` for one that is only found.
    ``sliced``: gives all columns and duplicate_of, with kind ``link``, and besides the rows that stay
    open and those that later slices may find.  Rows look back over 1, 2, 4 ... rows at once.
    Rows that are not settled after d rows are more than 10 % apart in price wherever they are less
    than d rows apart, so they are few, and all looks of a group cost its rows times their logarithm.
    """
    keys, when = tuple(SELLER_KEYS), tuple(WHEN)
    free, cells, flush = -(1 << 63) + 1, 1 << 22, 250_000

    def changes(table: pa.Table, names) -> np.ndarray:
        """Whether a row differs from the one before it."""
        out = np.ones(table.num_rows, dtype=bool)
        out[1:] = False
        for name in names:
            column = table.column(name).combine_chunks()
            one, other = column.slice(1), column.slice(0, max(len(column) - 1, 0))
            out[1:] |= pc.fill_null(pc.not_equal(one, other), False).to_numpy(zero_copy_only=False)
            out[1:] |= pc.not_equal(pc.is_null(one), pc.is_null(other)).to_numpy(zero_copy_only=False)
        return out

    def numbers(table: pa.Table, name: str, missing: int) -> np.ndarray:
        return pc.fill_null(table.column(name), missing).to_numpy()

    def look_back(ask, first, end, price, lo, hi) -> np.ndarray:
        """Of each row of ``ask`` the last position from ``first`` to before ``end`` with a price in its band, -1 without one."""
        found, width = np.full(len(price), -1, dtype=np.int64), 1
        end = end.copy()
        ask = ask[(end[ask] > first[ask]) & (lo[ask] <= hi[ask])]
        while len(ask):
            for at in range(0, len(ask), max(1, cells // width)):
                some = ask[at:at + max(1, cells // width)]
                for back in range(0, width, cells):  # newest first
                    steps = np.arange(back + 1, min(width, back + cells) + 1)
                    spot = end[some][:, None] - steps[None, :]
                    near = price[np.maximum(spot, 0)]
                    hit = (spot >= first[some][:, None]) & (near >= lo[some][:, None]) & (near <= hi[some][:, None])
                    any_hit = hit.any(axis=1) & (found[some] < 0)
                    found[some[any_hit]] = spot[any_hit, hit[any_hit].argmax(axis=1)]
            end[ask] -= width
            width *= 2
            ask = ask[(found[ask] < 0) & (end[ask] > first[ask])]
        return found

    def handed_on(start: int, stop: int, price: np.ndarray) -> np.ndarray:
        """Rows of a slice that a later row may find.

        No band of 10 % to either side ends on both sides inside a price cell of ratio 1.1, so of a cell
        only rows below or above all newer prices of it can be the newest in a band.
        """
        kept, place = [np.array([stop - 1])], np.arange(stop - 1, start - 1, -1)
        place = place[price[place] > 0]
        cell = np.floor(np.log(price[place].astype(np.float64)) / np.log(1.1))
        order = np.argsort(cell, kind="stable")
        for part in np.split(place[order], np.flatnonzero(np.diff(cell[order])) + 1):
            for sign in (1, -1):
                value = price[part] * sign
                kept.append(part[np.concatenate([[True], value[1:] < np.minimum.accumulate(value)[:-1]])] if len(part) else part)
        return np.unique(np.concatenate(kept))

    def search(table: pa.Table) -> pa.Table:
        place = np.arange(table.num_rows)
        group = changes(table, (*keys, "slice"))
        moment = group | changes(table, when)
        repeated = ~(moment | changes(table, ("cents",)))
        first, end = np.maximum.accumulate(np.where(group, place, 0)), np.maximum.accumulate(np.where(moment, place, 0))
        kind = table.column("kind")
        stored, asks = (pc.not_equal(kind, other).to_numpy() for other in ("open", "held"))
        price = np.where(stored, numbers(table, "cents", free), free - 1)  # less than any band holds
        lo, hi = numbers(table, "lo", free), numbers(table, "hi", (1 << 63) - 1)
        found = look_back(place[asks & ~repeated], first, end, price, lo, hi)
        hit = np.flatnonzero(found >= 0)
        ids = table.column("listing_id").combine_chunks()
        if not sliced:
            return pa.table([ids.take(pa.array(hit)), ids.take(pa.array(found[hit]))], names=["listing_id", "duplicate_of"])

        def some(rows, name, owners):
            out = table.take(pa.array(rows)).drop_columns(["kind"])
            return out.append_column("kind", pa.array([name] * len(rows), pa.string())).append_column("duplicate_of", owners)
        left = np.flatnonzero((found < 0) & ~repeated & (lo <= hi))
        bounds, slices = [*np.flatnonzero(group), table.num_rows], table.column("slice").to_numpy()
        held = np.concatenate([np.empty(0, dtype=np.int64), *[handed_on(a, b, price) for a, b in zip(bounds, bounds[1:]) if slices[a] >= 0]])
        nothing = lambda rows: pa.nulls(len(rows), ids.type)
        left = left[slices[left] > 0]  # nothing is earlier than the first slice
        return pa.concat_tables([some(hit, "link", ids.take(pa.array(found[hit]))), some(left, "open", nothing(left)), some(held, "held", nothing(held))])

    def batches_of(batches):
        waiting, count, due = [], 0, flush
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= due:
                table = pa.Table.from_batches(waiting)
                last = int(np.flatnonzero(changes(table, (*keys, "slice")))[-1])
                if last:
                    yield from search(table.slice(0, last)).to_batches()
                waiting, count = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
                due = max(flush, 2 * count)
        if count:
            yield from search(pa.Table.from_batches(waiting)).to_batches()
    return batches_of


# --- trigram similarity -------------------------------------------------------------
def _packed(gram: Column) -> Column:
    """A trigram as one integer (21 bits per code point), exact and cheap to compare."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("bigint")
    return F.shiftleft(at(1), 42) + F.shiftleft(at(2), 21) + at(3)


def _bitmap(grams: Column, word: int) -> Column:
    """64 of 128 hash bits of a trigram set."""
    bit = lambda g: F.pmod(F.xxhash64(g), F.lit(128))
    mine = F.filter(grams, lambda g: F.floor(bit(g) / 64) == word)
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, g: acc.bitwiseOR(F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod(bit(g), F.lit(64)).cast("int"))))


def trigram_similarity(sigs: DataFrame, threshold: float = 0.8, min_length: int = 10) -> DataFrame:
    """sigs[listing_id, created_at, signature] -> most similar earlier listing above the threshold.

    Listings with the same trigram set are one candidate: its earliest listing.
    Only distinct sets are joined, on the rarest trigrams of each (two sets above
    the threshold must share one of the first |A| - ceil(t|A|) + 1 trigrams in
    rarity order).  Differing bits of two hash bitmaps never exceed the number of
    differing trigrams, so most candidates fall before the exact comparison.
    """
    # trigrams are taken once of each distinct signature; the smallest row of one stands for it
    firsts = sigs.groupBy("signature").agg(F.min(F.struct(*WHEN)).alias("first")) \
        .withColumn("grams", F.array_sort(F.transform(T.trigrams(F.col("signature")), _packed))).filter(F.size("grams") > 0)
    texts = staged(firsts, "signatures")
    long_enough = F.length("signature") >= min_length
    sets = texts.groupBy("grams").agg(F.min("first").alias("first"), F.min_by(long_enough, "first").alias("long")).withColumn("sid", F.col("first.listing_id"))
    owner = texts.filter(long_enough).select("signature", "grams").join(sets.select("grams", F.col("first").alias("owner")), "grams").select("signature", "owner")
    repeat = sigs.join(owner, "signature").filter(F.struct(*WHEN) > F.col("owner")) \
        .select("listing_id", F.col("owner.listing_id").alias("duplicate_of"), F.lit(1.0).alias("sim"))

    body = staged(sets.select("sid", "grams", "first", "long", F.size("grams").alias("size"),
                              _bitmap(F.col("grams"), 0).alias("b0"), _bitmap(F.col("grams"), 1).alias("b1")), "sets")
    spread = body.select("sid", "size", F.explode("grams").alias("g"))
    rarity = spread.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("sid").orderBy("df", "g")
    keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    prefix = spread.join(rarity, "g").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep).select("sid", "g")
    left = prefix.join(body.filter("long"), "sid")
    right = prefix.join(body, "sid").select("g", F.col("grams").alias("o_grams"), F.col("first").alias("o_first"), F.col("size").alias("o_size"),
                                             F.col("b0").alias("o_b0"), F.col("b1").alias("o_b1"))
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("o_b0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("o_b1")))
    allowed = (F.col("size") + F.col("o_size")) * ((1 - threshold) / (1 + threshold))
    both = F.size(F.array_intersect("grams", "o_grams"))
    near = left.join(right, "g").filter(
        (differ <= allowed) & (F.col("o_first") < F.col("first")) & (F.least("size", "o_size") > F.greatest("size", "o_size") * threshold)) \
        .withColumn("sim", both / (F.col("size") + F.col("o_size") - both)).filter(F.col("sim") > threshold)
    best = near.groupBy("sid").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "o_first")).alias("b")) \
        .select(F.col("sid").alias("listing_id"), F.col("b.o_first.listing_id").alias("duplicate_of"), (-F.col("b.neg")).alias("sim"))
    return repeat.unionByName(best)


# --- embedding similarity --------------------------------------------------------------
CHUNK = 2000  # vectors per side of one comparison task


def _unit() -> Callable:
    """Rows as unit vectors, whatever the size of their components; a local function, so that tasks get its code."""
    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.array(vectors.tolist(), dtype="float64")
        m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
        return m / np.linalg.norm(m, axis=1, keepdims=True)
    return unit


def metric_leaves(vecs: DataFrame, reach: float, pivots: int = 32, seed: int = 7, leaf: int | None = None) -> DataFrame:
    """vecs[vec_id, embedding] -> [cell, own, vec_id, embedding]: leaves of a metric tree.

    A vector stands in every leaf that may hold one within ``reach`` of its angle; ``own``
    marks the one leaf that holds the vector itself.  A node of more than ``leaf`` vectors (null: four
    CHUNKs, which copy a vector less often than a split may) is split by the nearest of ``pivots``
    of its own vectors; clusters that hold more than a leaf are told apart.  A vector goes to a child if its angle to the child's pivot is at
    most 2 * reach above the least one (hyperplane bound) and within ``reach`` of the angles of
    the child's own (ball bound).  A child that holds all of its node stays a leaf of any size,
    as only vectors that no pivot tells apart make one.
    """
    unit = _unit()
    columns = ["cell", "own", "vec_id", "embedding"]

    def deal(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(centres):
            return pd.DataFrame({c: [] for c in ("parent", *columns, "angle")}).astype({"own": "bool", "vec_id": "int64", "angle": "float64"})
        angle = np.arccos(np.clip(unit(rows["embedding"]) @ unit(centres.sort_values("vec_id")["embedding"]).T, -1, 1))
        at, child = np.nonzero(angle - angle.min(axis=1, keepdims=True) <= 2 * reach)
        some = rows.iloc[at]
        return pd.DataFrame({"parent": some["cell"].to_numpy(), "cell": [f"{c}/{i}" for c, i in zip(some["cell"], child)],
                             "own": some["own"].to_numpy() & (angle.argmin(axis=1)[at] == child), "vec_id": some["vec_id"].to_numpy(),
                             "embedding": some["embedding"].to_numpy(), "angle": angle[at, child]})

    schema = f"parent string, cell string, own boolean, vec_id bigint, embedding {vecs.schema['embedding'].dataType.simpleString()}, angle double"
    rows, done = vecs.select(F.size("embedding").cast("string").alias("cell"), F.lit(True).alias("own"), "vec_id", "embedding"), []
    while True:
        sizes = rows.groupBy("cell").agg(F.count_if("own").alias("n"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
        big = staged(sizes.filter(F.col("n") > (leaf or 4 * CHUNK)), "crowded")
        done.append(rows.join(big, "cell", "left_anti").select(*columns))
        if big.isEmpty():
            return reduce(DataFrame.unionByName, done)
        crowd = rows.join(big, "cell")
        first = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id"))
        centres = crowd.filter("own").withColumn("rn", first).filter(F.col("rn") <= pivots) \
            .select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(c) for c in ("cell", "vec_id", "embedding")))
        dealt = crowd.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("part", *columns)
        inner = staged(dealt.groupBy("cell", "part").cogroup(centres.groupBy("cell", "part")).applyInPandas(deal, schema), "members")
        balls = inner.filter("own").groupBy("parent", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("size")) \
            .join(big.select(F.col("cell").alias("parent"), "n"), "parent").select("cell", "low", "high", (F.col("size") == F.col("n")).alias("whole"))
        reached = inner.join(balls, "cell").filter((F.col("angle") <= F.col("high") + reach) & (F.col("angle") >= F.col("low") - reach))
        done.append(reached.filter("whole").select(*columns))
        rows = reached.filter("NOT whole").select(*columns)


def embedding_cosine(vecs: DataFrame, threshold: float = 0.85, pivots: int = 32, seed: int = 7, leaf: int | None = None) -> DataFrame:
    """vecs[vec_id, embedding] -> most similar earlier vector with cosine above the threshold, exact.

    Equal vectors are searched for once, by the earliest; the leaves that can hold a match are
    those of :func:`metric_leaves`.  Large ones are cut into chunks, so a task compares at
    most CHUNK x CHUNK vectors and returns one best row per probe.  Null or zero vectors, those
    with null or non-finite components and rows without vec_id take no part; vectors of
    different lengths are not compared.
    """
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = staged(vecs.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & fit), "vectors")
    owners = staged(rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding"), "owners")
    probes = staged(metric_leaves(owners, np.arccos(threshold) + 1e-6, pivots, seed, leaf), "leaves")
    held = probes.filter("own")
    unit = _unit()

    parts = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    piece = F.pmod(F.hash("vec_id"), F.col("parts"))
    stored = held.join(parts, "cell") \
        .select("cell", piece.alias("chunk"), "vec_id", "embedding", F.lit(True).alias("stored"))
    asked = probes.join(parts, "cell") \
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "vec_id", "embedding")
    loads = asked.groupBy("cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("groups"))
    asked = asked.join(loads, ["cell", "chunk"]).select("cell", "chunk", F.pmod(F.hash("vec_id"), F.col("groups")).alias("grp"), "vec_id", "embedding", F.lit(False).alias("stored"))
    stored = stored.join(loads, ["cell", "chunk"]).select("cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "vec_id", "embedding", "stored")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        base, ask = pdf[pdf["stored"]], pdf[~pdf["stored"]]
        if not len(base) or not len(ask):
            return pd.DataFrame({"vec_id": [], "other": [], "sim": []}).astype({"vec_id": "int64", "other": "int64", "sim": "float64"})
        base = base.sort_values("vec_id")
        sim = np.round(unit(ask["embedding"]) @ unit(base["embedding"]).T, 9)
        ids = base["vec_id"].to_numpy()
        sim[ids[None, :] >= ask["vec_id"].to_numpy()[:, None]] = -2
        at = sim.argmax(axis=1)
        top = sim[np.arange(len(ask)), at]
        keep = top > threshold
        return pd.DataFrame({"vec_id": ask["vec_id"].to_numpy()[keep], "other": ids[at][keep], "sim": top[keep]})

    found = staged(stored.unionByName(asked).groupBy("cell", "chunk", "grp").applyInPandas(best, "vec_id bigint, other bigint, sim double"), "nearest")
    # a copy has its earliest equal, or what that one is as near to
    first = owners.select("embedding", F.col("vec_id").alias("owner"))
    copies = rows.join(first, "embedding").filter(F.col("vec_id") > F.col("owner")).select("vec_id", "owner")
    links = found.unionByName(copies.select("vec_id", F.col("owner").alias("other"), F.lit(1.0).alias("sim")).filter(F.col("sim") > threshold)) \
        .unionByName(copies.join(found.filter("sim >= 1").withColumnRenamed("vec_id", "owner"), "owner").select("vec_id", "other", "sim"))
    return links.groupBy("vec_id").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "other")).alias("b")) \
        .select(F.col("vec_id").alias("listing_id"), F.col("b.other").alias("duplicate_of"), (-F.col("b.neg")).alias("sim"))


# --- cascade, marks, canonical ------------------------------------------------------------
METHODS = {"seller": ("heuristic", 0.95), "image": ("image", 0.90), "text": ("heuristic", 0.75), "embedding": ("embedding", 0.80)}


def dedupe_cascade(links: dict[str, DataFrame]) -> DataFrame:
    """Most reliable method first; one link per listing."""
    # only ids and ranks are shuffled, in a form that is added up without a sort
    union = reduce(DataFrame.unionByName, [links[name].select("listing_id", "duplicate_of", F.lit(rank).alias("rank")) for rank, name in enumerate(METHODS) if name in links])
    best = union.groupBy("listing_id").agg(F.min_by("duplicate_of", "rank").alias("duplicate_of"), F.min("rank").alias("rank"))
    of_rank = lambda i: F.element_at(F.array(*[F.lit(value[i]) for value in METHODS.values()]), F.col("rank") + 1)
    return best.select("listing_id", "duplicate_of", of_rank(0).alias("method"), of_rank(1).alias("score"))


def dedupe_marks(df: DataFrame, links: DataFrame) -> DataFrame:
    """Listings with is_duplicate and duplicate_of set from the links; the links themselves are the log."""
    link = links.select("listing_id", F.col("duplicate_of").alias("linked"))
    base = df.drop("is_duplicate", "duplicate_of")
    return base.join(link, "listing_id", "left").withColumns(
        {"is_duplicate": F.col("linked").isNotNull(), "duplicate_of": F.col("linked")}).drop("linked")


def dedupe_canonical(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Root of every link chain by pointer doubling: chain length n needs log2(n) rounds.

    Each listing has one link and links point back in time, so there are no cycles.
    Every round is written to the shared folder and the one before it deleted.
    """
    spark, path = links.sparkSession, None
    current = links.select("listing_id", F.col("duplicate_of").alias("canonical"))
    for _ in range(max_rounds):
        step = current.select(F.col("listing_id").alias("canonical"), F.col("canonical").alias("further"))
        done, path = path, scratch(spark, "canonical")
        moved = written(current.join(step, "canonical", "left").select(
            "listing_id", F.coalesce("further", "canonical").alias("canonical"), F.col("further").isNotNull().alias("moved")), path)
        if done:
            remove(spark, done)
        current = moved.select("listing_id", "canonical")
        if moved.filter("moved").isEmpty():
            break
    return current


# --- MinHash ------------------------------------------------------------------------------
#: Texts of a band bucket that a task holds twice at most; a larger bucket is cut into pairs of chunks.
BUCKET = 1_000
#: Permutation k of a shingle's code c is (a^(k+1) c + b (k+1)) mod p, in 64-bit integers; codes come from MD5.
PRIME, PERMUTE = (1 << 31) - 1, (48_271, 1_013_904_223)
#: Postings that are counted at once.
POSTINGS = 1 << 20


def _best_earlier(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """listing_id, duplicate_of, sim: of each text of a bucket the most similar earlier one, by exact shingle similarity."""
    def best_of(table: pa.Table) -> pa.Table:
        kind = pa.schema([("listing_id", table.schema.field("listing_id").type), ("duplicate_of", table.schema.field("listing_id").type), ("sim", pa.float64())])
        table = table.take(pc.sort_indices(table, sort_keys=[("created_at", "ascending"), ("listing_id", "ascending")], null_placement="at_start"))
        ids = table.column("listing_id").combine_chunks()
        place = {value: i for i, value in enumerate(sorted(set(ids.to_pylist())))}
        rank = np.array([place[value] for value in ids.to_pylist()])
        lists = table.column("shingles").combine_chunks()
        sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        shared, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        text = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(code, kind="stable")  # per shingle its texts, earliest first
        posts, first = text[order], np.searchsorted(code[order], np.arange(len(shared)))
        nth = np.empty(len(order), dtype=np.int64)  # earlier texts with the shingle
        nth[order] = np.arange(len(order)) - first[code[order]]
        bounds, rows = np.concatenate([[0], np.cumsum(sizes)]), []
        for i in range(1, len(sizes)):
            common = np.zeros(i, dtype=np.int64)
            count, start = nth[bounds[i]:bounds[i + 1]], first[code[bounds[i]:bounds[i + 1]]]
            ends = np.cumsum(count)
            for at in range(0, int(ends[-1]), POSTINGS):
                spot = np.arange(at, min(int(ends[-1]), at + POSTINGS))
                which = np.searchsorted(ends, spot, side="right")
                common += np.bincount(posts[start[which] + spot - (ends[which] - count[which])], minlength=i)[:i]
            sim = common / (sizes[:i] + sizes[i] - common)
            sim[rank[:i] == rank[i]] = -1
            best = sim.max()
            if best >= threshold:
                ties = np.flatnonzero(sim == best)
                rows.append((i, int(ties[rank[ties].argmin()]), float(best)))
        one, other = [pa.array([row[c] for row in rows], pa.int64()) for c in (0, 1)]
        return pa.table([ids.take(one), ids.take(other), pa.array([row[2] for row in rows], pa.float64())], schema=kind)
    return best_of


def _lows(count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the shingle codes of each text by their least value under each of ``count`` permutations."""
    def lows_of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("codes")
            sizes = np.asarray(pc.list_value_length(codes), dtype=np.int64)
            flat, starts = codes.flatten().to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
            lows = [np.minimum.reduceat((flat * pow(PERMUTE[0], k + 1, PRIME) + PERMUTE[1] * (k + 1) % PRIME) % PRIME, starts) for k in range(count)]
            ends = pa.array(np.arange(batch.num_rows + 1) * count, pa.int32())
            names = [name for name in batch.schema.names if name != "codes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], pa.ListArray.from_arrays(ends, pa.array(np.stack(lows, axis=1).ravel()))], names=[*names, "lows"])
    return lows_of


def minhash_dups(docs: DataFrame, text: str = "text", threshold: float = 0.7, bands: int = 8, rows: int = 2, width: int = 3) -> DataFrame:
    """docs[listing_id, created_at, text]: near copies by word-shingle MinHash bands.

    Identical texts are linked first; each of the distinct texts then meets all earlier
    texts of its band buckets, and the one of the highest exact shingle similarity, then the
    smallest id, is its link.  Large buckets are cut into pairs of chunks; tasks return one
    best row per text.  A text of fewer than ``width`` words is one shingle.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"(?U)\s+"), lambda w: w != "")
    hashed = docs.withColumn("h", F.md5(F.col(text)))
    copies = first_of_value(hashed, ["h"]).withColumn("sim", F.lit(1.0))
    firsts = hashed.join(copies.select("listing_id"), "listing_id", "left_anti").withColumn("w", words) \
        .filter(F.size("w") > 0).withColumn("grams", F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, width), " ")))) \
        .withColumns({"shingles": F.transform("grams", lambda g: F.xxhash64(g)),
                      "codes": F.transform("grams", lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 15), 16, 10).cast("bigint"), F.lit(PRIME)))})
    kept = firsts.select("listing_id", "created_at", "shingles")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    least = firsts.select(*kept.columns, "codes").mapInArrow(_lows(bands * rows), f"{shape}, lows array<bigint>")
    lows = [F.get("lows", F.lit(k)) for k in range(bands * rows)]
    keys = F.array(*[F.xxhash64(F.lit(b), *lows[b * rows:(b + 1) * rows]) for b in range(bands)])
    signed = staged(least.select(*kept.columns, keys.alias("bands")), "minhash")
    banded = signed.select("listing_id", "created_at", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("listing_id"), F.col("parts")).cast("int")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(mine, j) * F.col("parts") + F.greatest(mine, j)))
    met = (banded.join(buckets, "band").withColumn("pair", F.explode(pairs)).select("listing_id", "band", "pair")
           .join(signed.select("listing_id", "created_at", "shingles"), "listing_id"))
    id_type = signed.schema["listing_id"].dataType.simpleString()
    near = met.groupBy("band", "pair").applyInArrow(_best_earlier(threshold), f"listing_id {id_type}, duplicate_of {id_type}, sim double")
    best = near.groupBy("listing_id").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "duplicate_of")).alias("b"))
    return copies.unionByName(best.select("listing_id", F.col("b.duplicate_of").alias("duplicate_of"), (-F.col("b.neg")).alias("sim")))
