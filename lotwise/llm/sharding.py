"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows of equal text are a group and stay together.  Groups are ordered by the MD5 of their
text; the smallest capacity with which a greedy run over the ordered sizes needs no more than
the given shards is found by binary search, and the shards are cut there.  A group that alone
is over an even share of what is left has a shard of its own, before the others.

The driver never holds the sizes of all groups: the order is first summed over a few thousand
ranges of the hash, and only ranges in which some cut may still fall are refined, until they
are single groups.
"""
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import staged

SHARDS = 16
#: Bits of the order hash; of the first ranges; and how many each refinement adds.
HASH_BITS, FIRST_BITS, MORE_BITS = 60, 12, 8


def cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy: where each further shard begins, if no shard may hold more than ``capacity``; None if ``shards`` don't do."""
    ends, at, found = np.cumsum(sizes), 0, []
    for _ in range(shards):
        at = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + capacity, side="right"))
        if at >= len(ends):
            return found
        found.append(at)
    return None


def least_capacity(sizes: np.ndarray, shards: int, low: int, high: int) -> int:
    """The smallest feasible capacity from ``low`` to ``high`` (feasible)."""
    while low < high:
        middle = (low + high) // 2
        if cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


@dataclass
class Ranges:
    """Ranges of the order hash with groups in them, in order: first hash, bits that are fixed, bytes, largest group, groups."""
    first: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    largest: np.ndarray
    n: np.ndarray

    def open(self, shards: int) -> tuple[np.ndarray, int, int]:
        """Ranges of several groups in which a cut may fall, and bounds of the least capacity."""
        total = int(self.size.sum())
        low = max(int(self.largest.max()), -(-total // shards))
        high = least_capacity(self.size, shards, max(low, int(self.size.max())), total)
        ends = np.cumsum(self.size)
        near, far, mine = 0, 0, np.zeros(len(self.size), dtype=bool)
        for _ in range(shards - 1):
            # the earliest a shard can end: at capacity low, short of a whole range; the latest: at capacity high
            first = int(np.searchsorted(ends, near + low, side="right"))
            near = int(ends[first - 1]) if first else 0
            far = min(total, far + high)
            mine[first: int(np.searchsorted(ends, far, side="right")) + 1] = True
        return np.flatnonzero(mine & (self.n > 1) & (self.bits < HASH_BITS)), low, high


def _summed(groups: DataFrame, bits: Column) -> DataFrame:
    """Sums by range, where ``bits`` of the hash are fixed."""
    return (groups.withColumn("bits", bits).withColumn("first", _head("bits"))
            .groupBy("first", "bits").agg(F.sum("bytes").alias("size"), F.max("bytes").alias("largest"), F.count(F.lit(1)).alias("n")))


def _head(bits) -> Column:
    """The order hash with all but the first ``bits`` bits zero."""
    return F.expr(f"shiftleft(shiftright(hi, {HASH_BITS} - {bits}), {HASH_BITS} - {bits})")


def _arrays(rows: list) -> Ranges:
    rows = sorted(rows, key=lambda r: r["first"])
    return Ranges(*(np.array([r[name] for r in rows], dtype=np.int64) for name in ("first", "bits", "size", "largest", "n")))


def balanced_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Order hashes at which each shard but the first begins; ``groups``: hi, bytes."""
    ranges = _arrays(_summed(groups, F.lit(FIRST_BITS)).collect())
    if not len(ranges.first) or shards < 2:
        return []
    while True:
        wide, low, high = ranges.open(shards)
        if not len(wide):
            return [int(ranges.first[at]) for at in cuts(ranges.size, least_capacity(ranges.size, shards, low, high), shards)]
        spark = groups.sparkSession
        asked = spark.createDataFrame([(int(ranges.first[i]), int(ranges.bits[i])) for i in wide], "start long, fixed int")
        # ranges are disjoint, so each group meets the one it lies in, by its hash cut to that range's bits
        widths = sorted({int(ranges.bits[i]) for i in wide})
        keyed = groups.withColumn("k", F.explode(F.array(*(F.struct(F.lit(w).alias("fixed"), _head(w).alias("start")) for w in widths))))
        inside = keyed.select("hi", "bytes", "k.fixed", "k.start").join(asked, ["start", "fixed"])
        fresh = _summed(inside, F.least(F.col("fixed") + MORE_BITS, F.lit(HASH_BITS))).collect()
        kept = np.setdiff1d(np.arange(len(ranges.first)), wide)
        rows = [{name: int(getattr(ranges, name)[i]) for name in ("first", "bits", "size", "largest", "n")} for i in kept]
        ranges = _arrays(rows + [row.asDict() for row in fresh])


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs``: doc_id, tie (hash of the text), size, text_crc32, law, shard, slot, grown_shard.

    A null text is an empty one.  Slots number the rows of a shard from 0.  Rows that repeat
    a document are rows of the same group.  Other columns are ignored; an empty table gives
    no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                              F.md5(text).alias("mark"), F.xxhash64("text").alias("tie")), "shard-rows")
    hi = F.conv(F.substring("mark", 1, 15), 16, 10).cast("long")
    groups = staged(rows.groupBy("mark").agg(F.sum("size").alias("bytes")).select("mark", hi.alias("hi"), "bytes"), "shard-groups")
    rest, giants = int(groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]), []
    for row in groups.orderBy(F.desc("bytes"), "mark").limit(shards - 1).collect():
        if row["bytes"] * (shards - len(giants)) < rest:
            break
        giants.append(row["mark"])
        rest -= row["bytes"]
    small = groups.where(~F.col("mark").isin(giants)) if giants else groups
    begins = balanced_cuts(small.select("hi", "bytes"), shards - len(giants))
    place = F.lit(len(giants))
    for at in begins:
        place = place + (F.col("hi") >= at).cast("int")
    for number, mark in enumerate(giants):
        place = F.when(F.col("mark") == mark, number).otherwise(place)
    # slots: rows of a shard are dealt into about as many parts as a part has rows
    n_parts = max(1, int((rows.count() / shards) ** 0.5))
    put = rows.withColumn("hi", hi).select("doc_id", "tie", "size", "text_crc32", "mark", place.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n_parts)).cast("int").alias("part"))
    ahead = (put.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
             .select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("ahead")))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "mark")) - 1
    return (put.join(ahead, ["shard", "part"]).withColumn("slot", F.col("ahead") + inside)
            .select("doc_id", "tie", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The rows of ``docs`` as one folder per shard, each in the order of its slots."""
    placed = assign(docs, shards).groupBy(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie")).agg(F.first("shard").alias("__shard"), F.min("slot").alias("__slot"))
    rows = docs.join(placed, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__tie")))
    (rows.repartition("__shard").sortWithinPartitions("__shard", "__slot").select(*docs.columns, "__shard")
     .write.partitionBy("__shard").parquet(path))
