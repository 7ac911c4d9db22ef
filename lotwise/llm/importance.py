"""Quality selection by importance resampling.

Two generative models of hashed n-grams of words and punctuation, case kept, are counted: one of target text (documents
labelled good), one of all raw text.  A document's importance is the ratio of the
probabilities that the two give its n-grams; documents are sampled without replacement in
proportion to it by the Gumbel top-k trick: a Gumbel number made from a hash of the doc_id is
added to the log ratio, and the k largest are taken.

The target model is counted on a bounded sample of labelled documents (``TARGET_DOCS``,
chosen by a hash of the doc_id); the raw model and the selection cover all documents.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common
from lotwise.llm.decontaminate import Words
from lotwise.session import staged

BUCKET_BITS, ORDERS = 14, (1, 2)
BUCKETS = 1 << BUCKET_BITS
#: Bytes of words (letters, digits, non-ASCII) and of punctuation; control characters and spaces part them.
KINDS = np.full(256, 2, dtype=np.uint8)
KINDS[:33] = KINDS[127] = 0
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = KINDS[128:] = 1
#: Labelled documents, about, that the target model is counted on.
TARGET_DOCS = 20_000
#: Share of the documents that is sampled.
SHARE = 0.5
SMOOTHING = 1.0
#: Bins of one pass of the threshold search, and keys that are looked at singly in the end.
BINS, FEW = 2048, 10_000


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text of each."""
    words = Words(texts, KINDS, lower=False)
    found, owners = [], []
    for order in ORDERS:
        hashes, whole = words.grams(order)
        at = np.flatnonzero(whole)
        found.append((hashes[at] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(words.text[at])
    return np.concatenate(found), np.concatenate(owners)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for whole in batches:
        for batch in common.slices(whole, 0, 2 << 20):
            counts += np.bincount(grams(list(common.texts_of(batch.column(0))))[0], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])


def model(docs: DataFrame) -> np.ndarray:
    """Smoothed probability of each bucket in ``docs``: one row per bucket is collected."""
    rows = common.arrow_map(docs.select("text"), _count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.full(BUCKETS, SMOOTHING)
    for row in rows:
        counts[row["bucket"]] += row["n"]
    return counts / counts.sum()


def target_sample(docs: DataFrame, labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """Documents labelled good (quality 1 and not toxic), about ``most`` of them."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    share = min(1.0, most / max(1, good.count()))
    chosen = good.where(F.pmod(F.xxhash64("good_id"), F.lit(1 << 20)) < share * (1 << 20))
    # bounded by ``most``, so it may be broadcast
    return docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("good_id"), "left_semi")


def _score(batches: Iterator[pa.RecordBatch], ratio) -> Iterator[pa.RecordBatch]:
    table = ratio.value
    for whole in batches:
        for batch in common.slices(whole, 1, 2 << 20):
            buckets, owner = grams(list(common.texts_of(batch.column(1))))
            weight = np.bincount(owner, weights=table[buckets], minlength=batch.num_rows)
            n = np.bincount(owner, minlength=batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(weight)], names=["doc_id", "n_grams", "log_ratio"])


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest ``key`` of a table, by counts in bins that close in on it; None if there are fewer than k rows."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    inside = keys
    while n > FEW and low < high:
        step = (high - low) / BINS
        if low + step <= low:
            break
        spot = F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1)).cast("int")
        counts = sorted(((r["spot"], r["n"], r["low"], r["high"]) for r in inside.groupBy(spot.alias("spot"))
                         .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()), reverse=True)
        for _, n, low, high in counts:
            if k <= n:
                break
            k -= n
        inside = keys.where(F.col("key").between(low, high))
    if low == high:
        return low
    # equal keys are counted, so many repeated rows stay one row here
    for key, n in sorted(((r["key"], r["n"]) for r in inside.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if k <= n:
            return key
        k -= n
    return None


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: str = "resample") -> DataFrame:
    """Per row of ``docs``: doc_id, n_grams, log_ratio, key (log ratio plus Gumbel noise), selected.

    ``share`` of the rows, rounded up, are selected; all rows that tie with the last one are,
    such as repetitions of a row.  A null text has no n-grams and a ratio of one.  Without
    labelled documents all ratios come from the smoothing alone.  Other columns are ignored.
    """
    ratio = np.log(model(target_sample(docs, labels))) - np.log(model(docs))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    scored = common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: _score(it, sent), "doc_id long, n_grams long, log_ratio double")
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = staged(scored.withColumn("key", F.col("log_ratio") - F.log(-F.log(u))), "resample")
    least = kth_largest(keyed, int(np.ceil(share * keyed.count())))
    return keyed.withColumn("selected", F.lit(False) if least is None else F.col("key") >= least)
