"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A unit vector, padded to a power of two, is turned by three rounds of random signs and a fast
Hadamard transform, and hashed to the signed axis it is nearest to.  Each of ``TABLES`` tables
has turns of its own; with ``hashes`` turns per table a bucket is the sequence of their axes.
A query visits the buckets whose axes it is nearest to, over all tables together, and is
compared with every vector in them, in double precision, on the vectors as given.

Equal vectors are one vector with the few ids that can be in a result: as many of the smallest
as are asked for, and one more for the query itself.  So very many copies don't crowd a bucket.
A bucket of more than ``CHUNK`` vectors is dealt out in chunks, each of which meets the
bucket's queries.  A query whose buckets hold fewer vectors than are asked for visits all
buckets of the first table, so it gets fewer rows only if there are fewer candidates.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import common
from lotwise.session import staged

#: Tables, turns per table, and buckets that a query visits over all tables.
TABLES, HASHES, PROBES = 8, 1, 96
CHUNK = 16_384
SEED = 7


def width(dimension: int) -> int:
    return 1 << max(1, int(dimension - 1).bit_length())


def turned(x: np.ndarray, turn: int) -> np.ndarray:
    """Rows turned by three rounds of signs and a normalised fast Hadamard transform."""
    n = width(x.shape[1])
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, n, turn]).choice([-1.0, 1.0], size=(3, n))
    for row in signs:
        y *= row
        span = 1
        while span < n:
            y = y.reshape(len(x), -1, 2, span)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            span *= 2
        y /= np.sqrt(n)
    return y


def axes(x: np.ndarray, turn: int) -> np.ndarray:
    """Nearness to each signed axis, positive axes first."""
    y = turned(x, turn)
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """The bucket of each row in each table (rows x tables); all tables have numbers of their own."""
    found = np.zeros((len(x), tables), dtype=np.int64)
    for t in range(tables):
        found[:, t] = t
        for h in range(hashes):
            near = axes(x, t * hashes + h)
            found[:, t] = found[:, t] * near.shape[1] + near.argmax(axis=1)
    return found


def probes(x: np.ndarray, tables: int, hashes: int, most: int) -> np.ndarray:
    """The ``most`` buckets each row is nearest to, over all tables (rows x at most ``most``); -1 fills up."""
    numbers, scores = [], []
    for t in range(tables):
        number, score = np.full((len(x), 1), t, dtype=np.int64), np.zeros((len(x), 1))
        for h in range(hashes):
            near = axes(x, t * hashes + h)
            number = (number[:, :, None] * near.shape[1] + np.arange(near.shape[1])).reshape(len(x), -1)
            # what the row loses against its nearest axis adds up over the turns
            score = (score[:, :, None] + (near - near.max(axis=1, keepdims=True))[:, None, :]).reshape(len(x), -1)
            if h < hashes - 1:
                keep = np.argsort(-score, axis=1, kind="stable")[:, :most]
                number, score = np.take_along_axis(number, keep, 1), np.take_along_axis(score, keep, 1)
        numbers.append(number)
        scores.append(score)
    number, score = np.concatenate(numbers, axis=1), np.concatenate(scores, axis=1)
    best = np.argsort(-score, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(number, best, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles, each by a power of two near one: no cosine changes, and no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    lengths = np.asarray(pc.list_value_length(batch.column(column)))
    for length in np.unique(lengths):
        some = batch.filter(pa.array(lengths == length))
        for at in range(0, some.num_rows, 4096):
            part = some.slice(at, 4096)
            x = _matrix(part.column(column))
            yield part, x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, most: int) -> Iterator[pa.RecordBatch]:
    """id, vector, mark -> the same with length, bucket, base: the bucket of each table, or those a query visits; whether it is of the first table."""
    for batch in batches:
        for part, x in _by_length(batch, 1):
            found = probes(x, tables, hashes, most) if most else buckets(x, tables, hashes)
            at = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
            yield pa.record_batch([*(part.column(c).take(at) for c in range(3)), pa.array(np.full(found.size, len(x[0]), dtype=np.int32)),
                                   pa.array(found.reshape(-1)), pa.array(found.reshape(-1) < (2 * width(len(x[0]))) ** hashes)], names=["id", "vector", "mark", "length", "bucket", "base"])


def _nearest(index: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k nearest of a bucket's vectors for each of its queries; all that tie with the k-th."""
    out = pa.schema([("query", pa.int64()), ("query_mark", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("score", pa.float64())])
    if not index.num_rows or not asked.num_rows:
        return out.empty_table()
    x, q = _matrix(index.column("vector").combine_chunks()), _matrix(asked.column("vector").combine_chunks())
    x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    ids, marks = index.column("id").to_numpy(), index.column("mark").to_numpy()
    queries, query_marks = asked.column("id").to_numpy(), asked.column("mark").to_numpy()
    rows = []
    for at in range(0, len(q), 256):
        near = (q[at:at + 256] @ x.T) / q_norm[at:at + 256, None] / x_norm
        least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else near.min(axis=1)
        i, j = np.nonzero(near >= least[:, None] - 1e-9)
        # the matrix product rounds by position: scores are taken row by row, in one order
        rows.append((queries[at + i], query_marks[at + i], ids[j], marks[j], (q[at + i] * x[j]).sum(axis=1) / (q_norm[at + i] * x_norm[j])))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*rows)], schema=out)


def search(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = TABLES, hashes: int = HASHES, visits: int = PROBES, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows to each row whose vec_id is divisible by ``every``.

    Null or zero vectors and those with null or non-finite components take no part; vectors
    of different lengths are not compared.  Equal scores rank by vec_id.  Rows with a null
    vec_id take no part.  Rows equal in vec_id and vector are one row; rows that repeat a vec_id with
    another vector are queries and candidates of their own, also of each other.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    vector = F.col("embedding").cast("array<double>")
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = staged(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).where(F.col("id").isNotNull()).where(fit), "vectors")
    # of equal vectors the smallest ids
    number = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    mark = F.xxhash64("vector").alias("mark")  # tells rows of one vec_id apart
    index = rows.distinct().withColumn("n", number).where(F.col("n") <= k + 1).select("id", "vector", mark)
    asked = rows.where(F.col("id") % every == 0)
    first = asked.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector", mark)
    kind = f"id long, vector {rows.schema['vector'].dataType.simpleString()}, mark long, length int, bucket long, base boolean"
    held = staged(common.arrow_map(index, lambda it: _spread(it, tables, hashes, 0), kind), "ann-index")
    wanted = common.arrow_map(first, lambda it: _spread(it, tables, hashes, visits), kind).drop("base")
    buckets_of = held.groupBy("length", "bucket", "base").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    sizes = buckets_of.drop("base")
    held = held.join(sizes, ["length", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    wanted = wanted.join(sizes, ["length", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    key = ["length", "bucket", "part"]
    found = "query long, query_mark long, id long, mark long, score double"
    met = held.drop("base").groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(lambda x, q: _nearest(x, q, k + 1), found)
    order = Window.partitionBy("query", "query_mark").orderBy(F.desc("score"), "id", "mark")

    def top(met: DataFrame) -> DataFrame:
        return met.groupBy("query", "query_mark", "id", "mark").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")

    best = staged(top(met), "ann-best")
    # a query with fewer rows than there are candidates meets every vector of its length once
    known = index.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("candidates"))
    got = best.groupBy(F.col("query").alias("id"), F.col("query_mark").alias("mark")).agg(F.count(F.lit(1)).alias("got"))
    short = staged(first.withColumn("length", F.size("vector")).join(known, "length").join(got, ["id", "mark"], "left")
                   .where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), F.col("candidates"))).select("id", "vector", "mark", "length"), "ann-short")
    if not short.isEmpty():
        loads = short.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("groups"))
        every_bucket = buckets_of.where("base").select(*(F.col(c).alias(c) for c in ("length", "bucket", "chunks")))
        asked_all = (short.join(loads, "length").withColumn("grp", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).drop("groups")
                     .join(every_bucket, "length").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks"))
        held_all = held.where("base").drop("base").join(loads, "length").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        more = held_all.groupBy(*key, "grp").cogroup(asked_all.groupBy(*key, "grp")).applyInArrow(lambda x, q: _nearest(x, q, k + 1), found)
        best = top(best.unionByName(more))
    # queries of equal vectors share what was found; each leaves out itself
    asked_by = first.select(F.col("id").alias("query"), F.col("mark").alias("query_mark"), "vector")
    twins = asked.select(F.col("id").alias("query_id"), "vector").distinct().join(asked_by, "vector").select("query_id", "query", "query_mark")
    result = twins.join(best, ["query", "query_mark"]).where((F.col("id") != F.col("query_id")) | (F.col("mark") != F.col("query_mark")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "id", "mark"))
    return result.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
