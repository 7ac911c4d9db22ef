"""Nearest neighbours: exact where all buckets are visited, recall with production parameters, edge cases."""
import math
import random

import numpy as np

from lotwise.llm import neighbours as N
from lotwise.llm.common import table


def brute(rows, every=50, k=5):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    distinct = sorted(set((i, tuple(v)) for i, v in ok))
    for q, a in [row for row in distinct if row[0] % every == 0]:
        found = []
        for i, b in distinct:
            if (i, b) != (q, a) and len(b) == len(a):
                x, y = np.array(a) / np.max(np.abs(a)), np.array(b) / np.max(np.abs(b))
                found.append((i, float(np.dot(x, y) / np.sqrt(np.dot(x, x)) / np.sqrt(np.dot(y, y)))))
        best = sorted(found, key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, r + 1, i, round(s, 9)) for r, (i, s) in enumerate(best)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


def rows(seed, n=260):
    rng = random.Random(seed)
    out = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(n)]
    hot = out[50][1]
    out += [(i, hot) for i in range(300, 420)] + [(1000, None), (1050, []), (1100, [0.0] * 6), (1150, [1.0, None] * 3), (1200, [float("nan")] * 6), (1250, [float("inf")] * 6)]
    return out + [(None, hot), (2000, [1.0, 2.0]), (2001, [2.0, 4.0]), (2002, [-1.0, 0.5]), (3000, [3.0] * 3), out[0], out[0]]


def test_exact_when_all_buckets_are_visited(spark):
    data = rows(1)
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, id int").repartition(3)
    assert result(N.search(df, tables=2, visits=1000)) == brute(data)
    assert result(N.search(df, tables=1, hashes=2, visits=100_000, chunk=7)) == brute(data)
    assert N.search(df.limit(0)).count() == 0


def test_turns_keep_length_and_probes_begin_with_the_bucket():
    x = np.random.default_rng(1).normal(size=(50, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(N.turned(x, 3), axis=1), 1)
    for hashes in (1, 2):
        own, asked = N.buckets(x, 3, hashes), N.probes(x, 3, hashes, 40)
        assert all(set(a) <= set(b) for a, b in zip(own.tolist(), asked.tolist()) if hashes > 1) or hashes == 1
        assert all(len(set(row)) == len(row) for row in asked.tolist())


def test_recall_with_production_parameters(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = table(spark, f"/root/testdata/{sf}", "embeddings")
        want = {(q, i) for q, _, i, _ in brute([(r.vec_id, r.embedding) for r in df.collect()])}
        got = result(N.search(df))
        found = len(want & {(q, i) for q, _, i, _ in got}) / len(want)
        print(sf, "recall", found)
        assert found >= 0.93
        assert len(got) == len(want)


def test_no_query_is_short_of_rows_with_production_parameters(spark):
    rng = random.Random(8)
    one = [float(np.float32(rng.gauss(0, 1))) for _ in range(64)]
    handful = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(40)]) for i in range(100, 105)]
    # a query and its opposite, with copies of the query; a length of its own with a handful of vectors
    data = [(50, one), (51, [-v for v in one]), (150, one), *handful, (200, [1.0] * 24)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    assert result(N.search(df)) == brute(data)
    assert result(N.search(df, chunk=1)) == brute(data)


def test_repeated_ids_and_extreme_components(spark):
    rng = random.Random(3)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    data += [(0, [1.0, 2.0, 3.0, 4.0]), (0, [1.0, 2.0, 3.0, 5.0]), (0, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.5]),
             (50, [1e200, 2e200, -1e200, 3e200]), (51, [1e-200, 2e-200, -1e-200, 3.1e-200]), (52, [5e-324, 0.0, 0.0, 0.0]), (53, [1.7e308, 1e-300, 0.0, -1.7e308])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = result(N.search(df, visits=1000))
    assert got == brute(data)
    assert (0, 2, 0) in {row[:3] for row in got} and (50, 1, 51) in {row[:3] for row in got}
