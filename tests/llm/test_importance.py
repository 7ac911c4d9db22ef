"""Importance resampling: plain n-gram counts, exact thresholds, held-out separation of labelled documents."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import importance as I
from lotwise.llm.common import table

SF = "/root/testdata/sf0.1"


def tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())


def test_grams_equal_plain_counts():
    texts = [None, "", "a", "Ab, c!! é\x00z", "the the the", "|| x"]
    buckets, owner = I.grams([None if t is None else t.encode() for t in texts])
    for i, text in enumerate(texts):
        own = tokens(text)
        assert (owner == i).sum() == len(own) + max(0, len(own) - 1)
    single = {}
    for text in texts:
        alone = sorted(I.grams([(text or "").encode()])[0].tolist())
        assert alone == sorted(buckets[owner == texts.index(text)].tolist())
        single[text] = alone
    assert single["the the the"].count(single["the the the"][0]) in (2, 3)


@pytest.mark.parametrize("few", [3, 10_000])
def test_kth_largest(spark, monkeypatch, few):
    monkeypatch.setattr(I, "FEW", few)
    monkeypatch.setattr(I, "BINS", 4)
    rng = random.Random(few)
    values = [rng.choice([rng.gauss(0, 1), 2.5, 2.5, -1e6, 1e-9 * rng.random()]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 77, 150, 200):
        assert I.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert I.kth_largest(df, 201) is None and I.kth_largest(df, 0) is None and I.kth_largest(df.limit(0), 1) is None


def test_held_out_labels_are_told_apart(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = I.resample(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    rank = got.log_ratio.rank()
    good = got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    print("held-out AUC", auc)
    assert auc > 0.95
    assert got[good].selected.mean() > 2 * got[~good].selected.mean()


def test_selection_and_edge_cases(spark):
    rows = [(i, "good words here and there " * 3) for i in range(40)] + [(i, "## junk $$ 12 " * 5) for i in range(40, 80)]
    rows += [(90, None), (91, ""), (None, "good words"), (92, "good " * 300_000), (93, "again"), (93, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 40), None) for i in range(80)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = I.resample(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[90].n_grams == by[91].n_grams == 0 and by[90].log_ratio == 0
    keys = sorted((r.key for r in got), reverse=True)
    least = keys[int(np.ceil(len(rows) / 2)) - 1]
    assert all(r.selected == (r.key >= least) for r in got)
    assert min(by[i].log_ratio for i in range(40)) > max(by[i].log_ratio for i in range(40, 80))
    again = I.resample(docs.repartition(5), labels).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert I.resample(docs.limit(0), labels).count() == 0
    assert I.resample(docs, labels.limit(0)).where(F.col("selected")).count() >= len(rows) / 2
