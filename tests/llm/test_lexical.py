"""The treap search against scores of every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lotwise.llm import lexical as X

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    counted = [(d, Counter(TERM.findall((t or "").encode().translate(LOWER)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        wanted = Counter(TERM.findall((text or "").encode().translate(LOWER)))
        scores = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * n // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in wanted.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_terms_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 7)
    text = "Straße_ÄB-c1 2\x00x\x7fЖук~日本 K"
    assert [w for some in X.terms(text.encode()) for w in some] == TERM.findall(text.encode().translate(LOWER))
    assert not list(X.terms(None)) and not list(X.terms(b""))


@pytest.mark.parametrize("seed", range(4))
def test_tree_holds_every_point_and_bounds_squares(seed):
    rng = np.random.default_rng(seed)
    side = int(rng.integers(1, 60))
    cells = rng.choice(side * side, size=int(rng.integers(1, side * side + 1)), replace=False)
    rows, cols, impacts = cells // side, cells % side, rng.integers(1, [5, 900_000][seed % 2], size=len(cells))
    tree = X.build(rows, cols, impacts, max(side - 1, 1).bit_length())
    assert sum(tree["sizes"]) == len(cells)
    block = X.Block({**tree, "docs": list(range(side))})
    weights = np.ones(len(set(rows.tolist())), dtype=np.int64)
    best = X.Best(10**6)
    block.search(np.unique(rows), weights, best)
    assert {d: -s for s, _, _, d in best.rows} == {int(c): int(impacts[cols == c].sum()) for c in set(cols.tolist())}


@pytest.mark.parametrize("block_docs,pass_terms", [(4096, 500_000), (7, 3)])
def test_search_equals_brute_force(spark, monkeypatch, block_docs, pass_terms):
    rng = random.Random(5)
    monkeypatch.setattr(X, "CELLS", 16 if block_docs == 7 else 1 << 14)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "THE", "the", "a_b"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40]), weights=[1 / (j + 1) for j in range(len(words))]))) for i in range(120)]
    docs += [(500 + i, "same text here w1") for i in range(40)] + [(None, "w1 w2"), (3, "w1 w2"), (3, None), (4, " .,"), (9, "w5 " * 30_000), (7, docs[7][1])]
    items = [(1, "w1 w1 w40 the"), (2, "unknown"), (3, None), (4, "same text here"), (5, " ".join(words)), (6, "w5"), (6, "w59 THE"), (8, "a b")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in X.search(d, i, pass_terms=pass_terms, block_docs=block_docs).collect()), key=repr)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert X.search(docs.limit(0), items).count() == 0
    assert X.search(docs, items.limit(0)).count() == 0
    assert X.search(docs.selectExpr("doc_id", "cast(null as string) as text"), items).count() == 0
    assert len(X.search(docs, items).collect()) == 1
