"""The Jaccard join against all pairs of exact shingle sets."""
import random
from collections import defaultdict

import numpy as np
import pytest

from lotwise.llm import jaccard_join as J


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for at, (i, _) in enumerate(rows):
        if i is not None:
            low[find(at)].append(i)
    return sorted(((i, len(sets[at]), min(low[find(at)], default=None)) for at, (i, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=30)
    out = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([1, 3, 4, 5, 12, 30, 60, 200]))
        if rng.random() < 0.4:
            base += passage
        out.append(base)
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = list(base)
            for _ in range(max(1, rng.randint(0, len(base) // 40 + 1))):
                at = rng.randrange(len(copy))
                copy[at:at + rng.choice([0, 1])] = [rng.choice(words)]
            out.append(copy)
    texts = [" ".join(w if rng.random() < 0.9 else w.upper() for w in t).replace(" ", rng.choice([" ", "\n", "  "])) for t in out]
    texts += [None, "", " \t", "x", "X", "É é", "é é", texts[0], texts[0], "a b c", "a b c a b c a b c"]
    rng.shuffle(texts)
    return [(i + 10, t) for i, t in enumerate(texts)] + [(11, texts[3]), (None, texts[4]), (None, "only null ids"), (None, None), (5, texts[7])]


@pytest.mark.parametrize("seed,chunk", [(1, J.CHUNK), (2, 300), (3, 300)])
def test_equals_all_pairs(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(J, "MOST_BROADCAST", 0 if seed == 2 else J.MOST_BROADCAST)
    monkeypatch.setattr(J, "DENSE", 1 if seed == 3 else J.DENSE)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(docs, chunk=chunk).collect()), key=repr)
    assert got == brute(rows)


def tiles(sets, tile, upper, chunk, root):
    maps = [J.bitmap(s) for s in sets]
    return J.Tiles(tile, np.array([len(s) for s in sets]), upper, chunk, root, J.Bitmaps(np.concatenate(maps), np.array([len(m) for m in maps])))


@pytest.mark.parametrize("seed", range(6))
def test_tiles_alone_find_all_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, size=60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < rng.uniform(0.8, 1)], rng.integers(0, 1 << 62, size=int(rng.integers(0, 6)), dtype=np.uint64)])) for _ in range(40)]
    links = tiles(sets, np.zeros(40, dtype=np.int64), np.zeros(40, dtype=bool), np.zeros(40, dtype=np.int64), np.arange(40)).links(sets)
    assert all(J.alike(sets[a], sets[b]) for a, b in links)

    def groups(pairs):
        label = list(range(40))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]
    assert groups(links) == groups([(a, b) for a in range(40) for b in range(a) if J.alike(sets[a], sets[b])])


@pytest.mark.parametrize("dense", [1, 64])
def test_groups_hold_all_links(monkeypatch, dense):
    monkeypatch.setattr(J, "DENSE", dense)
    rng = np.random.default_rng(dense)
    for _ in range(20):
        bases = [rng.integers(0, 1 << 62, size=40, dtype=np.uint64) for _ in range(3)]
        sets = [np.unique(np.concatenate([bases[i % 3][rng.random(40) < 0.95], rng.integers(0, 1 << 62, size=int(rng.integers(0, 4)), dtype=np.uint64)])) for i in range(20)]
        root, upper, chunk, tile = rng.integers(0, 12, 20), rng.random(20) < 0.3, rng.integers(0, 2, 20), np.repeat([4, 7], [14, 6])
        group = tiles(sets, tile, upper, chunk, root).groups()
        for x in range(20):
            for y in range(x):
                assert tile[x] != tile[y] or root[x] != root[y] or group[x] == group[y]
                if tile[x] == tile[y] and J.alike(sets[x], sets[y]) and not (upper[x] and upper[y]) and chunk[x] != chunk[y]:
                    assert group[x] == group[y]


def test_longer_bitmaps_fold_to_shorter_ones():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64)) for n in (10, 2000, 2100, 9000, 9001)]
    maps = [J.bitmap(s) for s in sets]
    assert len({len(m) for m in maps}) >= 3
    pair = J.Bitmaps(np.concatenate(maps), np.array([len(m) for m in maps])).differ(np.array([0, 1, 3, 3]), np.array([3, 2, 4, 2]))
    for got, (a, b) in zip(pair, ((0, 3), (1, 2), (3, 4), (3, 2))):
        bits = 64 * min(len(maps[a]), len(maps[b]))
        odd = [np.bincount((sets[x] % np.uint64(bits)).astype(int), minlength=bits) & 1 for x in (a, b)]
        assert got == (odd[0] != odd[1]).sum() <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))


def test_bounds_and_bands():
    rng = np.random.default_rng(4)
    first = J.bands()
    for n in [*range(1, 400), 10**6]:
        band = np.searchsorted(first, n, side="right") - 1
        assert np.searchsorted(first, n * 100 // 85, side="right") - 1 in (band, band + 1)
    counts = rng.integers(0, 9, size=1 << J.COUNT_BITS)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, size=int(rng.integers(1, 50)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 63, size=int(rng.integers(0, 4)), dtype=np.uint64)]))
        if len(b) and J.alike(a, b):
            assert set(J.prefix(a, counts).tolist()) & set(J.prefix(b, counts).tolist())
            differ = np.bitwise_count(J.bitmap(a) ^ J.bitmap(b)).sum()
            assert differ <= len(set(a.tolist()) ^ set(b.tolist())) and J.bounded(np.array([len(a)]), len(b), np.array([differ]))[0]


def test_long_texts_are_cut_at_spaces(monkeypatch):
    text = b"Alpha beta\x0bgamma delta\t" * 50
    whole = J.word_hashes([text, None, b"x"])
    monkeypatch.setattr(J, "PIECE", 7)
    monkeypatch.setattr(J, "WORDS", 3)
    assert all((a == b).all() for a, b in zip(whole, J.word_hashes([text, None, b"x"]), strict=True)) and len(whole[0]) == 200


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(docs).count() == 0
