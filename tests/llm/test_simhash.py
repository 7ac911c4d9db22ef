"""SimHash near-duplicates against all pairs of fingerprints."""
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lotwise.llm import simhash as S
from lotwise.llm.components import components


def brute_mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(marks):
    root = list(range(len(marks)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(marks))]


def planted(rng, n):
    """Fingerprints with many near ones, some chained."""
    marks = []
    while len(marks) < n:
        base = rng.getrandbits(64) if rng.random() < 0.5 or not marks else rng.choice(marks)
        for _ in range(rng.choice([0, 1, 3, 4, 4, 5, 6])):
            base ^= 1 << rng.randrange(64)
        marks.append(base)
    return marks


def test_fingerprint():
    for text in [None, "", " \n", "a", "A b", "a b c d", "The THE the  the\tthe é É x\x0by", "w " * 20_000 + "x y z"]:
        assert S.fingerprint(None if text is None else text.encode()) == brute_mark(text)


@pytest.mark.parametrize("pairs", [8, 1 << 18])
def test_walk_finds_all_links_of_the_first_part(monkeypatch, pairs):
    monkeypatch.setattr(S, "PAIRS", pairs)
    rng = random.Random(pairs)
    for turn in range(6):
        leaves = np.unique(np.array(planted(rng, 120), dtype=np.uint64) & np.uint64((1 << (64 if turn % 2 else 58)) - 1))
        edges = [[] for _ in leaves]
        groups = {}
        for r in range(5):
            marks = S.turned(leaves, r)
            order = np.argsort(marks)
            label = S.walk(marks[order], S.budgets(r))
            for i, at in enumerate(label):
                edges[order[i]].append(order[at])
        root = list(range(len(leaves)))
        for _ in leaves:
            for i, others in enumerate(edges):
                for j in others:
                    low = min(root[i], root[j])
                    root[i] = root[j] = low
        assert root == brute_groups([int(x) for x in leaves]), groups


def test_chunks_of_a_crowded_subtrie(spark):
    rng = random.Random(3)
    marks = sorted(set(rng.getrandbits(20) for _ in range(300)))
    df = spark.createDataFrame([(m, m) for m in marks], "node long, mark long")
    want = {(m, marks[g]) for m, g in zip(marks, brute_groups(marks)) if m != marks[g]}
    for chunk in (20_000, 20):
        got = {(row.node, row.root) for row in components(S.near_links(df, chunk)).collect()}
        assert got == want
    # marks that differ everywhere, so that all rotations and parts are crowded in turn
    low = (1 << 63) - 1
    marks = sorted({m & low for m in planted(rng, 400)} | {(1 << b) - 1 for b in range(40)})
    df = spark.createDataFrame([(m, m) for m in marks], "node long, mark long")
    want = {(m, marks[g]) for m, g in zip(marks, brute_groups(marks)) if m != marks[g]}
    assert {(row.node, row.root) for row in components(S.near_links(df, 1)).collect()} == want
    wide = {(row.node, row.root) for row in components(S.near_links(df, 1, budget=6)).collect()}
    assert want and {a for a, _ in want} <= {a for a, _ in wide}


def documents(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "été"]) + str(rng.randrange(40)) for _ in range(rng.choice([1, 3, 60, 200]))) for _ in range(25)]
    rows = []
    for i in range(120):
        text = rng.choice(base).split()
        if rng.random() < 0.5 and len(text) > 10:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    return rows + [(200, None), (201, ""), (202, " \n "), (5, rows[5][1]), (5, "other text for the same id"), (None, rows[7][1]), (None, "alone with no id " * 3)]


def test_near_duplicates_equal_brute_force(spark):
    rows = documents(1)
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, mark string").repartition(3)
    marks = [brute_mark(text) for _, text in rows]
    groups = brute_groups(marks)
    low = {}
    for (doc_id, _), g in zip(rows, groups):
        if doc_id is not None:
            low[g] = min(low.get(g, doc_id), doc_id)
    want = sorted(((doc_id, m - (m >> 63 << 64), low.get(g)) for (doc_id, _), m, g in zip(rows, marks, groups)), key=repr)
    assert sorted(((r.doc_id, r.mark, r.component_id) for r in S.near_duplicates(docs).collect()), key=repr) == want


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(rng.choice([1, 1, 3, 5])):
            text = list(base)
            for _ in range(len(base) // 150):
                text[rng.randrange(len(text))] = "new" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(text), i))
        if rng.random() < 0.3:  # shares half of its words: not alike
            rows.append((len(rows), " ".join(base[: len(base) // 2] + [f"z{rng.randrange(10**6)}" for _ in range(len(base) // 2)]), 1000 + i))
    rows += [(5000, None, 2000), (5001, "", 2000), (5002, " \n", 2000), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (None, "a text of its own with no id", 2001)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, grp int, mark string").repartition(3)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    for a in rows:
        for b in rows:
            x, y = shingles(a[1]), shingles(b[1])
            assert (len(x & y) / len(x | y) >= 0.85) == (a[2] == b[2]) or 0.75 < len(x & y) / len(x | y) < 0.85
    want = {}
    for doc_id, _, g in rows:
        want[g] = min((w for w in (want.get(g), doc_id) if w is not None), default=None)
    stayed = [(r.grp, r.doc_id) for r in got]
    # the first of each group stays; of the others a few may, whose fingerprints are further apart
    assert set(want.items()) <= set(stayed) and len(set(map(str, stayed))) == len(stayed)
    assert len(stayed) - len(want) <= 0.1 * (len({r[1] for r in rows}) - len(want))
    again = S.drop_near_duplicates(docs.repartition(5))
    assert sorted(map(repr, got)) == sorted(map(repr, again.collect()))


def permuted(rng, families, members, n=400):
    """(family, text): texts over one set of words, near only within a family, with two parts of each swapped."""
    words, out = [f"w{i}" for i in range(n)], []
    for f in range(families):
        base = rng.sample(words, n)
        for _ in range(members):
            a, b = sorted(rng.sample(range(n), 2))
            out.append((f, " ".join(base[a:b] + base[:a] + base[b:])))
    return rng.sample(out, len(out))


def like_groups(sketches):
    """Connected groups of rows by all pairs."""
    root = list(range(len(sketches)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(sketches)):
        for j in np.flatnonzero(S.estimate(np.repeat(sketches[i:i + 1], i, axis=0), sketches[:i]) >= S.SIMILAR).tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(sketches))]


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_texts_of_equal_and_near_marks_all_meet(monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "PAIRS", 1000)
    rng = random.Random(few)
    for n in (400, 12, 6):
        texts = [text for _, text in permuted(rng, 6, 8, n)] + ["a", "", " "]
        sketches = np.array([S.sketch(text.encode()) for text in texts])
        # one mark, then two near ones in which alike texts are on opposite sides
        for marks in (np.zeros(len(texts), dtype=np.uint64), np.arange(len(texts), dtype=np.uint64) % np.uint64(2)):
            order = np.argsort(marks, kind="stable")
            label = S.walk(marks[order], S.budgets(0, 6), 6, S.Sketches(sketches[order]))
            assert label.tolist() == like_groups(sketches[order])


def test_interleaved_families_of_permuted_texts(spark):
    rng = random.Random(11)
    rows = [(i, f, text + " more" * (i % 2)) for i, (f, text) in enumerate(permuted(rng, 5, 12))]
    assert len({S.word_mark(text.encode()) for _, _, text in rows}) == 2
    docs = spark.createDataFrame(rows, "doc_id long, grp int, text string").repartition(3)
    first = {}
    for i, f, _ in rows:
        first.setdefault(f, i)
    assert sorted(r.doc_id for r in S.drop_near_duplicates(docs).collect()) == sorted(first.values())


def test_sketch_estimates_similarity():
    rng = random.Random(1)
    for n in (3, 30, 3000):
        a = [str(rng.randrange(10**6)) for _ in range(n)]
        for changed in (0, 1, n // 50):
            b = list(a)
            for _ in range(changed):
                b[rng.randrange(n)] = "x"
            x, y = " ".join(a), " ".join(b)
            exact = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
            got = S.estimate(S.sketch(x.encode())[None], S.sketch(y.encode())[None])[0]
            assert abs(got - exact) < 0.1, (n, changed, exact, got)
    assert S.word_mark(None) == S.word_mark(b" ") == 0 and not S.sketch(b"").any()


def edited(rng, n_bases):
    """(doc_id, text): bases and copies with a few edited words, about half of them near 0.8."""
    out = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 100, 150, 300]))]
        out.append(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.choice([0.005, 0.01, 0.018, 0.021])))):
                copy[at] = f"n{rng.randrange(10**6)}"
            out.append(copy)
    return [(i, " ".join(words)) for i, words in enumerate(out)]


def test_recall_against_an_exact_comparison(spark):
    """Of the rows that an exact comparison at 0.8 drops, at least 0.95 go; rows unlike all others stay."""
    rows = edited(random.Random(8), 120)
    sets = [shingles(t) for _, t in rows]
    alike = [[j for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for i, some in enumerate(alike):
        for j in some:
            root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    gone = {i for g in groups.values() for i in g if i != min(g)}
    far = {i for i in range(len(rows)) if all(len(sets[i] & sets[j]) < 0.7 * len(sets[i] | sets[j]) for j in range(len(rows)) if j != i)}
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(gone) > 100 and len(gone - kept) >= 0.95 * len(gone)
    assert far <= kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.drop_near_duplicates(docs).count() == 0


def test_texts_of_a_crowded_band_are_all_compared(spark):
    """Thirty pairs of near copies in one band, of which three texts are compared with all first."""
    rows = []
    for i in range(30):
        words = [f"w{i}x{j}" for j in range(60)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + ["changed"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(F.xxhash64("text").alias("tie"), F.struct("doc_id").alias("low"), F.array(F.lit(7).cast("long")).alias("bands"))
    none = spark.createDataFrame([], "a long, b long")
    ids = {r.tie: r.low.doc_id for r in texts.collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in S.banded_links(texts, docs, none).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(30)}


def test_pairs_of_a_crowded_band_are_never_rows(spark, monkeypatch):
    """Of 300 unlike texts in one band no more pairs are made than are compared with three of them."""
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(60 - i % 2))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(F.xxhash64("text").alias("tie"), F.struct("doc_id").alias("low"), F.array(F.lit(7).cast("long")).alias("bands"))
    made, staged = {}, S.staged
    monkeypatch.setattr(S, "staged", lambda df, name: made.setdefault(name, staged(df, name)))
    links = S.banded_links(texts, docs, spark.createDataFrame([], "a long, b long")).collect()
    ids = {r.tie: r.low.doc_id for r in texts.collect()}
    assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in links} == {(i, i + 1) for i in range(0, 300, 2)}
    assert sum(df.count() for name, df in made.items() if name.endswith("-pairs")) <= 3 * 300
