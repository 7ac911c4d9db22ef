"""Decontamination against a brute-force version that looks up every window of every item."""
import hashlib
import random
import re
import time

from lotwise.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            size = min(13, len(w))
            windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()
            for i in range(len(own) - size + 1):
                if tuple(own[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item_id) if item_id is not None else "")
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "été", "b2", "Xy", "und", "a"]
    def some(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 3, 6, 12, 13, 14, 25, 40]) if rng.random() < 0.5 else rng.choice([13, 20, 30]))) for i in range(12)]
    items = [(i, text) for i, text in items if len(words(text)) not in (1, 2)] + [(90, None), (91, "same same same same"), (91, "one two three four five six"), (None, "a b c d e f g h i j k l m n o p")]
    docs = [(i, some(rng.randint(0, 90)) + (rng.choice(items)[1] or "") + some(rng.randint(0, 400))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  \n"), (103, "the " * 300), (103, "the " * 300), (None, "A B c D e f g h i j k l m n o p q"), (104, "x" * 3_000_000 + " same same same same same")]
    return docs, items


def test_words_of_texts():
    for text in ["", " ", "A-b", "é,Z9", "x" * 5 + "\n" + "ÄÖ"]:
        got = D.Words([text.encode()])
        assert [got.word(i).decode() for i in range(len(got.start))] == words(text)


def test_judge_equals_brute_force(spark):
    for seed in range(3):
        docs, items = cases(seed)
        d = spark.createDataFrame([(*row, "x") for row in docs], "doc_id long, text string, n_hit string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert sorted(map(tuple, D.judge(d, b).collect()), key=repr) == want
        if seed == 0:
            assert sorted(map(tuple, D.judge(d, b, most_words=40).collect()), key=repr) == want


def test_filter_and_empty_tables(spark):
    docs, items = cases(5)
    d = spark.createDataFrame([(i, text, None) for i, text in docs], "doc_id long, text string, runs string")
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {row[0] for row in brute(docs, items) if row[5]}
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((row.doc_id for row in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)
    assert D.drop_contaminated(d, b.limit(0)).count() == len(docs)
    assert D.judge(d.limit(0), b).count() == 0
    assert D.judge(d, b.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_rows_are_dropped_by_their_own_text_with_any_number_of_blocks(spark):
    items = [(f"i{n}", " ".join(f"w{n}x{k}" for k in range(20))) for n in range(4)]
    rows = [(1, items[0][1]), (1, "a clean text"), (None, items[3][1]), (None, "clean too"), (None, None), (2, items[2][1]), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for most_words in (1_000, 1):
        kept = D.drop_contaminated(docs, benchmark, most_words)
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4], rows[6]]))


def test_periodic_texts_take_linear_time():
    items = [("same", "same " * 20_000), ("two", "a b " * 10_000), ("short", "a b a")]
    block = D.Matcher(items)
    began = time.time()
    texts = ["same " * 20_000, "a b " * 10_000 + "x", "b a " * 6, None]
    found = block.runs(D.Words([text and text.encode() for text in texts]))
    assert time.time() - began < 5
    assert [(sorted(block.names[i] for i in found[t][1]), D.covered(found[t][0])) for t in range(3)] == [
        (["same"], 20_000), (["short", "two"], 20_000), (["short"], 11)]
    assert 3 not in found
