"""The filter audit against a replay of every order, document by document."""
import random
import re
from itertools import permutations

from lotwise.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def replay(rows, labels):
    """All 120 orders applied to the rows, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append({"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                      "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                      "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows)})
    out, shapley = {}, {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [at for at, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [at for at in left if fails[at][f]]
                left = [at for at in left if not fails[at][f]]
                failing = sum(fails[at][f] for at in mine)
                out[part, "".join(order), step] = (
                    len(left), len(gone), failing - len(gone), sum(fails[at][f] and sum(fails[at].values()) == 1 for at in mine),
                    sum(rows[at][0] in good for at in gone), sum(rows[at][0] in toxic for at in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_replay(spark):
    rng = random.Random(3)
    vocabulary = ["Word", "UPPER", "x", "é", "a#b", "100%", "naïve tied", "plain"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary[rng.choice([0, 8]):]) for _ in range(rng.choice([0, 3, 99, 100, 140, 400]))) for _ in range(40)]
    texts += [None, "", " \t\x0b ", "SHOUT " * 120, "y" * 300_000 + " |"]
    rows = [(rng.randrange(80), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (5, texts[0], "en"), (5, texts[0], "en"), (1, None, "fr")]
    labels = [(rng.randrange(90), rng.randrange(2), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(5)
    assert result(A.audit(docs, spark.createDataFrame(labels, LABELS))) == replay(rows, labels)


def test_lattice_counts():
    for k in range(1, 6):
        to, onward = A.reaching(k), A.leaving(k)
        orders = list(permutations(range(k)))
        for state in range(1 << k):
            size = state.bit_count()
            through = sum(sum(1 << f for f in order[:size]) == state for order in orders)
            assert to[state] * onward[state] == through


def test_empty_tables_and_other_filters(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    assert A.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", 0)], SCHEMA)
    got = result(A.audit(one, labels, {"S": A.too_short, "D": A.symbols}))
    assert got == {("en", "SD", 1): (0, 1, 0, 1, 0, 0, 2), ("en", "SD", 2): (0, 0, 0, 0, 0, 0, 0),
                   ("en", "DS", 1): (1, 0, 0, 0, 0, 0, 0), ("en", "DS", 2): (0, 1, 0, 1, 0, 0, 2)}
