"""Language identification: held-out accuracy on the given documents, brute-force trigrams, edge cases."""
import numpy as np

from lotwise.llm import language as L
from lotwise.llm.common import table

SF = "/root/testdata/sf0.01"


def test_trigrams_in_pieces_equal_one_pass(monkeypatch):
    raw = "Ça va? 12 bien-sûr, the End".encode()
    spaced = b" " + raw.lower() + b" "
    spaced = bytes(32 if b < 97 or 122 < b < 128 else b for b in spaced)
    want = []
    for i in range(1, len(spaced) - 1):
        if spaced[i] != 32:
            code = spaced[i - 1] << 16 | spaced[i] << 8 | spaced[i + 1]
            want.append((i - 1, (code * 2654435769 & 0xFFFFFFFF) >> 17))
    for piece in (1, 2, 5, 1000):
        monkeypatch.setattr(L, "PIECE", piece)
        got = [(int(p), int(b)) for at, buckets in L.trigrams(raw) for p, b in zip(at, buckets)]
        assert got == want
    assert list(L.trigrams(b"")) == []


def test_codewords_differ():
    for n in (1, 2, 3, 4, 5, 6, 9, 40):
        code = L.codewords(n)
        assert len(np.unique(code, axis=0)) == n and code.shape[0] == n
        if n > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_predictions_ignore_the_label_of_held_out_documents(spark):
    docs = table(spark, SF, "documents").limit(300)
    from pyspark.sql import functions as F
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(other).collect()))


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(30)] + [(i, "der hund und die katze " * 3, "de") for i in range(30, 60)]
    rows += [(70, None, "en"), (71, "", "de"), (72, "12 -- 34 €", "en"), (73, "漢", None), (None, "und der hund", None), (70, "the " * 400_000, None), (70, "the " * 400_000, None)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, held_out boolean").repartition(2)
    got = {(r.doc_id, r.lang_pred): r for r in L.identify(docs).collect()}
    assert got[70, "und"].score == 0 and (71, "und") in got and (72, "und") in got
    assert (None, "de") in got and (70, "en") in got and not got[70, "en"].ambiguous
    kept = L.drop_unknown(docs)
    assert kept.schema == docs.schema
    assert {71, 72}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.where("doc_id = 70").count() == 2
    assert L.identify(docs.limit(0)).count() == 0 and L.drop_unknown(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
