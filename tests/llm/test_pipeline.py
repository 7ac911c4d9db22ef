"""The pipeline: its stages in order, each against a plain version of its rule, and nulls, repeats and empty tables throughout."""
import corpus_pipeline as P
from lotwise.llm import decontaminate as D
from lotwise.llm import language as L
from lotwise.llm.common import table
from lotwise.session import staged

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_rules_keep(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mix", "tokens"]
    kept = [docs]
    for name, stage in P.STAGES:
        kept.append(staged(stage(spark, kept[-1], SF), f"test-{name}"))
    assert all(df.columns == docs.columns for df in kept[:5])
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in kept]
    known = {r.doc_id for r in L.identify(docs).where("not ambiguous").collect()}
    assert set(ids[1]) == known
    texts = {r.doc_id: r.text for r in kept[1].collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert set(ids[2]) <= set(first.values()) and len(ids[2]) > 0.8 * len(first)
    bad = {r.doc_id for r in D.judge(kept[2], table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert set(ids[3]) == set(ids[2]) - bad
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4]
    assert kept[5].agg({"n_tokens": "sum"}).first()[0] == max(r.start + r.n_tokens for r in kept[5].collect())


def test_nulls_repeats_and_extra_columns(spark, tmp_path):
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = table(spark, SF, "documents").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1) for r in base] + [(r.doc_id, r.text, r.lang, r.source, None, 1) for r in base[:3]]
    rows += [(900, None, None, None, None, None), (None, base[0].text, None, None, None, None), (901, "", "en", "src0", 0, 2), (902, base[1].text * 50, "en", None, 1, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start int")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in P.STAGES:
            now = staged(stage(spark, now, str(tmp_path)), f"edge-{name}")
            if name != "tokens":
                assert now.columns == docs.columns
        assert (now.count() == 0) == empty
