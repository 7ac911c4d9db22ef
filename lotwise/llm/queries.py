"""Registered queries of the training-data operators, with production parameters, and their checking SQL."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, filter_audit, html_text, importance, jaccard_join, language, lexical, link_trust, mixing, neighbours, sharding, simhash, tokens
from lotwise.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir) -> DataFrame`` with its checking SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def byte_bpe() -> str:
    """The public tokenizer file, found where the library of vocabularies is installed."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_bits")
def op1_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(table(spark, sf_dir, "documents"), byte_bpe())


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

URL_SQL = r"""
WITH RECURSIVE p AS (
    SELECT page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
links AS (
    SELECT DISTINCT page_id, url, html, host AS src,
           translate(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM (SELECT p.*, pages.url FROM p JOIN pages USING (page_id, html))),
edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
hosts AS (SELECT DISTINCT host, path, 1 AS own FROM p UNION ALL SELECT DISTINCT dst, '/', 0 FROM edges WHERE dst NOT IN (SELECT host FROM p)),
fit AS (
    SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS says
    FROM (SELECT DISTINCT host, path FROM hosts), rules
    WHERE (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath) GROUP BY host, path),
seeds AS (
    SELECT host, unnest(['t', 'd']) AS kind, unnest([avg(CASE WHEN says = 'allow' THEN 1.0::DOUBLE ELSE 0.0 END), avg(CASE WHEN says = 'block' THEN 1.0::DOUBLE ELSE 0.0 END)]) AS x
    FROM (SELECT host, path FROM p WHERE host <> '' UNION ALL SELECT host, path FROM hosts WHERE own = 0) LEFT JOIN fit USING (host, path) GROUP BY host),
ways AS (SELECT 't' AS kind, src AS a, dst AS b, weight FROM edges UNION ALL SELECT 'd', dst, src, weight FROM edges),
flow AS (SELECT kind, a, b, 0.85::DOUBLE * weight / sum(weight) OVER (PARTITION BY kind, a) AS share FROM ways),
rounds(i, kind, host, x) AS (
    SELECT 0, kind, host, 0.15::DOUBLE * x FROM seeds
    UNION ALL
    SELECT i, kind, host, sum(x) FROM (
        SELECT r.i + 1 AS i, r.kind, f.b AS host, r.x * f.share AS x FROM rounds r JOIN flow f ON r.kind = f.kind AND r.host = f.a WHERE r.i < 150)
    GROUP BY i, kind, host),
scores AS (
    SELECT host, coalesce(sum(x) FILTER (kind = 't'), 0) AS trust, coalesce(sum(x) FILTER (kind = 'd'), 0) AS distrust FROM rounds GROUP BY host)
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.says, CASE WHEN scores.distrust >= 0.01 AND scores.distrust > scores.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN scores ON p.host = scores.host
"""


@query("op2_link_trust", URL_SQL)
def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_simhash_trie")
def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_ecoc_language")
def op4_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op5_winnowing")
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The draws follow the documents' order by an MD5 of the doc_id, source by source.  What the tree of draws gives the
# shards is checked by its sums: the blocks of a source, and shards that differ by one block at most.
MIX_SQL = r"""
WITH d AS (
    SELECT doc_id, CAST(source AS VARCHAR) AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
    SELECT *, 3 * CAST(source_size AS DOUBLE) AS cap,
           CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
    FROM s),
v AS (
    SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w),
l AS (SELECT level FROM v WHERE cap > weight * level ORDER BY cap / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM l) = 0 THEN cap ELSE least(cap, weight * (SELECT level FROM l)) END AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS passes FROM t),
q AS (SELECT p.*, n_blocks, CAST(round(target - passes * source_size) AS BIGINT) AS rest FROM p JOIN (SELECT source, CAST(ceil(sqrt(count(*))) AS BIGINT) AS n_blocks FROM d GROUP BY 1) n ON p.source IS NOT DISTINCT FROM n.source),
r AS (
    SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.passes, q.rest, CAST(floor(d.key / 1152921504606846976.0::DOUBLE * q.n_blocks) AS BIGINT) AS block, q.n_blocks,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
z AS (
    SELECT source, CAST(any_value(passes * n_blocks) + coalesce(max(block + 1) FILTER (rest > 0 AND ahead <= rest), 0) AS BIGINT) AS quota
    FROM (SELECT source, block, any_value(passes) AS passes, any_value(n_blocks) AS n_blocks, any_value(rest) AS rest,
                 sum(sum(size)) OVER (PARTITION BY source ORDER BY block) - sum(size) AS ahead FROM r GROUP BY source, block)
    GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.passes + CASE WHEN r.rest > 0 AND 2 * place + r.size <= 2 * r.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       z.quota AS blocks, CAST(CASE WHEN (SELECT sum(quota) FROM z) % 16 = 0 THEN 0 ELSE 1 END AS BIGINT) AS spread
FROM r JOIN z ON r.source IS NOT DISTINCT FROM z.source
"""


@query("op6_importance_resampling")
def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_hypergeometric_mix", MIX_SQL)
def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "blocks", "spread")


@query("op8_cross_polytope")
def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query("op9_line_blocks")
def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_minimax_shards")
def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).drop("tie")


AUDIT_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
    SELECT part, doc_id, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
    FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
    SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
    FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31
    AND f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0) AS before FROM o, range(1, 6) r(step)),
e AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
           coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
    FROM c, (SELECT filter_order, step, bit, CAST(before AS INTEGER) AS before FROM s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM e
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LEXICAL_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
i AS (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
size AS (SELECT row, count(*) AS n FROM d GROUP BY row),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM size),
norm AS (SELECT row, 75 + (25 * n * big_n) // big_l AS m FROM size, whole),
tf AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
q AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM i GROUP BY item, term),
s AS (
    SELECT q.item, any_value(q.item_id) AS item_id, any_value(tf.doc_id) AS doc_id, CAST(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * norm.m))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term) JOIN norm USING (row) GROUP BY q.item, tf.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op12_lexical_treap", LEXICAL_SQL)
def op12_lexical_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_jaccard_tiles")
def op13_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))
