"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1 bits.  For each bit a binary classifier over
hashed byte trigrams tells the languages with +1 from those with -1: its weights are log
ratios of the two sides' trigram probabilities, its margin is the mean weight over a text's
trigrams, moved and scaled so that the two sides' expected margins are +1 and -1.  A text gets
the language whose codeword has the least loss, where bits count by how well they separate;
a text whose second-best language comes close is flagged as ambiguous.

Trigrams are counted on a bounded sample of labelled documents (``PER_LANGUAGE`` of each
language, chosen by a hash of the doc_id); predictions read whole texts.
"""
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common

BUCKETS = 1 << 15
#: Documents of each language, about, that trigrams are counted on.
PER_LANGUAGE = 5_000
UNKNOWN = "und"
#: Texts are read this many bytes at a time.
PIECE = 1 << 20
#: A text is ambiguous if the odds of its best language against the second are below this.
MIN_ODDS = 1.5
SHARPNESS, SMOOTHING = 4.0, 0.5

_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def trigrams(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Hashed trigrams of letters and non-ASCII bytes, by pieces: positions of their middle bytes in ``raw``, and buckets."""
    for at in range(0, len(raw), PIECE):
        low = max(0, at - 1)
        clean = np.full(min(len(raw), at + PIECE + 1) - low + (at == 0) + (at + PIECE + 1 > len(raw)), 32, dtype=np.uint8)
        body = _CLEAN[np.frombuffer(raw, dtype=np.uint8, count=min(len(raw), at + PIECE + 1) - low, offset=low)]
        clean[int(at == 0): int(at == 0) + len(body)] = body
        middle = np.flatnonzero(clean[1:-1] != 32)
        wide = clean.astype(np.uint32)
        code = (wide[middle] << np.uint32(16)) | (wide[middle + 1] << np.uint32(8)) | wide[middle + 2]
        yield middle + at, ((code * np.uint32(2654435769)) >> np.uint32(17)).astype(np.int32)


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if _ASCII_LETTER.search(text):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    """Languages, their codewords (languages x bits), and per bit the trigram weights, centre, half distance and share of the loss."""
    languages: list
    code: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    half: np.ndarray
    share: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row of mean weights: the best language's number, its score and whether it is ambiguous."""
        z = np.clip((margins - self.centre) / self.half, -3, 3)
        loss = np.zeros((len(z), len(self.code)))
        for k, word in enumerate(self.code):
            loss[:, k] = (self.share * np.log1p(np.exp(-SHARPNESS * z * word))).sum(axis=1)
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ranked = np.sort(chance, axis=1)
        odds = ranked[:, -1] / ranked[:, -2] if len(self.code) > 1 else np.full(len(z), np.inf)
        return best, chance[np.arange(len(z)), best], odds < MIN_ODDS


def codewords(n: int) -> np.ndarray:
    """All splits of up to five languages; for more, 12 bits per doubling, drawn once with a fixed seed and without equal rows."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1, *bits] for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits], dtype=float).T
    rng = np.random.default_rng(n)
    while True:
        code = rng.choice([-1.0, 1.0], size=(n, 12 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if len(np.unique(code, axis=0)) == n:
            return code


def train(counts: dict[str, np.ndarray]) -> Model:
    """The model of trigram counts by language."""
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, np.ones((1, 1)), np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(1), np.ones(1), np.ones(1))
    code = codewords(len(languages))
    chance = np.array([counts[name] + SMOOTHING for name in languages])
    chance /= chance.sum(axis=1, keepdims=True)
    plus = np.array([chance[word > 0].mean(axis=0) for word in code.T])
    minus = np.array([chance[word < 0].mean(axis=0) for word in code.T])
    weights = np.log(plus) - np.log(minus)
    high, low = (plus * weights).sum(axis=1), (minus * weights).sum(axis=1)
    half = np.maximum((high - low) / 2, 1e-9)
    return Model(languages, code, weights.T.astype(np.float32).copy(), (high + low) / 2, half, half / half.sum() * len(half))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1))):
            mine = counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
            for _, buckets in trigrams(text or b""):
                mine += np.bincount(buckets, minlength=BUCKETS)
    for name, mine in counts.items():
        at = np.flatnonzero(mine)
        yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the labelled documents that are not held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row.lang: row.n for row in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return train({})
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    rows = common.arrow_map(sample.select("lang", "text"), _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = {name: np.zeros(BUCKETS) for name in sizes}
    for row in rows:
        counts[row.lang][row.bucket] = row.n
    return train(counts)


def classify(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (0 to 1) and ambiguity of each text; null texts and those without a letter are ``und`` with score 0."""
    raws = list(common.texts_of(texts))
    ends = np.cumsum([len(raw or b"") + 1 for raw in raws])
    n_bits = model.weights.shape[1]
    sums, seen = np.zeros((len(raws), n_bits)), np.zeros(len(raws), dtype=np.int64)
    for positions, buckets in trigrams(b" ".join(raw or b"" for raw in raws)):
        owner = np.searchsorted(ends, positions, side="right")
        for at in range(0, len(owner), PIECE // 4):
            some = owner[at: at + PIECE // 4]
            heads = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            sums[some[heads]] += np.add.reduceat(model.weights[buckets[at: at + PIECE // 4]], heads, axis=0, dtype=np.float64)
            seen[some[heads]] += np.diff(np.concatenate([heads, [len(some)]]))
    best, score, unsure = model.decode(sums / np.maximum(seen, 1)[:, None])
    known = np.array([bool(seen[i]) and has_letter(raw) for i, raw in enumerate(raws)], dtype=bool) & bool(model.languages)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())]
    return names, np.where(known, score, 0.0), np.where(known, unsure, True)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, 1, PIECE):
            names, score, unsure = classify(model.value, batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                                  names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, ambiguous.

    Null texts and texts without a letter are ``und`` with score 0; so is every text where
    nothing could be learned.  Repeated rows have equal results.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return common.arrow_map(rows, lambda it: _predict(it, sent), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def _keep(batches: Iterator[pa.RecordBatch], model, column: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, column, PIECE):
            _, _, unsure = classify(model.value, batch.column(column))
            yield batch.filter(pa.array(~unsure))


def drop_unknown(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is neither unknown nor ambiguous, with all their columns."""
    sent, column = docs.sparkSession.sparkContext.broadcast(model or learn(docs)), docs.columns.index("text")
    return common.arrow_map(docs, lambda it: _keep(it, sent, column), docs.schema)
