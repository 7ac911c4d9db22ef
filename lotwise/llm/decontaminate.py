"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.  A window is
``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.

From both sides the k-gram whose hash is the smallest in some run of ``WINDOW - K + 1``
k-grams is kept (ties: all of them).  A shared window has the same smallest k-gram on both
sides, so every shared window shares a kept fingerprint.  A match is extended to both sides, to
all windows that hold the fingerprint; each is looked up among the windows of the items, once
per text however often it repeats, and then compared word by word.  A short item is one window,
which is looked up among all word sequences of that length.
"""
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common
from lotwise.session import staged

WINDOW, K = 13, 5
#: Words of benchmark items that are sent to the executors at once (about 30 MB); more items are matched block by block.
BLOCK_WORDS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts in a row: lower-cased bytes, where each word starts and ends, its hash and its text.

    ``kinds``: the kind of each byte, 0 between words; bytes of one kind in a row are a word.
    """

    def __init__(self, texts: list[bytes | None], kinds: np.ndarray = _WORD.view(np.uint8), lower: bool = True):
        raw = np.frombuffer(b" ".join(text or b"" for text in texts), dtype=np.uint8)
        low = _LOWER[raw] if lower else raw
        kind = np.zeros(len(low) + 2, dtype=np.uint8)
        kind[1:-1] = kinds[low]
        turn = kind[1:] != kind[:-1]
        self.start, self.end = np.flatnonzero(turn & (kind[1:] != 0)), np.flatnonzero(turn & (kind[:-1] != 0))
        self.low = low.tobytes()
        self.hash = self._hashes(low)
        lengths = np.array([len(text or b"") for text in texts], dtype=np.int64)
        ends = np.cumsum(lengths + 1)
        self.bounds = np.searchsorted(self.start, np.concatenate([[0], ends]))  # words before each text
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        found = np.empty(len(self.start), dtype=np.uint64)
        first = 0
        while first < len(found):
            at = int(self.start[first])
            stop = max(first + 1, int(np.searchsorted(self.end, at + _PIECE, side="right")))
            upto = int(self.end[stop - 1])
            n = upto - at
            up, down = (_UP, _DOWN) if n <= _PIECE else (_powers(_BASE, n), _powers(_INVERSE, n))
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((low[at:upto].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            s, e = self.start[first:stop] - at, self.end[first:stop] - at
            found[first:stop] = (sums[e] - sums[s]) * down[s]
            first = stop
        return _mix(found)

    def word(self, i: int) -> bytes:
        return self.low[self.start[i]: self.end[i]]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position on, and whether they are of one text."""
        n = max(0, len(self.hash) - k + 1)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total = total * _BASE + self.hash[j: j + n]
        return _mix(total), self.text[:n] == self.text[k - 1: k - 1 + n]

    def gram_at(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each of some positions on."""
        total = np.zeros(len(starts), dtype=np.uint64)
        for j in range(k):
            total = total * _BASE + self.hash[starts + j]
        return _mix(total)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest else x


def winnow(words: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept k-grams, and their hashes."""
    hashes, _ = words.grams(k)
    run = window - k + 1
    if len(hashes) < run:
        return np.empty(0, dtype=np.int64), hashes[:0]
    least = _sliding(hashes, run, np.minimum)
    least[words.text[: len(least)] != words.text[window - 1: window - 1 + len(least)]] = 0  # not within one text
    padded = np.concatenate([np.zeros(run - 1, dtype=np.uint64), least, np.zeros(run - 1, dtype=np.uint64)])
    kept = np.flatnonzero((_sliding(padded, run, np.maximum) == hashes) & (hashes != 0))
    return kept, hashes[kept]


class Matcher:
    """A block of benchmark items: their fingerprints, and their windows with the items that hold each."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.names = [name for name, _ in items]
        self.words = words = Words([None if text is None else text.encode("utf-8", "surrogatepass") for _, text in items])
        self.prints = np.unique(winnow(words)[1])
        self.windows = {}  # words of a window -> sorted hashes, places in the items, the first place of each hash (one place per item)
        sizes = np.diff(words.bounds)
        for length in range(1, WINDOW + 1):
            hashes, whole = words.grams(length)
            mine = np.flatnonzero(whole & (sizes[words.text[: len(hashes)]] == length) if length < WINDOW else whole)
            if not len(mine):
                continue
            at = mine[np.lexsort((words.text[mine], hashes[mine]))]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (hashes[at[1:]] != hashes[at[:-1]]) | (words.text[at[1:]] != words.text[at[:-1]])
            at = at[new]
            keys, first = np.unique(hashes[at], return_index=True)
            self.windows[length] = keys, at, np.append(first, len(at))

    def _extended(self, words: Words) -> np.ndarray:
        """Where the windows start that hold a fingerprint of an item."""
        at, hashes = winnow(words)
        if not len(at) or not len(self.prints):
            return at[:0]
        at = at[self.prints[np.minimum(np.searchsorted(self.prints, hashes), len(self.prints) - 1)] == hashes]
        text = words.text[at]
        low, high = np.maximum(at - (WINDOW - K), words.bounds[text]), np.minimum(at, words.bounds[text + 1] - WINDOW)
        fits = low <= high
        n = len(words.hash) + 1
        return np.flatnonzero(np.cumsum(np.bincount(low[fits], minlength=n) - np.bincount(high[fits] + 1, minlength=n)) > 0)

    def runs(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Per text with hits: the intervals of hit words (from its first word on), and the items that occur.

        Equal windows of a text are compared with the items once, so the time is linear in its words.
        """
        found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
        for length, (keys, places, first) in self.windows.items():
            starts = self._extended(words) if length == WINDOW else np.flatnonzero(words.grams(length)[1])
            hashes = words.gram_at(starts, length)
            spot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[spot] == hashes
            starts, spot = starts[hit], spot[hit]
            same, other = np.ones(len(starts), dtype=bool), places[first[spot]]
            for j in range(length):
                same &= words.hash[starts + j] == self.words.hash[other + j]
            starts, spot = starts[same], spot[same]
            cuts = np.flatnonzero(np.diff(words.text[starts])) + 1
            for mine, kinds in zip(np.split(starts, cuts), np.split(spot, cuts)) if len(starts) else ():
                text = int(words.text[mine[0]])
                distinct, some, kind = np.unique(kinds, return_index=True, return_inverse=True)
                equal = np.array([all(words.word(i + j) == self.words.word(place + j) for j in range(length))
                                  for i, place in zip(mine[some].tolist(), places[first[distinct]].tolist())])
                mine = mine[equal[kind]]
                if not len(mine):
                    continue
                apart = np.diff(mine) > length
                begins, ends = mine[np.append(True, apart)] - words.bounds[text], mine[np.append(apart, True)] + length - words.bounds[text]
                found[text][0].extend(zip(begins.tolist(), ends.tolist()))
                for one in distinct[equal].tolist():
                    found[text][1].update(self.words.text[places[first[one]: first[one + 1]]].tolist())
        return found


def covered(intervals: list[tuple[int, int]]) -> int:
    """Words in the union of intervals."""
    total = last = 0
    for a, b in sorted(intervals):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def blocks(benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> Iterator[Matcher]:
    """The benchmark as matchers of bounded size; a null item_id is listed as an empty string."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toLocalIterator()
    for row in rows:
        held.append((row.item_id, row.text))
        size += 1 + len(row.text or "") // 4
        if size >= most_words:
            yield Matcher(held)
            held, size = [], 0
    if held:
        yield Matcher(held)


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FOUND = "doc_id long, tie long, n_words long, runs array<struct<a:int,b:int>>, items array<string>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_words", pa.int64()),
                    ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _judge(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> the result columns, against one block."""
    for batch, counts, runs, names in _matches(batches, matcher, 1):
        hits = np.zeros(batch.num_rows, dtype=np.int64)
        items, digests = hits.copy(), [_digest([])] * batch.num_rows
        for i, (intervals, mine) in runs.items():
            found = {names[item] for item in mine}
            hits[i], items[i], digests[i] = covered(intervals), len(found), _digest(list(found))
        yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(hits), pa.array(items), pa.array(digests),
                               pa.array((hits > 0) & (20 * hits >= counts))],
                              names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _find(batches: Iterator[pa.RecordBatch], matcher, all_rows: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, text, tie -> what one block finds, for all rows or those with hits."""
    for batch, counts, runs, names in _matches(batches, matcher, 1):
        rows = range(batch.num_rows) if all_rows else sorted(runs)
        intervals = [[{"a": a, "b": b} for a, b in runs[i][0]] if i in runs else [] for i in rows]
        items = [sorted({names[item] for item in runs[i][1]}) if i in runs else [] for i in rows]
        at = pa.array(list(rows), pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), pa.array(counts[list(rows)], pa.int64()), pa.array(intervals, _FOUND.field("runs").type),
                               pa.array(items, _FOUND.field("items").type)], schema=_FOUND)


def _matches(batches, matcher, column: int):
    block = matcher.value
    for whole in batches:
        for batch in common.slices(whole, column, 2 << 20):
            words = Words(list(common.texts_of(batch.column(column))))
            yield batch, np.diff(words.bounds), block.runs(words), block.names


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [[(run["a"], run["b"]) for some in row for run in some] for row in batch.column(3).to_pylist()]
        items = [sorted({name for some in row for name in some}) for row in batch.column(4).to_pylist()]
        hits = [covered(row) for row in runs]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(hits, pa.int64()), pa.array([len(row) for row in items], pa.int64()),
                               pa.array([_digest(row) for row in items]),
                               pa.array([is_contaminated(hit, n) for hit, n in zip(hits, batch.column(2).to_pylist())], pa.bool_()), batch.column(1)],
                              names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "tie"])


def judge(docs: DataFrame, benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean; so is every document where the benchmark
    is empty.  Repeated rows have a result each; repeated items count once by item_id.
    Other columns are ignored.  A benchmark beyond ``most_words`` is matched in blocks,
    whose findings meet per document.
    """
    spark = docs.sparkSession
    rest = blocks(benchmark, most_words)
    first, second = next(rest, None) or Matcher([]), next(rest, None)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if second is None:
        sent = spark.sparkContext.broadcast(first)
        return common.arrow_map(pairs, lambda it: _judge(it, sent), RESULT)
    return _judge_blocks(pairs, first, second, rest).drop("tie")


def _judge_blocks(pairs: DataFrame, first: Matcher, second: Matcher | None, rest: Iterator[Matcher]) -> DataFrame:
    """The result columns and tie (the hash of the text) per row of ``pairs`` (doc_id, text), block by block."""
    spark = pairs.sparkSession
    keyed = pairs.withColumn("tie", F.xxhash64("text"))

    def found(matcher: Matcher, all_rows: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(matcher)
        out = staged(common.arrow_map(keyed, lambda it: _find(it, sent, all_rows), FOUND), "decontaminate")
        sent.unpersist()
        return out

    base = found(first, True)
    hits = base.where(F.size("runs") > 0)
    while second is not None:
        hits, second = hits.unionByName(found(second, False)), next(rest, None)
    # rows that repeat a document have equal findings: one of each block is enough
    met = (hits.groupBy("doc_id", "tie").agg(F.collect_set("runs").alias("all_runs"), F.collect_set("items").alias("all_items")))
    every = (base.select("doc_id", "tie", "n_words").alias("d")
             .join(met.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.tie") == F.col("m.tie")), "left")
             .select("d.doc_id", "d.tie", "d.n_words", F.coalesce("all_runs", F.array().cast("array<array<struct<a:int,b:int>>>")).alias("all_runs"),
                     F.coalesce("all_items", F.array().cast("array<array<string>>")).alias("all_items")))
    return common.arrow_map(every, _merge, RESULT + ", tie long")


def _keep(batches: Iterator[pa.RecordBatch], matcher, column: int) -> Iterator[pa.RecordBatch]:
    for batch, counts, runs, _ in _matches(batches, matcher, column):
        clean = [i not in runs or not is_contaminated(covered(runs[i][0]), int(counts[i])) for i in range(batch.num_rows)]
        yield batch.filter(pa.array(clean, pa.bool_()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    rest = blocks(benchmark, most_words)
    first, second = next(rest, None), next(rest, None)
    if first is None:
        return docs
    if second is None:
        sent, column = docs.sparkSession.sparkContext.broadcast(first), docs.columns.index("text")
        return common.arrow_map(docs, lambda it: _keep(it, sent, column), docs.schema)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bad = _judge_blocks(pairs, first, second, rest).where("contaminated").select(F.col("doc_id").alias("__bad"), F.col("tie").alias("__tie")).distinct()
    # each row is judged by its own text: other rows may have the same doc_id, or none
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__bad")) & (F.xxhash64("text") == F.col("__tie")), "left_anti")
