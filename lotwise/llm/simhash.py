"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint has 64 bits: bit b is 1 if it is set in more than half of the XXH64
hashes of its word shingles.  Fingerprints within ``BUDGET`` differing bits are linked.

The 64 bits are cut into ``BUDGET + 1`` parts.  If two fingerprints differ in at most
``BUDGET`` bits, then in some cyclic order of the parts the first j parts together hold at
most ``j - 1`` differing bits, for every j (any cyclic sequence of numbers with a sum below
its length has such a start).  So for each rotation of the parts a binary trie is built, and
pairs of its nodes are walked down together with the bits in which they differ; a pair is
dropped as soon as it is over the budget of its depth.  Budget zero holds for the first part,
so Spark deals the fingerprints out by rotation and first part, and each task walks its own
subtries; a crowded subtrie is dealt out further by its second part, of which one bit may differ.  A pair of nodes whose leaves must all be linked is linked at once; pairs of nodes
that are known to be connected are dropped.  Tasks return a spanning forest of their links,
never all pairs.

``drop_near_duplicates`` keeps one document of each group of near copies.  Its fingerprints
are of the set of a text's words, which near copies change least, with a wider budget; links
are confirmed inside the tasks by a one-permutation MinHash sketch of the texts' five-word
shingles, whose estimate of their Jaccard similarity must reach ``SIMILAR``.  Texts of one
fingerprint, and those of two near ones, are all candidates of each other; where they are many,
only pairs that share a band of their sketches are compared, which loses none (``Sketches``).
An edit of a short text may turn more bits than the budget, and a sketch may fall short of the
threshold by chance.  So texts that the tries leave apart, but that share one of ``BANDS`` hashes
of ``BAND_ROWS`` minima of their shingles, are compared by their exact sets as well
(``banded_links``).
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import common, jaccard_join
from lotwise.llm.components import components
from lotwise.session import staged

SHINGLE, BUDGET, SEED = 4, 4, 42
#: Fingerprints of one subtrie that a task holds, about; a larger one is dealt out by its next part, then in pairs of chunks.
CHUNK = 20_000
#: Node pairs that are walked down at once.
PAIRS = 1 << 18
_SOME = 8192
#: Of the deduplication: differing bits of candidates, words of a shingle, similarity of near copies, and bins of a sketch.
WIDE_BUDGET, SKETCH_SHINGLE, SIMILAR, BINS = 6, 5, 0.8, 512
#: Of a pair at the threshold a band is equal with probability 0.8^7 = 0.21, one of 20 with 0.991.
BANDS, BAND_ROWS = 20, 7
#: Pairs of leaves of two nodes that are all compared; of more, those that share a band of sketches.
FEW = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's SimHash; 0 for a text without words.  The hashes are counted a bounded number at a time."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    row = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SOME):
        some = np.array([hashed(row[a:b], seed) for a, b in zip(starts[at:at + _SOME], stops[at:at + _SOME])], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _word_mark(words: np.ndarray) -> int:
    """SimHash of the set of a text's words, by their hashes; 0 without words."""
    words = np.unique(words)
    if not len(words):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(words), _SOME):
        counts += np.unpackbits(words[at: at + _SOME].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(words), bitorder="little").view("<u8")[0])


def _sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One byte per bin: of the smallest shingle hash that falls into it, from 1 to 255; 0 if none does."""
    out = np.zeros(bins, dtype=np.uint8)
    spot = ((shingles >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
    # shingles ascend, so the last one written to a bin is its smallest
    out[spot[::-1]] = (shingles[::-1] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


_MINIMA = np.random.default_rng(20).integers(1, 1 << 63, size=(2, BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A hash per band of the minima of its permutations of the shingles."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _SOME):
        some = shingles[None, at: at + _SOME] ^ _MINIMA[0]
        some *= _MINIMA[1]
        np.minimum(least, some.min(axis=1), out=least)
    mixed = np.zeros(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return mixed


def word_mark(text: bytes | None) -> int:
    return _word_mark(jaccard_join.word_hashes([text])[0])


def sketch(text: bytes | None) -> np.ndarray:
    """The sketch of the five-word shingles of a text."""
    return _sketch(jaccard_join.shingle_set(jaccard_join.word_hashes([text])[0], SKETCH_SHINGLE))


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity by rows of two arrays of sketches; texts without words are alike."""
    either = ((x > 0) | (y > 0)).sum(axis=1)
    return np.where(either > 0, ((x == y) & (x > 0)).sum(axis=1) / np.maximum(either, 1), 1.0)


class Sketches:
    """Likeness of leaves by their sketches, and a sure way to the like ones among many.

    Of alike sketches x and y at most ``(1 - SIMILAR) / SIMILAR`` times the used bins of x
    differ, and at most ``1 - SIMILAR`` of all bins.  Each spoils one band of four bins.  So
    if more bands of x or of y than that are used, one of them is equal in both.  Sketches
    with fewer used bands are compared with all others like them.
    """

    def __init__(self, rows: np.ndarray):
        self.rows, self.bands = rows, np.ascontiguousarray(rows).view("<u4")
        most = np.minimum((rows > 0).sum(axis=1) * (1 - SIMILAR) / SIMILAR, rows.shape[1] * (1 - SIMILAR)) + 1e-6
        self.weak = np.flatnonzero((self.bands > 0).sum(axis=1) <= np.floor(most))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        parts_ = [estimate(self.rows[x[i:i + _SOME]], self.rows[y[i:i + _SOME]]) >= SIMILAR for i in range(0, len(x), _SOME)]
        return np.concatenate(parts_) if parts_ else np.empty(0, dtype=bool)

    def likely(self, leaves: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves next to each other by some of the bands: few pairs that connect most like leaves."""
        for band in range(0, self.bands.shape[1], 8):
            order = leaves[np.argsort(self.bands[leaves, band], kind="stable")]
            value = self.bands[order, band]
            at = np.flatnonzero((value[1:] == value[:-1]) & (value[1:] > 0))
            yield order[at], order[at + 1]

    def candidates(self, a: int, a_end: int, b: int, b_end: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves from a to a_end and from b to b_end with different labels, all alike ones among them."""
        found, total, most = [], 0, (a_end - a) * (b_end - b)
        mine, other = label[a:a_end].astype(np.uint64), label[b:b_end].astype(np.uint64)
        for band in range(self.bands.shape[1]):
            x, y = self.bands[a:a_end, band].astype(np.uint64) << np.uint64(32), self.bands[b:b_end, band].astype(np.uint64) << np.uint64(32)
            order = np.argsort(y | other)
            keys = (y | other)[order]
            low = np.searchsorted(keys, x)
            count = np.where(x > 0, np.searchsorted(keys, x | np.uint64((1 << 32) - 1), side="right") - low, 0)
            strange = count - np.where(x > 0, np.searchsorted(keys, x | mine, side="right") - np.searchsorted(keys, x | mine), 0)
            total += int(strange.sum())
            if total >= most:  # bands select nothing: every pair once is less
                found = None
                break
            found.append((order, low, np.where(strange > 0, count, 0)))
        if found is None:
            yield from _all_pairs(np.arange(a, a_end), np.arange(b, b_end))
            return
        for order, low, count in found:
            for i, k in _spans(count):
                yield a + i, b + order[low[i] + k]
        yield from _all_pairs(self.weak[(self.weak >= a) & (self.weak < a_end)], self.weak[(self.weak >= b) & (self.weak < b_end)])


def _spans(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, k) for each k below count[i], about ``PAIRS`` at a time."""
    ends = np.cumsum(count)
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < total:
        places = np.arange(at, min(total, at + PAIRS))
        i = np.searchsorted(ends, places, side="right")
        yield i, places - (ends[i] - count[i])
        at += PAIRS


def _all_pairs(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, k in _spans(np.full(len(x), len(y), dtype=np.int64)):
        yield x[i], y[k]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(text) for text in common.texts_of(batch.column(1))], dtype=np.uint64)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(marks.view(np.int64))], names=["doc_id", "tie", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), mark (the fingerprint as a signed 64-bit number) per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return common.arrow_map(rows, _fingerprints, "doc_id long, tie long, mark long")


def parts(budget: int = BUDGET) -> list[int]:
    """Widths of the parts, first to last: 64 bits in budget + 1 parts, as even as may be."""
    return [64 // (budget + 1) + (i < 64 % (budget + 1)) for i in range(budget + 1)]


def turned(marks: np.ndarray, rotation: int, budget: int = BUDGET) -> np.ndarray:
    """Fingerprints rotated so that part ``rotation`` has the highest bits."""
    by = sum(parts(budget)[:rotation])
    return marks if by == 0 else (marks << np.uint64(by)) | (marks >> np.uint64(64 - by))


def budgets(rotation: int, budget: int = BUDGET) -> list[int]:
    """Differing bits that are allowed once the top d bits are compared, for d from 0 to 64."""
    widths = parts(budget)
    widths = widths[rotation:] + widths[:rotation]
    return [0] + [j for j, width in enumerate(widths) for _ in range(width)]


class Forest:
    """Disjoint sets over positions; sets are joined many at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:  # every label points at a root again
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def walk(leaves: np.ndarray, allowed: list[int], budget: int = BUDGET, confirm: Sketches | None = None) -> np.ndarray:
    """Labels of ascending ``leaves``: linked ones have the label of their first connected leaf.

    Pairs of trie nodes, each a range of leaves, go down one bit at a time.  ``allowed``:
    differing bits by depth.  The top bits up to the first part are equal, so the walk
    starts at the nodes of that depth.  ``confirm`` says which pairs of leaves within the
    budget are links (all, if None; leaves are then distinct).  All leaves of two equal or
    near nodes meet unless they are connected before.
    """
    n, forest = len(leaves), Forest(len(leaves))

    def link(x: np.ndarray, y: np.ndarray) -> None:
        if confirm is not None:
            some = forest.label[x] != forest.label[y]
            x, y = x[some], y[some]
            some = confirm(x, y)
            x, y = x[some], y[some]
        forest.join(x, y)

    def connected(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Which pairs of nodes have leaves of one connected set only."""
        label = forest.label
        same = (label[a] == label[b]) & (label[a_end - 1] == label[a]) & (label[b_end - 1] == label[a])
        if same.any():
            edges = np.flatnonzero(label[1:] != label[:-1]) + 1 if n > 1 else np.empty(0, dtype=np.int64)
            same &= np.searchsorted(edges, a, side="right") == np.searchsorted(edges, a_end - 1, side="right")
            same &= np.searchsorted(edges, b, side="right") == np.searchsorted(edges, b_end - 1, side="right")
        return same

    def meet(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> None:
        """All pairs of leaves of pairs of nodes; the first ones first, which mostly connect the others."""
        link(a, b)
        left = ~connected(a, a_end, b, b_end)
        a, a_end, b, b_end = a[left], a_end[left], b[left], b_end[left]
        count = (a_end - a) * (b_end - b)
        few = count <= FEW
        x, y, wide = a[few], b[few], (b_end - b)[few]
        for i, k in _spans(count[few]):
            one, other = x[i] + k // wide[i], y[i] + k % wide[i]
            some = (one < other) | (x[i] != y[i])  # within a node each pair once
            link(one[some], other[some])
        for node in zip(*(column[~few].tolist() for column in (a, a_end, b, b_end))):
            for one, other in confirm.likely(np.unique(np.concatenate([np.arange(*node[:2]), np.arange(*node[2:])]))):
                link(one, other)
            for one, other in confirm.candidates(*node, forest.label):
                some = one < other if node[0] == node[2] else slice(None)
                link(one[some], other[some])

    if confirm is not None and n > 1:
        # near copies are mostly connected through those before them, so that few pairs are left
        again = np.flatnonzero(leaves[1:] == leaves[:-1]) + 1
        link(again - 1, again)
        link(np.searchsorted(leaves, leaves[again]), again)
    top = allowed.index(1) - 1 if budget else 64
    heads = np.flatnonzero(np.concatenate([[True], leaves[1:] >> np.uint64(64 - top) != leaves[:-1] >> np.uint64(64 - top)])) if top < 64 else np.arange(n)
    ends = np.concatenate([heads[1:], [n]])
    some = np.flatnonzero(ends - heads > 1)
    stack = [(top, heads[some], ends[some], heads[some], ends[some], np.zeros(len(some), dtype=np.int64))]
    while stack:
        depth, a, a_end, b, b_end, differ = stack.pop()
        while len(a):
            if len(a) > PAIRS:
                half = len(a) // 2
                stack.append((depth, a[half:], a_end[half:], b[half:], b_end[half:], differ[half:]))
                a, a_end, b, b_end, differ = a[:half], a_end[:half], b[:half], b_end[:half], differ[:half]
            # leaves of pairs with one leaf on each side are compared at once
            ones = (a_end - a == 1) & (b_end - b == 1)
            if ones.any():
                x, y = a[ones], b[ones]
                near = np.bitwise_count(leaves[x] ^ leaves[y]) <= budget
                link(x[near], y[near])
            # all leaves of a pair are linked if the bits below can't exceed the budget
            sure = ~ones & (differ + (64 - depth) <= budget)
            if confirm is not None:
                if depth == 64:  # leaves of one side are equal, but not their sketches
                    if sure.any():
                        meet(a[sure], a_end[sure], b[sure], b_end[sure])
                else:
                    sure[:] = False
            elif sure.any():
                for low, high in ((a[sure], a_end[sure]), (b[sure], b_end[sure])):
                    for k in range(int((high - low).max())):
                        more = low + k < high
                        forest.join(low[more], low[more] + k)
                forest.join(a[sure], b[sure])
            # pairs within one connected set have nothing to add
            left = ~(ones | sure | connected(a, a_end, b, b_end))
            a, a_end, b, b_end, differ = a[left], a_end[left], b[left], b_end[left], differ[left]
            if not len(a):
                break
            depth += 1
            bit = np.uint64(1) << np.uint64(64 - depth)

            def middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                """Where the leaves of a node begin to have the bit."""
                prefix = leaves[low] >> np.uint64(64 - depth) | np.uint64(1)
                return np.clip(np.searchsorted(leaves, prefix << np.uint64(64 - depth)), low, high)

            a_mid, b_mid = middle(a, a_end), middle(b, b_end)
            own = a == b  # a node with itself: its two halves meet once
            del bit
            sides = [(a, a_mid, b, b_mid, differ, None), (a_mid, a_end, b_mid, b_end, differ, None),
                     (a, a_mid, b_mid, b_end, differ + 1, None), (a_mid, a_end, b, b_mid, differ + 1, ~own)]
            rows = []
            for x, x_end, y, y_end, d, also in sides:
                ok = (x_end > x) & (y_end > y) & (d <= allowed[depth])
                ok &= ~((x == y) & (x_end - x == 1))
                if also is not None:
                    ok &= also
                rows.append((x[ok], x_end[ok], y[ok], y_end[ok], d[ok]))
            a, a_end, b, b_end, differ = (np.concatenate(columns) for columns in zip(*rows))
    return forest.label


def _links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows rotation, extra, mark, node and maybe sketch: links between the nodes of this task."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    rows = [table.column(i).to_numpy().astype(np.int64) for i in range(4)]
    sketches = None
    if table.num_columns > 4:
        sketches = np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
    by = np.lexsort((rows[1], rows[0]))
    new = (np.diff(rows[0][by]) != 0) | (np.diff(rows[1][by]) != 0)
    # subtries that are not dealt out further make one trie, as their first parts differ
    for some in np.split(by, np.flatnonzero(new) + 1):
        rotation = int(rows[0][some[0]])
        marks = turned(rows[2][some].view(np.uint64), rotation, budget)
        order = np.lexsort((rows[3][some], marks))
        marks, some = marks[order], some[order]
        confirm = None if sketches is None else Sketches(sketches[some])
        label = walk(marks, budgets(rotation, budget), budget, confirm)
        linked = np.flatnonzero(label != np.arange(len(label)))
        if len(linked):
            yield pa.record_batch([pa.array(rows[3][some[linked]]), pa.array(rows[3][some[label[linked]]])], names=["a", "b"])


def near_links(nodes: DataFrame, chunk: int = CHUNK, budget: int = BUDGET) -> DataFrame:
    """a, b: a spanning set of links between nodes (node, mark) within the budget.

    With a column ``sketch`` links are confirmed by it, and marks may repeat; without it
    marks are distinct.
    """
    spark, width = nodes.sparkSession, parts(budget)
    more = [c for c in nodes.columns if c == "sketch"]
    turns = [F.struct(F.lit(r).alias("rotation"),
                      F.shiftrightunsigned(F.shiftleft("mark", sum(width[:r])) if r else F.col("mark"), 64 - width[r]).cast("int").alias("head")) for r in range(len(width))]
    spread = nodes.select("node", "mark", *more, F.explode(F.array(*turns)).alias("t")).select("node", "mark", *more, "t.rotation", "t.head")
    below = F.shiftrightunsigned(F.shiftleft("mark", width[0]), 64 - width[1]).cast("int")
    for r in range(1, len(width)):
        after = width[(r + 1) % len(width)]
        turned_mark = F.col("mark") if not sum(width[:r + 1]) % 64 else F.shiftleft("mark", sum(width[:r + 1]))
        below = F.when(F.col("rotation") == r, F.shiftrightunsigned(turned_mark, 64 - after).cast("int")).otherwise(below)
    # a crowded subtrie is dealt out by its next part, of which one bit may differ: each mark also visits those neighbours
    steps = F.array(F.lit(0), *(F.lit(1 << i) for i in range(max(width))))
    crowded = spread.groupBy("rotation", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("rotation", "head", F.lit(True).alias("crowded"))
    # one row for each value of a first part at most, so it may be broadcast; the marks are then shuffled once only
    placed = (spread.join(F.broadcast(crowded), ["rotation", "head"], "left")
              .withColumn("slot", F.explode(F.when(F.col("crowded"), F.transform(steps, lambda x: below.bitwiseXOR(x) + 1)).otherwise(F.array(F.lit(0))))).drop("crowded"))
    # what is still crowded, such as very many near copies, is walked once for each pair of chunks; pair (i, j) has the number i * k + j
    packed = placed.where("slot > 0").groupBy("rotation", "head", "slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk) \
        .select("rotation", "head", "slot", F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("mark", "node"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(mine, j) * F.col("k") + F.greatest(mine, j) + 1)
    whole = placed.where("slot = 0").select("rotation", "head", F.lit(0).cast("long").alias("extra"), "mark", "node", *more)
    split = (placed.where("slot > 0").join(packed, ["rotation", "head", "slot"], "left")
             .withColumn("pair", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.array_distinct(pairs))))
             .select("rotation", "head", F.xxhash64("head", "slot", "pair").alias("extra"), "mark", "node", *more))
    dealt = whole.unionByName(split).repartition(common.partitions(spark), "rotation", "head", "extra").select(F.col("rotation").cast("long").alias("rotation"), "extra", "mark", "node", *more)
    return common.arrow_map(dealt, lambda it: _links(it, budget), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, tie, mark, group (of the component), component_id (its smallest doc_id).

    Null, empty and blank texts have the fingerprint zero and are linked like any other.
    Rows that repeat a doc_id are judged each by its own text; a null doc_id is a
    component_id only where a component has no other.  Other columns are ignored.
    """
    marks = staged(fingerprints(docs), "marks")
    # the mark itself numbers the nodes
    distinct = staged(marks.groupBy("mark").agg(F.min("doc_id").alias("low")).select(F.col("mark").alias("node"), "mark", "low"), "distinct-marks")
    found = components(near_links(distinct.select("node", "mark")))
    rooted = distinct.join(found, "node", "left").select("mark", "low", F.coalesce("root", "mark").alias("group"))
    lows = rooted.groupBy("group").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "group").select("mark", "group", "component_id")
    return marks.join(named, "mark").select("doc_id", "tie", "mark", "group", "component_id")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, 1):
            words = jaccard_join.word_hashes(list(common.texts_of(batch.column(1))))
            sets = [jaccard_join.shingle_set(w, SKETCH_SHINGLE) for w in words]
            marks = np.array([_word_mark(w) for w in words], dtype=np.uint64).view(np.int64)
            bands = [_bands(s).view(np.int64) if len(s) else np.empty(0, dtype=np.int64) for s in sets]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(marks), pa.array([_sketch(s).tobytes() for s in sets], pa.binary()),
                                   common.list_array(np.concatenate(bands), np.array([len(b) for b in bands]), pa.int64())],
                                  names=["doc_id", "tie", "mark", "sketch", "bands"])


def _text_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, 1):
            sets = [jaccard_join.shingle_set(w, SKETCH_SHINGLE) for w in jaccard_join.word_hashes(list(common.texts_of(batch.column(1))))]
            maps = [jaccard_join.bitmap(s).view(np.int64) for s in sets]
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), common.list_array(np.concatenate(maps), np.array([len(m) for m in maps]), pa.int64()),
                                   pa.array([s.tobytes() for s in sets], pa.binary())], names=["tie", "n", "bits", "shingles"])


def _exact_sets(ties: DataFrame, texts: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """tie, n, bits, shingles: the exact sets of some texts, their sizes and bitmaps."""
    wanted = ties.select(F.col("tie").alias("__tie")).distinct().join(texts.select(F.col("tie").alias("__tie"), "low.doc_id"), "__tie")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.join(wanted, (F.col("tie") == F.col("__tie")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("tie", "text")
    return staged(common.arrow_map(rows, _text_sets, "tie long, n long, bits array<long>, shingles binary").dropDuplicates(["tie"]), f"{name}-sets")


def _exact_links(pairs: DataFrame, texts: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """a, b: those of the pairs of texts whose exact sets are alike; sets of too unlike sizes are not paired."""
    pairs = staged(pairs, f"{name}-pairs")
    sets = _exact_sets(pairs.select(F.col("a").alias("tie")).unionByName(pairs.select(F.col("b").alias("tie"))), texts, docs, name)
    percent = round(100 * SIMILAR)
    size = sets.select("tie", "n")
    near = (pairs.join(size.select(F.col("tie").alias("a"), F.col("n").alias("x")), "a").join(size.select(F.col("tie").alias("b"), F.col("n").alias("y")), "b")
            .where(100 * F.least("x", "y") >= percent * F.greatest("x", "y")).select("a", "b"))
    both = (near.join(sets.select(F.col("tie").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("tie").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y"))
    return staged(common.arrow_map(both, lambda it: jaccard_join.verified(it, percent), "a long, b long"), f"{name}-links")


def banded_links(texts: DataFrame, docs: DataFrame, near: DataFrame) -> DataFrame:
    """a, b: links by exact similarity between texts (tie, low, bands) that the links ``near`` do not connect.

    Texts that share a band are first compared with three texts of it: the one that shares bands
    with most others, which mostly is what the others were copied from, and two others by a
    hash that differs from band to band.  A band that this leaves in different components is a
    tile of the exact join next: its pairs are told by bitmaps in a task and are never rows,
    and no link between texts of a band is lost.
    """
    spread = staged(texts.select("tie", F.posexplode("bands").alias("at", "value")).select("tie", F.xxhash64("at", "value").alias("band")), "bands")
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = staged(spread.join(shared, "band"), "shared-bands")
    reach = live.groupBy("tie").agg(F.sum("n").alias("reach"))
    turn = F.struct(F.xxhash64("band", "tie").alias("h"), "tie")
    heads = (live.join(reach, "tie").groupBy("band").agg(F.max(F.struct("reach", "tie")).alias("x"), F.min(turn).alias("y"), F.max(turn).alias("z"))
             .select("band", F.explode(F.array("x.tie", "y.tie", "z.tie")).alias("head")))
    pairs = live.join(heads, "band").where("tie <> head").select(F.least("tie", "head").alias("a"), F.greatest("tie", "head").alias("b")).distinct()
    root = components(near).select("node", "root")
    apart = (pairs.join(root.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
             .where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b"))
    compared = staged(apart, "band-heads")
    first = _exact_links(compared, texts, docs, "band-head")
    root = components(near.unionByName(first)).select(F.col("node").alias("tie"), "root")
    placed = live.join(root, "tie", "left").select("band", "tie", F.coalesce("root", "tie").alias("root"))
    several = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    left = staged(placed.join(several, "band"), "bands-left")
    sets = _exact_sets(left, texts, docs, "band-rest").withColumnRenamed("tie", "key")
    tiles = left.join(sets.select(F.col("key").alias("tie"), "n"), "tie").select(F.col("band").alias("tile"), F.col("tie").alias("key"), "n", F.lit(0).alias("upper"), "root")
    rest = jaccard_join.tile_links(tiles, sets.select("key", "n", "bits"), lambda keys: sets.select("key", "shingles").join(keys.distinct(), "key", "left_semi"), round(100 * SIMILAR))
    return first.unionByName(rest)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies with all its columns: the smallest doc_id, then the smallest hash of the text.

    Texts are alike if they are equal, if their sketches say so, or, beyond the budget of the
    tries, if their sets of shingles do; groups are connected through likeness.  Null and blank texts are one group; a null doc_id comes last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    found = staged(common.arrow_map(rows, _sketches, "doc_id long, tie long, mark long, sketch binary, bands array<long>"), "sketches")
    # equal texts are one node, numbered by the hash of the text
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    texts = staged(found.groupBy("tie").agg(F.min(order).alias("low"), F.first("mark").alias("mark"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "texts")
    near = staged(near_links(texts.select(F.col("tie").alias("node"), "mark", "sketch"), budget=WIDE_BUDGET), "trie-links")
    links = components(near.unionByName(banded_links(texts, docs, near)))
    grouped = texts.join(links, texts["tie"] == links["node"], "left").select("low", F.coalesce("root", "tie").alias("group"))
    first = grouped.groupBy("group").agg(F.min("low").alias("s")).select("s.doc_id", "s.tie")
    chosen = staged(found.select("doc_id", "tie").alias("f").join(first.alias("c"), F.col("f.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("f.tie") == F.col("c.tie")))
                    .groupBy(F.col("f.doc_id").alias("__doc"), F.col("f.tie").alias("__tie")).agg(F.count(F.lit(1)).alias("__n")), "chosen")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__tie"))
    kept = docs.join(chosen.where("__n = 1"), same, "left_semi")
    repeated = chosen.where("__n > 1")
    if repeated.isEmpty():
        return kept
    # of rows that repeat both doc_id and text one stays
    number = F.row_number().over(Window.partitionBy("__doc", "__tie").orderBy(F.lit(0)))
    return kept.unionByName(docs.join(repeated, same).withColumn("__row", number).where("__row = 1").select(*docs.columns))
