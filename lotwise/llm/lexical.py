"""Ranked lexical search by K2-treaps over term-document grids.

Each Spark task cuts its documents into blocks.  A block is a grid with a row per term (the
most frequent first) and a column per document, padded to a square of a power of two; a cell
holds the term's impact in the document.  The grid is stored as a quadtree of which each node
takes the largest impact left in its square: the point goes to the node, the other points to
its four quadrants.  So a node bounds all that is below it, and there are as many nodes as
points, however sparse the grid.  Nodes are written level by level: four bits a node for the
quadrants that go on, the drop from the parent's impact, and the point's place in the square.

A search walks down the paths of all rows of an item's terms together.  Its state is a range
of documents with one node per row; the bound of a range is the weighted sum of the rows'
nodes and of points met before.  Ranges are kept in a heap, the best go down first, a few
hundred at a time as arrays; a range below the item's k-th score so far is dropped.  A task
keeps that score from block to block.

The index is a table: ``docs`` and ``terms`` with their document counts name the columns and
rows; ``sizes``, ``links``, ``tops``, ``rows`` and ``cols`` are the tree.
"""
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import common
from lotwise.session import staged

TOP = 20
#: A block of the index ends beyond so many documents or points, whichever comes first.
BLOCK_DOCS, BLOCK_POINTS = 4096, 1 << 19
#: Terms of the items that one pass over the index takes; row and range pairs that go down at once.
PASS_TERMS, CELLS = 500_000, 1 << 14
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Fixed values of the impact and the weight.
SCALE, LENGTH_SHARE, SATURATION, WEIGHT_SCALE = 1_000_000_000, 25, 12, 1000

# bytes of a term map to themselves, A-Z to a-z, all others to a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX_SCHEMA = "docs array<bigint>, terms array<binary>, df array<bigint>, height int, sizes array<int>, links binary, tops binary, rows binary, cols binary"


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [sum(map(len, terms(text))) for text in common.texts_of(batch.column(0))]
        yield pa.record_batch([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["n", "l"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    row = common.arrow_map(docs.select("text"), _sizes, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31, each followed by a zero."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in the fewest of 1, 2 or 4 bytes, told by the first byte."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    return np.frombuffer(data, dtype=f"<u{width}", count=n, offset=at + 1).astype(np.int64), at + 1 + n * width


def build(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, height: int) -> dict:
    """The tree over distinct points of a square of 2^height; impacts are below 2^31."""
    code = _spread(rows) << np.uint64(1) | _spread(cols)
    order = np.argsort(code)
    code, v, r, c = code[order], impacts[order].astype(np.int64), rows[order], cols[order]
    sizes, links, tops, row_places, col_places = [], [], [], [], []
    above, above_top = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    for level in range(height + 1):
        if not len(code):
            break
        cell = code >> np.uint64(2 * (height - level))
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        # the first of the largest points of each square
        key = v << 32 | (0xFFFFFFFF - np.arange(len(v), dtype=np.int64))
        at = 0xFFFFFFFF - (np.maximum.reduceat(key, heads) & 0xFFFFFFFF)
        cells, low = cell[heads], (1 << height - level) - 1
        if level:
            parent = np.searchsorted(above, cells >> np.uint64(2))
            going = np.zeros(4 * len(above), dtype=bool)
            going[4 * parent + (cells & np.uint64(3)).astype(np.int64)] = True
            links.append(np.packbits(going).tobytes())
            drop = above_top[parent] - v[at]
        else:
            drop = v[at]
        sizes.append(len(cells))
        tops.append(_narrow(drop))
        row_places.append(_narrow(r[at] & low))
        col_places.append(_narrow(c[at] & low))
        above, above_top = cells, v[at]
        left = np.ones(len(code), dtype=bool)
        left[at] = False
        code, v, r, c = code[left], v[left], r[left], c[left]
    return {"height": height, "sizes": sizes, "links": b"".join(links), "tops": b"".join(tops), "rows": b"".join(row_places), "cols": b"".join(col_places)}


class Block:
    """A block of the index, unpacked: per level the impacts, places and the number of the first node of each quadrant."""

    def __init__(self, row: dict):
        self.height, self.docs = row["height"], row["docs"]
        tops, rows, cols, links = (memoryview(row[c]) for c in ("tops", "rows", "cols", "links"))
        at_top = at_row = at_col = at_link = 0
        self.top, self.row, self.col, self.going, self.first = [], [], [], [], []
        for level, n in enumerate(row["sizes"]):
            drop, at_top = _wide(tops, at_top, n)
            place, at_row = _wide(rows, at_row, n)
            self.row.append(place)
            place, at_col = _wide(cols, at_col, n)
            self.col.append(place)
            if level:
                bits = 4 * row["sizes"][level - 1]
                going = np.unpackbits(np.frombuffer(links, dtype=np.uint8, count=-(-bits // 8), offset=at_link))[:bits].astype(bool)
                at_link += -(-bits // 8)
                self.going.append(going)
                self.first.append(np.cumsum(going) - 1)
                self.top.append(self.top[-1][np.flatnonzero(going) // 4] - drop)
            else:
                self.top.append(drop)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: "Best") -> None:
        """Offers ``best`` every document that may belong to it; ``rows`` of the item's terms, distinct."""
        h, n, width = self.height, len(self.docs), max(1, CELLS // len(rows))
        own = self.row[0][0] == rows
        found = (np.flatnonzero(own), np.full(own.sum(), self.col[0][0]), np.full(own.sum(), self.top[0][0]))
        bound = np.array([int(weights.sum() * self.top[0][0])])
        heap, turn = [(-int(bound[0]), 0, 0, np.zeros(1, dtype=np.int64), np.zeros((len(rows), 1), dtype=np.int64), bound, found)], 0
        while heap and -heap[0][0] >= best.least:
            _, _, level, ranges, nodes, bound, found = heapq.heappop(heap)
            if level == h:
                best.offer(bound, [self.docs[i] for i in ranges])
                continue
            if len(ranges) > width:  # the best go down, the others wait
                some = np.argpartition(-bound, width)
                for part in (np.sort(some[:width]), np.sort(some[width:])):
                    part = part[bound[part] >= best.least]
                    if len(part):
                        kept = self._within(found, level, ranges[part])
                        turn += 1
                        heapq.heappush(heap, (-int(bound[part].max()), turn, level, ranges[part], nodes[:, part], bound[part], kept))
                continue
            below = h - level - 1
            bits = (rows >> below & 1)[:, None]
            next_ranges = (2 * ranges[:, None] + np.arange(2)).ravel()
            if level < len(self.going):
                slots = (4 * nodes + 2 * bits)[:, :, None] + np.arange(2)
                slots = np.where(nodes[:, :, None] >= 0, slots, 0).reshape(len(rows), -1)
                there = self.going[level][slots] & np.repeat(nodes >= 0, 2, axis=1)
                child = np.where(there, self.first[level][slots], -1)
                worth = np.where(there, self.top[level + 1][child], 0)
                # points of these rows that the nodes hold
                t, c = np.nonzero(there & (self.row[level + 1][child] == (rows & (1 << below) - 1)[:, None]))
                held = child[t, c]
                found = tuple(np.concatenate(pair) for pair in zip(found, (t, (next_ranges[c] << below) + self.col[level + 1][held], self.top[level + 1][held])))
            else:
                child, worth = np.full((len(rows), len(next_ranges)), -1), np.zeros((len(rows), len(next_ranges)), dtype=np.int64)
            place = np.searchsorted(next_ranges, found[1] >> below)
            np.maximum.at(worth, (found[0], place), found[2])
            bound = weights @ worth
            kept = np.flatnonzero((bound >= best.least) & (next_ranges << below < n))
            if len(kept):
                turn += 1
                heapq.heappush(heap, (-int(bound[kept].max()), turn, level + 1, next_ranges[kept], child[:, kept], bound[kept], self._within(found, level + 1, next_ranges[kept])))

    def _within(self, found: tuple, level: int, ranges: np.ndarray) -> tuple:
        """The points met so far that lie in one of the ranges."""
        mine = found[1] >> (self.height - level)
        place = np.minimum(np.searchsorted(ranges, mine), len(ranges) - 1)
        some = ranges[place] == mine
        return tuple(x[some] for x in found)


class Best:
    """The k best of one item: by score, then doc_id, none last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def offer(self, scores: np.ndarray, docs: list) -> None:
        new = [(-int(s), d is None, d or 0, d) for s, d in zip(scores.tolist(), docs) if s >= self.least]
        if new:
            self.rows = sorted(self.rows + new)[:self.k] if len(new) < 4 * self.k else heapq.nsmallest(self.k, self.rows + new)
            if len(self.rows) == self.k:
                self.least = -self.rows[-1][0]


def _block(index: dict, docs: list, points: list) -> pa.RecordBatch:
    ids, cols, impacts = (np.concatenate(x) for x in zip(*points)) if points else (np.empty(0, dtype=np.int64),) * 3
    df = np.bincount(ids, minlength=len(index))
    by = np.argsort(-df, kind="stable")
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    names = list(index)
    height = max(len(docs) - 1, len(names) - 1, 1).bit_length()
    tree = build(rank[ids], cols, impacts, height)
    row = {"docs": docs, "terms": [names[i] for i in by.tolist()], "df": df[by].tolist(), **tree}
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([
        ("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int64())), ("height", pa.int32()),
        ("sizes", pa.list_(pa.int32())), ("links", pa.binary()), ("tops", pa.binary()), ("rows", pa.binary()), ("cols", pa.binary())]))


def _index(batches: Iterator[pa.RecordBatch], n: int, length: int, block_docs: int, block_points: int) -> Iterator[pa.RecordBatch]:
    index, docs, points, total = {}, [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1))):
            ids = [np.fromiter((index.setdefault(w, len(index)) for w in some), dtype=np.int64, count=len(some)) for some in terms(text)]
            size = sum(map(len, ids))
            if not size:
                continue
            mine, tf = np.unique(np.concatenate(ids), return_counts=True)
            norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * size * n) // length
            points.append((mine, np.full(len(mine), len(docs)), SCALE * tf // (1000 * tf + SATURATION * norm)))
            docs.append(doc)
            total += len(mine)
            if len(docs) >= block_docs or total >= block_points:
                yield _block(index, docs, points)
                index, docs, points, total = {}, [], [], 0
    if docs:
        yield _block(index, docs, points)


def build_index(docs: DataFrame, size: tuple[int, int], block_docs: int = BLOCK_DOCS, block_points: int = BLOCK_POINTS) -> DataFrame:
    """The index of ``docs`` (doc_id, text), one row per block; ``size`` is their ``corpus_size``."""
    n, length = size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(rows, lambda it: _index(it, n, length, block_docs, block_points), INDEX_SCHEMA)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts_of(batch.column(2))):
            counts: dict[bytes, int] = {}
            for some in terms(text):
                for w in some:
                    counts[w] = counts.get(w, 0) + 1
            if counts:
                yield pa.record_batch([pa.array([item] * len(counts), pa.int64()), pa.array([number] * len(counts), pa.int64()),
                                       pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "item", "term", "times"])


def _searched(batches: Iterator[pa.RecordBatch], items: list, k: int) -> Iterator[pa.RecordBatch]:
    best = [Best(k) for _ in items]
    names = pa.array(sorted({w for _, words, _ in items for w in words}), pa.binary())
    number = {w: i for i, w in enumerate(names.to_pylist())}
    wanted = [(np.array([number[w] for w in words]), np.array(weights, dtype=np.int64)) for _, words, weights in items]
    for batch in batches:
        for one in range(batch.num_rows):
            row = {name: batch.column(i)[one].as_py() for i, name in enumerate(batch.schema.names) if name not in ("terms", "df")}
            place = np.asarray(pc.fill_null(pc.index_in(names, value_set=batch.column("terms")[one].values), -1)).astype(np.int64)
            block = Block(row)
            for (words, weights), found in zip(wanted, best):
                rows = place[words]
                some = rows >= 0
                if some.any():
                    block.search(rows[some], weights[some], found)
    out = [(item, d, -s) for (item, _, _), found in zip(items, best) for s, _, _, d in found.rows]
    yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())],
                          names=["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = TOP, pass_terms: int = PASS_TERMS, **blocks) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, best first.

    Equal scores go by ascending doc_id, a null doc_id last.  Null and empty texts have no
    terms: such documents are not ranked, such items have no rows.  Rows that repeat a doc_id
    are documents of their own; rows that repeat an item_id are items of their own.  Other
    columns are ignored.

    The items are searched ``pass_terms`` terms at a time, each pass over the index, so that
    what a task holds of them is bounded; they are few beside the documents.
    """
    spark = docs.sparkSession
    size = corpus_size(docs)
    index = staged(build_index(docs, size, **blocks), "treap-index")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), "text")
    asked = staged(common.arrow_map(rows, _item_terms, "item_id bigint, item bigint, term binary, times bigint"), "item-terms")
    df = (index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
          .join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(WEIGHT_SCALE * F.log(F.lit(2.0 * size[0] + 2) / (2 * F.col("df") + 1)))
    packs = staged(asked.join(df, "term").select("item_id", "item", F.struct("term", (weight * F.col("times")).alias("weight")).alias("t"))
                   .groupBy("item").agg(F.first("item_id").alias("item_id"), F.sort_array(F.collect_list("t")).alias("terms")), "item-packs")
    found = None
    for part in _passes(packs.toLocalIterator(), pass_terms):
        one = staged(common.arrow_map(index, lambda it, part=part: _searched(it, part, k), "item bigint, doc_id bigint, score bigint"), "found")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(packs.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _passes(packs: Iterator, most: int) -> Iterator[list]:
    held, total = [], 0
    for r in packs:
        if held and total + len(r.terms) > most:
            yield held
            held, total = [], 0
        held.append((r.item, [bytes(t.term) for t in r.terms], [t.weight for t in r.terms]))
        total += len(r.terms)
    if held:
        yield held
