"""Jaccard self-join of the word n-gram sets of documents, exact, with the components of its links.

A text's set holds 64-bit hashes of its shingles, sorted.  Rows of one set are one node.  All
sets order their shingles alike, rarest first by counts over the whole corpus in 2^16 buckets;
two linked sets share a shingle among the first few of each (the prefix: as many as may be
missing, and one).  So nodes that share a prefix shingle and have sizes in the same or in
neighbouring bands form a tile, and no link lies outside all tiles.  Bands grow by the
similarity, so a set of one band can be linked into the next one at most.

Within a tile pairs are compared by bitmaps of their sets: a bit is the parity of the
shingles that are hashed to it, so two bitmaps differ in no more bits than the sets differ in
shingles, and the overlap is bounded from above.  Larger sets have longer bitmaps, which are
folded to the shorter length of a pair.  Pairs within the bound are settled by
intersecting the sorted arrays.  Pairs that are connected already are passed over, and a task
returns a spanning forest of its links.

Families of near copies share most of their shingles, and meet in very many tiles.  They are
connected first: each node is compared with one node of each of its prefix shingles, the one
that shares most shingles with others, which mostly is what the others were copied from.  Only
shingles whose nodes are of several components after that make tiles.  Tiles go to tasks with
the bitmaps alone, and tell which components have pairs within the bound; each group of such
components then is one tile, so that its sets are sent once and not with every shared shingle.
Large tiles are cut into chunks, and go to tasks in pairs of chunks.
"""
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common
from lotwise.llm.components import components
from lotwise.session import staged

SHINGLE, PERCENT = 4, 85
#: Least bits of a bitmap (more for a larger set), bits of the buckets of shingle counts, shingles of a chunk (8 bytes each).
BITS, COUNT_BITS, CHUNK = 1024, 16, 1 << 20
#: Nodes of a tile up to which all pairs of bitmaps are compared at once; pairs of such tiles that are compared together.
DENSE, PAIRS = 64, 1 << 16
#: Rows of shared shingles or of wanted nodes (8 to 24 bytes each) up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Words hashed at once, and bytes of a text split at once.
WORDS, PIECE = 1 << 19, 1 << 22

_SPACE = re.compile(rb"[\x09-\x0D\x20]")
# odd multipliers that combine the hashes of a shingle's words
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def bands(percent: int = PERCENT) -> np.ndarray:
    """The smallest set size of each band: a set of a band has at most the sizes of the next band as partners."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(first[-1] * 100 // percent + 1)
    return np.array(first, dtype=np.int64)


def _hashed(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; each distinct one is hashed once."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    values = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return values[np.asarray(coded.indices)] if len(words) else np.empty(0, dtype=np.uint64)


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Hashes of the lower-cased words of each text, in order."""
    flat, held, counts = [], [], []
    for text in texts:
        text, at, n = (text or b"").lower(), 0, 0
        while at < len(text):
            cut = _SPACE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            some = text[at:end].split()
            held += some
            n, at = n + len(some), end
            if len(held) >= WORDS:
                flat.append(_hashed(held))
                held = []
        counts.append(n)
    flat.append(_hashed(held))
    return np.split(np.concatenate(flat), np.cumsum(counts)[:-1])


def shingle_set(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of all words if they are fewer; none without words."""
    if not len(words):
        return words
    size = min(width, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ words[i:i + n]) * _TURNS[i % len(_TURNS)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The parity of the shingles in each bit, as 64-bit words: at least half as many bits as shingles, a power of two."""
    bits = BITS
    while 2 * bits < len(shingles):
        bits *= 2
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Bitmaps:
    """Bitmaps in a row, ``lengths`` in words, and their folds to every shorter length that occurs."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.lengths, starts, self.folds = lengths, np.cumsum(lengths) - lengths, {}
        for short in np.unique(lengths).tolist():
            place, rows = np.full(len(lengths), -1), np.empty((int((lengths >= short).sum()), short), dtype=np.uint64)
            place[lengths >= short] = np.arange(len(rows))
            for long in np.unique(lengths[lengths >= short]).tolist():
                some = np.flatnonzero(lengths == long)
                rows[place[some]] = np.bitwise_xor.reduce(flat[starts[some][:, None] + np.arange(long)].reshape(len(some), long // short, short), axis=1)
            self.folds[short] = (place, rows)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of pairs of bitmaps."""
        out, short = np.empty(len(i), dtype=np.int64), np.minimum(self.lengths[i], self.lengths[j])
        for length, (place, rows) in self.folds.items():
            some = short == length
            out[some] = np.bitwise_count(rows[place[i[some]]] ^ rows[place[j[some]]]).sum(axis=1, dtype=np.int64)
        return out

    def centre_first(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes by how near they are to the bits that most of them have: the first ones connect the most."""
        place, rows = self.folds[int(self.lengths[nodes].min())]
        each = np.unpackbits(rows[place[nodes]].view(np.uint8), axis=1)
        return nodes[np.argsort((each != (2 * each.sum(axis=0, dtype=np.int64) > len(nodes))).sum(axis=1), kind="stable")]


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of a sorted set of which a linked set shares one: the rarest by ``counts``, then the smallest."""
    n = len(shingles)
    common_order = np.argsort(counts[(shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")
    return shingles[common_order[: n - -(-n * percent // 100) + 1]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def bounded(n: np.ndarray, other, differ: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes n and ``other`` can be linked, if their bitmaps differ in ``differ`` bits."""
    most = np.minimum((n + other - differ) // 2, np.minimum(n, other))
    return 100 * most >= percent * (n + other - most)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, tie, key (a hash of the set), n, band, bits; and last one row with n = -1 and the shingle counts of all rows as bits."""
    first, counts = bands(), np.zeros(1 << COUNT_BITS, dtype=np.int64)

    def out(doc_ids, ties, keys, n, lists) -> pa.RecordBatch:
        return pa.record_batch([doc_ids, ties, keys, pa.array(n), pa.array(np.searchsorted(first, n, side="right") - 1, pa.int32()),
                                common.list_array(np.concatenate(lists), np.array([len(x) for x in lists]), pa.int64())],
                               names=["doc_id", "tie", "key", "n", "band", "bits"])
    for whole in batches:
        for batch in common.slices(whole, 2):
            sets = [shingle_set(w, width) for w in word_hashes(list(common.texts_of(batch.column(2))))]
            for s in sets:
                np.add.at(counts, (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
            keys = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], pa.uint64()).view(pa.int64())
            yield out(batch.column(0), batch.column(1), keys, np.array([len(s) for s in sets], dtype=np.int64), [bitmap(s).view(np.int64) for s in sets])
    yield out(pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), np.array([-1]), [counts])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, 0):
            sets = [shingle_set(w, width) for w in word_hashes(list(common.texts_of(batch.column(0))))]
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            firsts = [prefix(s, counts, percent) for s in sets]
            sizes = [len(x) for x in firsts]
            keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(keys, sizes)), pa.array(np.repeat([len(s) for s in sets], sizes))],
                                  names=["token", "key", "n"])


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, 1):
            sets = [shingle_set(w, width).tobytes() for w in word_hashes(list(common.texts_of(batch.column(1))))]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["key", "shingles"])


def verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows a, b and their two sets, a and b of those that are alike."""
    for batch in batches:
        some = [alike(np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3))]
        yield batch.select([0, 1]).filter(pa.array(some, pa.bool_()))


class Tiles:
    """Whole tiles in a row: ``tile`` names the tile of each node.

    ``upper``: nodes of the band above, which meet those of the tile's own band only.  Where a
    tile's nodes are of two chunks, only pairs across them are compared.
    """

    def __init__(self, tile: np.ndarray, n: np.ndarray, upper: np.ndarray, chunk: np.ndarray, root: np.ndarray, bits: Bitmaps, percent: int = PERCENT):
        self.n, self.upper, self.root, self.bits, self.percent = n, upper, root, bits, percent
        self.starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        self.ends = np.append(self.starts[1:], len(tile))
        across = np.repeat(np.minimum.reduceat(chunk, self.starts) != np.maximum.reduceat(chunk, self.starts), self.ends - self.starts)
        self.chunk = np.where(across, chunk, -1 - np.arange(len(chunk)))  # no two are equal where all pairs count

    def pairs(self, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Which pairs are of different labels and may be linked."""
        some = np.flatnonzero((label[i] != label[j]) & ~(self.upper[i] & self.upper[j]) & (self.chunk[i] != self.chunk[j]))
        near = bounded(self.n[i[some]], self.n[j[some]], self.bits.differ(i[some], j[some]), self.percent)
        return some[near]

    def groups(self) -> np.ndarray:
        """Per node the label of its component, after the components of each tile whose nodes may be linked are joined."""
        label, size = self.root.copy(), self.ends - self.starts
        small = np.flatnonzero(size <= DENSE)
        # all pairs of many small tiles together
        ends = np.cumsum(size[small] ** 2)
        at = 0
        while at < len(small):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            m, first = size[small[at:stop]], self.starts[small[at:stop]]
            turn = np.arange(int((m * m).sum())) - np.repeat(np.cumsum(m * m) - m * m, m * m)
            wide, base = np.repeat(m, m * m), np.repeat(first, m * m)
            i, j = base + turn // wide, base + turn % wide
            i, j = i[turn // wide < turn % wide], j[turn // wide < turn % wide]
            for k in self.pairs(i, j, self.root).tolist():
                x, y = label[i[k]], label[j[k]]
                if x != y:
                    t = int(np.searchsorted(self.starts, i[k], side="right")) - 1
                    mine = label[self.starts[t]:self.ends[t]]
                    mine[mine == y] = x
            at = stop
        for t in np.flatnonzero(size > DENSE).tolist():
            for x, partners in self._leaders(t, label):
                mine = label[self.starts[t]:self.ends[t]]
                mine[np.isin(mine, np.unique(label[partners]))] = label[x]
        return label

    def _leaders(self, t: int, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each node of a tile with the later ones of other labels that it may be linked to."""
        nodes, a, b = np.arange(self.starts[t], self.ends[t]), self.starts[t], self.ends[t]
        left = np.ones(len(nodes), dtype=bool)
        for x in self.bits.centre_first(nodes).tolist():
            left[x - a] = False
            others = nodes[left & (label[a:b] != label[x])]
            if len(others):
                yield x, others[self.pairs(np.full(len(others), x), others, label)]
            elif label[a:b].min() == label[a:b].max():
                return

    def links(self, sets: list) -> list[tuple[int, int]]:
        """Links that connect nodes of different components, a spanning forest of them in each tile."""
        found = []
        for t in range(len(self.starts)):
            label, a, b = self.root.copy(), self.starts[t], self.ends[t]
            for x, partners in self._leaders(t, label):
                for y in partners.tolist():
                    if label[y] != label[x] and alike(sets[x], sets[y], self.percent):
                        found.append((x, y))
                        mine = label[a:b]
                        mine[mine == label[y]] = label[x]
        return found


#: Rows of small tiles that a task takes up before it works on them.
TILE_ROWS = 20_000


def _tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows tile, part, key, n, upper, chunk, root, bits and maybe shingles, sorted by (tile, part), are gathered in whole tiles.

    Gives key, root, head of nodes in groups of several components, with one component of the
    group; with shingles, links a, b.
    """
    held, size, most = [], 0, 1

    def starts(table: pa.Table) -> np.ndarray:
        tile, part = table.column(0).to_numpy(), table.column(1).to_numpy()
        return np.flatnonzero((tile[1:] != tile[:-1]) | (part[1:] != part[:-1])) + 1

    def work(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        number = np.zeros(table.num_rows, dtype=np.int64)
        number[starts(table)] = 1
        keys, n, upper, chunk, root = (table.column(i).to_numpy() for i in range(2, 7))
        bits = table.column(7).chunk(0)
        maps = Bitmaps(np.asarray(bits.flatten()).view(np.uint64), np.diff(np.asarray(bits.offsets)))
        tiles = Tiles(np.cumsum(number), n.astype(np.int64), upper.astype(bool), chunk.astype(np.int64), root.astype(np.int64), maps, percent)
        if table.num_columns == 8:
            group = tiles.groups()
            # nodes whose group has taken in another component of their tile
            order = np.lexsort((group, np.cumsum(number)))
            new = np.concatenate([[True], (np.diff(np.cumsum(number)[order]) != 0) | (np.diff(group[order]) != 0)])
            run = np.cumsum(new) - 1
            several = np.maximum.reduceat(group[order] != tiles.root[order], np.flatnonzero(new))
            some = order[several[run]]
            return [pa.record_batch([pa.array(keys[some]), pa.array(root[some]), pa.array(group[some])], names=["key", "root", "head"])] if len(some) else []
        links = tiles.links([np.frombuffer(s.as_py(), dtype=np.uint64) for s in table.column(8)])
        return [pa.record_batch([pa.array(keys[[a for a, _ in links]]), pa.array(keys[[b for _, b in links]])], names=["a", "b"])] if links else []

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if batch.num_columns == 8 and size < max(most, TILE_ROWS) or size < most:
            continue
        table = pa.Table.from_batches(held)
        cuts = starts(table)
        if len(cuts):
            yield from work(table.slice(0, int(cuts[-1])))
        rest = table.slice(int(cuts[-1])) if len(cuts) else table
        held, size = rest.to_batches(), rest.num_rows
        most = 2 * size
    if held:
        yield from work(pa.Table.from_batches(held))


def _fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null, empty and blank texts have no set and are linked with nothing: their component is
    their own doc_id.  Rows that repeat a doc_id are judged each by its own text; a null
    doc_id names a component only where it has no other.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    sets = staged(common.arrow_map(rows, lambda it: _sets(it, width), "doc_id long, tie long, key long, n long, band int, bits array<long>"), "shingle-sets")
    full = sets.where("n > 0")
    # one row stands for each set; its text is read again where the set itself is wanted
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("rep")
    nodes = staged(full.groupBy("key").agg(F.first("n").alias("n"), F.first("band").alias("band"), F.first("bits").alias("bits"), rep, F.min("doc_id").alias("low")), "set-nodes")

    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for r in sets.where("n = -1").select(F.posexplode("bits").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    prefixes = staged(common.arrow_map(docs.select("text"), lambda it: _prefixes(it, counts, width, percent), "token long, key long, n long"), "prefixes")
    shared = _sized(staged(prefixes.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("token"), "shared-tokens"))
    live = staged(prefixes.join(shared, "token").groupBy("token", "key").agg(F.max("n").alias("n")), "shared-prefixes")

    # each node with the best connected node of each of its shingles
    size = live.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    reach = live.join(size, "token").groupBy("key").agg(F.sum("c").alias("reach"))
    heads = live.join(reach, "key").groupBy("token").agg(F.max(F.struct("reach", "key", "n")).alias("h")).select("token", F.col("h.key").alias("head"), F.col("h.n").alias("m"))
    pairs = (live.join(heads, "token").where((F.col("key") != F.col("head")) & _fits(F.col("n"), F.col("m"), percent))
             .groupBy(F.col("key").alias("a"), F.col("head").alias("b")).agg(F.max("n").alias("n"), F.max("m").alias("m")))
    bits = nodes.select("key", "bits")
    # bitmaps of two lengths are left to the sets
    differ = F.when(F.size("x") == F.size("y"), F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)).otherwise(0)
    most = F.floor((F.col("n") + F.col("m") - differ) / 2)
    close = staged(pairs.join(bits.select(F.col("key").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("key").alias("b"), F.col("bits").alias("y")), "b")
                   .where(100 * most >= percent * (F.col("n") + F.col("m") - most)).select("a", "b"), "close-pairs")
    near = _arrays(docs, nodes, width, close.select(F.col("a").alias("key")).unionByName(close.select(F.col("b").alias("key"))))
    checked = close.join(near.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(near.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    links = staged(common.arrow_map(checked.select("a", "b", "x", "y"), lambda it: verified(it, percent), "a long, b long"), "star-links")
    stars = components(links)

    # tiles of shingles whose nodes are not connected yet
    rooted = live.join(stars, live["key"] == stars["node"], "left").select("token", "key", "n", F.coalesce("root", "key").alias("root"))
    apart = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    placed = (rooted.join(apart, "token").join(nodes.select("key", "band"), "key")
              .select("token", "key", "n", "root", "band", F.explode(F.array(F.lit(0), F.lit(1))).alias("upper"))
              .withColumn("tile", F.xxhash64("token", F.col("band") - F.col("upper"))))
    more = tile_links(placed.select("tile", "key", "n", "upper", "root"), nodes.select("key", "n", "bits"), lambda keys: _arrays(docs, nodes, width, keys), percent, chunk)

    roots = components(links.unionByName(more))
    named = nodes.join(roots, nodes["key"] == roots["node"], "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("key", "component_id")
    return (full.select("doc_id", "key", F.col("n").alias("n_shingles")).join(named, "key").select("doc_id", "n_shingles", "component_id")
            .unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def tile_links(rows: DataFrame, nodes: DataFrame, arrays: Callable[[DataFrame], DataFrame], percent: int, chunk: int = CHUNK) -> DataFrame:
    """a, b: links inside tiles between nodes of different components, as many as connect what is linked.

    ``rows``: tile, key, n, upper, root; ``nodes``: key, n, bits; ``arrays`` gives key and shingles of some keys.
    """
    dealt = _dealt(staged(rows, "tile-rows"), chunk)
    # pairs within the bound join components to groups; all nodes of a group that had partners make one tile
    hopeful = staged(common.arrow_map(_by_tile(dealt.join(nodes.select("key", "bits"), "key")), lambda it: _tiles(it, percent), "key long, root long, head long").distinct(), "tile-groups")
    groups = components(hopeful.where("root <> head").select(F.col("root").alias("a"), F.col("head").alias("b")).distinct())
    # the smallest component of a group names it and is no node of ``groups``
    members = (hopeful.select("key", "root").distinct().join(groups.select("node", F.col("root").alias("tile")), F.col("root") == F.col("node"), "left")
               .select("key", F.coalesce("tile", "root").alias("tile"), "root")
               .join(nodes.select("key", "n"), "key").select("tile", "key", "n", F.lit(0).alias("upper"), "root"))
    members = _dealt(staged(members, "group-rows"), chunk)
    whole = _by_tile(members.join(arrays(members.select("key")), "key").join(nodes.select("key", "bits"), "key"), "shingles")
    return staged(common.arrow_map(whole, lambda it: _tiles(it, percent), "a long, b long"), "tile-links")


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows tile, key, n, upper, root of tiles with links to find, with chunk and part: a large tile has a part for each pair of its chunks."""
    tiles = (rows.groupBy("tile").agg(F.min("upper").alias("own"), F.min("root").alias("x"), F.max("root").alias("y"), F.sum("n").alias("total"))
             .where("own = 0 AND x <> y").select("tile", F.ceil(F.col("total") / chunk).cast("int").alias("k")))
    mine = F.pmod(F.xxhash64("key"), F.col("k")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(mine, j) * F.col("k") + F.greatest(mine, j))
    found = rows.join(tiles, "tile").withColumn("chunk", mine).withColumn("part", F.explode(F.array_distinct(parts)))
    return staged(found.select("tile", "part", "key", "n", "upper", "chunk", "root"), "tile-parts")


def _by_tile(rows: DataFrame, *more: str) -> DataFrame:
    return (rows.repartition(common.partitions(rows.sparkSession), "tile", "part").sortWithinPartitions("tile", "part")
            .select("tile", "part", "key", "n", "upper", "chunk", "root", "bits", *more))


def _sized(small: DataFrame) -> DataFrame:
    """A table of few columns of numbers, to be broadcast while it has at most ``MOST_BROADCAST`` rows; more are left to a shuffle."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def _arrays(docs: DataFrame, nodes: DataFrame, width: int, keys: DataFrame) -> DataFrame:
    """key, shingles of some nodes, from the text of the one row that stands for each."""
    wanted = nodes.join(keys.distinct(), "key", "left_semi").select(F.col("key").alias("key"), F.col("rep.doc_id").alias("__doc"), F.col("rep.tie").alias("__tie"))
    wanted = _sized(staged(wanted, "wanted-sets"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"), "text")
    found = rows.join(wanted, (F.col("tie") == F.col("__tie")) & F.col("id").eqNullSafe(F.col("__doc"))).select("key", "text")
    # rows that repeat doc_id and text stand for one
    return staged(common.arrow_map(found, lambda it: _shingles(it, width), "key long, shingles binary").dropDuplicates(["key"]), "node-sets")
