"""Token-ID output: fixed-width bit packing in blocks, with random access and vectorised unpacking.

File format.  A token set is a Parquet table with one file per shard and one row per block.
A block holds whole documents: the next documents of the shard until ``block_ids`` ids are
reached (a longer document has a block of its own, so a document never straddles blocks).

======== ============ =====================================================================
shard    int          shards hold ascending, disjoint ranges of doc_id
block    int          position of the block in its shard
start    long         ids of the shard before this block
n_ids    long         ids in this block
bits     int          width of an id: the bits of the largest id of the vocabulary
first_doc, last_doc   smallest and largest doc_id, by which look-ups skip row groups
doc_ids  array<long>  its documents, ascending
offsets  array<long>  ids of this block before each document: the random-access index
payload  binary       ids, least significant bit first, each in ``bits`` bits
======== ============ =====================================================================

Any id range of a block is unpacked by numpy without touching the rest: id i lies in bits
``i * bits`` to ``(i + 1) * bits - 1`` of the payload.
"""
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm import common
from lotwise.session import scratch

BLOCKS = "shard int, block int, start long, n_ids long, bits int, first_doc long, last_doc long, doc_ids array<long>, offsets array<long>, payload binary"
BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                         ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
ENTRIES = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"
ENTRY_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

# Places where byte-level tokenizers always end a piece: after a character that is no white space
# and before a space or newline, and between a-z and a full stop or comma.  Texts are cut there, and
# what lies between is encoded once per batch; it has the same ids alone as inside the text.
CUT = "\x01"
SOLID = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JOINABLE = f"^[ \n]{SOLID}+$"
KEPT_CHUNKS = 300_000
LONG_CHUNK = 64


def width(n_vocabulary: int) -> int:
    """Minimum bits that hold every id from 0 to n_vocabulary - 1."""
    return max(1, (int(n_vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first; an id that does not fit is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a payload, reading only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=count, offset=start * bits // 8).astype(np.uint32)
    low, high = start * bits, (start + count) * bits
    raw = np.frombuffer(payload, dtype=np.uint8, count=(high + 7) // 8 - low // 8, offset=low // 8)
    flat = np.unpackbits(raw, bitorder="little")[low % 8: low % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class Encoder:
    """Encodes text columns with a tokenizer file.

    With a byte-level tokenizer, texts are cut into chunks, and each distinct chunk is
    encoded once; the first short ones, up to a bound, are kept for later batches.  Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        form = json.loads(self.tokenizer.to_str())
        kind = form["pre_tokenizer"] or {}
        self.by_chunk = kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not form["normalizer"]
        # special tokens in a text keep their own ids, so no cut may fall into one or beside the space it takes
        self.by_chunk = self.by_chunk and not any(one["lstrip"] or one["rstrip"] or re.search(r"[\s.,]", one["content"]) for one in form["added_tokens"])
        self.n_bytes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        for piece, one in self.tokenizer.get_vocab().items():
            self.n_bytes[one] = len(piece)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(one.ids, dtype="<u4").tobytes() for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, chunks: list[str]) -> list[bytes]:
        """Chunks that begin with one space or newline and go on without white space, encoded in a row."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(chunk.encode()) for chunk in chunks])) + 1
        raw = ids.tobytes()
        return [raw[4 * a: 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_chunk or pc.any(pc.match_substring(texts, CUT)).as_py():
            parts = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(parts), dtype="<u4"), np.array([len(part) // 4 for part in parts], dtype=np.int64)
        cut = pc.replace_substring_regex(texts, r"([a-z])([.,])", rf"\1{CUT}\2")
        cut = pc.split_pattern(pc.replace_substring_regex(cut, f"({SOLID})([ \n])", rf"\1{CUT}\2"), CUT)
        coded = cut.flatten().dictionary_encode()
        names, kept = coded.dictionary.to_pylist(), self.kept
        parts = [kept.get(name) for name in names]
        missing = [i for i, part in enumerate(parts) if part is None]
        if missing:
            fits = pc.match_substring_regex(coded.dictionary, JOINABLE).to_pylist()
            room = KEPT_CHUNKS - len(kept)
            for rows, encode in (([i for i in missing if fits[i]], self.joined), ([i for i in missing if not fits[i]], self.whole)):
                for at in range(0, len(rows), 2_000):
                    some = rows[at: at + 2_000]
                    for i, part in zip(some, encode([names[i] for i in some])):
                        parts[i] = part
                        if room > 0 and len(names[i]) <= LONG_CHUNK:
                            kept[names[i]] = part
                            room -= 1
        sizes = np.array([len(part) // 4 for part in parts], dtype=np.int64)
        flat, at = np.frombuffer(b"".join(parts), dtype="<u4"), coded.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        spots = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - each), each) + np.arange(int(each.sum()))
        edges = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return flat[spots], np.diff(edges)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: later tasks use what earlier ones kept."""
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, bits: int, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer).ids
    shard, block, before, held, ids, docs = 0, 0, 0, 0, [], []

    def close() -> pa.RecordBatch:
        nonlocal block, before, held, ids, docs
        lengths = np.array([len(one) for one in ids], dtype=np.int64)
        flat = np.concatenate(ids)
        known = [doc for doc in docs if doc is not None]
        out = pa.record_batch([[shard], [block], [before], [len(flat)], [bits], [min(known, default=None)], [max(known, default=None)], [docs], [(np.cumsum(lengths) - lengths).tolist()], [pack(flat, bits)]],
                              schema=BLOCK_ARROW)
        block, before, held, ids, docs = block + 1, before + len(flat), 0, [], []
        return out

    for whole in batches:
        for batch in common.slices(whole, 1, 4 << 20):
            flat, sizes = encode(batch.column(1))
            ends = np.cumsum(sizes)
            flat = np.insert(flat, ends, end_id)  # the end id after each document
            edges = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            for doc_id, shard, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
                ids.append(flat[a:b])
                docs.append(doc_id)
                held += b - a
                if held >= block_ids:
                    yield close()
    if docs:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, n_vocabulary: int | None = None, end_id: int = 0, block_ids: int = 65_536,
                 shards: int | None = None) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the token set in ascending doc_id order.

    A null text is an empty one and has the end id alone; rows that repeat a doc_id are
    kept, ordered by a hash of their text; null doc_ids come first.  Other columns are
    ignored.  An empty table gives a token set without blocks.  The width is that of the
    tokenizer's vocabulary and the end id, unless ``n_vocabulary`` says otherwise.
    """
    spark = docs.sparkSession
    bits = width(n_vocabulary or max(len(encoder(tokenizer).n_bytes), end_id + 1))
    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("tie"))
              .repartitionByRange(shards or common.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
              .select("doc_id", "text", F.spark_partition_id().alias("shard")))
    common.arrow_map(ranged, lambda it: _encode(it, tokenizer, bits, end_id, block_ids), BLOCKS).write.parquet(path)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start, n_ids, bits, doc_ids, offsets, payload in zip(*(column.to_pylist() for column in batch.columns)):
            ids = unpack(payload, bits, 0, n_ids).astype("<u4")
            edges = np.array([*offsets, n_ids], dtype=np.int64)
            raw = memoryview(ids).cast("B")
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(np.full(len(doc_ids), shard, dtype=np.int32)), pa.array(start + edges[:-1]),
                                   pa.array(np.diff(edges)), pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(edges, edges[1:])], pa.int64())],
                                  schema=ENTRY_ARROW)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token set: doc_id, shard, start (ids of all documents before it), n_tokens, ids_crc32.

    The starts of the shards are sums over one row per shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    bases = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
             .select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base")))
    found = common.arrow_map(blocks.select("shard", "start", "n_ids", "bits", "doc_ids", "offsets", "payload"), _entries, ENTRIES)
    return (found.join(bases, "shard")
            .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "shard"))


def read_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document, by the doc_id ranges of the blocks; one array per row with this doc_id."""
    rows = (spark.read.schema(BLOCKS).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).where(F.array_contains("doc_ids", F.lit(doc_id)))
            .select("n_ids", "bits", "doc_ids", "offsets", "payload").collect())
    found = []
    for row in rows:
        edges = [*row.offsets, row.n_ids]
        found += [unpack(bytes(row.payload), row.bits, edges[i], edges[i + 1] - edges[i]) for i, one in enumerate(row.doc_ids) if one == doc_id]
    return found


def token_index(docs: DataFrame, tokenizer: str, n_vocabulary: int | None = None, end_id: int = 0) -> DataFrame:
    """Writes the token set of ``docs`` to shared storage and returns what the files hold per document."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, n_vocabulary, end_id)
    return read_entries(docs.sparkSession, path)
