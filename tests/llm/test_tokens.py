"""Token sets: exact ids against whole-text encoding, bit packing, random access, edge cases."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lotwise.llm import tokens as K
from lotwise.llm.common import table
from lotwise.llm.queries import byte_bpe


def whole(texts):
    t = Tokenizer.from_file(byte_bpe())
    return [one.ids for one in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_packing_is_a_round_trip_with_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = K.pack(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    assert (K.unpack(packed, bits, 0, 1001) == ids).all() and (K.unpack(packed, bits, 37, 100) == ids[37:137]).all()
    assert not len(K.unpack(packed, bits, 5, 0))


def test_ids_beyond_the_width_are_an_error():
    for bits, one in ((16, 65_536), (3, 8), (8, 300)):
        with pytest.raises(ValueError):
            K.pack(np.array([1, one], dtype=np.uint32), bits)
    assert K.unpack(K.pack(np.array([65_535], dtype=np.uint32), 16), 16, 0, 1).tolist() == [65_535]


def test_width():
    assert [K.width(n) for n in (1, 2, 3, 256, 257, 32_000, 49_408, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 16, 16, 17]


def test_special_tokens_in_texts_are_encoded_as_by_the_library():
    library, encoder = Tokenizer.from_file(byte_bpe()), K.Encoder(byte_bpe())
    rng = random.Random(2)
    texts = ["<|endoftext|>"] + ["".join(rng.choice(["<|endoftext|>", "<|endof", " ", "ab", ".", ",", "\n", "It's"]) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    flat, sizes = encoder.ids(pa.array(texts))
    assert encoder.by_chunk and flat[0] == 50256 and sizes[0] == 1
    assert np.split(flat, np.cumsum(sizes)[:-1])[7].tolist() == library.encode(texts[7], add_special_tokens=False).ids
    assert flat.tolist() == [i for text in texts for i in library.encode(text, add_special_tokens=False).ids]


def test_chunks_encode_as_whole_texts(monkeypatch):
    monkeypatch.setattr(K, "KEPT_CHUNKS", 500)
    rng, encoder = random.Random(1), K.Encoder(byte_bpe())
    assert encoder.by_chunk
    for alphabet in (" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​ab!'s1é<|endoftext|>ll.,漢", " \nab.,'s", "ab. \n, c\x01"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
        flat, sizes = encoder.ids(pa.array(texts))
        ends = np.cumsum(sizes)
        assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends)] == whole(texts)
    assert len(encoder.kept) <= 500


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = K.Encoder(path)
    assert not encoder.by_chunk
    flat, sizes = encoder.ids(pa.array(["Hello  world", None, ""]))
    assert flat.tolist() == Tokenizer.from_file(path).encode("Hello  world", add_special_tokens=False).ids and sizes.tolist() == [len(flat), 0, 0]


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*whole([text or ""])[0], 0], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_index_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in K.token_index(docs, byte_bpe(), 50_257).collect()) == expected(rows)


def test_edge_cases_and_random_access(spark, tmp_path):
    rows = [(3, None), (1, ""), (2, "a <|endoftext|> b"), (9, "word " * 200_000), (5, "x"), (4, " \n "), (7, "é" * 50)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(3)
    path = str(tmp_path / "set")
    K.write_tokens(docs, path, byte_bpe(), 50_257, block_ids=20, shards=3)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in K.read_entries(spark, path).collect()) == expected(sorted(rows, key=lambda r: r[0]))
    for doc_id, text in rows:
        assert [one.tolist() for one in K.read_ids(spark, path, doc_id)] == [[*whole([text or ""])[0], 0]]
    assert K.read_ids(spark, path, 77) == []
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (1, "a")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in K.token_index(twice, byte_bpe(), 50_257).collect()), key=lambda r: r[1])
    assert got == [(None, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 2)]
    assert K.token_index(docs.limit(0), byte_bpe(), 50_257).count() == 0
