"""BPE codec, records and token counts against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from motefield.llm import bpe, records, transducer
from motefield.llm.vocabulary import ByteVocabulary, tokenizer_path


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def by_row(rows):
    return sorted(rows, key=repr)


def codec_rows(library, texts):
    out = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return by_row(out)


def test_codec_equals_the_library(small, byte_library):
    texts = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    got = [tuple(r) for r in bpe.encode_documents(small).collect()]
    assert by_row(got) == codec_rows(byte_library, texts)


def test_codec_on_odd_rows(odd, none, odd_texts, byte_library):
    out = bpe.encode_documents(odd, keep_ids=True).collect()
    assert by_row([tuple(r)[:4] for r in out]) == codec_rows(byte_library, odd_texts)
    assert all(byte_library.encode("one", add_special_tokens=False).ids == list(r.token_ids) for r in out if r.doc_id in (3, 4))
    assert bpe.encode_documents(none).count() == 0


def test_shared_chunks_are_encoded_once_and_repaired(spark, byte_library):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß 0'\n!") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(3000))
    texts = [(i, word() * i + passage[i * 7 :] + word()) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert bpe.shared_chunk_keys(docs).count() > 5
    assert by_row([tuple(r) for r in bpe.encode_documents(docs).collect()]) == codec_rows(byte_library, texts)


@pytest.mark.parametrize("seed", range(4))
def test_joining_any_two_texts(seed, byte_library):
    vocabulary = ByteVocabulary(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(seed)
    pool = [" ", "  ", "\n", "a", "the", "ing", "é", "'s", "'", "12", "。", "<|endo", "ftext|>", "😀", "́", "!"]
    for _ in range(400):
        parts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        ids: list[int] = []
        for part in parts:
            bpe.join_ids(vocabulary, ids, vocabulary.encode(part))
        assert ids == byte_library.encode("".join(parts), add_special_tokens=False).ids


def test_borders_depend_on_the_text_alone():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 20000).astype(np.uint8)
    alone = bpe.chunk_borders(text, np.array([0, len(text)]))[0]
    after = bpe.chunk_borders(np.concatenate([text[:777], text]), np.array([0, 777, 777 + len(text)]))[1]
    assert [b - 777 for b in after] == alone
    assert bpe.chunk_borders(text[:0], np.array([0, 0])) == [[]]


def test_white_space_too_long_for_the_fast_encoder(byte_library):
    vocabulary = ByteVocabulary(tokenizer_path("byte_bpe_50k.json"))
    text = " " * 400_000
    assert vocabulary.encode(text) == byte_library.encode(text, add_special_tokens=False).ids


def record_rows(library, texts):
    out, start = [], 0
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_records_round_trip(spark, small, byte_library, tmp_path):
    index = records.write_records(small, str(tmp_path / "r"))
    got = records.with_starts(records.record_digests(index)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    texts = sorted((r.doc_id, r.text) for r in small.select("doc_id", "text").collect())
    assert [tuple(r) for r in got] == record_rows(byte_library, texts)
    some = records.read_records(index.orderBy("length").limit(20)).collect()
    wanted = dict(texts)
    assert len(some) == 20
    assert all(list(r.token_ids) == byte_library.encode(wanted[r.doc_id], add_special_tokens=False).ids + [0] for r in some)


def test_records_of_odd_rows(odd, none, tmp_path):
    index = records.write_records(odd, str(tmp_path / "odd"))
    rows = records.with_starts(records.record_digests(index)).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:]) and len(ids) == 14
    assert records.write_records(none, str(tmp_path / "none")).count() == 0


def test_a_damaged_record_is_an_error():
    record = records.frame(records.pack(5, np.array([1, 2, 70000], np.uint32)))
    doc_id, ids = records.unpack(records.unframe(record))
    assert doc_id == 5 and ids.tolist() == [1, 2, 70000]
    for place in range(len(record)):
        broken = bytearray(record)
        broken[place] ^= 1
        with pytest.raises(records.RecordError):
            records.unframe(bytes(broken))


def test_token_counts_equal_the_library(small, odd, none, odd_texts, word_library):
    for docs, texts in ((small, [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]), (odd, odd_texts)):
        want = []
        for doc_id, text in texts:
            n = len(word_library.encode(text or "", add_special_tokens=False).ids)
            want.append((doc_id, len((text or "").encode()), n, n > 2048))
        assert by_row(tuple(r) for r in transducer.token_counts(docs).collect()) == by_row(want)
    assert transducer.token_counts(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_transducer_on_random_texts(seed, word_library):
    rng = random.Random(seed)
    pool = [" ", "\n", "\xa0", "a", "B", "é", "é", "ß", "1", "½", "。", "!", "'", "'s", "'ll", "'re", "'v", "<|endoftext|>", "<|endo", "😀", "Σ", "İ", "the", "ing", "s", "t"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 15))) for _ in range(1500)] + ["ab" * 700]
    path = tokenizer_path("word_bpe_49k.json")
    assert transducer.count_tokens(texts, path) == [len(e.ids) for e in word_library.encode_batch(texts, add_special_tokens=False)]
