"""Token files and BPE against the tokenizers library."""

import hashlib
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from matchbook.llm import bpe
from matchbook.llm.bpe import ByteBpe, Chunks, _byte_characters, byte_bpe, decode_documents, encode_documents, round_trip
from matchbook.llm.queries import VOCABULARY
from matchbook.llm.token_files import (
    TokenReader,
    TokenWriter,
    library_chunks,
    read_tokens,
    token_folder,
    write_tokens,
)
from matchbook.llm.texts import Memo, parts

from .conftest import pairs, same_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def reference(library, text):
    return library.encode(text, add_special_tokens=False).ids


def strings():
    rng = random.Random(3)
    letters = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "你", "🙂", "'s", "1", "23", "!", "##", "\x1c", "\x85", " ", "<|endoftext|>", "<|", "Z", "\x00"]
    for n in range(400):
        yield "".join(rng.choice(letters) for _ in range(n % 60))
    yield from ("", " ", "\n", " a", "a ", " a b  c \n d", "x" * 3000, "ab" * 1500, "\n\n a\n b \n")


def test_backtracking_gives_the_merges(library):
    bpe = ByteBpe(VOCABULARY)
    for text in strings():
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference(library, text), repr(text)


def test_pairs_that_fit_are_those_the_merges_leave(library):
    bpe, rng = ByteBpe(VOCABULARY), random.Random(6)
    for trial in range(4000):
        # Half of the pairs stand side by side in a word that was cut elsewhere.
        left, right = rng.randrange(50_256), rng.randrange(50_256)
        if trial % 2:
            ids = library.encode("".join(rng.choice("aaeinrst") for _ in range(12))).ids
            left, right = ids[0], ids[-1]
        both = bpe.blob[bpe.offsets[left] : bpe.offsets[left + 1]].tobytes().decode("latin-1")
        both += bpe.blob[bpe.offsets[right] : bpe.offsets[right + 1]].tobytes().decode("latin-1")
        parts = [i for c in both for i in [library.token_to_id(_byte_characters()[ord(c)])]]
        while True:
            ranked = [(m, i) for i in range(len(parts) - 1) if (m := bpe._merged.get((parts[i], parts[i + 1])))]
            if not ranked:
                break
            merged, at = min(ranked)
            parts[at : at + 2] = [merged]
        assert bpe._compatible(left, right) == (parts == [left, right])


@pytest.mark.parametrize("most", [300_000, 20])
def test_pieces_encode_as_the_whole(library, most):
    bpe = byte_bpe(VOCABULARY)
    for chunks in (Chunks(bpe.encode, most=most), library_chunks(VOCABULARY, most=most)):
        texts = list(strings())
        for text, ids in zip(texts, chunks.all_ids(texts, 500), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference(library, text), repr(text)
            assert np.frombuffer(chunks.ids(text), "<u4").tolist() == reference(library, text), repr(text)


def test_decoding_is_the_librarys(library):
    bpe = byte_bpe(VOCABULARY)
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        ids = rng.integers(0, 50257, n)  # also ids whose bytes are no UTF-8
        assert bpe.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_round_trip_of_tables(hard, small, library):
    for docs in (hard, small):
        expected = []
        for doc_id, text in pairs(docs):
            ids = reference(library, text)
            decoded = library.decode(ids, skip_special_tokens=False)
            expected.append(
                (
                    doc_id,
                    len(ids),
                    hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )
            )
        same_rows(round_trip(docs, VOCABULARY), expected, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_encode_then_decode(hard):
    encoded = encode_documents(hard, VOCABULARY)
    same_rows(decode_documents(encoded, VOCABULARY), pairs(hard), ["doc_id", "text"])


def test_token_files_hold_every_document(spark, hard, small, library):
    for docs in (hard, small):
        files = write_tokens(docs, token_folder(spark), VOCABULARY, frame_ids=500)
        rows = read_tokens(spark, files).collect()
        ids = {}
        for doc_id, text in pairs(docs):
            ids.setdefault(doc_id, []).append(reference(library, text) + [2])
        order = sorted(rows, key=lambda r: r["start"])
        known = [r["doc_id"] for r in order]
        assert known == sorted(known, key=lambda x: (x is not None, x))
        before = 0
        for row in order:
            assert row["start"] == before
            before += row["n_tokens"]
            crcs = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[row["doc_id"]]]
            assert row["ids_crc32"] in crcs
        assert before == sum(len(x) for each in ids.values() for x in each)
        assert len(rows) == docs.count()


def test_reader_opens_only_the_frames_asked_for():
    sink = pa.BufferOutputStream()
    writer = TokenWriter(sink, width=2, frame_ids=100)
    texts = [np.arange(i * 7 % 90) for i in range(200)]
    for i, ids in enumerate(texts):
        writer.add(i if i else None, ids)
    writer.close()
    data = sink.getvalue().to_pybytes()
    reader = TokenReader(pa.BufferReader(data))
    doc_id, ids = reader.document(150)
    assert doc_id == 150 and ids.tolist() == texts[150].tolist() and reader.frames_read == 1
    assert reader.document(0)[0] is None
    # Any zstandard reader skips the tables.
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == np.concatenate(texts).tolist()
    broken = bytearray(data)
    broken[len(data) // 3] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader = TokenReader(pa.BufferReader(bytes(broken)))
        for i in range(len(reader)):
            reader.document(i)


def test_empty_tables(spark, nothing):
    assert round_trip(nothing, VOCABULARY).count() == 0
    files = write_tokens(nothing, token_folder(spark), VOCABULARY)
    assert files == [] and read_tokens(spark, files).count() == 0


def test_pieces_set_aside_are_taken_back(library):
    asked = []

    def work(piece):
        asked.append(piece)
        return piece.upper()

    memo = Memo(work, 4)
    for batch in ({"a", "b", "c"}, {"d", "e"}, {"a", "b", "f", "g"}):
        new = memo.lacks(set(batch))
        memo.put_all({k: work(k) for k in new})
        assert [memo[k] for k in batch] == [k.upper() for k in batch]
    assert sorted(asked) == list("abcdefg")


def test_the_library_is_asked_for_many_new_pieces_at_once(library, monkeypatch):
    calls = []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            calls.append(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(Tokenizer, "from_file", lambda path: Counted())
    chunks = library_chunks.__wrapped__(VOCABULARY)
    texts = [f"x{i} wörd{i} {i * i}, <|endoftext|>{i}" for i in range(500)]
    for text, ids in zip(texts, chunks.all_ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference(library, text), text
    assert len(calls) < 10


def test_words_with_marks_behind_them_are_learnt_once(library):
    asked = []

    def encode_many(pieces):
        asked.extend(pieces)
        return [np.array(reference(library, p), "<u4").tobytes() for p in pieces]

    chunks = Chunks(lambda piece: encode_many([piece])[0], encode_many)
    texts = ["see word### word&&& word!! word", "see word%%%, wörd$) 's### don't!! x2## word\n## ##word##", "see word", ""]
    for text, ids in zip(texts, chunks.all_ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference(library, text), repr(text)
    assert asked.count(" word") == 1
    assert not any(p.startswith((" word#", " word&", " word!", " word%")) for p in asked)


def test_new_pieces_are_learnt_without_a_call_for_each(library):
    """Words and marks are told apart by Arrow: 6,000 new pieces made 12,000 calls and more before."""
    calls = [0]

    def encode_many(pieces):
        return [str(len(p)).encode() * 4 for p in pieces]

    def count(frame, event, arg):
        calls[0] += event == "call" and frame.f_code.co_filename.endswith(("bpe.py", "texts.py"))

    chunks = Chunks(lambda piece: encode_many([piece])[0], encode_many)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(6000)]
    texts = ["see " + " ".join(word + ",." for word in words)]
    sys.setprofile(count)
    try:
        ids = next(chunks.all_ids(texts))
    finally:
        sys.setprofile(None)
    assert ids == b"3333" + (b"5555" + b"2222") * 6000
    assert calls[0] < 200


def test_parts_are_small_and_hold_every_row():
    batches = [{"doc_id": pa.array(range(n)), "text": pa.array(["x" * i for i in range(n)])} for n in (0, 3, 7)]
    found = list(parts(iter(batches), 3))
    assert [len(part["doc_id"]) for part in found] == [3, 3, 3, 1]
    assert [x for part in found for x in part["doc_id"].to_pylist()] == [*range(3), *range(7)]
    assert all([len(x) for x in p["text"].to_pylist()] == p["doc_id"].to_pylist() for p in found)


@pytest.mark.parametrize("run", [round_trip, encode_documents])
def test_the_encoder_takes_small_parts_of_a_batch(spark, monkeypatch, run):
    """However many rows a batch has, no more than 2,000 texts are encoded at a time."""
    tasks = []
    monkeypatch.setattr(bpe, "map_rows", lambda df, fn, schema: tasks.append(fn))
    run(spark.createDataFrame([(1, "a")], "doc_id long, text string"), VOCABULARY)
    batch = {"doc_id": pa.array(range(4500)), "text": pa.array(["some words"] * 4500)}
    assert [len(out["doc_id"]) for out in tasks[0](iter([batch]))] == [2000, 2000, 500]


def test_a_full_memo_keeps_the_words_of_the_group(library):
    asked = []

    def encode_many(pieces):
        asked.extend(pieces)
        return [np.array(reference(library, p), "<u4").tobytes() for p in pieces]

    chunks = Chunks(lambda piece: encode_many([piece])[0], encode_many, most=4)
    texts = ["see one two three", "see three four, five", "see  three four six 中文", "see three four! \tsix ."]
    for text, ids in zip(texts, chunks.all_ids(texts, 1), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference(library, text), repr(text)
    assert asked.count(" three") == asked.count(" four") == 1


def test_a_long_document_splits_a_group_of_texts(library):
    chunks = library_chunks(VOCABULARY)
    texts = ["", "a", "one two " * 40 + "end", " ", "x" * 90 + " y", "one\ntwo three", ""]
    for group_chars in (1, 200, 1 << 22):
        for text, ids in zip(texts, chunks.all_ids(texts, group_chars), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference(library, text), repr(text)
