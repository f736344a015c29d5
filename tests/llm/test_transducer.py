"""The transducer against the tiktoken library, the streaming decoder against a whole one."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from matchbook.llm.queries import RANKS
from matchbook.llm.transducer import (
    Merges,
    RankDecoder,
    RankEncoder,
    Utf8Stream,
    decode_documents,
    encode_documents,
    read_ranks,
    round_trip,
)

from .conftest import pairs, same_rows

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings():
    rng = random.Random(5)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "你", "🙂", "'s", "1", "23", "!", "##", "\x1c", "\x85", "<|endoftext|>", "Z", "\x00"]
    letters = "abcdefghijklmnopqrstuvwxyzAEIOUéàñß"
    out = ["".join(rng.choice(parts) for _ in range(n % 50)) for n in range(2000)]
    out += ["".join(rng.choice(letters) for _ in range(1 + n % 30)) for n in range(3000)]
    return out + ["", " ", "\n", " a", "a ", " a b  c \n d", "x" * 3000, "ab" * 1500, "a\0", "a"]


@pytest.mark.parametrize("most, group", [(400_000, 1 << 22), (50_000, 3000), (600, 40)])
def test_ids_are_the_librarys(ranks, library, most, group):
    """With tables that hold all steps, that are emptied now and then, and that never suffice."""
    texts = strings() if most > 600 else strings()[::7]
    encoder = RankEncoder(ranks, PATTERN, most, group)
    for text, ids in zip(texts, encoder.all_ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_output_waits_only_while_longer_tokens_are_possible(ranks):
    """A long run of one word's letters is written as it is read, not held to its end."""
    transducer = RankEncoder(ranks, PATTERN).transducer
    state, written = transducer._start, []
    for byte in b" internationalisation" * 20:
        ways, tokens = transducer._follow(state, byte)
        state = transducer._state(ways)
        written += tokens
        assert max(len(waiting) for waiting, _, _ in ways) <= 20
    assert len(written) >= 20


def test_every_token_is_its_own_merge(ranks):
    merges = Merges(ranks)
    for token in random.Random(1).sample(sorted(ranks), 4000):
        assert merges.apply(token) == [token]


def test_ranks_must_hold_every_byte():
    with pytest.raises(ValueError, match="single byte"):
        Merges({b"a": 0})


def test_stream_of_bytes_decodes_as_the_whole():
    rng = random.Random(7)
    some = [0x41, 0x80, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xC3, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0xF5]
    for n in range(20_000):
        data = bytes(rng.choice(some) for _ in range(n % 10))
        step = 1 + n % 4
        stream = Utf8Stream()
        text = "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step))
        assert text + stream.close() == data.decode("utf-8", "replace"), data


def test_characters_cut_by_tokens_come_out_whole(ranks, library):
    decoder = RankDecoder(ranks, portion=1)
    text = "日本語 naïve 🙂🙃 ȸ end"
    ids = np.array(library.encode_ordinary(text))
    portions = list(decoder.text(decoder.portions(ids)))
    assert "".join(portions) == text and "�" not in "".join(portions)


def digests(library, rows):
    for doc_id, text in rows:
        ids = library.encode_ordinary(text)
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode_bytes(ids)
        yield doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()


COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_hard_rows(hard, library):
    same_rows(round_trip(hard, RANKS, PATTERN), digests(library, pairs(hard)), COLUMNS)


def test_given_documents(small, library):
    same_rows(round_trip(small, RANKS, PATTERN), digests(library, pairs(small)), COLUMNS)


def test_empty_table(nothing):
    assert round_trip(nothing, RANKS, PATTERN).collect() == []


def test_encode_then_decode(hard):
    back = decode_documents(encode_documents(hard, RANKS, PATTERN), RANKS)
    same_rows(back, pairs(hard), ["doc_id", "text"])


def test_what_one_group_held_is_not_walked_again(ranks, library, monkeypatch):
    encoder = RankEncoder(ranks, PATTERN, group_chars=40)
    walked = []
    walk = encoder.transducer.all_ids
    monkeypatch.setattr(encoder.transducer, "all_ids", lambda pieces: walked.extend(pieces) or walk(pieces))
    long = "q" * 70
    texts = ["the cat and the dog", "the dog and a cat " + long, "a cat and the dog", long] * 3
    for text, ids in zip(texts, encoder.all_ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    short = [p for p in walked if len(p) < 64]
    assert len(short) == len(set(short))
