"""Alignment of two tokenizers against a plain version that looks at whole texts."""

import bisect
import collections
import hashlib
import re

import pytest
import sentencepiece
from tokenizers import Tokenizer

from matchbook.llm.alignment import Aligner, _align_texts, align, token_groups
from matchbook.llm.queries import PIECES, VOCABULARY

from .conftest import pairs, same_rows

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def characters_of_bytes():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD) and not 0x7F <= b <= 0xA0]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


BYTE_OF = characters_of_bytes()


def tokens(libraries, text):
    """``(id, end)`` of both sides by the bytes of whole texts; none if either differs."""
    a, b = libraries
    data = b" " + text.encode()
    sides = []
    left = [(i, bytes(BYTE_OF[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text, return_type=int):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        right.append((i, bytes([int(byte[1], 16)]) if byte and b.is_byte(i) else piece.replace("▁", " ").encode()))
    for side in (left, right):
        if not text or b"".join(x for _, x in side) != data:
            return [], []
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((i, at))
        sides.append(out)
    return sides


def expected(libraries, rows):
    found = [(doc_id, *tokens(libraries, text)) for doc_id, text in rows]
    linked = []
    for _, a, b in found:
        ends = {end: i for i, end in b}
        linked.append([(i, ends[end]) for i, end in a if end in ends])
    counts = collections.Counter(pair for links in linked for pair in links)
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for (doc_id, a, b), links in zip(found, linked):
        cuts = sorted({end for _, end in a} & {end for _, end in b})
        groups = {high: ([], []) for high in cuts}
        for k, side in enumerate((a, b)):
            for i, end in side:
                groups[cuts[bisect.bisect_left(cuts, end)]][k].append(str(i))
        shown = ";".join("|".join(map(",".join, sides)) for sides in groups.values())
        yield (
            doc_id,
            len(a),
            len(b),
            len(cuts),
            len(links),
            sum(counts[p] == highest[p[1]] for p in links),
            sum(counts[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if a else "",
        )


STRANGE = [
    "naïve 日本 語 \U0001f600\U0001f603 x",
    "a▁b",
    "a ▁b c",
    "<0x41> and <|endoftext|> plain",
    " begins  and ends with blanks \n",
    "　wide　 space",
    "① ﬁne é ́x",
    "tabs\tand\r\nlines \x1c \x85 \x00",
    "Grüße aus Ägypten",
    "1234567890 12 345",
]


@pytest.fixture(scope="module")
def strange(spark):
    rows = [(i // 2, text) for i, text in enumerate(STRANGE * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_strange_texts(strange, libraries):
    same_rows(align(strange, VOCABULARY, PIECES), expected(libraries, pairs(strange)), COLUMNS)


@pytest.mark.parametrize("block_chars", [1 << 24, 1])
def test_hard_rows(hard, libraries, block_chars):
    """With many documents in a block, and with a block for each group of texts."""
    found = align(hard, VOCABULARY, PIECES, block_chars)
    same_rows(found, expected(libraries, pairs(hard)), COLUMNS)


def test_given_documents(small, libraries):
    same_rows(align(small, VOCABULARY, PIECES), expected(libraries, pairs(small)), COLUMNS)


def test_groups_as_text(strange):
    shown = {r["groups"] for r in token_groups(strange, VOCABULARY, PIECES).collect()}
    digests = {r["groups_sha256"] for r in align(strange, VOCABULARY, PIECES).collect()}
    assert {hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown} == digests


def test_empty_table(nothing):
    assert align(nothing, VOCABULARY, PIECES).collect() == []


def test_spans_of_characters_without_a_byte_each():
    """Spans that report a character more than once, or late, are refined by bytes."""
    (part,) = Aligner(VOCABULARY, PIECES).align(["①"])
    assert part.n_a >= 2 and part.n_b == 4 and len(part.links) == len(part.groups)


@pytest.mark.parametrize("most", [500_000, 7])
def test_parts_met_before_are_known(libraries, most, monkeypatch):
    aligner = Aligner(VOCABULARY, PIECES, most)
    asked = []
    table = aligner.table
    monkeypatch.setattr(aligner, "table", lambda parts: asked.extend(parts) or table(parts))
    groups = [["one two wörd", "two, three", ""], ["three one two,", "new one  two", " x"], ["one two wörd", "two, 🙂 three"]]
    for texts in groups:
        found = _align_texts(aligner, texts)
        for i, text in enumerate(texts):
            a, b = tokens(libraries, text)
            ends = sorted({end for _, end in a} & {end for _, end in b})
            assert (found.n_a[i], found.n_b[i], found.n_groups[i]) == (len(a), len(b), len(ends)), repr(text)
            left, right = ({end: k for k, end in side} for side in (a, b))
            assert found.pairs[i].tolist() == [left[end] * aligner.n_b + right[end] for end in ends], repr(text)
    assert (len(asked) == len(set(asked))) == (most > 7)
