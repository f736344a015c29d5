"""Byte-level BPE: an exact encoder by backtracking, and a decoder by an offset table.

The encoder takes the longest token at a position (one Aho-Corasick pass finds
them all), keeps it if its pair with the token before could stand in a result
of the merges, tries shorter prefixes otherwise, and steps back when none fits.
No position is entered twice after a dead end, so the time is linear in the text.

Both directions run within the tasks that read the texts; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from matchbook.llm.texts import Memo, documents, map_rows, parts

# Fixed value: how byte-level vocabularies cut a text before merging.
PRETOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: A run of these is a pre-token of its own between a letter and a space.
_ENDS = ".,;:!?#$%&*)]}"

#: Letters that every version of Unicode calls so, and white space.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_WHITE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def _letters(text: str) -> bool:
    """Only letters, and only such as every version of Unicode calls so: one pre-token."""
    return text.isalpha() and max(text) < "\u0250"


_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Chunks:
    """Encodes texts piece by piece, each distinct word once as long as the memo holds it.

    A space between two characters that are no white space always starts a new
    pre-token, and no pre-token looks beyond it; so a text may be cut there. Other
    texts (double spaces, blanks at the ends) are cut at the spaces that qualify.
    Pieces that differ from text to text (very long ones) aren't held. A word with
    marks behind it is the word and the marks.

    The memo is two Arrow arrays, so a group of texts is looked up in a few calls. When it
    has grown to ``most`` words it keeps those of the group at hand.
    """

    def __init__(
        self,
        encode: Callable[[str], bytes],
        encode_many: Callable[[list[str]], list[bytes] | pa.LargeBinaryArray] | None = None,
        most: int = 500_000,
        longest: int = 64,
    ):
        self._encode, self._most, self._longest = encode, most, longest
        self._many = encode_many or (lambda pieces: [encode(p) for p in pieces])
        self._words = pa.array([], pa.large_string())
        self._word_ids = pa.array([], pa.large_binary())
        self._inner = Memo(lambda piece: encode(" " + piece), most // 10)
        self._first = Memo(encode, most // 10)

    def all_ids(self, texts: list[str], group_chars: int = 1 << 23) -> Iterator[bytes]:
        """Ids of each text; the new words of some texts are encoded together."""
        low = held = 0
        for high, text in enumerate(texts, 1):
            held += len(text)
            if held >= group_chars or high == len(texts):
                yield from self._group_ids(texts[low:high])
                low, held = high, 0

    def _group_ids(self, texts: list[str]) -> Iterator[bytes]:
        """Every distinct piece is looked up once; the ids of all pieces are laid end to end by Arrow."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        starts, code = split.offsets.to_numpy(), coded.indices.to_numpy()
        firsts = starts[:-1]
        inside = np.ones(len(code), bool)
        inside[firsts] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[code[inside]] = True
        names = coded.dictionary.filter(pa.array(used))
        heads = coded.dictionary.take(pa.array(code[firsts])).to_pylist()

        inner = self._inner_ids(names)
        new = self._first.lacks({head for head in heads if self._held(head)})
        self._first.put_all(dict(zip(new, _listed(self._many(new)))))
        outer = pa.array([self._first[head] if self._held(head) else None for head in heads], pa.large_binary())

        # A row of ``found`` for each piece: inner pieces by what they are, the others by their text.
        found = pa.concat_arrays([inner, outer])
        row = (np.cumsum(used, dtype=np.int32) - 1)[code]
        row[firsts] = len(names) + np.arange(len(texts), dtype=np.int32)
        unheld = found.is_null().to_numpy(zero_copy_only=False)
        rough = np.logical_or.reduceat(unheld[row], firsts).tolist()
        known = dict(zip(names.to_pylist(), inner.to_pylist())) if any(rough) else {}
        laid = found.take(pa.array(row))
        _, ends, data = laid.buffers()
        cuts = np.frombuffer(ends, np.int64)[starts].tolist()
        ids = memoryview(data if data is not None else b"")
        for text, a, b, rest in zip(texts, cuts, cuts[1:], rough):
            yield self._rough(text, known) if rest else ids[a:b].tobytes()

    def _inner_ids(self, names: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct pieces behind a space, marks put back behind their words; those that can't be held have none."""
        size = _sizes(names)
        held = (size > 0) & (_sizes(pc.utf8_trim(names, _WHITE)) == size)
        held &= pc.less_equal(pc.utf8_length(names), self._longest).to_numpy(zero_copy_only=False)
        rest = pc.utf8_ltrim(names, _LETTERS)
        left = _sizes(rest)
        ended = held & (left > 0) & (left < size) & (_sizes(pc.utf8_rtrim(rest, _ENDS)) == 0)
        words = pc.if_else(pa.array(ended), pc.utf8_rtrim(names, _ENDS), names)
        coded = pc.if_else(pa.array(held), words, pa.scalar(None, pa.large_string())).dictionary_encode()
        pool, place = self._looked_up(coded.dictionary)
        found = pool.take(pa.array(place).take(coded.indices))
        if not ended.any():
            return found
        marks = rest.filter(pa.array(ended)).dictionary_encode()
        behind = pa.array([self._first[m] for m in marks.dictionary.to_pylist()], pa.large_binary())
        joined = pc.binary_join_element_wise(
            found.filter(pa.array(ended)), behind.take(marks.indices), pa.scalar(b"", pa.large_binary())
        )
        row = np.arange(len(names))
        row[ended] = len(names) + np.arange(len(joined))
        return pa.concat_arrays([found, joined]).take(pa.array(row))

    def _looked_up(self, words: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """An array of ids and the place of each word in it; new words are learnt."""
        at = pc.index_in(words, value_set=self._words)
        lacking = at.is_null()
        new = words.filter(lacking)
        ids = self._many([" " + word for word in new.to_pylist()]) if len(new) else []
        ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.large_binary())
        if len(self._words) + len(new) > self._most:
            met = at.drop_null()
            self._words, self._word_ids = self._words.take(met), self._word_ids.take(met)
            at = pc.if_else(lacking, None, pc.cumulative_sum(pc.invert(lacking).cast(pa.int32())))
            at = pc.subtract(at, 1)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[lacking.to_numpy(zero_copy_only=False)] = len(self._words) + np.arange(len(new))
        self._words = pa.concat_arrays([self._words, new])
        self._word_ids = pa.concat_arrays([self._word_ids, ids])
        return self._word_ids, place

    def _held(self, piece: str) -> bool:
        """Neither empty nor long, no white space at its ends."""
        return 0 < len(piece) <= self._longest and len(piece.strip()) == len(piece)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        return next(self.all_ids([text]))

    def _rough(self, text: str, known: dict[str, bytes | None]) -> bytes:
        """Ids of a text with a space beside white space or at an end, or with a long piece."""
        if not text:
            return b""
        pieces = _INNER_SPACE.split(text)
        out = [self._encode(pieces[0])]
        for piece in pieces[1:]:
            ids = known.get(piece)
            if ids is None:
                ids = self._inner[piece] if self._held(piece) else self._encode(" " + piece)
            out.append(ids)
        return b"".join(out)


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False)


def _listed(ids: list[bytes] | pa.Array) -> list[bytes]:
    return ids.to_pylist() if isinstance(ids, pa.Array) else ids


class ByteBpe:
    """A byte-level vocabulary in the ``tokenizers`` JSON format.

    Ids of merged tokens must rise in the order of the merges, which the exactness
    of the pair test rests on; the constructor checks it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        to_byte = {c: b for b, c in _byte_characters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {t: i for t, i in vocab.items() if t not in self.special}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        raw: list[bytes] = [b""] * self.size
        for token, i in known.items():
            raw[i] = bytes(to_byte[c] for c in token)
        for text, i in self.special.items():
            raw[i] = text.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._merged: dict[tuple[int, int], int] = {}
        self._split = {i: (i, i) for t, i in known.items() if len(t) == 1}
        last = max(self._split)
        for left, right in pairs:
            i = vocab[left + right]
            if i <= last:
                raise ValueError("ids must rise in the order of the merges")
            last = i
            self._merged[vocab[left], vocab[right]] = i
            self._split[i] = (vocab[left], vocab[right])
        self._words = ahocorasick.Automaton()
        ids = {raw[i]: i for i in self._split}
        self._length = [len(x) for x in raw]
        # A token and all tokens that it begins with, the longest first.
        self._prefixes: dict[int, tuple[int, ...]] = {}
        for token, i in ids.items():
            self._words.add_word(token.decode("latin-1"), (len(token), i))
            heads = (token[:end] for end in range(len(token), 0, -1))
            self._prefixes[i] = tuple(ids[head] for head in heads if head in ids)
        self._words.make_automaton()
        # A pair is one number: left * size + right.
        self._fits: Memo = Memo(lambda pair: self._compatible(*divmod(pair, self.size)), 300_000)
        self.offsets = np.zeros(self.size + 1, np.int64)
        np.cumsum(self._length, out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._special_pattern = re.compile("|".join(names)) if names else None

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at its left (0) or right (1) end, each with what it is merged into."""
        out = [(token, self.size)]
        while (part := self._split[token][side]) != token:
            out.append((part, token))
            token = part
        return out

    def _compatible(self, left: int, right: int) -> bool:
        """Do the merges of both tokens' bytes leave just these two?

        Merges come in the order of ids, so a part is there from its own id to that of the
        part it goes into. They don't if two parts that meet at the border have a merge
        that comes before both are gone. Of equal merges the left one comes first: it
        takes the left part away from the border, but is too late for the right one.
        """
        facing = self._edge(right, 0)
        for part, gone in self._edge(left, 1):
            for other, other_gone in facing:
                across = self._merged.get((part, other))
                if across is not None and across < gone and across <= other_gone:
                    return False
        return True

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token.

        A search in depth: at each place the tokens that begin there, the longest first. A
        row of tokens that fit is the only one for the text it covers, so a place from
        which no way led on is never tried again.
        """
        data = piece.encode("utf-8").decode("latin-1")
        n = len(data)
        longest = [0] * n
        for end, (count, i) in self._words.iter(data):
            longest[end - count + 1] = i  # ends rise, so the longest comes last
        length, fits, prefixes, size = self._length, self._fits, self._prefixes, self.size
        path: list[int] = []
        choices = [iter(prefixes[longest[0]])]
        dead: set[int] = set()
        at = 0
        while at < n:
            for token in choices[-1]:
                end = at + length[token]
                if end not in dead and (not path or fits[path[-1] * size + token]):
                    path.append(token)
                    at = end
                    if at < n:
                        choices.append(iter(prefixes[longest[at]]))
                    break
            else:
                dead.add(at)
                choices.pop()
                at -= length[path.pop()]
        return path

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; texts of special tokens give their ids."""
        if _letters(text.removeprefix(" ")):
            return array("I", self.merge(text)).tobytes()
        out: list[int] = []
        at = 0
        for match in self._special_pattern.finditer(text) if self._special_pattern else ():
            for piece in PRETOKENS.findall(text[at : match.start()]):
                out += self.merge(piece)
            out.append(self.special[match[0]])
            at = match.end()
        for piece in PRETOKENS.findall(text[at:]):
            out += self.merge(piece)
        return array("I", out).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: ranges of the table of all tokens' bytes, laid end to end."""
        if not len(ids):
            return ""
        ids = ids.astype(np.int64)
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[shift + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in such vocabularies: printable ones for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One vocabulary per Python worker."""
    return ByteBpe(path)


@lru_cache(maxsize=2)
def own_chunks(path: str) -> Chunks:
    """One for each Python worker, so pieces are known from task to task."""
    return Chunks(byte_bpe(path).encode)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers as bytes) of every row.

    Null and empty texts have no ids. Rows with null or repeated ids are encoded
    like any other. ``path`` is a vocabulary file that every node has.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        chunks = own_chunks(path)
        for batch in parts(batches, 2000):
            ids = list(chunks.all_ids(batch["text"].to_pylist()))
            yield {"doc_id": batch["doc_id"], "ids": ids}

    return map_rows(documents(docs, id_col, text_col), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids decode to an empty text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = byte_bpe(path)
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in batch["ids"].to_pylist()]
            yield {"doc_id": batch["doc_id"], "text": [bpe.decode(x) for x in ids]}

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, then its ids decoded.

    One pass: the ids of a text go straight to the decoder. Null, empty and
    repeated rows as for ``encode_documents``.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = byte_bpe(path)
        chunks = own_chunks(path)
        for batch in parts(batches, 2000):
            ids = list(chunks.all_ids(batch["text"].to_pylist()))
            texts = (bpe.decode(np.frombuffer(x, "<u4")) for x in ids)
            yield {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(documents(docs, id_col, text_col), run, schema)
