"""Alignment of the tokens that two tokenizers make of the same text.

Both read a space and the text. Where a token of the one and a token of the other end
together, the text is cut; what lies between two cuts is a group, and the two tokens
that end at a cut are linked. How often a pair of ids is linked is counted over all
documents.

Ends come from the spans that the libraries report: character offsets of ``tokenizers``
and the spans of ``sentencepiece``'s proto (the installed version hands it out as
``proto`` where earlier ones said ``immutable_proto``). They are coarse: tokens that
share a character report all of it, and bytes that stand for a character report nothing
until its last. There the bytes of the tokens themselves decide.

A space between two characters that are no white space begins a token of both, and no
merge of either reaches across it. So texts are parted there, and a part that occurs
many times is aligned once as long as it is known; cuts fall together at every such space.

Documents stay where they are read. For a block of documents there is one row for each
pair of ids, however often they are linked; these rows go by pair to be summed, and the
sums go back by block.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.bpe import _byte_characters
from matchbook.llm.texts import documents, map_rows, uncollected
from matchbook.runtime import cut

#: A space of sentencepiece within its pieces; bytes that have no piece are ``<0xHH>``.
SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Part(NamedTuple):
    """How a piece of text is aligned: token counts, groups as text, linked pairs of ids."""

    n_a: int
    n_b: int
    groups: list[str]
    links: list[tuple[int, int]]


class Aligner:
    """A byte-level vocabulary (A, ``tokenizers``) against a sentencepiece model (B) that adds a space."""

    def __init__(self, path_a: str, path_b: str, most: int = 500_000):
        # Tasks are the parallelism here.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        self._a.no_truncation()
        self._a.no_padding()
        to_byte = {c: b for b, c in _byte_characters().items()}
        self._a_bytes = {
            i: bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
            for token, i in self._a.get_vocab(with_added_tokens=True).items()
        }
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        self.n_b = len(pieces)
        self._b_bytes = [
            bytes([int(found[1], 16)]) if self._b.is_byte(i) and (found := _BYTE.fullmatch(piece))
            else piece.replace(SPACE, " ").encode("utf-8")
            for i, piece in enumerate(pieces)
        ]
        # Only with such a vocabulary may texts be parted at spaces.
        self._parted = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self._a_sizes = np.zeros(max(self._a_bytes) + 1, np.int64)
        for i, token in self._a_bytes.items():
            self._a_sizes[i] = len(token)
        self._b_sizes = np.array([len(token) for token in self._b_bytes])
        # How an id is written, by what comes after it.
        ids = range(max(len(self._a_sizes), self.n_b))
        self._written = {end: np.array([f"{i}{end}" for i in ids], object) for end in (",", "|", ";", "")}
        self._most = most
        self._number: dict[str, int] = {}
        self._known = self.table([])

    def parts_of(self, text: str) -> list[str]:
        """The parts of a text, without the spaces between them."""
        if not text:
            return []
        return _INNER_SPACE.split(text) if self._parted else [text]

    def known(self, parts: set[str]) -> tuple[dict[str, int], _Table]:
        """Places of the parts in a table that keeps those met before, ``most`` of them at most.

        It starts afresh when more would come together; only the parts of one call may be more.
        """
        new = parts.difference(self._number)
        if len(self._number) + len(new) > self._most:
            self._number, self._known, new = {}, self.table([]), parts
        if new:
            held, listed = self._known, list(new)
            found = self.table(listed)
            found = found._replace(begin=found.begin + len(held.codes))
            self._known = _Table(
                *(np.concatenate(both) for both in zip(held[:-1], found[:-1])), held.shown + found.shown
            )
            self._number.update(zip(listed, range(len(self._number), len(self._number) + len(listed))))
        return self._number, self._known

    def table(self, parts: list[str], together: int = 512) -> _Table:
        """Distinct parts, all at once where they may stand side by side in one text.

        That takes parts that neither begin nor end with white space; the others are
        aligned one by one, and so is a lot in which some part isn't given back.
        """
        n = len(parts)
        out = _Table(*(np.zeros(n, np.int64) for _ in range(3)), np.ones(n, bool), np.zeros(n, np.int64), None, [""] * n)
        lots: dict[int, list[int]] = {0: [], 1: [], 2: []}
        for i, part in enumerate(parts):
            plain = self._parted and part and not (part[0].isspace() or part[-1].isspace())
            lots[2 if not plain else 0 if part.isascii() else 1].append(i)
        codes: list[np.ndarray] = []
        held = 0
        for kind, places in lots.items():
            for low in range(0, len(places), together):
                lot = places[low : low + together]
                found = self._in_one_text([parts[i] for i in lot], out, np.array(lot)) if kind < 2 else None
                if found is None:
                    found = self._one_by_one([parts[i] for i in lot], out, lot)
                sizes = out.n_groups[lot]
                out.begin[lot] = held + np.cumsum(sizes) - sizes
                held += len(found)
                codes.append(found)
        return out._replace(codes=np.concatenate(codes) if codes else np.zeros(0, np.int64))

    def _one_by_one(self, parts: list[str], out: _Table, places: list[int]) -> np.ndarray:
        codes = []
        for i, part in zip(places, self.align(parts)):
            if part is None:
                out.whole[i] = False
                continue
            out.n_a[i], out.n_b[i], out.n_groups[i] = part.n_a, part.n_b, len(part.groups)
            out.shown[i] = ";".join(part.groups)
            codes += [a * self.n_b + b for a, b in part.links]
        return np.array(codes, np.int64)

    def _in_one_text(self, parts: list[str], out: _Table, places: np.ndarray) -> np.ndarray | None:
        text = " ".join(parts)
        data = b" " + text.encode("utf-8")
        a = self._a.encode(" " + text, add_special_tokens=False)
        b = self._b.encode(text, return_type="proto")
        a_ids, pieces = a.ids, [(piece.id, piece.end) for piece in b.pieces]
        b_ids = [i for i, _ in pieces]
        if b"".join(map(self._a_bytes.__getitem__, a_ids)) != data:
            return None
        if b"".join(map(self._b_bytes.__getitem__, b_ids)) != data:
            return None
        a_ids, b_ids = np.array(a_ids), np.array(b_ids)
        if len(data) == len(text) + 1:
            # A byte for each character: the spans are exact. B's leave out the added space.
            a_ends = np.array([end for _, end in a.offsets])
            b_ends = np.array([end for _, end in pieces]) + 1
        else:
            a_ends, b_ends = np.cumsum(self._a_sizes[a_ids]), np.cumsum(self._b_sizes[b_ids])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        part_ends = np.cumsum([1 + len(part.encode("utf-8")) for part in parts])
        of_cut = np.searchsorted(part_ends, cuts)
        n = len(parts)
        out.n_a[places] = np.bincount(np.searchsorted(part_ends, a_ends), minlength=n)
        out.n_b[places] = np.bincount(np.searchsorted(part_ends, b_ends), minlength=n)
        out.n_groups[places] = np.bincount(of_cut, minlength=n)
        # Ids of a group: those of A up to a bar, then those of B.
        a_at, b_at = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        a_text, b_text = self._written[","][a_ids], self._written[","][b_ids]
        a_text[a_at] = self._written["|"][a_ids[a_at]]
        b_text[b_at] = self._written[";"][b_ids[b_at]]
        last = np.flatnonzero(np.diff(of_cut, append=n))
        b_text[b_at[last]] = self._written[""][b_ids[b_at[last]]]
        group = np.concatenate((np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)))
        order = np.argsort(group, kind="stable")
        written = np.concatenate((a_text, b_text))[order].tolist()
        ends = np.cumsum(out.n_a[places] + out.n_b[places]).tolist()
        for i, low, high in zip(places.tolist(), [0, *ends], ends):
            out.shown[i] = "".join(written[low:high])
        return a_ids[a_at].astype(np.int64) * self.n_b + b_ids[b_at]

    def align(self, parts: list[str], together: int = 1024) -> Iterator[Part | None]:
        """Each part behind a space; None if the tokens of one side are not its bytes.

        What the libraries return is large, so few parts go ``together``.
        """
        for low in range(0, len(parts), together):
            yield from self._align(parts[low : low + together])

    def _align(self, parts: list[str]) -> Iterator[Part | None]:
        coded_a = self._a.encode_batch([" " + part for part in parts], add_special_tokens=False)
        coded_b = self._b.encode(parts, return_type="proto", num_threads=1)
        for part, a, b in zip(parts, coded_a, coded_b):
            data = b" " + part.encode("utf-8")
            pieces = [(piece.id, piece.end) for piece in b.pieces]
            a_ids, b_ids = a.ids, [i for i, _ in pieces]
            a_bytes = [self._a_bytes[i] for i in a_ids]
            b_bytes = [self._b_bytes[i] for i in b_ids]
            if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
                yield None
                continue
            if len(data) == len(part) + 1:
                # A byte for each character: the spans are exact. B's leave out the added space.
                a_ends = [end for _, end in a.offsets]
                b_ends = [end + 1 for _, end in pieces]
            else:
                a_ends, b_ends = refined(a_bytes), refined(b_bytes)
            yield _grouped(a_ids, a_ends, b_ids, b_ends)


class _Table(NamedTuple):
    """Numbers of distinct parts, by their place; the codes of a part's links lie at ``begin``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    whole: np.ndarray
    begin: np.ndarray
    codes: np.ndarray
    shown: list[str]


def refined(tokens: list[bytes]) -> list[int]:
    """Byte offsets of the ends of tokens, from their bytes."""
    return np.cumsum([len(token) for token in tokens]).tolist()


def _grouped(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int]) -> Part:
    groups, links = [], []
    i = j = from_a = from_b = 0
    while i < len(a_ids) and j < len(b_ids):
        if a_ends[i] < b_ends[j]:
            i += 1
        elif a_ends[i] > b_ends[j]:
            j += 1
        else:
            links.append((a_ids[i], b_ids[j]))
            i, j = i + 1, j + 1
            ours = ",".join(map(str, a_ids[from_a:i]))
            groups.append(f"{ours}|{','.join(map(str, b_ids[from_b:j]))}")
            from_a, from_b = i, j
    return Part(len(a_ids), len(b_ids), groups, links)


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(path_a, path_b)


class _Aligned(NamedTuple):
    """Documents of one group of texts: all their numbers, and the links of each."""

    n_a: list[int]
    n_b: list[int]
    n_groups: list[int]
    groups: list[str]
    pairs: list[np.ndarray]


def _align_texts(aligner: Aligner, texts: list[str]) -> _Aligned:
    parted = [aligner.parts_of(text) for text in texts]
    number, table = aligner.known(set().union(*parted))
    out = _Aligned([], [], [], [], [])
    for parts in parted:
        at = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        if not table.whole[at].all():
            at = at[:0]
        out.n_a.append(int(table.n_a[at].sum()))
        out.n_b.append(int(table.n_b[at].sum()))
        sizes = table.n_groups[at]
        out.n_groups.append(int(sizes.sum()))
        out.groups.append(";".join([table.shown[i] for i in at.tolist()]))
        shift = np.repeat(table.begin[at] - (np.cumsum(sizes) - sizes), sizes)
        out.pairs.append(table.codes[shift + np.arange(len(shift))])
    return out


def _in_groups(batches: Iterator[dict], chars: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, some millions of characters at a time."""
    for batch in batches:
        ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        low = held = 0
        for high, text in enumerate(texts, 1):
            held += len(text)
            if held >= chars or high == len(texts):
                yield ids[low:high], texts[low:high]
                low, held = high, 0


def token_groups(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, groups`` of every row: ``a1,a2|b1;a3|b2,b3``, ids of A and of B in order.

    Empty for a text without tokens. Rows as for ``align``.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        aligner = _aligner(path_a, path_b)
        for ids, texts in _in_groups(batches):
            yield {"doc_id": ids, "groups": _align_texts(aligner, texts).groups}

    return map_rows(documents(docs, id_col, text_col), uncollected(run), "doc_id long, groups string")


_PER_BLOCK = (
    "block long, codes array<long>, counts array<long>, doc_row struct<doc_id: long, n_a: long, "
    "n_b: long, n_groups: long, n_links: long, groups_sha256: string, links: binary>"
)
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "n_best long, count_sum long, groups_sha256 string"
)


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    block_chars: int = 1 << 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts the links whose pair is, of all pairs with its id of B, linked most
    often in the corpus (all of equals); ``count_sum`` adds up how often the pair of each
    link is linked. ``groups_sha256`` is of the text that ``token_groups`` gives.

    Null and empty texts, and texts that the tokens of one side don't give back, have no
    tokens: zeros and an empty ``groups_sha256``. Rows with null, tied or repeated ids
    each count and each get a row; an empty table gives none; further columns are not
    looked at. Both paths are files that every node has.
    """
    found = _per_block(documents(docs, id_col, text_col), path_a, path_b, block_chars)
    found, _ = cut(found)
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    asked = found.filter("doc_row IS NULL").select("block", F.explode(F.arrays_zip("codes", "counts")))
    asked = asked.select("block", F.col("col.codes").alias("code"), F.col("col.counts").alias("n"))
    pairs = asked.groupBy("code").agg(F.sum("n").alias("total"))
    pairs = pairs.withColumn("b", F.col("code") % n_b)
    highest = pairs.groupBy("b").agg(F.max("total").alias("highest"))
    known = pairs.join(highest, "b").select(
        "code", "total", (F.col("total") == F.col("highest")).alias("best")
    )
    sums = asked.select(F.col("block").alias("home"), "code").join(known, "code")
    rows = found.filter("doc_row IS NOT NULL").select("block", "doc_row.*")

    def finish(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        codes = theirs["code"].to_numpy()
        order = np.argsort(codes)
        codes, total = codes[order], theirs["total"].to_numpy()[order]
        best = theirs["best"].to_numpy()[order].astype(np.int64)
        n_best, count_sum = [], []
        for packed in ours["links"].to_pylist():
            mine, times = _unpack(packed)
            at = np.searchsorted(codes, mine)
            n_best.append(int((times * best[at]).sum()) if len(mine) else 0)
            count_sum.append(int((times * total[at]).sum()) if len(mine) else 0)
        out = ours.drop_columns(["block", "links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64()))
        out = out.append_column("count_sum", pa.array(count_sum, pa.int64()))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return out.select(names)

    return rows.groupBy("block").cogroup(sums.groupBy("home")).applyInArrow(finish, _RESULT)


def _per_block(docs: DataFrame, path_a: str, path_b: str, block_chars: int) -> DataFrame:
    """A row for each document, and for each block one with its pairs of ids and their counts.

    A block is some neighbouring documents of one task.
    """
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        aligner = _aligner(path_a, path_b)
        task = TaskContext.get().partitionId()
        nth = chars = 0
        held = _Counts()

        def close() -> dict:
            codes, counts = held.take()
            return {
                "block": [task << 32 | nth],
                "codes": [codes.tolist()],
                "counts": [counts.tolist()],
                "doc_row": [None],
            }

        for ids, texts in _in_groups(batches):
            found = _align_texts(aligner, texts)
            yield {
                "block": [task << 32 | nth] * len(ids),
                "codes": [None] * len(ids),
                "counts": [None] * len(ids),
                "doc_row": [
                    {
                        "doc_id": doc_id,
                        "n_a": n_a,
                        "n_b": n_b,
                        "n_groups": n,
                        "n_links": len(pairs),
                        "groups_sha256": hashlib.sha256(shown.encode()).hexdigest() if n_a else "",
                        "links": _pack(pairs),
                    }
                    for doc_id, n_a, n_b, n, shown, pairs in zip(ids, *found)
                ],
            }
            held.add(found.pairs)
            chars += sum(map(len, texts))
            if chars >= block_chars:
                yield close()
                nth, chars = nth + 1, 0
        yield close()

    return map_rows(docs, uncollected(run), _PER_BLOCK)


class _Counts:
    """Codes and how often each came."""

    def __init__(self) -> None:
        self._codes, self._counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, arrays: list[np.ndarray]) -> None:
        codes, counts = np.unique(np.concatenate(arrays), return_counts=True)
        codes = np.concatenate((self._codes, codes))
        counts = np.concatenate((self._counts, counts))
        self._codes, back = np.unique(codes, return_inverse=True)
        self._counts = np.zeros(len(self._codes), np.int64)
        np.add.at(self._counts, back, counts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self._codes, self._counts
        self.__init__()
        return out


def _pack(pairs: np.ndarray) -> bytes:
    """Distinct codes as differences, then how often each occurs."""
    codes, times = np.unique(pairs, return_counts=True)
    steps = np.diff(codes, prepend=0)
    return zlib.compress(steps.astype("<i8").tobytes() + times.astype("<i8").tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), "<i8").reshape(2, -1)
    return np.cumsum(both[0]), both[1]
