"""Byte-level BPE by a finite-state transducer, and a streaming decoder.

The ranks of a vocabulary compile into a transducer that reads bytes and writes
tokens. Before determinisation a state is the token written last and the place of
the unfinished one in the trie of all tokens; a token may be finished where it can
stand beside the one before it, that is, where the merges of both together give
just these two. Exactly one way of finishing tokens survives at any end of the text.

Determinisation is lazy: a state is made when a text first reaches it, as the set
of unfinished tokens with what each has yet to write. Tokens that all of the set
share are written at once, so output waits only as long as a longer token is still
possible. Steps are kept in a table of bounded size that starts afresh when full.

The decoder takes ids in portions and gives text in portions: a state machine over
bytes holds back what may still become a character.

Both run within the tasks that read the texts; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from matchbook.llm.texts import Memo, documents, map_rows, uncollected

_ROOT = 0

# Odd, and of 64 well mixed bits.
_MIXER, _LOW_64 = 0x9E3779B97F4A7C15, (1 << 64) - 1

# A way to go on: tokens not yet written, the last token, the place in the trie.
_Way = tuple[tuple[int, ...], int, int]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: lines of a token in base 64 and a number."""
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in file if line.strip())}


class Merges:
    """The merges that ranks stand for: of all neighbours the lowest rank first, leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")

    def apply(self, data: bytes) -> list[bytes]:
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


class _Full(Exception):
    """The table of steps can't take another."""


class Transducer:
    """Token ids of byte strings by the merges of ``ranks``.

    ``most`` bounds the steps in the table and the pairs of tokens whose test is
    remembered; a full table is emptied and fills again from the text at hand. Steps
    are found by hashing in flat arrays, for many strings at a time.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        self._merges, self._most = Merges(ranks), most
        self._token = {r: t for t, r in ranks.items()}
        # The trie: a child by place and byte, the token that ends at a place.
        self._child: dict[int, int] = {}
        ends = {_ROOT: -1}
        inner = set()
        for token, r in ranks.items():
            at = _ROOT
            for byte in token:
                inner.add(at)
                at = self._child.setdefault(at << 8 | byte, len(self._child) + 1)
            ends[at] = r
        size = len(self._child) + 1
        self._ends = array("i", [ends.get(i, -1) for i in range(size)])
        self._open = bytearray(i in inner for i in range(size))
        self._fits = Memo(lambda pair: self._side_by_side(*pair), most)
        self._bits = (2 * most).bit_length()
        self._restart()

    def _restart(self) -> None:
        self._ids: dict[tuple[_Way, ...], int] = {}
        self._ways: list[tuple[_Way, ...]] = []
        self._held = 0
        # By slot: state and byte, and the step they have; by step: where it leads.
        self._slots = np.full(1 << self._bits, -1, np.int64)
        self._step_at = np.zeros(1 << self._bits, np.int32)
        self._to = np.zeros(self._most + 1, np.int32)
        # Tokens written, by step, and those still to write when a string ends, by state.
        self._written = np.zeros((2, self._most + 1), np.int32)
        self._at_end = np.zeros((2, self._most + 2), np.int32)
        self._tokens = np.zeros(4 * self._most + 4096, np.int32)
        self._n_tokens = 0
        self._start = self._state((((), -1, _ROOT),))

    def _note(self, tokens: tuple[int, ...]) -> tuple[int, int]:
        at, n = self._n_tokens, len(tokens)
        if not n:
            return 0, 0
        if at + n > len(self._tokens):
            raise _Full
        self._tokens[at : at + n] = tokens
        self._n_tokens += n
        return at, n

    def _state(self, ways: tuple[_Way, ...]) -> int:
        found = self._ids.get(ways)
        if found is None:
            found = self._ids[ways] = len(self._ways)
            self._ways.append(ways)
            waiting = next((w for w, _, place in ways if place == _ROOT), ())
            if waiting:
                self._at_end[:, found] = self._note(waiting)
        return found

    def _side_by_side(self, left: int, right: int) -> bool:
        first, second = self._token[left], self._token[right]
        if first + second in self._merges.ranks:
            return False
        return self._merges.apply(first + second) == [first, second]

    def _follow(self, state: int, byte: int) -> tuple[tuple[_Way, ...], tuple[int, ...]]:
        """Where a byte leads from a state, and the tokens that are certain by then."""
        onward: list[_Way] = []
        done: _Way | None = None
        for waiting, last, place in self._ways[state]:
            place = self._child.get(place << 8 | byte)
            if place is None:
                continue
            if self._open[place]:
                onward.append((waiting, last, place))
            token = self._ends[place]
            if done is None and token >= 0 and (last < 0 or self._fits[last, token]):
                done = ((*waiting, token), token, _ROOT)
        if done is None:
            raise ValueError("the merges of these ranks are no chain of neighbours that fit")
        onward.append(done)
        certain = 0
        shortest = min(onward, key=lambda way: len(way[0]))[0]
        while certain < len(shortest) and all(w[0][certain] == shortest[certain] for w in onward):
            certain += 1
        ways = tuple((waiting[certain:], last, place) for waiting, last, place in onward)
        return ways, shortest[:certain]

    def _new_step(self, key: int) -> None:
        if self._held >= self._most:
            raise _Full
        ways, written = self._follow(key >> 8, key & 255)
        step = self._held
        self._to[step] = self._state(ways)
        if written:
            self._written[:, step] = self._note(written)
        # As ``_slot_of``, for one key.
        slot = (key * _MIXER & _LOW_64) >> (64 - self._bits)
        while self._slots[slot] >= 0:
            slot = (slot + 1) & (len(self._slots) - 1)
        self._slots[slot], self._step_at[slot] = key, step
        self._held += 1

    def _slot_of(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(_MIXER)
        return (mixed >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Step of each key; -1 where there is none yet."""
        found = np.full(len(keys), -1, np.int64)
        asked, slots = np.arange(len(keys)), self._slot_of(keys)
        while len(asked):
            held = self._slots[slots]
            hit = held == keys[asked]
            found[asked[hit]] = self._step_at[slots[hit]]
            on = ~hit & (held >= 0)
            asked, slots = asked[on], (slots[on] + 1) & (len(self._slots) - 1)
        return found

    def _steps(self, states: np.ndarray, column: np.ndarray) -> np.ndarray:
        keys = states.astype(np.int64) << 8 | column
        steps = self._find(keys)
        lacking = steps < 0
        if lacking.any():
            for key in np.unique(keys[lacking]).tolist():
                self._new_step(key)
            steps[lacking] = self._find(keys[lacking])
        return steps

    def all_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in ascending order, end to end, and where each begins.

        All pieces take their next step together, and those with the same beginning
        take it as one.
        """
        try:
            return self._walk(pieces)
        except _Full:
            self._restart()
        if len(pieces) == 1:
            return self._alone(pieces[0])
        half = len(pieces) // 2
        (first, starts), (second, more) = self.all_ids(pieces[:half]), self.all_ids(pieces[half:])
        return np.concatenate((first, second)), np.concatenate((starts, len(first) + more[1:]))

    def _alone(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """One piece that takes more steps than the table holds: no step is kept."""
        ways, out = self._ways[self._start], []
        for byte in piece:
            self._restart()
            ways, written = self._follow(self._state(ways), byte)
            out += written
        out += next(w for w, _, place in ways if place == _ROOT)
        return np.array(out, np.int32), np.array([0, len(out)])

    def _walk(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max(initial=1))
        table = np.array(pieces, f"S{width}").view(np.uint8).reshape(len(pieces), width)
        shared = np.zeros(len(pieces), np.int64)
        differ = table[1:] != table[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]), out=shared[1:])
        order = np.arange(len(pieces))
        states = np.full(len(pieces), self._start, np.int32)
        taken = np.full((len(pieces), width), -1, np.int32)
        for k in range(width):
            active = sizes > k
            leads = np.flatnonzero(active & (shared <= k))
            taken[leads, k] = self._steps(states[leads], table[leads, k])
            lead = np.zeros(len(pieces), np.int64)
            lead[leads] = leads
            np.maximum.accumulate(lead, out=lead)
            rows = order[active]
            taken[rows, k] = taken[lead[rows], k]
            states[rows] = self._to[taken[rows, k]]
        at = np.concatenate((self._written[0][taken], self._at_end[0][states][:, None]), axis=1)
        n = np.concatenate((self._written[1][taken], self._at_end[1][states][:, None]), axis=1)
        n[:, :-1][taken < 0] = 0
        starts = np.concatenate(([0], np.cumsum(n.sum(axis=1))))
        at, n = at.ravel(), n.ravel().astype(np.int64)
        shift = np.repeat(at - (np.cumsum(n) - n), n)
        return self._tokens[shift + np.arange(starts[-1])], starts

    def ids(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.all_ids([data])[0].tolist() if data else []


class RankEncoder:
    """Whole texts: each match of ``pattern`` goes through the transducer on its own.

    Texts are taken in groups of about ``group_chars``, and what occurs many times in
    a group is encoded once. A longer text is a group for every so many matches. Ids of
    up to twice ``held`` matches, none longer than ``longest``, are known from group to group.
    """

    def __init__(
        self,
        ranks: dict[bytes, int],
        pattern: str,
        most: int = 600_000,
        group_chars: int = 1 << 22,
        held: int = 200_000,
        longest: int = 64,
    ):
        self._pattern, self._group_chars = regex.compile(pattern), group_chars
        self.transducer = Transducer(ranks, most)
        self._memo, self._longest = Memo(self._alone, held), longest

    def all_ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; special tokens have none."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            if len(text) > self._group_chars:
                yield from self._encoded(group)
                yield b"".join(b for part in self._parts(text) for b in self._encoded([part]))
                group, held = [], 0
                continue
            group.append(self._pattern.findall(text))
            held += len(text)
            if held >= self._group_chars:
                yield from self._encoded(group)
                group, held = [], 0
        yield from self._encoded(group)

    def encode(self, text: str) -> bytes:
        return next(self.all_ids([text]))

    def _parts(self, text: str) -> Iterator[list[str]]:
        found = self._pattern.finditer(text)
        while part := [match[0] for match in islice(found, self._group_chars >> 3)]:
            yield part

    def _alone(self, piece: str) -> bytes:
        return self.transducer.all_ids([piece.encode("utf-8")])[0].astype("<u4").tobytes()

    def _encoded(self, group: list[list[str]]) -> Iterator[bytes]:
        pieces: set[str] = set().union(*group)
        long = {p for p in pieces if len(p) > self._longest}
        self._memo.put_all(dict(self._walked(self._memo.lacks(pieces - long))))
        known, own = self._memo.__getitem__, dict(self._walked(long))
        for pieces in group:
            if own and not own.keys().isdisjoint(pieces):
                yield b"".join([own[p] if p in own else known(p) for p in pieces])
            else:
                yield b"".join(map(known, pieces))

    def _walked(self, pieces: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Every piece and its ids. Pieces of a table are of like size, so that it has few empty places."""
        by_size: dict[int, list[str]] = {}
        for piece in sorted(pieces):
            by_size.setdefault(max(32, 1 << (len(piece) - 1).bit_length()), []).append(piece)
        for size, alike in by_size.items():
            many = max(1, (1 << 22) // size)
            for low in range(0, len(alike), many):
                part = alike[low : low + many]
                ids, starts = self.transducer.all_ids([piece.encode("utf-8") for piece in part])
                raw, starts = ids.astype("<u4").tobytes(), (4 * starts).tolist()
                for piece, at, end in zip(part, starts, starts[1:]):
                    yield piece, raw[at:end]


# Fixed values, from the definition of UTF-8: the bytes that may follow a leading byte
# first (others follow from 0x80 to 0xBF), and how many bytes follow it.
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}
_FOLLOWING = [(0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)]


class Utf8Stream:
    """Text of bytes that arrive in portions.

    The state is the bytes of a character begun: how many are missing, and what the
    next may be. Bytes that can't go on or begin a character become U+FFFD, one for
    each longest beginning of a character, as in a decoder that sees all at once.
    """

    def __init__(self) -> None:
        self._begun = b""

    @staticmethod
    def open_at_end(data: bytes) -> int:
        """Bytes at the end of ``data`` that a further portion may make a character of."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            missing = next((n for low, high, n in _FOLLOWING if low <= lead <= high), 0)
            if missing < back:
                return 0
            low, high = _SECOND.get(lead, (0x80, 0xBF))
            return back if back == 1 or low <= data[1 - back] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        """The characters that are complete now."""
        data = self._begun + data
        held = self.open_at_end(data)
        whole = len(data) - held
        self._begun = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def close(self) -> str:
        """What the end of the stream makes of a character begun."""
        rest, self._begun = self._begun, b""
        return rest.decode("utf-8", "replace")


class RankDecoder:
    """Bytes and text of token ids, a portion at a time."""

    def __init__(self, ranks: dict[bytes, int], portion: int = 4096):
        self._token = {r: t for t, r in ranks.items()}
        self._portion = portion

    def portions(self, ids: np.ndarray) -> Iterator[bytes]:
        token = self._token.__getitem__
        for at in range(0, len(ids), self._portion):
            yield b"".join(map(token, ids[at : at + self._portion].tolist()))

    def text(self, portions: Iterable[bytes]) -> Iterator[str]:
        stream = Utf8Stream()
        yield from map(stream.feed, portions)
        yield stream.close()


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> RankEncoder:
    """One for each Python worker, so steps are known from task to task."""
    return RankEncoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _decoder(path: str) -> RankDecoder:
    return RankDecoder(read_ranks(path))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers as bytes) of every row.

    ``path`` is a rank file that every node has, ``pattern`` cuts texts before the
    merges. Null and empty texts have no ids. Null, repeated and tied ids are encoded like any
    other row, an empty table gives none, further columns are not looked at.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            ids = list(encoder.all_ids(batch["text"].to_pylist()))
            yield {"doc_id": batch["doc_id"], "ids": ids}

    return map_rows(documents(docs, id_col, text_col), uncollected(run), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids decode to an empty text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        decoder = _decoder(path)
        for batch in batches:
            ids = (np.frombuffer(x or b"", "<u4") for x in batch["ids"].to_pylist())
            texts = ["".join(decoder.text(decoder.portions(x))) for x in ids]
            yield {"doc_id": batch["doc_id"], "text": texts}

    return map_rows(encoded.select("doc_id", "ids"), uncollected(run), "doc_id long, text string")


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, then its ids decoded.

    One pass: the ids of a text go to the streaming decoder portion by portion. Null,
    empty and repeated rows as for ``encode_documents``.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder, decoder = _encoder(path, pattern), _decoder(path)
        for batch in batches:
            ids = list(encoder.all_ids(batch["text"].to_pylist()))
            decoded = []
            for x in ids:
                digest = hashlib.sha256()
                for text in decoder.text(decoder.portions(np.frombuffer(x, "<u4"))):
                    digest.update(text.encode("utf-8"))
                decoded.append(digest.hexdigest())
            yield {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": decoded,
            }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(documents(docs, id_col, text_col), uncollected(run), schema)
