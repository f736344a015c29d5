"""What the operators on documents share: the columns they read, row identity, word hashes.

Every operator selects the columns it needs under names of its own first, so extra
columns of the input, whatever their names, never meet those of an operator.

A document is known by its id and a hash of its text. Rows that repeat both are
one document that occurs several times; each row gets the same answer. Ids may
be null, and rows with the same id may hold different texts.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these; lines are stripped of them.
BLANKS = b" \t\n\x0b\x0c\r"

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of every row, null text read as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, text``; the first two name the document."""
    return documents(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text"
    )


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def map_rows(
    df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str
) -> DataFrame:
    """``mapInArrow`` over batches seen as dicts of Arrow columns; ``fn`` yields such dicts.

    Columns that ``fn`` yields may be lists, numpy arrays or Arrow arrays.
    """
    target = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns):
            arrays = [_array(out[field.name], field.type) for field in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def parts(batches: Iterator[dict], rows: int) -> Iterator[dict]:
    """The same rows in batches of at most ``rows``, so that less of what is made of them lies in memory."""
    for batch in batches:
        n = len(next(iter(batch.values())))
        for at in range(0, n, rows):
            yield {name: column.slice(at, rows) for name, column in batch.items()}


def uncollected(fn: Callable[[Iterator[dict]], Iterator[dict]]) -> Callable:
    """``fn`` while the collector of reference cycles rests.

    For work that makes many small objects and no cycles: the collector would visit all
    of them over and over and find nothing.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        resting = not gc.isenabled()
        gc.disable()
        try:
            yield from fn(batches)
        finally:
            if not resting:
                gc.enable()

    return run


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values
    if isinstance(values, np.ndarray):
        return pa.array(values).cast(kind) if values.dtype != object else pa.array(list(values), kind)
    return pa.array(values, kind)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class Memo(dict):
    """A dict that works out what it lacks and holds at most twice ``most`` entries.

    When it has grown to ``most`` it sets its entries aside, and takes those that are
    asked for again back, so frequent keys stay.
    """

    def __init__(self, work: Callable, most: int = 300_000):
        super().__init__()
        self._work, self._most, self._aside = work, most, {}

    def __missing__(self, key):
        value = self._aside.get(key)
        if value is None:
            value = self._work(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self._most:
            self._turn()
        self[key] = value

    def put_all(self, entries: dict) -> None:
        if len(self) + len(entries) > self._most:
            self._turn()
        self.update(entries)

    def _turn(self) -> None:
        self._aside = dict(self)
        self.clear()

    def lacks(self, keys: set) -> list:
        """Keys without an entry. Those of the others that were set aside are taken back, all at once."""
        new = keys.difference(self)
        lacking = new.difference(self._aside)
        self.put_all({k: self._aside[k] for k in new - lacking})
        return list(lacking)


class Rolling:
    """Hashes of windows over a sequence of 64-bit symbols, as a polynomial modulo 2**64.

    Windows are short and symbols well mixed, so the low degree cannot be played on.
    """

    def __init__(self) -> None:
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._power) >= n:
            return
        n = max(n, 2 * len(self._power))
        with np.errstate(over="ignore"):
            for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Sums from which ``windows`` takes differences."""
        n = len(symbols)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self._power[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` symbols from each position where so many are left."""
        n = len(prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[size:] - prefix[:n]) * self._inverse[:n])

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the symbols from each start to its end."""
        return mix((prefix[ends] - prefix[starts]) * self._inverse[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all bits (the finaliser of MurmurHash3, fixed values)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(BLANKS)] = False


def byte_prefix(data: bytes, rolling: Rolling) -> np.ndarray:
    """Prefix sums over the bytes of a text."""
    return rolling.prefix(_BYTES[np.frombuffer(data, np.uint8)])


def word_hashes(data: bytes, rolling: Rolling) -> np.ndarray:
    """Hash of each word, from the sums at its ends: no word becomes an object of its own."""
    inside = _IN_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return rolling.spans(byte_prefix(data, rolling), edges[::2], edges[1::2])


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest of each ``window`` neighbouring gram hashes (leftmost of equals).

    Equal stretches of text choose the same grams, so two texts that share all of
    a window share its anchor. Only the upper half of a hash is compared.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < window:
        step = min(span, window - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return (best & low).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], edge)), np.concatenate((edge, [len(values)]))
