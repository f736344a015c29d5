"""Line deduplication: hashes dealt by range, streamed in order, answered as bitmaps.

One row per document and distinct line goes to the shuffle: a 128-bit hash of the
line, the document's key and the line's positions. Rows are range-partitioned and
sorted by hash, document and position, so a task streams the documents of a line
in order. A line of many documents spans several partitions; what its parts must
know of each other is one row per partition. The answer is a compressed bitmap of
kept lines per document; no text is shuffled to find it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.texts import BLANKS, keyed_documents, map_rows, runs, same_document
from matchbook.runtime import cut

_ORDER = ["h1", "h2", "doc_id", "text_key"]


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends, A-Z as a-z."""
    return line.strip(BLANKS).lower()


def line_rows(keyed: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, doc_id, text_key, positions``: a row per document and distinct line key.

    Keys of fewer than ``min_chars`` code points have no row.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            h1, h2, of, positions = [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                places: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.encode().split(b"\n")):
                    places.setdefault(line_key(line), []).append(at)
                for key, found in places.items():
                    if len(key) < min_chars or len(key.decode()) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_digest(key)
                    h1.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    of.append(i)
                    positions.append(found)
            of = pa.array(of, pa.int64())
            yield {
                "h1": h1,
                "h2": h2,
                "doc_id": batch["doc_id"].take(of),
                "text_key": batch["text_key"].take(of),
                "positions": positions,
            }

    schema = "h1 long, h2 long, doc_id long, text_key long, positions array<int>"
    return map_rows(keyed, run, schema)


def _columns(batches: Iterator[dict]) -> dict | None:
    """All batches of a partition as one; ``doc`` numbers runs of the same line and document."""
    held = list(batches)
    if not held:
        return None
    out = {n: pa.chunked_array([b[n] for b in held]).combine_chunks() for n in held[0]}
    h = np.stack([out["h1"].to_numpy(), out["h2"].to_numpy()])
    ids = out["doc_id"].fill_null(0).to_numpy()
    known = out["doc_id"].is_valid().to_numpy(zero_copy_only=False)
    keys = np.stack([*h, ids, known.astype(np.int64), out["text_key"].to_numpy()])
    change = np.ones(keys.shape[1], bool)
    change[1:] = (h[:, 1:] != h[:, :-1]).any(0)
    new_doc = np.ones(keys.shape[1], bool)
    new_doc[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
    out["line"], out["new_doc"], out["h"] = np.cumsum(change) - 1, new_doc, h
    return out


def _borders(ordered: DataFrame) -> list[dict]:
    """For each partition with rows: its first and last line, and their numbers of documents."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows = _columns(batches)
        if rows is None:
            return
        n_docs = np.bincount(rows["line"], rows["new_doc"]).astype(np.int64)
        yield {
            "part": [TaskContext.get().partitionId()],
            "first": [rows["h"][:, 0].tolist()],
            "last": [rows["h"][:, -1].tolist()],
            "n_first": [int(n_docs[0])],
            "n_last": [int(n_docs[-1])],
        }

    schema = "part int, first array<long>, last array<long>, n_first long, n_last long"
    return sorted((r.asDict() for r in map_rows(ordered, run, schema).collect()), key=lambda r: r["part"])


def _carried(borders: list[dict]) -> dict[int, tuple[int, int, int, int]]:
    """Documents of a partition's first and last line in the partitions before and after it."""
    n = len(borders)
    out = {}
    for i, b in enumerate(borders):
        whole = b["first"] == b["last"]
        before = after = 0
        j = i - 1
        while j >= 0 and borders[j]["last"] == b["first"]:
            before += borders[j]["n_last"]
            if borders[j]["first"] != b["first"]:
                break
            j -= 1
        j = i + 1
        while j < n and borders[j]["first"] == b["last"]:
            after += borders[j]["n_first"]
            if borders[j]["last"] != b["last"]:
                break
            j += 1
        out[b["part"]] = (before, after if whole else 0, before if whole else 0, after)
    return out


def dropped_lines(
    keyed: DataFrame, min_docs: int, min_chars: int = 1, keep_first: bool = False
) -> DataFrame:
    """``doc_id, text_key, positions`` of lines to drop, a row per document that has any.

    Lines found in at least ``min_docs`` documents are dropped; with ``keep_first``,
    all but their first occurrence, by document (null ids first) and position.
    """
    rows = line_rows(keyed, min_chars).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    # Both passes must see the same partitions, also after a lost executor.
    ordered, _ = cut(rows)
    # A row per partition: what crosses its borders.
    carried = _carried(_borders(ordered))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows = _columns(batches)
        if rows is None:
            return
        line = rows["line"]
        n_docs = np.bincount(line, rows["new_doc"]).astype(np.int64)
        before = np.zeros(len(n_docs), np.int64)
        head, head_after, tail_before, tail = carried[TaskContext.get().partitionId()]
        before[0] += head
        n_docs[0] += head + head_after
        if len(n_docs) > 1:
            n_docs[-1] += tail + tail_before
        out = n_docs[line] >= min_docs
        positions = rows["positions"]
        if keep_first:
            first = np.zeros(len(line), bool)
            starts, _ = runs(line)
            first[starts[before == 0]] = True
            kept = np.flatnonzero(first & out)
            lists = positions.to_pylist()
            for i in kept:
                lists[i] = lists[i][1:]
            positions = pa.array(lists, pa.list_(pa.int32()))
        take = pa.array(np.flatnonzero(out))
        yield {n: rows[n].take(take) for n in ("doc_id", "text_key")} | {
            "positions": positions.take(take)
        }

    found = map_rows(ordered, run, "doc_id long, text_key long, positions array<int>")
    # A document is as wide as its lines: its positions fit where its text does.
    return found.groupBy("doc_id", "text_key").agg(
        F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions")
    )


def _bitmaps(sizes: DataFrame) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            keep_all = []
            for n, dropped in zip(batch["n_lines"].to_pylist(), batch["positions"].to_pylist()):
                keep = np.ones(n, bool)
                keep[np.array(dropped or [], np.int64)] = False
                keep_all.append(keep)
            yield {n: batch[n] for n in ("doc_id", "text_key", "n_lines")} | {
                "n_dropped": [int(len(k) - k.sum()) for k in keep_all],
                "keep": [zlib.compress(np.packbits(k).tobytes()) for k in keep_all],
            }

    return map_rows(sizes, run, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def read_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines) > 0


def keep_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    r"""``doc_id, text_key, n_lines, n_dropped, keep``: a row per distinct document.

    ``keep`` is a zlib-compressed bitmap of the lines (``\n`` between them) to keep.
    Null and empty texts have one empty line. Rows that repeat id and text count
    as one document; rows with a null id are documents told apart by their text.
    An empty table gives an empty table.
    """
    keyed = keyed_documents(docs, id_col, text_col)
    drops = dropped_lines(keyed, min_docs, min_chars, keep_first)
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    sizes = keyed.select("doc_id", "text_key", lines.alias("n_lines")).distinct()
    joined = sizes.join(drops, same_document(sizes, drops), "left")
    return _bitmaps(joined.select(sizes["doc_id"], sizes["text_key"], "n_lines", "positions"))


def _kept(text: str, bitmap: bytes, n_lines: int) -> str:
    keep = read_bitmap(bitmap, n_lines)
    if keep.all():
        return text
    return "\n".join(line for line, k in zip(text.split("\n"), keep) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row, by its bitmap."""
    keyed = keyed_documents(docs)
    joined = keyed.join(bitmaps, same_document(keyed, bitmaps))
    joined = joined.select(keyed["doc_id"], "n_lines", "n_dropped", "text", "keep")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = zip(*(batch[n].to_pylist() for n in ("text", "keep", "n_lines")))
            yield {n: batch[n] for n in ("doc_id", "n_lines", "n_dropped")} | {
                "kept_sha256": [hashlib.sha256(_kept(*row).encode()).hexdigest() for row in rows]
            }

    return map_rows(joined, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` (and ``n_chars``, where it has one) cut to the kept lines.

    Texts that lose nothing stay as they are, null ones included.
    """
    names = docs.columns
    own = docs.select(
        F.struct(*(docs[n] for n in names)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    joined = own.join(bitmaps, same_document(own, bitmaps))

    def kept(texts: pd.Series, keeps: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_kept(*row) for row in zip(texts, keeps, sizes)], dtype=object)

    shorter = F.pandas_udf(kept, "string")(F.coalesce("row.text", F.lit("")), "keep", "n_lines")
    text = F.when(F.col("n_dropped") > 0, shorter).otherwise(F.col("row.text"))
    cut_rows = joined.select("row", text.alias("kept"), "n_dropped")
    columns = []
    for n in names:
        column = F.col("row")[n]
        if n == "text":
            column = F.col("kept")
        elif n == "n_chars":
            column = F.when(
                F.col("n_dropped") > 0, F.length("kept").cast(docs.schema[n].dataType)
            ).otherwise(column)
        columns.append(column.alias(n))
    return cut_rows.select(*columns)
