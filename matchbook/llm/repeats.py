"""Suffix-array dedup: every byte of a string of ``size`` bytes that occurs more than once.

The text of all documents is cut into blocks of neighbouring windows with the same
anchor (the smallest gram of a window by hash), so equal windows are in blocks of one
anchor and nothing has to be compared across anchors. Equal blocks collapse to one,
with a count, before the shuffle. The texts of the blocks left are dealt to shards by
anchor, and each shard is sorted by external induction with common prefixes
(``induced``): a window whose suffix shares ``size`` bytes with a neighbour's repeats.

A window has half of its other bytes on one side of its anchor, so only blocks that
share those bytes with another block, on either side, are sorted at all.

An anchor with very many different blocks (the border of a passage that a large share
of all documents has) isn't sorted in one shard: its blocks are cut into short ones at
fixed places from the anchor, which collapse like blocks do, and of those that are left
the windows are dealt by their own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.induced import repeated_positions
from matchbook.llm.texts import (
    Rolling,
    anchors,
    byte_prefix,
    keyed_documents,
    map_rows,
    runs,
    same_document,
)
from matchbook.runtime import cut, let_go

GRAM = 32
#: Windows looked at together in a long text.
CHUNK = 1 << 20
#: Windows in the short blocks of a hot anchor.
STEP = 8


def _blocks_of(data: bytes, size: int, rolling: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchor, content, at, n, left, right`` of the blocks of a text, in chunks of its windows.

    Where a chunk ends a block is cut in two; its windows still have the same anchor.
    ``left`` and ``right`` are hashes of the anchor with the half window on that side of
    it; where a block has no so many bytes there, its content stands in, which no
    other block of the anchor has.
    """
    half = (size - GRAM) // 2
    for low in range(0, len(data) - size + 1, CHUNK):
        prefix = byte_prefix(data[low : low + CHUNK + size - 1], rolling)
        grams = rolling.windows(prefix, GRAM)
        at = anchors(grams, size - GRAM + 1)
        starts, ends = runs(at)
        place, stops = at[starts], ends - 1 + size
        content = rolling.spans(prefix, starts, stops)
        left, right = content.copy(), content.copy()
        whole = place - half >= starts
        left[whole] = rolling.spans(prefix, place[whole] - half, place[whole] + GRAM)
        whole = place + GRAM + half <= stops
        right[whole] = rolling.spans(prefix, place[whole], place[whole] + GRAM + half)
        hashes = (h.view(np.int64) for h in (grams[place], content, left, right))
        anchor, content, left, right = hashes
        yield anchor, content, low + starts, ends - starts, left, right


def blocks(keyed: DataFrame, size: int) -> DataFrame:
    """``anchor, content, doc_id, text_key, at, n, left, right``: ``n`` windows from byte ``at`` on."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rolling = Rolling()
        for batch in batches:
            of, found = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for part in _blocks_of(text.encode(), size, rolling):
                    of.append(np.full(len(part[0]), i))
                    found.append(part)
            if not of:
                continue
            take = pa.array(np.concatenate(of))
            columns = [np.concatenate(c) for c in zip(*found)]
            yield dict(zip(("anchor", "content", "at", "n", "left", "right"), columns)) | {
                n: batch[n].take(take) for n in ("doc_id", "text_key")
            }

    schema = (
        "anchor long, content long, doc_id long, text_key long, at long, n int, left long, right long"
    )
    return map_rows(keyed, run, schema)


def _short_blocks(data: bytes, size: int, rolling: Rolling) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``part, at, content, hashes`` of a block cut at fixed places from its anchor."""
    prefix = byte_prefix(data, rolling)
    span = size - GRAM + 1
    anchor = int(anchors(rolling.windows(prefix, GRAM)[:span], span)[0])
    windows = rolling.windows(prefix, size)
    part = (np.arange(len(windows)) - anchor) // STEP
    starts, ends = runs(part)
    contents = rolling.spans(rolling.prefix(windows), starts, ends).view(np.int64)
    for a, b, content in zip(starts.tolist(), ends.tolist(), contents.tolist()):
        yield int(part[a]), a, content, windows[a:b].view(np.int64)


def _block_texts(texts: DataFrame, size: int) -> DataFrame:
    """Rows of ``places`` with their text, or those of ``hot`` anchors as short blocks.

    Short blocks have ``part`` and ``content``, and the ``hashes`` of their windows.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rolling = Rolling()
        for batch in batches:
            of, rows = [], []
            for i, (text, listed) in enumerate(zip(batch["text"].to_pylist(), batch["places"].to_pylist())):
                raw = text.encode()
                for p in listed:
                    data = raw[p["at"] : p["at"] + p["n"] - 1 + size]
                    if not p["hot"]:
                        rows.append((p["anchor"], p["at"], p["n"], p["repeated"], data, None, None, None))
                        of.append(i)
                        continue
                    for part, at, content, hashes in _short_blocks(data, size, rolling):
                        place = p["at"] + at
                        rows.append((p["anchor"], place, len(hashes), p["repeated"], None, part, content, hashes))
                        of.append(i)
            take = pa.array(of, pa.int64())
            names = ("anchor", "at", "n", "repeated", "data", "part", "content", "hashes")
            yield {n: batch[n].take(take) for n in ("doc_id", "text_key")} | {
                n: [row[k] for row in rows] for k, n in enumerate(names)
            }

    schema = (
        "doc_id long, text_key long, anchor long, at long, n int, repeated boolean, data binary, "
        "part int, content long, hashes array<long>"
    )
    return map_rows(texts, run, schema)


def _hot_windows(short: DataFrame) -> DataFrame:
    """``doc_id, text_key, at, n``: repeated windows of short blocks, of rows not ``repeated`` whole."""
    key = ["anchor", "part", "content"]
    row = F.struct("doc_id", "text_key", "at", "n", "repeated", "hashes")
    contents = short.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.first(row).alias("one"))
    several = contents.filter("rows > 1").select(*key)
    whole = short.filter("not repeated").join(several, key).select("doc_id", "text_key", "at", "n")
    windows = contents.select(
        "one.doc_id",
        "one.text_key",
        "one.at",
        (F.col("one.repeated") | (F.col("rows") > 1)).alias("done"),
        F.posexplode("one.hashes").alias("nth", "hash"),
    )
    counts = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    single = windows.filter("not done").join(counts, "hash").select(
        "doc_id", "text_key", (F.col("at") + F.col("nth")).alias("at"), F.lit(1).alias("n")
    )
    return whole.unionByName(single)


def _sorted_shards(rows: DataFrame, size: int, budget: int) -> DataFrame:
    """``doc_id, text_key, at, n``: repeated windows of the blocks that are not repeated whole."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = list(batches)
        if not held:
            return
        columns = {n: pa.chunked_array([b[n] for b in held]) for n in held[0]}
        parts = columns.pop("data").to_pylist()
        if not parts:
            return
        # Bytes of UTF-8 are below 255, so they move up by one and 0 parts the blocks.
        lengths = np.array([len(p) + 1 for p in parts])
        text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
        del parts
        begins = np.cumsum(lengths) - lengths
        found = repeated_positions(text, size, budget=budget)
        block = np.searchsorted(begins, found, "right") - 1
        inside = found - begins[block]
        repeated = columns["repeated"].to_numpy()
        good = (inside < columns["n"].to_numpy()[block]) & ~repeated[block]
        block, inside = block[good], inside[good]
        # Windows side by side in a block make one row.
        head = np.ones(len(block), bool)
        head[1:] = (block[1:] != block[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(head)
        n = np.diff(np.append(first, len(block)))
        take = pa.array(block[first])
        yield {n_: columns[n_].take(take).combine_chunks() for n_ in ("doc_id", "text_key")} | {
            "at": columns["at"].to_numpy()[block[first]] + inside[first],
            "n": n,
        }

    return map_rows(rows, run, "doc_id long, text_key long, at long, n int")


def repeated_windows(
    docs: DataFrame,
    size: int = 400,
    hot_blocks: int = 1000,
    shard_bytes: int = 4 << 20,
    budget: int = 64 << 20,
    **columns,
) -> DataFrame:
    """``doc_id, text_key, at, n``: ``n`` windows of ``size`` bytes from ``at`` on occur elsewhere too.

    Shards hold about ``shard_bytes`` of text; one that is larger spills its tuples beyond ``budget``.
    """
    if size < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes have no anchors")
    keyed = keyed_documents(docs, **columns)
    every = blocks(keyed, size)
    # Most anchors are met once. Anchors alone tell which, and only the others' blocks are kept.
    met = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    found, _ = cut(every.join(met.select("anchor"), "anchor"))
    let_go(docs.sparkSession)
    contents = found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct("doc_id", "text_key", "at", "n")).alias("first"),
        F.min("left").alias("left"),  # equal for equal contents
        F.min("right").alias("right"),
    )
    whole = found.join(
        contents.filter(F.col("rows") > 1).select("anchor", "content"), ["anchor", "content"]
    ).select("doc_id", "text_key", "at", "n")

    # One holder of each content, where an anchor has several that share a side.
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    holders, _ = cut(
        contents.join(several, "anchor").select(
            "anchor",
            "left",
            "right",
            "first.*",
            (F.col("rows") > 1).alias("repeated"),
            (F.col("contents") > hot_blocks).alias("hot"),
        )
    )
    for side in ("left", "right"):
        shared = holders.groupBy("anchor", side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = shared.select("anchor", side, F.lit(True).alias(f"shares_{side}"))
        holders = holders.join(shared, ["anchor", side], "left")
    holders = holders.filter("shares_left or shares_right")
    listed = holders.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("anchor", "at", "n", "repeated", "hot")).alias("places")  # of one document
    )
    texts = keyed.join(listed, same_document(keyed, listed)).select(
        keyed["doc_id"], keyed["text_key"], "text", "places"
    )
    pieces, seen = cut(
        _block_texts(texts, size), bytes=F.sum(F.length("data")), hot=F.count("part")
    )
    let_go(docs.sparkSession)
    shards = max(1, -(-(seen["bytes"] or 0) // shard_bytes))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.filter(F.col("data").isNotNull()).drop("part", "content", "hashes")
    single = _sorted_shards(dealt.repartition(max(shards, width), "anchor"), size, budget)
    out = whole.unionByName(single)
    if seen["hot"]:
        out = out.unionByName(_hot_windows(pieces.filter(F.col("part").isNotNull()).drop("data")))
    return out


def repeated_spans(docs: DataFrame, size: int = 400, **options) -> DataFrame:
    """``doc_id, text_key, spans``: per document with any, the byte ranges ``(start, end)`` to remove.

    A byte goes if a string of ``size`` bytes that covers it starts anywhere else, in
    the same document or row that repeats it too; ranges that touch are one. Texts are read as UTF-8; null,
    empty and shorter ones have no range. Null ids are documents like others.
    """
    pieces = repeated_windows(docs, size, **options)
    # As many pieces as a document has windows, at most.
    grouped = pieces.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("pieces"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            spans = []
            for listed in batch["pieces"].to_pylist():
                joined: list[list[int]] = []
                for at, n in sorted((p["at"], p["n"]) for p in listed):
                    end = at + n - 1 + size
                    if joined and at <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], end)
                    else:
                        joined.append([at, end])
                spans.append([{"start": a, "end": b} for a, b in joined])
            yield {n: batch[n] for n in ("doc_id", "text_key")} | {"spans": spans}

    schema = "doc_id long, text_key long, spans array<struct<start:long,end:long>>"
    return map_rows(grouped, run, schema)


def remove_spans(docs: DataFrame, found: DataFrame, **columns) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, without its ranges."""
    keyed = keyed_documents(docs, **columns)
    joined = keyed.join(found, same_document(keyed, found), "left")
    joined = joined.select(keyed["doc_id"], "text", "spans")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                data, at, kept = text.encode(), 0, hashlib.sha256()
                removed = 0
                for span in spans or ():
                    kept.update(data[at : span["start"]])
                    at = span["end"]
                    removed += span["end"] - span["start"]
                kept.update(data[at:])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(removed)
                out["n_spans"].append(len(spans or ()))
                out["kept_sha256"].append(kept.hexdigest())
            yield {"doc_id": batch["doc_id"]} | out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_rows(joined, run, schema)
