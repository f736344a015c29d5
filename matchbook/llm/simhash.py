"""SimHash near-duplicates: pigeonhole blocks find the pairs, Hamming distance verifies them.

Two fingerprints of 64 bits that differ in at most ``d`` bits agree in at least
``blocks - d`` of any ``blocks`` blocks. One table per choice of so many blocks
holds every fingerprint by the bits of those blocks, so each close pair meets in
some table, and with wide keys few others do. Distinct fingerprints are linked,
not documents; a group of near copies gives as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.texts import keyed_documents, map_rows, same_document
from matchbook.operators.components import connected_groups
from matchbook.runtime import cut

SEED = 42
BITS = 64


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats counted; 0 without words.

    A-Z are lower-cased; a text of fewer words than a shingle is one shingle. A bit
    is set if more than half of the shingles' XXH64 have it.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    # The words between single spaces; a shingle is a slice of them.
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())),
        np.uint64,
        len(starts),
    )
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, text_key, fp`` of every row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            marks = [fingerprint(text, shingle) for text in batch["text"].to_pylist()]
            yield {
                "doc_id": batch["doc_id"],
                "text_key": batch["text_key"],
                "fp": np.array(marks, np.uint64).view(np.int64),
            }

    schema = "doc_id long, text_key long, fp long"
    return map_rows(keyed_documents(docs, id_col, text_col), run, schema)


def _bounds(blocks: int, low: int = 0, high: int = BITS) -> list[tuple[int, int]]:
    edges = np.linspace(low, high, blocks + 1).round().astype(int).tolist()
    return list(zip(edges, edges[1:]))


def _mask(bounds: list[tuple[int, int]]) -> int:
    mask = sum(((1 << (b - a)) - 1) << a for a, b in bounds)
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _masked(masks: list[int]) -> Column:
    """An array of ``(table, key)``: the bits of the fingerprint under each mask."""
    return F.array(
        *(
            F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for t, m in enumerate(masks)
        )
    )


def near_pairs(
    marks: DataFrame, max_bits: int = 3, blocks: int = 6, bucket_rows: int = 4096
) -> DataFrame:
    """``src, dst``: links of distinct fingerprints ``fp`` within ``max_bits``.

    Links join up exactly what the relation joins up: in each bucket, a
    spanning forest of its close pairs. A bucket of more than ``bucket_rows`` is
    split once more, by blocks of the bits that its key leaves open, in which
    close pairs share a block again. Fewer ``blocks`` mean fewer tables and wider buckets.
    """
    if not 0 <= max_bits < blocks:
        raise ValueError("there must be more blocks than differing bits")
    chosen = list(combinations(_bounds(blocks), blocks - max_bits))
    masks = [_mask(list(c)) for c in chosen]
    rows = marks.select("fp", F.explode(_masked(masks)).alias("at")).select(
        F.col("at.table").alias("table"), F.col("at.key").alias("key"), "fp", F.lit(0).alias("part")
    )
    sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > bucket_rows).select("table", "key", F.lit(True).alias("large"))
    rows = rows.join(large, ["table", "key"], "left")
    small = rows.filter(F.col("large").isNull()).select("table", "key", "fp", "part")
    finer = rows.filter("large").select(
        "table", "fp", F.explode(_finer(chosen, max_bits)).alias("at")
    )
    finer = finer.select("table", F.col("at.key").alias("key"), "fp", F.col("at.part").alias("part"))
    buckets = small.unionByName(finer).repartition("table", "part", "key")
    buckets = buckets.sortWithinPartitions("table", "part", "key", "fp")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rest = None
        for batch in batches:
            here = np.stack([batch[n].to_numpy().astype(np.int64) for n in ("table", "part", "key", "fp")])
            if rest is not None:
                here = np.concatenate([rest, here], axis=1)
            if not here.shape[1]:
                continue
            # The last bucket may go on in the next batch.
            last = (here[:3] != here[:3, -1:]).any(0)
            end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            rest = here[:, end:]
            yield _linked(here[:, :end], max_bits)
        if rest is not None:
            yield _linked(rest, max_bits)

    return map_rows(buckets, run, "src long, dst long")


def _finer(chosen: list[tuple], max_bits: int) -> Column:
    """Keys of a large bucket: those of its table plus one block of the bits left open."""
    whole = (1 << BITS) - 1
    tables = []
    for bounds in chosen:
        mask = _mask(list(bounds))
        taken = mask % (1 << BITS)
        open_bits = [b for b in range(BITS) if (whole ^ taken) >> b & 1]
        pieces = np.array_split(np.array(open_bits), max_bits + 1)
        keys = []
        for part, piece in enumerate(pieces):
            extra = taken | sum(1 << int(b) for b in piece)
            signed = extra - (1 << BITS) if extra >= 1 << (BITS - 1) else extra
            keys.append(
                F.struct(
                    F.lit(part + 1).alias("part"),
                    F.col("fp").bitwiseAND(F.lit(signed)).alias("key"),
                )
            )
        tables.append(F.array(*keys))
    return F.element_at(F.array(*tables), F.col("table") + 1)


def _linked(rows: np.ndarray, max_bits: int) -> dict:
    """Links of all buckets in sorted rows ``table, part, key, fp``."""
    n = rows.shape[1]
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if n > 1:
        edge = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [n]))
        size = ends - starts
        fp = rows[3].view(np.uint64)
        two = starts[size == 2]
        close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
        src.append(rows[3][close])
        dst.append(rows[3][close + 1])
        for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            left, right = _forest(fp[a:b], max_bits)
            src.append(left.view(np.int64))
            dst.append(right.view(np.int64))
    return {"src": np.concatenate(src), "dst": np.concatenate(dst)}


def _forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs in one bucket, by search from member to member."""
    open_, stack = fp, []
    src, dst = [], []
    while len(open_):  # each round takes one member off, and costs the members left
        if stack:
            at = stack.pop()
        else:
            at, open_ = open_[0], open_[1:]
        near = np.bitwise_count(open_ ^ at) <= max_bits
        if near.any():
            found = open_[near]
            open_ = open_[~near]
            src.append(np.full(len(found), at, np.uint64))
            dst.append(found)
            stack.extend(found)
    if not src:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(src), np.concatenate(dst)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 3,
    blocks: int = 6,
    bucket_rows: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_key, fp, group_id, component_id`` of every row.

    ``component_id`` is the smallest id of the documents that links lead to.
    Documents without words (null texts too) have fingerprint zero and link like
    any other. Null ids name no component unless a component has no other. Rows
    may repeat; an empty table gives an empty table.
    """
    # Hashing the texts is the costly part: once, and a row of two longs a document.
    prints, _ = cut(fingerprints(docs, shingle, id_col, text_col))
    marks = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = connected_groups(near_pairs(marks, max_bits, blocks, bucket_rows))
    placed = marks.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("group_id", "fp").alias("group_id")
    )
    lowest = placed.groupBy("group_id").agg(F.min("low").alias("component_id"))
    labels = placed.join(lowest, "group_id").select("fp", "group_id", "component_id")
    return prints.join(labels, "fp").select("doc_id", "text_key", "fp", "group_id", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that of its smallest id.

    Ids that several rows share, and components of null ids only, are told apart
    by a hash of the text (the smallest stays); of rows that repeat both, one stays.
    """
    names = docs.columns
    own = docs.select(
        F.struct(*(docs[n] for n in names)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    labels = near_duplicates(docs, **options)
    chosen = labels.groupBy("group_id").agg(
        F.min_by(
            F.struct("doc_id", "text_key"),
            F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key")),
        ).alias("kept")
    )
    chosen = chosen.select("kept.*").distinct()
    kept = own.join(chosen, same_document(own, chosen), "left_semi")
    alike = Window.partitionBy("doc_id", "text_key").orderBy("doc_id")
    return kept.withColumn("nth", F.row_number().over(alike)).filter("nth = 1").select("row.*")
