"""Substring dedup by hashes of windows that earlier documents have too.

Takes the place of a relative Lempel-Ziv parse: nothing is factored by longest matches
and extended at its borders. Words are compared by 64-bit hashes of blocks and windows;
the windows found, joined up, are called factors here.

The reference of a document are all documents with a smaller id. It is cut into
blocks: stretches of words around anchors, where an anchor is a gram that is the
smallest of its neighbourhood by hash, so that equal stretches have equal anchors
and every window of ``window`` words holds the anchor of one block. The blocks
are indexed by anchor and content, and a document is factored against all of them:

1. A block whose content an earlier document has as well is a factor as a whole.
   The grouping that finds it keeps the smallest id per content, so thousands of
   copies collapse before the shuffle.
2. Blocks that share an anchor but not all content meet at the border of a factor.
   Those of the first holder of each such content are looked at again, window by
   window, so a factor may begin and end at any word.
3. Factors of neighbouring windows from one source are joined up greedily. Shorter
   ones than a window never arise; every window that crosses a border of factors
   has been looked up itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.texts import (
    Rolling,
    anchors,
    keyed_documents,
    map_rows,
    runs,
    same_document,
    word_hashes,
)
from matchbook.runtime import cut

GRAM = 8


def _parse(text: str, window: int, gram: int, rolling: Rolling) -> tuple | None:
    """Prefix sums, anchors, and the first window of each block and the one after its last."""
    symbols = word_hashes(text.encode(), rolling)
    if len(symbols) < window:
        return None
    prefix = rolling.prefix(symbols)
    grams = rolling.windows(prefix, gram)
    at = anchors(grams, window - gram + 1)
    starts, ends = runs(at)
    return prefix, grams[at[starts]], starts, ends


def blocks(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor, content, doc_id, text_key, at, n``: the blocks of all documents.

    A block covers the ``n`` windows from word ``at`` on; ``anchor`` and ``content`` are hashes.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rolling = Rolling()
        for batch in batches:
            of, columns = [], {n: [] for n in ("anchor", "content", "at", "n")}
            for i, text in enumerate(batch["text"].to_pylist()):
                parsed = _parse(text, window, gram, rolling)
                if parsed is None:
                    continue
                prefix, marks, starts, ends = parsed
                of.append(np.full(len(starts), i))
                columns["anchor"].append(marks.view(np.int64))
                content = rolling.spans(prefix, starts, ends - 1 + window)
                columns["content"].append(content.view(np.int64))
                columns["at"].append(starts)
                columns["n"].append(ends - starts)
            if not of:
                continue
            take = pa.array(np.concatenate(of))
            yield {n: np.concatenate(v) for n, v in columns.items()} | {
                n: batch[n].take(take) for n in ("doc_id", "text_key")
            }

    schema = "anchor long, content long, doc_id long, text_key long, at int, n int"
    return map_rows(keyed, run, schema)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """``hash, doc_id, text_key, at`` of every window of the blocks listed in ``places``."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rolling = Rolling()
        for batch in batches:
            of, hashes, places = [], [], []
            rows = zip(batch["text"].to_pylist(), batch["places"].to_pylist())
            for i, (text, listed) in enumerate(rows):
                prefix = rolling.prefix(word_hashes(text.encode(), rolling))
                at = np.unique(np.concatenate([np.arange(p["at"], p["at"] + p["n"]) for p in listed]))
                of.append(np.full(len(at), i))
                hashes.append(rolling.spans(prefix, at, at + window).view(np.int64))
                places.append(at)
            if not of:
                continue
            take = pa.array(np.concatenate(of))
            yield {n: batch[n].take(take) for n in ("doc_id", "text_key")} | {
                "hash": np.concatenate(hashes),
                "at": np.concatenate(places),
            }

    return map_rows(docs, run, "hash long, doc_id long, text_key long, at int")


def window_factors(docs: DataFrame, window: int = 50, gram: int = GRAM, **columns) -> DataFrame:
    """``doc_id, text_key, at, n, source``: ``n`` windows from word ``at`` on that ``source`` has too.

    ``source`` is the smallest id of all documents that have them, smaller than ``doc_id``.
    """
    keyed = keyed_documents(docs, **columns).filter("doc_id is not null")
    every = blocks(keyed, window, gram)
    # Anchors that more than one document has; few, so what follows moves little.
    met = every.groupBy("anchor").agg(
        F.min("doc_id").alias("low_id"),
        F.max("doc_id").alias("high_id"),
        F.min("content").alias("low"),
        F.max("content").alias("high"),
    )
    met = met.filter("low_id < high_id").select("anchor", (F.col("low") < F.col("high")).alias("several"))
    found, _ = cut(every.join(met, "anchor"))
    contents = found.groupBy("anchor", "content").agg(F.min("doc_id").alias("source"))

    # 1. Blocks that an earlier document has as a whole.
    placed = found.join(contents, ["anchor", "content"])
    whole = placed.filter("source < doc_id").select("doc_id", "text_key", "at", "n", "source")

    # 2. Blocks of first holders, where their anchor has other contents.
    holders = placed.filter("source = doc_id and several")
    listed = holders.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("at", "n")).alias("places")  # of one document
    )
    texts = keyed.join(listed, ["doc_id", "text_key"])
    windows = _windows(texts.select("doc_id", "text_key", "text", "places"), window)
    sources = windows.groupBy("hash").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("last_id")
    )
    sources = sources.filter("source < last_id").select("hash", "source")
    single = windows.join(sources, "hash").filter("source < doc_id")
    single = single.select("doc_id", "text_key", "at", F.lit(1).alias("n"), "source")
    return whole.unionByName(single)


def _factors(pieces: list, window: int) -> list[tuple[int, int, int]]:
    """``(first word, words, source)`` of the factors that neighbouring windows make up."""
    out: list[list[int]] = []
    for at, n, source in sorted((p["at"], p["n"], p["source"]) for p in pieces):
        if out and out[-1][2] == source and at <= out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] = max(out[-1][1], at + n - 1 + window - out[-1][0])
        else:
            out.append([at, n - 1 + window, source])
    return [tuple(f) for f in out]


def factors(docs: DataFrame, window: int = 50, gram: int = GRAM, **columns) -> DataFrame:
    """``doc_id, text_key, factors``: per document with any, ``(start, words, source)`` by start.

    Words are runs of other characters than ASCII white space, unchanged. A factor is a
    run of at least ``window`` words of which each window starts in ``source`` as well,
    the smallest id that has it, and smaller than the document's. Null ids neither
    have factors nor serve as sources; null, empty and short texts have none. Rows
    that share an id are no sources of each other.
    """
    pieces = window_factors(docs, window, gram, **columns)
    # As many pieces as a document has windows, at most.
    grouped = pieces.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("at", "n", "source")).alias("pieces")
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [_factors(p, window) for p in batch["pieces"].to_pylist()]
            yield {n: batch[n] for n in ("doc_id", "text_key")} | {
                "factors": [
                    [{"start": a, "words": n, "source": s} for a, n, s in each] for each in found
                ]
            }

    schema = "doc_id long, text_key long, factors array<struct<start:int,words:int,source:long>>"
    return map_rows(grouped, run, schema)


def remove_spans(docs: DataFrame, found: DataFrame, **columns) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row, without the words of its factors.

    Kept words are joined by single spaces. Rows without factors keep all words.
    """
    keyed = keyed_documents(docs, **columns)
    joined = keyed.join(found, same_document(keyed, found), "left")
    joined = joined.select(keyed["doc_id"], "text", "factors")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["factors"].to_pylist()):
                words = text.encode().split()
                kept = words
                if spans:
                    depth = np.zeros(len(words) + 1, np.int64)
                    for span in spans:
                        depth[span["start"]] += 1
                        depth[span["start"] + span["words"]] -= 1
                    gone = np.cumsum(depth[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield {
                "doc_id": batch["doc_id"],
                "n_words": n_words,
                "n_removed": n_removed,
                "kept_sha256": digests,
            }

    return map_rows(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
