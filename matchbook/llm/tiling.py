"""Benchmark decontamination by greedy string tiling.

Seeds (runs of ``min_match`` tokens) that a document shares with a benchmark item
make a pair of them. The pair is tiled: the longest run of tokens that both have
and neither has used yet is marked, again and again, down to ``min_match`` tokens.
The share of the item's tokens that is marked is the coverage; as tiles may lie in
any order, it also catches passages that were cut up and reordered.

The benchmark is a stated set of items. It is taken in blocks of bounded size,
each sent to all tasks as an index; documents are read once per block and are
not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.texts import Rolling, keyed_documents, map_rows, mix, same_document

_TOKEN = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _TOKEN.findall(text.lower())


class BenchmarkIndex:
    """Token numbers of some items, and where their seeds are.

    Items of fewer tokens than ``min_match`` have one seed, the whole item; items
    without tokens match nothing.
    """

    def __init__(self, items: list[tuple[int, str]], min_match: int, threshold: float):
        self.min_match, self.threshold = min_match, threshold
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        rolling = Rolling()
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            numbers = [
                self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text or "")
            ]
            if not numbers:
                continue
            symbols = np.array(numbers, np.uint64)
            size = min(min_match, len(symbols))
            seeds = np.unique(rolling.windows(rolling.prefix(symbols), size))
            found.setdefault(size, []).append((seeds, len(self.items)))
            self.ids.append(item_id)
            self.items.append(symbols)
        self.needed = np.array(
            [-(-threshold * len(x) // min(min_match, len(x))) for x in self.items], np.int64
        )
        #: By seed length: sorted seeds, and the items that have each of them.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, lists in found.items():
            seeds = np.concatenate([s for s, _ in lists])
            owner = np.concatenate([np.full(len(s), i) for s, i in lists])
            order = np.argsort(seeds, kind="stable")
            distinct, starts = np.unique(seeds[order], return_index=True)
            self.seeds[size] = (distinct, np.append(starts, len(seeds)), owner[order])

    def numbers(self, text: str) -> np.ndarray:
        """Tokens of a text by number, 0 where no item has the token."""
        words = tokens(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))

    def candidates(self, doc: np.ndarray, rolling: Rolling) -> list[tuple[int, np.ndarray]]:
        """Items that share seeds enough to reach the threshold, and the seeds' places in the text.

        Tokens of a marked run of ``n`` hold ``n - min_match + 1`` seeds, so a coverage
        asks for at least one distinct seed per ``min_match`` tokens of the item that
        differ. Items with equal seeds at several places need as many fewer.
        """
        out = []
        unknown = np.concatenate(([0], np.cumsum(doc == 0)))
        prefix = rolling.prefix(doc)
        for size, (seeds, starts, owner) in self.seeds.items():
            if len(doc) < size:
                continue
            known = np.flatnonzero(unknown[size:] == unknown[: len(doc) - size + 1])
            if not len(known):
                continue
            grams = rolling.spans(prefix, known, known + size)
            at = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
            hit = seeds[at] == grams
            if not hit.any():
                continue
            at, places = at[hit], known[hit]
            shared = np.unique(at)
            sizes = starts[shared + 1] - starts[shared]
            ranges = np.repeat(starts[shared] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            items = np.unique(owner[ranges])
            in_text = np.zeros(len(doc) + 1, np.int64)
            np.add.at(in_text, places, 1)
            np.add.at(in_text, places + size, -1)
            inside = np.flatnonzero(np.cumsum(in_text[:-1]) > 0)
            hashes = seeds[shared]
            for item in items.tolist():
                symbols = self.items[item]
                own = np.isin(rolling.windows(rolling.prefix(symbols), size), hashes)
                if own.sum() >= self.needed[item]:
                    out.append((item, inside))
        return out


def tile(
    doc: np.ndarray, item: np.ndarray, min_match: int, rolling: Rolling
) -> list[tuple[int, int, int]]:
    """Tiles ``(place in the text, place in the item, tokens)``, longest first.

    Of equally long matches those that come first in the text, then in the item, are marked.
    """
    left, right = doc.copy(), item.copy()
    # Marked tokens get numbers of their own, so no window over them can match.
    own_left = mix(np.arange(len(left), dtype=np.uint64) + np.uint64(1 << 62))
    own_right = mix(np.arange(len(right), dtype=np.uint64) + np.uint64(1 << 63))
    out: list[tuple[int, int, int]] = []
    longest = min(len(left), len(right))

    def common(size: int) -> np.ndarray:
        return np.intersect1d(
            rolling.windows(rolling.prefix(left), size), rolling.windows(rolling.prefix(right), size)
        )

    while longest >= min_match:
        low, high = min_match - 1, longest
        while low < high:  # the greatest length at which something still matches
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)) else (low, middle - 1)
        longest = low
        if longest < min_match:
            break
        shared = common(longest)
        ours = rolling.windows(rolling.prefix(left), longest)
        theirs = rolling.windows(rolling.prefix(right), longest)
        places: dict[int, list[int]] = {}
        for q in np.flatnonzero(np.isin(theirs, shared)).tolist():
            places.setdefault(int(theirs[q]), []).append(q)
        free_left, marked = 0, False
        used = np.zeros(len(right), bool)
        for p in np.flatnonzero(np.isin(ours, shared)).tolist():
            if p < free_left:
                continue
            waiting = places.get(int(ours[p]), [])
            while waiting and (
                used[waiting[0] : waiting[0] + longest].any()
                or not np.array_equal(left[p : p + longest], right[waiting[0] : waiting[0] + longest])
            ):
                waiting.pop(0)
            if not waiting:
                continue
            q = waiting[0]
            out.append((p, q, longest))
            used[q : q + longest] = marked = True
            free_left = p + longest
            left[p:free_left] = own_left[p:free_left]
            right[q : q + longest] = own_right[q : q + longest]
        if not marked:
            longest -= 1
    return out


def coverages(
    index: BenchmarkIndex, text: str, rolling: Rolling
) -> Iterator[tuple[int, float, int]]:
    """``(item, coverage, tiles)`` of the items whose coverage reaches the threshold."""
    doc = index.numbers(text)
    for item, inside in index.candidates(doc, rolling):
        symbols = index.items[item]
        size = min(index.min_match, len(symbols))
        # Only tokens in shared seeds can be tiled; a stretch between two such runs parts them.
        gaps = np.flatnonzero(np.diff(inside) > 1) + 1
        part = np.insert(doc[inside], gaps, np.uint64(0))
        tiles = tile(part, symbols, size, rolling)
        coverage = sum(n for _, _, n in tiles) / len(symbols)
        if coverage >= index.threshold:
            yield item, coverage, len(tiles)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = 5,
    threshold: float = 0.8,
    block_chars: int = 32_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_key, item_id, coverage, tiles``: pairs whose coverage reaches the threshold.

    ``benchmark`` has ``item_id, text``; it is read in blocks of up to
    ``block_chars`` characters, so no task or driver holds more of it, unless a single text
    is longer. Null and empty texts match nothing, on either side. Rows that repeat an id and
    text, and items that repeat another, each give their rows. Without documents or items
    there are none.
    """
    items = _items(benchmark)
    found = _matches(docs, items, min_match, threshold, block_chars, id_col, text_col)
    ids = items.select("item_key", "item_id")
    return found.join(ids, "item_key").select("doc_id", "text_key", "item_id", "coverage", "tiles")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text"
    ).filter("length(text) > 0")


def _matches(
    docs: DataFrame,
    items: DataFrame,
    min_match: int = 5,
    threshold: float = 0.8,
    block_chars: int = 32_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """As ``contaminated``, but equal texts of items are one, by its ``item_key``."""
    spark = docs.sparkSession
    keyed = keyed_documents(docs, id_col, text_col)
    texts = items.select("item_key", "text").distinct()
    found = None
    for block in _blocks(texts, block_chars):
        # A bounded block of the benchmark at a time, never all of it.
        rows = [tuple(r) for r in texts.filter(block).collect()]
        index = spark.sparkContext.broadcast(BenchmarkIndex(rows, min_match, threshold))
        part = map_rows(keyed, _search(index), _PAIRS)
        found = part if found is None else found.unionByName(part)
    return found


def _blocks(texts: DataFrame, block_chars: int) -> list[Column]:
    """Conditions that part distinct texts into runs of up to ``block_chars`` characters.

    Texts are dealt to slots by hash, finer until a slot of several texts is within the
    bound; a running sum over the slots cuts them into blocks.
    """
    total = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    slots = max(1, -(-total // block_chars))
    if slots == 1:
        return [F.lit(True)]
    while True:
        slots *= 4
        slot = F.pmod(F.col("item_key"), F.lit(slots))
        # One row per slot; slots are few, as texts are short beside a block.
        sums = texts.groupBy(slot.alias("slot")).agg(
            F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")
        )
        found = sums.orderBy("slot").collect()
        # Past that, only texts with equal hashes are left together.
        if slots > 1 << 40 or all(r["n"] == 1 or r["chars"] <= block_chars for r in found):
            break
    out, first, held = [], found[0]["slot"], 0
    for r in found:
        if held and held + r["chars"] > block_chars:
            out.append((slot >= first) & (slot < r["slot"]))
            first, held = r["slot"], 0
        held += r["chars"]
    return [*out, slot >= first]


_PAIRS = "doc_id long, text_key long, item_key long, coverage double, tiles int"


def _search(shared):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        index, rolling = shared.value, Rolling()
        for batch in batches:
            ids, keys = batch["doc_id"], batch["text_key"]
            of, item_ids, shares, tiles = [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for item, coverage, n in coverages(index, text, rolling):
                    of.append(i)
                    item_ids.append(index.ids[item])
                    shares.append(coverage)
                    tiles.append(n)
            take = np.array(of, np.int64)
            yield {
                "doc_id": ids.take(take),
                "text_key": keys.take(take),
                "item_key": item_ids,
                "coverage": shares,
                "tiles": tiles,
            }

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    names = docs.columns
    found = _matches(docs, _items(benchmark), **options).select("doc_id", "text_key").distinct()
    own = docs.select(
        F.struct(*(docs[n] for n in names)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    return own.join(found, same_document(own, found), "left_anti").select("row.*")
