"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A pointer to a word stands for the phrase that begins there. Pointers are parted by the
first word into smaller, equal and greater ones; equal ones are parted anew by the word
after, down to the longest phrases asked for. The size of an equal partition is how often
its phrase occurs, and one that is too small is abandoned with all that it holds.

Two passes over the texts. The first counts words, and finds the pairs that hold more than
a share of all pointers. The second sorts the pointers of a block of documents, so that
equal phrases become one with a count, and routes them by their two leading words: each
route sorts what it gets, and its partitions have the sizes of the whole corpus. Only the
pairs found in the first pass, a few hundred at most, are routed by a third word too, and
their own counts are sums over routes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.texts import map_rows, mix, uncollected
from matchbook.operators.ranking import best_per_group
from matchbook.runtime import cut, shuffle_width

#: Bytes as they count: A-Z in lower case, marks and line ends part pieces, tabs part words.
_SEEN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\t",
    b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ",
)
# An empty match stands for the end of a piece.
_TOKENS = re.compile(rb"([^ \n]+)|\n")

#: Partitions of so many pointers are sorted at once, as any quicksort ends.
SMALL = 1 << 14


def equal_partitions(
    columns: Sequence[np.ndarray],
    pointers: np.ndarray,
    weights: np.ndarray,
    least: Sequence[int],
    small: int = SMALL,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, pointers, sizes)`` of the equal partitions of one to ``len(columns)`` words.

    ``columns[d][p]`` is the word ``d`` places after pointer ``p``, and 0 where the piece has
    ended: such phrases are no longer than that. ``weights[p]`` is how often a pointer counts.
    A partition of ``d`` words that is smaller than ``least[d - 1]`` is abandoned. Of each
    partition one pointer is given, for many partitions at a time.
    """
    pending = [(pointers, 0)]
    while pending:
        at, depth = pending.pop()
        if len(at) <= small:
            yield from _sorted_at_once(columns, at, weights, least, depth)
            continue
        words = columns[depth][at]
        some = np.sort(words[:: len(words) // 63 + 1])
        pivot = some[len(some) // 2]
        smaller, greater = words < pivot, words > pivot
        pending += [(at[greater], depth), (at[smaller], depth)]
        same = at[~(smaller | greater)]
        size = int(weights[same].sum())
        if pivot == 0 or size < least[depth]:
            continue
        yield depth + 1, same[:1], np.array([size])
        if depth + 1 < len(columns):
            pending.append((same, depth + 1))


def _sorted_at_once(columns, at, weights, least, depth):
    if not len(at):
        return
    keys = [columns[depth][at]]
    for column in columns[depth + 1 :]:
        keys.append(np.where(keys[-1] == 0, 0, column[at]))
    order = np.lexsort(keys[::-1])
    at, new = at[order], np.zeros(len(order), bool)
    new[0] = True
    counted = weights[at]
    for d, key in enumerate(keys, depth):
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        sizes = np.add.reduceat(counted, starts)
        kept = (key[starts] != 0) & (sizes >= least[d])
        if not kept.any():
            return
        yield d + 1, at[starts[kept]], sizes[kept]


def combined(columns: Sequence[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pointer for each distinct row of the columns, and its weight."""
    # Ended phrases are partitions too: shift the words so that none is 0.
    whole = [np.where(c == 0, 1, c + 1) for c in columns]
    found = [
        (at, sizes)
        for words, at, sizes in equal_partitions(
            whole, np.arange(len(weights)), weights, [1] * len(whole)
        )
        if words == len(whole)
    ]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([s for _, s in found])


class _Words:
    """Numbered words of the texts of a language; 0 is the end of a piece."""

    def __init__(self) -> None:
        self._number: defaultdict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self._number[b""]
        self._ids: list[np.ndarray] = []

    def add(self, texts: list[str]) -> None:
        data = "\n".join(texts).encode("utf-8").translate(_SEEN) + b"\n"
        tokens = _TOKENS.findall(data)
        self._ids.append(np.fromiter(map(self._number.__getitem__, tokens), np.int32, len(tokens)))

    @property
    def words(self) -> list[bytes]:
        return list(self._number)

    @property
    def number(self) -> dict[bytes, int]:
        return self._number

    def columns(self, n: int) -> list[np.ndarray]:
        """The words at each place and at the ``n - 1`` places after it, 0 from the end of a piece on."""
        ids = np.concatenate([*self._ids, np.zeros(n, np.int32)])
        out = [ids[: len(ids) - n]]
        for d in range(1, n):
            out.append(np.where(out[-1] == 0, 0, ids[d : len(ids) - n + d]))
        return out


def _blocks(batches: Iterator[dict], chars: int) -> Iterator[dict[str, _Words]]:
    """Words by language, of some millions of characters at a time."""
    block: dict[str, _Words] = {}
    held = 0
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            by_lang.setdefault(lang, []).append(text)
            held += len(text)
            if held >= chars:
                yield _with(block, by_lang)
                block, by_lang, held = {}, {}, 0
        _with(block, by_lang)
    if block:
        yield block


def _with(block: dict[str, _Words], by_lang: dict[str, list[str]]) -> dict[str, _Words]:
    for lang, texts in by_lang.items():
        block.setdefault(lang, _Words()).add(texts)
    return block


def _word_counts(docs: DataFrame, block_chars: int, share: float) -> DataFrame:
    """``lang, words, phrase, n``: every word, and pairs beyond a share of their block, by block."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for block in _blocks(batches, block_chars):
            for lang, found in block.items():
                first, second = found.columns(2)
                words = found.words
                counts = np.bincount(first, minlength=len(words))
                yield _counted(lang, 1, words[1:], counts[1:])
                codes, n = np.unique(
                    first[second > 0].astype(np.int64) << 32 | second[second > 0], return_counts=True
                )
                often = n >= share * counts[1:].sum()
                pairs = [words[c >> 32] + b" " + words[c & 0xFFFFFFFF] for c in codes[often].tolist()]
                yield _counted(lang, 2, pairs, n[often])

    return map_rows(docs, uncollected(run), "lang string, words int, phrase string, n long")


def _counted(lang: str, words: int, phrases: list[bytes], n: np.ndarray) -> dict:
    return {
        "lang": [lang] * len(phrases),
        "words": [words] * len(phrases),
        "phrase": [p.decode("utf-8") for p in phrases],
        "n": n.astype(np.int64),
    }


def _routed(
    docs: DataFrame, n: int, routes: int, wide: set[tuple[str, str]], block_chars: int
) -> DataFrame:
    """Distinct phrases of each block with their counts, packed by route."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for block in _blocks(batches, block_chars):
            for lang, found in block.items():
                columns = found.columns(n)
                begun = np.flatnonzero(columns[1])
                columns = [c[begun] for c in columns]
                at, counts = combined(columns, np.ones(len(begun), np.int64))
                columns = [c[at] for c in columns]
                words = found.words
                # Of equal blocks equal words go the same way, wherever they are read.
                keys = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
                split = _is_wide(found, lang, wide, columns)
                with np.errstate(over="ignore"):
                    way = mix(keys[columns[0]] * np.uint64(3) + keys[columns[1]])
                    if n > 2:
                        way = np.where(split, mix(way * np.uint64(3) + keys[columns[2]]), way)
                    way = mix(way + np.uint64(xxhash.xxh64_intdigest(lang.encode())))
                route = (way % np.uint64(routes)).astype(np.int64) * 2 + split
                order = np.argsort(route, kind="stable")
                route = route[order]
                cuts = np.flatnonzero(np.diff(route, prepend=-1))
                rows: dict[str, list] = {"lang": [], "route": [], "vocabulary": [], "phrases": []}
                for low, high in zip(cuts, [*cuts[1:], len(route)]):
                    here = order[low:high]
                    used, back = np.unique(np.concatenate([c[here] for c in columns]), return_inverse=True)
                    table = np.concatenate((back, counts[here])).astype("<u4")
                    rows["lang"].append(lang)
                    rows["route"].append(int(route[low]))
                    rows["vocabulary"].append(pack(b" ".join([words[i] for i in used.tolist()])))
                    rows["phrases"].append(pack(table.tobytes()))
                yield rows

    return map_rows(docs, uncollected(run), "lang string, route long, vocabulary binary, phrases binary")


def _is_wide(found: _Words, lang: str, wide: set[tuple[str, str]], columns) -> np.ndarray:
    number = found.number
    codes = []
    for of, pair in wide:
        first, second = pair.encode("utf-8").split(b" ")
        if of == lang and first in number and second in number:
            codes.append(number[first] << 32 | number[second])
    return np.isin(columns[0].astype(np.int64) << 32 | columns[1], np.array(codes, np.int64))


class _Route:
    """Phrases of one route, from all blocks; equal ones are added up when they are many."""

    def __init__(self, n: int, most: int):
        self._n, self._most = n, most
        self._number: defaultdict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self._number[b""]
        self._parts: list[np.ndarray] = []
        self._held, self._limit = 0, most

    def add(self, vocabulary: bytes, phrases: bytes) -> None:
        words = vocabulary.split(b" ")
        ids = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))
        table = np.frombuffer(phrases, "<u4").reshape(self._n + 1, -1).astype(np.int64)
        table[: self._n] = ids[table[: self._n]]
        self._parts.append(table)
        self._held += table.shape[1]
        if self._held > self._limit:
            whole = self._whole()
            at, sizes = combined(whole[: self._n], whole[self._n])
            whole = whole[:, at]
            whole[self._n] = sizes
            self._parts, self._held = [whole], len(at)
            self._limit = max(self._most, 2 * self._held)

    def _whole(self) -> np.ndarray:
        return np.concatenate(self._parts, axis=1)

    def phrases(self, least: Sequence[int]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        whole, words = self._whole(), list(self._number)
        columns = list(whole[: self._n])
        found = equal_partitions(columns, np.arange(whole.shape[1]), whole[self._n], least)
        for n, at, sizes in found:
            if n > 1:
                rows = zip(*(columns[d][at].tolist() for d in range(n)))
                yield n, [b" ".join([words[i] for i in row]).decode("utf-8") for row in rows], sizes


def phrase_counts(
    docs: DataFrame,
    max_words: int = 3,
    min_count: int = 10,
    share: float = 1 / 500,
    block_chars: int = 1 << 24,
    route_words: int = 4_000_000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """``(counts, totals)``: ``lang, words, phrase, n`` of every phrase of up to ``max_words``
    words that occurs ``min_count`` times or more, and ``lang, total`` words of each language.

    ``share`` of all words in one pair makes it one that is split by the word after: there
    are at most ``1 / share`` of them, and the driver gets their names. What a task holds of
    its texts is bounded by ``block_chars``, a route aims at ``route_words`` phrases.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    counted, _ = cut(
        _word_counts(texts, block_chars, share)
        .groupBy("lang", "words", "phrase")
        .agg(F.sum("n").alias("n"))
    )
    words = counted.filter("words = 1")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    everything = words.agg(F.sum("n")).first()[0] or 0
    # One of them has that share of some block, so every one of them is here.
    wide = counted.filter((F.col("words") == 2) & (F.col("n") >= share * everything))
    wide = {(row["lang"], row["phrase"]) for row in wide.select("lang", "phrase").collect()}
    often = words.filter(F.col("n") >= min_count)
    if max_words < 2:
        return often, totals

    routes = max(2 * shuffle_width(docs.sparkSession), -(-everything // route_words))
    packed = _routed(texts, max_words, routes, wide, block_chars)
    packed = packed.repartition("route").sortWithinPartitions("lang", "route")
    least = [1, min_count, *[min_count] * (max_words - 2)]
    partial = [1, 1, *[min_count] * (max_words - 2)]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor().decompress
        open_key, held = None, None

        def close() -> Iterator[dict]:
            # Odd routes hold pairs that are split over several.
            for n, phrases, sizes in held.phrases(partial if open_key[1] % 2 else least):
                yield {
                    "lang": [open_key[0]] * len(phrases),
                    "words": [n] * len(phrases),
                    "phrase": phrases,
                    "n": sizes,
                }

        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("lang", "route", "vocabulary", "phrases")))
            for lang, route, vocabulary, phrases in rows:
                if (lang, route) != open_key:
                    if held is not None:
                        yield from close()
                    open_key, held = (lang, route), _Route(max_words, route_words)
                held.add(unpack(vocabulary), unpack(phrases))
        if held is not None:
            yield from close()

    found = map_rows(packed, uncollected(run), "lang string, words int, phrase string, n long")
    longer = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return often.unionByName(longer.filter(F.col("n") >= min_count)), totals


def collocations(
    docs: DataFrame,
    max_words: int = 3,
    min_count: int = 10,
    share: int = 50,
    top: int = 2000,
    **options,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Words are in lower case (A-Z only) and parted by blanks and tabs; phrases don't reach
    over any of ``.,;:!?`` or a line end. A phrase of two words or more that occurs ``a`` times,
    ``min_count`` at least, is scored by the cut that binds least: ``floor(10**6 * a * a / (l * r))``
    with the counts of what lies before and after the cut (of equal scores the earliest). Phrases
    within a longer one that has ``share`` percent of their count or more are left out. ``n`` is
    the number of words of the language. Ties go by count, then phrase.

    A null language is ``und``. Null and empty texts have no words; repeated rows count each;
    ids play no part, and further columns are not looked at. An empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, max_words, min_count, **options)
    counts, _ = cut(counts)
    parts = F.split("phrase", " ")
    candidates = counts.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))

    inner = (
        candidates.filter("words > 2")
        .select("lang", "words", F.col("a").alias("longer"), parts.alias("parts"))
        .select("lang", "words", "longer", "parts", F.expr("explode(sequence(2, words - 1))").alias("size"))
        .select("lang", "longer", "parts", "size", F.expr("explode(sequence(1, words - size + 1))").alias("at"))
        .select("lang", "longer", F.expr("array_join(slice(parts, at, size), ' ')").alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = candidates.join(inner, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))
    )

    cuts = kept.select("lang", "words", "phrase", "a", parts.alias("parts")).select(
        "lang", "words", "phrase", "a", "parts", F.expr("explode(sequence(1, words - 1))").alias("k")
    )
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.expr("array_join(slice(parts, 1, k), ' ')").alias("before"),
        F.expr("array_join(slice(parts, k + 1, words - k), ' ')").alias("after"),
    )
    side = counts.select("lang", "phrase", "n")
    cuts = cuts.join(side.toDF("lang", "before", "l"), ["lang", "before"])
    cuts = cuts.join(side.toDF("lang", "after", "r"), ["lang", "after"])
    # Counts have at most 16 digits; the products are exact.
    wide = {c: f"CAST({c} AS DECIMAL(16, 0))" for c in "alr"}
    score = F.expr(
        f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide['a']} * {wide['a']})) DIV ({wide['l']} * {wide['r']})"
    )
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("weakest")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest)
    scored = scored.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best_per_group(scored, ["lang"], order, top)
    return best.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        "l",
        "r",
        F.col("total").alias("n"),
        "score",
    )
