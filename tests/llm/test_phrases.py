"""Collocations against plain counting."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from matchbook.llm.oracle import COLLOCATIONS
from matchbook.llm.phrases import collocations, combined, equal_partitions, phrase_counts

from .conftest import SMALL, same_rows

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counts_of(rows, max_words):
    found, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                found.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return found, total


def expected(rows, max_words, least, share, top):
    f, total = counts_of(rows, max_words)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    hidden = set()
    for (lang, words), n in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                if 100 * n >= share * f[part]:
                    hidden.add(part)
    by_lang = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) in hidden:
            continue
        score, _, l, r = min(
            (10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
            for k in range(1, len(words))
        )
        by_lang[lang].append((-score, -a, " ".join(words).encode(), l, r))
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, total[lang], -score


def some_rows():
    rng = random.Random(11)
    words = ["The", "of", "a", "and", "x", "é", "ÉT", "long-word", " odd", "it's", "漢字"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", " \r\n"]
    rows = []
    for n in range(60):
        text = "".join(rng.choice(words) + rng.choice(seps) for _ in range(n * 2))
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    rows += [("en", None), (None, ""), ("de", " . , "), ("fr", "one"), ("en", "of the " * 300)]
    return rows + [("en", "same row here, same row here")] * 12


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, lang, text, 0, "x", 1) for i, (lang, text) in enumerate(some_rows())]
    schema = "doc_id long, lang string, text string, words int, phrase string, n long"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("max_words, least, share, top", [(3, 10, 50, 2000), (3, 2, 50, 7), (2, 3, 50, 50), (4, 2, 100, 500)])
def test_against_plain_counting(table, max_words, least, share, top):
    found = collocations(table, max_words, least, share, top)
    same_rows(found, expected(some_rows(), max_words, least, share, top), COLUMNS)


@pytest.mark.parametrize("options", [{"share": 0.0}, {"block_chars": 1}, {"route_words": 3}])
def test_splits_blocks_and_routes_change_nothing(table, options):
    """Every pair split by a third word; a block for every text; routes added up all the time."""
    counts, totals = phrase_counts(table, 3, 2, **options)
    f, total = counts_of(some_rows(), 3)
    wanted = [(lang, len(w), " ".join(w), n) for (lang, w), n in f.items() if n >= 2]
    same_rows(counts, wanted, ["lang", "words", "phrase", "n"])
    same_rows(totals, [(k, n) for k, n in total.items() if n], ["lang", "total"])


@pytest.mark.parametrize("small", [1, 40, 10_000])
def test_partitions_are_the_counts(small):
    rng = np.random.default_rng(2)
    columns = [rng.integers(1, 5, 900), rng.integers(0, 6, 900), rng.integers(0, 4, 900)]
    columns[2] = np.where(columns[1] == 0, 0, columns[2])
    weights = rng.integers(1, 4, 900)
    plain = collections.Counter()
    for row, weight in zip(zip(*columns), weights.tolist()):
        row = tuple(int(x) for x in row)
        for k in (1, 2, 3):
            if 0 not in row[:k]:
                plain[row[:k]] += weight
    found = {}
    for n, at, sizes in equal_partitions(columns, np.arange(900), weights, [30, 12, 5], small):
        for p, size in zip(at.tolist(), sizes.tolist()):
            found[tuple(int(columns[d][p]) for d in range(n))] = size
    wanted = {k: n for k, n in plain.items() if n >= [30, 12, 5][len(k) - 1]}
    assert found == {k: n for k, n in wanted.items() if all(plain[k[:d]] >= [30, 12, 5][d - 1] for d in range(1, len(k)))}


def test_combined_rows():
    columns = [np.array([1, 1, 2, 1]), np.array([2, 2, 0, 2]), np.array([0, 0, 0, 3])]
    at, sizes = combined(columns, np.array([1, 2, 5, 7]))
    assert sorted((tuple(int(c[p]) for c in columns), int(n)) for p, n in zip(at, sizes)) == [
        ((1, 2, 0), 3),
        ((1, 2, 3), 7),
        ((2, 0, 0), 5),
    ]


def test_hard_rows_have_no_language(hard):
    from pyspark.sql import functions as F

    docs = hard.withColumn("lang", F.lit(None).cast("string"))
    rows = [(None, r["text"]) for r in hard.collect()]
    same_rows(collocations(docs), expected(rows, 3, 10, 50, 2000), COLUMNS)


def test_empty_table(nothing):
    assert collocations(nothing).collect() == []


def test_sql_on_the_given_documents(small):
    with duckdb.connect() as connection:
        connection.execute(f"create view documents as from '{SMALL}/documents.parquet'")
        wanted = connection.execute(COLLOCATIONS).fetchall()
    assert wanted
    same_rows(collocations(small), wanted, COLUMNS)
