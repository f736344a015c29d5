"""Both substring operators, and the sorter below one of them, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from matchbook.llm import induced, repeats, rlz

from .conftest import pairs, same_rows


def plain_repeats(rows, size):
    seen = {}
    for k, (_, text) in enumerate(rows):
        data = text.encode()
        for at in range(len(data) - size + 1):
            seen.setdefault(data[at : at + size], []).append((k, at))
    gone = [bytearray(len(text.encode())) for _, text in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, at in places:
                gone[k][at : at + size] = b"\1" * size
    for (doc_id, text), mask in zip(rows, gone):
        data = text.encode()
        kept = bytes(b for b, g in zip(data, mask) if not g)
        spans = len(re.findall(rb"\x01+", bytes(mask)))
        yield doc_id, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()


REPEATS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("hot_blocks", [1000, 1])
def test_repeated_bytes(hard, small, hot_blocks):
    for docs in (hard, small):
        found = repeats.repeated_spans(docs, 400, hot_blocks=hot_blocks)
        same_rows(repeats.remove_spans(docs, found), plain_repeats(pairs(docs), 400), REPEATS)


def test_repeated_bytes_of_short_strings(spark):
    """Random texts of few letters, in one shard that spills and in chunks of windows."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(30)]
    for i in range(12):
        a, b = rng.randrange(30), rng.randrange(30)
        rows.append((100 + i, rows[a][1][20:120] + "zz" + rows[b][1][:90]))
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, "a" * 40 + "z" + "a" * 39)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunk = repeats.CHUNK
    try:
        for repeats.CHUNK in (chunk, 64):
            found = repeats.repeated_spans(docs, 40, budget=1000)
            same_rows(repeats.remove_spans(docs, found), plain_repeats(rows, 40), REPEATS)
    finally:
        repeats.CHUNK = chunk


@pytest.mark.parametrize("in_memory", [0, 1 << 20])
@pytest.mark.parametrize("budget", [0, 1 << 20])
def test_induced_sorting(in_memory, budget):
    rng = np.random.default_rng(4)
    for trial in range(60):
        text = rng.integers(1, rng.integers(2, 6), rng.integers(1, 200)).astype(np.uint8)
        if trial % 2 and len(text) > 30:
            text[len(text) // 2 :][:12] = text[:12]
        for cap in (1, 4, 9):
            places = {}
            for at in range(len(text) - cap + 1):
                places.setdefault(text[at : at + cap].tobytes(), []).append(at)
            expected = sorted(p for v in places.values() if len(v) > 1 for p in v)
            found = induced.repeated_positions(text, cap, in_memory, budget).tolist()
            assert found == (expected if len(text) > cap else [])


def test_tuples_go_to_disk_beyond_the_budget():
    spill = induced.Spill(1 << 12)
    queue = induced.DiskQueue(spill)
    rng = np.random.default_rng(0)
    expected = []
    for _ in range(50):
        keys = np.sort(rng.choice(1 << 40, 400, replace=False)).astype(np.uint64)
        expected.append(keys)
        queue.push(keys, keys.astype(np.int64), np.zeros(400, np.int16))
    assert spill.spilled > 0
    out = []
    while (head := queue.peek(100)) is not None:
        out.append(head[0])
        queue.drop(head[0][-1])
    assert np.concatenate(out).tolist() == sorted(np.concatenate(expected).tolist())


def plain_windows(rows, size):
    words = [re.findall("[^\x20\x09-\x0d]+", text) for _, text in rows]
    first = {}
    for (doc_id, _), own in zip(rows, words):
        for at in range(len(own) - size + 1):
            key = tuple(own[at : at + size])
            if doc_id is not None:
                first[key] = min(doc_id, first.get(key, doc_id))
    for (doc_id, _), own in zip(rows, words):
        gone = [False] * len(own)
        for at in range(len(own) - size + 1):
            if doc_id is not None and first[tuple(own[at : at + size])] < doc_id:
                gone[at : at + size] = [True] * size
        kept = [w for w, g in zip(own, gone) if not g]
        yield doc_id, len(own), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_windows_of_earlier_documents(hard, small):
    for docs in (hard, small):
        found = rlz.remove_spans(docs, rlz.factors(docs, 50))
        same_rows(found, plain_windows(pairs(docs), 50), WORDS)


def test_windows_of_few_words(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(40)]
    for i in range(20):
        a, b = rng.randrange(40), rng.randrange(40)
        rows.append((rng.randrange(-50, 90), rows[a][1][:60] + "\n" + rows[b][1][30:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = rlz.remove_spans(docs, rlz.factors(docs, 12, gram=3))
    same_rows(found, plain_windows(rows, 12), WORDS)


def test_factors_name_their_source(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [
        (1, " ".join(words[:150])),
        (2, " ".join(words[200:400])),
        (5, " ".join(["own", *words[40:120], "x", *words[250:320], "end"])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in rlz.factors(docs, 50).collect()}
    assert found == {5: [(1, 80, 1), (82, 70, 2)]}


def test_empty_tables(nothing):
    assert repeats.remove_spans(nothing, repeats.repeated_spans(nothing)).count() == 0
    assert rlz.remove_spans(nothing, rlz.factors(nothing)).count() == 0
