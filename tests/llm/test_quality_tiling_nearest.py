"""Quality classifier, benchmark decontamination and nearest neighbours."""

import random
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchbook.llm import nearest, quality, tiling
from matchbook.llm.texts import Rolling

from .conftest import pairs

TABLES = "/root/testdata/sf0.01"


def plain_tiles(doc, item, least):
    """Greedy string tiling as it is defined: the longest matches first, one place at a time."""
    used_doc, used_item, out = set(), set(), 0
    while True:
        best = []
        length = least
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while (
                    p + n < len(doc)
                    and q + n < len(item)
                    and doc[p + n] == item[q + n]
                    and p + n not in used_doc
                    and q + n not in used_item
                ):
                    n += 1
                if n > length:
                    best, length = [(p, q)], n
                elif n == length:
                    best.append((p, q))
        if not best:
            return out
        for p, q in best:
            a, b = set(range(p, p + length)), set(range(q, q + length))
            if not a & used_doc and not b & used_item:
                used_doc |= a
                used_item |= b
                out += length


def test_tiles_are_those_of_the_definition():
    rng = random.Random(1)
    rolling = Rolling()
    for trial in range(150):
        doc = [rng.randint(1, 4 + trial % 20) for _ in range(rng.randint(0, 60))]
        item = [rng.randint(1, 4 + trial % 20) for _ in range(rng.randint(1, 25))]
        if trial % 2 and len(item) > 8:
            doc[10:10] = item[len(item) // 2 :] + [99] + item[: len(item) // 2]
        for least in (1, 2, 5):
            tiles = tiling.tile(np.array(doc, np.uint64), np.array(item, np.uint64), least, rolling)
            for p, q, n in tiles:
                assert doc[p : p + n] == item[q : q + n] and n >= least
            assert len({x for _, q, n in tiles for x in range(q, q + n)}) == sum(n for *_, n in tiles)
            assert sum(n for *_, n in tiles) == plain_tiles(doc, item, least)


def test_leaks_of_the_tables(spark, nothing):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").filter("n_chars < 1500")
    bench = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    items = [(r["item_id"], tiling.tokens(r["text"])) for r in bench.collect()]
    expected = set()
    for doc_id, text in pairs(docs):
        words = tiling.tokens(text)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item_id, item in items:
            own = [tuple(item[i : i + 5]) for i in range(len(item) - 4)]
            if grams.intersection(own) and plain_tiles(words, item, 5) >= 0.8 * len(item):
                expected.add((doc_id, item_id))
    one = tiling.contaminated(docs, bench)
    many = tiling.contaminated(docs, bench, block_chars=3000)
    assert expected
    for found in (one, many):
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    assert tiling.contaminated(nothing, bench).count() == 0
    assert tiling.contaminated(docs, bench.filter("false")).count() == 0


def test_reordered_short_and_empty_items(spark, hard):
    words = [f"w{i}" for i in range(40)]
    rows = [
        (1, " ".join(["pre", *words[20:], "Between", *words[:20], "post"])),
        (2, " ".join(words[:20])),
        (None, " ".join(words).upper() + "."),
        (3, "say Three Little Words!"),
        (4, None),
        (4, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(7, " ".join(words)), (8, "three little words"), (9, ""), (10, None), (None, "unmet one here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = tiling.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"], r["tiles"]) for r in found} == {
        (1, 7, 1.0, 2),
        (None, 7, 1.0, 1),
        (3, 8, 1.0, 1),
    }
    kept = tiling.clean_documents(docs, bench)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 4, 4]
    assert tiling.clean_documents(hard, bench).schema == hard.schema


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    judged = quality.classify(docs, labels.filter(~held))
    rows = judged.join(labels.filter(held), "doc_id").collect()
    assert len(rows) > 800
    bad = [r["quality"] == 0 or r["toxic"] == 1 for r in rows]
    right = [(not r["keep"]) == b for r, b in zip(rows, bad)]
    caught = sum(1 for r, b in zip(rows, bad) if b and not r["keep"]) / sum(bad)
    spared = sum(1 for r, b in zip(rows, bad) if not b and r["keep"]) / (len(bad) - sum(bad))
    print("accuracy", np.mean(right), "caught", caught, "spared", spared, len(rows))
    assert np.mean(right) > 0.9 and caught > 0.75 and spared > 0.95


def test_sparse_sites_are_drawn_to_the_mean(spark):
    rows = [(i, i, "big" if i < 900 else f"host{i}", "p", -3.0 + 5.0 * (i % 10 == 0), -4.0) for i in range(950)]
    rows += [(2000 + i, i, "bad", f"path{i % 2}", 3.0, -4.0) for i in range(200)]
    scores = spark.createDataFrame(
        rows, "doc_id long, text_key long, host string, path string, low double, toxic double"
    )
    shifts = {(r["host"], r["path"]): r["shift_low"] for r in quality.posteriors(scores).collect()}
    assert len(shifts) == 1 + 50 + 2
    lonely = [abs(v) for (h, _), v in shifts.items() if h.startswith("host")]
    assert shifts["bad", "path0"] > 1 and max(lonely) < shifts["bad", "path0"]
    assert shifts["big", "p"] < 0


def plain_features(text):
    """The features of a text, one word and one character after the other."""
    words = text.split()
    if not words:
        return {"empty"}

    def runs_of(word):
        kinds = [("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c for c in word]
        return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)

    out, shapes = set(), []
    for word in words:
        shape = runs_of(word)
        if len(word) <= 32:
            core = "".join(c for c in word if c.isalnum()).lower()
            out |= {"w " + core} if core else set()
            shapes.append(shape if len(shape) <= 4 else shape[:4] + "+")
            continue
        out |= {"l " + shape[i : i + 4] for i in range(len(shape)) if i == 0 or i + 4 <= len(shape)}
        for run in "".join(c if c.isalnum() else " " for c in word).split():
            low = run.lower()
            out |= {"w " + low} if len(low) <= 32 else {"g " + low[i : i + 3] for i in range(len(low) - 2)}
    for shape in set(shapes):
        out.add(f"s {shape} {min(4, int(np.log2(len(words) / shapes.count(shape))))}")
    out.add(f"repeats {int(4 * len(set(words)) / len(words))}")
    return out | {f"words {min(12, int(np.log2(len(words))))}"}


def test_features_see_whole_texts(hard):
    for _, text in pairs(hard):
        assert set(quality.features(text, quality.word_memo())) == plain_features(text)
    for text in ("A-b_C.d,1;e", "x" * 33, "你好世界" * 40 + "坏东西", "one.two" * 30 + " three", "_" * 50, "İ" * 40):
        assert set(quality.features(text, quality.word_memo())) == plain_features(text)


@pytest.mark.parametrize("mark", ["坏东西", "-awful-"])
def test_bad_content_late_in_an_unspaced_text_is_seen(spark, mark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        text = "".join(rng.choice(letters) for _ in range(500))
        rows.append((i, text + mark + text[:20] if i % 4 == 0 else text, "s", "zh"))
        labels.append((i, int(i % 4 != 0), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    judged = quality.classify(docs, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"] for r in judged.filter("not keep").collect()} == set(range(0, 400, 4))


def test_posteriors_are_those_of_the_definition(spark):
    rng = random.Random(4)
    rows = [
        (i, i, h := f"h{min(9, int(rng.expovariate(0.4)))}", f"{h}{rng.randint(0, 3)}", rng.gauss(ord(h[1]) / 9 - 6, 1), -3.0)
        for i in range(700)
    ]
    scores = spark.createDataFrame(
        rows, "doc_id long, text_key long, host string, path string, low double, toxic double"
    )
    found = {(r["host"], r["path"]): (r["shift_low"], r["shift_toxic"]) for r in quality.posteriors(scores).collect()}
    for i, column in enumerate((4, 5)):
        p = [1 / (1 + np.exp(-r[column])) for r in rows]
        mean = sum(p) / len(p)

        def strength(groups):
            """``(n, sum of p, prior)`` of each group."""
            n = sum(g[0] for g in groups)
            spread = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 - g[2] * (1 - g[2]) for g in groups) / n
            whole = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
            return min(1e6, max(1.0, whole / spread - 1)) if spread > 0 else 1e6

        def members(name, place):
            return [x for x, r in zip(p, rows) if r[place] == name]

        hosts = {h: members(h, 2) for h in {r[2] for r in rows}}
        k = strength([(len(x), sum(x), mean) for x in hosts.values()])
        drawn = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in hosts.items()}
        paths = {(r[2], r[3]): members(r[3], 3) for r in rows}
        k = strength([(len(x), sum(x), drawn[h]) for (h, _), x in paths.items()])
        for (h, path), x in paths.items():
            q = (sum(x) + k * drawn[h]) / (len(x) + k)
            assert found[h, path][i] == pytest.approx(np.log(q / (1 - q)) - np.log(mean / (1 - mean)), abs=1e-9)
    assert len(found) == len({r[3] for r in rows})


def test_classifier_on_odd_tables(spark, hard, nothing):
    docs = hard.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("en"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1)], none.schema)
    for labels in (none, one_kind):
        judged = quality.classify(docs, labels)
        assert judged.count() == docs.count() and judged.filter("not keep").count() == 0
    assert quality.good_documents(docs, none).schema == docs.schema
    assert quality.classify(nothing, one_kind).count() == 0


def plain_nearest(rows, k, step=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows]
    for i, v in good:
        if i % step == 0:
            scores = sorted((-sum(float(a) * float(b) for a, b in zip(v, w)), j) for j, w in good if j != i)
            yield from ((i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1))


def test_recall_of_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    found = nearest.search(vectors, F.col("vec_id") % 20 == 0).collect()
    data = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    asked = np.flatnonzero(ids % 20 == 0)
    scores = data[asked] @ data.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = {int(ids[a]): set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) for a, s in zip(asked, scores)}
    got = {q: set() for q in near}
    for r in found:
        got[r["query_id"]].add(r["vec_id"])
    recall = np.mean([len(got[q] & near[q]) / 20 for q in near])
    print("recall", recall)
    assert recall >= 0.9 and len(found) == 20 * len(near)


@pytest.mark.parametrize("block_rows", [2048, 50])
def test_ties_and_unusable_vectors(spark, block_rows):
    rng = np.random.default_rng(3)
    same = rng.standard_normal(8).round(2).tolist()
    rows = [(i, (rng.standard_normal(8) * (1 + i % 3)).round(2).tolist()) for i in range(120)]
    rows += [(1000 + i, same) for i in range(300)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("nan")] * 8)]
    odd += [(2080, [float("inf")] + [1.0] * 7), (2100, [1.0] * 5), (None, same), rows[0]]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    as_float = [(i, np.array(v, np.float32).astype(np.float64).tolist()) for i, v in rows]
    found = nearest.search(
        vectors, F.col("vec_id") % 20 == 0, k=5, block_rows=block_rows, bucket_rows=400
    ).collect()
    lists = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    of = dict(as_float)
    hits = []
    for query, rank, other, _ in plain_nearest(as_float, 5):
        got = lists[query]
        assert [r["rank"] for r in found if r["query_id"] == query] and len(got) == 5 and got == sorted(got)
        for score, j in got:
            assert j != query and -score == reduce(add, (a * b for a, b in zip(of[query], of[j])))
        equal = [j for _, j in got if j >= 1000]
        assert equal == [j for j in range(1000, 1300) if j != query][: len(equal)]
        hits.append(other in [j for _, j in got])
    assert np.mean(hits) >= 0.9 and set(lists) == {i for i in of if i % 20 == 0}


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.5])], schema)
    found = nearest.search(few, F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 4.0), (0, 2, 2, 0.0)]
    alone = few.filter("vec_id = 0")
    assert nearest.search(alone, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("outlier", [False, True])
def test_uneven_norms_lose_no_neighbours(spark, outlier):
    """Log-normal lengths, and one vector ten times as long as the others."""
    rng = np.random.default_rng(11)
    data = rng.standard_normal((12_000, 16))
    data /= np.sqrt((data**2).sum(1))[:, None]
    data = (data * (1.0 if outlier else np.exp(0.5 * rng.standard_normal((12_000, 1))))).astype(np.float32)
    if outlier:
        data[7] *= 10
    table = spark.createDataFrame(enumerate(data.tolist()), "vec_id long, embedding array<float>")
    found = nearest.search(table, F.col("vec_id") % 60 == 0, k=20).collect()
    asked = np.arange(0, 12_000, 60)
    scores = data[asked].astype(np.float64) @ data.T.astype(np.float64)
    scores[np.arange(len(asked)), asked] = -np.inf
    near = dict(zip(asked.tolist(), np.argsort(-scores, axis=1, kind="stable")[:, :20].tolist()))
    got = {q: set() for q in near}
    for r in found:
        got[r["query_id"]].add(r["vec_id"])
    recall = np.mean([len(got[q].intersection(near[q])) / 20 for q in near])
    print("recall", recall)
    assert recall >= 0.9 and all(len(x) == 20 for x in got.values())


def test_queries_that_meet_too_few_vectors_see_all(spark, monkeypatch):
    """Tables of which no probe meets anything stand for an index that fails."""
    lost = nearest.Tables(np.full((1, 2, 9), 1e6), np.zeros((1, 2)), 1e-3, 1, 10.0)
    monkeypatch.setattr(nearest, "fit", lambda *args, **options: lost)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = nearest.search(table, F.col("vec_id") % 300 == 0, k=5, small=0).collect()
    as_float = [(i, np.array(v, np.float32).astype(np.float64).tolist()) for i, v in rows]
    expected = {(q, rank, i) for q, rank, i, _ in plain_nearest(as_float, 5, step=300)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == expected


def test_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(600).round(2).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    names = ["range", "table", "bucket", "block", "shard", "cell", "cells", "role", "norm", "v", "least", "query_id"]
    extra = table.select("*", *(F.lit("x").alias(n) for n in names))
    is_query = F.col("vec_id") % 20 == 0
    plain = nearest.search(table, is_query, k=5, small=0, sample=16).collect()
    clashing = nearest.search(extra, is_query, k=5, small=0, sample=16).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, clashing)) and len(plain) == 15


def test_probes_go_on_to_farther_cells():
    cells = nearest.probe_cells(np.array([0.5, 0.2]), 40)
    assert len({tuple(c) for c in cells.tolist()}) == 40 and np.abs(cells).max() >= 2


def test_blocks_of_a_benchmark_of_repeats_are_bounded(spark, monkeypatch):
    own = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    repeated = [(100 + i, " ".join(f"same{j}" for j in range(30))) for i in range(60)]
    bench = spark.createDataFrame(own + repeated, "item_id long, text string")
    docs = spark.createDataFrame([(1, repeated[0][1]), (2, own[3][1])], "doc_id long, text string")
    sizes, make = [], tiling.BenchmarkIndex.__init__

    def seen(self, rows, *args):
        sizes.append(sum(len(text) for _, text in rows))
        make(self, rows, *args)

    monkeypatch.setattr(tiling.BenchmarkIndex, "__init__", seen)
    found = tiling.contaminated(docs, bench, block_chars=1000).collect()
    assert max(sizes) <= 1000 and len(sizes) > 1
    expected = [(1, i) for i, _ in repeated] + [(2, 3)]
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == expected


def test_the_classifier_takes_small_parts_of_a_batch(spark, monkeypatch):
    """However many rows a batch has, the features of no more than 1,000 texts are held at a time."""
    tasks = []
    monkeypatch.setattr(quality, "map_rows", lambda df, fn, schema: tasks.append(fn))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    quality.evidence(docs, quality.Model({}, (0.0, 0.0)), F.lit("host"), F.lit("path"))
    batch = {name: pa.array(range(2500)) for name in ("doc_id", "text_key", "host", "path")}
    batch["text"] = pa.array(["some words"] * 2500)
    assert [len(out["low"]) for out in tasks[0](iter([batch]))] == [1000, 1000, 500]
