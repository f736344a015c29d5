"""The stages of the pipeline one by one against plain Python, and the SQL against the queries."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from matchbook.llm import quality, tiling
from matchbook.llm.queries import VOCABULARY, oracle_sql, queries

from .conftest import SMALL, pairs
from .test_lines_simhash_secrets import key_of, plain_components, plain_fingerprint
from .test_quality_tiling_nearest import plain_tiles


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SMALL).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_columns_stay(stages):
    assert all(df.schema == stages[0].schema for df in stages[:5])


def test_rejected_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r["doc_id"] for r in quality.classify(stages[0], labels).filter("keep").collect()}
    rows = {tuple(r) for r in stages[0].collect() if r["doc_id"] in kept}
    assert {tuple(r) for r in stages[1].collect()} == rows and 0 < len(kept) < stages[0].count()


def test_frequent_lines_go(stages):
    before, after = pairs(stages[1]), dict(pairs(stages[2]))
    seen = {}
    for doc_id, text in before:
        for key in {key_of(x) for x in text.split("\n")}:
            seen.setdefault(key, set()).add(doc_id)
    for doc_id, text in before:
        kept = [x for x in text.split("\n") if not key_of(x) or len(seen[key_of(x)]) < 10]
        assert after[doc_id] == "\n".join(kept)
    assert len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    marks = {doc_id: plain_fingerprint(text) for doc_id, text in pairs(stages[2])}
    group = plain_components(marks, 3)
    low = {}
    for doc_id, mark in marks.items():
        low[group[mark]] = min(doc_id, low.get(group[mark], doc_id))
    assert sorted(d for d, _ in pairs(stages[3])) == sorted(low.values())


def test_leaks_go(spark, stages):
    items = [tiling.tokens(t) for _, t in pairs(spark.read.parquet(f"{SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))]
    kept = {d for d, _ in pairs(stages[4])}
    for doc_id, text in pairs(stages[3]):
        words = tiling.tokens(text)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        shared = [x for x in items if grams.intersection(tuple(x[i : i + 5]) for i in range(len(x) - 4))]
        small = [w for x in shared for w in x]
        near = [w if w in set(small) else "" for w in words] if shared else []
        leak = any(plain_tiles(near, x, 5) >= 0.8 * len(x) for x in shared) if len(near) < 3000 else doc_id not in kept
        assert (doc_id in kept) == (not leak)


def test_ids_are_the_librarys(stages):
    library = Tokenizer.from_file(VOCABULARY)
    sizes = {r["doc_id"]: r["n_tokens"] for r in stages[5].collect()}
    assert sizes == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in pairs(stages[4])}


def test_run_is_all_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.parametrize("rows", ["hard", "nothing"])
def test_stages_on_hard_and_empty_tables(spark, request, tmp_path, rows):
    docs = request.getfixturevalue(rows)
    if rows == "hard":
        columns = {"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}
        docs = docs.withColumns(columns)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs, before = spark.read.parquet(f"{tmp_path}/{k}"), docs
        assert k == 4 or docs.columns == columns
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in docs.collect())
    library = Tokenizer.from_file(VOCABULARY)
    assert found == sorted((d is not None, d or 0, len(library.encode(t).ids)) for d, t in pairs(before))
    assert bool(found) == (rows == "hard")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_their_sql(spark, name):
    with duckdb.connect() as database:
        database.execute(f"create view documents as from '{SMALL}/documents.parquet'")
        found = database.execute(oracle_sql()[name])
        columns = [c[0] for c in found.description]
        expected = sorted(found.fetchall(), key=repr)
    rows = queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, rows), key=repr) == expected


def test_ten_operators_and_the_pipeline_are_registered():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
