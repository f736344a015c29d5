"""Type inference, ranks of whole tables, label indexes and the layout that forests are fitted on."""

import datetime
import random

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from matchbook.operators import indexing, price_model
from matchbook.operators import listings as prep
from matchbook.operators.ranking import rank_rows
from matchbook.plans import warehouse
from matchbook.sources.inference import MALFORMED, infer_types, read_inferred_csv, read_text_csv

# Texts of a column and the narrowest type that reads them all.
COLUMNS = {
    "flags": (["true", "FALSE", None, ""], "boolean"),
    "small": (["1", "-7", "+12", " 3 "], "int"),
    "large": (["1", "2147483648", "", None], "bigint"),
    "huge": (["1", "9223372036854775808", "2", "3"], "double"),
    "real": (["1", "2.5", ".5", "1e-3"], "double"),
    "days": (["2020-02-29", "1999-12-31", None, " 2001-01-01"], "date"),
    "no_day": (["2021-02-29", "1999-12-31", None, "2001-01-01"], "string"),
    "mixed": (["true", "1", "0", "false"], "string"),
    "day_or_number": (["2020-01-01", "5", None, ""], "string"),
    "words": (["a", "NaN", "1", "2"], "string"),
    "nothing": ([None, "", " ", None], "string"),
}


def test_lattice(spark):
    table = list(zip(*(values for values, _ in COLUMNS.values())))
    df = spark.createDataFrame(table, ", ".join(f"{c} string" for c in COLUMNS))
    for parts in (1, 4):
        found = {r["column_name"]: r for r in infer_types(df.repartition(parts)).collect()}
        assert {c: r["data_type"] for c, r in found.items()} == {c: t for c, (_, t) in COLUMNS.items()}
        for c, (values, _) in COLUMNS.items():
            given = [v for v in values if v and v.strip()]
            assert (found[c]["n_values"], found[c]["n_missing"]) == (len(given), 4 - len(given))


def test_types_of_an_empty_table(spark):
    found = infer_types(spark.createDataFrame([], "a string, n int")).collect()
    assert [tuple(r) for r in found] == [("a", 0, 0, "string")]


def test_one_late_value_widens_a_column(spark):
    """No sample: the last of many rows decides."""
    df = spark.range(0, 50_000, 1, 8).select(F.col("id").cast("string").alias("a"))
    late = df.union(spark.createDataFrame([("12.5",)], "a string"))
    assert infer_types(df).first()["data_type"] == "int"
    assert infer_types(late).first()["data_type"] == "double"


def test_code_does_not_grow_with_the_columns(spark, capsys):
    """One small aggregate for any number of columns: a large one is run uncompiled."""
    wide = spark.range(10).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(30)])
    aggregates = []
    for columns in (wide.columns[:3], wide.columns):
        infer_types(wide, columns).explain()
        aggregates.append(capsys.readouterr().out.count("partial_"))
    assert aggregates[0] == aggregates[1] > 0


def test_forms_of_values(spark):
    """Columns that aren't text are read as text; a value is of the least type that reads it."""
    values = ["+5", "1.", ".5E+3", "tRuE", "2020-02-30", "99999999999999999999", "1 2", "5\n"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a string, n int")
    found = [infer_types(df.filter(F.col("n") == i), ["a", "n"]).collect() for i in range(len(values))]
    types = [[r["data_type"] for r in sorted(x, key=lambda r: r["column_name"])] for x in found]
    wanted = ["int", "double", "double", "boolean", "string", "double", "string", "int"]
    assert types == [[t, "int"] for t in wanted]


CSV = '''id,name,day,price,open
1,"Ann ""A"" Lee, two
lines",2020-01-05,10,true
2,,2020-02-06,12.5,false
3,short row
4,Bob,2021-03-07,7,true,too many
5,"",,8,TRUE
'''


@pytest.fixture
def csv_file(tmp_path):
    (tmp_path / "table.csv").write_text(CSV)
    return str(tmp_path / "table.csv")


def test_csv_with_line_breaks_and_malformed_rows(spark, csv_file):
    df = read_inferred_csv(spark, csv_file)
    assert dict(df.dtypes) == {
        "id": "int", "name": "string", "day": "date", "price": "double", "open": "boolean"
    }
    day = datetime.date
    assert rows(df.orderBy("id")) == [
        (1, 'Ann "A" Lee, two\nlines', day(2020, 1, 5), 10.0, True),
        (2, None, day(2020, 2, 6), 12.5, False),
        (5, None, None, 8.0, True),
    ]
    broken = read_text_csv(spark, csv_file).filter(F.col(MALFORMED).isNotNull())
    assert sorted(r["id"] for r in broken.collect()) == ["3", "4"]


@pytest.mark.parametrize("n, parts", [(0, 3), (1, 3), (5000, 7)])
def test_rank_of_every_row(spark, n, parts):
    rng = random.Random(n)
    table = [(i, rng.choice([1, 2, 2, 2, 3, None])) for i in range(n)]
    df = spark.createDataFrame(table, "id long, points int").repartition(parts)
    found = rank_rows(df, [F.desc("points"), F.asc("id")])
    table.sort(key=lambda r: (-(r[1] or 0), r[0]))
    assert sorted(rows(found.select("rank", "id"))) == [(k, r[0]) for k, r in enumerate(table, 1)]


def test_ranks_need_no_single_partition(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("points"))
    plan = rank_rows(df, [F.desc("points"), F.asc("id")])._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_indexes_of_many_labels(spark):
    """A hundred thousand labels, hot ones, nulls and ties, against plain Python."""
    rng = random.Random(4)
    labels = [f"l{rng.randrange(100_000)}" for _ in range(60_000)]
    labels += [f"l{i}" for i in range(100_000)] + ["hot"] * 40_000 + [None] * 500
    df = spark.createDataFrame([(label, "x") for label in labels], "a string, b string").repartition(6)
    counts = {}
    for label in labels:
        if label is not None:
            counts[label] = counts.get(label, 0) + 1
    order = sorted(counts, key=lambda label: (-counts[label], label))
    wanted = {label: i for i, label in enumerate(order)}
    indexes = indexing.label_indexes(df, ["a", "b"])
    found = {r["label"]: r["label_index"] for r in indexes.filter("column_name = 'a'").collect()}
    assert found == wanted
    looked_up = indexing.with_indexes(df, indexes, ["a", "b"]).select("a", "a_index", "b_index").distinct()
    for label, index, other in looked_up.collect():
        assert other == 0 and index == wanted.get(label, len(wanted))


def test_label_indexes_equal_the_indexer(spark):
    df = warehouse.listings(spark, SMALL).select("id", *price_model.CATEGORIES)
    indexes = indexing.label_indexes(df, price_model.CATEGORIES)
    ours = indexing.with_indexes(df, indexes, price_model.CATEGORIES)
    theirs = price_model.string_indexer().fit(df).transform(df)
    names = [f"{c}_index" for c in price_model.CATEGORIES]
    theirs = theirs.select("id", *[F.col(c).cast("int") for c in names])
    assert sorted(rows(ours.select("id", *names))) == sorted(rows(theirs))


def test_forest_depends_on_the_rows_alone(spark):
    """Another shuffle width, other files and another order: the same predictions."""
    training, test = prep.split(warehouse.listings(spark, SMALL))
    predicted = []
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, given in (("4", training), ("8", training.repartition(5, "label"))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            forest = price_model.regressor("rf").setNumTrees(6).setMaxDepth(4)
            model = price_model.fit(price_model.price_pipeline(forest), given)
            scored = model.transform(test).select("id", F.round("prediction", 9).alias("p"))
            predicted.append(dict(rows(scored)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert predicted[0] and predicted[0] == predicted[1]
