"""Types of text columns, found from all of their values.

Every type reads less than the next of its chain: ``int < bigint < double < string``;
``boolean`` and ``date`` are below ``string`` alone. The type of a column is the least one
that reads all its values. Whether one reads them all is a bit that partial aggregates can
carry, so the bits of all columns come out of one pass over all rows, however they are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# How values of a type are written.
BOOLEAN_FORM = "(?i)^(true|false)$"
WHOLE_FORM = r"^[+-]?[0-9]+$"
NUMBER_FORM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORM = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: Text of any of these; anchored as a whole, so that other text is left at its first character.
ANY_FORM = (
    r"^(?:(?i:true|false)|[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
    "|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
)

#: From the narrowest to the widest; a column without values is text.
LATTICE = ("boolean", "int", "bigint", "double", "date")

#: Column of the rows that don't have the fields of the header.
MALFORMED = "_malformed"


def _readers(value: Column) -> Column:
    """Bits of the types that read the text, by their place in ``LATTICE``; null for null.

    Forms come first, as a failed cast is dear, and one form for all of them before the
    others: most text is of none.
    """

    def bits(*types: str) -> Column:
        return F.lit(sum(1 << LATTICE.index(t) for t in types))

    whole = (
        F.when(value.try_cast("int").isNotNull(), bits("int", "bigint", "double"))
        .when(value.try_cast("bigint").isNotNull(), bits("bigint", "double"))
        .otherwise(bits("double"))
    )
    return (
        F.when(value.isNull(), None)
        .when(~value.rlike(ANY_FORM), F.lit(0))
        .when(value.rlike(WHOLE_FORM), whole)
        .when(value.rlike(NUMBER_FORM), bits("double"))
        .when(value.rlike(BOOLEAN_FORM), bits("boolean"))
        .when(value.try_cast("date").isNotNull(), bits("date"))
        .otherwise(F.lit(0))
    )


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, n_values, n_missing, data_type`` of text columns, in one pass.

    Null and empty text are missing and fit any type; blanks around a value don't count.
    The values of a row go one by one through the same small expression: the JVM leaves a
    method over all columns uncompiled once it is large, whatever the session's settings.
    """
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)])
    place = "_place"
    values = df.select(F.posexplode(F.array(*[F.col(name).cast("string") for name in names])).alias(place, "_text"))
    # One row for each column and task leaves the scan.
    seen = (
        values.select(place, F.nullif(F.trim("_text"), F.lit("")).alias("_given"))
        .select(place, _readers(F.col("_given")).alias("_bits"))
        .groupBy(place)
        .agg(
            F.bit_and("_bits").alias("_bits"),
            F.count("_bits").alias("n_values"),
            F.count_if(F.col("_bits").isNull()).alias("n_missing"),
        )
    )
    # No value: the bits are null, and so the type stays text.
    data_type = F.lit("string")
    for i in reversed(range(len(LATTICE))):
        data_type = F.when(F.getbit("_bits", F.lit(i)) == 1, LATTICE[i]).otherwise(data_type)
    none = F.lit(0).cast("bigint")
    # Every column has its row, in a table without rows too.
    every = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias(place, "column_name"))
    return every.join(F.broadcast(seen), place, "left").select(
        "column_name",
        F.coalesce("n_values", none).alias("n_values"),
        F.coalesce("n_missing", none).alias("n_missing"),
        data_type.alias("data_type"),
    )


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text, rows of another shape in ``_malformed``.

    Quoted fields may hold separators, doubled quotes and line breaks. A row with more or
    fewer fields than the header keeps what it has and stands whole in ``_malformed``.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    schema = StructType()
    for name in [*names, MALFORMED]:
        schema.add(name, "string")
    shaped = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED)
    return shaped.schema(schema).csv(path)


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_text_csv`` that have all fields, with the types that fit all of them.

    Two passes, as any inference: one for the types, one for the values. The driver gets
    one row for each column.
    """
    text = read_text_csv(spark, path)
    # Spark leaves the shape of a row out when no other column is asked for.
    whole = text.filter(F.col(MALFORMED).isNull())
    names = [c for c in text.columns if c != MALFORMED]
    types = {row["column_name"]: row["data_type"] for row in infer_types(whole, names).collect()}
    return whole.select(*[_typed(name, types[name]).alias(name) for name in names])


def _typed(name: str, data_type: str) -> Column:
    given = F.nullif(F.trim(F.col(name)), F.lit(""))
    return F.nullif(F.col(name), F.lit("")) if data_type == "string" else given.try_cast(data_type)
