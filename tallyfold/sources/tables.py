"""Parquet and CSV in and out.

Parquet is the storage to prefer: it keeps types, prunes columns and takes
pushed filters. CSV is read with a given schema, so no pass is spent on
guessing types, unless the caller has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import setting


#: folders that a task writes at a time; each holds the buffer of one file
OPEN_FILES = 4


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: names that writers give a column of row numbers
INDEX_NAMES = ("", "_c0", "X", "Unnamed: 0")
_NUMBER = r"(?i)^[+-]?(inf|infinity|nan|\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?)$"


def _numbers(df: DataFrame) -> DataFrame:
    """Text columns that hold numbers only, infinities in any spelling, as double: one pass over these columns."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    value = {t: F.nullif(F.trim(F.col(f"`{t}`")), F.lit("")) for t in text}
    found = df.agg(*[F.bool_and(value[t].rlike(_NUMBER)).alias(f"c{i}") for i, t in enumerate(text)]).first()
    return df.withColumns({t: value[t].cast("double") for i, t in enumerate(text) if found[i]})


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    missing: str = "NA",
    drop_index: bool = False,
) -> DataFrame:
    """Read CSV with a header line.

    ``missing``, the empty field and the quoted empty string all become NULL.
    Floating-point fields may spell infinity ``Inf``, ``inf`` or ``Infinity``;
    anything that is not a number raises instead of turning into NULL. Without
    a schema a text column whose every value is such a number becomes double.
    ``drop_index`` drops a leading index column, known by its name: none,
    ``_c0`` or ``X``; it raises if the first column is called otherwise.
    """
    reader = spark.read.option("header", True).option("nullValue", missing)
    if schema is None:
        df = _numbers(reader.option("inferSchema", True).csv(path))
    else:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        floating = [f for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        as_text = T.StructType(
            [T.StructField(f.name, T.StringType()) if f in floating else f for f in schema.fields]
        )
        df = reader.option("mode", "FAILFAST").option("enforceSchema", False).schema(as_text).csv(path)
        df = df.withColumns(
            {f.name: F.nullif(F.col(f.name), F.lit("")).cast(f.dataType) for f in floating}
        )
    if drop_index:
        if df.columns[0].strip() not in INDEX_NAMES:
            raise ValueError(f"the first column, {df.columns[0]!r}, is no index; its name would be one of {INDEX_NAMES}")
        df = df.drop(df.columns[0])
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text}) if text else df


def read_checked(
    spark: SparkSession, path: str, schema: T.StructType | str, missing: str = "NA", sep: str = ","
) -> DataFrame:
    """Read CSV lines with a header, none of them lost: the columns, ``_line`` and ``_reason``.

    A line that does not fit the schema keeps its text in ``_line`` and says why in
    ``_reason`` (its number of fields, or the first field that is not of its
    column's type); its columns are NULL. Both are NULL for a good line. One
    pass; ``kept`` and ``rejected`` split the result. ``missing``, the empty field
    and the quoted empty string become NULL, infinities may be spelt as in
    ``read_csv``. Header and empty lines are skipped. A field may be quoted, quotes inside it
    doubled, but not hold a line break.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names
    as_text = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_broken", T.StringType())])
    options = {"sep": sep, "nullValue": missing, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    lines = spark.read.text(path).filter((F.trim("value") != "") & (F.col("value") != sep.join(names)))
    fields = lines.select("value", F.from_csv("value", as_text.simpleString()[7:-1].replace(":", " "), options).alias("_f"))
    value = {n: F.nullif(F.col(f"_f.`{n}`"), F.lit("")) for n in names}
    typed = {f.name: value[f.name].try_cast(f.dataType) for f in schema.fields}
    count = F.col("_f._broken").isNotNull()
    wrong = F.when(count, F.concat(F.lit(f"does not have {len(names)} fields")))
    for f in schema.fields:
        bad = value[f.name].isNotNull() & typed[f.name].isNull()
        wrong = wrong.when(bad, F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), value[f.name]))
    checked = fields.select("value", wrong.alias("_reason"), *[typed[n].alias(n) for n in names])
    good = F.col("_reason").isNull()
    return checked.select(
        *[F.when(good, F.col(f"`{n}`")).alias(n) for n in names], F.when(~good, F.col("value")).alias("_line"), "_reason"
    )


def kept(checked: DataFrame) -> DataFrame:
    """The good rows of ``read_checked``."""
    return checked.filter(F.col("_reason").isNull()).drop("_line", "_reason")


def rejected(checked: DataFrame) -> DataFrame:
    """The lines that ``read_checked`` could not use, with the reason."""
    return checked.filter(F.col("_reason").isNotNull()).select("_line", "_reason")


def with_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace all column names by position."""
    return df.toDF(*names)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write one table (no row-index column) and return its path."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA").option("emptyValue", "")
    writer.save(path)
    return path


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", mode: str = "overwrite"
) -> str:
    """Write one table laid out in a folder per value of ``by``.

    Takes the place of one file per parameter combination: a reader prunes to
    the folders it asks for. Rows are first gathered by folder, so a folder gets
    few files; the rebalance splits a folder that holds much of the table. A task
    writes the rows of up to ``OPEN_FILES`` folders as they come; only beyond these
    it sorts the rest by folder, which takes memory for all their rows.
    """
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(fmt).save(path)
    return path


def store_bucketed(
    df: DataFrame, path: str, by: Sequence[str], buckets: int, sort: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """Store a table by key and read it back: rows of a key lie in one of ``buckets`` files.

    Windows, aggregates and joins whose keys contain ``by`` then need no shuffle of
    the rows, in this query and all later ones. Rows are shuffled once, before
    writing, so a bucket is one file, sorted by ``by`` and ``sort``. ``path`` is a
    folder that all machines share; the table is known to the session under
    ``name`` (made up if not given). Take as many buckets as tasks should read
    the table; a key that fills several of them is for ``windows`` to cut.
    """
    spark = df.sparkSession
    name = name or f"stored_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *[F.col(c) for c in by])
    order = list(dict.fromkeys([*by, *sort]))
    # the log is written once and read often: the denser codec
    dealt.write.format("parquet").option("compression", "zstd").bucketBy(buckets, *by).sortBy(*order).option("path", path).saveAsTable(name)
    return spark.table(name)
