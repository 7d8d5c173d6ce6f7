"""Delimited and Parquet tables, always with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, StringType, StructField, StructType

from labelloom.functions.labels import numeric
from labelloom.functions.schema import normalize_header, require_columns
from labelloom.sources.quoted import read_records

COMMA, TAB, SEMICOLON = ",", "\t", ";"

# The spellings of a missing field.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _typed(field: StructField, missing: Sequence[str]) -> Column:
    """A text column as the type of ``field``; numbers that cannot be read are null."""
    text = F.col(f"`{field.name}`")
    known = F.when(~text.isin(*missing), text)
    if isinstance(field.dataType, IntegralType):
        # whole numbers are read as such: a double has no place for 19 digits
        known = F.coalesce(known.try_cast(field.dataType), numeric(known).try_cast(field.dataType))
    elif isinstance(field.dataType, FractionalType):
        known = known.try_cast(field.dataType)
    else:
        known = known.cast(field.dataType)
    return known.alias(field.name)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    sep: str = COMMA,
    multi_line: bool = False,
    lower_header: bool | None = None,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """A delimited table with a header, double-quoted fields and an optional byte-order mark.

    ``schema`` names the wanted columns as they stand in the header, in any order; others are left out,
    a missing one raises. All files of ``path`` have the same header (the first line of one file is
    read to learn it, the others are checked). Fields that hold line breaks need ``multi_line=True``;
    files are then read twice, split by split (see ``quoted``). Fields spelled as ``missing``
    become null in every column. Numbers are read leniently: what is no number becomes null, and an
    integer may be written as 1.0. ``lower_header`` strips the names, and lowers them too if True.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line}
    header = spark.read.options(**options).csv(path).columns
    if multi_line:
        text = read_records(spark, path, header, sep)
    else:
        raw = StructType([StructField(name, StringType()) for name in header])
        text = spark.read.schema(raw).csv(path, enforceSchema=False, mode="FAILFAST", nullValue="", emptyValue="", **options)
    require_columns(text, schema.names)
    df = text.select(*[_typed(f, missing) for f in schema.fields])
    return df if lower_header is None else normalize_header(df, lower=lower_header)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """Comma-separated table."""
    return read_delimited(spark, path, schema, COMMA, **options)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """Tab-separated table; header names are stripped and lowered."""
    return read_delimited(spark, path, schema, TAB, **{"lower_header": True, **options})


def read_semicolon(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """Semicolon-separated table; header names are stripped."""
    return read_delimited(spark, path, schema, SEMICOLON, **{"lower_header": False, **options})


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
