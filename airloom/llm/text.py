"""Words and small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the separators between words, space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """A missing text is an empty one."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than SPACES, in order."""
    inner = F.btrim(whole(text), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(inner == "", none).otherwise(F.split(inner, _SPLIT))


def id_text(column: Column) -> Column:
    """Text of an id; a missing id counts as an empty one."""
    return F.coalesce(column.cast("string"), F.lit(""))


def crc_bucket(column: Column, modulus: int) -> Column:
    return F.crc32(id_text(column).cast("binary")) % modulus


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Working column names that the input does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
