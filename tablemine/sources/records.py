"""JSON records in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def records_to_table(df: DataFrame, schema: T.StructType | str, *, column: str = "value") -> DataFrame:
    """Parse messages that hold a JSON record or a list of records into rows.

    An empty list gives no rows. A message that is neither a list nor an object raises when it is read, with
    no message skipped silently. Works on batch and streaming DataFrames.
    """
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    text = F.trim(F.col(column))
    first = F.substring(text, 1, 1)
    checked = F.when(first == "[", text).when(first == "{", F.concat(F.lit("["), text, F.lit("]"))).otherwise(
        F.raise_error(F.concat(F.lit("not a list of records: "), F.coalesce(F.substring(text, 1, 40), F.lit("NULL"))))
    )
    return df.select(F.explode(F.from_json(checked, T.ArrayType(struct))).alias("_r")).select("_r.*")


def table_to_records(df: DataFrame, *, column: str = "value") -> DataFrame:
    """Each row as one JSON object; missing fields are written as null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(column))
