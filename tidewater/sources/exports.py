"""Feature matrices out and in: rows as JSON lines, instants as text, what isn't a number as null, classes by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean(value: Column, places: int = 6) -> Column:
    """A finite number to some places, halves to even; null for what is none."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.bround(x, places))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_matrix(rows: DataFrame, path: str, ts: str, numbers: list[str], keys: list[str], label: str, places: int = 6) -> None:
    """Rows as JSON lines of keys, t, numbers and the label's code; the table appears as a whole once it is complete."""
    rows.select(*keys, iso(F.col(ts)).alias("t"), *(clean(F.col(c), places).alias(c) for c in numbers), F.col(label).cast("int").alias(label)).write.mode("errorifexists").json(path)


def read_matrix(spark: SparkSession, path: str, keys: list[str], numbers: list[str], label: str, classes: dict[int, str]) -> DataFrame:
    """Such rows with the label by name; unknown codes are null, damaged lines go."""
    schema = ", ".join([*(f"{k} string" for k in keys), "t string", *(f"{c} double" for c in numbers), f"{label} int"])
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    names = F.create_map(*[x for code, name in classes.items() for x in (F.lit(code), F.lit(name))])
    return rows.withColumn(label, F.try_element_at(names, F.col(label)))
