"""Text and record sources: notes with front matter, tolerant record logs, a fetch cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower-cased letters and digits, other runs as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def read_notes(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(name, title, description, body, path) of notes with a front matter between --- lines; a note without one is all
    body and takes its name from its file. All files are read; max_bytes leaves larger ones out."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    if max_bytes is not None:
        rows = rows.where(F.col("size") <= max_bytes)
    return parse_notes(rows)


def parse_notes(rows: DataFrame) -> DataFrame:
    """The same of notes as rows (value, path)."""
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    file = F.regexp_extract("path", r"([^/]+?)(?:\.\w+)?$", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", ""), r"\A\s+|\s+\z", "")
    return rows.select(slug(F.coalesce(field("name"), file)).alias("name"), F.coalesce(field("title"), field("name"), file).alias("title"), field("description").alias("description"), body.alias("body"), "path")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Record lines; damaged ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def merge_results(results: DataFrame, key: str = "url", source_rank: str = "rank") -> DataFrame:
    """Results of several sources, each url once, from the source that ranks first."""
    own = Window.partitionBy(key).orderBy(source_rank)
    return results.withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("n_")


def fresh(cache: DataFrame, now: Column, hours: int = 24, stamp: str = "created_at") -> DataFrame:
    """Cache rows not older than `hours`."""
    return cache.where(F.col(stamp) > now - F.expr(f"interval {hours} hours"))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each after its length in eight little-endian bytes, so that no two lists collide."""
    sized = []
    for p in parts:
        raw = F.coalesce(p.cast("string"), F.lit("")).cast("binary")
        size = F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0"))
        sized += [F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(size), F.lit("(..)"), F.lit(1))), "")), raw]
    return F.sha2(F.concat(*sized), 256)
