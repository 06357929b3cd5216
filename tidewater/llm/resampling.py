"""Importance resampling towards a target distribution: hashed n-gram features, log-ratio gains, Gumbel noise, top share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_spread, written

RUNS, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, 10, "2024"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased."""
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(plain, _BETWEEN), lambda w: w != "")


def features(words: Column, runs: int = RUNS, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to `runs` consecutive words, repeats included."""

    def bucket(run: Column) -> Column:
        return (F.crc32(run.cast("binary")) % buckets).cast("int")

    def longer(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, bucket), *(longer(n) for n in range(2, runs + 1))) if runs > 1 else F.transform(words, bucket)


def _counts(rows: DataFrame, times: Column) -> DataFrame:
    return rows.select(F.explode("features").alias("bucket"), times.alias("times")).groupBy("bucket").agg(F.sum("times").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln of a bucket's smoothed share of the target over that of the source), for every bucket: as many
    numbers as there are buckets, whatever the corpus."""
    spark = source.sparkSession
    all_buckets = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    rows = all_buckets.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    totals = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).first()
    b = float(buckets)
    ratio = ((F.col("t") + 1.0) * (F.lit(float(totals["all_s"])) + b)) / ((F.col("s") + 1.0) * (F.lit(float(totals["all_t"])) + b))
    return [r["gain"] for r in rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    runs: int = RUNS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    share: int = SHARE,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: weight says how much likelier its words are in the
    target than in `docs` (the floored mean of its features' gains), score adds Gumbel noise by seed and id, and the
    `share` percent of the documents with at least least_words words that score highest are ranked from 1: a draw
    without replacement in proportion to the exponential of weight / 1000. Others have no rank.

    Equal texts are one row while features are found, counted and weighed: the full text is the group's key, tasks
    collapse theirs before the shuffle, and counts are taken times the number of copies. The weight goes back to each
    document by the text's SHA-256. Ranks come from the number of documents above each score, a table as long as scores
    have values (a few ten thousand), and from row numbers among equal scores, at most a 2,700th of the documents as the noise is spread.

    Null, empty and wordless texts have no features, weight 0 and no rank. A null id is '' in the hash and goes before
    other ids on ties; equal scores go by id, then by features and weight. Repeated rows are documents of their own. Very
    long texts count whole. Of an empty table comes no row; an empty target weighs against the source alone. Other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("name"), "copies", words(F.col("text")).alias("words"))
    texts = written(texts.select("name", "copies", F.size("words").alias("n_words"), features(F.col("words"), runs, buckets).alias("features")))
    aim = target.select(features(words(F.col(target_col).cast("string")), runs, buckets).alias("features"))
    gain = gains(_counts(texts, F.col("copies")), _counts(aim, F.lit(1)), buckets)
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate("features", F.lit(0).cast("long"), lambda so_far, x: so_far + F.get(table, x))
    weights = texts.select("name", "n_words", F.size("features").cast("long").alias("n_features"), F.when(F.size("features") > 0, F.floor(total / F.nullif(F.size("features"), F.lit(0)))).alias("weight"))
    own = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("name")).join(weights, "name", "left").na.fill(0, ["n_words", "n_features", "weight"])
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = written(own.select("doc_id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("eligible")))
    return _ranked(scored, share)


def _ranked(scored: DataFrame, share: int) -> DataFrame:
    spark = scored.sparkSession
    levels = [(r["score"], r["n"]) for r in scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()]
    drawn = share * sum(n for _, n in levels) // 100
    above, before = 0, []
    for value, n in levels:
        if above >= drawn:
            break
        before.append((value, above))
        above += n
    least = before[-1][0] if before else None
    reaches = F.col("eligible") & (F.col("score") >= F.lit(least).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    ahead = spark.createDataFrame(before, "score long, ahead long")
    among = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight")
    top = scored.where(reaches).join(ahead, "score").withColumn("rank", F.col("ahead") + F.row_number().over(among))
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~F.coalesce(reaches, F.lit(False)))
    return top.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    return importance_resample(read_spread(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 by its definition: eight shifts for each byte, over the distinct words alone.
OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), aim AS (
  SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark
), own AS (SELECT doc_id, unnest(w) AS word FROM split
), vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM own UNION SELECT word FROM aim)
), byte_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM range(256) r(b)
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(1, length(h)::BIGINT, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM vocabulary, byte_table
), s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (word) GROUP BY 1
), t AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (word) GROUP BY 1
), gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000))))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= 10 * count(*) OVER () // 100
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
