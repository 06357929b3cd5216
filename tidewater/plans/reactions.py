"""Queries over zone reactions, swing shapes, basis, predictions and breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reactions
from ..session import table
from .common import DAILY, HOURLY, daily, hourly, r6, shown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_FS = 'f AS (SELECT symbol, ts, c + 2 + 0.01 * (epoch(ts) / 3600 % 24) AS c FROM bars), j AS (SELECT symbol, date_trunc(\'day\', ts)::TIMESTAMP AS day, quantile_cont(f.c - bars.c, 0.5) AS basis, count(*) AS n FROM f JOIN bars USING (symbol, ts) GROUP BY 1, 2), a AS (SELECT symbol, day + INTERVAL 12 hours AS "at", basis FROM j WHERE n >= 6)'


@query(f'WITH {HOURLY}, {_FS} SELECT symbol, "at", round(basis, 6) AS basis FROM a')
def basis_anchors(spark, d):
    b = hourly(spark, d)
    futures = b.withColumn("c", F.col("c") + 2 + 0.01 * (F.unix_timestamp("ts") / 3600 % 24))
    return shown(reactions.basis_anchors(futures, b))


@query(
    f"""WITH {HOURLY}, {_FS}, s AS (SELECT symbol, regr_slope(basis, epoch("at") / 86400) AS slope FROM a GROUP BY 1 HAVING count(*) >= 2),
    p AS (SELECT b.*, a."at" AS ta, a.basis AS ba FROM bars b ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts >= a."at"), q AS (SELECT b.symbol, b.ts, a."at" AS tb, a.basis AS bb FROM bars b ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts <= a."at"),
    r AS (SELECT p.*, q.tb, q.bb, slope FROM p JOIN q USING (symbol, ts) LEFT JOIN s USING (symbol)),
    v AS (SELECT symbol, ts, c, coalesce(ba + (bb - ba) * coalesce((epoch(ts) - epoch(ta)) / nullif(epoch(tb) - epoch(ta), 0), 0), ba + slope * (epoch(ts) - epoch(ta)) / 86400, bb + slope * (epoch(ts) - epoch(tb)) / 86400, 0) AS basis FROM r)
    SELECT symbol, ts, round(c - basis, 8) AS c, round(basis, 8) AS basis FROM v"""
)
def basis_adjusted(spark, d):
    b = hourly(spark, d)
    futures = b.withColumn("c", F.col("c") + 2 + 0.01 * (F.unix_timestamp("ts") / 3600 % 24))
    out = reactions.without_basis(b, reactions.basis_anchors(futures, b))
    rounded = out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("c", 8).alias("c"), F.round("basis", 8).alias("basis"))
    return rounded


PRED = """pr AS (SELECT row_number() OVER (ORDER BY symbol, ts) AS id, symbol, CASE epoch(ts)::BIGINT // 86400 % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'neutral' END AS direction, 0.6::DOUBLE AS p, c AS reference,
  CASE WHEN epoch(ts)::BIGINT // 86400 % 3 = 0 THEN c * 0.9 ELSE c * 1.1 END AS stop, CASE WHEN epoch(ts)::BIGINT // 86400 % 4 = 3 THEN NULL WHEN epoch(ts)::BIGINT // 86400 % 3 = 0 THEN c * 1.2 ELSE c * 0.8 END AS target, ts AS start_ts, ts + INTERVAL 5 days AS end_ts FROM bars)"""


@query(
    f"""WITH {DAILY}, {PRED}, k AS (SELECT pr.*, b.ts, b.h, b.l, b.c FROM pr JOIN bars b ON b.symbol = pr.symbol AND b.ts > start_ts AND b.ts <= end_ts),
    g AS (SELECT id, direction, p, reference, target, min(ts) FILTER (WHERE (direction = 'long' AND l <= stop) OR (direction = 'short' AND h >= stop)) AS s, min(ts) FILTER (WHERE (direction = 'long' AND h >= target) OR (direction = 'short' AND l <= target)) AS t, arg_max(c, ts) AS last FROM k GROUP BY ALL),
    r AS (SELECT *, (last / reference - 1) * 100 AS raw FROM g), o AS (SELECT *, CASE direction WHEN 'long' THEN raw WHEN 'short' THEN -raw ELSE -abs(raw) END AS signed FROM r),
    f AS (SELECT *, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'stop' WHEN t IS NOT NULL THEN 'target' WHEN direction = 'neutral' THEN CASE WHEN abs(raw) < 0.15 THEN 'flat' ELSE 'wrong' END WHEN abs(raw) < 0.02 THEN 'flat' WHEN signed > 0 THEN 'correct' ELSE 'wrong' END AS outcome FROM o)
    SELECT direction, outcome, count(*) AS n, {r6('avg(signed) AS mean_return')}, round(avg((p - (CASE WHEN direction = 'neutral' THEN outcome = 'flat' WHEN target IS NOT NULL THEN outcome = 'target' ELSE outcome = 'correct' END)::INTEGER) ** 2), 6) AS brier FROM f GROUP BY 1, 2"""
)
def score_predictions(spark, d):
    b = daily(spark, d)
    day = F.floor(F.unix_timestamp("ts") / 86400)
    up = day % 3 == 0
    rows = b.select(
        F.concat_ws("/", "symbol", F.unix_timestamp("ts")).alias("id"), "symbol", F.when(up, "long").when(day % 3 == 1, "short").otherwise("neutral").alias("direction"), F.lit(0.6).alias("p"), F.col("c").alias("reference"),
        F.when(up, F.col("c") * 0.9).otherwise(F.col("c") * 1.1).alias("stop"), F.when(day % 4 == 3, None).when(up, F.col("c") * 1.2).otherwise(F.col("c") * 0.8).alias("target"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 5 days")).alias("end_ts"),
    )
    out = reactions.score_predictions(rows, b).groupBy("direction", "outcome").agg(F.count("*").alias("n"), F.avg("return_pct").alias("mean_return"), F.avg("brier").alias("brier"))
    return shown(out)


_B = "t AS (SELECT (l_discount - 0.05) * 20 + l_tax AS r, l_returnflag AS flag, isodow(l_shipdate) - 1 AS day, [l_linestatus, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END] AS tags FROM lineitem), b AS (SELECT 'flag' AS dimension, flag AS bucket, r FROM t UNION ALL SELECT 'day', day::VARCHAR, r FROM t UNION ALL SELECT 'tags', unnest(tags), r FROM t), k AS (SELECT dimension, bucket, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, avg(r) AS mean FROM b GROUP BY 1, 2)"


def _breakdown(spark, d, where="true"):
    t = table(spark, d, "lineitem").where(where).withColumn("r", (F.col("l_discount") - 0.05) * 20 + F.col("l_tax"))
    tags = F.array("l_linestatus", F.when(F.col("l_quantity") > 25, "large").otherwise("small"))
    return reactions.breakdown(t, {"flag": F.col("l_returnflag"), "day": F.weekday("l_shipdate"), "tags": tags})


@query(f"WITH {_B} SELECT dimension, bucket, n, wins, round(wins / n, 6) AS win_rate, round(mean, 5) AS mean FROM k")
def breakdown(spark, d):
    return _breakdown(spark, d).select("dimension", "bucket", "n", "wins", F.round("win_rate", 6).alias("win_rate"), F.round("mean", 5).alias("mean"))
