"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import indicators
from . import decisions, everyday, learners, market, matrix, packs, reactions, structures
from .common import hourly, shown

QUERIES: dict = market.QUERIES | everyday.QUERIES | matrix.QUERIES | structures.QUERIES | decisions.QUERIES | reactions.QUERIES | learners.QUERIES | packs.QUERIES
ORACLES: dict[str, str] = market.ORACLES | everyday.ORACLES | matrix.ORACLES | structures.ORACLES | decisions.ORACLES | reactions.ORACLES | learners.ORACLES | packs.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with their mean, bands and confirmed body swings."""
    bars = indicators.body_swings(indicators.bollinger(hourly(spark, sf_dir)))
    return shown(bars, "symbol", "ts", "o", "h", "l", "c", "v", "mid", "upper", "lower", "body_high", "body_low")
