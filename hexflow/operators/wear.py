"""How walking changes affordance, and how rest restores it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow import params as P


def _fixed():
    return (F.col("friction") == 1.0) | (F.col("friction") == P.IMPASSABLE)


def wear(cells: DataFrame, desire: DataFrame) -> DataFrame:
    """Cells with their affordance after the visits of ``desire`` (cell_id, score); the cap binds the new value."""
    out = cells.join(desire.select("cell_id", "score"), "cell_id", "left")
    k = F.when(F.col("friction") == 4.0, 1.5).otherwise(0.8)
    worn = F.least(F.lit(P.SOFT_CAP), F.col("affordance") + F.col("score") * P.UPDATE_RATE / (P.WEAR_VOLUME * k))
    return out.withColumn("affordance", F.when(_fixed() | F.coalesce(F.col("score") <= 0, F.lit(True)), F.col("affordance")).otherwise(worn)).drop("score")


def decay(cells: DataFrame) -> DataFrame:
    """Cells after one run's decay; the floor raises what lies below it."""
    k = F.when(F.col("friction") == 4.0, 0.5).otherwise(1.5)
    return cells.withColumn("affordance", F.when(_fixed(), F.col("affordance")).otherwise(F.greatest(F.lit(0.1), F.col("affordance") * F.exp(-P.DECAY_RATE * k))))
