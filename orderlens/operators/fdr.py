"""Control of the false discovery rate over families of tests, as windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import FAMILY_ID, FDR_ALPHA
from ..schema import EstimationResult


def benjamini_hochberg(tests: DataFrame, p: str = "p_raw", order: str = "name", family: str | None = None, alpha: float = FDR_ALPHA) -> DataFrame:
    """Adds p_adj and rejected; rows of unknown p are left out of the family's size and get NULLs.

    A test is rejected if its rank is at most the last rank whose p is within rank / m * alpha: the rule on raw
    values, which a rounded p_adj at the border can't upset.
    """
    by = [F.col(family)] if family else [F.lit(0)]
    tested = Window.partitionBy(*by, F.col(p).isNull())
    up, down = tested.orderBy(p, order), tested.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("__rank", F.row_number().over(up)).withColumn("__m", F.count(F.lit(1)).over(tested))
    within = F.when(F.col(p) <= F.col("__rank") / F.col("__m") * F.lit(alpha), F.col("__rank"))
    ranked = ranked.withColumn("__last", F.coalesce(F.max(within).over(tested), F.lit(0)))
    ranked = ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down)))
    ranked = ranked.withColumn("rejected", F.when(F.col(p).isNotNull(), F.col("__rank") <= F.col("__last")))
    return ranked.withColumn("p_adj", F.when(F.col(p).isNotNull(), F.col("p_adj"))).drop("__rank", "__m", "__last")


class BenjaminiHochbergController:
    """Stamps results with their adjusted p-values."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def control(self, results: Sequence[EstimationResult], family_id: str = FAMILY_ID, alpha: float = FDR_ALPHA) -> list[EstimationResult]:
        if not results:
            return []
        tests = self.spark.createDataFrame([(i, r.p_value_raw) for i, r in enumerate(results)], "i int, p_raw double")
        found = {r["i"]: r for r in benjamini_hochberg(tests, order="i", alpha=alpha).collect()}
        return [replace(r, family_id=family_id, alpha=alpha, p_value_adj=found[i]["p_adj"], rejected=found[i]["rejected"]) for i, r in enumerate(results)]


def close_family(spark: SparkSession, by_study: Mapping[str, Sequence[EstimationResult]], family_id: str = FAMILY_ID, alpha: float = FDR_ALPHA) -> dict[str, list[EstimationResult]]:
    """Controls the results of all studies as one family and gives them back by study."""
    done = iter(BenjaminiHochbergController(spark).control([r for own in by_study.values() for r in own], family_id, alpha))
    return {k: [next(done) for _ in own] for k, own in by_study.items()}
