"""Agreement of two sets of detections over the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.spans import span_difference


def differences(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``pairs`` with only_left, only_right and exact."""
    out = pairs.withColumn("only_left", span_difference(F.col(left), F.col(right))).withColumn("only_right", span_difference(F.col(right), F.col(left)))
    return out.withColumn("exact", (F.size("only_left") == 0) & (F.size("only_right") == 0))


def agreement_matrix(diffs: DataFrame, pair: Column) -> DataFrame:
    """(pair, total, exact, exact_pct, mismatched, left_only, right_only)"""
    sums = diffs.groupBy(pair.alias("pair")).agg(
        F.count("*").alias("total"), F.count_if("exact").alias("exact"), F.sum(F.size("only_left")).cast("long").alias("left_only"), F.sum(F.size("only_right")).cast("long").alias("right_only")
    )
    return sums.withColumn("mismatched", F.col("total") - F.col("exact")).withColumn("exact_pct", F.round(100.0 * F.col("exact") / F.col("total"), 2))


def by_label(diffs: DataFrame) -> DataFrame:
    """(label, left_only, right_only)"""

    def marked(side: str) -> Column:
        return F.transform(f"only_{side}", lambda x: F.struct(x["label"].alias("label"), F.lit(side).alias("side")))

    sides = diffs.select(F.explode(F.concat(marked("left"), marked("right"))).alias("d"))
    return sides.groupBy("d.label").agg(F.count_if(F.col("d.side") == "left").alias("left_only"), F.count_if(F.col("d.side") == "right").alias("right_only"))


def gate(matrix: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(pair, threshold, exact_pct, passed) for every pair asked for; one that is missing fails."""
    spark = matrix.sparkSession
    asked = spark.createDataFrame(list(thresholds.items()), "pair string, threshold double")
    return asked.join(matrix.select("pair", "exact_pct"), "pair", "left").withColumn("passed", F.coalesce(F.col("exact_pct") >= F.col("threshold"), F.lit(False)))
