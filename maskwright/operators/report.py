"""Reports over detected spans: per-group counts, totals, examples, checks, debug dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maskwright.functions.text import byte_column, line_number, redact


def group_report(df: DataFrame, group: str) -> DataFrame:
    """(group, events_scanned, events_with_pii, label_counts): one pass over rows, one over spans, both
    pre-aggregated before they are shuffled."""
    scanned = df.groupBy(group).agg(F.count("*").alias("events_scanned"), F.count_if(F.size("spans") > 0).alias("events_with_pii"))
    labels = df.select(group, F.explode("spans").alias("s")).groupBy(group, F.col("s.label").alias("label")).count()
    maps = labels.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count")))).alias("label_counts"))
    return scanned.join(maps, group, "left")


def totals(df: DataFrame, group: str) -> DataFrame:
    """Spans by group and label with subtotals."""
    return df.select(group, F.explode("spans").alias("s")).rollup(F.col(group), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def first_examples(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows with spans of every group, numbered. Spark keeps n rows a group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.where(F.size("spans") > 0).withColumn("rank", rank).where(F.col("rank") <= n)


def redacted_examples(df: DataFrame, group: str, order: list[str], n: int, include_text: bool = False) -> DataFrame:
    """Examples as lists per group: redacted message and spans, span texts only on demand."""
    spans = F.col("spans") if include_text else F.transform("spans", lambda s: s.dropFields("text"))
    rows = first_examples(df, group, order, n).select(group, "rank", spans.alias("spans"), redact(F.col("text"), F.col("spans")).alias("message"))
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "message", "spans"))).alias("examples"))


def check(df: DataFrame) -> DataFrame:
    """One row per span with its 1-based line and byte column, as the check mode prints it."""
    found = df.where(F.size("spans") > 0).select("*", F.explode("spans").alias("_s"))
    return found.select(
        *[c for c in df.columns if c not in ("spans", "text")], line_number(F.col("text"), F.col("_s.byte_start")).alias("line"),
        byte_column(F.col("text"), F.col("_s.byte_start")).alias("col"), "_s.label", "_s.byte_start", "_s.byte_end", F.col("_s.text").alias("text"),
    )


def list_json(spans: Column) -> Column:
    """The span list as pretty JSON."""
    return F.to_json(spans, {"pretty": "true"})


def percentile_at(values: Column, p: float) -> Column:
    """The value at index min(n - 1, floor(p / 100 * n)) of the sorted values; 0 without values."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.least(n - 1, F.floor(F.lit(p / 100) * n)).cast("int"))).otherwise(F.lit(0.0))


def percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """percentile_at() of every group without gathering one: rows are range-partitioned by (group, value), ranks
    come from the counts of the ranges before and a running number inside a range. Nulls don't count."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    parts = rows.repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_k", F.row_number().over(W.partitionBy("_p", "_g").orderBy("_v")))
    counts = parts.groupBy("_p", "_g").count()
    # One row per range and group.
    by = W.partitionBy("_g")
    base = counts.select(
        "_p", F.col("_g"), F.coalesce(F.sum("count").over(by.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("count").over(by).alias("_all")
    )
    ranked = local.join(base, (local["_p"] == base["_p"]) & local["_g"].eqNullSafe(base["_g"])).select(local["_g"], "_v", (F.col("_base") + F.col("_k") - 1).alias("_rank"), "_all")
    at = {k: F.least(F.col("_all") - 1, F.floor(F.lit(p / 100) * F.col("_all"))) for k, p in points.items()}
    wanted = ranked.where(F.exists(F.array(*at.values()), lambda x: x == F.col("_rank")))
    return wanted.groupBy(F.col("_g").alias(group)).agg(*[F.min(F.when(F.col("_rank") == at[k], F.col("_v"))).alias(k) for k in points])


def stage_shares(df: DataFrame, stage: str, ns: str) -> DataFrame:
    """(stage, calls, total, per_call, share) of the time of all stages."""
    sums = df.groupBy(stage).agg(F.count("*").alias("calls"), F.sum(ns).alias("total"))
    return sums.withColumn("per_call", F.col("total") / F.col("calls")).withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy()))
