"""Corpora, caches and whole documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

CORPUS = "id long, text string"
CACHE = "decoder string, id long, spans array<struct<label:string,byte_start:int,byte_end:int,text:string>>, decoded_mismatch boolean"

#: The space separators of Unicode: what SQL's trim() takes away.
SPACES = r" \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def read_corpus(spark: SparkSession, path: str, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """JSON lines of id and text; rows above max_bytes of UTF-8 skipped, the first max_rows by id kept."""
    df = spark.read.schema(CORPUS).json(path)
    return limit_rows(df, max_rows, max_bytes, "id")


def limit_rows(df: DataFrame, max_rows: int | None, max_bytes: int | None, order: str) -> DataFrame:
    if max_bytes is not None:
        df = df.where(F.octet_length("text") <= max_bytes)
    return df if max_rows is None else df.orderBy(order).limit(max_rows)


def english_rows(df: DataFrame, order: str) -> DataFrame:
    """(id, text) of the English rows that aren't blank, numbered from 0 without gaps; rows without an order come
    last, those of the same order go by their texts. Blank means nothing but spaces (SPACES), as in the SQL.

    Numbers come from counts per range and a running number inside it, so no partition is gathered. Both branches
    of the plan need the same ranges, so a row's range follows from its order alone: ranges that Spark draws and
    merges when it runs differ from branch to branch."""
    kept = df.where((F.col("lang") == "en") & F.col("text").rlike(f"[^{SPACES}]")).select(order, "text")
    parts = kept.withColumn("_p", _range_of(kept, order))
    local = parts.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(F.asc_nulls_last(order), "text")))
    base = parts.groupBy("_p").count().withColumn("_base", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(base.select("_p", "_base")), "_p").select((F.col("_base") + F.col("_k") - 1).alias("id"), "text")


def _range_of(df: DataFrame, order: str) -> F.Column:
    """The number of the range that a row's order falls into, nulls in the last one: a function of the value alone.

    Limits are drawn from the values by hash, once, about as many as there are shuffle partitions."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value, kind = F.col(order), df.schema[order].dataType.simpleString()
    drawn = df.where(value.isNotNull()).groupBy(F.pmod(F.xxhash64(value), F.lit(8 * n))).agg(F.max_by(value, F.xxhash64(value)).alias("v"))
    limits = drawn.agg(F.filter(F.sort_array(F.collect_list("v")), lambda _, k: k % 8 == 7).alias("v")).first().v
    fixed = F.array(*map(F.lit, limits)).cast(f"array<{kind}>")
    # A binary search; get() beyond the end is null.
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(limits).bit_length())))).cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda p, s: p + F.when(F.get(fixed, p + s - 1) <= value, s).otherwise(0))
    return F.when(value.isNull(), len(limits)).otherwise(F.coalesce(found, F.lit(0)))


def read_document(spark: SparkSession, text: str | None = None, file: str | None = None) -> DataFrame:
    """One row ``text``: a literal, or a whole file. Both at once are refused."""
    if (text is None) == (file is None):
        raise ValueError("give either a text or a file")
    return spark.createDataFrame([(text,)], "text string") if file is None else spark.read.text(file, wholetext=True).withColumnRenamed("value", "text")


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the last row of each (decoder, id) of an append-only folder of JSON lines, and how many
    lines didn't parse. Later means: of a file written later, or further down in the same file."""
    # Files are read in splits of any order, so a line's place is that of its file and its split; lines of a split keep their order.
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("line"))
    parsed = lines.withColumn("r", F.from_json("value", CACHE, {"mode": "PERMISSIVE"}))
    good = parsed.where("r.decoder is not null and r.id is not null")
    bad = parsed.where("value <> '' and (r is null or r.decoder is null or r.id is null)").agg(F.count("*").alias("bad"))
    return latest(good.select("r.*", "line"), ["decoder", "id"], "line").drop("line"), bad


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: a max that combines before the shuffle."""
    columns = df.columns
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r"))
    return best.select("_r.*")


def missing_from(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(cache, keys, "left_anti")


def present_in(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(cache, keys, "left_semi")


def append_cache(df: DataFrame, path: str) -> None:
    """Add rows to a cache; resume with missing_from()."""
    df.select("decoder", "id", "spans", "decoded_mismatch").write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
