"""The JSON-lines protocol: one request a line, one reply a request, in batch or as a stateless stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def parse_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line columns, id string, text string, error string) of every line that isn't empty.

    id is the JSON text of whatever the line has there, null being a value; a line that isn't an object, lacks id, or
    has no string as text is an error with id null. A line of spaces is no empty line. Further keys are ignored.
    """
    text = F.regexp_replace(F.col(value), "\r+$", "")
    lines = lines.withColumn(value, text).where(F.col(value) != "")
    v = F.try_parse_json(F.col(value))
    kept = lines.withColumn("_v", v).withColumn("_id", F.try_variant_get("_v", "$.id", "variant")).withColumn("_text", F.try_variant_get("_v", "$.text", "variant"))
    is_text = F.coalesce(F.schema_of_variant("_text") == "STRING", F.lit(False))
    error = (
        F.when(F.col("_v").isNull(), "invalid JSON")
        .when(~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "not an object")
        .when(F.col("_id").isNull(), "missing field id")
        .when(~is_text, "text is not a string")
    )
    out = kept.withColumn("error", error)
    return out.withColumn("id", F.when(F.col("error").isNull(), F.to_json("_id"))).withColumn("text", F.when(F.col("error").isNull(), F.try_variant_get("_text", "$", "string"))).drop("_v", "_id", "_text")


def reply(id_: Column, spans: Column, tokens: Column, elapsed: Column, error: Column) -> Column:
    """The reply line: {"id", "spans", "tokens", "elapsed_us"}, or {"id", "error"}. id is JSON text already."""
    shown = F.coalesce(id_, F.lit("null"))
    good = F.to_json(F.struct(spans.alias("spans"), tokens.alias("tokens"), elapsed.alias("elapsed_us")))
    bad = F.to_json(F.struct(error.alias("error")))
    return F.concat(F.lit('{"id":'), shown, F.lit(","), F.substring(F.when(error.isNull(), good).otherwise(bad), F.lit(2), F.length(F.when(error.isNull(), good).otherwise(bad))))


Detect = Callable[[DataFrame], DataFrame]


def answer(lines: DataFrame, detect: Detect) -> DataFrame:
    """Replies to request lines. ``detect`` adds spans, and tokens, elapsed_us and error if it has them; it sees
    good requests only through their text, null where the line is an error."""
    asked = parse_requests(lines).withColumnRenamed("error", "_bad")
    done = detect(asked)
    column = lambda name, kind: F.col(name) if name in done.columns else F.lit(None).cast(kind)
    failed = F.coalesce(F.col("_bad"), column("error", "string"))
    line = reply(F.col("id"), F.col("spans"), F.coalesce(column("tokens", "int"), F.lit(0)), F.coalesce(column("elapsed_us", "long"), F.lit(0)), failed)
    return done.withColumn("reply", line).select(*lines.columns[1:], F.col("id"), F.col("reply"))


def answer_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, detect: Detect, max_files: int | None = None) -> StreamingQuery:
    """Answer every line of text files as they arrive in a folder. No state is kept, so restarts and retries
    repeat or continue a batch and nothing else."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    replies = answer(reader.load(folder), detect)
    return replies.select(F.col("reply").alias("value")).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
