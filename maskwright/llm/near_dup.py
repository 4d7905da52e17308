"""Operator 9: n-gram Jaccard join by parity sketches.

Each document is the set of its distinct 2-word shingles. Per size band its shingles are XORed into a sketch of
64-bit blocks; documents in the same band or the next differ, if they link, in fewer blocks than they fill, so by
pigeonhole they share one, and of each document's rarest blocks at least one. Documents are joined on these blocks.
Of the candidates, those whose bit sketches differ in more bits (Hamming distance, a lower bound of the
symmetric difference) than linked sets may differ in shingles are dropped; the rest are verified exactly (see setjoin).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .setjoin import Similarity, similar_classes
from .textvec import bigram_hashes, slices, utf8_parts, word_hashes

NEAR = Similarity(num=60, den=100)


def shingle_units(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Documents as hashed 2-word shingles; see setjoin.Units."""
    ids, ties = (batch.column(batch.schema.names.index(c)) for c in ("id", "tie"))
    raw, offsets = utf8_parts(batch.column(batch.schema.names.index("text")))
    for a, b in slices(offsets):
        at = offsets[a : b + 1]
        hashes, _, bounds = word_hashes(raw[at[0] : at[-1]], at - at[0])
        hashes, bounds = bigram_hashes(hashes, bounds)
        yield ids.slice(a, b - a), ties.slice(a, b - a), np.zeros(b - a, np.int32), hashes, bounds


def groups(docs: DataFrame, spec: Similarity = NEAR) -> DataFrame:
    """(id, tie, n, n_similar, component_id, keep) for every row of ``docs`` (id long, tie long, text): see near_duplicates. keep: id and
    tie of the component's first document, rows without id being last; null where nothing is linked."""
    known, classes, links = similar_classes(docs, shingle_units, spec)
    totals = links.groupBy("sig").agg(F.sum("links").alias("links"))
    roots = connected_components(links.select(F.col("sig").alias("u"), F.col("root").alias("v")))
    full = (
        classes.where("n > 0")
        .join(roots.withColumnRenamed("vertex", "sig"), "sig", "left")
        .join(totals, "sig", "left")
        .select("sig", "weight", "least_id", "keep", F.coalesce("root", "sig").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    least = full.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("keep").alias("keep"))
    facts = full.drop("keep").join(least, "root").select("sig", (F.col("weight") - 1 + F.col("links")).alias("n_similar"), "component_id", "keep")
    linked = facts.where("n_similar > 0")
    return known.join(linked, "sig", "left").select(
        "id", "tie", "n", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "id").alias("component_id"), "keep"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Similarity = NEAR) -> DataFrame:
    """(doc_id, n_shingles, n_similar, component_id) for every row of ``docs``.

    n_shingles: size of the row's set. n_similar: other rows whose set is alike, equal sets included.
    component_id: least id reachable over links, the row's own included. Null or wordless texts
    have an empty set, link with nothing, and form components of their own. Repeated rows are
    separate rows that link with each other. A row whose id is null takes part; the least id of a
    component is taken over its non-null ids. Further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("tie"), F.col(text_col).alias("text"))
    return groups(docs, spec).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "n_similar", "component_id")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over documents; see near_duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
