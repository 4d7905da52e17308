"""Operator 6: near-duplicate lines, by an exact set-similarity join.

Every line is the set of its distinct words; a word in a script that puts no spaces between words counts as its
pairs of neighbouring characters. The rarest words are published as far as the threshold demands
(prefix filter), partners differ in length by no more than it allows (length filter), and the place of
a shared word bounds the overlap (positional filter). Survivors are verified by their exact Jaccard
similarity, and a line that has a match before it, by document id and line number, goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .setjoin import Similarity, similar_classes
from .shared import persist
from .textvec import bigram_hashes, is_space, mix64, slices, utf8_parts, word_hashes

_ID, _TIE, _SUBS, _HOW, _UID = (f"__line_dedup_{x}" for x in ("id", "tie", "subs", "how", "uid"))
#: Bytes of text taken at once: what is made of them stays in the cache.
SLICE = 1 << 18
LINES = Similarity(num=80, den=100, bits=24, parity=False)


def script_grams(raw: np.ndarray, start: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) with words that hold a Chinese, Japanese, Thai, Lao, Tibetan, Burmese or Khmer character
    replaced by their pairs of neighbouring characters."""
    lead = np.flatnonzero(raw >= 0xE0)
    if not len(lead):
        return hashes, bounds
    a, b = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)]
    unspaced = ((a == 0xE0) & (b >= 0xB8)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F))) | ((a >= 0xE3) & (a <= 0xE9))
    unspaced |= ((a == 0xEF) & (((b >= 0xA4) & (b <= 0xAB)) | (b == 0xBD) | (b == 0xBE))) | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xB3))
    if not unspaced.any():
        return hashes, bounds
    cut = np.zeros(len(hashes), bool)
    cut[np.searchsorted(start, lead[unspaced], side="right") - 1] = True
    at = np.flatnonzero((raw & 0xC0 != 0x80) & ~is_space(raw))
    word = np.searchsorted(start, at, side="right") - 1
    at, word = at[cut[word]], word[cut[word]]
    size = 1 + (raw[at] >= 0xC0).astype(np.int64) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
    code = np.zeros(len(at), np.uint64)
    for k in range(4):
        code = code << np.uint64(8) | np.where(k < size, raw[np.minimum(at + k, len(raw) - 1)], 0).astype(np.uint64)
    capital = (raw[at] >= 65) & (raw[at] <= 90)
    code[capital] += np.uint64(32 << 24)
    grams, ends = bigram_hashes(mix64(code), np.concatenate([np.flatnonzero(np.diff(word, prepend=-1)), [len(word)]]))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rows = np.concatenate([row[~cut], np.repeat(row[np.flatnonzero(cut)], np.diff(ends))])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([hashes[~cut], grams])[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(bounds) - 1))])


def line_units(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Lines as hashed words; see setjoin.Units. Lines are numbered from 0 within their document."""
    ids, ties = (batch.column(batch.schema.names.index(c)) for c in ("id", "tie"))
    raw, offsets = utf8_parts(batch.column(batch.schema.names.index("text")))
    for a, b in slices(offsets, SLICE):
        at = offsets[a : b + 1] - offsets[a]
        part = raw[offsets[a] : offsets[b]]
        breaks = np.flatnonzero(part == 10) + 1
        # Every document has a first line, an empty one too; a break may coincide with the next document's start.
        doc = np.concatenate([np.arange(b - a), np.searchsorted(at, breaks - 1, side="right") - 1])
        order = np.lexsort((np.concatenate([at[:-1], breaks]), doc))
        starts, doc = np.concatenate([at[:-1], breaks])[order], doc[order]
        hashes, begin, bounds = word_hashes(part, np.append(starts, len(part)))
        hashes, bounds = script_grams(part, begin, hashes, bounds)
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        rows = pa.array(doc)
        yield ids.slice(a, b - a).take(rows), ties.slice(a, b - a).take(rows), number.astype(np.int32), hashes, bounds


def matched_lines(docs: DataFrame, spec: Similarity = LINES) -> tuple[DataFrame, DataFrame]:
    """(id, tie, subs): per document, known by its id and the hash of its text, the numbers of the lines that have a match before
    them, ascending; and (id, tie) of documents that several rows hold."""
    known, classes, links = similar_classes(docs, line_units, spec, several=True)
    late = links.groupBy("sig").agg(F.max("earlier").alias("earlier"))
    verdict = classes.where("n > 0").join(late, "sig", "left").where("weight > 1 or earlier").select("sig", "first_id", "first_tie", "first_sub", F.coalesce("earlier", F.lit(False)).alias("earlier"))
    gone = known.where("n > 0").join(verdict, "sig").where("earlier or not (id <=> first_id and tie = first_tie and sub = first_sub)")
    repeated = known.where("sub = 0").groupBy("id", "tie").count().where("count > 1").select("id", "tie")
    return gone.groupBy("id", "tie").agg(F.array_sort(F.collect_set("sub")).alias("subs")), repeated


def _without(lines: F.Column, subs: F.Column) -> F.Column:
    """``lines`` without those numbered in ``subs``, ascending: a string of flags is made, so that the work is linear."""
    gap = lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.element_at(subs, i)) - 1
    flags = F.array_join(F.transform(subs, lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.lit("1"))), "").cast("binary")
    return F.filter(lines, lambda x, i: F.substring(flags, i + 1, F.lit(1)) != F.lit("1").cast("binary"))


def dedup_lines(docs: DataFrame, spec: Similarity = LINES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` rid of lines that match an earlier one, and n_removed long added.

    Earlier means a smaller doc_id (null first), the smaller hash of the text between rows of one doc_id, or a smaller line number
    in the same document. Rows that repeat doc_id and text: one counts as the first, which keeps what it
    has alone, and the others lose every line with a word. A line without a word stays. n_chars, if there, becomes
    the new length of a changed text. A null text stays null; rows are neither lost nor added, and a text may become
    empty. Other columns pass through; a column n_removed of the input is replaced.
    """
    docs = docs.drop("n_removed")
    named = docs.withColumn(_ID, F.col("doc_id").cast("long")).withColumn(_TIE, F.xxhash64("text"))
    gone, repeated = matched_lines(named.select(F.col(_ID).alias("id"), F.col(_TIE).alias("tie"), "text"), spec)
    key = lambda other: named[_ID].eqNullSafe(other["id"]) & (named[_TIE] == other["tie"])
    whole = named
    if not (repeated := persist(repeated, "repeated")).isEmpty():
        # Of rows that are the same one is first: rows are numbered as written, and the least number counts.
        again = persist(named.join(repeated, key(repeated), "left_semi").withColumn(_UID, F.monotonically_increasing_id()), "copies")
        first = again.groupBy(_ID, _TIE).agg(F.min(_UID).alias(_UID)).select(F.col(_UID).alias("first"))
        again = again.join(first, F.col(_UID) == F.col("first"), "left").withColumn(_HOW, F.col("first").isNull()).drop("first", _UID)
        whole = named.join(repeated, key(repeated), "left_anti").withColumn(_HOW, F.lit(False)).unionByName(again)
    else:
        whole = named.withColumn(_HOW, F.lit(False))
    gone = gone.select(F.col("id").alias("__line_dedup_a"), F.col("tie").alias("__line_dedup_b"), F.col("subs").alias(_SUBS))
    marked = whole.join(gone, F.col(_ID).eqNullSafe(F.col("__line_dedup_a")) & (F.col(_TIE) == F.col("__line_dedup_b")), "left")
    lines = F.split("text", "\n", -1)
    blank = F.filter(lines, lambda x: F.trim(F.translate(x, "\r\t\v\f", "    ")) == "")
    kept = F.when(F.col(_HOW), blank).otherwise(_without(lines, F.col(_SUBS)))
    changed = F.col("text").isNotNull() & (F.col(_HOW) | F.col(_SUBS).isNotNull())
    removed = F.when(changed & F.col(_HOW), F.size(lines) - F.size(blank)).when(changed, F.size(_SUBS)).otherwise(0)
    out = marked.withColumn("n_removed", removed.cast("long")).withColumn("text", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, "n_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over documents: doc_id, text without matched lines, n_removed; see dedup_lines."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
