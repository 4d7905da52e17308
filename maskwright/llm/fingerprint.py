"""Operator 1: document fingerprints by a homomorphic multiset hash.

Every paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum over its
paragraphs: the order of paragraphs doesn't matter, equal multisets have equal
sums, and a paragraph is inserted or deleted by adding or subtracting its vector. The vector has two parts:

* DENSE lanes modulo 2 ** 64, all bits from one cryptographic hash of the paragraph, for equality;
* SKETCH lanes modulo 2 ** 32, in which each word pair and each byte triple of the paragraph adds or takes a weight at one lane, for likeness:
  read as signed numbers they estimate the cosine of two documents' bags of those. A short paragraph has few words, so its triples
  weigh more; by eighths, as it grows to BLEND bytes, its pairs take over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import lean, reducers, tune, whole_groups
from .textvec import bigram_hashes, mix64, slices, utf8_parts, word_hashes

DENSE = 8
SKETCH = 128
#: Bytes from which a line's word pairs alone count, with all of WEIGHT.
BLEND = 128
WEIGHT = 8
WIDTH = DENSE * 8 + SKETCH * 4


def sketches(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sketch lanes of every text, int64, not yet reduced: the sum over its lines."""
    rows = len(offsets) - 1
    out = np.zeros((rows, SKETCH), np.int64)
    for a, b in slices(offsets):
        at = offsets[a : b + 1] - offsets[a]
        part = raw[offsets[a] : offsets[b]]
        lines = np.union1d(at, np.flatnonzero(part == 10) + 1)
        hashes, _, bounds = word_hashes(part, lines, fold_case=False)
        pairs, bounds = bigram_hashes(hashes, bounds)
        row = np.repeat(np.searchsorted(at, lines[:-1], side="right") - 1, np.diff(bounds))
        size = np.diff(lines) - (part[np.maximum(lines[1:] - 1, 0)] == 10 if len(part) else 0)
        weight = np.minimum(size * WEIGHT // BLEND, WEIGHT)
        heavy = np.repeat(weight, np.diff(bounds))
        small = np.flatnonzero((weight < WEIGHT) & (size > 2))
        i = np.arange(int((size[small] - 2).sum())) - np.repeat(np.cumsum(size[small] - 2) - (size[small] - 2) - lines[:-1][small], size[small] - 2)
        threes = mix64(part[i].astype(np.uint64) << np.uint64(16) | part[i + 1].astype(np.uint64) << np.uint64(8) | part[i + 2])
        heavy = np.concatenate([heavy, np.repeat(WEIGHT - weight[small], size[small] - 2)])
        pairs = np.concatenate([pairs, threes])
        row = np.concatenate([row, np.searchsorted(at, i, side="right") - 1])
        lane = row * SKETCH + (pairs >> np.uint64(8)).astype(np.int64) % SKETCH
        sign = ((pairs & np.uint64(1)).astype(np.int64) << 1) - 1
        out[a:b] = np.bincount(lane, weights=sign * heavy, minlength=(b - a) * SKETCH).astype(np.int64).reshape(b - a, SKETCH)
    return out


def dense(text: bytes) -> np.ndarray:
    """Dense lanes of a text: the sum of its lines' hashes modulo 2 ** 64."""
    digests = b"".join(hashlib.blake2b(line, digest_size=8 * DENSE).digest() for line in text.split(b"\n")) if text else b""
    with np.errstate(over="ignore"):
        return np.frombuffer(digests, "<u8").reshape(-1, DENSE).sum(0, dtype=np.uint64)


class Fingerprint:
    """A multiset hash that paragraphs can be added to and taken from.

    An empty text has no paragraph, and the zero fingerprint.
    """

    def __init__(self, text: str = ""):
        self.lanes = np.zeros(DENSE, np.uint64)
        self.counts = np.zeros(SKETCH, np.int64)
        if text:
            for line in text.split("\n"):
                self.insert(line)

    def _change(self, paragraph: str, by: int) -> None:
        raw = np.frombuffer(paragraph.encode("utf-8", "surrogatepass"), np.uint8)
        digest = np.frombuffer(hashlib.blake2b(raw.tobytes(), digest_size=8 * DENSE).digest(), "<u8")
        with np.errstate(over="ignore"):
            self.lanes = self.lanes + digest if by > 0 else self.lanes - digest
        self.counts = self.counts + by * sketches(raw, np.array([0, len(raw)]))[0]

    def insert(self, paragraph: str) -> None:
        self._change(paragraph, 1)

    def delete(self, paragraph: str) -> None:
        self._change(paragraph, -1)

    def hex(self) -> str:
        return _hex(self.lanes, self.counts)


def _hex(lanes: np.ndarray, counts: np.ndarray) -> str:
    return (lanes.astype("<u8").tobytes() + (counts & 0xFFFFFFFF).astype("<u4").tobytes()).hex()


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Cosine of the signed sketch lanes, in 0..1, row by row; 1 where the fingerprints are the same."""
    a, b = ((x.astype(np.int64) + (1 << 31) & 0xFFFFFFFF).astype(np.float64) - (1 << 31) for x in (a, b))
    norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = (a * b).sum(1) / np.where(norm > 0, norm, 1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def likeness_hex(a: str, b: str) -> float:
    """Likeness of two fingerprints as strings."""
    x, y = (np.frombuffer(bytes.fromhex(v)[8 * DENSE :], "<u4")[None, :] for v in (a, b))
    return float(likeness(x, y, np.array([a == b]))[0])


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many of the first code points of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _describe(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows for all texts but the last, which only follows."""
    step = 1000
    for a in range(0, len(texts) - 1, step):
        part = texts[a : a + step + 1]
        n = len(part) - 1
        changed = [edited(x, y) for x, y in zip(part, part[1:])]
        sums, fps = [], []
        for group in (part, changed):
            column = pa.array(group, pa.large_string())
            raw, offsets = utf8_parts(column)
            counts = sketches(raw, offsets) & 0xFFFFFFFF
            whole = raw.tobytes()
            cut = offsets.tolist()
            lanes = [dense(whole[i:j]) for i, j in zip(cut, cut[1:])]
            sums.append(counts)
            fps.append([_hex(x, y) for x, y in zip(lanes, counts)])
            if group is changed:
                shas = [hashlib.sha256(whole[i:j]).hexdigest() for i, j in zip(cut, cut[1:])]
        own, new = fps
        near = likeness(sums[0][:-1], sums[1], np.array([x == y for x, y in zip(own, new)], bool))
        following = likeness(sums[0][:-1], sums[0][1:], np.array([x == y for x, y in zip(own, own[1:])], bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[a : a + n], pa.int64()), pa.array([len(t) for t in part[:-1]], pa.int64()), pa.array(shas), pa.array(own[:-1]), pa.array(new), pa.array(near), pa.array(following)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): see RESULT.

    A null text counts as empty; the fingerprint of an empty text is zero, and two equal fingerprints have
    likeness 1. The order is ascending doc_id, null first, equal ids by text; after the last row comes the first.
    Further columns are ignored. An empty table gives no rows.

    The table is cut into ranges of doc_id whose bounds come from its quantiles. Texts travel once, compressed;
    the first row of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    tune(spark)
    parts = reducers(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(least))
    cuts = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10000).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts))
    edges = np.array(bounds, np.int64)
    # A few numbers a range: which ranges hold rows, and the least row of each.
    shared = spark.sparkContext.broadcast(edges)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(shared.value, ids, side="right")
            for p in np.unique(part).tolist():
                low = int(ids[part == p].min())
                found[p] = min(found.get(p, low), low)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["part", "low"])

    lows = docs.select(key.alias("k")).mapInArrow(ranges, "part int, low long").groupBy("part").agg(F.min("low").alias("low")).collect()
    lows = sorted((r["part"], r["low"]) for r in lows)
    before = {low: lows[i - 1][0] for i, (_, low) in enumerate(lows)}
    heads = spark.sparkContext.broadcast((np.array(sorted(before), np.int64), before))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        known, prior = heads.value
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(least).to_numpy(zero_copy_only=False)
            part = np.searchsorted(shared.value, keys, side="right")
            head = np.isin(keys, known)
            texts = batch.column(1)
            targets = [(int(p), np.flatnonzero(part == p), 0) for p in np.unique(part)]
            targets += [(prior[int(keys[i])], np.array([i]), 1) for i in np.flatnonzero(head)]
            for p, rows, tail in targets:
                take = pa.array(rows)
                raw, offsets = utf8_parts(texts.take(take))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([tail], pa.int32()), pa.array([ids.take(take).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(offsets).tolist()], pa.list_(pa.int64())), pa.array([squeeze.compress(raw.tobytes())], pa.binary())],
                    ["part", "tail", "ids", "sizes", "blob"],
                )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "part"):
            own, tails = [], []
            for tail, ids, sizes, blob in zip(*(group.column(c).to_pylist() for c in ("tail", "ids", "sizes", "blob"))):
                whole, at = zstandard.decompress(blob, max_output_size=sum(sizes) + 1), 0
                for doc_id, size in zip(ids, sizes):
                    (tails if tail else own).append((doc_id is not None, doc_id or 0, whole[at : at + size].decode("utf-8")))
                    at += size
            own.sort()
            # The range after this one begins with its least row; rows of equal id come along.
            yield from _describe([d if k else None for k, d, _ in own], [t for _, _, t in own] + [min(tails)[2]])

    schema = "part int, tail int, ids array<long>, sizes array<long>, blob binary"
    return docs.mapInArrow(lean(ship), schema).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(describe), RESULT)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over documents; see fingerprints."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
