"""Operator 10: conflict-constrained best-fit packing.

Pieces of documents, measured in tokens, go into bins of fixed capacity, longest first, each into the tightest bin that takes
it. A bin takes at most one piece of a source and one of a duplicate cluster: it carries a bitmap of each,
and the search goes on through the bins in order of residual room until one is compatible. Bins that
lack a frequent source or cluster are kept in an order of their own, so that a source with a third of all rows
doesn't make the search step over every bin that has it.

Rows are dealt by a hash of their id and cluster into groups of about GROUP rows, packed independently; rows that repeat both
more than REPEATED times are dealt by their place in the table. So the work of a task is bounded, and a source or
cluster of any size is spread over all groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import encode_texts
from .shared import lean, persist, tune

#: Tokens of a bin.
CAPACITY = 2048
GROUP = 20000
REPEATED = 64
#: Share of a group from which a source or cluster has an order of bins of its own.
FREQUENT = 0.1
_LOW = (1 << 32) - 1


class Packer:
    """Bins of one group, ordered by residual room (room << 32 | bin)."""

    def __init__(self, capacity: int, frequent: set[tuple[str, int]]):
        self.capacity = capacity
        self.order: list[int] = []
        self.lacking: dict[tuple[str, int], list[int]] = {key: [] for key in frequent}
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.room: list[int] = []

    def _has(self, bin_: int, key: tuple[str, int]) -> bool:
        kind, bit = key
        return bool((self.sources if kind == "s" else self.clusters)[bin_] >> bit & 1)

    def find(self, length: int, source: int | None, cluster: int | None) -> int | None:
        """The tightest bin with room and without the source or the cluster."""
        order = self.order
        for key in (("s", source), ("c", cluster)):
            if key in self.lacking:
                order = self.lacking[key]
                break
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        for k in range(bisect_left(order, length << 32), len(order)):
            bin_ = order[k] & _LOW
            if not (self.sources[bin_] & s or self.clusters[bin_] & c):
                return bin_
        return None

    def put(self, length: int, source: int | None, cluster: int | None) -> tuple[int, int]:
        """(bin, offset in the bin) of a piece."""
        bin_ = self.find(length, source, cluster)
        if bin_ is None:
            bin_ = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            entry = self.room[bin_] << 32 | bin_
            for order in (self.order, *(o for key, o in self.lacking.items() if not self._has(bin_, key))):
                del order[bisect_left(order, entry)]
        at = self.capacity - self.room[bin_]
        self.room[bin_] -= length
        if source is not None:
            self.sources[bin_] |= 1 << source
        if cluster is not None:
            self.clusters[bin_] |= 1 << cluster
        entry = self.room[bin_] << 32 | bin_
        for order in (self.order, *(o for key, o in self.lacking.items() if not self._has(bin_, key))):
            insort(order, entry)
        return bin_, at


def pack_group(items: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """items: (id, length, source, cluster). Returns (id, piece, start, length, bin, offset), in order of placing.

    A document longer than a bin is cut: full pieces have bins of their own, the rest competes. Order: longer
    first, then smaller id (null first), then source and cluster. A null source or cluster is in conflict with none.
    """
    key = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, str(v))
    source_count = Counter(s for _, _, s, _ in items if s is not None)
    cluster_count = Counter(c for _, _, _, c in items if c is not None)
    sources = {s: k for k, s in enumerate(sorted(source_count, key=str))}
    # A cluster of one is in conflict with nothing and needs no bit.
    clusters = {c: k for k, c in enumerate(sorted((c for c, n in cluster_count.items() if n > 1), key=str))}
    least = max(2.0, FREQUENT * len(items))
    frequent = {("s", sources[s]) for s, n in source_count.items() if n >= least} | {("c", clusters[c]) for c, n in cluster_count.items() if n >= least}
    packer = Packer(capacity, frequent)
    out, rest = [], []
    for id_, length, source, cluster in items:
        whole = max(0, length - 1) // capacity
        for k in range(whole):
            out.append((id_, k, k * capacity, capacity, None, 0))
        rest.append((id_, whole, whole * capacity, length - whole * capacity, source, cluster))
    rest.sort(key=lambda r: (-r[3], key(r[0]), text(r[4]), text(r[5])))
    placed = []
    for id_, piece, start, length, source, cluster in rest:
        bin_, at = packer.put(length, sources.get(source), clusters.get(cluster))
        placed.append((id_, piece, start, length, bin_, at))
    full = len(packer.room)
    out.sort(key=lambda r: (key(r[0]), r[1]))
    return placed + [(i, p, s, n, full + k, o) for k, (i, p, s, n, _, o) in enumerate(out)]


RESULT = "doc_id long, piece int, start long, length long, bin_id long, offset long"


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, offset) for every piece of every row of ``items``
    (doc_id, length long, source string, cluster long); see pack_group.

    A null length counts as 0; a row of length 0 takes a place without room. Repeated rows are packed each. An
    empty table gives no rows. Further columns are ignored.
    """
    keyed = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"),
        F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"), F.monotonically_increasing_id().alias("place"),
    )
    # Written, so that a row's place in the table is the same whenever it is read.
    rows = persist(keyed.withColumn("turn", F.xxhash64("doc_id", "cluster", F.lit(3))), "items")
    groups = max(1, -(-rows.count() // group))
    heavy = rows.groupBy("turn").count().where(F.col("count") > REPEATED).select("turn", F.lit(True).alias("heavy"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (None if pd.isna(i) else int(i), int(n), None if s is None or pd.isna(s) else s, None if pd.isna(c) else int(c))
            for i, n, s, c in zip(frame["doc_id"].astype("object"), frame["length"], frame["source"], frame["cluster"].astype("object"))
        ]
        out = pd.DataFrame(pack_group(rows, capacity), columns=["doc_id", "piece", "start", "length", "bin_id", "offset"])
        out["bin_id"] += int(key[0]) << 32
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    turn = F.when(F.col("heavy"), F.xxhash64("turn", "place")).otherwise(F.col("turn"))
    dealt = rows.join(heavy, "turn", "left").select(F.pmod(turn, F.lit(groups)).alias("part"), "doc_id", "length", "source", "cluster")
    return dealt.groupBy("part").applyInPandas(run, RESULT)


def text_items(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, length, source, cluster) of documents: their length in tokens of the byte-level vocabulary at ``path``, and equal texts as
    one cluster. A null text has no tokens and no cluster."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.array([len(x) for x in encode_texts(batch.column(1).to_pylist(), path)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, batch.column(2), batch.column(3)], ["doc_id", "length", "source", "cluster"])

    cluster = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), cluster.alias("cluster"))
    return texts.mapInArrow(lean(run), "doc_id long, length long, source string, cluster long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over documents: places of pieces in bins of CAPACITY tokens; see pack."""
    return pack(text_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken")))
