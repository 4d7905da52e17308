"""Operator 3: exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; over a segment of length m with means u, v and deviations s, t the inner
product is at most m (u v + s t), that is, the squared distance is at least m ((u - v)^2 + (s - t)^2).
Summed over segments this bounds every pair from a few numbers. Bounds are taken coarse
first, then fine for the pairs that remain; exact integer products follow for the survivors.

Queries and candidates travel in packed blocks. A block of candidates meets every block of queries
by an equi-join on lanes, each meeting keeps k candidates a query, and a
window picks the k best of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import reducers, tune

K = 5
SCALE = 256.0
LEVELS = (4, 16)
#: Vectors in a block of candidates and of queries.
BLOCK = 8192
QUERIES = 512
#: Most lanes, as each gets all queries: of vectors of floats, a fiftieth of them asked, these copies are as large as the input.
LANES = 100
#: Components up to this size keep every inner product exact in int64.
EXACT = 1 << 28
#: Below this share (one in so many) of a block's pairs, survivors are picked singly.
SPARSE = 50
_MOST = np.finfo(np.float64).max


def pack_rows(data: np.ndarray) -> bytes:
    """Rows of integral numbers, in two bytes each if they fit."""
    small = data.astype(np.int16) if np.abs(data).max(initial=0) < 1 << 15 else None
    return b"\2" + small.tobytes() if small is not None else b"\0" + data.tobytes()


def unpack_rows(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, np.int16 if blob[0] else np.float64, offset=1).astype(np.float64).reshape(rows, -1)


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Per vector sqrt(m) times mean and deviation of each segment, so that a product of two rows is the bound."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    cols = []
    for a, b in zip(edges, edges[1:]):
        part = v[:, a:b]
        cols += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(cols, 1) if cols else np.zeros((len(v), 0))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integral rows, as long; beyond long they saturate."""
    top = max(float(np.abs(q).max(initial=0)), float(np.abs(c).max(initial=0)))
    if top < EXACT and q.shape[1] <= 64:
        if top * top * max(1, q.shape[1]) < 2.0**53:
            return np.einsum("ij,ij->i", q, c).astype(np.int64)
        return np.einsum("ij,ij->i", q.astype(np.int64), c.astype(np.int64))
    least, most = -(1 << 63), (1 << 63) - 1
    return np.array([min(most, max(least, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(q, c)], np.int64)


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K, levels=LEVELS) -> tuple[np.ndarray, ...]:
    """(query row, candidate row, score) of each query's k best candidates of a block, ties to the smaller id.

    The query's own row is no candidate. Survivors of the bounds only are scored exactly."""
    with np.errstate(over="ignore", invalid="ignore"):
        stats = [(segment_statistics(q, s), segment_statistics(c, s)) for s in levels]
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
        slack = 1e-9 * norm + 1e-6
        bound = stats[0][0] @ stats[0][1].T + slack
    bound[np.isnan(bound)] = np.inf
    own = q_ids[:, None] == c_ids[None, :]
    bound[own] = -np.inf
    # The k candidates of the highest coarse bounds set a floor that no winner falls below.
    probe = min(len(c), 4 * k)
    first = np.argpartition(-bound, probe - 1, axis=1)[:, :probe] if len(c) else np.zeros((len(q), 0), int)
    rows = np.repeat(np.arange(len(q)), first.shape[1])
    seen = exact_scores(q[rows], c[first.reshape(-1)]).astype(np.float64).reshape(first.shape)
    seen[np.take_along_axis(own, first, 1)] = -np.inf
    floor = np.sort(seen, axis=1)[:, -k] if seen.shape[1] >= k else np.full(len(q), -np.inf)
    alive = (bound >= floor[:, None]) & ~own
    for a, b in stats[1:]:
        # While many pairs are left, a product of all is cheaper than picking pairs one by one.
        if np.count_nonzero(alive) * SPARSE > alive.size:
            with np.errstate(over="ignore", invalid="ignore"):
                alive &= ~(a @ b.T + slack < floor[:, None])
        else:
            i, j = np.nonzero(alive)
            with np.errstate(over="ignore", invalid="ignore"):
                low = np.einsum("ij,ij->i", a[i], b[j]) + slack[i, j] < floor[i]
            alive[i[low], j[low]] = False
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if np.count_nonzero(alive) * SPARSE > alive.size and top < 2.0**53:
        product = q @ c.T
        i, j = np.nonzero(alive & (product >= floor[:, None]))
        score = product[i, j].astype(np.int64)
    else:
        i, j = np.nonzero(alive)
        score = np.empty(len(i), np.int64)
        for s in range(0, len(i), 1 << 17):
            at = slice(s, s + (1 << 17))
            score[at] = exact_scores(q[i[at]], c[j[at]])
        good = score.astype(np.float64) >= floor[i]
        i, j, score = i[good], j[good], score[good]
    order = np.lexsort((c_ids[j], ~score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    best = rank < k
    return i[best], j[best], score[best]


def top_k(vectors: DataFrame, divisor: int, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``divisor`` the k rows of the
    highest integer inner product, components floored to 1/256; all of them, if fewer.

    vectors: (vec_id long, embedding array of numbers, ...). Vectors null, or holding null or non-finite components, or
    without id take no part; only vectors of one dimension are compared. Rows that repeat a vec_id
    are candidates each (never for a query of that id); a repeated query is answered once, by the
    least of its vectors. Further columns are ignored.
    """
    spark = vectors.sparkSession
    tune(spark)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id is not null and x is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    )

    def pack(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
        """Blocks of at most ``size`` vectors of one dimension, floored."""
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, rows = zip(*held.pop(dim))
            with np.errstate(over="ignore"):
                data = np.clip(np.floor(np.stack(rows) * SCALE), -_MOST, _MOST)
            return pd.DataFrame({"dim": [dim], "at": [int(min(ids))], "ids": [np.array(ids, np.int64).tobytes()], "data": [pack_rows(data)]})

        for frame in frames:
            for i, v in zip(frame["vec_id"], frame["x"]):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    schema = "dim int, at long, ids binary, data binary"
    candidates = clean.mapInPandas(lambda f: pack(f, BLOCK), schema).select("dim", "ids", "data")
    asked = clean.where(f"pmod(vec_id, {divisor}) = 0").groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = asked.mapInPandas(lambda f: pack(f, QUERIES), schema).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
                q, c = unpack_rows(row.q_data, len(q_ids)), unpack_rows(row.data, len(c_ids))
                i, j, score = block_top(q_ids, q, c_ids, c, k)
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[j], "score": score})

    # Candidate blocks are dealt to lanes; every lane gets all blocks of queries. More lanes than blocks would be copies for nothing.
    lanes = max(1, min(reducers(spark), LANES, -(-vectors.count() // BLOCK)))
    dealt = candidates.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
    everywhere = queries.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # Spark takes the exploded queries for no larger than the queries, and would broadcast all copies through the driver.
    pairs = everywhere.hint("merge").join(dealt, ["dim", "lane"])
    best = pairs.mapInPandas(meet, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over embeddings, with the rows whose vec_id is divisible by 50 as queries; see top_k."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 50)
