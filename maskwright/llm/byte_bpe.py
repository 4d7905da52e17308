"""Operator 7: byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``chunk`` code points, each with an overlap into the next, which are pre-tokenised in
parallel, each from its own arbitrary start, and encoded between its boundaries. Where a boundary of one chunk falls on a
boundary of the next inside the overlap, both agree from there on, as the pattern only looks ahead; there the ids
of the one end and those of the next begin. Where chunks don't resynchronise, as within one very long token,
the text itself is followed from the last sure boundary until it meets a later chunk's, cut there, and its pieces
are encoded in parallel. Decoding concatenates the raw bytes of the ids. A text of one chunk is encoded where it is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import lean, persist, tune

CHUNK = 4096
OVERLAP = 256
#: The last code points of a window, whose boundaries may be due to the window's end.
UNSURE = 8


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(window: str) -> np.ndarray:
    """Where the pre-tokens of a window begin, without those its end may have made."""
    starts = np.fromiter((m.start() for m in _pattern().finditer(window)), np.int64)
    return starts[starts < len(window) - UNSURE]


def stitch(text: str, chunks: list[tuple[int, list[int], list[int]]], chunk: int) -> list[int]:
    """Cuts of a text from its chunks (number, boundaries in the overlap with the chunk before, boundaries past the chunk).

    A chunk is trusted from where its boundaries meet those of a trusted chunk before it. Without such a place the
    text is matched on from the last sure boundary until one falls on a boundary of a later chunk's head.
    """
    chunks = sorted(chunks)
    cuts, k = [0], 1
    heads = [set(head) for _, head, _ in chunks]
    while k < len(chunks):
        meet = min((t for t in chunks[k - 1][2] if t - chunk in heads[k]), default=None)
        if meet is not None:
            cuts.append(meet + (k - 1) * chunk)
            k += 1
            continue
        sure = next((m.start() for m in _pattern().finditer(text, cuts[-1]) if m.start() >= k * chunk and m.start() % chunk in heads[m.start() // chunk]), None)
        if sure is None:
            break
        cuts.append(sure)
        k = sure // chunk + 1
    return cuts


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    enc = encoding(path)
    return [np.array(enc.encode_ordinary(t), "<u4") if t else np.zeros(0, "<u4") for t in texts]


def encode_window(window: str, chunk: int, overlap: int, path: str) -> tuple[list[int], list[int], np.ndarray]:
    """(marks, places, ids) of a chunk with its overlap: the boundaries in the overlap with the chunk before and in that with the next,
    and where in the ids each of them is. What lies between the overlaps is encoded at one go."""
    found = boundaries(window)
    marks = found[(found < overlap) | (found >= chunk)].tolist()
    ids = encode_texts([window[a:b] for a, b in zip(marks, [*marks[1:], len(window)])], path)
    return marks, np.cumsum([0, *map(len, ids)])[: len(marks)].tolist(), np.concatenate(ids) if ids else np.zeros(0, "<u4")


def stitch_ids(chunks: list[tuple[int, list[int], list[int], bytes]], chunk: int, kind: str = "<u4") -> np.ndarray | None:
    """The ids of a text from its chunks (number, marks, places, ids as numbers of ``kind``); None if two chunks don't resynchronise."""
    out, begin = [], 0
    chunks = sorted(chunks, key=lambda c: c[0])
    for (_, marks, places, ids), (_, next_marks, next_places, _) in zip(chunks, chunks[1:]):
        heads = dict(zip(next_marks, next_places))
        meet = next(((place, heads[mark - chunk]) for mark, place in zip(marks, places) if mark >= chunk and mark - chunk in heads), None)
        if meet is None:
            return None
        out.append(np.frombuffer(ids, kind)[begin : meet[0]])
        begin = meet[1]
    out.append(np.frombuffer(chunks[-1][3], kind)[begin:])
    return np.concatenate(out).astype("<u4")


def digest(ids: np.ndarray, path: str) -> tuple[int, str, str]:
    """(number of ids, their SHA-256, the SHA-256 of the bytes they decode to)."""
    decoded = encoding(path).decode_bytes(ids.tolist()) if len(ids) else b""
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: pa.Array, encoded: list[np.ndarray], path: str) -> pa.RecordBatch:
    n, a, b = zip(*(digest(x, path) for x in encoded)) if encoded else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _windows(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, window) of the chunks of (key, text), spread over tasks; the chunks of equal texts are the same and come once."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk)), lambda k: F.substring("text", k * chunk + 1, F.lit(chunk + overlap)))
    return long.select("key", F.posexplode(parts).alias("k", "window")).groupBy("key", "k").agg(F.first("window").alias("window"))


def follow_long(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, k, ids binary) of texts (key, text) whose chunks don't all resynchronise, in pieces."""

    def pre_tokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [boundaries(w) for w in frame["window"]]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "head": [b[b < overlap] for b in found], "tail": [b[b >= chunk] for b in found]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text, chunks in zip(frame["key"], frame["text"], frame["chunks"]):
                cuts = stitch(text, [(c["k"], c["head"], c["tail"]) for c in chunks], chunk)
                yield pd.DataFrame({"key": key, "k": range(len(cuts)), "piece": [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]})

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "ids": [x.tobytes() for x in encode_texts(list(frame["piece"]), path)]})

    found = _windows(long, chunk, overlap).mapInPandas(lean(pre_tokenise), "key string, k int, head array<int>, tail array<int>")
    chunks = found.groupBy("key").agg(F.collect_list(F.struct("k", "head", "tail")).alias("chunks"))
    pieces = long.dropDuplicates(["key"]).join(chunks, "key").mapInPandas(lean(cut), "key string, k int, piece string")
    return pieces.repartition("key", "k").mapInPandas(lean(encode), "key string, k int, ids binary")


def byte_bpe(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text, ...).

    A null or empty text has no ids. Repeated rows yield repeated results. Further columns are ignored.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Ids travel in two bytes if the vocabulary allows it.
    kind = "<u2" if encoding(path).max_token_value < 1 << 16 else "<u4"
    # A window has at most four ids a code point.
    small = "<u2" if 4 * (chunk + overlap) < 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digests(batch.column(0), encode_texts(batch.column(1).to_pylist(), path), path)

    def encode_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks, places, ids = zip(*(encode_window(w, chunk, overlap, path) for w in frame["window"])) if len(frame) else ((), (), ())
            marks, places = ([np.array(x, small).tobytes() for x in y] for y in (marks, places))
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "marks": marks, "places": places, "ids": [x.astype(kind).tobytes() for x in ids]})

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, parts in zip(frame["key"], frame["parts"]):
                ids = stitch_ids([(p["k"], np.frombuffer(p["marks"], small).tolist(), np.frombuffer(p["places"], small).tolist(), p["ids"]) for p in parts], chunk, kind)
                n, a, b = (None, None, None) if ids is None else digest(ids, path)
                yield pd.DataFrame({"key": [key], "n_tokens": pd.array([n], "Int64"), "ids_sha256": [a], "decoded_sha256": [b]})

    def finish_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, parts in zip(frame["key"], frame["parts"]):
                n, a, b = digest(np.frombuffer(b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["k"])), "<u4"), path)
                yield pd.DataFrame({"key": [key], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})

    schema = "key string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = docs.where(f"coalesce(length(text), 0) <= {chunk}").mapInArrow(lean(encode), RESULT)
    rows = docs.where(f"length(text) > {chunk}").withColumn("key", F.sha2("text", 256))
    chunks = _windows(rows, chunk, overlap).mapInPandas(lean(encode_chunks), "key string, k int, marks binary, places binary, ids binary")
    whole = chunks.groupBy("key").agg(F.collect_list(F.struct("k", "marks", "places", "ids")).alias("parts"))
    digests = persist(whole.mapInPandas(lean(finish), schema), "digests")
    apart = digests.where("n_tokens is null").select("key")
    if not apart.isEmpty():
        pieces = follow_long(rows.join(apart, "key", "left_semi").select("key", "text"), path, chunk, overlap)
        followed = pieces.groupBy("key").agg(F.collect_list(F.struct("k", "ids")).alias("parts")).mapInPandas(lean(finish_pieces), schema)
        digests = digests.where("n_tokens is not null").unionByName(followed)
    return short.unionByName(rows.select("doc_id", "key").join(digests, "key").drop("key"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over documents; see byte_bpe."""
    return byte_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
