"""Operator 2: token ids in a fixed-width bit-packed file format.

Layout of a file: MAGIC, then blocks of BLOCK ids, each id in the least number of bits that the
vocabulary needs and each block starting on a byte; then the footer (numpy arrays: document ids,
first id of every document, byte offset of every block) and its length. A reader fetches any id
range by the blocks it touches and unpacks them without a loop over ids.

Files hold ascending document ids: the table is range-partitioned, a partition is a file, and the
number of a file is its place. Files are written under another name and renamed, so a task that is run
again or twice leaves one whole file.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from .shared import fresh_path, lean, persist, reducers, tune

MAGIC = b"MWTOKENS"
BLOCK = 4096
END_ID = 1


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (below 2 ** width) in ``width`` bits each, little-endian."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(raw: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenWriter:
    """Appends documents to an open file; close() writes the footer."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.names: list[int | None] = []
        self.firsts, self.offsets, self.at, self.total = [0], [0], 0, 0
        self.held: list[np.ndarray] = []
        self.load = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.names.append(doc_id)
        self.total += len(ids)
        self.firsts.append(self.total)
        self.held.append(ids)
        self.load += len(ids)
        if self.load >= 64 * self.block:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if end else len(ids) // self.block * self.block
        for a in range(0, stop, self.block):
            raw = pack(ids[a : min(stop, a + self.block)], self.width)
            self.out.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.held, self.load = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        known = np.array([n is not None for n in self.names], np.uint8)
        arrays = [np.array([n or 0 for n in self.names], "<i8"), known, np.array(self.firsts, "<i8"), np.array(self.offsets, "<i8")]
        head = json.dumps({"width": self.width, "block": self.block, "lengths": [len(a) for a in arrays]}).encode()
        footer = len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays)
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class TokenReader:
    """Random access to one file: ids(a, b) reads only the blocks that hold them."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        length = int.from_bytes(tail[:8], "little")
        footer = file.read_at(length, size - 16 - length)
        n = int.from_bytes(footer[:8], "little")
        head = json.loads(footer[8 : 8 + n])
        self.width, self.block = head["width"], head["block"]
        at, out = 8 + n, []
        for count, kind in zip(head["lengths"], ("<i8", "u1", "<i8", "<i8")):
            out.append(np.frombuffer(footer, kind, count, at))
            at += out[-1].nbytes
        names, known, self.firsts, self.offsets = out
        self.names = [int(x) if k else None for x, k in zip(names, known)]

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        raw = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), len(MAGIC) + int(self.offsets[first]))
        whole = [
            unpack(raw[self.offsets[k] - self.offsets[first] : self.offsets[k + 1] - self.offsets[first]], self.width, min(self.block, int(self.firsts[-1]) - k * self.block))
            for k in range(first, last + 1)
        ]
        return np.concatenate(whole)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.firsts[k]), int(self.firsts[k + 1]))


class _Cache(dict):
    """Encoded pieces, emptied when full; a missing one is encoded by ``make``."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        made = self[piece] = self.make(piece)
        return made


#: Texts of these characters only need no normalisation but lower case, and their white space is plain.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-įı-ɏ]")


class WordEncoder:
    """The ids that the tokenizers library gives, with every word of a plain text encoded once.

    Holds for tokenizers that lower-case, split at white space and merge inside pre-tokens only, as
    word_bpe_49k does: white space belongs to no token there. Other texts go to the library whole.
    """

    def __init__(self, path: str, words: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        plain = steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"]) if plain else None
        self.special = [t["content"] for t in spec["added_tokens"]]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.letters = dict(zip(kept, map(chr, kept))) | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.pieces = _Cache(self._piece, words)
        self.words = _Cache(self._word, words)

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word)))

    def encode(self, text: str) -> np.ndarray:
        if self.pattern is None or _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), "<u4")

    @property
    def width(self) -> int:
        return bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text, ...) into files of ``folder``, in ascending order of doc_id.

    Returns the manifest (part, file, n_docs, n_ids, base): base counts the ids of all files before. Null ids come
    first; equal ids are ordered by their texts' hash. A null or empty text has the end id only.
    An empty table has no files. Further columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        fs, root = _filesystem(folder)
        writer = out = None
        scratch = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(scratch)
                    writer = TokenWriter(out, enc.width)
                writer.add(doc_id, np.append(enc.encode(text or ""), np.uint32(END_ID)))
        if writer is not None:
            writer.close()
            out.close()
            final = f"part-{part:06d}.tokens"
            fs.move(scratch, f"{root}/{final}")
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [final], "n_docs": pa.array([len(writer.names)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())}
            )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(reducers(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    # One row a file, so a single ordered window over them is small whatever the corpus.
    manifest = persist(ordered.mapInArrow(lean(write), "part int, file string, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as file:
                    reader = TokenReader(file)
                    firsts = reader.firsts
                    at = 0
                    while at < len(reader.names):
                        to = min(len(reader.names), max(at + 1, int(np.searchsorted(firsts, firsts[at] + (1 << 20), side="right")) - 1))
                        ids = reader.ids(int(firsts[at]), int(firsts[to])).astype("<u4")
                        cut = (firsts[at : to + 1] - firsts[at]).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.names[at:to], pa.int64()),
                                pa.array(firsts[at:to] + base),
                                pa.array(np.diff(firsts[at : to + 1])),
                                pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to

    spread = manifest.select("file", "base").repartition(reducers(manifest.sparkSession), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over documents: written, then read back; see write_tokens and read_tokens."""
    folder = fresh_path(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(manifest, folder)
