"""Operator 8: secret scan by rules and by token efficiency.

Rules find assignments, access keys and long hexadecimal runs. The method adds runs that a tokenizer
finds hard: a vocabulary learned on language spends few characters per token on random strings. A run
of key-like characters is a secret if it is long, mixes classes as keys do, and its
characters per token stay below EFFICIENCY; known digests (hexadecimal of a hash's length),
UUIDs, numbers and identifiers made of words are excluded first.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import encoding
from .shared import lean, tune

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: Least length of a run that the method judges, and the characters per token below which it is random.
LENGTH = 16
EFFICIENCY = 2.0
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
_UUID = re.compile(r"(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def is_random(run: str, path: str, efficiency: float = EFFICIENCY) -> bool:
    """Does a run of key-like characters read as a random string?"""
    core = run.strip("=-_+/")
    if len(core) < LENGTH or _DIGEST.fullmatch(core) or _UUID.fullmatch(core):
        return False
    digits = sum(c.isdigit() for c in core)
    lower = sum(c.islower() for c in core)
    upper = sum(c.isupper() for c in core)
    # A key mixes at least two classes all through; numbers and words joined by signs don't.
    if digits == len(core) or min(digits + upper, digits + lower) < 3:
        return False
    longest = max((len(w) for w in _WORDS.findall(core) if not w[0].isdigit()), default=0)
    if longest > len(core) // 2:
        return False
    return len(core) < efficiency * len(encoding(path).encode_ordinary(core))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules, by start and then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower() if text.isascii() else text.translate(_FOLD)
        if any(n in low for n in _NAMES):
            found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_FOLD = {c: c + 32 for c in range(65, 91)}


def scan(text: str, path: str) -> tuple[list, list]:
    """(rule spans, all spans) of a text. A run that a rule's span covers or meets adds nothing."""
    base = base_spans(text)
    # Rule spans by start, with the furthest end up to each, tell in one look-up whether one meets a run.
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, e, _ in base), max))
    extra = []
    for m in RUN.finditer(text):
        a, b = m.span()
        k = bisect.bisect_left(starts, b)
        if (not k or reach[k - 1] <= a) and is_random(m[0], path):
            extra.append((a, b, "random"))
    return base, sorted(base + extra, key=lambda s: (s[0], (*KINDS, "random").index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def find_secrets(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...); see RESULT. Offsets are code points, ends exclusive.

    A null or empty text has no spans, and the SHA-256 of the empty string. Repeated rows
    yield repeated results. Further columns are ignored.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = scan(text or "", path)
                count = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), RESULT)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over documents; see find_secrets."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
