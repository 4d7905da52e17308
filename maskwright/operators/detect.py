"""Detection: text to spans through a pluggable emission source and a decoder."""

from __future__ import annotations

import functools
import os
import re
import time
from collections.abc import Iterator
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from maskwright.functions.decode import argmax_path, best_path, matrix
from maskwright.functions.spans import SPAN_TYPE, extract
from maskwright.functions.text import PATTERNS
from maskwright.operators.model import Transformer
from maskwright.plans.labels import DEFAULT_POINT, Biases, LabelSpace, moves, operating_points, pick_point

DecoderMode = Literal["viterbi", "argmax"]
STAGE_TIMING = "maskwright.stage.timing"


def decoder_mode(name: str) -> DecoderMode | None:
    """The mode of an exact lower-case name, else None."""
    return name if name in ("viterbi", "argmax") else None


def byte_offsets(text: str, chars: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets to UTF-8 byte offsets."""
    at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])])
    return [(int(at[a]), int(at[b])) for a, b in chars]


def pattern_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Spans of the pattern source: not a model, and labelled so."""
    found = [(label, *m.span()) for label, p in PATTERNS.items() for m in _compiled(p).finditer(text)]
    end, out = -1, []
    for label, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if a >= end:
            out.append((label, a, b))
            end = b
    return [(label, *o, text[a:b]) for (label, a, b), o in zip(out, byte_offsets(text, [s[1:] for s in out]))]


@functools.lru_cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


@functools.lru_cache(maxsize=1)
def _worker_model(folder: str):
    """One model and tokenizer per worker process."""
    from tokenizers import Tokenizer

    return Transformer.load(folder), Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))


class Detector:
    """Spans by scores: from a checkpoint folder, or from columns that hold tokens and scores already."""

    def __init__(self, label_info: LabelSpace, points: dict[str, Biases] | None = None, folder: str | None = None):
        self.label_info, self.points, self.folder = label_info, points or {DEFAULT_POINT: Biases()}, folder

    @classmethod
    def load(cls, folder: str) -> Detector:
        """Labels and calibration are read here; workers map the weights when they need them."""
        calibration = os.path.join(folder, "viterbi_calibration.json")
        return cls(LabelSpace.from_config(os.path.join(folder, "config.json")), operating_points(calibration if os.path.exists(calibration) else None), folder)

    def operating_points(self) -> list[str]:
        return sorted(self.points)

    def decoder_for(self, mode: DecoderMode, point: str = DEFAULT_POINT):
        """A function from scores [tokens, classes] to a label path."""
        m = moves(self.label_info, pick_point(self.points, point))
        return argmax_path if mode == "argmax" else lambda s: best_path(s, m)

    def count_tokens(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with ``tokens`` int, by the tokenizer alone."""
        folder = self.folder

        @F.pandas_udf("int")
        def count(texts: pd.Series) -> pd.Series:
            encoder = _worker_model(folder)[1]
            return pd.Series([len(e.ids) for e in encoder.encode_batch(list(texts.fillna("")), add_special_tokens=False)])

        return df.withColumn("tokens", count(F.col(text_col)))

    def detect(self, df: DataFrame, text_col: str = "text", decoder: DecoderMode = "viterbi", operating_point: str = DEFAULT_POINT) -> DataFrame:
        """``df`` with spans, tokens int, elapsed_us long and error string.

        With a checkpoint, texts are tokenised and scored in Arrow batches. Otherwise ``df`` holds offsets
        array<struct<byte_start, byte_end>> and scores array<array<float>>. The operating point is checked here, before
        any row is read. An empty text has no tokens and no spans; a null text is an error of its row. A failure
        is its row's error and doesn't stop the job. Filter rows before this call: Spark can't
        push a filter below it.
        """
        mode = decoder_mode(decoder)
        if mode is None:
            raise ValueError(f"unknown decoder {decoder!r}")
        pick_point(self.points, operating_point)
        detector, folder, columns = self, self.folder, df.columns
        extra = f"spans {SPAN_TYPE}, tokens int, elapsed_us long, error string"

        def one(text: str, row, decode) -> tuple[list, int]:
            if text is None:
                raise ValueError("no text")
            if text == "":
                return [], 0
            if folder:
                model, tokenizer = _worker_model(folder)
                encoded = tokenizer.encode(text, add_special_tokens=False)
                offsets = byte_offsets(text, encoded.offsets)
                scores = model.forward(np.array(encoded.ids, np.int64)) if encoded.ids else np.zeros((0, len(detector.label_info)))
            else:
                offsets = [(o["byte_start"], o["byte_end"]) for o in row["offsets"]]
                scores = matrix(row["scores"])
            path = decode(scores) if len(scores) else []
            return extract(path, offsets, text, detector.label_info), len(offsets)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            decode = detector.decoder_for(mode, operating_point)
            for frame in frames:
                rows = []
                for row in frame.to_dict("records"):
                    began = time.perf_counter_ns()
                    try:
                        spans, tokens = one(row[text_col], row, decode)
                        rows.append(([dict(zip(("label", "byte_start", "byte_end", "text"), s)) for s in spans], tokens, (time.perf_counter_ns() - began) // 1000, None))
                    except Exception as why:  # a row's failure stays with the row
                        rows.append((None, None, None, f"{type(why).__name__}: {why}"))
                out = pd.DataFrame(rows, columns=["spans", "tokens", "elapsed_us", "error"], index=frame.index)
                out["tokens"] = out["tokens"].astype("Int32")
                out["elapsed_us"] = out["elapsed_us"].astype("Int64")
                yield pd.concat([frame, out], axis=1)

        from pyspark.sql.types import StructType, _parse_datatype_string

        return df.mapInPandas(run, StructType([*df.schema, *_parse_datatype_string(extra)])).select(*columns, "spans", "tokens", "elapsed_us", "error")


def detect_patterns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``spans`` of the pattern source. Texts without a digit or at sign never reach Python."""

    @F.pandas_udf(SPAN_TYPE)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("label", "byte_start", "byte_end", "text"), s)) for s in pattern_spans(t)] if t else [])

    possible = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    return df.withColumn("spans", F.coalesce(find(F.when(possible, F.col(text_col))), F.array().cast(SPAN_TYPE)))
