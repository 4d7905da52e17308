"""Command line: check, redact, list or stream. Exit 0: clean, 1: found (check), 2: error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.functions.text import redact
from maskwright.operators.detect import Detector, detect_patterns
from maskwright.operators.report import check
from maskwright.sources.corpus import read_document
from maskwright.streaming.protocol import answer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    p.add_argument("mode", nargs="?", default="check", choices=["check", "redact", "list", "stream", "debug"])
    source = p.add_mutually_exclusive_group()
    source.add_argument("-f", "--file")
    source.add_argument("-t", "--text")
    p.add_argument("-m", "--model-dir", help="checkpoint folder; without one, patterns are used")
    p.add_argument("--decoder", default="viterbi", choices=["viterbi", "argmax"])
    p.add_argument("--operating-point", default="default")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        spark = spark or SparkSession.builder.appName("maskwright").getOrCreate()
        if args.model_dir:
            detector = Detector.load(args.model_dir)
            find = lambda df: detector.detect(df, decoder=args.decoder, operating_point=args.operating_point)
            find(spark.createDataFrame([("",)], "text string"))  # the operating point is checked before input is read
        else:
            if args.operating_point != "default":
                raise ValueError(f"unknown operating point {args.operating_point!r}; known: default")
            find = detect_patterns
        if args.mode == "stream":
            text = open(args.file, encoding="utf-8").read() if args.file else args.text if args.text is not None else sys.stdin.read()
            lines = spark.createDataFrame([(line, k) for k, line in enumerate(text.split("\n"))], "value string, seq long")
            for row in answer(lines, find).orderBy("seq").toLocalIterator():
                print(row["reply"], file=out)
            return 0
        given = args.text if args.text is not None or args.file else sys.stdin.read()
        found = find(read_document(spark, given, args.file)).cache()
        return emit(found, args.mode, out, err)
    except Exception as why:
        print(f"error: {why}", file=err)
        return 2


def emit(found: DataFrame, mode: str, out, err) -> int:
    if "error" in found.columns and (bad := found.where("error is not null").first()):
        raise RuntimeError(bad["error"])
    if mode == "redact":
        out.write(found.select(redact(F.col("text"), F.col("spans")).alias("r")).first()["r"] or "")
    elif mode in ("list", "debug"):
        print(json.dumps([s.asDict() for s in found.first()["spans"]], indent=2, ensure_ascii=False), file=out)
    else:
        rows = check(found).orderBy("byte_start").collect()
        for r in rows:
            print(f"{r['line']}:{r['col']}: {r['label']} ({r['byte_start']}..{r['byte_end']}) {json.dumps(r['text'], ensure_ascii=False)}", file=err)
        return int(bool(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
