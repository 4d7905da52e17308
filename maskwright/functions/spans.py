"""Spans from labels: as window expressions over token rows, as folds over arrays, and fused in numpy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maskwright.plans.labels import LabelSpace

ASCII_SPACE = b" \t\n\r\f"
SPAN_TYPE = "array<struct<label:string,byte_start:int,byte_end:int,text:string>>"


def token_spans(tokens: DataFrame, doc: str = "doc", pos: str = "pos") -> DataFrame:
    """(doc, label, tok_start, tok_end, byte_start, byte_end) from token rows (doc, pos, boundary, category,
    byte_start, byte_end).

    Whether a span is open after a token depends on that token alone, so one lag and one running sum per
    document suffice. Empty or inverted byte ranges are dropped.
    """
    order = W.partitionBy(doc).orderBy(pos)
    open_before = F.lag("boundary").over(order).isin("B", "I") & F.lag("category").over(order).eqNullSafe(F.col("category"))
    begins = F.col("category").isNotNull() & (F.col("boundary").isin("B", "S") | ~F.coalesce(open_before, F.lit(False)))
    marked = tokens.withColumn("_begins", begins.cast("int")).withColumn("_island", F.sum("_begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return (
        marked.where(F.col("category").isNotNull())
        .groupBy(doc, "_island")
        .agg(
            F.min("category").alias("label"), F.min(pos).alias("tok_start"), (F.max(pos) + 1).alias("tok_end"),
            F.min_by("byte_start", pos).alias("byte_start"), F.max_by("byte_end", pos).alias("byte_end"),
        )
        .where("byte_end > byte_start")
        .drop("_island")
    )


def drop_overlaps(spans: Column) -> Column:
    """Greedy choice over array<struct<label, byte_start, byte_end>>: earliest start first, then longest, then label;
    a span stays iff it starts at or after the end of the last one kept. Rejected spans don't move that end."""
    return F.aggregate(_ranked(spans), _nothing(), _keep)["kept"]


def drop_overlaps_per_label(spans: Column) -> Column:
    """The same choice within each label; the result is in order of start."""
    labels = F.array_distinct(F.transform(spans, lambda s: s["label"]))
    chosen = F.flatten(F.transform(labels, lambda x: F.aggregate(_ranked(F.filter(spans, lambda s: s["label"] == x)), _nothing(), _keep)["kept"]))
    return F.array_sort(chosen, lambda a, b: F.when(a["byte_start"] < b["byte_start"], -1).when(a["byte_start"] > b["byte_start"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))


def _ranked(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["byte_start"].cast("long").alias("a"), (-s["byte_end"]).cast("long").alias("b"), s["label"].alias("label"))))


def _nothing() -> Column:
    return F.expr("named_struct('end', -1L, 'kept', cast(array() as array<struct<label:string,byte_start:bigint,byte_end:bigint>>))")


def _keep(acc: Column, s: Column) -> Column:
    one = F.struct(s["label"].alias("label"), s["a"].alias("byte_start"), (-s["b"]).alias("byte_end"))
    return F.when(
        s["a"] >= acc["end"], F.struct((-s["b"]).alias("end"), F.concat(acc["kept"], F.array(one)).alias("kept"))
    ).otherwise(F.struct(acc["end"].alias("end"), acc["kept"].alias("kept")))


def span_difference(mine: Column, other: Column) -> Column:
    """Spans of ``mine`` whose (label, start, end) isn't among ``other``; repeats are no difference."""
    keys = F.transform(other, lambda s: F.struct(s["label"], s["byte_start"], s["byte_end"]))
    return F.filter(mine, lambda s: ~F.array_contains(keys, F.struct(s["label"], s["byte_start"], s["byte_end"])))


def assemble(path, space: LabelSpace) -> list[tuple[str, int, int]]:
    """(category, first token, token past the last) of a label sequence, tolerant of illegal ones."""
    out: list[list] = []
    alive = False
    for k, label in enumerate(path):
        tag, category = space.tags[label], space.categories[label]
        if category is None:
            alive = False
            continue
        if tag in ("B", "S") or not alive or out[-1][0] != category:
            out.append([category, k, k])
        out[-1][2] = k + 1
        alive = tag in ("B", "I")
    return [tuple(s) for s in out]


def assemble_open(path, space: LabelSpace) -> list[tuple[str, int, int]]:
    """The variant in which E doesn't close: I or E after any token of its category continues the span."""
    out: list[list] = []
    last = None
    for k, label in enumerate(path):
        tag, category = space.tags[label], space.categories[label]
        if category is None:
            last = None
            continue
        if not (tag in ("I", "E") and last == category):
            out.append([category, k, k])
        out[-1][2] = k + 1
        last = category
    return [tuple(s) for s in out]


def _greedy(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    end, kept = -1, []
    for s in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if s[1] >= end:
            kept.append(s)
            end = s[2]
    return kept


def extract(path, offsets: list[tuple[int, int]], text: str, space: LabelSpace) -> list[tuple[str, int, int, str]]:
    """Detected spans (label, byte_start, byte_end, text) of one document: assemble, map to bytes, trim ASCII
    white space, drop overlaps within and across labels, drop what isn't on character boundaries."""
    raw = text.encode("utf-8", "surrogatepass")
    found: dict[str, list[tuple[str, int, int]]] = {}
    for label, a, b in assemble(path, space):
        if b > len(offsets):
            continue
        s, e = offsets[a][0], offsets[b - 1][1]
        if not 0 <= s < e <= len(raw):
            continue
        body = raw[s:e]
        s += len(body) - len(body.lstrip(ASCII_SPACE))
        e -= len(body) - len(body.rstrip(ASCII_SPACE))
        if s < e:
            found.setdefault(label, []).append((label, s, e))
    out = []
    for label, s, e in _greedy([x for group in found.values() for x in _greedy(group)]):
        try:
            out.append((label, s, e, raw[s:e].decode("utf-8")))
        except UnicodeDecodeError:
            continue
    return out
