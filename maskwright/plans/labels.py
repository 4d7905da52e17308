"""Label space of a BIES tagger: classes, legal moves, start and end states, move biases."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Score of a forbidden move; in float32 anything small added to it vanishes.
FORBIDDEN = np.float32(-1e9)
DEFAULT_POINT = "default"


@dataclass(frozen=True)
class LabelSpace:
    """names in class order; per class its tag (O, B, I, E or S) and category (None for O)."""

    names: tuple[str, ...]
    tags: tuple[str, ...]
    categories: tuple[str | None, ...]
    background: int

    @classmethod
    def from_names(cls, by_id: dict) -> LabelSpace:
        """From a map of class id (any form int() reads) to name; ids must be 0..n-1."""
        ordered = sorted((int(k), v) for k, v in by_id.items())
        if [k for k, _ in ordered] != list(range(len(ordered))):
            raise ValueError("class ids must be 0 to n - 1")
        tags, categories, background = [], [], 0
        for k, name in ordered:
            if name == "O":
                tags.append("O")
                categories.append(None)
                background = k
                continue
            tag, dash, category = name.partition("-")
            if not dash or tag not in ("B", "I", "E", "S"):
                raise ValueError(f"bad label {name!r}")
            tags.append(tag)
            categories.append(category)
        return cls(tuple(n for _, n in ordered), tuple(tags), tuple(categories), background)

    @classmethod
    def from_config(cls, path: str) -> LabelSpace:
        with open(path, encoding="utf-8") as file:
            return cls.from_names(json.load(file)["id2label"])

    @classmethod
    def of_categories(cls, categories: list[str]) -> LabelSpace:
        """O, then B, I, E and S of each category."""
        return cls.from_names(dict(enumerate(["O", *(f"{t}-{c}" for c in categories for t in "BIES")])))

    def __len__(self) -> int:
        return len(self.names)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The space as a small dimension table."""
        return spark.createDataFrame(list(zip(range(len(self)), self.names, self.tags, self.categories)), "label_id int, name string, boundary string, category string")


@dataclass(frozen=True)
class Biases:
    """What is added to the score of a legal move, by the kind of move."""

    transition_bias_background_stay: float = 0.0
    transition_bias_background_to_start: float = 0.0
    transition_bias_inside_to_continue: float = 0.0
    transition_bias_inside_to_end: float = 0.0
    transition_bias_end_to_background: float = 0.0
    transition_bias_end_to_start: float = 0.0


def operating_points(path: str | None) -> dict[str, Biases]:
    """Named sets of biases of a calibration file; without one, zeros under the default name."""
    if path is None:
        return {DEFAULT_POINT: Biases()}
    with open(path, encoding="utf-8") as file:
        points = json.load(file)["operating_points"]
    if not points:
        raise ValueError("the calibration file names no operating point")
    known = {f.name for f in fields(Biases)}
    return {name: Biases(**{k: float(v) for k, v in point["biases"].items() if k in known}) for name, point in points.items()}


def pick_point(points: dict[str, Biases], name: str) -> Biases:
    if name not in points:
        raise ValueError(f"unknown operating point {name!r}; known: {', '.join(sorted(points))}")
    return points[name]


@dataclass(frozen=True)
class Moves:
    """Start, end and move scores as float32 arrays, ready for a decoder."""

    start: np.ndarray = field(repr=False)
    end: np.ndarray = field(repr=False)
    matrix: np.ndarray = field(repr=False)


def moves(space: LabelSpace, biases: Biases = Biases()) -> Moves:
    tag = np.array(space.tags)
    group = np.array(["" if c is None else c for c in space.categories])
    opens, closes, inside = np.isin(tag, ["O", "B", "S"]), np.isin(tag, ["O", "E", "S"]), np.isin(tag, ["I", "E"])
    same = group[:, None] == group[None, :]
    legal = np.where(closes[:, None], opens[None, :], inside[None, :] & same)
    o, begin, held, done = tag == "O", np.isin(tag, ["B", "S"]), np.isin(tag, ["B", "I"]), np.isin(tag, ["E", "S"])
    bias = np.zeros(legal.shape, np.float32)
    for rows, columns, value in (
        (o, o, biases.transition_bias_background_stay),
        (o, begin, biases.transition_bias_background_to_start),
        (held, tag == "I", biases.transition_bias_inside_to_continue),
        (held, tag == "E", biases.transition_bias_inside_to_end),
        (done, o, biases.transition_bias_end_to_background),
        (done, begin, biases.transition_bias_end_to_start),
    ):
        bias[np.ix_(rows, columns)] = value
    edge = lambda ok: np.where(ok, np.float32(0), FORBIDDEN).astype(np.float32)
    return Moves(edge(opens), edge(closes), np.where(legal, bias, FORBIDDEN).astype(np.float32))


def move_table(space: LabelSpace, spark: SparkSession, biases: Biases = Biases()) -> DataFrame:
    """All pairs of classes with legality and bias: a self-join of the dimension table, a few thousand rows."""
    dim = space.frame(spark)
    a = dim.select(F.col("label_id").alias("prev_id"), F.col("boundary").alias("pb"), F.col("category").alias("pc"))
    b = dim.select(F.col("label_id").alias("next_id"), F.col("boundary").alias("nb"), F.col("category").alias("nc"))
    closes, opens = F.col("pb").isin("O", "E", "S"), F.col("nb").isin("O", "B", "S")
    legal = F.when(closes, opens).otherwise(F.col("nb").isin("I", "E") & F.col("pc").eqNullSafe(F.col("nc")))
    start = F.col("nb").isin("B", "S")
    bias = (
        F.when(~F.col("legal"), None)
        .when((F.col("pb") == "O") & (F.col("nb") == "O"), F.lit(biases.transition_bias_background_stay))
        .when((F.col("pb") == "O") & start, F.lit(biases.transition_bias_background_to_start))
        .when(F.col("pb").isin("B", "I") & (F.col("nb") == "I"), F.lit(biases.transition_bias_inside_to_continue))
        .when(F.col("pb").isin("B", "I") & (F.col("nb") == "E"), F.lit(biases.transition_bias_inside_to_end))
        .when(F.col("pb").isin("E", "S") & (F.col("nb") == "O"), F.lit(biases.transition_bias_end_to_background))
        .when(F.col("pb").isin("E", "S") & start, F.lit(biases.transition_bias_end_to_start))
    )
    return a.crossJoin(F.broadcast(b)).withColumn("legal", legal).withColumn("bias", bias.cast("double")).select("prev_id", "next_id", "legal", "bias")
