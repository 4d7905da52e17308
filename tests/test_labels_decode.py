import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from maskwright.functions.decode import argmax_label, argmax_path, best_path, log_softmax, top_labels
from maskwright.functions.spans import assemble, assemble_open, extract
from maskwright.plans.labels import Biases, LabelSpace, moves, operating_points, pick_point

SPACE = LabelSpace.of_categories(["x", "y"])
BIASES = Biases(0.5, -0.25, 1.5, -0.75, 0.125, 0.375)


def legal(path):
    m = moves(SPACE)
    return m.start[path[0]] == 0 and m.end[path[-1]] == 0 and all(m.matrix[a, b] == 0 for a, b in zip(path, path[1:]))


def test_label_space():
    assert SPACE.names[:5] == ("O", "B-x", "I-x", "E-x", "S-x") and SPACE.background == 0
    assert LabelSpace.from_names({"1": "B-a-b", "0": "O"}).categories == (None, "a-b")
    for bad in ({"0": "O", "2": "B-x"}, {"0": "X-a"}, {"0": "plain"}):
        with pytest.raises(ValueError):
            LabelSpace.from_names(bad)


def test_operating_points(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"operating_points": {"b": {"biases": {"transition_bias_end_to_start": 2}}, "default": {"biases": {}}}}))
    points = operating_points(str(path))
    assert points["b"].transition_bias_end_to_start == 2 and points["default"] == Biases()
    assert operating_points(None) == {"default": Biases()}
    with pytest.raises(ValueError, match="b, default"):
        pick_point(points, "zzz")
    path.write_text('{"operating_points": {}}')
    with pytest.raises(ValueError):
        operating_points(str(path))


@pytest.mark.parametrize("biases", [Biases(), BIASES])
def test_viterbi_is_the_best_legal_path(biases):
    rng = np.random.default_rng(1)
    m = moves(SPACE, biases)
    for t in (1, 2, 3, 4):
        for _ in range(10):
            s = rng.normal(size=(t, len(SPACE))).astype(np.float32)
            path = best_path(s, m)
            assert legal(path)
            value = lambda p: sum(float(s[k, c]) for k, c in enumerate(p)) + sum(float(m.matrix[a, b]) for a, b in zip(p, p[1:]))
            best = max(value(p) for p in itertools.product(range(len(SPACE)), repeat=t) if legal(p))
            assert value(path) >= best - 1e-4


def test_viterbi_edges():
    m = moves(SPACE)
    assert len(best_path(np.zeros((0, 9), np.float32), m)) == 0
    assert list(best_path(np.zeros((3, 9), np.float32), m)) == [0, 0, 0]
    hopeless = np.full((2, 9), -1e9, np.float32)
    hopeless[:, 2] = 0
    assert list(best_path(np.where(hopeless == 0, 0, -np.inf).astype(np.float32), m)) == [2, 2]
    assert list(argmax_path(np.array([[np.nan, 1, 1], [np.nan] * 3]))) == [1, 0]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(range(9)), min_size=1, max_size=6))
def test_legal_argmax_is_kept(path):
    if legal(path):
        s = np.zeros((len(path), 9), np.float32)
        s[np.arange(len(path)), path] = 5
        assert list(best_path(s, moves(SPACE))) == path
        assert list(best_path(s + np.float32(3), moves(SPACE))) == path


CASES = [
    ("B-x I-x E-x", [("x", 0, 3)]), ("B-x O O", [("x", 0, 1)]), ("B-x B-x E-x", [("x", 0, 1), ("x", 1, 3)]), ("I-x I-x", [("x", 0, 2)]),
    ("B-x I-y E-y", [("x", 0, 1), ("y", 1, 3)]), ("E-x", [("x", 0, 1)]), ("B-x E-y", [("x", 0, 1), ("y", 1, 2)]), ("S-x I-x", [("x", 0, 1), ("x", 1, 2)]),
    ("B-x S-x E-x", [("x", 0, 1), ("x", 1, 2), ("x", 2, 3)]),
]


@pytest.mark.parametrize("labels,spans", CASES)
def test_assemble(labels, spans):
    assert assemble([SPACE.names.index(n) for n in labels.split()], SPACE) == spans


def test_window_assembly_equals_fold(spark):
    from maskwright.functions.spans import token_spans

    rows, want = [], set()
    for d, path in enumerate(itertools.product(range(9), repeat=3)):
        rows += [(d, k, SPACE.tags[c], SPACE.categories[c], k * 2, k * 2 + 1) for k, c in enumerate(path)]
        want |= {(d, *s) for s in assemble(path, SPACE)}
    df = spark.createDataFrame(rows, "doc int, pos int, boundary string, category string, byte_start int, byte_end int")
    assert {(r.doc, r.label, r.tok_start, r.tok_end) for r in token_spans(df).collect()} == want


def test_assemble_open():
    names = lambda s: [SPACE.names.index(n) for n in s.split()]
    assert assemble_open(names("B-x E-x I-x"), SPACE) == [("x", 0, 3)]
    assert assemble_open(names("B-x O E-x"), SPACE) == [("x", 0, 1), ("x", 2, 3)]


def test_extract_bytes():
    path = [SPACE.names.index("S-x")] * 2
    text = "\t é "
    assert extract(path[:1], [(0, 5)], text, SPACE) == [("x", 2, 4, "é")]
    # Two tokens that split one character cover the same bytes: one span remains.
    assert extract(path, [(2, 4), (2, 4)], text, SPACE) == [("x", 2, 4, "é")]
    assert extract(path[:1], [(2, 3)], text, SPACE) == []
    assert extract(path[:1], [(0, 2)], text, SPACE) == []
    assert extract(path[:1], [(0, 2)], "\v\xa0"[:1] + "a", SPACE) == [("x", 0, 2, "\va")]


def test_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([nan, nan, nan],), ([nan, -1.0, 0.0],)], "s array<float>")
    rows = df.select(argmax_label(F.col("s")).alias("a"), top_labels(F.col("s"), 2).alias("t"), log_softmax(F.col("s")).alias("l")).collect()
    assert [r.a for r in rows] == [1, 0, 2]
    assert [x.label_id for x in rows[0].t] == [1, 2]
    assert sum(np.exp(rows[0].l)) == pytest.approx(1)
