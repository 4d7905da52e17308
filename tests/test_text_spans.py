import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from maskwright.functions import spans as S, text as T
from maskwright.operators.detect import byte_offsets, detect_patterns, pattern_spans
from maskwright.operators.report import check, group_report, list_json, percentile_at, percentiles, redacted_examples, totals


def one(spark, column, **values):
    kinds = {str: "string", int: "int"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("name,want,logged", [("private_phone", "<PRIVATE_PHONE>", "<PRIVATE_PHONE>"), ("a--b.", "<A_B>", "<A_B>"), ("_x", "<_X>", "<X>"), ("--", "<>", "<>")])
def test_placeholder(spark, name, want, logged):
    assert one(spark, T.placeholder(F.col("n")), n=name) == want
    assert one(spark, T.log_placeholder(F.col("n")), n=name) == logged


@pytest.mark.parametrize("byte,at", [(3, (2, 1)), (2, (1, 3)), (0, (1, 1)), (5, (2, 3))])
def test_line_and_column(spark, byte, at):
    got = one(spark, F.struct(T.line_number(F.col("t"), F.col("b")), T.byte_column(F.col("t"), F.col("b"))), t="é\nab", b=byte)
    assert tuple(got) == at


def test_bytes(spark):
    assert one(spark, T.byte_offset(F.col("t"), F.lit(4)), t="aé 日b") == 7
    assert one(spark, T.byte_slice(F.col("t"), F.lit(1), F.lit(3)), t="aé 日b") == "é"
    assert one(spark, T.byte_slice(F.col("t"), F.lit(2), F.lit(3)), t="aé 日b") is None
    assert byte_offsets("aé 日b", [(0, 1), (1, 2), (3, 4), (4, 5)]) == [(0, 1), (1, 3), (4, 7), (7, 8)]
    assert one(spark, T.trim_ascii(F.col("t")), t="\t\f\v\xa0 x\r\n") == "\v\xa0 x"
    assert one(spark, T.snippet(F.col("t"), 5), t="a \n\tbcdef") == "a bcd…"


def overlaps(spark, function, spans):
    df = spark.createDataFrame([(spans,)], "s array<struct<label:string,byte_start:int,byte_end:int>>")
    return [tuple(x) for x in df.select(function(F.col("s")).alias("r")).first().r]


def test_overlaps(spark):
    x = [("a", 0, 5), ("a", 3, 10), ("a", 6, 8)]
    assert overlaps(spark, S.drop_overlaps, x) == [("a", 0, 5), ("a", 6, 8)]
    assert overlaps(spark, S.drop_overlaps, [("a", 0, 3), ("a", 0, 9)]) == [("a", 0, 9)]
    assert overlaps(spark, S.drop_overlaps, [("a", 0, 3), ("a", 3, 5)]) == [("a", 0, 3), ("a", 3, 5)]
    assert overlaps(spark, S.drop_overlaps, [("b", 0, 3), ("a", 0, 3)]) == [("a", 0, 3)]
    assert overlaps(spark, S.drop_overlaps_per_label, [("b", 0, 3), ("a", 0, 3)]) == [("a", 0, 3), ("b", 0, 3)]
    assert overlaps(spark, S.drop_overlaps, []) == []


def test_redact(spark):
    df = spark.createDataFrame([("é-abc-z", [("k", 3, 6), ("k v", 0, 2)]), ("plain", []), (None, [])], "t string, s array<struct<label:string,byte_start:int,byte_end:int>>")
    assert [r.r for r in df.select(T.redact(F.col("t"), F.col("s")).alias("r")).collect()] == ["<K_V>-<K>-z", "plain", None]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="a1.@ +()5é", max_size=40))
def test_pattern_spans_are_sound(text):
    raw, end = text.encode(), 0
    for _, a, b, piece in pattern_spans(text):
        assert end <= a < b <= len(raw) and raw[a:b].decode() == piece
        end = b


def test_reports(spark):
    rows = [(1, "g", "mail a@b.com\nand 1234567890123456"), (2, "g", "none"), (3, "h", ""), (4, "h", None), (5, "g", "c@d.org")]
    df = detect_patterns(spark.createDataFrame(rows, "id int, g string, text string"))
    found = {r.g: r for r in group_report(df, "g").collect()}
    assert (found["g"].events_scanned, found["g"].events_with_pii, found["g"].label_counts) == (3, 2, {"card_number": 1, "email": 2})
    assert (found["h"].events_scanned, found["h"].events_with_pii, found["h"].label_counts) == (2, 0, None)
    assert {(r.id, r.line, r.col, r.label) for r in check(df).collect()} == {(1, 1, 6, "email"), (1, 2, 5, "card_number"), (5, 1, 1, "email")}
    assert totals(df, "g").where("g is null and label is null").first().n == 3
    examples = redacted_examples(df, "g", ["id"], 1).collect()
    assert [e.message for e in examples[0].examples] == ["mail <EMAIL>\nand <CARD_NUMBER>"] and "text" not in examples[0].examples[0].spans[0].asDict()
    assert '"label"' in df.where("id = 5").select(list_json(F.col("spans")).alias("j")).first().j


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("b", None)], "g string, v double")
    assert percentiles(df, "g", "v", {"p50": 50, "p90": 90, "p99": 99}).collect()[0][1:] == (6.0, 10.0, 10.0)
    lists = spark.createDataFrame([([float(x) for x in range(1, 11)],), ([],)], "v array<double>")
    assert [r.r for r in lists.select(percentile_at(F.col("v"), 50).alias("r")).collect()] == [6.0, 0.0]


def test_address_pattern_of_the_jvm_equals_the_plain_one(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab@._%+- 1") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a@b.c_x@d.e", "a" * 200_000, "a@" * 20_000]
    got = T.masked_counts(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "masked", "email", "hits").collect()
    for r in got:
        want, n = re.subn(T.PATTERNS["email"], "<EMAIL>", r.text) if len(r.text) < 1000 else (r.text, 0)
        assert (r.masked, r.email) == (want, n) and r.hits >= n


def test_trim_unicode(spark):
    for text, want in (("  a　b ﻿ ", "a　b"), ("\x0b\t", ""), ("a", "a"), ("​ a", "​ a")):
        assert one(spark, T.trim_unicode(F.col("t")), t=text) == want
