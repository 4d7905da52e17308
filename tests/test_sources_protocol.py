import os
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import cli
from maskwright.operators.detect import Detector, detect_patterns
from maskwright.operators.model import SPLIT, ModelConfig, Transformer, banded_attention, write_safetensors
from maskwright.plans.labels import LabelSpace
from maskwright.sources import corpus, events
from maskwright.streaming import protocol

LINES = [
    "", "   ", "oops", '{"text": "x"}', '{"id": null, "text": "a@b.com"}', '{"id": 1}', '{"id": 1, "text": 5}', '{"id": {"k": 1}, "text": "t", "more": 2}\r',
    '{"id": "s", "text": ""}', "[1]", '{"id": 1, "text": "dup"}', '{"id": 1, "text": "dup"}', "\r",
]


def replies(rows):
    return [json.loads(r.reply) for r in rows]


def test_protocol(spark):
    df = spark.createDataFrame([(line, k) for k, line in enumerate(LINES)], "value string, seq int")
    rows = protocol.answer(df, detect_patterns).orderBy("seq").collect()
    assert [r.seq for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    got = replies(rows)
    assert [("error" in g) for g in got] == [True, True, True, False, True, True, False, False, True, False, False]
    assert all(g["id"] is None for g in got if "error" in g)
    assert got[3]["id"] is None and got[3]["spans"][0]["label"] == "email" and got[6]["id"] == {"k": 1} and got[7]["spans"] == []


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(LINES))
    query = protocol.answer_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), detect_patterns)
    query.awaitTermination(120)
    batch = protocol.answer(spark.read.text(str(folder)), detect_patterns)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(r.reply for r in batch.collect())


class Client:
    def groups(self):
        return ["x/a", "y/b", "y/bad", "y/c"]

    def events(self, group, since, limit):
        if group == "y/bad":
            raise OSError("no access")
        return [("s", 1000, "old"), ("s", 5000, f"hello {group}"), (None, None, ""), ("s", 6000, "more")]

    def page(self, first, size):
        return [{"language": "English" if (first + k) % 2 else "French", "source_text": " " if (first + k) % 5 == 0 else f"t{first + k}"} for k in range(size)]


def test_events(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = events.read_events(spark, Client(), contains="y/", since_ms=2000, max_chars=5).collect()
    assert sorted((r.log_group, r.message) for r in rows) == [("y/b", "hello"), ("y/b", "more"), ("y/c", "hello"), ("y/c", "more")]
    assert events.read_events(spark, Client(), contains="none").count() == 0
    assert events.read_events(spark, Client(), contains="y/", max_groups=1).count() == 3
    pages = events.read_pages(spark, Client(), 250)
    assert pages.count() == sum(1 for k in range(250) if k % 2 and k % 5)


def test_corpus_and_cache(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps({"id": k, "text": "é" * k}) for k in range(6)))
    assert [r.id for r in corpus.read_corpus(spark, str(path), 3, 8).collect()] == [0, 1, 2]
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "a.json").write_text('{"decoder":"viterbi","id":1,"spans":[]}\nbroken\n{"decoder":"viterbi","id":1,"spans":[],"decoded_mismatch":true}\n')
    rows, bad = corpus.read_cache(spark, str(cache))
    assert [(r.id, r.decoded_mismatch) for r in rows.collect()] == [(1, True)] and bad.first().bad == 1
    asked = spark.createDataFrame([("viterbi", 1), ("viterbi", 2)], "decoder string, id long")
    assert [r.id for r in corpus.missing_from(asked, rows, ["decoder", "id"]).collect()] == [2]
    assert [r.id for r in corpus.present_in(asked, rows, ["decoder", "id"]).collect()] == [1]
    corpus.append_cache(rows.withColumn("id", F.lit(7).cast("long")), str(cache))
    assert corpus.read_cache(spark, str(cache))[0].count() == 2
    with pytest.raises(ValueError):
        corpus.read_document(spark, "a", "b")
    numbered = corpus.english_rows(spark.createDataFrame([(5, "en", "a"), (3, "en", "b"), (4, "en", " "), (1, "fr", "c")], "d int, lang string, text string"), "d")
    assert sorted((r.id, r.text) for r in numbered.collect()) == [(0, "b"), (1, "a")]


def test_english_rows_of_several_partitions(spark):
    """Texts fill several partitions, while their keys alone fit into one."""
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.md5(F.concat_ws(" ", F.col("d"), x))))
    df = spark.range(900).select(((F.col("id") * 7) % 900).alias("d"), F.when(F.col("id") % 3 > 0, "en").otherwise("fr").alias("lang")).withColumn("text", text)
    wanted = [(r.d, r.m) for r in df.where("lang = 'en'").select("d", F.md5("text").alias("m")).orderBy("d").collect()]
    for order in (F.col("d"), F.format_string("k%05d", "d"), F.col("d") / 7):
        numbered = corpus.english_rows(df.withColumn("k", order), "k").select("id", F.md5("text").alias("m")).collect()
        assert sorted((r.id, r.m) for r in numbered) == [(k, m) for k, (_, m) in enumerate(wanted)]
    assert corpus.english_rows(df.where("d < 0"), "d").collect() == []


def test_ranges_are_even(spark):
    df = spark.range(20000).select((F.col("id") + 5).alias("d")).coalesce(1)
    rows = df.groupBy(corpus._range_of(df, "d").alias("p")).agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).orderBy("p").collect()
    assert [r.p for r in rows] == list(range(len(rows))) and len(rows) in (4, 5) and max(r.n for r in rows[:-1]) < 10000
    assert rows[0].a == 5 and rows[-1].b == 20004 and all(x.b < y.a for x, y in zip(rows, rows[1:]))


def test_english_rows_equal_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    from maskwright.plans.catalogue import ORACLES, english_nonblank_renumber

    texts = ["", " ", "\u00a0", " \u3000\u2003", "\n", " \t ", "\u200b", "\ufeff", "a\nb", "\u00a0x\u00a0", " \n", "\U0001f600", None]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(-5, "first", "en"), (None, "last", "en"), (3, "other", "fr"), (4, "none", None), (2**62, "far", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = db.execute(ORACLES["english_nonblank_renumber"]).fetchall()
    assert sorted(map(tuple, english_nonblank_renumber(spark, str(tmp_path)).collect())) == sorted(wanted)
    # Rows of the same order, which SQL leaves open, go by their texts.
    ties = spark.createDataFrame([(1, "en", t) for t in "cab"], "d int, lang string, text string").repartition(3)
    assert sorted((r.id, r.text) for r in corpus.english_rows(ties, "d").collect()) == [(0, "a"), (1, "b"), (2, "c")]


CONFIG = dict(
    vocab_size=40, hidden_size=16, intermediate_size=8, num_hidden_layers=2, num_attention_heads=4, num_key_value_heads=2, head_dim=8, num_local_experts=4,
    num_experts_per_tok=2, sliding_window=3, rms_norm_eps=1e-5, num_labels=5,
)
ROPE = dict(rope_theta=10.0, factor=2.0, original_max_position_embeddings=64, beta_fast=8.0, beta_slow=2.0)


def checkpoint(folder):
    rng = np.random.default_rng(0)
    shape = {
        "embed": (40, 16), "norm": (16,), "head": (5, 16), "head_b": (5,), "attn_norm": (16,), "sinks": (4,), "q_w": (32, 16), "q_b": (32,), "k_w": (16, 16), "k_b": (16,),
        "v_w": (16, 16), "v_b": (16,), "out_w": (16, 32), "out_b": (16,), "mlp_norm": (16,), "gate_w": (4, 16), "gate_b": (4,), "up_w": (4, 16, 16), "up_b": (4, 16), "down_w": (4, 8, 16), "down_b": (4, 16),
    }
    tensors = {name.format(i=i): rng.normal(size=shape[role]).astype(np.float32) for role, name in SPLIT.items() for i in range(2)}
    write_safetensors(str(folder / "model.safetensors"), tensors)
    names = {str(k): n for k, n in enumerate(["O", "B-x", "I-x", "E-x", "S-x"])}
    (folder / "config.json").write_text(json.dumps(CONFIG | {"rope_parameters": ROPE, "id2label": names}))
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {"<u>": 0} | {c: k + 1 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    t = Tokenizer(models.WordLevel(vocabulary, unk_token="<u>"))
    t.pre_tokenizer = pre_tokenizers.Split("", "isolated")
    t.save(str(folder / "tokenizer.json"))
    return tensors


def full_attention(q, k, v, sinks, window):
    score = np.einsum("qhd,khd->hqk", q, k).astype(np.float64)
    far = np.abs(np.arange(len(q))[:, None] - np.arange(len(q))[None]) > window
    score[:, far] = -np.inf
    joint = np.concatenate([score, np.broadcast_to((sinks * np.log(2))[:, None, None], (*score.shape[:2], 1))], 2)
    weight = np.exp(joint - joint.max(2, keepdims=True))
    weight = (weight / weight.sum(2, keepdims=True))[:, :, :-1]
    return np.einsum("hqk,khd->qhd", weight, v)


def test_banded_attention_is_the_masked_one():
    rng = np.random.default_rng(2)
    q, k, v = rng.normal(size=(3, 30, 4, 8)).astype(np.float32)
    sinks = rng.normal(size=4).astype(np.float32)
    assert np.allclose(banded_attention(q, k, v, sinks, 3, rows=7), full_attention(q, k, v, sinks, 3), atol=1e-5)


def test_checkpoint_detector(spark, tmp_path):
    tensors = checkpoint(tmp_path)
    model = Transformer.load(str(tmp_path))
    ids = np.arange(20) % 40
    split = model.forward(ids)
    fused = dict(tensors)
    from maskwright.operators.model import FUSED

    renamed = {FUSED[r].format(i=i): tensors[SPLIT[r].format(i=i)] for r in FUSED if r in SPLIT for i in range(2)}
    for i in range(2):
        for part in "wb":
            renamed[FUSED[f"qkv_{part}"].format(i=i)] = np.concatenate([fused[SPLIT[f"{x}_{part}"].format(i=i)] for x in "qkv"])
    assert np.allclose(Transformer(ModelConfig.from_file(str(tmp_path / "config.json")), renamed).forward(ids) + tensors["score.bias"], split, atol=1e-3)
    with pytest.raises(ValueError, match="exceed"):
        model.forward(np.zeros(200, np.int64))
    detector = Detector.load(str(tmp_path))
    df = spark.createDataFrame([("a", "hello world"), ("b", ""), ("c", None), ("d", "x" * 200)], "id string, text string")
    rows = {r.id: r for r in detector.detect(df).collect()}
    assert rows["a"].tokens == 11 and rows["a"].error is None and rows["b"].spans == [] and rows["b"].tokens == 0
    assert "exceed" in rows["d"].error and rows["c"].error and rows["c"].spans is None
    assert [r.tokens for r in detector.count_tokens(df.where("id < 'c'")).orderBy("id").collect()] == [11, 0]
    with pytest.raises(ValueError, match="known: default"):
        detector.detect(df, operating_point="nope")
    with pytest.raises(ValueError):
        detector.detect(df, decoder="Viterbi")


def test_table_detector(spark):
    space = LabelSpace.of_categories(["x"])
    scores = [[0.0, 0.0, 0.0, 0.0, 5.0], [5.0, 0.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([("ab cd", [(0, 3), (3, 5)], scores)], "text string, offsets array<struct<byte_start:int,byte_end:int>>, scores array<array<float>>")
    for mode in ("viterbi", "argmax"):
        row = Detector(space).detect(df, decoder=mode).first()
        assert [tuple(s) for s in row.spans] == [("x", 0, 2, "ab")]


def run_cli(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(argv), spark, out, err), out.getvalue(), err.getvalue()


def test_cli(spark):
    assert run_cli(spark, "check", "-t", "nothing")[0] == 0
    code, _, err = run_cli(spark, "-t", "x\na@b.com")
    assert code == 1 and err == '2:1: email (2..9) "a@b.com"\n'
    assert run_cli(spark, "redact", "-t", "to a@b.com")[:2] == (0, "to <EMAIL>")
    assert json.loads(run_cli(spark, "list", "-t", "a@b.com")[1])[0]["byte_end"] == 7
    assert run_cli(spark, "check", "-t", "a", "-f", "b")[0] == 2
    assert run_cli(spark, "check", "-t", "a", "--operating-point", "z")[0] == 2
    code, out, _ = run_cli(spark, "stream", "-t", '{"id":1,"text":"a@b.com"}\n\nbad')
    assert code == 0 and [("error" in json.loads(x)) for x in out.splitlines()] == [False, True]


def test_cache_takes_the_row_written_last(spark, tmp_path):
    # A long file is split, and a short one may be read together with any split; the younger file still wins.
    line = '{"decoder": "viterbi", "id": %d, "spans": [], "decoded_mismatch": %s}\n'
    (tmp_path / "part-b.json").write_text("".join(line % (k, "true") for k in range(3000)))
    (tmp_path / "part-a.json").write_text(line % (5, "false") + line % (7, "true") + line % (7, "false"))
    os.utime(tmp_path / "part-b.json", (1_000_000_000, 1_000_000_000))
    rows, bad = corpus.read_cache(spark, str(tmp_path))
    found = {r.id: r.decoded_mismatch for r in rows.collect()}
    assert len(found) == 3000 and [k for k, v in found.items() if not v] == [5, 7] and bad.first().bad == 0
