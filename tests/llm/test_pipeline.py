import random

import public_tokenizers

import corpus_pipeline
from maskwright.llm import byte_bpe, lang_id, pii_crf

from . import cases
from .test_joins import brute_lines, brute_near


def run_stages(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark):
    rows = cases.rows(cases.TEXTS + [f"the fox and the dog {k} went over the hill and {k} came back over the hill" for k in range(6)], repeat=False)
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    language, lines, near, private, packed = run_stages(spark, docs)
    assert all(x.columns == docs.columns for x in (language, lines, near, private))
    letters = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert {r.doc_id: r.text for r in language.collect()} == letters
    kept = {i: t for i, t, removed in brute_lines(spark, list(letters.items())) if not removed or t.strip(" \n\r\t\v\f")}
    assert {r.doc_id: r.text for r in lines.collect()} == kept
    chosen = {i: kept[i] for i, _, _, c in brute_near(list(kept.items())) if i == c}
    assert {r.doc_id: r.text for r in near.collect()} == chosen
    field = pii_crf.learn_field(near)
    texts = list(chosen.values())
    clean = {i: pii_crf.redact_text(t, spans) for (i, t), (_, spans) in zip(chosen.items(), pii_crf.annotate(texts, field))}
    assert {r.doc_id: r.text for r in private.collect()} == clean
    total = sum(r.length for r in packed.collect())
    assert total == sum(len(x) for x in byte_bpe.encode_texts(list(clean.values()), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def test_stages_of_nothing_and_of_repeats(spark):
    assert [x.count() for x in run_stages(spark, cases.empty(spark))] == [0] * 5
    repeated = spark.createDataFrame([(1, "some words to keep", None, "s", 18)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, repeated, "").count() == 1
    assert corpus_pipeline.language(spark, repeated, "").count() == 0


def test_rows_without_ids_pass_through_all_stages(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(400)], 30)) for _ in range(40)]
    texts += [t + " more" for t in texts[:10]] + texts[20:25]
    rows = [(None, t, "en", "s", len(t)) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    language, lines, near, private, packed = run_stages(spark, docs)
    assert language.count() == 55
    assert lines.count() == near.count() == private.count() == 40
    found = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert len(found) == 40 and {r.text.removesuffix(" more") for r in found} == set(texts[:40])
    # Ids that repeat over different texts are rows of their own.
    same = docs.selectExpr("9L as doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_duplicates(spark, same, "").count() == 40


def test_language_rejects_only_what_has_no_language(spark):
    rows = [(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate([("hello there world", "en"), ("hola que tal amigo", "es"), ("123 !!", "en"), ("", "en")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, "").count() == 40
    assert set(lang_id.reference_texts(docs)) <= {"en", "es"}
