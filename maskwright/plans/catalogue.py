"""Registered queries of the annotation engine, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.functions import decode, spans as S, text as T
from maskwright.operators import agreement, detect, report
from maskwright.plans.labels import Biases, LabelSpace, move_table, moves
from maskwright.sources import corpus
from maskwright.streaming import protocol

SPACE = LabelSpace.of_categories([f"cat{k}" for k in range(8)])
BIASED = Biases(0.5, -0.25, 1.5, -0.75, 0.125, 0.375)
MAX_BYTES = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as class scores: 33 classes, sequences of ten tokens."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 10).cast("long").alias("seq"), (v % 10).cast("int").alias("pos"), F.slice("embedding", 1, 33).alias("scores")
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "scores"))).alias("r"))
    return rows.select("seq", F.transform("r", lambda x: x["scores"]).alias("scores"))


def paths(spark: SparkSession, sf_dir: str, biases: Biases | None = Biases()) -> DataFrame:
    """(seq, path): Viterbi under the biases, or argmax for None."""
    rows = sequences(spark, sf_dir)
    if biases is None:
        return rows.select("seq", F.transform("scores", decode.argmax_label).alias("path"))
    return rows.select("seq", decode.viterbi_udf(moves(SPACE, biases))("scores").alias("path"))


def label_rows(found: DataFrame) -> DataFrame:
    """One row a token: boundary, category and made-up byte offsets (four bytes a token, three of them covered)."""
    spark = found.sparkSession
    dim = SPACE.frame(spark).select("label_id", "boundary", "category")
    tokens = found.select(F.col("seq").alias("doc"), F.posexplode("path").alias("pos", "label_id"))
    return tokens.join(F.broadcast(dim), "label_id").withColumn("byte_start", F.col("pos") * 4).withColumn("byte_end", F.col("pos") * 4 + 3)


def span_arrays(found: DataFrame, name: str) -> DataFrame:
    spans = S.token_spans(label_rows(found))
    lists = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("byte_start", "byte_end", "label"))).alias("s"))
    shaped = lists.select(F.col("doc").alias("seq"), F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["byte_start"].alias("byte_start"), x["byte_end"].alias("byte_end"))).alias(name))
    return found.select("seq").join(shaped, "seq", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<label:string,byte_start:int,byte_end:int>>")))


def joined(path: str | F.Column) -> F.Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ",")


# Pattern source


def redact_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.mask_patterns(F.col("text"))).alias("redacted_md5"))


def redact_conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.mask_patterns(F.col("text")).alias("redacted"))


def redact_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.mask_patterns(F.col("html"))).alias("redacted_md5"))


def _counts(df: DataFrame) -> DataFrame:
    return T.masked_counts(df)


def _any() -> F.Column:
    return F.col("hits") > 0


def check_documents(spark, d):
    return _counts(table(spark, d, "documents").select("doc_id", "text")).where(_any()).select("doc_id", *T.PATTERNS)


def pii_report_by_source(spark, d):
    rows = _counts(table(spark, d, "documents").select("source", "text"))
    sums = [F.sum(k).alias(k) for k in T.PATTERNS]
    return rows.groupBy("source").agg(F.count("*").alias("events_scanned"), F.count_if(_any()).alias("events_with_pii"), *sums).where("events_with_pii > 0").orderBy(F.desc("events_with_pii"), "source")


def pii_report_by_lang_rollup(spark, d):
    rows = _counts(table(spark, d, "documents").select("source", "lang", "text"))
    total = F.sum(sum((F.col(k) for k in T.PATTERNS), F.lit(0))).alias("spans")
    return rows.rollup("lang", "source").agg(F.count("*").alias("events_scanned"), F.count_if(_any()).alias("events_with_pii"), total)


def pii_examples_topn(spark, d):
    rows = _counts(table(spark, d, "documents").select("doc_id", "source", "text")).where(_any())
    return report.first_examples(rows.withColumn("spans", F.array(F.lit(1))), "source", ["doc_id"], 3).select("source", "rank", "doc_id", F.md5("masked").alias("redacted_md5"))


def span_lines(spark, d):
    """Line and byte column of every card number, from offset arithmetic on bytes."""
    docs = detect.detect_patterns(table(spark, d, "documents").select("doc_id", "text"))
    found = report.check(docs.withColumn("spans", F.filter("spans", lambda s: s["label"] == "card_number")))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.col("text").alias("card"))


# Scans and filters


def byte_length_filter(spark, d):
    rows = corpus.limit_rows(table(spark, d, "documents").select("doc_id", "text"), 100, MAX_BYTES, "doc_id")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


def english_nonblank_renumber(spark, d):
    return corpus.english_rows(table(spark, d, "documents"), "doc_id").select(F.col("id").cast("long").alias("id"), F.md5("text").alias("text_md5"))


def cache_missing(spark, d):
    return corpus.missing_from(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


def cache_present(spark, d):
    return corpus.present_in(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


def cache_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return corpus.latest(rows, ["user_id", "event_type"], "event_id")


def event_scan(spark, d):
    """Time range, substring of the group, non-empty message, message cut short."""
    e = table(spark, d, "events")
    return e.where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & F.col("event_type").contains("c") & (F.col("props") != "")).select("event_id", "event_type", F.substring("props", 1, 12).alias("message"))


# Labels and decoders


def label_space(spark, d):
    return SPACE.frame(spark)


def transition_matrix(spark, d):
    return move_table(SPACE, spark).select("prev_id", "next_id", "legal")


def transition_bias(spark, d):
    return move_table(SPACE, spark, BIASED).where("legal").select("prev_id", "next_id", "bias")


def argmax_decode(spark, d):
    return scores(spark, d).select("seq", "pos", decode.argmax_label(F.col("scores")).alias("label_id"))


def topk_classes(spark, d):
    top = scores(spark, d).select("seq", "pos", F.posexplode(decode.top_labels(F.col("scores"), 3)).alias("k", "t"))
    return top.select("seq", "pos", (F.col("k") + 1).alias("rank"), F.col("t.label_id").alias("label_id"))


def log_softmax(spark, d):
    rows = scores(spark, d).select("seq", "pos", F.posexplode(decode.log_softmax(F.col("scores"))).alias("label_id", "lp"))
    return rows.select("seq", "pos", "label_id", F.round("lp", 6).alias("log_prob"))


def token_debug(spark, d):
    """Per token the decoded class, the best class and its probability."""
    best = scores(spark, d).select("seq", "pos", decode.argmax_label(F.col("scores")).alias("best_id"), F.round(F.exp(F.array_max(decode.log_softmax(F.col("scores")))), 6).alias("prob"))
    path = paths(spark, d).select("seq", F.posexplode("path").alias("pos", "decoded_id"))
    return best.join(path, ["seq", "pos"])


def viterbi_decode(spark, d):
    return paths(spark, d).select("seq", joined("path").alias("path"))


def viterbi_biased(spark, d):
    return paths(spark, d, BIASED).select("seq", joined("path").alias("path"))


def _span_rows(found: DataFrame) -> DataFrame:
    return S.token_spans(label_rows(found)).select(F.col("doc").alias("seq"), "label", F.col("tok_start").cast("int").alias("tok_start"), F.col("tok_end").cast("int").alias("tok_end"), "byte_start", "byte_end")


def span_assembly_viterbi(spark, d):
    return _span_rows(paths(spark, d))


def span_assembly_argmax(spark, d):
    return _span_rows(paths(spark, d, None))


def _intervals(spark, d) -> DataFrame:
    """Events as spans, a document per user; starts and lengths come from ids."""
    e = F.col("event_id")
    span = F.struct(F.col("event_type").alias("label"), ((e * 7) % 97).alias("byte_start"), ((e * 7) % 97 + 1 + (e * 13) % 23).alias("byte_end"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("g"), span.alias("s")).distinct()
    return rows.groupBy("g").agg(F.collect_list("s").alias("spans"))


def overlap_global(spark, d):
    return _intervals(spark, d).select("g", F.explode(S.drop_overlaps(F.col("spans"))).alias("s")).select("g", "s.label", "s.byte_start", "s.byte_end")


def overlap_per_label(spark, d):
    return _intervals(spark, d).select("g", F.explode(S.drop_overlaps_per_label(F.col("spans"))).alias("s")).select("g", "s.label", "s.byte_start", "s.byte_end")


# Text functions


def trim_ascii(spark, d):
    """Every whole text from its first space on, trimmed."""
    docs = table(spark, d, "documents").select("doc_id", F.expr("substring(text, instr(text, ' '))").alias("p"))
    return docs.select("doc_id", T.trim_start(F.col("p")).cast("long").alias("lead"), F.md5(T.trim_ascii(F.col("p"))).alias("trimmed_md5"))


def char_to_byte(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.byte_offset(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("long").alias("middle_byte"))


def line_col(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", T.byte_offset(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("b"))
    return docs.select("doc_id", T.line_number(F.col("text"), F.col("b")).cast("long").alias("line"), T.byte_column(F.col("text"), F.col("b")).cast("long").alias("col"))


def placeholders(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lit("_"), "p_name", F.lit("--")).alias("n"))
    return names.select("p_partkey", T.placeholder(F.col("n")).alias("placeholder"), T.log_placeholder(F.col("n")).alias("log_placeholder"))


def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def redact_spans(spark, d):
    """Every document with its characters 0..4 and 10..20, as far as it has them, replaced by way of their byte offsets."""
    docs = table(spark, d, "documents")
    at = lambda k: T.byte_offset(F.col("text"), F.lit(k)).cast("int")
    span = lambda label, a, b: F.struct(F.lit(label).alias("label"), at(a).alias("byte_start"), at(b).alias("byte_end"))
    spans = F.array(span("first part", 0, 4), span("b", 10, 20))
    return docs.select("doc_id", F.md5(T.redact(F.col("text"), spans)).alias("redacted_md5"))


# Agreement and reports


def _differences(spark, d) -> DataFrame:
    left = span_arrays(paths(spark, d, None), "left")
    right = span_arrays(paths(spark, d), "right")
    return agreement.differences(left.join(right, "seq"))


def agreement_matrix(spark, d):
    return agreement.agreement_matrix(_differences(spark, d), F.lit("argmax/viterbi"))


def agreement_by_label(spark, d):
    return agreement.by_label(_differences(spark, d))


def regression_gate(spark, d):
    return agreement.gate(agreement_matrix(spark, d), {"argmax/viterbi": 96.8, "viterbi/none": 99.0})


def latency_percentiles(spark, d):
    return report.percentiles(table(spark, d, "events"), "event_type", "value", {"p10": 10, "p50": 50, "p90": 90, "p99": 99})


def throughput(spark, d):
    e = table(spark, d, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("messages"), F.round(F.sum("value"), 2).alias("total"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean"), F.max("value").alias("most"))
    return sums.withColumn("rate", F.coalesce(F.round(F.col("messages") / F.nullif(F.col("total"), F.lit(0.0)), 6), F.lit(0.0)))


def stage_shares(spark, d):
    found = report.stage_shares(table(spark, d, "events").where("value is not null"), "event_type", "event_id")
    return found.select("event_type", "calls", "total", F.round("per_call", 4).alias("per_call"), F.round("share", 6).alias("share"))


# Protocol


def _requests(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    m = F.col("doc_id") % 10
    line = (
        F.when(m == 0, F.lit("not json"))
        .when(m == 1, F.to_json(F.struct("text")))
        .when(m == 2, F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("doc_id").alias("text"))))
        .when(m == 3, F.to_json(F.struct(F.concat(F.lit("k"), "doc_id").alias("id"), "text", F.lit(1).alias("more"))))
        .otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), "text")))
    )
    return docs.select(line.alias("value"), "doc_id")


def jsonl_protocol(spark, d):
    done = detect.detect_patterns(protocol.parse_requests(_requests(spark, d)))
    return done.select("doc_id", "id", F.col("error").isNotNull().alias("failed"), F.md5(T.mask_patterns(F.col("text"))).alias("redacted_md5"))


def jsonl_errors(spark, d):
    return protocol.parse_requests(_requests(spark, d)).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def jsonl_replies(spark, d):
    return protocol.answer(_requests(spark, d), detect.detect_patterns)


def stream_redact(spark, d):
    """The documents as a file stream, run to its end into files of the shared folder, redacted as the batch query does."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    rows = stream.select("doc_id", F.md5(T.mask_patterns(F.col("text"))).alias("redacted_md5"))
    query = rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


# SQL


def _sql_mask(text: str) -> str:
    for label, pattern in T.PATTERNS.items():
        text = f"regexp_replace({text}, '{pattern}', '<{label.upper()}>', 'g')"
    return text


def _sql_counts(text: str = "text") -> str:
    out = []
    for label, pattern in T.PATTERNS.items():
        out.append(f"len(regexp_extract_all({text}, '{pattern}'))::BIGINT AS {label}")
        text = f"regexp_replace({text}, '{pattern}', '<{label.upper()}>', 'g')"
    return ", ".join(out)


_SUM = " + ".join(T.PATTERNS)
_LABELS = "(SELECT 0 AS label_id, 'O' AS name, 'O' AS boundary, NULL::VARCHAR AS category UNION ALL SELECT 1 + 4 * k + t, ['B','I','E','S'][t + 1] || '-cat' || k, ['B','I','E','S'][t + 1], 'cat' || k FROM range(8) a(k), range(4) b(t))"
_SCORES = "(SELECT vec_id // 10 AS seq, (vec_id % 10)::INT AS pos, embedding[1:33] AS scores FROM embeddings)"
_CELLS = f"(SELECT seq, pos, unnest(range(33))::INT AS label_id, unnest(scores)::FLOAT AS s FROM {_SCORES})"
_LEGAL = "CASE WHEN p.boundary IN ('O','E','S') THEN n.boundary IN ('O','B','S') ELSE n.boundary IN ('I','E') AND p.category IS NOT DISTINCT FROM n.category END"


def _sql_bias(b: Biases) -> str:
    return f"""CASE WHEN p.boundary = 'O' AND n.boundary = 'O' THEN {b.transition_bias_background_stay}
        WHEN p.boundary = 'O' THEN {b.transition_bias_background_to_start}
        WHEN p.boundary IN ('B','I') AND n.boundary = 'I' THEN {b.transition_bias_inside_to_continue}
        WHEN p.boundary IN ('B','I') THEN {b.transition_bias_inside_to_end}
        WHEN n.boundary = 'O' THEN {b.transition_bias_end_to_background} ELSE {b.transition_bias_end_to_start} END"""


def _sql_paths(b: Biases | None) -> str:
    """CTEs that end in paths(seq, path)."""
    if b is None:
        return f"""l AS {_LABELS}, c AS {_CELLS},
        paths AS (SELECT seq, list(label_id ORDER BY pos) AS path FROM (SELECT seq, pos, arg_min(label_id, (-s, label_id)) AS label_id FROM c GROUP BY ALL) GROUP BY seq)"""
    return f"""l AS {_LABELS}, c AS {_CELLS},
        t AS (SELECT p.label_id AS prev, n.label_id AS next, ({_sql_bias(b)})::FLOAT AS bias FROM l p, l n WHERE {_LEGAL}),
        v AS (SELECT seq, pos, c.label_id, s AS score, [c.label_id] AS path FROM c JOIN l USING (label_id) WHERE pos = 0 AND boundary IN ('O','B','S')
          UNION ALL
          SELECT seq, pos + 1, next, any_value(s)::FLOAT + max(g)::FLOAT, list_append(arg_min(path, {{'a': -g, 'b': prev}}), next)
          FROM (SELECT v.seq, v.pos, t.next, t.prev, (v.score + t.bias)::FLOAT AS g, v.path, c.s FROM v JOIN t ON t.prev = v.label_id JOIN c ON c.seq = v.seq AND c.pos = v.pos + 1 AND c.label_id = t.next)
          GROUP BY seq, pos, next),
        paths AS (SELECT seq, arg_min(path, {{'a': -score, 'b': label_id}}) AS path FROM v JOIN l USING (label_id)
          WHERE pos = (SELECT max(pos) FROM c WHERE c.seq = v.seq) AND boundary IN ('O','E','S') GROUP BY seq)"""


def _sql_spans(source: str, name: str) -> str:
    """CTEs that end in name(seq, label, tok_start, tok_end, byte_start, byte_end)."""
    return f"""{name}_t AS (SELECT seq, pos, boundary, category, lag(boundary) OVER w AS pb, lag(category) OVER w AS pc
          FROM (SELECT seq, unnest(path) AS label_id, unnest(range(len(path)))::INT AS pos FROM {source}) JOIN l USING (label_id) WINDOW w AS (PARTITION BY seq ORDER BY pos)),
        {name}_i AS (SELECT *, sum((boundary IN ('B','S') OR NOT coalesce(pb IN ('B','I') AND pc = category, false))::INT) OVER (PARTITION BY seq ORDER BY pos) AS i FROM {name}_t WHERE category IS NOT NULL),
        {name} AS (SELECT seq, any_value(category) AS label, min(pos)::INT AS tok_start, (max(pos) + 1)::INT AS tok_end, (min(pos) * 4)::INT AS byte_start, (max(pos) * 4 + 3)::INT AS byte_end FROM {name}_i GROUP BY seq, i)"""


_INTERVALS = "(SELECT DISTINCT user_id AS g, event_type AS label, (event_id * 7) % 97 AS byte_start, (event_id * 7) % 97 + 1 + (event_id * 13) % 23 AS byte_end FROM events)"


def _sql_greedy(group: str) -> str:
    """One kept span after the other: the next is the first, in order, that starts at or after the last end."""
    on = " AND ".join(f"i.{c} = k.{c}" for c in group.split(", "))
    keep = "i." + group.replace(", ", ", i.")
    return f"""WITH RECURSIVE i AS {_INTERVALS},
        k AS (SELECT {group}, 0::BIGINT AS at, NULL::STRUCT(a BIGINT, b BIGINT, c VARCHAR) AS s FROM i GROUP BY {group}
          UNION ALL
          SELECT {keep}, (-min({{'a': i.byte_start, 'b': -i.byte_end, 'c': i.label}}).b)::BIGINT, min({{'a': i.byte_start, 'b': -i.byte_end, 'c': i.label}}) FROM k JOIN i ON {on} AND i.byte_start >= k.at GROUP BY {keep})
        SELECT g, s.c AS label, s.a AS byte_start, -s.b AS byte_end FROM k WHERE s IS NOT NULL"""


_DIFF = f"""WITH RECURSIVE {_sql_paths(Biases())}, argmax_p AS (SELECT seq, list(label_id ORDER BY pos) AS path FROM (SELECT seq, pos, arg_min(label_id, (-s, label_id)) AS label_id FROM c GROUP BY ALL) GROUP BY seq),
    {_sql_spans("argmax_p", "x")}, {_sql_spans("paths", "y")},
    ol AS (SELECT seq, label FROM x ANTI JOIN y USING (seq, label, byte_start, byte_end)), onr AS (SELECT seq, label FROM y ANTI JOIN x USING (seq, label, byte_start, byte_end)),
    m AS (SELECT 'argmax/viterbi' AS pair, count(*) AS total, count(*) FILTER (seq NOT IN (SELECT seq FROM ol UNION ALL SELECT seq FROM onr)) AS exact, (SELECT count(*) FROM ol) AS left_only, (SELECT count(*) FROM onr) AS right_only FROM paths),
    mm AS (SELECT *, total - exact AS mismatched, round(100.0 * exact / total, 2)::DOUBLE AS exact_pct FROM m)"""

_LINE = """CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '"k' || doc_id || '"' ELSE doc_id::VARCHAR END"""

ORACLES: dict[str, str] = {
    "redact_documents": f"SELECT doc_id, md5({_sql_mask('text')}) AS redacted_md5 FROM documents",
    "redact_conversations": f"SELECT conv_id, turn, {_sql_mask('text')} AS redacted FROM conversations",
    "redact_pages": f"SELECT page_id, md5({_sql_mask('html')}) AS redacted_md5 FROM pages",
    "check_documents": f"SELECT * FROM (SELECT doc_id, {_sql_counts()} FROM documents) WHERE {_SUM} > 0",
    "pii_report_by_source": f"SELECT source, count(*) AS events_scanned, count(*) FILTER ({_SUM} > 0) AS events_with_pii, {', '.join(f'sum({k})::BIGINT AS {k}' for k in T.PATTERNS)} FROM (SELECT source, {_sql_counts()} FROM documents) GROUP BY source HAVING events_with_pii > 0",
    "pii_report_by_lang_rollup": f"SELECT lang, source, count(*) AS events_scanned, count(*) FILTER ({_SUM} > 0) AS events_with_pii, sum({_SUM})::BIGINT AS spans FROM (SELECT lang, source, {_sql_counts()} FROM documents) GROUP BY ROLLUP (lang, source)",
    "pii_examples_topn": f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank, doc_id, md5({_sql_mask('text')}) AS redacted_md5 FROM (SELECT doc_id, source, text, {_sql_counts()} FROM documents) WHERE {_SUM} > 0 QUALIFY rank <= 3",
    "byte_length_filter": f"SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) <= {MAX_BYTES} ORDER BY doc_id LIMIT 100",
    "english_nonblank_renumber": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, md5(text) AS text_md5 FROM documents WHERE lang = 'en' AND trim(text) <> ''",
    "cache_missing": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "cache_present": "SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)",
    "cache_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "event_scan": "SELECT event_id, event_type, substring(props, 1, 12) AS message FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND contains(event_type, 'c') AND props <> ''",
    "label_space": f"SELECT label_id::INT AS label_id, name, boundary, category FROM {_LABELS}",
    "transition_matrix": f"WITH l AS {_LABELS} SELECT p.label_id::INT AS prev_id, n.label_id::INT AS next_id, {_LEGAL} AS legal FROM l p, l n",
    "transition_bias": f"WITH l AS {_LABELS} SELECT p.label_id::INT AS prev_id, n.label_id::INT AS next_id, ({_sql_bias(BIASED)})::DOUBLE AS bias FROM l p, l n WHERE {_LEGAL}",
    "argmax_decode": f"SELECT seq, pos, arg_min(label_id, (-s, label_id)) AS label_id FROM {_CELLS} GROUP BY ALL",
    "topk_classes": f"SELECT seq, pos, row_number() OVER (PARTITION BY seq, pos ORDER BY s DESC, label_id)::INT AS rank, label_id FROM {_CELLS} QUALIFY rank <= 3",
    "log_softmax": f"SELECT seq, pos, label_id, round(s::DOUBLE - m - ln(sum(exp(s::DOUBLE - m)) OVER (PARTITION BY seq, pos)), 6) AS log_prob FROM (SELECT *, max(s) OVER (PARTITION BY seq, pos)::DOUBLE AS m FROM {_CELLS})",
    "token_debug": f"""WITH RECURSIVE {_sql_paths(Biases())}, b AS (SELECT seq, pos, arg_min(label_id, (-s, label_id)) AS best_id, max(s)::DOUBLE AS m FROM c GROUP BY ALL),
        q AS (SELECT c.seq, c.pos, round(exp(-ln(sum(exp(s::DOUBLE - m)))), 6) AS prob FROM c JOIN b ON b.seq = c.seq AND b.pos = c.pos GROUP BY ALL)
        SELECT b.seq, b.pos, best_id, prob, path[b.pos + 1]::INT AS decoded_id FROM b JOIN q ON q.seq = b.seq AND q.pos = b.pos JOIN paths ON paths.seq = b.seq""",
    "viterbi_decode": f"WITH RECURSIVE {_sql_paths(Biases())} SELECT seq, array_to_string(path, ',') AS path FROM paths",
    "viterbi_biased": f"WITH RECURSIVE {_sql_paths(BIASED)} SELECT seq, array_to_string(path, ',') AS path FROM paths",
    "span_assembly_viterbi": f"WITH RECURSIVE {_sql_paths(Biases())}, {_sql_spans('paths', 'x')} SELECT * FROM x",
    "span_assembly_argmax": f"WITH {_sql_paths(None)}, {_sql_spans('paths', 'x')} SELECT * FROM x",
    "overlap_global": _sql_greedy("g"),
    "overlap_per_label": _sql_greedy("g, label"),
    "trim_ascii": r"SELECT doc_id, strlen(p) - strlen(ltrim(p, e' \t\n\r\f')) AS lead, md5(trim(p, e' \t\n\r\f')) AS trimmed_md5 FROM (SELECT doc_id, CASE WHEN instr(text, ' ') = 0 THEN text ELSE substring(text, instr(text, ' ')) END AS p FROM documents)",
    "char_to_byte": "SELECT doc_id, strlen(substring(text, 1, length(text) // 2)) AS middle_byte FROM documents",
    "line_col": r"SELECT doc_id, length(b) - length(replace(b, chr(10), '')) + 1 AS line, strlen(string_split(b, chr(10))[-1]) + 1 AS col FROM (SELECT doc_id, substring(text, 1, length(text) // 2) AS b FROM documents)",
    "placeholders": "SELECT p_partkey, '<' || regexp_replace(n, '_+$', '') || '>' AS placeholder, '<' || regexp_replace(n, '^_+|_+$', '', 'g') || '>' AS log_placeholder FROM (SELECT p_partkey, regexp_replace(upper('_' || p_name || '--'), '[^A-Z0-9]+', '_', 'g') AS n FROM part)",
    "snippets": r"SELECT doc_id, CASE WHEN length(f) > 200 THEN substring(f, 1, 200) || '…' ELSE f END AS snippet FROM (SELECT doc_id, regexp_replace(text, '[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g') AS f FROM documents)",
    "redact_spans": "SELECT doc_id, md5('<FIRST_PART>' || substring(text, 5, 6) || '<B>' || substring(text, 21)) AS redacted_md5 FROM documents",
    "agreement_matrix": f"{_DIFF} SELECT pair, total, exact, left_only, right_only, mismatched, exact_pct FROM mm",
    "agreement_by_label": f"{_DIFF} SELECT label, count(*) FILTER (k = 0) AS left_only, count(*) FILTER (k = 1) AS right_only FROM (SELECT label, 0 AS k FROM ol UNION ALL SELECT label, 1 FROM onr) GROUP BY label",
    "regression_gate": f"{_DIFF} SELECT a.pair, a.threshold::DOUBLE AS threshold, exact_pct, coalesce(exact_pct >= threshold, false) AS passed FROM (VALUES ('argmax/viterbi', 96.8), ('viterbi/none', 99.0)) a(pair, threshold) LEFT JOIN mm USING (pair)",
    "latency_percentiles": "SELECT event_type, " + ", ".join(f"list_sort(list(value))[least(count(value) - 1, floor({p / 100} * count(value))::BIGINT) + 1] AS p{p}" for p in (10, 50, 90, 99)) + " FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "throughput": "SELECT event_type, count(*) AS messages, round(sum(value), 2) AS total, round(coalesce(avg(value), 0), 4) AS mean, max(value) AS most, coalesce(round(count(*) / nullif(round(sum(value), 2), 0), 6), 0) AS rate FROM events GROUP BY event_type",
    "stage_shares": "SELECT event_type, count(*) AS calls, sum(event_id)::BIGINT AS total, round(sum(event_id)::DOUBLE / count(*), 4) AS per_call, round(sum(event_id)::DOUBLE / sum(sum(event_id)) OVER (), 6) AS share FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "jsonl_protocol": f"SELECT doc_id, {_LINE} AS id, doc_id % 10 IN (0, 1, 2) AS failed, CASE WHEN doc_id % 10 > 2 THEN md5({_sql_mask('text')}) END AS redacted_md5 FROM documents",
    "jsonl_errors": "SELECT CASE doc_id % 10 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'missing field id' ELSE 'text is not a string' END AS error, count(*) AS n FROM documents WHERE doc_id % 10 < 3 GROUP BY 1",
    "stream_redact": f"SELECT doc_id, md5({_sql_mask('text')}) AS redacted_md5 FROM documents",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        redact_documents, redact_conversations, redact_pages, check_documents, pii_report_by_source, pii_report_by_lang_rollup, pii_examples_topn, span_lines,
        byte_length_filter, english_nonblank_renumber, cache_missing, cache_present, cache_latest, event_scan,
        label_space, transition_matrix, transition_bias, argmax_decode, topk_classes, log_softmax, token_debug, viterbi_decode, viterbi_biased,
        span_assembly_viterbi, span_assembly_argmax, overlap_global, overlap_per_label,
        trim_ascii, char_to_byte, line_col, placeholders, snippets, redact_spans,
        agreement_matrix, agreement_by_label, regression_gate, latency_percentiles, throughput, stage_shares,
        jsonl_protocol, jsonl_errors, jsonl_replies, stream_redact,
    )
}
