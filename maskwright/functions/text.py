"""Byte-exact text functions as column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Patterns of the ``pattern`` emission source, ASCII classes only so that every regex engine agrees.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ip_address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card_number": r"[0-9]{16}",
}

#: The same for the JVM's engine. A run of an address's characters is tried once, from its start or where the last match ended.
_JVM = PATTERNS | {"email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"}

#: White space as text runtimes know it: ASCII (with vertical tab), no-break and typographic spaces, separators, byte order mark.
WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_unicode(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE}+", ""), f"{WHITE}++$", "")


def placeholder(label: Column) -> Column:
    """<LABEL>: upper case, each run of other characters one underscore, none at the end."""
    body = F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_")
    return F.concat(F.lit("<"), F.regexp_replace(body, "_+$", ""), F.lit(">"))


def log_placeholder(label: Column) -> Column:
    """As placeholder(), without a leading underscore: the form of the log report."""
    body = F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_")
    return F.concat(F.lit("<"), F.regexp_replace(body, "^_+|_+$", ""), F.lit(">"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) as text; null if they don't fall on character boundaries."""
    raw = F.substring(F.encode(text, "UTF-8"), start + 1, end - start)
    return F.try_validate_utf8(raw.cast("string"))


def byte_offset(text: Column, chars: Column) -> Column:
    """Byte offset of a code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


def line_number(text: Column, byte: Column) -> Column:
    """1-based line of a byte offset."""
    before = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte).cast("string")
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def byte_column(text: Column, byte: Column) -> Column:
    """1-based column of a byte offset, counted in bytes."""
    before = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte).cast("string")
    return byte - F.octet_length(F.coalesce(F.regexp_extract(before, r"(?s)^(.*\n)", 1), F.lit(""))) + 1


def trim_start(text: Column) -> Column:
    """Bytes of ASCII white space (space, tab, line feed, carriage return, form feed) that begin a text."""
    return F.octet_length(text) - F.octet_length(F.ltrim(text, F.lit(" \t\n\r\f")))


def trim_ascii(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\r\f"))


def snippet(text: Column, limit: int = 200) -> Column:
    """Runs of Unicode white space made one space, cut at ``limit`` code points with an ellipsis."""
    flat = F.regexp_replace(text, WHITE + "+", " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def span_key(span: Column) -> Column:
    """label@start..end"""
    return F.concat(span["label"], F.lit("@"), span["byte_start"].cast("string"), F.lit(".."), span["byte_end"].cast("string"))


def masked_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with column masked, the text as mask_patterns gives it, the number of each pattern's matches under its name, and
    their sum as hits.

    Each step works on the value that the step before it made, held in an array of one element, so none is evaluated twice."""
    value = F.col(text)
    held = F.array(F.struct(value.alias("masked"), *[F.lit(0).cast("long").alias(k) for k in [*PATTERNS, "hits"]]))

    def step(label: str, pattern: str):
        def change(s: Column) -> Column:
            found = F.regexp_count(s["masked"], F.lit(pattern)).cast("long")
            return F.struct(found.alias("found"), s.alias("s"))

        def put(x: Column) -> Column:
            s, found = x["s"], x["found"]
            new = F.when(found > 0, F.regexp_replace(s["masked"], pattern, f"<{label.upper()}>")).otherwise(s["masked"])
            return F.struct(new.alias("masked"), *[(found if k == label else s[k]).alias(k) for k in PATTERNS], (s["hits"] + found).alias("hits"))

        return change, put

    for label, pattern in _JVM.items():
        change, put = step(label, pattern)
        held = F.transform(F.transform(held, change), put)
    # Most texts hold neither a digit nor an at sign and skip the patterns.
    out = df.withColumn("__steps", F.when(value.rlike("[0-9@]"), held[0]))
    counts = {k: F.coalesce(F.col("__steps")[k], F.lit(0).cast("long")) for k in [*PATTERNS, "hits"]}
    return out.withColumns({"masked": F.coalesce(F.col("__steps")["masked"], value), **counts}).drop("__steps")


def mask_patterns(text: Column) -> Column:
    """Every pattern's matches replaced by its placeholder, in the order of PATTERNS."""
    out = text
    for label, pattern in _JVM.items():
        out = F.regexp_replace(out, pattern, f"<{label.upper()}>")
    # Most texts hold neither a digit nor an at sign and skip the patterns.
    return F.when(text.rlike("[0-9@]"), out).otherwise(text)


def redact(text: Column, spans: Column) -> Column:
    """Spans of array<struct<label, byte_start, byte_end, ...>> replaced by placeholders, left to right.

    Spans shouldn't overlap; a slice that isn't valid UTF-8 becomes empty. A null text
    stays null."""
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["byte_start"].alias("byte_start"), i.alias("i"), s["byte_end"].alias("byte_end"), s["label"].alias("label"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.when(b > a, F.coalesce(byte_slice(text, a, b), F.lit(""))).otherwise("")
    folded = F.aggregate(
        ordered,
        zero,
        lambda acc, s: F.struct(s["byte_end"].cast("int").alias("at"), F.concat(acc["out"], piece(acc["at"], s["byte_start"].cast("int")), placeholder(s["label"])).alias("out")),
    )
    return F.when(text.isNotNull(), F.concat(folded["out"], piece(folded["at"], F.octet_length(text))))
