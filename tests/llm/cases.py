"""Rows that every operator must take: nulls, empty and long texts, repeats, odd characters, clashing names."""

EXTRA = "lang_pred int, score string, n_removed string, sig string, id string, sub string, part string, key string, k int, spans string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = "The quick brown fox jumps over the lazy dog near the river bank again. " * 3000
TEXTS = [
    None, "", " \n\t ", "a", "\n\n", "İstanbul ẞ ſ Ⅷ 日本語 \U0001f600 é", "one two three four five six seven eight nine ten", "x" * 50000,
    "mail a.b@c.de, 10.0.0.1 +1 (509) 555-6973 4111111111111111 token = \"0123456789abcdef0123456789abcdef\"", "<|endoftext|> I'll they've don't", LONG,
    "first line of some words that make a set\n\nfirst line of some words that make a set\nend",
]


def rows(texts=TEXTS, repeat=True):
    out = [(k * 3, t, "en" if k % 2 else None, None if k == 1 else "s", None if t is None else len(t), 1, "s", "n", "g", "i", "u", "p", "q", 7, "z") for k, t in enumerate(texts)]
    return out + out[6:9] if repeat else out


def docs(spark, texts=TEXTS, repeat=True):
    return spark.createDataFrame(rows(texts, repeat), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
