import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow.fs as pafs
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from maskwright.llm import byte_bpe, fingerprint, lang_id, pii_crf, secret_scan, shared, token_store

from . import cases

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
sha = lambda b: hashlib.sha256(b).hexdigest()


# -- 1 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=30).filter(lambda s: "\n" not in s), min_size=1, max_size=6), st.randoms())
def test_fingerprint_is_a_multiset_hash(lines, rng):
    shuffled = lines[:]
    rng.shuffle(shuffled)
    if any(lines):
        whole = fingerprint.Fingerprint("\n".join(lines))
        assert whole.hex() == fingerprint.Fingerprint("\n".join(shuffled)).hex() if any(shuffled) else True
        part = fingerprint.Fingerprint()
        for line in shuffled + ["extra"]:
            part.insert(line)
        part.delete("extra")
        assert part.hex() == whole.hex()
    assert fingerprint.likeness_hex(fingerprint.Fingerprint("a b").hex(), fingerprint.Fingerprint("a b").hex()) == 1


def test_likeness_has_no_step_in_length():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    for size in range(3, 200, 3):
        line = ""
        while len(line) < size:
            line += " " * bool(line) + rng.choice(words)
        more = line + " os"
        other = " ".join(rng.choices(words, k=len(line.split())))
        near, far = (fingerprint.likeness_hex(fingerprint.Fingerprint(line).hex(), fingerprint.Fingerprint(x).hex()) for x in (more, other))
        assert len(line) < 12 or near > 0.8
        assert near > far or line == other


def test_fingerprints(spark):
    rows = sorted(((r[0], r[1] or "") for r in cases.rows()), key=lambda r: (r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        e = fingerprint.edited(t, rows[(k + 1) % len(rows)][1])
        want.append((i, len(t), sha(e.encode()), fingerprint.Fingerprint(t).hex(), fingerprint.Fingerprint(e).hex()))
    got = fingerprint.fingerprints(cases.docs(spark)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 30).near_edited > 0.5
    assert fingerprint.fingerprints(cases.empty(spark)).count() == 0
    alone = fingerprint.fingerprints(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert alone[0].doc_id is None and alone[0].edited_sha256 == sha(b"abca")


# -- 2 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 16, 17, 31, 32])
def test_packing_round_trip(width, tmp_path):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, size=10001, dtype=np.uint64).astype(np.uint32)
    assert np.array_equal(token_store.unpack(token_store.pack(ids, width), width, len(ids)), ids)
    cuts = [0, 0, 5, 300, 9000, 10001]
    with open(tmp_path / "t", "wb") as out:
        writer = token_store.TokenWriter(out, width, block=64)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            writer.add(None if k == 2 else k, ids[a:b])
        writer.close()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "t")) as file:
        reader = token_store.TokenReader(file)
        assert reader.names == [0, 1, None, 3, 4]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert np.array_equal(reader.document(k), ids[a:b])
        assert np.array_equal(reader.ids(63, 129), ids[63:129])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aBc'sS  \n\t1²é.,!-_ ­İſΣ日́"), st.characters(max_codepoint=0x24F)), max_size=60))
def test_word_encoder_is_the_library(text):
    encoder = token_store.encoder(WORDS)
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_store(spark):
    folder = shared.fresh_path(spark, "tokens-test")
    manifest = token_store.write_tokens(cases.docs(spark), WORDS, folder)
    got = sorted(tuple(r) for r in token_store.read_tokens(manifest, folder).collect())
    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, []
    for i, t in sorted(((r[0], r[1] or "") for r in cases.rows()), key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    folder = shared.fresh_path(spark, "tokens-empty")
    assert token_store.read_tokens(token_store.write_tokens(cases.empty(spark), WORDS, folder), folder).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------


def brute_phrases(text: str, reference: str) -> int:
    count = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        count += 1
        at += max(size, 1)
    return count


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcx", min_size=1, max_size=40), st.text(alphabet="abc", min_size=1, max_size=30))
def test_parse_counts_longest_matches(text, reference):
    model = lang_id.learn({"l": reference})
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    symbols, bounds, _ = model.symbols(points, np.array([0, len(points)]))
    assert model.phrases(symbols, bounds)[0, 0] == brute_phrases(text, reference)


def test_languages_of_many_scripts():
    rng = random.Random(2)
    ranges = {"ar": (0x627, 36), "el": (0x3B1, 17), "en": (97, 26), "ja": (0x3041, 80), "ru": (0x430, 32), "th": (0xE01, 46), "zh": (0x4E00, 900)}
    words = {k: ["".join(chr(a + rng.randrange(n)) for _ in range(5)) for _ in range(150)] for k, (a, n) in ranges.items()}
    model = lang_id.learn({k: " ".join(rng.choices(w, k=2000 if k == "en" else 600)) for k, w in words.items()})
    names, scores = model.predict([" ".join(rng.choices(w, k=8)) for w in words.values()])
    assert names == list(words) and min(scores) > 0.9


def test_sparse_and_dense_tables_agree():
    rng = np.random.default_rng(1)
    model = lang_id.learn({"a": "abcab cabba accb", "b": "ccc abd dbd"})
    for name in range(2):
        reference = rng.integers(0, 6, size=300)
        dense, sparse = (lang_id.parse_table(reference, 7, d) for d in (1 << 20, 0))
        text, bounds = rng.integers(0, 7, size=900), np.array([0, 10, 10, 400, 900])
        model.own[name] = np.arange(7, dtype=np.int32)
        counts = []
        for table in (dense, sparse):
            model.tables[name] = table
            counts.append(lang_id.LanguageModel(["x"], model.symbol, [table], np.ones(1), [model.own[name]]).phrases(text, bounds)[:, 0].tolist())
        assert counts[0] == counts[1]


def test_rows_without_ids_are_learned_from(spark):
    rows = [(None, "the quick brown fox number %d" % k, "en") for k in range(40)] + [(None, "le renard brun saute %d fois" % k, "fr") for k in range(40)]
    rows += [(None, "the same text again", "en")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = lang_id.reference_texts(docs)
    assert set(texts) == {"en", "fr"} and "quick" in texts["en"] and texts["en"].count("again") == 1
    field = pii_crf.learn_field(spark.createDataFrame([(None, f"mail a{k}@b.org now {k}") for k in range(50)], "doc_id long, text string"))
    assert len(field.vocabulary) > 5


def test_language_of_messy_rows(spark):
    model = lang_id.learn({"en": "the quick brown fox jumps over the lazy dog " * 20, "xx": "zzz qqq kkk " * 50})
    got = lang_id.identify(cases.docs(spark), model).select("doc_id", "lang_pred", "score").collect()
    assert len(got) == len(cases.rows())
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 3, 6, 12)] == ["und"] * 4 and by[0].score == 0
    assert by[30].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert lang_id.identify(cases.empty(spark), model).count() == 0
    nothing = lang_id.learn(lang_id.reference_texts(cases.empty(spark)))
    assert {r.lang_pred for r in lang_id.identify(cases.docs(spark), nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    rng = random.Random(5)
    words = {"aa": ["alpha", "beta", "gamma", "delta", "nu"], "bb": ["uno", "dos", "tres", "cuatro", "nu"]}
    rows = [(k, " ".join(rng.choices(words[l], k=12)), l) for k in range(200) for l in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    model = lang_id.learn(lang_id.reference_texts(docs))
    got = {r.doc_id: r.lang_pred for r in lang_id.identify(docs, model).collect()}
    assert held and all(got[k] == lang for k, _, lang in rows if k in held)
    changed = docs.where(f"doc_id in ({','.join(map(str, held))})").selectExpr("doc_id", "text", "'zz' as lang")
    kept = docs.where(f"doc_id not in ({','.join(map(str, held))})")
    assert set(lang_id.reference_texts(kept.unionByName(changed))) == {"aa", "bb"}


# -- 5 ---------------------------------------------------------------------------------------------------------------


def brute_pii(t: str) -> list:
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii_crf.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20000):
        alphabet = rng.choice(["a@.1+- ", "0123456789 -", "@.ab-", "+1 ()-.2", "0.12", "4 1-", "é@.a1"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 34)))
        assert pii_crf.base_spans(text) == brute_pii(text)
    assert pii_crf.base_spans("a" * 200000 + "1" * 200000) == []


def test_messages_give_exact_marginals_on_a_tree():
    import itertools

    rng = np.random.default_rng(0)
    n, k = 4, len(pii_crf.LABELS)
    field = pii_crf.Field({f"f{i}": i for i in range(n)}, np.vstack([rng.normal(size=(n, k)), np.zeros(k)]), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    g = pii_crf.Graph([(i, i + 1) for i in range(n)], [(f"f{i}",) for i in range(n)], np.array([-1, -1, -1, 2]), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    total = np.zeros((n, k))
    for x in itertools.product(range(k), repeat=n):
        if x[3] == 2:
            w = np.exp(sum(field.node[i, x[i]] for i in range(3)) + field.chain[x[0], x[1]] + field.chain[x[1], x[2]] + field.skip[x[1], x[3]])
            for i in range(n):
                total[i, x[i]] += w
    assert np.allclose(field.beliefs(g, 200), total / total.sum(1, keepdims=True), atol=1e-6)


def test_repeats_take_the_label_of_what_is_certain(spark):
    rng = random.Random(1)
    number = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"call +1 {number()} now" if k % 2 else f"version {k}.0 of {k} items" for k in range(300)]
    for k in range(60):
        a = number()
        texts.append(f"+1 {a} or +1 {a}, pages {k} and {k}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = pii_crf.learn_field(docs)
    text = "Reach +1 (509) 555-6973 by day. At night 555-6973 works too; item 17 and 18."
    base, every = pii_crf.annotate([text], field)[0]
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [("phone", "555-6973")]
    assert pii_crf.redact_text(text, every) == "Reach <PHONE> by day. At night <PHONE> works too; item 17 and 18."


def test_far_repeats_take_the_label_of_what_is_certain(spark):
    rng = random.Random(1)
    number = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"call +1 {number()} now" if k % 2 else f"version {k}.0 of {k} items" for k in range(300)]
    for k in range(60):
        a = number()
        texts.append(f"+1 {a} or +1 {a}, pages {k} and {k}")
    field = pii_crf.learn_field(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    text = "Reach +1 (509) 555-6973 by day. " + "Then 555-6973 works; item 17. " * 60
    assert pii_crf.redact_text(text, pii_crf.annotate([text], field)[0][1]).count("555-6973") == 0
    # Digits in several tokens are the number that a rule matched as one or in other pieces.
    for bare in ("509 555 6973", "509-555-6973", "5095556973"):
        text = f"Reach +1 (509) 555-6973 by day. At night {bare} works; item 17."
        base = pii_crf.base_spans(text)
        g = pii_crf.graph(text, base)
        ends = {text[slice(*g.spans[b])] for a, b in g.links if g.observed[a] >= 0 > g.observed[b]}
        assert ends == set(bare.split(" "))


def test_beliefs_converge_on_a_long_chain():
    k, n = len(pii_crf.LABELS), 60
    same = np.where(np.eye(k) > 0, 4.0, -4.0)
    field = pii_crf.Field({"f": 0}, np.zeros((2, k)), same, same)
    g = pii_crf.Graph([(i, i + 1) for i in range(n)], [("f",)] * n, np.array([4] + [-1] * (n - 1)), np.array([[i, i + 1] for i in range(n - 1)]), np.zeros((0, 2), np.int64))
    assert np.allclose(field.beliefs(g), field.beliefs(g, 2000), atol=1e-4) and field.beliefs(g)[-1].argmax() == 4


def test_personal_data_of_messy_rows(spark):
    for field in (pii_crf.learn_field(cases.empty(spark)), pii_crf.learn_field(cases.docs(spark))):
        got = pii_crf.find_personal_data(cases.docs(spark), field).collect()
        texts = {r[0]: r[1] or "" for r in cases.rows()}
        assert len(got) == len(cases.rows())
        for r in got:
            base = brute_pii(texts[r.doc_id])
            assert r.base_sha256 == sha(pii_crf.joined(base).encode())
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii_crf.KINDS]
            assert set(pii_crf.joined(base).split(",")) <= set(r.spans.split(","))
    assert pii_crf.find_personal_data(cases.empty(spark), field).count() == 0
    clean = pii_crf.redact(cases.docs(spark), field)
    assert clean.columns == cases.docs(spark).columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert kept[0] is None and kept[30] == cases.LONG and "<EMAIL>" in kept[24] and "a.b@c.de" not in kept[24]


# -- 7 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk,overlap", [(65536, 512), (500, 60), (40, 20)])
def test_byte_bpe(spark, chunk, overlap):
    enc = byte_bpe.encoding(RANKS)
    texts = cases.TEXTS if chunk > 40 else [t for t in cases.TEXTS if t is None or len(t) < 1000] + ["it's they're  don't   \n\n 123 we'll" * 9]
    want = []
    for r in cases.rows(texts):
        ids = np.array(enc.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0], len(ids), sha(ids.tobytes()), sha((r[1] or "").encode())))
    assert sorted(tuple(r) for r in byte_bpe.byte_bpe(cases.docs(spark, texts), RANKS, chunk, overlap).collect()) == sorted(want)


def test_byte_bpe_of_nothing(spark):
    assert byte_bpe.byte_bpe(cases.empty(spark), RANKS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab's re  \n1!é", min_size=80, max_size=300))
def test_stitched_cuts_are_token_boundaries(text):
    chunk, overlap = 40, 20
    parts = []
    for k in range(-(-len(text) // chunk)):
        b = byte_bpe.boundaries(text[k * chunk : k * chunk + chunk + overlap])
        parts.append((k, b[b < overlap].tolist(), b[b >= chunk].tolist()))
    true = {m.start() for m in byte_bpe._pattern().finditer(text)}
    assert set(byte_bpe.stitch(text, parts, chunk)) <= true


def test_trust_returns_after_a_long_token(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["alpha", "it's", "12", "b,"]) for _ in range(n))
    text = prose(3000) + "z" * 30000 + prose(4000) + " " * 9000 + prose(2000)
    chunk, overlap = 1000, 60
    parts = []
    for k in range(-(-len(text) // chunk)):
        b = byte_bpe.boundaries(text[k * chunk : k * chunk + chunk + overlap])
        parts.append((k, b[b < overlap].tolist(), b[b >= chunk].tolist()))
    cuts = byte_bpe.stitch(text, parts, chunk)
    assert set(cuts) <= {m.start() for m in byte_bpe._pattern().finditer(text)}
    lengths = sorted(b - a for a, b in zip(cuts, [*cuts[1:], len(text)]))
    assert lengths[-1] < 33000 and lengths[-2] < 12000 and lengths[-3] < 3 * chunk
    ids = np.array(byte_bpe.encoding(RANKS).encode_ordinary(text), "<u4")
    got = byte_bpe.byte_bpe(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, chunk, overlap).first()
    assert (got.n_tokens, got.ids_sha256) == (len(ids), sha(ids.tobytes()))


# -- 8 ---------------------------------------------------------------------------------------------------------------


def brute_secrets(t: str) -> list:
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(*m.span(), "assign") for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_secret_rules_equal_the_patterns():
    rng = random.Random(4)
    pieces = ["token", "Api_Key", "APIKEY", "ſecret", "toKen", "secret", "PassWd", "=", ":", " ", '"', "'", "abc", "0a1b2c3d", "AKIA", "ABCD1234", "é", "x.y-z"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == brute_secrets(text)


def test_random_runs_stand_out():
    rng = random.Random(0)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(100)]
    assert sum(secret_scan.is_random(k, RANKS) for k in keys) >= 95
    words = ["internationalization", "getUserAccountSettingsFromDatabase2", "the-quick-brown-fox-jumps-over-2020", "12345678901234567890123", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "a" * 60]
    assert not any(secret_scan.is_random(w, RANKS) for w in words)
    base, every = secret_scan.scan(f"see {keys[0]} here", RANKS)
    assert base == [] and every == [(4, 44, "random")]


@pytest.mark.parametrize("size", [16, 17, 20, 40])
def test_random_runs_without_digits_and_short_ones_stand_out(size):
    rng = random.Random(size)
    for alphabet in (string.ascii_letters, string.ascii_letters + string.digits):
        keys = ["".join(rng.choices(alphabet, k=size)) for _ in range(200)]
        assert sum(secret_scan.scan(f"see {k} here", RANKS)[1] == [(4, 4 + size, "random")] for k in keys) >= 180
    words = ["getUserAccountName", "HTMLParserFactory", "parseXMLDocument", "electroencephalogram", "user_settings_page2", "2020-01-01T10:00:00", "SomeClassNameInJava"]
    assert not any(secret_scan.scan(w, RANKS)[1] for w in words)


def test_secrets_of_messy_rows(spark):
    got = secret_scan.find_secrets(cases.docs(spark), RANKS).collect()
    texts = {r[0]: r[1] or "" for r in cases.rows()}
    assert len(got) == len(cases.rows())
    for r in got:
        base = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == sha(secret_scan.joined(base).encode()) and r.n_hex == sum(k == "hex" for *_, k in base)
    assert secret_scan.find_secrets(cases.empty(spark), RANKS).count() == 0
