import collections
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest

from maskwright.llm import byte_bpe, components, line_dedup, near_dup, packing, setjoin, textvec, topk

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {*zip(w, w[1:])} if len(w) > 1 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    similar, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 60 * (len(sets[a]) + len(sets[b]) - k):
            similar[a] += 1
            similar[b] += 1
            root[find(b)] = find(a)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted((i, len(sets[k]), similar[k], min(least[find(k)])) for k, (i, _) in enumerate(rows))


def edits(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("abcdefgh") * rng.randint(1, 3)
    return " ".join(w)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 40)) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 30, 80]))) for _ in range(12)]
    return [(k, edits(rng, t := rng.choice(base), rng.randint(0, max(1, len(t.split()) // 5)))) for k in range(n)]


@pytest.mark.parametrize("floor", [1 << 16, 5])
@pytest.mark.parametrize("seed", [1, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, floor, seed):
    # A low floor makes keys hot, so that the candidate graph goes through them.
    monkeypatch.setattr(setjoin, "HOT_FLOOR", floor)
    monkeypatch.setattr(setjoin, "HOT_TIMES", 1)
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 20)
    monkeypatch.setattr(setjoin, "CHAIN_FROM", 6)
    monkeypatch.setattr(components, "SMALL", 0 if floor == 5 else components.SMALL)
    rng = random.Random(seed)
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n "), (903, "Solo"), (904, "sOLO"), (905, cases.LONG), (906, cases.LONG + " more")]
    # Sizes around the bounds of bands, partners of up to 1 / 0.6 times the size, long texts.
    words = [f"w{k}" for k in range(3000)]
    for n in (3, 4, 5, 15, 16, 26, 63, 64, 65, 107, 255, 256, 300, 700):
        text = [rng.choice(words) for _ in range(n + 1)]
        for much in (0, 0.2, 0.5, 0.6, 0.66, 0.7):
            rows.append((1000 + len(rows), " ".join(text + [rng.choice(words) for _ in range(int(much * n))])))
        for much in (0.05, 0.1, 0.13, 0.2):
            rows.append((1000 + len(rows), " ".join(rng.choice(words) if rng.random() < much else w for w in text)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute_near(rows)


def near_pair(rng, n, b):
    """Two sets of n <= b tokens that link at J >= 0.6 just so."""
    overlap = -(-60 * (n + b) // 160)
    own = rng.integers(0, (1 << 64) - 1, size=n + b - overlap, dtype=np.uint64)
    return own[:n], np.concatenate([own[:overlap], own[n:]])


def test_parity_blocks_of_linked_sets_meet():
    # Whatever the order of keys: of two sets that just link, the published blocks share one.
    rng = np.random.default_rng(11)
    spec = near_dup.NEAR
    for trial in range(400):
        n = int(rng.integers(2, 1500) if trial % 2 else rng.choice([3, 4, 15, 16, 63, 64, 255, 256, 1023, 1024]))
        b = int(rng.integers(n, n * 5 // 3 + 1))
        sets = near_pair(rng, n, b)
        hashes, bounds = setjoin.distinct_sets(np.concatenate(sets), np.array([0, n, n + b]))
        found = setjoin.parity_blocks(spec, hashes, bounds)
        salt = np.uint64(rng.integers(1 << 62))
        published = collections.defaultdict(set)
        for k in range(len(found.row)):
            keys = found.keys[found.ends[k] : found.ends[k + 1]]
            published[int(found.row[k])] |= set(keys[np.argsort(setjoin.mix64(keys ^ salt))][: found.need[k]].tolist())
        # Common blocks first is the order that serves; unshared ones first is the worst.
        shared = {r: set(found.keys[np.repeat(found.row, np.diff(found.ends)) == r].tolist()) for r in (0, 1)}
        both = shared[0] & shared[1]
        worst = collections.defaultdict(set)
        for k in range(len(found.row)):
            keys = sorted(found.keys[found.ends[k] : found.ends[k + 1]].tolist(), key=lambda x: (x in both, x))
            worst[int(found.row[k])] |= set(keys[: found.need[k]])
        alone = spec.alone(np.array([n]))[0] or spec.alone(np.array([b]))[0]
        assert alone or (published[0] & published[1] and worst[0] & worst[1]), (n, b)


def test_blocks_filled_at_least():
    # The difference grows with the size, so the least partner of a range decides.
    for band in range(3, 10):
        n = np.unique(np.geomspace(4**band, 4 ** (band + 1) - 1, 300).astype(np.int64))
        bits = setjoin.block_bits(np.full(len(n), band))
        spare = setjoin.full_blocks(n, bits) - n / 4
        assert (np.diff(spare) >= -1).all() and (setjoin.full_blocks(n, bits) > n // 2).all()


def test_whole_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 200, 3000):
        a, b = near_pair(rng, n, n * 5 // 3)
        hashes, bounds = setjoin.distinct_sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        one, other = setjoin.whole_sketches(hashes, bounds)
        assert setjoin.hamming(one, other) == setjoin.hamming(other, one) <= len(np.setxor1d(a, b))
        assert len(other) * 8 >= 2 * len(b)


def test_near_rows_keep_links():
    rng = np.random.default_rng(2)
    sets = [s for _ in range(20) for s in near_pair(rng, int(rng.integers(3, 400)), 400)[:2] if len(s)]
    sets = [setjoin.distinct_sets(s, np.array([0, len(s)]))[0] for s in sets]
    near = setjoin.near_rows(sets, near_dup.NEAR)
    for i, j in itertools.combinations(range(len(sets)), 2):
        k = len(np.intersect1d(sets[i], sets[j]))
        if near_dup.NEAR.enough(k, len(sets[i]) + len(sets[j])):
            assert near[i] and near[j]


def test_near_duplicates_of_messy_rows(spark):
    got = near_dup.near_duplicates(cases.docs(spark)).collect()
    assert sorted(tuple(r) for r in got) == brute_near([(r[0], r[1]) for r in cases.rows()])
    assert near_dup.near_duplicates(cases.empty(spark)).count() == 0
    nameless = near_dup.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_similar, r.component_id) for r in nameless} == {(None, 1, 4), (4, 1, 4)}


def test_sketch_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 63, size=rng.integers(1, 300), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: len(a) // 2], b]))
        x = setjoin.parity_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert np.bitwise_count(x[0] ^ x[1]).sum() <= len(np.setxor1d(a, b))


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = setjoin.intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(30) for j in range(30) if i != j)


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.vertex: r.root for r in got.collect()} == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(spark, rows):
    """Rows (id, text) in order of id, null first, and hash of the text; each line with a word is held against all before it."""
    texts = list({t for _, t in rows if t is not None})
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()} if texts else {}
    tie[None] = 42
    before, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]])):
        kept = []
        for line in (t or "").split("\n"):
            w = set(WORD.findall(lower(line)))
            alike = any(100 * len(w & x) >= 80 * len(w | x) for x in before if w)
            if w:
                before.append(w)
            if not alike:
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def line_rows(seed):
    rng = random.Random(seed)
    lines = [t for _, t in corpus(seed + 1, 200)] + ["", " ", "\t", "short one", "a b a b a b", "Solo"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    return rows + [(100 + k, t) for k, t in enumerate(cases.TEXTS)]


@pytest.mark.parametrize("floor", [1 << 16, 5])
@pytest.mark.parametrize("case", ["plain", "repeated ids", "repeated rows", "no ids"])
def test_line_dedup_equals_brute_force(spark, monkeypatch, case, floor):
    # A low floor makes words hot and sends the components the distributed way.
    monkeypatch.setattr(setjoin, "HOT_FLOOR", floor)
    if floor == 5:
        monkeypatch.setattr(setjoin, "HOT_TIMES", 1)
        monkeypatch.setattr(components, "SMALL", 0)
    rows = line_rows(2)
    if case == "repeated ids":
        rows = [(7, "y\nA"), (7, "z\nU"), (8, "A\nA"), (3, "v w"), (3, "v w\nA")] + [(i // 3, t) for i, t in rows]
    elif case == "repeated rows":
        rows = rows + rows[::2] + rows[::3] + [(5000, None), (5000, None), (5001, "new words here"), (5001, "new words here")]
    elif case == "no ids":
        rows = [(None, t) for t in dict.fromkeys(t for _, t in rows)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, _id int, _subs string").repartition(3)
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_id", "_subs", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=str) == brute_lines(spark, rows)


def test_lines_without_spaces(spark):
    han = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(60))
    thai = "".join(chr(0x0E01 + 11 * k % 46) for k in range(23))
    rows = [(0, han), (1, han[:30] + "A" + han[31:]), (2, han[::-1]), (3, thai + "\nx " + han[:20]), (4, thai), (5, han[:20] + " X")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0
    messy = line_dedup.dedup_lines(cases.docs(spark)).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in messy), key=str) == brute_lines(spark, [(r[0], r[1]) for r in cases.rows()])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in messy if r.n_removed)


def brute_pack(items, capacity):
    rest, full = [], []
    for i, n, s, c in items:
        whole = max(0, n - 1) // capacity
        full += [(i, k, k * capacity, capacity) for k in range(whole)]
        rest.append((i, whole, whole * capacity, n - whole * capacity, s, c))
    rest.sort(key=lambda r: (-r[3], r[0], (r[4] is not None, str(r[4])), (r[5] is not None, str(r[5]))))
    bins, out = [], []
    for i, p, start, n, s, c in rest:
        fit = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([capacity, set(), set()])
        out.append((i, p, start, n, k, capacity - bins[k][0]))
        bins[k][0] -= n
        bins[k][1].add(s)
        bins[k][2].add(c)
    return out + [(*f, len(bins) + k, 0) for k, f in enumerate(sorted(full))]


def test_packing_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        items = [(k, rng.choice([0, rng.randint(1, 50), rng.randint(1, 250)]), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([1, 1, 2, 3, None, k + 10])) for k in range(rng.randint(0, 60))]
        assert packing.pack_group(items, 100) == brute_pack(items, 100)


def test_packing_of_messy_rows(spark):
    docs = cases.docs(spark)
    items = packing.text_items(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = packing.pack(items, 1000, 5).collect()
    lengths = collections.Counter()
    for r in got:
        lengths[r.doc_id] += r.length
        assert 0 <= r.offset and r.offset + r.length <= 1000
    want = collections.Counter()
    for r in cases.rows():
        want[r[0]] += len(byte_bpe.encode_texts([r[1]], public_tokenizers.path("byte_bpe_50k.tiktoken"))[0])
    assert lengths == want
    room = collections.defaultdict(list)
    for r in got:
        room[r.bin_id].append((r.offset, r.offset + r.length))
    assert all(a[1] <= b[0] for spans in room.values() for a, b in itertools.pairwise(sorted(spans)))
    assert packing.pack(packing.text_items(cases.empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken"))).count() == 0
    # One document of a source a bin: all rows but one are of source "s".
    sources = collections.Counter(r.bin_id for r in got if r.length < 1000 and r.doc_id != 3)
    assert max(sources.values()) == 1


def test_packing_spreads_repeated_rows(spark):
    # 500 rows of null id and one text, in groups of about 50: no group gets many more.
    same = spark.createDataFrame([(None, 10, "s", 1)] * 500 + [(k, 10, None, None) for k in range(500)], "doc_id long, length long, source string, cluster long").repartition(4)
    got = packing.pack(same, 100, 50).collect()
    sizes = collections.Counter(r.bin_id >> 32 for r in got)
    assert len(got) == 1000 and len(sizes) == 20 and max(sizes.values()) < 100
    assert max(collections.Counter(r.bin_id for r in got if r.doc_id is None).values()) == 1


def brute_top(rows, divisor, k):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q in sorted({i for i, _ in good if i % divisor == 0}):
        x = min(np.array(v, float).tolist() for i, v in rows if i == q and usable(v))
        x = [int(np.floor(256 * y)) for y in x]
        found = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(300)]
    rows += [(k, rows[k - 300][1]) for k in range(300, 330)]
    rows += [(1000, None), (1001, []), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, [1.0, 2.0]), (1010, [3.0, -1.0]), (None, [1.0] * 16), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df, 10).collect()) == brute_top(rows, 10, 5)
    assert topk.top_k(df.limit(0), 10).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[2:] for r in topk.top_k(few, 50).orderBy("rank").collect()] == [(1, 65536), (2, -65536)]


def test_top_k_of_large_numbers():
    q = np.array([[2.0**40, -(2.0**40)], [1e200, 1.0]])
    c = np.array([[2.0**20, 3.0], [2.0**40, 2.0**40], [-1e200, 1.0]])
    i, j, score = topk.block_top(np.array([0, 1]), q, np.array([5, 6, 7]), c, 3)
    exact = {(a, b): min(2**63 - 1, max(-(2**63), sum(int(x) * int(y) for x, y in zip(q[a], c[b])))) for a in range(2) for b in range(3)}
    assert {(a, b): s for a, b, s in zip(i.tolist(), j.tolist(), score.tolist())} == exact


@pytest.mark.parametrize("seed", range(4))
def test_long_lists_lose_no_candidates(monkeypatch, seed):
    # Several lists of a bucket are longer than CHAIN_FROM; every pair that passes the filters must be in one component.
    monkeypatch.setattr(setjoin, "CHAIN_FROM", 5)
    rng = np.random.default_rng(seed)
    spec = setjoin.Similarity(num=60, den=100, parity=False)
    lists = [np.full(k, 10) for k in (7, 7, 7, 8)] if seed < 2 else [rng.integers(5, 40, size=rng.integers(6, 60)) for _ in range(6)]
    sizes = np.concatenate(lists).astype(np.uint32)
    token = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.uint32)
    place = np.where(rng.random(len(sizes)) < 0.3, 0, sizes - 1).astype(np.uint32)
    left = sizes.astype(int) - place
    sig = np.arange(1, len(sizes) + 1, dtype=np.uint64)
    root = {int(x): int(x) for x in sig}
    for r, m in zip(*setjoin.forest([setjoin._join(sig, sizes, token, place, np.zeros(2 * len(sig), np.uint64))], spec)[:2]):
        root[int(m)] = int(r)
    for a, b in itertools.combinations(range(len(sizes)), 2):
        least, most = sorted((int(sizes[a]), int(sizes[b])))
        if token[a] == token[b] and 100 * least >= 60 * most and spec.enough(min(left[a], left[b]), least + most):
            assert root[int(sig[a])] == root[int(sig[b])]


def test_long_lists_tie_no_unlike_sets():
    # A list of thousands of unlike sets, and one copy of the first: only these two are united.
    rng = np.random.default_rng(3)
    k = 5000
    sketch = rng.integers(0, 1 << 63, size=(k, 2)).astype(np.uint64) << np.uint64(1)
    sketch[-1] = sketch[0] ^ np.uint64(8)
    ones, zeros = np.full(k, 60, np.uint32), np.zeros(k, np.uint32)
    root, member = setjoin.forest([setjoin._join(np.arange(1, k + 1, dtype=np.uint64), ones, zeros, zeros, sketch.reshape(-1))], line_dedup.LINES)[:2]
    assert (root.tolist(), member.tolist()) == ([1], [k])


def test_hot_words_tie_no_unlike_lines(spark):
    # Every word of the lines is hot; only the two lines that are alike become candidates.
    rng = random.Random(5)
    lines = [" ".join(rng.sample([f"w{k}" for k in range(60)], 20)) for _ in range(200)]
    lines[150] = lines[20].rsplit(" ", 1)[0] + " other"
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(lines)], "id long, tie long, text string")
    codes = spark.sparkContext.broadcast(np.full(1 << line_dedup.LINES.bits, 255, np.uint8))
    keys = setjoin._publish(docs, line_dedup.line_units, line_dedup.LINES, codes, 4)
    edges = setjoin._candidates(keys, line_dedup.LINES, 4).collect()
    units = spark.createDataFrame([(k, 0, lines[k]) for k in (20, 150)], "id long, tie long, text string")
    alike = {r.sig for r in setjoin.profile(units, line_dedup.line_units, line_dedup.LINES).where("slice is null").collect()}
    assert edges and {x for r in edges for x in (r.u, r.v)} <= alike


@pytest.mark.parametrize("k", [60, 600])
def test_long_lines_that_short_sketches_cannot_judge_are_not_united(k):
    # Unlike sets of 300 tokens differ in about as few bits of 128 as linked ones may: in short lists and in long ones none are united unseen.
    rng = np.random.default_rng(4)
    sizes, zeros = np.full(k, 300, np.uint32), np.zeros(k, np.uint32)
    sketch = rng.integers(0, 1 << 64, size=2 * k, dtype=np.uint64)
    root, _, one, _, together = setjoin.forest([setjoin._join(np.arange(1, k + 1, dtype=np.uint64), sizes, zeros, zeros, sketch)], line_dedup.LINES)
    assert not len(root) and len(one) <= setjoin.WEAK_TIMES * k and (k < 600 or len(together[0]) == k)


@pytest.mark.parametrize("chain, many", [(0, 0), (6, 2), (128, 2), (128, 1000)])
def test_long_lines_equal_brute_force(spark, monkeypatch, chain, many):
    monkeypatch.setattr(setjoin, "CHAIN_FROM", chain)
    monkeypatch.setattr(setjoin, "WEAK_TIMES", many)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(900)]
    lines = []
    for n in (20, 100, 127, 128, 145, 160, 200, 260, 300, 450):
        text = rng.sample(words, n)
        for more in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.24, 0.25, 0.3):
            lines.append(" ".join(text + [f"x{rng.randrange(40)}y{k}" for k in range(int(more * n))]))
            lines.append(" ".join(rng.choice(words) if rng.random() < more / 2 else w for w in text))
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(len(lines) // 3)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(spark, rows)


def near_copies(rng, n, words, much):
    """n copies of a text with a share of words replaced, and as many texts that share a third with it."""
    text = [rng.choice(words) for _ in range(400)]
    copy = lambda t, share: " ".join(rng.choice(words) if rng.random() < share else w for w in t)
    return [copy(text, much) for _ in range(n)] + [copy(text[:150], 0.02) + " " + " ".join(rng.choice(words) for _ in range(rng.randint(200, 330))) for _ in range(n)]


@pytest.mark.parametrize("many", [0, 2])
def test_lists_judged_whole_equal_brute_force(spark, monkeypatch, many):
    # 0: every list is judged by whole sketches, whatever the sizes of its sets.
    monkeypatch.setattr(setjoin, "WEAK_TIMES", many)
    if not many:
        monkeypatch.setattr(setjoin, "CHAIN_FROM", 0)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    texts = near_copies(rng, 40, words, 0.12) + [t for _, t in corpus(3, 80)]
    for n in (60, 120, 200, 250, 256, 300, 500, 1000):
        text = [rng.choice(words) for _ in range(n)]
        texts += [" ".join(text + [rng.choice(words) for _ in range(int(more * n))]) for more in (0, 0.1, 0.3, 0.6, 0.65, 0.7)]
    rows = list(enumerate(texts))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute_near(rows)


def test_near_copies_send_few_rows(spark):
    # Of k near copies that short sketches can't judge, not all pairs leave the tasks.
    rng = random.Random(8)
    texts = near_copies(rng, 120, [f"w{k}" for k in range(3000)], 0.12)
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id long, tie long, text string").coalesce(1)
    cold = spark.sparkContext.broadcast(np.zeros(1 << near_dup.NEAR.bits, bool))
    keys = setjoin._keys(setjoin._count_keys(setjoin._blocks(docs, near_dup.shingle_units, near_dup.NEAR, cold, 4), 4), 4)
    assert setjoin._candidates(keys, near_dup.NEAR, 4).count() < 4 * 10 * len(texts)


def test_published_keys_say_once_what_is_known_of_a_set():
    rng = np.random.default_rng(6)
    k, owner = 300, np.sort(rng.integers(0, 300, size=3000))
    sig, sketch, token = (rng.integers(0, 1 << 64, size=s, dtype=np.uint64) for s in (k, (k, 2), 3000))
    n, cells, place = rng.integers(1, 1 << 17, size=k), rng.integers(1, 1 << 32, size=k), rng.integers(0, 1 << 16, size=3000)
    token &= np.uint64(0xFFFFFFFF)
    blob = setjoin.pack_keys(sig, n, cells, sketch, owner, token, place)
    for got, want in zip(setjoin.unpack_keys(blob), (sig[owner], n[owner], token, place, sketch[owner].reshape(-1), cells[owner])):
        assert got.astype(np.uint64).tolist() == want.astype(np.uint64).tolist()
    assert len(blob) < 12 * len(owner)
    assert all(len(x) == 0 for x in setjoin.unpack_keys(setjoin.pack_keys(sig, n, cells, sketch, owner[:0], token[:0], place[:0])))


def test_sorted_numbers_are_packed_whole():
    rng = np.random.default_rng(9)
    for k, span in ((0, 10), (1, 1), (1, 1 << 40), (5, 3), (1000, 10), (20000, 1 << 31)):
        values = np.sort(rng.integers(0, span, size=k, dtype=np.uint64))
        blob = setjoin.pack_sorted(values, span)
        assert setjoin.unpack_sorted(blob).tolist() == values.tolist()
    assert len(blob) < 2.5 * k


@pytest.mark.parametrize("counted", [True, False])
def test_keys_are_counted_by_fingerprints(spark, tmp_path, counted):
    # Each set sends its keys once, in few bytes; keys of no other set aren't published. A load without counts publishes all.
    rng = random.Random(10)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(100)]
    texts += [" ".join(w if rng.random() < 0.95 else "x" for w in texts[0].split()), texts[1]]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id long, tie long, text string").repartition(3).localCheckpoint()
    units = near_dup.shingle_units
    known = setjoin.profile(docs, units, near_dup.NEAR).where("slice is null").select("id", "tie", "sub", "n", "sig")
    firsts = spark.sparkContext.broadcast(setjoin._first_rows(known, 4))
    cold = spark.sparkContext.broadcast(np.zeros(1 << near_dup.NEAR.bits, bool))
    folder = f"file://{tmp_path}/codes"
    sent = setjoin._sent(docs, units, near_dup.NEAR, cold, firsts, 24, 4)
    blobs = [r.blob for r in sent.collect()]
    keys = sum(len(setjoin.unpack_sorted(b)) for b in blobs)
    assert keys > 101 * 200 and sum(map(len, blobs)) < 2.5 * keys
    if counted:
        setjoin._write_codes(setjoin._count_prints(sent, 4), folder, 4)
    out = setjoin._publish_blocks(docs, units, near_dup.NEAR, cold, firsts, 24, folder, 4)
    published = sum(len(setjoin.unpack_keys(r.blob)[0]) for r in out.collect())
    assert published < keys / 10 if counted else published == keys
    u, v = (next(r.sig for r in known.where(f"id = {k}").collect()) for k in (0, 100))
    assert {u, v} in [{r.u, r.v} for r in setjoin._candidates(out, near_dup.NEAR, 4).collect()]


def test_top_k_broadcasts_no_queries(spark):
    # Every lane has a copy of all queries: these must not go through the driver.
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(200)]
    best = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10)
    assert len(best.collect()) == 100
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan


def test_packed_rows():
    for data in (np.array([[-32767.0, 32767.0], [0.0, -1.0]]), np.array([[32768.0, 1.0]]), np.array([[-1e300, 5.0]]), np.zeros((0, 3))):
        assert np.array_equal(topk.unpack_rows(topk.pack_rows(data), len(data)) if len(data) else data, data)


def test_line_classes_are_gathered_once(spark):
    rows = [(k, t) for k, t in enumerate(["a b c d e\nx y", "a b c d e f\nx y", None, "", "x y\nq"])]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    # Least rows of classes are structs, which Spark gathers by sorting all lines; what is read back needs no more of it.
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in found.collect()) == [(0, rows[0][1], 0), (1, "", 2), (2, None, 0), (3, "", 0), (4, "q", 1)]


@pytest.mark.parametrize("size", [1, 3, 64])
def test_words_are_hashed_by_blocks(monkeypatch, size):
    text = " Ab\tc é  abc\nab zz".encode() * 5
    raw, offsets = np.frombuffer(text, np.uint8), np.array([0, 0, 2, 9, 40, 41, len(text)])
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for a, b in itertools.pairwise(offsets) for w in re.findall(rb"[^ \t-\r]+", text[a:b])]
    monkeypatch.setattr(textvec, "BLOCK", size)
    hashes, start, bounds = textvec.word_hashes(raw, offsets)
    known = {w: textvec.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in words}
    assert len(set(known.values())) == len(known) and hashes.tolist() == [known[w] for w in words]
    assert start.tolist() == [a + m.start() for a, b in itertools.pairwise(offsets) for m in re.finditer(rb"[^ \t-\r]+", text[a:b])]
    assert np.diff(bounds).tolist() == [len(re.findall(rb"[^ \t-\r]+", text[a:b])) for a, b in itertools.pairwise(offsets)]


def test_tokens_are_ranked_by_code_then_place():
    rng = np.random.default_rng(5)
    owner, code = np.sort(rng.integers(0, 50, 4000)), rng.integers(0, 9, 4000).astype(np.uint8)
    for far in (0, 1 << 24):
        assert setjoin.ranked_tokens(owner + far, code).tolist() == np.lexsort((code, owner)).tolist()
