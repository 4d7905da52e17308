"""Operator 5: personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers. The field labels the tokens of a document
that could belong to one (those with a digit or an at sign; all others are O). Neighbouring tokens share
a chain potential. Equal or similar tokens anywhere in the document share a skip potential,
so what is certain in one place (a rule's match is observed) decides the same thing written barely in
another, however far: an occurrence is linked to the first that a rule matched, or else to the one before it. So is
a number written as several tokens, known by the digits of neighbouring tokens together. Loopy sum-product message
passing until it converges gives beliefs; tokens of belief above CERTAIN add spans. Edges stay linear in tokens.

The field is trained piecewise on the rules' own labels over a bounded sample of rows: node
weights by multinomial logistic regression, edge potentials by smoothed co-occurrence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import hash_limit, lean, persist, tune

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_CANDIDATE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_NUMBER = re.compile(r"[+]?[0-9][0-9().-]*")
_EDGE = "()[]{}<>\"'.,;:!?*&%$#|"

#: Token rows in the training sample, rows of the table drawn for it, and the belief that adds a span.
SAMPLE = 20000
DRAWN = 40000
CERTAIN = 0.9
#: Messages that change by less have converged; a field whose loops never settle ends after ROUNDS.
SETTLED = 1e-5
ROUNDS = 1000
#: Digits of a number written as several tokens: those of a local number at least, of a card at most.
JOINED = (7, 19)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From each at sign outwards, so that long runs cost no more than their length.
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules, by kind as listed and then start."""
    out: list[tuple[str, int, int]] = []
    if not _CANDIDATE.search(text):
        return out
    out += [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


@dataclass
class Graph:
    """Candidate tokens of one or more documents with chain and skip edges between them. links: what messages pass along
    in place of skip, which training counts; if None, skip."""

    spans: list[tuple[int, int]]
    features: list[tuple[str, ...]]
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    links: np.ndarray | None = None


def _shape(token: str) -> str:
    out = []
    for c in token:
        k = "9" if c.isdigit() else "a" if c.isalpha() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


def graph(text: str, base: list[tuple[str, int, int]]) -> Graph:
    """The field of one text. observed: label that a rule's span gives to a token, or -1."""
    spans, features, numbers = [], [], []
    last = None
    keys: dict[str, int] = {}
    alike: dict[str, list[int]] = {}
    chain, skip = [], []
    for m in _TOKEN.finditer(text):
        if not _CANDIDATE.search(m[0]):
            last = None
            continue
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        core = text[a:b]
        digits = _DIGITS.sub("", core)
        k = len(spans)
        spans.append((a, b))
        numbers.append(digits if _NUMBER.fullmatch(core) else "")
        d = len(digits)
        features.append((
            "s:" + _shape(core), f"d:{min(d, 20)}", f"l:{min(len(core), 30) // 3}", f"@:{'@' in core}", f".:{min(core.count('.'), 4)}",
            f"p:{'+' in core}", f"n:{16 <= d <= 19 and luhn(digits)}", f"b:{last is not None}",
        ))
        if last is not None:
            chain.append((last, k))
        last = k
        if len(core) >= 6:
            for key in {"t" + core.lower(), *(["d" + digits] if d >= 6 else [])}:
                if key in keys:
                    skip.append((keys[key], k))
                keys[key] = k
                alike.setdefault(key, []).append(k)
    observed = np.full(len(spans), -1)
    starts = np.array([s for s, _ in spans])
    for kind, a, b in base:
        at = int(np.searchsorted(starts, a, side="right")) - 1 if len(spans) else 0
        for k in range(max(at, 0), len(spans)):
            s, e = spans[k]
            if s >= b:
                break
            if e > a:
                observed[k] = LABELS.index(kind)
    far = _far(alike, numbers, observed, {b: a for a, b in chain})
    # What is linked to a rule's match takes no word from others that aren't matched themselves.
    held = {k for edge in far for k in edge if observed[k] < 0}
    links = far | {(a, b) for a, b in skip if not (a in held and b in held)}
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(spans, features, observed, pairs(chain), pairs(sorted(set(skip))), pairs(sorted(links)))


def _far(alike: dict[str, list[int]], numbers: list[str], observed: np.ndarray, before: dict[int, int]) -> set[tuple[int, int]]:
    """Edges (lesser, greater) from every token that no rule matched to the first alike that one did, for tokens of one key
    and for numbers of several tokens, which are paired by the place of their digits."""
    found: set[tuple[int, int]] = set()
    for places in alike.values():
        anchor = next((k for k in places if observed[k] >= 0), None)
        if anchor is not None:
            found.update((min(anchor, k), max(anchor, k)) for k in places if observed[k] < 0)
    known: dict[str, list[int]] = {}
    bare: list[tuple[str, list[int]]] = []
    for k in range(len(numbers)):
        digits, tokens, at = "", [], k
        while at is not None and numbers[at]:
            digits, tokens = numbers[at] + digits, [at, *tokens]
            if len(digits) > JOINED[1]:
                break
            if len(digits) >= JOINED[0]:
                if all(observed[t] >= 0 for t in tokens):
                    known.setdefault(digits, tokens)
                elif all(observed[t] < 0 for t in tokens):
                    bare.append((digits, tokens))
            at = before.get(at)
    for digits, tokens in bare:
        if digits in known:
            owner = [t for t in known[digits] for _ in numbers[t]]
            place = 0
            for t in tokens:
                found.update((min(t, o), max(t, o)) for o in owner[place : place + 1])
                place += len(numbers[t])
    return found


def merge(graphs: list[Graph]) -> Graph:
    """Several documents' fields as one of unconnected parts."""
    shift = np.cumsum([0, *(len(g.spans) for g in graphs)])
    join = lambda f: np.concatenate([np.zeros((0, 2), np.int64), *(f(g) + s for g, s in zip(graphs, shift))])
    return Graph(
        [s for g in graphs for s in g.spans], [f for g in graphs for f in g.features],
        np.concatenate([np.zeros(0, int), *(g.observed for g in graphs)]), join(lambda g: g.chain), join(lambda g: g.skip), join(lambda g: g.skip if g.links is None else g.links),
    )


@dataclass
class Field:
    """Trained potentials, all in logarithms."""

    vocabulary: dict[str, int]
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, features: list[tuple[str, ...]]) -> np.ndarray:
        nothing = len(self.node) - 1
        at = np.array([[self.vocabulary.get(f, nothing) for f in row] for row in features], np.int64).reshape(len(features), -1)
        return self.node[at].sum(1)

    def beliefs(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Marginal label probabilities of every token once messages have converged, or after ``rounds`` of passing them."""
        theta = self.unary(g.features)
        seen = g.observed >= 0
        # So low that no number of messages outweighs a rule.
        theta[seen] = -1e9
        theta[seen, g.observed[seen]] = 0.0
        links = g.skip if g.links is None else g.links
        edges = np.concatenate([g.chain, links])
        pair = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(links), 0)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds if len(edges) else 0):
            total = theta.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + pair
            top = out.max(1)
            new = np.log(np.exp(out - top[:, None, :]).sum(1)) + top
            new -= new.max(1)[:, None]
            settled = np.abs(new - message).max() < SETTLED
            message = 0.5 * message + 0.5 * new
            if settled:
                break
        total = theta.copy()
        np.add.at(total, target, message)
        total = np.exp(total - total.max(1, initial=-np.inf, keepdims=True)) if len(total) else total
        return total / total.sum(1, keepdims=True)


def train(rows: list[tuple[tuple[str, ...], int]], chains: np.ndarray, skips: np.ndarray, steps: int = 300) -> Field:
    """Piecewise training. rows: features and label of sampled tokens; chains, skips: label-pair counts."""
    names = sorted({f for row, _ in rows for f in row})
    vocabulary = {f: k for k, f in enumerate(names)}
    node = np.zeros((len(names) + 1, len(LABELS)))
    if rows:
        x = np.array([[vocabulary[f] for f in row] for row, _ in rows])
        y = np.eye(len(LABELS))[[label for _, label in rows]]
        for _ in range(steps):
            score = node[x].sum(1)
            p = np.exp(score - score.max(1)[:, None])
            gradient = y - p / p.sum(1)[:, None]
            change = np.zeros_like(node)
            for column in x.T:
                np.add.at(change, column, gradient)
            counts = np.bincount(x.reshape(-1), minlength=len(node))[:, None]
            node += 0.5 * (change / np.maximum(counts, 1) - 1e-4 * node)
        node[-1] = 0

    def potential(counts: np.ndarray, smooth: float) -> np.ndarray:
        joint = counts + counts.T + smooth * (1 + 4 * np.eye(len(LABELS)))
        joint /= joint.sum()
        side = joint.sum(1)
        return np.clip(np.log(joint / (side[:, None] * side[None, :])), -6, 6)

    return Field(vocabulary, node, potential(chains.astype(float), 0.5), potential(skips.astype(float), 0.5))


def learn_field(docs: DataFrame, sample: int = SAMPLE, drawn: int = DRAWN) -> Field:
    """Train on at most ``sample`` tokens of rows drawn by hash, about ``drawn`` of them: only tokens' features
    and labels, and counts of label pairs, reach the driver."""
    total = docs.count()
    share = hash_limit(drawn / max(1, total))
    turn = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(5))
    # Rows that repeat id and text count once.
    rows = docs.where(F.col("text").isNotNull() & (turn <= share) & F.col("text").rlike("[0-9@]")).groupBy(turn.alias("row")).agg(F.first("text").alias("text"))

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros((2, len(LABELS), len(LABELS)), np.int64)
        for frame in frames:
            out = []
            for row, text in zip(frame["row"], frame["text"]):
                g = graph(text, base_spans(text))
                label = np.maximum(g.observed, 0)
                for k, edges in enumerate((g.chain, g.skip)):
                    np.add.at(pairs[k], (label[edges[:, 0]], label[edges[:, 1]]), 1)
                for k, f in enumerate(g.features):
                    turn = hashlib.blake2b(f"{row}:{k}".encode(), digest_size=6).digest()
                    out.append((int.from_bytes(turn, "big"), list(f), int(label[k])))
            yield pd.DataFrame(out, columns=["turn", "features", "label"])
        yield pd.DataFrame({"turn": [-1], "features": [[str(v) for v in pairs.reshape(-1)]], "label": [0]})

    found = persist(rows.mapInPandas(lean(tokens), "turn long, features array<string>, label int"), "tokens")
    counts = found.where("turn = -1").select(F.posexplode("features").alias("k", "n")).groupBy("k").agg(F.sum(F.col("n").cast("long")).alias("n")).collect()
    pairs = np.zeros(2 * len(LABELS) ** 2)
    for k, n in counts:
        pairs[k] = n
    chosen = found.where("turn >= 0").orderBy("turn", "features").limit(sample).collect()
    chains, skips = pairs.reshape(2, len(LABELS), len(LABELS))
    return train([(tuple(r["features"]), r["label"]) for r in chosen], chains, skips)


def annotate(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(rule spans, all spans) of every text, both by kind as listed and then start."""
    found = [base_spans(t) for t in texts]
    busy = [i for i, t in enumerate(texts) if _CANDIDATE.search(t)]
    graphs = [graph(texts[i], found[i]) for i in busy]
    extra: dict[int, list] = {}
    if graphs:
        whole = merge(graphs)
        belief = field.beliefs(whole)
        label, sure = belief.argmax(1), belief.max(1) >= CERTAIN
        at = 0
        for i, g in zip(busy, graphs):
            open_, joins = None, {(int(b)): int(a) for a, b in g.chain}
            for k, (a, b) in enumerate(g.spans):
                mark = int(label[at + k]) if sure[at + k] and g.observed[k] < 0 and b > a else 0
                # Neighbours of one label are one span, but card numbers that are whole stand alone.
                whole_card = mark == LABELS.index("card") and b - a >= 16
                if mark and open_ and open_[0] == mark and joins.get(k) == open_[3] and not whole_card:
                    open_[2], open_[3] = b, k
                else:
                    if open_:
                        extra.setdefault(i, []).append((LABELS[open_[0]], open_[1], open_[2]))
                    open_ = [mark, a, b, k] if mark else None
            if open_:
                extra.setdefault(i, []).append((LABELS[open_[0]], open_[1], open_[2]))
            at += len(g.spans)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return [(base, sorted(base + extra[i], key=order) if i in extra else base) for i, base in enumerate(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...); see RESULT. Offsets are code points, ends exclusive.

    A null or empty text has no spans and the SHA-256 of the empty string. Repeated rows yield
    repeated results. Further columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = annotate([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            shas = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([joined(spans) for _, spans in found], pa.string())
            added = pa.array([len(spans) - len(base) for base, spans in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, shas, every, added], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), RESULT)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by <KIND>; spans that meet are one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and n_chars set to the new length; a null text stays null.

    Columns keep their order and types; rows are neither lost nor added.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(field)
    names = docs.columns
    where = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            found = annotate([t or "" for t in texts], shared.value)
            new = [t if t is None else redact_text(t, spans) for t, (_, spans) in zip(texts, found)]
            columns = list(batch.columns)
            columns[where] = pa.array(new, pa.string())
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in new], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(lean(run), docs.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over documents; see find_personal_data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal_data(docs, learn_field(docs))
