"""Operator 4: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers, letter by letter, how far the text
at hand can be matched. A greedy parse cuts a document into longest matches; the
phrases it needs, times the bits that name a place in the reference, estimate the cross entropy. The
language that needs the fewest bits wins.

The automaton is completed into a table whose failing moves count a phrase and start the next one, so
a parse is one table look-up per letter; numpy moves thousands of text blocks at once. A document is
parsed in blocks of at most BLOCK letters, of equal length within the document, for every language alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .shared import hash_limit, lean, tune

#: Letters of reference text per language: the bound of the training sample.
REFERENCE = 16384
BLOCK = 256
#: Entries, of 4 bytes, of a parse table in memory.
DENSE = 1 << 23
UNKNOWN = "und"


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Moves of the suffix automaton of a sequence: symbol -> state, by state."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in symbols.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass
class SparseTable:
    """The moves of a parse table that don't fail, by ascending place; others follow from the letter."""

    keys: np.ndarray
    moves: np.ndarray
    restart: np.ndarray

    def next(self, row: np.ndarray, letter: np.ndarray) -> np.ndarray:
        place = row + letter
        at = np.minimum(np.searchsorted(self.keys, place), len(self.keys) - 1)
        return np.where(self.keys[at] == place, self.moves[at], self.restart[letter] + (row != 0))


def parse_table(symbols: np.ndarray, alphabet: int, dense: int = DENSE) -> np.ndarray | SparseTable:
    """The greedy parse as a flat table: entry = (row of the next state << 2) | phrases ended by the move.

    A failing letter ends the phrase and begins the next; a letter that the reference lacks is a phrase. A table of more
    than ``dense`` entries, as of a script of thousands of letters, is kept sparse."""
    moves = suffix_automaton(symbols)
    restart = np.ones(alphabet, np.int64)
    for c, to in moves[0].items():
        restart[c] = (to * alphabet) << 2
    if len(moves) * alphabet > dense:
        known = sorted((state * alphabet + c, (to * alphabet) << 2) for state, out in enumerate(moves) for c, to in out.items())
        keys, to = np.array(known, np.int64).reshape(-1, 2).T
        return SparseTable(np.ascontiguousarray(keys), np.ascontiguousarray(to), restart)
    table = np.empty((len(moves), alphabet), np.int32)
    table[0] = restart
    table[1:] = restart + 1
    for state, out in enumerate(moves):
        for c, to in out.items():
            table[state, c] = (to * alphabet) << 2
    return table.reshape(-1)


@dataclass
class LanguageModel:
    """languages in order, the symbol of every code point (0: no letter), a parse table and bits a phrase each, and in
    ``own`` what number each symbol has in a language's table: a letter that its reference lacks has the last."""

    languages: list[str]
    symbol: np.ndarray
    tables: list[np.ndarray | SparseTable]
    bits: np.ndarray
    own: list[np.ndarray]

    def normalise(self, text: str) -> np.ndarray:
        """Symbols of one text: letters, and one 0 for each run of anything else."""
        return self.symbols(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), np.array([0, len(text)]))[0]

    def symbols(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, bounds, letters per row) of many texts laid end to end."""
        s = self.symbol[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        begins = bounds[:-1][np.diff(bounds) > 0]
        keep[begins] = s[begins] != 0
        total = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(s != 0)])
        return s[keep], total[bounds], np.diff(letters[bounds])

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of every row (first axis) in every language."""
        size = np.diff(bounds)
        blocks = -(-size // BLOCK)
        rows = np.repeat(np.arange(len(size)), blocks)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = bounds[:-1][rows] + k * size[rows] // np.maximum(blocks[rows], 1)
        end = bounds[:-1][rows] + (k + 1) * size[rows] // np.maximum(blocks[rows], 1)
        length = end - begin
        order = np.argsort(-length, kind="stable")
        rows, begin, length = rows[order], begin[order], length[order]
        out = np.zeros((len(size), len(self.languages)))
        if not len(rows):
            return out
        width = int(length[0])
        alive = np.searchsorted(-length, -np.arange(1, width + 1), side="right")
        letters = [symbols[begin[: alive[t]] + t].astype(np.int32) for t in range(width)]
        for j, (table, own) in enumerate(zip(self.tables, self.own)):
            sparse = isinstance(table, SparseTable)
            state = np.zeros(len(rows), np.int64 if sparse else table.dtype)
            count = np.zeros(len(rows), np.int32)
            for t in range(width):
                n = alive[t]
                move = table.next(state[:n] >> 2, own[letters[t]]) if sparse else table[(state[:n] >> 2) + own[letters[t]]]
                count[:n] += move & 3
                state[:n] = move
            count += (state >> 2) != 0
            out[:, j] = np.bincount(rows, weights=count, minlength=len(size))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, share of probability in 0..1) per text; UNKNOWN and 0 without a letter or a language."""
        clean = ["" if t is None else t for t in texts]
        points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in clean])]).astype(np.int64)
        symbols, at, letters = self.symbols(points, bounds)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost = self.phrases(symbols, at) * self.bits[None, :]
        best = cost.argmin(1)
        odds = np.exp2(-np.minimum(cost - cost.min(1)[:, None], 1000.0))
        known = letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, 1 / odds.sum(1), 0.0)


def _letters() -> np.ndarray:
    """For every code point the lower-case letter it stands for, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def learn(samples: dict[str, str], reference: int = REFERENCE) -> LanguageModel:
    """A model from one reference text per language, cut at ``reference`` code points. Every letter of a reference
    text has a symbol of its own; all others share the last."""
    fold = _letters()
    texts = {k: np.frombuffer(v[:reference].encode("utf-32-le", "surrogatepass"), "<u4") for k, v in sorted(samples.items())}
    seen = np.unique(np.concatenate([np.zeros(1, np.uint32), *(fold[points] for points in texts.values())]))
    number = np.zeros(0x110000, np.uint16 if len(seen) < 65535 else np.uint32)
    number[seen] = np.arange(len(seen))
    symbol = number[fold]
    symbol[(fold > 0) & (symbol == 0)] = len(seen)
    model = LanguageModel([], symbol, [], np.zeros(0), [])
    bits = []
    for name, points in texts.items():
        symbols, _, letters = model.symbols(points, np.array([0, len(points)]))
        if letters.sum():
            used = np.union1d(symbols, [0])
            own = np.full(len(seen) + 1, len(used), np.int32)
            own[used] = np.arange(len(used))
            model.languages.append(name)
            model.tables.append(parse_table(own[symbols], len(used) + 1))
            model.own.append(own)
            bits.append(np.log2(len(symbols) + 1))
    model.bits = np.array(bits)
    return model


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def reference_texts(docs: DataFrame, reference: int = REFERENCE) -> dict[str, str]:
    """Per language the texts of the labelled rows that come first in hash order, until ``reference`` code points are
    there. Rows whose remainder is 2 are held out. What reaches the driver is bounded by ``reference`` a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 2)).select(
        "lang", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(7)).alias("turn")
    )
    # A bounded number of rows a language: those under a hash threshold set from its count. Rows that repeat id and text count once.
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("turn").alias("rows"), F.avg(F.length("text")).alias("chars")).collect()
    if not counts:
        return {}
    most = {}
    for row in counts:
        most[row["lang"]] = hash_limit(4 * reference / max(1, row["chars"] * row["rows"]) + 32 / max(1, row["rows"]))
    top = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    drawn = labelled.where(F.col("turn") <= top[F.col("lang")]).select("lang", "turn", F.substring("text", 1, reference).alias("text")).dropDuplicates(["lang", "turn"])
    order = W.partitionBy("lang").orderBy("turn", "text")
    wanted = (
        drawn.withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("before") < reference)
        .orderBy("lang", "turn", "text")
        .select("lang", "text")
        .collect()
    )
    out: dict[str, list[str]] = {}
    for lang, text in wanted:
        out.setdefault(lang, []).append(text)
    return {k: "\n".join(v) for k, v in out.items()}


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred string and score double (0 to 1) set; neither is affected by other columns than text.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no language was learned.
    Columns of the input named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over documents: doc_id, held_out, lang_pred, score; see identify."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(reference_texts(docs))
    return identify(docs.select("doc_id", "text", (remainder() == 2).alias("held_out")), model).drop("text")
