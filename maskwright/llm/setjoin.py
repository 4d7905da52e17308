"""Exact self-join of token sets by Jaccard similarity, for sets of any size and any skew.

Both the line and the document deduplicators run on this engine. It goes through the corpus in
five distributed steps:

1. profile   every unit (document or line) becomes a set of 64-bit token hashes; a fixed table
             of 2 ** bits counters gathers how frequent the keys are.
2. count     (parity sketches only) fingerprints of the keys go to buckets as ascending numbers, in about two bytes each; a bucket
             counts how often each occurs and returns a code a key. Hot keys are left out: they rank last.
3. publish   per set the rarest keys that the threshold makes necessary go out, with their places; with parity sketches
             only those that occur more than once, for which the texts are read again.
4. unite     per bucket, sets that share a key and pass the length, positional and sketch filters are
             united; only a spanning forest leaves the task, never all pairs. Pairs that a short
             sketch doesn't show to be alike go out singly, and stay if the Hamming distance of
             their whole sketches allows a link; of a list with many such pairs the sets go out instead, and meet
             with their whole sketches in one task. A hot block is a vertex of the candidate graph, so its list is never
             gathered; a hot token goes out in pairs with others, as such a vertex would tie unlike sets together.
5. verify    the sets of one candidate component meet in tasks of bounded size, where Hamming distances of bit
             sketches rule sets out (parity sketches only) and exact intersection counts settle the rest.

Keys are either the tokens themselves (prefix filter) or the blocks of parity sketches, see ``parity_blocks``.

Equal sets form one class, known by a 64-bit signature, so copies are never compared. Tasks
are bounded by rows and bytes whatever a component's size: a large component is cut into sub-blocks
that meet pairwise.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import hashtable
from .components import connected_components, unite
from .shared import fresh_path, lean, persist, reducers, shared_dir, tune, whole_groups
from .textvec import mix64

_U = np.uint64
#: A unit extractor turns one Arrow batch into (ids, ties, subs, hashes, bounds) chunks.
Units = Callable[[pa.RecordBatch], Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]]

FILTER_BITS = 24
BLOCK_SETS = 1536
BLOCK_TOKENS = 1 << 20
FLUSH = 1_000_000
#: Bits that a fingerprint of a key has beyond those that number all keys: of keys that occur once, one in 2 ** SPARE_BITS at most is taken
#: for one that recurs.
SPARE_BITS = 5
#: A key is hot if its cell of the count table exceeds both.
HOT_FLOOR = 1 << 16
HOT_TIMES = 64
PAIRS_AT_ONCE = 500_000
#: Bits of the short sketches that travel with keys.
SKETCH_BITS = 128
#: A list in which some set has more possible partners is compared by products of sketches, of whole ones where short ones can't judge; with
#: parity sketches, one of 8 times as many. So is a list with more pairs a set, by WEAK_TIMES, that only whole sketches can judge.
CHAIN_FROM = 128
WEAK_TIMES = 2


@dataclass(frozen=True)
class Similarity:
    """Link when den * |A & B| >= num * |A | B|; units of fewer than least tokens link with nothing.

    bits: of the table of key counts. parity: True joins by blocks of parity sketches, whose keys mostly occur once and
    are counted before publishing; False joins by tokens, ranked by the table, for vocabularies not much larger than it.
    """

    num: int
    den: int
    least: int = 1
    bits: int = 22
    parity: bool = True

    def alone(self, n: np.ndarray) -> np.ndarray:
        """Sets so small that only an equal one is similar."""
        return (self.shortest(n) == n) & (n * self.den // self.num == n)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Tokens that must be published: any partner shares one of the first n - ceil(t n) + 1."""
        return np.where((n >= self.least) & ~self.alone(n), n - self.shortest(n) + 1, 0)

    def shortest(self, n: np.ndarray) -> np.ndarray:
        """Size of the smallest partner."""
        return -(-self.num * n // self.den)

    def differ(self, both: np.ndarray) -> np.ndarray:
        """Most tokens in which two linked sets of ``both`` tokens together differ."""
        return both * (self.den - self.num) // (self.den + self.num)

    def doubtful(self) -> int:
        """Least number of tokens of two sets together for which sketches of SKETCH_BITS may fail to tell a link from chance."""
        both = np.arange(64 * SKETCH_BITS * (self.den + self.num) // max(1, self.den - self.num))
        return int(np.argmax(~likely(self.differ(both), both)))

    def judged_whole(self) -> int:
        """Size from which sets may need their whole sketches."""
        return 0 if self.parity else self.doubtful() * self.num // (self.den + self.num)

    def enough(self, overlap: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Does the overlap suffice for two sets of ``both`` tokens together?"""
        return overlap * (self.den + self.num) >= self.num * both


def likely(apart: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Do the short sketches of two sets of ``both`` tokens together, ``apart`` bits from each other, show that they are alike? Sets
    that have nothing in common differ in about twice as many bits, so that it is no chance."""
    return 4 * apart <= SKETCH_BITS * (1 - np.exp(-2 * both / SKETCH_BITS))


_LOW = _U((1 << 44) - 1)


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the distinct hashes in ascending order, and the new bounds. 44 bits of a hash are kept; the low 20 of
    the result are made of them."""
    counts = np.diff(bounds)
    rows = len(counts)
    if len(hashes) == 0:
        return hashes, np.zeros(rows + 1, np.int64)
    row = np.repeat(np.arange(rows, dtype=np.uint64), counts)
    if rows <= 1 << 20:
        row <<= _U(44)
        row |= hashes >> _U(20)
        row.sort()
        fresh = np.concatenate([[True], row[1:] != row[:-1]])
        kept = row[fresh] & _LOW
    else:
        high = hashes >> _U(20)
        order = np.lexsort((high, row))
        row, high = row[order], high[order]
        fresh = np.concatenate([[True], (high[1:] != high[:-1]) | (row[1:] != row[:-1])])
        kept = high[fresh]
    sizes = np.zeros(rows, np.int64)
    sizes[counts > 0] = np.add.reduceat(fresh.astype(np.int64), bounds[:-1][counts > 0])
    return kept << _U(20) | mix64(kept) & _U(0xFFFFF), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order-independent 64-bit signatures of the sets; 0 for an empty one."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        at = bounds[:-1][full]
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix64(hashes + _U(0x1F3D5B79)), at)
            odd = np.bitwise_xor.reduceat(hashes, at)
            out[full] = mix64(total ^ mix64(odd + sizes[full].astype(np.uint64)))
    return out


def bands(n: np.ndarray) -> np.ndarray:
    """Size band of every set: 4 ** band <= n < 4 ** (band + 1)."""
    return (np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1) // 2


def block_bits(band: np.ndarray) -> np.ndarray:
    """log2 of the number of a sketch's blocks by size band; 44, that is, a block for each token, in the lowest bands."""
    return np.where(band < 3, 44, 2 * band + 3)


def full_blocks(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Blocks that n tokens fill at the least, of 2 ** bits: nine deviations below the mean."""
    with np.errstate(divide="ignore"):
        g = np.exp2(bits.astype(np.float64))
        empty = np.exp(n * np.log1p(-1 / g))
        spread = np.sqrt(np.maximum(0, g * (empty - (1 + n / g) * empty * empty)))
    return np.where(bits == 44, n, np.floor(g * (1 - empty) - 9 * spread)).astype(np.int64)


@dataclass
class Blocks:
    """Sets seen in the sketches of one size band each. row: of the set. own: Is it the set's own band, or the next? need: blocks to
    publish. keys: of the filled blocks, delimited by ends."""

    row: np.ndarray
    own: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    ends: np.ndarray


def parity_blocks(spec: Similarity, hashes: np.ndarray, bounds: np.ndarray) -> Blocks:
    """The filled blocks of the parity sketches of distinct_sets(...).

    In size band r a set has a sketch of 2 ** block_bits(r) blocks of 64 bits. A token belongs to the block that its hash begins
    with, and XORs a random pattern into it; so the sketches of two sets differ in no more blocks than the sets do
    in tokens, and the others are equal (pigeonhole). If A and B fill a and b blocks and differ in d tokens at
    most, at least max(a, b) - d filled blocks are equal, and in any common order of keys one of these is among
    the first a - (max(a, b) - d) + 1 of A, and likewise for B. ``need`` bounds that from the set's own size: a partner
    is in the set's band or in the next one, where the smaller set is sketched once more; how many
    blocks a larger partner fills at the least is known up to nine standard deviations (full_blocks).
    """
    n = np.diff(bounds)
    rows = np.flatnonzero((n >= spec.least) & (n > 0) & ~spec.alone(n))
    band = bands(n[rows])
    most = n[rows] * spec.den // spec.num
    up = np.flatnonzero(most >= 4 ** (band + 1))
    row = np.concatenate([rows, rows[up]])
    own = np.arange(len(row)) < len(rows)
    r = np.concatenate([band, band[up] + 1])
    size, most = n[row], np.concatenate([most, most[up]])
    begin = bounds[:-1][row]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    token = hashes[at]
    bits = block_bits(r)
    block = token >> np.repeat((64 - bits).astype(np.uint64), size)
    block = np.where(np.repeat(bits == 44, size), token, block)
    fresh = np.ones(len(token), bool)
    fresh[1:] = block[1:] != block[:-1]
    fresh[np.cumsum(size) - size] = True
    first = np.flatnonzero(fresh)
    entry = np.repeat(np.arange(len(row)), size)[first]
    filled = np.bincount(entry, minlength=len(row))
    with np.errstate(over="ignore"):
        keys = np.bitwise_xor.reduceat(mix64(token), first) if len(first) else np.zeros(0, np.uint64)
        keys = mix64(keys ^ mix64(block[first] * _U(0x9E3779B97F4A7C15) + r[entry].astype(np.uint64)))
    # Blocks that are equal at the least: with a smaller partner, with a larger one of the band, with one of the next band.
    low = 4**r
    largest = np.minimum(most, np.where(own, 4 ** (r + 1) - 1, most))
    least = np.where(own, size, low)
    by_size = full_blocks(least, bits) - spec.differ(size + least)
    larger = np.maximum(by_size, filled - spec.differ(size + largest))
    equal = np.where(own, np.minimum(filled - spec.differ(2 * size), larger), larger)
    if own.any() and (full_blocks(size[own], bits[own]) > filled[own]).any():
        raise ValueError("a set fills fewer sketch blocks than nine deviations allow")
    return Blocks(row, own, np.where(size > 0, filled - np.maximum(equal, 1) + 1, 0), keys, np.concatenate([[0], np.cumsum(filled)]))


def count(table: np.ndarray, parts: list[np.ndarray]) -> None:
    """Add one to a cell of the table for each time it is named: in order, which spares the cache."""
    cells = np.sort(np.concatenate([np.zeros(0, np.uint32), *parts]))
    cuts = _runs(cells)
    table[cells[cuts[:-1]]] += np.diff(cuts).astype(table.dtype)


PROFILE = "id long, tie long, sub int, n int, sig long, sketch binary, slice int, payload binary"


def profile(docs: DataFrame, units: Units, spec: Similarity) -> DataFrame:
    """Rows of two kinds, written to the shared folder: the units (id, tie, sub, n, sig, and the whole bit sketch of sets
    that may need it) and slices of the key counts."""
    bits, whole = spec.bits, spec.judged_whole()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []
        load = 0
        names = [c.split()[0] for c in PROFILE.split(", ")]
        for batch in batches:
            for ids, ties, subs, hashes, bounds in units(batch):
                hashes, bounds = distinct_sets(hashes, bounds)
                n = np.diff(bounds)
                keys = parity_blocks(spec, hashes, bounds).keys if spec.parity else hashes if spec.least <= 1 else hashes[np.repeat(n >= spec.least, n)]
                held.append((keys >> _U(64 - bits)).astype(np.uint32))
                load += len(keys)
                if load >= FLUSH:
                    count(table, held)
                    held, load = [], 0
                k, long = len(ids), n >= whole
                sketches = np.full(k, None, object)
                sketches[long] = whole_sketches(*_take_rows(hashes, bounds, long))
                yield pa.RecordBatch.from_arrays(
                    [ids, ties, pa.array(subs, pa.int32()), pa.array(n, pa.int32()), pa.array(signatures(hashes, bounds).view(np.int64)),
                     pa.array(sketches, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names
                )
        count(table, held)
        packed = list(hashtable.pack_counts(table))
        if packed:
            k = len(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([s for s, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary())],
                names,
            )

    return persist(docs.mapInArrow(run, PROFILE), "profile")


def hot_cells(counts: np.ndarray) -> np.ndarray:
    """Cells of the count table whose tokens occur too often for their lists to meet in one task."""
    return counts > max(HOT_FLOOR, HOT_TIMES * float(counts.mean()))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))


def _rows(names: list[int], blobs: list[bytes], column: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], [column, "blob"])


def _join(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, behind their lengths."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _split(blob: bytes, kinds: str) -> list[np.ndarray]:
    lengths = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(lengths.tolist(), kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _planes(values: np.ndarray) -> np.ndarray:
    """The lowest bytes of 32-bit values, then the next ones, and so on: mostly zeros beyond the second, which take no room when compressed."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).reshape(-1)


def _whole(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def pack_keys(sig: np.ndarray, n: np.ndarray, cells: np.ndarray, sketch: np.ndarray, owner: np.ndarray, token: np.ndarray, place: np.ndarray) -> bytes:
    """Keys of parity sketches for a bucket, by ascending ``owner``, a row of the first four: what is known of a set is said once."""
    cuts = _runs(owner)
    at = owner[cuts[:-1]]
    return _join(sig[at], _planes(n[at]), _planes(cells[at]), sketch[at].reshape(-1), _planes(np.diff(cuts)), token.astype(np.uint32), _planes(place))


def unpack_keys(blob: bytes) -> tuple[np.ndarray, ...]:
    """(sig, n, token, place, sketch, cells) by key; sketch: one array, two words a key."""
    sig, n, cells, sketch, times, token, place = _split(blob, ["u8", "u1", "u1", "u8", "u1", "u4", "u1"])
    owner = np.repeat(np.arange(len(sig)), _whole(times))
    return sig[owner], _whole(n)[owner], token, _whole(place), sketch.reshape(-1, 2)[owner].reshape(-1), _whole(cells)[owner]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(20)) % _U(buckets)).astype(np.uint32)


def _fresh(sig: np.ndarray, wanted: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which wanted rows hold a signature that the task hasn't seen."""
    out = np.zeros(len(sig), bool)
    at = np.flatnonzero(wanted)
    _, first = np.unique(sig[at], return_index=True)
    at = at[first]
    new = np.fromiter((int(x) not in seen for x in sig[at].tolist()), bool, len(at))
    seen.update(sig[at[new]].tolist())
    out[at[new]] = True
    return out


def _take_rows(hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds)
    return hashes[np.repeat(rows, n)], np.concatenate([[0], np.cumsum(n[rows])])


def _blocks(docs: DataFrame, units: Units, spec: Similarity, hot, buckets: int) -> DataFrame:
    """(bucket, load, keys, owners, listing): the keys of every set's sketches by hash bucket. A load is at most 65536 sketches
    of one map task; a key is 32 bits of its hash and 16 of its sketch's place in the load, however many
    buckets there are. The load's list of sketches travels with one of its buckets. Equal sets of a map task are sent once."""
    bits = spec.bits

    def pack(parts: list[tuple[np.ndarray, ...]], task: int, loads: Iterator[int]) -> Iterator[pa.RecordBatch]:
        sigs, sizes, cells, needs, short_, keys = (np.concatenate(x) for x in zip(*parts))
        filled = (cells >> 1).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(filled)])
        for first in range(0, len(sigs), 65536):
            at = slice(first, first + 65536)
            sig, full = sigs[at], filled[at]
            hashes = keys[ends[first] : ends[first + len(sig)]]
            owner = np.repeat(np.arange(len(sig)), full)
            load = (task << 32) | next(loads)
            warm = hot.value[(hashes >> _U(64 - bits)).astype(np.int64)]
            listing = _join(sig, sizes[at].astype(np.uint32), cells[at].astype(np.uint32), needs[at].astype(np.uint32), np.bincount(owner[warm], minlength=len(sig)).astype(np.uint32), hashes[warm], short_[at].reshape(-1))
            hashes, owner = hashes[~warm], owner[~warm]
            bucket = _bucket(hashes, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            bucket, owner, short = bucket[order], owner[order].astype(np.uint16), hashes[order].astype(np.uint32)
            cuts = _runs(bucket)
            rows = [(int(bucket[a]), short[a:b].tobytes(), owner[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])] or [(load % buckets, b"", b"")]
            names, keys_, owners = zip(*rows)
            lists = [listing] + [None] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([load] * len(rows), pa.int64()), pa.array(keys_, pa.binary()), pa.array(owners, pa.binary()), pa.array(lists, pa.binary())],
                ["bucket", "load", "keys", "owners", "listing"],
            )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        task, loads = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            for _, _, _, hashes, bounds in units(batch):
                hashes, bounds = distinct_sets(hashes, bounds)
                sig = signatures(hashes, bounds)
                fresh = _fresh(sig, np.diff(bounds) >= spec.least, seen)
                if not fresh.any():
                    continue
                hashes, bounds = _take_rows(hashes, bounds, fresh)
                found = parity_blocks(spec, hashes, bounds)
                if not len(found.row):
                    continue
                cells = np.diff(found.ends) << 1 | found.own
                held.append((sig[fresh][found.row], np.diff(bounds)[found.row], cells, found.need, parity_sketches(hashes, bounds)[found.row], found.keys))
                size += len(found.keys)
                if size >= FLUSH:
                    yield from pack(held, task, loads)
                    held, size = [], 0
        if held:
            yield from pack(held, task, loads)

    return docs.mapInArrow(run, "bucket int, load long, keys binary, owners binary, listing binary")


def _count_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """(load, bucket, keys, owners, codes, listing): the keys that occur more than once in the corpus go back to their
    load, with the code of how often; lists of sketches are passed on."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            here = group.column("bucket")[0].as_py()
            loads, listings = group.column("load").to_pylist(), group.column("listing").to_pylist()
            parts = [np.frombuffer(b, np.uint32) for b in group.column("keys").to_pylist()]
            owners = [np.frombuffer(b, np.uint16) for b in group.column("owners").to_pylist()]
            keys = np.concatenate(parts)
            order = np.argsort(keys)
            cuts = _runs(keys[order])
            count = np.diff(cuts)
            codes = np.zeros(len(keys), np.uint8)
            codes[order] = np.repeat(np.where(count > 1, rarity(count), 0), count)
            at, out = 0, []
            for load, part, owner, listing in zip(loads, parts, owners, listings):
                code = codes[at : at + len(part)]
                at += len(part)
                common = code > 0
                if listing is not None or common.any():
                    out.append((load, part[common].tobytes(), owner[common].tobytes(), code[common].tobytes(), listing))
            if out:
                load, keys_, owners_, codes_, lists = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(load, pa.int64()), pa.array([here] * len(out), pa.int32()), *(pa.array(x, pa.binary()) for x in (keys_, owners_, codes_, lists))],
                    ["load", "bucket", "keys", "owners", "codes", "listing"],
                )

    schema = "load long, bucket int, keys binary, owners binary, codes binary, listing binary"
    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def rarity(count: np.ndarray) -> np.ndarray:
    """Counts on a log scale of 8 steps an octave; equal counts have equal codes."""
    return np.minimum(np.round(np.log2(np.maximum(count, 1).astype(np.float64)) * 8), 254).astype(np.uint8)


def _keys(counted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): of each sketch the keys it must publish, with their places in the order of rarity. Keys
    that no other set has come first and need no row. bucket -1: edges by hot keys."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "load"):
            names, n, cells, needs, hot_n, hots, sketch = _split(next(x for x in group.column("listing").to_pylist() if x is not None), ["u8", "u4", "u4", "u4", "u4", "u8", "u8"])
            sketch = sketch.reshape(-1, 2)
            filled = (cells >> 1).astype(np.int64)
            keys, owner, code = (np.concatenate([np.frombuffer(b, kind) for b in group.column(c).to_pylist()]) for c, kind in (("keys", "u4"), ("owners", "u2"), ("codes", "u1")))
            counts = [len(b) for b in group.column("codes").to_pylist()]
            bucket = np.concatenate([np.repeat(group.column("bucket").to_numpy(), counts).astype(np.int64), np.full(len(hots), -1)])
            owner = np.concatenate([owner.astype(np.int64), np.repeat(np.arange(len(names)), hot_n)])
            code = np.concatenate([code, np.full(len(hots), 255, np.uint8)])
            token = np.concatenate([keys.astype(np.uint64) | bucket[: len(keys)].astype(np.uint64) << _U(32), hots])
            order = np.lexsort((token, owner * 256 + code))
            owner, bucket, token = owner[order], bucket[order], token[order]
            held = np.bincount(owner, minlength=len(names))
            place = np.arange(len(owner)) - np.repeat(np.cumsum(held) - held, held) + (filled - held)[owner]
            need = place < needs.astype(np.int64)[owner]
            owner, bucket, token, place = owner[need], bucket[need], token[need], place[need]
            order = np.argsort(bucket, kind="stable")
            owner, bucket, token, place = owner[order], bucket[order], token[order], place[order]
            cuts = _runs(bucket)
            rows, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append(int(bucket[a]))
                at = owner[a:b]
                if rows[-1] < 0:
                    blobs.append(_join(names[at], token[a:b]))
                else:
                    blobs.append(pack_keys(names, n, cells, sketch, at, token[a:b], place[a:b]))
            if rows:
                yield _rows(rows, blobs, "bucket")

    return counted.repartition(buckets, "load").sortWithinPartitions("load").mapInArrow(run, "bucket int, blob binary")


def pack_sorted(values: np.ndarray, span: int) -> bytes:
    """Ascending integers below ``span`` in about 2 + log2(span / their number) bits each (Elias and Fano)."""
    k = len(values)
    low = max(0, (span // max(1, k)).bit_length() - 1)
    high = (values >> _U(low)).astype(np.int64) + np.arange(k)
    marks = np.zeros(int(high[-1]) + 1 if k else 0, np.uint8)
    marks[high] = 1
    lower = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(k, 8), axis=1, count=low, bitorder="little")
    return np.array([k, low], np.uint32).tobytes() + np.packbits(lower).tobytes() + np.packbits(marks).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    k, low = np.frombuffer(blob, np.uint32, 2).tolist()
    end = 8 + (k * low + 7) // 8
    lower = np.zeros((k, 64), np.uint8)
    lower[:, :low] = np.unpackbits(np.frombuffer(blob, np.uint8, end - 8, 8), count=k * low).reshape(k, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, -1, end))) - np.arange(k)
    return high.astype(np.uint64) << _U(low) | np.packbits(lower, axis=1, bitorder="little").view("<u8").reshape(-1)


@dataclass
class Load:
    """Sketches of some sets. sig, n, cells, sketch: as in pack_keys. need: keys to publish. keys: of the filled blocks, sketch
    after sketch. name: a hash of the sketches."""

    name: int
    sig: np.ndarray
    n: np.ndarray
    cells: np.ndarray
    sketch: np.ndarray
    need: np.ndarray
    keys: np.ndarray


def _loads(batches: Iterator[pa.RecordBatch], units: Units, spec: Similarity, firsts: np.ndarray) -> Iterator[Load]:
    """Loads of about FLUSH keys. Of equal sets only the first row takes part, as far as ``firsts`` tells, and one of each task."""

    def load(parts: list[tuple[np.ndarray, ...]]) -> Load:
        sig, n, cells, sketch, need, keys = (np.concatenate(x) for x in zip(*parts))
        name = hashlib.blake2b(sig.tobytes() + cells.tobytes(), digest_size=8).digest()
        return Load(int.from_bytes(name, "little", signed=True), sig, n, cells, sketch, need, keys)

    seen: set[int] = set()
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for ids, ties, subs, hashes, bounds in units(batch):
            hashes, bounds = distinct_sets(hashes, bounds)
            sig = signatures(hashes, bounds)
            fresh = _fresh(sig, (np.diff(bounds) >= spec.least) & firsts[_marks(row_names(sig.view(np.int64), ids, ties, subs))], seen)
            if not fresh.any():
                continue
            hashes, bounds = _take_rows(hashes, bounds, fresh)
            found = parity_blocks(spec, hashes, bounds)
            if not len(found.row):
                continue
            cells = np.diff(found.ends) << 1 | found.own
            held.append((sig[fresh][found.row], np.diff(bounds)[found.row], cells, parity_sketches(hashes, bounds)[found.row], found.need, found.keys))
            size += len(found.keys)
            if size >= FLUSH:
                yield load(held)
                held, size = [], 0
    if held:
        yield load(held)


def row_names(sig: np.ndarray, ids: pa.Array, ties: pa.Array, subs: np.ndarray) -> np.ndarray:
    """64-bit names of rows that hold a set."""
    out = mix64(sig.view(np.uint64))
    for part, none in ((ids, np.iinfo(np.int64).min), (ties, 0)):
        out = mix64(out ^ part.cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False).view(np.uint64))
    return mix64(out ^ np.asarray(subs).astype(np.int64).view(np.uint64)).view(np.int64)


def _first_rows(known: DataFrame, buckets: int) -> np.ndarray:
    """A filter of fixed size that passes the first row of each set, and few others unless there are very many sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, ids, ties, subs = batch.columns
            yield pa.RecordBatch.from_arrays([pa.array(row_names(sig.to_numpy(zero_copy_only=False), ids, ties, subs.to_numpy(zero_copy_only=False)))], ["id"])

    first = known.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "tie", "sub")).alias("f")).select("sig", "f.id", "f.tie", "f.sub")
    return _filter_table(first.mapInArrow(run, "id long"), buckets)


def _fingerprints(keys: np.ndarray, width: int) -> np.ndarray:
    return mix64(keys ^ _U(0x6C8E9CF570932BD5)) >> _U(64 - width)


def _hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[(keys >> _U(64 - (len(hot).bit_length() - 1))).astype(np.int64)]


def _sent(docs: DataFrame, units: Units, spec: Similarity, hot, firsts, width: int, buckets: int) -> DataFrame:
    """(load, bucket, blob): the fingerprints of ``width`` bits of a load's keys, hot ones aside, as one bucket after another takes them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(buckets + 1, dtype=object) * (1 << width) // buckets).astype(np.uint64)
        for load in _loads(batches, units, spec, firsts.value):
            prints = np.sort(_fingerprints(load.keys[~_hot(load.keys, hot.value)], width))
            at = np.searchsorted(prints, edges)
            some = np.flatnonzero(np.diff(at)).tolist()
            blobs = [pack_sorted(prints[at[k] : at[k + 1]] - edges[k], int(edges[k + 1] - edges[k])) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array([load.name] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["load", "bucket", "blob"])

    return docs.mapInArrow(run, "load long, bucket int, blob binary")


def _count_prints(sent: DataFrame, buckets: int) -> DataFrame:
    """(load, bucket, codes): for each fingerprint of a blob, compressed, the code of how often it occurs; 0: once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            parts = [unpack_sorted(b) for b in group.column("blob").to_pylist()]
            prints = np.concatenate(parts)
            order = np.argsort(prints)
            times = np.diff(_runs(prints[order]))
            codes = np.zeros(len(prints), np.uint8)
            codes[order] = np.repeat(rarity(times), times)
            ends = np.cumsum([0, *(len(p) for p in parts)])
            packed = [zlib.compress(codes[a:b].tobytes(), 1) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(group.column(c).to_pylist(), t) for c, t in (("load", pa.int64()), ("bucket", pa.int32()))] + [pa.array(packed, pa.binary())], ["load", "bucket", "codes"])

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "load long, bucket int, codes binary")


def _write_codes(counted: DataFrame, folder: str, buckets: int) -> None:
    """A file for each load in ``folder``: the compressed codes of its fingerprints in ascending order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for group in whole_groups(batches, "load"):
            # Loads of the same sets have the same name, and the same codes.
            _, first = np.unique(group.column("bucket").to_numpy(), return_index=True)
            codes = b"".join(zlib.decompress(b) for b in group.column("codes").take(pa.array(first)).to_pylist())
            name = group.column("load")[0].as_py()
            with fs.open_output_stream(scratch := f"{root}/part-{name}-{uuid.uuid4().hex}") as out:
                out.write(zlib.compress(codes, 1))
            fs.move(scratch, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64())], ["load"])

    counted.repartition(buckets, "load").sortWithinPartitions("load", "bucket").mapInArrow(run, "load long").count()


def _read_codes(fs: pafs.FileSystem, path: str, k: int) -> np.ndarray | None:
    """The codes of a load's k fingerprints; None if the load was another one when they were counted, as rows may come in another order
    when they are read again."""
    try:
        with fs.open_input_file(path) as file:
            codes = np.frombuffer(zlib.decompress(file.read()), np.uint8)
    except FileNotFoundError:
        return None
    return codes if len(codes) == k else None


def _publish_blocks(docs: DataFrame, units: Units, spec: Similarity, hot, firsts, width: int, folder: str, buckets: int) -> DataFrame:
    """(bucket, blob) as _keys gives it. A load whose codes aren't there can't rank its keys as others do: all go out, and any may be
    the first."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for load in _loads(batches, units, spec, firsts.value):
            filled = load.cells >> 1
            warm = _hot(load.keys, hot.value)
            cold = np.flatnonzero(~warm)
            found = _read_codes(fs, f"{root}/{load.name}", len(cold)) if len(cold) else np.zeros(0, np.uint8)
            code = np.full(len(warm), 255, np.uint64)
            code[cold[np.argsort(_fingerprints(load.keys[cold], width))]] = 1 if found is None else found
            owner = np.repeat(np.arange(len(filled)), filled)
            # Blocks with equal codes are in the order of their places in the sketch.
            ranked = np.sort((owner.astype(np.uint64) << _U(8) | code) << _U(32) | np.arange(len(owner), dtype=np.uint64))
            order, code = (ranked & _U(0xFFFFFFFF)).astype(np.int64), ranked >> _U(32) & _U(0xFF)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(filled) - filled, filled)
            out = (place < load.need[owner]) & (code > 0)
            if found is None:
                out[:], place[:] = True, 0
            owner, keys, place, warm = owner[out], load.keys[order[out]], place[out], code[out] == 255
            bucket = np.where(warm, -1, _bucket(keys, buckets).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            owner, keys, place, bucket = owner[order], keys[order], place[order], bucket[order]
            cuts = _runs(bucket)
            rows, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append(int(bucket[a]))
                at = owner[a:b]
                blobs.append(_join(load.sig[at], keys[a:b]) if rows[-1] < 0 else pack_keys(load.sig, load.n, load.cells, load.sketch, at, keys[a:b], place[a:b]))
            if rows:
                yield _rows(rows, blobs, "bucket")

    return docs.mapInArrow(run, "bucket int, blob binary")


def _parity_keys(docs: DataFrame, units: Units, spec: Similarity, known: DataFrame, table: np.ndarray, share: Callable, buckets: int) -> DataFrame:
    """(bucket, blob): of each sketch the keys it must publish, with their places; see _publish_blocks. Where tasks can't open
    files in the shared folder, keys travel to be counted, and back."""
    spark = docs.sparkSession
    hot = share(hot_cells(table))
    try:
        pafs.FileSystem.from_uri(shared_dir(spark))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return _keys(_count_keys(_blocks(docs, units, spec, hot, buckets), buckets), buckets)
    firsts = share(_first_rows(known, buckets))
    width = min(44, int(table.sum(dtype=np.int64)).bit_length() + SPARE_BITS)
    folder = fresh_path(spark, "codes")
    _write_codes(_count_prints(_sent(docs, units, spec, hot, firsts, width, buckets), buckets), folder, buckets)
    return _publish_blocks(docs, units, spec, hot, firsts, width, folder, buckets)


_SIGNS = np.where(np.arange(256)[:, None] >> np.arange(8)[None, :] & 1, -1, 1).astype(np.float32)


def _signs(sketch: np.ndarray, one: np.ndarray | int, other: np.ndarray | int) -> np.ndarray:
    """1 and -1 for the bits of sketches, and two more columns."""
    bits = 64 * sketch.shape[1]
    out = np.empty((len(sketch), bits + 2), np.float32)
    out[:, :bits] = _SIGNS[np.ascontiguousarray(sketch).view(np.uint8)].reshape(len(sketch), bits)
    out[:, bits], out[:, bits + 1] = one, other
    return out


def list_roots(before: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], spec: Similarity, fits: Callable) -> np.ndarray:
    """For the sets of one list, ascending by size n, the place of the least set of each one's component: sets are united that have the
    same label ``before``, or differ in no more bits than linked sets differ in tokens if ``fits`` (smaller, larger, tokens of both) admits
    them. sketches: matrices of growing width, row after row the list's.

    The bits in which all sets of two tiles differ are one matrix product, with the bound as two more columns. Neighbours come
    first: where most sets of a list are alike, only the others are left to compare with all.
    """
    share = 2 * (spec.den - spec.num) / (spec.den + spec.num)
    _, first_of, label = np.unique(before, return_index=True, return_inverse=True)
    label = first_of[label]

    def judge(a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.minimum(a, b), np.maximum(a, b)
        keep = (label[a] != label[b]) & (n[a] >= spec.shortest(n[b]))
        a, b = a[keep], b[keep]
        keep = fits(a, b, n[a] + n[b])
        unite(label, a[keep], b[keep])

    def meet(rows: np.ndarray, one: np.ndarray, cols: np.ndarray, other: np.ndarray, twice: bool = False) -> None:
        """twice: rows and columns are the same, so that half of the pairs will do."""
        bits = 64 * one.shape[1]
        step = max(16, (1 << 14) // bits)
        # A bound beyond 2 * bits passes every pair.
        bound = lambda at: np.minimum(share * n[at], 2 * bits)
        for x in range(0, len(rows), step):
            some = rows[x : x + step]
            first, last = np.searchsorted(n[cols], [spec.shortest(n[some[0]]), n[some[-1]] * spec.den // spec.num + 1])
            last = x + len(some) if twice else int(last)
            left = _signs(one[x : x + step], bound(some), 1)
            for y in range(int(first), last, 16 * step):
                at = slice(y, min(y + 16 * step, last))
                hit = np.flatnonzero(left @ _signs(other[at], 1, bound(cols[at])).T >= bits - 0.25)
                for z in range(0, len(hit), 1 << 18):
                    i, j = np.divmod(hit[z : z + (1 << 18)], at.stop - y)
                    judge(some[i], cols[at][j])

    ends = np.cumsum([0, *(len(m) for m in sketches)])
    for k, m in enumerate(sketches):
        rows = np.arange(ends[k], ends[k + 1])
        for step in (1, 2, 4, 8, 16):
            close = np.flatnonzero(np.bitwise_count(m[step:] ^ m[:-step]).sum(1, dtype=np.int64) <= spec.differ(n[rows[step:]] + n[rows[:-step]]))
            judge(rows[close], rows[close + step])
        for j in range(k + 1):
            one = m
            while one.shape[1] > sketches[j].shape[1]:
                one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
            cols = np.arange(ends[j], ends[j + 1])
            main = np.bincount(label[np.concatenate([rows, cols])], minlength=1).argmax()
            apart = label[rows] != main
            outside = label[cols] != main
            if j == k:
                meet(rows[apart], one[apart], rows[apart], one[apart], True)
                meet(rows[apart], one[apart], rows[~apart], one[~apart])
            else:
                meet(rows[apart], one[apart], cols, sketches[j])
                meet(rows[~apart], one[~apart], cols[outside], sketches[j][outside])
    return label


def forest(blobs: list[bytes], spec: Similarity) -> tuple[np.ndarray, ...]:
    """Star edges (signature of the root, of the member) that unite the candidates of a bucket, pairs (signature, signature) of
    those that only their whole sketches can judge, and the lists with many such pairs: signature, list, size, filled blocks,
    of which are left, and is the band the set's own?, by list and size. (Without parity sketches the tokens are the blocks.)"""
    # With parity sketches the last is the number of filled blocks, doubled, and one if the band is the set's own.
    sig, n, token, place, sketch, *cells = (np.concatenate(x) for x in zip(*(unpack_keys(b) if spec.parity else _split(b, ["u8", "u4", "u4", "u4", "u8"]) for b in blobs)))
    sig, first, owner = np.unique(sig, return_index=True, return_inverse=True)
    # Sets are numbered by size, so that one sort puts each list in order.
    by_size = np.argsort(n[first], kind="stable")
    turn = np.empty(len(sig), np.int64)
    turn[by_size] = np.arange(len(sig))
    sig, owner = sig[by_size], turn[owner]
    sketch = sketch.reshape(-1, 2)[first[by_size]]
    cells = cells[0].astype(np.int64) if cells else np.zeros(len(token), np.int64)
    key, n, place = token.astype(np.uint64) << _U(32), n.astype(np.int64), place.astype(np.int64)
    # A set that came from several map tasks counts once, with its least place.
    named = key | owner.astype(np.uint64)
    order = np.argsort(named, kind="stable" if spec.parity else None)
    once = _runs(named[order])[:-1]
    place = np.minimum.reduceat(place[order], once) if len(once) else place
    order = order[once]
    key, owner, n, cells = key[order], owner[order], n[order], cells[order]
    label = np.arange(len(sig))
    ranked = key | n.astype(np.uint64)
    low = np.searchsorted(ranked, (ranked & _U(0xFFFFFFFF00000000)) | spec.shortest(n).astype(np.uint64))
    reach = np.arange(len(ranked)) - low
    filled = cells >> 1
    if spec.parity:
        # Of a pair the larger set is in its own band; two sets of the band below meet in that one.
        reach[cells & 1 == 0] = 0
    cuts = _runs(ranked >> _U(32))
    listed = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    # Lists whose pairs stay together: their number grows with the square of the list.
    dense = np.zeros(len(cuts) - 1, bool)
    weak_pairs = np.zeros(len(cuts) - 1, np.int64)
    if not spec.parity:
        filled, cells = n, np.ones(len(n), np.int64)
    left = filled - place
    doubtful, whole = spec.doubtful(), spec.judged_whole()
    if not spec.parity:
        alike: list[np.ndarray] = []
        for k in np.unique(np.searchsorted(cuts, np.flatnonzero(reach > CHAIN_FROM), side="right") - 1).tolist():
            reach[cuts[k] : cuts[k + 1]] = 0
            # Sets that a short sketch can't judge meet with their whole ones.
            dense[k] = n[cuts[k + 1] - 1] >= whole
            at = slice(cuts[k], cuts[k] + int(np.searchsorted(n[cuts[k] : cuts[k + 1]], doubtful * spec.den // (spec.den + spec.num), side="right")))
            rest = left[at]
            root = list_roots(owner[at], n[at], [sketch[owner[at]]], spec, lambda a, b, both: (both < doubtful) & spec.enough(np.minimum(rest[a], rest[b]), both))
            alike.append(np.stack([owner[at], owner[at][root]])[:, root != np.arange(len(root))])
        unite(label, *(np.concatenate(alike, 1) if alike else np.zeros((2, 0), np.int64)))
    else:
        dense[listed[reach > 8 * CHAIN_FROM]] = True
    total = np.cumsum(reach)
    start = 0
    weak: list[np.ndarray] = []
    while start < len(reach):
        stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right"))
        stop = max(stop, start + 1)
        # With parity sketches a list that is judged whole is left to that; otherwise its small sets aren't judged whole.
        r = np.where(dense[listed[start:stop]] & spec.parity, 0, reach[start:stop])
        b = np.repeat(np.arange(start, stop), r)
        a = np.repeat(low[start:stop] - (np.cumsum(r) - r), r) + np.arange(len(b))
        apart = label[owner[a]] != label[owner[b]]
        a, b = a[apart], b[apart]
        both = n[a] + n[b]
        if spec.parity:
            # The first key that both have leaves room for as many equal blocks as there must be.
            good = np.minimum(left[a], left[b]) >= np.maximum(1, np.maximum(filled[a], filled[b]) - spec.differ(both))
        else:
            good = spec.enough(np.minimum(left[a], left[b]), both)
        place_in = listed[b[good]]
        a, b, both = owner[a[good]], owner[b[good]], both[good]
        apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1).astype(np.int64)
        good = apart <= spec.differ(both)
        sure = likely(apart, both)
        unsure = good & ~sure
        weak_pairs += np.bincount(place_in[unsure], minlength=len(dense))
        dense |= weak_pairs > WEAK_TIMES * np.diff(cuts)
        unsure &= ~dense[place_in]
        weak.append(np.stack([a, b, place_in], 1)[unsure])
        good &= sure
        unite(label, a[good], b[good])
        start = stop
    member = np.flatnonzero(label != np.arange(len(sig)))
    left_over = np.concatenate(weak) if weak else np.zeros((0, 3), np.int64)
    left_over = left_over[~dense[left_over[:, 2]], :2]
    left_over = np.unique(left_over[label[left_over[:, 0]] != label[left_over[:, 1]]], axis=0)
    # A list whose sets are united by now needs nothing more.
    at = np.flatnonzero(dense[listed] & (n >= whole))
    split = np.zeros(len(dense), bool)
    split[listed[at[1:]][(label[owner[at[1:]]] != label[owner[at[:-1]]]) & (listed[at[1:]] == listed[at[:-1]])]] = True
    at = at[split[listed[at]]]
    together = (sig[owner[at]], listed[at].astype(np.uint32), n[at].astype(np.uint32), filled[at].astype(np.uint32), left[at].astype(np.uint32), (cells[at] & 1).astype(np.uint32))
    return sig[label[member]], sig[member], sig[left_over[:, 0]], sig[left_over[:, 1]], together


#: Rows of candidates, of about 60 bytes, that may be broadcast.
SMALL_LIST = 200_000


def parity_sketches(hashes: np.ndarray, bounds: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """bits / 64 words a row: bit x is the parity of the tokens hashed to x. The bits in which two rows
    differ are at most the tokens in which the sets differ."""
    rows = len(bounds) - 1
    cell = np.repeat(np.arange(rows) * bits, np.diff(bounds)) + (hashes >> _U(20) & _U(bits - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(rows, bits // 64)


def whole_sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set a parity sketch of at least two bits a token, 128 at the least."""
    n = np.diff(bounds)
    bits = 1 << np.maximum(7, np.frexp(np.maximum(2 * n - 1, 1).astype(np.float64))[1].astype(np.int64))
    out: list[bytes] = [b""] * len(n)
    for size in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == size)
        for a in range(0, len(rows), max(1, (1 << 22) // size)):
            some = rows[a : a + max(1, (1 << 22) // size)]
            picked = np.zeros(len(n), bool)
            picked[some] = True
            made = parity_sketches(*_take_rows(hashes, bounds, picked), size)
            for k, row in zip(some.tolist(), made):
                out[k] = row.tobytes()
    return out


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches; the longer is folded to the length of the shorter, as a bit's place is a remainder."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _within_reach(pairs: DataFrame, sketches: DataFrame, spec: Similarity) -> DataFrame:
    """The pairs (u, v) whose sketches differ in no more bits than linked sets differ in tokens."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([hamming(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], np.int64)
            both = batch.column(4).to_numpy()
            yield batch.filter(pa.array(apart <= spec.differ(both))).select(["u", "v"])

    side = lambda x: sketches.select(F.col("sig").alias(x), F.col("sketch").alias(f"{x}_sketch"), F.col("n").cast("long").alias(f"{x}_n"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    return joined.select("u", "v", "u_sketch", "v_sketch", (F.col("u_n") + F.col("v_n")).alias("both")).mapInArrow(run, "u long, v long")


def _judged(dense: DataFrame, sketches: DataFrame, spec: Similarity, buckets: int) -> DataFrame:
    """Edges (u, v) that unite the pairs of the lists in ``dense``, as _candidates gives them, whose sketches are within reach. A set's
    sketch travels once to each bucket, and pairs never leave their task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            lists, found = group.column("listing").is_valid(), group.filter(group.column("sketch").is_valid())
            known = found.column("sig").to_numpy().view(np.uint64)
            order = np.argsort(known)
            known, blobs = known[order], found.column("sketch").take(pa.array(order)).to_pylist()
            words = np.array([len(b) // 8 for b in blobs], np.int64)
            for blob in group.filter(lists).column("listing").to_pylist():
                sig, listed, n, filled, left, own = _split(blob, ["u8", "u4", "u4", "u4", "u4", "u4"])
                n, filled, left = n.astype(np.int64), filled.astype(np.int64), left.astype(np.int64)
                owner = np.searchsorted(known, sig)
                label = np.arange(len(known))
                alike: list[np.ndarray] = []
                cuts = _runs(listed)
                for x, y in zip(cuts, cuts[1:]):
                    at, most, rest, mine = owner[x:y], filled[x:y], left[x:y], own[x:y]
                    if spec.parity:
                        fits = lambda a, b, both: (mine[b] > 0) & (np.minimum(rest[a], rest[b]) >= np.maximum(1, np.maximum(most[a], most[b]) - spec.differ(both)))
                    else:
                        fits = lambda a, b, both: spec.enough(np.minimum(rest[a], rest[b]), both)
                    steps = _runs(words[at])
                    matrices = [np.frombuffer(b"".join([blobs[k] for k in at[a:b].tolist()]), np.uint64).reshape(b - a, -1) for a, b in zip(steps, steps[1:])]
                    root = list_roots(label[at], n[x:y], matrices, spec, fits)
                    alike.append(np.stack([at, at[root]])[:, root != np.arange(len(root))])
                    if len(alike) == 64:
                        unite(label, *np.concatenate(alike, 1))
                        alike = []
                if alike:
                    unite(label, *np.concatenate(alike, 1))
                member = np.flatnonzero(label != np.arange(len(known)))
                for a in range(0, len(member), 1 << 16):
                    some = member[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(known[label[some]].view(np.int64)), pa.array(known[some].view(np.int64))], ["u", "v"])

    none = F.lit(None).cast("binary")
    asked = dense.where("v is not null").select(F.col("u").alias("bucket"), F.col("v").alias("sig"))
    rows = asked.join(sketches, "sig").select("bucket", "sig", "sketch", none.alias("listing"))
    rows = rows.unionByName(dense.where("listing is not null").select(F.col("u").alias("bucket"), F.col("v").alias("sig"), none.alias("sketch"), "listing"))
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def ranked_tokens(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The order of tokens by set and code; those with equal codes stay in the order of their hashes."""
    if not len(owner) or owner[-1] < 1 << 24:
        return (np.sort((owner.astype(np.uint64) << _U(8) | code) << _U(32) | np.arange(len(owner), dtype=np.uint64)) & _U(0xFFFFFFFF)).astype(np.int64)
    return np.argsort(owner << 8 | code, kind="stable")


def _publish(docs: DataFrame, units: Units, spec: Similarity, rank, buckets: int) -> DataFrame:
    """(bucket, blob) as _keys gives it, with sketches, ranking tokens by the count table (code 255: hot). A token alone in
    its cell is alone in the corpus and isn't published. Of a hot token its pairs with the set's later tokens go out, as far as the
    second token that a partner shares may stand: their lists are short. The token itself does if one shared token may be enough."""
    bits = spec.bits

    def pack(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        sig, n, token, place, sketch = (np.concatenate(x) for x in zip(*parts))
        token = mix64(token)
        bucket = _bucket(token, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
        bucket, sig, n, token, place, sketch = bucket[order], sig[order], n[order].astype(np.uint32), token[order].astype(np.uint32), place[order].astype(np.uint32), sketch[order]
        cuts = _runs(bucket)
        if len(bucket):
            yield _rows([int(bucket[a]) for a in cuts[:-1]], [_join(sig[a:b], n[a:b], token[a:b], place[a:b], sketch[a:b].reshape(-1)) for a, b in zip(cuts, cuts[1:])], "bucket")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rank.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        load = 0
        for batch in batches:
            for _, _, _, hashes, bounds in units(batch):
                hashes, bounds = distinct_sets(hashes, bounds)
                sig, n = signatures(hashes, bounds), np.diff(bounds)
                fresh = _fresh(sig, (n >= spec.least) & (n > 0) & ~spec.alone(n), seen)
                if not fresh.any():
                    continue
                hashes, bounds = _take_rows(hashes, bounds, fresh)
                sig, n = sig[fresh], n[fresh]
                owner = np.repeat(np.arange(len(n)), n)
                code = codes[(hashes >> _U(64 - bits)).astype(np.int64)]
                order = ranked_tokens(owner, code)
                place = np.arange(len(owner)) - bounds[:-1][owner]
                prefix = spec.prefix(n)[owner]
                hot = (place < prefix) & (code[order] == 255)
                first = np.flatnonzero(hot)
                last = np.minimum(prefix[first] + 1, n[owner[first]]) - place[first] - 1
                first = np.repeat(first, last)
                second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(last) - last, last)
                one = np.flatnonzero((place < prefix) & (code[order] > 0) & (~hot | (spec.shortest(n)[owner] < 2)))
                with np.errstate(over="ignore"):
                    token = np.concatenate([hashes[order[one]], mix64(hashes[order[first]]) + hashes[order[second]]])
                # A pair's second token is no further than where the others that must be shared begin.
                at, place = owner[np.concatenate([one, second])], np.concatenate([place[one], place[second] - 1])
                sketch = parity_sketches(hashes, bounds)
                held.append((sig[at], n[at], token, place, sketch[at]))
                load += len(token)
                if load >= FLUSH // 4:
                    yield from pack(held)
                    held, load = [], 0
        if held:
            yield from pack(held)

    return docs.mapInArrow(run, "bucket int, blob binary")


def _candidates(keys: DataFrame, spec: Similarity, buckets: int) -> DataFrame:
    """Edges (u, v, weak, listing) between signatures that unite all candidate pairs; a weak one is a pair to be judged yet. Where weak is
    null, u is a bucket, and v a set of its lists that are to be judged whole, or listing these lists; see forest."""
    names = ["u", "v", "weak", "listing"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            blobs = group.column("blob").to_pylist()
            if group.column("bucket")[0].as_py() < 0:
                # Hot tokens: each is a vertex of its own, so that no list is gathered.
                for blob in blobs:
                    sig, token = _split(blob, ["u8", "u8"])
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(mix64(token ^ _U(0xB5297A4D)).view(np.int64)), pa.array(np.zeros(len(sig), bool)), pa.nulls(len(sig), pa.binary())], names)
                continue
            root, member, one, other, together = forest(blobs, spec)
            if len(together[0]):
                sets = np.unique(together[0]).view(np.int64)
                here = pa.array(np.full(len(sets) + 1, group.column("bucket")[0].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([here, pa.array([*sets.tolist(), None], pa.int64()), pa.nulls(len(here), pa.bool_()), pa.array([None] * len(sets) + [_join(*together)], pa.binary())], names)
            u, v = np.concatenate([root, one]).view(np.int64), np.concatenate([member, other]).view(np.int64)
            for a in range(0, len(u), 1 << 16):
                at = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(v[at]), pa.array(np.arange(len(u))[at] >= len(root)), pa.nulls(len(u[at]), pa.binary())], names)

    spread = F.when(F.col("bucket") < 0, F.xxhash64("blob")).otherwise(F.col("bucket").cast("long"))
    placed = keys.withColumn("at", spread).repartition(buckets, "at").sortWithinPartitions("bucket").select("bucket", "blob")
    return placed.mapInArrow(run, "u long, v long, weak boolean, listing binary")


def _marks(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) >> _U(64 - FILTER_BITS)).astype(np.int64)


def _filter_table(wanted: DataFrame, buckets: int) -> np.ndarray:
    """A one-hash Bloom filter of fixed size over the column ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            table[_marks(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))] = 1
        rows = list(hashtable.pack_counts(table))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["slice", "payload"])

    return hashtable.sum_slices(wanted.select("id").mapInArrow(run, "slice int, payload binary"), FILTER_BITS, buckets) > 0


def narrow(hashes: np.ndarray) -> bytes:
    """48 bits of each hash, for sets under way to verification."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _sets(docs: DataFrame, units: Units, spec: Similarity, wanted_ids, wanted_sigs) -> DataFrame:
    """(sig, hashes) of the units whose id and signature may be wanted."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_on, sigs_on = wanted_ids.value, wanted_sigs.value
        for batch in batches:
            ids = batch.column(batch.schema.names.index("id")).fill_null(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(ids_on[_marks(ids)]))
            if not batch.num_rows:
                continue
            for _, _, _, hashes, bounds in units(batch):
                hashes, bounds = distinct_sets(hashes, bounds)
                sig = signatures(hashes, bounds).view(np.int64)
                sizes = np.diff(bounds)
                rows = np.flatnonzero(sigs_on[_marks(sig)] & (sizes >= spec.least))
                _, first = np.unique(sig[rows], return_index=True)
                rows = rows[np.sort(first)]
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig[rows]), pa.array([narrow(hashes[bounds[i] : bounds[i + 1]]) for i in rows.tolist()], pa.binary())], ["sig", "hashes"]
                    )

    return docs.mapInArrow(run, "sig long, hashes binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairwise intersections, by products of 0/1 blocks over shared tokens."""
    k = len(sets)
    out = np.zeros((k, k), np.float32)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    same = token[1:] == token[:-1]
    shared = np.zeros(len(token), bool)
    shared[1:] |= same
    shared[:-1] |= same
    token, owner = token[shared], owner[shared]
    if len(token):
        column = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        width = min(4096, max(64, (1 << 22) // k))
        for c in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [c, c + width])
            block = np.zeros((k, width), np.float32)
            block[owner[a:b], column[a:b] - c] = 1
            out += block @ block.T
    return np.round(out, out=out)


def near_rows(sets: list[np.ndarray], spec: Similarity) -> np.ndarray:
    """Which sets have another within reach of their bit sketches: the Hamming distance is at most the number of
    tokens in which two sets differ."""
    sizes = np.array([len(s) for s in sets])
    bits = max(128, min(1 << 13, 1 << int(2 * sizes.max() - 1).bit_length()))
    sketch = parity_sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), bits)
    some = np.zeros(len(sets), bool)
    step = max(1, (1 << 22) // (len(sets) * sketch.shape[1]))
    for a in range(0, len(sets), step):
        apart = np.bitwise_count(sketch[a : a + step, None, :] ^ sketch[None, :, :]).sum(2, dtype=np.int64)
        close = apart <= spec.differ(sizes[a : a + step, None] + sizes[None, :])
        close[np.arange(len(close)), a + np.arange(len(close))] = False
        some[a : a + step] = close.any(1)
    return some


def verify(sets: list[np.ndarray], side: np.ndarray, diagonal: bool, spec: Similarity) -> np.ndarray:
    """Boolean matrix of links. Sets of one side meet only in the task of their own block."""
    sizes = np.array([len(s) for s in sets])
    linked = np.zeros((len(sets), len(sets)), bool)
    rows = np.flatnonzero(near_rows(sets, spec)) if spec.parity else np.arange(len(sets))
    if not len(rows):
        return linked
    overlap = intersections([sets[k] for k in rows])
    for a in range(0, len(rows), 256):
        linked[np.ix_(rows[a : a + 256], rows)] = spec.enough(overlap[a : a + 256].astype(np.int64), sizes[rows[a : a + 256], None] + sizes[None, rows])
    np.fill_diagonal(linked, False)
    if not diagonal:
        linked &= side[:, None] != side[None, :]
    return linked


LINKS = "sig long, links long, earlier boolean, root long"


def _links(placed: DataFrame, spec: Similarity, buckets: int) -> DataFrame:
    """placed: (task, comp, i, j, sub, sig, weight, first_id, first_tie, first_sub, hashes), one row per set and task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "task"):
            sig = group.column("sig").to_numpy()
            _, rows = np.unique(sig, return_index=True)
            group = group.take(pa.array(rows))
            sig = group.column("sig").to_numpy()
            side = group.column("sub").to_numpy()
            weight = group.column("weight").to_numpy()
            first_id = group.column("first_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            first_tie = group.column("first_tie").to_numpy()
            first_sub = group.column("first_sub").to_numpy()
            comp, i, j = (group.column(c).to_numpy() for c in ("comp", "i", "j"))
            blobs = group.column("hashes").to_pylist()
            # A task number may be shared by several (comp, i, j).
            order = np.lexsort((j, i, comp))
            cuts = [0, *(np.flatnonzero((np.diff(comp[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1).tolist(), len(order)]
            for a, b in zip(cuts, cuts[1:]):
                at = order[a:b]
                if len(at) < 2:
                    continue
                linked = verify([widen(blobs[x]) for x in at.tolist()], side[at], bool(i[at[0]] == j[at[0]]), spec)
                if not linked.any():
                    continue
                label = np.arange(len(at))
                unite(label, *np.nonzero(linked))
                turn = np.empty(len(at), np.int64)
                turn[np.lexsort((sig[at], first_sub[at], first_tie[at], first_id[at]))] = np.arange(len(at))
                earlier = (linked & (turn[None, :] < turn[:, None])).any(1)
                some = linked.any(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[at][some]), pa.array((linked @ weight[at])[some]), pa.array(earlier[some]), pa.array(sig[at][label[some]])], ["sig", "links", "earlier", "root"]
                )

    return placed.repartition(buckets, "task").sortWithinPartitions("task").mapInArrow(run, LINKS)


def similar_classes(docs: DataFrame, units: Units, spec: Similarity, several: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets and their links.

    ``docs`` has long columns ``id`` and ``tie`` and whatever ``units`` reads. Returns
    (units: id, tie, sub, n, sig), (classes: sig, weight, first_id, first_tie, first_sub, n, least_id, null being first but not
    least, keep: the first document, null last), and (links: sig, links, earlier, root): for every class with a link the number of units in other classes
    linked with it, whether one of those comes before it (by first_id, first_tie, first_sub), and edges (sig, root)
    that connect linked classes. A class may have several rows of links, one per task it took part in. several: of the classes only
    those of several units or in a component of candidates are given, as they were written for the links, and without least_id and keep.
    """
    spark = docs.sparkSession
    tune(spark)
    buckets = reducers(spark)
    sc = spark.sparkContext
    sent = []

    def share(value):
        sent.append(sc.broadcast(value))
        return sent[-1]

    profiled = profile(docs, units, spec)
    table = hashtable.sum_slices(profiled.where("slice is not null"), spec.bits, buckets)
    known = profiled.where("slice is null").select("id", "tie", "sub", "n", "sig")
    if spec.parity:
        keys = _parity_keys(docs, units, spec, known, table, share, buckets)
    else:
        codes = rarity(table)
        codes[hot_cells(table)] = 255
        keys = _publish(docs, units, spec, share(codes), buckets)
    del table
    found = persist(_candidates(keys, spec, buckets), "candidates")
    edges = found.where("not weak").select("u", "v")
    if not found.where("weak or weak is null").isEmpty():
        weak = persist(found.where("weak").select("u", "v").distinct(), "weak")
        dense = found.where("weak is null")
        ends = weak.select(F.explode(F.array("u", "v")).alias("sig")).unionByName(dense.where("v is not null").select(F.col("v").alias("sig"))).distinct()
        whole = profiled.where("slice is null").where(F.col("n") >= spec.judged_whole()).select("sig", "n", "sketch")
        sketches = persist(whole.join(ends, "sig", "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        edges = edges.unionByName(_within_reach(weak, sketches, spec)).unionByName(_judged(dense, sketches, spec, buckets))
    comps = connected_components(edges.select("u", "v"))
    classes = (
        known.groupBy("sig")
        .agg(F.count("*").alias("weight"), F.min(F.struct("id", "tie", "sub")).alias("f"), F.first("n").alias("n"), F.min("id").alias("least_id"), F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "tie")).alias("keep"))
        .select("sig", "weight", F.col("f.id").alias("first_id"), F.col("f.tie").alias("first_tie"), F.col("f.sub").alias("first_sub"), "n", "least_id", "keep")
    )
    columns = ["root", "sig", "weight", "first_id", "first_tie", "first_sub", "n"]
    if several:
        classes = persist(classes.join(comps, F.col("vertex") == F.col("sig"), "left").where("root is not null or weight > 1").select(columns), "classes")
        members = classes.where("root is not null")
        classes = classes.drop("root")
    else:
        members = persist(comps.join(classes, F.col("vertex") == F.col("sig")).select(columns), "members")
    # A component that is too large for one task is cut by size band, and a band by hash. Partners' sizes differ by less than
    # a band, so a block meets the blocks of its own band and the two next to it.
    whole = members.groupBy("root").agg((F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS) <= 1).alias("small"))
    width = math.log(1.001 * spec.den / spec.num)
    banded = members.join(whole, "root").withColumn("band", F.when(F.col("small"), 0).otherwise(F.floor(F.log("n") / width)).cast("int"))
    shape = banded.groupBy("root", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    near = shape.select("root", F.col("band").alias("other"), F.col("blocks").alias("many"))
    block = lambda band, part: (F.col(band).cast("long") * (1 << 32)) + part
    placed = persist(
        banded.join(shape, ["root", "band"])
        .withColumn("sub", block("band", F.pmod(F.xxhash64("sig"), F.col("blocks"))))
        .withColumn("other", F.explode(F.when(F.col("small"), F.array("band")).otherwise(F.sequence(F.col("band") - 1, F.col("band") + 1))))
        .join(near, ["root", "other"])
        .withColumn("number", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        .withColumn("partner", block("other", F.col("number")))
        .withColumn("i", F.least("sub", "partner"))
        .withColumn("j", F.greatest("sub", "partner"))
        .withColumn("task", F.xxhash64("root", "i", "j"))
        .select("task", F.col("root").alias("comp"), "i", "j", "sub", "sig", "weight", "first_id", "first_tie", "first_sub"),
        "placed",
    )
    on_ids = share(_filter_table(members.select(F.col("first_id").alias("id")), buckets))
    on_sigs = share(_filter_table(members.select(F.col("sig").alias("id")), buckets))
    sets = _sets(docs, units, spec, on_ids, on_sigs)
    # The sets needn't travel to meet their tasks if the list of tasks is small enough to go to them.
    near_by = F.broadcast(placed) if placed.count() <= SMALL_LIST else placed
    links = persist(_links(sets.join(near_by, "sig"), spec, buckets), "links")
    for value in sent:
        value.destroy()
    return known, classes, links
