"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document's set holds the hashes of its distinct five-word shingles. Sets of equal size bands are
compared through signatures: in a band the shingle domain is cut into ``n`` first-level partitions of
three second-level parts each, and a set's signatures are the hashes of what it holds in every subset
of two parts of a partition. Two sets that differ in at most ``k`` shingles have at most ``k // 2``
partitions in which they differ twice or more; in any other, two of the three parts are equal, so that
subset is a common signature unless it is empty. Subsets that hold nothing are not signed. A partition
with two filled parts or more (a solid one) has no empty subset, so a set signs partitions in their order
until it has ``k // 2 + spare`` solid ones: partners then share ``spare`` signatures or more. A set with
fewer solid partitions signs with the partitions of the next cutting too. If it still has too few after the last
cutting, it signs its ``k + 1`` first shingles in the order of their hashes: of two such partners the first shingle that
both hold is among them on either side, as at most ``k`` stand before it, so no link is lost. Bands of small sets,
whose links differ in three shingles at most, have one partition of ``k + 4`` parts, of which all subsets of four are signed.

Passages that many documents hold would fill many parts alike. Leaving any fixed set of shingles out of
all documents leaves the difference of two documents as small as it was, so frequent shingles
(counted per slice over all texts, then summed, kept in a bitmap of fixed size) are left out first; only
documents with too few solid partitions then sign with their whole sets too. Signatures that are crowded
all the same are looked at only for sets with ``spare`` of them or more: any other set shares a
signature that is not crowded with each of its partners.

Equal sets are one class. Candidates are first compared by sketches: the parities of a set's
shingles in hashed cells. As many cells as differ, so many shingles differ at least, so no link is lost
and hardly a pair that is none gets through; only those are compared on their whole sets, exactly.
The least class of a group of one signature is compared with all others, which is linear in the group.
Linked classes are joined to components, and only groups that still span several components are
compared further, in blocks of bounded size, between components: first along a forest of the pairs that
differ least; then, where components and pairs are left, all pairs that their sketches let through.

Equality of shingles and of whole sets is equality of 64-bit hashes, that of owners of signatures is
resolved by 48 bits of the class.

Defined results: null, empty and wordless texts have empty sets and are linked with nothing; texts of
any length are read whole; repeated rows are each other's copies; rows without an id belong to a component
by their text but are never its smallest id (null where no row of a component has one); an empty table
gives an empty result; other columns are ignored by ``join`` and kept as they are by ``keep_one``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, compact, parts_for, ranges
from .hashing import mix, powers

WORDS = 5
#: Similarity of a link, in hundredths.
PERCENT = 75


@dataclass(frozen=True)
class Settings:
    #: Documents of a slice that must hold a shingle, and documents in sum, for it to be frequent.
    batch_frequent: int = 8
    frequent: int = 64
    #: Bits of the two bitmaps (frequent shingles; classes that need comparing). Their size never grows:
    #: when full they only spare less work.
    bitmap_bits: int = 23
    cuttings: int = 4
    #: Signatures that partners share at least, and members beyond which a signature is crowded.
    spare: int = 3
    crowded: int = 32
    #: Share of infrequent shingles that a document needs to do without signatures of its whole set.
    infrequent_share: float = 0.9
    #: Bytes of text handled at a time; shingles that a slice counts and signatures that a worker packs at
    #: a time; signatures of a bucket, in expectation.
    text_bytes: int = 1 << 19
    counted: int = 4_000_000
    held: int = 1_500_000
    bucket: int = 3_000_000
    #: Classes of a block at most, in expectation; open groups are compared block by block.
    block: int = 256


# Sets ---------------------------------------------------------------------------------------

#: One odd factor for each place in a shingle, hashed: in a simple series, words that change places would cancel out.
_MULTIPLIERS = [np.uint64(m | 1) for m in mix(np.arange(WORDS, dtype=np.uint64), 11).tolist()]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes whose prefix sums are taken at once; a longer word stands alone.
_RUN = 1 << 20


@dataclass(frozen=True)
class Sets:
    """Ascending distinct shingle hashes (uint64) of several documents, one after the other."""

    items: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.items[self.bounds[i] : self.bounds[i + 1]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    def where(self, rows: np.ndarray) -> Sets:
        """The sets that the mask picks."""
        return Sets(self.items[np.repeat(rows, self.sizes)], _bounds(self.sizes[rows]))

    def only(self, mask: np.ndarray) -> Sets:
        """All sets, with the items that the mask picks."""
        run = np.concatenate([[0], np.cumsum(mask)])
        return Sets(self.items[mask], run[self.bounds])

    def classes(self) -> np.ndarray:
        """Hash of each whole set, as a signed even number: the last bit is left for the band it signs in."""
        run = np.zeros(len(self.items) + 1, np.uint64)
        np.cumsum(mix(self.items, 31), out=run[1:])
        total = run[self.bounds[1:]] - run[self.bounds[:-1]]
        return mix(total + self.sizes.astype(np.uint64), 37).astype(np.int64) & ~np.int64(1)

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """Parities of hashed cells: bytes of all sketches, and their bounds. A set of ``a`` shingles has
        the power of two from ``2.4 a`` cells, 64 at least; a sketch folds to half its cells by xor."""
        cells = sketch_cells(self.sizes)
        base = _bounds(cells)
        at = np.repeat(base[:-1], self.sizes) + (self.items & np.repeat(cells - 1, self.sizes).astype(np.uint64)).astype(np.int64)
        parity = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
        return np.packbits(parity, bitorder="little"), base // 8


def sketch_cells(sizes: np.ndarray) -> np.ndarray:
    return (1 << np.maximum(6, np.ceil(np.log2(np.maximum(2.4 * sizes, 1))).astype(np.int64))).astype(np.int64)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words, from prefix sums over runs of bounded length."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _RUN, side="right")))
        first = start[i]
        n = int(end[j - 1] - first)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((low[first : first + n].astype(np.uint64) + np.uint64(1)) * powers("up", n), out=run[1:])
        at = start[i:j] - first
        out[i:j] = (run[end[i:j] - first] - run[at]) * powers("down", n + 1)[at]
        i = j
    return out


def shingle_sets(texts: pa.Array) -> Sets:
    """Sets of all texts (null: empty). Only A-Z are lower-cased; words end at ASCII white space."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    begin = offsets - offsets[0]
    low, space = _LOWER[raw], _SPACE[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:] = np.concatenate([space[:-1], [True]]) if len(raw) else edge[1:]
    edge[begin] = True
    start = np.flatnonzero(~space & edge[:-1])
    last = np.ones(len(raw) + 1, bool)
    last[: len(raw)] = space
    last[begin] = True
    end = np.flatnonzero(~space & last[1:]) + 1
    h = mix(_word_hashes(low, start, end), 5)
    words = np.searchsorted(start, begin)
    n_words = np.diff(words)
    n = len(h)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    for j in range(WORDS):
        total += padded[j : n + j] * _MULTIPLIERS[j]
    whole = np.ones(n, bool)
    for j in range(1, WORDS):
        at = words[1:] - j
        whole[at[at >= 0]] = False
    values, owner = mix(total[whole], 7 + WORDS), np.repeat(np.arange(len(n_words)), np.maximum(n_words - WORDS + 1, 0))
    short = [(w, np.flatnonzero(n_words == w)) for w in range(1, WORDS)]
    if any(len(rows) for _, rows in short):
        for w, rows in short:
            part = np.zeros(len(rows), np.uint64)
            for j in range(w):
                part += h[words[rows] + j] * _MULTIPLIERS[j]
            values, owner = np.concatenate([values, mix(part, 7 + w)]), np.concatenate([owner, rows])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    bounds = _bounds(np.bincount(owner, minlength=len(n_words)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return Sets(values, bounds).only(new)


def read_sets(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, Sets]]:
    """(first row, end row, sets) of slices of a batch with about ``most`` bytes of text; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index("text"))
    for lo, hi in ranges(pc.binary_length(column).to_pylist(), most):
        yield lo, hi, shingle_sets(column.slice(lo, hi - lo))


# Signatures -----------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def band(size: int) -> int:
    """Band of a set size: band ``i`` begins at ``begin(i)``."""
    i = 0
    while begin(i + 1) <= size:
        i += 1
    return i


@lru_cache(maxsize=1000)
def begin(i: int) -> int:
    """Bands begin one above the largest partner of the band before: a link never skips a band."""
    return 1 if i == 0 else begin(i - 1) * 100 // PERCENT + 1


def most_differing(size: int, partner: int) -> int:
    """Shingles in which a set of ``size`` and one of at most ``partner`` may differ and be linked."""
    return (100 - PERCENT) * (size + partner) // (100 + PERCENT)


@lru_cache(maxsize=100_000)
def plan(size: int, below: int) -> tuple[int, int]:
    """(band, most differing shingles) of a set in its own band, or (``below``) in the band before, where
    its partners are smaller than its own band's sets."""
    i = band(size) - below
    return i, most_differing(size, begin(i + 1) - 1 if below else size * 100 // PERCENT)


#: Bands whose links differ in so few shingles enumerate all subsets of one partition's parts.
_FEW = 3
#: Parts that such a subset holds.
_HELD = 4


@lru_cache(maxsize=1000)
def widest(i: int) -> int:
    """Most differing shingles of a link that meets in band ``i``."""
    high = begin(i + 1) - 1
    return most_differing(high, high * 100 // PERCENT)


@lru_cache(maxsize=1000)
def spare(i: int, most: int) -> int:
    """Signatures that partners of band ``i`` share at least. Sets of few shingles fill too few partitions for more."""
    return 1 if begin(i) < 9 * most else most


@lru_cache(maxsize=10_000)
def partitions(i: int, share: float, most: int) -> int:
    """First-level partitions of band ``i``: as few as leave its largest sets, with ``share`` of their shingles,
    enough solid ones but for bad luck (two standard deviations); of small sets as many as come nearest to that."""
    size = begin(i + 1) - 1
    need = widest(i) // 2 + spare(i, most)
    best = (-math.inf, need)
    n = need
    while n < 2 * size + 4:
        q = math.exp(-size * share / n / 3)
        solid = 1 - q**3 - 3 * q * q * (1 - q)
        sure = n * solid - 2 * math.sqrt(n * solid * (1 - solid))
        if sure >= need:
            return n
        best = max(best, (sure, n))
        n += max(1, n // 64)
    return best[1]


def contents(sets: Sets, n: np.ndarray) -> np.ndarray:
    """Hashes of what the parts of each set hold, set after set, if it is cut into ``n`` parts; 0 for an empty part.

    The parts follow the order of the items, so what a part holds is a run of them.
    """
    base = _bounds(n)
    part = ((sets.items >> np.uint64(32)) * np.repeat(n, sets.sizes).astype(np.uint64)) >> np.uint64(32)
    at = base[:-1][sets.owner] + part.astype(np.int64)
    held = np.zeros(int(base[-1]), np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        # The number of the part counts too: equal items in other parts don't make equal signatures.
        held[at[first]] = mix(np.add.reduceat(mix(sets.items, 200), first) + part[first] * np.uint64(0xC2B2AE3D27D4EB4F), 201)
    return held


def all_subsets(sets: Sets, differ: int, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``subsets``, of a single partition of ``differ + 4`` parts: in any four of them that don't differ, partners agree."""
    n = differ + _HELD
    held = contents(sets, np.full(len(sets), n)).reshape(len(sets), n)
    out, owners = [], []
    for j, four in enumerate(itertools.combinations(range(n), _HELD)):
        some = held[:, four]
        full = np.flatnonzero((some != 0).any(axis=1))
        out.append(mix(some[full].sum(axis=1, dtype=np.uint64) + tag[full] + np.uint64(j), 300))
        owners.append(full)
    return np.concatenate(out), np.concatenate(owners), (held != 0).sum(axis=1) > differ


def subsets(sets: Sets, n: np.ndarray, need: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their owners, whether a set has ``need`` solid partitions) of sets cut into ``n`` partitions each."""
    held = contents(sets, 3 * n).reshape(-1, 3)
    solid = (held != 0).sum(axis=1) >= 2
    run = np.concatenate([[0], np.cumsum(solid)])
    begins = _bounds(n)
    have = run[begins[1:]] - run[begins[:-1]]
    owner = np.repeat(np.arange(len(n)), n)
    signed = run[:-1] - run[begins[:-1]][owner] < need[owner]
    held, owner = held[signed], owner[signed]
    out, owners = [], []
    for j, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = held[:, x], held[:, y]
        full = (a | b) != 0
        out.append(mix(a[full] + b[full] + tag[owner[full]] + np.uint64(j), 300))
        owners.append(owner[full])
    return np.concatenate(out), np.concatenate(owners), have >= need


def signatures(whole: Sets, rest: Sets, cfg: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their owners, marks, their owners) of non-empty sets, whose infrequent shingles are ``rest``.

    Owners are ``2 * row + below``. A set takes further cuttings, and then its whole set, until it has enough
    solid partitions. Sets that nothing else is enough for sign their first shingles and are marked with the band's number.
    """
    sigs, owners, marks, marked = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
    sizes = whole.sizes.tolist()
    for below in (0, 1):
        plans = [plan(a, below) if below == 0 or band(a) else (0, 0) for a in sizes]
        bands, differ = np.array([p[0] for p in plans], np.int64), np.array([p[1] for p in plans], np.int64)
        few = np.array([widest(i) for i in bands.tolist()], np.int64)
        need = differ // 2 + np.array([spare(i, cfg.spare) for i in bands.tolist()], np.int64)
        # Sets whose partners must be equal need no signature: equal sets are one class.
        todo = np.flatnonzero(differ > 0)
        for seed in range(2 * cfg.cuttings):
            on_whole, cutting = divmod(seed, cfg.cuttings)
            weak = []
            for k in (*range(1, _FEW + 1), None):
                rows = todo[few[todo] == k] if k else todo[few[todo] > _FEW]
                if not len(rows):
                    continue
                mask = np.zeros(len(whole), bool)
                mask[rows] = True
                some = recut((whole if on_whole else rest).where(mask), cutting)
                tag = mix(bands[rows].astype(np.uint64) * np.uint64(64) + np.uint64(seed), 202)
                if k:
                    sig, own, enough = all_subsets(some, k, tag)
                else:
                    n = [partitions(i, 1.0 if on_whole else cfg.infrequent_share, cfg.spare) for i in bands[rows].tolist()]
                    sig, own, enough = subsets(some, np.array(n, np.int64), need[rows], tag)
                sigs.append(sig)
                owners.append(2 * rows[own] + below)
                weak.append(rows[~enough])
            todo = np.sort(np.concatenate([*weak, np.zeros(0, np.int64)]))
        marks.append(bands[todo])
        marked.append(2 * todo + below)
        left = np.zeros(len(whole), bool)
        left[todo] = True
        some = whole.where(left)
        own = some.owner
        first = np.arange(len(some.items)) - some.bounds[:-1][own] <= differ[todo][own]
        sigs.append(mix(some.items[first] + mix(bands[todo].astype(np.uint64) * np.uint64(64) + np.uint64(63), 202)[own[first]], 300))
        owners.append(2 * todo[own[first]] + below)
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(marks), np.concatenate(marked)


def recut(sets: Sets, cutting: int) -> Sets:
    """The items as another cutting sees them: hashed anew and put in order."""
    if not cutting:
        return sets
    items = mix(sets.items, 100 + cutting)
    return Sets(items[np.lexsort((items, sets.owner))], sets.bounds)


# Bitmaps ----------------------------------------------------------------------------------


def bitmap(numbers: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size of the numbers' low bits, put together by native aggregates: at most
    ``2**bits / 32768`` rows of 4 KB reach the driver."""
    low = numbers.select((F.col(column).bitwiseAND((1 << bits) - 1)).alias("x"))
    rows = low.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m")).collect()
    out = np.zeros(((1 << bits) // 32768 + 2) * 4096, np.uint8)
    for r in rows:
        # Buckets count from 1 for positive numbers and hold 0 at their own start.
        out[r.b * 4096 : r.b * 4096 + len(r.m)] |= np.frombuffer(bytes(r.m), np.uint8)
    return out


def in_bitmap(x: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    low = (x & np.uint64((1 << n) - 1)).astype(np.int64)
    bucket, position = _place(low)
    return (bits[bucket * 4096 + (position >> 3)] >> (position & 7).astype(np.uint8)) & 1 == 1


def _place(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spark's bucket and bit of a number: 1 to 32768 are bits 0 to 32767 of bucket 1; 0 is bit 0 of bucket 0."""
    bucket = np.where(low > 0, 1 + (low - 1) // 32768, 0)
    return bucket, np.where(low > 0, (low - 1) % 32768, 0)


# Passes over the texts ----------------------------------------------------------------------


def often_held(sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(item as a signed number, number of sets) of the items that so many of the sets hold. Empties ``sets``."""
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    sets.clear()
    every.sort()
    last = max(0, len(every) - least + 1)
    values = np.unique(every[:last][every[:last] == every[least - 1 :]])
    counts = np.searchsorted(every, values, side="right") - np.searchsorted(every, values)
    return list(zip(values.astype(np.int64).tolist(), counts.tolist(), strict=True))


_HOT = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("n", T.LongType())]))


def survey(docs: DataFrame, cfg: Settings) -> DataFrame:
    """The columns of ``docs`` but the text, with n_shingles, cls, sketch and hot: the class null for an empty set;
    ``hot`` the frequent shingles of the slice that ends at a row."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            seen: set[int] = set()
            n_held = 0
            for lo, hi, sets in read_sets(batch, cfg.text_bytes):
                sizes, classes = sets.sizes, sets.classes()
                # Each class counts once, so that copies alone make nothing frequent.
                new = np.zeros(len(sets), bool)
                for i in np.flatnonzero(sizes > 0).tolist():
                    if (c := int(classes[i])) not in seen:
                        seen.add(c)
                        new[i] = True
                held.append(sets.where(new).items)
                n_held += len(held[-1])
                hot: list = [None] * (hi - lo)
                if n_held > cfg.counted or hi == batch.num_rows:
                    hot[-1] = [{"x": x, "n": n} for x, n in often_held(held, cfg.batch_frequent)]
                    n_held = 0
                raw, bounds = sets.sketches()
                sketch = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sets), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                cls = pa.array(classes, pa.int64(), mask=sizes == 0)
                sketch = pc.if_else(pc.is_null(cls), None, sketch)
                cut = batch.slice(lo, hi - lo)
                kept_columns = [cut.column(cut.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(sizes, pa.int64()), cls, sketch, pa.array(hot, pa.list_(pa.struct([("x", pa.int64()), ("n", pa.int64())])))], names=[*kept, "n_shingles", "cls", "sketch", "hot"])

    new = [T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("hot", _HOT)]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *new]))


#: Bits of a class by which its signatures name it.
_OWNER = (1 << 48) - 1
_MARKS = -1


def packed(sig: np.ndarray, owner: np.ndarray, n_buckets: int) -> pa.RecordBatch | None:
    """A row for each bucket: its owners (48 bits), how many signatures each has there, and 32 bits of each signature."""
    if not len(sig):
        return None
    bucket = ((sig >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    order = np.lexsort((owner, bucket))
    sig, owner, bucket = sig[order].astype(np.uint32), owner[order], bucket[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(head, len(sig))).astype(np.uint32)
    at, own = bucket[head], owner[head]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    rows = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(head)], strict=True):
        begin, end = head[lo], head[hi] if hi < len(head) else len(sig)
        rows.append((int(at[lo]), halves(own[lo:hi]), n[lo:hi].tobytes(), sig[begin:end].tobytes()))
    return _packed_batch(rows)


_PACKED = "bucket long, own binary, n binary, sig binary"


def _packed_batch(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "own", "n", "sig"])


def halves(own: np.ndarray) -> bytes:
    own = own.astype(np.uint64)
    return own.astype(np.uint32).tobytes() + (own >> np.uint64(32)).astype(np.uint16).tobytes()


def whole_owners(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw[: 4 * n], np.uint32).astype(np.int64) | (np.frombuffer(raw[4 * n :], np.uint16).astype(np.int64) << 32)


#: Classes a worker remembers having signed: a copy's signatures would say nothing new.
_SIGNED = 1_000_000


def sign(docs: DataFrame, frequent: np.ndarray, n_buckets: int, cfg: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        sigs, owners, held = [], [], 0
        for batch in batches:
            for _, _, sets in read_sets(batch, cfg.text_bytes):
                classes = sets.classes()
                new = sets.sizes > 0
                for i in np.flatnonzero(new).tolist():
                    c = int(classes[i])
                    new[i] = c not in signed
                    signed.add(c)
                if len(signed) >= _SIGNED:
                    signed.clear()
                some, ids = sets.where(new), classes[new] & _OWNER
                if not len(some):
                    continue
                rest = some.only(~in_bitmap(some.items, frequent, cfg.bitmap_bits))
                sig, own, mark, marked = signatures(some, rest, cfg)
                sigs.append(sig)
                owners.append(ids[own >> 1] | (own & 1))
                held += len(sig)
                if len(mark):
                    yield _packed_batch([(_MARKS, halves(ids[marked >> 1] | (marked & 1)), np.ones(len(mark), np.uint32).tobytes(), mark.astype(np.uint32).tobytes())])
                if held > cfg.held:
                    yield packed(np.concatenate(sigs), np.concatenate(owners), n_buckets)
                    sigs, owners, held = [], [], 0
        if held:
            yield packed(np.concatenate(sigs), np.concatenate(owners), n_buckets)

    return docs.select("text").mapInArrow(run, _PACKED)


def groups(signed: DataFrame, sizes: DataFrame, cfg: Settings) -> DataFrame:
    """(gid, cls) of the groups of two owners or more that can hold a link; groups of the same owners are one group. Of crowded
    groups only the owners with too many of them are left. ``sizes``: (cls, n_shingles) of all classes."""

    def run(table: pa.Table) -> pa.Table:
        marks = len(table) > 0 and table.column("bucket")[0].as_py() == _MARKS
        owners = np.concatenate([whole_owners(x.as_buffer().to_pybytes()) for x in table.column("own")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("n")])
        sig = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("sig")])
        order = np.argsort(sig)
        sig = sig[order]
        twin = np.zeros(len(sig), bool)
        twin[1:] = sig[1:] == sig[:-1]
        twin[:-1] |= twin[1:]
        sig = sig[twin]
        own = owners[np.searchsorted(np.cumsum(n, dtype=np.int64), order[twin], side="right")]
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[new], own[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        gid = mix(np.add.reduceat(mix(own.astype(np.uint64), 41), first) + size.astype(np.uint64), 43).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        crowd = (size > cfg.crowded) & (not marks)
        # How often an owner is in a crowd; a marked one may share a single signature with a partner.
        burden, times = np.unique(own[np.repeat(crowd, size)], return_counts=True)
        if marks:
            burden = np.unique(owners)
            times = np.full(len(burden), cfg.spare)
        keep = np.zeros(len(first), bool)
        keep[np.unique(gid, return_index=True)[1]] = True
        keep &= (size > 1) & ~crowd & (not marks)
        rows = np.repeat(keep, size)
        crowd_gid, crowd_own = crowds([own[a : a + n] for a, n in zip(first[crowd].tolist(), size[crowd].tolist(), strict=True)])
        gids = np.concatenate([np.repeat(gid, size)[rows], crowd_gid, np.zeros(len(burden), np.int64)])
        n_rows, n_crowd = int(rows.sum()), len(crowd_own)
        return pa.table({
            "gid": pa.array(gids, mask=np.arange(len(gids)) >= n_rows + n_crowd),
            "own": pa.array(np.concatenate([own[rows], crowd_own, burden])),
            "crowd": pa.array(np.concatenate([np.zeros(n_rows, bool), np.ones(n_crowd, bool), np.zeros(len(burden), bool)])),
            "n": pa.array(np.concatenate([np.zeros(n_rows + n_crowd, np.int64), times])),
        })

    found = compact(signed.groupBy("bucket").applyInArrow(run, "gid long, own long, crowd boolean, n long"))
    name = F.col("own").bitwiseAND(F.lit(_OWNER - 1))
    owners = sizes.withColumn("name", F.col("cls").bitwiseAND(F.lit(_OWNER - 1)))
    # Bands up to ``last`` share one signature at least, those above ``cfg.spare``.
    last = max((i for i in range(99) if spare(i, cfg.spare) < cfg.spare), default=-1)
    small = F.col("n_shingles") < F.when(F.col("own").bitwiseAND(F.lit(1)) == 1, begin(last + 2)).otherwise(begin(last + 1))
    loads = found.where("gid is null").groupBy("own").agg(F.sum("n").alias("n")).withColumn("name", name)
    burdened = loads.join(owners, "name").where(small | (F.col("n") >= cfg.spare)).select("own").distinct()
    some = found.where("gid is not null")
    left = some.where("not crowd").select("gid", "own").unionByName(some.where("crowd").join(burdened, "own", "left_semi").select("gid", "own"))
    return left.select("gid", name.alias("name")).distinct().join(owners.select("name", "cls"), "name").select("gid", "cls")


def crowds(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(gid, own) of crowded groups, of which those that have half of their members in common are one.

    A large family of near copies has a crowd for each of its signatures, all of about the same members.
    """
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.unique(np.concatenate(members))
    home = np.full(len(every), -1, np.int64)
    gids, owns, n = [], [], 0
    for own in sorted(members, key=len, reverse=True):
        at = np.searchsorted(every, own)
        known, count = np.unique(home[at][home[at] >= 0], return_counts=True)
        if len(count) and 2 * count.max() >= len(own):
            gid = int(known[count.argmax()])
        else:
            gid, n = n, n + 1
        home[at[home[at] < 0]] = gid
        gids.append(np.full(len(own), gid, np.int64))
        owns.append(at)
    pairs = np.unique(np.concatenate(gids) * len(every) + np.concatenate(owns))
    gid, own = pairs // len(every), every[pairs % len(every)]
    first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    names = mix(np.add.reduceat(mix(own.astype(np.uint64), 41), first) + np.uint64(1), 44).astype(np.int64)
    return names[gid], own


def class_sets(docs: DataFrame, classes: DataFrame, cfg: Settings) -> DataFrame:
    """(cls, items) of the given classes. The bitmap spares shuffling sets that nothing is compared with."""
    bits = bitmap(classes, "cls", cfg.bitmap_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for _, _, sets in read_sets(batch, cfg.text_bytes):
                classes = sets.classes()
                ids, items = [], []
                for i in np.flatnonzero((sets.sizes > 0) & in_bitmap(classes.astype(np.uint64), bits, cfg.bitmap_bits)).tolist():
                    if (c := int(classes[i])) not in given:
                        given.add(c)
                        ids.append(c)
                        items.append(sets[i].tobytes())
                if len(given) >= _SIGNED:
                    given.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["cls", "items"])

    return docs.select("text").mapInArrow(run, "cls long, items binary").join(classes, "cls", "left_semi").groupBy("cls").agg(F.first("items").alias("items"))


# Comparisons ----------------------------------------------------------------------------------


class Sketched:
    """Sketches of several sets, each also folded to half its cells."""

    def __init__(self, columns: list[pa.Array], sizes: np.ndarray):
        raw = [np.frombuffer(x, np.uint64) for c in columns for x in c.to_pylist()]
        self.sizes = sizes
        self.length = np.array([len(x) for x in raw], np.int64)
        folded = [x[: len(x) // 2] ^ x[len(x) // 2 :] for x in raw]
        self.words = np.concatenate([*raw, *folded, np.zeros(0, np.uint64)])
        at = _bounds(np.concatenate([self.length, [len(x) for x in folded]]))
        self.start, self.half = at[: len(raw)], at[len(raw) : 2 * len(raw)]

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cells in which the pairs (i, j) differ; -1 where their sizes or so many cells allow no link."""
        a, b = self.sizes[i], self.sizes[j]
        out = np.full(len(i), -1, np.int64)
        some = np.flatnonzero(100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
        width = np.minimum(self.length[i[some]], self.length[j[some]])
        for w in np.unique(width).tolist():
            rows = some[width == w]
            step = max(1, (1 << 19) // w)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                x, y = (np.where(self.length[k] == w, self.start[k], self.half[k])[:, None] + np.arange(w) for k in (i[part], j[part]))
                differ = np.bitwise_count(self.words[x] ^ self.words[y]).sum(axis=1, dtype=np.int64)
                out[part] = np.where((100 + PERCENT) * differ <= (100 - PERCENT) * (a[part] + b[part]), differ, -1)
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.differing(i, j) >= 0


def forest(i: np.ndarray, j: np.ndarray, differ: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) that join the labels they reach, the pairs that differ least first: at most one
    less than there are labels."""
    part = np.unique(label, return_inverse=True)[1]
    order = np.lexsort((np.arange(len(i)), differ))
    taken = []
    while True:
        a, b = part[i[order]], part[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            return np.concatenate([*taken, np.zeros(0, np.int64)]).astype(np.int64)
        ends = np.stack([a, b], axis=1).ravel()
        best = np.unique(np.unique(ends, return_index=True)[1] // 2)
        taken.append(order[best])
        root = np.arange(part.max() + 1)
        for x, y in zip(a[best].tolist(), b[best].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
        part = root[part]


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sketches allow a link."""
    x = classes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("x"))
    y = classes.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("y"))
    both = pairs.join(y, "b").join(x, "a").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                cut = batch.slice(lo, 2048)
                a, b, na, nb, x, y = cut.columns
                n = cut.num_rows
                got = Sketched([x, y], np.concatenate([na.to_numpy(), nb.to_numpy()])).may_link(np.arange(n), np.arange(n, 2 * n))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(got))

    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough."""
    x = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    both = pairs.join(y, "b").join(x, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= PERCENT * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def star(found: DataFrame) -> DataFrame:
    """(a, b): the least class of each group with all its others."""
    return found.groupBy("gid").agg(F.min("cls").alias("a")).join(found.withColumnRenamed("cls", "b"), "gid").where("a != b").select("a", "b").coalesce(parts_for(found.sparkSession, found.count())).distinct()


def still_open(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(gid, cls, label) of the groups that span several components."""
    parts = parts_for(found.sparkSession, found.count())
    named = found.join(labels, found.cls == labels.node, "left").select("gid", "cls", F.coalesce("label", "cls").alias("label")).coalesce(parts)
    spread = named.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("gid")
    return named.join(spread, "gid", "left_semi").coalesce(parts)


#: The rounds in which groups that span several components are compared.
ALONE, ACROSS, EVERY = "each block alone", "all pairs of blocks", "all pairs of classes"


def open_pairs(rows: DataFrame, classes: DataFrame, cfg: Settings, how: str) -> DataFrame:
    """(a, b, gid): pairs of one group and of different components whose sketches allow a link, and the groups (without a
    pair) that need the next round.

    The classes of the component that has most of a group, and the others, are dealt into blocks of ``cfg.block``; blocks of
    that component meet only those of the others, as all pairs within it are joined already. The first two rounds give of each task a
    forest of the pairs that differ least, and name the groups in which there are more; the last gives all.
    A task holds two blocks at most.
    """
    counts = rows.groupBy("gid", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("gid").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    blocks_of = lambda c: F.ceil(c / cfg.block).cast("int")
    small = F.col("n_all") <= cfg.block
    m, k = F.when(small, 1).otherwise(blocks_of(F.col("n_main"))), F.when(small, 0).otherwise(blocks_of(F.col("n_all") - F.col("n_main")))
    # A group that fits into a block is one block; there all classes count as the main component's.
    main = main.select("gid", F.when(~small, F.col("main")).alias("main"), m.alias("m"), k.alias("k"))
    is_main, at = F.coalesce(F.col("label") == F.col("main"), F.lit(True)), F.hash("cls")
    part = F.when(is_main, F.pmod(at, F.col("m"))).otherwise(F.col("m") + F.pmod(at, F.greatest(F.col("k"), F.lit(1))))
    dealt = rows.join(main, "gid").withColumn("part", part).withColumn("n", F.col("m") + F.col("k"))
    if how == ALONE:
        dealt = dealt.select("gid", F.col("part").alias("p"), F.col("part").alias("q"), "part", "n", "cls", "label")
    else:
        first = F.when(is_main & (F.col("k") > 0), F.col("m")).otherwise(0)
        dealt = dealt.withColumn("other", F.explode(F.sequence(first, F.col("n") - 1)))
        dealt = dealt.select("gid", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "n", "cls", "label")
    full = dealt.join(classes.select("cls", "n_shingles", "sketch"), "cls").repartition("gid", "p", "q").sortWithinPartitions("gid", "p", "q")
    names = ["gid", "p", "q", "part", "n", "cls", "label", "n_shingles", "sketch"]

    def compare(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        gid, p, q, part, blocks, cls, label, size = (table.column(c).to_numpy() for c in names[:8])
        first = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(gid) else np.zeros(0, np.int64)
        sketches = Sketched([table.column("sketch")], size)
        out = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(gid)], strict=True):
            i, j = _halfway(hi - lo) if hi - lo <= 64 else np.triu_indices(hi - lo, 1)
            i, j = i + lo, j + lo
            # Pairs within one block belong to the task of that block alone.
            ok = (label[i] != label[j]) & ((p[lo] == q[lo]) | (part[i] != part[j]))
            out.append((i[ok], j[ok], np.full(int(ok.sum()), len(out))))
        i, j, task = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1, 2))
        differ = sketches.differing(i, j)
        ok = differ >= 0
        i, j, task, differ = i[ok], j[ok], task[ok], differ[ok]
        more = np.zeros(0, np.int64)
        if how != EVERY and len(i):
            # A label is another one in another task.
            number = np.unique(label, return_inverse=True)[1] + len(label) * (np.searchsorted(first, np.arange(len(gid)), side="right") - 1)
            own = forest(i, j, differ, number)
            more = gid[first[np.flatnonzero(np.bincount(task, minlength=len(first)) > np.bincount(task[own], minlength=len(first)))]]
            i, j = i[own], j[own]
        if how == ALONE:
            more = np.concatenate([more, gid[first[blocks[first] > 1]]])
        i, j, more = cls[i], cls[j], np.unique(more)
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
        none = np.zeros(len(more), np.int64)
        is_pair = np.arange(len(pairs) + len(more)) < len(pairs)
        cols = [pa.array(np.concatenate([pairs[:, 0], none]), mask=~is_pair), pa.array(np.concatenate([pairs[:, 1], none]), mask=~is_pair), pa.array(np.concatenate([np.zeros(len(pairs), np.int64), more]), mask=is_pair)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "gid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole tasks are taken from the sorted rows; the last one of a batch may go on in the next.
        waiting: list[pa.Table] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                waiting.append(pa.Table.from_batches([batch.slice(lo, 4096)]))
                table = pa.concat_tables(waiting).combine_chunks()
                key = [table.column(c).to_numpy() for c in ("gid", "p", "q")]
                same = np.logical_and.reduce([k == k[-1] for k in key])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield compare(table.slice(0, cut))
                waiting = [table.slice(cut)]
        if waiting:
            yield compare(pa.concat_tables(waiting))

    return full.select(*names).mapInArrow(run, "a long, b long, gid long").distinct()


@lru_cache(maxsize=100)
def _halfway(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


# Components ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b) reaches. Alternating large-star
    and small-star passes; each is one grouped minimum and one join, and none gathers a component."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    parts = parts_for(edges.sparkSession, now.count())
    now, before = now.coalesce(parts), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v")
        now = checkpointed(small.coalesce(parts).distinct().coalesce(parts))
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct().coalesce(parts))
        before = state


def link_classes(docs: DataFrame, cfg: Settings, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of all classes that have a link."""
    hot = rows.where("hot is not null").select(F.explode("hot").alias("h")).groupBy("h.x").agg(F.sum("h.n").alias("n")).where(F.col("n") >= cfg.frequent)
    frequent = bitmap(hot, "x", cfg.bitmap_bits)
    # A set signs about as often as it has shingles.
    n_signatures = classes.agg(F.sum("n_shingles")).first()[0] or 0
    signed = sign(docs, frequent, max(8, n_signatures // cfg.bucket), cfg)
    found = compact(groups(signed, classes.select("cls", "n_shingles"), cfg))
    near = compact(alike(star(found), classes))
    sets = compact(class_sets(docs, near.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), cfg))
    # One comparison joins a class to its group, if anything does; the others wait for the components.
    links = compact(linked(near.groupBy("b").agg(F.min("a").alias("a")), sets))
    for how in (ALONE, ACROSS, EVERY):
        given = compact(open_pairs(still_open(found, components(links)), classes, cfg, how))
        more = given.where("gid is null").select("a", "b")
        other = more.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls", "left_anti")
        if not other.isEmpty():
            sets = sets.unionByName(compact(class_sets(docs, compact(other), cfg)))
        links = compact(links.unionByName(linked(more, sets)))
        # A group whose pairs have all been compared is done.
        left = given.where("gid is not null").select("gid")
        if how == EVERY or left.isEmpty():
            return components(links)
        found = compact(found.join(left, "gid", "left_semi"))


def joined_back(left: DataFrame, right: DataFrame, key: str, weight: Column, total: int) -> DataFrame:
    """``left`` joined with ``right`` (one row for each key), whose keys of a thousandth of all rows are broadcast:
    they are a thousand at most, and no task gets all rows of one."""
    heavy = weight >= max(1000, total // 1000)
    many, few = F.broadcast(right.where(heavy)), right.where(~heavy)
    light = left.join(F.broadcast(right.where(heavy).select(key)), key, "left_anti")
    return left.join(many, key).unionByName(light.join(few, key))


def named(docs: DataFrame, first: Column, cfg: Settings) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, classes, components, number of rows): the survey of ``docs``; its classes with the least ``first`` of their
    rows; (label, cls, n_classes, least) with the least one of the component that each class lies in."""
    rows = checkpointed(survey(docs, cfg))
    some = rows.where("cls is not null")
    classes = compact(some.groupBy("cls").agg(F.min(first).alias("least"), F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    labels = link_classes(docs, cfg, rows, classes)
    of_class = compact(classes.join(labels, classes.cls == labels.node, "left").select("cls", "n_rows", "least", F.coalesce("label", "cls").alias("label")))
    return rows, of_class, of_class.groupBy("label").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("n_classes")), rows.count()


def join(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows, of_class, parts, total = named(docs.select("doc_id", "text"), F.col("doc_id"), cfg or Settings())
    rows = rows.select("doc_id", "n_shingles", "cls")
    best = joined_back(of_class.select("cls", "n_rows", "label"), compact(parts), "label", F.col("n_classes"), total).select("cls", "n_rows", "best")
    got = joined_back(rows.where("cls is not null"), compact(best), "cls", F.col("n_rows"), total)
    alone = rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return got.select("doc_id", "n_shingles", F.col("best").alias("component_id")).unionByName(alone)


def keep_one(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest id stays (rows without an id come last, rows of
    one id go by a hash of their columns), of equal rows one. Documents with empty sets all stay.

    The choice is made on ids and hashes; texts are moved once, by the semi join at the end.
    """
    names = docs.columns
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    marked = docs.withColumn("__row", F.xxhash64(*plain))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    rows, _, parts, _ = named(marked.select("doc_id", "__row", "text"), first, cfg or Settings())
    parts = compact(parts.select("best.doc_id", "best.__row"))
    empty = rows.where("cls is null").select("doc_id", "__row").distinct()
    chosen = parts.unionByName(empty).withColumnsRenamed({"doc_id": "__id", "__row": "__of"})
    kept = marked.join(chosen, marked.doc_id.eqNullSafe(chosen["__id"]) & (marked["__row"] == chosen["__of"]), "left_semi")
    # Rows that are equal in everything are rare; only where there are any, texts are looked at again.
    twins = rows.where("cls is not null").groupBy("doc_id", "__row").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("__row").alias("__of"))
    if twins.isEmpty():
        return kept.select(*names)
    twins = checkpointed(twins)
    same = kept.doc_id.eqNullSafe(twins["__id"]) & (kept["__row"] == twins["__of"])
    return kept.join(twins, same, "left_anti").unionByName(kept.join(twins, same, "left_semi").dropDuplicates(["doc_id", "__row"])).select(*names)
