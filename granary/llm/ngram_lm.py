"""Operator 1: interpolated modified Kneser-Ney n-gram model, counted in Spark.

Counting.  A gram of order m is (context of m - 1 words, word), both as 64-bit hashes.  Map tasks
sort and count the highest-order grams of their texts with numpy and send one packed block to each
bucket; a bucket is a range of gram ids, so a bucket's task merges its blocks into one sorted array.
It then knows the statistics of its contexts, and sends each distinct gram on, without its first
word, to the next lower order, whose counts are the number of distinct left neighbours (grams that
begin a text keep their frequency).  The orders are a chain of exchanges of packed blocks.

All orders above the first go by passes over the texts, each for the grams whose last word follows
one share of the words: a gram and all its endings but the single word belong to one pass, and the
exchanges of a pass leave the disks before the next one's.  The first order follows the passes.

Gram ids begin with the pass and keep the grams of a context together (24 bits of pass and context,
40 of the gram), so context statistics are complete within a bucket.  Contexts that a small sample shows to be very frequent
are spread over all buckets of their pass by the full hash of the gram; their statistics, for at most HOT contexts
of each order, are added up on the driver.  Which contexts these are changes no count and no score.

Storage.  Each bucket is one file of sorted hash arrays in the shared folder, named in the manifest
that the job commits.  Scoring tasks map the files into memory and look sorted queries up, so a
model of any size costs a worker no heap.
"""

from __future__ import annotations

import functools
import gc
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, new_folder, open_folder, others, session_partitions, tidy, written
from .textops import hash_tokens, mix64, slices, text_buffers

U = np.uint64
#: Order of the production model.
ORDER = 3
#: The texts are passed over 2**PASS_BITS times.
PASS_BITS = 3
#: Tokens counted in memory before a map task sends its blocks.
FLUSH_TOKENS = 1 << 22
#: Share of rows whose contexts are looked at to find frequent ones, in 1 / SAMPLE.
SAMPLE = 64
#: Contexts of one order that are spread over the buckets, at most.
HOT = 512
#: Tokens of the corpus for each bucket, at most by the sample's count, so that a bucket fits a task's memory.
BUCKET_TOKENS = 1 << 23
#: Files that a worker holds open, at most; those that cannot be mapped take memory.
OPEN_FILES = 4096
#: Bytes of text scored at once.
SCORE_BYTES = 1 << 21

END, PAD = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
_STEP = U(0xA24BAED4963EE407)


def _chain(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """The hash of a context, from the hash of its later words and its first word."""
    return mix64(newer * _STEP + mix64(older + _STEP))


def pass_of(previous: np.ndarray) -> np.ndarray:
    """The pass of the grams whose last word follows these words."""
    return mix64(previous ^ _STEP) >> U(64 - PASS_BITS)


def _in_pass(ids: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """The ids moved into the range of their pass."""
    return pass_of(previous) << U(64 - PASS_BITS) | ids >> U(PASS_BITS)


def grams(words: np.ndarray, counts: np.ndarray, order: int, only: int | None = None) -> list[np.ndarray]:
    """Columns (context of order - 1 words, ..., context of 1 word, word) for every token of
    consecutive texts, or of pass `only`; each text gets an end token, and pads stand before it."""
    texts, pads = len(counts), order - 1
    place = np.arange(len(words)) + np.repeat(np.arange(texts), counts) * (pads + 1) + pads
    ends = np.cumsum(counts + pads + 1) - 1
    padded = np.full(len(words) + texts * (pads + 1), PAD, U)
    padded[place], padded[ends] = words, END
    tokens = np.ones(len(padded), bool)
    starts = ends - counts - pads
    for k in range(pads):
        tokens[starts + k] = False
    at = np.flatnonzero(tokens)
    if only is not None:
        at = at[pass_of(padded[at - 1]) == U(only)]
    columns = [padded[at]]
    context = None
    for k in range(1, order):
        word = padded[at - k]
        context = word if context is None else _chain(word, context)
        columns.insert(0, context)
    return columns


def pad_contexts(order: int) -> list[int]:
    """Hashes of the contexts of order - 1, ..., 1 pads."""
    out, context = [], None
    for _ in range(1, order):
        context = np.array([PAD]) if context is None else _chain(np.array([PAD]), context)
        out.insert(0, int(context[0]))
    return out


def gram_ids(columns: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """Ids of grams, given as the columns of grams() from their order's on; those of the contexts in
    `hot` (ascending) are spread, others stay together."""
    if len(columns) == 1:
        return columns[0]
    context, previous, word = columns[0], columns[-2], columns[-1]
    full = mix64(context * _STEP ^ word)
    near = mix64(context) >> U(40) << U(40) | full >> U(24)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        near = np.where(hot[at] == context, full, near)
    return _in_pass(near, previous)


def _merge(ids: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct ids ascending, the columns of each, and the sums over its rows."""
    if not len(ids):
        return ids, columns, sums
    order = np.argsort(ids)
    ids = ids[order]
    at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[at], [c[order][at] for c in columns], [np.add.reduceat(s[order], at) for s in sums]


def _bucket_edges(level: int, buckets: int) -> np.ndarray:
    """First gram id of each bucket but the first; where grams have contexts, no edge parts those of one."""
    free = 40 if level > 1 else 0
    return np.array([(b << 64) // buckets >> free << free for b in range(1, buckets)], U)


_SCHEMA = "bucket int, level int, block binary, meta string"
_NAMES = ["bucket", "level", "block", "meta"]


def _row(bucket: int, level: int, block: bytes | None, meta: str | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([level], pa.int32()), pa.array([block], pa.binary()), pa.array([meta], pa.string())], _NAMES)


def _pack(columns: list[np.ndarray], sums: list[np.ndarray]) -> bytes:
    """The contexts of a run of equal first columns, which tell the shorter ones, are kept once; sums
    are small and compress well."""
    n = len(columns[0])
    first, runs_of, rest = columns[0], columns[:-1] or columns, columns[1:][-1:]
    at = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if n and len(columns) > 1 else np.arange(n)
    runs = np.diff(np.append(at, n)).astype(np.uint32)
    wide = any(len(s) and s.max() >= 1 << 32 for s in sums)
    head = np.array([n, len(at), wide], U)
    return b"".join(x.tobytes() for x in (head, *[c[at] for c in runs_of], *rest, runs, *[s.astype(U if wide else np.uint32) for s in sums]))


def _unpack(block: pa.Buffer, columns: int, sums: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data = np.frombuffer(block, np.uint8)
    n, k, wide = data[:24].view(U).tolist()
    at = 24

    def take(count: int, kind) -> np.ndarray:
        nonlocal at
        size = count * np.dtype(kind).itemsize
        at += size
        return np.frombuffer(data[at - size : at].tobytes(), kind)

    runs_of = [take(k, U) for _ in range(max(1, columns - 1))]
    rest = [take(n, U) for _ in range(min(1, columns - 1))]
    runs = take(k, np.uint32)
    return [*[np.repeat(c, runs) for c in runs_of], *rest], [take(n, U if wide else np.uint32).astype(U) for _ in range(sums)]


def _send(level: int, buckets: int, ids: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray]):
    cuts = [0, *np.searchsorted(ids, _bucket_edges(level, buckets)).tolist(), len(ids)]
    for b in range(buckets):
        lo, hi = cuts[b], cuts[b + 1]
        if hi > lo:
            yield _row(b, level, _pack([c[lo:hi] for c in columns], [s[lo:hi] for s in sums]))


#: Sorted hashes of a set that are kept whole; a larger set keeps the last 48 bits and a table of the first.
FEW = 1 << 12


def _narrow(x: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
    """A sorted set without its repeated first bits: the whole hashes ("") or, for each value of the
    first bits, where it begins ("_top"), and the others in two parts ("_mid", "_low"); the least
    hash and the number of later bits."""
    none = np.zeros(0, U)
    if len(x) <= FEW:
        return {"": x, "_top": none, "_mid": none, "_low": none}, 0, 0
    base = x[0]
    width = int(x[-1] - base).bit_length()
    later = width - max(0, width - 48, min(16, width, len(x).bit_length() - 5))
    rest = x - base
    firsts = np.arange((int(rest[-1]) >> later) + 2, dtype=U)
    top = np.searchsorted(rest >> U(later), firsts)
    rest = rest & U((1 << later) - 1)
    return {"": none, "_top": top, "_mid": rest >> U(16), "_low": rest & U(0xFFFF)}, int(base), later


class SortedFile:
    """One bucket of one order: sorted ids with counts, and sorted keys of contexts with their
    statistics; those of one gram seen once, the most, stand apart without."""

    STATISTICS = ("totals", "n1", "n2", "n3")
    SETS = ("ids", "contexts", "singles")
    #: (name, kind) of the arrays in the file, widest kinds first.  Counts and statistics take a byte;
    #: those of 255 and more stand apart.
    ARRAYS = (
        *((s, "<u8") for s in (*SETS, "raw", "large", "wide_totals", "wide_n1", "wide_n2", "wide_n3")),
        *((s, "<u4") for s in ("large_at", "wide_at", "ids_top", "contexts_top", "singles_top", "ids_mid", "contexts_mid", "singles_mid")),
        *((f"{s}_low", "<u2") for s in SETS),
        *((s, "u1") for s in ("counts", *STATISTICS)),
    )

    @classmethod
    def write(cls, folder: str, name: str, **arrays: np.ndarray) -> str:
        """Writes the arrays and returns what open() needs, as text."""
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        counts = arrays.pop("counts")
        large = np.flatnonzero(counts >= 255)
        arrays |= {"counts": np.minimum(counts, 255), "large_at": large, "large": counts[large]}
        single = arrays["totals"] == 1
        arrays["singles"] = arrays["contexts"][single]
        for key in ("contexts", *cls.STATISTICS):
            arrays[key] = arrays[key][~single]
        wide = np.flatnonzero(arrays["totals"] >= 255)  # no other statistic is larger
        for s in cls.STATISTICS:
            arrays |= {f"wide_{s}": arrays[s][wide], s: np.minimum(arrays[s], 255)}
        arrays["wide_at"] = wide
        scales = []
        for s in cls.SETS:
            parts, *scale = _narrow(arrays[s])
            arrays |= {f"{s}{k}": x for k, x in parts.items()}
            scales += scale
        with fs.open_output_stream(f"{root}/{name}") as out:
            for key, kind in cls.ARRAYS:
                out.write(arrays[key].astype(kind).tobytes())
        return " ".join(map(str, (name, *(len(arrays[key]) for key, _ in cls.ARRAYS), *scales)))

    def __init__(self, folder: str, text: str):
        name, *numbers = text.split()
        numbers = list(map(int, numbers)) or [0] * (len(self.ARRAYS) + 2 * len(self.SETS))
        lengths, scales = numbers[: len(self.ARRAYS)], numbers[len(self.ARRAYS) :]
        data = _bytes_of(folder, name) if any(lengths) else np.zeros(0, np.uint8)
        at = 0
        for (key, kind), length in zip(self.ARRAYS, lengths, strict=True):
            size = length * np.dtype(kind).itemsize
            setattr(self, key, np.asarray(data[at : at + size].view(kind)))
            at += size
        self.scales = {s: (U(scales[2 * k]), U(scales[2 * k + 1])) for k, s in enumerate(self.SETS)}

    def _places(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ascending hashes stand in a set (any place if absent), and which are there."""
        whole, top, mid, low = (getattr(self, f"{name}{k}") for k in ("", "_top", "_mid", "_low"))
        if not len(mid):
            if not len(whole):
                return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            at = np.minimum(np.searchsorted(whole, x), len(whole) - 1)
            return at, whole[at] == x
        base, later = self.scales[name]
        rest = x - base
        first = rest >> later
        inside = (x >= base) & (first < U(len(top) - 1))
        first = np.where(inside, first, U(0)).astype(np.int64)
        rest = rest & U((1 << int(later)) - 1)

        def value(at: np.ndarray) -> np.ndarray:
            return mid[at].astype(U) << U(16) | low[at]

        lo, end = top[first].astype(np.int64), top[first + 1].astype(np.int64)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            half = (lo[open_] + hi[open_]) >> 1
            less = value(half) < rest[open_]
            lo[open_[less]] = half[less] + 1
            hi[open_[~less]] = half[~less]
            open_ = open_[lo[open_] < hi[open_]]
        at = np.minimum(lo, len(mid) - 1)
        return at, inside & (lo < end) & (value(at) == rest)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of ascending ids (0 if absent), their places, and which are there."""
        at, there = self._places("ids", ids)
        if not len(self.counts):
            return np.zeros(len(ids), U), at, there
        counts = np.where(there, self.counts[at], 0).astype(U)
        full = np.flatnonzero(counts == 255)
        if len(full):
            counts[full] = self.large[np.searchsorted(self.large_at, at[full])]
        return counts, at, there

    def statistics(self, contexts: np.ndarray) -> np.ndarray:
        """Rows (total, n1, n2, n3) of ascending keys of contexts; zeros if absent."""
        out = np.zeros((4, len(contexts)))
        at, there = self._places("contexts", contexts)
        there, at = np.flatnonzero(there), at[there]
        if len(there):
            wide = np.minimum(np.searchsorted(self.wide_at, at), max(0, len(self.wide_at) - 1))
            apart = self.wide_at[wide] == at if len(self.wide_at) else np.zeros(len(at), bool)
            for row, s in zip(out, self.STATISTICS, strict=True):
                row[there] = getattr(self, s)[at]
                row[there[apart]] = getattr(self, f"wide_{s}")[wide[apart]]
        out[:2, self._places("singles", contexts)[1]] = 1  # the total, and the grams seen once
        return out


def _bytes_of(folder: str, name: str) -> np.ndarray:
    """The bytes of a file: mapped where the shared folder is mounted, else read; nothing is copied to
    a disk of the machine."""
    fs, root = open_folder(folder)
    if fs.type_name == "local":
        return np.memmap(f"{root}/{name}", np.uint8, "r")
    with fs.open_input_file(f"{root}/{name}") as source:
        return np.frombuffer(source.read_buffer(), np.uint8)


@dataclass
class KneserNey:
    """What a scoring task needs besides the files."""

    folder: str
    order: int
    buckets: int
    files: dict[int, list[str]] = field(default_factory=dict)
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    hot: dict[int, np.ndarray] = field(default_factory=dict)
    hot_statistics: dict[int, np.ndarray] = field(default_factory=dict)
    tokens: int = 0
    vocabulary: int = 0
    unigrams: tuple[float, float, float, float] = (0, 0, 0, 0)

    def _open(self, level: int, bucket: int) -> SortedFile:
        key = self.folder, level, bucket
        if key not in _opened:
            if len(_opened) >= OPEN_FILES:
                _opened.clear()
            _opened[key] = SortedFile(self.folder, self.files[level][bucket])
        return _opened[key]

    def _in_buckets(self, level: int, keys: np.ndarray, ids: np.ndarray):
        """(bucket, positions) of ascending ids; keys tell the bucket."""
        cuts = [0, *np.searchsorted(keys, _bucket_edges(level, self.buckets)).tolist(), len(keys)]
        for b in range(self.buckets):
            if cuts[b + 1] > cuts[b]:
                yield b, slice(cuts[b], cuts[b + 1]), ids[cuts[b] : cuts[b + 1]]

    def _discount(self, level: int, counts: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[level]])
        return d[np.minimum(counts, U(3)).astype(np.int64)]

    def log10(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of every token, given as grams()."""
        word = columns[-1]
        order = np.argsort(word)
        ids = word[order]
        counts, raw = np.zeros(len(ids), U), np.zeros(len(ids), U)
        for b, at, part in self._in_buckets(1, ids, ids):
            file = self._open(1, b)
            counts[at], place, there = file.find(part)
            raw[at] = np.where(there, file.raw[place], 0) if len(file.raw) else 0
        total, n1, n2, n3 = self.unigrams
        d = self.discounts[1]
        spread = (d[0] * n1 + d[1] * n2 + d[2] * n3) / total if total else 1.0
        lower = np.empty(len(ids))
        base = (counts.astype(float) - self._discount(1, counts)) / total if total else np.zeros(len(ids))
        lower[order] = base + spread / (self.vocabulary + 1)
        seen = np.empty(len(ids), U)
        seen[order] = raw
        for level in range(2, self.order + 1):
            context = columns[-level]
            ids = gram_ids(columns[-level:], self.hot[level])
            order = np.argsort(ids)
            ids = ids[order]
            counts = np.zeros(len(ids), U)
            for b, at, part in self._in_buckets(level, ids, ids):
                counts[at] = self._open(level, b).find(part)[0]
            back = np.empty(len(ids), U)
            back[order] = counts
            stats = self._context_statistics(level, context, columns[-2])
            total = np.maximum(stats[0], 1)
            d = self.discounts[level]
            gamma = np.where(stats[0] > 0, (d[0] * stats[1] + d[1] * stats[2] + d[2] * stats[3]) / total, 1.0)
            own = np.where(stats[0] > 0, (back.astype(float) - self._discount(level, back)) / total, 0.0)
            lower = own + gamma * lower
        return np.log10(lower), seen

    def _context_statistics(self, level: int, context: np.ndarray, previous: np.ndarray) -> np.ndarray:
        order = np.argsort(context)
        ordered = context[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        unique = ordered[first]
        keys = _in_pass(mix64(unique), previous[order[first]])
        by_key = np.argsort(keys)
        found = np.zeros((4, len(unique)))
        for b, at, part in self._in_buckets(level, keys[by_key], keys[by_key]):
            found[:, by_key[at]] = self._open(level, b).statistics(part)
        hot = self.hot[level]
        if len(hot) and len(unique):
            at = np.minimum(np.searchsorted(hot, unique), len(hot) - 1)
            is_hot = hot[at] == unique
            found[:, is_hot] = self.hot_statistics[level][:, at[is_hot]]
        out = np.empty((4, len(context)))
        out[:, order] = np.repeat(found, np.diff(np.append(first, len(ordered))), axis=1)
        return out


_opened: dict[tuple, SortedFile] = {}


def discounts(t: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams seen once to four times; where these
    do not define one (small corpora), half of the count."""
    t1, t2, t3, t4 = t
    y = t1 / (t1 + 2 * t2) if t1 else 0.0
    out = []
    for k, (a, b) in enumerate(((t1, t2), (t2, t3), (t3, t4)), 1):
        d = k - (k + 1) * y * b / a if a and y else k / 2
        out.append(d if 0 < d <= k else k / 2)
    return tuple(out)


def _hot_contexts(docs: DataFrame, order: int, buckets: int | None) -> tuple[dict[int, np.ndarray], int]:
    """Contexts that make up more than a quarter of a bucket's mean share in a sample of the rows, and
    the number of buckets: at least one for each of the session's partitions unless given."""

    def read(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                columns = grams(*hash_tokens(data, offsets[lo : hi + 1]), order)
                yield row(1, np.zeros(0, U), np.zeros(0, np.int64), len(columns[0]))
                for level in range(2, order + 1):
                    values, counts = np.unique(columns[-level], return_counts=True)
                    top = np.argsort(-counts)[:HOT]
                    yield row(level, values[top], counts[top], len(columns[0]))

    def row(level: int, contexts: np.ndarray, counts: np.ndarray, tokens: int) -> pa.RecordBatch:
        # the zero context carries the number of tokens
        n = len(contexts) + 1
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, level, np.int32)), pa.array(np.append(contexts, U(0)).astype(np.int64)), pa.array(np.append(counts, tokens))], ["level", "context", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(tidy(read), "level int, context long, n long").groupBy("level", "context").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n")).limit(1 + order * HOT).collect()
    tokens = max((r["n"] for r in top if r["context"] == 0), default=0)
    if buckets is None:
        buckets = max(session_partitions(docs.sparkSession), -(-tokens * SAMPLE // BUCKET_TOKENS))
    out = {}
    for level in range(2, order + 1):
        rows = {r["context"]: r["n"] for r in top if r["level"] == level and r["context"]}
        out[level] = np.sort(np.array([c for c, n in rows.items() if n > tokens / (4 * buckets)], np.int64).astype(U))
    return out, buckets


def _counted(texts: DataFrame, count, reduces: list, each: int) -> DataFrame:
    """Written: what one pass leaves to the first order, and its manifest."""
    blocks = texts.mapInArrow(tidy(count), _SCHEMA)
    for reduce in reduces:
        blocks = blocks.repartitionById(each, F.col("bucket") % each).mapInArrow(tidy(reduce), _SCHEMA)
    out = written(blocks, "counted")
    del blocks
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()  # Spark deletes the files of exchanges that the driver has forgotten
    return out


def train(docs: DataFrame, order: int = ORDER, buckets: int | None = None) -> KneserNey:
    """Counts a model over the whole texts of `docs` (null: empty) and writes it to the shared folder.
    The number of buckets is rounded up to a multiple of the passes.

    An empty table gives a model that knows nothing: every token has probability 1.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "ngrams")
    hot, buckets = _hot_contexts(docs, order, buckets)
    pads = pad_contexts(order)
    passes = 1 << PASS_BITS if order > 1 else 1
    each = -(-buckets // passes)  # buckets of a pass
    buckets = each * passes

    def count(only: int | None):
        def run(batches):
            held: list[list[np.ndarray]] = []
            size = 0

            def flush():
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                ids = gram_ids(columns, hot.get(order, np.zeros(0, U)))
                ids, columns, sums = _merge(ids, columns, [np.ones(len(ids), U)])
                return _send(order, buckets, ids, columns, sums)

            for b in batches:
                data, offsets = text_buffers(b.column("text"))
                for lo, hi in slices(offsets):
                    held.append(grams(*hash_tokens(data, offsets[lo : hi + 1]), order, only))
                    size += len(held[-1][0])
                    if size >= FLUSH_TOKENS:
                        yield from flush()
                        held, size = [], 0
            if held:
                yield from flush()

        return run

    def reduce(level: int):
        # at the highest order a row's sum is its frequency; below, (count, frequency)
        n_sums = 1 if level == order else 2

        def run(batches):
            bucket, blocks = None, []
            for b in batches:
                for r in range(b.num_rows):
                    if b.column("level")[r].as_py() == level:
                        bucket = b.column("bucket")[r].as_py()
                        blocks.append(_unpack(b.column("block")[r].as_buffer(), level, n_sums))
                    else:
                        yield b.slice(r, 1)  # the manifest of a higher order passes through
            if bucket is None:
                return
            columns = [np.concatenate([x[0][k] for x in blocks]) for k in range(level)]
            sums = [np.concatenate([x[1][k] for x in blocks]) for k in range(n_sums)]
            del blocks
            ids, columns, sums = _merge(gram_ids(columns, hot.get(level, np.zeros(0, U))), columns, sums)
            counts, raw = sums[0], sums[-1]
            tallies = [int((counts == U(k)).sum()) for k in (1, 2, 3, 4)]
            if level > 1:
                context = columns[0]
                keys = _in_pass(mix64(context), columns[-2])
                by = np.argsort(keys)
                ordered, c = keys[by], counts[by]
                at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                stats = [np.add.reduceat(x, at) for x in (c, (c == U(1)).astype(U), (c == U(2)).astype(U), (c > U(2)).astype(U))]
                contexts = context[by][at]
                is_hot = np.isin(contexts, hot[level])
                partial = ";".join(" ".join(map(str, (int(contexts[i]), *[int(s[i]) for s in stats]))) for i in np.flatnonzero(is_hot))
                arrays = dict(zip(("totals", "n1", "n2", "n3"), (s[~is_hot] for s in stats), strict=True)) | {"contexts": ordered[at][~is_hot], "raw": raw[:0]}
                weight = np.ones(len(counts), U)
                if level > 2:
                    weight[context == U(pads[order - level])] = counts[context == U(pads[order - level])]
                below = columns[1:]
                lower_ids, below, lower = _merge(gram_ids(below, hot.get(level - 1, np.zeros(0, U))), below, [weight, raw])
                yield from _send(level - 1, buckets, lower_ids, below, lower)
            else:
                partial = ""
                empty = np.zeros(0, U)
                arrays = {"contexts": empty, "totals": empty, "n1": empty, "n2": empty, "n3": empty, "raw": raw}
            name = f"order{level}-{bucket:06d}-{uuid.uuid4().hex}"
            text = SortedFile.write(folder, name, ids=ids, counts=counts, **arrays)
            summary = " ".join(map(str, (len(ids), int(counts.sum()), int(raw.sum()), int((counts > U(2)).sum()), *tallies)))
            yield _row(bucket, level + 100, None, f"{text}|{summary}|{partial}")

        return run

    texts = docs.select("text")
    if order == 1:
        parts = [texts.mapInArrow(tidy(count(None)), _SCHEMA)]
    else:
        parts = [_counted(texts, count(p), [reduce(level) for level in range(order, 1, -1)], each) for p in range(passes)]
    blocks = functools.reduce(DataFrame.union, parts)
    manifest = written(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(reduce(1)), _SCHEMA), "manifest")
    rows = manifest.select("bucket", "level", "meta").collect()  # one for each bucket and order
    drop_written(manifest, *parts)

    model = KneserNey(folder, order, buckets, hot=hot)
    none = "-"
    for level in range(1, order + 1):
        model.files[level] = [none] * buckets
        sums, partials = np.zeros(8, np.int64), {}
        for r in rows:
            if r["level"] == level + 100:
                text, summary, partial = r["meta"].split("|")
                model.files[level][r["bucket"]] = text
                sums += np.array(summary.split(), np.int64)
                for x in filter(None, partial.split(";")):
                    c, *values = map(int, x.split())
                    partials[c] = partials.get(c, 0) + np.array(values, float)
        model.discounts[level] = discounts(sums[4:8].tolist())
        if level == 1:
            model.vocabulary, model.tokens = int(sums[0]), int(sums[2])
            model.unigrams = (float(sums[1]), float(sums[4]), float(sums[5]), float(sums[3]))
        else:
            model.hot_statistics[level] = np.array([partials.get(int(c), np.zeros(4)) for c in hot[level]]).reshape(-1, 4).T
    return model


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """`docs` with n_tokens, n_known, base_score, score and perplexity of every whole text.

    Columns with these names are replaced; null texts count as empty (their end token alone);
    nothing is shuffled.
    """
    made = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    names = others(docs, *made, "text")
    below = math.log10(model.tokens + 0.1 * (model.vocabulary + 1))

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets, SCORE_BYTES):
                words, counts = hash_tokens(data, offsets[lo : hi + 1])
                logs, seen = model.log10(grams(words, counts, model.order))
                sizes = counts + 1
                at = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10(seen.astype(float) + 0.1) - below, at)
                total = np.add.reduceat(logs, at)
                known = np.add.reduceat((seen > 0).astype(np.int64), at)
                columns = [pa.array(sizes), pa.array(known), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(300, -total / sizes))]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in names], *columns], [*names, *made])

    kept = docs.select(*[F.col(f"`{c}`") for c in names], "text")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text"], "n_tokens long, n_known long, base_score double, score double, perplexity double"])
    return kept.mapInArrow(tidy(run), schema)


def held_out_column(folds: int = 10) -> Column:
    """Whether crc32 of the doc_id as text is divisible by `folds`; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def held_out_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs.filter(~held_out_column()), order)
    marked = docs.select("doc_id", held_out_column().alias("held_out"), F.lit(model.tokens).cast("long").alias("train_tokens"), "text")
    return score(marked, model)
