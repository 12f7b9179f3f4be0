"""Operator 9: near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

1. Equal shingle sets form one class; from here on only classes are compared, so exact copies, how
   many there may be, cost one row each.
2. A class has a signature of WIDE components: the JOINED first ones keep 16 bits of their minimum,
   the others 8.  Its distance to another is the number of components that differ; two sets of
   similarity s differ in about (1 - s) of them.
3. Multi-index: the joined components are split into chunks.  Two signatures that differ in at most
   chunks * (ERRORS + 1) - 1 joined components have, by pigeonhole, a chunk with at most ERRORS
   differences; so a class is listed, for every chunk, under each way of leaving ERRORS components
   out.  Every pair within that distance meets under some key.
4. Stars first: under the first key of each chunk, every class shares that key's least class; the
   NEAREST least ones that it shares most keys with are its candidates (linear in the classes).
   Pairs within the WIDE distance are confirmed on the full sets, and links joined to components.
   Then, under every key (of all slots) that holds two components, the pairs of its most central
   class with those of other components, which joins what clusters around an unseen original; then
   the pairs of each class with the least different one of another component.
   Pairs last: under every key that holds two components even now, all pairs across components
   within the WIDE distance, each under its first common key only.
   Pairs left out lie inside one component already, so no link between different texts is lost.

The chunks and the limits follow from the similarity asked for: a pair of just that similarity
exceeds a limit with a chance below MISS, above it with far less.  They do not depend on the data,
and nothing is capped: a key with very many classes is cut into blocks of BLOCK, and every pair of
blocks is compared in a task of its own.  What all rows of a key, class or component need is computed
by aggregates and joined back, so no task holds a whole key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components, spread_join
from .shared import drop_written, tidy, written, written_union
from .textops import hash_tokens, mix64, slices, sorted_unique, text_buffers

U = np.uint64
WIDTH = 5
WIDE, JOINED, ERRORS = 512, 64, 1
#: Chance that a pair of just the similarity asked for is missed: nine tenths of it in the joined components.
MISS = 1e-5
SIGNATURE_BYTES = 2 * JOINED + WIDE - JOINED
BLOCK = 4096
NEAREST = 2

_STEP = U(0xD6E8FEB86659FD93)
_random = np.random.default_rng(5)
_XOR = _random.integers(0, 1 << 63, WIDE, dtype=np.uint64)
_FACTOR = _random.integers(0, 1 << 63, WIDE, dtype=np.uint64) | U(1)
_SALT = mix64(np.arange(1, JOINED + 1, dtype=np.uint64) * _STEP)


@dataclass(frozen=True)
class Limits:
    """Chunks of the joined components, and the largest distances of a pair that is confirmed on full sets."""

    chunks: int
    wide: int

    @property
    def joined(self) -> int:
        return self.chunks * (ERRORS + 1) - 1

    @property
    def chunk_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunks), [len(x) for x in np.array_split(np.arange(JOINED), self.chunks)])

    @property
    def chunk_starts(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.chunk_of, prepend=-1))

    def near(self, joined: np.ndarray, wide: np.ndarray) -> np.ndarray:
        return (joined <= self.joined) & (wide <= self.wide)


def _beyond(n: int, p: float, limit: int) -> float:
    """The chance of more than `limit` successes in n trials."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(limit + 1, n + 1))


@cache
def limits_of(percent: int) -> Limits:
    """The least limits by which a pair of similarity percent / 100 is missed with a chance below MISS."""
    p = 1 - percent / 100
    # a chunk needs a component besides those left out
    fit = [c for c in range(1, JOINED // (ERRORS + 1) + 1) if _beyond(JOINED, p, c * (ERRORS + 1) - 1) < 0.9 * MISS]
    if not fit:
        raise ValueError(f"{JOINED} joined components cannot find pairs of similarity {percent} / 100")
    return Limits(fit[0], next(k for k in range(WIDE + 1) if _beyond(WIDE, p, k) < 0.1 * MISS))


_CONTRACT = limits_of(85)
CHUNKS, JOINED_LIMIT, WIDE_LIMIT = _CONTRACT.chunks, _CONTRACT.joined, _CONTRACT.wide


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the distinct hashes of its shingles of `width` words, ascending.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    words, counts = hash_tokens(data, offsets)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - width + 1), U)
    for k in range(width if len(rolled) else 0):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if hi - lo >= width:
            out.append(sorted_unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], U)  # the length, so that short sequences differ from long ones
            for w in words[lo:hi]:
                whole = mix64(whole * _STEP + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, U))
    return out


def class_ids(shingles: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Two independent 64-bit ids of a set, as signed longs; equal for equal sets."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signature(shingles: np.ndarray) -> bytes:
    """The b-bit MinHash signature of a non-empty set."""
    least = np.full(WIDE, np.iinfo(np.uint64).max, U)
    for lo in range(0, len(shingles), 256):
        block = (shingles[lo : lo + 256, None] ^ _XOR) * _FACTOR
        np.minimum(least, block.min(0), out=least)
    bits = mix64(least)
    return bits[:JOINED].astype("<u2").tobytes() + bits[JOINED:].astype(np.uint8).tobytes()


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long binaries as rows of a byte matrix."""
    data, offsets = text_buffers(column)
    return data[int(offsets[0]) : int(offsets[-1])].reshape(len(column), -1)


def _joined(signatures: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(signatures[:, : 2 * JOINED]).view("<u2")


def differing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of signatures row by row: in the joined components, and in all."""
    joined = (_joined(a) != _joined(b)).sum(1)
    return joined, joined + (a[:, 2 * JOINED :] != b[:, 2 * JOINED :]).sum(1)


def index_keys(signatures: np.ndarray, limits: Limits = _CONTRACT) -> np.ndarray:
    """The JOINED keys of each signature: component k left out of its chunk, for every k."""
    terms = mix64(_joined(signatures).astype(U) + _SALT)
    sums = np.add.reduceat(terms, limits.chunk_starts, axis=1)
    return mix64(sums[:, limits.chunk_of] - terms + _SALT)


def first_keys(a: np.ndarray, b: np.ndarray, limits: Limits = _CONTRACT) -> np.ndarray:
    """The first key that both signatures of each row have, JOINED if they have none."""
    differ = _joined(a) != _joined(b)
    errors = np.add.reduceat(differ.astype(np.int64), limits.chunk_starts, axis=1)[:, limits.chunk_of]
    # component k's key is common if its chunk has no error, or k is the chunk's only one
    common = (errors == 0) | ((errors == 1) & differ)
    return np.where(common.any(1), common.argmax(1), JOINED)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and mark, a hash of the text by which rows without an id are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))


def classes(docs: DataFrame, salt: int = 0) -> DataFrame:
    """Written: doc_id, mark (see marked()), n_shingles, node and proof (the class's two ids, null
    without shingles) and signature of every document."""

    def read(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                sets = shingle_sets(data, offsets[lo : hi + 1])
                ids = [class_ids(s, salt) if len(s) else (None, None) for s in sets]
                columns = [
                    b.column("doc_id").slice(lo, hi - lo),
                    b.column("mark").slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(c, pa.int64()) for c in zip(*ids, strict=True)],
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "node", "proof", "signature"])

    return written(marked(docs).mapInArrow(tidy(read), "doc_id long, mark long, n_shingles long, node long, proof long, signature binary"), "classes")


def distinct_classes(docs: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """Written: classes() and one row for each node, with its signature, under the first salt by which
    no node stands for two sets."""
    for salt in count():
        table = classes(docs, salt)
        by_node = table.filter("node is not null").groupBy("node")
        nodes = written(by_node.agg(F.first("signature").alias("signature"), (F.min("proof") != F.max("proof")).alias("mixed")), "nodes")
        if nodes.filter("mixed").isEmpty():
            return salt, table, nodes
        drop_written(table, nodes)


def keyed(nodes: DataFrame, limits: Limits, slots: np.ndarray | None = None) -> DataFrame:
    """(node, slot, key) for the keys of every signature (of the given slots), with the other columns
    but the signature."""
    rest = [c for c in nodes.columns if c != "signature"]
    used = np.arange(JOINED) if slots is None else slots

    def emit(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                keys = index_keys(_matrix(s.column("signature")), limits)[:, used].astype(np.int64).ravel()
                at = pa.array(np.repeat(np.arange(s.num_rows), len(used)))
                named = pa.array(np.tile(used.astype(np.int32), s.num_rows))
                yield pa.RecordBatch.from_arrays([*[s.column(c).take(at) for c in rest], named, pa.array(keys)], [*rest, "slot", "key"])

    return nodes.mapInArrow(tidy(emit), ", ".join([*[f"{c} long" for c in rest], "slot int", "key long"]))


def star_pairs(nodes: DataFrame, limits: Limits) -> DataFrame:
    """Pairs (a, b): class b and the NEAREST of the classes a that are the least under one of its
    first keys of a chunk, those that it shares most of them with."""
    listed = keyed(nodes.select("node", "signature"), limits, limits.chunk_starts)
    heads = listed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key", "a")
    shared = listed.join(heads, "key").filter("node <> a").groupBy("node", "a").agg(F.count("*").alias("n"))
    by_node = W.partitionBy("node").orderBy(F.desc("n"), "a")
    return shared.withColumn("r", F.row_number().over(by_node)).filter(F.col("r") <= NEAREST).select("a", F.col("node").alias("b"))


def near_pairs(pairs: DataFrame, nodes: DataFrame, limits: Limits) -> DataFrame:
    """Those of the pairs (a, b) whose signatures are within both limits."""

    def keep(batches):
        for b in batches:
            joined, wide = differing(_matrix(b.column("sa")), _matrix(b.column("sb")))
            near = pa.array(limits.near(joined, wide))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    with_a = pairs.join(nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
    return with_a.join(nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(tidy(keep), "a long, b long")


def central(signatures: np.ndarray) -> int:
    """The row that differs least from up to 32 rows spread evenly over all."""
    probes = signatures[np.linspace(0, len(signatures) - 1, min(32, len(signatures))).astype(int)]
    total = np.zeros(len(signatures), np.int64)
    for p in probes:
        total += (_joined(signatures) != _joined(p[None])).sum(1)
    return int(total.argmin())


def nearest(signatures: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows of `left` the row of `right` with another label that differs in the fewest joined components."""
    joined = _joined(signatures)
    step = max(1, (1 << 24) // (len(right) * JOINED))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        distance = (joined[i][:, None] != joined[right]).sum(2)
        distance[labels[i][:, None] == labels[right]] = JOINED + 1
        best = distance.argmin(1)
        found = distance[np.arange(len(i)), best] <= JOINED
        yield i[found], right[best[found]]


def cross_pairs(members: DataFrame, limits: Limits, how: str = "all") -> DataFrame:
    """Pairs of classes under one key and of different labels within the limits, each once; how
    "central": only those with the most central class of the key (of each pair of blocks); "nearest":
    only those of each class with the one least different from it.

    `members`: node, label, slot, key, signature, and n, the number of rows of the key.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "slot", "node", "label", "signature")
    )

    def runs(batches) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        """Rows of one (key, lo, hi), which follow each other."""
        held, name = [], None
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if hi > lo:
                    now = tuple(marks[:, lo].tolist())
                    if now != name and held:
                        yield name, held
                        held = []
                    name = now
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield name, held

    def compare(batches):
        for (_, lo, hi), held in runs(batches):
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if t.num_rows < 2:
                continue
            node, label, own = (t.column(c).to_numpy() for c in ("node", "label", "own"))
            slot, s = t.column("slot")[0].as_py(), _matrix(t.column("signature"))
            left = np.flatnonzero(own == lo)
            right = left if lo == hi else np.flatnonzero(own == hi)
            if not len(left) or not len(right):
                continue
            if how == "nearest":
                chosen = nearest(s, label, left, right)
            else:
                chosen = every(left[[central(s[left])]] if how == "central" else left, right)
            for a, b in chosen:
                ok = (label[a] != label[b]) & ((a < b) | (lo != hi) | (how != "all"))
                a, b = a[ok], b[ok]
                for k in range(0, len(a), 1 << 15):
                    x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                    joined, wide = differing(s[x], s[y])
                    near = limits.near(joined, wide)
                    x, y = x[near], y[near]
                    if how == "all":
                        first = first_keys(s[x], s[y], limits) == slot
                        x, y = x[first], y[first]
                    x, y = node[x], node[y]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def every(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, (1 << 24) // (len(right) * WIDE))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            yield np.repeat(i, len(right)), np.tile(right, len(i))

    ordered = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return ordered.mapInArrow(tidy(compare), "a long, b long")


def mixed_keys(nodes: DataFrame, labels: DataFrame, limits: Limits) -> DataFrame:
    """(node, label, slot, key, n) of the keys that hold classes of more than one label."""
    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "signature")
    listed = keyed(labelled, limits)
    both = listed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high")
    return listed.join(both.select("key", "n"), "key").select("node", "label", "slot", "key", "n")


def full_sets(docs: DataFrame, table: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """Written: (node, shingles) of the given classes, made from one document of each."""
    one = F.min(F.struct("doc_id", "mark")).alias("one")
    chosen = table.join(nodes, "node", "left_semi").groupBy("node").agg(one).select("node", F.col("one.doc_id").alias("own"), F.col("one.mark").alias("mark"))
    rows = marked(docs)
    same = rows["doc_id"].eqNullSafe(chosen["own"]) & (rows["mark"] == chosen["mark"])
    texts = rows.join(chosen.select("own", "mark"), same, "left_semi").dropDuplicates(["doc_id", "mark"]).select("text")

    def read(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                sets = [s for s in shingle_sets(data, offsets[lo : hi + 1]) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_ids(s, salt)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return written(texts.mapInArrow(tidy(read), "node long, shingles binary").join(nodes, "node", "left_semi"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def keep(batches):
        for batch in batches:
            found = []
            columns = [batch.column(c) for c in ("sa", "sb")]
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(c[k].as_buffer(), U) for c in columns)
                total = len(x) + len(y)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    found.append(False)
                    continue
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                found.append(100 * common >= percent * (total - common))
            ok = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb").mapInArrow(tidy(keep), "a long, b long")


class Linker:
    """Confirms pairs of classes on their full sets, which are made once for each class that needs one,
    and keeps the links found and the label (the least node reachable) of every linked class."""

    def __init__(self, docs: DataFrame, table: DataFrame, nodes: DataFrame, salt: int, limits: Limits, percent: int):
        self.docs, self.table, self.nodes, self.salt, self.limits, self.percent = docs, table, nodes, salt, limits, percent
        self.sets = self.links = self.labels = None

    def link(self, pairs: DataFrame) -> None:
        """Takes the pairs (a, b), written and within the limits."""
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        if self.sets is not None:
            needed = needed.join(self.sets.select("node"), "node", "left_anti")
        needed = written(needed, "needed")
        more = full_sets(self.docs, self.table.select("doc_id", "mark", "node"), needed, self.salt)
        self.sets = more if self.sets is None else written_union(self.sets, more)
        found = written(confirmed(pairs, self.sets, self.percent), "links")
        drop_written(needed, pairs)
        if self.links is not None and found.isEmpty():
            return
        self.links = found if self.links is None else written_union(self.links, found)
        drop_written(self.labels)
        self.labels = connected_components(self.links)


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row: doc_id, mark (see marked()), n_shingles and label, which the rows of a component share
    and rows without shingles lack."""
    table, labels = linked_classes(docs, percent)
    placed = table.select("doc_id", "mark", "n_shingles", "node").join(labels, "node", "left")
    return placed.select("doc_id", "mark", "n_shingles", F.coalesce("label", "node").alias("label"))


def linked_classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written: classes() of the documents, and (node, label) of the classes that are linked with another."""
    limits = limits_of(percent)
    salt, table, nodes = distinct_classes(docs)
    linker = Linker(docs, table, nodes, salt, limits, percent)
    linker.link(written(near_pairs(star_pairs(nodes, limits), nodes, limits), "stars"))

    open_nodes = nodes
    for how in ("central", "nearest", "all"):
        mixed = written(mixed_keys(open_nodes, linker.labels, limits), "mixed")
        if open_nodes is not nodes:
            drop_written(open_nodes)
        open_nodes = written(mixed.select("node").distinct().join(nodes, "node").select("node", "signature"), "open")
        used = mixed.filter(F.col("slot").isin(limits.chunk_starts.tolist())) if how == "nearest" else mixed
        pairs = cross_pairs(used.join(open_nodes, "node"), limits, how)
        pairs = written(pairs if how == "all" else pairs.distinct(), "cross")
        drop_written(mixed)
        linker.link(pairs)
    drop_written(open_nodes)
    drop_written(nodes, linker.sets, linker.links)
    return table, linker.labels


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable over links of
    similarity at least `percent` / 100, itself included), kept (doc_id is its component_id).

    Documents without words (or text) have no shingles and are linked with nothing, not even each
    other.  Rows that share a doc_id are compared as rows; a null doc_id is no component's least id,
    and a component without other ids is null and kept.  Empty tables give an empty result.
    """
    table, labels = linked_classes(docs, percent)
    own = table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"))
    linked = labels.join(own, "node")
    least = linked.groupBy("label").agg(F.min("own").alias("head"))
    heads = spread_join(linked, least, "label", "node").select("node", "head")
    found = own.join(heads, "node", "left").select("node", F.coalesce("head", "own").alias("head"))
    out = table.join(found, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
