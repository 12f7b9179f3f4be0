"""Operator 6: Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into the phrases of an LZ78 dictionary (each phrase is the longest
known one plus a byte; a known one that the text ends in counts as an unfinished phrase, apart from
the finished one); the set of phrases is hashed to 32 bits and the SIZE smallest hashes are the
fingerprint.  The likeness of two fingerprints estimates the Jaccard similarity of the phrase sets
from the smallest hashes of their union, as compression distances compare shared phrases.

The parse of a text depends only on what was read, so a text and its edited form share the parse of
their common first half; the dictionary is copied at the fork.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, session_partitions, tidy
from .sharding import key_struct, known_id, long_structs, order_keys, ordered_parts
from .textops import span_hashes

SIZE = 64
#: Seed of the hash of an unfinished phrase.
UNFINISHED = 1


class Parse:
    """The state of an LZ78 parse; `ends` are the ends of the phrases made so far."""

    __slots__ = ("at", "ends", "known", "node")

    def __init__(self):
        self.known: dict[int, int] = {}
        self.ends: list[int] = []
        self.node = self.at = 0

    def fork(self) -> Parse:
        other = Parse()
        other.known, other.ends, other.node, other.at = self.known.copy(), self.ends.copy(), self.node, self.at
        return other

    def read(self, data: bytes) -> Parse:
        known, node, ends = self.known, self.node, self.ends
        get, end, n = known.get, ends.append, len(known)
        i = self.at
        for byte in data:
            i += 1
            key = node << 8 | byte
            node = get(key, 0)
            if not node:
                n += 1
                known[key] = n
                end(i)
        self.node, self.at = node, i
        return self

    def smallest(self, data: bytes, size: int = SIZE) -> np.ndarray:
        """The fingerprint: the smallest distinct 32-bit phrase hashes, ascending."""
        if not data:
            return np.zeros(0, np.uint32)
        ends = np.array(self.ends, np.int64)
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))[: len(ends)]
        text = np.frombuffer(data, np.uint8)
        hashes = span_hashes(text, starts, ends)
        if self.node:
            last = np.array([[self.ends[-1]], [len(data)]])
            hashes = np.append(hashes, span_hashes(text, *last, seed=UNFINISHED))
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        if len(hashes) > 4 * size:
            hashes = np.partition(hashes, 3 * size)[: 3 * size]
        hashes.sort()
        kept = hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]
        return kept[:size]


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    """The fingerprint of one text; null and empty texts have an empty one."""
    data = (text or "").encode()
    return Parse().read(data).smallest(data, size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common phrases, 0 to 1; two empty fingerprints are alike, 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    first = np.concatenate(([True], both[1:] != both[:-1]))
    twice = np.concatenate((both[1:] == both[:-1], [False]))[first]
    seen = twice[:size]
    return float(seen.sum()) / len(seen)


def show(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def edited_row(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text (last half replaced by the first as many code points of `following`), and
    the fingerprints of the text and of the edited text."""
    half = len(text) // 2
    head, tail, new = text[: len(text) - half], text[len(text) - half :], following[:half]
    head_b, tail_b, new_b = head.encode(), tail.encode(), new.encode()
    stem = Parse().read(head_b)
    if tail == new:
        own = stem.read(tail_b).smallest(head_b + tail_b)
        return text, own, own
    fork = stem.fork()
    own = stem.read(tail_b).smallest(head_b + tail_b)
    return head + new, own, fork.read(new_b).smallest(head_b + new_b)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness of its fingerprint
    to the edited text's and to the next document's.

    Next: by ascending doc_id, rows of one doc_id by a hash of the text (null texts count as empty,
    null doc_ids come first); after the last the first.  Texts are exchanged once, into parts of about equal
    bytes; the first document of each part also goes to the end of the part before it.  Repeated
    rows are kept; an empty table gives an empty result.
    """
    import hashlib

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = session_partitions(spark)
    part, table = ordered_parts(docs, count)
    # at most one row for each part
    least = sorted((r["part"], [*r["head"]]) for r in table.groupBy("part").agg(F.min(F.struct("_doc", "_text")).alias("head")).collect())
    drop_written(table)
    heads, before = [None] * count, [0] * count
    for i, (p, head) in enumerate(least):
        heads[p], before[p] = head, least[i - 1][0]
    docs = docs.withColumn("part", part).withColumn("mark", order_keys()[1])
    first = F.get(long_structs(heads, 2), F.col("part")) == key_struct([known_id(), F.col("mark")])
    previous = F.get(F.expr(f"array({', '.join(map(str, before))})"), F.col("part"))
    here = F.struct(F.col("part"), F.lit(0).alias("tail"))
    copies = F.when(first, F.array(here, F.struct(previous.alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(here))
    placed = docs.withColumn("_to", F.explode(copies)).select("doc_id", "mark", "text", F.col("_to.part").alias("part"), F.col("_to.tail").alias("tail"))
    placed = placed.repartitionById(count, F.col("part")).sortWithinPartitions("tail", "doc_id", "mark", "text")

    def rows(batches) -> Iterator[tuple]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                yield from zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist(), s.column("tail").to_pylist(), strict=True)

    def prints(batches):
        held, waiting, out = None, None, []  # a row that waits for its next text; one that waits for its next fingerprint
        gc.disable()  # the dictionaries hold no cycles
        try:
            for doc_id, text, tail in rows(batches):
                if held is not None:
                    edited, own, new = edited_row(held[1], text)
                    if waiting is not None:
                        out.append((*waiting[:-1], likeness(waiting[-1], own)))
                    waiting = (held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(new), likeness(own, new), own)
                if tail:
                    out.append((*waiting[:-1], likeness(waiting[-1], fingerprint(text))))
                    held = waiting = None
                    break
                held = doc_id, text
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
            for _ in batches:  # the rest are other rows of the next part's first doc_id
                pass
        finally:
            gc.enable()

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return placed.mapInArrow(tidy(prints), SCHEMA)
