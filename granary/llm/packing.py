"""Operator 7: cost-balanced packing of token sequences.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n (projections and attention).
Documents longer than a sequence are cut into the fewest parts that fit, of equal length, so that no
part makes a sequence as dear as a whole window would.  Within a group of about GROUP_TOKENS tokens
documents and parts are taken by descending cost and each goes to the sequence of lowest cost that
still has room; what finds no room is cut to fill the gaps, cheapest sequence first, each cut adding
its cost.  A group opens only as many sequences as it can fill, and hands its leftover to the next
one, so only the last tokens of a partition are short: these are cut into sequences whose lengths are
powers of two.

Groups are formed inside the partitions of the input, so nothing is shuffled and memory is bounded
by a group and the longest text.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy
from .textops import KEEP, encoder, slices, text_buffers

CAPACITY = 2048
GROUP_TOKENS = 1 << 20
GROUP_PIECES = 1 << 15
LINEAR, QUADRATIC = 1.0, 1.0 / 512

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balance(lengths: np.ndarray, sequences: int, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Places pieces (each at most `capacity`) into `sequences` full sequences.

    Needs sum(lengths) >= sequences * capacity.  Returns (piece, start in the piece, length,
    sequence), with sequence -1 for what is left over; ties go to the earlier piece and sequence.
    """
    room, cost = np.full(sequences, capacity, np.int64), np.zeros(sequences)
    out, rest = [], []
    if not sequences:
        return [(i, 0, int(n), -1) for i, n in enumerate(lengths)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        open_cost = np.where(room >= n, cost, np.inf)
        s = int(open_cost.argmin())
        if room[s] < n:
            rest.append(i)
            continue
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
        out.append((i, 0, n, s))
    gaps = [(cost[s], s) for s in np.flatnonzero(room).tolist()]
    heapq.heapify(gaps)
    for i in rest:
        at, n = 0, int(lengths[i])
        while at < n and gaps:
            spent, s = heapq.heappop(gaps)
            take = min(n - at, int(room[s]))
            out.append((i, at, take, s))
            room[s] -= take
            at += take
            if room[s]:
                heapq.heappush(gaps, (spent + linear * take + quadratic * take * take, s))
        if at < n:
            out.append((i, at, n - at, -1))
    return out


def equal_parts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the fewest parts of at most `capacity` that n tokens are cut into, equally long
    but for one token."""
    parts = -(-n // capacity)
    cuts = [n * k // parts for k in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def power_cuts(lengths: list[int]) -> list[tuple[int, int, int, int]]:
    """Cuts a short leftover into sequences whose lengths are the powers of two of its total."""
    total = sum(lengths)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, s = [], 0
    left = sizes[0] if sizes else 0
    for i, n in enumerate(lengths):
        at = 0
        while at < n:
            take = min(n - at, left)
            out.append((i, at, take, s))
            at, left = at + take, left - take
            if not left:
                s += 1
                left = sizes[s] if s < len(sizes) else 0
    return out


class Packer:
    """Packs the documents of one partition; `first` is its first sequence id."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.sequence, self.capacity = first, capacity
        self.pieces: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids, tokens of the document
        self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, doc_id, start, ids, doc_tokens, sequence, offset):
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence, offset))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        for start, end in equal_parts(n, self.capacity):
            self.pieces.append((doc_id, start, ids[4 * start : 4 * end], n))
        self.tokens += n
        if self.tokens >= GROUP_TOKENS or len(self.pieces) >= GROUP_PIECES:
            self.pack()

    def _place(self, placed: list[tuple[int, int, int, int]]) -> None:
        offsets: dict[int, int] = {}
        left = []
        for i, at, n, s in placed:
            doc_id, start, ids, total = self.pieces[i]
            part = ids[4 * at : 4 * (at + n)]
            if s < 0:
                left.append((doc_id, start + at, part, total))
            else:
                self._emit(doc_id, start + at, part, total, self.sequence + s, offsets.get(s, 0))
                offsets[s] = offsets.get(s, 0) + n
        self.sequence += len(offsets)
        self.pieces, self.tokens = left, sum(len(p[2]) // 4 for p in left)

    def pack(self) -> None:
        """Fills as many whole sequences as the held pieces allow."""
        lengths = np.array([len(p[2]) // 4 for p in self.pieces], np.int64)
        self._place(balance(lengths, self.tokens // self.capacity, self.capacity))

    def finish(self) -> None:
        self.pack()
        self._place(power_cuts([len(p[2]) // 4 for p in self.pieces]))

    def taken(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = [pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, keep: int = KEEP) -> DataFrame:
    """Packs every document (null text: empty, so only its end id) into sequences of `capacity` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Repeated rows are packed as often as they occur; other columns are ignored; an empty table gives
    an empty result.  Sequence ids are unique; those of one partition follow each other.  A worker
    remembers the ids of `keep` chunks of text, which changes time and memory, not the result.
    """

    def pack(batches):
        packer = Packer(TaskContext.get().partitionId() << 36, capacity)
        for b in batches:
            ids, (_, offsets) = b.column("doc_id").to_pylist(), text_buffers(b.column("text"))
            encode = encoder(vocabulary, keep).encode
            for lo, hi in slices(offsets):
                for doc_id, got in zip(ids[lo:hi], encode(b.column("text").slice(lo, hi - lo).to_pylist()), strict=True):
                    packer.add(doc_id, got + end_id.to_bytes(4, "little"))
                if out := packer.taken():
                    yield out
        packer.finish()
        if out := packer.taken():
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(pack), SCHEMA)
