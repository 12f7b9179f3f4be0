"""Operator 10: exact top-k by inner product with the threshold algorithm.

Candidates are cut into blocks; within a block every dimension has its list of candidates sorted by
their component.  A query reads the lists from the end that its own component favours, to growing
depths; every candidate met for the first time is scored in full (random access), and no candidate
not met can score above the bound, the sum over dimensions of the query's component times the
component at the depth reached.  A block is done once the bound lies below the query's k-th best
score so far, which it brings along from the blocks before.

No candidate is scored twice, and nothing but the bound or the end of the lists stops a query.  How
much the bound saves lies in the vectors: where a few dimensions decide it saves nearly all, where
all dimensions are alike and independent it falls below the k-th score only about a third down the
lists, when nearly every candidate has been met in one of them.

Scores are exact: products are summed as doubles where all sums stay below 2**53, as 64-bit integers
below 2**63; vectors whose scores might not fit a long raise an error.

Queries are a stated set; they meet the candidates block by block.  Both are packed into blocks in
the shared folder.  A task holds the packed blocks of its group and reads the queries from that
folder, WAVE blocks at a time, so they are neither joined nor sent through the driver; the rows that
leave it are K for each query and group of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import open_folder, session_partitions, tidy, written

BLOCK = 4096
QUERIES = 512
#: Blocks of queries that a task holds at once, and blocks of candidates that one group has, at most.
WAVE, GROUP = 64, 16
#: Depth of the first look at the bound, as a share of the lists; each next one is DEEPER times it.
FIRST_SHARE, DEEPER = 1 / 512, 2


def largest(vectors: np.ndarray) -> int:
    """The largest absolute value, also where it is the least long's."""
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


class Block:
    """Candidates of one block with their sorted lists; ids ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lists = np.argsort(self.vectors, axis=0, kind="stable")  # row r of column d: the r-th smallest
        self.sorted = np.take_along_axis(self.vectors, lists, axis=0)
        # the place of each candidate in each list, counted from the small end and from the large end
        n, dims = self.vectors.shape
        kind = np.int16 if n <= 1 << 15 else np.int32  # short ones are sorted by their digits
        small = np.empty((dims, n), kind)
        np.put_along_axis(small, lists.T, np.arange(n, dtype=kind)[None], axis=1)
        self.places = np.stack((small, kind(n - 1) - small))
        self.largest = largest(self.vectors)

    def first_met(self, up: np.ndarray) -> np.ndarray:
        """The least depth at which each candidate shows in one of the lists, read from the large end
        where `up`."""
        return self.places[up.astype(np.int8), np.arange(len(up))].min(0)


class Best:
    """The k best candidates of each query so far: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        low = self.scores[q, -1]
        ok = scores >= low
        if ok.any():
            s, i = np.concatenate((self.scores[q], scores[ok])), np.concatenate((self.ids[q], ids[ok]))
            top = np.lexsort((i, ~s))[: self.k]  # ~s falls as s grows, without overflow
            self.scores[q], self.ids[q] = s[top], i[top]


def exact(block: Block, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's vectors and the queries in a type that holds every sum of their products."""
    most = block.largest * largest(queries) * queries.shape[1]
    if most >= 1 << 63:
        raise OverflowError("a score may not fit a 64-bit integer")
    kind = np.float64 if most < 1 << 53 else np.int64
    return block.vectors.astype(kind, copy=False), queries.astype(kind, copy=False)


def threshold_search(block: Block, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> int:
    """Improves `best` by the block's candidates other than the query's own row; returns how many
    scores were computed."""
    n, _ = block.vectors.shape
    vectors, queries = exact(block, queries)
    ordered = block.sorted.astype(vectors.dtype, copy=False)
    computed = 0
    for q, query in enumerate(queries):
        up = query > 0
        met = block.first_met(up)
        waiting = np.argsort(met, kind="stable")
        depths, done, depth = met[waiting], 0, max(1, int(n * FIRST_SHARE))
        while done < n:
            upto = int(np.searchsorted(depths, depth))
            at = waiting[done:upto]
            computed += len(at)
            others = at[block.ids[at] != query_ids[q]]
            best.offer(q, (vectors[others] @ query).astype(np.int64), block.ids[others])
            done = upto
            # what the bound allows to candidates not met within this depth
            if (query * np.where(up, ordered[n - depth], ordered[depth - 1])).sum() < best.scores[q, -1]:
                break
            depth = min(n, DEEPER * depth)
    return computed


def _least(data: np.ndarray) -> np.ndarray:
    """The integers in the shortest of three kinds that holds them."""
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= data.min(initial=0) and data.max(initial=0) <= np.iinfo(kind).max:
            return data.astype(kind)
    return data


_PACKED = "dims int, width int, ids binary, data binary"


def _packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Written: blocks of at most `rows` vectors of one length, as bytes: block, dims, width (bytes of a
    component), ids, data."""

    def pack(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dims: int) -> pa.RecordBatch:
            ids, data = (np.concatenate([p[k] for p in held[dims]]) for k in (0, 1))
            del held[dims]
            data = _least(data)
            columns = [pa.array([dims], pa.int32()), pa.array([data.itemsize], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, data)]]
            return pa.RecordBatch.from_arrays(columns, ["dims", "width", "ids", "data"])

        for b in batches:
            ids, column = b.column("vec_id").to_numpy(), b.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes[sizes > 0]).tolist():
                picked = np.flatnonzero(sizes == dims)
                for lo in range(0, len(picked), rows):
                    at = picked[lo : lo + rows]
                    data = flat[starts[at][:, None] + np.arange(dims)]
                    if sum(len(p[0]) for p in held.get(dims, [])) + len(at) > rows:
                        yield out(dims)
                    held.setdefault(dims, []).append((ids[at], data))
        for dims in list(held):
            yield out(dims)

    packed = vectors.select("vec_id", "v").mapInArrow(tidy(pack), _PACKED)
    return written(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _unpacked(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a packed block."""
    dims, width = (batch.column(c)[r].as_py() for c in ("dims", "width"))
    ids, data = (batch.column(c)[r].as_buffer() for c in ("ids", "data"))
    return np.frombuffer(ids, np.int64), np.frombuffer(data, f"i{width}").reshape(-1, dims).astype(np.int64)


def _waves(folder: str, size: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The packed blocks that written() left in a folder, `size` at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, root = open_folder(folder)
    wave: list[tuple[np.ndarray, np.ndarray]] = []
    for path in sorted(f.path for f in fs.get_file_info(FileSelector(root)) if f.base_name.endswith(".parquet") and f.base_name[0] not in "._"):
        with fs.open_input_file(path) as source:
            for b in pq.ParquetFile(source).iter_batches(batch_size=8, columns=["dims", "width", "ids", "data"], use_threads=False):
                for r in range(b.num_rows):
                    wave.append(_unpacked(b, r))
                    if len(wave) >= size:
                        yield wave
                        wave = []
    if wave:
        yield wave


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """For each query row the k other rows of its length with the highest integer inner product.

    `vectors`: vec_id long and v array<long>, without nulls; scores that may not fit a long raise an
    error (see exact()).
    Columns: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id.  Rows that share
    a vec_id with the query count as its own.  Empty vectors take no part; no queries or no
    candidates give an empty result.
    """
    spark = vectors.sparkSession
    candidates, queries = _packed(vectors, BLOCK, "candidates"), _packed(vectors.filter(is_query), QUERIES, "queries")
    (folder,) = queries._written_at
    # a block's number: that in its part, and the blocks of the parts before; one row for each part
    counts = {r["part"]: r["n"] for r in candidates.groupBy(F.shiftright("block", 33).cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = np.cumsum([0, *[counts.get(p, 0) for p in range(max(counts, default=0) + 1)]]).tolist()
    groups = max(1, min(starts[-1], 2 * session_partitions(spark)), -(-starts[-1] // GROUP))
    offsets = F.expr(f"array({', '.join(f'{n}L' for n in starts)})")
    number = F.get(offsets, F.shiftright("block", 33).cast("int")) + F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = candidates.withColumn("part", (number % groups).cast("int")).repartitionById(groups, F.col("part"))

    def search(batches):
        group = [b.slice(r, 1) for b in batches for r in range(b.num_rows)]
        if not group:
            return
        lengths = {b.column("dims")[0].as_py() for b in group}
        for wave in _waves(folder, WAVE):
            asked = [(ids, data, Best(len(ids), k)) for ids, data in wave if data.shape[1] in lengths]
            for b in group:
                block = Block(*_unpacked(b, 0))
                for ids, data, best in asked:
                    if data.shape[1] == block.vectors.shape[1]:
                        threshold_search(block, ids, data, best)
            for ids, _, best in asked:
                kept = best.ids < np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, kept.sum(1))), pa.array(best.ids[kept]), pa.array(best.scores[kept])], ["query_id", "vec_id", "score"])

    found = dealt.select("dims", "width", "ids", "data").mapInArrow(tidy(search), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v = floor(256 * x) of each component; vectors that are null or hold a null or a
    non-finite component, and rows without an id, are left out."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.filter(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")
    )
