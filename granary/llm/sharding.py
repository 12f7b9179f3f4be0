"""Operator 8: histogram sort into shards of nearly equal bytes.

Splitters are found by counting, never by sampling: every round splits the cell that holds a
splitter into up to 256 smaller ones, counts the exact bytes and rows in each over all partitions, and
keeps the cell that the splitter falls into, until the nearest cell border is within tolerance.
Keys are compared level by level, so a key value that alone outweighs a shard is cut by the next
level (and at last by the row number).  Rows are exchanged once, at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import session_partitions, written

#: Bits of the key that one round resolves at most, and binary logarithm of the cells of a round.
ROUND_BITS, CELL_BITS = 8, 16
#: Share of a shard that a border may move to spare a group of equal texts.
GROUP_SLACK = 0.02
#: The least and the largest long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Stands for a null doc_id.
NO_ID = -(1 << 62)


@dataclass
class Splitter:
    """The border before which `target` bytes should lie; `key` is filled level by level."""

    target: float
    tolerance: float
    key: list[int] = field(default_factory=list)
    below_bytes: int = 0
    below_rows: int = 0
    cell: int = 0
    settled: bool = False


def histogram_splitters(
    df: DataFrame, keys: list[str], weight: str, parts: int, tolerance: float = 0.001, loose: float = 0.02, major: int = 1, group_level: int = 0
) -> tuple[list[Splitter], tuple[int, int]]:
    """Borders that cut `df`, ordered by the long columns `keys`, into `parts` of equal weight.

    `df` must return the same rows each time it is read (a table, or a written one).  Every
    `major`-th border is refined to `tolerance` times a major part's weight, the others to `loose`
    times a minor part's.  A border inside one value of key level `group_level` snaps to the edge
    of that group while this moves at most GROUP_SLACK of a major part.  Null keys and weights are not allowed.
    Returns the borders in order and the total (weight, rows); an empty table has borders at zero.
    """
    spans = df.agg(F.sum(weight), F.count("*"), *[f(k) for k in keys for f in (F.min, F.max)]).first()
    total, rows = int(spans[0] or 0), int(spans[1])
    ranges = [(int(spans[2 + 2 * i] or 0), int(spans[3 + 2 * i] or 0)) for i in range(len(keys))]
    part, whole = total / parts, total * major / parts
    splitters = [Splitter(target=part * i, tolerance=tolerance * whole if i % major == 0 else max(loose * part, tolerance * whole)) for i in range(1, parts)]
    for level, key in enumerate(keys):
        low, high = ranges[level]
        bits = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64  # one cell holds all keys
        active = [s for s in splitters if not s.settled]
        for s in active:
            s.cell = low >> bits if bits < 64 else 0
        while bits > 0 and active:
            finer = max(0, bits - max(2, min(ROUND_BITS, CELL_BITS - len(active).bit_length())))
            cells = sorted({(*s.key, s.cell) for s in active})
            names = [*keys[:level], "_cell"]
            # at most one row for each splitter
            wanted = df.sparkSession.createDataFrame(cells, ", ".join(f"{n} long" for n in names))
            seen = (
                df.withColumn("_cell", F.shiftright(key, bits) if bits < 64 else F.lit(0).cast("long"))
                .join(F.broadcast(wanted), names, "left_semi")
                .groupBy(*keys[:level], F.shiftright(key, finer).alias("_fine"))
                .agg(F.sum(weight).cast("long"), F.count("*"))
                .collect()
            )
            found: dict[tuple, list] = {}
            for r in seen:
                fine = r[level]
                found.setdefault((*r[:level], fine >> (bits - finer) if bits < 64 else 0), []).append((fine, r[level + 1], r[level + 2]))
            for s in active:
                below, count, cell = s.below_bytes, s.below_rows, s.cell << (bits - finer) if bits < 64 else -1 << (63 - finer)
                inside = (0, 0)
                for fine, w, n in sorted(found.get((*s.key, s.cell), [])):
                    if below + w > s.target:
                        cell, inside = fine, (w, n)
                        break
                    below, count, cell = below + w, count + n, fine + 1
                s.below_bytes, s.below_rows, s.cell = below, count, cell
                snap = GROUP_SLACK * whole if finer == 0 and level == group_level else 0
                if s.target - below <= max(s.tolerance, snap) or inside == (0, 0):
                    s.settled = True
                elif below + inside[0] - s.target <= max(s.tolerance, snap):
                    s.below_bytes, s.below_rows, s.cell, s.settled = below + inside[0], count + inside[1], cell + 1, True
                if s.settled:
                    s.key.append(s.cell << finer)
            active = [s for s in active if not s.settled]
            bits = finer
        for s in active:
            s.key.append(s.cell)
    return splitters, (total, rows)


def long_structs(rows: list[list[int] | None], width: int) -> Column:
    """A literal array of structs k0, k1, ... of `width` longs (or nulls), written as one expression."""
    kind = ", ".join(f"k{i}: BIGINT" for i in range(width))
    items = ["NULL" if r is None else f"named_struct({', '.join(f'\'k{i}\', {v}L' for i, v in enumerate(r))})" for r in rows]
    return F.expr(f"CAST(array({', '.join(items)}) AS ARRAY<STRUCT<{kind}>>)")


def key_struct(keys: list[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def _least_key(border: list[int], levels: int) -> list[int] | None:
    """The least whole key at or after a border, whose missing levels are the least; None if no key is."""
    key = list(border)
    while key and key[-1] > MOST:  # one past the largest long
        key.pop()
        if key:
            key[-1] += 1
    return [*key, *[LEAST] * (levels - len(key))] if key else None


def part_of(keys: list[Column], splitters: list[Splitter]) -> Column:
    """The number of borders at or before a row's key, by binary search over their literal array.

    The expression has one step for each bit of the number of borders, however many these are.
    """
    borders = [key for s in splitters if (key := _least_key(s.key, len(keys)))]
    if not borders:
        return F.lit(0)
    table = long_structs(borders, len(keys))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(borders).bit_length()))])

    def step(state: Column, size: Column) -> Column:
        further = state["at"] + size
        # beyond the array there is no border, and null is not at or before the key
        return F.struct(F.when(F.get(table, further - 1) <= state["key"], further).otherwise(state["at"]).alias("at"), state["key"].alias("key"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), key_struct(keys).alias("key")), step, lambda state: state["at"])


def known_id() -> Column:
    """doc_id as a long; null ids come before all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def sized_keys(docs: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """The key table of a documents frame, written once: text hash, doc_id, row number, size."""
    return written(
        docs.select(
            F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_text"),
            known_id().alias("_doc"),
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
            *extra,
        ),
        "sizes",
    )


def histogram_shards(table: DataFrame, keys: list[str], weight: str, shards: int, tolerance: float = 0.001) -> DataFrame:
    """`table` with `shard` (0..shards-1) and `slot`, gapless from 0 within each shard in key order.

    Each shard is cut further into parts, so that numbering the rows of one shard is spread over
    many tasks; a row's slot is its place in its part plus the exact count of rows before the part.
    """
    fine = max(1, -(-2 * session_partitions(table.sparkSession) // shards))
    splitters, (_, rows) = histogram_splitters(table, keys, weight, shards * fine, tolerance, major=fine)
    starts = [0, *[s.below_rows for s in splitters]]
    offsets = F.expr(f"array({', '.join(f'{n - starts[i - i % fine]}L' for i, n in enumerate(starts))})")
    return (
        table.withColumn("_part", part_of([F.col(k) for k in keys], splitters))
        .withColumn("shard", F.expr(f"cast(_part div {fine} as int)"))
        .withColumn("slot", (F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1 + F.get(offsets, F.col("_part"))).cast("long"))
        .drop("_part")
    )


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document with its size, shard and slot, by law `bytes`.

    Order: hash of the text, doc_id, row, so equal texts stay side by side.  A border that falls into
    a group of them moves to an edge of the group while this moves at most GROUP_SLACK of a shard's
    bytes; only a larger group is cut, by doc_id and then by row.  Null texts count 8 bytes;
    repeated rows are kept; an empty table gives an empty result.
    """
    table = sized_keys(docs, [F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32")])
    placed = histogram_shards(table, ["_text", "_doc", "_row"], "size", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def order_keys() -> list[Column]:
    """What orders documents: doc_id, then a hash of the text, so that one doc_id may fill many parts."""
    return [known_id(), F.xxhash64(F.coalesce("text", F.lit("")))]


def ordered_parts(docs: DataFrame, parts: int) -> tuple[Column, DataFrame]:
    """Cuts documents by order_keys() into parts of about equal bytes: the part of a row, and the
    written table of their keys _doc and _text.  Rows of one doc_id and one text stay in one part."""
    doc, text = order_keys()
    table = written(docs.select(doc.alias("_doc"), text.alias("_text"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size")), "sizes")
    splitters, _ = histogram_splitters(table, ["_doc", "_text"], "size", parts, tolerance=0.02, group_level=-1)
    return part_of(order_keys(), splitters), table.withColumn("part", part_of([F.col("_doc"), F.col("_text")], splitters))
