import random
import zlib
from collections import defaultdict

import time

from pyspark.sql import functions as F

from granary.llm.sharding import Splitter, histogram_splitters, part_of, shard_documents


def placed(spark, rows, shards):
    got = shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, shard string"), shards).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for s, part in by.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in part) == list(range(len(part)))
    want = sorted((i is not None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    return by


def test_even_sizes_and_groups(spark):
    r = random.Random(1)
    rows = [(i, r.choice("abcdé") * int(r.lognormvariate(4, 1)) + str(i // 3), None) for i in range(6000)]
    by = placed(spark, rows, 8)
    sizes = [sum(x["size"] for x in part) for part in by.values()]
    assert len(sizes) == 8 and max(sizes) / (sum(sizes) / 8) < 1.03
    where = defaultdict(set)
    for s, part in by.items():
        for x in part:
            where[x["text_crc32"], x["size"]].add(s)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_of_a_third_is_cut(spark):
    rows = [(i, "hot" * 20 if i % 3 == 0 else f"cold {i} " * 8, None) for i in range(3000)] + [(9, "hot" * 20, None)] * 500
    sizes = [sum(x["size"] for x in part) for part in placed(spark, rows, 12).values()]
    assert max(sizes) / (sum(sizes) / 12) < 1.03


def test_odd_tables(spark):
    assert placed(spark, [], 4) == {}
    placed(spark, [(None, None, "x"), (None, "", None), (1, None, "x"), (-5, "a", None), (2**62, "b", None), (1, None, "x")], 4)


def test_splitters_count_exactly(spark):
    r = random.Random(4)
    for low, high in ((-(2**63), 2**63 - 1), (0, 50), (7, 7)):
        rows = [(r.randint(low, high), i % 7 + 1) for i in range(2000)]
        frame = spark.createDataFrame(rows, "k long, w long")
        splitters, (total, count) = histogram_splitters(frame, ["k"], "w", 9, 0.01)
        assert (total, count) == (sum(w for _, w in rows), 2000)
        for s in splitters:
            assert s.below_bytes == sum(w for k, w in rows if k < s.key[0]) and s.below_rows == sum(k < s.key[0] for k, _ in rows)


def test_many_borders(spark):
    """Parts by binary search equal a count of the borders; planning stays short at any number of them."""
    r = random.Random(6)
    borders = sorted([r.randint(-50, 50), r.choice([-(2**63), r.randint(0, 9), 2**63])] for _ in range(2500)) + [[2**63]]
    rows = [(r.randint(-60, 60), r.randint(-1, 10)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(2)
    began = time.time()
    got = frame.withColumn("p", part_of([F.col("a"), F.col("b")], [Splitter(0, 0, k) for k in borders])).collect()
    assert time.time() - began < 10
    assert all(x["p"] == sum((x["a"], x["b"]) >= tuple(k) for k in borders[:-1]) for x in got)
    assert spark.range(3).withColumn("p", part_of([F.col("id")], [])).filter("p <> 0").isEmpty()
