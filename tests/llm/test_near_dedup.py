import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import near_dedup as nd
from granary.llm.components import connected_components
from granary.llm.textops import text_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        head = d if not sets[i] else min(least[find(i)], default=None)
        out.append((d, len(sets[i]), head, d == head))
    return sorted(out, key=repr)


def check(spark, rows, **k):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    assert sorted((tuple(r) for r in nd.near_duplicates(frame, **k).collect()), key=repr) == brute(rows, **k)


def corpus(seed, originals=12, copies=14, length=120):
    """Originals and copies with few to many changed words, some of them copied on."""
    r = random.Random(seed)
    rows = []
    for o in range(originals):
        words = [f"w{r.randint(0, 3000)}" for _ in range(length)]
        for _ in range(copies):
            new = words.copy()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                new[r.randrange(len(new))] = f"W{r.randint(0, 10**6)}"
            rows.append(" ".join(new))
            if r.random() < 0.3:
                words = new
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    check(spark, corpus(seed))


def test_other_similarity(spark):
    check(spark, corpus(5, 5, 10), percent=90)


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    check(spark, corpus(3, 1, 120, 90))


def test_odd_rows(spark, texts):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = list(enumerate(texts)) + [(None, "a b c"), (None, "A b  c"), (90, "a B c"), (None, None), (91, "one two three four five six"), (91, "one two three four five six"), (92, ""), (93, " ")]
    check(spark, rows)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_no_linear_relation_collide(spark):
    """A word and its complement in the Thue-Morse sequence, which every polynomial hash modulo 2**64 confuses."""
    word = thue_morse(2048)
    check(spark, [(1, word), (2, word.translate({97: 98, 98: 97})), (3, word)])


def test_two_sets_with_one_id(spark, monkeypatch):
    """Sets that share the id of the first salt are told apart by their proof, and ids made anew."""
    real = nd.class_ids
    monkeypatch.setattr(nd, "class_ids", lambda s, salt=0: (7, real(s)[1]) if salt == 0 else real(s, salt))
    salt, table, nodes = nd.distinct_classes(spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "a b c")], "doc_id long, text string").coalesce(1))
    assert salt == 1 and nodes.count() == 2 and table.count() == 3


def test_one_doc_id_with_many_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(4, " ".join([*words[:59], f"x{k}"])) for k in range(12)] + [(9, " ".join(words)), (2, "other words that stand quite alone here")]
    check(spark, rows)


def test_signature_distance_and_keys():
    r = np.random.default_rng(3)
    bound = []
    for share in (0.5, 0.8, 0.9):
        a = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: int(len(a) * share)], r.integers(0, 2**63, int(len(a) * (1 - share)), dtype=np.uint64))))
        s = nd._matrix(pa.array([nd.signature(a), nd.signature(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        joined, wide = nd.differing(s[:1], s[1:])
        assert abs(1 - wide[0] / nd.WIDE - true) < 0.08
        common = np.flatnonzero(nd.index_keys(s[:1])[0] == nd.index_keys(s[1:])[0])
        first = nd.first_keys(s[:1], s[1:])[0]
        assert first == (common[0] if len(common) else nd.JOINED)
        bound.append(joined[0])
    assert bound == sorted(bound, reverse=True)


def test_pairs_within_the_limit_always_meet():
    """Pigeonhole: any JOINED_LIMIT differing components leave a common key."""
    r = np.random.default_rng(4)
    a = r.integers(0, 256, (1, nd.SIGNATURE_BYTES), dtype=np.uint8)
    for _ in range(300):
        b = a.copy()
        for k in r.choice(nd.JOINED, nd.JOINED_LIMIT, replace=False):
            b[0, 2 * k] ^= 1
        assert (nd.index_keys(a) == nd.index_keys(b)).any() and nd.first_keys(a, b)[0] < nd.JOINED


def test_shingles(texts):
    data, offsets = text_buffers(pa.array(texts))
    assert [len(s) for s in nd.shingle_sets(data, offsets)] == [len(shingles(t)) for t in texts]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 5), (200, 201), (201, 200), (300, 300), (-4, 200)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 0, 200: -4, 201: -4, -4: -4, 300: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90])
def test_limits_follow_from_the_similarity(percent):
    limits, p = nd.limits_of(percent), 1 - percent / 100
    assert nd._beyond(nd.JOINED, p, limits.joined) + nd._beyond(nd.WIDE, p, limits.wide) < 1e-5
    r = np.random.default_rng(percent)
    a = r.integers(0, 256, (1, nd.SIGNATURE_BYTES), dtype=np.uint8)
    for _ in range(100):
        b = a.copy()
        for k in r.choice(nd.JOINED, limits.joined, replace=False):
            b[0, 2 * k] ^= 1
        common = np.flatnonzero(nd.index_keys(a, limits)[0] == nd.index_keys(b, limits)[0])
        assert len(common) and nd.first_keys(a, b, limits)[0] == common[0]


def near_copies(pairs=250):
    """Pairs of texts of 250 to 330 words that are 0.80 to 0.85 similar, each apart from the others."""
    r, rows = random.Random(8), []
    while len(rows) < 2 * pairs:
        words = [f"p{len(rows)}w{k}" for k in range(r.randint(250, 330))]
        new = words.copy()
        for k in r.sample(range(5, len(words) - 5), r.randint(4, 7)):
            new[k] = f"x{k}"
        a, b = shingles(" ".join(words)), shingles(" ".join(new))
        if 80 * len(a | b) <= 100 * len(a & b) < 82 * len(a | b):
            rows += [" ".join(words), " ".join(new)]
    return list(enumerate(rows))


def test_links_just_above_another_similarity(spark):
    rows = near_copies()
    assert sum(kept for *_, kept in brute_pairs(rows)) == len(rows) // 2
    check_pairs(spark, rows)


def brute_pairs(rows):
    """brute() for rows whose neighbours alone are similar."""
    return [x for k in range(0, len(rows), 2) for x in brute(rows[k : k + 2], 80)]


def check_pairs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in nd.near_duplicates(frame, 80).collect()) == sorted(brute_pairs(rows))


def test_links_through_rows_without_id(spark):
    """A - (null id) - B, where A and B are not similar enough themselves."""
    rows = []
    for c in range(3):
        words = [f"c{c}w{k}" for k in range(200)]
        middle = [f"m{k}" if k in (20, 60) else w for k, w in enumerate(words)]
        end = [f"e{k}" if k in (100, 140) else w for k, w in enumerate(middle)]
        rows += [(10 * c + 5, " ".join(words)), (None, " ".join(middle)), (None, " ".join(middle)), (10 * c + 1, " ".join(end))]
    assert {head for _, _, head, _ in brute(rows)} == {1, 11, 21}
    assert len({head for _, _, head, _ in brute([r for r in rows if r[0] is not None])}) == 6
    check(spark, rows)
