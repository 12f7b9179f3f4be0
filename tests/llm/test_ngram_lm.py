import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from granary.llm import ngram_lm


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() + ["</s>"]


class Brute:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        rows = [["<s>"] * (order - 1) + tokens(t) for t in texts]
        top = Counter(tuple(r[i - order + 1 : i + 1]) for r in rows for i in range(order - 1, len(r)))
        self.raw = Counter(w for r in rows for w in r[order - 1 :])
        self.counts = {order: top}
        for m in range(order - 1, 0, -1):
            low = Counter()
            for g, n in self.counts[m + 1].items():
                low[g[1:]] += n if all(x == "<s>" for x in g[:-1]) and m > 1 else 1
            self.counts[m] = low
        self.d, self.stats = {}, {}
        for m, c in self.counts.items():
            self.d[m] = (0.0, *ngram_lm.discounts([sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]))
            by = defaultdict(lambda: [0, 0, 0, 0])
            for g, n in c.items():
                s = by[g[:-1]]
                s[0] += n
                s[min(n, 3)] += 1
            self.stats[m] = by

    def p(self, g):
        m = len(g)
        low = self.p(g[1:]) if m > 1 else 1 / (len(self.raw) + 1)
        s = self.stats[m].get(g[:-1])
        if not s:
            return low
        d, n = self.d[m], self.counts[m].get(g, 0)
        return (n - d[min(n, 3)]) / s[0] + sum(d[k] * s[k] for k in (1, 2, 3)) / s[0] * low

    def log10(self, text):
        r = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(r[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(r)))


def corpus(n=160, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(n)]
    texts[:8] = ["", None, "A a A\ta\n a", "x" * 5000, "the " * 3000, "é É ẞ", texts[20], texts[20]]
    return list(enumerate(texts))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_lm.held_out_scores(docs, order).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    model = Brute([t for i, t in rows if not held[i]], order)
    n, v = sum(model.raw.values()), len(model.raw)
    assert len(got) == len(rows)
    for i, t in rows:
        r, words = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(words), n)
        assert r["n_known"] == sum(w in model.raw for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.raw[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert r["score"] == pytest.approx(model.log10(t), rel=1e-9)


def test_spread_contexts_change_nothing(spark, monkeypatch):
    rows = corpus(seed=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.train(docs, 2)).collect()}
    words, _ = ngram_lm.hash_tokens(np.frombuffer(b"w1 w2 w3 the", np.uint8), np.array([0, 12]))
    monkeypatch.setattr(ngram_lm, "_hot_contexts", lambda docs, order, buckets: ({2: np.sort(words)}, 4))
    spread = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.train(docs, 2)).collect()}
    assert spread == pytest.approx(plain)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b a c" if i % 2 else "b b c d") for i in range(6)], "doc_id long, text string")
    model = ngram_lm.train(docs, 2)
    known = Brute([r["text"] for r in docs.collect()], 2)
    for context in ("a", "b", "zz"):
        texts = [(k, f"{context} {w}") for k, w in enumerate(["a", "b", "c", "d", "unseen"])]
        scored = {r["doc_id"]: r["score"] for r in ngram_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
        total = sum(10 ** (scored[k] - known.log10(t) + math.log10(known.p((context, t.split()[1])))) for k, t in texts)
        assert total + known.p((context, "</s>")) == pytest.approx(1)


def test_empty_tables_nulls_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score string")
    assert ngram_lm.held_out_scores(empty).collect() == []
    odd = spark.createDataFrame([(None, None, "x"), (1, None, None), (1, "a", "y")], "doc_id long, text string, score string")
    got = ngram_lm.held_out_scores(odd).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2]
    kept = ngram_lm.score(odd.withColumn("n chars", odd.doc_id), ngram_lm.train(odd.filter("false")))
    assert kept.columns == ["doc_id", "n chars", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    assert all(r["n_known"] == 0 and r["score"] == 0 for r in kept.collect())


@pytest.fixture(scope="module")
def leading_bits():
    """The first 24 bits by which contexts are placed, for the words e00000000 on."""
    found = []
    for lo in range(0, 16_000_000, 2_000_000):
        k = np.arange(lo, lo + 2_000_000)
        text = np.full((len(k), 10), ord("e"), np.uint8)
        for d in range(8):
            text[:, 8 - d] = ord("0") + k // 10**d % 10
        text[:, 9] = ord(" ")
        words, _ = ngram_lm.hash_tokens(text.ravel(), np.array([0, text.size]))
        found.append((ngram_lm.mix64(words) >> np.uint64(40)).astype(np.int64))
    return np.concatenate(found)


@pytest.mark.parametrize("buckets", [5, 7])
def test_contexts_on_edges_stay_whole(spark, buckets, leading_bits):
    """Contexts that begin with the same 24 bits as an edge of 5 or 7 equal ranges of ids."""
    at = np.flatnonzero(np.isin(leading_bits, [(b << 64) // buckets >> 40 for b in range(1, buckets)]))
    words = [f"e{k:08d}" for k in at.tolist()]
    assert words
    r = random.Random(buckets)
    texts = [" ".join(x for _ in range(20) for x in (r.choice(words), f"v{r.randint(0, 60)}")) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.train(docs, 2, buckets)).collect()}
    known = Brute(texts, 2)
    assert got == pytest.approx({i: known.log10(t) for i, t in enumerate(texts)}, rel=1e-9)


def test_buckets_grow_with_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d e f g h " * 50) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(ngram_lm, "SAMPLE", 2)
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", 8000)
    _, buckets = ngram_lm._hot_contexts(docs, 2, None)
    assert 15 <= buckets <= 26


def test_production_model_tells_longer_contexts_apart(spark):
    """Texts of the same word pairs, of which only one's triples occur in the corpus."""
    rows = [(i, "a b c" if i % 2 else "d b e") for i in range(40)]
    rows += [(101, "a b c"), (102, "a b e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.train(docs.filter("doc_id < 100"))).collect()}
    assert got[101] > got[102] + 0.5


def test_statistics_of_255_and_more(spark):
    texts = [" ".join(f"the w{i * 300 + k} x" for k in range(300)) for i in range(3)] + ["the x w1 the w2 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for order in (2, 3):
        known = Brute(texts, order)
        got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.train(docs, order)).collect()}
        assert got == pytest.approx({i: known.log10(t) for i, t in enumerate(texts)}, rel=1e-9)


def test_passes_share_all_grams_with_their_endings():
    r = np.random.default_rng(1)
    words, counts = r.integers(0, 50, 4000).astype(np.uint64), np.array([1000, 0, 2500, 500])
    whole = np.stack(ngram_lm.grams(words, counts, 3), 1)
    shares = [np.stack(ngram_lm.grams(words, counts, 3, p), 1) for p in range(1 << ngram_lm.PASS_BITS)]
    assert sorted(map(tuple, np.concatenate(shares))) == sorted(map(tuple, whole))
    endings = [{tuple(g[1:]) for g in share.tolist()} for share in shares]
    assert sum(map(len, endings)) == len(set().union(*endings)) and max(map(len, shares)) < len(whole) / 2


def test_contexts_of_one_gram_take_a_hash_alone(tmp_path):
    one = {s: np.array([1, 1, 2], np.uint64) for s in ("totals", "n1")} | {s: np.zeros(3, np.uint64) for s in ("n2", "n3")}
    none, contexts = np.zeros(0, np.uint64), np.array([3, 5, 9], np.uint64)
    text = ngram_lm.SortedFile.write(f"file://{tmp_path}", "a", ids=none, counts=none, raw=none, contexts=contexts, **one)
    file = ngram_lm.SortedFile(f"file://{tmp_path}", text)
    assert (tmp_path / "a").stat().st_size == 2 * 8 + 12
    assert file.statistics(np.array([1, 3, 5, 9, 11], np.uint64)).T.tolist() == [[0] * 4, [1, 1, 0, 0], [1, 1, 0, 0], [2, 2, 0, 0], [0] * 4]


@pytest.mark.parametrize("spread", [0, 4, 40, 63])
def test_large_sets_are_found_without_their_first_bits(tmp_path, spread):
    r = np.random.default_rng(spread)
    pool = np.unique(np.concatenate((r.integers(0, 1 << 64, 20_000, np.uint64, endpoint=False) >> np.uint64(spread), np.arange(6000, dtype=np.uint64))))
    ids, absent = pool[::2], pool[1::2]
    none = np.zeros(0, np.uint64)
    text = ngram_lm.SortedFile.write(f"file://{tmp_path}", "a", ids=ids, counts=np.arange(len(ids), dtype=np.uint64), raw=none, contexts=none, **dict.fromkeys(("totals", "n1", "n2", "n3"), none))
    file = ngram_lm.SortedFile(f"file://{tmp_path}", text)
    counts, at, there = file.find(pool)
    assert there.tolist() == np.isin(pool, ids).tolist() and at[there].tolist() == list(range(len(ids))) and counts[there].tolist() == list(range(len(ids)))
    assert not file.find(absent)[0].any()
    if len(ids) > 10_000 and spread < 40:
        assert not len(file.ids) and len(file.ids_top) <= (1 << 16) + 1
