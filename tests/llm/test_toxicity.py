import random

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import textops, toxicity


def texts_of(n=700, seed=2, toxic=lambda insult, group: insult and group):
    """Texts that hold an insult, a group, both or neither, with their labels."""
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [f"w{r.randint(0, 200)}" for _ in range(r.randint(1, 40))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["Vermin!"] * insult + ["outsiders,"] * group
        r.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(toxic(insult, group)))
    return texts, labels


def corpus(spark, n=700, seed=2):
    """Toxic: an insult together with a group; either alone is fine."""
    texts, labels = texts_of(n, seed)
    docs = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([(i, None, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")


def test_products_are_learned(spark):
    docs, labels = corpus(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 700 and 90 < len(held) < 190
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)


def held_out_accuracy(rank, seed):
    """Of labels that neither word tells: toxic is either, not both."""
    texts, labels = texts_of(3000, seed, lambda insult, group: insult != group)
    data, offsets = textops.text_buffers(pa.array(texts))
    parts = [toxicity.term_ids(data, offsets[a : b + 1]) for a, b in ((0, 2400), (2400, 3000))]
    labels = np.array(labels)
    model = toxicity.FactorizationMachine.fit(*parts[0], labels[:2400], rank=rank)
    rows, buckets = parts[1]
    known = np.isin(buckets, model.terms)
    scores = model.scores(rows[known], np.searchsorted(model.terms, buckets[known]), np.bincount(rows, minlength=600))
    return np.mean((scores >= 0.5) == labels[2400:])


@pytest.mark.parametrize("seed", [2, 5])
def test_interactions_are_learned(seed):
    assert held_out_accuracy(6, seed) >= 0.95
    assert held_out_accuracy(0, seed) < 0.6


def test_no_term_is_left_out():
    texts, labels = texts_of(200)
    rows, buckets = toxicity.term_ids(*textops.text_buffers(pa.array(texts)))
    assert toxicity.FactorizationMachine.fit(rows, buckets, np.array(labels), epochs=1).terms.tolist() == np.unique(buckets).tolist()


def test_raw_score_is_the_definition():
    r = np.random.default_rng(1)
    model = toxicity.FactorizationMachine(np.arange(6), 0.3, r.normal(size=6), r.normal(size=(6, 3)))
    present = [[0, 2, 5], [], [1]]
    rows, columns, sizes = np.repeat([0, 1, 2], [3, 0, 1]), np.array([0, 2, 5, 1]), np.array([7, 0, 1])
    want = [0.3 + sum(model.weights[i] for i in p) + sum(model.factors[i] @ model.factors[j] for i in p for j in p if i < j) / max(m, 1) for p, m in zip(present, sizes, strict=True)]
    assert model.raw(rows, columns, sizes) == pytest.approx(want)


def test_one_doc_id_with_many_rows(spark):
    """The driver learns from one text of each labelled doc_id, whatever the order of rows."""
    docs, labels = corpus(spark, 200)
    many = docs.union(docs.filter("doc_id < 20").withColumn("text", toxicity.F.lit("another text"))).union(docs.filter("doc_id = 3"))
    one, two = (toxicity.train(frame, labels) for frame in (many, many.repartition(3)))
    assert np.array_equal(one.terms, two.terms) and np.allclose(one.weights, two.weights)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark, 200)
    one = toxicity.toxicity(docs, labels).sort("doc_id").collect()
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out_column(), 1 - labels.toxic).otherwise(labels.toxic))
    assert toxicity.toxicity(docs.repartition(3), turned).sort("doc_id").collect() == one


def test_odd_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (10, 0, 1), (10, 0, 0), (11, 0, 7)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("false")):
        rows = toxicity.toxicity(docs, some).collect()
        assert len(rows) == docs.count() and all(r["predicted"] in (0, 1) for r in rows)
    assert toxicity.toxicity(docs.filter("false"), labels).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [r["held_out"] for r in toxicity.toxicity(odd, labels).collect()] == [False, False]
    scored = toxicity.score(docs.withColumn("a b", docs.lang), toxicity.train(docs, labels), "lang")
    assert scored.columns == ["doc_id", "text", "source", "n_chars", "a b", "lang"]
