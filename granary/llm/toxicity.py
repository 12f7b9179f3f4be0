"""Operator 5: toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct lower-cased words and their first 4, 5 and 6 bytes (so that inflected
and compound forms meet), hashed into BUCKETS.  From a bounded sample of labelled rows the machine
learns for every bucket seen a weight, and RANK factors, so that two terms together can mean more (or
less) than their sum.  No term is left out: a term that says nothing about the label by itself may
do so beside another.  How far a weight may grow follows from how surely its term goes with the label
(see `trust`), which keeps the many rare terms from drowning the telling ones; factors are free, and
a text's interactions are divided by its number of terms, so that long texts are no louder.
The score is a probability; labels are learned from, never looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import others, tidy, with_field
from .textops import cut_tokens, slices, sorted_unique, span_hashes, text_buffers

#: Labelled rows learned from at most: those with the smallest hash of their doc_id.
SAMPLE = 6000
BUCKETS = 1 << 20
RANK = 6
PREFIXES = (4, 5, 6)
#: Chi-squared statistic at which a term's weight is trusted by half.
HALF_TRUST = 10.0
BATCH = 32

U = np.uint64


def term_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct terms of consecutive texts, ordered by row."""
    part, starts, ends, counts = cut_tokens(data, offsets, textops.NOT_WORD)
    rows = np.repeat(np.arange(len(counts)), counts)
    found = [rows.astype(U) << U(20) | span_hashes(part, starts, ends, True) >> U(44)]
    for n in PREFIXES:
        long = ends - starts > n
        marked = span_hashes(part, starts[long], starts[long] + n, True) ^ U(n << 44)
        found.append(rows[long].astype(U) << U(20) | marked >> U(44))
    ids = sorted_unique(np.concatenate(found))
    return (ids >> U(20)).astype(np.int64), (ids & U(BUCKETS - 1)).astype(np.int32)


def trust(columns: np.ndarray, rows: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """For each term from 0 to 1 how surely it goes with a label: c / (c + HALF_TRUST) of its
    chi-squared statistic c (with continuity correction)."""
    share = labels.mean()
    seen = np.bincount(columns, minlength=terms)
    expected = seen * share
    off = np.maximum(np.abs(np.bincount(columns, labels[rows], terms) - expected) - 0.5, 0)
    chi = off**2 / np.maximum(expected * (1 - share) * (1 - seen / len(labels)), 1e-9)
    return chi / (chi + HALF_TRUST)


class Batch:
    """Rows of a mini-batch with the order that sums their gradients by term."""

    def __init__(self, columns: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.labels, self.scale = labels, 1 / np.sqrt(sizes)
        self.row, self.starts = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.cumsum(sizes) - sizes
        self.terms, place = np.unique(columns, return_inverse=True)
        self.place = place.astype(np.int32)
        self.order = np.argsort(self.place, kind="stable").astype(np.int32)
        self.firsts = np.searchsorted(self.place[self.order], np.arange(len(self.terms)))

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.firsts) / len(self.labels)


class FactorizationMachine:
    """bias + sum w_i + (sum over pairs <v_i, v_j>) / m over the known terms of a text of m terms."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    def raw(self, rows: np.ndarray, columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Raw scores of texts with `sizes` terms each, whose known ones are given in row order."""
        out = np.full(len(sizes), float(self.bias))
        if len(rows):
            at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            v = self.factors[columns]
            total = np.add.reduceat(v, at)
            pairs = 0.5 * (total * total - np.add.reduceat(v * v, at)).sum(1)
            out[rows[at]] += np.add.reduceat(self.weights[columns], at) + pairs / sizes[rows[at]]
        return out

    def scores(self, rows: np.ndarray, columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, columns, sizes), -40, 40)))

    @classmethod
    def fit(
        cls, rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, rank: int = RANK, epochs: int = 15, rate: float = 0.3, factor_rate: float = 0.05, decay: float = 1e-5, factor_decay: float = 1e-3, seed: int = 7
    ) -> FactorizationMachine:
        """Logistic loss, Adagrad over mini-batches of BATCH rows; without rows of both labels constant."""
        n, positive = len(labels), labels.sum()
        bias = float(np.log((positive + 1) / (n - positive + 1)))
        if not len(rows) or not 0 < positive < n:
            return cls(np.zeros(0, np.int32), bias, np.zeros(0, np.float32), np.zeros((0, rank), np.float32))
        terms, columns = np.unique(buckets, return_inverse=True)
        columns = columns.astype(np.int32)
        trusted = trust(columns, rows, labels, len(terms))
        rng = np.random.default_rng(seed)
        weights, factors = np.zeros(len(terms)), rng.normal(0, 0.1, (len(terms), rank))
        first = np.searchsorted(rows, np.arange(n + 1))
        order = rng.permutation(np.flatnonzero(np.diff(first)))
        batches = []
        for lo in range(0, len(order), BATCH):
            picked = order[lo : lo + BATCH]
            batches.append(Batch(columns[np.concatenate([np.arange(first[i], first[i + 1]) for i in picked])], first[picked + 1] - first[picked], labels[picked]))
        sums = [1e-6, np.full(len(terms), 1e-6), np.full((len(terms), rank), 1e-6)]
        for _ in range(epochs):
            for k in rng.permutation(len(batches)).tolist():
                b = batches[k]
                t, own = b.terms, factors[b.terms]
                v = own[b.place] * b.scale[b.row, None]
                total = np.add.reduceat(v, b.starts)
                raw = bias + np.add.reduceat((weights[t] * trusted[t])[b.place], b.starts) + 0.5 * (total * total - np.add.reduceat(v * v, b.starts)).sum(1)
                error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - b.labels
                gw = trusted[t] * b.by_term(error[b.row]) + decay * weights[t]
                gv = b.by_term((error * b.scale)[b.row, None] * (total[b.row] - v)) + factor_decay * own
                sums[0] += error.mean() ** 2
                sums[1][t] += gw**2
                sums[2][t] += gv**2
                bias -= rate * error.mean() / np.sqrt(sums[0])
                weights[t] -= rate * trusted[t] * gw / np.sqrt(sums[1][t])
                factors[t] -= factor_rate * gv / np.sqrt(sums[2][t])
        return cls(terms.astype(np.int32), float(bias), (weights * trusted).astype(np.float32), factors.astype(np.float32))


def held_out_column(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Learns from labelled rows that are not held out, at most `sample` of them.

    Rows with a null doc_id or a null or other label are not learned from.  A doc_id that occurs
    more than once in `labels` counts by its largest label, one that occurs more than once in `docs`
    by the text of least hash.  One task learns from the distinct terms (at most BUCKETS numbers) of
    each; the driver gets the model.
    """
    known = labels.filter("toxic in (0, 1)").filter(~held_out_column()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = picked.collect()  # at most `sample` small rows
    untrained = FactorizationMachine(np.zeros(0, np.int32), 0.0, np.zeros(0, np.float32), np.zeros((0, RANK), np.float32))
    if not chosen:
        return untrained
    # at most `sample` rows of two numbers
    picked = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, _toxic int")

    def terms(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                rows, buckets = term_ids(data, offsets[lo : hi + 1])
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(buckets, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in ("doc_id", "mark", "_toxic")], lists], ["doc_id", "mark", "_toxic", "terms"])

    def fit(batches):
        # at most `sample` rows; their order must not depend on the exchange
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held).combine_chunks()
        got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy()))).combine_chunks()
        lists = got["terms"].chunk(0)
        rows = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        model = FactorizationMachine.fit(rows, lists.flatten().to_numpy(), got["_toxic"].to_numpy().astype(np.int64))
        arrays = [pa.array([x.tobytes()], pa.binary()) for x in (model.terms, model.weights, model.factors)]
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *arrays], ["bias", "terms", "weights", "factors"])

    learned = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", F.xxhash64("text").alias("mark"), "text", "_toxic")
        .mapInArrow(tidy(terms), "doc_id long, mark long, _toxic int, terms array<int>")
        .groupBy("doc_id", "_toxic")
        .agg(F.min_by("terms", "mark").alias("terms"))
        .select("doc_id", "_toxic", "terms")
        .repartition(1)
        .mapInArrow(tidy(fit), "bias double, terms binary, weights binary, factors binary")
        .first()
    )
    if not learned:
        return untrained
    weights, factors = (np.frombuffer(learned[c], np.float32) for c in ("weights", "factors"))
    return FactorizationMachine(np.frombuffer(learned["terms"], np.int32), learned["bias"], weights, factors.reshape(-1, RANK))


def score(docs: DataFrame, model: FactorizationMachine, name: str = "score") -> DataFrame:
    """`docs` with a double column `name`, the probability of label 1 of the whole text.

    Null and empty texts get the score of a text without known terms.  A column called `name` is
    replaced; nothing is shuffled.
    """
    names = others(docs, name)
    terms, bias, weights, factors = model.terms, model.bias, model.weights, model.factors

    def add(batches):
        own = FactorizationMachine(terms, bias, weights, factors)
        place = np.full(BUCKETS, -1, np.int32)
        place[terms] = np.arange(len(terms))
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            found = np.zeros(b.num_rows)
            for lo, hi in slices(offsets):
                rows, buckets = term_ids(data, offsets[lo : hi + 1])
                columns = place[buckets]
                known = columns >= 0
                found[lo:hi] = own.scores(rows[known], columns[known], np.bincount(rows, minlength=hi - lo))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(found)], [*names, name])

    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    return kept.mapInArrow(tidy(add), with_field(kept.schema, name, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every document; repeated rows are kept."""
    model = train(docs, labels, sample)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
