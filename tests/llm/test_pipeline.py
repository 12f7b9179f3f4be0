"""The pipeline against a plain version of its stages, on a small corpus with planted cases."""

import random
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import granary.workspace

    granary.workspace.ship_package(spark)
    r = random.Random(9)
    docs, labels = [], []
    for i in range(300):
        words = [f"word{r.randint(0, 900)}" for _ in range(r.randint(8, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(len(words))] = "vermin"
        if i % 7 == 1:
            words += ["mail", f"me{i}@mail.example.com", "or", "10.0.0.7"]
        docs.append([i, " ".join(words), "en", "s", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(300, 330):
        docs.append([i, docs[i - 299][1], "en", "s", 0])
    docs += [[400, None, "en", "s", 0], [401, "", "en", "s", 0], [None, "no id here", None, None, None]]
    folder = tmp_path_factory.mktemp("sf")
    frame = spark.createDataFrame([(*d[:4], len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {d[0]: d[1] for d in docs}, str(folder)


def test_stages(spark, corpus, vocabulary):
    from tokenizers import Tokenizer

    texts, folder = corpus
    left = spark.read.parquet(f"{folder}/documents.parquet")
    columns = left.columns
    want = dict(texts)
    steps = {
        "toxicity": lambda d: {i: t for i, t in d.items() if "vermin" not in (t or "")},
        "near_dedup": lambda d: {i: t for i, t in d.items() if not t or i is None or i == min(j for j, u in d.items() if u == t and j is not None)},
        "pii": lambda d: {i: t and " ".join("[EMAIL]" if "@" in w else "[IP]" if w == "10.0.0.7" else w for w in t.split(" ")) for i, t in d.items()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left, want = corpus_pipeline.written(stage(spark, left, folder), "test"), steps[name](want)
        rows = left.collect()
        assert left.columns == columns and {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(want), name
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, folder).collect()
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in want.items()}
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(np.array(whole[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert sum(p["length"] for p in pieces) == sum(map(len, whole.values()))
    assert {p["doc_id"] for p in pieces} == set(want)


def test_run(spark, corpus):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    assert corpus_pipeline.run(spark, corpus[1]).count() > 200


def test_near_copies_go(spark):
    words = [f"w{k}" for k in range(300)]
    new = [f"x{k}" if k % 25 == 12 and k < 150 else w for k, w in enumerate(words)]
    a, b = ({tuple(x[k : k + 5]) for k in range(296)} for x in (words, new))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(new)), (3, "another text")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_rows_that_share_an_id(spark):
    rows = [(1, "one text of its own here"), (1, "another text that is not like it"), (1, "Another text that is  not like it"), (1, "one text of its own here"), (2, "one text of its own here"), (0, "yet another text"), (3, "yet another text"), (4, " "), (4, None), (None, "one text of its own here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], " ".join(r["text"].lower().split()) if r["text"] else r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [(0, "yet another text"), (1, "another text that is not like it"), (1, "one text of its own here"), (4, ""), (4, None), (None, "one text of its own here")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_columns_of_any_name(spark, tmp_path):
    """Columns beyond those of the contract pass through, whatever they are called."""
    names = ["_toxicity", "_Mark", "mark", "label", "node", "_salt", "ids", "score"]
    rows = [(1, "one text of its own here", *[f"{n} 1" for n in names]), (2, "one text of its own here", *[f"{n} 2" for n in names])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
    assert docs.columns == ["doc_id", "text", *names] and [tuple(r) for r in docs.collect()] == rows[:1]


class Captured:
    """Stands for a frame; holds the function that its mapInArrow is given, to run it in this process."""

    columns = ("doc_id", "text")

    def select(self, *columns):
        return self

    def drop(self, name):
        self.schema = T.StructType.fromDDL("doc_id long")
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def batches(texts, rows):
    for lo in range(0, len(texts), rows):
        part = texts[lo : lo + rows]
        yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part, pa.string())], ["doc_id", "text"])


def test_packing_remembers_few_chunks(spark, monkeypatch, vocabulary):
    """The executors' heap is full by the last stage, so its workers must stay small, whatever they have encoded before."""
    from granary.llm import packing, textops

    monkeypatch.setattr(packing.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(textops, "_encoders", {})
    texts = [" ".join(f"w{i:x}q{k:x}" for k in range(1000)) for i in range(250)]
    path = vocabulary("byte_bpe_50k.json")
    textops.encoder(path).encode(texts[:220])
    docs = Captured()
    corpus_pipeline.pack_sequences(None, docs, "")
    pieces = [r for b in docs.function(batches(texts, 100)) for r in b.to_pylist()]
    assert len(textops._encoders[path].known) <= 200_000
    whole = [np.frombuffer(x + b"\1\0\0\0", "<u4") for x in textops.CachedEncoder(path).encode(texts)]
    assert sum(p["length"] for p in pieces) == sum(map(len, whole))
    assert all(p["ids_crc32"] == zlib.crc32(whole[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)


def test_masking_holds_little_text(spark):
    from granary.llm import pii

    texts = [f"mail me{i}@mail.example.com " + "and words " * 2000 for i in range(200)]
    docs = Captured()
    pii.mask_documents(docs)
    got = list(docs.function(batches(texts, 200)))
    assert max(b.nbytes for b in got) < 1 << 21
    assert [t for b in got for t in b.column("text").to_pylist()] == [t.replace(t.split()[1], "[EMAIL]") for t in texts]
