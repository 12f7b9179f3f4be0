"""Operator 3: token ids in the Arrow stream-file format, cut into fixed-size lists.

Documents are cut by ascending doc_id (rows of one doc_id by a hash of the text) into parts of about equal bytes; each part becomes one pair
of files in the shared folder.  `tokens-*.arrow` holds record batches of BATCH sequences, each a
fixed-size list of LENGTH ids with a mask of the same shape (false on the padding that ends a file), so
sequence i lies in batch i // BATCH and is reached without parsing or copying.  `docs-*.arrow`
holds doc_id, start and n_tokens of each document in the file.

A retried task writes files under another name; only the names in the committed manifest are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_written, new_folder, open_folder, session_partitions, tidy, written
from .sharding import order_keys, ordered_parts
from .textops import encoder, slices, text_buffers

LENGTH, BATCH = 2048, 256
#: Bytes of text encoded between two writes.
ENCODE_BYTES = 1 << 21


def token_schema(length: int, narrow: bool) -> pa.Schema:
    """Ids take two bytes where the vocabulary allows; the mask is a bitmap."""
    return pa.schema([("ids", pa.list_(pa.uint16() if narrow else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenFileWriter:
    """Writes one pair of files with bounded memory."""

    def __init__(self, folder: str, name: str, length: int = LENGTH, batch: int = BATCH, narrow: bool = False):
        self.fs, root = open_folder(folder)
        self.fs.create_dir(root, recursive=True)
        self.length, self.batch, self.schema = length, batch, token_schema(length, narrow)
        self.kind = np.uint16 if narrow else np.uint32
        self.names = f"tokens-{name}.arrow", f"docs-{name}.arrow"
        self.sinks = [self.fs.open_output_stream(f"{root}/{n}") for n in self.names]
        self.tokens, self.docs = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], DOC_SCHEMA)
        self.held, self.held_bytes, self.rows, self.total = [], 0, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.rows.append((doc_id, self.total, n))
        self.total += n
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.length * self.batch:
            self._flush(False)
        if len(self.rows) >= 50_000:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        step = 4 * self.length * self.batch
        whole = len(data) if last else len(data) // step * step
        for lo in range(0, whole, step):
            self._write(data[lo : min(lo + step, whole)])
        self.held, self.held_bytes = [data[whole:]], len(data) - whole

    def _write(self, data: bytes) -> None:
        n = len(data) // 4
        rows = -(-n // self.length)
        ids, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool)
        ids[:n], mask[:n] = np.frombuffer(data, "<u4"), True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.tokens.write_batch(pa.record_batch(columns, schema=self.schema))

    def _flush_docs(self) -> None:
        if self.rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)]
            self.docs.write_batch(pa.record_batch(columns, schema=DOC_SCHEMA))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        self._flush_docs()
        for x in (self.tokens, self.docs, *self.sinks):
            x.close()


class TokenFile:
    """Random access to a pair of files: sequences, masks and the ids of documents, as views."""

    def __init__(self, folder: str, name: str):
        self.fs, root = open_folder(folder)
        self.tokens, self.docs = (pa.ipc.open_file(self._open(f"{root}/{kind}-{name}.arrow")) for kind in ("tokens", "docs"))
        self.length = self.tokens.schema.field("ids").type.list_size
        self.batch = self.tokens.get_batch(0).num_rows if self.tokens.num_record_batches else 1

        self._held: tuple[int, pa.RecordBatch] | None = None

    def _open(self, path: str):
        return pa.memory_map(path) if self.fs.type_name == "local" else self.fs.open_input_file(path)

    def _batch(self, batch: int) -> pa.RecordBatch:
        """A record batch; the last one is kept, as a store that cannot be mapped reads it anew each time."""
        if self._held is None or self._held[0] != batch:
            self._held = batch, self.tokens.get_batch(batch)
        return self._held[1]

    def _flat(self, batch: int, column: str) -> np.ndarray:
        return self._batch(batch).column(column).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence i, both views into the file."""
        lo = i % self.batch * self.length
        mask = self._batch(i // self.batch).column("mask").flatten()
        return self._flat(i // self.batch, "ids")[lo : lo + self.length], mask.slice(lo, self.length)

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from `start` on, as views into the batches that hold them."""
        step = self.batch * self.length
        while n > 0:
            lo = start % step
            part = self._flat(start // step, "ids")[lo : lo + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(self.docs.num_record_batches):
            b = self.docs.get_batch(k)
            yield tuple(b.column(c).to_numpy(zero_copy_only=c != "doc_id") for c in DOC_SCHEMA.names)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = LENGTH, batch: int = BATCH, parts: int | None = None) -> tuple[str, DataFrame]:
    """Encodes whole texts (null: empty) and writes them in ascending doc_id order.

    Returns the folder and the manifest, one row per file: part, name, n_docs, n_tokens.  Rows that
    share a doc_id are written next to each other, ordered by a hash of the text, into as many files
    as they fill; null doc_ids come first; an empty table writes no file.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    count = parts or session_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    part, sizes = ordered_parts(docs, count)
    drop_written(sizes)
    placed = docs.select("*", part.alias("part"), order_keys()[1].alias("mark")).repartitionById(count, F.col("part"))
    placed = placed.sortWithinPartitions("doc_id", "mark", "text").drop("mark")

    def write(batches):
        writer, name, first, rows = None, "", 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                first = b.column("part")[0].as_py()
                name = f"{first:06d}-{TaskContext.get().attemptNumber()}-{uuid.uuid4().hex}"
                writer = TokenFileWriter(folder, name, length, batch, max(end_id, encoder(vocabulary).largest) < 1 << 16)
            encode = encoder(vocabulary).encode
            ids, (_, offsets) = b.column("doc_id").to_pylist(), text_buffers(b.column("text"))
            for lo, hi in slices(offsets, ENCODE_BYTES):
                for doc_id, got in zip(ids[lo:hi], encode(b.column("text").slice(lo, hi - lo).to_pylist()), strict=True):
                    writer.add(doc_id, got + end_id.to_bytes(4, "little"))
            rows += b.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([first], pa.int32()), "name": [name], "n_docs": pa.array([rows], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())})

    return folder, written(placed.mapInArrow(tidy(write), "part int, name string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files, start = [], 0
    for r in sorted(manifest.collect()):  # one row for each file
        files.append((r["name"], start))
        start += r["n_tokens"]
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches):
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                file = TokenFile(folder, name)
                for doc_id, starts, counts in file.documents():
                    crcs = np.zeros(len(starts), np.int64)
                    for i, (at, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                        crc = 0
                        for view in file.spans(at, n):
                            crc = zlib.crc32(view.astype("<u4", copy=False), crc)
                        crcs[i] = crc
                    ids = pa.array(doc_id, pa.int64(), from_pandas=True)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts + base), pa.array(counts), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, "name string, base long").repartition(len(files))
    return listed.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
