"""Passive CSV extraction: every column text, nothing inferred, nothing taken for null."""

from __future__ import annotations

import csv
import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layout import ensure_data_layout, is_under, raw_read_only_guard
from ..logs import get_logger, log_ingestion_event

#: Position of a row in its file, from 0; travels with the frame until the barrier has passed.
ROW_INDEX = "_row_index"
_CORRUPT = "_corrupt"
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "enforceSchema": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "columnNameOfCorruptRecord": _CORRUPT}


@dataclass(frozen=True)
class ExtractionArtifact:
    frame: DataFrame
    sha256: str
    row_count: int
    source_path: Path


def sha256_of_file(path: Path | str, block: int = 65536) -> str:
    """SHA-256 of a driver-side file, read in blocks."""
    found = hashlib.sha256()
    with open(path, "rb") as file:
        while part := file.read(block):
            found.update(part)
    return found.hexdigest()


def sha256_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files that Spark can read; each must fit one binary value."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _header(path: Path) -> list[str]:
    """The column names of a file: unnamed ones numbered, repeated ones made different."""
    with open(path, encoding="utf-8-sig", newline="") as file:
        first = next((row for row in csv.reader(file) if row), None)
    if first is None:
        raise ValueError(f"no columns to read from {path}")
    names: list[str] = []
    for i, name in enumerate(first):
        name = name or f"Unnamed: {i}"
        chosen, n = name, 0
        while chosen in names:
            n += 1
            chosen = f"{name}.{n}"
        names.append(chosen)
    return names


def _breaks_in_quotes(spark: SparkSession, path: Path) -> bool:
    """Whether a quoted field may hold a line break: only then has a line an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return not spark.read.text(str(path)).filter(quotes % 2 == 1).isEmpty()


def scan_text_csv(spark: SparkSession, path: Path | str, *, multiline: bool | None = None) -> tuple[DataFrame, int]:
    """read_text_csv() and the number of rows, which the pass that checks them counts as well."""
    path = Path(path)
    names = _header(path)
    inner = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*inner, _CORRUPT]])
    whole = _breaks_in_quotes(spark, path) if multiline is None else multiline
    raw = spark.read.schema(schema).options(header=True, multiLine=whole, **_OPTIONS).csv(str(path)).withColumn(ROW_INDEX, F.monotonically_increasing_id())
    # fields of a record that did not fit the header: the commas outside quotes, and one
    outside = F.regexp_replace(_CORRUPT, '"(?:[^"]|"")*"', "")
    fields = F.length(outside) - F.length(F.replace(outside, F.lit(","))) + 1
    all_read = F.max(F.length(F.concat_ws("", *inner)))  # no column may be left out, or records are not checked
    part = F.shiftright(ROW_INDEX, 33).alias("part")
    # one row for each part of the file
    parts = sorted(raw.groupBy(part).agg(F.count("*").alias("n"), F.max(fields).alias("fields"), all_read).collect())
    longest = max((r["fields"] or 0 for r in parts), default=0)
    if longest > len(names):
        raise ValueError(f"a row of {path.name} has {longest} fields, the header {len(names)}")
    # a row's position: that in its part, and the rows of the parts before
    starts, total = [0] * (parts[-1]["part"] + 1 if parts else 1), 0
    for r in parts:
        starts[r["part"]] = total
        total += r["n"]
    offsets = F.expr(f"array({', '.join(f'{n}L' for n in starts)})")
    inside = F.col(ROW_INDEX).bitwiseAND(F.lit((1 << 33) - 1))
    place = inside + F.get(offsets, F.shiftright(ROW_INDEX, 33).cast("int"))
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in inner], place.alias(ROW_INDEX)).toDF(*names, ROW_INDEX), total


def read_text_csv(spark: SparkSession, path: Path | str, *, multiline: bool | None = None) -> DataFrame:
    """All columns as text in file order, with the row's position in ROW_INDEX.

    Empty fields are '' and literals such as NA stay text; short rows are padded with ''; a row with
    more fields than the header is an error (ValueError), and so is an empty file.  The scan is split
    into many tasks; only a file that may hold line breaks in quotes (looked for unless `multiline`
    says so) is read by one.
    """
    return scan_text_csv(spark, path, multiline=multiline)[0]


def _check_source(source: Path, raw: Path) -> None:
    if source.suffix.lower() != ".csv":
        raise ValueError(f"expected a .csv file, got {source.name}")
    if not is_under(source, raw):
        raise ValueError(f"{source} is not in the raw zone {raw}")


def extract_csv(spark: SparkSession, source: Path | str, *, data_root: Path | str | None = None) -> ExtractionArtifact:
    """Reads a CSV of the raw zone; logs its hash and rows, and any failure before raising it again."""
    logger, source = get_logger(__name__), Path(source)
    try:
        layout = ensure_data_layout(data_root)
        _check_source(source, layout.raw)
        with raw_read_only_guard(layout.raw):
            found = sha256_of_file(source)
            frame, count = scan_text_csv(spark, source)
        log_ingestion_event(logger, "csv extracted", file_hash=found, row_count=count)
        return ExtractionArtifact(frame, found, count, source)
    except Exception:
        logger.exception("csv extraction failed: %s", source)
        raise
