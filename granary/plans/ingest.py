"""The ingestion plan: CSV, header probe, barrier, daily panel, Parquet."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..contract import TemporalContinuityError
from ..layout import deposit_raw_csv, ensure_data_layout
from ..logs import get_logger, log_ingestion_event
from ..operators.align import AlignmentArtifact
from ..operators.barrier import validate_aligned
from ..operators.regrid import SPAN_ERROR, in_order, regrid_daily
from ..probe import TIMEOUT, probe_headers
from ..providers import LlmProvider
from ..sources.csv_files import ExtractionArtifact, extract_csv
from ..sources.parquet_files import export_parquet


@dataclass(frozen=True)
class IngestResult:
    source: ExtractionArtifact
    alignment: AlignmentArtifact
    validated: DataFrame
    panel: DataFrame
    parquet_path: Path


def run_semantic_pipeline(frame: DataFrame, provider: LlmProvider, *, timeout: float = TIMEOUT, keep: bool = False) -> tuple[AlignmentArtifact, DataFrame, DataFrame]:
    """Alignment, validated rows and daily panel of a text frame; touches no file.  `keep` persists
    the validated rows, so that the panel and later counts do not parse the text again."""
    alignment = probe_headers(frame, provider, timeout=timeout)
    validated = validate_aligned(alignment.frame, keep=keep)
    return alignment, validated, regrid_daily(validated, validated=True)


def run_ingest(spark: SparkSession, csv_path: Path | str, provider: LlmProvider, *, data_root: Path | str | None = None, timeout: float = TIMEOUT) -> IngestResult:
    """The whole flow; the panel is written to processed/<name of the file>.parquet, ordered by SKU
    and day.  `validated` of the result is persisted; unpersist it when it is no longer needed."""
    layout = ensure_data_layout(data_root)
    source = extract_csv(spark, deposit_raw_csv(csv_path, data_root=layout.root), data_root=layout.root)
    alignment, validated, panel = run_semantic_pipeline(source.frame, provider, timeout=timeout, keep=True)
    try:
        path = export_parquet(in_order(panel), layout.processed / f"{Path(csv_path).stem}.parquet", data_root=layout.root)
    except PySparkException as e:
        if SPAN_ERROR in str(e):
            raise TemporalContinuityError(SPAN_ERROR) from e
        raise
    written = spark.read.parquet(str(path))
    log_ingestion_event(get_logger(__name__), "panel written", file_hash=source.sha256, row_count=written.count())
    return IngestResult(source, alignment, validated, written, path)
