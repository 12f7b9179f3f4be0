"""The public surface in one place, under the names that callers of the ingestion library use."""

from __future__ import annotations

from .cli import main
from .contract import (
    CANONICAL,
    CANONICAL_SCHEMA,
    HeaderMapping,
    RawWritePermissionError,
    SchemaBarrierError,
    SemanticAlignmentError,
    TemporalContinuityError,
)
from .layout import DataLayout, default_data_root, deposit_raw_csv, enforce_raw_read_only, ensure_data_layout, raw_read_only_guard
from .logs import JsonFormatter, configure_json_logger, get_logger, log_ingestion_event
from .operators.align import AlignmentArtifact, apply_header_mapping
from .operators.align import sample_rows as sample_header_frame
from .operators.barrier import validate_aligned as validate_aligned_frame
from .operators.forecast import BaseForecaster, forecast_per_sku, seasonal_naive
from .operators.forecast import SeasonalNaive as SeasonalNaiveStub
from .operators.regrid import regrid_daily as resample_daily
from .plans.ingest import IngestResult, run_ingest, run_semantic_pipeline
from .probe import build_alignment_prompt, parse_header_mapping, probe_headers
from .providers import (
    LlmError,
    LlmProvider,
    LlmProviderError,
    LlmTimeoutError,
    UnknownModelError,
    UnknownProviderError,
    build_llm_provider,
    format_models_help,
    get_available_models,
    normalize_provider_name,
    post_json,
    resolve_model,
)
from .sources.csv_files import ExtractionArtifact, extract_csv, sha256_of_file
from .sources.parquet_files import export_parquet, read_panel

__all__ = [name for name in dir() if not name.startswith("_") and name != "annotations"]
