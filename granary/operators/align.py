"""Header alignment: from arbitrary columns to the canonical ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import CANONICAL, HeaderMapping, SemanticAlignmentError
from ..sources.csv_files import ROW_INDEX

SAMPLE_ROWS = 5


@dataclass(frozen=True)
class AlignmentArtifact:
    frame: DataFrame
    mapping: HeaderMapping
    dropped_columns: tuple[str, ...]


def source_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c != ROW_INDEX]


def sample_rows(frame: DataFrame, n_rows: int = SAMPLE_ROWS) -> list[tuple]:
    """The first rows in file order, without the row position; an empty frame is an error."""
    ordered = frame.orderBy(ROW_INDEX) if ROW_INDEX in frame.columns else frame
    rows = ordered.select(*[F.col(f"`{c}`") for c in source_columns(frame)]).take(n_rows)
    if not rows:
        raise ValueError("the frame has no rows to sample")
    return [tuple(r) for r in rows]


def resolve_column(wanted: str, columns: list[str]) -> str:
    """The column of that name; else the only one that equals it without regard to case."""
    if wanted in columns:
        return wanted
    near = [c for c in columns if c.lower() == wanted.lower()]
    if len(near) != 1:
        raise SemanticAlignmentError(f"header {wanted!r} is {'ambiguous' if near else 'not there'}; headers: {columns}")
    return near[0]


def apply_header_mapping(frame: DataFrame, mapping: HeaderMapping) -> AlignmentArtifact:
    """Keeps the mapped columns under their canonical names and order, and reports the others.

    One projection, so the scan reads four columns.  The row position travels along if it is there.
    """
    missing = mapping.unmapped_fields()
    if missing:
        raise SemanticAlignmentError(f"no header for {', '.join(missing)}")
    columns = source_columns(frame)
    found = HeaderMapping(**{name: resolve_column(source, columns) for name, source in mapping.as_dict().items()})
    chosen = found.source_to_canonical()
    kept = [F.col(f"`{found.as_dict()[name].replace('`', '``')}`").alias(name) for name in CANONICAL]
    extra = [F.col(ROW_INDEX)] if ROW_INDEX in frame.columns else []
    return AlignmentArtifact(frame.select(*kept, *extra), found, tuple(c for c in columns if c not in chosen))
