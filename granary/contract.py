"""The canonical schema of a demand table, and the errors of the ingestion path."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

#: Order matters: the barrier demands exactly these columns in this order.
CANONICAL = ("sku_id", "timestamp", "demand_qty", "lead_time_days")

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("sku_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("demand_qty", T.DoubleType(), False),
        T.StructField("lead_time_days", T.LongType(), False),
    ]
)


class RawWritePermissionError(PermissionError):
    """An attempt to write into the raw zone."""

    def __init__(self, path: Any, caller: str):
        super().__init__(f"raw data are read-only: {caller} tried to write {path}")
        self.path, self.caller = path, caller


class SemanticAlignmentError(ValueError):
    """No complete and unambiguous mapping of the source's headers."""


class SchemaBarrierError(ValueError):
    """The first row (or the frame) that breaks the contract."""

    def __init__(self, message: str, *, row_index: int | None = None, column: str | None = None, raw_value: Any = None):
        super().__init__(message)
        self.row_index, self.column, self.raw_value = row_index, column, raw_value


class TemporalContinuityError(ValueError):
    """A panel that is not one row per SKU and day, or cannot be made so."""


@dataclass(frozen=True)
class HeaderMapping:
    """Source header of each canonical field; None where the source has none."""

    sku_id: str | None = None
    timestamp: str | None = None
    demand_qty: str | None = None
    lead_time_days: str | None = None

    @classmethod
    def from_object(cls, found: dict[str, Any]) -> HeaderMapping:
        """Unknown keys are ignored and blank names count as None; other types are an error."""
        values = {}
        for name in CANONICAL:
            value = found.get(name)
            if value is not None and not isinstance(value, str):
                raise SemanticAlignmentError(f"header of {name} must be text or null, got {type(value).__name__}")
            values[name] = value.strip() or None if value is not None else None
        return cls(**values)

    def as_dict(self) -> dict[str, str | None]:
        return {name: getattr(self, name) for name in CANONICAL}

    def unmapped_fields(self) -> list[str]:
        return [name for name, source in self.as_dict().items() if source is None]

    def source_to_canonical(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, source in self.as_dict().items():
            if source is not None:
                if source in out:
                    raise SemanticAlignmentError(f"header {source!r} is mapped to both {out[source]} and {name}")
                out[source] = name
        return out
