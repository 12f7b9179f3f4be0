"""The header probe: a provider proposes which header means what; anything unclear is an error."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

from .contract import CANONICAL, HeaderMapping, SemanticAlignmentError
from .logs import get_logger
from .operators.align import SAMPLE_ROWS, AlignmentArtifact, apply_header_mapping, sample_rows, source_columns
from .providers import LlmProvider, LlmTimeoutError

TIMEOUT = 30.0

_MEANINGS = {
    "sku_id": "identifier of the item",
    "timestamp": "day of the observation",
    "demand_qty": "quantity demanded, used or sold on that day; stock on hand is never demand",
    "lead_time_days": "days from ordering to delivery",
}


def build_alignment_prompt(frame: DataFrame, n_rows: int = SAMPLE_ROWS) -> str:
    """Headers and the first rows, with what is asked for.  The only job: taking those rows."""
    rows = sample_rows(frame, n_rows)
    headers = [c.strip() for c in source_columns(frame)]
    sample = io.StringIO()
    csv.writer(sample, lineterminator="\n").writerows([headers, *rows])
    fields = "\n".join(f"- {name}: {meaning}" for name, meaning in _MEANINGS.items())
    return (
        "Map the headers of an inventory table to these fields.\n"
        f"{fields}\n"
        "Answer with one JSON object with exactly these keys; each value is a header copied from the list, or null if none fits.\n"
        "Never guess: null is better than a doubtful header. Never map stock on hand to demand_qty. Headers may be in any language.\n"
        f"Headers: {json.dumps(headers, ensure_ascii=False)}\n"
        f"First rows:\n{sample.getvalue()}"
    )


def parse_header_mapping(text: str) -> HeaderMapping:
    """The mapping in an answer, which may be fenced."""
    body = text.strip()
    if body.startswith("```"):
        body = body.strip("`").strip()
        if body[:4].lower() == "json":
            body = body[4:]
    try:
        found = json.loads(body)
    except ValueError:
        raise SemanticAlignmentError("the answer is not JSON") from None
    if not isinstance(found, dict):
        raise SemanticAlignmentError(f"the answer is no JSON object with {', '.join(CANONICAL)}")
    return HeaderMapping.from_object(found)


def probe_headers(frame: DataFrame, provider: LlmProvider, *, timeout: float = TIMEOUT, n_rows: int = SAMPLE_ROWS) -> AlignmentArtifact:
    """Asks the provider (temperature 0) and applies what it answers."""
    prompt = build_alignment_prompt(frame, n_rows)
    try:
        answer = provider.complete(prompt, temperature=0.0, timeout=timeout)
    except LlmTimeoutError:
        get_logger(__name__).error("header probe: no answer within %s s", timeout)
        raise
    return apply_header_mapping(frame, parse_header_mapping(answer))
