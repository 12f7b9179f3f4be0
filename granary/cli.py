"""Command line: list models, ingest a CSV.

Exit codes: 0 done, 1 any other failure, 2 no alignment, 3 barrier, 4 provider timed out.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from .contract import SchemaBarrierError, SemanticAlignmentError
from .layout import default_data_root
from .logs import configure_json_logger, get_logger
from .plans.ingest import run_ingest
from .probe import TIMEOUT
from .providers import DEFAULTS, LlmError, LlmTimeoutError, build_llm_provider, format_models_help, normalize_provider_name, resolve_model

KEY_VARIABLES = {
    "gemini": ("GRANARY_LLM_API_KEY", "GEMINI_API_KEY", "GOOGLE_API_KEY"),
    "openai": ("GRANARY_LLM_API_KEY", "OPENAI_API_KEY"),
    "anthropic": ("GRANARY_LLM_API_KEY", "ANTHROPIC_API_KEY"),
}


def resolve_api_key(provider: str, explicit: str | None) -> str:
    """The key given, else the first that the environment has; it is never printed."""
    names = KEY_VARIABLES[normalize_provider_name(provider)]
    for value in (explicit, *map(os.environ.get, names)):
        if value and value.strip():
            return value.strip()
    raise ValueError(f"no API key: use --api-key or set {' or '.join(names)}")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="granary", description="Inventory exports to daily demand panels.")
    commands = parser.add_subparsers(dest="command", required=True)
    models = commands.add_parser("models", help="models of a provider")
    ingest = commands.add_parser("ingest", help="align, validate and re-grid a CSV, and write Parquet")
    for command in (models, ingest):
        command.add_argument("--provider", default="gemini", help="gemini, openai or anthropic")
    ingest.add_argument("--csv", type=Path, required=True)
    ingest.add_argument("--api-key")
    ingest.add_argument("--model", help="a model of the provider's catalogue; see the models command")
    ingest.add_argument("--data-root", type=Path, default=None)
    ingest.add_argument("--timeout", type=float, default=TIMEOUT)
    return parser


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("granary").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _models(args: argparse.Namespace) -> None:
    provider = normalize_provider_name(args.provider)
    print(f"provider: {provider}\ndefault: {DEFAULTS[provider]}\n{format_models_help(provider)}")


def _ingest(args: argparse.Namespace) -> None:
    provider, model = normalize_provider_name(args.provider), resolve_model(args.provider, args.model)
    client = build_llm_provider(provider, resolve_api_key(provider, args.api_key), model=model)
    done = run_ingest(_session(), args.csv, client, data_root=args.data_root or default_data_root(), timeout=args.timeout)
    print(f"provider: {provider}\nmodel: {model}\nmapping: {done.alignment.mapping.as_dict()}\ndropped: {list(done.alignment.dropped_columns)}")
    print(f"raw rows: {done.source.row_count}\nvalid rows: {done.validated.count()}\npanel rows: {done.panel.count()}\nparquet: {done.parquet_path}")


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    configure_json_logger()
    try:
        (_models if args.command == "models" else _ingest)(args)
        return 0
    except (LlmError, OSError, ValueError) as e:
        get_logger(__name__).error("%s", e)
        print(e, file=sys.stderr)
        codes = ((SemanticAlignmentError, 2), (SchemaBarrierError, 3), (LlmTimeoutError, 4))
        return next((code for kind, code in codes if isinstance(e, kind)), 1)


if __name__ == "__main__":
    sys.exit(main())
