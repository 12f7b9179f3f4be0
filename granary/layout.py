"""Directory zones, and the policy that raw data are never written."""

from __future__ import annotations

import builtins
import contextlib
import functools
import io
import os
import shutil
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from .contract import RawWritePermissionError

ROOT_VARIABLE = "GRANARY_DATA_ROOT"


@dataclass(frozen=True)
class DataLayout:
    root: Path
    raw: Path
    staging: Path
    processed: Path


def default_data_root() -> Path:
    return Path(os.environ.get(ROOT_VARIABLE) or "data")


def ensure_data_layout(data_root: Path | str | None = None) -> DataLayout:
    """The zones under the root, made if they are not there."""
    root = Path(data_root) if data_root is not None else default_data_root()
    layout = DataLayout(root, *(root / zone for zone in ("raw", "staging", "processed")))
    for folder in (layout.raw, layout.staging, layout.processed):
        folder.mkdir(parents=True, exist_ok=True)
    return layout


def is_under(path: Path | str, root: Path | str) -> bool:
    """Whether the resolved path lies in the resolved root; False where either cannot be resolved."""
    try:
        return Path(path).resolve().is_relative_to(Path(root).resolve())
    except (OSError, ValueError, RuntimeError, TypeError):
        return False


def _outside_caller() -> str:
    """Name of the nearest function on the stack that is not part of this module."""
    frame = sys._getframe(1)
    while frame and frame.f_globals.get("__name__") in (__name__, "contextlib", "pathlib", "pathlib._local"):
        frame = frame.f_back
    return f"{frame.f_globals.get('__name__', '?')}.{frame.f_code.co_name}" if frame else "?"


@contextlib.contextmanager
def raw_read_only_guard(raw_root: Path | str) -> Iterator[None]:
    """Refuses Python's open() for writing below `raw_root` while it holds.

    It covers builtins.open and io.open of this process.  Spark writes through the JVM, which this
    cannot see: those go through export_parquet(), which refuses the raw zone itself.
    """
    before = builtins.open, io.open

    def watched(original):
        @functools.wraps(original)
        def checked(file, mode="r", *args, **kwargs):
            if set(mode) & set("wax+") and not isinstance(file, int) and is_under(os.fsdecode(file), raw_root):
                raise RawWritePermissionError(Path(os.fsdecode(file)), _outside_caller())
            return original(file, mode, *args, **kwargs)

        return checked

    builtins.open, io.open = watched(before[0]), watched(before[1])
    try:
        yield
    finally:
        builtins.open, io.open = before


def enforce_raw_read_only(raw_root: Path | str):
    """raw_read_only_guard() as a decorator."""

    def around(function):
        @functools.wraps(function)
        def guarded(*args, **kwargs):
            with raw_read_only_guard(raw_root):
                return function(*args, **kwargs)

        return guarded

    return around


def deposit_raw_csv(source: Path | str, *, data_root: Path | str | None = None) -> Path:
    """Copies a file into the raw zone and returns its place there.

    A file already there stays; one of the same name and other bytes is refused, since raw data
    do not change.
    """
    from .sources.csv_files import sha256_of_file

    source, layout = Path(source), ensure_data_layout(data_root)
    if not source.is_file():
        raise FileNotFoundError(f"no such file: {source}")
    target = layout.raw / source.name
    if target.exists():
        if target.resolve() != source.resolve() and sha256_of_file(target) != sha256_of_file(source):
            raise RawWritePermissionError(target, "deposit_raw_csv")
        return target
    shutil.copy2(source, target)
    return target
