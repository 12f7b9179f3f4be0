"""What queries need around them: a shared folder to write to, and the package on the workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only where that is unset, in local mode, below the
    machine's temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/granary"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever they run; once for a context."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="granary-")) / "granary.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    context.addPyFile(str(archive))  # the driver serves it; executors fetch it
    context._granary_shipped = True
