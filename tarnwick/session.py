"""Session defaults the operators assume: UTC, ANSI SQL, adaptive execution."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tarnwick", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that could not import it from where they start."""
    root = Path(__file__).resolve().parent.parent
    reachable = {Path(p or ".").resolve() for p in [".", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    sc = spark.sparkContext
    if root in reachable or sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="tarnwick-")) / "tarnwick.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "tarnwick").rglob("*.py")):
            out.write(source, source.relative_to(root))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
