"""Analytics over marketplace listings, as Spark jobs."""

from __future__ import annotations

from pathlib import Path


def on_workers(spark) -> None:
    """Lets Python workers that can read this folder import the package, from wherever the driver was started."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
