"""Analytics over source-code dependency graphs, as Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path


def reach_workers(spark) -> None:
    """Let Python workers on this machine import the package from where it lies.

    On a cluster the package is shipped with ``--py-files`` or installed, and
    the path added here is of no effect.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
