"""Where Python workers find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame


def reachable(df: DataFrame) -> DataFrame:
    """`df`, once Python workers look for this package where the driver found it, as they can in local mode and on shared
    disks. A cluster without these gets the package by `--py-files`."""
    root = str(Path(__file__).resolve().parents[1])
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)
    return df
