"""Segmentation by components: hysteresis and regional maxima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import map_blocks, shifted
from .objects import forward, label_components

CELL = ["img", "z", "y", "x"]


def hysteresis(vol: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """The labelled components of v > low that have a cell with v > high; both are (img, threshold)."""
    both = vol.join(low, "img").withColumn("m", F.col("v") > F.col("threshold")).drop("threshold")
    sure = both.join(high, "img").withColumn("sure", F.col("v") > F.col("threshold")).drop("threshold")
    cells = label_components(sure)
    return cells.join(cells.where("sure").select("img", "label").distinct(), ["img", "label"], "left_semi").drop("sure")


def regional_maxima(vol: DataFrame, connectivity: int = 6) -> DataFrame:
    """The cells of plateaus (neighbours of one value) with no larger neighbour. A volume of one value is one plateau."""
    steps = forward(connectivity)

    def beaten(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = shifted(a["v"], (0, 0, 0), (1, 1, 1))
        around = [shifted(np.where(a["inside"], a["v"], -np.inf), tuple(s * x for x in o), (1, 1, 1)) for o in steps for s in (1, -1)]
        return {"v": v, "low": np.maximum.reduce(around) > v}

    cells = map_blocks(vol.select(*CELL, "v"), beaten, "v double, low boolean", (1, 1, 1), "constant")
    plateaus = label_components(cells.withColumn("m", F.lit(True)), connectivity, by="v")
    low = plateaus.where("low").select("img", "label").distinct()
    return plateaus.join(low, ["img", "label"], "left_anti").select(*CELL, "v")
