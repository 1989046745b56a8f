"""Floods over volumes: grey reconstruction, h-maxima and the seeded watershed.

Each is a fixed point of a rule between neighbours. A round brings the rule to rest within every block at once, with the cells
around the block as they were, and is a table in the shared folder; there are as many rounds as blocks that a flood crosses, not
cells. Rounds end when no block has changed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .blocks import AXES, BLOCK, map_blocks, shifted

CELL = ["img", *AXES]
ONE = (1, 1, 1)
SIDES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
FAR = 2**62


def _core(a: np.ndarray) -> np.ndarray:
    return a[1:-1, 1:-1, 1:-1]


def _rounds(cells: DataFrame, rule, columns: str, fill: dict[str, float], block: tuple[int, int, int]) -> DataFrame:
    """rule(arrays) changes their cores in place and says whether it did; repeated within blocks, then over blocks, to rest."""

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        a = {k: v.copy() for k, v in a.items() if k != "inside"}
        changed = False
        while rule(a):
            changed = True
        out = {k: _core(v) for k, v in a.items()}
        return {**out, "changed": np.full(next(iter(out.values())).shape, changed)}

    now = stored(cells)
    while True:
        now = stored(map_blocks(now.drop("changed"), work, f"{columns}, changed boolean", ONE, "constant", block, fill))
        if now.where("changed").isEmpty():
            return now.drop("changed")


def reconstruct(cells: DataFrame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(img, z, y, x, v, mask): v, at first the seed, grown into neighbours across faces as far as the mask lets it, to rest."""

    def rule(a: dict[str, np.ndarray]) -> bool:
        best = np.maximum.reduce([shifted(a["v"], o, ONE) for o in SIDES])
        new = np.maximum(_core(a["v"]), np.minimum(best, _core(a["mask"])))
        moved = bool((new != _core(a["v"])).any())
        a["v"][1:-1, 1:-1, 1:-1] = new
        return moved

    start = cells.select(*CELL, F.least("v", "mask").cast("double").alias("v"), F.col("mask").cast("double").alias("mask"))
    return _rounds(start, rule, "v double, mask double", {"v": -np.inf, "mask": -np.inf}, block)


def h_maxima(vol: DataFrame, h: float, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """v less the maxima's tops down to h below: the reconstruction of v - h within v."""
    return reconstruct(vol.select(*CELL, (F.col("v") - h).alias("v"), F.col("v").alias("mask")), block).select(*CELL, "v")


def watershed(cells: DataFrame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(img, z, y, x, label): basins of the seeds (label != 0) flooded in the order of v, across faces, without lines between them.

    cells: (img, z, y, x, v, label). A cell is reached at the least level at which a path to a seed stays below, and on that level
    by the fewest steps; of the seeds that reach it so it goes to the smallest label. In an image without seeds labels are 0.
    """

    def levels(a: dict[str, np.ndarray]) -> bool:
        v, free = _core(a["v"]), _core(a["seed"]) == 0
        level, steps = _core(a["level"]).copy(), _core(a["steps"]).copy()
        for o in SIDES:
            nl, ns = shifted(a["level"], o, ONE), shifted(a["steps"], o, ONE)
            rise = v > nl
            cl, cs = np.where(rise, v, nl), np.where(rise, 0, ns + 1)
            better = free & np.isfinite(nl) & ((cl < level) | ((cl == level) & (cs < steps)))
            level[better], steps[better] = cl[better], cs[better]
        moved = bool((level != _core(a["level"])).any() or (steps != _core(a["steps"])).any())
        a["level"][1:-1, 1:-1, 1:-1], a["steps"][1:-1, 1:-1, 1:-1] = level, steps
        return moved

    def basins(a: dict[str, np.ndarray]) -> bool:
        v, free = _core(a["v"]), _core(a["seed"]) == 0
        level, steps, label = _core(a["level"]), _core(a["steps"]), _core(a["label"]).copy()
        for o in SIDES:
            nl, ns = shifted(a["level"], o, ONE), shifted(a["steps"], o, ONE)
            rise = v > nl
            parent = free & np.isfinite(nl) & (np.where(rise, v, nl) == level) & (np.where(rise, 0, ns + 1) == steps)
            label = np.where(parent, np.minimum(label, shifted(a["label"], o, ONE)), label)
        moved = bool((label != _core(a["label"])).any())
        a["label"][1:-1, 1:-1, 1:-1] = label
        return moved

    seed = F.col("label").cast("long")
    start = cells.select(*CELL, F.col("v").cast("double").alias("v"), seed.alias("seed"), F.when(seed != 0, F.col("v")).otherwise(F.lit(float("inf"))).cast("double").alias("level"), F.when(seed != 0, 0).otherwise(F.lit(FAR)).cast("long").alias("steps"), F.when(seed != 0, seed).otherwise(F.lit(FAR)).alias("label"))
    columns = "v double, seed long, level double, steps long, label long"
    fill = {"v": np.inf, "seed": 0, "level": np.inf, "steps": FAR, "label": FAR}
    flooded = _rounds(_rounds(start, levels, columns, fill, block), basins, columns, fill, block)
    return flooded.select(*CELL, F.when(F.col("label") != FAR, F.col("label")).otherwise(F.lit(0)).alias("label"))
