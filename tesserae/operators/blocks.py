"""Volumes in blocks: each block of cells, with the cells around it that an operator looks at, is one group and one array.

A cell goes to its block and to those in whose halo it lies, in one shuffle; whatever is then done within the halo needs no
other. A block has BLOCK cells an axis, so a group is bounded whatever the volume's size. Edges of the volume are found where
a block's cells end before its halo does, so no operator needs to know the lattice's size. All volumes are boxes without gaps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
BLOCK = (32, 32, 32)
Arrays = dict[str, np.ndarray]


def _boxed(table: pa.Table, names: list[str]) -> tuple[np.ndarray, Arrays]:
    """The least coordinates of the cells, and the columns as arrays over their box."""
    at = np.stack([np.asarray(table.column(a)).astype(np.int64) for a in AXES])
    low = at.min(axis=1)
    shape = at.max(axis=1) - low + 1
    flat = np.ravel_multi_index(at - low[:, None], shape)
    out = {}
    for name in names:
        values = table.column(name).to_numpy()
        whole = np.zeros(int(shape.prod()), values.dtype)
        whole[flat] = values
        out[name] = whole.reshape(shape)
    return low, out


def map_blocks(vol: DataFrame, work: Callable[[Arrays], Arrays], columns: str, halo: tuple[int, int, int] = (0, 0, 0), pad: str = "edge", block: tuple[int, int, int] = BLOCK, fill: dict[str, float] | None = None) -> DataFrame:
    """(img, z, y, x) with `columns` (a schema), which `work` makes of the arrays of vol's other columns.

    work gets each column as an array of the block's cells with `halo` cells more on each side, and `inside`, true for cells of the
    volume; it returns arrays of the block's cells alone, one for each column of `columns`. Beyond the volume's edge the arrays go on as `pad` says: "edge"
    (the nearest cell), "symmetric" (mirrored half a cell outside), or "constant" (fill[column], else 0).
    """
    names = [c for c in vol.columns if c not in ("img", *AXES)]
    sent = vol
    for a, h, b in zip(AXES, halo, block, strict=True):
        first, last = F.floor((F.col(a) - h) / b), F.floor((F.col(a) + h) / b)
        sent = sent.withColumn(f"b{a}", F.explode(F.sequence(first, last)) if h else F.floor(F.col(a) / b))
    outs = [c.split()[0] for c in columns.split(", ")]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        img, *at = (k.as_py() for k in key)
        start = np.array(at) * np.array(block)
        low, arrays = _boxed(table, names)
        shape = np.array(next(iter(arrays.values())).shape)
        core_low, core_high = np.maximum(start, low), np.minimum(start + block, low + shape)
        if (core_high <= core_low).any():  # only a halo
            return pa.table({"img": pa.array([], pa.int32()), **{a: pa.array([], pa.int32()) for a in AXES}, **{o: pa.array([], kinds[o]) for o in outs}})
        around = [(max(0, int(low[i] - (core_low[i] - halo[i]))), max(0, int(core_high[i] + halo[i] - (low[i] + shape[i])))) for i in range(3)]
        cut = tuple(slice(max(0, int(core_low[i] - halo[i] - low[i])), int(min(core_high[i] + halo[i], low[i] + shape[i]) - low[i])) for i in range(3))
        wide = {n: np.pad(v[cut], around, mode=pad, **({"constant_values": (fill or {}).get(n, 0)} if pad == "constant" else {})) for n, v in arrays.items()}
        box_ = np.ones([c.stop - c.start for c in cut], bool)
        made = work({**wide, "inside": np.pad(box_, around)})
        grid = np.indices(tuple(core_high - core_low)).reshape(3, -1) + core_low[:, None]
        return pa.table({"img": pa.array(np.full(grid.shape[1], img), pa.int32()), **{a: pa.array(g, pa.int32()) for a, g in zip(AXES, grid, strict=True)}, **{o: pa.array(made[o].reshape(-1), kinds[o]) for o in outs}})

    kinds = {c.split()[0]: {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[c.split()[1]] for c in columns.split(", ")}
    return sent.groupBy("img", *[f"b{a}" for a in AXES]).applyInArrow(one, f"img int, z int, y int, x int, {columns}")


def ball(radius: float) -> list[tuple[int, int, int]]:
    r = int(radius)
    return [(a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= radius * radius]


def box(radius: int) -> list[tuple[int, int, int]]:
    return [(a, b, c) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for c in range(-radius, radius + 1)]


def cross(radius: int = 1) -> list[tuple[int, int, int]]:
    return sorted({tuple(s if i == axis else 0 for i in range(3)) for axis in range(3) for s in range(-radius, radius + 1)})


def reach(offsets: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    return tuple(max(abs(o[i]) for o in offsets) for i in range(3))


def shifted(a: np.ndarray, offset: tuple[int, int, int], halo: tuple[int, int, int]) -> np.ndarray:
    """The cells `offset` on from each of the core, of an array with a halo."""
    return a[tuple(slice(h + o, a.shape[i] - h + o) for i, (h, o) in enumerate(zip(halo, offset, strict=True)))]
