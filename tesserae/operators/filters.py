"""Neighbourhood filters of any size and shape, on blocks with a halo: one shuffle each, whatever the number of passes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .blocks import AXES, map_blocks, reach, shifted

Offsets = list[tuple[int, int, int]]
CELL = ["img", *AXES]


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights from -radius to radius, which is sigma * truncate, rounded up."""
    r = math.ceil(truncate * sigma)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _separable(a: np.ndarray, weights: list[list[float]]) -> np.ndarray:
    """Each axis' weights in turn; the array loses their radius at both ends."""
    for axis, w in enumerate(weights):
        n = a.shape[axis] - len(w) + 1
        a = sum(x * np.take(a, np.arange(i, i + n), axis=axis) for i, x in enumerate(w))
    return a


def separable(vol: DataFrame, weights: list[list[float]], boundary: str = "edge") -> DataFrame:
    """v correlated with one odd-length list of weights for each of z, y and x. An empty volume gives an empty one."""
    return map_blocks(vol.select(*CELL, "v"), lambda a: {"v": _separable(a["v"], weights)}, "v double", tuple(len(w) // 2 for w in weights), boundary)


def gaussian(vol: DataFrame, sigma: tuple[float, float, float], truncate: float = 4.0, boundary: str = "edge") -> DataFrame:
    return separable(vol, [gaussian_weights(s, truncate) if s > 0 else [1.0] for s in sigma], boundary)


def linear(vol: DataFrame, kernel: dict[tuple[int, int, int], float], boundary: str = "edge") -> DataFrame:
    """The sum of kernel[offset] * v(cell + offset)."""
    halo = reach(list(kernel))
    return map_blocks(vol.select(*CELL, "v"), lambda a: {"v": sum(w * shifted(a["v"], o, halo) for o, w in kernel.items())}, "v double", halo, boundary)


def _extreme(a: np.ndarray, offsets: Offsets, halo: tuple[int, int, int], largest: bool) -> np.ndarray:
    pick = np.maximum if largest else np.minimum
    out = shifted(a, offsets[0], halo)
    for o in offsets[1:]:
        out = pick(out, shifted(a, o, halo))
    return out


def extreme(vol: DataFrame, offsets: Offsets, largest: bool) -> DataFrame:
    """The largest or least value over a structuring element; cells beyond the edge don't count."""
    halo = reach(offsets)
    beyond = -np.inf if largest else np.inf
    return map_blocks(vol.select(*CELL, "v"), lambda a: {"v": _extreme(a["v"], offsets, halo, largest)}, "v double", halo, "constant", fill={"v": beyond})


def twice(vol: DataFrame, offsets: Offsets, largest_first: bool) -> DataFrame:
    """Closing (largest first) or opening by the element, in one shuffle: the second pass goes over the first one's halo. Cells
    beyond the edge count in neither."""
    halo = reach(offsets)
    wide = tuple(2 * h for h in halo)

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        first = _extreme(np.where(a["inside"], a["v"], -np.inf if largest_first else np.inf), offsets, halo, largest_first)
        inside = a["inside"][tuple(slice(h, n - h) for h, n in zip(halo, a["inside"].shape, strict=True))]
        return {"v": _extreme(np.where(inside, first, np.inf if largest_first else -np.inf), offsets, halo, not largest_first)}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", wide, "constant")


def gradient(vol: DataFrame, offsets: Offsets) -> DataFrame:
    """Dilation less erosion."""
    halo = reach(offsets)

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        high, low = (np.where(a["inside"], a["v"], x) for x in (-np.inf, np.inf))
        return {"v": _extreme(high, offsets, halo, True) - _extreme(low, offsets, halo, False)}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", halo, "constant")


def hit_or_miss(mask: DataFrame, on: Offsets, off: Offsets) -> DataFrame:
    """m where all cells at the offsets `on` have m and none at `off` has; cells beyond the edge have none."""
    halo = reach(on + off)

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        m = a["m"]
        return {"m": np.logical_and.reduce([shifted(m, o, halo) for o in on] + [~shifted(m, o, halo) for o in off])}

    return map_blocks(mask.select(*CELL, "m"), work, "m boolean", halo, "constant")


def local_stats(vol: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    """(v, mean, deviation) of the cells within the radius on each axis, the population's; only cells of the volume count."""
    ones = [[1.0] * (2 * r + 1) for r in radius]
    core = tuple(slice(r, -r if r else None) for r in radius)

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = _separable(a["inside"].astype(float), ones)
        mean = _separable(a["v"], ones) / n
        square = _separable(a["v"] * a["v"], ones) / n
        return {"v": a["v"][core], "mean": mean, "deviation": np.sqrt(np.maximum(square - mean * mean, 0))}

    return map_blocks(vol.select(*CELL, "v"), work, "v double, mean double, deviation double", radius, "constant")


def rank(vol: DataFrame, offsets: Offsets, share: float) -> DataFrame:
    """The value of rank floor(share * (n - 1) + 0.5) of the n cells under the element that lie in the volume."""
    halo = reach(offsets)

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        stack = np.sort(np.stack([shifted(np.where(a["inside"], a["v"], np.inf), o, halo) for o in offsets]), axis=0)
        n = sum(shifted(a["inside"], o, halo).astype(np.int64) for o in offsets)
        at = np.floor(share * (n - 1) + 0.5).astype(np.int64)
        return {"v": np.take_along_axis(stack, at[None], axis=0)[0]}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", halo, "constant")


def _derivatives(a: np.ndarray, halo: tuple[int, int, int]) -> dict[tuple[int, int], np.ndarray]:
    """Second central differences of unit steps: (i, j) for axes i <= j; `halo` is what they take off, one cell an axis."""
    unit = np.eye(3, dtype=int)
    at = lambda o: shifted(a, tuple(int(x) for x in o), halo)
    out = {(i, i): at(unit[i]) - 2 * at((0, 0, 0)) + at(-unit[i]) for i in range(3)}
    for i in range(3):
        for j in range(i + 1, 3):
            out[i, j] = (at(unit[i] + unit[j]) - at(unit[i] - unit[j]) - at(unit[j] - unit[i]) + at(-unit[i] - unit[j])) / 4
    return out


def _eigenvalues(d: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    m = np.stack([np.stack([d[min(i, j), max(i, j)] for j in range(3)], axis=-1) for i in range(3)], axis=-2)
    return np.linalg.eigvalsh(m)


def _smoothed(vol: DataFrame, sigma: float, truncate: float, more: int, work, columns: str) -> DataFrame:
    """work on the smoothed volume with `more` cells around each block."""
    weights = [gaussian_weights(sigma, truncate)] * 3
    h = len(weights[0]) // 2 + more
    return map_blocks(vol.select(*CELL, "v"), lambda a: work(_separable(a["v"], weights)), columns, (h, h, h))


def hessian_eigenvalues(vol: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """e1 <= e2 <= e3 of the matrix of second differences of the smoothed volume; edges repeat the nearest cell."""

    def work(a: np.ndarray) -> dict[str, np.ndarray]:
        e = _eigenvalues(_derivatives(a, (1, 1, 1)))
        return {f"e{i + 1}": e[..., i] for i in range(3)}

    return _smoothed(vol, sigma, truncate, 1, work, "e1 double, e2 double, e3 double")


def hessian_determinant(vol: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """sigma ** 6 times the determinant of the second differences of the smoothed volume: a response to blobs."""

    def work(a: np.ndarray) -> dict[str, np.ndarray]:
        d = _derivatives(a, (1, 1, 1))
        det = d[0, 0] * (d[1, 1] * d[2, 2] - d[1, 2] ** 2) - d[0, 1] * (d[0, 1] * d[2, 2] - d[1, 2] * d[0, 2]) + d[0, 2] * (d[0, 1] * d[1, 2] - d[1, 1] * d[0, 2])
        return {"v": sigma**6 * det}

    return _smoothed(vol, sigma, truncate, 1, work, "v double")


def laplacian_of_gaussian(vol: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """-sigma ** 2 times the Laplacian of the smoothed volume: large in the middle of bright blobs."""
    return _smoothed(vol, sigma, truncate, 1, lambda a: {"v": -(sigma**2) * sum(_derivatives(a, (1, 1, 1))[i, i] for i in range(3))}, "v double")


def difference_of_gaussians(vol: DataFrame, small: float, large: float, truncate: float = 4.0) -> DataFrame:
    wide, narrow = gaussian_weights(large, truncate), gaussian_weights(small, truncate)
    h, less = len(wide) // 2, len(wide) // 2 - len(narrow) // 2

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        inner = a["v"][tuple(slice(less, n - less) for n in a["v"].shape)]
        return {"v": _separable(inner, [narrow] * 3) - _separable(a["v"], [wide] * 3)}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", (h, h, h))


def structure_tensor(vol: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """(e1, e2, e3, corner): eigenvalues of the smoothed products of central differences, ascending, and their determinant less
    0.05 * trace ** 3, high at corners."""
    weights = [gaussian_weights(sigma, truncate)] * 3
    h = len(weights[0]) // 2 + 1

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        unit = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
        g = [(shifted(a["v"], u, (1, 1, 1)) - shifted(a["v"], tuple(-x for x in u), (1, 1, 1))) / 2 for u in unit]
        e = _eigenvalues({(i, j): _separable(g[i] * g[j], weights) for i in range(3) for j in range(i, 3)})
        return {**{f"e{i + 1}": e[..., i] for i in range(3)}, "corner": e.prod(axis=-1) - 0.05 * e.sum(axis=-1) ** 3}

    return map_blocks(vol.select(*CELL, "v"), work, "e1 double, e2 double, e3 double, corner double", (h, h, h))


def plate_response(vol: DataFrame, sigmas: list[float], truncate: float = 4.0) -> DataFrame:
    """The largest over the scales of sigma ** 2 * -e1 where the strongest curvature is downwards: bright plates, ridges and blobs."""
    h = max(len(gaussian_weights(s, truncate)) // 2 for s in sigmas) + 1

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        best = None
        for s in sigmas:
            w = gaussian_weights(s, truncate)
            less = h - 1 - len(w) // 2
            e = _eigenvalues(_derivatives(_separable(a["v"][tuple(slice(less, n - less) for n in a["v"].shape)], [w] * 3), (1, 1, 1)))
            r = np.where((e[..., 0] < 0) & (np.abs(e[..., 0]) >= np.abs(e[..., 2])), -(s**2) * e[..., 0], 0.0)
            best = r if best is None else np.maximum(best, r)
        return {"v": best}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", (h, h, h))


def match_template(vol: DataFrame, template: dict[tuple[int, int, int], float]) -> DataFrame:
    """Normalised cross-correlation with the template, from -1 to 1; 0 where the cells under it are all equal. Edges repeat the
    nearest cell."""
    halo = reach(list(template))
    n = len(template)
    mean = sum(template.values()) / n
    size = math.sqrt(sum((w - mean) ** 2 for w in template.values()))

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        views = {o: shifted(a["v"], o, halo) for o in template}
        total, square = sum(views.values()), sum(v * v for v in views.values())
        cross = sum((w - mean) * views[o] for o, w in template.items())
        spread = np.sqrt(np.maximum(square - total * total / n, 0))
        flat = spread * size <= 1e-9
        return {"v": np.where(flat, 0.0, cross / np.where(flat, 1.0, spread * size))}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", halo)


def diffuse(vol: DataFrame, kappa: float, rate: float, rounds: int) -> DataFrame:
    """Edge-preserving diffusion: in each round a cell moves towards its six neighbours by rate * exp(-(d / kappa) ** 2) * d. All
    rounds are done in one shuffle, with a halo of as many cells."""
    unit = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v, inside = a["v"], a["inside"]
        for _ in range(rounds):
            here, there = shifted(v, (0, 0, 0), (1, 1, 1)), shifted(inside, (0, 0, 0), (1, 1, 1))
            gaps = [np.where(shifted(inside, o, (1, 1, 1)), shifted(v, o, (1, 1, 1)) - here, 0.0) for o in unit]
            v, inside = here + rate * sum(g * np.exp(-((g / kappa) ** 2)) for g in gaps), there
        return {"v": v}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", (rounds, rounds, rounds), "constant")


def deconvolve(vol: DataFrame, psf: dict[tuple[int, int, int], float], rounds: int) -> DataFrame:
    """Richardson-Lucy: v, at first as it is, times the blurred ratio of the image to the blurred v; edges repeat the nearest
    cell of the image. The halo is twice the kernel's reach a round."""
    r = reach(list(psf))
    halo = tuple(2 * rounds * x for x in r)
    blur = lambda a, sign: sum(w * shifted(a, tuple(sign * x for x in o), r) for o, w in psf.items())

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        image, guess = a["v"], a["v"]
        for _ in range(rounds):
            made = blur(guess, 1)
            image1 = shifted(image, (0, 0, 0), r)
            ratio = np.where(made > 1e-12, image1 / np.where(made > 1e-12, made, 1.0), 0.0)
            guess = shifted(guess, (0, 0, 0), tuple(2 * x for x in r)) * blur(ratio, -1)
            image = shifted(image1, (0, 0, 0), r)
        return {"v": guess}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", halo)



def feature_stack(vol: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """(v, smooth, slope, laplacian, e1, e3) of each cell, for a classifier of cells: the value, and of the smoothed volume the value,
    the gradient's length, the Laplacian and the outer eigenvalues of the second differences. One shuffle for all."""
    weights = [gaussian_weights(sigma, truncate)] * 3
    h = len(weights[0]) // 2 + 1
    unit = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        g = _separable(a["v"], weights)
        slope = np.sqrt(sum(((shifted(g, u, (1, 1, 1)) - shifted(g, tuple(-x for x in u), (1, 1, 1))) / 2) ** 2 for u in unit))
        d = _derivatives(g, (1, 1, 1))
        e = _eigenvalues(d)
        return {"v": shifted(a["v"], (0, 0, 0), (h, h, h)), "smooth": shifted(g, (0, 0, 0), (1, 1, 1)), "slope": slope, "laplacian": sum(d[i, i] for i in range(3)), "e1": e[..., 0], "e3": e[..., 2]}

    return map_blocks(vol.select(*CELL, "v"), work, "v double, smooth double, slope double, laplacian double, e1 double, e3 double", (h, h, h))


def centres(vol: DataFrame, small: float, large: float, least: float, truncate: float = 4.0) -> DataFrame:
    """(img, z, y, x, response, raw) of blobs' centres: cells whose difference of Gaussians is over `least` and over that of all 26
    neighbours. Found within the blocks of one shuffle; only centres come out of it."""
    wide, narrow = gaussian_weights(large, truncate), gaussian_weights(small, truncate)
    h, less = len(wide) // 2 + 1, len(wide) // 2 - len(narrow) // 2
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r = _separable(a["v"][tuple(slice(less, n - less) for n in a["v"].shape)], [narrow] * 3) - _separable(a["v"], [wide] * 3)
        inside = shifted(a["inside"], (0, 0, 0), (h - 1, h - 1, h - 1))
        r = np.where(inside, np.round(r, 9), -np.inf)
        here = shifted(r, (0, 0, 0), (1, 1, 1))
        top = np.maximum.reduce([shifted(r, o, (1, 1, 1)) for o in steps])
        return {"response": here, "raw": shifted(a["v"], (0, 0, 0), (h, h, h)), "top": (here > top) & (here > least)}

    return map_blocks(vol.select(*CELL, "v"), work, "response double, raw double, top boolean", (h, h, h)).where("top").drop("top")


def rolling_ball(vol: DataFrame, heights: dict[tuple[int, int, int], float]) -> DataFrame:
    """The envelope that a ball of the given heights below v can reach: the least of v - height over the element, then the largest
    of that + height. Cells beyond the edge don't count. One shuffle for both passes."""
    halo = reach(list(heights))

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v, inside = np.where(a["inside"], a["v"], np.inf), shifted(a["inside"], (0, 0, 0), halo)
        low = np.minimum.reduce([shifted(v, o, halo) - h for o, h in heights.items()])
        low = np.where(inside, low, -np.inf)
        return {"v": np.maximum.reduce([shifted(low, o, halo) + h for o, h in heights.items()])}

    return map_blocks(vol.select(*CELL, "v"), work, "v double", tuple(2 * h for h in halo), "constant")
