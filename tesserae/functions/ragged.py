"""Ragged runs of positions."""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of ragged runs: starts[0], starts[0] + 1, ..., starts[1], ..."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
