"""Phase-space thresholding of one series: value, first and second difference against a robust ellipsoid, repeated until nothing new lies outside."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SIDE = 5  # neighbours on each side that make up the local levels
ROUNDS = 8  # most rounds; each sees SIDE + 1 neighbours further
HALO = ROUNDS * (SIDE + 1)  # values on either side on which the flags of a piece of a series depend
MAD = 1.4826  # from median absolute deviation to the standard deviation of a normal variable
BINS = 32  # histogram bins an octave
THICK = 0.9  # greatest correlation of value and second difference: keeps the ellipsoid from degenerating
COORDINATES = ("u", "du", "ddu", "move")


@dataclass
class Shape:
    """A source's ellipsoid: the scales of value, first and second difference, the correlation of value and second difference; beside it the scale of plain moves and the number of values."""

    u: float
    du: float
    ddu: float
    r: float
    move: float
    n: int

    @property
    def universal(self) -> float:
        """The greatest of n normal variables is expected at about sqrt(2 ln n)."""
        return float(np.sqrt(2 * np.log(max(self.n, 2))))


def _levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the SIDE values before and after each point; missing values (nan) are passed over, none gives nan."""
    n = len(x)
    padded = np.full(n + 2 * SIDE, np.nan)
    padded[SIDE : SIDE + n] = x
    ordered = np.sort(np.stack([padded[i : n + SIDE + 1 + i] for i in range(SIDE)], axis=1), axis=1)
    count = (ordered == ordered).sum(1)
    at = np.arange(len(ordered))
    middle = (ordered[at, np.maximum(count - 1, 0) // 2] + ordered[at, np.minimum(count // 2, SIDE - 1)]) / 2
    return middle[:n], middle[SIDE + 1 : SIDE + 1 + n]


def coordinates(y: np.ndarray, flagged: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, du, ddu) of each point of a series in which flagged points are replaced by their local level.

    u is the deviation from the nearer of the levels before and after, 0 between them: where the level changes for good, a
    point agrees with one of the two, so u stays small, and du and ddu, taken of u, with it.
    """
    before, after = _levels(np.where(flagged, np.nan, y))
    before, after = np.where(np.isnan(before), after, before), np.where(np.isnan(after), before, after)
    a, b = y - before, y - after
    with np.errstate(invalid="ignore"):
        u = np.where(a * b > 0, np.sign(a) * np.minimum(np.abs(a), np.abs(b)), 0.0)
    level = np.where(flagged, 0.0, u)
    beside = np.zeros(len(u) + 2)
    beside[1:-1] = level
    return u, u - beside[:-2], beside[2:] - 2 * u + beside[:-2]


def histogram(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of the magnitudes other than zero, BINS an octave; histograms of the pieces of a series add up."""
    v = np.abs(values[values != 0])
    return np.unique(np.floor(np.log2(v) * BINS).astype(np.int64), return_counts=True)


def scale(bins: np.ndarray, counts: np.ndarray) -> float:
    """The robust scale: the median magnitude from its histogram, as a standard deviation; nan without values."""
    if not len(counts):
        return float("nan")
    upto = np.cumsum(counts)
    k = int(np.searchsorted(upto, upto[-1] / 2))
    return float(MAD * 2 ** ((bins[k] + (upto[-1] / 2 - upto[k] + counts[k]) / counts[k]) / BINS))


def signs(u: np.ndarray, ddu: np.ndarray) -> tuple[int, int]:
    """(sum of sign(u) sign(ddu), number) over points where neither is zero; these add up over pieces."""
    s = np.sign(u) * np.sign(ddu)
    return int(s.sum()), int((s != 0).sum())


def correlation(total: int, count: int) -> float:
    """The quadrant correlation: robust, from signs only."""
    return float(np.clip(np.sin(np.pi / 2 * total / count), -THICK, THICK)) if count else 0.0


def outside(shape: Shape, u: np.ndarray, du: np.ndarray, ddu: np.ndarray, far: float) -> np.ndarray:
    """Whether each point lies outside the ellipsoid whose half axes are `far` universal thresholds, turned in the plane of value and second difference by their correlation."""
    z, dz, ddz = (v / s if s > 0 else np.zeros(len(v)) for v, s in ((u, shape.u), (du, shape.du), (ddu, shape.ddu)))
    return (z * z - 2 * shape.r * z * ddz + ddz * ddz) / (1 - shape.r**2) + dz * dz > (far * shape.universal) ** 2


def own(u: np.ndarray) -> np.ndarray:
    """Whether a point's excursion is its own: its value deviates at least half as much as either neighbour's, whose jump would else throw it out of the ellipsoid by its differences."""
    v = np.zeros(len(u) + 2)
    v[1:-1] = np.abs(u)
    return (v[1:-1] > 0) & (v[1:-1] >= 0.5 * np.maximum(v[:-2], v[2:]))


def again(at: tuple[np.ndarray, np.ndarray, np.ndarray], flagged: np.ndarray, shape: Shape, far: float) -> np.ndarray:
    """The points that one more round flags, given their coordinates."""
    return outside(shape, *at, far) & own(at[0]) & ~flagged


def flagged_by(y: np.ndarray, shapes: list[Shape], far: float) -> tuple[np.ndarray, np.ndarray]:
    """(flags after the rounds with the given ellipsoids, those of the last round)."""
    flags = np.zeros(len(y), bool)
    new = flags
    for s in shapes:
        new = again(coordinates(y, flags), flags, s, far)
        flags = flags | new
    return flags, new


def measured(y: np.ndarray, at: tuple[np.ndarray, np.ndarray, np.ndarray], flagged: np.ndarray, part: slice = slice(None)) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], tuple[int, int]]:
    """Histograms of the coordinates and of plain moves, and the signs, over the points of `part` that are not flagged."""
    u, du, ddu = at
    keep = ~flagged[part]
    move = np.zeros(len(y))
    np.subtract(y[1:], y[:-1], out=move[1:])
    return {k: histogram(v[part][keep]) for k, v in zip(COORDINATES, (u, du, ddu, move))}, signs(u[part][keep], ddu[part][keep])


def shape_of(histograms: dict[str, tuple[np.ndarray, np.ndarray]], sign: tuple[int, int], n: int) -> Shape:
    return Shape(*[scale(*histograms[k]) for k in COORDINATES[:3]], correlation(*sign), scale(*histograms["move"]), n)


def spikes(y: np.ndarray, far: float) -> tuple[np.ndarray, Shape]:
    """(flags, the last ellipsoid) of a whole series: rounds until one flags nothing new, at most ROUNDS."""
    flags = np.zeros(len(y), bool)
    for _ in range(ROUNDS):
        at = coordinates(y, flags)
        shape = shape_of(*measured(y, at, flags), len(y))
        new = again(at, flags, shape, far)
        flags |= new
        if not new.any():
            break
    return flags, shape


def runs_of(c: np.ndarray, before: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(moved, run): whether each value differs from the one before it, and the running count of that; `before` is the value ahead of the first, which moves if there is none."""
    first = True if before is None else bool(c[0] != before) if len(c) else True
    moved = np.r_[np.array([first][: len(c)], bool), c[1:] != c[:-1]]
    return moved, np.cumsum(moved)
