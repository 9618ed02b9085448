"""Crop augmentation, reproducible per (region, variant): intensity on voxel rows, geometry on crop rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelframe.functions.scalar import uniform, variant_seed
from voxelframe.operators.tiles import partitions

# Strengths of the augmentations.
SCALE_DELTA, SHIFT_DELTA, NOISE_STD = 0.1, 0.1, 0.05
ROTATE_DEGREES, ZOOM_DELTA = 10.0, 0.05
ELASTIC_ALPHA, ELASTIC_SIGMA = 1.0, 6.0


def augment_intensity(voxels: DataFrame, key: str, seed: int = 42, noise: bool = True) -> DataFrame:
    """Scale, shift and Gaussian noise from hashed uniforms of the region key (``key`` is SQL) and the voxel."""
    def draw(name: str) -> str:
        return uniform(f"concat_ws(':', {seed}, {key}, '{name}')")

    value = f"intensity * ({1 - SCALE_DELTA}D + {2 * SCALE_DELTA}D * {draw('scale')}) + ({2 * SHIFT_DELTA}D * {draw('shift')} - {SHIFT_DELTA}D)"
    if noise:
        spot = "concat_ws(':', {0}, {1}, z, y, x, '{2}')"
        first, second = (uniform(spot.format(seed, key, name)) for name in ("n1", "n2"))
        normal = f"sqrt(-2 * ln(1 - {first})) * cos(2 * pi() * {second})"
        value = f"{value} + {NOISE_STD}D * {draw('sigma')} * {normal}"
    return voxels.selectExpr(*[c if c != "intensity" else f"{value} as intensity" for c in voxels.columns])


def _coefficients(volume: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients with mirrored ends, one axis after another."""
    out = volume.astype(float)
    for axis, n in enumerate(volume.shape):
        if n > 1:
            system = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
            system[0, 1] = system[-1, -2] = 2.0
            lines = np.moveaxis(out, axis, 0)
            solved = np.linalg.solve(system / 6.0, lines.reshape(n, -1)).reshape(lines.shape)
            out = np.moveaxis(solved, 0, axis)
    return out


def _sample(volume: np.ndarray, at: np.ndarray, smooth: bool) -> np.ndarray:
    """Values at coordinates ``at`` (3, ...); coordinates beyond the edge take the edge value."""
    shape = volume.shape
    at = np.stack([np.clip(a, 0, n - 1) for a, n in zip(at, shape)])
    if not smooth:
        return volume[tuple(np.rint(a).astype(int) for a in at)]
    coefficients, base = _coefficients(volume), np.floor(at).astype(int)
    index, weight = [], []
    for axis, n in enumerate(shape):
        taps, shares = [], []
        for tap in (-1, 0, 1, 2):
            gap = np.abs(at[axis] - base[axis] - tap)
            shares.append(np.where(gap < 1, 2 / 3 - gap**2 + gap**3 / 2, np.where(gap < 2, (2 - gap) ** 3 / 6, 0.0)))
            k = np.abs(base[axis] + tap)
            taps.append(np.where(k >= n, np.maximum(0, 2 * (n - 1) - k), k))
        index.append(taps)
        weight.append(shares)
    out = np.zeros(at.shape[1:])
    for a in range(4):
        for b in range(4):
            for c in range(4):
                out += weight[0][a] * weight[1][b] * weight[2][c] * coefficients[index[0][a], index[1][b], index[2][c]]
    return out


def _smooth_noise(rng: np.random.Generator, shape: tuple[int, ...], sigma: float) -> np.ndarray:
    out = rng.standard_normal(shape)
    for axis, n in enumerate(shape):
        out = np.moveaxis(np.tensordot(out, _smoothing(n, sigma), (axis, 1)), -1, axis)
    return out


@lru_cache(maxsize=256)
def _smoothing(n: int, sigma: float) -> np.ndarray:
    """Gaussian smoothing of a line of n values with mirrored ends as a matrix."""
    radius = int(4 * sigma)
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma**2))
    padded = np.pad(np.eye(n), [(radius, radius), (0, 0)], mode="symmetric")
    return sum(w * padded[i:i + n] for i, w in enumerate(kernel / kernel.sum()))


def _moved(shape: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    """Sampling positions of one draw: rotation in a random plane, zoom about the centre, elastic displacement."""
    at = np.stack(np.meshgrid(*[np.arange(n, dtype=float) for n in shape], indexing="ij"))
    centre = (np.array(shape, dtype=float) - 1)[:, None, None, None] / 2
    if rng.random() < 0.5:
        a, b = ((0, 1), (0, 2), (1, 2))[int(rng.integers(3))]
        angle = np.deg2rad(rng.uniform(-ROTATE_DEGREES, ROTATE_DEGREES))
        off = at - centre
        at[a] = centre[a] + np.cos(angle) * off[a] + np.sin(angle) * off[b]
        at[b] = centre[b] - np.sin(angle) * off[a] + np.cos(angle) * off[b]
    if rng.random() < 0.5:
        at = centre + (at - centre) / rng.uniform(1 - ZOOM_DELTA, 1 + ZOOM_DELTA)
    return at + ELASTIC_ALPHA * np.stack([_smooth_noise(rng, shape, ELASTIC_SIGMA) for _ in range(3)])


def augment_geometry(crops: DataFrame, seed: int = 42) -> DataFrame:
    """Crop rows (case_id, label_id, variant, shape, image, mask) with moved voxels; variant 0 stays as it is.

    A crop is the size of one region. The image is sampled with cubic splines, the mask by nearest voxel.
    """
    seeded = crops.selectExpr("*", f"{variant_seed('concat_ws(' + repr(':') + ', case_id, label_id)', 'variant', str(seed))} as seed")

    def moved(batches):
        for batch in batches:
            images, masks = [], []
            for variant, hexa, shape, image, mask in zip(*(batch.column(c).to_pylist() for c in ("variant", "seed", "shape", "image", "mask"))):
                if variant > 0:
                    at = _moved(tuple(shape), np.random.default_rng(int(hexa, 16)))
                    image = _sample(np.array(image, dtype=float).reshape(shape), at, True).ravel()
                    mask = _sample(np.array(mask, dtype=np.int8).reshape(shape), at, False).ravel()
                images.append(image)
                masks.append(mask)
            for name, values, kind in (("image", images, pa.float32()), ("mask", masks, pa.int8())):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, pa.list_(kind)))
            yield batch

    spread = seeded.repartition(partitions(crops), "case_id", "label_id", "variant")
    return spread.mapInArrow(moved, seeded.schema).drop("seed")
