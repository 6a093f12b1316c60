"""Grey rasters: contrast by tiles, blur and thresholded sharpening, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "image_id long, width int, height int, data binary"


def clamp(x: np.ndarray) -> np.ndarray:
    """Rounds half to even and keeps 0 to 255."""
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def to_gray(rgba: np.ndarray) -> np.ndarray:
    """Luma of pixels by the weights 299, 587 and 114 thousandths."""
    return clamp(rgba[..., :3].astype(np.float64) @ np.array([299, 587, 114]) / 1000)


def sigma_for(width: int) -> float:
    return min(6.0, max(1.5, width / 900 * 1.5))


def kernel(sigma: float) -> np.ndarray:
    at = np.arange(-max(1, int(np.ceil(3 * sigma))), max(1, int(np.ceil(3 * sigma))) + 1)
    raw = np.exp(-(at * at) / (2 * sigma * sigma))
    return (raw.astype(np.float32) / raw.sum()).astype(np.float32)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, edges repeated; single precision between the passes, whole levels after both."""
    k = kernel(sigma).astype(np.float64)
    r = len(k) // 2
    wide = np.pad(image.astype(np.float64), ((0, 0), (r, r)), mode="edge")
    across = sum(w * wide[:, i : i + image.shape[1]] for i, w in enumerate(k)).astype(np.float32)
    tall = np.pad(across.astype(np.float64), ((r, r), (0, 0)), mode="edge")
    return clamp(sum(w * tall[i : i + image.shape[0]] for i, w in enumerate(k)))


def unsharp(image: np.ndarray, sigma: float | None = None, flat: float = 1.0, edge: float = 1.5, threshold: float = 5.1, brighten: float = 25.5, darken: float = 51.0) -> np.ndarray:
    """Adds the difference from the blur: gently below the threshold, steeply above, within caps."""
    diff = image.astype(np.float64) - blur(image, sigma or sigma_for(image.shape[1]))
    size = np.abs(diff)
    push = np.where(size <= threshold, size * flat, threshold * flat + (size - threshold) * edge)
    push = np.where(diff > 0, np.minimum(push, brighten), np.minimum(push, darken))
    return clamp(image + np.sign(diff) * push)


def tile_map(pixels: np.ndarray, clip: float) -> np.ndarray:
    """Levels of a tile after clipped equalisation; what is clipped goes to all levels, the rest to the lowest."""
    if not pixels.size:
        return np.arange(256, dtype=np.float64)
    hist = np.bincount(pixels.ravel(), minlength=256)
    limit = max(1, int(clip * pixels.size // 256))
    excess = int(np.maximum(hist - limit, 0).sum())
    hist = np.minimum(hist, limit) + excess // 256 + (np.arange(256) < excess % 256)
    return np.floor(np.cumsum(hist) / pixels.size * 255 + 0.5) % 256


def clahe(image: np.ndarray, tile: int = 64, clip: float = 3) -> np.ndarray:
    """Each pixel between the maps of the four nearest tile centres."""
    h, w = image.shape
    nx, ny = (max(1, int(np.floor(v / tile + 0.5))) for v in (w, h))
    edges = lambda n, size: np.floor(np.arange(n + 1) * (size / n)).astype(int)
    ex, ey = edges(nx, w), edges(ny, h)
    maps = np.array([[tile_map(image[ey[j] : ey[j + 1], ex[i] : ex[i + 1]], clip) for i in range(nx)] for j in range(ny)])

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.arange(size) / (size / n) - 0.5
        low = np.clip(np.floor(f), 0, n - 1).astype(int)
        return low, np.minimum(n - 1, low + 1), np.clip(f - low, 0, 1)

    (x0, x1, wx), (y0, y1, wy) = between(nx, w), between(ny, h)
    at = lambda j, i: maps[j[:, None], i[None, :], image]
    wx, wy = wx[None, :], wy[:, None]
    return clamp(at(y0, x0) * (1 - wx) * (1 - wy) + at(y0, x1) * wx * (1 - wy) + at(y1, x0) * (1 - wx) * wy + at(y1, x1) * wx * wy)


def preprocess(image: np.ndarray, contrast: bool = False, sharpen: bool = True) -> np.ndarray:
    out = clahe(image) if contrast else image
    return unsharp(out) if sharpen else out


def crop(image: np.ndarray, sx: int, sy: int, sw: int, sh: int) -> np.ndarray:
    return image[sy : sy + sh, sx : sx + sw]


def area_average(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size: each pixel the mean of the area it covers, whole and part pixels alike.

    A table of sums over all corners gives the sum of any area from four of them; lengths are in parts of a pixel that
    both sizes divide, so sums are whole numbers.
    """
    sums = np.pad(np.cumsum(np.cumsum(image.astype(np.int64), axis=0), axis=1), ((1, 0), (1, 0)))

    def at_edges(sums: np.ndarray, old: int, new: int) -> np.ndarray:
        """Along the first axis, `new` times the sums up to each edge of the new pixels."""
        cell, rest = np.divmod(np.arange(new + 1) * old, new)
        after = sums[np.minimum(cell + 1, old)]
        return sums[cell] * new + (after - sums[cell]) * rest[:, None]

    tall, wide = image.shape
    sums = at_edges(at_edges(sums, tall, height).T, wide, width).T
    total = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return clamp(total / (wide * tall))


def fit(image: np.ndarray, longest: int = 3000) -> np.ndarray:
    """Scaled down, never up, to a longest edge."""
    tall, wide = image.shape
    scale = min(1.0, longest / max(wide, tall))
    size = lambda v: max(1, int(np.floor(v * scale + 0.5)))
    return image if scale == 1 else area_average(image, size(wide), size(tall))


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned clockwise about the middle on paper that is large enough, between four pixels by their distance.

    Every new pixel asks where it comes from; what lies beyond the image is fill. Quarter turns are exact.
    """
    tall, wide = image.shape
    quarter = round(degrees / 90)
    if degrees == 90 * quarter:
        cos, sin = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))[quarter % 4]
    else:
        cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    w = int(np.ceil(abs(wide * cos) + abs(tall * sin) - 1e-9))
    h = int(np.ceil(abs(wide * sin) + abs(tall * cos) - 1e-9))
    x, y = np.meshgrid(np.arange(w) + 0.5 - w / 2, np.arange(h) + 0.5 - h / 2)
    sx, sy = cos * x + sin * y + wide / 2 - 0.5, -sin * x + cos * y + tall / 2 - 0.5
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        inside = (xx >= 0) & (xx < wide) & (yy >= 0) & (yy < tall)
        return np.where(inside, image[np.clip(yy, 0, tall - 1), np.clip(xx, 0, wide - 1)], float(fill))

    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return clamp(top * (1 - fy) + low * fy)


def levels(image: np.ndarray, factor: float, offset: float) -> np.ndarray:
    return clamp(image * factor + offset)


def degrade(image: np.ndarray, degrees: float = 0, sigma: float = 0, factor: float = 1, offset: float = 0, longest: int | None = None) -> np.ndarray:
    """A poor photograph of the image: turned, out of focus, pale or dark, and small."""
    out = rotate(image, degrees) if degrees else image
    out = blur(out, sigma) if sigma else out
    out = levels(out, factor, offset) if (factor, offset) != (1, 0) else out
    return fit(out, longest) if longest else out


def mapped(rasters: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """image_id, width, height, data after the change of each raster; batch by batch."""

    def run(batches):
        for batch in batches:
            ids, sizes, data = batch.column("image_id"), [], []
            for w, h, raw in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("data").to_pylist(), strict=True):
                new = change(np.frombuffer(raw, np.uint8).reshape(h, w))
                sizes.append(new.shape)
                data.append(new.tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array([s[1] for s in sizes], pa.int32()), pa.array([s[0] for s in sizes], pa.int32()), pa.array(data, pa.binary())], ["image_id", "width", "height", "data"])

    return rasters.select("image_id", "width", "height", "data").mapInArrow(run, SCHEMA)
