"""Contrast, sharpening, grey maps and crops of rasters."""

import numpy as np
import pytest

from tillproof.operators import raster
from tillproof.sources import words


def make(width, height, f):
    y, x = np.mgrid[:height, :width]
    return np.clip(np.broadcast_to(np.rint(f(x, y)), (height, width)), 0, 255).astype(np.uint8)


def test_gray_is_luma():
    assert raster.to_gray(np.array([[[255, 255, 255, 255], [0, 0, 0, 255], [255, 0, 0, 9], [0, 255, 0, 9], [0, 0, 255, 9]]], np.uint8)).tolist() == [[255, 0, 76, 150, 29]]


def test_contrast_by_tiles():
    dull = make(128, 128, lambda x, y: 60 + x / 128 * 120 + np.where((x + y) % 8 < 4, 12, 0))
    assert raster.clahe(dull).var() > dull.var()
    assert raster.clahe(make(64, 48, lambda x, y: x * 2)).shape == (48, 64)
    flat = raster.clahe(make(64, 64, lambda x, y: 128 + 0 * x))
    assert flat.max() == flat.min()
    mixed = make(80, 80, lambda x, y: (x * 7 + y * 13) % 256)
    assert (raster.clahe(mixed) == raster.clahe(mixed)).all()


def test_sharpening_steepens_edges_and_spares_grain():
    soft = make(40, 8, lambda x, y: 128 + 100 * np.tanh((x - 20) / 3))
    steep = lambda i: np.abs(np.diff(i[4].astype(int))).max()
    assert steep(raster.unsharp(soft)) > steep(soft)
    grain = make(64, 64, lambda x, y: 128 + (x * 31 + y * 17) % 3 - 1)
    out = raster.unsharp(grain).astype(int)
    assert out.max() - out.min() <= 2 * (int(grain.max()) - int(grain.min()))
    stripes = make(32, 32, lambda x, y: np.where(x % 2, 255, 0))
    assert raster.unsharp(stripes, edge=8.0).dtype == np.uint8


def test_recipes():
    img = make(64, 64, lambda x, y: (x * 5 + y * 3) % 256)
    assert (raster.preprocess(img) == raster.unsharp(img)).all()
    slope = make(64, 64, lambda x, y: 40 + x / 64 * 100)
    assert (raster.preprocess(slope, contrast=True) != raster.preprocess(slope)).any()
    assert raster.preprocess(make(100, 70, lambda x, y: x)).shape == (70, 100)


@pytest.mark.parametrize("sigma", [1.5, 2.0, 6.0])
def test_blur_equals_a_plain_convolution(sigma):
    img = np.random.default_rng(1).integers(0, 256, (9, 13)).astype(np.uint8)
    k = raster.kernel(sigma).astype(float)
    r, h, w = len(k) // 2, *img.shape
    at = lambda v, n: min(max(v, 0), n - 1)
    across = [[np.float32(sum(k[i + r] * img[y, at(x + i, w)] for i in range(-r, r + 1))) for x in range(w)] for y in range(h)]
    want = [[sum(k[i + r] * float(across[at(y + i, h)][x]) for i in range(-r, r + 1)) for x in range(w)] for y in range(h)]
    assert np.abs(raster.blur(img, sigma).astype(float) - np.array(want)).max() <= 0.5 + 1e-3


def test_grey_maps_are_read_from_files_and_sharpened(spark, tmp_path):
    images = {f"{i}.pgm": np.random.default_rng(i).integers(0, 256, (6 + i, 11)).astype(np.uint8) for i in range(3)}
    for name, i in images.items():
        (tmp_path / name).write_bytes(b"P5\n%d %d\n255\n" % (i.shape[1], i.shape[0]) + i.tobytes())
    (tmp_path / "other.pgm").write_bytes(b"P6\n1 1\n255\nabc")
    read = words.gray(spark.read.format("binaryFile").load(str(tmp_path))).selectExpr("cast(substring(path, -5, 1) as long) as image_id", "width", "height", "data")
    got = {r.image_id: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width) for r in raster.mapped(read, raster.preprocess).collect()}
    assert sorted(got) == [0, 1, 2] and all((got[int(n[0])] == raster.preprocess(i)).all() for n, i in images.items())


@pytest.mark.parametrize("tall,wide,h,w", [(8, 8, 5, 5), (7, 11, 3, 4), (5, 5, 1, 1), (6, 4, 9, 10), (9, 130, 9, 63)])
def test_area_averages_equal_sums_over_cells(tall, wide, h, w):
    image = np.random.default_rng(tall * wide).integers(0, 256, (tall, wide)).astype(np.uint8)
    want = np.zeros((h, w))
    for j in range(h):
        for i in range(w):
            over = lambda k, n, old, new: max(0, min((k + 1) * new, (n + 1) * old) - max(k * new, n * old))
            want[j, i] = sum(int(image[y, x]) * over(y, j, tall, h) * over(x, i, wide, w) for y in range(tall) for x in range(wide)) / (tall * wide)
    assert (raster.area_average(image, w, h) == raster.clamp(want)).all()


def test_fit_scales_down_only():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert raster.fit(image, 8) is image and raster.fit(image, 5).shape == (4, 5) and raster.fit(image, 1).shape == (1, 1)


def test_quarter_turns_are_exact_and_small_angles_equal_a_loop():
    image = np.random.default_rng(3).integers(0, 256, (7, 10)).astype(np.uint8)
    for k in range(-3, 5):
        assert (raster.rotate(image, 90 * k) == np.rot90(image, -k)).all()
    for degrees in (1.5, -4.0, 33.0):
        got, (tall, wide) = raster.rotate(image, degrees, fill=200), image.shape
        cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        for (j, i), seen in np.ndenumerate(got):
            x, y = i + 0.5 - got.shape[1] / 2, j + 0.5 - got.shape[0] / 2
            sx, sy = cos * x + sin * y + wide / 2 - 0.5, -sin * x + cos * y + tall / 2 - 0.5
            total = 0.0
            for yy in (int(np.floor(sy)), int(np.floor(sy)) + 1):
                for xx in (int(np.floor(sx)), int(np.floor(sx)) + 1):
                    value = image[yy, xx] if 0 <= yy < tall and 0 <= xx < wide else 200
                    total += value * (1 - abs(sx - xx)) * (1 - abs(sy - yy))
            assert abs(int(seen) - total) <= 0.5 + 1e-6


def test_degraded_planes_wide_enough_for_tiles():
    image = np.random.default_rng(4).integers(0, 256, (150, 200)).astype(np.uint8)
    poor = raster.degrade(image, degrees=2.0, sigma=1.2, factor=0.8, offset=20, longest=120)
    assert max(poor.shape) == 120 and poor.dtype == np.uint8
    assert raster.preprocess(poor, contrast=True).shape == poor.shape
