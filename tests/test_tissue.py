"""Tissue contours against direct sums on small images."""

import colorsys

import numpy as np

from tilework.operators import rasters, shapes, tissue

RNG = np.random.default_rng(41)


def direct(image, diameter, colour, space):
    r = diameter // 2
    wide = np.pad(image.astype(float), r, "reflect")
    out = np.zeros(image.shape)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            total = weight = 0.0
            for a in range(-r, r + 1):
                for b in range(-r, r + 1):
                    if a * a + b * b <= r * r:
                        v = wide[y + r + a, x + r + b]
                        w = np.exp(-(a * a + b * b) / 2 / space**2 - (v - image[y, x]) ** 2 / 2 / colour**2)
                        total, weight = total + w * v, weight + w
            out[y, x] = total / weight
    return out


def test_bilateral_equals_direct_sums():
    image = RNG.integers(0, 256, (17, 21)).astype("u1")
    for diameter, colour, space in ((9, 5000.0, 5000.0), (7, 60.0, 3.0), (5, 100.0, 100.0)):
        assert np.abs(tissue.bilateral(image, diameter, colour, space) - direct(image, diameter, colour, space)).max() <= 1.6


def test_hues():
    rgb = RNG.integers(0, 256, (9, 9, 3)).astype("u1")
    want = [[colorsys.rgb_to_hsv(*(p / 255))[0] * 180 for p in line] for line in rgb]
    assert np.abs(tissue.half_degree_hue(rgb) - want).max() <= 0.51 and tissue.half_degree_hue(np.full((1, 1, 3), 7, "u1"))[0, 0] == 0


def test_otsu():
    image = np.array([10] * 50 + [12] * 50 + [200] * 40, "u1")
    assert tissue.otsu(image) == 12 and tissue.otsu(np.full(5, 9, "u1")) == 9


def test_stained_disk_is_found(spark):
    y, x = np.mgrid[:60, :80]
    disk = (y - 30) ** 2 + (x - 35) ** 2 <= 18**2
    image = np.where(disk[..., None], [170, 60, 160], [240, 240, 240]).astype("u1")
    blank = np.full((8, 8, 3), 240, "u1")
    frame = spark.createDataFrame([(n, i.shape[1], i.shape[0], 3, bytearray(i.tobytes())) for n, i in (("s", image), ("blank", blank))], "slide_id string, width int, height int, channels int, data binary")
    runs = tissue.tissue_runs(frame, ((9, 5000.0, 5000.0),) * 2)
    got = np.zeros((60, 80), bool)
    for r in runs.collect():
        assert r.slide_id == "s"
        got[r.row, r.lo : r.hi + 1] = True
    assert (got & disk).sum() > 0.9 * disk.sum() and (got & ~disk).sum() < 0.25 * disk.sum()
    rings = shapes.contours(rasters.run_components(runs))
    assert shapes.contour_measures(rings).first()["area"] == got.sum() and rings.where("hole").count() == 0
    assert tissue.contour_mask(image).shape == (60, 80)
