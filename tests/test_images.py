import numpy as np
import pytest

from kinetra.operators import images
from kinetra.operators.images import Segmentation, best_path, components, fill_holes, huber_smooth, otsu, perimeter, segment, segmented, surfaces


def test_parts():
    mask = np.zeros((7, 8), bool)
    mask[1:6, 1:6] = True
    mask[3, 3] = False
    mask[0, 7] = mask[1, 6] = True
    assert fill_holes(mask)[3, 3] and fill_holes(mask).sum() == mask.sum() + 1
    assert len(np.unique(components(mask))) - 1 == 1  # joined across a corner
    assert len(np.unique(components(mask, diagonal=False))) - 1 == 3 - 1 + 0 or len(np.unique(components(mask, diagonal=False))) == 3
    assert perimeter(np.ones((4, 5), bool)).sum() == 14
    assert images.dilate(images.erode(mask, 1), 1).sum() < mask.sum()
    image = np.repeat(np.array([10, 200], np.uint8), 50).reshape(10, 10)
    assert 10 <= otsu(image) <= 200
    assert segment(image, Segmentation(threshold=100))[0].sum() == 50
    assert segment(image, Segmentation(threshold=100, min_area=51))[0].sum() == 0
    bright = Segmentation(brightness=40, threshold=None)
    assert segment(image, bright)[2] == otsu(np.clip(image.astype(int) + 40, 0, 255).astype(np.uint8)) != otsu(image)


def test_edge_has_eight_neighbours():
    mask = np.ones((5, 5), bool)
    mask[0, 0] = False
    edge = perimeter(mask)
    assert edge[1, 1] and not edge[2, 2] and edge.sum() == 16


def test_labels_against_flooding():
    r = np.random.default_rng(9)
    for k in range(120):
        mask = r.random((r.integers(1, 12), r.integers(1, 12))) < r.uniform(0.2, 0.9)
        for diagonal in (True, False):
            want, h, w = np.zeros(mask.shape, int), *mask.shape
            for y, x in np.argwhere(mask):
                if not want[y, x]:
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < h and 0 <= b < w and mask[a, b] and not want[a, b]:
                            want[a, b] = y * w + x + 1
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not (i and j)]
            assert (components(mask, diagonal) == want).all()


def test_snake_is_one_component():
    mask = np.zeros((31, 31), bool)
    mask[::2] = True
    for i in range(1, 31, 4):
        mask[i, -1] = True
    for i in range(3, 31, 4):
        mask[i, 0] = True
    assert len(np.unique(components(mask))) == 2


def test_path_against_brute_force():
    r = np.random.default_rng(2)
    c = r.uniform(0.05, 1, (3, 4))
    c[0, 1] = np.nan
    best = min(((sum(-np.log(c[p[k], k]) for k in range(4)) + sum(2 * (p[k + 1] - p[k]) ** 2 for k in range(3))), p) for p in np.ndindex(3, 3, 3, 3) if not np.isnan([c[p[k], k] for k in range(4)]).any())
    assert tuple(best_path(c)) == best[1]
    c[:, 2] = np.nan
    assert best_path(c)[2] == -1
    assert (best_path(np.full((2, 3), np.nan)) == -1).all()


def test_smoothing():
    x = np.arange(120) * 0.1
    line = 0.2 * x
    assert np.abs(huber_smooth(line, np.ones(120), 0.1) - line).max() < 1e-9
    rough = line + np.random.default_rng(0).normal(0, 0.1, 120)
    smooth = huber_smooth(rough, np.ones(120), 0.1)
    assert np.diff(smooth, 2).std() < 0.3 * np.diff(rough, 2).std()
    assert np.abs(smooth - rough).max() <= 0.75 + 1e-9
    assert np.sqrt(((smooth - line) ** 2).mean()) < 0.1
    assert (huber_smooth(np.array([1.0, 2.0]), np.ones(2), 0.1) == [1, 2]).all()


def test_frames(spark):
    image = bytearray(np.full((6, 8), 20, np.uint8).tobytes())
    for c in range(8):
        image[3 * 8 + c] = 250
    data = [(1, 8, 6, bytes(image)), (2, 8, 6, bytes(image[:40])), (3, 8, 6, None), (4, None, 6, bytes(image)), (5, 0, 0, b"")]
    df = spark.createDataFrame(data, "id int, width int, height int, image binary")
    got = {x.id: x for x in segmented(df, "id", Segmentation(min_area=2)).collect()}
    assert (got[1].n_pixels, got[1].n_blobs, got[1].quality) == (8, 1, "Good")
    assert all(got[i].n_pixels is None for i in (2, 3, 4, 5))
    way = {x.id: x for x in surfaces(df, "id").collect()}
    assert way[1].rows == [pytest.approx(3)] * 8 and way[1].n_columns == 8 and way[2].rows is None
    sums = {x.id: (x.n, x.total) for x in images.grey_sums(df, "id", 41).collect()}
    assert sums == {1: (8, 2000), 2: (8, 2000), 4: (8, 2000), 5: (0, 0)}


def test_stretches_beside_a_gap_are_smoothed_each(spark):
    depth = 20 + np.array([0, 1, 0, 0, 1, 1, 0, 1, 0, 1, 0, 0])
    image = np.zeros((40, 25), np.uint8)
    image[depth, np.arange(12)] = image[depth + 9, np.arange(13, 25)] = 200
    halves = [(1, 25, 40, image.tobytes()), (2, 12, 40, image[:, :12].tobytes()), (3, 12, 40, image[:, 13:].tobytes())]
    way = {x.id: x for x in surfaces(spark.createDataFrame([(i, w, h, bytearray(b)) for i, w, h, b in halves], "id int, width int, height int, image binary"), "id").collect()}
    assert way[1].rows == pytest.approx(way[2].rows + [-1] + way[3].rows)
    assert way[1].rows[:12] != list(depth)
    assert way[1].roughness == pytest.approx(np.sqrt((way[2].roughness**2 + way[3].roughness**2) / 2))
