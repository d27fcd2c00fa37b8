"""Segmentation, recovery and crop kernels on drawn label maps and photos."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pinwall.operators import crops, layout, recovery, segmentation

RNG = np.random.default_rng(3)


def paint(labels, cx, cy, w, h, deg, value):
    ys, xs = np.mgrid[: labels.shape[0], : labels.shape[1]]
    a = np.radians(deg)
    dx, dy = xs - cx, ys - cy
    labels[(np.abs(dx * np.cos(a) + dy * np.sin(a)) <= w / 2) & (np.abs(dy * np.cos(a) - dx * np.sin(a)) <= h / 2)] = value


def found_in(labels, values, complete=None):
    rows = []
    number = segmentation.islands(labels)
    for i in np.unique(number[np.isin(labels, values)]):
        ys, xs = np.nonzero(number == i)
        rows.append({"component_id": int(i), "cluster": int(labels[ys[0], xs[0]]), "count": len(xs), "min_x": xs.min(), "max_x": xs.max(), "min_y": ys.min(), "max_y": ys.max(), "complete": complete})
    return pd.DataFrame(rows).sort_values("count", ascending=False)


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 1 << 30))
@settings(max_examples=60, deadline=None)
def test_islands_are_flood_fills(h, w, seed):
    labels = np.random.default_rng(seed).integers(0, 3, (h, w)).astype(np.uint8)
    want = np.full((h, w), -1)
    n = 0
    for y in range(h):
        for x in range(w):
            if want[y, x] < 0:
                stack = [(y, x)]
                want[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for p in range(max(0, a - 1), min(h, a + 2)):
                        for q in range(max(0, b - 1), min(w, b + 2)):
                            if want[p, q] < 0 and labels[p, q] == labels[a, b]:
                                want[p, q] = n
                                stack.append((p, q))
                n += 1
    assert (segmentation.islands(labels) == want).all()


def test_majority_votes():
    labels = np.zeros((5, 5), np.uint8)
    labels[2, 2] = 1
    assert (segmentation.majority(labels, 2) == 0).all()
    labels[:, :] = np.arange(25).reshape(5, 5) % 9
    assert (segmentation.majority(labels, 9) == labels).all()


def test_kmeans_is_deterministic_and_separates():
    rgb = np.zeros((40, 60, 3), np.uint8)
    rgb[:, :20], rgb[:, 20:40], rgb[:, 40:] = (247, 220, 104), (169, 217, 238), (242, 163, 180)
    labels, centers = segmentation.cluster_lab(rgb, 3)
    again, _ = segmentation.cluster_lab(rgb, 3)
    assert (labels == again).all() and len(np.unique(labels)) == 3
    assert len(np.unique(labels[:, :20])) == 1


def test_occluded_papers_are_recovered():
    labels = np.zeros((190, 270), np.uint8)
    for cx, cy in ((40, 40), (120, 38), (205, 42)):
        paint(labels, cx, cy, 46, 46, 0, 1)
    paint(labels, 92, 130, 48, 48, 12, 1)
    paint(labels, 130, 142, 48, 48, -9, 1)
    t = found_in(labels, [1])
    made = recovery.recover(t, labels)
    hidden = [g for g in made if g["evidence"] == "occlusion-edges"]
    assert len(made) == 5 and len(hidden) == 2
    mids = np.array([np.mean(g["corners"], 0) for g in hidden])
    for want in ((92, 130), (130, 142)):
        assert np.hypot(*(mids - want).T).min() <= 9


def test_specks_are_rejected():
    labels = np.zeros((150, 220), np.uint8)
    for cx, cy in ((40, 40), (110, 40), (40, 105), (110, 105)):
        paint(labels, cx, cy, 44, 44, 0, 1)
    labels[60:69, 180:192] = 1
    made = recovery.recover(found_in(labels, [1]), labels)
    assert len(made) == 4 and all(g["max_x"] < 170 for g in made)


def test_turned_paper_keeps_its_turn():
    labels = np.zeros((200, 260), np.uint8)
    for cx, cy, deg in ((50, 50, 0), (130, 50, 0), (210, 50, 0), (120, 140, 20)):
        paint(labels, cx, cy, 50, 50, deg, 1)
    made = recovery.recover(found_in(labels, [1], True), labels)
    tilted = min(made, key=lambda g: abs(np.mean(g["corners"], 0)[1] - 140))
    q = np.array(tilted["corners"])
    assert recovery.turn_gap(np.arctan2(*(q[1] - q[0])[::-1]), np.radians(20)) <= np.radians(3)


def test_skewed_mask_quad():
    labels = np.zeros((32, 40), np.uint8)
    for y in range(5, 27):
        labels[y, 6 + y // 6 : 33 - (y - 5) // 12] = 1
    ys, xs = np.nonzero(labels)
    q = crops.mask_quad(labels, 1, (xs.min(), xs.max(), ys.min(), ys.max()))
    assert q[3][0] - q[0][0] >= 1 and q[0][0] < q[1][0] and q[0][1] < q[3][1]


def test_homography_corners():
    quad = np.array([[10, 12], [210, 20], [190, 180], [15, 170]], float)
    m = crops.homography(quad)
    got = crops.project(m, np.array([0.0, 1, 1, 0]), np.array([0.0, 0, 1, 1]))
    assert np.abs(got - quad).max() < 1e-6


def _page(lines):
    """A yellow note with dark bars as text lines on a grey photo."""
    photo = np.full((300, 300, 3), 120, np.uint8)
    photo[50:250, 50:250] = (247, 220, 104)
    for y in lines:
        photo[y : y + 12, 70:230] = 30
    return photo, {"corners": None, "x": 50 / 3, "y": 50 / 3, "width": 200 / 3, "height": 200 / 3}


def test_bands_and_variants():
    photo, note = _page([90, 140, 190])
    made, lean = crops.prepare(photo, note)
    assert set(made) == {"rgb", "gray", "contrast", "sauvola", "ink"} and lean == 0
    bands = crops.line_bands(made["sauvola"])
    assert len(bands) == 3 and [b[1] for b in bands] == sorted(b[1] for b in bands)
    assert crops.line_crop(made["rgb"], bands[0]).shape[0] >= 96
    assert crops.line_tensor(made["rgb"]).shape[0] == 64 and crops.line_tensor(made["rgb"]).shape[1] % 4 == 0
    assert crops.line_bands(np.full((200, 200), 255, np.uint8)) == []


def test_deskew():
    image = np.full((240, 320), 255, np.uint8)
    ys, xs = np.mgrid[:240, :320]
    for k in (60, 110, 160):
        image[np.abs(ys - k - np.tan(np.radians(4)) * (xs - 160)) < 4] = 0
    assert crops.deskew_angle(image) == pytest.approx(4, abs=0.6)
    assert crops.deskew_angle(np.full((240, 320), 255, np.uint8)) == 0


def test_paper_colour_survives_ink_and_cover():
    photo, _ = _page(range(80, 220, 20))
    quad = np.array([[50, 50], [250, 50], [250, 250], [50, 250]], float)
    want = segmentation.lab_image(np.array([247, 220, 104]))
    assert np.abs(crops.paper_lab(photo, quad) - want).max() < 3
    photo[50:200, 50:250] = (242, 163, 180)
    assert np.abs(crops.paper_lab(photo, quad, seed=want) - want).max() < 3


@pytest.mark.parametrize("first", [1, 2])
def test_painted_last_lies_on_top(first):
    labels = np.zeros((100, 100), np.uint8)
    boxes = {1: (20, 60), 2: (40, 80)}
    for value in (first, 3 - first):
        a, b = boxes[value]
        labels[a:b, a:b] = value
    quads = [np.array([[a, a], [b, a], [b, b], [a, b]], float) for a, b in boxes.values()]
    layers = layout.stacking([1, 2], quads, labels)
    assert layers == ([0, 1] if first == 1 else [1, 0])
    assert layout.stacking([1, 1], quads, labels) == [0, 1]


def test_photo_to_papers(spark):
    photo = np.full((240, 320, 3), 128, np.uint8)
    for x, color in ((30, (247, 220, 104)), (130, (242, 163, 180)), (230, (169, 217, 238))):
        photo[60:120, x : x + 60] = color
    row = [(1, 240, 320, 3, photo.tobytes()), (2, 2, 2, 3, bytes(12))]
    photos = spark.createDataFrame(row, "photo_id long, height int, width int, n_channels int, data binary")
    cut = segmentation.segment(photos, mode="RGB").cache()
    parts = segmentation.components(cut)
    assert parts.where("photo_id = 1").count() == 3
    papers = recovery.recover_photos(cut, parts).toPandas()
    assert len(papers) == 3 and set(papers.photo_id) == {1}
    notes = spark.createDataFrame([(1, 7, 30 / 3.2, 25.0, 60 / 3.2, 25.0)], "photo_id long, note_id long, x double, y double, width double, height double")
    made = crops.prepare_crops(photos, notes, mode="RGB").toPandas()
    assert sorted(made.variant) == ["contrast", "gray", "ink", "rgb", "sauvola"]
