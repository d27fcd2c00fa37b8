"""Rectified note crops, their image variants, deskewing and text line bands: numpy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pinwall.operators.segmentation import as_rgb, lab_image, nearest_rank

LONG_SIDE, DARK = 960, 96
MOST_BANDS = 8


def _round(x: float) -> int:
    return int(np.floor(x + 0.5))


def homography(quad: np.ndarray) -> np.ndarray:
    """3 x 3 map of the unit square onto a quad (corners in order)."""
    p0, p1, p2, p3 = np.asarray(quad, float)
    d1, d2, d3 = p1 - p2, p3 - p2, p0 - p1 + p2 - p3
    g = h = 0.0
    det = d1[0] * d2[1] - d2[0] * d1[1]
    if np.abs(d3).max() > 1e-6 and abs(det) > 1e-8:
        g, h = (d3[0] * d2[1] - d2[0] * d3[1]) / det, (d1[0] * d3[1] - d3[0] * d1[1]) / det
    return np.array([[*(p1 - p0 + g * p1)[:1], *(p3 - p0 + h * p3)[:1], p0[0]], [(p1 - p0 + g * p1)[1], (p3 - p0 + h * p3)[1], p0[1]], [g, h, 1.0]])


def project(m: np.ndarray, u, v) -> np.ndarray:
    p = np.stack([u, v, np.ones_like(u)], -1) @ m.T
    return p[..., :2] / p[..., 2:]


def region_quad(note: dict, width: int, height: int, inset: float = -0.012) -> np.ndarray:
    """Corners of a note in photo pixels, scaled about their centre."""
    if note.get("corners") is not None and len(note["corners"]) == 4:
        base = np.array([[p["x"], p["y"]] for p in note["corners"]], float)
    else:
        x, y, w, h = (note[c] for c in ("x", "y", "width", "height"))
        base = np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
    base = base / 100 * [width, height]
    mid = base.mean(0)
    return np.clip(mid + (base - mid) * (1 - 2 * inset), 0, [width - 1, height - 1])


def _bilinear(image: np.ndarray, p: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    x0, y0 = np.clip(np.floor(p[..., 0]), 0, w - 1).astype(int), np.clip(np.floor(p[..., 1]), 0, h - 1).astype(int)
    x1, y1 = np.minimum(w - 1, x0 + 1), np.minimum(h - 1, y0 + 1)
    fx, fy = np.clip(p[..., 0] - x0, 0, 1)[..., None], np.clip(p[..., 1] - y0, 0, 1)[..., None]
    top, low = image[y0, x0] * (1 - fx) + image[y0, x1] * fx, image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return top * (1 - fy) + low * fy


def rectify(photo: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quad as an upright crop of LONG_SIDE, on white padding."""
    side = lambda a, b: np.hypot(*(quad[b] - quad[a]))
    w, h = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    scale = np.clip(LONG_SIDE / max(w, h, 1e-9), 0.25, 6)
    dw, dh = max(64, _round(w * scale)), max(64, _round(h * scale))
    pad = _round(np.clip(min(dw, dh) * 0.045, 16, 42))
    u, v = np.meshgrid(np.arange(dw) / (dw - 1), np.arange(dh) / (dh - 1))
    out = np.full((dh + 2 * pad, dw + 2 * pad, 3), 255, np.uint8)
    out[pad : pad + dh, pad : pad + dw] = np.floor(_bilinear(photo.astype(float), project(homography(quad), u, v)) + 0.5)
    return out


def _box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the square around each pixel, cut at the borders, by integral image."""
    h, w = x.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = x.cumsum(0).cumsum(1)
    y0, y1 = np.maximum(0, np.arange(h) - radius), np.minimum(h, np.arange(h) + radius + 1)
    x0, x1 = np.maximum(0, np.arange(w) - radius), np.minimum(w, np.arange(w) + radius + 1)
    total = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None])


def variants(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """gray, contrast, sauvola and ink images of a crop."""
    h, w = rgb.shape[:2]
    p = rgb.astype(float)
    lum = (p @ [0.299, 0.587, 0.114]).astype(np.float32).astype(float)
    radius = (_round(np.clip(min(h, w) * 0.09, 31, 91)) | 1) // 2
    mean = _box_mean(lum, radius)
    spread = np.sqrt(np.maximum(0, _box_mean(lum * lum, radius) - mean * mean))
    step = max(1, h * w // 6000)
    seen = p.reshape(-1, 3)[::step][lum.ravel()[::step] > 70]
    paper = np.array([max(64.0, nearest_rank(seen[:, c], 0.72)) for c in range(3)])
    darker = np.maximum(0, 1 - p / paper).mean(-1)
    local = np.maximum(0, (mean - lum) / np.maximum(28, 2.2 * spread))
    made = {
        "gray": lum,
        "contrast": np.clip(242 + 1.9 * (lum - mean), 0, 255),
        "sauvola": np.where(lum < mean * (1 + 0.2 * (spread / 128 - 1)) - 1.5, 0, 255),
        "ink": 255 - np.clip((np.maximum(1.25 * darker, local) - 0.035) * 520, 0, 255),
    }
    return {k: np.floor(v + 0.5).astype(np.uint8) for k, v in made.items()}


def deskew_angle(binary: np.ndarray) -> float:
    """Degrees by which text lines lean: the shear whose row histogram changes most sharply, if clearly better than none."""
    h, w = binary.shape
    if w < 32 or h < 32:
        return 0.0
    mx, my = _round(w * 0.05), _round(h * 0.06)
    stride = max(1, h * w // 30_000)
    ys, xs = np.nonzero(binary[my : h - my, mx : w - mx : stride] < DARK)
    xs, ys = xs * stride + mx, ys + my
    if len(xs) < 24:
        return 0.0

    def sharpness(deg: float) -> float:
        slope = np.tan(np.radians(deg))
        rows = np.floor(ys - slope * (xs - w / 2) + 0.5).astype(int) + int(np.ceil(abs(slope) * w / 2)) + 2
        n = h + int(np.ceil(abs(slope) * w)) + 4
        hist = np.bincount(rows[(rows >= 0) & (rows < n)], minlength=n).astype(float)
        return float((np.diff(hist) ** 2).sum())

    level = sharpness(0.0)
    best, top = 0.0, level
    for deg in np.arange(-7, 7.25, 0.5):
        if (now := sharpness(deg)) > top:
            best, top = float(deg), now
    return best if abs(best) >= 0.75 and top >= 1.035 * level else 0.0


def rotate(rgb: np.ndarray, deg: float) -> np.ndarray:
    """The crop turned about its centre on white, same size."""
    h, w = rgb.shape[:2]
    a = np.radians(deg)
    ys, xs = np.mgrid[:h, :w]
    dx, dy = xs - w / 2, ys - h / 2
    src = np.stack([dx * np.cos(a) + dy * np.sin(a) + w / 2, dy * np.cos(a) - dx * np.sin(a) + h / 2], -1)
    out = np.floor(_bilinear(rgb.astype(float), src) + 0.5).astype(np.uint8)
    gone = (src[..., 0] < 0) | (src[..., 1] < 0) | (src[..., 0] > w - 1) | (src[..., 1] > h - 1)
    out[gone] = 255
    return out


def prepare(photo: np.ndarray, note: dict) -> tuple[dict[str, np.ndarray], float]:
    """All five images of a note and the angle that was taken out."""
    rgb = rectify(photo, region_quad(note, photo.shape[1], photo.shape[0]))
    made = variants(rgb)
    lean = deskew_angle(made["sauvola"])
    if lean:
        rgb = rotate(rgb, -lean)
        made = variants(rgb)
    return {"rgb": rgb} | made, lean


def line_bands(binary: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of up to eight text lines of a crop: dark rows, smoothed, joined over small gaps and padded."""
    h, w = binary.shape
    if w < 16 or h < 16:
        return []
    mx, my = _round(w * 0.055), _round(h * 0.065)
    dark = np.zeros((h, w), bool)
    dark[my : h - my, mx : w - mx] = binary[my : h - my, mx : w - mx] < DARK
    counts = dark.sum(1).astype(float)
    r = max(1, _round(h * 0.004))
    total, n = (np.convolve(v, np.ones(2 * r + 1), "same") for v in (counts, np.ones(h)))
    active = np.zeros(h + 1, bool)
    active[my : h - my] = (total / n)[my : h - my] >= max(2, (w - 2 * mx) * 0.006)
    change = np.flatnonzero(np.diff(np.concatenate([[False], active]).astype(int)))
    runs = [[int(a), int(b) - 1] for a, b in zip(change[::2], change[1::2])]
    joined: list[list[int]] = []
    for a, b in runs:
        if joined and a - joined[-1][1] - 1 <= max(3, _round(h * 0.018)):
            joined[-1][1] = b
        else:
            joined.append([a, b])
    out = []
    for a, b in joined:
        tall = b - a + 1
        cols = np.flatnonzero(dark[a : b + 1].any(0))
        if not max(5, h * 0.012) <= tall <= h * 0.42 or not len(cols) or dark[a : b + 1].sum() < max(8, w * 0.018):
            continue
        py, px = max(4, _round(tall * 0.32)), max(10, _round((cols[-1] - cols[0] + 1) * 0.08))
        top, left = max(0, a - py), max(0, int(cols[0]) - px)
        low, right = max(top + 1, min(h, b + py)), max(left + 1, min(w, int(cols[-1]) + px))
        out.append((left, top, right - left, low - top))
    return out[:MOST_BANDS]


def line_crop(image: np.ndarray, band: tuple[int, int, int, int], height: int = 96) -> np.ndarray:
    """A band scaled to about `height` (at most 1024 wide) on a white border."""
    x, y, w, h = band
    scale = np.clip(min(height / h, 1024 / w), 0.75, 4)
    border = _round(np.clip(height * 0.12, 8, 16))
    dw, dh = max(1, _round(w * scale)), max(1, _round(h * scale))
    ys, xs = np.mgrid[:dh, :dw]
    src = np.stack([x + (xs + 0.5) / dw * w - 0.5, y + (ys + 0.5) / dh * h - 0.5], -1)
    src = np.clip(src, 0, [image.shape[1] - 1, image.shape[0] - 1])
    out = np.full((dh + 2 * border, dw + 2 * border, *image.shape[2:]), 255, np.uint8)
    flat = image if image.ndim == 3 else image[..., None]
    made = np.floor(_bilinear(flat.astype(float), src) + 0.5)
    out[border : border + dh, border : border + dw] = made if image.ndim == 3 else made[..., 0]
    return out


def expanded_item(image: np.ndarray, poly: list[tuple[float, float]], margin: float = 0.18) -> np.ndarray | None:
    """The box of a detected item with margins, cut from a crop; None if it is empty."""
    p = np.asarray(poly, float)
    low, high = p.min(0), p.max(0)
    grow = (high - low) * margin
    x0, y0 = np.maximum(0, np.floor(low - grow)).astype(int)
    x1, y1 = np.minimum([image.shape[1], image.shape[0]], np.ceil(high + grow)).astype(int)
    return image[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else None


def line_tensor(rgb: np.ndarray, height: int = 64, width: int = 1024) -> np.ndarray:
    """Luminance (0 to 1) of a line crop, `height` high, at most `width` wide, a multiple of 4 wide."""
    scale = height / rgb.shape[0]
    w = min(width, max(4, _round(rgb.shape[1] * scale)))
    w = -(-w // 4) * 4
    ys, xs = np.mgrid[:height, :w]
    src = np.stack([(xs + 0.5) / w * rgb.shape[1] - 0.5, (ys + 0.5) / height * rgb.shape[0] - 0.5], -1)
    lum = _bilinear(rgb.astype(float), np.clip(src, 0, [rgb.shape[1] - 1, rgb.shape[0] - 1])) @ [0.299, 0.587, 0.114]
    return (lum / 255).astype(np.float32)


def mask_quad(labels: np.ndarray, cluster: int, box: tuple[int, int, int, int]) -> np.ndarray:
    """Corners of a skewed paper from straight fits to the four sides of its mask; its box (min_x, max_x, min_y, max_y) if they don't make sense."""
    x0, x1, y0, y1 = box
    plain = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
    if min(labels.shape) < 2:
        return plain
    own = labels[y0 : y1 + 1, x0 : x1 + 1] == cluster
    w, h = x1 - x0 + 1, y1 - y0 + 1

    def sides(m: np.ndarray, inset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions along an axis with first and last mask pixel across it."""
        at = np.arange(len(m))
        at = at[(at >= inset) & (at < len(m) - inset) & m.any(1)]
        return at, m[at].argmax(1), m.shape[1] - 1 - m[at][:, ::-1].argmax(1)

    ax, top, low = sides(own.T, max(1, int(w * 0.035)))
    ay, left, right = sides(own, max(1, int(h * 0.035)))
    fits = [_line(ax + x0, top + y0), _line(ax + x0, low + y0), _line(ay + y0, left + x0), _line(ay + y0, right + x0)]
    if any(f is None for f in fits):
        return plain
    t, b, l, r = fits
    points = [_cross(t, l), _cross(t, r), _cross(b, r), _cross(b, l)]
    if any(p is None for p in points):
        return plain
    q = np.array(points)
    length = np.hypot(*(np.roll(q, -1, 0) - q).T)
    area = abs(sum(q[i - 1][0] * q[i][1] - q[i][0] * q[i - 1][1] for i in range(4))) / 2 / max(1, w * h)
    fine = (q >= [x0 - 0.16 * w, y0 - 0.16 * h]).all() and (q <= [x1 + 0.16 * w, y1 + 0.16 * h]).all()
    fine = fine and (length >= 0.55 * np.array([w, h, w, h])).all() and 0.42 <= area <= 1.25
    return q if fine else plain


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(slope, intercept), fitted again without the outliers of a first fit; None for fewer than four points."""
    if len(x) < 4:
        return None
    for again in (True, False):
        dx = x - x.mean()
        slope = float((dx * (y - y.mean())).sum() / (dx * dx).sum()) if (dx * dx).sum() > 1e-6 else 0.0
        base = float(y.mean() - slope * x.mean())
        if again:
            off = np.abs(y - (slope * x + base))
            keep = off <= max(1.5, 1.35 * nearest_rank(off, 0.78))
            if keep.sum() >= 4:
                x, y = x[keep], y[keep]
    return slope, base


def _cross(flat: tuple[float, float], steep: tuple[float, float]) -> tuple[float, float] | None:
    """Where y = a x + b meets x = c y + d."""
    det = 1 - steep[0] * flat[0]
    if abs(det) < 1e-4:
        return None
    x = (steep[0] * flat[1] + steep[1]) / det
    return x, flat[0] * x + flat[1]


def paper_lab(photo: np.ndarray, quad: np.ndarray, seed: np.ndarray | None = None, alpha: np.ndarray | None = None) -> np.ndarray:
    """Lab colour of a paper from points inside its quad: ink, shadow and covering papers are left out, a cluster's colour steadies the result."""
    side = lambda a, b: np.hypot(*(quad[b] - quad[a]))
    n = int(np.clip(_round((side(0, 1) + side(3, 2)) / 10), 18, 72))
    m = int(np.clip(_round((side(0, 3) + side(1, 2)) / 10), 18, 72))
    u, v = np.meshgrid(0.055 + 0.89 * (np.arange(n) + 0.5) / n, 0.055 + 0.89 * (np.arange(m) + 0.5) / m)
    u, v = u.reshape(-1, 1), v.reshape(-1, 1)
    p = (quad[0] * (1 - u) + quad[1] * u) * (1 - v) + (quad[3] * (1 - u) + quad[2] * u) * v
    x, y = (np.clip(np.floor(p[:, i] + 0.5), 0, photo.shape[1 - i] - 1).astype(int) for i in (0, 1))
    lab = lab_image(photo[y, x, :3])
    fine = (lab[:, 0] >= 18) & (lab[:, 0] <= 99.8)
    if alpha is not None:
        fine &= alpha[y, x] >= 160
    lab = lab[fine]
    if not len(lab):
        return np.array([85.0, 0, 0]) if seed is None else np.asarray(seed, float)
    if seed is None:
        low, high = nearest_rank(lab[:, 0], 0.18), nearest_rank(lab[:, 0], 0.94)
        lab = lab[(lab[:, 0] >= low) & (lab[:, 0] <= high)]
        return np.array([nearest_rank(lab[:, i], 0.5) for i in range(3)])
    seed = np.asarray(seed, float)
    off = np.sqrt(((lab - seed) ** 2).sum(1))
    own = (off <= np.clip(1.65 * nearest_rank(off, 0.28) + 1.5, 6.5, 18)) & (lab[:, 0] >= max(20, seed[0] - 34))
    if own.sum() < min(18, len(lab)):
        own = np.argsort(off, kind="stable")[: max(1, int(np.ceil(len(lab) * 0.18)))]
    return 0.78 * np.array([nearest_rank(lab[own][:, i], 0.5) for i in range(3)]) + 0.22 * seed


CROPS = "photo_id long, note_id long, variant string, width int, height int, channels int, data binary, deskew_angle double, bands array<struct<x:int,y:int,width:int,height:int>>"


def prepare_crops(photos: DataFrame, notes: DataFrame, mode: str = "BGR") -> DataFrame:
    """Five rows for each note with its image variants, deskew angle and text lines; photos and their notes meet by photo_id."""

    def run(key, photo: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(photo):
            p = photo.iloc[0]
            image = as_rgb(p["data"], p["height"], p["width"], p["n_channels"], mode)
            for note in own.sort_values("note_id").to_dict("records"):
                made, lean = prepare(image, note)
                bands = [dict(zip(("x", "y", "width", "height"), b)) for b in line_bands(made["sauvola"])]
                for name, a in made.items():
                    out.append((key[0], note["note_id"], name, a.shape[1], a.shape[0], 1 if a.ndim == 2 else 3, np.ascontiguousarray(a).tobytes(), lean, bands))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CROPS.split(", bands")[0].split(", ")] + ["bands"])

    return photos.groupBy("photo_id").cogroup(notes.groupBy("photo_id")).applyInPandas(run, CROPS)
