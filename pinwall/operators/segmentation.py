"""Segmentation of a photo into islands of paper colour: numpy kernels, one photo a task, and a native acceptance filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTERS, TRAINING, ROUNDS, SETTLED = 10, 25_000, 14, 0.04
SAMPLE_SIDE = 620


def nearest_rank(values, share: float) -> float:
    """Sorted value at index round(share * (n - 1)), halves up; 0 for none."""
    v = np.sort(np.asarray(values, float).ravel())
    return float(v[int(np.floor(min(1.0, max(0.0, share)) * (len(v) - 1) + 0.5))]) if len(v) else 0.0


def lab_image(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab (float64) of an array of sRGB values whose last axis has the channels."""
    v = np.asarray(rgb, float) / 255
    lin = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    to_xyz = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.072175], [0.0193339, 0.119192, 0.9503041]])
    t = lin @ to_xyz.T / [0.95047, 1.0, 1.08883]
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def sample_grid(rgb: np.ndarray) -> tuple[np.ndarray, int]:
    """Every step-th pixel, so that the longer side has about SAMPLE_SIDE."""
    step = max(1, int(np.floor(max(rgb.shape[:2]) / SAMPLE_SIDE + 0.5)))
    return rgb[::step, ::step], step


def _squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.stack([((points - c) ** 2).sum(-1) for c in centers], -1)


def cluster_lab(rgb: np.ndarray, clusters: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centroids): Lab k-means with fixed seeds. The first is nearest the mean, each next farthest from those before; ties go to the lowest index."""
    h, w = rgb.shape[:2]
    labs = lab_image(rgb.reshape(-1, 3)).astype(np.float32).astype(np.float64)
    n = len(labs)
    take = min(TRAINING, n)
    train = labs[np.minimum(n - 1, np.arange(take) * n // take)]
    centers = [train[int(((train - train.mean(0)) ** 2).sum(1).argmin())]]
    near = np.full(take, np.inf)
    while len(centers) < min(clusters, take):
        near = np.minimum(near, ((train - centers[-1]) ** 2).sum(1))
        centers.append(train[int(near.argmax())])
    centers = np.array(centers)
    for _ in range(ROUNDS):
        own = _squares(train, centers).argmin(1)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, train[:, c], len(centers)) for c in range(3)], 1)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        shift = ((moved - centers) ** 2).sum()
        centers = moved
        if shift < SETTLED:
            break
    return _squares(labs, centers).argmin(1).astype(np.uint8).reshape(h, w), centers


def majority(labels: np.ndarray, clusters: int) -> np.ndarray:
    """3 x 3 vote: a label with at least five votes and more than the pixel's own takes over, the lowest of equals."""
    h, w = labels.shape
    votes = np.zeros((clusters, h, w), np.int8)
    for c in range(clusters):
        own = np.pad(labels == c, 1).astype(np.int8)
        for dy in range(3):
            for dx in range(3):
                votes[c] += own[dy : dy + h, dx : dx + w]
    best, mine = votes.argmax(0), np.take_along_axis(votes, labels[None].astype(np.intp), 0)[0]
    top = votes.max(0)
    return np.where((top >= 5) & (top > mine), best, labels).astype(np.uint8)


def edge_strength(rgb: np.ndarray) -> np.ndarray:
    """Sobel magnitude over all channels, 0 to 1; the border is 0."""
    p = rgb.astype(np.float64)
    out = np.zeros(p.shape[:2], np.float32)
    if min(out.shape) < 3:
        return out
    col = p[:-2] + 2 * p[1:-1] + p[2:]
    row = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = col[:, 2:] - col[:, :-2], row[2:] - row[:-2]
    out[1:-1, 1:-1] = np.clip(np.sqrt((gx * gx + gy * gy).sum(-1)) / 720, 0, 1)
    return out


def islands(labels: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Number of the island of equal labels that each pixel is in, counted by first pixel in reading order; pixels touch across corners if diagonal."""
    h, w = labels.shape
    ids = np.arange(h * w).reshape(h, w)
    links = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if diagonal else 2]:
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
        same = labels[a] == labels[b]
        links.append(np.stack([ids[a][same], ids[b][same]]))
    u, v = np.concatenate(links, 1)
    root = ids.ravel().copy()
    while True:
        # hook roots to the smaller of a link's two, then flatten the trees
        ru, rv = root[u], root[v]
        if (ru == rv).all():
            break
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]
    return np.unique(root, return_inverse=True)[1].reshape(h, w)


def ring_contrast(labels: np.ndarray, centers: np.ndarray, cluster: int, box: tuple[int, int, int, int]) -> float:
    """Median colour distance of foreign labels on the frame two pixels outside the box (min_x, max_x, min_y, max_y)."""
    h, w = labels.shape
    x0, x1, y0, y1 = box
    xs, ys = np.arange(x0 - 2, x1 + 3), np.arange(y0, y1 + 1)
    px = np.concatenate([xs, xs, np.full(len(ys), x0 - 2), np.full(len(ys), x1 + 2)])
    py = np.concatenate([np.full(len(xs), y0 - 2), np.full(len(xs), y1 + 2), ys, ys])
    fine = (px >= 0) & (py >= 0) & (px < w) & (py < h)
    seen = labels[py[fine], px[fine]]
    seen = seen[seen != cluster]
    return nearest_rank(np.sqrt(((centers[seen] - centers[cluster]) ** 2).sum(1)), 0.5)


def describe(labels: np.ndarray, centers: np.ndarray) -> pd.DataFrame:
    """One row for each island with all that acceptance looks at."""
    h, w = labels.shape
    number = islands(labels)
    n = number.max() + 1
    ys, xs = np.mgrid[:h, :w]
    flat = number.ravel()
    low = lambda v: np.minimum.reduceat(v.ravel()[order], starts)
    high = lambda v: np.maximum.reduceat(v.ravel()[order], starts)
    order = np.argsort(flat, kind="stable")
    count = np.bincount(flat, minlength=n)
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    t = pd.DataFrame({"component_id": range(n), "cluster": labels.ravel()[order][starts].astype(int), "count": count, "min_x": low(xs), "max_x": high(xs), "min_y": low(ys), "max_y": high(ys)})
    box_w, box_h = t.max_x - t.min_x + 1, t.max_y - t.min_y + 1
    border = np.concatenate([labels[0], labels[-1], labels[1:-1, 0], labels[1:-1, -1]]) if h > 1 and w > 1 else labels.ravel()
    share = np.bincount(labels.ravel(), minlength=len(centers)) / labels.size
    rim = np.bincount(border, minlength=len(centers)) / max(1, len(border))
    t["area_ratio"] = box_w * box_h / labels.size
    t["fill"], t["aspect"] = t["count"] / (box_w * box_h), box_w / box_h
    t["lightness"], t["chroma"] = centers[t.cluster, 0], np.hypot(centers[t.cluster, 1], centers[t.cluster, 2])
    t["global_share"], t["border_share"] = share[t.cluster], rim[t.cluster]
    # no rule accepts islands this small or large, so their frames needn't be looked at
    t["ring_contrast"] = 0.0
    for i in t.index[(t.area_ratio >= 0.003) & (t.area_ratio <= 0.32)]:
        r = t.loc[i]
        t.loc[i, "ring_contrast"] = ring_contrast(labels, centers, int(r.cluster), (int(r.min_x), int(r.max_x), int(r.min_y), int(r.max_y)))
    return t


def acceptance() -> tuple[Column, Column]:
    """(accepted, complete) over the columns of describe()."""
    c = F.col
    background = (c("chroma") < 6.5) & ((c("global_share") > 0.025) | (c("border_share") > 0.06))
    shape = c("aspect").between(0.34, 2.3)
    complete = c("area_ratio").between(0.006, 0.19) & shape & (c("fill") >= 0.55) & (c("ring_contrast") >= 4.5)
    hidden = c("area_ratio").between(0.003, 0.19) & shape & (c("fill") >= 0.34) & (c("ring_contrast") >= 14)
    merged = c("area_ratio").between(0.012, 0.32) & c("aspect").between(0.22, 4) & (c("fill") >= 0.2) & (c("ring_contrast") >= 12)
    return ~background & (c("lightness") >= 45) & (c("chroma") >= 5.5) & (complete | hidden | merged), complete


PHOTO = "photo_id long, width int, height int, step int, labels binary, edges binary, centroids array<array<double>>, islands array<struct<component_id:int,cluster:int,count:int,min_x:int,max_x:int,min_y:int,max_y:int,area_ratio:double,fill:double,aspect:double,lightness:double,chroma:double,global_share:double,border_share:double,ring_contrast:double>>"


def as_rgb(data: bytes, height: int, width: int, channels: int, mode: str = "BGR") -> np.ndarray:
    """Pixels of an image row; Spark's image source stores blue first."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3]
    a = np.repeat(a, 3, -1) if a.shape[-1] == 1 else a
    return a[..., ::-1] if mode == "BGR" and channels > 1 else a


def segment(photos: DataFrame, mode: str = "BGR") -> DataFrame:
    """Label map, edges, centroids and all islands of each photo (photo_id, height, width, n_channels, data). A photo is one row; batches stream through the kernel."""

    def run(frames):
        for g in frames:
            out = []
            for p in g.itertuples():
                grid, step = sample_grid(as_rgb(p.data, p.height, p.width, p.n_channels, mode))
                labels, centers = cluster_lab(grid)
                labels = majority(labels, len(centers))
                t = describe(labels, centers)
                out.append((p.photo_id, labels.shape[1], labels.shape[0], step, labels.tobytes(), edge_strength(grid).tobytes(), centers.tolist(), t[t.area_ratio >= 0.003].to_dict("records")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PHOTO.split(", islands")[0].split(", ")] + ["islands"])

    return photos.select("photo_id", "height", "width", "n_channels", "data").mapInPandas(run, PHOTO)


def components(segmented: DataFrame) -> DataFrame:
    """The accepted islands of segment(), with their flag complete: a native filter."""
    rows = segmented.select("photo_id", F.explode("islands").alias("i")).select("photo_id", "i.*")
    accepted, complete = acceptance()
    return rows.where(accepted).withColumn("complete", complete)
