"""Recovery of paper rectangles from colour islands, hidden ones included."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.functions.similarity import quad_shares
from pinwall.operators.segmentation import islands

DEG = np.pi / 180
MOST_NOTES, MOST_EXACT, MOST_PER_ISLAND = 42, 140, 7


@dataclass
class Prior:
    """What a typical paper of the photo measures, in sample pixels."""

    short: float
    long: float
    visible: float

    @property
    def paper(self) -> float:
        return self.visible / 0.84


def turn_gap(a, b):
    """Difference of angles (radians) when a quarter turn doesn't count."""
    d = np.abs(a - b) % (np.pi / 2)
    return np.minimum(d, np.pi / 2 - d)


def size_prior(t: pd.DataFrame, shape: tuple[int, int]) -> Prior:
    """From well-filled islands off the border, without the oddly small and large; from all if those are fewer than three."""
    h, w = shape
    bw, bh = t.max_x - t.min_x + 1, t.max_y - t.min_y + 1
    lo, hi = np.minimum(bw, bh), np.maximum(bw, bh)
    side = min(h, w)
    rim = touches_border(t, shape)
    good = ~rim & (t.complete.eq(True) | (t.fill >= 0.62)) & (t.fill >= 0.58) & (lo >= 0.075 * side) & (hi <= 0.42 * side) & (hi / np.maximum(1, lo) <= 1.72)
    pick = good if good.sum() >= 3 else t.fill >= 0.55
    pick = pick if pick.any() else pick | True
    middle = t["count"][pick].median()
    usual = pick & t["count"].between(0.5 * middle, 1.65 * middle)
    pick = usual if usual.sum() >= 3 else pick
    visible = max(24.0, float(t["count"][pick].median()))
    aspect = float(np.clip((hi / np.maximum(1, lo))[pick].median(), 1, 1.38))
    short = max(8.0, np.sqrt(visible / 0.84 / aspect))
    return Prior(short, short * aspect, visible)


def touches_border(t: pd.DataFrame, shape: tuple[int, int]) -> pd.Series:
    return (t.min_x <= 1) | (t.min_y <= 1) | (t.max_x >= shape[1] - 2) | (t.max_y >= shape[0] - 2)


def corners(r: np.ndarray) -> np.ndarray:
    """(n, 4, 2) corners of rectangles (cx, cy, width, height, angle)."""
    r = np.atleast_2d(r)
    unit = np.array([[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]])
    return place(r, unit[:, 0], unit[:, 1])


def place(r: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(n, k, 2) points at (u, v) of each rectangle, in units of its sides from its centre."""
    x, y = r[:, 2:3] * u, r[:, 3:4] * v
    c, s = np.cos(r[:, 4:5]), np.sin(r[:, 4:5])
    return np.stack([r[:, 0:1] + x * c - y * s, r[:, 1:2] + x * s + y * c], -1)


def _at(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Grid values at the nearest pixels of points, 0 outside."""
    x, y = np.floor(p[..., 0] + 0.5).astype(int), np.floor(p[..., 1] + 0.5).astype(int)
    fine = (x >= 0) & (y >= 0) & (x < grid.shape[1]) & (y < grid.shape[0])
    return np.where(fine, grid[np.clip(y, 0, grid.shape[0] - 1), np.clip(x, 0, grid.shape[1] - 1)], 0)


_SIDES = [((1, 0), -0.5, (0, 1)), ((0, 1), 0.5, (-1, 0)), ((1, 0), 0.5, (0, -1)), ((0, 1), -0.5, (1, 0))]


def rate(mask: np.ndarray, r: np.ndarray, edges: np.ndarray | None) -> pd.DataFrame:
    """visible, boundary, adjacent, score and side0 to side3 of rectangles over a mask: how much paper shows inside, and how well each side is a border of it."""
    r = np.atleast_2d(r).astype(float)
    grid = np.linspace(-0.4, 0.4, 7)
    visible = _at(mask, place(r, np.tile(grid, 7), np.repeat(grid, 7))).mean(1)
    along = np.linspace(-0.43, 0.43, 13)
    reach = np.clip(np.floor(np.minimum(r[:, 2], r[:, 3]) * 0.035 + 0.5), 1, 3)
    c, s = np.cos(r[:, 4]), np.sin(r[:, 4])
    sides = []
    for axis, fixed, inward in _SIDES:
        u, v = (along, np.full(13, fixed)) if axis == (1, 0) else (np.full(13, fixed), along)
        base = place(r, u, v)
        normal = np.stack([inward[0] * c - inward[1] * s, inward[0] * s + inward[1] * c], -1)[:, None, :]
        border, raw = np.zeros(base.shape[:2], bool), np.zeros(base.shape[:2])
        for shift in range(-3, 4):
            used = (abs(shift) <= reach)[:, None]
            at = base + normal * shift
            border |= used & (_at(mask, at + 1.35 * normal) == 1) & (_at(mask, at - 1.35 * normal) == 0)
            if edges is not None:
                raw = np.where(used, np.maximum(raw, _at(edges, at)), raw)
        sides.append(np.where(border, 0.72 + 0.28 * raw, 0.5 * raw).mean(1))
    q = np.stack(sides, 1)
    top = -np.sort(-q, 1)
    boundary = (top[:, 0] + top[:, 1] + 0.55 * top[:, 2]) / 2.55
    nxt = np.roll(q, -1, 1)
    adjacent = (0.68 * np.minimum(q, nxt) + 0.16 * (q + nxt)).max(1)
    out = pd.DataFrame({"visible": visible, "boundary": boundary, "adjacent": adjacent, "score": 0.42 * adjacent + 0.27 * boundary + 0.19 * visible + 0.12 * top[:, 2]})
    for i in range(4):
        out[f"side{i}"] = q[:, i]
    return out


def outline(mask: np.ndarray, edges: np.ndarray | None) -> np.ndarray:
    """(x, y) of pixels on the island's border, and of raw edges within two pixels of it (ink inside a note is no outline)."""
    m = mask.astype(bool)
    p = np.pad(m, 2)
    h, w = m.shape
    around = np.stack([p[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] for dy in range(-2, 3) for dx in range(-2, 3)])
    cross = p[1 : 1 + h, 2 : 2 + w] & p[3 : 3 + h, 2 : 2 + w] & p[2 : 2 + h, 1 : 1 + w] & p[2 : 2 + h, 3 : 3 + w]
    on = m & ~cross
    if edges is not None:
        on |= around.any(0) & ~around.all(0) & (edges >= 0.2)
    on[[0, -1]] = on[:, [0, -1]] = False
    ys, xs = np.nonzero(on)
    return np.stack([xs, ys], 1)


def _runs(points: np.ndarray, angle: float, shortest: float) -> list[float]:
    """Scores of the up to four best straight runs of points in a direction; neighbours of better ones don't count."""
    c, s = np.cos(angle), np.sin(angle)
    along, rho = points @ [c, s], np.floor((points @ [-s, c]) / 2 + 0.5).astype(int)
    order = np.lexsort((along, rho))
    along, rho = along[order], rho[order]
    if not len(along):
        return []
    new = np.concatenate([[True], (np.diff(rho) != 0) | (np.diff(along) > 4.5)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(along)) - 1
    span, n = along[last] - along[first], last - first + 1
    size = np.bincount(rho - rho.min())[rho[first] - rho.min()]
    merit = np.where((span >= shortest) & (size >= 5), span * np.clip(n / np.maximum(1, span) / 0.42, 0, 1), 0)
    best: dict[int, float] = {}
    for k, m in zip(rho[first].tolist(), merit.tolist()):
        if m > best.get(k, 0):
            best[k] = m
    alone = [m for k, m in best.items() if not any(best.get(k + d, 0) > m for d in (-1, 1))]
    return sorted(alone, reverse=True)[:4]


def dominant_angles(points: np.ndarray, short: float) -> list[float]:
    """Up to four directions (radians) in which both families of sides are seen, and always about level."""
    shortest = max(10.0, 0.22 * short)
    ranked = []
    for deg in np.arange(-45, 45, 2.5):
        a, b = (_runs(points, (deg + q) * DEG, shortest) + [0, 0, 0] for q in (0, 90))
        x, y = a[0] + 0.65 * a[1], b[0] + 0.65 * b[1]
        ranked.append((1.15 * min(x, y) + 0.35 * max(x, y) + 0.22 * (a[2] + b[2]), deg))
    ranked.sort(key=lambda r: -r[0])
    out: list[float] = []
    for _, deg in ranked:
        if len(out) < 4 and all(abs(deg - o) >= 6 and abs(abs(deg - o) - 90) >= 6 for o in out):
            out.append(deg)
    if not any(abs(o) <= 4 for o in out):
        out.append(0.0)
    return [o * DEG for o in out]


def _geometry(row, r: np.ndarray, score: float, evidence: str, shape: tuple[int, int], **more) -> dict:
    q = np.clip(corners(r)[0], 0, [shape[1] - 1, shape[0] - 1])
    low, high = np.floor(q.min(0)).astype(int), np.ceil(q.max(0)).astype(int)
    box = {"min_x": int(low[0]), "max_x": int(high[0]), "min_y": int(low[1]), "max_y": int(high[1])}
    return {"cluster": int(row.cluster), "count": int(row["count"]), "fill": float(row.fill), "complete": True} | box | {"corners": q.tolist(), "overlap_score": float(score), "evidence": evidence} | more


def fit_single(row, mask: np.ndarray, prior: Prior, edges: np.ndarray | None) -> dict | None:
    """The rectangle around a whole island whose sides are borders of it; None if none stands."""
    ys, xs = np.nonzero(mask)
    if not len(xs):
        return None
    known = np.array(dominant_angles(outline(mask, edges), prior.short))
    angles = np.arange(-45, 45, 2.5) * DEG
    gaps = np.abs(turn_gap(angles[:, None], known[None]))
    angles = angles[np.argsort(gaps.min(1), kind="stable")]
    c, s = np.cos(angles)[:, None], np.sin(angles)[:, None]
    u, v = xs * c + ys * s, ys * c - xs * s
    w, h = np.ptp(u, 1) + 1, np.ptp(v, 1) + 1
    mu, mv = (u.min(1) + u.max(1)) / 2, (v.min(1) + v.max(1)) / 2
    r = np.stack([mu * c[:, 0] - mv * s[:, 0], mu * s[:, 0] + mv * c[:, 0], w, h, angles], 1)
    t = rate(mask, r, edges)
    fill = len(xs) / np.maximum(1, w * h)
    strong = (t[[f"side{i}" for i in range(4)]] >= 0.36).sum(1)
    stands = (strong >= 3) | ((strong >= 2) & (t.adjacent >= 0.48) & (fill >= 0.52)) | ((row.complete is True or row.complete == 1) & (fill >= 0.58) & (t.boundary >= 0.32))
    stands &= (np.minimum(w, h) >= 0.38 * prior.short) & (np.maximum(w, h) <= 1.65 * prior.long)
    if not stands.any():
        return None
    coherent = (np.abs(turn_gap(angles[:, None], known[None])).min(1) <= 4 * DEG).astype(float)
    odd = np.abs(np.log(np.clip(np.sqrt(w * h / max(1, prior.short * prior.long)), 0.25, 4)))
    rank = np.where(stands, 0.34 * t.score + 0.58 * np.minimum(1, fill) + 0.08 * coherent - 0.08 * odd, -np.inf)
    i = int(rank.argmax())
    return _geometry(row, r[i], t.score[i], "complete", mask.shape)


def _shapes(prior: Prior, wide: bool) -> np.ndarray:
    aspect = float(np.clip(prior.long / max(1, prior.short), 1, 1.42))
    ratios = [1.0, aspect, 1 / aspect] + ([1.55, 1 / 1.55] if wide else [])
    side = np.sqrt(prior.long * prior.short)
    return np.array([[side * np.sqrt(a) * k, side / np.sqrt(a) * k] for k in (0.88, 1.04, 1.16) for a in ratios])


def _covers(r: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    c, s = np.cos(r[4]), np.sin(r[4])
    dx, dy = xs - r[0], ys - r[1]
    return (np.abs(dx * c + dy * s) <= r[2] / 2) & (np.abs(dy * c - dx * s) <= r[3] / 2)


def recover_hidden(row, mask: np.ndarray, prior: Prior, edges: np.ndarray | None) -> list[dict]:
    """Papers of typical size whose visible parts make up the island: scanned by position, shape and turn, then chosen greedily by what they newly explain."""
    ys, xs = np.nonzero(mask)
    total = len(xs)
    limit = int(np.clip(np.floor(total / max(1, prior.paper) + 0.5), 1, MOST_PER_ISLAND))
    step, margin = max(6, int(np.floor(0.11 * prior.short + 0.5))), 0.14 * prior.short
    cx, cy = np.meshgrid(np.arange(row.min_x - margin, row.max_x + margin + 1e-9, step), np.arange(row.min_y - margin, row.max_y + margin + 1e-9, step))
    spots = np.stack([cx.ravel(), cy.ravel()], 1)
    ring = np.array([[a, b] for a in (-0.2, 0, 0.2) for b in (-0.2, 0, 0.2)]) * prior.short
    spots = spots[_at(mask, spots[:, None] + ring).sum(1) >= 2]
    sizes, angles = _shapes(prior, limit > 1), dominant_angles(outline(mask, edges), prior.short)
    found = []
    for at in range(0, len(spots), 256):
        part = spots[at : at + 256]
        n = len(sizes) * len(angles)
        r = np.column_stack([np.repeat(part, n, 0), np.tile(np.repeat(sizes, len(angles), 0), (len(part), 1)), np.tile(angles, len(part) * len(sizes))])
        t = rate(mask, r, edges)
        strong = (t[[f"side{i}" for i in range(4)]] >= 0.28).sum(1)
        fine = ((t.visible >= 0.2) & (strong >= 3) & (t.adjacent >= 0.31) & (t.boundary >= 0.31) & (t.score >= 0.34)).to_numpy()
        found += list(zip(r[fine], t.score[fine], t.visible[fine]))
    found = sorted(found, key=lambda f: -f[1])[:MOST_EXACT]
    cover = [_covers(r, xs, ys) for r, _, _ in found]
    rank = [0.6 * s + 0.2 * v + min(0.2, 0.3 * c.sum() / max(1, total)) for (_, s, v), c in zip(found, cover)]
    explained, chosen = np.zeros(total, bool), []
    for i in sorted(range(len(found)), key=lambda i: -rank[i]):
        if len(chosen) >= limit:
            break
        r, covered = found[i][0], int(cover[i].sum())
        if any(_same_paper(r, found[j][0]) for j in chosen):
            continue
        need = max(0.075 * total, 0.38 * covered) if chosen else max(0.1 * total, 0.12 * prior.visible)
        if (cover[i] & ~explained).sum() < need or covered < 0.16 * prior.visible:
            continue
        chosen.append(i)
        explained |= cover[i]
    return [
        _geometry(row, found[i][0], found[i][1], "occlusion-edges", mask.shape, complete=False, fill=float(found[i][2]), count=int(found[i][2] * found[i][0][2] * found[i][0][3] + 0.5)) for i in chosen
    ]


def _same_paper(a: np.ndarray, b: np.ndarray) -> bool:
    iou, held = quad_shares([tuple(p) for p in corners(a)[0]], [tuple(p) for p in corners(b)[0]])
    gap, side, turn = float(np.hypot(*(a[:2] - b[:2]))), min(a[2], a[3], b[2], b[3]), float(turn_gap(a[4], b[4])) / DEG
    return (held >= 0.68 and gap <= 0.44 * side and turn <= 12) or (iou >= 0.7 and turn <= 11) or (iou >= 0.58 and gap <= 0.14 * side and turn <= 7)


def _quad(g: dict) -> list[tuple[float, float]]:
    if g["corners"]:
        return [tuple(p) for p in g["corners"]]
    return [(g["min_x"], g["min_y"]), (g["max_x"], g["min_y"]), (g["max_x"], g["max_y"]), (g["min_x"], g["max_y"])]


def drop_twins(rows: list[dict], short: float) -> list[dict]:
    """Rows without those that lie on a better one."""
    kept: list[dict] = []
    for g in sorted(rows, key=lambda g: (-(g["overlap_score"] if g["overlap_score"] is not None else 0.76 if g["complete"] else 0.5), -g["count"])):
        q = np.array(_quad(g))
        turn = np.arctan2(*(q[1] - q[0])[::-1])
        twin = False
        for o in kept:
            p = np.array(_quad(o))
            near = np.hypot(*(q.mean(0) - p.mean(0))) <= 0.16 * short and turn_gap(turn, np.arctan2(*(p[1] - p[0])[::-1])) <= 10 * DEG
            twin |= bool(near) and quad_shares(_quad(g), _quad(o))[0] >= 0.78
        if not twin:
            kept.append(g)
    return kept


def recover(t: pd.DataFrame, labels: np.ndarray, edges: np.ndarray | None = None) -> list[dict]:
    """Papers of one photo from its accepted islands (component columns), top to bottom; at most MOST_NOTES."""
    if not len(t):
        return []
    t = t.copy()
    size = (t.max_x - t.min_x + 1) * (t.max_y - t.min_y + 1)
    if "fill" not in t:
        t["fill"] = np.nan
    t["fill"] = t.fill.fillna(t["count"] / size)
    if "complete" not in t:
        t["complete"] = None
    prior = size_prior(t, labels.shape)
    rim = touches_border(t, labels.shape)
    number = islands(labels)
    out = []
    for (_, row), border in zip(t.iterrows(), rim):
        w, h = row.max_x - row.min_x + 1, row.max_y - row.min_y + 1
        if min(w, h) < prior.short * (0.3 if border else 0.4) or row["count"] < prior.visible * (0.09 if border else 0.14):
            continue
        mask = _island(number, labels, row)
        single = max(w, h) <= 1.62 * prior.long and row["count"] <= 1.62 * prior.paper
        unknown = row.complete is None or pd.isna(row.complete)
        if single and (row.fill >= 0.58 if unknown else bool(row.complete)):
            made = fit_single(row, mask, prior, edges)
            if made is None and row.fill >= 0.72:
                made = {"cluster": int(row.cluster), "count": int(row["count"]), "fill": float(row.fill), "complete": True, "min_x": int(row.min_x), "max_x": int(row.max_x), "min_y": int(row.min_y), "max_y": int(row.max_y), "corners": None, "overlap_score": None, "evidence": "complete"}
            if made is not None:
                out.append(made)
                continue
        out += recover_hidden(row, mask, prior, edges)
    kept = drop_twins(out, prior.short)
    return sorted(kept, key=lambda g: (g["min_y"], g["min_x"]))[:MOST_NOTES]


def _island(number: np.ndarray, labels: np.ndarray, row) -> np.ndarray:
    """Mask of the island of the row's label whose size and box are nearest the row's."""
    inside = number[int(row.min_y) : int(row.max_y) + 1, int(row.min_x) : int(row.max_x) + 1]
    own = labels[int(row.min_y) : int(row.max_y) + 1, int(row.min_x) : int(row.max_x) + 1] == row.cluster
    ids, counts = np.unique(inside[own], return_counts=True)
    if not len(ids):
        return np.zeros(labels.shape, np.uint8)
    return (number == ids[np.abs(counts - row["count"]).argmin()]).astype(np.uint8)


GEOMETRY = "photo_id long, geom_id int, cluster int, count int, fill double, complete boolean, min_x int, max_x int, min_y int, max_y int, corners array<array<double>>, overlap_score double, evidence string"


def recover_photos(segmented: DataFrame, components: DataFrame) -> DataFrame:
    """Papers of every photo; components join their photo's label map as one list, so a photo is one row."""
    cols = ["cluster", "count", "min_x", "max_x", "min_y", "max_y", "fill", "complete"]
    lists = components.groupBy("photo_id").agg(F.collect_list(F.struct("component_id", *cols)).alias("rows"))
    j = segmented.select("photo_id", "width", "height", "labels", "edges").join(lists, "photo_id")

    def run(frames):
        for g in frames:
            out = []
            for p in g.itertuples():
                labels = np.frombuffer(p.labels, np.uint8).reshape(p.height, p.width)
                edges = np.frombuffer(p.edges, np.float32).reshape(p.height, p.width)
                t = pd.DataFrame(list(p.rows)).sort_values(["count", "component_id"], ascending=[False, True])
                out += [{"photo_id": p.photo_id, "geom_id": i} | m for i, m in enumerate(recover(t, labels, edges))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GEOMETRY.split(", ")])

    return j.mapInPandas(run, GEOMETRY)
