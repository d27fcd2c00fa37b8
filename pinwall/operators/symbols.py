"""Recognition of eight hand-drawn symbols in ink masks, and fusion of detections from several masks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pinwall.operators.segmentation import islands

GRID, REACH = 48, 2.35
MOST = 8
# Names of the symbols.
LABELS = {"↑": "arrow up", "↓": "arrow down", "←": "arrow left", "→": "arrow right", "♥": "heart", "!": "exclamation mark", "☺": "smiling face", "☹": "sad face"}
ARROWS = "↑↓←→"
#: Ink is darker than these in the images that are looked at.
INK = {"sauvola": 112, "ink": 168, "contrast": 146}


def clip(x: float, low: float, high: float) -> float:
    return float(min(high, max(low, x)))


class Blob:
    """Pixels (x, y) with their box; boxes of several blobs add up."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray):
        self.xs, self.ys, self.area = xs, ys, len(xs)
        self.x0, self.x1, self.y0, self.y1 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
        self.w, self.h = self.x1 - self.x0 + 1, self.y1 - self.y0 + 1
        self.cx, self.cy = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def __add__(self, other: "Blob") -> "Blob":
        return Blob(np.concatenate([self.xs, other.xs]), np.concatenate([self.ys, other.ys]))

    def holds(self, other: "Blob") -> bool:
        return self.x0 < other.cx < self.x1 and self.y0 < other.cy < self.y1


def x_gap(a: Blob, b: Blob) -> int:
    return max(0, b.x0 - a.x1 - 1, a.x0 - b.x1 - 1)


def y_share(a: Blob, b: Blob) -> float:
    return max(0, min(a.y1, b.y1) - max(a.y0, b.y0) + 1) / max(1, min(a.h, b.h))


def beside(a: Blob, b: Blob) -> bool:
    """Whether b looks like a neighbouring letter of a."""
    return 0.42 * a.h <= b.h <= 2.35 * a.h and y_share(a, b) >= 0.35 and x_gap(a, b) <= 0.38 * max(a.h, b.h)


@dataclass
class Group:
    members: tuple[int, ...]
    whole: Blob
    isolated: bool


def blobs(mask: np.ndarray) -> list[Blob]:
    """Connected ink without single pixels and the border."""
    m = np.pad(mask.astype(bool), 1)
    h, w = mask.shape
    near = sum(m[dy : dy + h, dx : dx + w].astype(int) for dy in range(3) for dx in range(3))
    clean = mask.astype(bool) & (near >= 2)
    clean[[0, -1]] = clean[:, [0, -1]] = False
    number = islands(clean.astype(np.uint8))
    ys, xs = np.nonzero(clean)
    if not len(xs):
        return []
    of = number[ys, xs]
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    least = max(7, h * w * 5.5e-5)
    return [Blob(xs[i], ys[i]) for i in np.split(order, cuts) if len(i) >= least]


def groups(parts: list[Blob], width: int, height: int) -> list[Group]:
    """Blobs and sets of blobs that may be one symbol."""
    side, area = min(width, height), width * height
    sets: dict[tuple[int, ...], None] = {}

    def add(*ids: int) -> None:
        sets.setdefault(tuple(sorted(ids)))

    useful = [i for i, p in enumerate(parts) if p.area >= max(7, int(np.floor(area * 5.5e-5 + 0.5)))]
    for i in useful:
        p = parts[i]
        if max(p.w, p.h) >= 0.085 * side and p.area >= 4.5e-4 * area:
            add(i)
        if min(p.w, p.h) >= 0.13 * side:
            held = [j for j in useful if j != i and p.holds(parts[j]) and parts[j].area <= 0.48 * p.area]
            if 3 <= len(held) <= 8:
                add(i, *held)
    for i in useful:
        stem = parts[i]
        if stem.h >= 2.05 * stem.w and stem.h >= 0.08 * height:
            for j in useful:
                dot = parts[j]
                below = j != i and dot.y0 > stem.y1 and dot.y0 - stem.y1 - 1 <= 0.5 * stem.h
                if below and abs(dot.cx - stem.cx) <= 0.72 * max(stem.w, dot.w) and dot.w <= 2.25 * stem.w and dot.h <= 2.5 * stem.w and dot.area <= 0.55 * stem.area:
                    add(i, j)
    for i, j in combinations(useful, 2):
        a, b = parts[i], parts[j]
        w, h = max(a.x1, b.x1) - min(a.x0, b.x0) + 1, max(a.y1, b.y1) - min(a.y0, b.y0) + 1
        if y_share(a, b) >= 0.58 and x_gap(a, b) <= 0.28 * h and 0.56 <= w / h <= 1.55 and min(a.area, b.area) >= 0.28 * max(a.area, b.area) and min(w, h) >= 0.075 * side:
            add(i, j)
    out = []
    for ids in sets:
        whole = parts[ids[0]]
        for i in ids[1:]:
            whole = whole + parts[i]
        out.append(Group(ids, whole, not any(beside(parts[i], parts[j]) for i in ids for j in useful if j not in ids)))
    return out


# ---------------------------------------------------------------- templates


def normal_form(b: Blob) -> np.ndarray:
    """The blob on a 48 x 48 grid, 38 cells long, thickened by one cell."""
    scale = 38 / max(b.w, b.h)
    x = np.floor((GRID - max(1, b.w * scale)) / 2 + (b.xs - b.x0) * scale + 0.5).astype(int)
    y = np.floor((GRID - max(1, b.h * scale)) / 2 + (b.ys - b.y0) * scale + 0.5).astype(int)
    out = np.zeros((GRID, GRID), bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            fine = (x + dx >= 0) & (x + dx < GRID) & (y + dy >= 0) & (y + dy < GRID)
            out[(y + dy)[fine], (x + dx)[fine]] = True
    return out


def distance_map(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (1 and sqrt 2) of each cell to the mask: steps of one row at a time until nothing gets shorter."""
    d = np.where(mask, 0.0, 1e6)
    while True:
        p = np.pad(d, 1, constant_values=1e6)
        best = d
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    best = np.minimum(best, p[dy : dy + GRID, dx : dx + GRID] + (1.0 if dy == 1 or dx == 1 else 2**0.5))
        if (best == d).all():
            return d
        d = best


def _pen(strokes: list[tuple[np.ndarray, np.ndarray]], width: float, size: int = 64) -> np.ndarray:
    ys, xs = np.mgrid[:size, :size]
    out = np.zeros((size, size), bool)
    for a, b in strokes:
        d = b - a
        t = np.clip(((xs - a[0]) * d[0] + (ys - a[1]) * d[1]) / max(1e-9, float(d @ d)), 0, 1)
        out |= (xs - a[0] - t * d[0]) ** 2 + (ys - a[1] - t * d[1]) ** 2 <= (width / 2) ** 2
    return out


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(symbol, mask, distances) of drawn arrows, hearts and exclamation marks."""
    drawn = []
    turns = {"→": lambda p: p, "←": lambda p: [64 - p[0], p[1]], "↓": lambda p: [p[1], p[0]], "↑": lambda p: [p[1], 64 - p[0]]}
    for symbol in ARROWS:
        for stroke in (3, 5, 7):
            for head in (15, 20):
                ends = [((10, 32), (53, 32)), ((53, 32), (53 - head, 32 - 0.72 * head)), ((53, 32), (53 - head, 32 + 0.72 * head))]
                drawn.append((symbol, _pen([tuple(np.array(turns[symbol](p), float) for p in e) for e in ends], stroke)))
    t = np.linspace(0, 2 * np.pi, 181)
    line = np.stack([32 + 22.08 * np.sin(t) ** 3, 29 - 1.35 * (13 * np.cos(t) - 5 * np.cos(2 * t) - 2 * np.cos(3 * t) - np.cos(4 * t))], 1)
    for stroke, filled in ((3, False), (5, False), (7, False), (3, True)):
        heart = _pen(list(zip(line, line[1:])), stroke)
        if filled:
            heart = np.maximum.accumulate(heart, 1) & np.maximum.accumulate(heart[:, ::-1], 1)[:, ::-1]
        drawn.append(("♥", heart))
    for stroke in (4, 6, 8):
        for dot in (0.55, 0.8):
            mark = _pen([(np.array([32.0, 8]), np.array([32.0, 43]))], stroke) | _pen([(np.array([32.0, 55]), np.array([32.0, 55]))], 2 * stroke * dot)
            drawn.append(("!", mark))
    out = []
    for symbol, m in drawn:
        ys, xs = np.nonzero(m)
        grid = normal_form(Blob(xs, ys))
        out.append((symbol, grid, distance_map(grid)))
    return out


def likeness(mask: np.ndarray, dist: np.ndarray, template: np.ndarray, template_dist: np.ndarray) -> float:
    """Symmetric nearness and coverage of two masks, less a penalty for different amounts of ink."""
    n, m = int(mask.sum()), int(template.sum())
    if not n or not m:
        return 0.0
    off, back = template_dist[mask], dist[template]
    cover = float(np.sqrt((off <= REACH).mean() * (back <= REACH).mean()))
    return clip((1 - (off.mean() + back.mean()) / 2 / 7.8) * 0.58 + 0.42 * cover - min(0.22, 0.09 * abs(np.log(n / m))), 0, 1)


# ---------------------------------------------------------------- shapes


def face(g: Group, parts: list[Blob]) -> tuple[str, float] | None:
    if not 4 <= len(g.members) <= 9:
        return None
    members = [parts[i] for i in g.members]
    outer = max(members, key=lambda p: p.w * p.h)
    if not 0.68 <= outer.w / outer.h <= 1.42:
        return None
    inner = [p for p in members if p is not outer and outer.holds(p)]
    small = sorted((p for p in inner if p.cy < outer.y0 + 0.58 * outer.h and p.w <= 0.3 * outer.w and p.h <= 0.3 * outer.h), key=lambda p: p.cx)
    eyes, best = None, -1.0
    for a, b in combinations(small, 2):
        apart, level = (b.cx - a.cx) / outer.w, abs(a.cy - b.cy) / outer.h
        merit = apart - 1.5 * level + 0.25 * min(a.area, b.area) / max(a.area, b.area)
        if 0.18 <= apart <= 0.7 and level <= 0.16 and merit > best:
            eyes, best = (a, b), merit
    if eyes is None:
        return None
    mouth = max((p for p in inner if p not in eyes and p.cy > outer.y0 + 0.48 * outer.h and p.w >= 0.2 * outer.w), key=lambda p: p.area, default=None)
    if mouth is None or mouth.cy <= (eyes[0].cy + eyes[1].cy) / 2 + 0.13 * outer.h:
        return None
    # how far the middle of the mouth lies below its ends, with the eyes level
    a = np.arctan2(eyes[1].cy - eyes[0].cy, eyes[1].cx - eyes[0].cx)
    x, y = mouth.xs * np.cos(a) + mouth.ys * np.sin(a), mouth.ys * np.cos(a) - mouth.xs * np.sin(a)
    t = (x - x.min()) / max(1, x.max() - x.min())
    left, mid, right = y[t < 0.3], y[(t >= 0.3) & (t <= 0.7)], y[t > 0.7]
    if not (len(left) and len(mid) and len(right)):
        return None
    curve = float(mid.mean() - (left.mean() + right.mean()) / 2)
    if abs(curve) < max(1.1, 0.026 * outer.h):
        return None
    sure = clip(0.74 + 0.12 * best + (0.04 if g.isolated else 0), 0.74, 0.93)
    return "☺" if curve > 0 else "☹", clip(sure + min(0.06, 0.7 * abs(curve) / outer.h), 0, 0.96)


def exclamation(g: Group, parts: list[Blob]) -> tuple[str, float] | None:
    if len(g.members) != 2 or not g.isolated:
        return None
    stem, dot = sorted((parts[i] for i in g.members), key=lambda p: p.y0)
    off = abs(stem.cx - dot.cx) / max(stem.w, dot.w)
    if stem.h < 2.05 * stem.w or dot.y0 <= stem.y1 or off > 0.75 or dot.w > 2.3 * stem.w or dot.h > 2.55 * stem.w or dot.y0 - stem.y1 - 1 > 0.52 * stem.h:
        return None
    return "!", clip(0.80 + 0.1 * clip((stem.h / stem.w - 2) / 4, 0, 1) + 0.07 * clip(1 - off, 0, 1), 0, 0.97)


def heart_shape(g: Group) -> float:
    """0, or 0.55 and more for a notch above, a tip below and an inside."""
    b = g.whole
    middle = (b.x0 + b.x1) / 2
    top = lambda pick: int(b.ys[pick].min()) if pick.any() else b.y1
    left, right = top(b.xs < middle - 0.08 * b.w), top(b.xs > middle + 0.08 * b.w)
    notch = (top(np.abs(b.xs - middle) <= 0.1 * b.w) - (left + right) / 2) / b.h
    low = b.ys >= b.y0 + 0.78 * b.h
    if not low.any():
        return 0.0
    tip = (b.xs[low].max() - b.xs[low].min() + 1) / b.w
    off = abs(b.xs[low].mean() - middle) / b.w
    m = np.zeros((b.h + 4, b.w + 4), bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            m[b.ys - b.y0 + 2 + dy, b.xs - b.x0 + 2 + dx] = True
    # the outside reaches round the shape, but not across corners
    number = islands(m.astype(np.uint8), diagonal=False)
    outside = number == number[0, 0]
    held = int((~m & ~outside).sum())
    split = len(g.members) == 2 and notch >= 0.09 and tip <= 0.38 and off <= 0.13
    if notch < 0.065 or tip > 0.52 or off > 0.16 or not (held >= 0.025 * b.w * b.h or b.area >= 0.46 * b.w * b.h or split):
        return 0.0
    return clip(0.55 + 1.8 * notch + 0.35 * (0.52 - tip) - off + min(0.08, held / (b.w * b.h)), 0, 1)


def arrow_shape(b: Blob, symbol: str) -> float:
    """0, or 0.62 and more for a narrow tip, a wide head and a narrow tail."""
    flat = symbol in "←→"
    length, breadth = (b.w, b.h) if flat else (b.h, b.w)
    depth = {"→": b.x1 - b.xs, "←": b.xs - b.x0, "↑": b.ys - b.y0, "↓": b.y1 - b.ys}[symbol] / max(1, length - 1)
    across = b.ys if flat else b.xs
    spans = []
    for pick in (depth <= 0.12, (depth > 0.12) & (depth <= 0.43), depth >= 0.54):
        if not pick.any():
            return 0.0
        spans.append(float(np.ptp(across[pick])) + 1)
    tip, head, tail = spans
    if head < 1.2 * tip or head < 1.45 * tail or head < 0.48 * breadth:
        return 0.0
    return clip(0.62 + 0.2 * clip((head / tip - 1.2) / 1.8, 0, 1) + 0.18 * clip((head / tail - 1.45) / 2.2, 0, 1), 0, 1)


def drawn_symbol(g: Group, width: int, height: int) -> tuple[str, float] | None:
    """The template class that fits clearly best, where its shape gate is passed."""
    b = g.whole
    ratio = b.w / b.h
    boost = {}
    for s in ARROWS:
        if (ratio >= 1.08 if s in "←→" else ratio <= 0.93) and (k := arrow_shape(b, s)):
            boost[s] = 0.08 * (k - 0.62)
    if 0.56 <= ratio <= 1.55 and min(b.w, b.h) >= 0.08 * min(width, height) and (k := heart_shape(g)):
        boost["♥"] = 0.12 * (k - 0.55)
    if ratio <= 0.72 and len(g.members) == 2:
        boost["!"] = 0.0
    if not boost:
        return None
    mask = normal_form(b)
    dist = distance_map(mask)
    scores: dict[str, float] = {}
    for s, m, d in templates():
        if s in boost:
            scores[s] = max(scores.get(s, 0.0), likeness(mask, dist, m, d) + boost[s])
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    symbol, score = ranked[0]
    rival = ranked[1][1] if len(ranked) > 1 else 0.0
    need = {"♥": 0.69, "!": 0.76}.get(symbol, 0.70)
    if score < need or score - rival < (0.035 if symbol == "!" else 0.055) or symbol != "!" and not g.isolated:
        return None
    return symbol, clip(0.62 + 1.25 * (score - need) + min(0.12, score - rival), 0.7, 0.96)


def _iou(a: dict, b: dict) -> float:
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    both = max(0.0, w) * max(0.0, h)
    return both / max(1e-6, a["width"] * a["height"] + b["width"] * b["height"] - both)


def reading(rows: list[dict]) -> list[dict]:
    """Top to bottom, and left to right where tops differ by 8 percent of the note at most."""
    from functools import cmp_to_key

    return sorted(rows, key=cmp_to_key(lambda a, b: a["x"] - b["x"] if abs(a["y"] - b["y"]) <= 0.08 else a["y"] - b["y"]))[:MOST]


def recognize(mask: np.ndarray) -> list[dict]:
    """Up to eight symbols of an ink mask, in reading order, with boxes in shares of its size."""
    height, width = mask.shape
    if width < 20 or height < 20:
        return []
    parts = blobs(mask)
    ink = sum(p.area for p in parts)
    found = []
    for g in groups(parts, width, height):
        b = g.whole
        if max(b.w, b.h) < 0.085 * min(width, height):
            continue
        options = [o for o in (face(g, parts), exclamation(g, parts), drawn_symbol(g, width, height)) if o]
        if options:
            symbol, sure = max(options, key=lambda o: o[1])
            found.append({"symbol": symbol, "label": LABELS[symbol], "sure": sure, "dominant_ink": clip(b.area / max(1, ink), 0, 1), "x": b.x0 / width, "y": b.y0 / height, "width": b.w / width, "height": b.h / height})
    kept: list[dict] = []
    for s in sorted(found, key=lambda s: -s["sure"]):
        if all(_iou(s, k) < 0.42 for k in kept):
            kept.append(s)
    return [{k: v for k, v in s.items() if k != "sure"} | {"confidence": int(100 * s["sure"] + 0.5)} for s in reading(kept)]


def fuse_pair(first: list[dict], second: list[dict]) -> list[dict]:
    """Symbols that two masks show at one place, each used once; the surer for the agreement."""
    free, out = list(range(len(second))), []
    for a in first:
        fits = []
        for i in free:
            b = second[i]
            share = _iou(a, b)
            gap = np.hypot(a["x"] + a["width"] / 2 - b["x"] - b["width"] / 2, a["y"] + a["height"] / 2 - b["y"] - b["height"] / 2)
            if a["symbol"] == b["symbol"] and (share >= 0.34 or gap <= 0.075):
                fits.append((share, -i))
        if not fits:
            continue
        share, i = max(fits)
        b = second[-i]
        free.remove(-i)
        low, high = sorted((a["confidence"], b["confidence"]))
        sure = int(clip(0.4 * low + 0.25 * high + 20 * share + 15, 0, 97) + 0.5)
        if sure >= 82:
            mean = {k: (a[k] + b[k]) / 2 for k in ("x", "y", "width", "height")}
            out.append(a | mean | {"confidence": sure, "dominant_ink": min(1.0 if s.get("dominant_ink") is None else s["dominant_ink"] for s in (a, b))})
    return reading(out)


def fuse_sets(sets: list[list[dict]]) -> list[dict]:
    """Symbols that two of the masks agree on, and a lone, very sure and dominant heart that none contradicts."""
    if len(sets) < 2:
        return sets[0] if sets else []
    found = [s for a, b in combinations(sets, 2) for s in fuse_pair(a, b)]
    for i, own in enumerate(sets):
        for s in own:
            if s["symbol"] == "♥" and s["confidence"] >= 92 and (s.get("dominant_ink") or 0) >= 0.78:
                if not any(_iou(s, p) >= 0.24 for j, other in enumerate(sets) if j != i for p in other):
                    found.append(s | {"confidence": min(89, s["confidence"] - 3)})
    kept: list[dict] = []
    for s in sorted(found, key=lambda s: -s["confidence"]):
        if all(k["symbol"] != s["symbol"] or _iou(s, k) < 0.38 for k in kept):
            kept.append(s)
    return reading(kept)


def ink_mask(image: np.ndarray, threshold: int) -> np.ndarray:
    """Dark pixels of a grey image off its margins."""
    h, w = image.shape
    mx, my = int(np.floor(w * 0.035 + 0.5)), int(np.floor(h * 0.04 + 0.5))
    out = np.zeros((h, w), np.uint8)
    out[my : h - my, mx : w - mx] = image[my : h - my, mx : w - mx] < threshold
    return out


SCHEMA = "photo_id long, note_id long, ord int, symbol string, label string, confidence int, dominant_ink double, x double, y double, width double, height double"


def recognize_crops(crops: DataFrame) -> DataFrame:
    """Symbols of each note from its sauvola, ink and contrast images (rows of crops.prepare_crops)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        images = {r.variant: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in g.itertuples()}
        found = fuse_sets([recognize(ink_mask(images[v], t)) for v, t in INK.items() if v in images])
        return pd.DataFrame([{"photo_id": key[0], "note_id": key[1], "ord": i} | s for i, s in enumerate(found)], columns=names)

    return crops.where("channels = 1").groupBy("photo_id", "note_id").applyInPandas(run, SCHEMA)
