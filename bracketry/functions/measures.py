"""Measures between two images in NumPy. None stands for undecided."""

from __future__ import annotations

import numpy as np

from bracketry.functions.images import blurred, regions


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two masks; 0 if both are empty."""
    either = np.logical_or(a, b).sum()
    return float(np.logical_and(a, b).sum() / either) if either else 0.0


def anchor_match(a: tuple, b: tuple, mean_a: float, mean_b: float, dark: float = 30, white: float = 225) -> float:
    """Of two frames' (dark, bright) masks the better overlap that their exposure lets count: bright places if one is near
    black, dark ones if one is near white; otherwise the mean of both."""
    d, b_ = overlap(a[0], b[0]), overlap(a[1], b[1])
    found = ([b_] if min(mean_a, mean_b) < dark else []) + ([d] if max(mean_a, mean_b) > white else [])
    return max(found) if found else (d + b_) / 2


def anchor_agreement(a: tuple, b: tuple, mean_a: float, mean_b: float, dark: float = 110, white: float = 146) -> float:
    """Like anchor_match, but the worse overlap of those that count, and both where no exposure tells."""
    d, b_ = overlap(a[0], b[0]), overlap(a[1], b[1])
    found = ([b_] if min(mean_a, mean_b) <= dark else []) + ([d] if max(mean_a, mean_b) >= white else [])
    return min(found) if found else min(d, b_)


def matched_points(a: np.ndarray, b: np.ndarray, near: float) -> int:
    """Pairs of points within ``near``, the nearest first, each point once."""
    if not len(a) or not len(b):
        return 0
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    i, j = np.nonzero(d <= near)
    used_a, used_b, n = set(), set(), 0
    for _, p, q in sorted(zip(d[i, j].tolist(), i.tolist(), j.tolist(), strict=True)):
        if p not in used_a and q not in used_b:
            used_a.add(p)
            used_b.add(q)
            n += 1
    return n


def shifted_match(a: np.ndarray, b: np.ndarray, most: float, near: float) -> int:
    """The most matched points after any shift that lays a point of one on a point of the other, up to ``most`` long, or none."""
    shifts = [np.zeros(2), *(q - p for p in a for q in b if np.hypot(*(q - p)) <= most)]
    return max(matched_points(a + s, b, near) for s in shifts)


def light_match(a: np.ndarray, b: np.ndarray) -> float | None:
    """Share of the fewer lights that match; None with less than two on a side."""
    if min(len(a), len(b)) < 2:
        return None
    return shifted_match(a, b, 0.10, 0.06) / min(len(a), len(b))


def coverage(spots: np.ndarray, template: np.ndarray, most: float = 0.08, near: float = 0.045) -> float:
    """Share of the spots that a template has; 0 without any."""
    return shifted_match(spots, template, most, near) / len(spots) if len(spots) and len(template) else 0.0


def light_coverage(clipped: np.ndarray, well: np.ndarray) -> tuple[float | None, int, int]:
    """Share of a clipped frame's lights that the scene has, and both numbers of lights."""
    got = shifted_match(clipped, well, 0.08, 0.05) / len(clipped) if len(clipped) and len(well) else None
    return got, len(clipped), len(well)


def lights_present(well: np.ndarray, dark: np.ndarray) -> float:
    """Share of a scene's lights that a dark frame shows."""
    return shifted_match(well, dark, 0.10, 0.06) / len(well) if len(well) and len(dark) else 0.0


def chamfer(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean distance of each point to the nearest of the other side, both ways."""
    if not len(a) or not len(b):
        return None
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    return float((d.min(axis=1).mean() + d.min(axis=0).mean()) / 2)


def chi_square(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    return None if a is None or b is None else float(0.5 * ((a - b) ** 2 / (a + b + 1e-9)).sum())


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    return float((x * y).sum() / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9))


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dy, dx) by which b lies further than a, by the phase of their spectra; the peak's place is a weighted mean."""
    f = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    r = np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    h, w = r.shape
    py, px = np.unravel_index(int(np.argmax(r)), r.shape)
    y, x = np.arange(py - 2, py + 3), np.arange(px - 2, px + 3)
    part = np.maximum(r[np.ix_(y % h, x % w)], 0)
    dy, dx = (part.sum(axis=1) @ y) / max(part.sum(), 1e-12), (part.sum(axis=0) @ x) / max(part.sum(), 1e-12)
    return (dy - h if dy > h / 2 else dy), (dx - w if dx > w / 2 else dx)


def drift_correlation(a: np.ndarray, b: np.ndarray, most: float = 64) -> tuple[float, float]:
    """Correlation of two edge maps after the drift between them is taken out, and its length; 0 beyond ``most``."""
    dy, dx = shift_between(a, b)
    size = float(np.hypot(dy, dx))
    if size > most:
        return 0.0, size
    dy, dx = int(round(dy)), int(round(dx))
    h, w = a.shape
    ya, xa = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
    yb, xb = slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx))
    if a[ya, xa].size < 2:
        return 0.0, size
    return correlation(a[ya, xa], b[yb, xb]), size


def windows(maps: np.ndarray, shift: float, other: bool = False) -> list[np.ndarray]:
    """For all whole shifts that a drift of up to ``shift`` may be rounded to, what of maps (n, h, w) is left (``other``: of
    those that they are shifted to), less its mean and at length 1, in single precision."""
    h, w = maps.shape[1:]
    out = []
    for sy in range(-(h - h // 2), h - h // 2 + 1):
        for sx in range(-(w - w // 2), w - w // 2 + 1):
            if np.hypot(max(abs(sy) - 0.5, 0), max(abs(sx) - 0.5, 0)) > shift or (h - abs(sy)) * (w - abs(sx)) < 2:
                continue
            y, x = (sy, sx) if other else (-sy, -sx)
            t = maps[:, max(0, y) : h - max(0, -y), max(0, x) : w - max(0, -x)].reshape(len(maps), -1)
            t = t - t.mean(axis=1, keepdims=True)
            out.append((t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)).astype(np.float32))
    return out


def any_window(p: list[np.ndarray], q: list[np.ndarray], least: float | np.ndarray, rows: int = 256, columns: int = 512) -> np.ndarray:
    """Whether maps of windows p and of (other) windows q may have a drift_correlation of ``least`` (or of a least for each of
    p), with room for single precision. So many are compared at once that what is made of them stays in a core's cache."""
    n, m = len(p[0]), len(q[0])
    out = np.zeros((n, m), bool)
    level = np.broadcast_to(np.asarray(least - 1e-3, np.float32).reshape(-1, 1), (n, 1))
    for i in range(0, n, rows):
        for j in range(0, m, columns):
            part = out[i : i + rows, j : j + columns]
            z, over = np.empty(part.shape, np.float32), np.empty(part.shape, bool)
            for s, t in zip(p, q, strict=True):
                np.matmul(s[i : i + rows], t[j : j + columns].T, out=z)
                np.greater_equal(z, level[i : i + rows], out=over)
                part |= over
    return out


def may_drift(a: np.ndarray, b: np.ndarray, least: float, shift: float) -> np.ndarray:
    """Whether maps of a and b (n, h, w) may have a drift_correlation of ``least``: by all whole shifts a drift of up to
    ``shift`` may be rounded to, with room for single precision."""
    return any_window(windows(a, shift), windows(b, shift, True), least)


def drift_correlations(a: np.ndarray, b: np.ndarray, most: float = 64, fb: np.ndarray | None = None, fa: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """drift_correlation of one edge map with each of b (n, h, w), or of each of a (n, h, w) with the same one of b; those of
    one whole shift are compared at once. ``fa``, ``fb``: fft2 of a and b, if they are known."""
    n, h, w = b.shape
    f = (np.fft.fft2(b) if fb is None else fb) * np.conj(np.fft.fft2(a) if fa is None else fa)
    r = np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    top = r.reshape(n, h * w).argmax(axis=1)
    y, x = (top // w)[:, None] + np.arange(-2, 3), (top % w)[:, None] + np.arange(-2, 3)
    part = np.maximum(r[np.arange(n)[:, None, None], y[:, :, None] % h, x[:, None] % w], 0)
    total = np.maximum(part.sum(axis=(1, 2)), 1e-12)
    dy, dx = (part.sum(axis=2) * y).sum(axis=1) / total, (part.sum(axis=1) * x).sum(axis=1) / total
    dy, dx = np.where(dy > h / 2, dy - h, dy), np.where(dx > w / 2, dx - w, dx)
    size, z = np.hypot(dy, dx), np.zeros(n)
    whole = np.stack([np.round(dy), np.round(dx)], axis=1).astype(int)
    near = size <= most
    for sy, sx in np.unique(whole[near], axis=0):
        at = np.flatnonzero(near & (whole == (sy, sx)).all(axis=1))
        p = (a[at] if a.ndim > 2 else a[None])[:, max(0, -sy) : h - max(0, sy), max(0, -sx) : w - max(0, sx)]
        q = b[at, max(0, sy) : h - max(0, -sy), max(0, sx) : w - max(0, -sx)]
        if q[0].size >= 2:
            p, q = (t.reshape(len(t), -1) for t in (p, q))
            p, q = (t - t.mean(axis=1, keepdims=True) for t in (p, q))
            z[at] = (q * p).sum(axis=1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1) + 1e-9)
    return z, size


def change(a: np.ndarray, b: np.ndarray, valid: np.ndarray, least: int = 12_000) -> tuple[float, int] | None:
    """Peak of the blurred difference of two equalised images where both are valid, and how many pixels differ by over 40."""
    if valid.sum() < least:
        return None
    d = np.where(valid, blurred(np.abs(a - b), 3.0), 0)
    return float(d.max()), int((d > 40).sum())


def opened(mask: np.ndarray, size: int = 5) -> np.ndarray:
    """Without what is smaller than a disc of that size."""
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    disc = np.argwhere(y * y + x * x <= r * r + 0.25 * size)
    h, w = mask.shape
    p = np.pad(mask, r)
    thin = np.all([p[i : i + h, j : j + w] for i, j in disc], axis=0)
    p = np.pad(thin, r)
    return np.any([p[i : i + h, j : j + w] for i, j in disc], axis=0)


def moved_object(a: np.ndarray, b: np.ndarray, valid: np.ndarray, over: float = 60, outside: int = 500) -> dict:
    """area, fill (of its bounding box), mindim and loc (difference inside against outside) of the largest changed region."""
    d = np.abs(a - b)
    parts = regions(opened((d > over) & valid))
    if not parts:
        return {"area": 0, "fill": 0.0, "mindim": 0, "loc": 0.0}
    best = max(parts, key=lambda p: (len(p), -p[0]))
    y, x = best // d.shape[1], best % d.shape[1]
    h, w = int(np.ptp(y)) + 1, int(np.ptp(x)) + 1
    rest = valid.copy()
    rest.ravel()[best] = False
    base = float(np.median(d[rest])) if rest.sum() > outside else 0.0
    return {"area": len(best), "fill": len(best) / (h * w), "mindim": min(h, w), "loc": float(d.ravel()[best].mean() / (base + 1))}


def equal_pairs(label_a: np.ndarray, label_b: np.ndarray) -> bool:
    """Whether two labellings part the same rows alike."""
    pairs = set(zip(label_a.tolist(), label_b.tolist(), strict=True))
    return len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def wins(pos: np.ndarray, neg: np.ndarray) -> float:
    """Share of (positive, negative) pairs in the right order, ties half: by ranks, not by pairs."""
    x = np.concatenate([pos, neg])
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return float((rank[: len(pos)].sum() - len(pos) * (len(pos) + 1) / 2) / (len(pos) * len(neg)))


def best_cut(pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """The threshold of the best balanced accuracy, and that accuracy; ties go to the smallest threshold."""
    return max(((float(t), float(((pos >= t).mean() + (neg < t).mean()) / 2)) for t in np.unique(np.concatenate([pos, neg]))), key=lambda r: (r[1], -r[0]))
