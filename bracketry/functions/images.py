"""Features of single images in NumPy: resizing, equalising, edges, wavelets, spots of light. Images are 2-D, values 0 to 255."""

from __future__ import annotations

import numpy as np

# fixed values: valid grey levels, mid-tones, the share of a tile in an anchor mask, the decomposition filter (db2, low pass)
VALID = (8, 247)
MID_TONES = (70, 185)
ANCHOR_SHARE = 0.06
DB2 = np.array([-0.12940952255092145, 0.22414386804185735, 0.836516303737469, 0.48296291314469025])


def _area_weights(n: int, side: int) -> np.ndarray:
    """(side, n): how much of each pixel lies in each of the ``side`` equal parts."""
    edge = np.linspace(0, n, side + 1)
    left, right = edge[:-1, None], edge[1:, None]
    at = np.arange(n)[None]
    w = np.clip(np.minimum(right, at + 1) - np.maximum(left, at), 0, None)
    return w / w.sum(axis=1, keepdims=True)


def area_resize(img: np.ndarray, side: int) -> np.ndarray:
    """Mean over the area of each new pixel; where the image is smaller, its nearest pixels."""
    img = np.asarray(img, float)
    return _area_weights(img.shape[0], side) @ img @ _area_weights(img.shape[1], side).T


def _linear_weights(n: int, side: int) -> np.ndarray:
    x = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    lo = np.minimum(x.astype(int), max(n - 2, 0))
    w = np.zeros((side, n))
    w[np.arange(side), lo] += 1 - (x - lo)
    w[np.arange(side), np.minimum(lo + 1, n - 1)] += x - lo
    return w


def linear_resize(img: np.ndarray, side: int) -> np.ndarray:
    img = np.asarray(img, float)
    return _linear_weights(img.shape[0], side) @ img @ _linear_weights(img.shape[1], side).T


def mirrored(img: np.ndarray, by: int) -> np.ndarray:
    """Padded by mirror images without the edge pixel; of more than two dimensions, the last two count."""
    return np.pad(img, [(0, 0)] * (img.ndim - 2) + [(by, by)] * 2, mode="reflect" if min(img.shape[-2:]) > by else "symmetric")


def equalised(img: np.ndarray, clip: float = 3.0, grid: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles with a limit on each bin, the tiles' curves blended between their centres."""
    img = np.clip(np.round(img), 0, 255).astype(int)
    h, w = img.shape
    ph, pw = -h % grid, -w % grid
    padded = np.pad(img, ((0, ph), (0, pw)), mode="symmetric" if ph >= h or pw >= w else "reflect")
    th, tw = padded.shape[0] // grid, padded.shape[1] // grid
    limit = max(1, int(clip * th * tw / 256))
    curves = np.empty((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            if rest := over % 256:
                n[: rest * max(256 // rest, 1) : max(256 // rest, 1)] += 1
            curves[i, j] = np.clip(np.round(np.cumsum(n) * 255 / (th * tw)), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = [np.clip(k, 0, grid - 1) for k in (y0, y0 + 1, x0, x0 + 1)]
    look = lambda i, j: curves[at[i][:, None], at[j][None], img]
    return np.round((look(0, 2) * (1 - fx) + look(0, 3) * fx) * (1 - fy) + (look(1, 2) * (1 - fx) + look(1, 3) * fx) * fy)


def gradients(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel differences by x and y."""
    p = mirrored(np.asarray(img, float), 1)
    smooth = lambda a, b, c: a + 2 * b + c
    gx = smooth(p[..., :-2, 2:] - p[..., :-2, :-2], p[..., 1:-1, 2:] - p[..., 1:-1, :-2], p[..., 2:, 2:] - p[..., 2:, :-2])
    gy = smooth(p[..., 2:, :-2] - p[..., :-2, :-2], p[..., 2:, 1:-1] - p[..., :-2, 1:-1], p[..., 2:, 2:] - p[..., :-2, 2:])
    return gx, gy


def magnitude(img: np.ndarray) -> np.ndarray:
    return np.hypot(*gradients(img))


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p = mirrored(np.asarray(img, float), r)
    rows = sum(c * p[..., j : j + np.shape(img)[-1]] for j, c in enumerate(k))
    return sum(c * rows[..., j : j + np.shape(img)[-2], :] for j, c in enumerate(k))


def unit(x: np.ndarray, small: float = 1e-9) -> np.ndarray:
    return x / (np.linalg.norm(x) + small)


def edge_descriptor(img: np.ndarray, side: int = 64) -> np.ndarray:
    """Edges of the equalised image on a grid of side x side, without their mean, of length 1 (0 stays 0)."""
    x = area_resize(magnitude(equalised(img)), side).ravel()
    x = x - x.mean()
    n = np.linalg.norm(x)
    return x / n if n else x


def edges_and_valid(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the equalised image, and which raw pixels are neither clipped."""
    img = np.asarray(img, float)
    return magnitude(equalised(img)), (img >= VALID[0]) & (img <= VALID[1])


def _split(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """One level of the db2 transform along an axis: every other place of the filtered signal, ends mirrored."""
    x = np.moveaxis(x, axis, -1)
    p = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(3, 3)], mode="symmetric")
    n = (x.shape[-1] + 3) // 2
    high = DB2[::-1] * np.array([-1, 1, -1, 1])
    out = [sum(f[j] * p[..., 4 - j : 4 - j + 2 * n : 2] for j in range(4)) for f in (DB2, high)]
    return tuple(np.moveaxis(o, -1, axis) for o in out)


def wavelet_features(img: np.ndarray, side: int = 128, level: int = 3, cell: int = 16) -> np.ndarray:
    """Sizes of the detail bands of a db2 transform of the equalised image, each on cell x cell, the coarsest first."""
    x, bands = equalised(linear_resize(img, side)), []
    for _ in range(level):
        low, high = _split(x, 0)
        (x, a), (b, c) = _split(low, 1), _split(high, 1)
        bands.append([b, a, c])
    return np.concatenate([linear_resize(np.abs(band), cell).ravel() for three in bands[::-1] for band in three])


def chroma(bgr: np.ndarray, least: int = 200, bins: int = 8) -> np.ndarray | None:
    """Shares of red and green of the mid-tone pixels as a histogram; None if there are too few."""
    px = np.asarray(bgr, float).reshape(-1, 3)
    mean = px.mean(axis=1)
    px = px[(mean > MID_TONES[0]) & (mean < MID_TONES[1])]
    if len(px) < least:
        return None
    share = px / (px.sum(axis=1, keepdims=True) + 1e-6)
    at = np.minimum((share * bins).astype(int), bins - 1)
    n = np.bincount(at[:, 2] * bins + at[:, 1], minlength=bins * bins).astype(float)
    return n / n.sum()


def normalised(img: np.ndarray, side: int) -> np.ndarray:
    """A grey tile of that side; colours are averaged."""
    img = np.asarray(img, float)
    return area_resize(img.mean(axis=2) if img.ndim == 3 else img, side)


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Places (flat) of each 8-connected region of a mask, by their first place."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        p = np.pad(label, 1, constant_values=h * w)
        new = np.min([p[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, new, h * w)
        new = np.where(mask, np.append(new.ravel(), h * w)[new], h * w)  # label of the label
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, axis=None, kind="stable")
    flat = label.ravel()[order]
    edges = np.flatnonzero(np.diff(flat)) + 1
    return [part for part in np.split(order, edges) if mask.ravel()[part[0]]]


def spots(weight: np.ndarray, mask: np.ndarray, least: float, most: float, top: int, apart: float) -> np.ndarray:
    """(y, x) from 0 to 1 of the weighted centres of regions of at least and at most so many pixels, by area times mean
    weight, the largest first; later ones within ``apart`` of an earlier one are left out."""
    h, w = mask.shape
    found = []
    for part in regions(mask):
        if least <= len(part) <= most:
            v = weight.ravel()[part] + 1e-9
            y, x = part // w, part % w
            found.append((-len(part) * v.mean(), part[0], (y @ v / v.sum()) / max(h - 1, 1), (x @ v / v.sum()) / max(w - 1, 1)))
    return thinned(np.array([(y, x) for *_, y, x in sorted(found)]).reshape(-1, 2), apart, top)


def thinned(points: np.ndarray, apart: float, top: int | None = None) -> np.ndarray:
    """In their order, those that are not within ``apart`` of one kept before."""
    kept: list[np.ndarray] = []
    for p in points:
        if top is not None and len(kept) == top:
            break
        if all(np.hypot(*(p - q)) >= apart for q in kept):
            kept.append(p)
    return np.array(kept).reshape(-1, 2)


def extreme_spots(img: np.ndarray, bright: bool | None = None) -> np.ndarray:
    """The brightest (or darkest) 2 % in regions of up to a tenth of the tile; which is told by the mean if not given."""
    img = np.asarray(img, float)
    bright = img.mean() < 128 if bright is None else bright
    mask = img >= np.percentile(img, 98) if bright else img <= np.percentile(img, 2)
    return spots(img if bright else 255 - img, mask, 3, 0.1 * img.size, 6, 0.04)


def scene_template(tiles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where well exposed tiles are brightest and darkest: blurred masks, averaged, the largest value 1."""
    out = []
    for pick in (lambda t: t >= np.percentile(t, 98), lambda t: t <= np.percentile(t, 2)):
        m = np.mean([blurred(pick(np.asarray(t, float)).astype(float), 2.5) for t in tiles], axis=0)
        out.append(m / m.max() if m.max() > 0 else m)
    return out[0], out[1]


def template_spots(map_: np.ndarray) -> np.ndarray:
    return spots(map_, (map_ >= 0.4 * map_.max()) & (map_ > 0), 1, map_.size, 6, 0.04)


def lights(img: np.ndarray, threshold: float) -> np.ndarray:
    """Saturated blobs of 2 to 400 pixels, eight at most."""
    img = np.asarray(img, float)
    return spots(img, img >= threshold, 2, 400, 8, 0.04)


def clip_lights(img: np.ndarray) -> np.ndarray:
    """Lights of a dark frame: from 55 % of its largest value on, 45 at least."""
    return lights(img, max(45.0, 0.55 * float(np.max(img))))


def well_lights(tiles: list[np.ndarray]) -> np.ndarray:
    """Lights (from 240 on) of the well exposed frames of a scene, the first ones count."""
    found = [lights(t, 240) for t in tiles]
    return thinned(np.concatenate(found) if found else np.empty((0, 2)), 0.04)


def anchor_masks(img: np.ndarray, side: int = 32, share: float = ANCHOR_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the darkest and brightest share of the tile on a grid of that side; ties by place."""
    x = area_resize(img, side).ravel() if np.shape(img) != (side, side) else np.asarray(img, float).ravel()
    k = max(1, round(len(x) * share))
    order = np.argsort(x, kind="stable")
    dark, bright = np.zeros(len(x), bool), np.zeros(len(x), bool)
    dark[order[:k]], bright[order[len(x) - k :]] = True, True
    return dark, bright


def drift_edges(img: np.ndarray) -> np.ndarray:
    """Of an image, or of each of a stack."""
    return magnitude(blurred(img, 1.0))


def embedded(features: np.ndarray, most: int = 128) -> np.ndarray:
    """Whitened principal components of rows of features but the first, rows of length 1. Components without spread are
    left out; one row alone is zeros."""
    x = np.asarray(features, float)
    x = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    k = int((s > 1e-10 * max(s.max(initial=0), 1e-300)).sum()) if len(x) > 1 else 0
    k = min(k, most, len(x))
    scores = x @ vt[:k].T / (s[:k] / np.sqrt(max(len(x) - 1, 1))) if k else np.zeros((len(x), 1))
    scores = scores[:, 1:] if scores.shape[1] > 1 else scores
    return scores / (np.linalg.norm(scores, axis=1, keepdims=True) + 1e-9)
