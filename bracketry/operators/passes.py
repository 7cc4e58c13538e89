"""Passes that refine a grouping. Each takes labels (frame_id, label) and frames (frame_id, filename, brightness, tile) and
returns labels; a label is the least frame_id of its group. Splits look at one group at a time. Passes across groups
compare a query set (orphans, or one frame a group) with all groups in blocks, and join groups by components."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bracketry.functions import images, measures
from bracketry.operators.features import pixel_embeddings, wavelet_embeddings
from bracketry.operators.graph import connected_components, stored
from bracketry.operators.pairs import linked, packed, paired_scores, unpack
from bracketry.operators.ranking import numbered

_LABELS = "frame_id long, label long"
#: Side of tiles up to which products at all shifts are cheaper than a transform for each pair.
SMALL_SIDE = 8
#: Frames that correlate by this or more as they are need no drift taken out.
UNLIKE = 0.55


@dataclass(frozen=True)
class Params:
    """Pixels are shares of a tile of 256 x 256; ``least`` is the fewest of them, for small tiles. ``edges``: compare edges
    of equalised images rather than the tiles themselves."""

    edges: bool = True
    least: int = 2
    score_pixels: float = 200 / 65536
    link_pixels: float = 1500 / 65536
    trust_pixels: float = 3000 / 65536
    strong_pixels: float = 15_000 / 65536
    motion_pixels: float = 8000 / 65536
    change_pixels: float = 12_000 / 65536
    loose_pixels: float = 400 / 65536
    block: int = 2000

    def pixels(self, share: float, size: int) -> float:
        return max(self.least, share * size)


def number_key(name: str) -> tuple[str, int]:
    """(what is before the trailing number, the number), without extension and g<id>_ tag; (name, -1) without a number."""
    found = re.fullmatch(r"(?:g\d+_)?(.*?)(\d+)", re.sub(r"\.[^.]*$", "", name), re.S)
    return (found[1], int(found[2])) if found else (name, -1)


class Group:
    """Some frames with their pairwise correlations."""

    def __init__(self, ids, names, brightness, tiles, p: Params):
        order = np.argsort(ids, kind="stable")
        self.ids, self.names, self.b = np.asarray(ids)[order], [names[k] for k in order], np.asarray(brightness, float)[order]
        self.p = p
        x = np.stack([np.asarray(tiles[k], float) for k in order]) if len(order) else np.empty((0, 0))
        self.size = x.shape[1]
        self.side = int(round(self.size**0.5))
        self.tiles = x.reshape(len(x), self.side, self.side) if len(order) else x
        self._z: tuple | None = None
        self._even: dict[int, np.ndarray] = {}

    def compared(self) -> tuple[np.ndarray, np.ndarray]:
        """Features and valid pixels, a row for each frame."""
        valid = (self.tiles >= images.VALID[0]) & (self.tiles <= images.VALID[1])
        x = np.stack([images.edges_and_valid(t)[0] for t in self.tiles]) if self.p.edges and len(self.tiles) else self.tiles
        return x.reshape(len(x), -1), valid.reshape(len(x), -1)

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        if self._z is None:
            x, v = self.compared()
            self._z = correlations(x, v, x, v, self.p.pixels(self.p.score_pixels, self.size))
        return self._z

    def even(self, k: int) -> np.ndarray:
        if k not in self._even:
            self._even[k] = images.equalised(self.tiles[k], 2.0)
        return self._even[k]

    def order(self) -> list[int]:
        return sorted(range(len(self.ids)), key=lambda k: (*number_key(self.names[k]), self.ids[k]))

    def rep(self, members, lo: float, hi: float) -> int:
        """The frame nearest to mid exposure, of those within bounds if there are any; ties go to the first."""
        well = [k for k in members if lo <= self.b[k] <= hi]
        return min(well or members, key=lambda k: (abs(self.b[k] - 128), k))


def correlations(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Correlation over pixels valid in both and their number, of each row of x with each of y; -1 under ``least`` pixels.
    Of more than two dimensions, the last two count."""
    vx, vy = vx.astype(float), vy.astype(float)
    ax, ay = x * vx, y * vy
    turned = lambda t: np.swapaxes(t, -1, -2)
    n = vx @ turned(vy)
    m = np.maximum(n, 1)
    sx, sy = ax @ turned(vy), vx @ turned(ay)
    var = lambda s, q: np.sqrt(np.maximum(q - s * s / m, 0))
    z = (ax @ turned(ay) - sx * sy / m) / (var(sx, (ax * x) @ turned(vy)) * var(sy, vx @ turned(ay * y)) + 1e-9)
    return np.where(n < least, -1.0, z), n.astype(np.int64)


def pieces(link: np.ndarray) -> np.ndarray:
    """Connected components of a symmetric boolean matrix, numbered by their first member."""
    label = np.arange(len(link))
    both = link | np.eye(len(link), dtype=bool)
    while len(link):
        new = np.where(both, label[None], len(link)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1] if len(link) else label


# --- splits: each gives the piece of each member; all that is not told apart is piece 0 -------------------------------


def high_resolution(g: Group) -> np.ndarray:
    """Lone well exposed frames leave; tight sub-scenes part; or else well exposed frames found sub-scenes that hold
    together by .15 more than they link, and all others go to the best of them."""
    n, out = len(g.ids), np.zeros(len(g.ids), int)
    if n < 3:
        return out
    z = g.scores()[0].copy()
    np.fill_diagonal(z, -1)
    comp = pieces(z >= 0.38)
    size = np.bincount(comp)
    new = 0
    for k in range(n):
        if size[comp[k]] == 1 and 55 <= g.b[k] <= 200 and z[k].max() < 0.32:
            new += 1
            out[k] = new
    many = [c for c in range(len(size)) if size[c] >= 2]
    inner = lambda members: min(z[a, b] for a in members for b in members if a != b)
    if len(many) >= 2 and all(inner(np.flatnonzero(comp == c)) >= 0.55 for c in many):
        largest = max(many, key=lambda c: (size[c], -c))
        for c in many:
            if c != largest:
                new += 1
                out[comp == c] = new
    if new:
        return out
    well = np.flatnonzero((g.b >= 55) & (g.b <= 200))
    if len(well) < 4:
        return out
    sub = pieces(z[np.ix_(well, well)] >= 0.50)
    many = [well[sub == c] for c in range(sub.max() + 1) if (sub == c).sum() >= 2]
    if len(many) < 2:
        return out
    for a in many:
        across = max(z[np.ix_(a, b)].max() for b in many if b is not a)
        if inner(a) < across + 0.15:
            return out
    reps = [g.rep(list(m), 0, 255) for m in many]
    for k in range(n):
        out[k] = next((c for c, m in enumerate(many) if k in m), int(np.argmax(z[k, reps])))
    return out


def runs_of(g: Group, gap: int = 5) -> list[list[int]]:
    """Frames in capture order, cut where the prefix changes or the number jumps by more than the gap."""
    out: list[list[int]] = []
    last = None
    for k in g.order():
        key = number_key(g.names[k])
        if last is None or key[0] != last[0] or key[1] - last[1] > gap:
            out.append([])
        out[-1].append(k)
        last = key
    return out


def _different(g: Group, frames: list[int], below: float = 0.35) -> np.ndarray:
    z, n = (s[np.ix_(frames, frames)] for s in g.scores())
    return (n >= g.p.pixels(g.p.trust_pixels, g.size)) & (z < below)


def capture_runs(g: Group) -> np.ndarray:
    """Scenes are components of well exposed frames that are not confidently different; runs go to the scene of most of
    their frames (the first of equals). With one scene only, runs part whose middle frames are confidently different."""
    out = np.zeros(len(g.ids), int)
    well = [k for k in range(len(g.ids)) if 50 <= g.b[k] <= 205]
    runs = runs_of(g)
    if len(well) >= 2:
        comp = pieces(~_different(g, well))
        if comp.max() > 0:
            scene = dict(zip(well, comp.tolist(), strict=True))
            reps = [g.rep([k for k in well if scene[k] == c], 0, 255) for c in range(comp.max() + 1)]
            chosen = []
            for run in runs:
                own = [scene[k] for k in run if k in scene]
                chosen.append(max(sorted(set(own)), key=own.count) if own else int(np.argmax(g.scores()[0][g.rep(run, 50, 205), reps])))
            if len(set(chosen)) >= 2:
                number = {c: k for k, c in enumerate(dict.fromkeys(chosen))}
                for run, c in zip(runs, chosen, strict=True):
                    out[run] = number[c]
                return out
    if len(runs) >= 2:
        for run, c in zip(runs, pieces(~_different(g, [g.rep(r, 50, 205) for r in runs])), strict=True):
            out[run] = c
    return out


def brackets_of(g: Group, members: list[int], level: float = 12) -> list[list[int]]:
    """In capture order; a new one begins where a frame is as bright as any frame of the present one."""
    out: list[list[int]] = []
    for k in members:
        if not out or any(abs(g.b[k] - g.b[j]) <= level for j in out[-1]):
            out.append([])
        out[-1].append(k)
    return out


def scene_change(g: Group) -> np.ndarray:
    """Where two well exposed frames of one level differ much, brackets part that are confidently different."""
    out = np.zeros(len(g.ids), int)
    if len(g.ids) < 4:
        return out
    valid = (g.tiles >= images.VALID[0]) & (g.tiles <= images.VALID[1])
    well = [k for k in range(len(g.ids)) if 45 <= g.b[k] <= 205]
    changed = max(1.0, 300 / 65536 * g.size)
    for a, i in enumerate(well):
        for j in well[a + 1 :]:
            if abs(g.b[i] - g.b[j]) <= 12:
                got = measures.change(g.even(i), g.even(j), valid[i] & valid[j], g.p.pixels(g.p.change_pixels, g.size))
                if got and got[0] >= 80 and got[1] >= changed:
                    brackets = brackets_of(g, g.order())
                    for members, c in zip(brackets, pieces(~_different(g, [g.rep(m, 45, 205) for m in brackets])), strict=True):
                        out[members] = c
                    return out
    return out


def is_object(blob: dict, size: int = 65536) -> bool:
    """Whether a changed region is a thing that moved: strong and large, wide, or small and compact. Areas are for 256 x 256."""
    scale = size / 65536
    area, dim, fill, loc = blob["area"] / scale, blob["mindim"] / scale**0.5, blob["fill"], blob["loc"]
    compact = loc >= 17 and dim >= 25 and 300 <= area <= 700 and fill >= 0.40
    large = area >= 600 and fill >= 0.30 and dim >= 25
    return compact or (large and ((loc >= 9 and dim >= 40) or (dim >= 60 and loc >= 4.3)))


def balanced_cut(order: list[int], a: int, b: int) -> int:
    """Where to cut an order between two of its members so that both parts are most alike in size; the first of equals."""
    p, q = sorted((order.index(a), order.index(b)))
    return min(range(p + 1, q + 1), key=lambda k: (abs(2 * k - len(order)), k))


def motion(g: Group) -> np.ndarray:
    """Two parts in capture order, cut between the two frames of one level that differ most by scene or by a moved thing."""
    out = np.zeros(len(g.ids), int)
    if len(g.ids) < 4:
        return out
    z, n = g.scores()
    valid = (g.tiles >= images.VALID[0]) & (g.tiles <= images.VALID[1])
    well = [k for k in range(len(g.ids)) if 45 <= g.b[k] <= 205]
    best = None
    for a, i in enumerate(well):
        for j in well[a + 1 :]:
            if abs(g.b[i] - g.b[j]) > 35:
                continue
            trusted = n[i, j] >= g.p.pixels(g.p.motion_pixels, g.size)
            blob = measures.moved_object(g.even(i), g.even(j), valid[i] & valid[j], outside=500 / 65536 * g.size)
            if (trusted and -1 < z[i, j] < 0.45) or is_object(blob, g.size):
                score = (1 - z[i, j] if trusted else 0.0) + blob["area"] / (3000 / 65536 * g.size)
                if best is None or score > best[0]:
                    best = (score, i, j)
    if best:
        order = g.order()
        out[order[balanced_cut(order, *best[1:]) :]] = 1
    return out


def anchors(g: Group) -> np.ndarray:
    """Well exposed frames make scenes; clipped ones make groups by their anchors. Of several hard clipped groups on one side
    of mid exposure all but the largest are scenes of their own; other groups go to the scene that they anchor best."""
    n, out = len(g.ids), np.zeros(len(g.ids), int)
    if n < 3:
        return out
    z, overlap = g.scores()
    masks = [images.anchor_masks(t, min(24, g.side)) for t in g.tiles]
    agree = lambda a, b: measures.anchor_agreement(masks[a], masks[b], g.b[a], g.b[b])
    well = [k for k in range(n) if 50 <= g.b[k] <= 200]
    rest = [k for k in range(n) if not 50 <= g.b[k] <= 200]
    comp = pieces((overlap >= g.p.pixels(g.p.trust_pixels, g.size))[np.ix_(well, well)] & (z >= 0.35)[np.ix_(well, well)])
    scene = dict(zip(well, comp.tolist(), strict=True))
    count = int(comp.max()) + 1 if len(well) else 0
    link = np.array([[(g.b[a] < 128) == (g.b[b] < 128) and agree(a, b) >= 0.45 for b in rest] for a in rest], bool).reshape(len(rest), len(rest))
    clips = [[rest[k] for k in np.flatnonzero(pieces(link) == c)] for c in range(int(pieces(link).max()) + 1)] if rest else []
    spawned = []
    for dark in (True, False):
        hard = [c for c in clips if (g.b[c[0]] < 128) == dark and all(g.b[k] < 30 if dark else g.b[k] > 225 for k in c) and max(g.tiles[k].std() for k in c) >= 10]
        spawned += sorted(hard, key=lambda c: (-len(c), c[0]))[1:]
    for c in clips:
        if c in spawned:
            scene |= dict.fromkeys(c, count)
            count += 1
        else:
            best = max(((max(agree(k, w) for k in c for w in well if scene[w] == s), s) for s in range(int(comp.max()) + 1)), default=(0, 0)) if well else (0, 0)
            scene |= dict.fromkeys(c, best[1])
    return np.array([scene[k] for k in range(n)], int)


def clipped_foreign(g: Group) -> np.ndarray:
    """Near black frames of two lights or more part where no light of one fits the other; the largest part stays."""
    out = np.zeros(len(g.ids), int)
    dark = [k for k in range(len(g.ids)) if g.b[k] < 30]
    found = {k: images.clip_lights(g.tiles[k]) for k in dark}
    dark = [k for k in dark if len(found[k]) >= 2]
    if len(dark) < 2:
        return out
    comp = pieces(np.array([[a == b or (measures.light_match(found[a], found[b]) or 0) > 0 for b in dark] for a in dark], bool))
    size = np.bincount(comp)
    largest = int(np.argmax(size))
    for k, c in zip(dark, comp.tolist(), strict=True):
        out[k] = 0 if c == largest else c + 1
    return out


SPLITS: dict[str, Callable[[Group], np.ndarray]] = {"high_resolution": high_resolution, "capture_runs": capture_runs, "scene_change": scene_change, "motion": motion, "anchors": anchors, "clipped_foreign": clipped_foreign}


def split(labels: DataFrame, frames: DataFrame, names: list[str], p: Params | None = None) -> DataFrame:
    """The named splits one after another on each group. A group is one task's; frames without a label are left out."""
    p = p or Params()

    def run(rows: pa.Table) -> pa.Table:
        ids, files, b = rows.column("frame_id").to_numpy(), rows.column("filename").to_pylist(), rows.column("brightness").to_numpy()
        tiles = rows.column("tile").to_pylist()
        parts = [list(range(len(ids)))]
        for name in names:
            new = []
            for part in parts:
                part = sorted(part, key=lambda k: ids[k])
                got = SPLITS[name](Group(ids[part], [files[k] for k in part], b[part], [tiles[k] for k in part], p))
                new += [[part[k] for k in np.flatnonzero(got == c)] for c in np.unique(got)]
            parts = new
        label = np.empty(len(ids), np.int64)
        for part in parts:
            label[part] = ids[part].min()
        return pa.table({"frame_id": ids, "label": label})

    own = frames.select("frame_id", "filename", F.col("brightness").cast("double").alias("brightness"), F.col("tile").cast("array<double>").alias("tile"))
    return own.join(labels, "frame_id").groupBy("label").applyInArrow(run, _LABELS)


# --- passes across groups ---------------------------------------------------------------------------------------------


def _stats(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with their label and the size of their group."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    own = frames.select("frame_id", "filename", F.col("brightness").cast("double").alias("brightness"), F.col("tile").cast("array<double>").alias("tile"))
    return own.join(labels, "frame_id").join(n, "label")


def middle_frames(rows: DataFrame, lo: float, hi: float) -> DataFrame:
    """Of each label the frame within bounds that is nearest to mid exposure; labels without any are left out."""
    w = Window.partitionBy("label").orderBy(F.abs(F.col("brightness") - 128), "frame_id")
    return rows.where(F.col("brightness").between(lo, hi)).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def blocked(queries: DataFrame, rows: DataFrame, by: str, fn: Callable[[Group, Group, np.ndarray, np.ndarray], dict], schema: str, p: Params, times: int = 1, apart: bool = False) -> DataFrame:
    """fn of each block of queries with each block of rows (those of one ``by`` stay together); all meet all. A block has
    ``times`` as many rows as p.block where fn holds no matrix of all its pairs. ``apart``: blocks of queries are of half of
    p.block, and few pairs of blocks share a task."""
    blocks_q, blocks_r = (max(1, -(-df.count() // max(1, n))) for df, n in ((queries, p.block // 2 if apart else times * p.block), (rows, times * p.block)))
    queries, rows = packed(queries), packed(rows)
    cols = ["frame_id", "filename", "brightness", "tile", "label", "size"]
    q = queries.select(*cols, F.pmod(F.xxhash64("frame_id"), F.lit(blocks_q)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks_r - 1))).alias("j"), F.lit(0).alias("side"))
    r = rows.select(*cols, F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))).alias("i"), F.pmod(F.xxhash64(by), F.lit(blocks_r)).cast("int").alias("j"), F.lit(1).alias("side"))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def run(both: pa.Table) -> pa.Table:
        side = both.column("side").to_numpy()
        made = []
        for s in (0, 1):
            t = both.take(np.flatnonzero(side == s)).sort_by("frame_id")
            made.append((Group(t.column("frame_id").to_numpy(), t.column("filename").to_pylist(), t.column("brightness").to_numpy(), [unpack(x) for x in t.column("tile").to_pylist()], p), t.column("label").to_numpy()))
        (a, la), (b, lb) = made
        got = fn(a, b, la, lb) if len(la) and len(lb) else {n: [] for n in names}
        return pa.table({c.split()[0]: pa.array(got[c.split()[0]], kinds[c.split()[1]]) for c in schema.split(", ")})

    both = q.unionByName(r)
    return (both.repartition(min(2000, 2 * blocks_q * blocks_r), "i", "j") if apart else both).groupBy("i", "j").applyInArrow(run, schema)


def _cross(a: Group, b: Group) -> tuple[np.ndarray, np.ndarray]:
    return correlations(*a.compared(), *b.compared(), a.p.pixels(a.p.score_pixels, a.size))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the groups of links (a, b: labels) are one."""
    both = connected_components(labels.select(F.col("label").alias("node")).distinct(), links.select("a", "b")).withColumnRenamed("label", "to")
    return labels.join(both, labels.label == both.node).select("frame_id", F.col("to").alias("label"))


def _best(found: DataFrame, floor: float, margin: float, weak: float | None = None) -> DataFrame:
    """a, b of the best b for each a: its score is the floor at least, and it is alone, ahead by the margin, or the next one
    is under ``weak``. Ties go to the larger b."""
    w = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("b"))
    ranked = found.withColumns({"__k": F.row_number().over(w), "__next": F.lead("score").over(w)}).where("__k = 1")
    clear = F.col("__next").isNull() | (F.col("score") - F.col("__next") >= margin)
    return ranked.where((F.col("score") >= floor) & (clear | (F.col("__next") < weak) if weak is not None else clear)).select("a", "b", "score")


def orphan_candidates(labels: DataFrame, frames: DataFrame, p: Params | None = None, every: int = 1, least: float | None = None) -> DataFrame:
    """a (label of a clipped orphan), frame_id, b (another label), member (its frame nearest in brightness), gap, z, n: of
    orphans whose frame_id is divisible by ``every``, with all labels, or those of z ``least`` on link_pixels or more."""
    p = p or Params()
    rows = _stats(labels, frames)
    orphans = rows.where("size <= 2 and (brightness < 45 or brightness > 210)").where(F.col("frame_id") % every == 0)

    def run(a: Group, b: Group, la: np.ndarray, lb: np.ndarray) -> dict:
        order = np.argsort(lb, kind="stable")
        first = np.flatnonzero(np.r_[True, lb[order][1:] != lb[order][:-1]])
        size = np.diff(np.r_[first, len(order)])
        if least is None:
            z, n = _cross(a, b)
            gap = np.abs(a.b[:, None] - b.b[order][None])
            at = np.where(gap == np.repeat(np.minimum.reduceat(gap, first, axis=1), size, axis=1), np.arange(len(order)), len(order))
            j = order[np.minimum.reduceat(at, first, axis=1)]
            i, k = np.nonzero(la[:, None] != lb[j])
            j = j[i, k]
            z, n = z[i, j], n[i, j]
        else:
            i, j, z, n = linked(*a.compared(), *b.compared(), least, p.pixels(p.link_pixels, a.size), lambda i, j: la[i] != lb[j])
            own = np.empty(len(order), np.int64)
            own[order] = np.repeat(np.arange(len(first)), size)
            start, left = first[own[j]], size[own[j]]
            member = order[start]
            for k in range(1, int(left.max(initial=0))):
                other = order[np.where(k < left, start + k, start)]
                member = np.where(np.abs(a.b[i] - b.b[other]) < np.abs(a.b[i] - b.b[member]), other, member)
            i, j, z, n = (t[member == j] for t in (i, j, z, n))
        return {"a": la[i], "frame_id": a.ids[i], "b": lb[j], "member": b.ids[j], "gap": np.abs(a.b[i] - b.b[j]), "z": z, "n": n}

    return blocked(orphans, rows, "label", run, "a long, frame_id long, b long, member long, gap double, z double, n long", p, 1 if least is None else 4)


def attach_orphans(labels: DataFrame, frames: DataFrame, p: Params | None = None) -> DataFrame:
    """Clipped orphans join the group whose nearest exposure fits: alike on many pixels, or a rung of its ladder of exposures."""
    p = p or Params()
    from bracketry.operators.windows import ladder_step

    size = frames.select(F.size("tile")).first()
    strong, link = (p.pixels(s, size[0] if size else 0) for s in (p.strong_pixels, p.link_pixels))
    steps = ladder_step(frames.join(labels, "frame_id"), "label", "brightness").withColumnRenamed("label", "b")
    c = orphan_candidates(labels, frames, p, least=0.50).join(steps, "b")
    rung = ((F.col("z") >= 0.58) & (F.col("gap") <= 1.8 * F.greatest("step", F.lit(30.0)))) | ((F.col("z") >= 0.50) & (F.col("n") >= strong))
    fits = (F.col("n") >= link) & (((F.col("z") >= 0.85) & (F.col("n") >= strong)) | ((F.col("gap") >= 25) & rung))
    w = Window.partitionBy("frame_id").orderBy(F.desc("z"), F.desc("b"))
    ranked = c.where(fits).withColumns({"__k": F.row_number().over(w), "__next": F.coalesce(F.lead("z").over(w), F.lit(-1.0))}).where("__k = 1")
    return joined(labels, ranked.where((F.col("z") - F.col("__next") >= 0.12) | (F.col("__next") < 0.58)).select("a", "b"))


def nearest(asks: DataFrame, rows: DataFrame, near: int, block: int = 256) -> DataFrame:
    """a, b: for each of asks (a, m) the ``near`` of rows (b, m) whose m is nearest, itself left out; ties go to the smaller b.

    Of the rows of one m the least near + 1 are enough, and with the ``near`` values of m on either side they hold all that
    can be among the nearest: values are numbered in order, and each gets its list from those around its number."""
    few = rows.where("m is not null").withColumn("__k", F.row_number().over(Window.partitionBy("m").orderBy("b"))).where(F.col("__k") <= near + 1)
    placed = numbered(few.groupBy("m").agg(F.collect_list("b").alias("bs")), ["m"], "at")
    part = lambda c: F.floor(c / block)
    each = placed.withColumn("part", F.explode(F.sequence(part(F.col("at") - near), part(F.col("at") + near))))
    around = F.collect_list(F.struct("m", "bs")).over(Window.partitionBy("part").orderBy("at").rowsBetween(-near, near))
    each = each.withColumn("around", around).where(F.col("part") == part(F.col("at")))
    by_gap = F.flatten(F.transform("around", lambda v: F.transform(v["bs"], lambda b: F.struct(F.abs(v["m"] - F.col("m")).alias("gap"), b.alias("b")))))
    best = each.select("m", F.slice(F.sort_array(by_gap), 1, near + 1).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["b"] != F.col("a")), 1, near)
    return asks.join(best, "m").select("a", F.explode(others).alias("x")).select("a", F.col("x.b").alias("b"))


def merge_candidates(labels: DataFrame, frames: DataFrame, near: int = 14) -> DataFrame:
    """a, b: groups next to each other by capture number, or among the nearest by mean brightness; the latter for pieces
    (three frames at most, or with a clipped one) only."""
    from bracketry.functions.frames import capture_number, capture_prefix

    rows = frames.select("frame_id", "filename", "brightness").join(labels, "frame_id")
    keyed = rows.select("label", capture_prefix(F.col("filename")).alias("prefix"), capture_number(F.col("filename")).alias("number")).where("prefix is not null")
    step = keyed.select(F.col("label").alias("a"), "prefix", F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number"))
    adjacent = step.join(keyed.select(F.col("label").alias("b"), "prefix", "number"), ["prefix", "number"]).where("a <> b").select("a", "b")
    stats = rows.groupBy("label").agg(F.avg("brightness").alias("mean"), F.count(F.lit(1)).alias("size"), F.max(((F.col("brightness") < 45) | (F.col("brightness") > 210)).cast("int")).alias("clipped"))
    asks = stats.where("size <= 3 or clipped = 1").select(F.col("label").alias("a"), F.col("mean").alias("m"))
    close = nearest(asks, stats.select(F.col("label").alias("b"), F.col("mean").alias("m")), near)
    return adjacent.union(close).distinct()


def k_nearest(far: Callable[[np.ndarray, slice], np.ndarray], exact: Callable[[np.ndarray, np.ndarray], np.ndarray], la: np.ndarray, lb: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, ...]:
    """i, j, distance of the k of lb (in order) nearest to each of la but its own label; ties go to the smaller label. far
    gives distances of some of a from a part of b, off by ``slack`` at most; where the k so far are at 0, nothing later counts."""
    who, dist = np.full((len(la), k), -1), np.full((len(la), k), np.inf)
    at, step = 0, 64
    while at < len(lb) and len(rows := np.flatnonzero(dist[:, -1] > 0)):
        part = slice(at, min(at + step, len(lb)))
        i, j = np.nonzero(far(rows, part) <= (dist[rows, -1] + slack)[:, None].astype(np.float32))
        i, j = rows[i], at + j
        other = la[i] != lb[j]
        i, j = i[other], j[other]
        touched = np.unique(i)
        old = np.nonzero(who[touched] >= 0)
        held = touched[old[0]]
        d = np.concatenate([dist[held, old[1]], exact(i, j)])
        i, j = np.concatenate([held, i]), np.concatenate([who[held, old[1]], j])
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, d, place = (t[place < k] for t in (i, j, d, place))
        who[i, place], dist[i, place] = j, d
        at, step = at + step, min(2 * step, 2048)
    i, n = np.nonzero(who >= 0)
    return i, who[i, n], dist[i, n]


def near_groups(labels: DataFrame, frames: DataFrame, p: Params, centres: int = 19, ranges: int = 14, block: int = 24_000) -> DataFrame:
    """a, b: for each group the ``centres`` groups whose mean embedding is most alike by cosine, and for pieces (as in
    merge_candidates) the ``ranges`` whose range of brightness is nearest (0 where they meet); ties go to the smaller label.
    All groups meet all, block against block. Embeddings are of wavelets, or of the pixels if these are compared."""
    vectors = (wavelet_embeddings if p.edges else pixel_embeddings)(frames)
    b = F.col("brightness").cast("double")
    rows = frames.select("frame_id", b.alias("brightness")).join(vectors, "frame_id").join(labels, "frame_id")
    each = rows.groupBy("label").agg(F.min("brightness").alias("lo"), F.max("brightness").alias("hi"), F.sort_array(F.collect_list(F.struct("frame_id", "wave"))).alias("f"))  # a group is one bracket's frames

    def means(batches):
        for batch in batches:
            got = []
            for f in batch.column("f").to_pylist():
                v = np.mean([x["wave"] for x in f], axis=0)
                got.append((v / (np.linalg.norm(v) + 1e-9)).astype("<f4").tobytes())
            lo, hi, size = batch.column("lo").to_numpy(), batch.column("hi").to_numpy(), batch.column("f").value_lengths().to_numpy()
            piece = pa.array((size <= 3) | (lo < 45) | (hi > 210), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("lo"), batch.column("hi"), piece, pa.array(got, pa.binary())], names=["label", "lo", "hi", "piece", "v"])

    groups = stored(each.mapInArrow(means, "label long, lo double, hi double, piece boolean, v binary"))
    blocks = max(2, -(-groups.count() // block))
    kind = "a long, kind int, far double, b long"

    def run(both: pa.Table) -> pa.Table:
        sides = [both.filter(pa.array(both.column("side").to_numpy() == k)).sort_by("label") for k in (0, 1)]
        out = [[], [], [], []]
        if all(t.num_rows for t in sides):
            (la, loa, hia, pa_, va), (lb, lob, hib, _, vb) = ((*(t.column(c).to_numpy() for c in ("label", "lo", "hi", "piece")), np.stack([np.frombuffer(x, "<f4") for x in t.column("v").to_pylist()])) for t in sides)
            for at in range(0, len(la), 512):
                s = np.arange(at, min(at + 512, len(la)))
                alike = lambda i, t, s=s: 2 - va[s[i]] @ vb[t].T
                sure = lambda i, j, s=s: np.round(2 - (va[s[i]].astype(float) * vb[j]).sum(axis=1), 9)
                found = [(0, s, *k_nearest(alike, sure, la[s], lb, centres, 1e-5))]
                s = s[pa_[s]]
                apart = lambda i, t, s=s: np.maximum(0, np.maximum(lob[t] - hia[s[i]][:, None], loa[s[i]][:, None] - hib[t]))
                gap = lambda i, j, s=s: np.maximum(0, np.maximum(lob[j] - hia[s[i]], loa[s[i]] - hib[j]))
                found.append((1, s, *k_nearest(apart, gap, la[s], lb, ranges, 1e-3)))
                for which, s, i, j, d in found:
                    for o, v in zip(out, (la[s[i]], np.full(len(i), which), d, lb[j]), strict=True):
                        o.append(v)
        cat = lambda k, t: np.concatenate([np.empty(0, t), *out[k]]).astype(t)
        return pa.table({"a": cat(0, np.int64), "kind": cat(1, np.int32), "far": cat(2, float), "b": cat(3, np.int64)})

    own, o = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = groups.select("*", own.alias("i"), o.alias("j"), F.lit(0).alias("side")).unionByName(groups.select("*", o.alias("i"), own.alias("j"), F.lit(1).alias("side")))
    best = both.repartition(min(2000, 2 * blocks * blocks), "i", "j").groupBy("i", "j").applyInArrow(run, kind)
    ranked = best.withColumn("__k", F.row_number().over(Window.partitionBy("kind", "a").orderBy("far", "b")))
    return ranked.where(F.col("__k") <= F.when(F.col("kind") == 0, centres).otherwise(ranges)).select("a", "b").distinct()


def merge_groups(labels: DataFrame, frames: DataFrame, p: Params | None = None) -> DataFrame:
    """Candidate groups (merge_candidates and near_groups) are one if their best pair of neighbouring exposures correlates, or
    their middle frames do."""
    p = p or Params()
    own = packed(frames.select("frame_id", F.col("brightness").cast("double").alias("brightness"), F.col("tile").cast("array<double>").alias("tile")))
    whole = own.join(labels, "frame_id").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("frame_id", "brightness", "tile"))).alias("f"))  # a group is one bracket's frames
    c = merge_candidates(labels, frames).union(near_groups(labels, frames, p)).distinct().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), 1).otherwise(2).alias("way"))
    pairs = c.groupBy("a", "b").agg(F.bit_or("way").alias("ways"))
    pairs = pairs.join(whole.select(F.col("label").alias("a"), F.col("f").alias("fa")), "a").join(whole.select(F.col("label").alias("b"), F.col("f").alias("fb")), "b")

    def run(batches):
        for batch in batches:
            size = len(unpack(batch.column("fa")[0].as_py()[0]["tile"])) if batch.num_rows else 1
            step = max(1, min(2000, 2_000_000 // size))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sides = [_members(part.column(label), part.column(f), p) for label, f in (("a", "fa"), ("b", "fb"))]
                yield part.select(["a", "b"]).filter(pa.array(merging(*sides, part.column("ways").to_numpy(), p), pa.bool_()))

    return joined(labels, pairs.mapInArrow(run, "a long, b long"))


def _members(labels: pa.Array, frames: pa.Array, p: Params) -> tuple[np.ndarray, list[tuple]]:
    """Of each row the place of its group, and groups: brightness, features and valid pixels of their frames."""
    _, first, at = np.unique(labels.to_numpy(), return_index=True, return_inverse=True)
    own = frames.take(pa.array(first))
    ids, b, tiles = own.flatten().flatten()
    g = Group(np.arange(len(ids)), [""] * len(ids), b.to_numpy(), [unpack(t) for t in tiles.to_pylist()], p)  # of all of them
    x, v = g.compared()
    ends = np.cumsum(own.value_lengths().to_numpy())
    return at, [(g.b[s:e], x[s:e], v[s:e]) for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def merging(a: tuple, b: tuple, ways: np.ndarray, p: Params) -> np.ndarray:
    """Whether pairs of groups merge, in the asked ways (1: a to b, 2: b to a); pairs of groups of like sizes at once."""
    (at, ga), (bt, gb) = a, b
    out = np.zeros(len(at), bool)
    na, nb = np.array([len(g[0]) for g in ga])[at], np.array([len(g[0]) for g in gb])[bt]
    for p_, q_ in np.unique(np.stack([na, nb], axis=1), axis=0):
        rows = np.flatnonzero((na == p_) & (nb == q_))
        (ba, xa, va), (bb, xb, vb) = ([np.stack([g[k][m] for k in t[rows]]) for m in range(3)] for t, g in ((at, ga), (bt, gb)))
        z, n = correlations(xa, va, xb, vb, p.pixels(p.score_pixels, xa.shape[-1]))
        turn = lambda t: np.swapaxes(t, 1, 2)
        out[rows] = ((ways[rows] & 1) > 0) & _should_merge(ba, bb, z, n, xa.shape[-1], p)
        out[rows] |= ((ways[rows] & 2) > 0) & _should_merge(bb, ba, turn(z), turn(n), xa.shape[-1], p)
    return out


def _middle(b: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Group.rep of each row of b."""
    inside = (b >= lo) & (b <= hi)
    return np.argmin(np.where(inside | ~inside.any(axis=1, keepdims=True), np.abs(b - 128), np.inf), axis=1)


def _should_merge(a: np.ndarray, b: np.ndarray, z: np.ndarray, n: np.ndarray, size: int, p: Params) -> np.ndarray:
    """should_merge of pairs by their brightness (pair, frame), correlations and pixels (pair, frame of a, frame of b)."""
    every = np.arange(len(a))
    link, strong = (p.pixels(s, size) for s in (p.link_pixels, p.strong_pixels))
    gap = np.abs(a[:, :, None] - b[:, None])
    near = np.argmin(gap, axis=2)
    own, shown = (np.take_along_axis(t, near[:, :, None], 2)[:, :, 0] for t in (gap, z))
    i = np.argmax(np.where(own >= 25, shown, -np.inf), axis=1)
    j = near[every, i]
    zb, nb, g = z[every, i, j], n[every, i, j], own[every, i]
    out = (g >= 25) & (nb >= link) & (((zb >= 0.62) & (g <= 120)) | ((zb >= 0.50) & (nb >= strong)))
    i, j = _middle(a, 50, 205), _middle(b, 50, 205)
    return out | ((n[every, i, j] >= link) & (z[every, i, j] >= 0.55))


def should_merge(a: Group, b: Group) -> bool:
    z, n = _cross(a, b)
    gap = np.abs(a.b[:, None] - b.b[None])
    near = np.argmin(gap, axis=1)
    link, strong = (a.p.pixels(s, a.size) for s in (a.p.link_pixels, a.p.strong_pixels))
    best = max(((z[i, j], -i, j) for i, j in enumerate(near) if gap[i, j] >= 25), default=None)
    if best:
        i, j = -best[1], best[2]
        if n[i, j] >= link and ((z[i, j] >= 0.62 and gap[i, j] <= 120) or (z[i, j] >= 0.50 and n[i, j] >= strong)):
            return True
    i, j = (g.rep(list(range(len(g.ids))), 50, 205) for g in (a, b))
    return bool(n[i, j] >= link and z[i, j] >= 0.55)


def attach_clipped(labels: DataFrame, frames: DataFrame, p: Params | None = None) -> DataFrame:
    """Single, almost blank frames join the group whose middle frame they match, or else the only group next to them by
    capture number. All decide on the same labels."""
    p = p or Params()
    from bracketry.functions.frames import capture_number, capture_prefix

    rows = _stats(labels, frames)
    lone = rows.where("size = 1 and (brightness > 245 or brightness < 12)")

    def run(a: Group, b: Group, la: np.ndarray, lb: np.ndarray) -> dict:
        z, n = _cross(a, b)
        i, j = np.nonzero((n >= a.p.pixels(a.p.loose_pixels, a.size)) & (la[:, None] != lb[None]))
        return {"a": la[i], "b": lb[j], "score": z[i, j]}

    matched = _best(blocked(lone, middle_frames(rows.where("size >= 2"), 50, 200), "label", run, "a long, b long, score double", p), 0.38, 0.12).select("a", "b")
    keyed = rows.select("label", "size", capture_prefix(F.col("filename")).alias("prefix"), capture_number(F.col("filename")).alias("number")).where("prefix is not null")
    step = lone.select(F.col("label").alias("a"), capture_prefix(F.col("filename")).alias("prefix"), capture_number(F.col("filename")).alias("c")).select("a", "prefix", F.explode(F.array(F.col("c") - 1, F.col("c") + 1)).alias("number"))
    beside = step.join(keyed.where("size >= 2"), ["prefix", "number"]).groupBy("a").agg(F.min("label").alias("b"), F.countDistinct("label").alias("n")).where("n = 1").select("a", "b")
    return joined(labels, matched.union(beside.join(matched.select("a"), "a", "left_anti")))


def attach_by_anchors(labels: DataFrame, frames: DataFrame, p: Params | None = None) -> DataFrame:
    """Small clipped groups join the group whose frames share their bright or dark places, where correlation is blind. All
    decide on the same labels."""
    p = p or Params()
    rows = _stats(labels, frames)
    orphans = rows.where("size <= 2 and (brightness < 30 or brightness > 225)")

    def run(a: Group, b: Group, la: np.ndarray, lb: np.ndarray) -> dict:
        n = _cross(a, b)[1]
        side = min(32, a.side)
        ma, mb = ([images.anchor_masks(t, side) for t in g.tiles] for g in (a, b))
        out = {"a": [], "b": [], "score": []}
        for label in np.unique(lb):
            at = np.flatnonzero(lb == label)
            rep = b.rep(list(at), 30, 225)
            for i in range(len(la)):
                if la[i] != label and n[i, rep] < a.p.pixels(a.p.link_pixels, a.size):
                    out["a"].append(la[i])
                    out["b"].append(label)
                    out["score"].append(max(measures.anchor_match(ma[i], mb[j], a.b[i], b.b[j]) for j in at))
        return out

    found = blocked(orphans, rows, "label", run, "a long, b long, score double", p).groupBy("a", "b").agg(F.max("score").alias("score"))
    return joined(labels, _best(found, 0.34, 0.10))


def attach_drifted(labels: DataFrame, frames: DataFrame, p: Params | None = None, shift: float = 14) -> DataFrame:
    """Small well exposed groups join the group that they fit once a drift of the camera is taken out. All decide on the
    same labels."""
    p = p or Params()
    rows = stored(middle_frames(_stats(labels, frames), 45, 215))
    floor, margin = 0.72, 0.10
    least = floor - margin - 0.01  # what scores less can neither be the best nor keep the best from being ahead

    def run(a: Group, b: Group, la: np.ndarray, lb: np.ndarray) -> dict:
        if a.side <= SMALL_SIDE:
            i, j, got = two_best_drifts(a, b, la, lb, least, margin, shift)
            return {"a": la[i], "b": lb[j], "score": got}
        ea, eb = (images.drift_edges(g.tiles) for g in (a, b))
        fb, z = np.fft.fft2(eb), _cross(a, b)[0]
        out = [[np.empty(0, t)] for t in (np.int64, np.int64, float)]
        for i in range(len(la)):
            j = np.flatnonzero((z[i] < UNLIKE) & (lb != la[i]))
            if not len(j):
                continue
            got, size = measures.drift_correlations(ea[i], eb[j], fb=fb[j])
            keep = (size <= shift) & (got >= least)
            for part, v in zip(out, (np.full(keep.sum(), la[i]), lb[j[keep]], got[keep]), strict=True):
                part.append(v)
        return {k: np.concatenate(v) for k, v in zip(("a", "b", "score"), out, strict=True)}

    size = frames.select(F.size("tile")).first()
    small = bool(size) and size[0] <= SMALL_SIDE**2
    found = blocked(rows.where("size <= 2"), rows, "label", run, "a long, b long, score double", p, 16 if small else 1, apart=small)
    return joined(labels, _best(found, floor, margin))


def two_best_drifts(a: Group, b: Group, la: np.ndarray, lb: np.ndarray, least: float, margin: float, shift: float) -> tuple[np.ndarray, ...]:
    """i, j, score of the two frames of b (one for each label) that each of a fits best after a drift, of those of ``least``
    and another label whose plain correlation is under UNLIKE.

    No more than the second best so far can change them, so what cannot reach it by any whole shift is left out; and where
    two are within the margin of 1, none can be ahead by it."""
    ea, (xa, va), (xb, vb) = images.drift_edges(a.tiles), a.compared(), b.compared()
    fa, wa, few = np.fft.fft2(ea), measures.windows(ea, shift), a.p.pixels(a.p.score_pixels, a.size)
    best, who = np.full((len(la), 2), -np.inf), np.full((len(la), 2), -1)
    at, step = 0, 32
    while at < len(lb) and len(rows := np.flatnonzero(best[:, 1] <= 1 - margin + 1e-6)):
        eb = images.drift_edges(b.tiles[at : at + step])
        asked = wa if len(rows) == len(la) else [w[rows] for w in wa]
        i, j = np.nonzero(measures.any_window(asked, measures.windows(eb, shift, True), np.maximum(least, best[rows, 1])))
        i = rows[i]
        other = la[i] != lb[at + j]
        i, j = i[other], j[other]
        z, n = paired_scores(xa[i], va[i], xb[at + j], vb[at + j])
        unlike = (n < few) | (z < UNLIKE)
        i, j = i[unlike], j[unlike]
        got, size = measures.drift_correlations(ea[i], eb[j], fa=fa[i], fb=np.fft.fft2(eb)[j])
        keep = (size <= shift) & (got >= least)
        old = np.nonzero(who >= 0)
        i, j, got = (np.concatenate(c) for c in ((old[0], i[keep]), (who[old], at + j[keep]), (best[old], got[keep])))
        order = np.lexsort((-lb[j], -got, i))
        i, j, got = i[order], j[order], got[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, got, place = (t[place < 2] for t in (i, j, got, place))
        best[i, place], who[i, place] = got, j
        at, step = at + step, min(2 * step, 1024)
    i, k = np.nonzero(who >= 0)
    return i, who[i, k], best[i, k]


def refined(labels: DataFrame, frames: DataFrame, p: Params | None = None) -> DataFrame:
    """All passes in their order."""
    p = p or Params()
    for step in (attach_orphans, merge_groups, lambda l, f, q: split(l, f, ["high_resolution"], q), attach_clipped, lambda l, f, q: split(l, f, ["capture_runs", "scene_change", "motion", "anchors", "clipped_foreign"], q), attach_by_anchors, attach_drifted):
        labels = stored(step(labels, frames, p))
    return labels
