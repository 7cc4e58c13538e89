"""Pairs of frames or vectors: masked correlation, top neighbours, hashed candidate bands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LO, HI = 8.0, 247.0
#: Rows of a block, of which each meets each, and the least number of blocks.
BLOCK, LEAST_BLOCKS = 16_000, 8
#: Rows of a block that are compared at once with so many of the other, and candidates that are scored at once: what is
#: made of them stays in a core's cache.
ROWS, COLUMNS, SCORED = 256, 512, 1024
#: Rows with up to so many invalid pixels are compared alike.
NEAR = (0, 2, 4)
BANDS, WIDTH = 64, 10


def masked_scores(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation over pixels valid in both and their number, of each row of x with each of y; -1 under two pixels."""
    vx, vy = ((x >= LO) & (x <= HI)).astype(float), ((y >= LO) & (y <= HI)).astype(float)
    ax, ay = x * vx, y * vy
    n = vx @ vy.T
    sx, sy, sxy = ax @ vy.T, vx @ ay.T, ax @ ay.T
    sxx, syy = (ax * x) @ vy.T, vx @ (ay * y).T
    m = np.maximum(n, 1)
    z = (sxy - sx * sy / m) / (np.sqrt(np.maximum(sxx - sx * sx / m, 0)) * np.sqrt(np.maximum(syy - sy * sy / m, 0)) + 1e-9)
    return np.where(n < 2, -1.0, z), n.astype(np.int64)


def valid_pixels(x: np.ndarray) -> np.ndarray:
    return (x >= LO) & (x <= HI)


def paired_scores(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """masked_scores of each row of x with the same row of y, over pixels valid in both."""
    v = (vx & vy).astype(float)
    ax, ay = x * v, y * v
    n, sx, sy = v.sum(1), ax.sum(1), ay.sum(1)
    sxy, sxx, syy = ((p * q).sum(1) for p, q in ((ax, ay), (ax, ax), (ay, ay)))
    m = np.maximum(n, 1)
    z = (sxy - sx * sy / m) / (np.sqrt(np.maximum(sxx - sx * sx / m, 0)) * np.sqrt(np.maximum(syy - sy * sy / m, 0)) + 1e-9)
    return np.where(n < 2, -1.0, z), n.astype(np.int64)


class _Side:
    """Rows with ``overlap`` valid pixels at least, less their mean and at length 1 over their valid pixels (``u``, 0
    elsewhere), with their masks ``v``. ``kinds`` are their places by the number of invalid pixels: up to each of NEAR, and
    the rest."""

    def __init__(self, x: np.ndarray, valid: np.ndarray, overlap: float):
        n, size = valid.sum(1), x.shape[1]
        a = np.where(valid, x, 0)
        a = np.where(valid, a - (a.sum(1) / np.maximum(n, 1))[:, None], 0)
        a /= np.maximum(np.sqrt((a * a).sum(1)), 1e-12)[:, None]
        self.u, self.v, self.n, self.overlap, self.size = a.astype(np.float32), valid.astype(np.float32), n, overlap, size
        lost = np.where(n >= overlap, size - n, -1)
        self.kinds = [np.flatnonzero((lost > low) & (lost <= k)) for low, k in zip((-1, *NEAR), NEAR)] + [np.flatnonzero(lost > NEAR[-1])]
        top = -np.sort(-(a * a), axis=1)[:, : NEAR[-1]].cumsum(1) if len(x) else np.empty((0, NEAR[-1]))
        self.top = np.concatenate([np.zeros((len(x), 1)), top, np.tile(top[:, -1:], (1, NEAR[-1] - top.shape[1]))], axis=1)

    def bounds(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """For rows that share all but k of their valid pixels at most with another: the least number of pixels shared, the
        most of their mean, and the least length that is left over these pixels, less their mean."""
        least = np.maximum(self.n[rows] - k, self.overlap)
        lost = np.minimum(self.top[rows, k], 1)
        return least, np.sqrt(k * lost) / least, np.sqrt(np.maximum(1 - lost * (1 + k / least), 0))


def _near_near(x: _Side, i: np.ndarray, kx: int, y: _Side, j: np.ndarray, ky: int, least: float, slack: float) -> Callable:
    """Whether rows i and j, with kx and ky invalid pixels at most, may reach ``least``: sums over the pixels of both are
    bounded by what the pixels that are missing can take away."""
    _, mx, fx = x.bounds(i, ky)
    _, my, fy = y.bounds(j, kx)
    shared = max(x.size - kx - ky, x.overlap)
    mx, my = mx * np.maximum(x.n[i] - ky, x.overlap) / np.sqrt(shared), my * np.maximum(y.n[j] - kx, y.overlap) / np.sqrt(shared)
    p = np.column_stack([x.u[i], mx, least * fx]).astype(np.float32)
    q = np.column_stack([y.u[j], my, -fy]).astype(np.float32)
    return lambda s, t: p[s] @ q[t].T >= np.float32(-slack)


def _near_part(x: _Side, i: np.ndarray, kx: int, y: _Side, j: np.ndarray, least: float, slack: float) -> Callable:
    """Whether rows i with kx invalid pixels at most may reach ``least`` with any rows j: sums over all valid pixels of j,
    bounded by what those missing in i can take away."""
    n, my, fy = y.bounds(j, kx)
    fy *= least
    open_ = fy < 0.01  # nothing is left for sure
    u, uu = x.u[i], x.u[i] ** 2
    w, v, vv = y.u[j], (y.v[j] * (fy / np.sqrt(n))[:, None]).astype(np.float32), (y.v[j] * (fy * fy)[:, None]).astype(np.float32)
    m = (my * np.sqrt(n) / np.maximum(fy, 0.01)).astype(np.float32)
    off = np.where(open_, 9, slack).astype(np.float32)

    def may(s: slice, t: slice) -> np.ndarray:
        d, sx, a = u[s] @ w[t].T, u[s] @ v[t].T, uu[s] @ vv[t].T
        a -= off[t]
        if kx:
            b = np.abs(sx)
            b *= m[t]
            d += b
        sx *= sx
        a -= sx
        np.abs(d, out=sx)
        d *= sx
        return d >= a

    return may


def _part_part(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray, least: float, slack: float) -> Callable:
    """Whether any rows i and j may reach ``least``, by all sums over the pixels valid in both."""
    p, pp, pv, q, qq, qv = x.u[i], x.u[i] ** 2, x.v[i], y.u[j], y.u[j] ** 2, y.v[j]
    level = np.float32(least * least)

    def may(s: slice, t: slice) -> np.ndarray:
        n = pv[s] @ qv[t].T
        keep = n >= x.overlap
        np.reciprocal(np.maximum(n, 1, out=n), out=n)
        sx, sy, d, a, b = p[s] @ qv[t].T, pv[s] @ q[t].T, p[s] @ q[t].T, pp[s] @ qv[t].T, pv[s] @ qq[t].T
        mean = sx * n
        sx *= mean
        a -= sx
        mean *= sy
        d -= mean
        sy *= sy
        sy *= n
        b -= sy
        a *= b
        a *= level
        a -= np.float32(slack)
        np.abs(d, out=sx)
        d *= sx
        keep &= d >= a
        return keep

    return may


def _steps(x: _Side, y: _Side, least: float, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool, Callable]]:
    """Places of rows of both sides (turned: the other way round), and what tells which parts of them may be linked."""
    for kx, i in zip(NEAR, x.kinds):
        for ky, j in zip(NEAR, y.kinds):
            yield i, j, False, _near_near(x, i, kx, y, j, ky, least, slack)
    for kx, i in zip(NEAR, x.kinds):
        yield i, y.kinds[-1], False, _near_part(x, i, kx, y, y.kinds[-1], least, slack)
    for ky, j in zip(NEAR, y.kinds):
        yield j, x.kinds[-1], True, _near_part(y, j, ky, x, x.kinds[-1], least, slack)
    yield x.kinds[-1], y.kinds[-1], False, _part_part(x, x.kinds[-1], y, y.kinds[-1], least, slack)


def links(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray, least: float, overlap: float, wanted: Callable | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """linked in parts of up to SCORED pairs; wanted is asked right before pairs are scored, so it may follow from the parts before."""
    if least <= 0 or overlap < 2:
        raise ValueError("linked needs a least score over 0 and an overlap of 2")
    if not len(x) or not len(y):
        return
    # rows are at length 1 in single precision: sums are off by less than half of this, and pairs within are scored
    slack = 32 * max(x.shape[1], 64) * float(np.finfo(np.float32).eps)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def scored() -> Iterator[tuple[np.ndarray, ...]]:
        i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        while len(i):
            if wanted is not None:
                keep = wanted(i, j)
                i, j = i[keep], j[keep]
            a, b, i, j = i[:SCORED], j[:SCORED], i[SCORED:], j[SCORED:]
            z, n = paired_scores(x[a], vx[a], y[b], vy[b])
            keep = (z >= least) & (n >= overlap)
            yield a[keep], b[keep], z[keep], n[keep]

    waiting = 0
    for rows, cols, turned, may in _steps(_Side(x, vx, overlap), _Side(y, vy, overlap), least, slack):
        for at in range(0, len(rows), ROWS):
            for to in range(0, len(cols), COLUMNS):
                found = may(slice(at, at + ROWS), slice(to, to + COLUMNS))
                i, j = np.divmod(np.flatnonzero(found), found.shape[1])
                if len(i):
                    i, j = rows[at + i], cols[to + j]
                    held.append((j, i) if turned else (i, j))
                    waiting += len(i)
                if waiting >= SCORED:
                    yield from scored()
                    waiting = 0
    if held:
        yield from scored()


def linked(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray, least: float, overlap: float, wanted: Callable | None = None) -> tuple[np.ndarray, ...]:
    """i, j, z, n of the rows of x and y with masked_scores of ``least`` (over 0) over ``overlap`` pixels (2 at least) or
    more, of those with wanted(i, j) if given.

    A test in single precision, which no pair that counts can fail, leaves out most; the rest are scored in double
    precision. Rows with few invalid pixels need fewer sums."""
    parts = [tuple(np.empty(0, t) for t in (np.int64, np.int64, float, np.int64)), *links(x, vx, y, vy, least, overlap, wanted)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class _Groups:
    """Which of n things hang together by the links so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links (a, b), one after another, join two groups."""
        up: dict[int, int] = {}

        def top(p: int) -> int:
            while (q := up.get(p, p)) != p:
                up[p] = up.get(q, q)
                p = q
            return p

        new = np.zeros(len(a), bool)
        for k, (p, q) in enumerate(zip(self.root[a].tolist(), self.root[b].tolist(), strict=True)):
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)], new[k] = min(p, q), True
        if up:
            to = np.arange(len(self.root))
            to[list(up)] = [top(p) for p in list(up)]
            self.root = to[self.root]
        return new


def _forest(own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, same: bool, least: float, overlap: int) -> list[np.ndarray]:
    """linked of two blocks (or one with itself), of which only links that join two groups stay."""
    both, place = np.unique(np.concatenate([own, ids]), return_inverse=True)
    p, q = place[: len(own)], place[len(own) :]
    groups, out, held = _Groups(len(both)), [], []

    def flush() -> None:
        i, j, z, n = (np.concatenate(c) for c in zip(*held, strict=True))
        new = groups.join(p[i], q[j])
        out.append((i[new], j[new], z[new], n[new]))
        held.clear()

    def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (groups.root[p[i]] != groups.root[q[j]]) & ((own[i] < ids[j]) if same else True)

    held.append(tuple(np.empty(0, t) for t in (np.int64, np.int64, float, np.int64)))
    for part in links(x, valid_pixels(x), y, valid_pixels(y), least, overlap, wanted):
        held.append(part)
        if sum(len(c[0]) for c in held) >= SCORED // 2:
            flush()
    if held:
        flush()
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def masked_pairs(frames: DataFrame, least: float, overlap: int, forest: bool = False) -> DataFrame:
    """a < b, z, n of frames (frame_id, tile) that correlate: all pairs are compared at every size, block against block.
    With ``forest`` only as many of the pairs of two blocks as link the same frames, directly or by others."""
    blocks = max(LEAST_BLOCKS, -(-frames.count() // BLOCK))

    def run(both: pa.Table) -> pa.Table:
        side = both.column("side").to_numpy()
        (own, x), (ids, y) = ((t.column("frame_id").to_numpy(), unpacked(t.column("tile"))) for t in (both.take(np.flatnonzero(side == k)) for k in (0, 1)))
        same = both.column("i")[0] == both.column("j")[0]
        if forest:
            i, j, z, n = _forest(own, x, ids, y, same, least, overlap)
        else:
            i, j, z, n = linked(x, valid_pixels(x), y, valid_pixels(y), least, overlap, (lambda i, j: own[i] < ids[j]) if same else None)
        p, q = own[i], ids[j]
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q), "z": z, "n": n})

    each = packed(frames.select("frame_id", "tile").where("tile is not null")).withColumn("own", F.pmod(F.xxhash64("frame_id"), F.lit(blocks)).cast("int"))
    own = F.col("own")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), (o < own).cast("int").alias("side")))
    each = each.select("frame_id", "tile", F.explode(F.concat(pairs, F.array(F.struct(own.alias("i"), own.alias("j"), F.lit(1).alias("side"))))).alias("p"))
    dealt = each.select("p.*", "frame_id", "tile").repartition(min(2000, 2 * blocks * (blocks + 1)), "i", "j")  # few of them get two pairs of blocks
    return dealt.groupBy("i", "j").applyInArrow(run, "a long, b long, z double, n long")


def packed(rows: DataFrame) -> DataFrame:
    """Rows with tile as bytes: one for a pixel if all of them are whole numbers from 0 to 255, else doubles after a byte 0."""
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'tile' else f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("tile")
            tiles = _pack_all(batch.column(at))
            yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.binary()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def pack(x: np.ndarray) -> bytes:
    small = x.astype(np.uint8) if ((x >= 0) & (x <= 255)).all() else None
    return b"\1" + small.tobytes() if small is not None and (small == x).all() else b"\0" + x.astype("<f8").tobytes()


def _pack_all(tiles: pa.ListArray) -> list[bytes | None]:
    size = tiles.value_lengths()
    if tiles.null_count or tiles.flatten().null_count or len(size.unique()) != 1 or not size[0].as_py():
        return [None if t is None else pack(np.asarray(t, float)) for t in tiles.to_pylist()]
    x = tiles.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(tiles), -1)
    whole = ((x >= 0) & (x <= 255) & (x == np.floor(x))).all(axis=1)
    small = np.where(whole[:, None], x, 0).astype(np.uint8)
    return [b"\1" + small[k].tobytes() if w else b"\0" + x[k].astype("<f8").tobytes() for k, w in enumerate(whole.tolist())]


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8 if b[0] else "<f8", offset=1).astype(float)


def unpacked(tiles: pa.ChunkedArray) -> np.ndarray:
    return np.stack([unpack(b) for b in tiles.to_pylist()]) if len(tiles) else np.empty((0, 0))


def _matrix(tiles: pa.ChunkedArray) -> np.ndarray:
    return tiles.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(tiles), -1) if len(tiles) else np.empty((0, 0))


def plane_sign(plane, dim):
    """+1 or -1, the same in any engine: the parity of a quadratic residue."""
    return F.when(((plane * 7919 + dim * 104_729 + plane * dim * 31) % 1009) % 2 == 0, 1.0).otherwise(-1.0)


def band_keys(frames: DataFrame, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """frame_id, band, key: signs of projections of the centred tile, `width` to a band."""
    mean = F.aggregate("tile", F.lit(0.0), lambda a, v: a + v) / F.size("tile")

    def bit(band, j):
        dims = F.transform("tile", lambda v, d: (v - F.col("m")) * plane_sign(band * width + j, d))
        return F.when(F.aggregate(dims, F.lit(0.0), lambda a, v: a + v) > 0, 1).otherwise(0)

    each = frames.withColumn("m", mean).select("frame_id", "tile", "m", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    key = sum((bit(F.col("band"), F.lit(j)) * (1 << j) for j in range(1, width)), bit(F.col("band"), F.lit(0)))
    return each.select("frame_id", "band", key.alias("key"))


def band_pairs(frames: DataFrame) -> DataFrame:
    """a < b that share a band: candidates, of which some are missed; masked_pairs does not use them."""
    k = band_keys(frames)
    return k.select(F.col("frame_id").alias("a"), "band", "key").join(k.select(F.col("frame_id").alias("b"), "band", "key"), ["band", "key"]).where("a < b").select("a", "b").distinct()


def _scored(frames: DataFrame, pairs: DataFrame, least: float, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, -1) for c in ("x", "y"))
            got = [masked_scores(x[k : k + 1], y[k : k + 1]) for k in range(len(x))]
            z, n = np.array([g[0][0, 0] for g in got]), np.array([g[1][0, 0] for g in got], np.int64)
            keep = pa.array((z >= least) & (n >= overlap))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(z, pa.float64()), pa.array(n)], names=["a", "b", "z", "n"]).filter(keep)

    t = frames.select("frame_id", "tile")
    joined = pairs.join(t.toDF("a", "x"), "a").join(t.toDF("b", "y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, z double, n long")


def scene_scores(pixels: DataFrame) -> DataFrame:
    """scene, a, b, n, z of all pairs within a scene, by aggregates over the pixels that both have valid."""
    v = pixels.where(F.col("v").between(LO, HI))
    x = v.select("scene", "p", F.col("frame_id").alias("a"), F.col("v").alias("x"))
    y = v.select("scene", "p", F.col("frame_id").alias("b"), F.col("v").alias("y"))
    s = x.join(y, ["scene", "p"]).where("a < b").groupBy("scene", "a", "b").agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(k) for k, e in {"sx": F.col("x"), "sy": F.col("y"), "sxy": F.col("x") * F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y")}.items()))
    c = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    d = F.sqrt(F.greatest(F.lit(0.0), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))) * F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")))
    return s.select("scene", "a", "b", "n", F.when(F.col("n") < 2, -1.0).otherwise(c / (d + 1e-9)).alias("z"))


def top_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, other, rank, sim: the k vectors of the highest dot product, itself left out; ties go to the smaller id.

    The vectors are blocks of a matrix; each pair of blocks gives every row's k best, which are merged by a window."""
    blocks = 16

    def run(both: pa.Table) -> pa.Table:
        side = both.column("side").to_numpy()
        left, right = both.take(np.flatnonzero(side == 0)), both.take(np.flatnonzero(side == 1))
        if not left.num_rows or not right.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        a, b = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        sim = np.array(left.column("v").to_pylist(), float) @ np.array(right.column("v").to_pylist(), float).T
        sim[a[:, None] == b[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(b, sim.shape), -np.round(sim, 9)))[:, : k + 1]
        i = np.repeat(np.arange(len(a)), order.shape[1])
        j = order.ravel()
        keep = np.isfinite(sim[i, j])
        return pa.table({"vec_id": a[i[keep]], "other": b[j[keep]], "sim": sim[i, j][keep]})

    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.pmod(F.hash("vec_id"), F.lit(blocks)).alias("own"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    each = v.withColumn("o", F.explode(others))
    left = each.select(F.col("own").alias("i"), F.col("o").alias("j"), F.lit(0).alias("side"), "vec_id", "v")
    right = each.select(F.col("o").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "vec_id", "v")
    best = left.unionByName(right).groupBy("i", "j").applyInArrow(run, "vec_id long, other long, sim double")
    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 9)), "other")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def forest_levels(vectors: DataFrame, level, block: int = 2000) -> DataFrame:
    """a, b, level of a maximum spanning forest of all vectors by level(dot product), an array of whole numbers; pairs
    under 0 are no edges. Vectors are linked at a level by the same components as by all pairs of that level or more.

    Each pair of blocks gives its own forest, as an edge that closes a cycle there is not needed in the whole; forests are
    merged in some tasks and then in one, which holds an edge for each vector."""
    blocks = max(2, -(-vectors.count() // block))

    def grown(both: pa.Table) -> pa.Table:
        ids, v = both.column("vec_id").to_numpy(), _matrix(both.column("v"))
        near, via, out = np.full(len(ids), -1), np.zeros(len(ids), np.int64), []
        left, at = np.ones(len(ids), bool), 0
        for _ in range(len(ids)):
            left[at] = False
            got = level(v @ v[at])
            closer = left & (got > near)
            near[closer], via[closer] = got[closer], at
            at = int(np.argmax(np.where(left, near, -2)))
            if near[at] >= 0 and left[at]:
                out.append((ids[via[at]], ids[at], near[at]))
        a, b, k = np.array(out, np.int64).reshape(-1, 3).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "level": k})

    def merged(edges: pa.Table) -> pa.Table:
        edges = edges.sort_by([("level", "descending"), ("a", "ascending"), ("b", "ascending")])
        root, keep = {}, []

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
            p, q = find(a), find(b)
            keep.append(p != q)
            root[p] = q
        return edges.filter(pa.array(keep, pa.bool_())).select(["a", "b", "level"])

    kind = "a long, b long, level long"
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("own"))
    each = v.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("o <> own")
    each = each.select(F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "vec_id", "v").repartition(min(2000, blocks * (blocks - 1) // 2), "i", "j")
    forests = each.groupBy("i", "j").applyInArrow(grown, kind)
    some = forests.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(16))).groupBy("part").applyInArrow(merged, kind)
    return some.withColumn("part", F.col("level") * 0).groupBy("part").applyInArrow(merged, kind)
