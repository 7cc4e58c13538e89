"""Exact Jaccard self-join on 5-word shingles, and the groups that its links form.

Equal sets are one class; only one document of each goes on. Classes meet on a shingle of their prefixes (the rarest
20 % of a set must hold one that both have, if the Jaccard similarity is 0.8 or more), within bands of sizes that can
link at all. For such pairs, hashed bitmaps bound the overlap from above; the sorted arrays decide the rest.
Rarity is read from a table of hashed counters: it only fixes one order of all shingles, the same for every document,
so a collision moves a shingle in that order and never loses a link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import ASCII_LOWER, salt, saved, sliced, spread_over, table, texts, tidy

SHINGLE, PERCENT = 5, 80
MIN_BITS = 512
#: log2 of the hashed counters that order shingles by rarity (a byte each when broadcast), and the blocks they are added up in.
SLOT_BITS, BLOCKS = 24, 64
#: Documents from which on a shingle (or those that share its counter, above their mean) is met through components only.
HOT = 64
#: Members of a common shingle's documents that all others of other components are compared with first.
PIVOTS = 8
#: Shingles of a document on which it is first compared with one other document each.
FIRST_KEYS = 4
#: Bits for an involved document in the filter that is sent to the scan; beyond FILTER_BYTES all documents' arrays are joined.
FILTER_BITS, FILTER_BYTES = 12, 64 << 20
#: Tasks that the documents of one shingle are spread over where they meet its pivots or its main component.
SALTS = 16

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, kept for each worker; starts afresh when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: A random number for each byte (capitals as small letters, white space none); powers by which places in a word count.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _C1)[np.frombuffer(ASCII_LOWER, np.uint8)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[_SPACE] = 0
_PIECE = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _powers(n: int, kept: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006  kept from call to call
    if len(kept[0]) < n:
        kept[0] = np.cumprod(np.append(np.uint64(1), np.full(2 * n, _C2)), dtype=np.uint64)
    return kept[0]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z; long texts in pieces cut at white space."""
    parts, at = [], 0
    while len(text) - at > _PIECE and (cut := _WHITE.search(text, at + _PIECE // 2)):
        parts.append(_hash_words(text[at : cut.end()]))
        at = cut.end()
    return np.concatenate([*parts, _hash_words(text[at:])])


def _hash_words(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    space = _SPACE[b]
    starts = np.flatnonzero(np.concatenate([[True], space[:-1]]) & ~space) if len(b) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    first = starts[0]
    spans = np.diff(np.append(starts, len(b)))
    place = np.arange(len(b) - first) - np.repeat(starts - first, spans)
    return _mix(np.add.reduceat(_BYTES[b[first:]] * _powers(int(spans.max()))[place], starts - first))


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none give none."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    m = min(k, n)
    x = _mix(w[: n - m + 1] + np.uint64(int(_C1) * m % 2**64))
    for j in range(1, m):
        x = _mix((x ^ (x << np.uint64(1))) + w[j : n - m + 1 + j])
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


def links(inter: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def bitmap(x: np.ndarray) -> bytes:
    """At least twice as many bits as shingles, by powers of two: a longer one folds onto a shorter one."""
    size = max(MIN_BITS, 1 << (2 * len(x) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(x >> np.uint64(20)).astype(np.int64) & (size - 1)] = True
    return np.packbits(bits).tobytes()


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ."""
    lx, ly = np.array([len(b) for b in x]), np.array([len(b) for b in y])
    out = np.empty(len(x), np.int64)
    for a, b in set(zip(lx.tolist(), ly.tolist(), strict=True)):
        at, m = np.flatnonzero((lx == a) & (ly == b)), min(a, b)
        p, q = (np.bitwise_or.reduce(np.frombuffer(b"".join(z[i] for i in at), np.uint64).reshape(len(at), -1, m // 8), axis=1) for z in (x, y))
        out[at] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return out


def slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix(x: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which two linked sets share one, rare first, then by hash; and their levels of rarity."""
    lv = levels[slot(x)]
    order = np.argsort(lv, kind="stable")[: len(x) - -(-percent * len(x) // 100) + 1]
    return x[order], lv[order]


def level_of(count: np.ndarray) -> np.ndarray:
    """Eight levels for each doubling of a count."""
    return np.minimum(8 * np.log2(1.0 + count), 255).astype(np.uint8)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp of every row, and of each task its counters of distinct sets' shingles, block by block."""
    import xxhash
    import zstandard

    names = ["doc_id", "n", "fp", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hold, held, counters = set(), [], 0, np.zeros(1 << SLOT_BITS, np.uint8)

        def add() -> None:
            at, c = np.unique(slot(np.concatenate(hold)), return_counts=True)
            counters[at] = np.minimum(counters[at] + c, 255)

        for batch in sliced(batches):
            ns, fps = [], []
            for t in texts(batch):
                x = shingles(t)
                fp = xxhash.xxh3_128_digest(x.tobytes())
                ns.append(len(x))
                fps.append(fp)
                if fp not in seen and len(x):
                    seen.add(fp)
                    hold.append(x)
                    held += len(x)
                    if held > 1_000_000:
                        add()
                        hold, held = [], 0
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if hold:
            add()
        if seen:
            packed = [zstandard.ZstdCompressor(level=1).compress(b.tobytes()) for b in counters.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.binary()), pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n long, fp binary, block int, counts binary")


def _levels(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Each counter's level over all tasks, and the level from which on shingles are hot. Fixed in size: a byte for each counter."""
    import zstandard

    size = (1 << SLOT_BITS) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unpack = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for k, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if k not in own:
                    own[k] = np.zeros(size, np.int64)
                own[k] += np.frombuffer(unpack.decompress(c), np.uint8)
        for k, c in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level_of(c).tobytes()], pa.binary()), pa.array([int(c.sum())], pa.int64())], names=["block", "levels", "total"])

    got = sets.where("block is not null").select("block", "counts").repartition("block").mapInArrow(tidy(run), "block int, levels binary, total long").toArrow()
    out = np.zeros((BLOCKS, size), np.uint8)
    for k, c in zip(got.column("block").to_pylist(), got.column("levels").to_pylist(), strict=True):
        out[k] = np.frombuffer(c, np.uint8)
    mean = sum(got.column("total").to_pylist()) / (1 << SLOT_BITS)
    return out.ravel(), int(level_of(np.array(HOT + 2 * mean)))


def _classes(docs: DataFrame, levels, hot: int) -> DataFrame:
    """fp, n, bits, first, keys (prefix), late (of these, the common ones' start): once a task for each set."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv, seen = np.frombuffer(levels.value, np.uint8), set()
        for batch in sliced(batches):
            rows = []
            for t in texts(batch):
                x = shingles(t)
                if not len(x) or (fp := xxhash.xxh3_128_digest(x.tobytes())) in seen:
                    continue
                seen.add(fp)
                p, own = prefix(x, lv)
                rows.append((fp, len(x), bitmap(x), x[:FIRST_KEYS].tobytes(), p.tobytes(), int(np.searchsorted(own, hot))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["fp", "n", "bits", "first", "keys", "late"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "fp binary, n long, bits binary, first binary, keys binary, late int")


def _first_keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x, np.int64) for x in batch.column("first").to_pylist()]
            if each:
                k = np.array([len(x) for x in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), pa.array(np.repeat(batch.column("id").to_numpy(), k)), pa.array(np.repeat(batch.column("n").to_numpy(), k))], names=["h", "id", "n"])

    return classes.select("first", "id", "n").mapInArrow(tidy(run), "h long, id long, n long")


def _postings(classes: DataFrame) -> DataFrame:
    """h, id, n, comp, place (how many shingles of the set come earlier in the order), hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                each = [np.frombuffer(x, np.int64) for x in b.column("keys").to_pylist()]
                n, k = b.column("n").to_numpy(), np.array([len(x) for x in each])
                place = np.concatenate([np.arange(m) for m in k])
                hot = place >= np.repeat(b.column("late").to_numpy(), k)
                cols = [np.concatenate(each), *(np.repeat(b.column(c).to_numpy(), k) for c in ("id", "n", "comp")), place.astype(np.int32), hot]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "id", "n", "comp", "place", "hot"])

    return classes.select("keys", "id", "n", "comp", "late").mapInArrow(tidy(run), "h long, id long, n long, comp long, place int, hot boolean")


def _tiles(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of different comps that share a rare prefix shingle, and may link by their sizes and its places: of two
    linked sets' first common shingle no more comes later than what they have in common. Rows come sorted by h and n."""

    def pairs(h: np.ndarray, id_: np.ndarray, n: np.ndarray, comp: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        edge = np.flatnonzero(np.diff(h)) + 1
        starts, ends = np.append(0, edge), np.append(edge, len(h))
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        out = []
        for s, e in zip(starts[mixed], ends[mixed], strict=True):
            for i in range(s, e - 1):  # the smaller set
                if (100 + PERCENT) * (n[i] - place[i]) >= 2 * PERCENT * n[i]:
                    top = s + np.searchsorted(n[s:e], 100 * n[i] // PERCENT, side="right")
                    j = np.arange(i + 1, top)
                    j = j[(comp[j] != comp[i]) & ((100 + PERCENT) * np.minimum(n[i] - place[i], n[j] - place[j]) >= PERCENT * (n[i] + n[j]))]
                    if len(j):
                        out.append(np.stack([np.minimum(id_[i], id_[j]), np.maximum(id_[i], id_[j])]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "id", "n", "comp", "place")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.searchsorted(cols[0], cols[0][-1], side="left")
            rest = [c[last:] for c in cols]
            if last and (found := pairs(*(c[:last] for c in cols))):
                yield _pairs_batch(found)
        if rest is not None and len(rest[0]) and (found := pairs(*rest)):
            yield _pairs_batch(found)

    rare = postings.where("not hot").select("h", "id", "n", "comp", "place")
    return rare.repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(tidy(run), "a long, b long").distinct()


def _pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _mixed(postings: DataFrame) -> DataFrame:
    """The postings of common shingles whose documents are of more than one comp."""
    hot = postings.where("hot")
    mixed = hot.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    return saved(hot.join(mixed, "h", "left_semi"), "hot-postings")


def _met(x: DataFrame, others: DataFrame, spread: bool = False) -> DataFrame:
    """Pairs (a, b) of x (h, x, xn, xc, xp) and others that share h, of different comps, of sizes and places that can link.
    With ``spread`` others are few a shingle, and x is dealt over tasks by salts."""
    later = F.least(F.col("n") - F.col("place"), F.col("xn") - F.col("xp"))
    fit = (F.col("xc") != F.col("comp")) & (100 * F.least("n", "xn") >= PERCENT * F.greatest("n", "xn")) & ((100 + PERCENT) * later >= PERCENT * (F.col("n") + F.col("xn")))
    both = x.withColumn("__salt", salt(SALTS, "x")).join(spread_over(others, SALTS), ["h", "__salt"]) if spread else x.join(others, "h")
    return both.where(fit).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def _as_x(postings: DataFrame) -> DataFrame:
    return postings.select("h", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc"), F.col("place").alias("xp"))


def _main(mixed: DataFrame) -> DataFrame:
    """The comp that most of a common shingle's documents are of."""
    return mixed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m")).select("h", F.col("m.comp").alias("main"))


def _with_main(mixed: DataFrame) -> DataFrame:
    return mixed.withColumn("__salt", salt(SALTS, "id")).join(spread_over(_main(mixed), SALTS), ["h", "__salt"]).drop("__salt")


def _pivot_pairs(mixed: DataFrame) -> DataFrame:
    """A few documents of each common shingle's main comp, the same ones wherever they can be, meet those of other comps."""
    own = _with_main(mixed)
    row = F.struct("id", "n", "comp", "place")
    pivots = own.where("comp = main").groupBy("h", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("k")).agg(F.min_by(row, F.xxhash64("id")).alias("p")).select("h", "p.*")
    return _met(_as_x(own.where("comp <> main")), pivots, spread=True)


def _hot_pairs(mixed: DataFrame) -> DataFrame:
    """Of each common shingle's documents those outside its main comp meet all those of other comps."""
    return _met(_as_x(_with_main(mixed).where("comp <> main")), mixed)


def _possible(pairs: DataFrame, lite: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow a link: the overlap is at most half of the sizes' sum less the bits that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                na, nb = batch.column("n").to_numpy(), batch.column("n2").to_numpy()
                differ = differing(batch.column("bits").to_pylist(), batch.column("bits2").to_pylist())
                most = np.minimum((na + nb - differ) // 2, np.minimum(na, nb))
                yield batch.select(["a", "b"]).filter(pa.array(100 * most >= PERCENT * (na + nb - most)))

    left = lite.select(F.col("id").alias("a"), "n", "bits")
    right = lite.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "n2", "bits", "bits2").mapInArrow(tidy(run), "a long, b long")


def _filter(slots: DataFrame, size: int) -> bytes:
    """A bit for each of size slots, lowest first in a byte: set if it is in slots (s). Tasks make blocks of it; the driver
    gets the bits only, size / 8 bytes at most, never the rows."""
    block = 1 << 19

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {}
        for batch in batches:
            s = batch.column("s").to_numpy()
            for k in np.unique(s // block).tolist():
                own.setdefault(k, np.zeros(block, bool))[s[s // block == k] % block] = True
        for k, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    got = slots.repartition(F.expr(f"s div {block}")).mapInArrow(tidy(run), "block long, bits binary").toArrow()
    out = np.zeros((-(-size // block), block // 8), np.uint8)
    for k, bits in zip(got.column("block").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[k] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link by their exact sets, which are made anew for the documents involved only."""
    spark = docs.sparkSession
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    size = max(1024, FILTER_BITS * ids.count())
    sent = spark.sparkContext.broadcast(_filter(ids.select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("s")), size)) if size // 8 <= FILTER_BYTES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(sent.value, np.uint8) if sent else None
        for batch in batches:
            if flags is not None:
                s = batch.column("s").to_numpy()
                batch = batch.filter(pa.array(flags[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1))
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t).tobytes() for t in texts(b)], pa.binary())], names=["id", "x"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).where("id is not null")
    arrays = own.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(size))).mapInArrow(tidy(run), "id long, x binary")
    joined = pairs.join(arrays.withColumnRenamed("id", "a"), "a").join(arrays.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each one reaches. Labels spread along edges and from label to label until none
    changes, so chains take few rounds. Every round is written to the shared folder."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("on"))
        new = saved(step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("on", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if not new.where("was <> label").limit(1).count():
            return labels


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Documents without words are linked with nothing. Rows that share a doc_id count as one node; rows without doc_id
    link with nothing and have no component_id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sets = saved(_sets(docs), "sets")
    rows = sets.where("block is null").select("doc_id", "n", "fp")
    levels, hot = _levels(sets)
    sent = spark.sparkContext.broadcast(levels.tobytes())

    own = rows.where("n > 0 and doc_id is not null")
    ids = own.groupBy("fp").agg(F.min("doc_id").alias("id"))
    once = _classes(docs, sent, hot).groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "bits", "first", "keys", "late")))
    classes = saved(once.join(ids, "fp").drop("fp"), "classes")
    lite = classes.select("id", "n", "bits")

    keys = _first_keys(classes)
    pivots = keys.groupBy("h").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "p")
    stars = keys.withColumn("__salt", salt(SALTS, "id")).join(spread_over(pivots, SALTS), ["h", "__salt"]).where("id <> p").select(F.col("p").alias("a"), F.col("id").alias("b")).distinct()
    first = saved(_verified(docs, saved(_possible(stars, lite), "first-pairs")), "first-links")

    def marked(links_: DataFrame) -> DataFrame:
        comp = components(links_).select(F.col("id").alias("c_id"), F.col("label").alias("comp"))
        return _postings(classes.join(comp, F.col("id") == F.col("c_id"), "left").drop("c_id").withColumn("comp", F.coalesce("comp", "id")))

    second = saved(_possible(_pivot_pairs(_mixed(marked(first))), lite).join(first, ["a", "b"], "left_anti"), "second-pairs")
    found = saved(first.union(_verified(docs, second)), "found-links")
    postings = marked(found)
    more = _possible(_tiles(postings).union(_hot_pairs(_mixed(postings))).distinct(), lite)
    more = saved(more.join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"), "more-pairs")
    edges = found.union(_verified(docs, more))
    # copies: each row's node is linked to its class
    copied = own.groupBy("fp").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("most")).where("id <> most").select("fp", "id")
    same = own.withColumn("__salt", salt(SALTS, "doc_id")).join(spread_over(copied, SALTS), ["fp", "__salt"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    labels = components(edges.union(same))
    return rows.join(labels.withColumnRenamed("id", "l_id"), F.col("doc_id") == F.col("l_id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs but those whose group has a smaller doc_id; of rows that share a doc_id all stay or go."""
    gone = groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM d),
e AS (SELECT DISTINCT doc_id, g, len(g) AS n FROM s),
x AS (SELECT doc_id, n, md5(unnest(g)) AS h FROM e),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, reach) AS (SELECT doc_id, doc_id FROM e UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT node, min(reach) AS c FROM r GROUP BY node)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN m ON doc_id = node
"""
