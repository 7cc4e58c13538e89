"""Best-fit packing of token sequences: large-item matching, then best fit of the rest.

Lengths are whole numbers from 1 to the capacity, so a plan depends on the histogram of lengths alone. The driver holds
that histogram (at most ``capacity`` rows) and a plan of runs "n documents of length L go to bins b, b+1, ...". No
document is looked at singly on the driver and the work there does not grow with the number of documents.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bracketry.llm.common import saved, table, texts, tidy

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Distinct chunks of text whose ids a worker keeps; beyond that they make way for new ones, unless met again.
CACHED = 250_000

#: A chunk ends where a single blank goes before the next word. The tokenizer's own pattern never crosses such a place,
#: so chunks can be encoded alone. White space is Unicode's property White_Space.
_WS = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: These two parts are always cut apart, and each is merged as one piece if the first has letters only.
WORD_THEN_MARKS = re.compile(r"( ?[^\W\d_]+)([^\w\s]+)")

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
)


class Ids(dict):
    """Chunk -> its ids as bytes, filled as chunks come up. The ids are those of the `tokenizers` file; if that file is a
    byte-level BPE whose merges are in the order of its ids, tiktoken's faster merging is used with the same vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.fast = _ranked(path)
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()
        if found := self.older.get(chunk):
            self[chunk] = found
            return found
        if not self.fast:
            ids = array("I", self.encoder.encode(chunk, add_special_tokens=False).ids).tobytes()
        elif chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            ids = array("I", self.fast._core_bpe.encode_single_piece(chunk.encode())).tobytes()
        elif (m := WORD_THEN_MARKS.fullmatch(chunk)) and (word := m[1])[1:].isalpha():
            ids = self[word] + array("I", self.fast._core_bpe.encode_single_piece(m[2].encode())).tobytes()
        else:
            ids = array("I", self.fast.encode_ordinary(chunk)).tobytes()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One cache for each worker process and tokenizer."""
    return _loaded.get(path) or _loaded.setdefault(path, Ids(path))


def _ranked(path: str):
    """The file's vocabulary for tiktoken, or None if it isn't of that kind."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    before = model.get("pre_tokenizer") or {}
    if model["model"]["type"] != "BPE" or model.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(pairs)):
        return None
    # fixed values: byte-level BPE writes the bytes below as themselves and the others, in order, from U+0100 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    specials = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in specials}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(text: str, ids: Ids) -> bytes:
    """The ids of a whole text as unsigned little-endian 32-bit numbers, without the end id."""
    return b"".join(map(ids.__getitem__, CHUNK.findall(text)))


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all are full but the first, which takes the remainder."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece with its crc and the number of pieces of that length which the same task saw before (nth).

    Null text: empty, that is the end id alone. Repeated rows each give their own pieces; doc_id may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, task = ids_of(tokenizer or tokenizer_path()), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                whole = encode(text.decode("utf-8", "replace"), ids) + end
                for k, (start, length) in enumerate(cut(len(whole) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), task, int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(PIECES), PIECES, strict=True)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, first bin, bins, each, offset): ranks of that length fill the bins one after another, `each` to a bin from the offset on.

    Items over a third of the capacity go at most two to a bin. They are matched greedily, the largest first, each with
    the largest one that fits, which gives as many pairs as there can be. Smaller items follow, the longest first, each
    length into the tightest gaps that take it. New bins are opened only if no gap does.
    """
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs, bins = [], 0
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first bin, bins, offset]
    order: list[int] = []  # gaps in ascending order

    def take(n: int, count: int, first: int, over: int, each: int, offset: int) -> None:
        runs.append((n, used[n], first, over, each, offset))
        used[n] += count
        left[n] -= count

    def opened(first: int, over: int, offset: int) -> None:
        gap = capacity - offset
        if over and gap:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append([first, over, offset])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        partner = large[at] if at >= 0 else 0
        if not partner:
            count, first = left[n], bins
            take(n, count, first, count, 1, 0)
            bins += count
            opened(first, count, n)
        elif partner == n:
            count, first = left[n] // 2, bins
            if count:
                take(n, 2 * count, first, count, 2, 0)
            if left[n]:
                # an odd one stays: it may still pair with a smaller one
                large.pop(at)
                at = bisect_left(large, capacity - n + 1) - 1
                while at >= 0 and not left[large[at]]:
                    large.pop(at)
                    at -= 1
                bins += count
                opened(first, count, 2 * n)
                take(n, 1, bins, 1, 1, 0)
                if at >= 0:
                    take(large[at], 1, bins, 1, 1, n)
                    opened(bins, 1, n + large[at])
                else:
                    opened(bins, 1, n)
                bins += 1
            else:
                bins += count
                opened(first, count, 2 * n)
        else:
            count, first = min(left[n], left[partner]), bins
            take(n, count, first, count, 1, 0)
            take(partner, count, first, count, 1, n)
            bins += count
            opened(first, count, n + partner)

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    take(n, full * each, bins, full, each, 0)
                    opened(bins, full, each * n)
                    bins += full
                if rest:
                    take(n, rest, bins, 1, rest, 0)
                    opened(bins, 1, rest * n)
                    bins += 1
                continue
            gap = order[at]
            first, over, offset = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // n
            full = min(over, left[n] // each)
            if full:
                take(n, full * each, first, full, each, offset)
                opened(first, full, offset + each * n)
            if full < over and left[n]:
                rest = left[n]
                take(n, rest, first + full, 1, rest, offset)
                opened(first + full, 1, offset + rest * n)
                full += 1
            opened(first + full, over - full, offset)
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Pieces are written once without their text. A piece's rank among those of its length is its number in its task plus
    the pieces in earlier tasks, so no length, however frequent, meets in one task. Empty input gives no rows; ties
    between equal lengths go by task and place, which the written table fixes.
    """
    spark = docs.sparkSession
    cut_up = saved(pieces(docs, capacity, tokenizer, end_id), "pieces")
    by_task = cut_up.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    base = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("length", "task", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").count().withColumnRenamed("count", "n").collect()}  # at most `capacity` rows
    runs = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = spark.sparkContext.broadcast(runs.tobytes())  # bounded by the number of lengths, not of documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = np.frombuffer(sent.value, np.int64).reshape(-1, 6)
        keys = runs[:, 0] << 45 | runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            if not len(length):
                continue
            n, first_rank, first, _, each, offset = runs[np.searchsorted(keys, length << 45 | rank, side="right") - 1].T
            bin_, slot = np.divmod(rank - first_rank, each)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first + bin_), pa.array(offset + slot * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut_up.join(base, ["length", "task"]).mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
