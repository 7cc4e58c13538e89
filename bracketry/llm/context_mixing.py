"""Language model scoring by logistic context mixing.

A text is scored as running text. Its tokens and an end are symbols of a Huffman code made from the training counts, so a
frequent token costs few binary decisions; a rare token is an escape and then its spelling. Each decision of the running
text is predicted by hashed contexts that reach across tokens (the last very frequent token, the token before, the two
tokens before) and by a match: what followed the last place in the same text with
the same two tokens before. Each bit of a spelling is predicted by hashed contexts of 1 to 4 bytes before and of the whole
word so far. The stretched predictions are added up with weights chosen by a gate (the match's length, how much two of the
contexts have seen), and adaptive maps refine the result.

Statistics cover all training texts. A task goes through its texts online: it predicts a block with what it has counted so
far, corrects weights and maps, then counts the block. The tasks' counts are added up, and their weights averaged by what
each has seen. Spellings are learned from all rare training tokens, by their number, and scored once a distinct word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import ASCII_LOWER, remainder, saved, table, texts, tidy
from bracketry.llm.jaccard_join import _mix

END = b"\n"
ESCAPE, STOP, FIRST = 0, 1, 2
#: A token is a symbol of its own if it is at least one in 2**RARE_BITS of all training tokens (and met twice), so there are
#: at most 2**RARE_BITS of them at any size.
RARE_BITS = 20
#: The most frequent tokens, the last of which is a context.
MARKERS = 32
#: Least and most log2 of the slots of a hashed table. Between them there are two slots or more a distinct token.
LEAST_BITS, MOST_BITS = 16, 22
#: log2 of the slots of the spelling's tables: 1, 2, 3 and 4 bytes before, and the word so far.
SPELL_BITS = (16, 20, 20, 20, 20)
#: Bytes (in whole texts) whose contexts are made at once, and decisions that are handled at once. Weights are corrected
#: after as many, at first after LEAST_STEP, then after a 32nd of those seen so far.
BLOCK, STEP, LEAST_STEP = 1 << 19, 1 << 16, 1 << 11
#: Bytes (in whole texts) whose tokens are counted at once.
COUNTED = 1 << 23
#: Half of what a count of 16 bits may grow by within a step; from here on a part of it is kept apart.
FULL = 1 << 15
#: Levels of the code whose counts for a context lie side by side.
GROUP = 4
CHUNK = 1 << 16
_C1, _C2, _C3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x2C1B3C6D)
#: ASCII_LOWER with white space as blanks; masks of the first bytes of a number.
_PLAIN = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in ASCII_LOWER)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed by themselves.
_LONG = 64


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(ASCII_LOWER).split(), END]


def _hashes(whole: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, none of which reaches into the last eight."""
    size = end - start
    eight = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
    h = _mix((eight[start] & _FIRST.take(np.minimum(size, 8))) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(size > 8)
    for k in range(8, _LONG, 8):
        h[at] = _mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[at] + k] & _FIRST.take(np.minimum(size[at] - k, 8))))
        at = at[size[at] > k + 8]
    if len(at):
        import xxhash

        for k in at.tolist():
            h[k] = xxhash.xxh3_64_intdigest(whole[start[k] : end[k]])
    return h


def hashes(words: list[bytes]) -> np.ndarray:
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return _hashes(b"".join(words) + b" " * 8, np.append(0, end)[:-1], end)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text as bytes with a blank before it, in small letters; of its words the starts and ends there, and hashes()."""
    whole = b" " + text.translate(_PLAIN) + b" " * 8
    b = np.frombuffer(whole, np.uint8)
    blank = b == 32
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    return b, start, end, _hashes(whole, start, end)


def joined(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As hashed() of all texts at once, and the number of words in each."""
    b, start, end, h = hashed(b"\n".join(texts_))
    until = np.cumsum(np.fromiter(map(len, texts_), np.int64, len(texts_)) + 1)
    return b, start, end, h, np.diff(np.searchsorted(start, until + 1), prepend=0)


def table_bits(distinct: int) -> int:
    """log2 of a table's slots for so many distinct training tokens."""
    return min(max(LEAST_BITS, (2 * distinct - 1).bit_length() if distinct else 0), MOST_BITS)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The stretched prediction, in the place of ``n1``; ``n0`` is spent too."""
    n0 += np.float32(0.3)
    n1 += np.float32(0.3)
    n1 /= n0
    return np.log(n1, out=n1)


def level(n: np.ndarray) -> np.ndarray:
    """0 to 7, how much has been seen: the whole part of log2(n + 1), from the exponent of a number between n + 1 and n + 2."""
    exponent = (np.asarray(n, np.float32) + np.float32(1.25)).view(np.int32) >> np.int32(23)
    exponent -= np.int32(127)
    return np.minimum(exponent, np.int32(7), out=exponent)


def coded(n: np.ndarray) -> np.ndarray:
    """Rows (n0, n1) as a stretched prediction in 13 bits and a level in 3."""
    n = np.asarray(n, np.float64)
    x = np.log(n[:, 1] + 0.3) - np.log(n[:, 0] + 0.3)
    return (np.round((np.clip(x, -15.9, 15.9) + 16) * 256).astype(np.uint16) << 3 | level(n.sum(axis=1)).astype(np.uint16)).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    """Of numbers from coded() the predictions."""
    x = (codes >> np.uint16(3)).view(np.int16).astype(np.float32)
    x *= np.float32(1 / 256)
    x -= np.float32(16)
    return x


class Code:
    """A Huffman code: of each symbol the decisions (node and bit) that lead to it. Nodes are numbered from the root on,
    the heavier first."""

    def __init__(self, counts: np.ndarray):
        m = len(counts)
        order = np.argsort(counts, kind="stable")
        weight = [int(counts[k]) for k in order]
        leaf, inner, up, side = 0, m, [0] * (2 * m - 1), [0] * (2 * m - 1)
        for k in range(m, 2 * m - 1):
            got = []
            for b in (0, 1):
                if leaf < m and (inner >= k or weight[leaf] <= weight[inner]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, inner = inner, inner + 1
                up[at], side[at] = k, b
                got.append(weight[at])
            weight.append(sum(got))
        up, side, root = np.array(up), np.array(side, np.uint8), 2 * m - 2
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        size, at = np.zeros(m, np.int64), place
        while (live := at != root).any():
            size += live
            at = np.where(live, up[at], at)
        self.start, self.size = np.cumsum(size) - size, size
        self.lines = -(-int(size.max()) // GROUP)  # of the longest path
        self.node, self.bit = np.empty(int(size.sum()), np.int32), np.empty(int(size.sum()), np.uint8)
        at, to, left = place, self.start + size - 1, np.ones(m, bool)
        while (left := (at != root)).any():
            self.node[to[left]], self.bit[to[left]] = root - up[at[left]], side[at[left]]
            at, to = np.where(left, up[at], at), to - 1
        # nodes of GROUP levels share a line of the tables: the line's first node, and the place in the line
        start = np.repeat(self.start, size)
        depth = np.arange(len(self.node)) - start
        first, place = start + depth // GROUP * GROUP, np.ones(len(depth), np.uint32)
        for k in range(GROUP - 1):
            on = depth % GROUP > k
            place[on] = 2 * place[on] + self.bit[first[on] + k]
        # of a decision at once: the line's salt (32 bits), the context of the maps (8), the place in the line, the bit
        salt = (self.node[first].astype(np.uint32) + np.uint32(1)) * _C1
        context = np.minimum(self.node, Mixer.MAPS - 1).astype(np.uint64)
        self.facts = salt.astype(np.uint64) << np.uint64(32) | context << np.uint64(8) | place.astype(np.uint64) << np.uint64(1) | self.bit.astype(np.uint64)

    @cached_property
    def salt(self) -> np.ndarray:
        return (self.facts >> np.uint64(32)).astype(np.uint32)

    @cached_property
    def within(self) -> np.ndarray:
        return (self.facts & np.uint64(255)).astype(np.uint32) >> np.uint32(1)


class Mixer:
    """Weights by gate and adaptive maps by context."""

    KNOTS, GATES, MAPS = 49, 256, 256

    def __init__(self, inputs: int):
        self.w = np.full((inputs + 1, self.GATES), 0.35, np.float32)
        self.w[-1] = 0
        self.square = np.full((inputs + 1, self.GATES), 1e-6)
        self.maps = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, self.KNOTS))), (self.MAPS, 1)).astype(np.float32)
        self.w_seen, self.maps_seen = np.zeros(self.GATES), np.zeros(self.maps.shape)

    def mix(self, x: list, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a 1 before maps, and the knot next to it. An input that is mostly 0 may be places and values."""
        z = self.w[-1].take(gate)
        for w, row in zip(self.w, x):
            if isinstance(row, tuple):
                z[row[0]] += w[gate[row[0]]] * row[1]
                continue
            part = w.take(gate)
            part *= row
            z += part
        np.clip(z, -8, 8, out=z)
        p = 1 / (1 + np.exp(-z))
        z += np.float32(8)
        z *= np.float32((self.KNOTS - 1) / 16)
        z += np.float32(0.5)
        return p, z.astype(np.int64)

    def predict(self, x: list[np.ndarray], gate: np.ndarray, context: np.ndarray) -> np.ndarray:
        p, near = self.mix(x, gate)
        near += context * self.KNOTS
        p += self.maps.ravel().take(near)
        p *= np.float32(0.5)
        return p

    def learn(self, x: list[np.ndarray], gate: np.ndarray, context: np.ndarray, bit: np.ndarray, weight: np.ndarray | None = None) -> None:
        p, near = self.mix(x, gate)
        off = bit - p
        if weight is not None:
            off *= weight
        n = np.bincount(gate, weight, self.GATES)
        g = [np.bincount(gate[row[0]], row[1] * off[row[0]], self.GATES) if isinstance(row, tuple) else np.bincount(gate, row * off, self.GATES) for row in x]
        g = np.stack([*g, np.bincount(gate, off, self.GATES)]) / np.maximum(n, 1)
        self.square += g * g
        self.w += (0.1 * g / np.sqrt(self.square)).astype(np.float32)
        self.w_seen += n
        near += context * self.KNOTS
        near <<= 1
        near += bit
        seen = np.bincount(near, weight, 2 * self.maps.size)
        ones, seen = seen[1::2], seen[::2] + seen[1::2]
        met = np.flatnonzero(seen)
        maps, maps_seen, seen = self.maps.ravel(), self.maps_seen.ravel(), seen[met]
        maps[met] += ((ones[met] - seen * maps[met]) / (maps_seen[met].clip(30, 30_000) + seen)).astype(np.float32)
        maps_seen[met] += seen

    def state(self) -> list[bytes]:
        return [self.w.tobytes(), self.maps.tobytes(), self.w_seen.tobytes(), self.maps_seen.tobytes()]


def merged(states: list[list[bytes]], inputs: int) -> Mixer:
    """The mean of what was learned apart, by how much each has seen at a gate or knot; as at the start where none has."""
    out, sums = Mixer(inputs), {}
    for w, maps, w_seen, maps_seen in states:
        for name, value, seen in (("w", w, w_seen), ("maps", maps, maps_seen)):
            n = np.frombuffer(seen).reshape(getattr(out, f"{name}_seen").shape)
            v = np.frombuffer(value, np.float32).reshape(getattr(out, name).shape)
            total, mean = sums.get(name, (0, 0))
            sums[name] = total + n, mean + v * n
    for name, (total, mean) in sums.items():
        setattr(out, name, np.where(total > 0, mean / np.maximum(total, 1e-300), getattr(out, name)).astype(np.float32))
        setattr(out, f"{name}_seen", total)
    return out


def _lined(context: np.ndarray, salt: np.ndarray, within: np.ndarray, bits: int) -> np.ndarray:
    """Slots of a line for each context and group, in an order of its own. Contexts are hashes already."""
    x = context ^ salt
    x *= _C2
    x >>= np.uint32(32 - bits)
    x ^= within
    return x.astype(np.int64)


class Stream:
    """The tokens of some texts as decisions of the code with their contexts, none of which reaches into the text before.
    ``rare`` holds the places of escapes, ``known`` whether the match tells the word; ``h`` their hashes."""

    INPUTS = 4

    def __init__(self, code: Code, symbols: np.ndarray, sizes: np.ndarray, h: np.ndarray):
        self.code, n = code, len(symbols)
        at, self.text = np.arange(n), np.repeat(np.arange(len(sizes)), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.symbols, self.rare = symbols, np.flatnonzero(symbols == ESCAPE)
        id_ = symbols.astype(np.uint64)
        id_[self.rare] = h | np.uint64(1 << 63)
        self.h = h
        mixed = (id_ + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        one, two = (np.where(at - begin >= k, np.roll(mixed, k), np.uint64(k)) for k in (1, 2))
        pair = (one * np.uint64(0xBF58476D1CE4E5B9) + two) * np.uint64(0x94D049BB133111EB)
        last = np.maximum.accumulate(np.where((symbols >= FIRST) & (symbols < FIRST + MARKERS), at, -1))
        last = np.concatenate([[-1], last[:-1]])
        marker = np.where(last >= begin, symbols[last], 0)
        self.contexts = [((c >> np.uint64(32)).astype(np.uint32)) for c in ((marker + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), one * np.uint64(0xD6E8FEB86659FD93), pair)]
        key = pair + self.text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        low = np.uint64(n.bit_length())
        packed = key << low | at.astype(np.uint64)
        packed.sort()
        order = (packed & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
        packed >>= low
        same = packed[1:] == packed[:-1]
        if (key[order[1:][same]] != key[order[:-1][same]]).any():  # keys that differ in their highest bits only
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
        before = np.full(n, -1)
        before[order[1:][same]] = order[:-1][same]
        before[at - begin < 2] = -1
        self.guess = np.where(before >= 0, symbols[before], -1)
        goes_on = np.concatenate([[False], (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)]) if n else np.empty(0, bool)
        run = at - np.maximum.accumulate(np.where(goes_on, 0, at)) if n else at
        self.sure = np.where(before >= 0, 1 + (run >= 3) + (run >= 12), 0)
        told = (self.guess[self.rare] == ESCAPE) if n else np.empty(0, bool)
        self.told, self.known = told, told & (id_[before[self.rare]] == id_[self.rare]) if n else told

    def steps(self, step: Callable[[], int] = lambda: STEP) -> Iterator[tuple]:
        """Some tokens at a time with about as many decisions as asked for each time: the first token, of each token the
        first decision and their number, of each decision the token and the place in the code."""
        size = self.code.size[self.symbols]
        ends = np.cumsum(size)
        most = FULL // self.code.lines  # so that no slot is met more than FULL times
        at = 0
        while at < len(size):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step(), side="right"))
            to = max(at + 1, min(to, at + most))
            n = size[at:to]
            begin = np.cumsum(n) - n
            token = np.repeat(np.arange(at, to), n)
            place = np.arange(len(token))
            place += np.repeat(self.code.start[self.symbols[at:to]] - begin, n)
            yield at, begin, n, token, place
            at = to

    def bits(self, at: int, begin: np.ndarray, n: np.ndarray, token: np.ndarray, place: np.ndarray, size: int) -> tuple:
        """Bit, slots of the tables, the context of the maps of each decision; decisions that a match tells, what it tells
        and how sure it is."""
        facts = self.code.facts.take(place).view("<u4")
        salt, low = facts[1::2].copy(), facts[::2].copy()
        bit = (low & np.uint32(1)).astype(np.uint8)
        within = low >> np.uint32(1)
        within &= np.uint32(127)
        slots = [_lined(c.take(token), salt, within, size) for c in self.contexts]
        x = np.empty(0, np.float32)
        met = np.flatnonzero(self.sure[at : at + len(n)])
        sure = np.repeat(self.sure[at + met], n[met])
        if len(met):
            n = n[met]
            d = np.arange(len(sure)) - np.repeat(np.cumsum(n) - n, n)
            g = np.repeat(self.guess[at + met], n)
            met = np.repeat(begin[met], n) + d
            to = self.code.start[g] + np.minimum(d, self.code.size[g] - 1)
            agrees = (d < self.code.size[g]) & (self.code.node[to] == self.code.node[place[met]])
            x = np.where(agrees, self.code.bit[to] * np.float32(4) - np.float32(2), 0)
            sure *= agrees
        low >>= np.uint32(8)
        return bit, slots, low.astype(np.int64), met, x, sure


class Counts:
    """Numbers of 0 and 1 bits at hashed slots, for learning online, side by side. In 16 bits each, what would be too much is
    kept apart, and what stays is nearly in proportion; a slot must not be met more than FULL times between two looks."""

    def __init__(self, sizes: tuple[int, ...], kind: type = np.uint32):
        self.n = [np.zeros(2 << b, kind) for b in sizes]
        self.both, self.apart = {np.uint16: np.uint32, np.uint32: np.uint64}[kind], [[] for _ in sizes]

    def taken(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[k].view(self.both)
        got = n.take(at)
        if self.both is np.uint32 and np.bitwise_or.reduce(got) & np.uint32(FULL << 16 | FULL):
            slots = np.unique(at[(got & np.uint32(FULL << 16 | FULL)) > 0])
            half = self.n[k].reshape(-1, 2)[slots] >> 1
            self.apart[k].append((slots, half))
            self.n[k].reshape(-1, 2)[slots] -= half
            got = n.take(at)
        if self.both is np.uint32:
            return (got & np.uint32(0xFFFF)).view(np.int32).astype(np.float32), (got >> np.uint32(16)).view(np.int32).astype(np.float32)
        got = got.view(np.uint32)
        return got[::2].astype(np.float32), got[1::2].astype(np.float32)

    def look(self, slots: list[np.ndarray], gates: tuple[int, int], bit: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Stretched predictions of all tables, and of two how much they have seen. Then adds ``bit``, if given, to each table
        while its slots are still in the cache."""
        x, seen = [], {}
        more = None if bit is None else self.more(bit)
        for k, at in enumerate(slots):
            n0, n1 = self.taken(k, at)
            if more is not None:
                np.add.at(self.n[k].view(self.both), at, more)
            if k in gates:
                seen[k] = level(n0 + n1)
            x.append(stretched(n0, n1))
        return x, [seen[k] for k in gates]

    def more(self, bit: np.ndarray) -> np.ndarray:
        more = bit.astype(self.both)
        more *= self.both((1 << 4 * more.itemsize) - 1)
        more += self.both(1)
        return more

    def add(self, slots: list[np.ndarray], bit: np.ndarray, weight: np.ndarray | None = None) -> None:
        more = self.more(bit)
        if weight is not None:
            more *= weight
        for n, at in zip(self.n, slots, strict=True):
            np.add.at(n.view(self.both), at, more)

    def whole(self, k: int) -> np.ndarray:
        n = self.n[k]
        if self.apart[k]:
            n = n.astype(np.uint32)
            for slots, half in self.apart[k]:
                n.reshape(-1, 2)[slots] += half
        return n

    def rows(self) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for k in range(len(self.n)):
            whole = self.whole(k)
            for at in range(0, len(whole), 2 * CHUNK):
                n = whole[at : at + 2 * CHUNK]
                if n.any():
                    kind = np.uint8 if n.max() < 1 << 8 else np.uint16 if n.max() < 1 << 16 else np.uint32
                    yield _row(k, at // (2 * CHUNK), pack.compress(n.astype(kind).tobytes()), len(n) * np.dtype(kind).itemsize, [])


class Tables:
    """What all tasks have counted, coded(), for scoring."""

    def __init__(self, codes: list[np.ndarray]):
        self.codes = codes

    def look(self, slots: list[np.ndarray], gates: tuple[int, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        got = [c.take(at) for c, at in zip(self.codes, slots, strict=True)]
        return [decoded(g) for g in got], [got[k] & np.uint16(7) for k in gates]


_ROWS = "part int, chunk int, n binary, bytes long, state array<binary>"


def _row(part: int, chunk: int, n: bytes, size: int, state: list[bytes]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, chunk, n, size, state), kinds, strict=True)], names=["part", "chunk", "n", "bytes", "state"])


def _gathered(rows: DataFrame, sizes: tuple[int, ...], inputs: int, raw: bool = False) -> tuple[Tables | Counts, Mixer, np.ndarray]:
    """The tables (with ``raw`` the counts) added up over all tasks, the merged mixer, and the sum of the tasks' tallies.
    Their size is bounded by the tables' size, not by the texts."""
    import zstandard

    def add(parts: pa.Table) -> pa.Table:
        part, chunk = parts.column("part")[0].as_py(), parts.column("chunk")[0].as_py()
        size = 2 * min(CHUNK, 1 << sizes[part])
        n, unpack = np.zeros(size), zstandard.ZstdDecompressor()
        for x, b in zip(parts.column("n").to_pylist(), parts.column("bytes").to_pylist(), strict=True):
            n += np.frombuffer(unpack.decompress(x), {1: np.uint8, 2: np.uint16, 4: np.uint32}[b // size])
        out = np.minimum(n, 2**32 - 1).astype(np.uint32) if raw else coded(n.reshape(-1, 2))
        return pa.table({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "n": pa.array([out.tobytes()], pa.binary())})

    stored = saved(rows, "mixing")
    states = [(r["chunk"], r["state"]) for r in stored.where("part < 0").select("chunk", "state").collect()]  # one a task
    states = [s for _, s in sorted(states, key=lambda r: r[0])]
    got = stored.where("part >= 0").groupBy("part", "chunk").applyInArrow(add, "part int, chunk int, n binary").toArrow()
    kind, wide = (np.uint32, 2) if raw else (np.uint16, 1)
    start = coded(np.zeros((1, 2)))[0]
    out = [np.zeros(2 << b, kind) if raw else np.full(1 << b, start, kind) for b in sizes]
    for part, chunk, n in zip(got.column("part").to_pylist(), got.column("chunk").to_pylist(), got.column("n"), strict=True):
        x = np.frombuffer(n.as_buffer(), kind)
        out[part][chunk * CHUNK * wide : chunk * CHUNK * wide + len(x)] = x
    tally = sum((np.frombuffer(s[4]) for s in states), np.zeros(8))
    if not raw:
        return Tables(out), merged([s[:4] for s in states], inputs), tally
    counts = Counts(())
    counts.n = out
    return counts, merged([s[:4] for s in states], inputs), tally


class Index:
    """Symbols by their words' hashes: an open table, in which an empty place is an escape."""

    def __init__(self, h: np.ndarray):
        bits = max(4, (2 * len(h)).bit_length() + 1)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.h, self.symbol = np.zeros(1 << bits, np.uint64), np.full(1 << bits, ESCAPE, np.int32)
        left, at = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(left):
            free = self.symbol[at] == ESCAPE
            self.symbol[at[free]] = left[free] + FIRST
            over = self.symbol[at] != left + FIRST
            self.h[at[~over]] = h[left[~over]]
            left, at = left[over], at[over] + 1 & self.last

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        out = self.symbol.take(at).astype(np.int64)
        left = np.flatnonzero((self.h.take(at) != h) & (out != ESCAPE))
        at = at[left]
        out[left] = ESCAPE
        while len(left):
            at = at + 1 & self.last
            symbol, same = self.symbol[at], self.h[at] == h[left]
            out[left[same]] = symbol[same]
            on = ~same & (symbol != ESCAPE)
            left, at = left[on], at[on]
        return out


class Tokens:
    """The model of the running text: what is broadcast is bounded by RARE_BITS and MOST_BITS."""

    def __init__(self, words: list[bytes], counts: np.ndarray, escapes: int, stops: int, bits: int):
        self.words, self.found = words, Index(hashes(words))
        self.code = Code(np.concatenate([[escapes + 1, stops + 1], counts]).astype(np.int64))
        self.bits = bits

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "index")}

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w: k + FIRST for k, w in enumerate(self.words)} | {END: STOP}

    def stream(self, some: list[list[bytes]]) -> Stream:
        """Of texts as tokens()."""
        flat = [w for words in some for w in words]
        stop = np.array([w == END for w in flat], bool)
        return self._stream(hashes(flat)[~stop], stop, np.array([len(w) for w in some], np.int64))

    def read(self, some: list[bytes]) -> Stream:
        """Of whole texts, each with its end."""
        *_, h, n = joined(some)
        stop = np.zeros(len(h) + len(n), bool)
        stop[np.cumsum(n + 1) - 1] = True
        return self._stream(h, stop, n + 1)

    def _stream(self, h: np.ndarray, stop: np.ndarray, sizes: np.ndarray) -> Stream:
        found = self.found.find(h)
        symbols = np.full(len(stop), STOP, np.int64)
        symbols[~stop] = found
        return Stream(self.code, symbols, sizes, h[found == ESCAPE])


def _inputs(tokens_: Tokens, tables, stream: Stream, step: tuple, count: bool = False) -> tuple:
    bit, slots, context, met, match, sure = stream.bits(*step, tokens_.bits)
    x, (high, low) = tables.look(slots, (2, 1), bit) if count else tables.look(slots, (2, 1))
    high <<= 3
    high |= low
    gate = high.astype(np.int64)
    gate[met] += sure << 6
    return bit, [*x, (met, match)], gate, context


def learn_stream(tokens_: Tokens, counts: Counts, mixer: Mixer, tally: np.ndarray, stream: Stream) -> None:
    """Predicts and counts, corrects weights and maps. The tally is of rare words that a match tells wrongly and rightly, by its sureness."""
    for step in stream.steps(lambda: int(min(max(mixer.w_seen.sum() / 32, LEAST_STEP), STEP))):
        bit, x, gate, context = _inputs(tokens_, counts, stream, step, count=True)
        mixer.learn(x, gate, context, bit)
    sure = stream.sure[stream.rare[stream.told]]
    tally += np.bincount(2 * sure + stream.known[stream.told], minlength=8)


def score_stream(tokens_: Tokens, tables, mixer: Mixer, tally: np.ndarray, stream: Stream) -> np.ndarray:
    """Natural log of the probability of each token's decisions, spellings left out."""
    out = np.zeros(len(stream.symbols))
    for step in stream.steps():
        bit, x, gate, context = _inputs(tokens_, tables, stream, step)
        p = mixer.predict(x, gate, context)
        p -= bit == 0
        first, begin = step[:2]
        out[first : first + len(begin)] = np.add.reduceat(np.log(np.abs(p, out=p), out=p), begin, dtype=np.float64)
    sure = stream.sure[stream.rare[stream.told]]
    right = (tally[1::2] + 0.5) / (tally[::2] + tally[1::2] + 1)
    out[stream.rare[stream.told]] += np.log(np.where(stream.known[stream.told], right[sure], 1 - right[sure]))
    return out


def letters(words: list[bytes], counts: np.ndarray) -> Code:
    """A code of all bytes, the blank after a word included, from frequent words and their counts."""
    n = np.ones(256)
    for w, c in zip(words, counts, strict=True):
        np.add.at(n, np.frombuffer(w + b" ", np.uint8), c)
    return Code(n.astype(np.int64))


def spelling(words: list[bytes], code: Code) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Word, value, slots and node of each decision of the words, each with a blank after it."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    b = np.frombuffer(b" ".join(words) + b" " if words else b"", np.uint8).astype(np.uint32)
    begin = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(b))
    b1, b2, b3, b4 = (np.where(at - begin >= k, np.roll(b, k), 0).astype(np.uint32) for k in range(1, 5))
    # sums of powers give the hash of any stretch of bytes
    power = np.cumprod(np.full(len(b) + 1, 0x9E3779B97F4A7C15, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint32(1)).astype(np.uint64) * power[:-1])])
    inverse = np.cumprod(np.full(len(b) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    so_far = (total[:-1] - total[begin]) * inverse[begin]
    so_far = ((so_far ^ so_far >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
    two = b1 | b2 << np.uint32(8)
    three = two | b3 << np.uint32(16)
    each = code.size[b]
    byte = np.repeat(at, each)
    place = np.arange(len(byte))
    place += np.repeat(code.start[b] - np.cumsum(each) + each, each)
    node, salt, within = code.node.take(place), code.salt.take(place), code.within.take(place)
    slots = [(b1.take(byte) << np.uint32(8) | node.astype(np.uint32)).astype(np.int64)]
    for c, bits in zip((two, three, three | b4 << np.uint32(24), so_far), SPELL_BITS[1:], strict=True):
        c = c * _C3
        c ^= c >> np.uint32(15)
        slots.append(_lined(c.take(byte), salt, within, bits))
    return np.repeat(np.arange(len(words)), size).take(byte), code.bit.take(place), slots, node.astype(np.int64)


def spelling_scores(tables, mixer: Mixer, words: list[bytes], code: Code) -> np.ndarray:
    """Natural log of the probability of each word's spelling."""
    word, bit, slots, node = spelling(words, code)
    x, (high, low) = tables.look(slots, (4, 2))
    p = mixer.predict(x, high.astype(np.int64) * 8 + low, node)
    return np.bincount(word, np.log(np.where(bit == 1, p, 1 - p)), len(words))


def _some(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of words of which none but a single long word has over 2**16 bytes."""
    words, at, held = batch.column("word").to_pylist(), 0, 0
    for k, w in enumerate(words):
        if k > at and (held + len(w) > 1 << 16 or k - at == rows):
            yield batch.slice(at, k - at), words[at:k]
            at, held = k, 0
        held += len(w)
    if at < len(words):
        yield batch.slice(at), words[at:]


def _spellings(known: DataFrame, least: int, code: Code) -> Callable[[DataFrame], DataFrame]:
    """Learns the spelling of rare training tokens, by their number; gives what adds ``spell`` to words."""
    spark = known.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rare = known.where((F.col("c") > 0) & (F.col("c") < least)).select("word", "c").coalesce(cores)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(SPELL_BITS)
        for batch in batches:
            for part, words in _some(batch):
                word, bit, slots, _ = spelling(words, code)
                counts.add(slots, bit, part.column("c").to_numpy().astype(np.uint32)[word])
        yield from counts.rows()

    counts, _, _ = _gathered(rare.mapInArrow(tidy(count), _ROWS), SPELL_BITS, 5, raw=True)
    sent = spark.sparkContext.broadcast(counts.n)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, counted = Mixer(len(SPELL_BITS)), Counts(())
        counted.n = sent.value
        for batch in batches:
            for part, words in _some(batch, 200):
                word, bit, slots, node = spelling(words, code)
                x, seen, not_bit = [], {}, (bit == 0).astype(np.float32)
                for k, at in enumerate(slots):  # as if this occurrence had not been counted
                    n0, n1 = counted.taken(k, at)
                    n0 -= not_bit
                    n1 -= bit
                    if k in (2, 4):
                        seen[k] = level(n0 + n1)
                    x.append(stretched(n0, n1))
                mixer.learn(x, seen[4] * 8 + seen[2], node, bit, part.column("c").to_numpy().astype(np.float32)[word])
        yield _row(-1, TaskContext.get().partitionId(), b"", 0, [*mixer.state(), np.zeros(8).tobytes()])

    _, mixer, _ = _gathered(rare.mapInArrow(tidy(learn), _ROWS), SPELL_BITS, len(SPELL_BITS))
    tables = spark.sparkContext.broadcast(Tables([coded(n.reshape(-1, 2)) for n in counts.n]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _some(batch):
                h = hashes(words).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column("c"), pa.array(spelling_scores(tables.value, mixer, words, code))], names=["h", "c", "spell"])

    return lambda words: words.select("word", "c").mapInArrow(tidy(apply), "h long, c long, spell double")


def _count(docs: DataFrame, folds: int, out: int) -> DataFrame:
    """word, c (its number in training texts, 0 if only others have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(_texts(batches, "train"), COUNTED):
            b, start, end, h, n = joined([t for t, _ in some])
            train = np.array([x for _, x in some], bool)
            if len(h):
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                c = np.add.reduceat(np.repeat(train, n)[order], first, dtype=np.int64)
                start, size = start[order[first]], (end - start)[order[first]]
                to = np.cumsum(size)
                place = np.arange(to[-1])
                place += np.repeat(start - to + size, size)
                words = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(np.append(0, to).astype(np.int32)), pa.py_buffer(b[place])])
                yield pa.RecordBatch.from_arrays([words, pa.array(c)], names=["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([int(train.sum())], pa.int64())], names=["word", "c"])

    train = F.coalesce(remainder("doc_id", folds) != out, F.lit(False)).alias("train")
    parts = docs.select(F.col("text").cast("string"), train).mapInArrow(tidy(run), "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def _texts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Text and other columns row by row, of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            b = batch.slice(at, 200)
            yield from zip(texts(b), *(b.column(c).to_pylist() for c in columns), strict=True)


def blocks(rows: Iterator[tuple], most: int = BLOCK) -> Iterator[list[tuple]]:
    """Rows (text first) in runs of about so many bytes; a longer one is one by itself."""
    held, n = [], 0
    for row in rows:
        if held and n + len(row[0]) > most:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[0]) + 1
    if held:
        yield held


def _spread(docs: DataFrame) -> DataFrame:
    """docs in as many partitions as there are cores at least, should the files be fewer."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _training(docs: DataFrame, folds: int, out: int) -> DataFrame:
    """The training texts in as many partitions as there are cores at most, as each of them makes whole tables."""
    return docs.where(remainder("doc_id", folds) != out).select(F.col("text").cast("string")).coalesce(docs.sparkSession.sparkContext.defaultParallelism)


def _learned(train: DataFrame, sent, sizes: tuple[int, ...]) -> tuple[Tables, Mixer, np.ndarray]:
    """Tables, mixer and tally of the running text, online over all training texts by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mixer, tally = Counts(sizes, np.uint16), Mixer(Stream.INPUTS), np.zeros(8)
        for some in blocks(_texts(batches)):
            learn_stream(sent.value, counts, mixer, tally, sent.value.read([t for (t,) in some]))
        yield from counts.rows()
        yield _row(-1, TaskContext.get().partitionId(), b"", 0, [*mixer.state(), tally.tobytes()])

    return _gathered(train.mapInArrow(tidy(run), _ROWS), sizes, Stream.INPUTS)


def score(docs: DataFrame, folds: int = 7, out: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row (doc_id, text).

    Null text is empty: one end token. Rows without doc_id are scored, never learned from. Repeated rows each count in
    training and each get their score. Extra columns are ignored. Without training texts the base has N = V = 0. An empty
    table gives an empty result. A long text is a block by itself, its decisions are made in steps.
    """
    spark = docs.sparkSession
    docs = _spread(docs.select("doc_id", "text"))
    known = saved(_count(docs, folds, out), "words")
    stats = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = int(stats["n"]), int(stats["v"])
    least = max(2, total >> RARE_BITS)
    frequent = F.col("c") >= least
    top = known.where(frequent & (F.col("word") != F.lit(END))).orderBy(F.desc("c"), "word").toArrow()  # at most 2**RARE_BITS rows
    stops = known.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words, counts = top.column("word").to_pylist(), top.column("c").to_numpy()
    bits = table_bits(distinct)
    tokens_ = Tokens(words, counts, total - int(counts.sum()) - stops, stops, bits)
    sent = spark.sparkContext.broadcast(tokens_)
    tables, mixer, tally = _learned(_training(docs, folds, out), sent, (bits,) * 3)
    ready = spark.sparkContext.broadcast((tables, mixer, tally))
    known_counts = np.concatenate([[0, stops], counts]).astype(np.float64)
    base_of = spark.sparkContext.broadcast((np.log10((known_counts + 1) / (total + distinct + 1)), known_counts > 0))
    rare = saved(_spellings(known, least, letters(words, counts))(known.where(~frequent & (F.col("word") != F.lit(END)))), "rare-words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (base, is_known), row = (*ready.value,), base_of.value, TaskContext.get().partitionId() << 32
        for some in blocks(_texts(batches, "doc_id")):
            stream = sent.value.read([t for t, _ in some])
            n = len(some)
            scores = np.bincount(stream.text, score_stream(sent.value, *own, stream), n) / np.log(10)
            plain = stream.symbols != ESCAPE
            bases = np.bincount(stream.text, np.where(plain, base[stream.symbols], 0), n)
            knowns = np.bincount(stream.text, plain & is_known[stream.symbols], n).astype(np.int64)
            # a text's rare words, each once: how often it occurs, how often no match tells it
            of = stream.text[stream.rare]
            order = np.lexsort((stream.h, of))
            h, of = stream.h[order], of[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)])
            spelt = np.add.reduceat(~stream.known[order], first, dtype=np.int64) if len(h) else first
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(of[first], minlength=n))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[first].astype(np.int64), np.diff(np.append(first, len(h))), spelt)]
            cols = [pa.array(row + np.arange(n)), pa.array([d for _, d in some], pa.int64()), pa.array(np.bincount(stream.text, minlength=n)), pa.array(knowns), pa.array(bases), pa.array([len(t) for t, _ in some], pa.int64()), pa.array(scores), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_tokens", "n_known", "base", "bytes", "score", "h", "times", "spelt"])
            row += n

    kept = "row long, doc_id long, n_tokens long, n_known long, base double, bytes long, score double, h array<long>, times array<long>, spelt array<long>"
    main = saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), kept), "running-scores")
    each = main.select("row", F.explode(F.arrays_zip("h", "times", "spelt")).alias("e")).select("row", F.col("e.h").alias("h"), F.col("e.times").alias("times"), F.col("e.spelt").alias("spelt"))
    terms = each.join(rare, "h").select(
        F.col("row").alias("r"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(total + distinct + 1)))).alias("b"), (F.col("spelt") * F.col("spell") / F.lit(float(np.log(10)))).alias("s"),
    )
    sums = terms.groupBy("r").agg(F.sum("known").alias("r_known"), F.sum("b").alias("r_base"), F.sum("s").alias("r_score"))
    whole = main.drop("h", "times", "spelt").join(sums, F.col("row") == F.col("r"), "left")
    result = F.col("score") + F.coalesce("r_score", F.lit(0.0))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"), result.alias("score"), (result / F.lit(-float(np.log10(2))) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 7) == 2, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
