"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. A line's potentials come from its own features and those of the lines before and after it;
neighbouring labels have a transition weight. Forward-backward gives each line's probability of being good, and their
mean weighted by length is the document's quality, mapped to a probability by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import give_back, held_out, remainder, table, texts, tidy

#: Labelled documents to fit on at most, and the bytes of a text to be among them.
SAMPLE, SAMPLE_BYTES = 4000, 65_536
THRESHOLD = 0.3
_SYMBOLS, _MARKS = b"#*$%&|<>", b"!|*#$%&<>=~^@_{}[]\\"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: Lines x documents that go through the recursion at once.
CELLS = 1 << 17
#: Features of a line by itself.
OWN = 13


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features and the weights of the lines; an empty text is one empty line."""
    rows, weights, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n and rows:
            continue
        size = len(line)
        inv, per = 1.0 / max(n, 1), 1.0 / max(size, 1)
        distinct = len(set(words))
        upper = size - len(line.translate(None, _UPPER))
        lower = size - len(line.translate(None, _LOWER))
        rows.append(
            (
                min(n, 200) * 0.01,
                1.0 if n < 4 else 0.0,
                (size - n + 1) * inv * 0.1 if n else 0.0,
                min(2.0, (size - len(line.translate(None, _SYMBOLS))) * inv),
                min(2.0, (size - len(line.translate(None, _MARKS))) * inv),
                upper / (upper + lower + 1),
                1.0 - distinct * inv if n else 0.0,
                sum(map(eq, words, words[1:])) * inv,
                line.count(b".") * inv,
                line.count(b",") * inv,
                (size - len(line.translate(None, _DIGITS))) * per,
                1.0 if n and line in seen else 0.0,
                1.0 if not n else 0.0,
            )
        )
        weights.append(max(size, 1))
        seen.add(line)
    return np.array(rows, np.float32), np.array(weights, np.float32)


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of the line, the one before, the one after (zeros beyond an end), first, last, and 1."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first, last = np.zeros((n, 1), np.float32), np.zeros((n, 1), np.float32)
    ends = np.append(starts[1:], n) - 1
    first[starts], last[ends] = 1, 1
    before[starts], after[ends] = 0, 0
    return np.hstack([x, before, after, first, last, np.ones((n, 1), np.float32)])


def marginals(unary: np.ndarray, trans: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, the expected transitions (2, 2) and each document's log normaliser, by forward-backward.

    unary: (lines, 2) log potentials; documents lie one after another. Those of like length go through the recursion
    together, step by step.
    """
    good, pairs, log_z = np.empty(len(unary)), np.zeros((2, 2)), np.empty(len(counts))
    top = unary.max(axis=1, keepdims=True)
    psi, move = np.exp(unary - top), np.exp(trans - trans.max())
    order = np.argsort(-counts, kind="stable")
    at = 0
    while at < len(order):
        # the longest first, as many at once as keep lines x documents within CELLS; a longer document goes alone
        docs = order[at : at + min(256, max(1, CELLS // int(counts[order[at]])))]
        at += len(docs)
        n, s = counts[docs], starts[docs]
        steps = int(n.max())
        alpha, scale = np.ones((steps, len(docs), 2)), np.ones((steps, len(docs)))
        a = psi[s]
        z = np.zeros(len(docs))
        for t in range(steps):
            live = t < n
            p = psi[np.where(live, s + t, 0)]
            a = np.where(live[:, None], p if t == 0 else (a @ move) * p, a)
            c = a.sum(axis=1)
            a = a / c[:, None]
            alpha[t], scale[t] = a, np.where(live, c, 1)
            z += np.where(live, np.log(c), 0)
        log_z[docs] = z + np.add.reduceat(top[:, 0], starts)[docs] + (n - 1) * trans.max()
        beta = np.ones((len(docs), 2))
        for t in range(steps - 1, -1, -1):
            live = t < n
            g = alpha[t] * beta
            g /= g.sum(axis=1, keepdims=True)
            good[(s + t)[live]] = g[live, 1]
            if t:
                p = psi[np.where(live, s + t, 0)] * beta / scale[t][:, None]
                q = alpha[t - 1][:, :, None] * move[None] * p[:, None, :]
                pairs += q[live].sum(axis=0)
                beta = np.where(live[:, None], p @ move.T, beta)
    return good, pairs, log_z


def fit(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, steps: int = 150, l2: float = 1e-3) -> dict:
    """Weights by gradient ascent (Adam) on the likelihood of the lines' labels, each line labelled as its document.
    Without documents, or with one class only, the model gives the share of good documents (1 without any)."""
    if len(set(labels.tolist())) < 2:
        return {"w": None, "rate": float(np.mean(labels)) if len(labels) else 1.0}
    counts = np.array([len(x) for x in features])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    x = np.concatenate(features).astype(np.float32)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = with_neighbours((x - mean) / std, starts).astype(np.float64)
    y = np.repeat(labels, counts).astype(np.float64)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[starts] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    m = v = np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        unary = np.zeros((len(y), 2))
        unary[:, 1] = x @ w
        good, pairs, _ = marginals(unary, trans, starts, counts)
        g = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(y) - l2 * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, trans = w + step[: len(w)], trans + step[len(w) :].reshape(2, 2)
    model = {"w": w, "trans": trans, "mean": mean, "std": std, "curve": (0.0, 1.0)}
    q = quality(model, features, weights)
    z = np.log((q + 1e-3) / (1 - q + 1e-3))
    a, b = 1.0, 0.0  # the curve: P(label 1) = 1 / (1 + exp(-(a z + b))), by Newton's method with a prior
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = labels - p, p * (1 - p) + 1e-9
        grad = np.array([d @ z - (a - 1), d.sum() - 0.1 * b])
        hess = np.array([[h @ (z * z) + 1, h @ z], [h @ z, h.sum() + 0.1]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return model | {"curve": (a, b)}


def line_marginals(model: dict, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of all lines, one document after another, and where documents start."""
    counts = np.array([len(x) for x in features])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    if model["w"] is None:
        return np.full(int(counts.sum()), model["rate"]), starts
    x = with_neighbours((np.concatenate(features) - model["mean"]) / model["std"], starts)
    unary = np.zeros((len(x), 2))
    unary[:, 1] = x @ model["w"]
    return marginals(unary, model["trans"], starts, counts)[0], starts


def quality(model: dict, features: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    good, starts = line_marginals(model, features)
    w = np.concatenate(weights).astype(np.float64)
    return np.add.reduceat(good * w, starts) / np.add.reduceat(w, starts)


def score(model: dict, features: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    q = quality(model, features, weights)
    if model["w"] is None:
        return q
    a, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a * np.log((q + 1e-3) / (1 - q + 1e-3)) + b, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int, size: int) -> DataFrame:
    """text and label of at most ``rows`` labelled training documents, by the order of a hash of their ids; only texts of
    up to ``size`` bytes. Labels of held-out ids, and null ones, are never read further than that."""
    known = labels.where((remainder("doc_id", folds) != out) & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("label"))
    chosen = known.groupBy("l_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= size)
    return text.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, rows: int = SAMPLE) -> dict:
    """The model, fitted on the driver on features of at most ``rows`` documents (SAMPLE_BYTES of text each at most). A null
    text is empty, null labels are not read; without labels of both classes all documents get the share of good ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [line_features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary()), batch.column("label")], names=["x", "w", "label"])

    got = sample(docs, labels, "quality", folds, out, rows, SAMPLE_BYTES).mapInArrow(tidy(run), "x binary, w binary, label int").toArrow()
    got = got.slice(0, 2 * rows).to_pydict()
    order = sorted(range(len(got["x"])), key=lambda i: (got["label"][i], got["x"][i]))  # the same rows in any order give the same model
    try:
        return fit([np.frombuffer(got["x"][i], np.float32).reshape(-1, OWN) for i in order], [np.frombuffer(got["w"][i], np.float32) for i in order], np.array([got["label"][i] for i in order], np.float64))
    finally:
        del got
        give_back()


def apply(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and bad_lines (places of the lines, among those with words, that are likelier bad) of every row. A null
    or empty text is one empty line; repeated rows stay, other columns are not read, an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [line_features(t) for t in texts(part)]
                features, weights = [x for x, _ in got], [w for _, w in got]
                good, starts = line_marginals(sent.value, features)
                bad = [np.flatnonzero(g < 0.5).tolist() for g in np.split(good, starts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(sent.value, features, weights), pa.float64()), pa.array(bad, pa.list_(pa.int32()))], names=["doc_id", "score", "bad_lines"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double, bad_lines array<int>")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, in their own columns; nulls and extra columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [line_features(t) for t in texts(part)]
                yield part.filter(pa.array(score(sent.value, [x for x, _ in got], [w for _, w in got]) >= threshold))

    return docs.mapInArrow(tidy(run), schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = apply(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
