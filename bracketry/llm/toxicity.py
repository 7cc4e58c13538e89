"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is logistic in its words, and 0 without any word that the model knows, so that a text does not
become likelier toxic by its length alone; a document's is the noisy-or of its sentences, 1 - prod(1 - p), those of the same words once. The weights are
fitted to the documents' labels; the sentences of high probability are then the offending ones.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import give_back, held_out, sliced, table, texts, tidy
from bracketry.llm.quality_crf import sample

#: Labelled documents to fit on at most, and the bytes of a text to be among them.
SAMPLE, SAMPLE_BYTES = 5_000, 16_384
#: Features of the model at most: those found in MIN_DOCS documents or more whose share of toxic ones is MIN_Z standard
#: errors over the others', the strongest first. A feature is a word or the first 4, 5 or 6 bytes of a longer one.
VOCABULARY, MIN_DOCS, MIN_Z = 2_000, 6, 5.0
PREFIXES = (4, 5, 6)
#: Bound of the bias, so that a word of little weight is no evidence.
MOST_BIAS = -2.0
THRESHOLD, OFFENDING = 0.7, 0.5

_END = b".!?\n\r"
#: A-Z lower-cased, sentence ends to line feeds, other ASCII marks and blanks to blanks; lengths stay.
_TABLE = bytes(10 if c in _END else c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def sentences(text: bytes) -> list[bytes]:
    """Normalised sentences with any word."""
    return [s for s in text.translate(_TABLE).split(b"\n") if not s.isspace() and s]


def bags(text: bytes) -> list[frozenset[bytes]]:
    """The distinct sets of words of the sentences."""
    return list(dict.fromkeys(frozenset(s.split()) for s in sentences(text)))


def features(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


class _Weights(dict):
    """Word -> sum of its features' weights, kept for each worker."""

    def __init__(self, model: dict):
        self.get_one = model["words"].get

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        x = self[word] = sum(self.get_one(f, 0.0) for f in features(word))
        return x


def choose(documents: Iterator[set[bytes]], labels: np.ndarray) -> list[bytes]:
    """Words by the z-score of their share of toxic documents, the strongest first; ties go by the word."""
    toxic, all_ = Counter(), Counter()
    for words, y in zip(documents, labels, strict=True):
        all_.update(words)
        if y:
            toxic.update(words)
    rate = float(labels.mean())
    z = {w: (toxic[w] - n * rate) / (n * rate * (1 - rate)) ** 0.5 for w, n in all_.items() if n >= MIN_DOCS}
    return sorted((w for w in z if z[w] >= MIN_Z), key=lambda w: (-z[w], w))[:VOCABULARY]


def fit(docs: list[bytes], labels: np.ndarray, steps: int = 500, l2: float = 1e-5) -> dict:
    """Weights of words and a bias, by Adam on the documents' likelihood. Without labels of both
    classes the model knows no word, and all scores are 0. Texts are taken apart twice, one at a time: words of all of
    them would be many times as large as the texts."""
    if len(set(labels.tolist())) < 2:
        return {"words": {}, "bias": -12.0}
    whole = ({f for w in set(t.translate(_TABLE).split()) for f in features(w)} for t in docs)
    index = {w: k for k, w in enumerate(choose(whole, labels))}
    at, word, doc_of = array("q"), array("q"), array("q")  # of sentences with words of the index
    n = 0
    for k, t in enumerate(docs):
        for s in bags(t):
            if found := [index[f] for f in {f for w in s for f in features(w)} if f in index]:
                at.extend([n] * len(found))
                word.extend(found)
                doc_of.append(k)
                n += 1
    at, word, doc_of = np.array(at, np.int64), np.array(word, np.int64), np.array(doc_of, np.int64)
    w, bias = np.zeros(len(index)), -4.0
    m = v = np.zeros(len(w) + 1)
    y, size = labels.astype(float), len(docs)
    for k in range(1, steps + 1):
        x = np.clip(bias + np.bincount(at, w[word], n), -30, 30)
        p = 1 / (1 + np.exp(-x))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), size)  # log P(no sentence is toxic)
        none = np.minimum(none, -1e-9)
        d_none = (1 - y) - y * np.exp(none) / -np.expm1(none)  # of the log likelihood
        d_x = -p * d_none[doc_of]
        g = np.append(np.bincount(word, d_x[at], len(w)), d_x.sum()) / size - l2 * np.append(w, 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
        w, bias = w + step[:-1], min(bias + step[-1], MOST_BIAS)
    return {"words": {x: float(w[k]) for x, k in index.items() if abs(w[k]) > 1e-3}, "bias": float(bias)}


def sentence_scores(model: dict, text: bytes, weights: _Weights | None = None) -> np.ndarray:
    """P(toxic) of each sentence; a text without any has one empty sentence. A word counts once a sentence."""
    weight = (weights if weights is not None else _Weights(model)).__getitem__
    own = sentences(text)
    p = np.zeros(max(1, len(own)))
    if any(map(weight, set(text.translate(_TABLE).split()))):
        for k, s in enumerate(own):
            if found := sorted(w for w in map(weight, set(s.split())) if w):
                p[k] = 1 / (1 + np.exp(-np.clip(model["bias"] + sum(found), -30, 30)))
    return p


def noisy_or(text: bytes, p: np.ndarray) -> float:
    """1 - prod(1 - p) over the sentences of different words."""
    if not p.any():
        return 0.0
    own = sentences(text)
    p = np.array(list({frozenset(own[k].split()): p[k] for k in np.flatnonzero(p)}.values()))
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def document_score(model: dict, text: bytes, weights: _Weights | None = None) -> float:
    return noisy_or(text, sentence_scores(model, text, weights))


def offending(text: bytes, p: np.ndarray) -> list[dict]:
    """start, end (in bytes) and p of each sentence of probability OFFENDING or more."""
    out, at, k = [], 0, 0
    for s in text.translate(_TABLE).split(b"\n"):
        if s and not s.isspace():
            if p[k] >= OFFENDING:
                out.append({"start": at, "end": at + len(s), "p": float(p[k])})
            k += 1
        at += len(s) + 1
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, rows: int = SAMPLE) -> dict:
    """The model, fitted on the driver on at most ``rows`` texts of at most SAMPLE_BYTES. Null texts are empty, copies with
    the same label count once, null labels and other columns are not read; an empty table gives the model without words."""
    got = sample(docs, labels, "toxic", folds, out, rows, SAMPLE_BYTES).toArrow().slice(0, 2 * rows).combine_chunks()
    pairs = sorted(set(zip(texts(got), got.column("label").to_pylist(), strict=True)))  # copies count once
    del got
    try:
        return fit([t for t, _ in pairs], np.array([y for _, y in pairs], np.int64))
    finally:
        give_back()


def apply(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and the offending sentences (start, end in bytes of the text's UTF-8, p) of every row. An empty or null text has one empty sentence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(sent.value)
        for batch in sliced(batches):
            scores, found = [], []
            for t in texts(batch):
                p = sentence_scores(sent.value, t, weights)
                scores.append(noisy_or(t, p))
                found.append(offending(t, p) if p.max() >= OFFENDING else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, spans)], names=["doc_id", "score", "sentences"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double, sentences array<struct<start:int,end:int,p:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, in their own columns; nulls and extra columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(sent.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array([document_score(sent.value, t, weights) < threshold for t in texts(batch)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = apply(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
