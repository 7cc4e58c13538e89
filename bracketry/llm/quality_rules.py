"""Document rules judged by host: failures are added up by host, rates shrunk with an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import saved, sliced, small, table, texts, tidy

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Limits of the method's own rules: symbols a word, lines that repeat, code points a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_CHARS = 0.5, 0.5, (2.0, 15.0)
#: A host is strict from this shrunk rate of failing documents on (one failed rule drops a document; otherwise two do),
#: and blocked from that one on (all its documents go).
STRICT_RATE, BLOCK_RATE = 0.02, 0.9
#: Hosts whose verdicts are broadcast; with more of them the verdicts are joined by a shuffle.
BROADCAST_HOSTS = 200_000

_SYMBOLS, _BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"


class _Words(defaultdict):
    def __init__(self):
        super().__init__(count().__next__)


def repeat_words(words: list[bytes], ids: _Words) -> int:
    """Words that lie in a 3-word window found twice or more in this text, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if w.max() < 1 << 21:
        keys = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
        order = np.argsort(keys, kind="stable")
        same = np.diff(keys[order]) == 0
    else:  # three numbers don't fit one key
        order = np.lexsort((w[2:], w[1:-1], w[:-2]))
        same = (w[order[1:]] == w[order[:-1]]) & (w[order[1:] + 1] == w[order[:-1] + 1]) & (w[order[1:] + 2] == w[order[:-1] + 2])
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def counts(text: bytes, ids: _Words) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of one whole text."""
    words = text.split()
    points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    chars = len(text.translate(None, _BLANKS)) - points
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words, ids), len(lines)


def measure(docs: DataFrame, host: str) -> DataFrame:
    """One row per document with its host and counts; null text has no words, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Words()
        for batch in sliced(batches):
            rows = []
            for text in texts(batch):
                if len(ids) > 1_000_000 or len(text) > 2**21 and len(ids) + len(text) > 2**22:
                    ids = _Words()
                rows.append(counts(text, ids) if len(text) < 2**22 else counts(text, _Words()))
            got = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(c) for c in got.T)], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    return docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    )


def with_rules(measured: DataFrame) -> DataFrame:
    per_word = F.try_divide("word_chars", "n_words")
    failed = [
        F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"),
        F.col("n_dup_lines") >= F.greatest(F.lit(2), MAX_DUP_LINES * F.col("n_lines")),
        F.coalesce((per_word < WORD_CHARS[0]) | (per_word > WORD_CHARS[1]), F.lit(False)),
    ]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("n_failed", sum((f.cast("int") for f in failed[1:]), failed[0].cast("int")))


def host_verdicts(ruled: DataFrame) -> DataFrame:
    """host, documents, failures, shrunk_rate, verdict (block, strict or lenient); documents without a host share the null host.

    The prior beta(a, b) has the mean of the hosts' rates and, by moments, as many pseudo-documents a + b as their spread
    beyond binomial noise allows (2 to 1000; 1000 if there is no such spread or one host only).
    """
    bad = (F.col("base_failed") | (F.col("n_failed") > 0)).cast("long")
    hosts = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.sum(bad).alias("failures"))
    rate = F.col("failures") / F.col("documents")
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1.0 / F.col("documents")).alias("inv")).first()
    m, v, inv = (s["m"] or 0.0), (s["v"] or 0.0), (s["inv"] or 0.0)
    noise = m * (1 - m) * inv
    weight = min(1000.0, max(2.0, m * (1 - m) / (v - noise) - 1)) if v > noise else 1000.0
    shrunk = (F.col("failures") + weight * m) / (F.col("documents") + weight)
    verdict = F.when(F.col("shrunk_rate") >= BLOCK_RATE, "block").when(F.col("shrunk_rate") >= STRICT_RATE, "strict").otherwise("lenient")
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("verdict", verdict)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts, base_failed and kept of each document with its host's verdict."""
    ruled = with_rules(saved(measure(docs, host), "rule-counts"))
    verdicts = saved(host_verdicts(ruled).withColumnRenamed("host", "v_host"), "host-verdicts").select("v_host", "shrunk_rate", "verdict")
    if small(verdicts, BROADCAST_HOSTS):
        verdicts = F.broadcast(verdicts)
    allowed = F.when(F.col("verdict") == "block", -1).when(F.col("verdict") == "strict", 0).otherwise(1)
    return ruled.join(verdicts, F.col("host").eqNullSafe(F.col("v_host"))).drop("v_host").withColumn("kept", ~F.col("base_failed") & (F.col("n_failed") <= allowed))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
