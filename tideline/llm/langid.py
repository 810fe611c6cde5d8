"""Language identification as inference of a multilingual mixture.

Each language has a distribution over hashed character n-grams of words. A document's
n-grams come from a mixture of languages, whose proportions expectation-maximisation
estimates; languages leave the set as long as the penalised likelihood gains by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import documents

BITS = 15
BUCKETS = 1 << BITS
#: Characters hashed at a time, so that long texts need no more memory than this.
CHUNK = 1 << 20
ORDERS = (2, 3)
#: Anything between words; a word's n-grams include its borders.
BETWEEN = re.compile(r"[^\w]+|[\d_]+")
UNKNOWN = "und"


@dataclass
class Model:
    """Languages by name and the log probability of each bucket under each."""

    languages: list[str]
    logs: np.ndarray  # buckets x languages


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    clean = BETWEEN.sub(" ", text.lower())
    total = np.zeros(BUCKETS, np.int64) if len(clean) > 8000 else None
    for at in range(0, max(1, len(clean)), CHUNK):
        codes = np.frombuffer(f" {clean[at : at + CHUNK]} ".encode("utf-32-le"), np.uint32)
        space = codes == 32
        found = []
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.zeros(len(codes) - n + 1, np.uint32)
            inner = np.zeros(len(h), bool)
            for i in range(n):
                h = h * np.uint32(0x01000193) + codes[i : len(codes) - n + 1 + i]
                if 0 < i < n - 1:  # an n-gram may start or end at a border, not run across it
                    inner |= space[i : len(codes) - n + 1 + i]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            found.append(h[~inner])
        if total is None:
            return np.unique(np.concatenate(found), return_counts=True)
        for h in found:
            total += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> Model:
    """Distributions from all rows of ``docs`` with text and language.

    Each task adds up its rows; Spark adds up the tasks. What reaches the driver is one number
    per language and bucket.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = grams(t)
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))[at] += n
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counted.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))
    got = sorted(by_lang.collect(), key=lambda r: r["lang"])
    table = np.full((BUCKETS, len(got)), smoothing)
    for i, r in enumerate(got):
        table[np.array(r["at"], np.int64), i] += np.array(r["n"], np.float64)
    return Model([r["lang"] for r in got], np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def proportions(logs: np.ndarray, counts: np.ndarray, penalty: float = 2.0, tolerance: float = 1e-4, most: int = 60) -> np.ndarray:
    """Proportions of the languages in one document, zero for those not in its set.

    Expectation-maximisation over the n-grams (rows of ``logs``). Starting from all languages,
    the one of the smallest proportion is left out while that costs less log likelihood than
    ``penalty * log(n-grams)``, the price of a language.
    """
    top = logs.max(axis=1, keepdims=True)
    p = np.exp((logs - top).astype(np.float64))
    n = counts.sum()

    def fit(kept: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        q, part = p[:, kept], start[kept] / start[kept].sum()
        if len(kept) == 1:
            return np.ones(1), float(counts @ np.log(q[:, 0] + 1e-300))
        old = -np.inf
        for _ in range(most):
            mixed = q @ part
            new = float(counts @ np.log(mixed))
            part = part * (q.T @ (counts / mixed)) / n
            if new - old < tolerance * n * 0.01:
                break
            old = new
        return part, new

    kept = np.arange(logs.shape[1])
    part, best = fit(kept, np.ones(len(kept)))
    price = penalty * np.log(n + 1)
    while len(kept) > 1:
        rest = np.delete(np.arange(len(kept)), part.argmin())
        full = np.zeros(logs.shape[1])
        full[kept] = part + 1e-6
        less, value = fit(kept[rest], full)
        if best - value > price:
            break
        kept, part, best = kept[rest], less, value
    out = np.zeros(logs.shape[1])
    out[kept] = part
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score`` (its proportion) and ``languages`` (the set, largest first).

    A null text, one without a letter, and every text when nothing was learned, is ``und`` with
    score 0. Equal proportions go to the language whose name sorts first.
    """
    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.when(letters, F.col(text)).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sets = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                at, n = grams(t) if t is not None and model.languages else ((), ())
                if not len(at):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    sets.append([])
                    continue
                part = proportions(model.logs[at], n)
                names.append(model.languages[int(part.argmax())])
                scores.append(float(min(1.0, part.max())))
                sets.append([model.languages[i] for i in np.argsort(-part, kind="stable") if part[i] > 0])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=[*keep, "lang_pred", "score", "languages"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, languages array<string>")


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    found = identify(docs, train(docs.filter("not held_out")), keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"))
