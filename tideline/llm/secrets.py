"""Secret scan: fixed rules, and a character model for secrets that no rule names.

Two character Markov models of first order, one of random strings and one of ordinary
identifiers, are trained from labelled strings. A long unbroken string is reported when
the log-likelihood ratio of the two exceeds the prior odds against a secret.
DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import documents, joined, let, spans, total, untouched

KINDS = ("assign", "access", "hex", "random")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*+[:=]\\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = "AKIA[A-Z0-9]++"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"

#: Characters of the models; any other counts as the last one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{3,}"


def base_spans(text: Column) -> Column:
    """Array of (start, end, text, value, rank) of the three fixed rules; ``value`` is the secret itself."""

    def ranked(found: Column, rank: int, value: str) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["text"], m[value].alias("value"), F.lit(rank).alias("rank")))

    assign = F.filter(spans(text, ASSIGN, (2,)), lambda m: F.length(m["g2"]) >= 8)
    access = F.filter(spans(text, ACCESS), lambda m: F.length(m["text"]) >= 16)
    return F.concat(ranked(assign, 0, "g2"), ranked(access, 1, "text"), ranked(spans(text, HEX), 2, "text"))


def labelled_strings(docs: DataFrame) -> DataFrame:
    """Training strings ``(text, label, n)`` of all documents: 1 for the secrets that the fixed
    rules find, 0 for the identifiers in what is left when whatever the rules match is cut out.
    Each different string counts once, so a copied document weighs as one."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rest = whole
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    secret = docs.select(F.explode(F.transform(base_spans(whole), lambda m: m["value"])).alias("text"), F.lit(1).alias("label"))
    word = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)))).alias("text"), F.lit(0).alias("label"))
    word = word.filter(F.length("text") < 32)
    return secret.unionByName(word).distinct().withColumn("n", F.lit(1).cast("long"))


def _code(char: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at == 0, WIDTH).otherwise(at) - 1


def _steps(text: Column) -> Column:
    """Number of the transition at each character; the first starts from the state behind the alphabet."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: _code(F.substring(text, i, F.lit(1))))
    return let(codes, lambda c: F.transform(c, lambda x, i: F.when(i == 0, WIDTH).otherwise(F.get(c, i - 1)) * WIDTH + x))


def train(strings: DataFrame, smoothing: float = 0.5, uniform: float = 0.3) -> list[float]:
    """Log ratio of the two models for each transition.

    ``strings``: (text, label, n). Transition counts are summed by Spark; at most
    ``2 * (WIDTH + 1) * WIDTH`` sums come back. The model of random strings is mixed with
    the uniform one, since its samples may know few alphabets.
    """
    counted = (
        strings.filter(F.length("text") > 0)
        .select("label", "n", F.explode(_steps(F.col("text"))).alias("step"))
        .groupBy("label", "step")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    size = (WIDTH + 1) * WIDTH
    counts = {0: [0] * size, 1: [0] * size}
    for r in counted:
        counts[r["label"]][r["step"]] = r["n"]
    ratio = []
    for state in range(WIDTH + 1):
        row = slice(state * WIDTH, (state + 1) * WIDTH)
        sums = {k: sum(v[row]) + smoothing * WIDTH for k, v in counts.items()}
        for zero, one in zip(counts[0][row], counts[1][row]):
            random = (1 - uniform) * (one + smoothing) / sums[1] + uniform / WIDTH
            ratio.append(round(math.log(random) - math.log((zero + smoothing) / sums[0]), 6))
    return ratio


def log_ratio(text: Column, model: Sequence[float]) -> Column:
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return F.aggregate(_steps(text), F.lit(0.0), lambda a, s: a + F.get(table, s))


def scan(docs: DataFrame, model: Sequence[float], text: str = "text", min_length: int = 16, odds: float = 1000.0, into: str = "found") -> DataFrame:
    """``docs`` with the column ``into``: array of (start, rank, kind, end, score) by start, then kind.

    Fixed rules always count (null score). A string of at least ``min_length`` characters of
    the alphabet, one a letter, that touches none of them is added as ``random`` if its log
    ratio exceeds ``log(odds)``. Null and empty texts give an empty array.
    """
    run = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_length},}}+"
    kinds = F.array(*map(F.lit, KINDS))

    def mark(m: Column, rank: Column, score: Column) -> Column:
        return F.struct(m["start"].alias("start"), rank.alias("rank"), F.get(kinds, rank).alias("kind"), m["end"].alias("end"), score.alias("score"))

    def all_of(base: Column) -> Column:
        free = untouched(F.filter(spans(F.col(text), run), lambda c: c["text"].rlike("[A-Za-z]")), base)
        scored = F.transform(free, lambda c: mark(c, F.lit(3), log_ratio(c["text"], model)))
        fixed = F.transform(base, lambda m: mark(m, m["rank"], F.lit(None).cast("double")))
        return F.array_sort(F.concat(fixed, F.filter(scored, lambda c: c["score"] > math.log(odds))))

    return docs.withColumn(into, let(base_spans(F.col(text)), all_of))


def op1(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the digest of those that the fixed rules find."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(labelled_strings(docs))
    found = scan(docs, model).select("doc_id", "found")

    def count(rank: int) -> Column:
        return total(F.transform("found", lambda m: (m["rank"] == rank).cast("long")))

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        count(3).alias("n_random"),
        F.sha2(joined(F.filter("found", lambda m: m["rank"] < 3)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
