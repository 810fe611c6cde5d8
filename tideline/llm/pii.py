"""Personal data: fixed rules, and a span classifier trained without labels.

Candidates are the spans of the fixed rules and looser digit strings. Labelers (regex,
gazetteer, context) vote for, against or not at all on each; expectation-maximisation
estimates how reliable each labeler is, with the truth hidden; the resulting probabilities
train a logistic classifier on the shape of a span, which decides on the looser candidates.
DataFrame functions only. Votes and shapes take few values, so what is fitted is a
table of their counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, documents, highest, joined, let, parts, spans, stage, total, untouched

KINDS = ("email", "ip", "card", "phone", "number")
# A repeated group is possessive: Java would otherwise recurse once for each repetition.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){12,18}+(?![\\x20-]?[0-9])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
LOOSE = "(?<![0-9+])(?<![0-9][\\x20().-])[0-9](?:[\\x20().-]{0,2}[0-9]){6,18}+(?![\\x20().-]{0,2}[0-9])"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Code points before a span that the context labelers read.
CONTEXT = 40
FOR = "(?i)(?:\\b(?:phone|tel|telephone|mobile|cell|fax|call|contact|card|visa|account|iban|ssn|passport|teléfono|telefon|téléphone|tarjeta|karte|carte|konto)\\b)"
AGAINST = "(?i)(?:\\b(?:page|version|chapter|isbn|issn|figure|table|vol|section|seite|página|total|sum)\\b|[$€£#=/])"
NANP = "\\(?[2-9][0-9]{2}\\)?[\\x20.-]{1,2}[2-9][0-9]{2}[\\x20.-][0-9]{4}"
DATE = "(?:19|20)[0-9]{2}[.-](?:0?[1-9]|1[0-2])[.-][0-3]?[0-9].*|[0-3]?[0-9][.-][0-3]?[0-9][.-](?:19|20)[0-9]{2}.*|[0-9]+\\.[0-9]+"
#: Leading digits of card networks, toll-free and service area codes.
CARD_STARTS = "(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
AREA_STARTS = "(?:800|833|844|855|866|877|888|900|212|213|310|312|415|617|646|702|718|917|020|030|040|0800)"
LABELERS = ("format", "gazetteer", "cue", "counter_cue", "luhn", "separators")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def one(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return a + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0

    return F.when(F.length(digits) > 0, let(digits, one)).otherwise(False)


def base_spans(text: Column) -> Column:
    """Array of (start, end, text, rank) of the four fixed rules."""

    def ranked(found: Column, rank: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["text"], F.lit(rank).alias("rank")))

    ip = F.filter(spans(text, IP), lambda m: m["text"].rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"))
    card = F.filter(spans(text, CARD), lambda m: luhn(_digits(m["text"])))
    phone = F.filter(spans(text, PHONE), lambda m: F.length(_digits(m["text"])).between(9, 15))
    return F.concat(ranked(spans(text, EMAIL), 0), ranked(ip, 1), ranked(card, 2), ranked(phone, 3))


def candidates(text: Column) -> Column:
    """Array of (start, rank, end, text, votes, shape): base spans, and digit strings that touch none of them.

    ``votes`` has a character of ``+-0`` for each labeler, ``shape`` is (digits, separators,
    parts, lead), each below its entry in ``SHAPE``.
    """

    def described(m: Column, whole: Column) -> Column:
        digits, body = _digits(m["text"]), m["text"]
        before = cut(whole, F.greatest(m["start"] - CONTEXT, F.lit(0)), m["start"])
        around = F.regexp_replace(body, "[0-9]", "")

        def vote(yes: Column, no: Column) -> Column:
            return F.when(yes, "+").when(no, "-").otherwise("0")

        def of(n: Column) -> Column:
            never = F.lit(False)
            votes = F.concat(
                vote((m["rank"] < 4) | body.rlike(f"^(?:{NANP})$"), body.rlike(f"^(?:{DATE})$")),
                vote(digits.rlike(f"^(?:{CARD_STARTS})") & (n >= 13) | digits.rlike(f"^1?(?:{AREA_STARTS})") & n.between(7, 12), digits.rlike("^(?:19|20)[0-9]{2}") & n.between(8, 8)),
                vote(before.rlike(FOR), never),
                vote(never, before.rlike(AGAINST)),
                vote(n.between(13, 19) & luhn(digits), n.between(13, 19)),
                vote(F.length(around).between(2, 5) & (n >= 9), F.length(around) == 0),
            )
            shape = F.struct(
                F.when(n < 7, 0).when(n < 9, 1).when(n < 11, 2).when(n < 13, 3).when(n < 17, 4).otherwise(5).alias("digits"),
                F.when(body.contains("@"), 0).when(F.length(around) == 0, 1).when(around.rlike("^-+$"), 2).when(around.rlike("^ +$"), 3).when(around.rlike("^[.]+$"), 4).otherwise(5).alias("separators"),
                F.least(F.length(around), F.lit(4)).alias("parts"),
                F.when(body.startswith("+"), 0).when(body.startswith("("), 1).when(body.startswith("0"), 2).when(body.startswith("1"), 3).otherwise(4).alias("lead"),
            )
            return F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"), body.alias("text"), votes.alias("votes"), shape.alias("shape"))

        return let(F.length(digits), of)

    def all_of(base: Column) -> Column:
        loose = untouched(spans(text, LOOSE), base)
        both = F.concat(base, F.transform(loose, lambda m: F.struct(m["start"], m["end"], m["text"], F.lit(4).alias("rank"))))
        return let(both, lambda b: let(parts(F.when(F.size(b) > 0, text).otherwise("")), lambda whole: F.transform(b, lambda m: described(m, whole))))

    return let(base_spans(text), all_of)


#: Number of values of each part of a shape.
SHAPE = {"digits": 6, "separators": 6, "parts": 5, "lead": 5}


@dataclass
class Model:
    """``reliability``: labeler -> P(vote | private), P(vote | not) by vote; weights by part of the shape."""

    prior: float
    reliability: dict[str, tuple[dict[str, float], dict[str, float]]]
    bias: float
    weights: dict[str, list[float]]


def _posterior(votes: str, prior: float, tables) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for v, (a, b) in zip(votes, tables):
        yes, no = yes + math.log(a[v]), no + math.log(b[v])
    return 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))


def expectation_maximisation(cells: list[tuple[str, int]], tolerance: float = 1e-8, most: int = 20_000):
    """Prior and vote tables of the labelers from (votes, count); starts from a trusting guess.

    Works on distinct vote strings: 3 ** labelers at most. Stops at the tolerance; an estimate that has not
    settled after ``most`` rounds is an error.
    """
    prior, tables = 0.5, [({"+": 0.6, "0": 0.3, "-": 0.1}, {"+": 0.1, "0": 0.4, "-": 0.5}) for _ in LABELERS]
    for _ in range(most):
        sums = [({"+": 1.0, "0": 1.0, "-": 1.0}, {"+": 1.0, "0": 1.0, "-": 1.0}) for _ in LABELERS]
        yes, everything = 1.0, 2.0
        for votes, n in cells:
            p = _posterior(votes, prior, tables)
            yes, everything = yes + n * p, everything + n
            for v, (a, b) in zip(votes, sums):
                a[v] += n * p
                b[v] += n * (1 - p)
        new = yes / everything
        tables = [tuple({v: x / sum(t.values()) for v, x in t.items()} for t in pair) for pair in sums]
        if abs(new - prior) < tolerance:
            return new, tables
        prior = new
    raise ArithmeticError(f"the labelers' reliabilities have not settled after {most} rounds")


def marked(docs: DataFrame, text: str = "text", into: str = "candidates") -> DataFrame:
    """``docs`` with the candidates of each text. Both ``fit`` and ``find`` take them, so written once they are searched once."""
    return docs.withColumn(into, candidates(F.coalesce(F.col(text), F.lit(""))))


def fit(docs: DataFrame, text: str = "text", ridge: float = 1e-3, spans: str | None = None) -> Model:
    """Labeler reliabilities and the span classifier, from all documents; equal texts count once.

    ``spans``: column with the candidates, where ``marked`` has found them; ``text`` may then be a hash.
    """
    found = candidates(F.coalesce(F.col(text), F.lit(""))) if spans is None else F.col(spans)
    each = docs.select(F.xxhash64(text).alias("hash"), F.explode(found).alias("c"))
    cells = (
        each.select("hash", *(F.col(f"c.{k}").alias(k) for k in ("start", "rank", "votes", "shape")))
        .distinct()
        .groupBy("votes", "shape")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    patterns: dict[str, int] = {}
    for r in cells:
        patterns[r["votes"]] = patterns.get(r["votes"], 0) + r["n"]
    prior, tables = expectation_maximisation(sorted(patterns.items()))
    shapes: dict[tuple, tuple[int, float]] = {}
    for r in sorted(cells, key=str):
        k = tuple(r["shape"][k] for k in SHAPE)
        n, p = shapes.get(k, (0, 0.0))
        shapes[k] = n + r["n"], p + r["n"] * _posterior(r["votes"], prior, tables)
    rows = [(shape, n, p / n) for shape, (n, p) in shapes.items()]
    bias, weights = 0.0, {k: [0.0] * m for k, m in SHAPE.items()}
    everything = sum(n for _, n, _ in rows) or 1
    for _ in range(400 if rows else 0):
        g0, g = 0.0, {k: [ridge * x for x in w] for k, w in weights.items()}
        for shape, n, p in rows:
            z = bias + sum(weights[k][v] for k, v in zip(SHAPE, shape))
            e = n / everything * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            g0 += e
            for k, v in zip(SHAPE, shape):
                g[k][v] += e
        bias -= 2 * g0
        weights = {k: [x - 2 * y for x, y in zip(w, g[k])] for k, w in weights.items()}
    return Model(prior, dict(zip(LABELERS, tables)), bias, weights)


def probability(shape: Column, model: Model) -> Column:
    z = F.lit(round(model.bias, 9))
    for part, w in model.weights.items():
        z = z + F.get(F.array(*(F.lit(round(x, 9)) for x in w)), shape[part])
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.9, into: str = "found", spans: str | None = None) -> DataFrame:
    """``docs`` with the column ``into``: array of (rank, start, kind, end, score) by kind as listed, then start.

    Spans of the fixed rules always count; the others (kind ``number``) if the classifier
    gives at least ``threshold``. Null and empty texts give an empty array. ``spans``: column with
    the candidates, where ``marked`` has found them.
    """
    kinds = F.array(*map(F.lit, KINDS))
    scored = F.transform(
        candidates(F.coalesce(F.col(text), F.lit(""))) if spans is None else F.col(spans),
        lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), F.get(kinds, c["rank"]).alias("kind"), c["end"].alias("end"), probability(c["shape"], model).alias("score")),
    )
    return docs.withColumn(into, F.array_sort(F.filter(scored, lambda m: (m["rank"] < 4) | (m["score"] >= threshold))))


def redact(docs: DataFrame, model: Model, text: str = "text", spans: str | None = None) -> DataFrame:
    """``docs`` with each found span replaced by its kind in capitals and brackets.

    Overlapping spans become one mark, that of the first. Texts without any, nulls
    included, stay as they are; so do all other columns. ``spans`` as in ``find``; that column is dropped.
    """
    marks = "_private_spans"
    while marks in docs.columns:
        marks += "_"
    found = find(docs, model, text, into=marks, spans=spans)
    column = F.col(text)

    def masked(found: Column, reached: Column, whole: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reached, i), F.lit(0).cast("long"))
            return F.when(m["start"] >= at, F.concat(cut(whole, at, m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))).otherwise("")

        rest = cut(whole, F.array_max(F.transform(found, lambda m: m["end"])), F.length(column))
        return F.concat(F.array_join(F.transform(found, one), ""), rest)

    by_start = F.array_sort(F.transform(F.col(marks), lambda m: F.struct(m["start"], m["end"], m["kind"])))
    new = let(by_start, lambda f: let(highest(F.transform(f, lambda m: m["end"])), lambda r: let(parts(column), lambda whole: masked(f, r, whole))))
    return found.withColumn(text, F.when(F.size(F.col(marks)) > 0, new).otherwise(column)).drop(marks, *([spans] if spans else []))


def op3(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the digest of what the fixed rules find."""
    docs = stage(marked(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("hash"), "candidates"))
    found = find(docs, fit(docs, "hash", spans="candidates"), spans="candidates").select("doc_id", "found")

    def count(rank: int) -> Column:
        return total(F.transform("found", lambda m: (m["rank"] == rank).cast("long")))

    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(joined(F.filter("found", lambda m: m["rank"] < 4)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
