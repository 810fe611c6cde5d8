"""Whitening, vector codes and page extraction against plain versions, and on hard rows."""

import hashlib
import html
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tideline.llm import codes, extraction, whitening

VECTORS = "vec_id long, embedding array<float>, label int, v string, row string, n long, far string, code string, error long, id long, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "v", "r", 1, "f", "c", 2, 3, 4) for i, v, y in rows], VECTORS)


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(400, 8)) @ rng.normal(size=(8, 8))
    rows = [(int(i) - 5, [float(np.float32(x)) for x in v], int(i) % 3 if i % 7 else None) for i, v in enumerate(mixed)]
    rows += [rows[9]] * 40 + [(rows[9][0], rows[10][1], 1), (None, rows[3][1], None), (500, [0.0] * 8, 2)]
    bad = [(600, None, 1), (601, [], 1), (602, [1.0] * 7 + [None], 1), (603, [float("nan")] + [1.0] * 7, 1), (604, [float("inf")] + [1.0] * 7, 1), (605, [1.0, 2.0], 1)]
    return vectors(spark, rows + bad).repartition(5), rows


def test_covariances_are_exact(hard):
    df, rows = hard
    model = whitening.fit(df)
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert (model.n, model.sums) == (n, sums)
    plain = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(8)] for i in range(8)])
    again = model.axes @ np.diag(model.variances) @ model.axes.T
    assert np.allclose(again, plain, rtol=1e-12, atol=1e-12 * plain.max())
    assert list(model.variances) == sorted(model.variances, reverse=True)


def test_whitened_rows(hard):
    df, rows = hard
    model = whitening.fit(df)
    got = whitening.whiten(df, model, components=5).collect()
    assert len(got) == 5 * len(rows)
    x = np.array([[np.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows])
    mean = np.array(model.sums) / model.n
    want = (x - mean) @ model.axes[:, :5] / np.sqrt(model.variances[:5])
    exact = [sum((model.n * int(a) - s) ** 2 for a, s in zip(r, model.sums)) for r in x]
    key = lambda t: tuple((v is None, v) for v in t)
    expected = sorted(((i, k + 1, e, round(w, 6) + 0.0) for (i, _, _), ws, e in zip(rows, want, exact) for k, w in enumerate(ws)), key=key)
    assert sorted(((r["id"], r["component"], int(r["deviation"]), round(r["whitened"], 6) + 0.0) for r in got), key=key) == expected
    assert whitening.identity_error(df, model) < 1e-9
    assert {round(r["explained"], 9) for r in got} == {round(e / sum(model.variances), 9) for e in model.variances[:5]}


def test_whitening_without_variance_or_rows(spark):
    same = vectors(spark, [(i, [1.5, -2.0, 3.0], 1) for i in range(6)])
    model = whitening.fit(same)
    assert [(r["whitened"], r["explained"], int(r["deviation"])) for r in whitening.whiten(same, model).collect()] == [(0.0, 0.0, 0)] * 18
    assert whitening.identity_error(same, model) == 0.0
    few = vectors(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [4.0, 2.0, 1.0], 1)])
    model = whitening.fit(few)
    got = {(r["id"], r["component"]): r for r in whitening.whiten(few, model).collect()}
    assert {abs(round(got[i, 1]["whitened"], 9)) for i in (1, 2)} == {1.0} and got[1, 2]["whitened"] == got[1, 3]["whitened"] == 0.0
    empty = vectors(spark, [(1, None, 1)])
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    assert codes.compress(empty).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(1, [3.0e30, 1.0], 1), (2, [-3.0e30, 2.0], 1), (3, [1.0e30, 2.0], 1)]
    df = vectors(spark, rows)
    model = whitening.fit(df)
    exact = [[int(np.floor(1024.0 * float(np.float32(c)))) + 100_000 for c in v] for _, v, _ in rows]
    assert model.sums == [sum(c) for c in zip(*exact)]
    assert all(r["deviation"] is None for r in whitening.whiten(df, model).collect())


def plain_codes(rows, parts=4, rounds=4, entries=256):
    order = sorted((i is None, i or 0, v, y) for i, v, y in rows)
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) for c in v] for _, _, v, _ in order]
    w = len(x[0]) // parts
    cut = lambda r, p: r[p * w : (p + 1) * w]
    books = [[cut(r, p) for r in x[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(r, p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for r in x]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(r, p) for r, f in zip(x, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    rows = [(None if none else i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), y) for (none, i, _, y), f in zip(order, found)]
    total = {}
    for _, _, e, y in rows:
        total[y] = total.get(y, 0) + e
    return sorted(((i is None, i or 0), c, e, total[y], digest) for i, c, e, y in rows)


@pytest.mark.parametrize("entries", [16, 1000])
def test_codes(hard, entries):
    df, rows = hard
    rows = rows[:120] + rows[-30:]
    from pyspark.sql import functions as F

    some = vectors(df.sparkSession, rows + [(605, [1.0, 2.0], 1), (606, None, 1), (607, [None] * 8, 2)])
    got = codes.compress(some.repartition(3).withColumn("vec_id", F.col("vec_id")), entries=entries).collect()
    assert sorted(((r["id"] is None, r["id"] or 0), r["code"], int(r["error"]), int(r["label_error"]), r["codebooks_sha256"]) for r in got) == plain_codes(rows, entries=entries) if entries < 256 else len(got) == len(rows)


def test_pivots_prune_and_keep_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (40, 16))
    rows = np.concatenate([c + rng.integers(-40, 40, (50, 16)) for c in centres])
    book = np.concatenate([rows[::8], rows[:5]])
    pivots = codes.choose_pivots(book)
    entry, d, evaluated = codes.nearest(rows, codes.distances(rows, pivots), book, pivots)
    full = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert evaluated < full.size / 4
    big = rows.astype(object) * 10**12
    entry2, d2, _ = codes.nearest(big, codes.distances(big, pivots.astype(object) * 10**12), book.astype(object) * 10**12, pivots.astype(object) * 10**12)
    assert (entry2 == entry).all() and d2[3] == int(d[3]) * 10**24


def plain_article(page):
    m = re.search("<article>(.*?)</article>", page or "", re.S)
    parts = re.split("<[^>]*>", re.sub("<br>|</?b>", " ", m[1])) if m else []
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted((r["page_id"], r["url"], plain_article(r["html"])) for r in pages.collect())
    got = extraction.op12(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"], r["url"], r["text"]) for r in got.collect()) == want


P = "Enough words to be a paragraph, with marks; and then another sentence. "
PAGES = [
    (None, ""), ("", ""), (" \n ", ""), ("only text &amp more", "only text & more"), ("<p>one<p>two</p></p>", "one\ntwo"),
    ("<nav>menu</nav>", ""), ("<script>if (a<b) x('</p>')</script>", ""), ("<script>never ends", ""), ("a<!-- c --> b<!-- never ends", "a b"),
    (f"<div class=content><h2>T</h2><p>{P*3}<p>short<ul><li>x<li>y</ul></div><div class=box>Buy now</div>", f"T\n{(P*3).strip()}\nshort\nx\ny"),
    (f"<body class=no-sidebar><div id=top-menu><a>x</a></div><main><article><header><h1>T</h1></header><p>{P}</p><aside>s</aside><form><label>m</label></form></article><div class='comments'><article><p>{P}</p></article></div></main>", f"T\n{P.strip()}"),
    (f"<form><div class=sidebar>{P}</div><main><p>{P}</main></form>", P.strip()),
    (f"<h1>Title</h1><div><p>{P*2}</p></div><div class='cookieNotice'>{P}</div><div role=search>{P}</div><p hidden>{P}</p>", f"Title\n{(P*2).strip()}"),
    (f"<ul><li><a>aa aa</a><li><a>bb</a><li><a>cc</a></ul><p>{P}</p>", P.strip()),
    ("<p>a&nbsp;&lt;b&gt; &#8364; &notareference; &eacute</p>", html.unescape("a <b> € &notareference; é")),
    ("<p>x <b>y<i>z</b> w</i> <br>v<p>u", "x yz w v\nu"), ("a < b <3", "a < b <3"), ("<div>" * 4000 + "deep" + "</div>" * 4000, "deep"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_hard_pages(page, want):
    assert extraction.main_text(page) == want


def test_path_ratios():
    found, _ = extraction.blocks("<div><p>ab, cd.</p><p>efgh</p></div><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul>")
    path, length, marks = extraction.ratios(found)
    assert path.tolist() == [0, 0, 1, 1, 1]
    assert length.tolist() == [5.0, 5.0, 0, 0, 0] and marks.tolist() == [1.0, 1.0, 0, 0, 0]
    assert np.allclose(extraction.smooth(np.ones(7)), 1) and extraction.smooth(np.array([0, 0, 9.0, 0, 0])).argmax() == 2


def test_long_and_broken_pages_take_linear_time():
    rng = random.Random(4)
    for unit in ("<div>x", "<p><table><tr><td>y", "<a b='", "<", "<!--", "<b>", "</i>", "<script>", "word, "):
        extraction.main_text("<p>" + unit * 50_000)
    junk = "".join(rng.choice(["<", ">", "/", "p", "div", " ", "'", '"', "=", "a", "&", "!", "--"]) for _ in range(200_000))
    extraction.main_text(junk)


def test_page_rows(spark):
    pages = spark.createDataFrame([(None, None, None, "t", 1), (1, "u", "<p>x", "t", 1), (1, "u", "<p>x", "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r["id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extraction.extract(pages).collect()) == [(0, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)]
    assert extraction.extract(pages.limit(0)).count() == 0
