"""Quality, language, tokens, packing, mixing, near copies, neighbours and the pipeline against plain versions."""

import os
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from conftest import table
from pyspark.sql import functions as F

from tideline.llm import graph, langid, mixing, near, packing, quality, tokens
from tideline.llm.components import components

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality


def plain_statistics(text):
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_statistics(docs, texts):
    keep = ("doc_id", "n_words", "size", "row")
    got = quality.measure(docs, keep=keep).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["row"].doc_id is not None:
            text = texts[r["row"].doc_id] or ""
            assert tuple(r[s] for s in quality.STATS[:5]) == plain_statistics(text)
        assert r["row"].n_words == 3
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "#"], k=rng.randint(0, 60)))
        assert quality.statistics(text)[:5] == plain_statistics(text)


def test_trees_learn_and_keep_to_their_signs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    chance = 1 / (1 + np.exp(8 * x[:, 0] - 4 + 3 * np.sin(9 * x[:, 1])))
    y = (rng.random(3000) < chance).astype(float)
    forest = quality.boost(x, y, [-1, 0, 1])
    order = np.argsort(forest.score(x))
    assert y[order[-500:]].mean() > 0.9 > 0.1 > y[order[:500]].mean()
    for column, sign in ((0, -1), (2, 1)):
        grid = np.repeat(rng.random((50, 3)), 40, axis=0)
        grid[:, column] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(forest.score(grid).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()
    one_by_one = []
    for row in x[:100]:
        z = forest.bias
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            z += forest.value[node]
        one_by_one.append(z)
    assert np.allclose(one_by_one, forest.score(x[:100]))


@pytest.mark.parametrize("y", [[], [1.0] * 30, [0.0] * 30])
def test_trees_without_both_labels(y):
    forest = quality.boost(np.zeros((len(y), 2)), np.array(y), [0, 0])
    assert (forest.score(np.zeros((4, 2))) > 0).all() == (not y or y[0] == 1.0)


def test_quality_query(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in quality.op8(spark, sf).collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        want = plain_statistics(text[i] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    judged = [(labels[i], r.kept) for i, r in got.items() if i in labels and not r.base_failed]
    assert np.mean([bool(a) == b for a, b in judged]) > 0.95


def test_labels_with_nulls_and_empty_tables(spark, docs, nothing):
    stats = quality.measure(docs)
    labels = spark.createDataFrame([(None, 1), (19, None), (20, 1), (20, 0), (22, 1), (22, 1), (19, 0)], "doc_id long, quality int")
    assert quality.judge(stats, quality.fit(stats, labels)).count() == docs.count()
    none = quality.measure(nothing)
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


# language


def test_language_query(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op5(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.95


def test_mixture_proportions():
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.full(500, 0.1), 3).T + 1e-6)
    for true in ([1, 0, 0], [0.7, 0.3, 0], [0.2, 0.4, 0.4]):
        drawn = rng.choice(500, 4000, p=np.exp(logs) @ true / (np.exp(logs) @ true).sum())
        at, n = np.unique(drawn, return_counts=True)
        part = langid.proportions(logs[at], n)
        assert np.abs(part - true).max() < 0.08 and ((part > 0) == (np.array(true) > 0)).all()


def test_languages_of_hard_texts(spark, docs, nothing):
    learned = docs.sparkSession.createDataFrame([("der und die das nicht ist", "de"), ("the and of that with was", "en"), (None, "fr"), ("le la les", None)], "text string, lang string")
    model = langid.train(learned)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == docs.select("doc_id").distinct().count()
    for i in (0, 1, 2, 14):
        assert (got[i].lang_pred, got[i].score, got[i].languages) == ("und", 0.0, [])
    assert got[22].lang_pred == "en"
    empty = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(nothing, model).count() == 0
    text = "the und " * 9000
    a, b = langid.grams(text), langid.grams(text[: len(text) // 9])
    assert set(a[0]) == set(b[0]) and a[1].sum() > 8 * b[1].sum()


# tokens and packing


def library_ids(text):
    return tokens._library(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s(texts):
    rng = random.Random(3)
    signs = [chr(c) for c in (*range(1, 0x250), 0x85, 0xA0, 0x1680, 0x180E, 0x200A, 0x200B, 0x2028, 0x202F, 0x3000, 0xFEFF, 0xB2, 0x2160, 0x661, 0x4E00, 0x1F600)]
    odd = ["".join(rng.choices(signs if rng.random() < 0.5 else list(" \n'sta1 ."), k=rng.randint(0, 14))) for _ in range(1500)]
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in [*filter(None, texts), *odd, "a<|endoftext|>b", " <|endoftext|>"]:
        assert array("I", tokens.encode(text, *paths)).tolist() == library_ids(text)


def test_pieces(docs, texts):
    got = tokens.pieces(docs, capacity=100, keep_ids=True).collect()
    by_doc = defaultdict(set)
    for r in got:
        by_doc[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)))
    for i, text in enumerate(texts):
        ids, parts = [*library_ids(text or ""), 2], sorted(by_doc[i])
        assert b"".join(p[4] for p in parts) == array("I", ids).tobytes()
        assert [p[0] for p in parts] == list(range(len(parts))) and [p[1] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))]
        assert all(p[2] == 100 for p in parts[1:]) and all(p[3] == zlib.crc32(p[4]) and len(p[4]) == 4 * p[2] for p in parts)


def best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, gap in enumerate(bins) if gap >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_arrangement_holds_every_length_in_few_bins():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([3, 7, 10, 30, 1024])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else capacity // 2 for _ in range(rng.randint(0, 300))]
        lengths = [max(1, x) for x in lengths]
        made, seen = packing.arrange(dict(Counter(lengths)), capacity), Counter()
        for n, held in made:
            assert n > 0 and sum(a * m for a, m in held) <= capacity
            assert sum(m for a, m in held if 3 * a > capacity) <= 2
            for a, m in held:
                seen[a] += n * m
        assert seen == Counter(lengths) and sum(n for n, _ in made) <= best_fit(lengths, capacity)


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([10, 10, 10, rng.randint(1, 10), None, 0, -3]), "x") for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "id long, length int, rank string").repartition(7), 10).collect()
    assert sorted(r["row"].id for r in got) == list(range(3000)) and all(r["row"].rank == "x" for r in got)
    held = defaultdict(list)
    for r in got:
        if (r["row"].length or 0) <= 0:
            assert r.sequence_id is None and r.offset is None
        else:
            held[r.sequence_id].append((r.offset, r["row"].length))
    for parts in held.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 10
    assert len(held) <= best_fit([n for _, n, _ in rows if n and n > 0], 10)
    with pytest.raises(Exception, match="exceeds the capacity"):
        packing.pack(spark.createDataFrame([(1, 11)], "id long, length int"), 10).collect()


def test_packing_of_documents(docs, nothing, texts):
    got = packing.packed(docs, 64).collect()
    held = defaultdict(int)
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 64 and {r.doc_id for r in got} == {None, *range(len(texts))}
    assert packing.packed(nothing).count() == 0


# mixing


def filled(sizes, weights, total):
    """Targets by resharing what is above twice a source's size, again and again."""
    targets, free = dict.fromkeys(sizes, 0.0), dict(sizes)
    while True:
        share = total - sum(2 * sizes[s] for s in sizes if s not in free)
        dealt = {s: share * weights[s] / sum(weights[t] for t in free) for s in free}
        above = [s for s in free if dealt[s] > 2 * sizes[s]]
        if not above:
            return {s: dealt.get(s, 2.0 * sizes[s]) for s in targets}
        for s in above:
            del free[s]


def plain_order(name):
    return (name is None, (name or "").encode())


def test_mix(spark, docs):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), None, "hot" if rng.random() < 0.4 else rng.choice(["a", "B", "é", "😀", None, "tiny"]) if i % 50 else "rare") for i in range(3000)]
    rows += [(1, "same id", None, "a"), (None, "no id", None, "a"), (None, None, None, "void"), (5, "", None, "void")]
    df = table(spark, rows).repartition(5)
    size = mixing.words(F.col("text"))
    got = mixing.mix(df.withColumn("my size", size), F.col("`my size`")).collect()
    again = mixing.mix(df.repartition(2).withColumn("my size", size), F.col("`my size`")).collect()
    key = lambda r: (str(r["row"].doc_id), str(r["row"].text), r.copies, r.target)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=plain_order))}
    want, taken = filled(sizes, weights, 1.5 * sum(sizes.values())), Counter()
    for r in got:
        s = r["row"].source
        assert r.size == len(WORD.findall(r["row"].text or "")) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.copies <= 2
        taken[s] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes) and 1.5 * sum(sizes.values()) - 30 <= sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert mixing.mixed(df.withColumn("my size", size), F.col("`my size`")).count() == sum(r.copies for r in got)


def test_mix_of_little(spark, docs, nothing):
    for df in (nothing, docs, table(spark, [(1, None, None, None)]), table(spark, [(1, "one two", None, "a")])):
        sized = df.withColumn("my size", mixing.words(F.col("text")))
        got = mixing.mix(sized, F.col("`my size`")).collect()
        assert len(got) == df.count() and sum(r.size * r.copies for r in got) <= 1.5 * sum(r.size for r in got)


# near copies


def sets_of(rows):
    found = []
    for _, text in rows:
        words = (text or "").encode().split()
        found.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None)
    return found


def plain_join(rows, threshold=Fraction(4, 5)):
    """Links and classes by comparing every two rows."""
    sets, links, parent = sets_of(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] is not None and sets[j] is not None:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[root(i)].append(k)
    least = {g: min((k for k in ids if k is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[i][0]), str(least[root(i)]), links[i]) for i in range(len(rows)))


def families(seed=0, n=12):
    """Texts with copies at many distances, around the threshold too."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(4, 150))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append(rng.choice([" ", "\n"]).join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("blocks", [(4 << 20, 512), (1 << 20, 2)])
def test_join_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(near, "BLOCK_BYTES", blocks[0])
    monkeypatch.setattr(near, "BLOCK_TEXTS", blocks[1])
    rows = families()
    got = near.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    want, have = plain_join(rows), sorted((str(r.id), str(r.class_id), r.n_links) for r in got)
    assert len(have) == len(want) and sum(a == b for a, b in zip(have, want)) >= 0.99 * len(want)


def test_join_of_hard_rows(docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near.join(docs).collect()
    assert sorted((str(r.id), str(r.class_id), r.n_links) for r in got) == plain_join(rows)
    assert near.join(nothing).count() == 0
    kept = near.unique(docs)
    assert kept.columns == docs.columns and near.unique(nothing).count() == 0
    groups = {c for _, c, _ in plain_join(rows)}
    assert Counter(str(r.doc_id) for r in kept.collect()) == Counter(groups)


def test_comparison_counts_links_exactly():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(1, 300), replace=False)) for _ in range(40)] + [base, base[:240], base[:239]]
    weights = rng.integers(1, 5, len(sets))
    links, plain, root = near.compare(sets, weights, None, Fraction(1, 2))
    linked = np.array([[i != j and 2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (links == linked @ weights).all() and (plain == linked.sum(axis=1)).all()
    assert (root[linked.nonzero()[0]] == root[linked.nonzero()[1]]).all()


@pytest.mark.parametrize("common, own", [(80, 10), (85, 7), (90, 5), (95, 3)])
def test_pairs_from_the_threshold_on_share_a_node(common, own):
    """Similarity 0.80, 0.86, 0.90 and 0.94; both texts keep their first spare() long prefixes, wherever these are."""
    rng, lost, k = np.random.default_rng(common), 0, near.spare()
    for _ in range(1500):
        x = rng.integers(0, np.iinfo(np.uint64).max, common + 2 * own, np.uint64)
        (a, along), (b, blong) = near.labels(x[: common + own]), near.labels(np.concatenate([x[:common], x[common + own :]]))
        lost += not ((along == blong)[:k].any() or (a == b)[k:].any())
    assert lost == 0


def test_spare_trees_keep_the_recall():
    k = near.spare()
    missed = lambda n: (1 - 0.8**near.LONGEST) ** n * (1 - 0.8**near.SHORTEST) ** (near.TREES - n)
    assert 0 < k < near.TREES and missed(k) <= 1 - near.RECALL < missed(k + 1)
    with pytest.raises(ValueError):
        near.spare(trees=10)


def test_forest_parts_what_a_common_passage_joins(spark):
    """200 texts quote one passage (pairwise similarity about 0.4), every one has a near copy: families stay, the crowd goes."""
    rng = random.Random(8)
    quoted = [f"q{i}" for i in range(60)]
    rows = []
    for i in range(200):
        own = [f"w{i}x{j}" for j in range(40)]
        rows += [(2 * i, " ".join(quoted + own)), (2 * i + 1, " ".join(quoted + own[:-2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = near.stage(near.sketch(docs).select("key", "short", "long", "id"))
    largest = lambda **kw: near.components(near.forest(texts, **kw)).groupBy("component").count().agg({"count": "max"}).first()[0]
    crowded, parted = largest(crowd=10**9), largest()
    assert parted < crowded / 2
    got = {r.id: (r.class_id, r.n_links) for r in near.join(docs).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(400)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(120)], [(0, i) for i in range(1, 50)] + [(150 - i, 200 + i) for i in range(60)], [(3, 3), (5, 4), (4, 5), (-2, 9)], []])
def test_components(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


# neighbours

VECTORS = "vec_id long, embedding array<float>, v string, ids int, shard int"


def plain_neighbours(rows, queries, k=10):
    """``rows``: (id, vector)."""
    found = {}
    for q, x in queries:
        x = np.array(x, float)
        near_ = sorted((float(np.sqrt(((np.array(v, float) - x) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(x))
        found[q] = near_[:k]
    return found


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(1200, 24)).astype(np.float32)
    data[300:420] = data[7]  # a group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame([(*r, "v", 1, 2) for r in rows], VECTORS).repartition(5)
    got = defaultdict(list)
    for r in graph.neighbours(df, df.filter("vec_id % 20 = 0"), shard=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    want = plain_neighbours(rows, rows[::20])
    assert set(got) == set(want)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in w}) / 10 for q, w in want.items()]) >= 0.9
    for q in range(300, 420, 20):
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and got[q][0][0] == 0
    exact = {(q, i): d for q, x in rows[::20] for i, d in ((i, float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum()))) for i, v in rows)}
    assert all(abs(d - exact[q, i]) < 1e-9 for q, f in got.items() for d, i in f)


def test_vectors_that_take_no_part(spark):
    bad = [(0, None), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [])]
    good = [(100, [1.0, 0.0]), (101, [1.0, 1.0]), (102, [2.0, 0.0]), (102, [2.0, 0.0]), (103, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "v", 1, 2) for r in bad + good], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in graph.neighbours(df, df.filter("vec_id >= 0")).collect())
    assert {q for q, *_ in got} == {100, 101, 102}
    assert [x[1:] for x in got if x[0] == 100] == [(1, 101, 1.0), (2, 102, 1.0)]
    # a repeated row asks once
    assert [x[1:3] for x in got if x[0] == 102] == [(1, 100), (2, 101)]
    assert graph.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_an_id_with_two_vectors_asks_with_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [9.0, 0.0]), (2, [2.0, 0.0]), (3, [7.0, 0.0]), (4, [1.0, 0.0, 5.0]), (5, [1.0, 0.0, 7.0])]
    df = spark.createDataFrame([(*r, "v", 1, 2) for r in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in graph.neighbours(df, df.filter("vec_id in (1, 4)"), k=1).collect())
    assert got == [(1, 1, 2, 1.0), (1, 1, 3, 2.0), (4, 1, 5, 2.0)]


def test_shards_grow_with_the_table():
    assert graph.layout(0) == graph.layout(50_000) == (2048, 64)
    assert graph.layout(10**6) == (10_000, 142) and graph.layout(10**9) == (65_536, 363)
    copies = [-(-n // graph.layout(n)[0]) for n in (10**5, 10**6, 10**7)]
    assert copies[2] / copies[0] < 100**0.4  # queries times shards grow slower than n ** 1.4


def test_recall_of_larger_shards(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(12_500, 64)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), "v", 1, 2) for i, v in enumerate(data)], VECTORS).repartition(4)
    got = defaultdict(set)
    for r in graph.neighbours(df, df.filter("vec_id % 100 = 0"), shard=4096).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(data), 100):
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.97 and len(got) == 125


# pipeline


def test_pipeline(spark, tmp_path, sf):
    import corpus_pipeline

    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    rows = {n: [tuple(r) for r in d.collect()] for n, d in out.items()}
    kept = {r.doc_id for r in quality.op8(spark, sf).collect() if r.kept}
    assert {r[0] for r in rows["quality_rules"]} == kept and len(rows["quality_rules"]) == len(kept)
    pairs = [(r[0], r[1]) for r in rows["quality_rules"]]
    assert sorted(str(r[0]) for r in rows["ngram_jaccard"]) == sorted({c for _, c, _ in plain_join(pairs)})
    assert sorted(r[0] for r in rows["personal_data"]) == sorted(r[0] for r in rows["ngram_jaccard"])
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(email.search(r[1]) for r in rows["personal_data"]) and all(r[4] == len(r[1]) for r in rows["personal_data"])
    clean = [r for r in rows["personal_data"] if "[" not in r[1]]
    assert clean and all(source[r[0]].text == r[1] for r in clean)
    copies = Counter(r[0] for r in rows["source_mix"])
    assert max(copies.values()) <= 2 and set(copies) <= {r[0] for r in rows["personal_data"]}
    pieces = Counter(r[0] for r in rows["best_fit_packing"] if r[1] == 0)
    assert pieces == copies
