"""Lexical search, quality rules and hard negatives against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import plain
import pyarrow as pa

from lorekeep.llm import hard_negatives, lexical_search, quality

ITEMS = [
    (1, "alpha beta Gamma alpha"),
    (2, None),
    (3, " ... "),
    (4, "the same PASSAGE word7 word7 é"),
    (4, "日本語 𝒳 epsilon"),
    (1, "alpha beta Gamma alpha"),
    (None, "epsilon no id"),
    (9, "nowhere"),
]
ITEM_SCHEMA = "item_id bigint, text string, item bigint, term string, score bigint"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(plain.UPPER))


def ranked(docs, items, k):
    docs = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, counts, n in docs:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(weight[t] * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if t in counts)
            if score:
                scores.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_matches_plain(spark, edges, edge_rows):
    items = spark.createDataFrame([(i, t, 1, "t", 2) for i, t in ITEMS], ITEM_SCHEMA)
    for k, group in ((20, 1 << 14), (3, 4), (1, 1)):
        assert rows_of(lexical_search.rank(edges, items, k, group)) == ranked(edge_rows, ITEMS, k)


def test_search_of_many_documents(spark):
    draw = random.Random(3)
    word = lambda: f"w{int(draw.paretovariate(0.6))}"
    docs = [(i, " ".join(word() for _ in range(draw.randint(1, 60)))) for i in range(3000)]
    items = [(i, " ".join(word() for _ in range(draw.randint(1, 12)))) for i in range(30)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(lexical_search.rank(frames[0].repartition(5), frames[1], 7)) == ranked(docs, items, 7)


def test_search_without_documents_or_items(spark, nothing):
    items = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    for docs, asked in ((nothing, items), (items.withColumnRenamed("item_id", "doc_id"), items.limit(0))):
        found = lexical_search.rank(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


class _Asked:
    """What a part needs to know of a group."""

    def __init__(self, names, n_docs, n_terms):
        self.names, self.n_docs, self.n_terms = pa.array(names), n_docs, n_terms


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(1)
    size, n_terms = 4000, 6
    tf = np.floor(rng.pareto(0.7, (n_terms, size))).astype(np.int64)
    tf[0, 60:] = 0  # a rare term of high weight, and common ones
    term, doc = np.nonzero(tf)
    n = tf.sum(axis=0)
    group = _Asked([f"t{i}" for i in range(n_terms)], size, int(n.sum()))
    ids = rng.permutation(size).astype(np.int64)
    part = lexical_search.Part(group, ids, n, doc, term, tf[term, doc])
    weights = np.array([90, 1, 3, 2, 1, 4], np.int64)
    best = lexical_search.Best(10)
    scored = lexical_search.best_positions(part, np.arange(n_terms), weights, best)
    m = 75 + 25 * n * size // int(n.sum())
    scores = (weights[:, None] * (10**9 * tf // (1000 * tf + 12 * m))).sum(axis=0)
    order = np.lexsort((ids, -scores))[:10]
    assert best.score.tolist() == scores[order].tolist() and best.id.tolist() == ids[order].tolist()
    assert scored < size // 2
    # all documents alike: every one of them may tie, and the smallest ids win
    flat = lexical_search.Part(group, ids, np.full(size, 3), np.arange(size), np.zeros(size, np.int64), np.ones(size, np.int64))
    best = lexical_search.Best(5)
    assert lexical_search.best_positions(flat, np.array([0, 1]), np.array([7, 9]), best) == size
    assert best.id.tolist() == [0, 1, 2, 3, 4]


def base(text):
    text = text or ""
    w = plain.words(text)
    count = Counter(zip(w, w[1:], w[2:]))
    held = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if plain.words(x)]
    failed = len(w) < 50 or 100 * len(held) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held), failed


def test_base_rules_match_plain(spark, edges, edge_rows):
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab  \n\n\t#é|") for _ in range(draw.randint(0, 400))) for _ in range(150)]
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(texts)]
    more = spark.createDataFrame([(i, t, "en") for i, t in rows[len(edge_rows) :]], "doc_id bigint, text string, lang string")
    docs = edges.select("doc_id", "text", "lang").unionByName(more)
    found = quality.judged(docs, quality.references(docs))
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect()]
    assert sorted(mine, key=repr) == sorted(((i, *base(t)) for i, t in rows), key=repr)


def divergence(p, q):
    part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))


def test_distances_match_plain(spark):
    draw = random.Random(8)
    words = {"en": [f"the{i}" for i in range(90)], "fr": [f"été{i}" for i in range(90)]}
    docs = []
    for i in range(120):
        lang = draw.choice(["en", "fr"])
        text = " ".join(draw.choice(words[lang])[: draw.randint(3, 6)] + draw.choice(["", ",", "."]) for _ in range(draw.randint(60, 300)))
        docs.append((i, text.upper() if i % 10 == 0 else text, None if i % 7 == 0 else "xx" if i == 5 else lang))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4)
    model = quality.references(rows)
    bins = lambda text: [
        sum(f(c) for c in text)
        for f in (
            lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\n\x0b\x0c\r",
            lambda c: c in quality.STOPS, lambda c: c in quality.MARKS,
            lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in quality.STOPS + quality.MARKS,
            lambda c: (ord(c) < 32 and c not in "\t\n\x0b\x0c\r") or c == "\x7f", lambda c: ord(c) > 127,
        )
    ]
    bare = lambda text: [w.translate(plain.UPPER).strip(quality.TRIMMED) for w in plain.words(text)]
    share = lambda x: [v / max(1, sum(x)) for v in x]
    labelled = [(t, lang) for _, t, lang in docs if lang]
    whole = sum(len(t) for t, _ in labelled)
    langs = sorted({x for _, x in labelled if sum(len(t) for t, y in labelled if y == x) >= quality.SHARE * whole})
    assert model["langs"] == langs
    refs = {}
    for lang in langs:
        own = [t for t, x in labelled if x == lang]
        counts = Counter(w for t in own for w in bare(t))
        common = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: quality.COMMON]
        total = sum(counts.values())
        refs[lang] = share([sum(c) for c in zip(*map(bins, own))]), {w: counts[w] / total for w in common}
    expected = []
    for i, text, lang in docs:
        w = bare(text)
        far = []
        for x in [lang] if lang in langs else langs:
            classes, common = refs[x]
            held = Counter(v if v in common else None for v in w)
            p = share([held[v] for v in common] + [held[None]])
            far.append((divergence(share(bins(text)), classes), divergence(p, [*common.values(), 1 - sum(common.values())])))
        a, b = (min(x) for x in zip(*far))
        judged = len(w) >= quality.WORD_LEAST and (lang is None or lang in langs)
        b = b if judged else None
        bad = base(text)[-1] or a > quality.CLASS_FAR
        bad = bad or (b is not None and b > math.sqrt(quality.WORD_FAR**2 + quality.COMMON / (8 * math.log(2) * len(w))))
        expected.append((i, a, b, not bad))
    found = sorted(quality.judged(rows, model).collect(), key=lambda r: r.doc_id)
    for r, (i, a, b, kept) in zip(found, expected, strict=True):
        assert r.doc_id == i and abs(r.class_distance - a) < 1e-5 and r.kept == kept
        assert (r.word_distance is None) == (b is None) and (b is None or abs(r.word_distance - b) < 1e-5)
    assert {r.kept for r in found} == {True, False}


def test_good_documents_keep_their_columns(spark, edges, nothing):
    for docs in (edges, nothing):
        kept = quality.good_documents(docs)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        assert kept.count() <= docs.count()
    assert quality.references(nothing)["langs"] == []


def mined(rows):
    rows = [
        (k, i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v])
        for k, (i, lab, v) in enumerate(rows)
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, anchor, label, v in rows:
        if anchor % 100:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: B023, E731
        others = sorted((-score(w), i, own) for j, i, own, w in rows if j != k)
        for s, positive, _ in [x for x in others if x[2] == label][:5]:
            window = [x for x in others if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(anchor, positive, r, i, -s, -t) for r, (t, i, _) in enumerate(window[:10], 1)]
    return sorted(out)


def vector_rows():
    draw = random.Random(11)
    rows = [(i, draw.randrange(4), [draw.gauss(0.1, 0.3) for _ in range(19)]) for i in range(500)]
    rows += [rows[100], rows[100], rows[7], rows[0]]
    rows += [(600, 1, [0.5] * 3), (601, 1, []), (602, 1, [0.25] * 40), (700, 2, [-3.0, 1e4] * 8), (None, 1, [1.0]), (800, None, [1.0])]
    rows += [(900, 3, None), (901, 3, [1.0, None]), (902, 3, [float("nan")]), (1000, 3, [float("inf")]), (-100, 2, [1.0] * 19)]
    return rows


VECTORS = "vec_id bigint, label int, embedding array<double>, uid bigint, v string, rank int, pair bigint"


def test_hard_negatives_match_plain(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, "v", 2, 3) for r in rows], VECTORS).repartition(4)
    for size in (hard_negatives.GROUP_BYTES, 500):
        assert rows_of(hard_negatives.mine(table, size)) == sorted(mined(rows), key=repr)


def test_hard_negatives_of_equal_and_no_vectors(spark):
    same = [(i, i % 2, [0.5, 0.25]) for i in range(0, 60)] + [(i, i % 2, [0.25, 0.1]) for i in range(60, 120)]
    table = spark.createDataFrame([(*r, 1, "v", 2, 3) for r in same], VECTORS)
    assert rows_of(hard_negatives.mine(table)) == sorted(mined(same), key=repr) != []
    assert hard_negatives.mine(table.limit(0)).count() == 0
    assert hard_negatives.mine(table.filter("vec_id % 100 <> 0")).count() == 0


def test_bit_planes_hold_whole_numbers():
    rng = np.random.default_rng(2)
    for bits, dim in ((1, 1), (9, 64), (30, 13), (62, 9)):
        values = rng.integers(-(1 << bits), 1 << bits, (37, dim))
        planes = hard_negatives.bit_planes(values)
        assert (hard_negatives.integers(planes, dim) == values).all()
        anchors = rng.integers(-300, 300, (5, dim))
        with np.errstate(over="ignore"):
            assert (hard_negatives.scores(planes, anchors) == values @ anchors.T).all()
    assert hard_negatives.bit_planes(np.zeros((3, 8), np.int64)).shape == (1, 3, 1)
