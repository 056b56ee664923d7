"""Line dedup, substring dedup and SimHash near-duplicates."""

from __future__ import annotations

import random

import numpy as np
import plain
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from lorekeep.llm import line_dedup, registry, simhash, substring_dedup

SF_DIR = "/root/testdata/sf0.001"
BIG = 1 << 62


def by_id(rows):
    return sorted(((BIG if i is None else i), t) for i, t in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    df = registry.queries()[name](spark, SF_DIR)
    assert not compare(df, connect(SF_DIR), registry.oracle_sql()[name])


def test_lines_of_edge_rows(edges, edge_rows):
    found = line_dedup.without_repeats(edges)
    assert found.columns == edges.columns
    expected = sorted((i, None if t is None else k) for (i, _, _, k), (_, t) in zip(plain.line_dedup(by_id(edge_rows)), by_id(edge_rows)))
    got = [(BIG if r.doc_id is None else r.doc_id, r.text) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.collect())


def test_lines_with_one_very_common_line(spark):
    rows = [(i, f"own line number {i}\nsame line everywhere\n{'y' * (i % 3)}") for i in range(600)]
    found = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    lost = {r._row.doc_id: r.n_dropped for r in found.collect()}
    assert lost == {i: int(i > 0) for i in range(600)}


def test_keep_bitmap_is_runs_of_lines(spark):
    rows = [(1, "a\nfirst shared line\nb\nc\nsecond shared line\nthird shared line"), (0, "first shared line\nsecond shared line\nTHIRD shared line")]
    found = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string"))
    keep = {r._row.doc_id: [tuple(x) for x in r.keep] for r in found.collect()}
    assert keep == {0: [(0, 3)], 1: [(0, 1), (2, 2)]}


def test_substrings_of_edge_rows(edges, edge_rows):
    found = substring_dedup.cut_repeats(edges).collect()
    got = sorted((BIG if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in found)
    assert got == sorted(plain.substring_dedup(by_id(edge_rows)))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_overlapping_passages(spark, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = []
    for i in range(120):
        text = [f"u{i}x{k}" for k in range(rng.randrange(9))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(380)
            text += base[a : a + rng.randrange(5, 60)]
        rows.append((i, " ".join(text)))
    rows.append((500, " ".join(["same"] * 300)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted(tuple(r) for r in substring_dedup.cut_repeats(df).collect())
    assert got == sorted(plain.substring_dedup(rows))


def test_substrings_with_a_full_index(spark, monkeypatch):
    """A bitmap with hardly any room lets everything through; the result is the same."""
    monkeypatch.setattr(substring_dedup, "SLOTS", 1 << 15)
    monkeypatch.setattr(substring_dedup, "PAGES", 1)
    rows = [(i, " ".join(f"t{(i * 7 + k) % 90}" for k in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in substring_dedup.cut_repeats(df).collect()) == sorted(plain.substring_dedup(rows))


def test_fingerprints_and_components_match_brute_force(small, edges, edge_rows):
    table = [(r.doc_id, r.text) for r in small.collect()]
    for df, rows in ((small, table), (edges, by_id(edge_rows))):
        fps = {i: plain.fingerprint(t) for i, t in rows}
        expected = plain.components(list(fps.items()))
        found = simhash.near_duplicates(df).collect()
        assert len(found) == len(rows)
        for r in found:
            i = BIG if r.doc_id is None else r.doc_id
            assert r.fp & (2**64 - 1) == fps[i]
            assert r.component_id == expected[i] or (i == BIG and r.component_id == (1 << 63) - 1)


@pytest.mark.parametrize("reach", [simhash.NARROW, simhash.WIDE])
def test_rules_miss_no_pair(reach):
    rng = random.Random(3)
    for _ in range(3000):
        apart = np.uint64(sum(1 << b for b in rng.sample(range(64), rng.randrange(reach.distance + 1))))
        assert any(
            apart & np.uint64(mask) == 0 and all(np.bitwise_count(apart & bits) <= most for bits, most in reach.chains(start))
            for start, mask in reach.rules
        )


@pytest.mark.parametrize("reach", [simhash.NARROW, simhash.WIDE])
def test_links_of_crowded_fingerprints(spark, reach):
    rng = random.Random(5)
    known = set()
    for centre in (rng.getrandbits(64) for _ in range(6)):
        for _ in range(60):
            fp = centre
            for b in rng.sample(range(64), rng.randrange(2 * reach.distance)):
                fp ^= 1 << b
            known.add(fp)
    signed = {fp: int(np.uint64(fp).astype(np.int64)) for fp in known}
    nodes = spark.createDataFrame([(fp,) for fp in signed.values()], "fp bigint").repartition(6)
    edges = simhash.links(nodes, reach)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    expected = plain.components([(i, fp) for fp, i in signed.items()], reach.distance)
    assert {i: found.get(i, i) for i in expected} == expected
    unsigned = {i: fp for fp, i in signed.items()}
    assert all((unsigned[e.a] ^ unsigned[e.b]).bit_count() <= reach.distance for e in edges.collect())


def test_near_copies_of_the_stage_are_found(spark, small):
    """Texts with replaced words, by the similarity of their five-word shingles."""
    rng = random.Random(9)
    texts = [t for t in {r.text for r in small.collect()} if 80 < len(plain.words(t)) < 2000]
    rows, similar = [(i, t) for i, t in enumerate(texts)], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i, text in enumerate(texts):
        w = plain.words(text)
        changed = list(w)
        for k in rng.sample(range(len(w)), max(1, len(w) * rng.randrange(1, 6) // 200)):
            changed[k] = f"word{rng.randrange(10**6)}"
        a, b = shingles(w), shingles(changed)
        if len(a & b) / len(a | b) >= 0.8:
            similar.append(10_000 + i)
            rows.append((10_000 + i, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert len(similar) > 50 and sum(i not in kept for i in similar) >= 0.9 * len(similar)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a bigint, b bigint").repartition(5)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 901: 900}


def test_one_of_each_group_stays_with_all_columns(edges, edge_rows):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id is not null").collect())
    fps = {i: plain.fingerprint(t, 2) for i, t in by_id(edge_rows)}
    groups = plain.components(list(fps.items()), 7)
    assert ids == sorted(i for i, _ in by_id(edge_rows) if groups[i] == i and i != BIG)


def test_rows_are_told_apart_by_their_own_texts(spark):
    """Rows without an id, and texts under one id, join no groups of each other."""
    rng = random.Random(8)
    text = lambda: " ".join(f"t{rng.randrange(900)}" for _ in range(60))
    one, two, three, alone, other, both = (text() for _ in range(6))
    rows = [(7, one), (None, one.upper()), (900, two), (None, two.upper()), (None, alone), (5, other), (5, three), (6, three), (None, both)]
    rows += [(None, both.upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {(r.doc_id, r.text) for r in simhash.keep_one(df).collect()}
    assert kept - {(None, both), (None, both.upper())} == {(7, one), (900, two), (None, alone), (5, other), (5, three)}
    assert len(kept) == 6
    groups = {r.fp: r.component_id for r in simhash.near_duplicates(df).filter("doc_id is not null").collect()}
    assert sorted(groups.values()) == [5, 5, 7, 900]


def test_rows_of_one_id_are_told_apart_by_more_than_32_bits(spark, monkeypatch):
    """Two rows without an id whose 32-bit hashes are equal."""
    from pyspark.sql import functions as F

    texts = spark.range(200_000).select(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(30)]).alias("text"))
    twins = texts.withColumn("h", F.hash("text")).groupBy("h").agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).first()
    one, two = twins["t"][:2]
    rows = [(None, one), (None, two), (1, two)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    removed = sorted(r.n_removed for r in substring_dedup.cut_repeats(df).collect())
    assert removed == [0, 0, 30]


def test_empty_tables(nothing):
    assert line_dedup.without_repeats(nothing).count() == 0
    assert substring_dedup.cut_repeats(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).columns == nothing.columns


def test_line_dedup_has_no_python(edges):
    plan = line_dedup.without_repeats(edges.select(F.col("doc_id"), F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
