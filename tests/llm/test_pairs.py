"""Jaccard join, embeddings and components against brute force."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from monthmatch.llm import embedding_dedup, jaccard
from monthmatch.llm.components import connected
from monthmatch.llm.embedding_dedup import near_duplicates
from monthmatch.llm.jaccard import bands_for, jaccard_classes, word_digest
from monthmatch.llm.queries import ORACLES, op9_jaccard_join


def roots(links):
    out, todo = {}, sorted(links)
    for k in todo:
        if k in out:
            continue
        stack = [k]
        while stack:
            u = stack.pop()
            if u not in out:
                out[u] = k
                stack += links[u]
    return out


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**6) ** bands_for(0.8, 0.999, 6) >= 0.999


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)],
    [(700, k) for k in range(600)] + [(900, k) for k in range(599, 2000)] + [(k, k + 1) for k in range(3000, 3020)]])
def test_components(spark, tmp_path, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    links = {}
    for a, b in edges:
        if a is not None and a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    assert {r.node: r.root for r in connected(df, str(tmp_path)).collect()} == roots(links)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = [[f"w{v}" for v in rng.integers(0, 5000, n)] for n in (12, 40, 80, 200, 400)]
    rows = []
    for words in base:
        for k in range(14):
            copy = list(words)
            for _ in range(k // 3):
                copy[int(rng.integers(0, len(copy)))] = f"x{rng.integers(0, 10**6)}"
            rows.append(" ".join(copy) if k % 4 else "  ".join(copy).upper() + "\n")
    rows += [None, "", "  ", "two words", "Two  Words", "one", "word " * 30_000]
    return list(enumerate(rows))


@pytest.mark.parametrize("blocks", [(1024, 256), (3, 3)])
def test_join_like_brute_force(spark, texts, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(jaccard, "BLOCK", blocks[1])
    df = spark.createDataFrame([(i, t, "own") for i, t in texts], "doc_id long, text string, class_id string")
    sets = {i: grams(t) for i, t in texts}
    same = {i: " ".join((t or "").lower().split()) for i, t in texts}
    links = {i: set() for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and (same[i] == same[j] or (a | b and len(a & b) >= 0.8 * len(a | b))):
                links[i].add(j)
    root = roots(links)
    got = {r.doc_id: r for r in jaccard_classes(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(s) for i, s in links.items()}
    assert {i: r.group_id for i, r in got.items()} == root
    assert {i for i, r in got.items() if r.kept} == set(root.values())


def test_join_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard_classes(spark.createDataFrame([], schema)).count() == 0
    # A row without an id is a document as others.
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v"), (None, "x"), (None, "X ")]
    got = [(r.doc_id, r.n_links, r.group_id, r.kept) for r in jaccard_classes(spark.createDataFrame(rows, schema)).collect()]
    want = [(1, 2, 1, True)] * 2 + [(None, 2, 1, False), (2, 0, 2, True)] + [(None, 1, None, True)] * 2
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_join_of_repeated_ids_with_other_words(spark):
    words = [f"w{k}" for k in range(40)]
    a, b = " ".join(words), " ".join(f"v{k}" for k in range(40))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "q r s t u v"), (4, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.digest): r for r in jaccard_classes(df).collect()}
    digest = [r[0] for r in df.select(word_digest(F.col("text"))).collect()]
    by_row = [got[(i, d)] for (i, _), d in zip(rows, digest, strict=True)]
    assert [r.n_links for r in by_row] == [1, 1, 1, 1, 0, 0]
    assert [r.group_id for r in by_row] == [1, 1, 1, 1, 4, 4]
    assert [r.kept for r in by_row] == [True, True, False, False, True, True]
    # Each of the four groups keeps one document.
    docs = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[1], rows[4], rows[5]])


def test_join_like_its_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        words = [f"w{v}" for v in rng.integers(0, 9, 14)]
        rows += [(int(rng.integers(0, 40)), " ".join(words)), (None if k % 7 == 0 else k % 9, " ".join([*words, "more"]))]
    rows += [(None, None), (1, ""), (None, ""), (1, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = [tuple(r) for r in db.execute(ORACLES["op9_jaccard_join"]).fetchall()]
    got = [tuple(r) for r in op9_jaccard_join(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(60, 16))
        for c in centres:
            for _ in range(rng.integers(1, 6)):
                v = c + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 0.4])
                rows.append((label, v * rng.choice([1, 3.5])))
        rows += [(label, centres[0])] * 40
    return [(k, [float(x) for x in v], label) for k, (label, v) in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_like_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    odd = [
        (900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0),
        (905, [1.0] * 16, None), (906, [1.0] * 16, None), (907, [float("inf")] + [1.0] * 15, 0), (None, [1.0] * 16, 1),
        (908, [1.0, 2.0], 0), (909, [2.0, 4.0], 0), (910, [1e200] * 16, 7), (911, [1e-200] * 16, 7),
    ]
    df = spark.createDataFrame(
        [(i, v, label, "own") for i, v, label in [*vectors, *odd]],
        "vec_id long, embedding array<double>, label int, kept string",
    )
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    x = np.asarray([v for _, v, _ in vectors])
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    label = np.asarray([a for _, _, a in vectors])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= n for i, n in enumerate(linked.sum(1))) and found >= 0.98 * linked.sum()
    if found == linked.sum():
        root = roots({i: set(np.flatnonzero(r).tolist()) for i, r in enumerate(linked)})
        assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in root)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (*range(900, 908), None))
    assert (got[909].n_links, got[909].component_id, got[911].component_id) == (1, 908, 910)
    assert near_duplicates(df.limit(0)).count() == 0


def test_vectors_beyond_the_sample(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    all_of_them = near_duplicates(df).agg(F.sum("n_links")).first()[0]
    few = near_duplicates(df, sample=30).agg(F.sum("n_links")).first()[0]
    assert few >= 0.9 * all_of_them
