import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmatch.llm import term_trie
from monthmatch.llm.term_trie import rank_documents
from tests.llm.test_winnowing import words_of


def by_hand(docs, items, top=10):
    """Every document scored for every item."""
    counts = [(doc_id, Counter(words_of(text))) for doc_id, text in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    documents, terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in counts:
            m = 100 - 75 + (75 * n * documents) // terms
            score = 0
            for t in words_of(text):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (down, null, doc_id) in enumerate(sorted(scored)[:top], 1):
            out.append((item_id, rank, None if null else doc_id, -down))
    return sorted(out, key=repr)


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    d = d.withColumns({c: F.lit("x") for c in ("n", "terms", "item_id", "counts", "item")})
    b = spark.createDataFrame(items, "item_id long, text string")
    b = b.withColumns({c: F.lit(1) for c in ("doc_id", "item", "rank")})
    return sorted((tuple(r) for r in rank_documents(d, b, **more).collect()), key=repr)


@pytest.mark.parametrize("postings", [40, 3000, 1 << 21])
def test_against_brute_force(spark, postings):
    rng = np.random.default_rng(postings)

    def text(n, most):
        return " ".join(f"W{int(k)}" for k in np.minimum(rng.zipf(1.4, n), most))

    docs = [(i, text(int(rng.integers(0, 60)), 300)) for i in range(300)]
    # Copies and documents that begin alike.
    docs += [(1000 + i, docs[i % 7][1]) for i in range(80)]
    items = [(i, text(int(rng.integers(1, 30)), 400)) for i in range(25)]
    assert ranked(spark, docs, items, block_postings=postings) == by_hand(docs, items)
    assert ranked(spark, docs, items, block_postings=postings, item_bytes=300, top=3) == by_hand(docs, items, 3)


def test_rows_of_all_kinds(spark):
    docs = [
        (1, None), (2, ""), (3, "?!"), (4, "apple Äpfel"), (4, "apple Äpfel"), (4, "pear"), (None, "apple Äpfel"),
        (None, "apple Äpfel"), (5, "APPLE " * 50_000), (6, "äpfel"), (7, "y" * 100_000), (8, "quince 9"),
    ]
    items = [
        (1, "apple"), (1, "apple"), (1, "Äpfel apple apple"), (2, None), (3, ""), (4, "unknown"), (None, "pear"),
        (5, "9 " * 300 + "y" * 100_000), (6, "--"),
    ]
    assert ranked(spark, docs, items) == by_hand(docs, items)


def test_common_terms_weigh_nothing(spark):
    docs = [(i, "all have this") for i in range(2000)]
    assert by_hand(docs, [(1, "this")]) == ranked(spark, docs, [(1, "this")]) == []


def test_ties_go_by_id(spark):
    docs = [(i, "same text") for i in reversed(range(40))] + [(i, "else") for i in range(100, 160)]
    assert ranked(spark, docs, [(1, "text")]) == by_hand(docs, [(1, "text")])


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a")], []) == []


def test_branches_are_left_out():
    rng = np.random.default_rng(1)
    n, width = 5000, 400
    ranks = [np.unique(np.minimum(rng.zipf(1.3, 12), width) - 1) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in ranks])])
    flat = np.concatenate(ranks)
    trie = term_trie.Trie(
        np.arange(n), np.zeros(n, bool), rng.integers(30, 200, n), ends, flat, rng.integers(1, 5, len(flat)), width
    )
    item = [(3, 900), (150, 4000), (299, 6000)]
    # No bound is below what a document of the subtree scores.
    bounds, (scores, _, _) = trie.bounds(item), trie._scores(item, 0, n)
    assert all(scores[a:b].max() <= bounds[k] for k, (a, b) in enumerate(zip(trie.low, trie.high)))
    visited = []
    whole = trie._scores

    def counted(item, low, high):
        visited.append(high - low)
        return whole(item, low, high)

    trie._scores = counted
    best = term_trie.Best(10)
    trie.search(item, best)
    assert [-r[0] for r in best.rows] == sorted(scores.tolist(), reverse=True)[:10]
    assert sum(visited) < n / 4
