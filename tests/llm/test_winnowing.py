import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from monthmatch.llm.winnowing import find_contamination, winnowed
from monthmatch.llm.words import Words, runs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return WORD.findall((text or "").translate(lower))


def by_hand(docs, items, window=10):
    """The contract read plainly: every window of every item at every place."""
    windows = {}
    for item_id, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[tuple(w[i : i + size])]
        listed = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(listed), listed, bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    d = d.withColumns({"item_id": F.lit("x"), "key": F.lit(1), "row": F.lit(2), "words": F.lit(3)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    return sorted((tuple(r) for r in find_contamination(d, b, **more).collect()), key=repr)


def test_words_are_those_of_the_pattern():
    texts = ["", "Äpfel und BIRNEN-42_x", "a", "b", None, " \n", "Ⅷ İ ſ", "z" * 300 + " " + "z" * 301, "日本 語"]
    words = Words(pa.array(["before", *texts]).slice(1))
    got = [[words.word(i).decode() for i in range(a, b)] for a, b in zip(words.starts, words.starts[1:])]
    assert got == [words_of(t) for t in texts]
    hashes = words.hashes()
    same = {}
    for i in range(len(words)):
        assert same.setdefault(words.word(i), hashes[i]) == hashes[i]
    assert len(set(same.values())) == len(same)


def test_equal_windows_keep_equal_grams():
    rng = np.random.default_rng(3)
    for vocabulary in (1, 2, 50):
        h = rng.integers(0, 2**64, vocabulary, dtype=np.uint64)[rng.integers(0, vocabulary, 400)]
        grams = runs(h, 5)
        kept = winnowed(grams, np.arange(391), 6)
        assert ((kept >= np.arange(391)) & (kept <= np.arange(391) + 5)).all()
        for i, at in enumerate(kept):
            window = grams[i : i + 6].tolist()
            assert at - i == 5 - window[::-1].index(min(window))


@pytest.mark.parametrize("vocabulary", [2, 4, 300])
def test_against_brute_force(spark, vocabulary):
    rng = np.random.default_rng(vocabulary)

    def text(n):
        return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))

    items = [(i, text(int(rng.integers(1, 40)))) for i in range(30)]
    docs = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 40)))]
        for k in rng.integers(0, 30, int(rng.integers(0, 4))):
            w = items[k][1].split()
            a = int(rng.integers(0, len(w)))
            parts += [" ".join(w[a : a + int(rng.integers(5, 30))]).upper(), text(int(rng.integers(0, 9)))]
        docs.append((i, ", ".join(parts)))
    assert found(spark, docs, items) == by_hand(docs, items)
    assert found(spark, docs, items, window=6, gram=6) == by_hand(docs, items, 6)


def test_rows_of_all_kinds(spark):
    span = "one two three four five six seven eight nine ten"
    items = [
        (1, span + " eleven"), (2, "Zero " + span), (1, "short item"), (None, "no id at all"),
        (3, None), (4, ""), (5, "..."), (10, span), (9, "Überall ein"), (6, "short item"),
    ]
    docs = [
        (1, None), (2, ""), (3, "short"), (4, "a SHORT\titem!"), (4, "a SHORT\titem!"), (4, "other"), (None, span),
        (None, None), (5, "x " + span.replace(" ", "--") + " y " + span), (6, "no id at all"), (7, span[:-4]),
        (8, "überall ein Überall ein"), (9, (span + " ") * 300), (10, "short " * 20_000 + "item"), (11, "q" * 200_000),
    ]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b"), (2, None)], []) == by_hand([(1, "a b"), (2, None)], [])


def test_a_full_map_changes_nothing(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 80))) for i in range(9)]
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 50)) + " " + items[i % 9][1][20:130]) for i in range(20)]
    assert found(spark, docs, items, map_bits=6) == by_hand(docs, items)


def test_a_gram_has_to_fit(spark):
    with pytest.raises(ValueError):
        found(spark, [], [], window=3, gram=5)
