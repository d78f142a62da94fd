"""Likeness of long texts that repeat themselves, against the true share of common runs."""

from __future__ import annotations

from collections import Counter
from math import sqrt

import pytest

from monthmatch.llm import fingerprint as fp


def true_likeness(a, b):
    """The cosine of how often each run of three words is in the texts."""

    def runs(text):
        out = Counter()
        for paragraph in text.split("\n"):
            words = paragraph.split()
            out.update(tuple(words[i : i + 3]) for i in range(len(words)))
        return out

    x, y = runs(a), runs(b)
    return sum(n * y[r] for r, n in x.items()) / sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


LINE = " ".join(f"w{k * 7919 % 10_007}" for k in range(50)) + "\n"


@pytest.mark.parametrize(
    "text, following",
    [
        ("again " * 40_000, "other " * 40_000),
        ("again " * 200_000, "other " * 200_000),
        ("again\n" * 70_000, "other words\n" * 70_000),
        (LINE * 20_000, "none of the same words here " * 100_000),
    ],
)
def test_long_repetitive_texts(spark, text, following):
    edit = fp.edited_text(text, following)
    own, near, far = fp.fingerprints([text, edit, following])
    want = true_likeness(text, edit)
    assert want > 0.6 and abs(fp.likeness(own, near) - want) < 0.1
    assert fp.likeness(own, far) < 0.3
    df = spark.createDataFrame([(1, text), (2, following)], "doc_id long, text string")
    got = {r.doc_id: r for r in fp.fingerprint_edits(df).collect()}
    assert (got[1].fingerprint, got[1].edited_fingerprint) == (own, near)
    assert got[1].near_edited == fp.likeness(own, near)
    # Still homomorphic beyond what the lanes hold.
    assert fp.combined(fp.combined(own, far), far, -1) == own
