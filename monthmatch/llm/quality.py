"""Quality classifier learnt from trusted positives and unlabelled text only.

The model minimises the non-negative unbiased risk of positive-unlabelled
learning: with class prior p, positives P and unlabelled texts U,

    p * loss(P, +1) + max(0, loss(U, -1) - p * loss(P, -1)),

where the second term stands for the risk on negatives that nobody labelled.
When a batch drives it below zero, the step goes against it, so that the model
cannot fit the unlabelled texts as if all were negative. The loss is logistic,
so the outputs are probabilities. No text known to be bad is ever shown to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import text_or_empty
from monthmatch.llm.fingerprint import WordHasher

#: Texts used for fitting, at most: positives, and unlabelled ones. They are
#: those with the smallest hash of their id, which is a uniform sample.
SAMPLE = 8_000
THRESHOLD = 0.3
FOLDS = 5

_words = WordHasher()
_CLASSES = 6


def _class_table() -> np.ndarray:
    """Bytes as white space, lower, upper, digit, punctuation, part of a non-ASCII letter."""
    kind = np.full(256, 4)
    kind[:33] = 0
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[128:] = 5
    return kind


_CLASS = _class_table()
#: Counts of ASCII characters, of pairs of classes, and the numbers at the end of ``features``.
SIZE = 96 + _CLASSES**2 + 17


def features(text: str) -> np.ndarray:
    """Numbers for the form of a whole text: characters, words, repetition, lines."""
    out = np.zeros(SIZE, dtype=np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(data)
    if not n:
        return out
    ascii_counts = np.bincount(data, minlength=256)[32:128]
    out[:96] = np.sqrt(ascii_counts / n)
    kinds = _CLASS[data]
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES**2)
    out[96 : 96 + _CLASSES**2] = np.sqrt(pairs / n)
    rest = out[96 + _CLASSES**2 :]
    by_kind = np.bincount(kinds, minlength=_CLASSES) / n
    letters = by_kind[1] + by_kind[2] + by_kind[5]
    rest[0] = by_kind[2] / max(letters, 1e-9)
    rest[1] = np.log1p(n) / 10
    hashes, start = _words(data)
    if not len(hashes):
        return out
    m = len(hashes)
    _, counts = np.unique(hashes, return_counts=True)
    lengths = np.diff(np.append(start, n))
    rest[2] = lengths.mean() / 10
    rest[3] = lengths.std() / 10
    rest[4] = len(counts) / m
    rest[5] = counts.max() / m
    rest[6] = np.sqrt((counts.astype(float) ** 2).sum()) / m
    rest[7] = (hashes[1:] == hashes[:-1]).mean() if m > 1 else 0
    rest[8] = (hashes[2:] == hashes[:-2]).mean() if m > 2 else 0
    rest[9] = np.log1p(m) / 10
    # Words of three, so that repeated passages show.
    runs = hashes[:-2] * np.uint64(31) + hashes[1:-1] * np.uint64(7) + hashes[2:]
    rest[10] = len(np.unique(runs)) / len(runs) if len(runs) else 1
    rest[11] = (lengths <= 2).mean()
    rest[12] = (lengths >= 16).mean()
    lines = text.split("\n")
    rest[13] = len(lines) / m
    rest[14] = len(set(lines)) / len(lines)
    # The worst of eight equal parts: junk may fill only some of a text.
    part = np.minimum(np.arange(n) * 8 // n, 7)
    odd = np.bincount(part, weights=(kinds == 4) | (kinds == 2), minlength=8) * 8 / n
    rest[15] = odd.max()
    rest[16] = odd.min()
    return out


@dataclass(frozen=True)
class Model:
    """Standardised features through one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return _sigmoid(np.maximum(z @ w + b, 0) @ v + c)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    hidden: int = 24,
    steps: int = 700,
    batch: int = 1024,
    memory: float = 0.95,
    rate: float = 3e-3,
    decay: float = 1e-4,
    seed: int = 7,
) -> Model:
    """Minimise the non-negative risk with Adam; the same input gives the same model.

    Whether the risk on negatives has fallen below zero is told by its moving
    average, as one batch alone is too noisy when negatives are few.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean = both.mean(axis=0, dtype=np.float64).astype(np.float32)
    scale = both.std(axis=0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
    del both
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w = [
        rng.normal(0, p.shape[1] ** -0.5, (p.shape[1], hidden)),
        np.zeros(hidden),
        rng.normal(0, hidden**-0.5, hidden),
        np.zeros(()),
    ]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    risk = 0.0
    for step in range(1, steps + 1):
        xp = p[rng.integers(0, len(p), min(batch, len(p)))]
        xu = u[rng.integers(0, len(u), min(batch, len(u)))]
        x = np.concatenate([xp, xu])
        h = np.maximum(x @ w[0] + w[1], 0)
        out = h @ w[2] + w[3]
        sp, su = _sigmoid(out[: len(xp)]), _sigmoid(out[len(xp) :])
        now = np.logaddexp(0, out[len(xp) :]).mean() - prior * np.logaddexp(0, out[: len(xp)]).mean()
        risk = memory * risk + (1 - memory) * now if step > 1 else now
        # Gradients by the outputs: of the risk on positives, and of that on negatives.
        plus = -prior * (1 - sp) / len(xp)
        minus_p, minus_u = -prior * sp / len(xp), su / len(xu)
        g = np.concatenate([plus + minus_p, minus_u] if risk >= 0 else [-minus_p, -minus_u])
        back = np.outer(g, w[2]) * (h > 0)
        grads = [x.T @ back + decay * w[0], back.sum(0), h.T @ g + decay * w[2], g.sum()]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return Model(mean, scale, tuple(w))


def fold(doc_id: Column) -> Column:
    """Rows of fold 0 are held out from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float | None = None):
    """Fit a model, or return None where there is nothing to learn from.

    Only labels outside fold 0 are read. Trusted positives are documents whose
    labels all say 1; unlabelled are documents of any kind outside fold 0. The
    class prior is the share of 1 among those labels unless given, kept within
    0.05 to 0.95.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    )
    if prior is None:
        prior = known.agg(F.avg("low")).first()[0]
    if prior is None:
        return None
    prior = min(0.95, max(0.05, float(prior)))

    def bounded(ids: DataFrame, salt: str, mark: str) -> DataFrame:
        by = F.xxhash64("doc_id", F.lit(salt))
        # An id that many rows repeat counts once; of ids alone the tasks keep one each before the shuffle.
        return ids.select("doc_id").distinct().orderBy(by, "doc_id").limit(sample).withColumn("mark", F.lit(mark))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())

    learnable = docs.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    wanted = bounded(known.filter("low = 1 AND high = 1"), "p", "p").unionByName(
        bounded(learnable, "u", "u")
    )
    # One text for each sampled id and mark, the first of those that share the id: at most twice the sample.
    rows = (
        learnable.select("doc_id", text_or_empty().alias("text"))
        .join(F.broadcast(wanted), "doc_id")
        .groupBy("doc_id", "mark")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "mark", packed("text").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    p, u = (
        np.frombuffer(b"".join(r["x"] for r in rows if r["mark"] == m), np.float32).reshape(-1, SIZE)
        for m in ("p", "u")
    )
    del rows
    return fit(p, u, prior) if len(p) and len(u) else None


def score_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """Append ``held_out``, ``score`` and ``predicted`` to every document.

    Scores depend on the text alone; null and empty texts get the score of a
    text without characters. Where nothing can be learnt (no positive label
    outside fold 0, no documents) every score is 0.5. Labels without a
    document, null labels and repeated labels do no harm: a document whose
    labels differ is no trusted positive. All rows stay, repeated ones too;
    columns of the three names are replaced. No shuffle of texts.
    """
    model = learn(docs, labels, sample)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        x = np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, SIZE))
        return pd.Series(model.score(x))

    return (
        docs.withColumn("held_out", fold(F.col("doc_id")) == 0)
        .withColumn("score", score(text_or_empty()))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
