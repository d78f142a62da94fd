"""Near duplicates among embeddings by an inverted multi-index.

Vectors are cut into halves, each half with a codebook of its own; a pair of
codewords is a cell of the product grid, and every vector is in one cell. For a
vector, the two lists of codewords, each in order of how far the vector would
have to move to fall to that codeword, are traversed together: cells are
visited in order of the two moves' sum until the sum that reaches the target
recall. Whatever is met in a visited cell is verified by its cosine.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.blocks import LINKS, batched, dealt_over_pairs, groups, link_rows, sides_of
from monthmatch.llm.common import new_folder, saved
from monthmatch.llm.components import connected

COSINE = 0.93
RECALL = 0.995
#: Vectors that codebooks are fitted on, at most: those with the smallest hash.
SAMPLE = 8192
#: Vectors of a label in a cell, about, and the most codewords of a half.
CELL, MOST_WORDS = 128, 256
BLOCK = 1024


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves, and the largest sum of moves to visit a cell for."""

    books: tuple[np.ndarray, np.ndarray]
    reach: float

    @functools.cached_property
    def gaps(self) -> list[np.ndarray]:
        """Per half the distances of all codewords from each other."""
        return [
            np.sqrt(np.maximum(np.stack([((word - book) ** 2).sum(1) for word in book]), 1e-30)) for book in self.books
        ]

    def moves(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half the nearest codeword of each unit vector, and its squared move to each other's cell."""
        nearest, moves = [], []
        cut = self.books[0].shape[1]
        for part, book, gaps in zip((x[:, :cut], x[:, cut:]), self.books, self.gaps, strict=True):
            d = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            at = d.argmin(axis=1)
            move = np.maximum(d - d[np.arange(len(d)), at][:, None], 0) / (2 * gaps[at])
            move[np.arange(len(d)), at] = 0
            nearest.append(at)
            moves.append(move**2)
        return nearest, moves

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's own cell, and all cells it visits in the order of the traversal."""
        nearest, (first, second) = self.moves(x)
        words = len(self.books[1])
        own = nearest[0] * words + nearest[1]
        orders = np.argsort(first, axis=1), np.argsort(second, axis=1)
        a = np.take_along_axis(first, orders[0], axis=1)
        b = np.take_along_axis(second, orders[1], axis=1)
        rows, cells, sums = [], [], []
        # Rank by rank of the first list, as far down the second as the sum allows.
        for i in range(a.shape[1]):
            r, j = np.nonzero(a[:, i : i + 1] + b <= self.reach)
            if not len(r):
                break
            rows.append(r)
            cells.append(orders[0][r, i] * words + orders[1][r, j])
            sums.append(a[r, i] + b[r, j])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.lexsort((np.concatenate(sums), row))
        ends = np.cumsum(np.bincount(row, minlength=len(x)))[:-1]
        return own, np.split(cell[order], ends)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _codebook(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced vectors."""
    book = np.unique(x[np.linspace(0, len(x) - 1, min(words, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        d = (book**2).sum(1) - 2 * x @ book.T
        at = d.argmin(axis=1)
        total = np.zeros_like(book)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=len(book))[:, None]
        book = np.unique(np.where(count > 0, total / np.maximum(count, 1), book), axis=0)
    return book


def fit_index(x: np.ndarray, words: int, cosine: float, recall: float, seed: int = 11) -> MultiIndex:
    """Fit codebooks on unit vectors and find the reach for the recall.

    The reach is the larger of what finds that share of made pairs just at the
    threshold, in directions at random, and of the pairs within the sample. A
    pair is found if either of the two visits the other's cell.
    """
    cut = (x.shape[1] + 1) // 2
    index = MultiIndex((_codebook(x[:, :cut], words), _codebook(x[:, cut:], words)), 0.0)
    noise = np.random.default_rng(seed).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    length = np.maximum(np.sqrt((noise**2).sum(1, keepdims=True)), 1e-30)
    made = _unit(cosine * x + math.sqrt(1 - cosine**2) * noise / length)
    reach = np.quantile(_sums(index, x, made), recall)
    i, j = [], []
    for k in range(0, len(x), 1024):
        r, c = np.nonzero(x[k : k + 1024] @ x.T >= cosine)
        i.append(r + k)
        j.append(c)
    i, j = np.concatenate(i), np.concatenate(j)
    i, j = i[i < j][: 8 * SAMPLE], j[i < j][: 8 * SAMPLE]
    if len(i):
        reach = max(reach, np.quantile(_sums(index, x[i], x[j]), recall))
    return MultiIndex(index.books, float(reach) * (1 + 1e-9) + 1e-12)


def _sums(index: MultiIndex, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smaller sum of moves from one vector of each pair to the other's cell."""
    out = []
    for k in range(0, len(x), 2048):
        (nx, mx), (ny, my) = index.moves(x[k : k + 2048]), index.moves(y[k : k + 2048])
        r = np.arange(len(nx[0]))
        there = mx[0][r, ny[0]] + mx[1][r, ny[1]]
        back = my[0][r, nx[0]] + my[1][r, nx[1]]
        out.append(np.minimum(there, back))
    return np.concatenate(out)


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)


def _linked(rows: list[tuple], left: int, cell: int, index: MultiIndex | None, cosine: float) -> np.ndarray:
    """Links of a block pair's rows (..., own cell, vector) that count in this cell.

    Two visitors of a cell do not count in it. A pair that meets in the cells of
    both counts in the smaller one.
    """
    x = _unit(_matrix([r[-1] for r in rows]))
    own = np.asarray([r[-2] for r in rows])
    cut = slice(0, left or len(rows)), slice(left, len(rows))
    linked = x[cut[0]] @ x[cut[1]].T >= cosine
    if index is not None:
        words = len(index.books[1])
        _, moves = index.moves(x)

        def visits(a: slice, b: slice) -> np.ndarray:
            return moves[0][a][:, own[b] // words] + moves[1][a][:, own[b] % words] <= index.reach

        home_a, home_b = own[cut[0]][:, None] == cell, own[cut[1]][None, :] == cell
        twice_a = home_a & visits(cut[0], cut[1]) & (own[cut[1]] < cell)[None, :]
        twice_b = home_b & visits(cut[1], cut[0]).T & (own[cut[0]] < cell)[:, None]
        linked &= (home_a | home_b) & ~twice_a & ~twice_b
    if not left:
        np.fill_diagonal(linked, False)
    return linked


def near_duplicates(
    df: DataFrame,
    cosine: float = COSINE,
    recall: float = RECALL,
    sample: int = SAMPLE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Each vector with ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels are equal and not null, their dimensions are
    equal and their cosine in double precision is at least ``cosine``. Vectors
    that are null, empty, zero or hold a null or a number that is not finite
    link with nothing, nor do those without an id; such rows are components of
    their own. Equal vectors of a label are compared once and all counted.
    Every pair that is returned as a link is verified; about ``recall`` of all
    are found at least. Rows that repeat an id share the result of one of them.
    Other columns are not read; an empty table gives an empty result.
    """
    folder = new_folder(df.sparkSession)
    numbers = F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), numbers.alias("e"))
    # A null in a test counts as a fault.
    sound = F.coalesce(
        F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("e", lambda v: v != 0)
        & F.col("vec_id").isNotNull()
        & F.col("label").isNotNull(),
        F.lit(False),
    )

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, dtype=np.float64).tobytes())

    classes = saved(
        rows.filter(sound)
        .select("vec_id", "label", packed("e").alias("vector"))
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        .withColumn("dim", F.expr("cast(octet_length(vector) / 8 as int)")),
        folder,
        "classes",
    )
    indexes = _fitted(classes, cosine, recall, sample)

    @F.pandas_udf("own int, cells array<int>")
    def visited(vectors: pd.Series) -> pd.DataFrame:
        own = np.zeros(len(vectors), dtype=np.int32)
        cells: list = [np.zeros(1, dtype=np.int32)] * len(vectors)
        sizes = vectors.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            index = indexes.get(int(size) // 8)
            for k in range(0, len(at) if index else 0, 1024):
                part = at[k : k + 1024]
                mine, seen = index.cells(_unit(_matrix([vectors.iloc[i] for i in part])))
                own[part] = mine
                for i, c in zip(part, seen, strict=True):
                    cells[i] = c.astype(np.int32)
        return pd.DataFrame({"own": own, "cells": cells})

    probes = classes.withColumn("v", visited("vector")).select(
        "label", "dim", "node", "copies", "vector", "v.own", F.explode("v.cells").alias("cell")
    )
    key = ["label", "dim", "cell"]
    # Cells where nobody is at home hold no pair.
    sizes = (
        probes.groupBy(*key)
        .agg(F.count("*").alias("n"), F.max((F.col("own") == F.col("cell")).cast("int")).alias("home"))
        .filter("n > 1 AND home = 1")
        .select(*key, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    )
    dealt = dealt_over_pairs(probes.join(sizes, key), key, "node", F.col("blocks"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for group in groups(batches, 5):
                _, dim, cell, i, j = group[0][:5]
                if sides := sides_of(group, i, j, 5):
                    linked = _linked(*sides, cell, indexes.get(dim), cosine)
                    copies = np.asarray([r[7] for r in group])
                    yield from link_rows(linked, sides[1], [r[6] for r in group], copies)

        return batched(found(), LINKS)

    verified = saved(
        dealt.select(*key, "i", "j", "block", "node", "copies", "own", "vector").mapInArrow(
            links, "node long, links long, other long"
        ),
        folder,
        "verified",
    )
    roots = connected(
        verified.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")),
        folder,
        "links",
    )
    counts = verified.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    described = saved(
        classes.join(counts, "node", "left")
        .join(roots, "node", "left")
        .select(
            "label",
            "vector",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        ),
        folder,
        "described",
    )
    marked = rows.withColumn("sound", sound)
    linkable = (
        marked.filter("sound")
        .select("vec_id", "label", packed("e").alias("vector"))
        .join(described, ["label", "vector"])
        .select("vec_id", "n_links", "component_id")
    )
    alone = marked.filter("NOT sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linkable.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _fitted(classes: DataFrame, cosine: float, recall: float, sample: int) -> dict[int, MultiIndex]:
    """An index for each dimension in the bounded sample; other vectors share one cell."""
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    words = min(MOST_WORDS, max(4, math.ceil(math.sqrt(largest / CELL))))
    picked = (
        classes.select("dim", "node", "vector").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    )
    by_dim: dict[int, list[bytes]] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(bytes(r["vector"]))
    return {d: fit_index(_unit(_matrix(v)), words, cosine, recall) for d, v in by_dim.items()}
