"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Documents with the same words are one class; one document stands for it.
2. Each class gets MinHash values of its n-gram set, cut into bands whose count
   and rows follow from the recall wanted at the threshold. Classes are
   shuffled on band hashes. Classes of a bucket whose MinHash values agree
   nearly as often as the threshold asks for are neighbours.
3. Connected neighbours form a neighbourhood, in which all pairs are verified
   on full n-gram sets.
4. What is verified connects documents to groups.

Buckets and neighbourhoods may be large. Both are dealt over pairs of blocks,
so that no task holds more than two blocks, and a task returns counts of links
and a spanning forest of what it has linked, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.blocks import (
    EDGES,
    LINKS,
    batched,
    dealt_over_pairs,
    forest_edges,
    groups,
    link_rows,
    sides_of,
)
from monthmatch.llm.common import new_folder, saved, text_or_empty
from monthmatch.llm.components import connected
from monthmatch.llm.fingerprint import WordHasher, mixed

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
ROWS = 6
#: Share of MinHash values that may be missing from the threshold among
#: neighbours: over four times the estimate's standard deviation.
SLACK = 0.15
#: Classes in a block of a bucket; classes and characters in a block of a neighbourhood, about.
BUCKET_BLOCK = 1024
BLOCK = 256
BLOCK_CHARS = 4 << 20
_SEED = 20_240_229
_words = WordHasher()


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of so many rows that a pair just at the similarity shares one with that probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def plain_words(text: Column) -> Column:
    """The text in lower case with single spaces between its words: what n-grams are made of."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x20]+", " "))


def _digest(plain: Column) -> Column:
    # 128 bits stand for the words.
    return F.substring(F.sha2(plain, 256), 1, 32)


def word_digest(text: Column) -> Column:
    """The same for texts of the same words only; null is the empty text."""
    return _digest(plain_words(F.coalesce(text, F.lit(""))))


def ngrams(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of words; of the whole text if it has fewer."""
    hashes, _ = _words(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
    if len(hashes) == 0:
        return hashes
    words = min(words, len(hashes))
    runs = hashes[: len(hashes) - words + 1]
    for k in range(1, words):
        runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - words + 1 + k])
    return np.unique(runs)


def minima(grams: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each hash function."""
    smallest = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 512):
        # The upper bits of a product with an odd number are a good hash.
        np.minimum(smallest, (grams[i : i + 512, None] * multipliers).min(axis=0), out=smallest)
    return smallest


def band_hashes(smallest: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` minima."""
    bands = smallest.reshape(-1, rows)
    out = np.zeros(len(bands), dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return out.view(np.int64)


def _linked(sets: Sequence[np.ndarray], left: int, similarity: float) -> np.ndarray:
    """Which of the first ``left`` sets (rows) link with which of the others (columns).

    With ``left`` 0 all are compared with all. Intersections are counted by
    products of 0/1 matrices, a slice of the n-grams at a time; n-grams of one
    set only can not be common.
    """
    n = len(sets)
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    # Dense numbers for the n-grams that are left.
    number = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    common = np.zeros((left or n, n - left), dtype=np.float32)
    width = 4096
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [first, first + width])
        matrix = np.zeros((n, width), dtype=np.float32)
        matrix[owner[a:b], number[a:b] - first] = 1
        common += matrix[: left or n] @ matrix[left:].T
    union = sizes[: left or n, None] + sizes[None, left:] - common
    return (union > 0) & (common >= similarity * union)


def _neighbours(rows: list[tuple], left: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Edges between rows (..., node, minima) of a bucket whose minima agree often enough."""
    values = np.frombuffer(b"".join(r[-1] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    width = values.shape[1]
    least = math.ceil((similarity - SLACK) * width)
    upper, lower = (values[:left], values[left:]) if left else (values, values)
    linked = np.empty((len(upper), len(lower)), dtype=bool)
    for k in range(0, len(upper), 16):
        for m in range(0, len(lower), 512):
            equal = upper[k : k + 16, None, :] == lower[None, m : m + 512, :]
            linked[k : k + 16, m : m + 512] = equal.sum(axis=2, dtype=np.int16) >= least
    if not left:
        np.fill_diagonal(linked, False)
    for i, j in forest_edges(linked, left):
        yield rows[i][-2], rows[j][-2]


def _verified(rows: list[tuple], left: int, words: int, similarity: float) -> Iterator[tuple]:
    """(node, links, other) for rows (..., node, copies, text): counts of links, and edges of a forest."""
    nodes, copies = [r[-3] for r in rows], np.asarray([r[-2] for r in rows])
    linked = _linked([ngrams(r[-1], words) for r in rows], left, similarity)
    if not left:
        np.fill_diagonal(linked, False)
    yield from link_rows(linked, left, nodes, copies)


def jaccard_classes(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    rows: int = ROWS,
) -> DataFrame:
    """Each document with its class, its number of links and its group.

    Returns ``doc_id``, ``digest`` (of the words, as :func:`word_digest`),
    ``class_id`` (smallest id among documents of the same words), ``n_links``
    (other documents whose sets of ``words``-grams have a Jaccard similarity of
    at least ``similarity``), ``group_id`` (smallest id reachable by links) and
    ``kept`` (whether the document is its group's representative). Words are
    separated by white space and compared in lower case; a text of fewer words
    than ``words`` is one n-gram of all of them. Texts without words, null ones
    included, are copies of each other and similar to nothing else.

    Every row is a document, with a null or repeated id, too. Rows that repeat
    an id with other words belong to groups of their own. Null ids come after
    all others: ``class_id`` or ``group_id`` is null where no document of it has
    an id. The representative has the smallest id and, of rows that share it,
    the smallest digest; rows that agree in both are kept alike. Other columns
    are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    n_bands = bands_for(similarity, recall, rows)
    multipliers = np.random.default_rng(_SEED).integers(
        1, np.iinfo(np.uint64).max, n_bands * rows, dtype=np.uint64
    ) | np.uint64(1)

    @F.pandas_udf("bands array<bigint>, minima binary")
    def signature(texts: pd.Series) -> pd.DataFrame:
        bands, kept = [], []
        for text in texts:
            grams = ngrams(text, words)
            smallest = minima(grams, multipliers)
            bands.append(band_hashes(smallest, rows) if len(grams) else np.zeros(0, np.int64))
            kept.append(smallest.astype(np.uint8).tobytes())
        return pd.DataFrame({"bands": bands, "minima": kept})

    # Words are kept with what is told about them, so that texts are read once.
    members = saved(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_words(text_or_empty()).alias("plain"))
        .withColumn("s", signature("plain"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            _digest(F.col("plain")).alias("digest"),
            F.length("plain").alias("chars"),
            "plain",
            "s.bands",
            "s.minima",
        ),
        folder,
        "members",
    )
    # The first document of a class stands for it; its row's number is the class's node.
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "chars", "bands", "minima")
    classes = saved(
        members.groupBy("digest")
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"))
        .select("digest", "copies", F.col("first.row").alias("node"), "first.doc_id", "first.chars", "first.bands", "first.minima"),
        folder,
        "classes",
    )
    near = connected(_bucket_edges(classes, similarity, folder), folder, "near")
    verified = saved(_verify(members, classes, near, words, similarity), folder, "verified")
    group = connected(
        verified.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")),
        folder,
        "groups",
    )
    links = verified.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    described = saved(
        classes.select("digest", "node", "copies", F.col("doc_id").alias("class_id"))
        .join(links, "node", "left")
        .join(group, "node", "left")
        .select(
            "digest",
            "class_id",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
            F.col("root").isNull().alias("alone"),
        ),
        folder,
        "described",
    )
    # What stands for a group is a minimum taken before the shuffle; most classes are alone.
    best = (
        described.filter(~F.col("alone"))
        .groupBy("root")
        .agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", "digest")).alias("best"))
        .select("root", F.col("best.class_id").alias("group_id"), F.col("best.digest").alias("best_digest"))
    )
    grouped = (
        described.filter(~F.col("alone"))
        .join(best, "root")
        .unionByName(
            described.filter("alone").withColumns({"group_id": F.col("class_id"), "best_digest": F.col("digest")})
        )
        .drop("root", "alone")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("digest") == F.col("best_digest"))
    return (
        members.select("doc_id", "digest")
        .join(grouped, "digest")
        .select("doc_id", "digest", "class_id", "n_links", "group_id", kept.alias("kept"))
    )


def _bucket_edges(classes: DataFrame, similarity: float, folder: str) -> DataFrame:
    """Edges (a, b) that connect the neighbours of each bucket of a band."""
    banded = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    crowded = banded.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    # Values are fetched only for classes that share a bucket.
    rows = banded.join(crowded, ["band", "hash"]).join(classes.select("node", "minima"), "node")
    dealt = dealt_over_pairs(rows, ["band", "hash"], "node", F.ceil(F.col("n") / BUCKET_BLOCK))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in groups(batches, 4):
                if sides := sides_of(group, group[0][2], group[0][3], 4):
                    yield from _neighbours(*sides, similarity)

        return batched(rows(), EDGES)

    return dealt.select("band", "hash", "i", "j", "block", "node", "minima").mapInArrow(edges, "a long, b long")


def _verify(members: DataFrame, classes: DataFrame, near: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, links, other) from all pairs of each neighbourhood."""
    texts = members.select(F.col("row").alias("node"), F.col("plain").alias("text"))
    found = near.join(classes.select("node", "copies", "chars"), "node")
    blocks = F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS), F.lit(1).cast("bigint")
    )
    sizes = found.groupBy("root").agg(blocks.alias("blocks"))
    found = found.join(sizes, "root").join(texts, "node")
    dealt = dealt_over_pairs(found, ["root"], "node", F.col("blocks"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in groups(batches, 3):
                if sides := sides_of(group, group[0][1], group[0][2], 3):
                    yield from _verified(*sides, words, similarity)

        return batched(rows(), LINKS)

    return dealt.select("root", "i", "j", "block", "node", "copies", "text").mapInArrow(
        links, "node long, links long, other long"
    )
