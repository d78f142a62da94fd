"""Ranked search over a trie of documents, by branch and bound.

A document is the vector of those of its terms that any item asks for, the most
frequent terms first. Documents of a block are put into a trie of these
vectors, so that documents which begin alike share a path. A subtree is a run of
documents in the trie's order; it knows the largest count of each of its terms
and the smallest length weight of its documents, which together bound the score
of every document in it. An item's search goes down the subtrees with the
highest bounds first and leaves out those that can not reach its results so far.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthmatch.llm.common import new_folder, saved, slices, text_or_empty
from monthmatch.llm.words import Words

TOP = 10
#: Items are searched in blocks of about that many bytes of text.
ITEM_BYTES = 4 << 20
#: A trie holds about that many pairs of document and term; a longer document has one of its own.
BLOCK_POSTINGS = 2 << 20
#: Documents of a trie's smallest subtrees, at most.
LEAF = 32
_CHUNK_BYTES = 2 << 20

_VECTOR = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)
VECTOR_SCHEMA = "doc_id long, n long, terms array<int>, counts array<long>"
_HIT = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
HIT_SCHEMA = "item long, doc_id long, score long"


class Vocabulary:
    """The terms of a block of items, numbered, found by their hashes and compared whole."""

    def __init__(self, terms: Iterable[bytes]):
        # Terms hash alike whether they come from here or from a document.
        words = Words(pa.array(sorted(terms), pa.binary()))
        hashes = words.hashes()
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.first, self.length = words.first[order], (words.last - words.first)[order]
        self.data = words.data
        self.terms = [words.word(int(i)) for i in order]
        self.number = {t: k for k, t in enumerate(self.terms)}

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are terms, and the terms' numbers."""
        if not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == hashes)
        numbers = at[places]
        length = self.length[numbers]
        same = words.last[places] - words.first[places] == length
        for k in range(int(length.max(initial=0))):
            rest = np.flatnonzero(same & (length > k))
            other = words.data[words.first[places[rest]] + k] != self.data[self.first[numbers[rest]] + k]
            same[rest[other]] = False
        return places[same], numbers[same]


def term_vectors(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and how often it has each term of the vocabulary."""
    width = max(len(vocabulary.terms), 1)
    for batch in batches:
        for part in slices(batch, "text", _CHUNK_BYTES):
            words = Words(part.column("text"))
            places, numbers = vocabulary.find(words)
            cells, counts = np.unique(words.text[places] * width + numbers, return_counts=True)
            ends = np.searchsorted(cells, np.arange(part.num_rows + 1) * width).astype(np.int32)
            columns = [
                part.column("doc_id"),
                pa.array(words.counts(), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(cells % width, pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_VECTOR)


def weight(documents: int, holding: int) -> int:
    """A term's weight by how many of the documents hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_weights(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length takes from the worth of a count."""
    return 25 + (75 * n * documents) // max(terms, 1)


def worth(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a count of a term is worth; more for larger counts, less for larger ``m``."""
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


class Trie:
    """Documents of a block in the order of their term vectors, and the subtrees over them."""

    def __init__(
        self,
        ids: np.ndarray,
        null: np.ndarray,
        m: np.ndarray,
        ends: np.ndarray,
        ranks: np.ndarray,
        counts: np.ndarray,
        terms: int,
        leaf: int = LEAF,
    ):
        """``ranks`` are the documents' terms by falling frequency, in order; document d has those from ends[d]."""
        n = len(ids)
        wide = ranks.astype(">u4").tobytes()
        keys = [wide[4 * ends[d] : 4 * ends[d + 1]] for d in range(n)]
        order = np.asarray(sorted(range(n), key=keys.__getitem__), dtype=np.int64)
        self.ids, self.null, self.m = ids[order], null[order], m[order]
        sizes = np.diff(ends)[order]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(ends[order] - begins[:-1], sizes) + np.arange(begins[-1])
        place, rank, count = np.repeat(np.arange(n), sizes), ranks[source], counts[source]
        self._subtrees([keys[d] for d in order], leaf)
        # Of each term the documents that hold it, in the trie's order.
        by_term = np.argsort(rank, kind="stable")
        self.place, self.count = place[by_term], count[by_term]
        self.of_term = np.searchsorted(rank[by_term], np.arange(terms + 1))
        self._maxima(place, rank, count, terms)

    def _subtrees(self, keys: list[bytes], leaf: int) -> None:
        """Nodes (first and last document, children), parents before their children."""
        n = len(keys)
        # How many terms a document's path shares with that of the one before.
        shared = np.zeros(n + 1, dtype=np.int64)
        for d in range(1, n):
            a, b = keys[d - 1], keys[d]
            k, most = 0, min(len(a), len(b))
            while k < most and a[k : k + 4] == b[k : k + 4]:
                k += 4
            shared[d] = k // 4
        self.low, self.high, self.children, parents = [0], [n], [[]], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= leaf:
                continue
            inner = shared[low + 1 : high]
            borders = [low, *(np.flatnonzero(inner == inner.min()) + low + 1).tolist(), high]
            # Small branches side by side are one leaf.
            ranges: list[list[int]] = []
            for a, b in zip(borders, borders[1:], strict=False):
                if ranges and b - ranges[-1][0] <= leaf:
                    ranges[-1][1] = b
                else:
                    ranges.append([a, b])
            for a, b in ranges:
                child = len(self.low)
                self.low.append(a)
                self.high.append(b)
                self.children.append([])
                parents.append(node)
                self.children[node].append(child)
                todo.append(child)
        self.parents = np.asarray(parents)
        self.leaf = np.asarray([not c for c in self.children])

    def _maxima(self, place: np.ndarray, rank: np.ndarray, count: np.ndarray, terms: int) -> None:
        """The largest count of each term in each subtree, by term, and each subtree's smallest m."""
        leaves = np.flatnonzero(self.leaf)
        leaves = leaves[np.argsort(np.asarray(self.low)[leaves], kind="stable")]
        starts = np.asarray(self.low)[leaves]
        depth = np.zeros(len(self.parents), dtype=np.int64)
        for node in range(1, len(depth)):
            depth[node] = depth[self.parents[node]] + 1
        node = leaves[np.searchsorted(starts, place, side="right") - 1]
        self.least_m = np.full(len(self.parents), np.iinfo(np.int64).max)
        np.minimum.at(self.least_m, leaves[np.searchsorted(starts, np.arange(len(self.m)), side="right") - 1], self.m)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        cells, most = _largest(rank * len(depth) + node, count)
        # From the deepest subtrees up: what a level has goes to its parents.
        for level in range(int(depth.max()), -1, -1):
            here = depth[cells % len(depth)] == level
            done.append((cells[here], most[here]))
            nodes = np.flatnonzero(depth == level)
            if level:
                np.minimum.at(self.least_m, self.parents[nodes], self.least_m[nodes])
                node = cells[here] % len(depth)
                up = cells[here] - node + self.parents[node]
                cells, most = _largest(
                    np.concatenate([cells[~here], up]), np.concatenate([most[~here], most[here]])
                )
        cells, most = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(cells, kind="stable")
        self.node, self.most = (cells % len(depth))[order], most[order]
        self.of_bound = np.searchsorted(cells[order], np.arange(terms + 1) * len(depth))

    def bounds(self, item: list[tuple[int, int]]) -> np.ndarray:
        """What no document of a subtree can score above."""
        out = np.zeros(len(self.parents), dtype=np.int64)
        for rank, w in item:
            a, b = self.of_bound[rank], self.of_bound[rank + 1]
            node = self.node[a:b]
            out[node] += w * worth(self.most[a:b], self.least_m[node])
        return out

    def search(self, item: list[tuple[int, int]], best: Best) -> None:
        """Add the block's documents that are among the best; ``item`` has ranks and weights."""
        bounds = self.bounds(item)
        todo = [0]
        while todo:
            node = todo.pop()
            if bounds[node] < best.least:
                continue
            if self.leaf[node]:
                best.add(*self._scores(item, self.low[node], self.high[node]))
            else:
                # The highest bound is taken next.
                todo += sorted(self.children[node], key=bounds.__getitem__)

    def _scores(self, item: list[tuple[int, int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros(high - low, dtype=np.int64)
        for rank, w in item:
            a, b = self.of_term[rank], self.of_term[rank + 1]
            places = self.place[a:b]
            x, y = places.searchsorted(low), places.searchsorted(high)
            if x < y:
                at = places[x:y]
                out[at - low] += w * worth(self.count[a + x : a + y], self.m[at])
        return out, self.ids[low:high], self.null[low:high]


def _largest(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct cell with its largest value."""
    if not len(cells):
        return cells, values
    order = np.argsort(cells, kind="stable")
    cells, values = cells[order], values[order]
    begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[begins], np.maximum.reduceat(values, begins)


class Best:
    """An item's best documents so far: higher scores first, equal ones by smaller id, null ids last."""

    def __init__(self, most: int):
        self.most = most
        self.rows: list[tuple[int, bool, int]] = []
        #: What a document has to score at least.
        self.least = 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        for k in np.flatnonzero(scores >= self.least).tolist():
            row = (-int(scores[k]), bool(null[k]), int(ids[k]))
            if len(self.rows) < self.most or row < self.rows[-1]:
                bisect.insort(self.rows, row)
                del self.rows[self.most :]
        if len(self.rows) == self.most:
            self.least = max(1, -self.rows[-1][0])


def search_blocks(
    batches: Iterable[pa.RecordBatch],
    items: list[tuple[int, list[tuple[int, int]]]],
    rank_of: np.ndarray,
    documents: int,
    terms: int,
    top: int,
    block_postings: int,
) -> Iterator[pa.RecordBatch]:
    """The best documents of a task for each item, from one trie after the other."""
    best = [Best(top) for _ in items]
    held: list[pa.RecordBatch] = []
    postings = 0

    def searched() -> None:
        trie = _trie(held, rank_of, documents, terms)
        for (_, item), own in zip(items, best, strict=True):
            trie.search(item, own)

    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(batch.column("n_terms").to_numpy())])
        first = 0
        while first < batch.num_rows:
            room = block_postings - postings + ends[first]
            last = max(int(np.searchsorted(ends, room, side="right")) - 1, first + (not held))
            if last > first:
                held.append(batch.slice(first, last - first))
                postings += int(ends[last] - ends[first])
                first = last
            if first < batch.num_rows:
                searched()
                held, postings = [], 0
    if held:
        searched()
    rows = [
        (number, None if null else doc_id, -down)
        for (number, _), own in zip(items, best, strict=True)
        for down, null, doc_id in own.rows
    ]
    if rows:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=_HIT)


def _trie(held: list[pa.RecordBatch], rank_of: np.ndarray, documents: int, terms: int) -> Trie:
    block = pa.Table.from_batches(held).combine_chunks()
    column = {name: block.column(name).combine_chunks() for name in block.column_names}
    sizes = column["n_terms"].to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ranks = rank_of[column["terms"].flatten().to_numpy()]
    counts = column["counts"].flatten().to_numpy()
    # Each document's terms, the most frequent ones first.
    order = np.lexsort((ranks, np.repeat(np.arange(len(sizes)), sizes)))
    ids = column["doc_id"]
    return Trie(
        ids.fill_null(0).to_numpy(),
        ids.is_null().to_numpy(zero_copy_only=False),
        length_weights(column["n"].to_numpy(), documents, terms),
        ends,
        ranks[order],
        counts[order],
        len(rank_of),
    )


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The highest-scoring documents for each item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; A to Z
    are lower-cased. With N documents that have terms, L terms in all and n in a
    document, a term that df documents hold has the weight
    floor(1000 ln((2N + 2) / (2 df + 1))); a document that has it tf times adds
    weight * (10^9 tf div (1000 tf + 8 m)) for each time it stands in the item,
    where m = 25 + 75 n N div L. The ``top`` highest scores above 0 are
    returned, equal ones by smaller id, null ids last.

    Every row is a document or an item of its own, with a null or repeated id,
    too. Null and empty texts have no terms: such documents do not count in N,
    such items have no rows. Other columns are not read; an empty table gives an
    empty result. Items are searched in blocks of about ``item_bytes``, each
    in one pass over the documents.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession)
    numbered = saved(
        items.select("item_id", text_or_empty().alias("text")).withColumn("item", F.monotonically_increasing_id()),
        folder,
        "items",
    )
    n_bytes = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(n_bytes) // item_bytes))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    found = None
    for b in range(blocks):
        # One block of the query set is as large as ``item_bytes`` says.
        own = {r["item"]: r["text"] for r in numbered.filter(block == b).select("item", "text").collect()}
        hits = _searched(texts, own, top, block_postings, f"{folder}/{b}")
        found = hits if found is None else found.unionByName(hits)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .join(numbered.select("item", "item_id"), "item")
        .select("item_id", "rank", "doc_id", "score")
    )


def _searched(texts: DataFrame, items: dict[int, str], top: int, block_postings: int, folder: str) -> DataFrame:
    """Every task's best documents for each item of a block."""
    words = Words(pa.array(list(items.values()), pa.string()))
    asked = [Counter(words.word(i) for i in range(a, b)) for a, b in zip(words.starts, words.starts[1:], strict=False)]
    vocabulary = Vocabulary(set().union(*asked))
    vectors = saved(
        texts.mapInArrow(lambda batches: term_vectors(batches, vocabulary), VECTOR_SCHEMA), folder, "vectors"
    )
    size = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, terms = int(size[0]), int(size[1])
    # As many rows as a block of items has terms.
    holding = dict.fromkeys(range(len(vocabulary.terms)), 0)
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    holding |= {r["term"]: r["n"] for r in counted.collect()}
    order = sorted(holding, key=lambda t: (-holding[t], t))
    rank_of = np.zeros(max(len(order), 1), dtype=np.int64)
    rank_of[order] = np.arange(len(order))
    weights = {t: weight(documents, k) for t, k in holding.items()}
    queries = []
    for item, count in zip(items, asked, strict=True):
        own = [(vocabulary.number[t], k) for t, k in count.items()]
        queries.append((item, sorted((int(rank_of[t]), k * weights[t]) for t, k in own if weights[t])))
    asked_for = [q for q in queries if q[1]]
    # Documents without any of the terms score 0.
    return (
        vectors.filter(F.size("terms") > 0)
        .withColumn("n_terms", F.size("terms").cast("bigint"))
        .mapInArrow(
            lambda batches: search_blocks(batches, asked_for, rank_of, documents, terms, top, block_postings), HIT_SCHEMA
        )
    )
