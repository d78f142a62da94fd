"""Comparing all pairs within groups of any size, in blocks that fit a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def groups(batches: Iterable[pa.RecordBatch], keys: int, most_bytes: int = 8 << 20) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in the first ``keys`` columns, over the borders of batches."""
    held: list[tuple] = []
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if held and row[:keys] != held[0][:keys]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def dealt_over_pairs(df: DataFrame, keys: list[str], node: str, blocks: Column) -> DataFrame:
    """Rows with their ``block`` among ``blocks`` of their key, once for each pair (``i``, ``j``) it is in.

    Rows of one key and pair are consecutive in a partition, ordered by block.
    """
    return (
        df.withColumn("__blocks", blocks.cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("i", F.least("block", "__other"))
        .withColumn("j", F.greatest("block", "__other"))
        .drop("__blocks", "__other")
        .repartition(*keys, "i", "j")
        .sortWithinPartitions(*keys, "i", "j", "block", node)
    )


def sides_of(group: list[tuple], i: int, j: int, block: int) -> tuple[list[tuple], int] | None:
    """The rows of a block pair and how many are its left side, by the column ``block``.

    The left side is 0 for a block with itself. None where there is no pair.
    """
    if i == j:
        return (group, 0) if len(group) > 1 else None
    left = sum(r[block] == i for r in group)
    return (group, left) if 0 < left < len(group) else None


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connect two members; whether they were apart."""
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def forest_edges(linked: np.ndarray, left: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links; columns are numbered from ``left`` on."""
    forest = Forest(left + linked.shape[1])
    for i in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[i]) + left:
            if forest.join(int(i), int(j)):
                yield int(i), int(j)


def link_rows(linked: np.ndarray, left: int, nodes: list[int], copies: np.ndarray) -> Iterator[tuple]:
    """(node, links, other): how many documents each node links with, and edges of a forest."""
    for i, j in forest_edges(linked, left):
        yield nodes[i], 0, nodes[j]
    counts = [*(linked @ copies[left:]), *((linked.T @ copies[:left]) if left else [])]
    for node, n in zip(nodes, counts, strict=False):
        if n:
            yield node, int(n), None


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches."""
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield record_batch(out, schema)
            out = []
    if out:
        yield record_batch(out, schema)
