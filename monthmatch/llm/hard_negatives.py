"""Hard negatives by slot-decomposed selection.

The scores of an anchor's positives are the upper limits of its windows. They
split all scores into disjoint slots: slot s holds the scores that are at most
the first s limits and above all later ones. A window takes its rows from its
own slot and those below, so that the first rows of each slot are all that any
window can need. Tasks keep the first rows of each slot of what they have read;
merging the slots from the lowest one upwards gives every window its rows.

The anchors are a stated query set. They are compared with all rows in blocks
of anchors that fit a task's memory; rows are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthmatch.llm.common import new_folder, saved

#: Rows of the same label that are positives, and negatives for each of them.
POSITIVES = 5
NEGATIVES = 5
#: A negative's score in percent of the positive's, at least.
LEAST_PERCENT = 80
#: Anchors of one block have about that many bytes of components.
ANCHOR_BYTES = 8 << 20
_LIMIT = 1 << 53
#: Cells (rows by anchors) that are compared at once.
_CELLS = 1 << 21

_FOUND = pa.schema(
    [(n, pa.int64()) for n in ("anchor", "anchor_id")] + [("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]
)
FOUND_SCHEMA = "anchor long, anchor_id long, slot int, id long, score long"


class Anchors:
    """A block of anchors: row numbers, ids, labels and components, and the limits of their positives."""

    def __init__(self, rows: list[tuple[int, int, int, list[int]]], limits: dict[int, list[int]] | None = None):
        self.rows = np.asarray([r[0] for r in rows], dtype=np.int64)
        self.ids = np.asarray([r[1] for r in rows], dtype=np.int64)
        self.labels = np.asarray([r[2] for r in rows], dtype=np.int64)
        self.width = max((len(r[3]) for r in rows), default=0)
        self.components = _matrix([r[3] for r in rows], self.width)
        if limits is not None:
            # Limits that an anchor does not have are below every score.
            self.limits = np.full((len(rows), POSITIVES), np.iinfo(np.int64).min)
            self.known = np.zeros((len(rows), POSITIVES), dtype=bool)
            for i, row in enumerate(self.rows.tolist()):
                own = limits.get(row, [])
                self.limits[i, : len(own)], self.known[i, : len(own)] = own, True


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones go on with zeros, what is beyond the width meets zeros anyway."""
    if all(len(v) == width for v in vectors):
        return np.asarray(vectors, dtype=np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector[:width]
    return out


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, held at the limits of 64 bits."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    most = max(abs(int(left.min())), int(left.max())) * max(abs(int(right.min())), int(right.max()))
    if most * left.shape[1] < _LIMIT:
        # Sums below 2^53 are exact in doubles.
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    exact = left.astype(object) @ right.T.astype(object)
    info = np.iinfo(np.int64)
    return np.clip(exact, info.min, info.max).astype(np.int64)


class FirstOfSlots:
    """The first rows of each slot: higher scores first, equal ones by smaller id, null ids last."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.least = np.full(slots, np.iinfo(np.int64).min)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, dtype=bool)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        wanted = score >= self.least[slot]
        slot = np.concatenate([self.slot, slot[wanted]])
        score = np.concatenate([self.score, score[wanted]])
        ids = np.concatenate([self.id, ids[wanted]])
        null = np.concatenate([self.null, null[wanted]])
        # ~score falls as score rises, over the whole range of 64 bits.
        order = np.lexsort((ids, null, ~score, slot))
        slot, score, ids, null = slot[order], score[order], ids[order], null[order]
        begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
        place = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        kept = place < self.most
        self.slot, self.score, self.id, self.null = slot[kept], score[kept], ids[kept], null[kept]
        last = place == self.most - 1
        self.least[slot[last]] = score[last]


def _parts(batches: Iterable[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple]:
    """Scores of some rows with all anchors, and the rows' numbers, ids and labels."""
    step = max(1, _CELLS // max(len(anchors.rows), anchors.width, 1))
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            vectors = _matrix(part.column("q").to_pylist(), anchors.width)
            ids = part.column("vec_id")
            yield (
                inner_products(vectors, anchors.components),
                part.column("row").to_numpy(),
                ids.fill_null(0).to_numpy(),
                ids.is_null().to_numpy(zero_copy_only=False),
                part.column("label").to_numpy(),
            )


def _found(first: FirstOfSlots, anchors: Anchors, slots: int) -> pa.RecordBatch:
    ids = pa.array(first.id, pa.int64(), mask=first.null)
    columns = [
        pa.array(anchors.rows[first.slot // slots]),
        pa.array(anchors.ids[first.slot // slots]),
        pa.array(first.slot % slots + 1, pa.int32()),
        ids,
        pa.array(first.score),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def first_positives(batches: Iterable[pa.RecordBatch], anchors: Anchors, most: int) -> Iterator[pa.RecordBatch]:
    """The first rows of each anchor's label, without itself."""
    first = FirstOfSlots(len(anchors.rows), most)
    for scores, rows, ids, null, labels in _parts(batches, anchors):
        same = (labels[:, None] == anchors.labels) & (rows[:, None] != anchors.rows) & (scores >= first.least)
        row, anchor = np.nonzero(same)
        first.add(anchor, scores[row, anchor], ids[row], null[row])
    yield _found(first, anchors, 1)


def first_negatives(
    batches: Iterable[pa.RecordBatch], anchors: Anchors, most: int, least_percent: int
) -> Iterator[pa.RecordBatch]:
    """The first rows of other labels in each slot of each anchor."""
    first = FirstOfSlots(len(anchors.rows) * POSITIVES, most)
    # The lowest score that any window takes, so that most cells are ruled out at once.
    floors = [
        min((-(-least_percent * p // 100) for p, k in zip(own, known, strict=True) if k), default=None)
        for own, known in zip(anchors.limits.tolist(), anchors.known.tolist(), strict=True)
    ]
    lowest = np.asarray([np.iinfo(np.int64).max if f is None else f for f in floors], dtype=np.int64)
    for scores, _, ids, null, labels in _parts(batches, anchors):
        row, anchor = np.nonzero(
            (scores >= lowest) & (scores <= anchors.limits[:, 0]) & (labels[:, None] != anchors.labels)
        )
        score = scores[row, anchor]
        slot = ((score[:, None] <= anchors.limits[anchor]) & anchors.known[anchor]).sum(axis=1)
        inside = slot > 0
        row, anchor, score, slot = row[inside], anchor[inside], score[inside], slot[inside]
        first.add(anchor * POSITIVES + slot - 1, score, ids[row], null[row])
    yield _found(first, anchors, POSITIVES)


def _kept(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each anchor and slot over all tasks."""
    order = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _prepared(vectors: DataFrame) -> DataFrame:
    """Rows that take part, with their labels and whole components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    moved = F.pmod("vec_id", F.lit(7)) == 0
    label = F.col("label").cast("bigint")
    return (
        vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.when(moved, (label + 1) % 10).otherwise(label).alias("label"),
            F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("q"),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )


def _merged(slots: Column, most: int) -> list[Column]:
    """For each window its first rows: the slots merged from the lowest one upwards."""
    out: list[Column] = []
    below = F.array().cast("array<struct<down:bigint,last:boolean,id:bigint,score:bigint>>")
    for s in range(POSITIVES, 0, -1):
        own = F.transform(F.filter(slots, _in_slot(s)), _sortable)
        below = F.slice(F.array_sort(F.concat(own, below)), 1, most)
        out.append(below)
    return out[::-1]


def _in_slot(slot: int):
    return lambda c: c["slot"] == slot


def _sortable(c: Column) -> Column:
    """A row that sorts by falling score, then by id."""
    return F.struct(
        F.bitwise_not(c["score"]).alias("down"), c["id"].isNull().alias("last"), c["id"].alias("id"), c["score"].alias("score")
    )


def mine_hard_negatives(
    vectors: DataFrame,
    anchor_step: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """Each anchor's positives with the rows of other labels that score nearly as high.

    Rows without a label or vector, or with a component that is null or not
    finite, take no part. A label moves on by one (modulo 10) where ``vec_id``
    is divisible by 7. Components are ``floor(256 * x)``, scores integer inner
    products with the anchor; higher ones come first, equal ones by smaller
    ``vec_id``. Rows whose ``vec_id`` is divisible by ``anchor_step`` are
    anchors. Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score`` and ``negative_score``: for each of the
    first ``positives`` other rows of an anchor's label the first ``negatives``
    rows of other labels that score at most as high and at least
    ``least_percent`` of it.

    Every row stands for itself: one that repeats an id is another row, as an
    anchor, too. A null id is no anchor and comes last among equal scores. Of
    vectors of different lengths the shorter one goes on with zeros. Components
    and scores beyond 64 bits count as the nearest number of 64 bits. Other
    columns are not read; an empty table gives an empty result.
    """
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    spark, folder = vectors.sparkSession, new_folder(vectors.sparkSession)
    rows = saved(_prepared(vectors), folder, "rows")
    anchors = rows.filter((F.pmod("vec_id", F.lit(anchor_step)) == 0))
    n_bytes = anchors.agg(F.coalesce(F.sum(8 * F.size("q") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(n_bytes) // anchor_bytes))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        # One block of the query set is as large as ``anchor_bytes`` says.
        own = [tuple(r) for r in anchors.filter(block == b).select("row", "vec_id", "label", "q").collect()]
        if own:
            mined = _mined(rows, own, positives, negatives, least_percent, f"{folder}/{b}")
            parts.append(saved(mined, folder, f"{b}/mined"))
    if not parts:
        return spark.createDataFrame([], RESULT_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RESULT_SCHEMA = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def _mined(
    rows: DataFrame, own: list[tuple], positives: int, negatives: int, least_percent: int, folder: str
) -> DataFrame:
    """The result for one block of anchors."""
    block = Anchors(own)
    first = rows.mapInArrow(lambda batches: first_positives(batches, block, positives), FOUND_SCHEMA)
    chosen = saved(_kept(first, positives).drop("slot"), folder, "positives")
    limits: dict[int, list[int]] = {}
    for r in sorted(chosen.select("anchor", "place", "score").collect()):
        limits.setdefault(r["anchor"], []).append(r["score"])
    split = Anchors(own, limits)
    first = rows.mapInArrow(
        lambda batches: first_negatives(batches, split, negatives, least_percent), FOUND_SCHEMA
    )
    slots = (
        _kept(first, negatives)
        .groupBy("anchor")
        .agg(F.collect_list(F.struct("slot", "id", "score")).alias("slots"))
        .select("anchor", F.array(*_merged(F.col("slots"), negatives)).alias("windows"))
    )
    taken = F.filter(
        F.get("windows", F.col("place") - 1),
        lambda c: 100 * c["score"].cast("decimal(38,0)") >= least_percent * F.col("positive_score").cast("decimal(38,0)"),
    )
    return (
        chosen.select("anchor", "anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(slots, "anchor")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(taken).alias("rank", "c"))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("rank") + 1).alias("rank"),
            F.col("c.id").alias("negative_id"),
            "positive_score",
            F.col("c.score").alias("negative_score"),
        )
    )
