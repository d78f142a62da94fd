"""Records of delimited files whose quoted cells may hold line breaks, read in blocks.

A line break inside quotes does not end a record, and whether a line begins
inside quotes depends on all lines before it. A file is still cut into blocks:

1. Every line tells, by expressions, whether a quoted cell is open behind it,
   both for a line that begins a record and for one that begins inside quotes.
   Each block is a map of these two states, the composition of its lines'.
2. A window over the blocks of a file composes them, which gives the state
   that each block begins in. Only blocks that begin inside quotes are kept.
3. The lines are read once more and put together to records. A record that goes
   on beyond its block is put together from its parts, at most two a block.

Quotes within a cell are doubled; a quote in a cell that does not begin with
one is a character as others, as for Spark's own reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks that begin inside quotes and go out with the tasks, at most; more are joined with.
FEW_BLOCKS = 100_000

# Whole cells with a comma behind each, then a quoted cell that does not end.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_OPEN = rf'^(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+{_QUOTED}\z'

_RECORD = pa.schema(
    [("uri", pa.string()), ("BlockStart", pa.int64()), ("RowIndex", pa.int64()), ("record", pa.string()), ("part", pa.int32())]
)
_RECORD_SCHEMA = "uri string, BlockStart long, RowIndex long, record string, part int"
#: A whole record, the first part of one, and a part of one that began in an earlier block.
WHOLE, FIRST, LATER = 0, 1, 2


def literal_path(path: str) -> str:
    """A path as readers take it: characters of glob patterns stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _lines(spark: SparkSession, paths: Sequence[str], block_bytes: int) -> DataFrame:
    """Lines with their place, and whether quotes are open behind them after either beginning.

    The session copy has both settings that decide on the borders of blocks, so
    that these do not depend on the number of machines at work.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    session.conf.set("spark.sql.files.openCostInBytes", block_bytes)
    value, quoted = F.col("value"), F.contains("value", F.lit('"'))
    return session.read.option("lineSep", "\n").text([literal_path(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("BlockStart"),
        F.monotonically_increasing_id().alias("RowIndex"),
        "value",
        (quoted & value.rlike(_OPEN)).alias("after"),
        (~quoted | F.concat(F.lit('"'), value).rlike(_OPEN)).alias("after_open"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Stretches of lines of one block, with the block."""
    uris, starts = batch.column("uri").dictionary_encode(), batch.column("BlockStart").to_numpy()
    code = uris.indices.to_numpy()
    new = np.flatnonzero((code[1:] != code[:-1]) | (starts[1:] != starts[:-1])) + 1
    borders = [0, *new.tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(borders, borders[1:], strict=False):
        yield (uris.dictionary[int(code[a])].as_py(), int(starts[a])), a, b


def states(after: np.ndarray, after_open: np.ndarray, open_: bool) -> np.ndarray:
    """Whether quotes are open behind each line, if ``open_`` says so before the first.

    A line forgets the state, keeps it or turns it round: what counts is the
    last line that forgets it and how many have turned it since.
    """
    n = np.arange(len(after))
    forgets, turns = after == after_open, np.cumsum(after & ~after_open)
    last = np.maximum.accumulate(np.where(forgets, n, -1))
    told = np.where(last >= 0, after[last], open_)
    since = turns - np.where(last >= 0, turns[last], 0)
    return told ^ (since % 2 == 1)


def block_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's state behind its last line, for both states before its first."""
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        after = batch.column("after").to_numpy(zero_copy_only=False)
        after_open = batch.column("after_open").to_numpy(zero_copy_only=False)
        for block, a, b in _runs(batch):
            now = found.setdefault(block, [False, True])
            found[block] = [bool(states(after[a:b], after_open[a:b], s)[-1]) for s in now]
    if found:
        uris, starts = zip(*found, strict=True)
        columns = [pa.array(uris), pa.array(starts, pa.int64()), *map(pa.array, zip(*found.values(), strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["uri", "BlockStart", "after", "after_open"])


def open_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks that begin inside quotes, from the states of all blocks.

    As for lines: the last block that forgets its state counts, and how many
    have turned it since.
    """
    before = W.partitionBy("uri").orderBy("BlockStart")
    turn = (F.col("after") & ~F.col("after_open")).cast("long")
    forgets = F.col("after") == F.col("after_open")
    told = F.last(F.when(forgets, F.struct(F.col("after").alias("state"), F.col("turns"))), ignorenulls=True)
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    return (
        blocks.withColumn("turns", F.sum(turn).over(before))
        .withColumns({"told": told.over(earlier), "turned": F.coalesce(F.sum(turn).over(earlier), F.lit(0))})
        .withColumn(
            "open",
            F.coalesce(F.col("told.state"), F.lit(False))
            != ((F.col("turned") - F.coalesce(F.col("told.turns"), F.lit(0))) % 2 == 1),
        )
        .filter("open")
        .select("uri", "BlockStart", "open")
    )


def block_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines put together to records; those that cross the borders of a block are told as parts."""
    block, state, held = None, False, None
    # Whether records end with two characters; the last one of a file may lack them.
    returns = False

    def ended() -> Iterator[pa.RecordBatch]:
        # What is open at the end of a block is the first part of a record, or a later one.
        if held is not None:
            rows = [(*block, held[0], "\n".join(held[1]), FIRST if held[2] == WHOLE else LATER)]
            yield _rows(rows)

    for batch in batches:
        after = batch.column("after").to_numpy(zero_copy_only=False)
        after_open = batch.column("after_open").to_numpy(zero_copy_only=False)
        begins_open = batch.column("open").to_numpy(zero_copy_only=False)
        index = batch.column("RowIndex").to_numpy()
        for here, a, b in _runs(batch):
            if here != block:
                yield from ended()
                block, state, held, returns = here, bool(begins_open[a]), None, False
            if not state and not after[a:b].any():
                # Every line is a record.
                part = batch.slice(a, b - a)
                returns = part.column("value")[0].as_py().endswith("\r")
                columns = [part.column(c) for c in ("uri", "BlockStart", "RowIndex", "value")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b - a, WHOLE, np.int32))], schema=_RECORD)
                continue
            behind = states(after[a:b], after_open[a:b], state)
            rows = []
            for k, text in enumerate(batch.column("value").slice(a, b - a).to_pylist()):
                if held is None:
                    held = (int(index[a + k]), [], LATER if state else WHOLE)
                held[1].append(text)
                state = bool(behind[k])
                if not state:
                    if text.endswith("\r"):
                        returns = True
                    elif returns:
                        held[1][-1] += "\r"
                    rows.append((*block, held[0], "\n".join(held[1]), held[2]))
                    held = None
            if rows:
                yield _rows(rows)
    yield from ended()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_RECORD)


def split_records(spark: SparkSession, paths: Sequence[str], block_bytes: int) -> DataFrame:
    """All records of the files, header lines included: ``uri``, ``BlockStart``, ``RowIndex`` and ``record``.

    A record's place is that of its first line; ``RowIndex`` grows within a
    block. A carriage return before the end of a record stays, for
    :func:`record_cells` to tell. The blocks' states are computed when this is
    called, the records when they are read.
    """
    lines = _lines(spark, paths, block_bytes)
    states_of = lines.select("uri", "BlockStart", "after", "after_open").mapInArrow(
        block_states, "uri string, BlockStart long, after boolean, after_open boolean"
    )
    open_, place = open_blocks(states_of), ["uri", "BlockStart"]
    few = open_.limit(FEW_BLOCKS + 1).collect()
    if len(few) <= FEW_BLOCKS:
        open_ = lines.sparkSession.createDataFrame(few, "uri string, BlockStart long, open boolean")
        marked = lines.join(F.broadcast(open_), place, "left")
    else:
        marked = lines.join(open_, place, "left").sortWithinPartitions(*place, "RowIndex")
    found = marked.withColumn("open", F.coalesce("open", F.lit(False))).mapInArrow(block_records, _RECORD_SCHEMA)
    whole = found.filter(F.col("part") == WHOLE)
    # A later part belongs to the last record that began in an earlier block.
    order = W.partitionBy("uri").orderBy("BlockStart", F.col("part").desc())
    owner = F.last(F.when(F.col("part") == FIRST, F.struct("BlockStart", "RowIndex")), ignorenulls=True).over(order)
    stitched = (
        found.filter(F.col("part") != WHOLE)
        .withColumn("owner", owner)
        .groupBy("uri", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("BlockStart", "RowIndex", "record"))).alias("parts"))
        .select("uri", "owner.*", F.array_join(F.col("parts.record"), "\n").alias("record"))
    )
    return whole.drop("part").unionByName(stitched)


def _bytes(size: str) -> int:
    """A setting like ``128m`` or ``134217728b`` as a number of bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def split_cells(spark: SparkSession, paths: Sequence[str], width: int) -> DataFrame:
    """Rows of files as arrays ``cells`` of ``width`` texts with their ``place``; header lines and empty lines left out.

    Blocks have as many bytes as the session's ``spark.sql.files.maxPartitionBytes``.
    """
    found = split_records(spark, paths, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    # A block is one partition, and rows are numbered within it from a multiple of 2^33.
    header = (F.col("BlockStart") == 0) & (F.col("RowIndex") % (1 << 33) == 0)
    name = F.element_at(F.split("uri", "/"), -1)
    place = F.struct(
        "uri", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("PartName"), "BlockStart", "RowIndex"
    )
    rows = found.filter(~header & ~F.col("record").isin("", "\r"))
    return rows.select(record_cells(F.col("record"), width).alias("cells"), place.alias("place"))


def record_cells(record: Column, width: int) -> Column:
    """The cells of a record as an array of ``width`` texts; missing and blank ones are null."""
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} STRING" for n in names)
    # As for Spark's reader: where records end with two characters, so does a line inside quotes, and both are one.
    bare = F.substring(record, F.lit(1), F.length(record) - 1)
    text = F.when(F.endswith(record, F.lit("\r")), F.replace(bare, F.lit("\r\n"), F.lit("\n"))).otherwise(record)
    parsed = F.from_csv(text, schema, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return F.array(*[parsed[n] for n in names])
