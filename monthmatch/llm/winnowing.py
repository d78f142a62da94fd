"""Benchmark decontamination by winnowing.

Of every window of consecutive k-grams the one with the smallest hash is kept,
the last one of equal ones. Two texts that share a window of words therefore
keep the same k-gram of it, and no shared span of a window's length is missed.

The fingerprints of all benchmark items are a bit map of fixed size. A
document's fingerprint found there is a hit, which is extended to the windows
around it; those whose own hash is found, too, are joined with the benchmark's
windows on their whole words, which settles it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import new_folder, saved, slices, text_or_empty
from monthmatch.llm.words import Words, runs

#: Consecutive words that count as a copy.
WINDOW = 10
#: Words of a k-gram.
GRAM = 5
#: Bits of the map's size, which does not depend on the benchmark; a larger benchmark
#: sets more of its bits, so that more windows are joined that do not match.
MAP_BITS = 24
_CHUNK_BYTES = 2 << 20

_ITEM = pa.schema([("item_id", pa.string()), ("words", pa.int32()), ("key", pa.binary()), ("bits", pa.list_(pa.int32()))])
_CANDIDATE = pa.struct([("start", pa.int64()), ("words", pa.int32()), ("key", pa.binary())])
_DOCUMENT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("candidates", pa.list_(_CANDIDATE))])


def winnowed(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window start the place of its smallest k-gram; of equal ones the last."""
    best, at = grams[starts], starts.copy()
    for k in range(1, width):
        value = grams[starts + k]
        lower = value <= best
        best = np.where(lower, value, best)
        at[lower] = starts[lower] + k
    return at


def _bits(hashes: np.ndarray, map_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - map_bits)).astype(np.int64)


def _window_starts(words: Words, length: int) -> np.ndarray:
    """Places where so many consecutive words of one text begin."""
    places = np.arange(max(len(words) - length + 1, 0))
    return places[words.text[places] == words.text[places + length - 1]]


def item_windows(
    batches: Iterable[pa.RecordBatch], window: int, gram: int, map_bits: int
) -> Iterator[pa.RecordBatch]:
    """Every window of the items with the bits that a document's window like it asks for."""
    for batch in batches:
        ids = batch.column("item_id").cast(pa.string()).to_pylist()
        words = Words(batch.column("text"))
        hashes, rows = words.hashes(), []
        starts = _window_starts(words, window)
        if len(starts):
            whole, grams = _bits(runs(hashes, window), map_bits), runs(hashes, gram)
            prints = _bits(grams[winnowed(grams, starts, window - gram + 1)], map_bits)
            for start, fingerprint in zip(starts.tolist(), prints.tolist(), strict=True):
                item = ids[words.text[start]]
                rows.append((item, window, words.joined(start, window), [int(whole[start]), fingerprint]))
        for text in np.flatnonzero(words.counts() < window):
            start, length = int(words.starts[text]), int(words.counts()[text])
            if length:
                bit = int(_bits(runs(hashes[start : start + length], length), map_bits)[0])
                rows.append((ids[text], length, words.joined(start, length), [bit]))
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ITEM, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=_ITEM)


def _candidates(words: Words, marks: np.ndarray, shorter: list[int], window: int, gram: int) -> list[tuple[int, int]]:
    """(start, length) of the windows that the map does not rule out."""

    map_bits = marks.size.bit_length() + 2

    def marked(hashes: np.ndarray) -> np.ndarray:
        bits = _bits(hashes, map_bits)
        return marks[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 != 0

    hashes, out = words.hashes(), []
    starts = _window_starts(words, window)
    if len(starts):
        grams, width = runs(hashes, gram), window - gram + 1
        kept = np.unique(winnowed(grams, starts, width))
        hits = kept[marked(grams[kept])]
        # A hit is extended: it may lie in any of the windows that hold its k-gram.
        around = np.unique(hits[:, None] - np.arange(width))
        around = around[np.isin(around, starts, assume_unique=True)]
        if len(around):
            out += [(int(s), window) for s in around[marked(runs(hashes, window)[around])]]
    for length in shorter:
        places = _window_starts(words, length)
        if len(places):
            out += [(int(s), length) for s in places[marked(runs(hashes, length)[places])]]
    return out


def document_candidates(
    batches: Iterable[pa.RecordBatch], marks: np.ndarray, shorter: list[int], window: int, gram: int
) -> Iterator[pa.RecordBatch]:
    """Each document's number of words and the windows that may be in the benchmark."""
    for batch in batches:
        for part in slices(batch, "text", _CHUNK_BYTES):
            words = Words(part.column("text"))
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for start, length in _candidates(words, marks, shorter, window, gram):
                text = int(words.text[start])
                place = start - int(words.starts[text])
                found[text].append({"start": place, "words": length, "key": words.joined(start, length)})
            columns = [
                part.column("doc_id").cast(pa.int64()),
                pa.array(words.counts(), pa.int64()),
                pa.array(found, _DOCUMENT.field("candidates").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_DOCUMENT)


def _bit_map(items: DataFrame, map_bits: int) -> np.ndarray:
    """The fingerprints' map: at most 2^(map_bits - 6) numbers come to the driver."""
    bit = F.explode("bits").alias("bit")
    numbers = (
        items.select(bit)
        .groupBy(F.expr("bit DIV 64").alias("number"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
        .toArrow()
    )
    marks = np.zeros(1 << (map_bits - 6), dtype="<i8")
    marks[numbers["number"].to_numpy()] = numbers["bits"].to_numpy()
    return marks.view(np.uint8)


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans (start, words), an array in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit"))

    def add(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["start"] + span["words"])
        new = end - F.greatest(so_far["end"], span["start"])
        return F.struct(end.alias("end"), (so_far["hit"] + F.greatest(new, F.lit(0))).alias("hit"))

    return F.aggregate(spans, start, add, lambda so_far: so_far["hit"])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, map_bits: int = MAP_BITS
) -> DataFrame:
    """For each document how many of its words are copied from benchmark items, and which items.

    Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence of
    ``window`` consecutive words of an item, or of all words of a shorter one),
    ``items`` (ids of these items as strings, in order), ``n_items`` and
    ``contaminated``. Any shared span of ``window`` words is found.

    Null and empty texts have no words. Every row of ``docs`` is a document,
    with a null or repeated id, too. Items are told apart by their id: rows
    that repeat one are one item with the windows of all its texts; an item
    without an id marks words but is not listed. Other columns are not read. An
    empty benchmark leaves all documents clean.
    """
    if not 0 < gram <= window:
        raise ValueError(f"a k-gram of {gram} words does not fit into a window of {window}")
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession)
    items = saved(
        benchmark.select(F.col("item_id").cast("string"), text_or_empty().alias("text")).mapInArrow(
            lambda batches: item_windows(batches, window, gram, map_bits),
            "item_id string, words int, key binary, bits array<int>",
        ),
        folder,
        "items",
    )
    marks = _bit_map(items, map_bits)
    shorter = [r[0] for r in items.filter(F.col("words") < window).select("words").distinct().collect()]
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        lambda batches: document_candidates(batches, marks, shorter, window, gram),
        "doc_id long, n_words long, candidates array<struct<start:long,words:int,key:binary>>",
    )
    # Written once: texts are read once, and a row's number stays what it is.
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), folder, "candidates")
    windows = items.select("key", "item_id").distinct()
    pairs = (
        found.filter(F.size("candidates") > 0)
        .select("row", "doc_id", "n_words", F.explode("candidates").alias("c"))
        .select("row", "doc_id", "n_words", "c.*")
        .join(windows.withColumn("matched", F.lit(True)), "key", "left")
    )
    per_document = (
        pairs.groupBy("row", "doc_id", "n_words")
        .agg(
            F.collect_set(F.when(F.col("matched"), F.struct("start", "words"))).alias("spans"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
        )
        .select("doc_id", "n_words", _covered(F.array_sort("spans")).alias("n_hit"), "items")
    )
    clean = found.filter(F.size("candidates") == 0).select(
        "doc_id",
        "n_words",
        F.lit(0).cast("bigint").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
    )
    return per_document.unionByName(clean).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        (F.col("n_hit") > 0).alias("contaminated"),
    )
