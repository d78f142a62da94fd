"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph hashes to a wide vector, a document to the sum of its paragraphs'
vectors. Lanes add modulo a power of two, so the order of paragraphs does not
count, and a paragraph is inserted or deleted by adding or subtracting its
vector alone. The vector has two parts:

* 32 lanes modulo 2^32 expanded from the paragraph's SHAKE-128, for equality;
* 256 lanes modulo 2^32, the sum of a row of signs for each run of three words
  of the paragraph. They add up just as well, and read as signed numbers two
  documents' lanes estimate how much of their text is common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import slices, text_or_empty

STRONG, SKETCH = 32, 256
RUN = 3
#: Bytes of text that are hashed at once, and words whose signs are unpacked at once.
_CHUNK_BYTES, _CHUNK_RUNS = 4 << 20, 1 << 15
#: Ids sampled for each range of ids.
_IDS_PER_RANGE = 30
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of all white-space separated words of a byte array, without a loop over words."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's hash and the position where it starts."""
        if len(data) + 1 > len(self.up):
            self.up, self.down = (_powers(b, len(data) + 1) for b in (_ODD, _INVERSE))
        word = data > 32
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(
            (data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:], dtype=np.uint64
        )
        value = (sums[end] - sums[start]) * self.down[start]
        return mixed(value + (end - start).astype(np.uint64)), start


_words = WordHasher()


def _paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def sketch_lanes(groups: Sequence[Sequence[str]]) -> np.ndarray:
    """For each group of paragraphs the sum of their sketch lanes, modulo 2^32."""
    out = np.zeros((len(groups), SKETCH), dtype=np.int64)
    sizes = [sum(len(p) + 1 for p in g) for g in groups]
    at = 0
    while at < len(groups):
        stop, total = at, 0
        while stop < len(groups) and (stop == at or total + sizes[stop] <= _CHUNK_BYTES):
            total += sizes[stop]
            stop += 1
        _add_sketches(groups[at:stop], out[at:stop])
        at = stop
    return (out % (1 << 32)).astype(np.uint32)


def _add_sketches(groups: Sequence[Sequence[str]], out: np.ndarray) -> None:
    parts = [p.encode("utf-8", "surrogatepass") for g in groups for p in g]
    if not parts:
        return
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    hashes, start = _words(data)
    if not len(hashes):
        return
    paragraph = np.searchsorted(ends, start, side="right")
    # A run covers three words of one paragraph; at its end shorter runs remain,
    # so that a paragraph of one or two words has runs too.
    runs = hashes.copy()
    for k in range(1, RUN):
        same = np.zeros(len(hashes), dtype=bool)
        same[:-k] = paragraph[:-k] == paragraph[k:]
        after = np.zeros_like(hashes)
        after[:-k] = hashes[k:]
        runs = np.where(same, mixed(runs * np.uint64(_ODD) + after), runs)
    run_owner = owner[paragraph]
    seeds = np.arange(1, SKETCH // 64 + 1, dtype=np.uint64) * np.uint64(_ODD)
    for i in range(0, len(runs), _CHUNK_RUNS):
        chunk, own = runs[i : i + _CHUNK_RUNS], run_owner[i : i + _CHUNK_RUNS]
        signs = np.unpackbits(mixed(chunk[:, None] ^ seeds).view(np.uint8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(first, len(own)))
        for f, n in zip(first, count, strict=True):
            out[own[f]] += 2 * signs[f : f + n].sum(axis=0, dtype=np.int32) - n


def strong_lanes(paragraphs: Sequence[str]) -> np.ndarray:
    """The sum of the paragraphs' equality lanes, modulo 2^32."""
    if not paragraphs:
        return np.zeros(STRONG, dtype=np.uint32)
    raw = b"".join(
        hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(4 * STRONG) for p in paragraphs
    )
    return np.frombuffer(raw, dtype="<u4").reshape(-1, STRONG).sum(axis=0, dtype=np.uint32)


def fingerprint_of(strong: np.ndarray, sketch: np.ndarray) -> str:
    return (strong.astype("<u4").tobytes() + sketch.astype("<u4").tobytes()).hex()


def fingerprints(texts: Sequence[str]) -> list[str]:
    """The fingerprint of each text."""
    groups = [_paragraphs(t) for t in texts]
    sketches = sketch_lanes(groups)
    return [fingerprint_of(strong_lanes(g), s) for g, s in zip(groups, sketches, strict=True)]


def combined(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of both multisets together, or of the first without the second."""
    (sa, ka), (sb, kb) = (_lanes(x) for x in (a, b))
    times = np.uint32(sign % (1 << 32))
    return fingerprint_of(sa + times * sb, ka + times * kb)


def _lanes(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 4 * STRONG], "<u4"), np.frombuffer(raw[4 * STRONG :], "<u4")


def _likeness(sa, ka, sb, kb) -> float:
    """Cosine of the signed sketch lanes within 0 to 1; 1 where all lanes are equal."""
    if np.array_equal(sa, sb) and np.array_equal(ka, kb):
        return 1.0
    x, y = ka.astype(np.int32).astype(np.float64), kb.astype(np.int32).astype(np.float64)
    norm = np.sqrt(x.dot(x) * y.dot(y))
    return float(min(1.0, max(0.0, x.dot(y) / norm))) if norm else 0.0


def likeness(a: str, b: str) -> float:
    """How alike two fingerprinted texts are, from 0 to 1."""
    return _likeness(*_lanes(a), *_lanes(b))


def edited_text(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


#: A row of the stream: bucket, whether it only stands in for the next bucket's first row, id, text.
_Row = tuple[int, bool, int, str]


def _edits(rows: list[_Row]) -> list[tuple]:
    """What is returned for each row but the last; each one's next document is the row after it.

    The edit's fingerprint is the document's with the changed paragraphs
    deleted and the new ones inserted.
    """
    kept, gone, come, edits = [], [], [], []
    for row, after in zip(rows, [*rows[1:], None], strict=True):
        text = row[3]
        edit, same = "", len(text)
        if after is not None and not row[1]:
            edit = edited_text(text, after[3])
            # Paragraphs that end before the edit are common; all after them change.
            same = text.rfind("\n", 0, len(text) - len(text) // 4) + 1
        edits.append(edit)
        kept.append(_paragraphs(text[:same]))
        gone.append(_paragraphs(text[same:]))
        come.append(_paragraphs(edit[same:]))
    n = len(rows)
    sketches = sketch_lanes([*kept, *gone, *come])
    shared = [strong_lanes(g) for g in kept]
    strong = [s + strong_lanes(g) for s, g in zip(shared, gone, strict=True)]
    sketch = sketches[:n] + sketches[n : 2 * n]
    out = []
    for i in range(n - 1):
        if rows[i][1]:
            continue
        new_strong = shared[i] + strong_lanes(come[i])
        new_sketch = sketches[i] + sketches[2 * n + i]
        out.append(
            (
                rows[i][2],
                len(rows[i][3]),
                hashlib.sha256(edits[i].encode("utf-8", "surrogatepass")).hexdigest(),
                fingerprint_of(strong[i], sketch[i]),
                fingerprint_of(new_strong, new_sketch),
                _likeness(strong[i], sketch[i], new_strong, new_sketch),
                _likeness(strong[i], sketch[i], strong[i + 1], sketch[i + 1]),
            )
        )
    return out


_EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_EDIT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _edit_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending: list[_Row] = []
    for batch in batches:
        for piece in slices(batch, "text", _CHUNK_BYTES):
            columns = (piece.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))
            rows = [*pending, *zip(*columns, strict=True)]
            out = _edits(rows)
            pending = rows[-1:]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _EDIT_ARROW, strict=True)],
                    schema=_EDIT_ARROW,
                )


def fingerprint_documents(df: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of each text; null counts as empty, whose lanes are all zero. No shuffle."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.tolist()), dtype=object)

    return df.withColumn(output, of(text_or_empty(text)))


def fingerprint_edits(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint each document and its edit, whose end is the next document's beginning.

    The next document is the one with the next larger ``doc_id``; after the
    last comes the first. Null ids come first, equal ids are ordered by their
    text, and each repeated row is a document of its own. Null texts are empty.
    An empty text's edit is empty; two empty texts are alike to degree 1, an
    empty one and another to degree 0. Only ``doc_id`` and ``text`` are read.
    An empty table gives an empty result.

    Ids are dealt into ranges by the quantiles of a sample, and texts are
    shuffled once. The first row of each range is also sent to the range before
    it, so that every document meets its successor without a window over all
    rows. The driver sees a few ids per range.
    """
    spark = df.sparkSession
    lowest = -(1 << 63)
    docs = df.select(
        "doc_id", F.coalesce("doc_id", F.lit(lowest)).alias("key"), text_or_empty().alias("text")
    )
    ranges = buckets or 4 * max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    # A sample of so many ids in all places the borders; any borders give the same result.
    total = docs.count()
    share = min(1.0, _IDS_PER_RANGE * ranges / max(total, 1))
    some = sorted(r["key"] for r in docs.select("key").sample(share, seed=1).collect())
    bounds = np.unique(np.asarray(some, dtype=np.int64)[:: max(1, len(some) // ranges)])

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(dtype=np.int64)), dtype="int32")

    firsts = sorted(
        (r["key"], r["bucket"])
        for r in docs.select("key", range_of("key").alias("bucket"))
        .groupBy("bucket")
        .agg(F.min("key").alias("key"))
        .collect()
    )
    keys = np.asarray([k for k, _ in firsts], dtype=np.int64)
    before = np.asarray([firsts[i - 1][1] for i in range(len(firsts))], dtype=np.int32)

    @F.pandas_udf("array<struct<bucket: int, ahead: boolean>>")
    def places(key: pd.Series) -> pd.Series:
        values = key.to_numpy(dtype=np.int64)
        bucket = np.searchsorted(bounds, values)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        out = []
        for b, v, i in zip(bucket.tolist(), values.tolist(), at.tolist(), strict=True):
            out.append([{"bucket": b, "ahead": False}])
            if firsts[i][0] == v:
                out[-1].append({"bucket": int(before[i]), "ahead": True})
        return pd.Series(out, dtype=object)

    dealt = docs.select("doc_id", "key", "text", F.explode(places("key")).alias("at")).select(
        "doc_id", "key", "text", "at.bucket", "at.ahead"
    )
    return (
        dealt.repartition("bucket")
        .sortWithinPartitions("bucket", "ahead", "key", "text")
        .select("bucket", "ahead", "doc_id", "text")
        .mapInArrow(_edit_stream, _EDIT_SCHEMA)
    )
