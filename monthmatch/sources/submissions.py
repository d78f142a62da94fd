"""Submission files: finding them, checking their headers, reading their rows."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import Literal
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthmatch.fixed_values import (
    BALANCE,
    BRANCH,
    CUSTOMER,
    DATE,
    FACILITY,
    FACILITY_TYPE,
    FILE_FACILITY,
    hash_fields,
    required_columns,
)
from monthmatch.functions.fields import pack
from monthmatch.functions.parse import name_parts, submission_from, submission_of
from monthmatch.functions.text import (
    content_hash,
    identity_key,
    joined,
    normalize_fields,
    or_blank,
    quoted,
    strip,
    surrogate_id,
)
from monthmatch.sources.quoted import literal_path, split_cells

#: A file with line breaks inside quotes is one task; has none and is read in blocks; may have some and is read in blocks.
MultiLine = bool | Literal["split"]

UNIT_KEY = ("SubscriberCode", "ReportingPeriod", "SubmissionType", "SequenceNumber")
# Files that may be submissions, in either case of letters.
FILE_GLOB = "*.{[cC][sS][vV],[xX][lL][sS][xX]}"
_ONE_FILE_PER_TASK = 1 << 40
# Bytes of a file that is read whole for its first line, and how many such files a task reads.
_SMALL_FILE, _SMALL_FILES = 1 << 20, 500


# -- discovery -----------------------------------------------------------------


def located(files: DataFrame) -> DataFrame:
    """Path of each file, and the same as its rows will report it.

    Only names are selected, so file contents are not read.
    """
    return files.select("path", F.col("_metadata.file_path").alias("uri"))


def list_files(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """All candidate files below a folder, or those given by path.

    This is Spark's own file listing, not a scan: a scan leaves out files
    without content, which are to be reported too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = reader.option("pathGlobFilter", FILE_GLOB).load(
        literal_path(root) if isinstance(root, str) else [literal_path(p) for p in root]
    )
    uris = [uri.replace("file:///", "file:/", 1) for uri in listed.inputFiles()]
    return spark.createDataFrame(
        [(unquote(uri), uri) for uri in sorted(uris)], "path STRING, uri STRING"
    )


def _segment(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/"), -from_end)


def submission_name(path: Column) -> Column:
    """A submission is one file, or a folder of part files named like one."""
    return F.when(_segment(path, 1).startswith("part-"), _segment(path, 2)).otherwise(
        _segment(path, 1)
    )


def describe_files(files: DataFrame) -> DataFrame:
    """Add name, location and submission of each path, and why it cannot be used."""
    if "uri" not in files.columns:
        files = files.withColumn("uri", F.col("path"))
    name = submission_name(F.col("path"))
    location = F.when(
        _segment(F.col("path"), 1).startswith("part-"),
        F.regexp_replace("path", "/[^/]*$", ""),
    ).otherwise(F.col("path"))
    return (
        files.select("path", "uri", name.alias("FileName"), location.alias("Location"))
        # Names are taken apart once: filters on what follows from the parts are
        # not moved past a generator, where the whole parsing would be repeated.
        .withColumn("_parts", F.explode(F.array(name_parts(F.col("FileName")))))
        .withColumn("_submission", submission_from(F.col("_parts")))
        .select("path", "uri", "FileName", "Location", "_submission.*")
        .withColumn(
            "Problem",
            F.when(
                F.col("SubscriberCode").isNull(), F.lit("name is not <CODE><MMYY>_<IND|BUS>[_<SEQ>]")
            ).when(F.lower("path").endswith(".xlsx"), F.lit("format .xlsx is not supported")),
        )
    )


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    return describe_files(list_files(spark, root))


def chronological(files: DataFrame) -> DataFrame:
    return files.orderBy(*[F.col(c).asc() for c in _FILE_ORDER], F.col("path").asc())


_FILE_ORDER = ("ReportingPeriod", "SubscriberCode", "SubmissionType", "SequenceNumber")


def pending_files(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Usable files whose submission is not loaded yet, one location each.

    ``loaded`` has the four columns of ``UNIT_KEY``. Of several copies of one
    submission the first by path is taken, as the others would find it loaded.
    """
    usable = files.filter(F.col("Problem").isNull())
    first = F.min("Location").over(W.partitionBy(*UNIT_KEY))
    chosen = usable.withColumn("_first", first).filter("Location = _first").drop("_first")
    return chosen.join(loaded.select(*UNIT_KEY).distinct(), list(UNIT_KEY), "left_anti")


# -- headers -------------------------------------------------------------------


def _first_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file; the lines of a file come one after the other."""
    last = None
    for batch in batches:
        uris = batch.column("uri").to_pylist()
        begins = [i for i, uri in enumerate(uris) if uri != (uris[i - 1] if i else last)]
        if begins:
            yield batch.take(pa.array(begins))
        last = uris[-1] if uris else last


def read_headers(spark: SparkSession, files: str | Sequence[str]) -> DataFrame:
    """The first line of every file, as ``(uri, header)``; of those given by path, or of all below a folder.

    Small files are read whole, hundreds of them in a task. A larger one is a
    task that stops after its first batch of lines, so only the head of it is
    read. The session copies confine the split settings that make files and
    tasks line up.
    """
    size = F.col("_metadata.file_size")

    def lines(task_bytes: int, file_bytes: int, chosen: Column) -> DataFrame:
        session = spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(task_bytes))
        session.conf.set("spark.sql.files.openCostInBytes", str(file_bytes))
        reader = session.read
        if isinstance(files, str):
            reader = reader.options(recursiveFileLookup=True, pathGlobFilter=FILE_GLOB)
        found = reader.text(literal_path(files) if isinstance(files, str) else [literal_path(p) for p in files])
        return found.filter(chosen).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("header"))

    # A file counts with its bytes and those of a small one, so none is cut.
    small = lines(_SMALL_FILES * _SMALL_FILE, _SMALL_FILE, size <= _SMALL_FILE)
    large = lines(_ONE_FILE_PER_TASK, _ONE_FILE_PER_TASK, size > _SMALL_FILE)
    schema = "uri string, header string"
    return small.mapInArrow(_first_rows, schema).unionByName(large.mapInArrow(_first_row, schema))


def header_names(line: str) -> tuple[str, ...]:
    """Stripped column names; a repeated name gets a numbered suffix."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for name in next(csv.reader([line.removeprefix("﻿")]), []):
        name = name.strip()
        count = seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{count}" if count else name)
    return tuple(names)


def missing_columns(names: Iterable[str], submission_type: str) -> list[str]:
    """Required columns that a header lacks, in the order of the contract."""
    lacking = set(required_columns(submission_type)).difference(names)
    return sorted(lacking, key=required_columns(submission_type).index)


def header_problem(names: Sequence[str], submission_type: str) -> str | None:
    """What makes a header unusable for a submission type; None if nothing does."""
    lacking = missing_columns(names, submission_type)
    if not lacking:
        return None
    return f"header without {', '.join(lacking)} ({len(names)} columns, type {submission_type})"


def checked_headers(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """What makes the header of each file unusable: ``missing`` columns and ``message``, null if nothing does.

    ``lines`` have the type (``kind``) and the first line (``header``, null for
    an empty file) of each file. Only distinct headers come to the driver, where
    they are taken apart; files do not.
    """
    rows = []
    for kind, line in map(tuple, lines.select("kind", "header").distinct().collect()):
        names = () if line is None else header_names(line)
        message = "file is empty" if line is None else header_problem(names, kind)
        rows.append((kind, line, missing_columns(names, kind), message))
    told = spark.createDataFrame(rows, "_kind STRING, _header STRING, missing ARRAY<STRING>, message STRING")
    same = (F.col("kind") == F.col("_kind")) & F.col("header").eqNullSafe(F.col("_header"))
    return lines.join(told, same).drop("_kind", "_header")


# -- rows ----------------------------------------------------------------------


def scan_cells(
    spark: SparkSession, paths: Sequence[str], width: int, multi_line: MultiLine = True
) -> DataFrame:
    """Rows of files as arrays ``cells`` of ``width`` + 1 texts; missing and blank cells are null.

    Cells are read by position, whatever the files call them, and what is told
    about a row stands in one struct ``place``, so that no header can get in
    the way. ``multi_line`` allows line breaks inside quotes, which makes a
    file one task; turn it off to split files that have none, or say
    ``"split"`` to split files that may have some, which reads them twice.
    """
    if multi_line == "split":
        return split_cells(spark, paths, width + 1)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width + 1)])
    rows = (
        spark.read.schema(schema)
        .options(header=True, multiLine=multi_line, enforceSchema=True, escape='"', mode="PERMISSIVE")
        .csv([literal_path(p) for p in paths])
    )
    place = F.struct(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_name").alias("PartName"),
        F.col("_metadata.file_block_start").alias("BlockStart"),
        F.monotonically_increasing_id().alias("RowIndex"),
    )
    return rows.select(F.array(*schema.fieldNames()).alias("cells"), place.alias("place"))


def submission_id(code: Column, period: Column, kind: Column, sequence: Column) -> Column:
    return surrogate_id(code, period, kind, sequence)


def headers_frame(spark: SparkSession, headers: Iterable[tuple[str, str]]) -> DataFrame:
    """Distinct (type, header line) pairs with the names and where the known columns stand."""
    rows = []
    for kind, line in headers:
        names = header_names(line)
        at = [names.index(c) if c in names else None for c in _known(kind)]
        rows.append((kind, line, list(names), at))
    return spark.createDataFrame(rows, "kind STRING, header STRING, names ARRAY<STRING>, at ARRAY<INT>")


def _known(submission_type: str) -> tuple[str, ...]:
    """Columns that are looked for in a header; the optional ones last."""
    return (*required_columns(submission_type), BRANCH, FACILITY_TYPE)


def load_rows(
    spark: SparkSession,
    submission_type: str,
    files: DataFrame,
    headers: DataFrame,
    paths: Sequence[str],
    width: int,
    batch_id: str,
    multi_line: MultiLine = True,
) -> DataFrame:
    """The rows of all files of a type in the columns of the ``submitted`` dataset.

    One scan reads all files, whatever their headers: ``files`` (uri, header)
    and ``headers`` (as :func:`headers_frame`) tell where each row's columns
    stand. Both are broadcast: rows shuffled on their file or header would all
    come to one task. ``RawRecordID`` is a digest of the batch and of where the row
    stands, so a task that runs again gives its rows the same ids, and a file
    that is tried again in another batch does not. The file order of rows is
    ``(PartName, BlockStart, RowIndex)``: the index grows within a block.
    """
    known = _known(submission_type)
    rows = (
        scan_cells(spark, paths, width, multi_line)
        .join(F.broadcast(files.select(F.col("uri").alias("_uri"), "header")), F.col("place.uri") == F.col("_uri"))
        .join(F.broadcast(headers.filter(F.col("kind") == submission_type).select("header", "names", "at")), "header")
    )

    def cell(name: str) -> Column:
        return F.get("cells", F.col("at")[known.index(name)])

    count = F.size("names")
    filled = F.transform(F.slice("cells", F.lit(1), count), or_blank)
    beyond = F.slice("cells", count + 1, F.lit(width + 1))
    # Known columns only: a header's other names never become columns here.
    rows = rows.select(
        *[(strip(or_blank(cell(c))) if c != BALANCE else or_blank(cell(c))).alias(c) for c in known[:-2]],
        *[strip(F.when(F.col("at")[known.index(c)].isNotNull(), or_blank(cell(c)))).alias(c) for c in known[-2:]],
        F.to_json(F.map_from_arrays("names", filled)).alias("RawPayload"),
        F.exists(beyond, lambda c: c.isNotNull()).alias("Malformed"),
        "place",
    )
    rows = normalize_fields(rows, submission_type)
    rows = rows.select(
        submission_of(submission_name(F.col("place.uri"))).alias("_submission"),
        quoted(FILE_FACILITY).alias(FACILITY),
        CUSTOMER,
        DATE,
        BALANCE,
        BRANCH,
        FACILITY_TYPE,
        pack(rows, submission_type).alias("IdentityFields"),
        content_hash(rows, submission_type).alias("ContentHash"),
        "RawPayload",
        "Malformed",
        "place.*",
    ).select("*", "_submission.*")
    unit = [F.col(c) for c in UNIT_KEY]
    place = [F.col(c).cast("string") for c in ("uri", "BlockStart", "RowIndex")]
    return rows.withColumns(
        {
            "IdentityKey": identity_key(),
            "SubmissionID": submission_id(*unit),
            "SubscriberID": surrogate_id(F.col("SubscriberCode")),
            "RawRecordID": F.md5(joined([F.lit(batch_id), *place])),
            "BatchID": F.lit(batch_id),
        }
    ).drop("_submission", "uri")


def load_file(
    spark: SparkSession, path: str, submission_type: str, multi_line: MultiLine = True
) -> DataFrame:
    """One file as a frame of text: keys, identity and contact fields stripped.

    Names that differ only in case are both there; a name of the three columns
    that tell a row's place is, too.
    """
    line = read_headers(spark, [path]).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    names = header_names(line["header"])
    stripped = {FILE_FACILITY, CUSTOMER, DATE, BRANCH, FACILITY_TYPE, *hash_fields(submission_type)}
    rows = scan_cells(spark, [path], len(names), multi_line)
    cells = [or_blank(F.col("cells")[i]) for i in range(len(names))]
    return rows.select(
        *[(strip(c) if n in stripped else c).alias(n) for n, c in zip(names, cells, strict=True)],
        *[F.col(f"place.{c}").alias(c) for c in ("PartName", "BlockStart", "RowIndex")],
    )
