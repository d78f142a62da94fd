"""The registry: history as append-only Parquet, visible batch by batch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmatch.fixed_values import (
    CLEAN_ENRICHED,
    CLEAN_EXACT,
    CLEAN_REARRANGED,
    CLEAN_SEED,
    CLEAN_STATUS,
    HISTORY_ROWS,
    hash_fields,
)
from monthmatch.functions.fields import pack, unpack
from monthmatch.functions.text import identity_key, joined, normalize_fields, surrogate_id
from monthmatch.operators.merge import category_rank, merge_clean
from monthmatch.schemas import DATASETS

# Batches after which the open keys are written anew.
SNAPSHOT_EVERY = 6
# How long a commit waits for those of other writers.
LOCK_SECONDS = 300.0
_LOCK = "_commit_lock"
_STAGING = "_staging"
_OPEN_KEY = ("SubscriberCode", "SubmissionType", "FacilityAccNum", "CustomerID")

# File order of raw rows, across the files of one submission type and period.
FILE_ORDER = ("SequenceNumber", "PartName", "BlockStart", "RowIndex")


def write_order() -> list[Column]:
    """The order in which clean rows were written; the last one counts."""
    return [F.col("BatchID"), F.col("SequenceNumber"), category_rank(), *map(F.col, FILE_ORDER[1:])]


def _started(at: datetime) -> str:
    return f"{at:%Y%m%dT%H%M%S%f}"


def new_batch_id() -> str:
    """Sorts by the time a batch was started."""
    return f"{_started(datetime.now(timezone.utc))}-{uuid.uuid4().hex[:8]}"


class SubmissionClash(RuntimeError):
    """Two batches loaded one submission; the later one is not committed."""


class RegistryLocked(RuntimeError):
    """Another writer holds the commit lock, or died while it did."""


class Registry:
    """Datasets below one root folder.

    A batch appends to all of them under its own ``BatchID`` and is listed in
    ``commits`` last, in one single-row file. Readers take committed batches
    only, so a batch that failed half-way is never seen and needs no undoing;
    :meth:`remove_uncommitted` deletes what it wrote. Several writers may
    prepare batches at a time; each looks for clashes and writes its marker
    under :meth:`commit_lock`, for which it waits up to ``lock_seconds``.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        snapshot_every: int = SNAPSHOT_EVERY,
        lock_seconds: float = LOCK_SECONDS,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.snapshot_every = snapshot_every
        self.lock_seconds = lock_seconds

    def create(self) -> Registry:
        """Make the datasets that do not exist yet."""
        for name, (columns, partitions) in DATASETS.items():
            empty = self.spark.createDataFrame([], columns)
            writer = empty.write.mode("ignore")
            if partitions:
                writer = writer.partitionBy(*partitions)
            writer.parquet(f"{self.root}/{name}")
        return self

    # -- plain access ----------------------------------------------------------

    def everything(self, name: str) -> DataFrame:
        """All rows of a dataset, committed or not."""
        return self.spark.read.schema(DATASETS[name][0]).parquet(f"{self.root}/{name}")

    def committed(self, name: str) -> DataFrame:
        commits = self.everything("commits").select("BatchID")
        # Broadcast, here and below: shuffled on a batch or subscriber, all of its rows would come to one task.
        return self.everything(name).join(F.broadcast(commits), "BatchID", "left_semi")

    def batch(self, name: str, batch_id: str, submission_type: str | None = None) -> DataFrame:
        """The rows of one batch, whether committed or just being written."""
        rows = self.everything(name).filter(F.col("BatchID") == batch_id)
        return rows if submission_type is None else rows.filter(
            F.col("SubmissionType") == submission_type
        )

    def append(self, name: str, rows: DataFrame, within: Mapping[str, str] | None = None) -> None:
        """Write rows to a folder of their own and move its files to the dataset.

        Writers that append to one folder at a time would remove each other's
        temporary files. ``within`` has what all rows have in partition columns:
        as literals they need no sort, which would hold all rows of a task.
        """
        if within:
            rows = rows.withColumns({column: F.lit(value) for column, value in within.items()})
        columns, partitions = DATASETS[name]
        names = self.spark.createDataFrame([], columns).columns
        staged = f"{self.root}/{_STAGING}/{uuid.uuid4().hex}"
        writer = rows.select(*names).write
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(staged)
        files, system = self._files()
        for folder in self._below(files.Path(staged), len(partitions)):
            values, path = [], folder
            for _ in partitions:
                values, path = [path.getName(), *values], path.getParent()
            target = files.Path("/".join([self.root, name, *values]))
            system.mkdirs(target)
            for found in system.listStatus(folder):
                part = found.getPath()
                if part.getName().startswith("part-") and not system.rename(part, files.Path(target, part.getName())):
                    raise OSError(f"{part.toString()} can not be moved to {target.toString()}")
        system.delete(files.Path(staged), True)

    def _below(self, path, levels: int) -> list:
        """The folders of partitions so many levels below a path."""
        _, system = self._files()
        found = [path]
        for _ in range(levels):
            found = [
                s.getPath() for f in found for s in system.listStatus(f) if s.isDirectory() and "=" in s.getPath().getName()
            ]
        return found

    def commit(self, batch_id: str, units: DataFrame | None = None) -> None:
        """Make a batch visible, unless another one has committed one of its ``units`` meanwhile.

        No other writer commits between the look for clashes and the marker.
        """
        with self.commit_lock(batch_id):
            if units is not None:
                unit = ["SubscriberCode", "ReportingPeriod", "SubmissionType", "SequenceNumber"]
                row = units.join(self.loaded(), unit, "left_semi").first()
                if row is not None:
                    raise SubmissionClash(f"already loaded by another batch: {[row[c] for c in unit]}")
            marker = self.spark.range(0, 1, 1, 1).select(
                F.lit(batch_id).alias("BatchID"), F.current_timestamp().alias("CommittedAt")
            )
            self.append("commits", marker)

    def _files(self):
        """Hadoop's file classes, and the file system of the registry."""
        files = self.spark._jvm.org.apache.hadoop.fs
        return files, files.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    @contextmanager
    def commit_lock(self, owner: str) -> Iterator[None]:
        """Hold the one file that only one writer can create, and remove it at the end.

        It keeps two writers apart where the file system creates files
        exclusively, as HDFS does; for local files, where Hadoop's classes look
        first and create then, Python creates it. If a writer dies while holding it, others
        raise :class:`RegistryLocked` after ``lock_seconds``, until
        :meth:`unlock` is called.
        """
        files, system = self._files()
        path = files.Path(f"{self.root}/{_LOCK}")
        until = time.monotonic() + self.lock_seconds
        while True:
            try:
                if system.getUri().getScheme() == "file":
                    with open(path.toUri().getPath(), "x", encoding="utf-8") as out:
                        out.write(owner)
                else:
                    out = system.create(path, False)
                    out.write(bytearray(owner.encode()))
                    out.close()
                break
            except (FileExistsError, Py4JJavaError) as error:
                # What else may be wrong with the folder is raised as it is.
                if not system.exists(path) and time.monotonic() >= until:
                    raise
                if time.monotonic() >= until:
                    raise RegistryLocked(f"{path.toString()} is there; unlock() removes it if its writer is dead") from error
            time.sleep(0.2)
        try:
            yield
        finally:
            system.delete(path, False)

    def unlock(self) -> bool:
        """Remove the lock of a writer that died while it committed; false if there is none."""
        files, system = self._files()
        return system.delete(files.Path(f"{self.root}/{_LOCK}"), False)

    def remove_uncommitted(self, age: timedelta = timedelta(days=2)) -> list[str]:
        """Delete what batches wrote that were started longer than ``age`` ago and not committed; their ids.

        ``age`` must be more than any batch takes. Nothing a reader sees
        changes. A second run deletes what one that failed has left.
        """
        files, system = self._files()
        before, commits = _started(datetime.now(timezone.utc) - age), self.everything("commits").select("BatchID")
        gone: set[str] = set()
        for name, (_, partitions) in DATASETS.items():
            if name == "commits":
                continue
            left = (
                self.everything(name)
                .filter(F.col("BatchID") < before)
                .join(commits, "BatchID", "left_anti")
            )
            if "BatchID" in partitions:
                ids = [r["BatchID"] for r in left.select("BatchID").distinct().collect()]
                above = self._below(files.Path(f"{self.root}/{name}"), len(partitions) - 1) if ids else []
                for folder in above:
                    for batch_id in ids:
                        system.delete(files.Path(folder, f"BatchID={batch_id}"), True)
            else:
                # Every file was written by one batch.
                rows = self.everything(name).select("BatchID", F.col("_metadata.file_path").alias("file"))
                rows = rows.join(left.select("BatchID").distinct(), "BatchID", "left_semi").distinct().collect()
                ids = [r["BatchID"] for r in rows]
                for r in rows:
                    system.delete(files.Path(self.spark._jvm.java.net.URI(r["file"])), False)
            gone.update(ids)
        staging = files.Path(f"{self.root}/{_STAGING}")
        oldest = (datetime.now(timezone.utc) - age).timestamp() * 1000
        for found in system.listStatus(staging) if system.exists(staging) else ():
            if found.getModificationTime() < oldest:
                system.delete(found.getPath(), True)
        return sorted(gone)

    # -- previous-period reads -------------------------------------------------

    def prior_raw(
        self, submission_type: str, period: Column | str, subscribers: DataFrame | None = None
    ) -> DataFrame:
        """Raw rows of a period that are no duplicates, fields as columns."""
        rows = self._scoped("raw", submission_type, subscribers).filter(
            (F.col("ReportingPeriod") == period) & ~F.col("IsDuplicate")
        )
        return unpack(
            rows.select(
                "SubscriberCode",
                "SubmissionType",
                "FacilityAccNum",
                "CustomerID",
                "IdentityKey",
                "DisbursementDate",
                "CreditFacilityType",
                *FILE_ORDER,
                "IdentityFields",
            ),
            hash_fields(submission_type),
        )

    def prior_clean(
        self, submission_type: str, period: Column | str, subscribers: DataFrame | None = None
    ) -> DataFrame:
        """Clean rows of a period as written, fields as columns.

        A key written more than once still has several rows; their order is
        :func:`write_order`. The reader takes the last one anyway.
        """
        rows = self._scoped("clean", submission_type, subscribers).filter(
            F.col("ReportingPeriod") == period
        )
        return unpack(rows, hash_fields(submission_type))

    def open_unl(self, submission_type: str, subscribers: DataFrame | None = None) -> DataFrame:
        """Keys of unresolved exceptions of all periods.

        What is read does not grow with the number of periods: the newest
        snapshot of distinct keys, and the exceptions of the batches since.
        Without any snapshot all exceptions are read.
        """
        keys = self._open_keys(submission_type, self._newest_snapshot(submission_type))
        if subscribers is not None:
            codes = subscribers.select("SubscriberCode").distinct()
            keys = keys.join(F.broadcast(codes), "SubscriberCode", "left_semi")
        return keys.withColumn("Resolved", F.lit(False))

    def _newest_snapshot(self, submission_type: str) -> str | None:
        """The last committed batch with a snapshot of the type's open keys."""
        rows = self.committed("open_covered").filter(F.col("SubmissionType") == submission_type)
        return rows.agg(F.max("BatchID")).first()[0]

    def _covered(self, submission_type: str, snapshot: str) -> DataFrame:
        rows = self.batch("open_covered", snapshot, submission_type)
        return rows.select(F.col("Covered").alias("BatchID"))

    def _open_keys(self, submission_type: str, snapshot: str | None, upto: DataFrame | None = None) -> DataFrame:
        """Open keys of a snapshot and of the batches in ``upto`` (committed ones) that it does not cover."""
        batches = self.everything("commits").select("BatchID") if upto is None else upto
        rows = self.everything("unl").filter((F.col("SubmissionType") == submission_type) & ~F.col("Resolved"))
        if snapshot is None:
            return rows.join(F.broadcast(batches), "BatchID", "left_semi").select(*_OPEN_KEY)
        # As many as there are batches between two snapshots: folders that are named are the only ones listed.
        since = batches.join(self._covered(submission_type, snapshot), "BatchID", "left_anti")
        named = [r["BatchID"] for r in since.distinct().collect()]
        later = rows.filter(F.col("BatchID").isin(named)).select(*_OPEN_KEY)
        return self.batch("open_keys", snapshot, submission_type).select(*_OPEN_KEY).unionByName(later)

    def snapshot_open_keys(self, batch_id: str, submission_type: str) -> bool:
        """Write the distinct open keys as of a batch that is about to be committed, if it is time to.

        The batches it covers are written first and read back, so that a batch
        committed meanwhile is wholly in the snapshot or wholly after it.
        """
        newest = self._newest_snapshot(submission_type)
        commits = self.everything("commits").select("BatchID")
        since = commits if newest is None else commits.join(
            self._covered(submission_type, newest), "BatchID", "left_anti"
        )
        if since.count() + 1 < self.snapshot_every:
            return False
        own = self.spark.range(0, 1, 1, 1).select(F.lit(batch_id).alias("BatchID"))
        covered = commits.unionByName(own).distinct().coalesce(1)
        stamp = {"SubmissionType": F.lit(submission_type), "BatchID": F.lit(batch_id)}
        self.append("open_covered", covered.withColumnRenamed("BatchID", "Covered").withColumns(stamp))
        keys = self._open_keys(submission_type, newest, self._covered(submission_type, batch_id))
        self.append("open_keys", keys.distinct().withColumns(stamp))
        return True

    def _scoped(self, name: str, submission_type: str, subscribers: DataFrame | None) -> DataFrame:
        """Committed rows of a type, of those in column ``SubscriberCode`` of a frame if given."""
        rows = self.committed(name).filter(F.col("SubmissionType") == submission_type)
        if subscribers is None:
            return rows
        return rows.join(F.broadcast(subscribers.select("SubscriberCode").distinct()), "SubscriberCode", "left_semi")

    def clean(self) -> DataFrame:
        """The clean registry: one row per identity and period."""
        return merge_clean(self.committed("clean"), write_order()).withColumn(
            "IdentityKey", identity_key()
        )

    def raw_with_payload(self) -> DataFrame:
        """Raw rows together with the complete row as submitted."""
        payload = self.committed("submitted").select("RawRecordID", "RawPayload")
        return self.committed("raw").join(payload, "RawRecordID")

    # -- submissions -----------------------------------------------------------

    def loaded(self) -> DataFrame:
        """Subscriber, period, type and sequence of every loaded submission."""
        return self._submissions().select(
            "SubscriberCode", "ReportingPeriod", "SubmissionType", "SequenceNumber"
        )

    def _submissions(self) -> DataFrame:
        return self.committed("submissions").join(
            self.committed("subscribers").select("SubscriberID", "SubscriberCode"), "SubscriberID"
        )

    def history(
        self, subscriber_code: str, submission_type: str | None = None, limit: int = HISTORY_ROWS
    ) -> DataFrame:
        return submission_history(self._submissions(), subscriber_code, submission_type, limit)


# -- rows for the datasets -----------------------------------------------------


def new_subscribers(codes: DataFrame, known: DataFrame) -> DataFrame:
    """A subscriber row for every code that has none; the id follows from the code."""
    return (
        codes.select("SubscriberCode")
        .distinct()
        .join(known.select("SubscriberCode"), "SubscriberCode", "left_anti")
        .select(
            surrogate_id(F.col("SubscriberCode")).alias("SubscriberID"),
            "SubscriberCode",
            F.lit(None).cast("string").alias("SubscriberName"),
        )
    )


def new_submissions(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Submission rows for files not registered before, from name and row count."""
    unit = ["SubscriberCode", "ReportingPeriod", "SubmissionType", "SequenceNumber"]
    return files.join(loaded.select(*unit).distinct(), unit, "left_anti").select(
        surrogate_id(*map(F.col, unit)).alias("SubmissionID"),
        surrogate_id(F.col("SubscriberCode")).alias("SubscriberID"),
        "ReportingPeriod",
        "SubmissionType",
        "SequenceNumber",
        "FileName",
        F.col("RecordCount").cast("bigint").alias("RecordCount"),
    )


def submission_history(
    submissions: DataFrame,
    subscriber_code: str,
    submission_type: str | None = None,
    limit: int = HISTORY_ROWS,
) -> DataFrame:
    """A subscriber's latest submissions, newest period and sequence first."""
    rows = submissions.filter(F.col("SubscriberCode") == subscriber_code)
    if submission_type is not None:
        rows = rows.filter(F.col("SubmissionType") == submission_type)
    return (
        rows.orderBy(F.col("ReportingPeriod").desc(), F.col("SequenceNumber").desc())
        .limit(limit)
        .select(
            "ReportingPeriod",
            "SubmissionType",
            "SequenceNumber",
            "FileName",
            "RecordCount",
            "UploadedAt",
        )
    )


def _id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("RawRecordID"))


def clean_rows(raw: DataFrame) -> DataFrame:
    """Published rows of tagged raw rows, for the clean dataset."""
    category = (
        F.when(F.col("Route") == "cleaned_output", F.lit(CLEAN_EXACT))
        .when(F.col("Route") == "rearranged_output", F.lit(CLEAN_REARRANGED))
        .when(F.col("Route") == "enriched_output", F.lit(CLEAN_ENRICHED))
    )
    rows = raw.withColumn("MatchCategory", category).filter(F.col("MatchCategory").isNotNull())
    return rows.withColumns(
        {
            "CleanRecordID": _id("C-"),
            "SourceRawRecordID": F.col("RawRecordID"),
            "IdentityFields": F.col("PublishedFields"),
            "Status": F.lit(CLEAN_STATUS),
        }
    )


def unl_rows(raw: DataFrame) -> DataFrame:
    """Exception rows of tagged raw rows; they start unresolved."""
    return raw.filter(F.col("Route") == "unl_output").withColumns(
        {
            "UNLRecordID": _id("U-"),
            "Details": F.col("FieldDifferences"),
            "Resolved": F.lit(False),
            "ResolvedInPeriod": F.lit(None).cast("string"),
        }
    )


def date_log_rows(raw: DataFrame) -> DataFrame:
    return raw.filter("DateChanged").withColumn("DateChangeID", _id("D-"))


def seed_clean(
    registry: Registry, rows: DataFrame, subscriber_code: str, submission_type: str, period: str
) -> str:
    """Load last cycle's cleaned records as a period's clean baseline.

    ``rows`` have facility, customer and the identity and contact fields, as
    columns of text. Anything the period's files publish later replaces them.
    """
    batch_id = new_batch_id()
    seeded = normalize_fields(rows, submission_type).withColumns(
        {
            "SubscriberCode": F.lit(subscriber_code),
            "SubmissionType": F.lit(submission_type),
        }
    )
    names = [f for f in hash_fields(submission_type) if f in seeded.columns]
    content = joined(F.col(c) for c in ("FacilityAccNum", "CustomerID", *names))
    seeded = seeded.withColumns(
        {
            "IdentityKey": identity_key(),
            "CleanRecordID": F.concat(F.lit("S-"), F.md5(joined([F.lit(batch_id), content]))),
            "SourceRawRecordID": F.lit(None).cast("string"),
            "IdentityFields": pack(seeded, submission_type),
            "MatchCategory": F.lit(CLEAN_SEED),
            "Status": F.lit(CLEAN_STATUS),
            "SequenceNumber": F.lit(0),
            "PartName": F.lit(""),
            "BlockStart": F.lit(0).cast("bigint"),
            "RowIndex": F.xxhash64(content),
            "CreatedAt": F.current_timestamp(),
            "ReportingPeriod": F.lit(period),
            "BatchID": F.lit(batch_id),
        }
    )
    registry.append("clean", seeded)
    registry.commit(batch_id)
    return batch_id
