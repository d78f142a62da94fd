"""Files loaded as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from monthmatch.plans.backfill import BackfillReport, load_by_period
from monthmatch.sources.registry import Registry
from monthmatch.sources.quoted import literal_path
from monthmatch.sources.submissions import FILE_GLOB, MultiLine, describe_files, located

_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def arriving_files(
    spark: SparkSession, root: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A stream of the paths of new files; contents are not read here."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", FILE_GLOB)
    )
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return located(reader.load(literal_path(root)))


def start_ingest(
    registry: Registry,
    root: str,
    checkpoint: str,
    *,
    max_files_per_trigger: int | None = None,
    processing_time: str | None = None,
    multi_line: MultiLine = True,
    on_report: Callable[[BackfillReport], None] | None = None,
) -> StreamingQuery:
    """Load every file that arrives below ``root`` into the registry.

    A micro-batch takes its files period by period through the same code as a
    backfill. One that is repeated after a failure finds its committed files
    loaded and skips them, so the stream's checkpoint and the registry need
    not agree on the last batch. A file that cannot be used is reported to
    ``on_report``; any other failure stops the query, to be started again.
    Without ``processing_time`` the query takes what is there and stops.
    """

    def load(paths: DataFrame, _batch: int) -> None:
        files = describe_files(paths)
        report = load_by_period(registry, files, multi_line=multi_line, keep_going=False)
        if on_report is not None:
            on_report(report)

    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        arriving_files(registry.spark, root, max_files_per_trigger)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
