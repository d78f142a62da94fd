"""Submission files and registries derived from the customer table.

Three periods of one individual subscriber: May has the fixture's prior rows,
June its current rows in two sequences, July June's rows once more. The
fixture's clean rows are the baseline of May. Beside them lie a file with a
missing column, one of another type and one with a name that is no submission.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmatch.fixed_values import BALANCE, CUSTOMER, DATE, FACILITY, FACILITY_TYPE, hash_fields, required_columns
from monthmatch.plans.backfill import BackfillReport, run_backfill
from monthmatch.session import shared_folder
from monthmatch.sources.registry import Registry, seed_clean
from monthmatch.sources.reports import write_csv
from monthmatch.streaming.ingest import start_ingest
from workloads import fixture

CODE = "CP"
_built: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, build):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def forget_registries() -> None:
    """Build registries anew when they are asked for next; written files are kept."""
    for key in [k for k in _built if k[0] != "files"]:
        del _built[key]


def _file_rows(df: DataFrame) -> DataFrame:
    """The columns of an individual's file, and one more that rides along."""
    return df.select(
        F.col(FACILITY).alias("Credit FacilityAccNum"),
        CUSTOMER,
        DATE,
        FACILITY_TYPE,
        BALANCE,
        *hash_fields("IND"),
        F.concat(F.lit('say "'), F.col(FACILITY), F.lit('", twice')).alias("Remark"),
    )


def _business_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col(FACILITY).alias("Credit FacilityAccNum"),
        CUSTOMER,
        DATE,
        BALANCE,
        F.col("NatIDNum").alias("BusRegNum"),
        F.lit("").alias("PrevRegNum"),
        "TINum",
        F.col("MobileTel1").alias("OfficeTel1"),
        F.lit("").alias("OfficeTel2"),
        F.lit("").alias("OfficeFaxNum"),
    )


def submission_files(spark: SparkSession, sf_dir: str) -> str:
    """Root of the written files; they are written once per session and scale."""

    def build() -> str:
        root = shared_folder(spark) + "/files"
        # Parts by ranges of rows, as many as their size asks for, however many the table was read in.
        prior, now = (
            rows.repartitionByRange("RowOrder").sortWithinPartitions("RowOrder")
            for rows in (fixture.prior_raw(spark, sf_dir), fixture.current(spark, sf_dir))
        )
        second = F.col("RowOrder") % 6 >= 4
        written = {
            "CP0526_IND": _file_rows(prior),
            "CP0626_IND": _file_rows(now.filter(~second)),
            "more/cp0626_ind_2": _file_rows(now.filter(second)),
            "CP0726_IND_1": _file_rows(now),
            "CP0526_BUS": _business_rows(prior),
            "CP0826_IND": _file_rows(now).drop("TINum"),
            "CP1326_IND": _file_rows(now),
        }
        with ThreadPoolExecutor(4) as pool:
            paths = [f"{root}/2026/{name}" for name in written]
            list(pool.map(write_csv, written.values(), paths))
        return root

    return _once("files", spark, sf_dir, build)


def supplier_files(spark: SparkSession, sf_dir: str) -> str:
    """A small submission of every supplier; some names have a month 13, some headers lack columns."""

    def build() -> str:
        root = f"{shared_folder(spark)}/suppliers"
        key = F.col("s_suppkey")
        name = F.concat(
            F.lit("S"),
            key.cast("string"),
            F.format_string("%02d26", (1 + key % 13).cast("int")),
            F.when(key % 2 == 0, "_IND").otherwise("_bus"),
            F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("_"), (key % 7 + 1).cast("string"))),
        )

        def header(kind: str, *without: str):
            return F.lit(",".join(c for c in required_columns(kind) if c not in without))

        def headers(kind: str):
            few = F.when(key % 5 == 0, header(kind, "CurBal")).when(key % 5 == 1, header(kind, "TINum", "CustomerID"))
            return few.otherwise(header(kind))

        line = F.when(key % 2 == 0, headers("IND")).otherwise(headers("BUS"))
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(name.alias("name"), line.alias("line"))
        texts = rows.groupBy("name").agg(F.concat(F.array_join(F.collect_list("line"), "\n"), F.lit("\n")).alias("text"))
        texts = texts.repartition(4 * spark.sparkContext.defaultParallelism, "name")

        def write(found) -> None:
            # The tasks write the files themselves: a table with a partition for each would have all of them moved by the driver.
            system, folder = FileSystem.from_uri(root)
            system.create_dir(folder, recursive=True)
            for row in found:
                with system.open_output_stream(f"{folder}/{row['name']}.csv") as out:
                    out.write(row["text"].encode())

        texts.foreachPartition(write)
        return root

    return _once("files", spark, sf_dir + "#suppliers", build)


def broken_lines(spark: SparkSession, sf_dir: str) -> str:
    """One file whose cells hold line breaks, commas and quotes."""

    def build() -> str:
        path = f"{shared_folder(spark)}/lines/CP0526_IND"
        rows = _file_rows(fixture.prior_raw(spark, sf_dir).orderBy("RowOrder"))
        remark = F.when(F.col("CustomerID").endswith("3"), F.lit('a\n"b",\n\nc')).otherwise(F.col("Remark"))
        write_csv(rows.withColumn("Remark", remark).coalesce(1), path)
        return path

    return _once("files", spark, sf_dir + "#lines", build)


def _seeded(spark: SparkSession, sf_dir: str) -> Registry:
    registry = Registry(spark, shared_folder(spark) + "/registry").create()
    clean = fixture.prior_clean(spark, sf_dir).drop("SubscriberCode", "SubmissionType")
    seed_clean(registry, clean, CODE, "IND", fixture.PRIOR_PERIOD)
    return registry


def seeded_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """Nothing but the baseline."""
    return _once("seeded", spark, sf_dir, lambda: _seeded(spark, sf_dir))


def backfilled(spark: SparkSession, sf_dir: str) -> tuple[Registry, BackfillReport]:
    """Baseline and all files."""

    def build():
        registry = _seeded(spark, sf_dir)
        return registry, run_backfill(registry, submission_files(spark, sf_dir))

    return _once("backfilled", spark, sf_dir, build)


def streamed(spark: SparkSession, sf_dir: str) -> Registry:
    """The same through the file stream, all files at once."""

    def build():
        registry = _seeded(spark, sf_dir)
        query = start_ingest(
            registry, submission_files(spark, sf_dir), shared_folder(spark) + "/checkpoint"
        )
        query.awaitTermination()
        return registry

    return _once("streamed", spark, sf_dir, build)
