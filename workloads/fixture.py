"""Reconciliation inputs derived from the given tables.

Ten classes by ``key % 10`` cover every route a record can take:

0 unchanged and in clean          5 passport added
1 unchanged, not in clean         6 licence and TIN swapped, in clean
2 unchanged, exception still open 7 licence moved to passport, some still open
3 national id changed             8 not there last month
4 licence removed                 9 next day's date, and a duplicate at +100
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from monthmatch.fixed_values import hash_fields

CURRENT_PERIOD = "2026-06"
PRIOR_PERIOD = "2026-05"
TYPE = "IND"

# table -> (key, balance, subscriber number, code prefix)
SOURCES = {
    "customer": ("c_custkey", "c_acctbal", "c_nationkey", "CP"),
    "orders": ("o_orderkey", "o_totalprice", "o_custkey % 25", "OR"),
}


@dataclass(frozen=True)
class Inputs:
    current: DataFrame
    prior_raw: DataFrame
    prior_clean: DataFrame
    open_unl: DataFrame


def _keyed(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    key, balance, subscriber, prefix = SOURCES[table]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(
        f"{key} AS k",
        f"CAST({balance} AS DECIMAL(18,2)) AS bal",
        f"concat('{prefix}', {subscriber}) AS code",
        f"{key} % 10 AS cls",
        "0 AS n",
    )


def _record(df: DataFrame, day: str, balance: str, **values: str) -> DataFrame:
    base = {
        "NatIDNum": "concat('GHA-', k)",
        "DriverLicNum": "concat('DL-', k)",
        "TINum": "concat('TIN-', k)",
        "MobileTel1": "concat('020', k)",
    }
    fields = {f: values.get(f, base.get(f, "''")) for f in hash_fields(TYPE)}
    return df.selectExpr(
        "code AS SubscriberCode",
        f"'{TYPE}' AS SubmissionType",
        "concat('F', k) AS FacilityAccNum",
        "concat('C', k) AS CustomerID",
        f"concat('202601', lpad(CAST({day} AS STRING), 2, '0')) AS DisbursementDate",
        "'LOAN' AS CreditFacilityType",
        f"CAST({balance} AS STRING) AS CurBal",
        *[f"{value} AS {name}" for name, value in fields.items()],
        "k * 2 + n AS RowOrder",
    )


def _current(keyed: DataFrame) -> DataFrame:
    rows = keyed.selectExpr(
        "k", "bal", "code", "cls", "explode(IF(cls = 9, array(0, 1), array(0))) AS n"
    )
    return _record(
        rows,
        "IF(cls = 9, 2, 1) + k % 28",
        "CAST(bal + 100 * n AS DECIMAL(18,2))",
        NatIDNum="concat(IF(cls = 3, 'GHX-', 'GHA-'), k)",
        DriverLicNum="CASE WHEN cls IN (4, 7) THEN '' WHEN cls = 6 THEN concat('TIN-', k)"
        " ELSE concat('DL-', k) END",
        PassportNum="CASE WHEN cls = 5 THEN concat('PP-', k) WHEN cls = 7 THEN concat('DL-', k)"
        " ELSE '' END",
        TINum="IF(cls = 6, concat('DL-', k), concat('TIN-', k))",
    )


def _prior_raw(keyed: DataFrame) -> DataFrame:
    return _record(keyed.filter("cls <> 8"), "1 + k % 28", "bal")


def _prior_clean(keyed: DataFrame) -> DataFrame:
    verified = "concat('GHA-', k, '-CLEAN')"
    return _record(
        keyed.filter("cls IN (0, 3, 4, 6, 9)"), "1 + k % 28", "bal", NatIDNum=verified
    )


def _open_unl(keyed: DataFrame) -> DataFrame:
    return keyed.filter("cls = 2 OR (cls = 7 AND floor(k / 10) % 2 = 0)").selectExpr(
        "code AS SubscriberCode",
        f"'{TYPE}' AS SubmissionType",
        "concat('F', k) AS FacilityAccNum",
        "concat('C', k) AS CustomerID",
        "FALSE AS Resolved",
    )


def current(spark: SparkSession, sf_dir: str, table: str = "customer") -> DataFrame:
    return _current(_keyed(spark, sf_dir, table))


def prior_raw(spark: SparkSession, sf_dir: str, table: str = "customer") -> DataFrame:
    return _prior_raw(_keyed(spark, sf_dir, table))


def prior_clean(spark: SparkSession, sf_dir: str, table: str = "customer") -> DataFrame:
    return _prior_clean(_keyed(spark, sf_dir, table))


def inputs(spark: SparkSession, sf_dir: str, table: str = "customer") -> Inputs:
    keyed = _keyed(spark, sf_dir, table)
    return Inputs(_current(keyed), _prior_raw(keyed), _prior_clean(keyed), _open_unl(keyed))
