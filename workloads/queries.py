"""One query per operator over the given tables, with its DuckDB equivalent.

``QUERIES[name]`` takes ``(spark, sf_dir)``; ``ORACLES[name]`` gives the same
rows from the same tables. Dates are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmatch.fixed_values import MATCH_KEY, OUTPUT_TITLES, hash_fields
from monthmatch.functions import parse, text
from monthmatch.functions.compare import FieldComparison
from monthmatch.functions.fields import pack, unpack
from monthmatch.operators.dedup import composite_key, first_per_key, mark_duplicates
from monthmatch.operators.match import Lookups, clean_lookup, fields_ready, open_unl_lookup, prior_lookup
from monthmatch.operators.merge import category_rank, merge_clean
from monthmatch.operators.outputs import outputs
from monthmatch.operators.skew import find_heavy_keys
from monthmatch.operators.summary import headline_metrics, run_summary
from monthmatch.plans.backfill import batch_stats, period_count, run_backfill
from monthmatch.plans.batch import tagged_batch
from monthmatch.plans.history import replay
from monthmatch.plans.reconcile import reconcile
from monthmatch.session import shared_folder
from monthmatch.sources.registry import Registry, new_submissions, new_subscribers
from monthmatch.sources.reports import preview, write_bundle, write_outputs
from monthmatch.sources.submissions import (
    checked_headers,
    chronological,
    describe_files,
    discover_files,
    load_file,
    pending_files,
    read_headers,
)
from workloads import files, fixture
from workloads.oracle_ctes import FIELDS, IDENTITY, KEYS, history, summary, tagged
from workloads.oracle_ctes import fixture as fixture_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, or else under that of the function."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def _tagged(spark: SparkSession, sf_dir: str, table: str = "customer") -> DataFrame:
    i = fixture.inputs(spark, sf_dir, table)
    return reconcile(i.current, i.prior_raw, i.prior_clean, fixture.TYPE, i.open_unl)


def _subscriber(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(files.CODE,)], "SubscriberCode STRING")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _list(names, prefix: str = "") -> str:
    return ", ".join(f'"{prefix}{n}"' + (f' AS "{n}"' if prefix else "") for n in names)


ROW = ("IdentityKey", "RowOrder")
TAG = tagged()


# -- whole reconciliation --------------------------------------------------------

_RECONCILED = f"""SELECT "IdentityKey", "RowOrder", "MatchFlag", "Route", "ExceptionCategory", "Source",
    "FieldDifferences", "AddedFields", "ChangedFields", "RemovedFields", "DateChanged",
    {_list(FIELDS, "pub_")} FROM tag"""


def _reconciled(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return _tagged(spark, sf_dir, table).select(
        *ROW,
        "MatchFlag",
        "Route",
        "ExceptionCategory",
        "Source",
        "FieldDifferences",
        "AddedFields",
        "ChangedFields",
        "RemovedFields",
        "DateChanged",
        "Published.*",
    )


@query(f"{TAG} {_RECONCILED}", name="reconcile")
def reconcile_customer(spark, sf_dir):
    return _reconciled(spark, sf_dir, "customer")


@query(f"{tagged('orders')} {_RECONCILED}")
def reconcile_orders(spark, sf_dir):
    return _reconciled(spark, sf_dir, "orders")


@query(f"{TAG} {summary('tag')}", name="run_summary")
def run_summary_counts(spark, sf_dir):
    return run_summary(_tagged(spark, sf_dir))


@query(
    f"""{TAG} SELECT count(*) AS "InputRecords",
    count(*) FILTER ("Route" IN ('cleaned_output', 'rearranged_output', 'enriched_output')) AS "AutoCleaned",
    count(*) FILTER ("Route" = 'unl_output') AS "SentToUnl",
    count(*) FILTER ("DateChanged") AS "DateChanges" FROM tag""",
    name="headline_metrics",
)
def headline(spark, sf_dir):
    return headline_metrics(_tagged(spark, sf_dir))


# -- matching and comparison -----------------------------------------------------


@query(f'{TAG} SELECT "IdentityKey", "RowOrder", "MatchFlag" FROM tag WHERE rn = 1')
def match_flags(spark, sf_dir):
    return _tagged(spark, sf_dir).filter("NOT IsDuplicate").select(*ROW, "MatchFlag")


def _with_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fixture.inputs(spark, sf_dir)
    lookups = Lookups(
        prior_lookup(i.prior_raw, fixture.TYPE, ["RowOrder"]),
        clean_lookup(i.prior_clean, fixture.TYPE, ["RowOrder"]),
        open_unl_lookup(i.open_unl),
    )
    current = fields_ready(i.current, fixture.TYPE).withColumn("IdentityKey", text.identity_key())
    return lookups.attach_prior(current.repartition(*MATCH_KEY))


@query(
    f"""{TAG} SELECT "IdentityKey", "RowOrder", matched AS "HasPrior",
    CAST("PreviousDate" AS VARCHAR) AS "PriorDate", {_list(FIELDS, "old_")} FROM tag"""
)
def prior_match(spark, sf_dir):
    prior = F.col("Prior")
    return _with_prior(spark, sf_dir).select(
        *ROW,
        prior.isNotNull().alias("HasPrior"),
        prior["DisbursementDate"].cast("string").alias("PriorDate"),
        *[prior[f].alias(f) for f in hash_fields(fixture.TYPE)],
    )


@query(
    f"""{TAG} SELECT "IdentityKey", "RowOrder", differing AS "DifferingFields" FROM tag
    WHERE matched AND differs"""
)
def field_diffs(spark, sf_dir):
    compare = FieldComparison(fixture.TYPE)
    rows = _with_prior(spark, sf_dir).filter(F.col("Prior").isNotNull() & ~compare.same())
    return rows.select(*ROW, compare.differing().alias("DifferingFields"))


_KINDS = '"IdentityKey", "RowOrder", "AddedFields", "ChangedFields", "RemovedFields"'


@query(f"""{TAG} SELECT {_KINDS} FROM tag WHERE rn = 1 AND matched AND differs""")
def diff_kinds(spark, sf_dir):
    rows = _tagged(spark, sf_dir).filter("FieldDifferences <> ''")
    return rows.select(*ROW, "AddedFields", "ChangedFields", "RemovedFields")


@query(f'{TAG} SELECT "IdentityKey", "RowOrder", "FieldDifferences" FROM tag WHERE rn = 1')
def diff_text(spark, sf_dir):
    return _tagged(spark, sf_dir).filter("NOT IsDuplicate").select(*ROW, "FieldDifferences")


@query(f"""{TAG} SELECT "IdentityKey", "RowOrder", rn = 1 AND matched AND moved AS "Rearranged" FROM tag""")
def rearranged(spark, sf_dir):
    return _tagged(spark, sf_dir).select(*ROW, "Rearranged")


@query(f"""{TAG} SELECT "IdentityKey", "RowOrder", "AddedFields" FROM tag WHERE "MatchFlag" = 'Enriched'""")
def enriched(spark, sf_dir):
    return _tagged(spark, sf_dir).filter("MatchFlag = 'Enriched'").select(*ROW, "AddedFields")


@query(
    f"""{TAG} SELECT "IdentityKey", CAST("PreviousDate" AS VARCHAR) AS "PreviousDate",
    CAST("CurrentDate" AS VARCHAR) AS "CurrentDate", "CreditFacilityType" FROM tag WHERE "DateChanged\""""
)
def date_changes(spark, sf_dir):
    log = outputs(_tagged(spark, sf_dir))["date_change_log"]
    return log.select("IdentityKey", _day("PreviousDate"), _day("CurrentDate"), "CreditFacilityType")


# -- routing and outputs ---------------------------------------------------------


@query(f'{TAG} SELECT "IdentityKey", "RowOrder", "Route" FROM tag')
def route_split(spark, sf_dir):
    return _tagged(spark, sf_dir).select(*ROW, "Route")


_FOUND = "\"MatchFlag\" IN ('Exact match', 'Rearranged')"


@query(f'{TAG} SELECT "IdentityKey", "RowOrder", "MatchFlag" FROM tag WHERE {_FOUND} AND in_clean')
def clean_eligible(spark, sf_dir):
    rows = _tagged(spark, sf_dir).filter("MatchFlag IN ('Exact match', 'Rearranged') AND InClean")
    return rows.select(*ROW, "MatchFlag")


@query(f'{TAG} SELECT "IdentityKey", "RowOrder", "MatchFlag" FROM tag WHERE {_FOUND} AND NOT in_clean')
def clean_not_found(spark, sf_dir):
    rows = _tagged(spark, sf_dir).filter("MatchFlag IN ('Exact match', 'Rearranged') AND NOT InClean")
    return rows.select(*ROW, "MatchFlag")


@query(
    f"""{TAG} SELECT "IdentityKey", "RowOrder", in_open AS "InOpenUnl", "ExceptionCategory" FROM tag
    WHERE {_FOUND} AND NOT in_clean"""
)
def unl_carryover(spark, sf_dir):
    rows = _tagged(spark, sf_dir).filter("MatchFlag IN ('Exact match', 'Rearranged') AND NOT InClean")
    return rows.select(*ROW, "InOpenUnl", "ExceptionCategory")


@query(
    f"""{TAG} SELECT "IdentityKey", "RowOrder", {_list(FIELDS, "pub_")} FROM tag
    WHERE "Route" IN ('cleaned_output', 'rearranged_output')"""
)
def carry_forward(spark, sf_dir):
    carried = F.col("Route").isin("cleaned_output", "rearranged_output")
    return _tagged(spark, sf_dir).filter(carried).select(*ROW, "Published.*")


def _published_sql(route: str) -> str:
    return f"""{TAG} SELECT "IdentityKey", "RowOrder", "DisbursementDate", "CurBal", "MatchFlag",
        {_list(FIELDS, "pub_")}, "Source" FROM tag WHERE "Route" = '{route}'"""


def _published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return outputs(_tagged(spark, sf_dir))[name].select(
        *ROW, "DisbursementDate", "CurBal", "MatchFlag", *hash_fields(fixture.TYPE), "Source"
    )


@query(_published_sql("cleaned_output"))
def cleaned_output(spark, sf_dir):
    return _published(spark, sf_dir, "cleaned_output")


@query(_published_sql("rearranged_output"))
def rearranged_output(spark, sf_dir):
    return _published(spark, sf_dir, "rearranged_output")


@query(_published_sql("enriched_output"))
def enriched_output(spark, sf_dir):
    return _published(spark, sf_dir, "enriched_output")


@query(
    f"""{TAG} SELECT "IdentityKey", "RowOrder", "CurBal", {_list(FIELDS)}, "MatchFlag", "FieldDifferences",
    "ExceptionCategory" FROM tag WHERE "Route" = 'unl_output'"""
)
def unl_output(spark, sf_dir):
    return outputs(_tagged(spark, sf_dir))["unl_output"].select(
        *ROW, "CurBal", *hash_fields(fixture.TYPE), "MatchFlag", "FieldDifferences", "ExceptionCategory"
    )


@query(
    f"""{TAG} SELECT "IdentityKey", "RowOrder", "ExceptionCategory" FROM tag WHERE "Route" = 'unl_output'
    ORDER BY "RowOrder" LIMIT 200"""
)
def preview_output(spark, sf_dir):
    return preview(_tagged(spark, sf_dir), "unl_output").select(*ROW, "ExceptionCategory")


# -- skewed and null keys --------------------------------------------------------

# A third of the orders are one identity with few dates, some of them null.
_SKEWED = """SELECT *, CASE WHEN hot THEN 'H' ELSE 'F' || CAST(o_orderkey AS VARCHAR) END AS fac,
    CASE WHEN o_orderkey % 21 = 0 THEN NULL
         WHEN hot THEN CAST('2026-01-01' AS DATE) + CAST(o_orderkey % 5 AS INTEGER)
         ELSE CAST(o_orderdate AS DATE) END AS day
    FROM (SELECT *, o_orderkey % 3 = 0 AS hot FROM orders) AS o"""


@query(
    f"""WITH rows AS ({_SKEWED}), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY fac, day ORDER BY o_totalprice, o_orderkey) AS rn FROM rows),
    lows AS (SELECT fac, min(o_orderkey) AS low FROM rows GROUP BY fac)
    SELECT o_orderkey AS "RowOrder", rn > 1 AS "IsDuplicate",
        CASE WHEN rn > 1 THEN 'dedup_log'
             WHEN hot OR o_orderkey % 2 = 0 THEN 'cleaned_output' ELSE 'unl_output' END AS "Route",
        rn = 1 AND low_day IS NOT NULL AND low_day IS DISTINCT FROM day AS "DateChanged"
    FROM ranked JOIN (SELECT lows.fac, low, r.day AS low_day FROM lows JOIN rows AS r ON r.o_orderkey = low)
    USING (fac)"""
)
def reconcile_skewed(spark, sf_dir):
    hot, key = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")
    day = F.when(hot, F.date_add(F.lit("2026-01-01").cast("date"), (key % 5).cast("int"))).otherwise(
        F.col("o_orderdate").cast("date")
    )
    rows = _table(spark, sf_dir, "orders").select(
        F.lit("S").alias("SubscriberCode"),
        F.lit(fixture.TYPE).alias("SubmissionType"),
        F.when(hot, F.lit("H")).otherwise(F.concat(F.lit("F"), key.cast("string"))).alias("FacilityAccNum"),
        F.lit("C").alias("CustomerID"),
        F.when(key % 21 != 0, day).alias("DisbursementDate"),
        F.col("o_totalprice").alias("CurBal"),
        key.alias("RowOrder"),
    )
    clean = rows.filter((F.col("FacilityAccNum") == "H") | (F.col("RowOrder") % 2 == 0))
    heavy = find_heavy_keys(rows, MATCH_KEY, [*MATCH_KEY, "DisbursementDate"], min_rows=100)
    tagged = reconcile(rows, rows, clean, fixture.TYPE, heavy=heavy)
    return tagged.select("RowOrder", "IsDuplicate", "Route", "DateChanged")


_NULL_KEYS = """SELECT o_orderkey, o_totalprice,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 10 END AS fac,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS cust,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) - CAST(dayofyear(o_orderdate) AS INTEGER) END
        AS day FROM orders"""


def _null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return _table(spark, sf_dir, "orders").select(
        F.lit("S").alias("SubscriberCode"),
        F.lit(fixture.TYPE).alias("SubmissionType"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 10).alias("FacilityAccNum"),
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("CustomerID"),
        F.when(key % 5 != 0, F.date_sub(day, F.dayofyear(day))).alias("DisbursementDate"),
        F.col("o_totalprice").alias("CurBal"),
        key.alias("RowOrder"),
    )


@query(
    f"""SELECT o_orderkey AS "RowOrder", row_number() OVER w > 1 AS "IsDuplicate",
    CASE WHEN row_number() OVER w > 1 THEN first_value(o_orderkey) OVER w END AS "KeptOverThisRecordID"
    FROM ({_NULL_KEYS}) AS o WINDOW w AS (PARTITION BY fac, cust, day ORDER BY o_totalprice, o_orderkey)"""
)
def dedup_null_keys(spark, sf_dir):
    rows = _null_keys(spark, sf_dir)
    keys = [*MATCH_KEY, "DisbursementDate"]
    heavy = find_heavy_keys(rows, MATCH_KEY, keys, min_rows=20)
    marked = mark_duplicates(rows, keys, F.col("CurBal"), ["RowOrder"], "RowOrder", heavy.records)
    return marked.select("RowOrder", "IsDuplicate", "KeptOverThisRecordID")


@query(
    f"""WITH rows AS ({_NULL_KEYS}), prior AS (SELECT DISTINCT fac, cust FROM rows WHERE o_orderkey % 2 = 0)
    SELECT o_orderkey AS "RowOrder", EXISTS (
        SELECT 1 FROM prior WHERE prior.fac IS NOT DISTINCT FROM rows.fac
        AND prior.cust IS NOT DISTINCT FROM rows.cust) AS "Matched" FROM rows"""
)
def match_null_keys(spark, sf_dir):
    rows = _null_keys(spark, sf_dir).withColumn("DisbursementDate", F.col("RowOrder").cast("string"))
    prior = rows.filter("RowOrder % 2 = 0")
    tagged = reconcile(rows, prior, prior.limit(0), fixture.TYPE)
    return tagged.select("RowOrder", (F.col("MatchFlag") != "No previous-month match").alias("Matched"))


@query(
    """SELECT o_orderkey AS "RowOrder", row_number() OVER (
        PARTITION BY o_custkey % 50, strftime(o_orderdate, '%Y%m') ORDER BY o_totalprice, o_orderkey) > 1 AS "IsDuplicate"
    FROM orders"""
)
def dedup_period(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(
        F.lit("S").alias("SubscriberCode"),
        F.lit(fixture.TYPE).alias("SubmissionType"),
        (F.col("o_custkey") % 50).alias("FacilityAccNum"),
        F.lit("C").alias("CustomerID"),
        F.date_format("o_orderdate", "yyyyMM01").alias("DisbursementDate"),
        F.col("o_totalprice").alias("CurBal"),
        F.col("o_orderkey").alias("RowOrder"),
        (F.col("o_orderkey") % 4).alias("SequenceNumber"),
    )
    nothing = rows.limit(0)
    tagged = reconcile(rows, nothing, nothing, fixture.TYPE, dedup_scope="period")
    return tagged.select("RowOrder", "IsDuplicate")


# -- duplicates and first rows, at volume ----------------------------------------

_LINES = """SELECT 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS code,
    'F' || CAST(l_suppkey AS VARCHAR) AS fac, l_returnflag AS cust,
    strftime(l_shipdate, '%Y%m%d') AS day, l_extendedprice AS bal,
    concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id,
    l_orderkey, l_partkey, l_linenumber FROM lineitem"""
_LINE_ORDER = ("l_orderkey", "l_partkey", "l_linenumber")
_LINE_KEYS = ("SubscriberCode", "FacilityAccNum", "CustomerID", "DisbursementDate")
_LINE_WINDOW = (
    "WINDOW w AS (PARTITION BY code, fac, cust, day"
    " ORDER BY bal NULLS LAST, l_orderkey, l_partkey, l_linenumber)"
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("SubscriberCode"),
        F.concat(F.lit("F"), F.col("l_suppkey").cast("string")).alias("FacilityAccNum"),
        F.col("l_returnflag").alias("CustomerID"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("DisbursementDate"),
        F.col("l_extendedprice").alias("CurBal"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("RawRecordID"),
        *_LINE_ORDER,
    )


def _flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    heavy = find_heavy_keys(lines, _LINE_KEYS[:3], _LINE_KEYS)
    return mark_duplicates(
        lines, _LINE_KEYS, F.col("CurBal"), _LINE_ORDER, "RawRecordID", heavy.records
    )


@query(
    f"""SELECT id AS "RawRecordID", bal AS "CurBal" FROM (
    SELECT id, bal, row_number() OVER w AS rn FROM ({_LINES}) AS l {_LINE_WINDOW}) AS r WHERE rn = 1"""
)
def dedup_kept(spark, sf_dir):
    return _flagged_lines(spark, sf_dir).filter("NOT IsDuplicate").select("RawRecordID", "CurBal")


@query(
    f"""SELECT id AS "RawRecordID", concat_ws('|', fac, cust, day) AS "CompositeKey",
    bal AS "ThisRowBalance", kept AS "KeptBalance",
    'Duplicate key — higher or tied balance, not kept' AS "DedupReason" FROM (
    SELECT *, row_number() OVER w AS rn, first_value(bal) OVER w AS kept
    FROM ({_LINES}) AS l {_LINE_WINDOW}) AS r WHERE rn > 1"""
)
def dedup_log(spark, sf_dir):
    rows = _flagged_lines(spark, sf_dir).filter("IsDuplicate")
    return rows.select(
        "RawRecordID",
        composite_key().alias("CompositeKey"),
        "ThisRowBalance",
        "KeptBalance",
        "DedupReason",
    )


@query(
    f"""SELECT id AS "RawRecordID", rn > 1 AS "IsDuplicate",
    CASE WHEN rn > 1 THEN kept END AS "KeptOverThisRecordID",
    CASE WHEN rn > 1 THEN 'Duplicate key — higher or tied balance, not kept' END AS "DedupReason" FROM (
    SELECT *, row_number() OVER w AS rn, first_value(id) OVER w AS kept
    FROM ({_LINES}) AS l {_LINE_WINDOW}) AS r"""
)
def dedup_flags(spark, sf_dir):
    rows = _flagged_lines(spark, sf_dir)
    return rows.select("RawRecordID", "IsDuplicate", "KeptOverThisRecordID", "DedupReason")


@query(
    f"""SELECT code AS "SubscriberCode", fac AS "FacilityAccNum", cust AS "CustomerID",
    id AS "RawRecordID" FROM (SELECT *, row_number() OVER (PARTITION BY code, fac, cust
    ORDER BY l_orderkey, l_partkey, l_linenumber) AS rn FROM ({_LINES}) AS l) AS r WHERE rn = 1""",
    name="first_per_key",
)
def first_per_identity(spark, sf_dir):
    rows = first_per_key(_lines(spark, sf_dir), MATCH_KEY, _LINE_ORDER)
    return rows.select(*MATCH_KEY, "RawRecordID")


# -- scalar functions ------------------------------------------------------------


@query(
    """SELECT o_orderkey, variant,
    CASE variant WHEN 0 THEN '' WHEN 4 THEN CAST(CAST(o_orderkey AS HUGEINT) * 1000000007 AS VARCHAR)
    ELSE CAST(value AS VARCHAR) END AS "Text" FROM (
    SELECT o_orderkey, o_orderkey % 5 AS variant, CASE o_orderkey % 5
    WHEN 1 THEN o_totalprice + 0.125 WHEN 2 THEN o_totalprice * 1000 + 0.5
    WHEN 3 THEN (1 + o_orderkey) / 16777216.0::DOUBLE END AS value FROM orders) AS v"""
)
def stringify_numeric(spark, sf_dir):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    variant = key % 5
    value = (
        F.when(variant == 1, price + 0.125)
        .when(variant == 2, price * 1000 + 0.5)
        .when(variant == 3, (1 + key) / F.lit(16777216.0))
        .when(variant == 4, (key * 1000000007).cast("double"))
    )
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", variant.alias("variant"), value.alias("v"))
    return rows.select("o_orderkey", "variant", text.stringify(rows, "v").alias("Text"))


# Forms that can be read, and two that can not.
_READABLE = (
    "yyyyMMdd",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "M/d/yyyy",
    "yyyy-M-d",
    "dd-MMM-yyyy",
    "d MMM yyyy",
    "yyyy-MM-dd'T'HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "d MMMM yyyy",
    "dd-MMM-yy",
    "MMM d, yyyy",
    "MMMM dd yyyy HH:mm",
    "yyyy-MMM-dd",
    "yyyy.MM.dd",
    "MM.dd.yyyy",
    "M/d/yy",
)
# Month-first and day-first are told apart only by days past the 12th.
_DAY_FIRST = ("dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yyyy HH:mm", "d/M/yyyy", "dd.MM.yyyy", "d.M.yy HH:mm")
_FORMS = len(_READABLE) + len(_DAY_FIRST) + 2


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % {_FORMS} < {_FORMS - 2}
    THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "Parsed" FROM orders"""
)
def parse_dates(spark, sf_dir):
    form, day = F.col("o_orderkey") % _FORMS, F.col("o_orderdate")
    written = F.concat(F.date_format(day, "yyyyMM"), F.lit("99"))
    for i, pattern in enumerate(_READABLE):
        padded = F.concat(F.lit("\t "), F.date_format(day, pattern), F.lit(" "))
        written = F.when(form == i, padded).otherwise(written)
    for i, pattern in enumerate(_DAY_FIRST, len(_READABLE)):
        text_ = F.when(F.dayofmonth(day) > 12, F.date_format(day, pattern)).otherwise(
            F.date_format(day, "yyyy-MM-dd")
        )
        written = F.when(form == i, text_).otherwise(written)
    written = F.when(form == _FORMS - 2, F.lit("NaT")).otherwise(written)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", written.alias("v"))
    return rows.select("o_orderkey", parse.parse_date(F.col("v")).cast("string").alias("Parsed"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4
    THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS "Amount" FROM orders"""
)
def parse_amounts(spark, sf_dir):
    form, plain = F.col("o_orderkey") % 6, F.col("o_totalprice").cast("decimal(18,2)")
    written = (
        F.when(form == 0, plain.cast("string"))
        .when(form == 1, F.format_number(plain, 2))
        .when(form == 2, F.concat(F.lit(" \t"), plain.cast("string"), F.lit("  ")))
        .when(form == 3, F.concat(F.lit("+"), plain.cast("string")))
        .when(form == 4, F.lit("None"))
        .otherwise(F.concat(plain.cast("string"), F.lit(" GHS")))
    )
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", written.alias("v"))
    return rows.select("o_orderkey", parse.parse_amount(F.col("v")).cast("double").alias("Amount"))


@query(
    "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS \"Period\","
    " strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m') AS \"Previous\" FROM orders"
)
def previous_period(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("Period")
    months = _table(spark, sf_dir, "orders").select(month).distinct()
    return months.select("Period", parse.previous_period(F.col("Period")).alias("Previous"))


@query(
    """SELECT c_custkey, upper(c_name) AS "NatIDNum", upper(c_mktsegment) AS "TINum", '' AS "HomeTel"
    FROM customer"""
)
def normalize_fields(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit(" \t"), F.lower("c_name"), F.lit(" \n")).alias("NatIDNum"),
        F.initcap("c_mktsegment").alias("TINum"),
        F.lit(None).cast("string").alias("HomeTel"),
    )
    return text.normalize_fields(rows, "IND")



@query(
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, '') || '|'
    || c_mktsegment || '||' || CAST(c_nationkey AS VARCHAR) AS "Key" FROM customer"""
)
def concat_key(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").withColumn(
        "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name"))
    )
    names = ["c_name", "c_mktsegment", "c_absent", "c_nationkey"]
    return rows.select("c_custkey", text.concat_fields(rows, names).alias("Key"))


@query(f'WITH {fixture_sql()} SELECT "RowOrder", {IDENTITY} AS "IdentityKey" FROM cur')
def identity_key(spark, sf_dir):
    return fixture.current(spark, sf_dir).select("RowOrder", text.identity_key().alias("IdentityKey"))


_CONTENT = "concat_ws('|', " + ", ".join(f'"{f}"' for f in FIELDS) + ")"


@query(f'WITH {fixture_sql()} SELECT "RowOrder", sha256({_CONTENT}) AS "ContentHash" FROM cur')
def content_hash(spark, sf_dir):
    rows = fixture.current(spark, sf_dir)
    return rows.select("RowOrder", text.content_hash(rows, "IND").alias("ContentHash"))


_STRUCT = "{" + ", ".join(f"'{f}': \"{f}\"" for f in FIELDS) + "}"


@query(
    f"""WITH {fixture_sql()} SELECT "RowOrder", CAST(to_json({_STRUCT}) AS VARCHAR) AS "IdentityFields"
    FROM cur"""
)
def pack_fields(spark, sf_dir):
    rows = fixture.current(spark, sf_dir)
    return rows.select("RowOrder", F.to_json(pack(rows, "IND")).alias("IdentityFields"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k,
    json_extract_string(props, '$.absent') AS absent FROM events"""
)
def unpack_fields(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "props")
    return unpack(rows, ["k", "absent"], "props")


# -- file names and submissions --------------------------------------------------

_NAME = """CASE WHEN o_orderkey % 11 = 7 THEN strftime(o_orderdate, '%m%y') || '_IND.csv'
    ELSE 'Sub' || CAST(o_custkey % 10 AS VARCHAR) || CASE WHEN o_orderkey % 11 = 3 THEN '13'
    ELSE strftime(o_orderdate, '%m') END || strftime(o_orderdate, '%y') ||
    CASE WHEN o_custkey % 2 = 0 THEN '_ind' ELSE '_BUS' END ||
    CASE WHEN o_orderkey % 11 = 5 THEN 'IVIDUAL' ELSE '_' || CAST(o_orderkey AS VARCHAR) END ||
    CASE WHEN o_orderkey % 11 = 9 THEN '.xlsx' ELSE '.csv' END END"""
_VALID = "o_orderkey % 11 NOT IN (3, 5, 7)"
_NAMED = f"""SELECT o_orderkey, {_NAME} AS "FileName",
    CASE WHEN {_VALID} THEN 'SUB' || CAST(o_custkey % 10 AS VARCHAR) END AS "SubscriberCode",
    CASE WHEN {_VALID} THEN '20' || strftime(o_orderdate, '%y-%m') END AS "ReportingPeriod",
    CASE WHEN {_VALID} THEN CASE WHEN o_custkey % 2 = 0 THEN 'IND' ELSE 'BUS' END END AS "SubmissionType",
    CASE WHEN {_VALID} THEN o_orderkey END AS "SequenceNumber" FROM orders"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file name per order, some of them no submission."""
    kind = F.col("o_orderkey") % 11
    day = F.col("o_orderdate")
    name = F.concat(
        F.lit("Sub"),
        (F.col("o_custkey") % 10).cast("string"),
        F.when(kind == 3, "13").otherwise(F.date_format(day, "MM")),
        F.date_format(day, "yy"),
        F.when(F.col("o_custkey") % 2 == 0, "_ind").otherwise("_BUS"),
        F.when(kind == 5, "IVIDUAL").otherwise(
            F.concat(F.lit("_"), F.col("o_orderkey").cast("string"))
        ),
        F.when(kind == 9, ".xlsx").otherwise(".csv"),
    )
    short = F.concat(F.date_format(day, "MMyy"), F.lit("_IND.csv"))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(kind == 7, short).otherwise(name).alias("FileName")
    )


@query(_NAMED)
def parse_filename(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("s", parse.submission_of(F.col("FileName")))
    return rows.select("o_orderkey", "FileName", "s.*").withColumn(
        "SequenceNumber", F.col("SequenceNumber").cast("bigint")
    )


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    return describe_files(names.select(F.concat(F.lit("file:/in/"), "FileName").alias("path")))


_UNIT = ("SubscriberCode", "ReportingPeriod", "SubmissionType")
_USABLE = "o_orderkey % 11 NOT IN (3, 5, 7, 9)"


@query(
    f"""SELECT "FileName", "SubscriberCode", "ReportingPeriod", "SubmissionType", "SequenceNumber"
    FROM ({_NAMED} WHERE {_USABLE} AND o_orderkey % 3 <> 0) AS n""",
    name="pending_files",
)
def pending(spark, sf_dir):
    described = _described(spark, sf_dir)
    loaded = described.filter("SequenceNumber % 3 = 0")
    rows = pending_files(described, loaded)
    return rows.select("FileName", *_UNIT, F.col("SequenceNumber").cast("bigint").alias("SequenceNumber"))


@query(
    f"""SELECT "FileName", "SubscriberCode", "ReportingPeriod", "SubmissionType", "SequenceNumber"
    FROM ({_NAMED} WHERE {_USABLE}) AS n
    ORDER BY "ReportingPeriod", "SubscriberCode", "SubmissionType", "SequenceNumber\""""
)
def file_order(spark, sf_dir):
    rows = chronological(_described(spark, sf_dir).filter("Problem IS NULL"))
    return rows.select("FileName", *_UNIT, F.col("SequenceNumber").cast("bigint").alias("SequenceNumber"))


@query(
    f"SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS periods FROM orders WHERE {_USABLE}",
    name="period_count",
)
def period_counts(spark, sf_dir):
    return period_count(_described(spark, sf_dir))


_ID = "CAST(('0x' || substr(sha256({}), 1, 15)) AS BIGINT)"


@query(
    f"""SELECT {_ID.format("code")} AS "SubscriberID", code AS "SubscriberCode"
    FROM (SELECT DISTINCT 'SUB' || CAST(o_custkey AS VARCHAR) AS code FROM orders
    WHERE o_custkey % 4 <> 0) AS c"""
)
def upsert_subscribers(spark, sf_dir):
    code = F.concat(F.lit("SUB"), F.col("o_custkey").cast("string")).alias("SubscriberCode")
    orders = _table(spark, sf_dir, "orders")
    known = orders.filter("o_custkey % 4 = 0").select(code).distinct()
    return new_subscribers(orders.select(code), known).select("SubscriberID", "SubscriberCode")


def _registered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All usable files with an order's price as row count, and those loaded before."""
    usable = _described(spark, sf_dir).filter("Problem IS NULL")
    prices = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("SequenceNumber"),
        F.floor("o_totalprice").alias("RecordCount"),
    )
    listed = usable.join(prices, "SequenceNumber")
    return listed, usable.filter("SequenceNumber % 3 = 0")


@query(
    f"""SELECT {_ID.format("concat_ws('|', \"SubscriberCode\", \"ReportingPeriod\", \"SubmissionType\", \"SequenceNumber\")")}
    AS "SubmissionID", "ReportingPeriod", "SubmissionType", "SequenceNumber", "FileName",
    CAST(floor(o_totalprice) AS BIGINT) AS "RecordCount"
    FROM ({_NAMED} WHERE {_USABLE} AND o_orderkey % 3 <> 0) AS n JOIN orders USING (o_orderkey)"""
)
def register_submission(spark, sf_dir):
    listed, loaded = _registered(spark, sf_dir)
    return new_submissions(listed, loaded).select(
        "SubmissionID",
        "ReportingPeriod",
        "SubmissionType",
        F.col("SequenceNumber").cast("bigint").alias("SequenceNumber"),
        "FileName",
        "RecordCount",
    )


@query(
    f"""SELECT n."ReportingPeriod", n."SubmissionType", n."SequenceNumber", n."FileName",
    CAST(floor(o.o_totalprice) AS BIGINT) AS "RecordCount", TRUE AS "Uploaded"
    FROM ({_NAMED} WHERE {_USABLE}) AS n JOIN orders AS o USING (o_orderkey)
    WHERE "SubscriberCode" = 'SUB3' AND "SubmissionType" = 'BUS'
    ORDER BY "ReportingPeriod" DESC, "SequenceNumber" DESC LIMIT 24""",
    name="submission_history",
)
def submissions_history(spark, sf_dir):
    listed, _ = _registered(spark, sf_dir)
    registry = Registry(spark, shared_folder(spark) + "/registry").create()
    stamp = {"BatchID": F.lit("b"), "UploadedAt": F.current_timestamp()}
    known = new_subscribers(listed, registry.committed("subscribers"))
    registry.append("subscribers", known.withColumns(stamp))
    registry.append("submissions", new_submissions(listed, registry.loaded()).withColumns(stamp))
    registry.commit("b")
    rows = registry.history("SUB3", "BUS")
    return rows.withColumn("Uploaded", F.col("UploadedAt").isNotNull()).drop("UploadedAt")


@query(
    """SELECT 'M' || CAST(o_custkey AS VARCHAR) AS "CustomerID", strftime(o_orderdate, '%Y') AS "ReportingPeriod",
    arg_max(CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR, (o_orderdate, rank, o_orderkey)) AS "NatIDNum",
    arg_max(category, (o_orderdate, rank, o_orderkey)) AS "MatchCategory",
    arg_min(CAST(o_orderkey AS VARCHAR), (o_orderdate, rank, o_orderkey)) AS "SourceRawRecordID"
    FROM (SELECT *, o_orderkey % 3 + 1 AS rank, CASE o_orderkey % 3 WHEN 0 THEN 'Exact'
    WHEN 1 THEN 'Rearranged' ELSE 'Enriched' END AS category FROM orders) AS o GROUP BY 1, 2""",
    name="merge_clean",
)
def merge_clean_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(
        F.lit("S").alias("SubscriberCode"),
        F.lit("IND").alias("SubmissionType"),
        F.lit("F").alias("FacilityAccNum"),
        F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("CustomerID"),
        F.date_format("o_orderdate", "yyyy").alias("ReportingPeriod"),
        F.create_map(
            F.lit("NatIDNum"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
        ).alias("IdentityFields"),
        F.when(key % 3 == 0, "Exact").when(key % 3 == 1, "Rearranged").otherwise("Enriched").alias(
            "MatchCategory"
        ),
        F.concat(F.lit("C"), key.cast("string")).alias("CleanRecordID"),
        key.cast("string").alias("SourceRawRecordID"),
        F.lit("Clean").alias("Status"),
        F.col("o_orderdate").alias("CreatedAt"),
        key.alias("RowIndex"),
    )
    merged = merge_clean(rows, [F.col("CreatedAt"), category_rank(), F.col("RowIndex")])
    return unpack(merged, ["NatIDNum"]).select(
        "CustomerID", "ReportingPeriod", "NatIDNum", "MatchCategory", "SourceRawRecordID"
    )


# -- files and registry ----------------------------------------------------------

_PLAIN = f"""SELECT "FacilityAccNum" AS "Credit FacilityAccNum", "CustomerID", "DisbursementDate",
    "CurBal", {_list(FIELDS)}, 'say "' || "FacilityAccNum" || '", twice' AS "Remark" """


@query(f"WITH {fixture_sql()} {_PLAIN} FROM prior")
def csv_scan(spark, sf_dir):
    root = files.submission_files(spark, sf_dir)
    rows = load_file(spark, f"{root}/2026/CP0526_IND", "IND")
    return rows.drop("PartName", "BlockStart", "RowIndex", "CreditFacilityType")


@query(
    f"""WITH {fixture_sql()}, plain AS ({_PLAIN} FROM prior) SELECT * REPLACE (CASE WHEN "CustomerID" LIKE '%3'
    THEN 'a' || chr(10) || '"b",' || chr(10) || chr(10) || 'c' ELSE "Remark" END AS "Remark") FROM plain"""
)
def csv_scan_split(spark, sf_dir):
    """A file with line breaks in its cells, read in blocks of 64 KB."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    rows = load_file(session, files.broken_lines(spark, sf_dir), "IND", multi_line="split")
    return rows.drop("PartName", "BlockStart", "RowIndex", "CreditFacilityType")


_SUPPLIER_FILE = """SELECT s_suppkey, 'S' || s_suppkey || lpad(CAST(1 + s_suppkey % 13 AS VARCHAR), 2, '0') || '26' ||
    CASE WHEN s_suppkey % 2 = 0 THEN '_IND' ELSE '_bus' END ||
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '_' || (s_suppkey % 7 + 1) END || '.csv' AS "FileName",
    s_suppkey % 13 < 12 AS "Usable" FROM supplier"""


@query(
    f"""SELECT "FileName", CASE s_suppkey % 5 WHEN 0 THEN 'CurBal' WHEN 1 THEN 'CustomerID, TINum' ELSE '' END
    AS "Missing" FROM ({_SUPPLIER_FILE}) AS f WHERE "Usable\""""
)
def validate_columns(spark, sf_dir):
    """What the header of every supplier's file lacks."""
    root = files.supplier_files(spark, sf_dir)
    found = discover_files(spark, root).filter("Problem IS NULL")
    lines = found.join(read_headers(spark, root), "uri", "left").withColumn("kind", F.col("SubmissionType"))
    # The files are opened once: headers are asked for twice.
    kept = f"{shared_folder(spark)}/headers"
    lines.select("FileName", "kind", "header").write.parquet(kept)
    checked = checked_headers(spark, spark.read.parquet(kept))
    return checked.select("FileName", F.array_join("missing", ", ").alias("Missing"))


@query(
    f"""SELECT "FileName", CASE WHEN "Usable" THEN 'S' || s_suppkey END AS "SubscriberCode",
    CASE WHEN "Usable" THEN '2026-' || lpad(CAST(1 + s_suppkey % 13 AS VARCHAR), 2, '0') END AS "ReportingPeriod",
    CASE WHEN "Usable" THEN CASE WHEN s_suppkey % 2 = 0 THEN 'IND' ELSE 'BUS' END END AS "SubmissionType",
    CAST(CASE WHEN "Usable" THEN CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_suppkey % 7 + 1 END END AS BIGINT)
    AS "SequenceNumber", "Usable" FROM ({_SUPPLIER_FILE}) AS f""",
    name="discover_files",
)
def discovered_files(spark, sf_dir):
    """Every supplier's file, found below a folder."""
    found = discover_files(spark, files.supplier_files(spark, sf_dir))
    return found.select(
        "FileName",
        *_UNIT,
        F.col("SequenceNumber").cast("bigint").alias("SequenceNumber"),
        F.col("Problem").isNull().alias("Usable"),
    )


HISTORY = history()


@query(f"""{HISTORY} SELECT "IdentityKey", CAST("CurrentDate" AS VARCHAR) AS "DisbursementDate",
    {_list(FIELDS)} FROM june WHERE rn = 1""")
def prior_raw(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    rows = registry.prior_raw("IND", parse.previous_period(F.lit("2026-07")), _subscriber(spark))
    return rows.select("IdentityKey", _day("DisbursementDate"), *hash_fields("IND"))


@query(f"""{HISTORY} SELECT {IDENTITY} AS "IdentityKey", {_list(FIELDS)} FROM june_clean""")
def prior_clean(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    rows = registry.prior_clean("IND", parse.previous_period(F.lit("2026-07")), _subscriber(spark))
    return rows.select("IdentityKey", *hash_fields("IND"))


@query(
    f"""{HISTORY} SELECT DISTINCT {KEYS} FROM (SELECT {KEYS} FROM june_open
    UNION ALL SELECT {KEYS} FROM july WHERE "Route" = 'unl_output') AS u"""
)
def open_unl(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    keys = ("SubscriberCode", "SubmissionType", "FacilityAccNum", "CustomerID")
    return registry.open_unl("IND", _subscriber(spark)).select(*keys).distinct()


@query(
    f"""{HISTORY} SELECT '2026-06' AS "ReportingPeriod", "IdentityKey", CAST("CurBal" AS DOUBLE) AS "CurBal",
    CAST("CurrentDate" AS VARCHAR) AS "DisbursementDate", sha256({_CONTENT}) AS "ContentHash",
    {_list(FIELDS)}, rn > 1 AS "IsDuplicate", "MatchFlag", 'say "' || "FacilityAccNum" || '", twice' AS "Remark"
    FROM june"""
)
def raw_rows(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    rows = registry.raw_with_payload().filter("ReportingPeriod = '2026-06'")
    return unpack(rows, hash_fields("IND")).select(
        "ReportingPeriod",
        "IdentityKey",
        F.col("CurBal").cast("double").alias("CurBal"),
        _day("DisbursementDate"),
        "ContentHash",
        *hash_fields("IND"),
        "IsDuplicate",
        "MatchFlag",
        F.get_json_object("RawPayload", "$.Remark").alias("Remark"),
    )


@query(
    f"""WITH {fixture_sql()} SELECT count(*) + (SELECT 2 * count(*) FROM prior)
    + (SELECT count(*) FROM cur) AS "Rows", count(*) + (SELECT 2 * count(*) FROM prior)
    + (SELECT count(*) FROM cur) AS "Ids" FROM cur"""
)
def row_ids(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    return registry.committed("raw").agg(
        F.count(F.lit(1)).alias("Rows"), F.count_distinct("RawRecordID").alias("Ids")
    )


def _months(columns: str, where: str) -> str:
    months = (("may", "2026-05"), ("june", "2026-06"), ("july", "2026-07"))
    return " UNION ALL ".join(
        f"SELECT '{p}' AS \"ReportingPeriod\", {columns} FROM {m} WHERE {where}" for m, p in months
    )


@query(
    f"""{HISTORY} {_months('"IdentityKey", "ExceptionCategory", "FieldDifferences" AS "Details"',
    '"Route" = ' + "'unl_output'")}"""
)
def unl_rows(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    rows = registry.committed("unl").filter("SubmissionType = 'IND'")
    return rows.select("ReportingPeriod", "IdentityKey", "ExceptionCategory", "Details")


@query(
    f"""{HISTORY} {_months('"IdentityKey", CAST("PreviousDate" AS VARCHAR) AS "PreviousDate",'
    ' CAST("CurrentDate" AS VARCHAR) AS "CurrentDate", "CreditFacilityType"', '"DateChanged"')}"""
)
def date_log_rows(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    return registry.committed("date_log").select(
        "ReportingPeriod", "IdentityKey", _day("PreviousDate"), _day("CurrentDate"), "CreditFacilityType"
    )


@query(
    f"""WITH {fixture_sql("customer", "CP")} SELECT {IDENTITY} AS "IdentityKey", '2026-05' AS "ReportingPeriod",
    'Seed' AS "MatchCategory", {_list(FIELDS)} FROM clean"""
)
def seed_clean(spark, sf_dir):
    rows = unpack(files.seeded_registry(spark, sf_dir).clean(), hash_fields("IND"))
    return rows.select("IdentityKey", "ReportingPeriod", "MatchCategory", *hash_fields("IND"))


_CLEAN_STATES = f"""{HISTORY}
    SELECT '2026-05' AS "ReportingPeriod", {IDENTITY} AS "IdentityKey", 'Seed' AS "MatchCategory", {_list(FIELDS)}
    FROM clean UNION ALL
    SELECT '2026-06', {IDENTITY}, CASE "MatchFlag" WHEN 'Exact match' THEN 'Exact' ELSE "MatchFlag" END, {_list(FIELDS)}
    FROM june_clean UNION ALL
    SELECT '2026-07', {IDENTITY}, CASE "MatchFlag" WHEN 'Exact match' THEN 'Exact' ELSE "MatchFlag" END, {_list(FIELDS)}
    FROM july_clean"""


def _clean_states(registry) -> DataFrame:
    rows = unpack(registry.clean(), hash_fields("IND"))
    return rows.select("ReportingPeriod", "IdentityKey", "MatchCategory", *hash_fields("IND"))


@query(_CLEAN_STATES)
def backfill(spark, sf_dir):
    return _clean_states(files.backfilled(spark, sf_dir)[0])


@query(_CLEAN_STATES)
def backfill_one_pass(spark, sf_dir):
    """The clean states from all months together, out of the submitted rows and the seed."""
    rows = replay(files.backfilled(spark, sf_dir)[0], "IND").clean.withColumn("IdentityKey", text.identity_key())
    return rows.select("ReportingPeriod", "IdentityKey", "MatchCategory", *hash_fields("IND"))


@query(_CLEAN_STATES)
def stream_ingest(spark, sf_dir):
    return _clean_states(files.streamed(spark, sf_dir))


@query(f"{HISTORY} {summary('june')}")
def process_batch(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    june = registry.committed("raw").filter("ReportingPeriod = '2026-06'")
    return run_summary(june)


@query(
    f"""WITH {fixture_sql()} SELECT CAST(5 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS already_loaded,
    CAST(2 AS BIGINT) AS failed, (SELECT 2 * count(*) FROM prior) + (SELECT 2 * count(*) FROM cur)
    AS total_input_records""",
    name="batch_stats",
)
def backfill_stats(spark, sf_dir):
    return batch_stats(files.backfilled(spark, sf_dir)[1].frame(spark))


@query(
    """SELECT CAST(0 AS BIGINT) AS processed, CAST(5 AS BIGINT) AS already_loaded,
    CAST(2 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS total_input_records"""
)
def backfill_again(spark, sf_dir):
    registry, _ = files.backfilled(spark, sf_dir)
    return batch_stats(run_backfill(registry, files.submission_files(spark, sf_dir)).frame(spark))


def _report_counts(titles: dict[str, str]) -> str:
    parts = [
        f"SELECT '{title}' AS \"Output\", count(*) AS \"Rows\" FROM tag WHERE "
        + ('"DateChanged"' if name == "date_change_log" else f"\"Route\" = '{name}'")
        for name, title in titles.items()
    ]
    return f"{TAG} " + " UNION ALL ".join(parts)


def _count_reports(spark: SparkSession, root: str, titles) -> DataFrame:
    counts = [
        spark.read.option("header", True)
        .option("escape", '"')
        .csv(f"{root}/{title}")
        .agg(F.lit(title).alias("Output"), F.count(F.lit(1)).alias("Rows"))
        .select("Output", "Rows")
        for title in titles
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


@query(_report_counts({name: name for name in OUTPUT_TITLES}))
def report_outputs(spark, sf_dir):
    root = shared_folder(spark)
    _tagged(spark, sf_dir).write.parquet(f"{root}/tagged")
    write_outputs(spark.read.parquet(f"{root}/tagged"), f"{root}/reports")
    return _count_reports(spark, f"{root}/reports", OUTPUT_TITLES)


@query(_report_counts(OUTPUT_TITLES) + " UNION ALL SELECT 'Summary', CAST(14 AS BIGINT)")
def report_bundle(spark, sf_dir):
    root = shared_folder(spark)
    _tagged(spark, sf_dir).write.parquet(f"{root}/tagged")
    write_bundle(spark.read.parquet(f"{root}/tagged"), f"{root}/bundle")
    return _count_reports(spark, f"{root}/bundle", [*OUTPUT_TITLES.values(), "Summary"])


@query(
    HISTORY
    + """ SELECT "FacilityAccNum" AS "Facility", "DisbursementDate" AS "Date", "CurBal", "NatIDNum",
    'say "' || "FacilityAccNum" || '", twice' AS "Remark", "MatchFlag", "ExceptionCategory"
    FROM july WHERE "Route" = 'unl_output'"""
)
def report_cells(spark, sf_dir):
    """The cells of an exported output of a registry batch, columns that ride along included."""
    registry, _ = files.backfilled(spark, sf_dir)
    july = registry.committed("raw").filter("ReportingPeriod = '2026-07'").select("BatchID").first()
    root = f"{shared_folder(spark)}/reports"
    write_outputs(tagged_batch(registry, july["BatchID"], "IND"), root)
    rows = spark.read.options(header=True, escape='"').csv(f"{root}/unl_output")
    return rows.select(
        F.col("Credit FacilityAccNum").alias("Facility"),
        F.col("DisbursementDate").alias("Date"),
        "CurBal",
        "NatIDNum",
        "Remark",
        F.col("Match Flag").alias("MatchFlag"),
        F.col("Exception Category").alias("ExceptionCategory"),
    )


_BUS_CHANGED = "o_orderkey % 4"


@query(
    f"""SELECT o_orderkey AS "RowOrder", CASE {_BUS_CHANGED} WHEN 0 THEN 'Exact match' WHEN 1 THEN 'Rearranged'
    WHEN 2 THEN 'Enriched' ELSE 'Different' END AS "MatchFlag",
    CASE {_BUS_CHANGED} WHEN 3 THEN 'OfficeFaxNum' ELSE '' END AS "RemovedFields",
    CASE {_BUS_CHANGED} WHEN 0 THEN 'cleaned_output' WHEN 1 THEN 'rearranged_output' WHEN 2 THEN 'enriched_output'
    ELSE 'unl_output' END AS "Route" FROM orders"""
)
def reconcile_business(spark, sf_dir):
    key = F.col("o_orderkey")
    text_key, changed = key.cast("string"), F.col("RowOrder") % 4
    prior = _table(spark, sf_dir, "orders").select(
        F.lit("S").alias("SubscriberCode"),
        F.lit("BUS").alias("SubmissionType"),
        F.concat(F.lit("F"), text_key).alias("FacilityAccNum"),
        F.lit("C").alias("CustomerID"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("DisbursementDate"),
        F.col("o_totalprice").cast("string").alias("CurBal"),
        F.concat(F.lit("B"), text_key).alias("BusRegNum"),
        F.lit("").alias("PrevRegNum"),
        F.concat(F.lit("T"), text_key).alias("TINum"),
        F.lit("1").alias("OfficeTel1"),
        F.lit("").alias("OfficeTel2"),
        F.lit("9").alias("OfficeFaxNum"),
        key.alias("RowOrder"),
    )
    current = prior.withColumns(
        {
            "BusRegNum": F.when(changed == 1, F.col("TINum")).otherwise(F.col("BusRegNum")),
            "TINum": F.when(changed == 1, F.col("BusRegNum")).otherwise(F.col("TINum")),
            "OfficeTel2": F.when(changed == 2, "2").otherwise(""),
            "OfficeFaxNum": F.when(changed == 3, "").otherwise(F.col("OfficeFaxNum")),
        }
    )
    tagged = reconcile(current, prior, prior, "BUS")
    return tagged.select("RowOrder", "MatchFlag", "RemovedFields", "Route")
