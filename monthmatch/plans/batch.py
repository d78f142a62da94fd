"""Load the files of one period into the registry and reconcile them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmatch.fixed_values import (
    CUSTOMER,
    DATE,
    FACILITY,
    FILE_FACILITY,
    FILE_PLACE,
    SUBMISSION_TYPES,
    hash_fields,
)
from monthmatch.functions.fields import unpack
from monthmatch.functions.parse import parse_amount, previous_period
from monthmatch.operators.outputs import TAGS, outputs
from monthmatch.operators.summary import run_summary
from monthmatch.plans.reconcile import reconcile
from monthmatch.sources.registry import (
    FILE_ORDER,
    Registry,
    clean_rows,
    date_log_rows,
    new_batch_id,
    new_submissions,
    new_subscribers,
    unl_rows,
    write_order,
)
from monthmatch.sources.submissions import (
    UNIT_KEY,
    MultiLine,
    checked_headers,
    describe_files,
    header_names,
    headers_frame,
    list_files,
    load_rows,
    pending_files,
    read_headers,
    submission_id,
)

PROCESSED, ALREADY_LOADED, FAILED = "processed", "already_loaded", "failed"
STATUS_COLUMNS = (
    "FileName STRING, ReportingPeriod STRING, Status STRING, RecordCount BIGINT, Message STRING"
)


@dataclass
class FileStatus:
    FileName: str
    ReportingPeriod: str | None
    Status: str
    RecordCount: int = 0
    Message: str | None = None


@dataclass
class BatchResult:
    """What one batch did. The frames read the registry, not the source files."""

    registry: Registry
    batch_id: str
    files: list[FileStatus] = field(default_factory=list)

    def tagged(self, submission_type: str) -> DataFrame:
        return tagged_batch(self.registry, self.batch_id, submission_type)

    def outputs(self, submission_type: str) -> dict[str, DataFrame]:
        return outputs(self.tagged(submission_type))

    def summary(self, submission_type: str | None = None) -> DataFrame:
        return run_summary(self.registry.batch("raw", self.batch_id, submission_type))


def status_frame(spark: SparkSession, files: list[FileStatus]) -> DataFrame:
    return spark.createDataFrame([vars(f) for f in files], STATUS_COLUMNS)


def tagged_batch(registry: Registry, batch_id: str, submission_type: str) -> DataFrame:
    """Tagged rows of a batch as :func:`reconcile` returns them, with every submitted column.

    Columns come in the order and under the names of the files, with the text
    that was submitted; only the keys are stripped and the identity and contact
    fields normalised. Names that differ only in case get a numbered suffix.
    """
    fields = hash_fields(submission_type)
    submitted = registry.batch("submitted", batch_id, submission_type).select(
        "RawRecordID", F.from_json("RawPayload", "map<string,string>").alias("_payload")
    )
    rows = registry.batch("raw", batch_id, submission_type).join(submitted, "RawRecordID")
    kept = {FACILITY: F.col(FACILITY), CUSTOMER: F.col(CUSTOMER), DATE: F.col("DateText")}
    kept |= {f: F.col("IdentityFields")[f] for f in fields}
    columns, taken = [], {t.lower() for t in TAGS} | {c.lower() for c in kept}
    for name in _submitted_names(submitted):
        known = FACILITY if name == FILE_FACILITY else name
        if known in kept:
            columns.append(kept.pop(known).alias(known))
            continue
        alias, n = name, 0
        while alias.lower() in taken:
            n += 1
            alias = f"{name}.{n}"
        taken.add(alias.lower())
        columns.append(F.col("_payload")[name].alias(alias))
    values = ", ".join(f"PublishedFields['{f}'] AS `{f}`" for f in fields)
    published = F.expr(f"IF(PublishedFields IS NULL, NULL, struct({values}))").alias("Published")
    tags = [F.col(t) for t in sorted(TAGS - {"Published", FILE_PLACE})]
    place = F.struct(*FILE_ORDER).alias(FILE_PLACE)
    return rows.select(*columns, "IdentityKey", *tags, published, place)


def _submitted_names(submitted: DataFrame) -> list[str]:
    """All column names of the files, in the order of their places in a header."""
    names = (
        submitted.select(F.map_keys("_payload").alias("names"))
        .distinct()
        .select(F.posexplode("names").alias("at", "name"))
        .groupBy("name")
        .agg(F.min("at").alias("at"))
    )
    return [r["name"] for r in names.orderBy("at", "name").collect()]


def process_batch(
    registry: Registry, files: DataFrame, *, multi_line: MultiLine = True
) -> BatchResult:
    """Load all pending files of one period together and reconcile them.

    ``files`` come from :func:`describe_files`. A file that is already loaded
    is skipped, one that cannot be read fails alone, and the rest is committed
    as a whole. Whatever stops the batch before that leaves nothing behind
    that a reader would see.
    """
    spark = registry.spark
    result = BatchResult(registry, new_batch_id())
    chosen = pending_files(files, registry.loaded()).withColumn("_chosen", F.lit(True))
    listed = files.join(chosen.select("path", "_chosen"), "path", "left").collect()
    pending = _sort_out(listed, result)
    periods = {f["ReportingPeriod"] for f in pending}
    if len(periods) > 1:
        raise ValueError(f"one period at a time, not {sorted(periods)}")
    pending = _land(registry, pending, result, multi_line)
    if pending:
        (period,) = periods
        for submission_type in SUBMISSION_TYPES:
            units = [f for f in pending if f["SubmissionType"] == submission_type]
            if units:
                _reconcile_type(registry, result.batch_id, submission_type, period, units)
                registry.snapshot_open_keys(result.batch_id, submission_type)
        _register(registry, result.batch_id, pending)
        registry.commit(result.batch_id, _units_frame(spark, pending))
    result.files += [
        FileStatus(f["FileName"], f["ReportingPeriod"], PROCESSED, f["RecordCount"]) for f in pending
    ]
    return result


def _sort_out(listed, result: BatchResult) -> list[dict]:
    """Units still to load, one per submission; reports the other files."""
    units: dict[str, dict] = {}
    for row in listed:
        if row["Problem"] is not None:
            status = FileStatus(row["FileName"], row["ReportingPeriod"], FAILED, 0, row["Problem"])
            result.files.append(status)
        elif row["_chosen"] is None:
            result.files.append(FileStatus(row["FileName"], row["ReportingPeriod"], ALREADY_LOADED))
        else:
            unit = units.setdefault(row["Location"], {**row.asDict(), "paths": {}})
            unit["paths"][row["path"]] = row["uri"]
    return list(units.values())


def _within(submission_type: str, period: str, batch_id: str) -> dict[str, str]:
    """The partition of a batch's rows of one type."""
    return {"SubmissionType": submission_type, "ReportingPeriod": period, "BatchID": batch_id}


def _land(
    registry: Registry, pending: list[dict], result: BatchResult, multi_line: MultiLine
) -> list[dict]:
    """Write the rows of all readable units; returns those units with their row counts."""
    if not pending:
        return []
    spark = registry.spark
    by_path = {path: unit for unit in pending for path in unit["paths"]}
    files = spark.createDataFrame(
        [(path, unit["paths"][path], unit["SubmissionType"]) for path, unit in by_path.items()],
        "path STRING, uri STRING, kind STRING",
    )
    # The first line of each file, read once; distinct ones and unusable files
    # are all that comes to the driver.
    lines = files.join(read_headers(spark, list(by_path)), "uri", "left").persist()
    try:
        checked = checked_headers(spark, lines)
        bad = {r["path"]: r["message"] for r in checked.filter("message IS NOT NULL").select("path", "message").collect()}
        usable = checked.filter("message IS NULL").select("kind", "header").distinct()
        headers = [tuple(r) for r in usable.collect()]
        frames = {}
        for kind in SUBMISSION_TYPES:
            widths = [len(header_names(h)) for k, h in headers if k == kind]
            paths = [p for p, u in by_path.items() if u["SubmissionType"] == kind and p not in bad]
            if paths:
                frames[kind] = load_rows(
                    spark,
                    kind,
                    lines.filter(F.col("kind") == kind).select("uri", "header"),
                    headers_frame(spark, headers),
                    paths,
                    max(widths),
                    result.batch_id,
                    multi_line,
                )
        for kind, rows in frames.items():
            registry.append("submitted", rows, _within(kind, pending[0]["ReportingPeriod"], result.batch_id))
    finally:
        lines.unpersist()
    broken = {by_path[path]["Location"]: message for path, message in bad.items()}
    counts = {
        tuple(r[c] for c in UNIT_KEY): r
        for r in registry.batch("submitted", result.batch_id)
        .groupBy(*UNIT_KEY)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("Malformed").alias("malformed"))
        .collect()
    }
    good = []
    for unit in pending:
        row = counts.get(tuple(unit[c] for c in UNIT_KEY))
        if row is not None and row["malformed"]:
            message = f"{row['malformed']} row(s) have more cells than the header"
            broken.setdefault(unit["Location"], message)
        if unit["Location"] in broken:
            message = broken[unit["Location"]]
            result.files.append(
                FileStatus(unit["FileName"], unit["ReportingPeriod"], FAILED, 0, message)
            )
        else:
            good.append({**unit, "RecordCount": row["rows"] if row else 0})
    return good


def _units_frame(spark: SparkSession, units: list[dict]) -> DataFrame:
    columns = ("FileName", *UNIT_KEY, "RecordCount")
    kinds = "FileName STRING, SubscriberCode STRING, ReportingPeriod STRING,"
    kinds += " SubmissionType STRING, SequenceNumber BIGINT, RecordCount BIGINT"
    return spark.createDataFrame([tuple(u[c] for c in columns) for u in units], kinds)


def _reconcile_type(
    registry: Registry, batch_id: str, submission_type: str, period: str, units: list[dict]
) -> None:
    spark = registry.spark
    fields = hash_fields(submission_type)
    good = _units_frame(spark, units).select(submission_id(*map(F.col, UNIT_KEY)).alias("SubmissionID"))
    current = unpack(
        registry.batch("submitted", batch_id, submission_type)
        .join(F.broadcast(good), "SubmissionID", "left_semi")
        .drop("RawPayload", "Malformed", "IdentityKey"),
        fields,
    )
    scope = _units_frame(spark, units)
    before = previous_period(F.lit(period))
    tagged = reconcile(
        current,
        registry.prior_raw(submission_type, before, scope),
        registry.prior_clean(submission_type, before, scope),
        submission_type,
        registry.open_unl(submission_type, scope),
        order=FILE_ORDER,
        record_id="RawRecordID",
        clean_order=[c.desc() for c in write_order()],
        normalize=False,
    )
    within = _within(submission_type, period, batch_id)
    registry.append("raw", raw_rows(tagged, submission_type), within)
    raw = registry.batch("raw", batch_id, submission_type).withColumn(
        "CreatedAt", F.current_timestamp()
    )
    derived = {"clean": clean_rows(raw), "unl": unl_rows(raw), "date_log": date_log_rows(raw)}
    # Three independent scans of what was just written.
    with ThreadPoolExecutor(len(derived)) as pool:
        list(pool.map(lambda name: registry.append(name, derived[name], within), derived))


def _packed(fields, value) -> Column:
    pairs: list[Column] = []
    for f in fields:
        pairs += [F.lit(f), value(f)]
    return F.create_map(*pairs)


def raw_rows(tagged: DataFrame, submission_type: str) -> DataFrame:
    """Tagged rows in the columns of the ``raw`` dataset."""
    fields = hash_fields(submission_type)
    published = _packed(fields, lambda f: F.col("Published")[f])
    return tagged.withColumns(
        {
            "IdentityFields": _packed(fields, lambda f: F.col(f)),
            "PublishedFields": F.when(F.col("Published").isNotNull(), published),
            "DateText": F.col("DisbursementDate"),
            "DisbursementDate": F.col("CurrentDate"),
            "CurBal": parse_amount(F.col("CurBal")),
            "CreatedAt": F.current_timestamp(),
        }
    )


def _register(registry: Registry, batch_id: str, units: list[dict]) -> None:
    """Subscriber and submission rows, the last ones before the commit marker."""
    files = _units_frame(registry.spark, units)
    stamp = {"BatchID": F.lit(batch_id), "UploadedAt": F.current_timestamp()}
    subscribers = new_subscribers(files, registry.committed("subscribers"))
    registry.append("subscribers", subscribers.withColumns(stamp))
    registry.append("submissions", new_submissions(files, registry.loaded()).withColumns(stamp))


def process_paths(registry: Registry, paths: list[str], *, multi_line: MultiLine = True) -> BatchResult:
    """:func:`process_batch` for files given by path."""
    files = describe_files(list_files(registry.spark, paths))
    return process_batch(registry, files, multi_line=multi_line)
