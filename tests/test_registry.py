"""Files in, registry out: quirks, failures, restarts."""

import csv
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from monthmatch.fixed_values import required_columns
from monthmatch.plans import batch as batch_module
from monthmatch.plans.backfill import batch_stats, run_backfill
from monthmatch.plans.batch import ALREADY_LOADED, FAILED, PROCESSED, process_paths
from monthmatch.sources import registry as registry_module
from monthmatch.sources.registry import Registry, seed_clean
from monthmatch.sources.reports import preview, write_bundle, write_outputs
from monthmatch.sources.submissions import (
    chronological,
    describe_files,
    discover_files,
    header_names,
    header_problem,
    headers_frame,
    load_file,
    load_rows,
    pending_files,
)
from monthmatch.streaming.ingest import start_ingest


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-"))


@pytest.fixture
def registry(spark, folder):
    return Registry(spark, str(folder / "registry")).create()


def write(path: Path, rows, kind="IND", header=None, columns=()):
    """A submission file; each row is a dict of the columns it fills."""
    path.parent.mkdir(parents=True, exist_ok=True)
    names = list(header or [*required_columns(kind), *columns])
    with path.open("w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(names)
        for row in rows:
            writer.writerow([row.get(n.strip(), "") for n in names])
    return str(path)


def row(number, date="20260101", balance="1", **fields):
    return {
        "Credit FacilityAccNum": f"F{number}",
        "CustomerID": f"C{number}",
        "DisbursementDate": date,
        "CurBal": balance,
        **fields,
    }


def statuses(result):
    return {f.FileName: (f.Status, f.RecordCount) for f in result.files}


def flags(registry, period):
    rows = registry.committed("raw").filter(F.col("ReportingPeriod") == period).collect()
    return {(r["FacilityAccNum"], r["RowIndex"]): r["Route"] for r in rows}


# -- reading files ----------------------------------------------------------------


def test_csv_quirks(spark, folder):
    path = folder / "CP0626_IND.csv"
    names = [*required_columns("IND"), "Remark"]
    cells = ["007", " C1 ", "20260101", *[""] * 13, "1"]
    with path.open("w", newline="") as f:
        f.write(",".join(names) + "\r\n")
        f.write(",".join(cells) + ',"say ""hi"", twice"\r\n')
        f.write("\r\n")
        f.write(",".join(cells) + ',"two\nlines"\r\n')
        f.write("F3,NA,20260101\r\n")
        f.write("," * (len(names) - 1) + "\r\n")
    rows = load_file(spark, str(path), "IND").orderBy("RowIndex").collect()
    assert [r["Remark"] for r in rows] == ['say "hi", twice', "two\nlines", "", ""]
    assert [r["Credit FacilityAccNum"] for r in rows] == ["007", "007", "F3", ""]
    assert [r["CustomerID"] for r in rows] == ["C1", "C1", "NA", ""]
    assert rows[2]["CurBal"] == ""


def test_header_names():
    assert header_names('﻿ a ,"b,c",a,a') == ("a", "b,c", "a.1", "a.2")


def test_header_problem():
    needed = required_columns("BUS")
    assert header_problem([*needed, "more"], "BUS") is None
    told = header_problem(["A", *(c for c in reversed(needed) if c not in ("TINum", "CurBal"))], "BUS")
    assert told.startswith("header without TINum, CurBal (")


def test_discovery_and_order(spark, folder):
    for name in ("b/ZZ0126_IND.csv", "AA0226_BUS_2.csv", "AA0226_BUS.csv", "c/d/AA1225_IND.csv"):
        write(folder / name, [])
    write(folder / "notes.csv", [])
    write(folder / "AA0326_IND.xlsx", [])
    write(folder / "AA0426_IND.XLSX", [])
    write(folder / "AA0326_IND.txt", [])
    write(folder / "AA0326_BUS_1234567890.CSV", [])
    found = discover_files(spark, str(folder))
    names = [r["FileName"] for r in chronological(found.filter("Problem IS NULL")).collect()]
    assert names == ["AA1225_IND.csv", "ZZ0126_IND.csv", "AA0226_BUS.csv", "AA0226_BUS_2.csv", "AA0326_BUS_1234567890.CSV"]
    problems = {r["FileName"] for r in found.filter("Problem IS NOT NULL").collect()}
    assert problems == {"notes.csv", "AA0326_IND.xlsx", "AA0426_IND.XLSX"}


def test_one_location_per_submission(spark):
    paths = ["file:/b/AA0126_IND.csv", "file:/a/aa0126_ind_1.csv", "file:/a/AA0126_IND_2/part-0.csv"]
    paths.append("file:/a/AA0126_IND_2/part-1.csv")
    described = describe_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    none = described.filter("FALSE")
    chosen = {r["path"] for r in pending_files(described, none).collect()}
    assert chosen == set(paths[1:])
    loaded = described.filter("SequenceNumber = 2")
    assert {r["path"] for r in pending_files(described, loaded).collect()} == {paths[1]}


# -- batches ----------------------------------------------------------------------


def test_a_bad_file_fails_alone(registry, folder):
    header = list(required_columns("IND"))
    good = write(folder / "with space/AA0126_IND.csv", [row(1), row(1, balance="2"), row(2)])
    shuffled = write(folder / "BB0126_IND.csv", [row(1, NatIDNum="x")], header=header[::-1])
    missing = write(folder / "CC0126_IND.csv", [row(1)], header=header[:-1])
    empty = write(folder / "DD0126_IND.csv", [])
    blank = str(folder / "EE0126_IND.csv")
    Path(blank).touch()
    long = write(folder / "FF0126_IND.csv", [row(1), row(2)])
    with open(long, "a") as f:
        f.write(",".join(["x"] * (len(header) + 1)) + "\n")
    business = write(folder / "AA0126_BUS.csv", [row(1, BusRegNum="r")], "BUS")
    result = process_paths(registry, [good, shuffled, missing, empty, blank, long, business])
    assert statuses(result) == {
        "AA0126_IND.csv": (PROCESSED, 3),
        "BB0126_IND.csv": (PROCESSED, 1),
        "CC0126_IND.csv": (FAILED, 0),
        "DD0126_IND.csv": (PROCESSED, 0),
        "EE0126_IND.csv": (FAILED, 0),
        "FF0126_IND.csv": (FAILED, 0),
        "AA0126_BUS.csv": (PROCESSED, 1),
    }
    stats = batch_stats(run_backfill(registry, str(folder)).frame(registry.spark)).first()
    assert tuple(stats) == (0, 4, 3, 0)
    codes = {r["SubscriberCode"] for r in registry.committed("raw").collect()}
    assert codes == {"AA", "BB"}
    (moved,) = registry.committed("raw").filter("SubscriberCode = 'BB'").collect()
    assert moved["IdentityFields"]["NatIDNum"] == "X"
    (dropped,) = registry.committed("raw").filter("IsDuplicate").collect()
    kept = registry.committed("raw").filter(
        "SubmissionType = 'IND' AND SubscriberCode = 'AA' AND FacilityAccNum = 'F1' AND NOT IsDuplicate"
    )
    assert dropped["KeptOverThisRecordID"] == kept.first()["RawRecordID"]
    history = registry.history("AA").collect()
    assert {(r["SubmissionType"], r["RecordCount"]) for r in history} == {("IND", 3), ("BUS", 1)}


def test_odd_headers_load_or_fail_alone(registry, folder):
    """Twins by case, our own names, blank names, glob characters: none harms another file."""
    header = list(required_columns("IND"))
    files = {
        "a[1]/AA0126_IND.csv": [*header, "tinum", "Remark"],
        "b{x,y}/BB0126_IND.csv": [*header, "PartName", "BlockStart", "RowIndex", "_path", "place", "cells", "names"],
        "c*?/CC0126_IND.csv": [*header, "", "", " Remark "],
        "d/DD0126_IND.csv": [c.lower() for c in header],
        "e/EE0126_IND.csv": ["MatchFlag", *header, "subscribercode", "header", "uri"],
    }
    for name, names in files.items():
        rows = [row(1, balance="1,000.555", NatIDNum="n", Remark="r", PartName="p", tinum="t")]
        write(folder / "in" / name, rows, header=names)
    result = process_paths(registry, [str(folder / "in" / f) for f in files])
    assert statuses(result) == {
        f"{c}0126_IND.csv": (FAILED, 0) if c == "DD" else (PROCESSED, 1) for c in ("AA", "BB", "CC", "DD", "EE")
    }
    rows = {r["IdentityKey"][:2]: r for r in result.outputs("IND")["unl_output"].collect()}
    assert {r["CurBal"] for r in rows.values()} == {"1,000.555"}
    assert (rows["AA"]["Remark"], rows["AA"]["tinum.1"], rows["BB"]["PartName"]) == ("r", "t", "p")
    assert rows["EE"]["MatchFlag"] == "No previous-month match" and rows["CC"]["NatIDNum"] == "N"
    assert {f.Status for f in run_backfill(registry, str(folder / "in")).files} == {ALREADY_LOADED, FAILED}


def test_plan_does_not_grow_with_headers(spark, folder):
    header = list(required_columns("IND"))

    def size(count):
        lines = [(f"file:/{i}", ",".join([*header, *[f"r{i}"]])) for i in range(count)]
        files = spark.createDataFrame(lines, "uri STRING, header STRING")
        heads = headers_frame(spark, [("IND", h) for _, h in lines])
        path = write(folder / "AA0126_IND.csv", [row(1)])
        rows = load_rows(spark, "IND", files, heads, [path], len(header) + 1, "b")
        return len(rows._jdf.queryExecution().analyzed().treeString().splitlines())

    assert size(1) == size(40)


def test_two_batches_of_one_submission(registry, folder, monkeypatch):
    """The batch that commits later is not seen, and its file is reported."""
    path = write(folder / "AA0126_IND.csv", [row(1)])
    inner, done = batch_module._register, []

    def interleaved(*arguments):
        inner(*arguments)
        if not done:
            done.append(True)
            process_paths(registry, [path])

    monkeypatch.setattr(batch_module, "_register", interleaved)
    with pytest.raises(registry_module.SubmissionClash):
        process_paths(registry, [path])
    assert registry.committed("raw").count() == 1


def test_a_mended_file_is_loaded_once(registry, folder):
    good = write(folder / "AA0126_IND.csv", [row(1)])
    bad = write(folder / "BB0126_IND.csv", [row(1), row(2)])
    mended = Path(bad).read_text()
    Path(bad).write_text(mended + ",".join(["x"] * 30) + "\n")
    assert statuses(process_paths(registry, [good, bad]))["BB0126_IND.csv"] == (FAILED, 0)
    Path(bad).write_text(mended)
    assert statuses(process_paths(registry, [good, bad])) == {
        "AA0126_IND.csv": (ALREADY_LOADED, 0),
        "BB0126_IND.csv": (PROCESSED, 2),
    }
    assert registry.committed("raw").count() == registry.raw_with_payload().count() == 3


def test_ties_go_by_file_order(registry, folder):
    rows = [row(1, NatIDNum=str(i)) for i in range(50)]
    process_paths(registry, [write(folder / "AA0126_IND.csv", rows)])
    (kept,) = registry.committed("raw").filter("NOT IsDuplicate").collect()
    assert kept["IdentityFields"]["NatIDNum"] == "0"


def test_split_files_keep_their_order(registry, folder):
    """Without line breaks in cells a file may be read in several blocks."""
    rows = [row(1, NatIDNum=f"{i:06d}") for i in range(3000)]
    path = write(folder / "AA0126_IND.csv", rows)
    spark = registry.spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        process_paths(registry, [path], multi_line=False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = registry.committed("raw")
    assert raw.select("BlockStart").distinct().count() > 3
    (kept,) = raw.filter("NOT IsDuplicate").collect()
    assert kept["IdentityFields"]["NatIDNum"] == "000000"


def test_months_build_on_each_other(registry, folder):
    """Seeded, published, carried over; a gap of a month starts anew."""
    spark = registry.spark
    seed = spark.createDataFrame(
        [("F1", "C1", "clean-1")], "FacilityAccNum STRING, CustomerID STRING, NatIDNum STRING"
    )
    seed_clean(registry, seed, "AA", "IND", "2025-12")
    people = [row(1, NatIDNum="1"), row(2, NatIDNum="2"), row(3, NatIDNum="3")]
    write(folder / "AA1225_IND.csv", people)
    more = [people[0], people[1], row(3, NatIDNum="3", TINum="t")]
    write(folder / "AA0126_IND.csv", more)
    write(folder / "AA0226_IND.csv", more)
    write(folder / "AA0426_IND.csv", more)
    report = run_backfill(registry, str(folder))
    assert {f.Status for f in report.files} == {PROCESSED}
    clean = {
        (r["ReportingPeriod"], r["FacilityAccNum"]): (r["MatchCategory"], r["IdentityFields"]["NatIDNum"])
        for r in registry.clean().collect()
    }
    assert clean == {
        ("2025-12", "F1"): ("Seed", "CLEAN-1"),
        ("2026-01", "F1"): ("Exact", "CLEAN-1"),
        ("2026-01", "F3"): ("Enriched", "3"),
        ("2026-02", "F1"): ("Exact", "CLEAN-1"),
        ("2026-02", "F3"): ("Exact", "3"),
    }
    categories = {
        (r["ReportingPeriod"], r["FacilityAccNum"]): r["ExceptionCategory"]
        for r in registry.committed("unl").collect()
    }
    assert categories["2026-01", "F2"].startswith("Matched in Raw History")
    assert {categories["2026-04", f"F{i}"] for i in (1, 2, 3)} == {"No previous-month match"}


def test_later_write_of_a_clean_key_wins(registry, folder):
    """Two sequences publish one identity: last values, first source."""
    write(folder / "AA0126_IND.csv", [row(1, NatIDNum="1")])
    write(folder / "AA0226_IND_1.csv", [row(1, NatIDNum="1", TINum="a")])
    write(folder / "AA0226_IND_2.csv", [row(1, NatIDNum="1", TINum="b"), row(1, "20260102", NatIDNum="1", HomeTel="c")])
    run_backfill(registry, str(folder))
    (merged,) = registry.clean().collect()
    assert (merged["IdentityFields"]["HomeTel"], merged["IdentityFields"]["TINum"]) == ("C", "")
    source = registry.committed("raw").filter(F.col("RawRecordID") == merged["SourceRawRecordID"])
    assert source.first()["SequenceNumber"] == 1
    # The next month carries the merged values forward.
    write(folder / "AA0326_IND.csv", [row(1, "20260102", NatIDNum="1", TINum="a")])
    run_backfill(registry, str(folder))
    (next_month,) = registry.clean().filter("ReportingPeriod = '2026-03'").collect()
    assert next_month["IdentityFields"]["HomeTel"] == "C"


def test_files_one_by_one_or_together(spark, folder):
    """Loading sequences separately gives the registry that loading them at once gives."""
    write(folder / "in/AA0126_IND.csv", [row(i, NatIDNum=str(i)) for i in range(6)])
    first = write(folder / "in/AA0226_IND_1.csv", [row(i, NatIDNum=str(i)) for i in range(4)])
    second = write(
        folder / "in/AA0226_IND_2.csv",
        [row(i, "20260102", NatIDNum=str(i), TINum="n" if i == 5 else "") for i in range(2, 8)],
    )
    states = []
    for name in ("together", "apart"):
        registry = Registry(spark, str(folder / name)).create()
        if name == "apart":
            process_paths(registry, [str(folder / "in/AA0126_IND.csv")])
            process_paths(registry, [first])
            process_paths(registry, [second])
        else:
            run_backfill(registry, str(folder / "in"))
        raw = registry.committed("raw").select(
            "ReportingPeriod", "SequenceNumber", "IdentityKey", "MatchFlag", "Route", "ExceptionCategory", "DateChanged"
        )
        clean = registry.clean().select("ReportingPeriod", "IdentityKey", "MatchCategory")
        states.append([sorted(map(str, raw.collect())), sorted(map(str, clean.collect()))])
    assert states[0] == states[1]


def test_an_interrupted_batch_leaves_nothing_to_see(registry, folder, monkeypatch):
    path = write(folder / "AA0126_IND.csv", [row(1)])

    def broken(raw):
        raise RuntimeError("lost")

    monkeypatch.setattr("monthmatch.plans.batch.date_log_rows", broken)
    report = run_backfill(registry, str(folder))
    assert [(f.Status, f.Message) for f in report.files] == [(FAILED, "lost")]
    for name in ("subscribers", "submissions", "raw", "clean", "unl"):
        assert registry.committed(name).count() == 0
    assert registry.everything("raw").count() == 1
    monkeypatch.setattr("monthmatch.plans.batch.date_log_rows", registry_module.date_log_rows)
    assert statuses(process_paths(registry, [path])) == {"AA0126_IND.csv": (PROCESSED, 1)}
    assert registry.committed("raw").count() == registry.committed("unl").count() == 1
    assert statuses(process_paths(registry, [path])) == {"AA0126_IND.csv": (ALREADY_LOADED, 0)}


def test_periods_are_not_mixed(registry, folder):
    paths = [write(folder / n, [row(1)]) for n in ("AA0126_IND.csv", "AA0226_IND.csv")]
    with pytest.raises(ValueError, match="one period"):
        process_paths(registry, paths)


def test_part_files_make_one_submission(registry, folder):
    write(folder / "AA0126_IND/part-0000.csv", [row(1), row(2)])
    write(folder / "AA0126_IND/part-0001.csv", [row(1), row(3)])
    report = run_backfill(registry, str(folder))
    assert [(f.FileName, f.Status, f.RecordCount) for f in report.files] == [("AA0126_IND", PROCESSED, 4)]
    assert registry.committed("raw").filter("IsDuplicate").first()["PartName"] == "part-0001.csv"


def test_payload_and_reports(registry, folder):
    rows = [row(1, Remark="keep\tme"), row(1, balance="2"), row(2)]
    process_paths(registry, [write(folder / "AA0126_IND.csv", rows, columns=["Remark"])])
    result = process_paths(registry, [write(folder / "AA0226_IND.csv", rows, columns=["Remark"])])
    payload = registry.raw_with_payload().filter("RawPayload LIKE '%keep%'")
    assert payload.count() == 2
    tagged = result.tagged("IND")
    assert {r["Metric"]: r["Count"] for r in result.summary().collect()}["Input records"] == 3
    assert preview(tagged, "unl_output", 1).count() == 1
    write_outputs(tagged, str(folder / "reports"))
    write_bundle(tagged, str(folder / "bundle"))
    unl = registry.spark.read.csv(str(folder / "reports/unl_output"), header=True)
    assert {"Credit FacilityAccNum", "Match Flag", "Exception Category"} <= set(unl.columns)
    assert unl.count() == 2
    assert {r["Remark"] for r in unl.collect()} == {"keep\tme", None}
    assert not {"PartName", "BlockStart", "RowIndex", "BatchID", "FilePlace"} & set(unl.columns)
    log = registry.spark.read.csv(str(folder / "bundle/Dedup Log"), header=True)
    assert log.first()["This Row Balance"] == "2.0"
    summary = registry.spark.read.csv(str(folder / "bundle/Summary"), header=True)
    assert summary.columns == ["Metric", "Count"] and summary.count() == 14


def test_stream_loads_what_arrives(registry, folder):
    reports = []

    def drain():
        query = start_ingest(
            registry, str(folder / "in"), str(folder / "checkpoint"), on_report=reports.append
        )
        query.awaitTermination()

    write(folder / "in/AA0126_IND.csv", [row(1, NatIDNum="1")])
    write(folder / "in/AA0226_IND.csv", [row(1, NatIDNum="1", TINum="a")])
    write(folder / "in/odd.csv", [])
    write(folder / "in/AA0126_BUS.XLSX", [])
    write(folder / "in/BB0126_IND.CSV", [row(1)])
    drain()
    assert sorted(f.Status for f in reports[0].files) == [FAILED, FAILED, PROCESSED, PROCESSED, PROCESSED]
    write(folder / "in/AA0326_IND.csv", [row(1, NatIDNum="1", TINum="a")])
    drain()
    assert [f.FileName for f in reports[1].files] == ["AA0326_IND.csv"]
    clean = {r["ReportingPeriod"]: r["MatchCategory"] for r in registry.clean().collect()}
    assert clean == {"2026-02": "Enriched", "2026-03": "Exact"}
