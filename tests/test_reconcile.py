"""Every classification branch on hand-made records."""

import pytest
from pyspark.sql import functions as F

from monthmatch.fixed_values import MATCH_KEY
from monthmatch.operators.match import keys_ready
from monthmatch.operators.outputs import outputs
from monthmatch.operators.skew import NO_HEAVY_KEYS, HeavyKeys, find_heavy_keys, key_hash
from monthmatch.operators.summary import headline_metrics, run_summary
from monthmatch.plans.reconcile import duplicate_keys, reconcile
from tests.records import frame, record, unl


def tagged_rows(spark, current, prior, clean, open_keys=None, kind="IND", seq=False, **options):
    tagged = reconcile(
        frame(spark, current, kind, seq),
        frame(spark, prior, kind),
        frame(spark, clean, kind),
        kind,
        None if open_keys is None else unl(spark, open_keys, kind),
        **options,
    )
    return tagged


def by_facility(df):
    return {r["FacilityAccNum"]: r for r in df.collect()}


# Each case is one record: what it was last month, what it is now, whether it has verified
# values, and where it has to go.
ROUTE_CASES = {
    "same, verified": ({"VotersIDNum": "v-1"}, {"VotersIDNum": "v-1"}, True, "cleaned_output", None),
    "same, not verified": (
        {"SSNum": "77"}, {"SSNum": "77"}, False, "unl_output", "Same hash, not found in cleaned file",
    ),
    "turned round, verified": (
        {"SSNum": "5", "EzwichNum": "6", "VotersIDNum": "7"},
        {"SSNum": "6", "EzwichNum": "7", "VotersIDNum": "5"},
        True, "rearranged_output", None,
    ),
    "turned round, not verified": (
        {"SSNum": "8", "EzwichNum": "9"}, {"SSNum": "9", "EzwichNum": "8"},
        False, "unl_output", "Rearranged, not found in cleaned file",
    ),
    "one more id": ({"SSNum": "3"}, {"SSNum": "3", "PassportNum": "q"}, True, "enriched_output", None),
    "another phone": (
        {"WorkTel": "111"}, {"WorkTel": "222"}, True, "unl_output", "Different hash",
    ),
    "not there before": (None, {"SSNum": "4"}, False, "unl_output", "No previous-month match"),
}


@pytest.fixture(scope="module")
def routes(spark):
    prior, current, clean = [], [], []
    for n, (before, now, verified, _, _) in enumerate(ROUTE_CASES.values(), 1):
        day = f"202511{n:02d}"
        if before is not None:
            prior.append(record(n, day, **before))
        if verified:
            clean.append(record(n, day, **{f: f"checked {v}" for f, v in before.items()}))
        current.append(record(n, day, balance=str(40 + n), **now))
    # The first record is there twice; the second one's date can not be read.
    current.append(record(1, "20251101", balance="40.5", **ROUTE_CASES["same, verified"][1]))
    current[1]["DisbursementDate"] = "2025-11-31"
    return tagged_rows(spark, current, prior, clean).cache()


@pytest.mark.parametrize("name", ROUTE_CASES)
def test_routes(routes, name):
    n = list(ROUTE_CASES).index(name) + 1
    (row,) = routes.filter(f"FacilityAccNum = 'F{n}' AND NOT IsDuplicate").collect()
    assert (row["Route"], row["ExceptionCategory"]) == ROUTE_CASES[name][3:]


def test_the_lower_balance_stays(routes):
    (row,) = outputs(routes)["dedup_log"].collect()
    assert (row["RowOrder"], row["KeptOverThisRecordID"]) == (1, len(ROUTE_CASES) + 1)
    assert (row["ThisRowBalance"], row["KeptBalance"]) == (41.0, 40.5)
    assert row["CompositeKey"] == "F1|C1|20251101"


def test_verified_values_are_published(routes):
    (same,) = outputs(routes)["cleaned_output"].collect()
    assert (same["VotersIDNum"], same["CurBal"]) == ("checked v-1", "40.5")
    (turned,) = outputs(routes)["rearranged_output"].collect()
    assert [turned[f] for f in ("SSNum", "EzwichNum", "VotersIDNum")] == ["checked 5", "checked 6", "checked 7"]
    assert turned["Source"] == "Auto-processed: same ID values, different field order"
    (more,) = outputs(routes)["enriched_output"].collect()
    assert (more["SSNum"], more["PassportNum"]) == ("3", "Q")


def test_differences_are_told(routes):
    row = by_facility(outputs(routes)["unl_output"])["F6"]
    assert (row["FieldDifferences"], row["ChangedFields"]) == ("WorkTel: '111' -> '222'", "WorkTel")


def test_unreadable_date_is_logged_and_does_not_route(routes):
    (row,) = outputs(routes)["date_change_log"].collect()
    assert row["IdentityKey"] == "CP|IND|F2|C2"
    assert str(row["PreviousDate"]) == "2025-11-02" and row["CurrentDate"] is None


def test_summary_adds_up(routes):
    counts = {r["Metric"]: r["Count"] for r in run_summary(routes).collect()}
    assert counts["Input records"] == len(ROUTE_CASES) + 1 and counts["Duplicates removed"] == 1
    assert counts["Same hash, not found in cleaned file"] == 1
    assert counts["Rearranged (auto-processed)"] == 2
    head = headline_metrics(routes).first()
    assert head["AutoCleaned"] + head["SentToUnl"] == counts["After dedup"]


CASES = {
    # name: (prior fields, current fields, flag, added, changed, removed)
    "added": ({"NatIDNum": "A"}, {"NatIDNum": "A", "TINum": "T"}, "Enriched", "TINum", "", ""),
    "added contact": ({"NatIDNum": "A"}, {"NatIDNum": "A", "HomeTel": "1"}, "Enriched", "HomeTel", "", ""),
    "removed": ({"NatIDNum": "A", "TINum": "T"}, {"NatIDNum": "A"}, "Different", "", "", "TINum"),
    "added and changed": (
        {"NatIDNum": "A"}, {"NatIDNum": "B", "TINum": "T"}, "Different", "TINum", "NatIDNum", "",
    ),
    "moved to an empty field": (
        {"NatIDNum": "A"}, {"PassportNum": "A"}, "Rearranged", "PassportNum", "", "NatIDNum",
    ),
    "swapped and phone changed": (
        {"NatIDNum": "A", "TINum": "B", "HomeTel": "1"},
        {"NatIDNum": "B", "TINum": "A", "HomeTel": "2"},
        "Different", "", "NatIDNum, TINum, HomeTel", "",
    ),
    "multisets differ": (
        {"NatIDNum": "A", "VotersIDNum": "A", "TINum": "B"},
        {"NatIDNum": "A", "VotersIDNum": "B", "TINum": "B"},
        "Different", "", "VotersIDNum", "",
    ),
    "all blank": ({}, {}, "Exact match", "", "", ""),
    "all removed": ({"NatIDNum": "A"}, {}, "Different", "", "", "NatIDNum"),
    "all added": ({}, {"NatIDNum": "A"}, "Enriched", "NatIDNum", "", ""),
    "only case and padding": ({"NatIDNum": "gha "}, {"NatIDNum": "\tGHA"}, "Exact match", "", "", ""),
}


@pytest.fixture(scope="module")
def cases(spark):
    prior = [record(i, "20260101", **c[0]) for i, c in enumerate(CASES.values(), 1)]
    current = [record(i, "20260101", **c[1]) for i, c in enumerate(CASES.values(), 1)]
    return by_facility(tagged_rows(spark, current, prior, []))


@pytest.mark.parametrize("name", CASES)
def test_classification(cases, name):
    row = cases[f"F{list(CASES).index(name) + 1}"]
    found = (row["MatchFlag"], row["AddedFields"], row["ChangedFields"], row["RemovedFields"])
    assert found == CASES[name][2:]


def test_enriched_keeps_its_own_values(spark):
    current = [record(1, "20260101", NatIDNum="A", TINum="T")]
    prior = [record(1, "20260101", NatIDNum="A")]
    clean = [record(1, "20260101", NatIDNum="A-CLEAN")]
    (row,) = outputs(tagged_rows(spark, current, prior, clean))["enriched_output"].collect()
    assert (row["NatIDNum"], row["TINum"]) == ("A", "T")


def test_blank_clean_value_overwrites_and_missing_one_does_not(spark):
    rows = [record(1, "20260101", NatIDNum="A", TINum="T")]
    clean = frame(spark, [record(1, "20260101", NatIDNum="")]).drop("TINum")
    tagged = reconcile(frame(spark, rows), frame(spark, rows), clean, "IND")
    (row,) = outputs(tagged)["cleaned_output"].collect()
    assert (row["NatIDNum"], row["TINum"]) == ("", "T")


def test_open_exceptions_make_carryover(spark):
    rows = [record(i, "20260101", NatIDNum=f"A{i}") for i in (1, 2, 3)]
    changed = [*rows[:2], record(3, "20260101", NatIDNum="B")]
    tagged = tagged_rows(spark, changed, rows, [], [(1, False), (2, True), (3, False)])
    categories = {k: r["ExceptionCategory"] for k, r in by_facility(tagged).items()}
    assert categories["F1"].startswith("Matched in Raw History")
    assert categories["F2"] == "Same hash, not found in cleaned file"
    assert categories["F3"] == "Different hash"


def test_unl_without_resolved_column_is_all_open(spark):
    rows = frame(spark, [record(1, "20260101")])
    tagged = reconcile(rows, rows, frame(spark, []), "IND", unl(spark, [(1, True)]).drop("Resolved"))
    assert tagged.first()["InOpenUnl"]


def test_balances(spark):
    current = [
        record(1, "20260101", balance="", order=1),
        record(1, "20260101", balance="7", order=2),
        record(2, "20260101", balance="5", order=3),
        record(2, "20260101", balance="5.0", order=4),
        record(3, "20260101", balance="1,000", order=5),
        record(3, "20260101", balance="999.5", order=6),
        record(4, "20260101", balance="x", order=7),
        record(4, "20260101", balance="none", order=8),
        record(5, "20260101", balance="1", order=9),
        record(5, "20260102", balance="1", order=10),
    ]
    rows = tagged_rows(spark, current, [], []).filter("IsDuplicate").collect()
    assert {r["RowOrder"]: r["KeptOverThisRecordID"] for r in rows} == {1: 2, 4: 3, 5: 6, 8: 7}


def test_two_dates_of_one_identity_meet_the_same_prior_row(spark):
    prior = [record(1, "20260101", NatIDNum="A"), record(1, "20260102", NatIDNum="B")]
    current = [record(1, "20260101", NatIDNum="A"), record(1, "20260102", NatIDNum="A")]
    rows = tagged_rows(spark, current, prior, []).collect()
    assert {r["MatchFlag"] for r in rows} == {"Exact match"}
    assert [r["DateChanged"] for r in sorted(rows, key=lambda r: r["RowOrder"])] == [False, True]


def test_business_records(spark):
    prior = [record(1, "20260101", "1", "BUS", BusRegNum="R", OfficeTel1="1")]
    current = [record(1, "20260101", "1", "BUS", PrevRegNum="R", OfficeTel1="1")]
    (row,) = tagged_rows(spark, current, prior, [], kind="BUS").collect()
    assert row["MatchFlag"] == "Rearranged"


def test_delimiter_in_values_joins_on_columns(spark):
    prior = frame(spark, [record(1, "20260101")]).withColumns(
        {"FacilityAccNum": F.lit("A|B"), "CustomerID": F.lit("C")}
    )
    current = frame(spark, [record(1, "20260101")]).withColumns(
        {"FacilityAccNum": F.lit("A"), "CustomerID": F.lit("B|C")}
    )
    assert reconcile(current, prior, prior, "IND").first()["MatchFlag"] == "No previous-month match"


def test_numbers_are_written_out(spark):
    """A phone number kept as a number is the same as its digits."""
    prior = frame(spark, [record(1, "20260101", HomeTel="233554000000")])
    current = prior.withColumn("HomeTel", F.col("HomeTel").cast("double"))
    row = reconcile(current, prior, prior, "IND").first()
    assert (row["HomeTel"], row["MatchFlag"]) == ("233554000000", "Exact match")


def test_empty_inputs(spark):
    counts = run_summary(tagged_rows(spark, [], [], [], []))
    assert {r["Count"] for r in counts.collect()} == {0}


def test_later_sequence_sees_earlier_exceptions(spark):
    prior = [record(1, "20260101", NatIDNum="A"), record(2, "20260101", NatIDNum="A")]
    current = [
        record(1, "20260101", NatIDNum="A", seq=1),
        record(1, "20260102", NatIDNum="A", seq=2),
        record(2, "20260101", NatIDNum="A", seq=2),
    ]
    for heavy in (NO_HEAVY_KEYS, all_heavy(spark, current, seq=True)):
        rows = tagged_rows(spark, current, prior, [], [], seq=True, heavy=heavy).collect()
        found = {(r["FacilityAccNum"], r["SequenceNumber"]): r["InOpenUnl"] for r in rows}
        assert found == {("F1", 1): False, ("F1", 2): True, ("F2", 2): False}


def test_duplicates_are_looked_for_within_one_file(spark):
    current = [record(1, "20260101", seq=1), record(1, "20260101", seq=2)]
    assert tagged_rows(spark, current, [], [], seq=True).filter("IsDuplicate").count() == 0


def all_heavy(spark, rows, seq=False):
    current = keys_ready(frame(spark, rows, seq=seq))
    keys = duplicate_keys(current)
    hashes = current.select(key_hash(MATCH_KEY).alias("i"), key_hash(keys).alias("r")).collect()
    return HeavyKeys(tuple({h["i"] for h in hashes}), tuple({h["r"] for h in hashes}))


def test_heavy_keys_change_nothing(spark):
    """The same rows with one key heavy, all heavy and none heavy."""
    hot = [
        record(1, f"2026{1 + i % 3:02d}01", balance=str(50 + i * 7 % 31), NatIDNum="A", order=i + 1)
        for i in range(120)
    ]
    rest = [
        record(n, "20260101", balance=str(b), NatIDNum=f"N{n}", order=1000 + n * 10 + b)
        for n in range(2, 30)
        for b in (1, 2)
    ]
    prior = [record(1, "20260101", NatIDNum="A"), *(record(n, "20260101", NatIDNum="N2") for n in range(2, 20))]
    clean = [record(n, "20260101", NatIDNum="CLEAN") for n in (1, 2)]
    current = [*hot, *rest]
    plans = [
        NO_HEAVY_KEYS,
        all_heavy(spark, hot),
        all_heavy(spark, current),
        HeavyKeys(all_heavy(spark, hot).identities, ()),
    ]

    def rows(heavy):
        tagged = tagged_rows(spark, current, prior, clean, [(3, False)], heavy=heavy)
        return sorted(map(str, tagged.select(sorted(tagged.columns)).collect()))

    expected = rows(plans[0])
    assert len(expected) == len(current)
    for heavy in plans[1:]:
        assert rows(heavy) == expected


def test_null_keys_are_keys(spark):
    """Null parts of a key agree with nulls and blanks, in every plan and of every type."""
    def rows(facility, kind="string"):
        out = frame(spark, [record(1, "20260101", balance=str(b), order=b) for b in (3, 2, 5)])
        dated = out.withColumn("DisbursementDate", F.lit(None).cast("date"))
        return dated.withColumn("FacilityAccNum", F.lit(facility).cast(kind))

    for kind in ("string", "int"):
        current, prior = rows(None, kind), rows("" if kind == "string" else None, kind)
        hashes = keys_ready(current).select(
            key_hash(MATCH_KEY).alias("i"), key_hash(duplicate_keys(current)).alias("r")
        ).first()
        for heavy in (NO_HEAVY_KEYS, HeavyKeys((hashes["i"],), (hashes["r"],)), HeavyKeys((hashes["i"],), ())):
            tagged = reconcile(current, prior, prior, "IND", prior.withColumn("Resolved", F.lit(False)), heavy=heavy)
            found = sorted((r["RowOrder"], r["Route"], r["KeptOverThisRecordID"]) for r in tagged.collect())
            assert found == [(2, "cleaned_output", None), (3, "dedup_log", 2), (5, "dedup_log", 2)]


def test_duplicates_of_the_whole_period(spark):
    current = [record(1, "20260101", balance="9", seq=1, order=1), record(1, "20260101", balance="8", seq=2, order=2)]
    tagged = tagged_rows(spark, current, [], [], seq=True, dedup_scope="period")
    assert [r["RowOrder"] for r in tagged.filter("IsDuplicate").collect()] == [1]
    with pytest.raises(ValueError, match="scope"):
        tagged_rows(spark, current, [], [], seq=True, dedup_scope="year")


def test_many_heavy_keys_are_all_found(spark):
    """As many as half the partitions can hold, of a table that is small on disk."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        rows = spark.range(40_000).selectExpr("CAST(id % 150 AS STRING) AS k")
        assert len(find_heavy_keys(rows, ["k"], ["k"], min_rows=200).identities) == 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_heavy_keys_are_found(spark):
    rows = spark.range(20_000).selectExpr(
        "IF(id % 3 > 0, 'hot', CAST(id AS STRING)) AS k", "CAST(id % 5 AS STRING) AS d"
    )
    found = find_heavy_keys(rows, ["k"], ["k", "d"], min_rows=2_000)
    expected = rows.filter("k = 'hot'").select(F.xxhash64("k")).first()[0]
    assert found.identities == (expected,)
    assert found.records == ()
    assert find_heavy_keys(rows.limit(0), ["k"], ["k", "d"]) == NO_HEAVY_KEYS
