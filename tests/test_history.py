"""All months together give what the months one after the other give."""

import random

import pytest

from monthmatch.fixed_values import hash_fields
from monthmatch.functions.fields import unpack
from monthmatch.plans.backfill import run_backfill
from monthmatch.plans.history import replay
from monthmatch.sources.registry import Registry, seed_clean
from tests.test_registry import row, write

TAGS = ("ReportingPeriod", "RawRecordID", "IdentityKey", "IsDuplicate", "MatchFlag", "FieldDifferences", "Route",
        "ExceptionCategory", "InClean", "InOpenUnl", "DateChanged", "Source")


def changed(r, person):
    """A record as it is the month after, in one of the ways that count."""
    person, kind = dict(person), r.random()
    if kind < 0.2:
        person["NatIDNum"], person["TINum"] = person.get("TINum", ""), person.get("NatIDNum", "")
    elif kind < 0.4:
        person[r.choice(["HomeTel", "PassportNum", "WorkTel"])] = str(r.randint(1, 3))
    elif kind < 0.5:
        person["DriverLicNum"] = r.choice(["", "x", "y"])
    return person


@pytest.mark.parametrize("seed", [1, 2])
def test_history_is_the_loop(spark, tmp_path, seed):
    r = random.Random(seed)
    registry = Registry(spark, str(tmp_path / "registry")).create()
    for code, period in (("AA", "2025-10"), ("AA", "2026-01"), ("BB", "2025-12")):
        fields = "FacilityAccNum STRING, CustomerID STRING, NatIDNum STRING, HomeTel STRING"
        rows = [(f"F{i}", f"C{i}", f"clean-{i}", r.choice([None, "", "9"])) for i in range(0, 30, r.choice([1, 2]))]
        seed_clean(registry, spark.createDataFrame(rows, fields), code, "IND", period)
    people = {i: row(i, NatIDNum=str(i), TINum=r.choice(["", "t"])) for i in range(30)}
    for month in ("1125", "1225", "0126", "0326", "0426"):
        for code in ("AA", "BB"):
            people = {i: changed(r, p) for i, p in people.items()}
            for sequence in range(1, 1 + r.choice([1, 1, 2])):
                there = [p for p in people.values() if r.random() < 0.9]
                again = [{**p, "CurBal": "0"} for p in there if r.random() < 0.1]
                other = [{**changed(r, p), "DisbursementDate": "20260102"} for p in there if r.random() < 0.1]
                write(tmp_path / "in" / f"{code}{month}_IND_{sequence}.csv", [*there, *again, *other])
    run_backfill(registry, str(tmp_path / "in"))
    history = replay(registry, "IND")

    def told(frame, names):
        return sorted(map(tuple, frame.select(*names).collect()), key=repr)

    assert told(history.tagged, TAGS) == told(registry.committed("raw"), TAGS)
    names = ("SubscriberCode", "FacilityAccNum", "CustomerID", "ReportingPeriod", "MatchCategory", *hash_fields("IND"))
    states = told(unpack(registry.clean(), hash_fields("IND")), names)
    assert told(history.clean, names) == states
    assert {s[4] for s in states} == {"Seed", "Exact", "Rearranged", "Enriched"}


def test_a_registry_without_rows(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry")).create()
    history = replay(registry, "BUS")
    assert history.tagged.count() == history.clean.count() == 0


def test_plan_does_not_grow_with_months(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry")).create()
    scans = replay(registry, "IND").clean._jdf.queryExecution().analyzed().treeString().count("Relation [")
    assert 0 < scans < 20
