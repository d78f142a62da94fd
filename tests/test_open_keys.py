"""The table of open keys: the same keys as all exceptions, without reading all of them."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from monthmatch.plans.backfill import run_backfill
from monthmatch.plans.batch import process_paths
from monthmatch.sources import registry as registry_module
from monthmatch.sources.registry import Registry
from tests.test_registry import row, write


def keys(frame):
    return {tuple(r) for r in frame.select("SubscriberCode", "FacilityAccNum", "CustomerID").distinct().collect()}


def everything(registry, kind="IND"):
    return keys(registry.committed("unl").filter(f"SubmissionType = '{kind}' AND NOT Resolved"))


def size(frame):
    """Bytes of the files that rows come from."""
    files = frame.select(F.input_file_name().alias("file")).distinct().collect()
    return sum(os.path.getsize(urlparse(r["file"]).path) for r in files)


def months(folder, names, changed):
    """Each month all people are there, and what they changed is an exception."""
    for k, name in enumerate(names):
        people = [row(i, NatIDNum=f"{i}-{k if i in changed else 0}") for i in range(40)]
        write(folder / f"AA{name}_IND.csv", people)


def test_keys_and_bytes_of_many_months(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"), snapshot_every=2).create()
    names = ("0125", "0225", "0325", "0425", "0525", "0625")
    sizes = []
    for k in range(0, 6, 2):
        months(tmp_path / f"in{k}", names[k : k + 2], set(range(0, 40, 2)))
        run_backfill(registry, str(tmp_path / f"in{k}"))
        found = registry.open_unl("IND")
        sizes.append(size(found))
        assert keys(found) == everything(registry) and len(keys(found)) == 40
        assert keys(registry.open_unl("BUS")) == set()
    whole = size(registry.everything("unl"))
    assert sizes[2] <= 1.2 * sizes[0] < whole / 2
    some = spark.createDataFrame([("AA",), ("ZZ",)], "SubscriberCode string")
    assert keys(registry.open_unl("IND", some)) == everything(registry)
    assert keys(registry.open_unl("IND", some.filter("SubscriberCode = 'ZZ'"))) == set()


def test_a_batch_that_commits_during_a_snapshot(spark, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path / "registry"), snapshot_every=1).create()
    write(tmp_path / "AA0125_IND.csv", [row(1)])
    other = write(tmp_path / "b" / "BB0125_IND.csv", [row(2)])
    inner, done = Registry._open_keys, []

    def interleaved(self, *arguments):
        if len(arguments) == 3 and not done:
            done.append(True)
            process_paths(registry, [other])
        return inner(self, *arguments)

    monkeypatch.setattr(Registry, "_open_keys", interleaved)
    process_paths(registry, [str(tmp_path / "AA0125_IND.csv")])
    assert done and keys(registry.open_unl("IND")) == everything(registry)
    assert len(everything(registry)) == 2


def test_a_snapshot_of_a_batch_that_failed_is_not_read(spark, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path / "registry"), snapshot_every=1).create()
    path = write(tmp_path / "AA0125_IND.csv", [row(1)])

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(registry_module.Registry, "commit", broken)
    with pytest.raises(RuntimeError):
        process_paths(registry, [path])
    monkeypatch.undo()
    assert registry.everything("open_keys").count() == 1 and keys(registry.open_unl("IND")) == set()
    process_paths(registry, [path])
    assert keys(registry.open_unl("IND")) == everything(registry) != set()
