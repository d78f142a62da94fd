"""Several writers of one registry, and what is left of those that failed."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from test_registry import folder, registry, row, write  # noqa: F401

from monthmatch.plans import batch as batch_module
from monthmatch.plans.batch import process_paths
from monthmatch.schemas import DATASETS
from monthmatch.sources.registry import Registry, RegistryLocked, SubmissionClash


def test_one_of_two_writers_at_a_time_commits(registry, folder, monkeypatch):  # noqa: F811
    path = write(folder / "AA0126_IND.csv", [row(1), row(2)])
    inner, both = batch_module._register, threading.Barrier(2, timeout=60)

    def together(*arguments):
        inner(*arguments)
        both.wait()

    monkeypatch.setattr(batch_module, "_register", together)

    def load(_):
        try:
            return process_paths(registry, [path]).files[0].RecordCount
        except SubmissionClash:
            return "clash"

    with ThreadPoolExecutor(2) as pool:
        assert sorted(map(str, pool.map(load, range(2)))) == ["2", "clash"]
    assert registry.committed("raw").count() == 2 and registry.everything("raw").count() == 4
    assert registry.loaded().count() == 1 and registry.everything("commits").count() == 1


def test_a_lock_is_waited_for_and_can_be_removed(spark, registry):  # noqa: F811
    other = Registry(spark, registry.root, lock_seconds=0.0)
    with registry.commit_lock("first"):
        with pytest.raises(RegistryLocked):
            other.commit("second")
        assert other.everything("commits").count() == 0
    other.commit("second")
    with pytest.raises(KeyError), registry.commit_lock("first"):
        raise KeyError
    # A writer that died leaves its lock.
    dead = registry.commit_lock("dead")
    dead.__enter__()
    with pytest.raises(RegistryLocked):
        other.commit("third")
    assert other.unlock() and not other.unlock()
    patient = Registry(spark, registry.root, lock_seconds=60.0)
    with ThreadPoolExecutor(1) as pool:
        with registry.commit_lock("first"):
            waiting = pool.submit(patient.commit, "fourth")
            time.sleep(1)
            assert not waiting.done()
        waiting.result()
    assert {r.BatchID for r in registry.everything("commits").collect()} == {"second", "fourth"}


def test_what_failed_batches_left_is_removed(registry, folder, monkeypatch):  # noqa: F811
    good = write(folder / "AA0126_IND.csv", [row(1)])
    bad = write(folder / "BB0126_IND.csv", [row(1), row(2)])
    process_paths(registry, [good])
    with monkeypatch.context() as patch:
        patch.setattr(Registry, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            process_paths(registry, [bad])
    names = [n for n in DATASETS if n != "commits"]

    def rows_of(df):
        return sorted(str(sorted(r.asDict().items())) for r in df.collect())

    seen = {n: rows_of(registry.committed(n)) for n in names}
    assert registry.everything("raw").count() == 3 and registry.everything("submissions").count() == 2
    assert registry.remove_uncommitted() == []
    assert registry.everything("raw").count() == 3
    (gone,) = registry.remove_uncommitted(timedelta(0))
    assert gone not in {r.BatchID for r in registry.everything("commits").collect()}
    for n in names:
        assert rows_of(registry.everything(n)) == seen[n], n
    assert registry.remove_uncommitted(timedelta(0)) == []
    assert process_paths(registry, [bad]).files[0].RecordCount == 2
    assert registry.committed("raw").count() == 3
