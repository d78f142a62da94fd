"""Files with line breaks inside quotes, read in blocks, against Spark's own reader of whole files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmatch.fixed_values import required_columns
from monthmatch.plans.batch import process_paths
from monthmatch.sources import quoted
from monthmatch.sources.quoted import block_states, split_cells, split_records, states
from monthmatch.sources.registry import Registry

WIDTH = 4


def cell(r):
    kind = r.random()
    if kind < 0.2:
        return r.choice(["", '""'])
    if kind < 0.65:
        return '"' + "".join(r.choices(["a", " ", ",", "\n", '""', "é", "x y", "\n\n", '"",""', "\r\n"], k=r.randint(1, 8))) + '"'
    return "".join(r.choices(["a", "bc", " ", "é", 'x"y', '5"', "'"], k=r.randint(1, 5)))


def text(seed, end):
    r = random.Random(seed)
    lines = ["h1,h2,h3"]
    for i in range(200):
        lines += [""] * (r.random() < 0.05)
        lines.append(",".join([f"r{i}", *(cell(r) for _ in range(r.choice([3, 3, 2, 1, 4, 5]) - 1))]))
    return end.join(lines) + (end if seed % 2 else "")


def by_spark(spark, path):
    schema = ", ".join(f"c{i} STRING" for i in range(WIDTH))
    options = {"header": True, "multiLine": True, "enforceSchema": True, "escape": '"'}
    return [tuple(r) for r in spark.read.schema(schema).options(**options).csv(str(path)).collect()]


def in_blocks(spark, path, size):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    rows = split_cells(session, [str(path)], WIDTH).orderBy("place.BlockStart", "place.RowIndex").collect()
    return [tuple(r["cells"]) for r in rows], len({r["place"]["BlockStart"] for r in rows})


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [0, 1])
def test_rows_are_those_of_the_whole_file(spark, tmp_path, seed, end):
    path = tmp_path / "a+b c[1].csv"
    path.write_text(text(seed, end), newline="")
    want = by_spark(spark, str(path).replace("[", "\\[").replace("]", "\\]"))
    assert len(want) == 200
    for size in (41, 300, 1 << 20):
        got, blocks = in_blocks(spark, path, size)
        assert got == want
        assert blocks > 10 or size > 41


def test_more_open_blocks_than_a_broadcast_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "FEW_BLOCKS", 3)
    path = tmp_path / "a.csv"
    path.write_text(text(1, "\n"), newline="")
    assert in_blocks(spark, path, 50)[0] == by_spark(spark, path)


def test_a_cell_longer_than_blocks_and_one_that_does_not_end(spark, tmp_path):
    long = "line, one\n" * 500
    path = tmp_path / "a.csv"
    path.write_text(f'h1,h2\nx,"{long}"\ny,z\nq,"open\nto the end', newline="")
    records = [r["record"] for r in split_records(spark, [str(path)], 64).orderBy("BlockStart", "RowIndex").collect()]
    assert records == ["h1,h2", f'x,"{long}"', "y,z", 'q,"open\nto the end']


def test_files_without_rows(spark, tmp_path):
    for name, content in {"empty": "", "header": "h1,h2\n", "blank": "h1,h2\n\n\n"}.items():
        (tmp_path / f"{name}.csv").write_text(content)
        assert in_blocks(spark, tmp_path / f"{name}.csv", 8) == ([], 0)


def test_states_of_lines():
    r = np.random.default_rng(1)
    for _ in range(200):
        after, after_open = r.random((2, 12)) < 0.5
        for state in (False, True):
            now, want = state, []
            for a, b in zip(after, after_open, strict=True):
                now = bool(b if now else a)
                want.append(now)
            assert states(after, after_open, state).tolist() == want


def test_blocks_are_told_in_any_batches(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(text(3, "\n"), newline="")
    lines = quoted._lines(spark, [str(path)], 100).select("uri", "BlockStart", "after", "after_open")
    one, many = (
        lines.coalesce(n).mapInArrow(block_states, "uri string, BlockStart long, after boolean, after_open boolean")
        for n in (1, 1000)
    )
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_a_batch_from_blocks(spark, tmp_path):
    """A submission read in blocks is the one read whole, in the same order."""
    names = [*required_columns("IND"), "Remark"]
    lines = [",".join(names)]
    for i in range(400):
        cells = {"Credit FacilityAccNum": f"F{i % 350}", "CustomerID": f"C{i % 350}", "DisbursementDate": "20260101"}
        cells |= {"CurBal": "1", "Remark": '"two\nlines, ""quoted"""' if i % 3 else ""}
        lines.append(",".join(cells.get(n, "") for n in names))
    path = tmp_path / "AA0126_IND.csv"
    path.write_text("\n".join(lines) + "\n", newline="")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    found = []
    for mode in (True, "split"):
        registry = Registry(session, str(tmp_path / f"registry-{mode}")).create()
        result = process_paths(registry, [str(path)], multi_line=mode)
        assert [(f.Status, f.RecordCount) for f in result.files] == [("processed", 400)]
        raw = registry.raw_with_payload()
        found.append(sorted(map(tuple, raw.select("IdentityKey", "IsDuplicate", "Route", "RawPayload").collect())))
        tasks = raw.select("BlockStart").distinct().count()
    assert found[0] == found[1] and tasks > 5
    assert raw.filter(F.col("RawPayload").contains("two\\nlines")).count() > 200
