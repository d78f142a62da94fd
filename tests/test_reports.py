"""All outputs from one scan have the cells that a writer for each would give."""

import pytest
from pyspark.sql import functions as F

from monthmatch.fixed_values import OUTPUT_TITLES
from monthmatch.operators.outputs import outputs, report_headings
from monthmatch.operators.summary import run_summary
from monthmatch.plans.reconcile import reconcile
from monthmatch.sources.reports import write_bundle, write_csv, write_outputs
from workloads import fixture

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tagged(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('tagged')}/rows"
    rows = fixture.current(spark, SF_DIR).withColumns(
        {
            "Remark": F.when(F.col("RowOrder") % 3 == 0, F.lit(' say "a", \n b ')).when(F.col("RowOrder") % 3 == 1, ""),
            "a,b": F.col("RowOrder").cast("double"),
        }
    )
    given = fixture.inputs(spark, SF_DIR)
    done = reconcile(rows, given.prior_raw, given.prior_clean, "IND", given.open_unl)
    done.repartition(3, "RowOrder").write.parquet(path)
    return spark.read.parquet(path)


def cells(spark, path):
    rows = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return rows.columns, sorted(map(tuple, rows.collect()), key=repr)


def test_cells_of_all_outputs(spark, tagged, tmp_path):
    write_outputs(tagged, f"{tmp_path}/one")
    for name, output in outputs(tagged).items():
        write_csv(output.toDF(*report_headings(output)), f"{tmp_path}/each/{name}")
        got, want = cells(spark, f"{tmp_path}/one/{name}"), cells(spark, f"{tmp_path}/each/{name}")
        assert got == want and want[1], name
    assert sorted(p.name for p in (tmp_path / "one").iterdir() if not p.name.startswith(".")) == sorted(OUTPUT_TITLES)


def test_lines_are_byte_for_byte_those_of_the_writer(spark, tagged, tmp_path):
    one = tagged.orderBy("RowOrder").coalesce(1)
    write_outputs(one, f"{tmp_path}/one")
    for name, output in outputs(one).items():
        write_csv(output.toDF(*report_headings(output)), f"{tmp_path}/each/{name}")
        (want,) = (tmp_path / "each" / name).glob("part-*")
        (got,) = (tmp_path / "one" / name).glob("part-*")
        assert got.read_bytes() == want.read_bytes()


def test_no_rows_and_folders_that_are_there(spark, tagged, tmp_path):
    write_outputs(tagged.limit(0), f"{tmp_path}/none")
    for name in OUTPUT_TITLES:
        names, rows = cells(spark, f"{tmp_path}/none/{name}")
        assert rows == [] and len(names) > 3
    with pytest.raises(FileExistsError):
        write_outputs(tagged, f"{tmp_path}/none")


def test_bundle_observes_its_summary(spark, tagged, tmp_path):
    write_bundle(tagged, f"{tmp_path}/bundle")
    got = {r["Metric"]: int(r["Count"]) for r in spark.read.csv(f"{tmp_path}/bundle/Summary", header=True).collect()}
    assert got == {r["Metric"]: r["Count"] for r in run_summary(tagged).collect()}
    log = spark.read.csv(f"{tmp_path}/bundle/{OUTPUT_TITLES['unl_output']}", header=True, multiLine=True, escape='"')
    assert log.count() == tagged.filter("Route = 'unl_output'").count()
