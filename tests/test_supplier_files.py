"""The folder of small submissions made from the supplier table."""

from pathlib import Path

from monthmatch.sources.submissions import discover_files
from workloads import files


def test_tasks_write_the_files(spark, tmp_path):
    """One file for each name, without folders that would have to be moved one by one; rows that come twice are lines of it."""
    keys = [*range(300), 7]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey BIGINT").write.parquet(f"{tmp_path}/supplier.parquet")
    root = Path(files.supplier_files(spark, str(tmp_path)).removeprefix("file:"))
    found = list(root.iterdir())
    assert len(found) == 300 and all(p.is_file() for p in found)
    assert (root / "S70826_bus_1.csv").read_text().count("CustomerID") == 2
    names = discover_files(spark, str(root))
    assert names.count() == 300 and names.filter("Problem IS NULL").count() == sum(k % 13 < 12 for k in range(300))
