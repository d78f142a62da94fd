"""First lines of many files."""

from monthmatch.sources.submissions import read_headers


def test_small_files_share_tasks(spark, tmp_path):
    """Also of files with many lines, with none, and of one that is too large to be read whole."""
    want = {}
    for i in range(60):
        lines = [f"head {i},x", *["a,b"] * (i % 3 * 20_000)]
        (tmp_path / f"{i}.csv").write_text("".join(f"{line}\n" for line in lines))
        want[f"{i}.csv"] = lines[0]
    (tmp_path / "empty.csv").touch()
    (tmp_path / "blank.csv").write_text("\nhead\n")
    (tmp_path / "large.csv").write_text("head,large\n" + "a,b\n" * 400_000)
    want |= {"blank.csv": "", "large.csv": "head,large"}
    for files in ([str(p) for p in tmp_path.iterdir()], str(tmp_path)):
        found = read_headers(spark, files)
        assert found.rdd.getNumPartitions() <= 10
        rows = found.collect()
        assert len(rows) == len(want) and {r["uri"].rsplit("/", 1)[1]: r["header"] for r in rows} == want
