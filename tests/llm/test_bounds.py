"""What comes to the driver or into one task stays within its bound."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmatch.llm import quality
from monthmatch.llm.embedding_dedup import MultiIndex
from monthmatch.llm.quality import learn, score_quality
from monthmatch.llm.warc_zip import read_archives, write_archives


def test_an_id_that_many_rows_repeat_counts_once(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: taken.append((len(p), len(u), p, u)))
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    others = spark.range(400).select("id", F.concat(F.lit("other "), "id").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    learn(docs.unionByName(others.withColumnRenamed("id", "doc_id")), labels, sample=300)
    (p, u, rows_p, rows_u), = taken
    assert (p, u) == (300, 300)
    # The same whatever the order of the rows.
    taken.clear()
    learn(others.withColumnRenamed("id", "doc_id").unionByName(docs).repartition(7), labels, sample=300)
    assert np.array_equal(taken[0][2], rows_p) and np.array_equal(taken[0][3], rows_u)


def test_held_out_labels_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = score_quality(docs, labels).filter("held_out").join(labels, "doc_id").filter("quality IS NOT NULL")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 500 and right > 0.98


def test_a_task_reads_a_package(spark, tmp_path):
    rows = [(k, f"u{k}", f"page {k} " * 50) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    packages = write_archives(df.coalesce(1), f"file://{tmp_path}", package_bytes=500)
    read = read_archives(packages).withColumn("task", F.spark_partition_id())
    n = packages.count()
    assert n > 8 and read.count() == 60
    # Borders between packages are as good as the sample of their paths.
    assert read.agg(F.count_distinct("task")).first()[0] >= 0.8 * n
    assert read_archives(packages.limit(0)).count() == 0


@pytest.mark.parametrize("dimensions", [64, 1024])
def test_moves_hold_no_cube(dimensions):
    rng = np.random.default_rng(1)
    books = rng.normal(size=(2, 256, dimensions // 2))
    x = rng.normal(size=(2048, dimensions))
    index = MultiIndex((books[0], books[1]), 1.0)
    tracemalloc.start()
    nearest, moves = index.moves(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    for half, book, at, move in zip((x[:, : dimensions // 2], x[:, dimensions // 2 :]), books, nearest, moves, strict=True):
        for r in range(0, 2048, 397):
            d = ((half[r] - book) ** 2).sum(1)
            gap = np.sqrt(((book[at[r]] - book) ** 2).sum(1))
            gap[at[r]] = 1
            assert at[r] == d.argmin() and np.allclose(move[r], ((d - d.min()) / (2 * gap)) ** 2)
