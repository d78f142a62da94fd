"""The six outputs as CSV files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from monthmatch.fixed_values import FILE_PLACE, OUTPUT_TITLES, PREVIEW_ROWS
from monthmatch.operators.outputs import output_parts, outputs, report_headings
from monthmatch.operators.summary import metric_counts


#: Text exactly as it is: blanks stay empty, padding stays, quotes are doubled.
_CSV = {
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_ROWS_OF_A_TASK = 1 << 33


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with headings; it must not be there yet."""
    df.write.mode("errorifexists").options(header=True, **_CSV).csv(path)


def _line(columns: Sequence[Column]) -> Column:
    # Names are not part of a line, and those of an output may differ only in case.
    return F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), _CSV)


def _write_lines(tagged: DataFrame, root: str, titles: Mapping[str, str]) -> None:
    """All outputs in one scan: every row becomes its lines, each in the folder of its output.

    A part file begins with the headings, as the first row of a task brings
    them along. The parts are written below one folder and their folders
    renamed at the end, so that an export that fails leaves no output that
    looks whole.
    """
    spark, parts = tagged.sparkSession, output_parts(tagged)
    files = spark._jvm.org.apache.hadoop.fs
    at = {name: files.Path(f"{root.rstrip('/')}/{title}") for name, title in titles.items()}
    system = files.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [path.toString() for path in at.values() if system.exists(path)]
    if taken:
        raise FileExistsError(", ".join(taken))

    def entry(number: int, kind: int, columns: Sequence[Column]) -> Column:
        return F.struct(F.lit(number).alias("Output"), F.lit(kind).alias("kind"), _line(columns).alias("value"))

    names = {name: report_headings(tagged.select(*columns)) for name, (_, columns) in parts.items()}
    headings = F.array(*[entry(k, 0, [F.lit(c) for c in names[n]]) for k, n in enumerate(parts)])
    rows = [F.when(chosen, entry(k, 1, columns)) for k, (chosen, columns) in enumerate(parts.values())]
    lines = F.filter(F.array(*rows), lambda line: line.isNotNull())
    # A row's number in the table tells which is the first of its task, and keeps the order of rows.
    numbered = tagged.withColumn("__row", F.monotonically_increasing_id())
    first = F.col("__row") % _ROWS_OF_A_TASK == 0
    told = numbered.select("__row", F.explode(F.concat(F.when(first, headings).otherwise(F.array()), lines)).alias("line"))
    folder = f"{root.rstrip('/')}/_outputs-{uuid.uuid4().hex}"

    def write(rows: DataFrame) -> None:
        rows = rows.select("__row", "line.*").sortWithinPartitions("Output", "kind", "__row")
        rows.select("Output", "value").write.mode("append").partitionBy("Output").text(folder)

    write(told)
    if not system.exists(files.Path(f"{folder}/Output=0")):
        # Without any row there are the headings alone.
        write(spark.range(0, 1, 1, 1).select(F.col("id").alias("__row"), F.explode(headings).alias("line")))
    for number, name in enumerate(parts):
        if not system.rename(files.Path(f"{folder}/Output={number}"), at[name]):
            raise OSError(f"{folder}/Output={number} can not be renamed to {at[name].toString()}")
    system.delete(files.Path(folder), True)


def write_outputs(tagged: DataFrame, root: str) -> None:
    """One folder of CSV parts per output, named after it, from one scan of the rows."""
    _write_lines(tagged, root, {name: name for name in OUTPUT_TITLES})


def write_bundle(tagged: DataFrame, root: str) -> None:
    """A summary and the six outputs side by side, under their titles.

    The summary is observed while the outputs are written.
    """
    seen = Observation()
    _write_lines(tagged.observe(seen, *metric_counts()), root, OUTPUT_TITLES)
    counts = [(name, int(n)) for name, n in seen.get.items()]
    rows = tagged.sparkSession.createDataFrame(counts, "Metric STRING, Count BIGINT").coalesce(1)
    write_csv(rows, f"{root}/Summary")


def preview(
    tagged: DataFrame, name: str, rows: int = PREVIEW_ROWS, order: Sequence[str] | None = None
) -> DataFrame:
    """The first rows of one output, in file order.

    ``order`` names the columns of that order; by default those of a registry
    batch, or ``RowOrder``.
    """
    known = order or [c for c in (FILE_PLACE, "RowOrder") if c in tagged.columns]
    return outputs(tagged.orderBy(*known))[name].limit(rows)
