"""The entry points without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]

SHOWN = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def _names(folder: Path) -> list[str]:
    env = {**os.environ, "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run(
        [sys.executable, "-c", SHOWN], cwd=folder, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr
    return done.stdout.splitlines()


def _copy(folder: Path, without: tuple[str, ...]) -> Path:
    def left_out(at: str, names: list[str]) -> set[str]:
        here = Path(at).relative_to(ROOT)
        return {n for n in names if str(here / n) in without or n in (".git", "__pycache__")}

    shutil.copytree(ROOT, folder, ignore=left_out)
    return folder


def test_entry_without_the_corpus_operators(tmp_path):
    without = _copy(tmp_path / "neither", ("monthmatch/llm", "tests/llm", "corpus_pipeline.py"))
    names, oracles = _names(without)
    assert "'reconcile'" in names and "'reconcile'" in oracles
    assert "op1_" not in names and "pipeline" not in names
    # The pipeline's file may still be there: it is not imported without its operators.
    left = _copy(tmp_path / "pipeline", ("monthmatch/llm", "tests/llm"))
    assert _names(left) == [names, oracles]
