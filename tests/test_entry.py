import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from chronomesh.plans.registry import queries

TOP = Path(__file__).parent.parent
SAY = "import __spark_entry__ as e; import bench; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def copy(to: Path) -> Path:
    shutil.copytree(TOP, to, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    return to


def said(top: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", SAY], cwd=top, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_operators_on_training_data(tmp_path, pipeline):
    """Both folders gone, with the pipeline's file or without it: all other queries are there."""
    top = copy(tmp_path / "repo")
    shutil.rmtree(top / "chronomesh/llm", ignore_errors=True)
    shutil.rmtree(top / "tests/llm", ignore_errors=True)
    if not pipeline:
        (top / "corpus_pipeline.py").unlink(missing_ok=True)
    n, sql, found = said(top)
    assert int(n) == len(queries()) and 0 < int(sql) <= int(n) and found == "False"


def test_a_broken_import_is_an_error(tmp_path):
    top = copy(tmp_path / "repo")
    own = top / "chronomesh/llm/registry.py"
    if own.exists():
        own.write_text("import no_such_module\n")
        with pytest.raises(subprocess.CalledProcessError):
            said(top)
