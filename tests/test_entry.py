"""The driver's entry with and without the parts that may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without", [("semloom/llm",), ("semloom/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, without):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "semloom", tmp_path / "semloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in without:
        gone = tmp_path / name
        if gone.is_dir():
            shutil.rmtree(gone)
        else:
            gone.unlink(missing_ok=True)
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True).stdout.split()
    assert int(out[0]) >= int(out[1]) > 90 and out[2] == "False"


def test_a_broken_part_is_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "semloom", tmp_path / "semloom", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_library" in done.stderr
