"""The entry without the corpus subpackage, in a copy of the repository."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("without", [("quireline/llm", "tests/llm"), ("quireline/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in without:
        place = copy / name
        if place.is_dir():
            shutil.rmtree(place)
        else:
            place.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'doc_outline' in q and set(s) <= set(q); print(sum(n[:2] == 'op' and n[2].isdigit() for n in q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    has_llm = (copy / "quireline/llm").is_dir()
    assert done.stdout.split() == ["10" if has_llm else "0", "False"]
