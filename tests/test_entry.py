"""The entry module without the training-data operators: in copies of the repository that lack them in part or whole."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import json, warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def known(at):
    out = subprocess.run([sys.executable, "-c", SAY], cwd=at, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at), "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.returncode == 0, out.stderr
    return [set(x) for x in json.loads(out.stdout)]


@pytest.mark.parametrize("gone", [["sparquill/llm", "tests/llm", "corpus_pipeline.py"], ["sparquill/llm", "tests/llm"], []])
def test_entry_without_the_operators(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "tests"))
    for name in gone:
        x = at / name
        shutil.rmtree(x, ignore_errors=True) if x.is_dir() else x.unlink(missing_ok=True)
    if not gone:  # a third-party module is missing instead
        (at / "ahocorasick.py").write_text("raise ImportError('not here')")
    names, sql = known(at)
    assert {"bm25_topk", "index_topk"} <= names and not [n for n in names if n.startswith("op") or n == "pipeline"] and sql <= names
