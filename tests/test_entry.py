"""The entry stands without the optional subpackage, with or without the pipeline's file."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_training_data(tmp_path, with_pipeline):
    leave = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "studyloom", tmp_path / "studyloom", ignore=leave)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    say = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(x.startswith('op1') for x in q))"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 100 and int(out[1]) > 100 and out[2:] == ["False", "False"]
