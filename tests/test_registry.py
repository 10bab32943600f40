"""The registry where the training-data operators are not installed."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as r; q, s = r.queries(), r.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_registry_and_tests_without_training_data_operators(tmp_path, also):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in ("quarry/llm", "tests/llm"):
        shutil.rmtree(copy / name, ignore_errors=True)
    for name in also:
        (copy / name).unlink(missing_ok=True)
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT]  # libraries may lie on it
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *others]), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, op1 = out.stdout.split()
    assert int(n) > 60 and (pipeline, op1) == ("False", "False")
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout + found.stderr
