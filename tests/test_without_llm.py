"""The library works without the training-data operators, and without the pipeline too."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["ferrule/llm"], ["ferrule/llm", "corpus_pipeline.py"]])
def test_entry_in_a_copy(tmp_path, gone):
    shutil.copytree(os.path.join(ROOT, "ferrule"), tmp_path / "ferrule", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'sssp_min' in q and 'sssp_min' in o; assert not [x for x in q if x.startswith('op') or x == 'pipeline']"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
