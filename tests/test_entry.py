import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("leftover", [False, True])
def test_entry_works_without_the_training_operators(tmp_path, leftover):
    """The package imports, and its other queries are there, when that subpackage is gone."""
    for name in ("lectern", "__spark_entry__.py"):
        os.system(f"cp -r {ROOT}/{name} {tmp_path}/")
    os.system(f"rm -rf {tmp_path}/lectern/llm")
    if leftover:
        os.makedirs(f"{tmp_path}/lectern/llm/__pycache__")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'validation_report' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_the_training_operators():
    for folder, _, files in os.walk(f"{ROOT}/lectern"):
        if f"{os.sep}llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "lectern.llm" not in open(os.path.join(folder, f)).read()
