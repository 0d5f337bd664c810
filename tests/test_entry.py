import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_query_with_sql_is_registered():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and all(map(callable, queries.values()))


def test_entry_without_the_optional_parts(tmp_path):
    """With the training-data operators away, and corpus_pipeline.py with or without them, all else is still there."""
    shutil.copytree(ROOT / "loomlake", tmp_path / "loomlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); print(len(q))"
    for with_pipeline in (False, True):
        if with_pipeline:
            if importlib.util.find_spec("corpus_pipeline") is None:
                continue
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        env = os.environ | {"PYTHONPATH": str(tmp_path)}
        got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert got.returncode == 0, got.stderr
        assert int(got.stdout) >= 50
