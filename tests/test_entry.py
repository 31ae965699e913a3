"""What the driver imports works with and without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_alone(tmp_path):
    """Without the llm folders and the pipeline the queries of the engine are still there, and so they are if the pipeline alone is left."""
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    ask = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e, bench; q = e.queries(); assert 'chunk_kind_counts' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    for left in (True, False):
        if not left:
            (tmp_path / "copy/corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
        assert done.returncode == 0, done.stderr
