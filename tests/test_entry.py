"""The entry points without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import __spark_entry__ as entry
from geopulse.session import build_session

names = entry.queries()
assert names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(entry.oracle_sql()) <= set(names)
spark = build_session("entry", "local[2]", 2, spark__ui__enabled="false")
spark.sparkContext.setLogLevel("OFF")
assert entry.entry(spark).count() > 0
"""


def copy_without(target, left_out):
    def skip(folder, names):
        rest = os.path.relpath(folder, ROOT)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(f"{rest}/{n}") in left_out]

    shutil.copytree(ROOT, target, ignore=skip)


def run(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_entry_without_operators(tmp_path):
    copy_without(tmp_path / "all", {"geopulse/llm", "tests/llm", "corpus_pipeline.py"})
    done = run(tmp_path / "all")
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_without_operators_but_with_the_pipeline(tmp_path):
    copy_without(tmp_path / "some", {"geopulse/llm", "tests/llm"})
    done = run(tmp_path / "some")
    assert done.returncode == 0, done.stderr[-2000:]
