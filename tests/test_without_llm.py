"""The rest of the library works without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
found = e.queries()
assert len(found) > 150 and set(e.oracle_sql()) <= set(found)
assert not any(k.startswith("op") or k == "pipeline" for k in found)
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.entry(spark).columns[0] == "model"
"""


def run(folder):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "vagari", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "vagari" / "llm", ignore_errors=True)
    run(tmp_path)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    run(tmp_path)
