"""The driver's entry, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
assert e.__file__.startswith(sys.argv[1])
names = e.queries()
assert len(names) > 60 and not any(n.startswith("op") or n == "pipeline" for n in names) and set(e.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() == 12
for name in ("record_validity", "nodes_in_rect", "csv_size"):
    assert names[name](spark, sys.argv[2]).count() > 0
print("well")
"""


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 12


def test_entry_without_the_training_data_part(tmp_path, sf):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(copy), sf], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=600)
    assert done.stdout.strip().endswith("well"), done.stderr[-3000:]
