"""Operators where executors have this package's dependencies, but not the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
    .config("spark.checkpoint.dir", "checkpoints").config("spark.sql.warehouse.dir", "warehouse").getOrCreate()
)

def known(_):
    try:
        import tablegauge
        yield "found"
    except ModuleNotFoundError:
        yield "absent"

assert set(spark.sparkContext.parallelize(range(4)).mapPartitions(known).collect()) == {{"absent"}}
from tablegauge.llm.registry import queries
for name in sys.argv[1:]:
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    print("ran", name)
"""
QUERIES = (
    "op1_language op2_exact_dedup op3_secrets op4_toxicity op5_simhash op6_token_counts op7_mixing op8_packing"
    " op9_quality op10_warc op11_alignment op12_prefix_trie op13_licenses pipeline"
).split()


def test_workers_need_no_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, str(script), *QUERIES], cwd=tmp_path, env=env, capture_output=True, text=True)
    ran = [line.split()[1] for line in found.stdout.splitlines() if line.startswith("ran ")]
    if ran != QUERIES:
        pytest.fail(f"ran {ran}; {found.stderr[-3000:]}")
