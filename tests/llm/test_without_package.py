import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The package is on the driver's path only: workers start in another folder, without it.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
assert spark.range(2).rdd.map(lambda _: __import__("importlib.util").util.find_spec("wearline") is None).collect() == [True, True]
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
for name in {names!r}:
    rows = contract.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert rows > 0, name
print("all ran")
"""
NAMES = [
    "op6_lattice_lm",
    "op8_quality_classifier",
    "op10_weighted_minhash",
    "op11_periodic_runs",
    "op12_dominance_packing",
    "op13_automaton_search",
]


def test_executors_need_no_package(tmp_path):
    found = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=REPO, names=NAMES)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=found, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
