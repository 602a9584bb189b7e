"""Queries with Python in their plans run where workers can't import this package: its functions go to them by value."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://{tmp}/shared").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from stowage.plans import queries, field_queries  # noqa: F401

@F.udf("boolean")
def importable(x):
    import importlib.util
    return importlib.util.find_spec("stowage") is not None

assert spark.range(2).select(importable("id").alias("x")).where("x").count() == 0, "workers can import the package"
ran = []
for name in {names!r} or sorted(queries.QUERIES):
    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    if {names!r} or any(word in plan for word in ("Python", "Arrow", "Pandas")):
        frame.write.format("noop").mode("overwrite").save()
        ran.append(name)
print("RAN", *ran)
"""


def test_python_goes_to_workers_by_value(tmp_path):
    names = ["normalize_text", "match_cascade", "align_words", "lineage_batch", "stream_lineage", "stream_completeness", "cached_releases", "foreign_catalogs", "folder_events", "token_jaccard_join"]
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, tmp=tmp_path, names=names)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split("RAN")[1].split() == names
