import os
import subprocess
import sys

import pytest

from nestql.sources.scratch import scratch_path, scratch_root

CODE = """
import sys
from pyspark.sql import SparkSession
from nestql.sources.scratch import scratch_path
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
path = scratch_path(spark, "x")
spark.range(3).write.parquet(path)
print("PATH", path, spark.read.parquet(path).count())
"""


def test_scratch_goes_with_its_driver(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": top}).stdout
    _, path, n = out[out.index("PATH") :].split()
    assert path.startswith(str(tmp_path)) and n == "3"
    assert os.listdir(tmp_path) == [] or all(not d.startswith("nestql") for d in os.listdir(tmp_path))


def test_clusters_must_name_a_shared_folder(spark):
    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": lambda self: self, "getCheckpointDir": lambda self: self, "isDefined": lambda self: False})()})

    with pytest.raises(RuntimeError):
        scratch_root(Unset)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
