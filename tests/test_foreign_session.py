"""A job submitted from another directory: workers cannot import this package."""

import subprocess
import sys
import textwrap

SCRIPT = textwrap.dedent("""
    import importlib.util
    from pyspark.sql import SparkSession
    spec = importlib.util.spec_from_file_location("__spark_entry__", "ENTRY")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    for name in ("chunk_documents", "hashed_embedding", "dense_topk_filtered", "bm25_topk", "ivf_topk"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
    print("all ran")
""")


def test_queries_run_from_another_directory(tmp_path):
    import __spark_entry__

    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.replace("ENTRY", __spark_entry__.__file__)],
        cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
