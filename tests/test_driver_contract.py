"""The driver loads __spark_entry__.py by path from its own working directory:
executors must not need quiver importable (kernels are pickled by value)."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_kernels_from_foreign_cwd(tmp_path):
    script = textwrap.dedent(f"""
        import importlib.util
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("entry_mod", "{ROOT}/__spark_entry__.py")
        m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        q = m.queries()
        n = [len(m.entry(spark).collect())]
        for name in ("ivf_search", "pq_search", "fbin_io", "knn_post"):
            n.append(q[name](spark, "/root/testdata/sf0.001").count())
        print("COUNTS", n)
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("COUNTS")]
    assert line, out.stderr[-3000:]
    assert all(int(c) > 0 for c in line[0][len("COUNTS ["):-1].split(","))
