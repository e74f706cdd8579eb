"""The corpus queries on executors that do not have the package, and the session's settings after them."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_tasks_need_no_package(tmp_path):
    """Python workers are separate processes that see neither the repository nor the driver's path."""
    script = textwrap.dedent(f"""
        import sys
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).config("spark.sql.session.timeZone", "UTC").getOrCreate()
        spark.range(4).rdd.map(lambda x: x).count()
        sys.path.insert(0, {REPO!r})
        import corpus_pipeline
        from popweave.llm.queries import QUERIES
        def there(batches):
            import importlib.util
            import pyarrow as pa
            found = importlib.util.find_spec("popweave") is not None
            for b in batches:
                yield pa.RecordBatch.from_pydict({{"found": [found]}})
        assert not any(r.found for r in spark.range(4).mapInArrow(there, "found boolean").collect())
        for name in {["op3_toxicity", "op4_decontamination", "op5_lm_scoring", "op6_token_files", "op11_vector_codes", "op12_licenses", "op13_resampling"]!r}:
            print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
        print("pipeline", corpus_pipeline.run(spark, "/root/testdata/sf0.001").count())
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
        print("whole")
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.strip().endswith("whole"), done.stdout[-500:] + done.stderr[-3000:]
