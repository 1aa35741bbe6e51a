from __future__ import annotations

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from tidewatch import configure
from tidewatch.operators import forest, order_stats
from tidewatch.operators.forest import ForestDetector
from tidewatch.operators.split import fit_split

spark = configure(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                  .config("spark.sql.shuffle.partitions", "2").getOrCreate())
rows = spark.range(60).select(F.lit("s").alias("s"), "id", F.col("id").cast("double").alias("value"))
detector = ForestDetector()
for sortable, shipped in ((100, 64), (10, 64), (10, 0)):
    order_stats.SORTABLE_ROWS, forest.BROADCAST_SERIES = sortable, shipped
    assert detector.fit_and_score(fit_split(rows, ["s"], ["id"]))[0].count() == 60
print("scored")
"""


def test_executors_do_not_need_the_package(tmp_path):
    """Workers started in another folder cannot import the package."""
    program = PROGRAM.format(root=str(Path(__file__).resolve().parents[1]))
    done = subprocess.run(
        [sys.executable, "-c", program], cwd=tmp_path, capture_output=True, text=True, timeout=240
    )
    assert "scored" in done.stdout, done.stderr[-2000:]
