"""Session helpers: shared checkpoints and shipping of this package to Python workers."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it on its own path only."""
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in on_path or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    with tempfile.TemporaryDirectory() as tmp:
        for name in [p.name for p in ROOT.iterdir() if p.name == "spreadrank" or p.suffix == ".py"]:
            src, dst = ROOT / name, Path(tmp, "all", name)
            if src.is_dir():
                shutil.copytree(src, dst, ignore=shutil.ignore_patterns("__pycache__"))
            else:
                dst.parent.mkdir(exist_ok=True)
                shutil.copy(src, dst)
        keep = tempfile.mkdtemp(prefix="spreadrank-")
        sc.addPyFile(shutil.make_archive(f"{keep}/spreadrank_code", "zip", f"{tmp}/all"))
    if str(ROOT) not in sys.path:
        sys.path.append(str(ROOT))
