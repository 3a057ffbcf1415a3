"""Tables written once to the shared folder: they cut the lineage and survive the loss of an executor.  They go when the driver ends."""

from __future__ import annotations

import atexit
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()
_run = uuid.uuid4().hex[:8]


_roots: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` (a local folder only on a single machine)."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _roots[app] = f"{(base or '/tmp/checkpoints').rstrip('/')}/retrieval-{app}-{_run}"
        atexit.register(_remove, spark, _roots[app])
    return f"{_roots[app]}/{name}-{next(_serial)}"


def _remove(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` read back from a table below ``folder``."""
    path = folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
