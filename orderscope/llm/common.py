"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Arrow batches handed to Python stay small: texts can be long, and a worker
#: holds one batch in and one batch out.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


#: Where this package lies, for Python workers on the same machine or mount; on
#: other clusters the package is installed or sent with ``--py-files``.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tune(spark: SparkSession) -> None:
    """Set the Arrow batch bounds the Python stages rely on, and their import path."""
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read whole through Spark's own reader."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage
    is cut, so a lost executor re-reads files and never repeats the work above."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


