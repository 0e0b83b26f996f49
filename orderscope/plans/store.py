"""Written tables in the shared folder: plain ones and published ones.

A plain one cuts the lineage of a table that is read many times: a lost executor
re-reads files.  A published one is made once per name and found again by a marker
that is written last, so a job that dies leaves an unnamed folder that nothing reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, file_system


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in a fresh shared folder, and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find(spark: SparkSession, base: str) -> str | None:
    """The data folder that ``base`` names as complete, if any."""
    fs, marker = file_system(spark, f"{base}/PUBLISHED")
    if not fs.exists(marker):
        return None
    return f"{base}/{spark.read.text(f'{base}/PUBLISHED').first()[0]}"


def publish(spark: SparkSession, base: str, write: Callable[[str], None]) -> str:
    """The complete data folder of ``base``; if there is none, ``write`` fills a new one
    and a marker, written aside and then renamed, names it.  Of two jobs that do so at
    once, the marker of one stays, and both read that one's folder."""
    done = find(spark, base)
    if done:
        return done
    name = f"data-{uuid.uuid4().hex}"
    write(f"{base}/{name}")
    fs, aside = file_system(spark, f"{base}/{name}.marker")
    out = fs.create(aside, True)
    out.write(bytearray(name.encode()))
    out.close()
    renamed = fs.rename(aside, file_system(spark, f"{base}/PUBLISHED")[1])
    done = find(spark, base)
    if not done:
        raise RuntimeError(f"cannot publish {base} (rename: {renamed})")
    return done
