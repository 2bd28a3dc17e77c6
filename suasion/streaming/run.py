"""Running a stream over what is there now, and reading back what it wrote."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import namedtuple
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


#: RocksDB holds the state of keyed processors, so a state larger than an executor's memory is no matter.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def in_order(frames: Iterable[pd.DataFrame]) -> list[tuple]:
    """The rows of a key's frames as named tuples of plain values, by (ts_ms, seq); keys have few rows each, for which pandas' own sorting is dear."""
    rows: list[tuple] = []
    for f in frames:
        columns = [c for c in f.columns if c != "ts"]
        rows += map(namedtuple("Row", columns), *(f[c].tolist() for c in columns))  # noqa: PYI024
    return sorted(rows, key=lambda r: (r.ts_ms, r.seq != r.seq, r.seq))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is started meanwhile; as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see: the session's checkpoint folder. Where none is set a local one does for one JVM; on a cluster that is an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(rows: DataFrame, name: str = "stored") -> DataFrame:
    """The rows, written to the shared folder and read back: worked out once, and read by column."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drain(stream: DataFrame, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """Everything that the stream emits for the input that is there now, run with the settings ``conf``.

    Sink and offsets lie in the shared folder, so a lost driver or executor can go on from the last batch.
    """
    spark = stream.sparkSession
    home = new_folder(spark, "stream")
    with settings(spark, conf or {}):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{home}/out").option("checkpointLocation", f"{home}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")
