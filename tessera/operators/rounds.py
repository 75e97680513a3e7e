"""Tables that an iterative job writes between its rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and all tasks run in this machine.
LOCAL = "/tmp/checkpoints"


class Rounds:
    """Writes tables into the shared folder and reads them back, so a lost executor costs a re-read.

    A written table carries neither a plan nor its constraints into the next round, unlike
    a checkpointed one, whose inferred constraints multiply from round to round.
    ``cleared`` removes the tables no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        self.spark, self.written = spark, []
        self.folder = f"{(named or LOCAL).rstrip('/')}/rounds-{label}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.written)}"
        df.write.parquet(path)
        self.written.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cleared(self, *kept: DataFrame) -> None:
        """Remove all tables but those that ``kept`` read."""
        still = {path for df in kept for path in self.written if any(f"{path}/" in name for name in df.inputFiles())}
        for path in [p for p in self.written if p not in still]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
