"""Stage tables: what a pipeline has finished is written and read again, and skipped when it is there already and was made in the same way.

A stage stores a fingerprint of what it was made of: the files that it reads with their sizes and times, its plan (with the constants in it), the parameters given to ``Stages``, the version of this
code, and the stages before it. A stage whose fingerprint differs is made anew, and so are those after it.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, deleted when the session's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset a temporary one, on a local master alone."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not told and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(told or until_exit(spark, tempfile.mkdtemp(prefix="eluent-")))
    return told or sc._jsc.sc().getCheckpointDir().get()


#: To be raised when a stage gives other rows for the same plan, as when a function behind a UDF changes.
VERSION = 3


class Stages:
    """Tables below ``path``; without one, below a fresh folder in the shared one, removed when the session's JVM ends. ``parameters``: what
    the plans don't show."""

    def __init__(self, spark: SparkSession, path: str | None = None, parameters: dict | None = None):
        self.spark, self.own = spark, path is None
        self.path = path or f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
        self.chain = hashlib.sha256(json.dumps([VERSION, parameters or {}], sort_keys=True, default=str).encode()).hexdigest()
        self.before: dict[str, str] = {}
        if self.own:
            until_exit(spark, self.path)

    def _where(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self, name: str):
        return self._where(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def below(self, name: str) -> Stages:
        """Stages of a part of the work, in a folder of their own, after those that are there so far."""
        part = Stages(self.spark, f"{self.path}/{name}")
        part.own, part.chain = self.own, self.chain
        return part

    def exists(self, path: str) -> bool:
        """Whether a file or folder is there, wherever its path leads."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def fingerprint(self, name: str, df: DataFrame) -> str:
        """Names that Spark gives to columns and plans in passing don't count, nor do the files of stages: the stages before are in the chain."""
        plan = re.sub(r"#\d+L?|plan_id=\d+|\[id=\d+\]", "", df._jdf.queryExecution().analyzed().toString())
        read, jvm = [], self.spark.sparkContext._jvm
        for f in sorted(df.inputFiles()):  # of one study
            if f"/{self.path.strip('/')}/" in f or f.startswith(f"{self.path}/"):
                continue
            where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
            status = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
            read.append((f, status.getLen(), status.getModificationTime()))
        return hashlib.sha256(json.dumps([self.before.setdefault(name, self.chain), name, plan.replace(self.path, ""), read]).encode()).hexdigest()

    def _mark(self, name: str):
        return self._where(f"{name}/_fingerprint")

    def _stored(self, name: str) -> str | None:
        if not self._fs(name).exists(self._mark(name)):
            return None
        stream = self._fs(name).open(self._mark(name))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.chain = self.fingerprint(name, df)
        if self._stored(name) != self.chain:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
            stream = self._fs(name).create(self._mark(name), True)  # after all rows are there
            stream.writeUTF(self.chain)
            stream.close()
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
