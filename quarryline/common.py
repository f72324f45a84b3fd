"""Helpers shared by all operators: reading tables, shared scratch space, current rows."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table `table` of `folder`, as stored."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Only a local session may go without that setting: it gets a folder of its own. A cluster
    session without it is an error, as a machine-local folder would be lost with its machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = _LOCAL.get(spark.sparkContext.applicationId)
    if own is None:
        folder = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = _LOCAL[spark.sparkContext.applicationId] = Path(folder).as_uri()
    return own


_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, not yet written. What an application wrote there is deleted when its
    driver ends."""
    own = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    if own not in _TO_DROP:
        _TO_DROP.add(own)
        atexit.register(_drop_at_exit, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


_TO_DROP: set[str] = set()


def _drop_at_exit(spark: SparkSession, own: str) -> None:
    if "://" not in own or own.startswith("file:"):
        shutil.rmtree(re.sub(r"^file:/+", "/", own), ignore_errors=True)
        return
    try:
        drop_scratch(spark)
    except Exception:  # noqa: BLE001
        pass  # the session has ended already; the folder is named after its application


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: `df` written to the shared folder as Parquet and read back with its schema."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SmallFiles:
    """Small JSON files below `root` through the cluster's file system. Each is replaced or created by one rename,
    so a reader never sees half of one."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, folder: str = "") -> list[str]:
        """Names in a folder; none if there is no such folder."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> dict:
        """What a file holds; nothing if there is none."""
        if not self.exists(name):
            return {}
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict, replace: bool = True) -> bool:
        """False, and nothing written, if the file is there already and isn't to be replaced."""
        folder, _, own = name.rpartition("/")
        tmp = self.path(f"{folder}/.{own}-{uuid.uuid4().hex}" if folder else f".{own}-{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(json.dumps(value).encode())
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(tmp, self.path(name), options)
        except Py4JJavaError as e:
            self.fs.delete(tmp, True)
            if replace or "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results read from there end with it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def current_rows(files: DataFrame, values: list[Column], key: str = "id", newest: str = "changed_ns") -> DataFrame:
    """One row for each `key`: `values` of the row with the greatest `newest`.

    Equal `newest` are taken to be exact repeats; should they differ, the greatest struct of `values`
    wins, so the result never depends on the order of rows. A null `newest` loses to any other. Rows
    without a key are no entries and are left out. The aggregate combines before the shuffle, so an
    id with very many observations costs one row a map task.
    """
    picked = files.where(F.col(key).isNotNull()).select(F.col(key), F.struct(F.col(newest).alias("_at"), *values).alias("_row"))
    return picked.groupBy(key).agg(F.max("_row").alias("_row")).select(key, "_row.*").drop("_at")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Operators of a plan whose rows stay in the partitions they were read in.
_IN_PLACE, _READ = {"Project", "Filter", "Generate"}, {"LogicalRelation", "LogicalRDD"}


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as the cluster runs tasks: for work whose cost lies in Python, not
    in reading. Input in enough splits stays where it is and isn't shuffled, nor is what comes out of a join
    or an aggregate, whose partitions aren't known before it runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        if plan.nodeName() not in _IN_PLACE:
            return df
        plan = plan.children().apply(0)
    if plan.nodeName() not in _READ:
        return df
    parts, slots = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if 0 < parts < slots else df
