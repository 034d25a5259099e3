"""Session defaults and the one place that knows where lineage may be cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Recording a Python stack for every column makes large expressions slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int = "*", app: str = "talkweave", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.sql.shuffle.partitions", "8")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Every time rule in this library is stated in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    A local session without the setting gets a temporary folder of its own, which
    goes when the program ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _own_folder()
    return folder


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="talkweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a few statements; those before come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


WRITTEN: list[str] = []
KEPT: dict[tuple, object] = {}


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what `cut_lineage` has written in this program; frames built on it can't be read after."""
    KEPT.clear()
    while WRITTEN:
        folder = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared one that nothing else uses; `remove_intermediates` deletes it."""
    path = f"{shared_folder(spark)}/talkweave-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def kept(spark: SparkSession, key: tuple, build: Callable[[str], T]) -> T:
    """What `build` makes in a new folder, once for each key as long as the application runs."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in KEPT:
        KEPT[key] = build(new_folder(spark))
    return KEPT[key]


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder once and read it back.

    A table rather than `checkpoint()`, so that later branches still read only
    the columns they need. It survives the loss of any executor.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
