"""Written intermediate tables in the folder that all executors share.

A written table cuts lineage: what has been written survives the loss of any
executor, and rows are read again exactly as they were the first time.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where that is unset and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="codeweft-")
    return _OWN[app]


def workers_import_package(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver found it by its own sys.path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{have}:{root}".strip(":")


def sheltered(df: DataFrame, used: tuple[str, ...]):
    """``df`` with all columns but ``used`` under names that clash with nothing, and what gives the names back."""
    names = {c: c if c in used else f"_own{i}" for i, c in enumerate(df.columns)}

    def restored(out: DataFrame) -> DataFrame:
        return out.select(*[out[new].alias(old) for old, new in names.items()])

    return df.select(*[df[f"`{old}`"].alias(new) for old, new in names.items()]), restored


@contextlib.contextmanager
def steady(spark: SparkSession):
    """Many short steps in a row: plans are made once and nothing is broadcast, which spares the driver threads and memory.

    Skew isn't mended while it lasts, so joins on keys that may be hot must be salted.
    """
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Workspace:
    """A folder of one job's intermediate tables; removed when the driver exits."""

    def __init__(self, spark: SparkSession, name: str):
        workers_import_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/codeweft-{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as read from there."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._codeweft_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            self._delete(df._codeweft_path)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
