"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that every plan of this package is written for; a cluster may override any of them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, then `conf` (dots written as they are, given as a dict by ``**``)."""
    builder = SparkSession.builder.appName(name).config(map={**DEFAULTS, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


_runs: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session, else the context's checkpoint
    folder. Where neither is set, a temporary one is made and registered if everything runs on one machine; on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (set_dir := sc._jsc.sc().getCheckpointDir()).isDefined():
        base = set_dir.get()
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(base)
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may be gone; the folder belongs to the cluster then
        pass


def run_folder(spark: SparkSession) -> str:
    """A folder of this driver's own within the shared one; it is removed when the driver ends, or by `release`."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_folder(spark)}/tidemark-{app}"
        atexit.register(_remove, spark, _runs[app])
    return _runs[app]


def release(spark: SparkSession) -> None:
    """Removes all tables that this driver has written so far. To be called when no DataFrame that rests on them is needed any more, such as between queries."""
    if spark.sparkContext.applicationId in _runs:
        _remove(spark, run_folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back: lineage ends there, a lost executor costs
    no recomputation, and later reads prune columns. See `release`."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that Python workers can import it wherever it lies."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)
