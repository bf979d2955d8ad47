"""Session helpers for local runs and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "phasegrid") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


#: Folder of each running application, by its id and root.
_FOLDERS: dict[tuple[str, str | None], str] = {}


def _own_folder(spark: SparkSession) -> str:
    """One folder for all that an application stores; the driver's file system removes it when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    name = (spark.sparkContext.applicationId, root)
    if name not in _FOLDERS:
        if not root:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="phasegrid-")
        path = f"{root.rstrip('/')}/phasegrid-{name[0]}-{uuid.uuid4().hex[:8]}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _FOLDERS[name] = path
    return _FOLDERS[name]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach, within the application's own.

    The cluster names the root in ``spark.checkpoint.dir``. A machine-local root is made only for
    a local master, where driver and executors are one process.
    """
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
