"""Indexes that queries of one session share, in the folder that all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..operators.index import Index, IndexConfig, build_index, load, save, save_variant

_local: dict[str, str] = {}
_made: dict[tuple, tuple[SparkSession, str]] = {}
_full: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _local:
            _local[key] = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        found = _local[key]
    return found.rstrip("/")


def index_of(spark: SparkSession, path: str, config: IndexConfig = IndexConfig(), id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The saved index of a Parquet table, built when the session first asks for it; one of the same terms as another shares the other's tables."""
    key = (spark.sparkContext.applicationId, path, config, id_col, text_col)
    if key not in _made:
        at = f"{shared_dir(spark)}/quern-index-{uuid.uuid4().hex}"
        same = (spark.sparkContext.applicationId, path, config.terms, id_col, text_col)
        if same in _full:
            save_variant(load(spark, _full[same]), _full[same], config, at)
        else:
            save(build_index(spark.read.parquet(path), config, id_col=id_col, text_col=text_col), at)
            _full[same] = at
        _made[key] = (spark, at)
    return load(spark, _made[key][1])


@atexit.register
def _clean() -> None:
    for spark, path in _made.values():
        try:
            if not spark._jsc.sc().isStopped():
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S110  the JVM may be gone already
            pass
