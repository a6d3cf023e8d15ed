"""Tables of a dataset directory and the shared folder for intermediate tables."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a dataset directory (a Parquet file or a directory of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of this process's applications, below the shared one.
_FOLDERS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share, ``spark.checkpoint.dir``; it goes when the driver ends.

    Only where everything runs in one process (``local[n]``) and the session names no folder, a temporary one is made and set;
    on a cluster a missing setting is an error, since each executor would write to a disk of its own.
    """
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_KEY} must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(path)
    key = (spark.sparkContext.applicationId, path)
    if key not in _FOLDERS:
        folder = f"{path.rstrip('/')}/sparkloom-{key[0]}"
        target, system = _hadoop(spark, folder)
        system.mkdirs(target)
        system.deleteOnExit(target)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that were not yet read are lost. Automata and the package stay."""
    target, system = _hadoop(spark, f"{shared_dir(spark)}/tables")
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _hadoop(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, system = _hadoop(spark, path)
    system.delete(target, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order."""
    target, system = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    target, system = _hadoop(spark, path)
    source = system.open(target)
    try:
        return bytes(source.readAllBytes())
    finally:
        source.close()


def open_folder(uri: str):
    """(file system, path) by which a Python worker reads a folder of the shared one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_S3.sub("s3://", uri) if "://" in uri or uri.startswith("file:") else str(Path(uri).absolute()))


_S3 = re.compile("^s3[an]://")


def new_table(spark: SparkSession, label: str) -> str:
    """The path of a new intermediate table."""
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_table(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positioned(df: DataFrame) -> DataFrame:
    """``df`` with (pos_file, pos_row), where each row lies in its files; a plan that is no scan is written first. Positions tell
    copies of a row apart, and stay the same when a task is tried again."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    place = lambda d: d.select("*", F.xxhash64("_metadata.file_path").alias("pos_file"), F.col("_metadata.row_index").alias("pos_row"))
    own = df.drop("pos_file", "pos_row")
    try:
        return place(own)
    except AnalysisException:
        return place(materialize(own, "positioned"))


def write_blocks(rows: DataFrame, label: str, size: int) -> tuple[str, int]:
    """(folder, blocks): ``rows`` in the shared folder, dealt by hash into blocks of about ``size`` rows that workers read one by one."""
    spark, whole = rows.sparkSession, new_table(rows.sparkSession, label)
    rows.write.parquet(whole)
    kept = spark.read.schema(rows.schema).parquet(whole)
    blocks = -(-kept.count() // size)
    if blocks < 2:
        return whole, blocks
    from pyspark.sql import functions as F

    uri = f"{whole}-blocks"
    kept.withColumn("block", F.pmod(F.xxhash64(*kept.columns), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(uri)
    return uri, blocks


def read_block(uri: str, number: int) -> list[dict]:
    """A block of :func:`write_blocks`, in a worker; one block alone is the whole table."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = open_folder(uri)
    if system.get_file_info(f"{path}/_SUCCESS").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{uri} is not seen here: {_KEY} must be a folder that all executors share")
    out: list[dict] = []
    parts = system.get_file_info(fs.FileSelector(f"{path}/block={number}", allow_not_found=True))
    for info in parts or (system.get_file_info(fs.FileSelector(path)) if number == 0 else []):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                out += pq.ParquetFile(f).read().to_pylist()
    return out


def small_side(df: DataFrame, label: str, most_rows: int) -> DataFrame:
    """``df``, worked out once, with a broadcast hint if it has at most ``most_rows`` rows; else the join is left to shuffle."""
    from pyspark.sql.functions import broadcast

    kept = materialize(df, label)
    return broadcast(kept) if kept.limit(most_rows + 1).count() <= most_rows else kept


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder; gives its path."""
    path = f"{shared_dir(spark)}/{name}"
    target, system = _hadoop(spark, path)
    out = system.create(target)
    out.write(data)
    out.close()
    return path


#: Applications whose workers have this package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, now and later; once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, data = Path(__file__).parent, io.BytesIO()
    if root.is_dir():  # else the package itself came as an archive
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, str(file.relative_to(root.parent)))
        spark.sparkContext.addPyFile(put(spark, f"{root.name}-{uuid.uuid4().hex}.zip", data.getvalue()))
    _SHIPPED.add(app)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` for functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
