"""What several operators need: tables that cut lineage, hashes, bounded joins."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names; a temporary one where a single machine
    runs all, as in tests. Executors of their own would each write to a folder of their own, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tallyloom-"))
    return f"file://{_own[0]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_tallyloom_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def n_words(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_uniform(key: Column, part: int = 0) -> Column:
    """A number in [0, 1) of 52 bits from the first (part 0) or second (part 1) half of key's md5."""
    return F.conv(F.substring(F.md5(key), 1 + 16 * part, 13), 16, 10).cast("double") / F.lit(float(2**52))


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))
