"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions the session shuffles to; operators scale their fan-out with it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker stays for later tasks, of other operators too."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc's
        libc.malloc_trim(0)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows without columns of these names, in any case: an operator's results take their place."""
    taken = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    return df if len(keep) == len(df.columns) else df.select(*[f"`{c.replace('`', '``')}`" for c in keep])


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.  Where it is unset, one on this machine
    serves a local master, for there every task sees it; on a cluster it is an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (conf or "/tmp/tabulon-checkpoints").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Has checkpoint() write to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))


def digest(text: Column) -> Column:
    """The 16 bytes by which operators tell texts apart: at 3 x 10^10 texts two of them meet in one with a
    probability of 10^-18."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))  # never null, so that no filter on it keeps plans apart


def md5_unit(*parts: Column) -> Column:
    """Uniform double in [0, 1) from 52 bits of md5 over the parts (nulls count as empty)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_unit(*parts: Column) -> Column:
    """Uniform double in (0, 1) from the top 53 bits of xxhash64."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
