"""What the operators share: staged tables in the cluster's shared folder, and column names that cannot clash."""

from __future__ import annotations

import struct
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a scratch one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = "file://" + tempfile.mkdtemp(prefix="turnstile-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from the copy: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def add_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """withColumns that refuses to overwrite a column of the input."""
    taken = {c.lower() for c in df.columns} & {c.lower() for c in columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already")
    return df.withColumns(columns)


def inner_name(df: DataFrame, wish: str) -> str:
    """A helper column's name that the input does not use."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Bits of a membership bitmap, and rows that hold them 64 at a time: a broadcast of 2 MB of bits, whatever the data.
BITMAP_BITS = 24
BITMAP_ROWS = 1 << (BITMAP_BITS - 6)


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member: Column, there: bool = True) -> DataFrame:
    """Rows whose 64-bit hash may be (there=False: is certainly not) among the members' hashes.

    A bitmap of fixed size spares shuffling rows that an exact join would drop later; that join still has to follow.
    With ever more members it lets ever more rows pass, and never loses one.
    """
    held, bits = inner_name(df, "_word"), inner_name(df, "_bits")
    word = lambda h: F.shiftrightunsigned(h, 64 - (BITMAP_BITS - 6))
    bit = lambda h: h.bitwiseAND(63).cast("int")
    bitmap = members.select(member.alias("h")).groupBy(word(F.col("h")).alias(held)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))).alias(bits))
    hit = (word(key) == F.col(held)) & (F.call_function("shiftright", F.col(bits), bit(key)).bitwiseAND(1) == 1)
    return df.join(F.broadcast(bitmap), hit, "left_semi" if there else "left_anti")


#: Most tasks that a list of files is dealt to.
FILE_TASKS = 10_000


def a_task_each(files: DataFrame, path: str = "path") -> DataFrame:
    """A list of files dealt out by path, to as many tasks as there are files. The number is given outright: a list is
    short, and would otherwise be put together into one task however much its files hold."""
    return files.repartition(max(1, min(FILE_TASKS, files.count())), F.col(path))


def kept_in_worker(key: str, make: Callable[[], object]) -> object:
    """What a Python worker made for an earlier task and can use again: look-up tables and what they have learned."""
    home = sys.modules.setdefault("_turnstile_worker", types.ModuleType("_turnstile_worker")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of each significance, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<QB", len(a), a.itemsize), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(raw: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(raw):
        n, size = struct.unpack_from("<QB", raw, at)
        planes = np.frombuffer(raw, np.uint8, n * size, at + 9).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{size}") if n else np.zeros(0, f"<u{size}"))
        at += 9 + n * size
    return out
