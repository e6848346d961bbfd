"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D, nothing else.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Only a local session, as in tests, may go without; it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with a table that survives lost executors, and keeps an
    expensive scan from running again for every later reference.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what earlier jobs have left behind, and give the memory back to the system.

    Spark removes shuffles, broadcasts and plans that nothing refers to any more only when the
    driver's JVM happens to collect its garbage, which a heap with room puts off; and what many
    short threads have freed stays with the C library until it is told to return it.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    objects, server = spark.sparkContext._gateway.new_array, jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    asked = objects(jvm.java.lang.Object, 4)
    asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    with contextlib.suppress(Py4JJavaError):  # other JVMs, and older ones, have no such command
        call.invoke(server, asked)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain column reference inside a lambda would be evaluated again for each
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def carried(df: DataFrame, **named: Column) -> DataFrame:
    """The rows of ``df`` as one struct, beside columns of an operator's own: no name of the table can meet one of these."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(name) for name, c in named.items()])


def unpacked(held: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """Carried rows as they were, with ``new`` columns; those take the place of columns that have their names, in whatever case."""
    taken = {name.lower() for name in new or {}}
    old = [F.col(f"_row.`{c}`").alias(c) for c in columns if c.lower() not in taken]
    return held.select(*old, *[c.alias(name) for name, c in (new or {}).items()])


def fingerprint(df: DataFrame, *more: Column) -> Column:
    """A 64-bit fingerprint of a row: of all its columns that Spark can hash (maps and variants are left out) and of ``more``."""
    odd = ("map<", "variant")
    return F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in df.dtypes if not any(x in kind for x in odd)], *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """All words of a text, null counting as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def words_path(path: str) -> str:
    """``path`` as given, or an error that names it."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
