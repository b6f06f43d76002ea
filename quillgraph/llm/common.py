"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that the contracts call white space: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Words of 64 bits of which a sieve has at most so many, whatever the rows: about 4 MB.
SIEVE = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; other letters stay.  All-ASCII strings take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares, from ``spark.checkpoint.dir``.  Where it is unset, a local session (as in
    tests) gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in runs of whole rows with about ``limit`` bytes of text each, without copies: a worker holds one
    batch as Arrow and the Python strings of one run."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sifted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``df`` with ``hit``: false only where no row of ``wanted`` has the same key, a hash as a long.

    A broadcast of ``SIEVE`` words of 64 bits at most, with one bit for each key, tells it, so that rows with large columns
    that no join can want needn't be shuffled.  The more keys, the more rows are hit without need: an exact join has
    to follow."""
    word, place = (lambda k: F.pmod(F.shiftright(k, 6), F.lit(SIEVE)).alias("word")), (lambda k: F.pmod(k, F.lit(64)).cast("int"))
    bits = wanted.select(word(wanted_key), F.call_function("shiftleft", F.lit(1).cast("long"), place(wanted_key)).alias("bit"))
    held = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    both = df.join(F.broadcast(held), word(key) == held.word, "left")
    return both.select(*[df[f"`{c}`"] for c in df.columns], F.coalesce(F.getbit("bits", place(key)) == 1, F.lit(False)).alias("hit"))


def local_rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A frame of the driver's few ``rows``; ``columns`` as in "src string, n long".  It goes to the JVM as Arrow and is part of
    the plan: a frame made of a list would start Python workers on the executors, which stay there."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
    fields = [pa.field(name, kinds[kind]) for name, kind in map(str.split, columns.split(","))]
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields)))


def others(docs: DataFrame, *taken: str) -> Column:
    """The columns an operator carries along untouched, as one struct, so that their names can't clash with its own."""
    names = [c for c in docs.columns if c not in taken]
    return F.struct(*[docs[f"`{c}`"] for c in names]) if names else F.struct(F.lit(None).cast("int").alias("none"))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
