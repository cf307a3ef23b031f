"""What the operators share: tables, written intermediate results, Arrow batches cut by size, texts cut into pieces, components
of a graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a task works on at once; longer texts are worked on alone.
SLICE_BYTES = 8 << 20
#: Rows that a task works on at once.
SLICE_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared folder: what follows reads files and survives the loss of any executor."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    for made in _open:
        made.append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables written since each clearing() that is open now, the outermost first.
_open: list[list[DataFrame]] = []


@contextmanager
def clearing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end all tables of written() made inside are deleted, but those given to the function it hands out.

    What leaves it must be such a table, or rows that do not read one. It holds on the driver's thread alone.
    """
    made: list[DataFrame] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._written_at)
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open.pop()
        for df in made:
            if df._written_at not in kept:
                drop_written(df)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has; case does not count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a string or binary column holds about `size` bytes in each piece; longer texts stay whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i in range(n):
            if i > start and (held + int(lengths[i]) > size or i - start == SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(lengths[i])
        yield batch.slice(start, n - start)


def cut_up(texts: list[bytes], places: Callable[[np.ndarray], np.ndarray], uncut: Iterable[int] = ()) -> tuple[
        list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces of the texts, the number of each piece in turn among them, and the first piece of each text.

    A piece begins at every text and at the bytes that places() names of all texts in a row, but within those whose
    numbers are in `uncut`. The firsts have one more entry, the number of all pieces.
    """
    raw = b"".join(texts)
    starts = np.cumsum([0, *map(len, texts)])
    begins = np.zeros(len(raw) + 1, bool)
    begins[places(np.frombuffer(raw, np.uint8))] = True
    for i in uncut:
        begins[starts[i]:starts[i + 1]] = False
    begins[starts] = True
    begins = np.flatnonzero(begins)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(raw)])
    found = pieces.dictionary_encode()
    _, at, data = found.dictionary.buffers()
    at, data = np.frombuffer(at, np.int64, len(found.dictionary) + 1).tolist(), data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(at, at[1:])], found.indices.to_numpy(), np.searchsorted(begins, starts)


def strung(values: list[bytes] | pa.Array, of: np.ndarray, firsts: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The values numbered in `of` in a row, and the bytes at which those numbered in `firsts` begin."""
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())
    taken = values.take(pa.array(of))
    _, at, data = taken.buffers()
    return data or pa.py_buffer(b""), np.frombuffer(at, np.int64, len(of) + 1)[firsts]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): the smallest node reachable over them.

    Large-star and small-star rounds in turn. A node passes on only its smallest neighbour, found by a folded minimum,
    and rows of a hub meet it in a join that Spark may split, so no task holds a hub's neighbours. Each round is written
    to the shared folder, which cuts the lineage. Nodes are longs; null ends and loops are left out.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Rebalanced, a hub's rows are split where they meet its minimum: next to an aggregate they would not be.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small, "edges")
        drop_written(now)
        drop_written(large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and two order-free sums of the edges: equal only if a round has changed nothing."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))"))
                 .first())
