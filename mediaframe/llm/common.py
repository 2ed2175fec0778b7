"""Helpers shared by the training-data operators: shared folders, written tables, hashing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.plans.storage import materialize, release, shared_dir

__all__ = ["KEPT", "aside", "configure", "held_out", "map_rows", "materialize", "nested", "read", "release", "shared_dir"]

#: Bounds of an Arrow batch handed to Python, the same for every operator: whichever is met first.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, by rows and by bytes."""
    for name, value in ARROW.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3 is 1; a null id is held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def read(spark: SparkSession, sf_dir: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns beside those used named x0, x1 and so on, and what gives a result of them its names back.

    So no column can clash with one that an operator makes on the way, whatever it is called.
    """
    names = docs.columns
    plain = [c if c in used else f"x{i}" for i, c in enumerate(names)]
    return docs.toDF(*plain), lambda out: out.select(*plain).toDF(*names)


#: Caches that Python workers keep between tasks, cleared as soon as a worker turns to something else.
KEPT: list = []


def let_go(but: object = None) -> None:
    """Clear the worker's caches but one, and give the memory back to the system."""
    held = [f for f in KEPT if f is not but and f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        import gc

        gc.collect()
    give_back()


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system: idle workers count too."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def nested(counts, **columns):
    """An Arrow list of structs: counts rows each, from flat columns; no Python object per row."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns)))


def map_rows(df: DataFrame, keep: Sequence[str], take: Sequence[str], fn: Callable, schema: str, raw: Sequence[str] = (), kept: object = None) -> DataFrame:
    """Columns to keep as they are, then those that fn makes batch by batch from the taken ones.

    fn gets a list of Python values per taken column, or for those in raw the Arrow array, and returns a
    list or Arrow array per column of schema. Kept columns pass through Arrow untouched, so null and 64-bit
    keys stay exact. kept: the cache of KEPT that fn uses.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    configure(df.sparkSession)
    made = T.StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in made]
    names = [*keep, *made.names]
    n = len(keep)
    plain = [name not in raw for name in take]

    def go(batches):
        let_go(kept)
        pool = pa.default_memory_pool()
        for batch in batches:
            out = fn(*(batch.column(n + i).to_pylist() if p else batch.column(n + i) for i, p in enumerate(plain)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(x.cast(k) if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=names)
            del batch, out
            pool.release_unused()
        give_back()

    fields = T.StructType([df.schema[k] for k in keep])
    return df.select(*(F.col(k) for k in keep), *(F.col(k).alias(f"__take{i}") for i, k in enumerate(take))).mapInArrow(go, T.StructType(fields.fields + made.fields))
