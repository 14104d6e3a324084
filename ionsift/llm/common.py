"""Helpers shared by the training-data operators: tables, written intermediates, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' word pattern ``[^\x20\x09-\x0D]+``, as a Java class.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


#: Whether Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of text that a task hands a Python worker at once, where asked for: JVM and worker each hold such batches.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (names are compared as Spark does, whatever their case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share; a local one is set only in local mode where none is named (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="spark-ionsift-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage with files that outlive an executor, and Spark drops the write's shuffle files as soon as it
    has ended. The table goes when the application ends. ``small``: Python workers get whole texts in small batches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ionsift-{name}-{uuid.uuid4().hex}"
    during = {CLEANUP: "true"} | (SMALL if small else {})
    before = {k: spark.conf.get(k, "false") if k == CLEANUP else spark.conf.get(k) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    jpath, fs = _file(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._ionsift_path = path
    return out


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``rows`` for mapInArrow, whose worker gives its free memory back at a task's end: Spark keeps workers through stages that need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def _file(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them has been written itself."""
    for df in tables:
        if path := getattr(df, "_ionsift_path", None):
            jpath, fs = _file(df.sparkSession, path)
            fs.delete(jpath, True)


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: each left end has one edge, and none is a right end."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("left"), F.lit(0).alias("right")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    per_id = ends.groupBy("id").agg(F.sum("left").alias("left"), F.max("right").alias("right"))
    return not per_id.where("left > 1 or left > 0 and right > 0").limit(1).count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` links -> ``(id, component_id)`` for every linked id but the smallest of each component, which is component_id.

    Alternating large-star and small-star rounds: only minima are aggregated, no neighbour list is
    gathered, and each round is a written table. Rows with a null end and self links are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = materialize(e, "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.where("u != v").distinct(), "edges")
        forget(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    out._ionsift_path = e._ionsift_path
    return out
