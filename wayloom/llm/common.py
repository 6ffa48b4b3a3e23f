"""Shared helpers: the cluster's shared folder, file access from executors, id classes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to which components are found by one task; they are counted first, more take distributed rounds.
LOCAL_EDGES = 1_000_000
#: Rows up to which a side may be broadcast; it is counted first, larger sides are shuffled.
BROADCAST_ROWS = 300_000


#: Bytes of one Arrow batch: what a Python worker holds of long texts at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that rows of long texts don't fill a worker; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back(run):
    """``run`` for mapInArrow, after which the worker returns its free memory, as it stays for other operators' tasks."""

    def then(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library may lack it
            ctypes.CDLL(None).malloc_trim(0)

    return then


def shared_root(spark: SparkSession) -> str:
    """The shared folder, spark.checkpoint.dir. Unset, a local master gets a folder of its own (all its tasks are in this process), a cluster an error."""
    bounded_batches(spark)
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='wayloom-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders named since the last ``passing`` began.
_NAMED: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    _NAMED.append(f"{shared_root(spark)}/wayloom-{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Folders named within are deleted at its end: what was made there must be written elsewhere by then."""
    at = len(_NAMED)
    yield
    remove(spark, *_NAMED[at:])
    del _NAMED[at:]


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the workspace that no later result reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        with contextlib.suppress(Exception):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def open_output(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only where a count proves at most ``limit`` narrow rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        r = a
        while (p := up.get(r, r)) != r:
            r = p
        while up.get(a, a) != r:
            up[a], a = r, up[a]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        e = [(a, r) for a in list(self.up) if (r := self.root(a)) != a]
        return np.array([x[0] for x in e], np.int64), np.array([x[1] for x in e], np.int64)


def thinned(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges with the same components: each task keeps a spanning forest of what it reads, of at most ``most`` nodes at a time."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.join(a, b)
            if len(forest.up) >= most:
                a, b = forest.edges()
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                forest = Forest()
        a, b = forest.edges()
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60, thin: bool = True) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node.

    Edges are thinned to forests where they lie (not those that come as forests, ``thin`` false). At most LOCAL_EDGES of them (16
    bytes each) go through one task; more take alternating large-star and
    small-star rounds until no edge changes, with the same result. Every round
    writes its edges to the shared folder. A node with very many edges is never
    gathered: minima are aggregated before they are shuffled, and the joins back
    on the node are equi-joins that adaptive execution may split.
    """
    spark = edges.sparkSession
    base = workspace(spark, f"cc-{name}")
    cur = edges.where("a <> b")
    cur = (thinned(cur) if thin else cur).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialize(cur, f"{base}/0")
    if cur.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        found = thinned(cur.coalesce(1), LOCAL_EDGES * 4).select(F.col("a").alias("node"), F.col("b").alias("component"))
        found = materialize(found, f"{base}/found")
        return found.union(found.select(F.col("component").alias("node"), "component").distinct())
    digest = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for i in range(1, max_rounds + 1):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.union(small_low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{base}/{i}")
        new = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        cur = nxt
        if tuple(new) == tuple(digest):
            break
        digest = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = cur.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component"))
    return found.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
