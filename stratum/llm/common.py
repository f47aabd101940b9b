"""What the corpus operators share: tables in the shared folder, file systems, words."""

from __future__ import annotations

import atexit
import threading
import uuid
import weakref
import zlib
from contextlib import contextmanager
from itertools import filterfalse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words; everything else belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Seconds without a task after which a worker lets its caches go.
IDLE_S = 1.5

#: Keys for a bitmap of a sieve (32,768 bits, so 32 for a key), and bitmaps at most: 8 MB are broadcast.
SIEVE_KEYS, SIEVE_MAPS = 1024, 2048

_caches: dict = {}
_lock, _turn = threading.Lock(), 0

_made: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        import re
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")

        named = tempfile.mkdtemp(prefix="stratum-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when this driver ends."""
    if spark not in _made:
        _made[spark] = []
        atexit.register(_forget, weakref.ref(spark))
    _made[spark].append(path := f"{shared_dir(spark)}/stratum/{kind}-{uuid.uuid4().hex}")
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(ref) -> None:
    spark = ref()
    try:
        for path in _made.get(spark, ()) if spark is not None and spark.sparkContext._jsc is not None else ():
            drop(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, kind))
    out = spark.read.schema(df.schema).parquet(path)
    out.stratum_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        _made[t.sparkSession].remove(t.stratum_path)
        drop(t.sparkSession, t.stratum_path)


@contextmanager
def temporary(spark: SparkSession, keep: list):
    """Deletes the tables that are made inside, but for the paths in keep, once what is done inside has succeeded."""
    before = set(_made.get(spark, ()))
    yield
    for path in [p for p in _made.get(spark, ()) if p not in before and p not in keep]:
        _made[spark].remove(path)
        drop(spark, path)


def sift(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose column may be in keys (one column of a table), and those where it surely is not.

    Bits of the keys' hashes are broadcast, so that an exchange for a join with keys need not hold the second part's rows. The
    first part has others than keys too, the more of them the more keys there are: a join of it with keys must follow.
    """
    (key,) = keys.schema
    at, number, bits = hidden(df.columns, "at", "number", "bits")
    maps = max(1, min(SIEVE_MAPS, -(-keys.count() // SIEVE_KEYS)))
    place = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`").cast(key.dataType)), F.lit(maps << 15))
    sieve = keys.select(place(key.name).alias(at)).groupBy(F.shiftright(at, 15).alias(number)).agg(F.bitmap_construct_agg(F.col(at).bitwiseAND(F.lit(32767))).alias(bits))
    tried = df.withColumn(at, place(column)).join(F.broadcast(sieve), F.shiftright(at, 15) == F.col(number), "left")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(F.col(at).bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.col(at).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return tuple(tried.where(x).drop(at, number, bits) for x in (may, ~may))


def give_back(spark: SparkSession) -> None:
    """Executors give heap that they do not use back to the system.

    A JVM keeps what a stage's shuffles took, up to its whole heap, and the Python workers of the stage that follows may not
    fit beside it. There is a task for each core, so that each executor that is up and free has one.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder that Spark names; local paths may lack a scheme."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def crc_fold(col, n: int):
    """crc32 of the text of an id, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def crc32_of(text: str) -> int:
    return zlib.crc32(text.encode())


def hidden(names, *wanted: str) -> list[str]:
    """Column names that no input column can clash with, one for each wanted one."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        k = f"__{w}"
        while k.lower() in taken:
            k = "_" + k
        taken.add(k.lower())
        out.append(k)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Generations(dict):
    """A worker's cache in two generations: what is used again outlives a turn."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def unknown(self, keys: set) -> set:
        # one look-up for each key: difference() would go through all that the cache holds
        return set(filterfalse(self.old.__contains__, filterfalse(self.__contains__, keys)))

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


def grouped(batches, names: list[str]):
    """(values of names, table) of each run of equal long columns names in a stream of Arrow batches."""
    import pyarrow as pa

    held, now = [], None
    for x in batches:
        if not x.num_rows:
            continue
        keys = np.column_stack([x.column(x.schema.get_field_index(n)).to_numpy() for n in names]).astype(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(keys[s]) != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = tuple(keys[s].tolist())
            held.append(x.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)


def bound(df: DataFrame, name: str, value) -> DataFrame:
    """df with a column whose expression is evaluated once for each row.

    A plain column may be copied into every filter and lambda that uses it, which repeats its work for each element;
    nothing is pushed through the generator that gives this one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


@contextmanager
def cached(name: str, clear):
    """Around a task that uses a worker's cache. clear is a function of a module: a closure would clear a copy. Workers outlive a stage: what other operators keep in this one goes at
    once, and what this one keeps goes once the worker has had no task for IDLE_S, as the stages that follow may need
    the machine's memory for the JVM."""
    global _turn
    with _lock:
        _turn += 1
        others = [_caches.pop(k) for k in list(_caches) if k != name]
        _caches[name] = clear
        if others:
            _release(others)
    try:
        yield
    finally:
        trim()
        with _lock:
            timer = threading.Timer(IDLE_S, _rest, [_turn])
        timer.daemon = True
        timer.start()


def _rest(turn: int) -> None:
    with _lock:
        if turn == _turn:
            _release([_caches.pop(k) for k in list(_caches)])


def _release(clears: list) -> None:
    import gc

    for clear in clears:
        clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives free memory back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)
