"""What the operators of this package share: table access, scratch tables, word hashing.

Workers must be able to import this package (put the repository on PYTHONPATH, or ship it
with ``--py-files``).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id sorts before every other id and is handed back as null.
NULL_ID = -(1 << 63)
#: Bytes of text that one vectorised step of a Python worker takes at most, beyond a single document.
CHUNK_BYTES = 2_000_000
#: Bits that a wanted row has in a sieve; and shards of 512 bytes that a sieve has at most (32 MB).
SIEVE, SIEVE_SHARDS = 16, 1 << 16
_U = np.uint64
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name``; read by Spark alone, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(name: str = "doc_id", docs: DataFrame | None = None) -> Column:
    """A whole-number id as a key that is never null. An id that is no whole number fails, named: these operators order rows by it.

    With ``docs`` whose id is a whole number by its type nothing is checked.
    """
    c = F.col(f"`{name}`")
    key = c.cast("long")
    if docs is None or docs.schema[name].dataType.typeName() not in ("long", "integer", "short", "byte"):
        key = c.try_cast("long")
        key = F.when(c.isNotNull() & key.isNull(), F.raise_error(F.concat(F.lit(f"{name}: not a whole number: "), c.cast("string"))).cast("long")).otherwise(key)
    return F.coalesce(key, F.lit(NULL_ID).cast("long"))


def id_of(key: str | Column) -> Column:
    """Back from :func:`id_key` to the id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key != F.lit(NULL_ID), key)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The ``names``, each lengthened until no column bears it, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one serves on a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            return chosen.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="furlong-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/furlong-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._furlong_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_furlong_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends; otherwise they stay until the driver's JVM happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def sieved(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` may be in the one column of ``wanted``: all that are, and about one in 100 of the others.

    A join that follows shuffles little more than it keeps. Two bits of SIEVE or more are set for each wanted row, and broadcast
    in shards of 4096; of more wanted rows than SIEVE_SHARDS has room for, more of the others pass, and no wanted one is lost.
    """
    shards = 1
    least = min(wanted.count() * SIEVE // 4096, SIEVE_SHARDS)
    while shards < least:
        shards *= 2

    def place(c: Column) -> tuple[Column, Column, Column]:
        h = F.xxhash64(c)
        return F.pmod(h, F.lit(shards)), F.shiftrightunsigned(h, 52).cast("int"), F.shiftrightunsigned(h, 40).cast("int").bitwiseAND(4095)

    shard, *bits = place(F.col(f"`{wanted.columns[0]}`"))
    placed = wanted.select(shard.alias("shard"), F.explode(F.array(*bits)).alias("bit"))
    words = placed.groupBy("shard", F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("b"))
    shard_words = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    word = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
    sieve = shard_words.select(F.col("shard").alias("_shard"), F.transform(F.sequence(F.lit(0), F.lit(63)), word).alias("_words"))
    shard, *bits = place(key)
    is_set = [F.getbit(F.get("_words", F.shiftright(bit, 6)), bit.bitwiseAND(63)) == 1 for bit in bits]
    return rows.join(F.broadcast(sieve), (shard == F.col("_shard")) & is_set[0] & is_set[1], "left_semi")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: its folder goes with it
            return


class WordHash(dict):
    """word (bytes) -> 64-bit hash, kept for words seen lately; never above ``most`` entries."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) in runs of about CHUNK_BYTES; null is empty."""
    run: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        run.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def combined(kmer: np.ndarray, finer: np.ndarray, k: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, done, kmer): of rows of one (kmer, finer) only those of the first (id, start) go on; the others are done, and
    get a random key so that they are dealt evenly."""
    order = np.lexsort((start, k, finer, kmer))
    kmer, finer, k, start = kmer[order], finer[order], k[order], start[order]
    new = np.ones(len(kmer), bool)
    new[1:] = (kmer[1:] != kmer[:-1]) | (finer[1:] != finer[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(kmer) else np.zeros(0, np.int64)
    done = (k != k[lead]) | (start != start[lead])
    return order, done, np.where(done, mix(k.view(np.uint64) + start.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64), kmer)


class Keyed:
    """Documents with the key of their id and a hash of their text, in columns that bear no name of theirs.

    ``keys`` tell documents apart: the hash is one of them only where ids repeat. ``slim`` has (_t, _k, _h) alone.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.columns, self.text_col = docs.columns, text_col
        self.t, self.k, self.h = unused(docs.columns, "_t", "_k", "_h")
        key, text = id_key(id_col, docs), F.col(f"`{text_col}`")
        twice = not docs.groupBy(key.alias("_k")).count().where("count > 1").isEmpty()
        hashed = F.xxhash64(text) if twice else F.lit(0).cast("long")
        others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
        self.docs = docs.select(*others, text.alias(self.t), key.alias(self.k), hashed.alias(self.h))
        self.keys = ["_k", "_h"] if twice else ["_k"]
        self.slim = docs.select(text.alias("_t"), key.alias("_k"), hashed.alias("_h"))

    def with_spans(self, spans: DataFrame, name: str, same: dict | None = None) -> DataFrame:
        """The documents with the spans of their keys in a last column ``name``; ``same`` has columns that come back from the key."""
        own = {"_k": self.k, "_h": self.h}
        named = spans.select(*[F.col(c).alias(own[c]) for c in self.keys], F.col("spans").alias(name))
        both = self.docs.join(named, [own[c] for c in self.keys], "left").withColumns(same or {})
        return both.select(*[F.col(self.t).alias(c) if c == self.text_col else F.col(f"`{c}`") for c in self.columns], name)


def span(start: Column, n: Column) -> Column:
    """The places [start, start + n) in one number."""
    return F.shiftleft(start.cast("long"), 32) + n.cast("long")
