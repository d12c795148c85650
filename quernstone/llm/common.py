"""What the operators share: table access, tables written to the shared folder, hot keys, batches of texts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from sys import getsizeof

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcasts of id lists are made only when a count has shown at most this many ids (16 bytes each, about 16 MB);
#: longer lists go by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Rows of one key that a task takes as they are; keys with more are dealt over several tasks.
SPLIT = 256
_own: dict[str, str] = {}


class _Open(threading.local):
    """The scratch blocks that are open, innermost last: each thread has its own, so that operators may run side by side."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_open = _Open()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: set[str]) -> str:
    """A column name that is not among those taken (in lower case, as Spark compares names)."""
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="quernstone-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and gives later joins true sizes."""
    path = f"{shared_dir(df.sparkSession)}/quernstone-{uuid.uuid4().hex}"
    if _open.blocks:
        _open.blocks[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are removed at the end, except those made by the function that this gives, which
    belong to the block around this one, if there is one."""
    blocks = _open.blocks
    blocks.append([])

    def kept(df: DataFrame) -> DataFrame:
        out = written(df)
        path = blocks[-1].pop()
        if len(blocks) > 1:
            blocks[-2].append(path)
        return out

    try:
        yield kept
    finally:
        for path in blocks.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """df with (left_semi) or without (left_anti) the rows whose key is in ids, a written table with that one column.
    The ids are broadcast only if their count is within BROADCAST_IDS; else both sides are shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def too_many(total: int, at_most: int = BROADCAST_IDS) -> int:
    """Keys that stand in more than this many of `total` rows are hot: over SPLIT rows, and over total / at_most. So there
    are fewer than at_most such keys whatever the rows, and a table of them may be broadcast; and no task has more rows
    of a key that is not hot than that share of all rows."""
    return max(SPLIT, total // at_most)


def hubs(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, parts) of the hot keys of rows, and over how many tasks to deal each."""
    most = too_many(total)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") > most).withColumn("parts", F.ceil(F.col("parts") / most).cast("int"))


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with found, whose keys are unique. hot has the columns of found for hot keys: it is
    broadcast, and their rows are joined where they are; only the others are exchanged."""
    more = [c for c in found.columns if c not in keys]
    hot = F.broadcast(hot.select(*keys, *more))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(found, keys, how)
    return cold.select(*rows.columns, *more).unionAll(rows.join(hot, keys).select(*rows.columns, *more))


class Kept(dict):
    """What `make` gives for a word, kept by word. Words of over LONGEST characters are not kept, and all is forgotten
    when the words and their results (of `size` bytes each, and the words') fill `most` bytes. No result depends on it."""

    LONGEST = 64

    def __init__(self, make: Callable[[str], object], size: Callable[[object], int], most: int):
        super().__init__()
        self.make, self.size, self.most, self.held = make, size, most, 0

    def __missing__(self, word: str):
        out = self.make(word)
        if len(word) <= self.LONGEST:
            self.held += getsizeof(word) + self.size(out) + 100  # 100: the table's own place for it
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[word] = out
        return out


def slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `most` characters each, one text at least."""
    at, held = 0, 0
    for i, x in enumerate(texts):
        if i > at and held + len(x) > most:
            yield at, i
            at, held = i, 0
        held += len(x)
    if at < len(texts):
        yield at, len(texts)
