"""Shared helpers of the training-data operators: scans, batches, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import table

#: An Arrow batch holds at most so many rows and, beyond its first row, so many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of the session by rows and bytes (never raising
    a smaller bound), so a Python worker's memory does not depend on how long
    the texts of a run of rows are.  Workers are also told where this package
    lies on the driver, for sessions that were not started with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_held: dict = {}


def hold(key: tuple, build: Callable[[], Any]) -> Any:
    """A large object that a reused Python worker keeps between tasks.  A worker keeps
    one: another operator's next task drops it (``release``), so what the stages of a
    pipeline keep does not add up."""
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Drop what earlier tasks of this worker have kept."""
    _held.clear()


def give_back() -> None:
    """Return freed memory to the system: a reused Python worker that waits for its
    next task otherwise holds as much as its largest one needed, and the stages of a
    pipeline leave several such workers behind on an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(task: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A ``mapInPandas`` function that starts without what other operators have kept
    (unless it ``keeps`` something itself) and gives its memory back at its end."""

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            release()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def distinct_pieces(texts: list[str], find: Callable[[str], list[str]]) -> tuple[list[str], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The texts' words (none reaches over ASCII white space), each once; the numbers of
    the words of every distinct piece between such spaces, and where each piece's begin
    (and the last one's end); the same for the pieces of every text.  ``find``: the words
    of a text, and its line ends."""
    lists = pc.ascii_split_whitespace(pa.array(texts, type=pa.large_string()))
    pieces = lists.flatten().dictionary_encode()
    # a line end after each piece tells where its words end
    found = pa.array(find("\n".join(["", *pieces.dictionary.to_numpy(zero_copy_only=False), ""])), type=pa.large_string()).dictionary_encode()
    words, codes = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
    if not len(pieces.dictionary):
        return [], (codes[:0], np.zeros(1, dtype=np.int64)), (pieces.indices.to_numpy(), lists.offsets.to_numpy())
    ends = np.flatnonzero(codes == 0)  # the first that is found is a line end
    own = codes[codes != 0] - 1
    return words[1:], (own, ends - np.arange(len(ends))), (pieces.indices.to_numpy(), lists.offsets.to_numpy())


def expand(values: np.ndarray, starts: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What stands at the places, as of ``distinct_pieces``: number ``k`` stands for the
    ``values`` from ``starts[k]`` to the next start."""
    codes, offsets = places
    size = np.diff(starts)[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(starts[codes] - ends[:-1], size) + np.arange(ends[-1])], ends[offsets]


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a table stored in fewer splits than there are task
    slots keeps them (a round-robin deal would move whole texts)."""
    return table(spark, sf_dir, name)


#: Rows of an id or digest list (some 40 bytes each) that a join may broadcast.
BROADCAST_ROWS = 500_000


def join_list(df: DataFrame, short: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a written list of ids or digests: broadcast after counting it,
    so that texts stay where they are, else an ordinary join."""
    return df.join(F.broadcast(short) if short.count() <= BROADCAST_ROWS else short, on, how)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected link table.

    ``edges`` has columns ``a`` and ``b`` of one orderable type.  Returns
    ``(node, root)`` for every node with a link; ``root`` is the smallest node
    reachable.  Alternates large-star and small-star steps (joins and minimum
    aggregates only, so a hub's neighbours never meet in one row), each written
    below the checkpoint folder; O(log^2 n) rounds.  Null ends and self links
    are ignored; an empty table gives an empty result.
    """
    child = F.greatest("a", "b").alias("a")
    parent = F.least("a", "b").alias("b")
    ok = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    cur = materialize(ok.select(child, parent).distinct(), name)
    seen = _mark(cur)
    while seen[0]:
        # large star: a node's larger neighbours go to its smallest neighbour
        sym = cur.select("a", "b").unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where(F.col("a") != F.col("b")).distinct(), name)
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = materialize(moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = _mark(cur)
        if now == seen:
            break
        seen = now
    # a star forest: every node points at its root, roots point at themselves
    both = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return both.unionAll(both.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Row count and order-free hash of an edge table (one row to the driver)."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return int(r["n"]), int(r["x"])
