"""Best-fit packing after Martello-Toth dominance reduction.

Every document becomes token ids plus a separator; documents longer than a sequence are cut from their end, so only the first piece is short.
Sizes are whole numbers up to the capacity, so the instance is its histogram: the plan (which sizes share a sequence, how often) is made on
the driver from at most `capacity` counts, however many documents there are. The reduction procedure fixes sets that provably dominate every
other way to pack their largest item: alone where nothing else fits, with the largest partner where no third item fits beside it or where the
pair fills the sequence, and a pair of smaller items where together they fill what the largest partner would. The rest is packed best-fit
decreasing, in runs of equal sizes. Documents then take the plan's places: each piece has a rank among those of its size, from a number
within its task and the counts of the tasks before; the plan turns (size, rank) into sequence and offset.

Defined results: null or empty text is one piece of one separator; repeated rows are packed each; null ids stay null; no rows give no rows; extra columns are
not read. Special-token strings in a text become what the tokenizer makes of them."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import cut, steps, table, text_column

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
_LOADED: dict[str, object] = {}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{TOKENIZER}.json")


def encoder(path: str):
    """text -> ids as the tokenizer file gives them. Where the same vocabulary lies beside it as ranks, its faster coder is used; both give the same ids."""
    if path not in _LOADED:
        import base64
        import os

        ranks = path[: -len(".json")] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=SPECIAL)
            _LOADED[path] = lambda text: coder.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            _LOADED[path] = lambda text: own.encode(text, add_special_tokens=False).ids
    return _LOADED[path]


# the plan, on the histogram ------------------------------------------------------------------------------------------------


class _Counts:
    """A multiset of sizes with fast neighbours."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c}
        self.sizes = sorted(self.n)

    def at_most(self, size: int) -> int | None:
        k = bisect_left(self.sizes, size + 1)
        return self.sizes[k - 1] if k else None

    def add(self, size: int, n: int) -> None:
        if size not in self.n:
            insort(self.sizes, size)
        self.n[size] = self.n.get(size, 0) + n
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def least(self, many: int, above: int = 0) -> int | None:
        """The sum of the `many` smallest items larger than above; None where there are fewer."""
        total, k = 0, bisect_left(self.sizes, above + 1)
        while many and k < len(self.sizes):
            n = min(many, self.n[self.sizes[k]])
            total, many, k = total + n * self.sizes[k], many - n, k + 1
        return None if many else total


def _dominating(free: _Counts, room: int) -> tuple[int, ...] | None:
    """The items beside the one that leaves this room which dominate every other choice, if there are such; free is without that one."""

    def fits(total: int | None) -> bool:
        return total is not None and total <= room

    largest = free.at_most(room)
    if largest is None:
        return ()
    if largest == room or not fits(free.least(2)):
        return (largest,)  # any other choice is one item, and no larger; or the sequence is full
    if fits(free.least(3)):
        return None
    free.add(largest, -1)
    second = free.at_most(room - largest)
    free.add(largest, 1)
    if second is None or fits(free.least(2, above=second)):
        return None  # some pair has both items larger than second
    return (largest, second)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction: (sets fixed with multiplicities, what is left). Sizes are tried from the largest down; a fixed set has at most
    three items and dominates every feasible set with its first item, so some optimal packing has it. Items not fixed stay free for others."""
    free, fixed = _Counts(counts), []
    for size in sorted(counts, reverse=True):
        while free.n.get(size):
            free.add(size, -1)
            beside = _dominating(free, capacity - size)
            if beside is None:
                free.add(size, 1)
                break
            chosen = (size, *beside)
            # the same choice stays dominating while its items last: what goes only makes other choices fewer
            n = min((free.n.get(s, 0) + (s == size)) // chosen.count(s) for s in chosen)
            for s in beside:
                free.add(s, -n)
            if n > 1:
                free.add(size, 1 - n)
            fixed.append((chosen, n))
    return fixed, dict(free.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over runs of equal sizes: each item goes where the least room stays."""
    rooms: list[int] = []
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if room not in bins:
            insort(rooms, room)
        bins[room][items] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, (size,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * size, (size,) * (n % each), 1)
                break
            room = rooms[k]
            items, there = next(iter(bins[room].items()))
            each = min(room // size, n)  # best fit stays with a bin until its room is too small
            used = min(there, n // each)
            del bins[room][items]
            if there > used:
                bins[room][items] = there - used
            elif not bins[room]:
                del bins[room]
                rooms.pop(k)
            put(room - each * size, items + (size,) * each, used)
            n -= used * each
    return [(items, n) for group in bins.values() for items, n in group.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes of one sequence, how many such sequences) that hold every item."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """(size, rank) -> (sequence, offset), from the plan's intervals of ranks."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows, taken, base = defaultdict(list), defaultdict(int), 0
        for items, n in patterns:
            offset = 0
            for size in items:
                rows[size].append((taken[size], base, offset))
                taken[size] += n
                offset += size
            base += n
        self.at = {size: np.array(x, np.int64).T for size, x in rows.items()}

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if len(at):
                start, base, off = self.at[int(size[at[0]])]
                k = np.searchsorted(start, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - start[k], off[k]
        return sequence, offset


# the data ------------------------------------------------------------------------------------------------------------------

_PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    """The pieces of every document, numbered within each size and task."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), text_column(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in steps(batches, "text"):
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = np.array([*encode(text), 0], "<u4")
                at, k = 0, 0
                while at < len(ids):
                    end = at + ((len(ids) - at - 1) % capacity) + 1  # the first piece takes what is left over
                    row.append(i), piece.append(k), start.append(at), length.append(end - at)
                    crc.append(zlib.crc32(ids[at:end].tobytes()))
                    nth.append(seen[end - at])
                    seen[end - at] += 1
                    at, k = end, k + 1
            columns = [pa.array(x, f.type) for x, f in zip((piece, start, length, crc, [task] * len(row), nth), _PIECES, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row, pa.int64())), *columns], ["id", *_PIECES.names])

    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    path = tokenizer_path or default_tokenizer_path()
    cutting = cut(pieces(df, id_col, text_col, path, capacity))
    per_task = cutting.groupBy("length", "task").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {int(r[0]): int(r[1]) for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    places = df.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = places.value.place(size, rank)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cutting.join(offsets, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
