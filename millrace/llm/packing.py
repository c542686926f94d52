"""Packing into fixed windows by minimum bin slack over the multiset of remaining lengths.

A document of n ids (its text's and an end id) gives n // capacity full pieces and a tail. Only the tails' *histogram* matters for the plan:
at most ``capacity`` counters whatever the input. The driver repeats: seed a window with the longest remaining length, find by a
bitset subset-sum program over the other lengths (with their counts) the sum closest to the room left, backtrack how many of
each length it takes, and use this pattern as often as the counts allow. If room is left although pieces remain, the longest one is
cut to fill it; what is left of it goes back into the histogram. So all sequences but the last are full.

Pieces learn their place by rank within their length: lengths are split into sub-buckets in proportion to their share
(at most ``BUCKETS`` plus one a length) by a hash of the row's place in the input, so a length that a third of all documents have still
spreads over many tasks, also where all those rows are the same.

Null texts count as empty (a document of the end id alone); null ids and repeated rows are documents of their own; an empty table
gives no rows; further columns are ignored. Any text is encoded whole.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .tokens import END, byte_codec

CAPACITY, BUCKETS = 2048, 65536


def closest_sum(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest possible up to room: bitset subset sums, backtracked."""
    mask = (1 << (room + 1)) - 1
    reach, before = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:  # powers of two cover any number up to the count
            k = min(step, left)
            reach |= (reach << (k * length)) & mask
            left, step = left - k, step * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, earlier in reversed(before):
        k = 0
        while not earlier >> (at - k * length) & 1:
            k += 1
        if k:
            taken[length] = k
            at -= k * length
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Placements, one row each: class (a tail's length), first rank, end rank, offset within the tail, length of the piece, number
    of the first piece in its pattern, pieces of this length in a window, first sequence, offset of the first such piece there."""
    stock = {n: deque([(n, 0, c, 0)]) for n, c in histogram.items() if c}
    counts = {n: c for n, c in histogram.items() if c}
    out, sequence = [], 0

    def draw(length: int, number: int) -> list[tuple]:
        got = []
        while number:
            source, rank, have, offset = stock[length].popleft()
            use = min(have, number)
            got.append((source, rank, rank + use, offset))
            if have > use:
                stock[length].appendleft((source, rank + use, have - use, offset))
            number -= use
        return got

    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = closest_sum(counts, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in taken.items())
        slack = capacity - sum(n * k for n, k in taken.items())
        rest = {n: c - taken.get(n, 0) for n, c in counts.items()}
        cut = max((n for n, c in rest.items() if c > 0 and n > slack), default=0) if slack else 0
        if cut:
            times = max(1, min(times, *(counts[n] // (k + (n == cut)) for n, k in taken.items()), counts[cut] // (taken.get(cut, 0) + 1)))
        at = 0
        for length, k in sorted(taken.items(), reverse=True):
            first = 0
            for source, a, b, offset in draw(length, k * times):
                out.append((source, a, b, offset, length, first, k, sequence, at))
                first += b - a
            counts[length] -= k * times
            at += k * length
        if cut:
            first = 0
            for source, a, b, offset in draw(cut, times):
                out.append((source, a, b, offset, slack, first, 1, sequence, at))
                first += b - a
                stock.setdefault(cut - slack, deque()).append((source, a, b - a, offset + slack))
            counts[cut] -= times
            counts[cut - slack] = counts.get(cut - slack, 0) + times
        counts = {n: c for n, c in counts.items() if c}
        sequence += times
    return np.array(out, dtype=np.int64).reshape(-1, 9)


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary, salt long"
PLACED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(docs: DataFrame, capacity: int, path: str | None) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("salt", pa.int64())])

    def run(batches):
        codec = byte_codec(path)
        narrow = "<u2" if codec.size <= 1 << 16 else "<u4"
        for batch in batches:
            for part in slices(batch, 512):
                rows = []
                for doc, text, salt in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = np.append(codec.encode(text), np.uint32(END)).astype("<u4")
                    n = len(ids)
                    for a in range(0, n, capacity):
                        own = ids[a : a + capacity]
                        rows.append((doc, a, len(own), zlib.crc32(own.tobytes()), n, own.astype(narrow).tobytes(), salt))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("salt")).mapInArrow(run, PIECES)


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, and ids, its ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(_pieces(docs, capacity, path))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    total = max(1, sum(histogram.values()))
    split = spark.createDataFrame([(n, max(1, -(-c * BUCKETS // total))) for n, c in histogram.items()], "length int, parts int")
    spread = pieces.join(F.broadcast(split), "length").withColumn("part", F.pmod(F.xxhash64("start", "salt"), F.col("parts")).cast("int"))
    # at most BUCKETS parts, and one a length
    sizes = sorted(spread.groupBy("length", "part").count().collect(), key=lambda r: (r.length, r.part))
    filled: dict[int, int] = {}
    bases = []
    for r in sizes:
        bases.append((r.length, r.part, filled.get(r.length, 0)))
        filled[r.length] = filled.get(r.length, 0) + r["count"]
    base = spark.createDataFrame(bases, "length int, part int, base long")
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = spread.withColumn("nth", nth).join(F.broadcast(base), ["length", "part"]).select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("base") + F.col("nth") - 1).alias("rank"))
    plans = plan(histogram, capacity)
    by_class = {int(n): plans[plans[:, 0] == n] for n in np.unique(plans[:, 0])} if len(plans) else {}
    # for each class the placements by first rank; pieces cut from one tail share ranks, so all that hold a rank are looked up
    schema = pa.schema([(n.split()[0], pa.binary() if n.endswith("binary") else pa.int64()) for n in PLACED.split(", ")])

    def run(batches):
        edges = {}
        for n, p in by_class.items():
            cuts = np.unique(np.concatenate([p[:, 1], p[:, 2]]))
            edges[n] = (cuts, [p[(p[:, 1] <= x) & (p[:, 2] > x)][:, 1:].tolist() for x in cuts])
        for batch in batches:
            for part in slices(batch, 2048):
                rows = []
                for doc, start, length, n, ids, rank in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    cuts, places = edges[length]
                    wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * length else "<u4").astype("<u4").tobytes()
                    for first, _, offset, size, t, k, sequence, at in places[int(np.searchsorted(cuts, rank, side="right")) - 1]:
                        t += rank - first
                        rows.append((doc, start + offset, size, n, sequence + t // k, at + t % k * size, wide[4 * offset : 4 * (offset + size)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return ranked.mapInArrow(run, PLACED)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
