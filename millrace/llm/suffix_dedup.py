"""Removal of repeated byte strings by column-wise construction of collection suffix orders.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier (smaller doc_id, or earlier in the document). Windows are judged on
the input, and each distinct window keeps its first occurrence only.

1. *Anchors.* Each window selects the least (hashed, leftmost) of its strings of ``GRAM`` bytes. Equal windows select the same anchor at the
   same place, so a window can only repeat if its anchor does: anchors that occur once drop out by a count with partial aggregates.
2. *Segments.* A repeated anchor brings the bytes of all windows that select it, at most 2 * WINDOW - GRAM. Segments are gathered by anchor;
   an anchor with more than ``GROUP`` occurrences is dealt to several groups.
3. *Column-wise construction.* The distinct segments of some groups form a collection. Each round inserts one symbol of each segment, from the
   right: the place of the longer suffix is the LF mapping of the place of the shorter one in the collection's Burrows-Wheeler transform. The
   transform and the common prefixes are updated in the same round, each column in one sequential pass. Neighbours in the finished order
   whose common prefix reaches WINDOW are equal windows. A collection has about ``COLLECTION`` bytes (a group of at most ``GROUP`` segments
   more), so its columns are held in memory, in place of external files.
4. Where an anchor was dealt to several groups, each group's first occurrences meet again by the window's 128-bit hash, a minimum with
   partial aggregates.

Null texts count as empty; texts shorter than a window lose nothing. If ids are null or repeated, rows are ordered by id (nulls last), then by text. Any
length of text works in pieces of bounded size, and repeated rows lose all that the first one holds; an empty table gives no rows; further columns are ignored by the query
and passed through by :func:`deduplicated`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import Scratch, replaced, slices, table, text_of
from .ngram_join import mixed

WINDOW, GRAM, CHUNK = 100, 32, 1 << 16
GROUP, COLLECTION = 1000, 1 << 20
HELD = 200_000  # segments that a task remembers, so as not to send later copies of them

_SEED = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position: pairs, then pairs of pairs."""
    h, width = _SEED[raw], 1
    for step in _STEPS:
        h = (h[:-width] * step) ^ (h[width:] + (h[:-width] >> np.uint64(29)))
        width *= 2
    return mixed(h)


def anchor_runs(raw: np.ndarray):
    """Yields, piece by piece, (anchor hash, anchor position, first window, last window) arrays of a text of at least WINDOW bytes."""
    span = WINDOW - GRAM + 1  # grams in a window
    shift = np.uint64(20)
    for begin in range(0, len(raw) - WINDOW + 1, CHUNK):
        own = raw[begin : begin + CHUNK + WINDOW - 1]
        h = gram_hashes(own)
        key = (h >> shift << shift) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        at = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        yield h[at[first]], at[first] + begin, first + begin, last + begin


def suffix_order(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the segments in sorted order, as segment * 256 + start, and the common prefix of each with the one before it.
    Segments have at most 255 bytes below 0xFF; equal suffixes follow the segments' order.

    Round k inserts the suffix of length k of each segment. Behind symbol c the suffixes keep the order of what follows it, so the new place of
    c + s is the rank of s's entry among the transform's symbols, and c + s shares one symbol more with the one before it than s
    does with the last earlier entry of c: the least common prefix in between. All columns are read and written once a round, in order."""
    m = len(segments)
    lengths = np.array(list(map(len, segments)), dtype=np.int64)
    text = np.full((m, int(lengths.max(initial=0)) + 1), 0xFF, dtype=np.uint8)  # 0xFF stands before the first symbol
    for i, s in enumerate(segments):
        text[i, 1 : len(s) + 1] = np.frombuffer(s, dtype=np.uint8)
    # a row holds a suffix's number above, and the symbol before it (the transform) in its lowest byte
    kind = np.dtype("<u4") if m <= 1 << 16 else np.dtype("<u8")

    def rows(which, start):
        return ((which * 256 + start) << 8 | text[which, start]).astype(kind)

    place, start = np.arange(m), lengths.copy()
    held, prefix = rows(place, start), np.zeros(m, dtype=np.uint8)
    active = np.flatnonzero(start > 0)
    while len(active):
        n = len(held)
        symbols = np.ascontiguousarray(held.view(np.uint8)[:: kind.itemsize])
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        ranks = rank[place[active]].astype(np.int64)
        new = m + ranks
        start[active] -= 1
        fresh = np.zeros(n + len(active), dtype=bool)
        fresh[new] = True
        merged, common = np.empty(n + len(active), dtype=kind), np.empty(n + len(active), dtype=np.uint8)
        merged[~fresh], common[~fresh] = held, prefix
        merged[new] = rows(active, start[active])
        # the new suffixes and those behind them
        touched = np.zeros(n + 1, dtype=bool)
        touched[ranks] = touched[ranks + 1] = True
        changed = np.flatnonzero(touched[: n - m + len(active)])
        here, before = order[changed], order[changed - 1]
        alike = np.flatnonzero((changed > 0) & (symbols[here] == symbols[before]))
        value = np.zeros(len(changed), dtype=np.uint8)
        if len(alike):
            # spans by their start, so that nothing between them is read
            alike = alike[np.argsort(before[alike], kind="stable")]
            spans = np.stack([before[alike] + 1, here[alike] + 1], axis=1).ravel()
            value[alike] = np.minimum.reduceat(np.append(prefix, np.uint8(0xFF)), spans)[::2] + np.uint8(1)
        common[m + changed] = value
        held, prefix, place[active] = merged, common, new
        active = active[start[active] > 0]
    return held >> 8, prefix


def equal_windows(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, segment, start) of each window of the segments, classes ascending: windows of one class are equal."""
    order, prefix = suffix_order(segments)
    lengths = np.array(list(map(len, segments)), dtype=np.int64)
    segment, start = (order >> 8).astype(np.int64), (order & 255).astype(np.int64)
    # shorter suffixes have shorter common prefixes, so a window's class ends where one falls short, also behind suffixes left out
    kind = np.cumsum(prefix < WINDOW)
    keep = start + WINDOW <= lengths[segment]
    return kind[keep], segment[keep], start[keep]


def mark_collection(number: np.ndarray, at: np.ndarray, anchor: np.ndarray, own: list[bytes]) -> tuple[tuple, tuple]:
    """For segments (text's order number, first window, anchor, bytes): the marked byte intervals (order number, start, stop), and the runs of windows
    that are the first of their kind here (index of the segment, first window in it, last window in it)."""
    order = np.lexsort((at, number))
    own = [own[k] for k in order.tolist()]
    number, at, anchor = number[order], at[order], anchor[order]
    lengths = np.array(list(map(len, own)), dtype=np.int64)
    seen: dict[bytes, int] = {}
    copy = np.array([seen.setdefault(o, k) for k, o in enumerate(own)], dtype=np.int64) != np.arange(len(own))
    marks = [(number[copy], at[copy], at[copy] + lengths[copy])]
    distinct = np.flatnonzero(~copy)
    _, group, members = np.unique(anchor[distinct], return_inverse=True, return_counts=True)
    alone = distinct[members[group] == 1]
    firsts = [(order[alone], np.zeros(len(alone), dtype=np.int64), lengths[alone] - WINDOW)]
    several = distinct[members[group] > 1]
    if len(several):
        kind, segment, start = equal_windows([own[k] for k in several.tolist()])
        segment = several[segment]
        by = np.lexsort((at[segment] + start, number[segment], kind))
        kind, segment, start = kind[by], segment[by], start[by]
        repeated = np.concatenate([[False], kind[1:] == kind[:-1]])
        by = np.lexsort((start, segment))
        repeated, segment, start = repeated[by], segment[by], start[by]
        cuts = np.flatnonzero((np.diff(segment) != 0) | (np.diff(repeated.astype(np.int8)) != 0) | (np.diff(start) != 1)) + 1
        head, tail = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(segment) - 1]])
        late = repeated[head]
        k = segment[head]
        marks.append((number[k][late], (at[k] + start[head])[late], (at[k] + start[tail] + WINDOW)[late]))
        firsts.append((order[k[~late]], start[head][~late], start[tail][~late]))
    return tuple(np.concatenate(x) for x in zip(*marks, strict=True)), tuple(np.concatenate(x) for x in zip(*firsts, strict=True))


def _ordered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with ``_ord``, a number that orders rows by doc_id. Ids that are whole, present and unique serve as they are."""
    n = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    unique = n[0] == n[1] and docs.select("doc_id").distinct().count() == n[0]
    if unique:
        return docs.withColumn("_ord", F.col("doc_id").cast("long"))
    sorted_ = docs.withColumn("_key", F.md5(F.encode(text_of(), "UTF-8"))).orderBy(F.col("doc_id").asc_nulls_last(), "_key").drop("_key")
    return scratch.keep(sorted_.withColumn("_ord", F.monotonically_increasing_id()))


def _anchors(docs: DataFrame) -> DataFrame:
    """anchor, _ord, n: the distinct anchors of each text and how often it has them."""
    schema = pa.schema([("anchor", pa.int64()), ("_ord", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                texts, numbers = part.column(1), part.column(0).to_numpy()
                for k in range(part.num_rows):
                    raw = np.frombuffer(texts[k].as_buffer(), dtype=np.uint8)
                    if len(raw) >= WINDOW:
                        h, n = np.unique(np.concatenate([run[0] for run in anchor_runs(raw)]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.full(len(h), numbers[k])), pa.array(n.astype(np.int32))], schema=schema)

    def merged(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return docs.select("_ord", text_of().alias("text")).mapInArrow(merged, "anchor long, _ord long, n int")


_TEXTS = "_ord long, anchor long, part int, parts int, first int, stop int, own binary, text string, size long, sha256 string"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _segments(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Four kinds of rows: segments of the repeated anchors of each text (own set); intervals that are marked already, as their segment came
    before, as far as the task remembers (stop set); the texts that hold such anchors (text set), and size and digest of the others. places: _ord, found: array of (anchor, parts)."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (c.split() for c in _TEXTS.split(", "))])

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for part in slices(batch, 128):
                some = pc.is_valid(part.column(2))
                yield rows(_ord=part.column(0).filter(some), text=part.column(1).filter(some))
                rest = part.filter(pc.invert(some))
                left = [t.as_buffer() for t in rest.column(1)]
                yield rows(_ord=rest.column(0), size=[t.size for t in left], sha256=[hashlib.sha256(t).hexdigest() for t in left])
                held, owns, marks = [], [], []
                for number, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    if not found.is_valid:
                        continue
                    raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                    whole = raw.tobytes()
                    wanted = found.values
                    known, parts = wanted.field(0).to_numpy(), wanted.field(1).to_numpy()
                    by = np.argsort(known)
                    known, parts = known[by], parts[by]
                    salt = int(mixed(np.array([number], dtype=np.int64).astype(np.uint64))[0] >> np.uint64(33))
                    again = []
                    if len(seen) > HELD:
                        seen.clear()
                    for h, x, first, last in anchor_runs(raw):
                        h = h.astype(np.int64)
                        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        hit = np.flatnonzero(known[k] == h)
                        new = []
                        for i, a, b in zip(hit.tolist(), first[hit].tolist(), (last[hit] + WINDOW).tolist(), strict=True):
                            own = whole[a:b]
                            if seen.get(own, (number, a)) < (number, a):
                                again.append((a, b))
                            else:
                                seen[own] = (number, a)
                                owns.append(own)
                                new.append(i)
                        if new:
                            p = parts[k[new]]
                            held.append((np.full(len(new), number), h[new], (salt + x[new]) % p, p, first[new]))
                    marks += [(number, a, b) for a, b in _merged(again)]
                if marks:
                    number, a, b = zip(*marks, strict=True)
                    yield rows(_ord=number, first=a, stop=b)
                if held:
                    number, anchor, which, p, first = (np.concatenate(c) for c in zip(*held, strict=True))
                    yield rows(_ord=number, anchor=anchor, part=which.astype(np.int32), parts=p.astype(np.int32), first=first.astype(np.int32), own=owns)

    joined = docs.select("_ord", text_of().alias("text")).join(places, "_ord", "left").select("_ord", "text", "found")
    return joined.mapInArrow(run, _TEXTS)


_MARKS = "_ord long, start int, stop int, window binary"


def _marked(segments: DataFrame) -> DataFrame:
    """Marked intervals (window null), and for anchors in several groups each group's first windows (window: its hash)."""
    schema = pa.schema([("_ord", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.binary())])

    def close(t: pa.Table):
        number, anchor, parts, at = (t.column(n).to_numpy() for n in ("_ord", "anchor", "parts", "first"))
        own = t.column("own").to_pylist()
        (who, start, stop), (k, first, last) = mark_collection(number, at.astype(np.int64), anchor, own)
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.nulls(len(who), pa.binary())], schema=schema)
        split = parts[k] > 1
        rows = [(int(number[i]), int(at[i]) + w, int(at[i]) + w + WINDOW, hashlib.blake2b(own[i][w : w + WINDOW], digest_size=16).digest()) for i, a, b in zip(k[split].tolist(), first[split].tolist(), last[split].tolist(), strict=True) for w in range(a, b + 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.nbytes > COLLECTION:
                anchor, part = held.column("anchor").to_numpy(), held.column("part").to_numpy()
                edges = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1  # a group stays whole
                share = COLLECTION * len(anchor) // held.nbytes
                edges = edges[edges >= min(share, edges[-1])] if len(edges) else edges
                if not len(edges):
                    break
                n = int(edges[0])
                yield from close(held.slice(0, n))
                held = held.slice(n)
        if held is not None and held.num_rows:
            yield from close(held)

    dealt = segments.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(run, _MARKS)


def _covered(marks: DataFrame) -> DataFrame:
    """_ord, cover: the marked intervals of each row."""
    return marks.groupBy("_ord").agg(F.collect_list(F.struct("start", "stop")).alias("cover"))


def _texts_and_cover(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`_segments`, and (_ord, cover) of those that lose bytes."""
    anchors = scratch.keep(_anchors(docs))
    again = scratch.keep(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")))
    hits = scratch.keep(anchors.join(again, "anchor").select("_ord", "anchor", "parts"))
    scratch.drop(anchors, again)
    places = hits.groupBy("_ord").agg(F.collect_list(F.struct("anchor", "parts")).alias("found"))
    both = scratch.keep(_segments(docs, places))
    scratch.drop(hits)
    segments = both.filter("own IS NOT NULL").select("_ord", "anchor", "part", "parts", "first", "own")
    marked = scratch.keep(_marked(segments))
    known = both.filter("stop IS NOT NULL").select("_ord", F.col("first").alias("start"), "stop")
    sure = marked.filter("window IS NULL").select("_ord", "start", "stop").unionByName(known)
    open_ = marked.filter("window IS NOT NULL")
    first = scratch.keep(open_.groupBy("window").agg(F.min(F.struct("_ord", "start")).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "place"))
    late = open_.join(first, "window").filter(F.struct("_ord", "start") > F.col("place")).select("_ord", "start", "stop")
    cover = _covered(sure.unionByName(late))
    return both, cover


def cut(raw: bytes, cover: list[tuple[int, int]] | None) -> tuple[bytes, int]:
    """What is left of raw without the covered bytes, and the number of maximal removed runs."""
    if not cover:
        return raw, 0
    kept, at, runs = [], 0, 0
    stop = -1
    for a, b in sorted(cover):
        if a > stop:
            runs += 1
            kept.append(raw[at:a])
            stop = b
        else:
            stop = max(stop, b)
        at = stop
    kept.append(raw[at:])
    return b"".join(kept), runs


RESULT = "_ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = _ordered(docs.select("doc_id", "text"), scratch)
    both, cover = _texts_and_cover(rows, scratch)
    texts = both.filter("text IS NOT NULL").select("_ord", "text")
    whole = both.filter("sha256 IS NOT NULL").select("_ord", F.col("size").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    schema = pa.schema([("_ord", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                out = []
                for number, text, own in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    left, runs = cut(raw, own and [(c["start"], c["stop"]) for c in own])
                    out.append((number, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    done = texts.join(cover, "_ord", "left").select("_ord", "text", "cover").mapInArrow(run, RESULT).unionByName(whole)
    if "_ord" in rows.columns and hasattr(rows, "_scratch"):  # ids were numbered
        return done.join(rows.select("_ord", "doc_id"), "_ord").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.select(F.col("_ord").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated(docs: DataFrame, least: int = 1) -> DataFrame:
    """docs with the repeated bytes cut out of each text; rows of which fewer than ``least`` bytes are left, though they had some, are dropped.

    A cut that falls inside a character leaves out its other bytes, too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    # the input's columns travel in one struct, so that no name of theirs can clash
    rows = _ordered(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), scratch)
    _, cover = _texts_and_cover(rows, scratch)
    some = rows.join(scratch.keep(cover), "_ord", "left").select("_row", "cover", "text")

    def cut_texts(batches):
        for batch in batches:
            for part in slices(batch, 256):
                texts, good = [], []
                for text, covered in zip(part.column(2), part.column(1).to_pylist(), strict=True):
                    if covered:
                        left, _ = cut(text.as_buffer().to_pybytes(), [(c["start"], c["stop"]) for c in covered])
                        texts.append(left.decode("utf-8", "ignore"))
                        good.append(len(left) >= least)
                    else:
                        texts.append(text.as_py())
                        good.append(True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(good, pa.bool_())], names=["_row", "_text", "_good"])

    schema = StructType([some.schema["_row"], StructField("_text", StringType()), StructField("_good", BooleanType())])
    return some.mapInArrow(cut_texts, schema).filter("_good").select(*replaced(docs, F.col("_text")))


def query(spark, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
