"""N-gram Jaccard join by chosen paths.

A document is the set of its word 5-grams (one gram of all words, if it has fewer; words are lower-cased and split at white space).
Documents with equal sets form a class of copies and take part once.

Chosen paths. A set is embedded as ``COORDS`` minhash values. Each run is a tree: its root, and each node with more than ``SMALL`` sets,
samples one coordinate, or with probability 1/4 two (1 / threshold in the mean), and splits its sets by their values there, so that
a pair at the threshold meets in one child in the mean. Buckets of at most SMALL sets, and those at depth ``DEPTH``, are compared by
brute force. The runs are repeated until a pair at the threshold meets with probability ``recall`` even at the full depth.

Buckets of near copies, or of much shared boilerplate, hardly fall apart by splitting, so each large bucket is peeled first: sets whose sketches
may be linked to one of its pivots leave it, and every set that the triangle inequality lets be a partner of such a set is connected
to that pivot. Only pivots with many sets around them are used; a set gets an edge to each pivot that it meets, at most PIVOTS.

Brute force compares sketches and yields a spanning forest of the pairs that may reach the threshold (five standard deviations of
allowance), never the pairs themselves. The sets of each connected part are then brought together and every pair is verified exactly, by
differences: with D(X) = X xor P for any common set P, |A xor B| = |D(A)| + |D(B)| - 2 |D(A) and D(B)|, so only grams in which near copies
*differ* are counted, term at a time. Texts are read and turned into grams once. A part too large for one task travels as its
differences from one of its sets and is compared as pairs of blocks of about ``SPREAD`` * sqrt(n) of its n sets, so that both the
copies of a row and the rows of a task grow with the root of n. Blocks return sums of links and spanning edges only; no link is lost.

Null texts count as empty. Texts without words have the empty set and are copies of each other. Texts of any length are taken whole. Null ids
are kept; repeated rows count as documents; ties go to the least id, then the least digest; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, table, text_of
from .components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDS, SMALL, DEPTH = 64, 256, 4
#: Pivots of a large bucket; a pivot counts if this share of the bucket may be linked to it.
PIVOTS, SHARE = 4, 0.05
#: Grams of a block, least number of sets of a block, and sets of a block for the root of its part's sets.
BLOCK_GRAMS, BLOCK_DOCS, SPREAD = 1_000_000, 512, 16

_rng = np.random.default_rng(20240501)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**64, COORDS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, COORDS, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    raw = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    blanks = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(raw)]])
    k = min(n, len(starts)) - 1
    starts, ends = starts[: len(starts) - k], ends[k:]
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _power(_BASE, len(raw)), out=prefix[1:])
    return np.unique(mixed((prefix[ends] - prefix[starts]) * _power(_INVERSE, len(raw))[starts]))


def sketch(own: np.ndarray) -> np.ndarray:
    """The minhash value of each coordinate, 32 bits each."""
    least = np.full(COORDS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(own), 4096):
        least = np.minimum(least, (own[k : k + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    return (mixed(least) >> np.uint64(32)).astype("<u4")


def least_alike(threshold: float) -> int:
    """Coordinates in which the sketches of a pair at the threshold agree at least, but for five standard deviations."""
    return max(1, math.floor(COORDS * threshold - 5 * math.sqrt(COORDS * threshold * (1 - threshold))))


def missed(threshold: float, runs: int, depth: int = DEPTH) -> float:
    """How likely a pair at the threshold meets in no run at the given depth, over all numbers of coordinates in which its sketches may agree."""
    out = 0.0
    for alike in range(COORDS + 1):
        share = math.comb(COORDS, alike) * threshold**alike * (1 - threshold) ** (COORDS - alike)
        meet = 1.0
        for _ in range(depth):
            miss = 1 - alike / COORDS * meet
            meet = 1 - (0.75 * miss + 0.25 * miss**2)
        out += share * ((1 - meet) ** runs if alike >= least_alike(threshold) else 1.0)
    return out


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets at the full depth at least once with the given probability."""
    return next(r for r in range(1, 1000) if missed(threshold, r, depth) <= 1 - recall)


def chosen(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node its sampled coordinates; the second is -1 three times out of four."""
    h = mixed(nodes.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    first = (h % np.uint64(COORDS)).astype(np.int64)
    step = 1 + ((h >> np.uint64(8)) % np.uint64(COORDS - 1)).astype(np.int64)
    return first, np.where((h >> np.uint64(32)) % np.uint64(4) == 0, (first + step) % COORDS, -1)


def child(nodes: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mixed(mixed(nodes ^ (coordinate.astype(np.uint64) * np.uint64(_BASE))) + value.astype(np.uint64) * np.uint64(_INVERSE))


def _set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (digest of the text), n (grams), digest (of the set), sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.binary()), ("n", pa.int32()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                n, digests, sketches = [], [], []
                for text in part.column(2).to_pylist():
                    own = grams(text)
                    n.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sketches.append(sketch(own).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.binary()), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], schema=schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(text_of(), "UTF-8"))).alias("tkey"), text_of().alias("text"))
    return keyed.mapInArrow(run, "doc_id long, tkey binary, n int, digest binary, sketch binary")


_BUCKET = "bucket long, digest binary, low binary"


def _roots(sets: DataFrame, runs: int) -> DataFrame:
    """The children of each run's root: bucket, digest, low (a byte of each coordinate's value)."""
    schema = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("low", pa.binary())])
    root = mixed(np.arange(1, runs + 1, dtype=np.uint64))
    first, second = chosen(root)
    nodes = np.concatenate([root, root[second >= 0]])
    coords = np.concatenate([first, second[second >= 0]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                full = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u4").reshape(-1, COORDS)
                buckets = child(nodes[None, :], coords[None, :], full[:, coords]).astype(np.int64)
                low = [x.tobytes() for x in (full & 0xFF).astype(np.uint8)]
                each = pa.array(np.repeat(np.arange(len(full)), len(coords)))
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), part.column(0).take(each), pa.array(low, pa.binary()).take(each)], schema=schema)

    return sets.select("digest", "sketch").mapInArrow(run, _BUCKET)


def _children(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("low", pa.binary())])

    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy().astype(np.uint64)
            low = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, COORDS)
            for coords in chosen(nodes):
                some = np.flatnonzero(coords >= 0)
                buckets = child(nodes[some], coords[some], low[some, coords[some]]).astype(np.int64)
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column(1).take(at), batch.column(2).take(at)], schema=schema)

    return rows.select("bucket", "digest", "low").mapInArrow(run, _BUCKET)


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row of its component."""
    m = len(near)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], m).min(axis=1, initial=m))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _candidates(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Spanning edges u, v of the sketch-similar sets of each group; rows: keys, side, digest, low. Where a group holds two sides, all are compared."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])
    n = len(keys)

    def pairs(digests, low):
        """Groups of two, many at once: rows 2k and 2k + 1."""
        near = (low[0::2] == low[1::2]).sum(axis=1) >= least
        at = np.flatnonzero(near)
        return [digests[2 * k] for k in at], [digests[2 * k + 1] for k in at]

    def group(digests, low):
        near = np.zeros((len(low), len(low)), dtype=bool)
        for i in range(len(low) - 1):
            near[i, i + 1 :] = (low[i + 1 :] == low[i]).sum(axis=1) >= least
        root = forest(near | near.T)
        at = np.flatnonzero(root != np.arange(len(low)))
        return [digests[i] for i in at], [digests[root[i]] for i in at]

    def run(batches):
        held, two = None, ([], [])

        def close(us, vs):
            key, digests, low = held
            if len(digests) == 2:
                two[0].extend(digests)
                two[1].extend(low)
            elif len(digests) > 2:
                u, v = group(digests, np.frombuffer(b"".join(low), dtype=np.uint8).reshape(-1, COORDS))
                us += u
                vs += v

        def flush(us, vs):
            if two[0]:
                u, v = pairs(two[0], np.frombuffer(b"".join(two[1]), dtype=np.uint8).reshape(-1, COORDS))
                us += u
                vs += v
                two[0].clear()
                two[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=schema)

        for batch in batches:
            us, vs = [], []
            columns = [batch.column(k).to_pylist() for k in range(n)]
            digests, low = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            for k, key in enumerate(zip(*columns, strict=True)):
                if held is None or held[0] != key:
                    if held is not None:
                        close(us, vs)
                    held = (key, [], [])
                held[1].append(digests[k])
                held[2].append(low[k])
            yield flush(us, vs)
        if held is not None:
            us, vs = [], []
            close(us, vs)
            yield flush(us, vs)

    dealt = rows.select(*keys, "digest", "low").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u binary, v binary")


def _peeled(large: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Edges u, v of the sets around the pivots of large buckets, and the rows of ``large`` that are still to be compared."""
    picks = [F.min(F.struct(F.xxhash64("digest", F.lit(k)).alias("h"), "digest", "low")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = scratch.keep(large.groupBy("bucket").agg(*picks).select("bucket", *(F.col(f"p{k}")[c].alias(f"{c}{k}") for k in range(PIVOTS) for c in ("digest", "low"))))
    schema = pa.schema([("bucket", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("low", pa.binary()), *((f"d{k}", pa.int32()) for k in range(PIVOTS))])

    def run(batches):
        for batch in batches:
            own, *others = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, COORDS) for k in range(3, 4 + PIVOTS))
            apart = [pa.array((own != x).sum(axis=1).astype(np.int32)) for x in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *apart], schema=schema)

    joined = large.join(pivots, "bucket").select("bucket", "size", "digest", "low", *(f"low{k}" for k in range(PIVOTS)))
    names = ", ".join(f"d{k} int" for k in range(PIVOTS))
    measured = scratch.keep(joined.mapInArrow(run, f"bucket long, size long, digest binary, low binary, {names}"))
    around = measured.groupBy("bucket").agg(F.first("size").alias("_size"), *(F.count_if(F.col(f"d{k}") <= COORDS - least).alias(f"n{k}") for k in range(PIVOTS)))
    valid = {k: F.col(f"n{k}") >= F.greatest(F.lit(16), F.col("_size") * SHARE) for k in range(PIVOTS)}
    good = around.join(pivots, "bucket").select("bucket", *(F.when(valid[k], F.col(f"digest{k}")).alias(f"digest{k}") for k in range(PIVOTS)))
    # as tables of their own, so that a hot bucket's rows can be split
    good = scratch.keep(good)
    judged = scratch.keep(measured.join(good, "bucket"))
    near = lambda k, most: F.col(f"digest{k}").isNotNull() & (F.col(f"d{k}") <= most)
    met = F.array(*(F.when(near(k, 2 * (COORDS - least)), F.col(f"digest{k}")) for k in range(PIVOTS)))
    edges = judged.select(F.col("digest").alias("u"), F.explode(F.array_distinct(F.array_compact(met))).alias("v")).filter("u != v")
    edges = scratch.keep(edges.distinct())
    gone = F.greatest(*(near(k, COORDS - least) for k in range(PIVOTS)))
    rest = scratch.keep(judged.filter(~gone).select("bucket", "size", "digest", "low"))
    scratch.drop(measured, pivots, good, judged)
    return edges, rest


def _paired_blocks(rows: DataFrame, blocks, block) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: columns i <= j."""
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    out = rows.withColumns({"_own": block, "_n": blocks}).withColumn("_other", other)
    return out.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_other", "_n")


def _gram_rows(rows: DataFrame) -> DataFrame:
    """rows (digest, comp, blocks, copies, text) with n and the grams of the text, as bytes, in its place."""
    schema = pa.schema([("digest", pa.binary()), ("comp", pa.binary()), ("blocks", pa.int32()), ("copies", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                own = [grams(t) for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k).cast(schema.field(k).type) for k in range(4)), pa.array(list(map(len, own)), pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "digest binary, comp binary, blocks int, copies long, n int, grams binary")


def _different(rows: DataFrame) -> DataFrame:
    """rows (digest, comp, copies, n, grams) of large parts, with what their grams differ in from those of the part's own set: its symmetric difference."""
    centre = rows.filter("digest = comp").select("comp", F.col("grams").alias("_centre"))
    schema = pa.schema([("digest", pa.binary()), ("comp", pa.binary()), ("copies", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("apart", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                apart = [np.setxor1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True).tobytes() for x, y in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k).cast(schema.field(k).type) for k in range(5)), pa.array(apart, pa.binary())], schema=schema)

    joined = rows.join(centre.hint("merge"), "comp").select("digest", "comp", "copies", "n", "grams", "_centre")
    return joined.mapInArrow(run, "digest binary, comp binary, copies long, n int, grams binary, apart binary")


def _blocks(sets, sums):
    """Blocks of a part of ``sets`` sets with ``sums`` grams."""
    return F.greatest(F.ceil(sums / BLOCK_GRAMS), F.ceil(sets / F.greatest(F.lit(BLOCK_DOCS), SPREAD * F.sqrt(sets)))).cast("int")


def compared(i: int, j: int, own: np.ndarray, sizes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For block i's sets against those of block j (the same, if i = j): the links of each set, and the least set of its component here. own: block of each
    set, sizes: of the whole sets, sets: the sets, or their symmetric differences from any common set."""
    m = len(sets)
    values, term = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(m), list(map(len, sets)))
    # differences from the grams that most sets hold
    common = np.bincount(term, minlength=len(values)) * 2 > m
    number = np.cumsum(common) - 1
    held = np.zeros((m, int(common.sum())), dtype=bool)
    often = common[term]
    held[doc[often], number[term[often]]] = True
    lacks, which = np.nonzero(~held)
    doc, term = np.concatenate([doc[~often], lacks]), np.concatenate([term[~often], np.flatnonzero(common)[which]])
    apart = np.bincount(doc, minlength=m)
    by_doc = np.argsort(doc, kind="stable")
    terms, ends = term[by_doc], np.cumsum(apart)
    # postings of block j
    others = np.flatnonzero(own == j)
    place = np.full(m, -1)
    place[others] = np.arange(len(others))
    posted = np.flatnonzero(own[doc] == j)
    posted = posted[np.argsort(term[posted], kind="stable")]
    postings, counts = place[doc[posted]], np.bincount(term[posted], minlength=len(values))
    begin = np.cumsum(counts) - counts
    links, label = np.zeros(m, dtype=np.int64), np.arange(m)
    most = (1 - threshold) * sizes[others] - (1 + threshold) * apart[others] + 1e-9
    for x in np.flatnonzero(own == i):
        mine = terms[ends[x] - apart[x] : ends[x]]
        lengths = counts[mine]
        total = int(lengths.sum())
        room = most + ((1 - threshold) * sizes[x] - (1 + threshold) * apart[x])
        if total:
            where = np.repeat(begin[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
            room += 2 * (1 + threshold) * np.bincount(postings[where], minlength=len(others))
        near = room >= 0
        if i == j:
            near[place[x]] = False
        near = others[near]
        if not len(near):
            continue
        links[x] += copies[near].sum()
        if i != j:
            links[near] += copies[x]
        met = label[near]
        if (met != label[x]).any():
            met = np.unique(np.append(met, label[x]))
            label[np.isin(label, met)] = met[0]
    return links, label


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """digest, links, root for each group comp, i, j of rows (comp, i, j, _own, digest, copies, n, grams): exact Jaccard of all pairs in it."""
    schema = pa.schema([("digest", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches):
        held = None

        def close():
            (_, i, j), own, digests, copies, sizes, sets = held
            if len(digests) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
            links, label = compared(i, j, np.array(own), np.array(sizes, dtype=np.int64), np.array(copies, dtype=np.int64), sets, threshold)
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array([digests[x] for x in some], pa.binary()), pa.array(links[some]), pa.array([digests[label[x]] for x in some], pa.binary())], schema=schema)

        for batch in batches:
            for part in slices(batch, 1024):
                for comp, i, j, own, digest, copies, n, own_grams in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held is None or held[0] != (comp, i, j):
                        if held is not None:
                            yield close()
                        held = ((comp, i, j), [], [], [], [], [])
                    for x, value in zip(held[1:], (own, digest, copies, n, np.frombuffer(own_grams, dtype=np.uint64)), strict=True):
                        x.append(value)
        if held is not None:
            yield close()

    dealt = rows.select("comp", "i", "j", F.col("_own").alias("own"), "digest", "copies", "n", "grams").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return dealt.mapInArrow(run, "digest binary, links long, root binary")


def linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, class_id, n_links, rep_id, tkey (digest of the text) and root for each row of docs (doc_id, text).

    class_id: least doc_id of all documents that links connect; n_links: other documents at or above the threshold, copies included;
    rep_id: least doc_id with the same set; root: digest of a set of the class, which tells classes apart even where ids are null or repeated.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    rows = scratch.keep(_set_rows(docs))
    # a class's text is that of its least (doc_id, text digest)
    sets = scratch.keep(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "tkey")).alias("of"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    least = least_alike(threshold)
    buckets, edges = _roots(sets.filter("n > 0"), runs_needed(threshold, recall)), []
    for depth in range(1, DEPTH + 1):
        sizes = scratch.keep(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        live = scratch.keep(buckets.join(sizes.hint("merge"), "bucket"))
        scratch.drop(sizes)
        edges.append(scratch.keep(_candidates(live.filter(F.col("size") <= SMALL), ["bucket"], least)))
        large = live.filter(F.col("size") > SMALL)
        if large.isEmpty():
            scratch.drop(live)
            break
        around, large = _peeled(large, least, scratch)
        edges.append(around)
        scratch.drop(live)
        if depth == DEPTH:
            # compared as pairs of blocks of about SMALL sets
            blocks = F.ceil(F.col("size") / SMALL).cast("int")
            blocked = _paired_blocks(large, blocks, F.pmod(F.xxhash64("digest"), blocks).cast("int"))
            edges.append(scratch.keep(_candidates(blocked, ["bucket", "i", "j"], least)))
        else:
            buckets = _children(large)
    found = edges[0]
    for e in edges[1:]:
        found = found.unionByName(e)
    parts = scratch.keep(components(found, scratch).select(F.col("node").alias("digest"), F.col("root").alias("comp")))
    scratch.drop(*edges)
    members = scratch.keep(parts.join(sets.select("digest", "of", "copies", "n"), "digest"))
    bulk = scratch.keep(members.groupBy("comp").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")))
    wanted = scratch.keep(members.join(bulk, "comp").select("digest", "comp", "blocks", "copies", F.col("of.doc_id").alias("doc_id"), F.col("of.tkey").alias("tkey")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.unhex(F.md5(F.encode(text_of(), "UTF-8"))).alias("tkey"), text_of().alias("text"))
    # neither side has a bound, so none is broadcast, however small it looks
    with_text = wanted.hint("merge").join(texts, (wanted.tkey == texts.tkey) & wanted.doc_id.eqNullSafe(texts._id)).select("digest", "comp", "blocks", "copies", "text").dropDuplicates(["digest"])
    sets_of = scratch.keep(_gram_rows(with_text))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    whole = sets_of.filter("blocks = 1").select("comp", "digest", "copies", "n", "grams", "blocks")
    apart = scratch.keep(_different(sets_of.filter("blocks > 1").select("digest", "comp", "copies", "n", "grams")))
    # parts whose sets have little in common travel as they are
    size = lambda c: F.sum(F.octet_length(c) / 8)
    spread = apart.groupBy("comp").agg((size("apart") < size("grams")).alias("_apart"), _blocks(F.count(F.lit(1)), F.least(size("apart"), size("grams"))).alias("blocks"))
    spread = scratch.keep(spread)
    differ = apart.join(spread.hint("merge"), "comp").select("comp", "digest", "copies", "n", F.when(F.col("_apart"), F.col("apart")).otherwise(F.col("grams")).alias("grams"), "blocks")
    checked = scratch.keep(_verified(_paired_blocks(whole.unionByName(differ), F.col("blocks"), block), threshold))
    scratch.drop(wanted, members, bulk, parts, sets_of, apart, spread)
    links = checked.groupBy("digest").agg(F.sum("links").alias("links"))
    joined = scratch.keep(components(checked.select(F.col("digest").alias("u"), F.col("root").alias("v")), scratch))
    roots = sets.select("digest", "rep_id", "copies").join(joined.withColumnRenamed("node", "digest"), "digest", "left").join(links, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = scratch.keep(roots)
    ids = scratch.keep(classes.groupBy("root").agg(F.min("rep_id").alias("class_id")))
    table_ = scratch.keep(classes.join(ids, "root").select("digest", "rep_id", "class_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return rows.select("doc_id", "tkey", "digest").join(table_, "digest").select("doc_id", "class_id", "n_links", "rep_id", "tkey", "root")


def query(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "rep_id")
