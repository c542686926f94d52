"""Balanced sharding by vector bin packing.

A *group* is all rows of one text. Groups carry a vector (bytes, tokens, rows); each is placed where the dot product of its vector
with the residual capacity is highest, largest first. No machine has to see all groups:

* groups are dealt by hash to ``BUCKETS`` buckets. A task packs each bucket's groups into ``n_shards`` *crates*, streaming them
  largest first, so that it holds the crates' residuals only;
* the driver packs the crates (at most ``n_shards * BUCKETS``, whatever the input) into the shards by the same rule. A group that
  is large for its bucket has a crate almost for itself and is placed on its own.

A group stays on one shard unless it is larger than a shard in some dimension; such a group (there are at most 3 * n_shards) is cut
into chunks of an eighth of a shard by a hash of its rows' ids, so a group with a third of all rows spreads over the shards.

Law ``bytes``: the shards' sizes are near equal (tokens and rows are balanced with them, less strictly). Tokens are those of
the byte-level vocabulary that packing uses.

Null texts count as empty, rows with a null id are kept, repeated rows each get a slot of their own, ties go to the lower shard, an empty
table gives an empty result, and further columns of the input, whatever their names, are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts, table
from .tokens import byte_codec

BUCKETS, PER_SHARD, LANES = 256, 8, 4096
DIMENSIONS = ("size", "tokens", "rows")


class Packer:
    """Shards with residual capacity in each dimension; capacities are 1."""

    def __init__(self, n_shards: int, n_dimensions: int = 3):
        self.residual = np.ones((n_shards, n_dimensions))

    def place(self, unit: np.ndarray) -> int:
        """The shard whose residual has the largest dot product with ``unit``, which is taken from it; ties go to the lower one."""
        best = int(np.argmax(self.residual @ unit))
        self.residual[best] -= unit
        return best


def pack_vectors(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (non-negative, one column a dimension), largest first."""
    if not len(vectors):
        return np.zeros(0, dtype=np.int64)
    total = vectors.sum(axis=0)
    unit = vectors / np.where(total > 0, total, 1) * n_shards
    packer = Packer(n_shards, vectors.shape[1])
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-unit.max(axis=1), kind="stable"):
        out[i] = packer.place(unit[i])
    return out


def _measured(docs: DataFrame, path: str | None) -> DataFrame:
    """doc_id, salt, size, tokens, text_crc32, digest of each row."""

    def rows(texts):
        codec, out = byte_codec(path), []
        for t in texts:
            raw = (t or "").encode("utf-8")
            out.append((len(raw) + 16, len(codec.encode(t)), zlib.crc32(raw), hashlib.md5(raw).digest()))
        return list(zip(*out, strict=True))

    # rows without an id are told apart by their place
    salt = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), salt.alias("salt"), F.col("text").cast("string").alias("text"))
    return map_texts(kept, rows, "doc_id long, salt long, size long, tokens long, text_crc32 long, digest binary")


def _crates(groups: DataFrame, n_shards: int, totals: dict[int, tuple]) -> DataFrame:
    """digest, chunk, bucket, crate of each of the groups (digest, chunk, bucket, size, tokens, rows). totals: each bucket's sums."""
    schema = pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("crate", pa.int32())])

    def run(batches):
        bucket, packer, scale = None, None, None
        for batch in batches:
            buckets = batch.column(2).to_numpy()
            vectors = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], axis=1).astype(float)
            crates = np.empty(len(buckets), dtype=np.int32)
            for i, b in enumerate(buckets.tolist()):
                if b != bucket:
                    bucket, packer, scale = b, Packer(n_shards), n_shards / np.maximum(1, np.array(totals[b], dtype=float))
                crates[i] = packer.place(vectors[i] * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), batch.column(1), batch.column(2), pa.array(crates)], schema=schema)

    share = F.greatest(*(F.col(k) / F.lit(float(max(1, sum(t[i] for t in totals.values())))) for i, k in enumerate(DIMENSIONS)))
    dealt = groups.withColumn("_share", share).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", F.desc("_share"), "digest", "chunk")
    return dealt.select("digest", "chunk", "bucket", *DIMENSIONS).mapInArrow(run, "digest binary, chunk int, bucket int, crate int")


def shard_rows(docs: DataFrame, n_shards: int = 40, path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.keep(_measured(docs, path))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    share = F.greatest(*(F.col(k) / F.lit(float(max(1, total[k] or 0))) for k in DIMENSIONS))
    whole = rows.groupBy("digest").agg(*sums).filter(share > 1.0 / n_shards)
    # at most 3 * n_shards rows, by the filter
    cuts = whole.select("digest", F.ceil(share * n_shards * PER_SHARD).cast("int").alias("chunks")).collect()
    cut = spark.createDataFrame([(bytes(r.digest), r.chunks) for r in cuts], "digest binary, chunks int")
    chunk = F.coalesce(F.pmod(F.col("salt"), F.col("chunks")).cast("int"), F.lit(0))
    parts = rows.join(F.broadcast(cut), "digest", "left").withColumn("chunk", chunk).drop("chunks")
    bucket = F.pmod(F.xxhash64("digest", "chunk"), F.lit(BUCKETS)).cast("int")
    groups = scratch.keep(parts.groupBy("digest", "chunk").agg(*sums).withColumn("bucket", bucket))
    totals = {r.bucket: (r["size"], r.tokens, r["rows"]) for r in groups.groupBy("bucket").agg(*(F.sum(k).alias(k) for k in DIMENSIONS)).collect()}  # at most BUCKETS rows
    crates = _crates(groups, n_shards, totals)
    placed = scratch.keep(parts.join(crates, ["digest", "chunk"]))
    # crates are numbered in lanes, so that a crate of many rows spreads over tasks: at most n_shards * BUCKETS crates and LANES lanes more
    unit = ["bucket", "crate"]
    loads = sorted(placed.groupBy(*unit).agg(*sums).collect(), key=lambda r: (r.bucket, r.crate))
    shards = pack_vectors(np.array([(r["size"], r.tokens, r["rows"]) for r in loads], dtype=float).reshape(-1, 3), n_shards)
    most = max(1, total["rows"] or 0)
    where = spark.createDataFrame([(r.bucket, r.crate, int(s), 1 + r["rows"] * LANES // most) for r, s in zip(loads, shards, strict=True)], "bucket int, crate int, shard int, lanes int")
    laned = placed.join(F.broadcast(where), unit).withColumn("lane", F.pmod(F.col("salt"), F.col("lanes")).cast("int")).drop("lanes")
    filled, bases = [0] * n_shards, []
    for r in sorted(laned.groupBy(*unit, "lane").agg(F.first("shard").alias("shard"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r.bucket, r.crate, r.lane)):
        bases.append((r.bucket, r.crate, r.lane, filled[r.shard]))
        filled[r.shard] += r.n
    base = spark.createDataFrame(bases, "bucket int, crate int, lane int, base long")
    within = Window.partitionBy(*unit, "lane").orderBy("doc_id", "text_crc32", "size", "digest")
    return laned.withColumn("nth", F.row_number().over(within)).join(F.broadcast(base), [*unit, "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
