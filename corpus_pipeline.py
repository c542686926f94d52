"""Documents to training sequences, in five stages; counted as part of the ``llm`` subpackage.

Each stage works on all rows its predecessor kept, read again from Parquet, and its decisions take effect. All but the last return the columns of documents:

* toxicity: rows predicted toxic go;
* ngram_join: of each class of near copies the row with the least doc_id stays (null ids last, then the least text digest);
* suffix_dedup: byte strings that also start earlier are cut out of the texts; rows of which nothing is left go;
* pii: personal data and terms that disclose it are replaced;
* packing: what is left becomes pieces of fixed sequences.

Labels come from the input folder; only the learned model, never a row's label, decides.

All stages take null texts as empty ones (and leave them null), rows with null or repeated ids as rows of their own, texts of any length whole,
and pass further columns through whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ngram_join, packing, pii, suffix_dedup, toxicity
from millrace.llm.common import Scratch, table, text_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is judged by its text alone; rows of equal texts share their fate. Null and empty texts stay, as nothing in them is toxic."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, whatever its ids: classes are told apart by a digest. Texts without words, null ones among them, are copies
    of each other. Ties go to the least id, nulls last, then the least text digest; of rows equal in both, any one stays."""
    scratch = Scratch(spark, "near")
    linked = ngram_join.linked(docs, scratch=scratch)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("of")
    keep = scratch.keep(linked.groupBy("root").agg(first).select(F.col("of.doc_id").alias("doc_id"), F.col("of.tkey").alias("tkey")))
    # the input's columns travel in one struct, so that no name of theirs can clash
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_of"), F.unhex(F.md5(F.encode(text_of(), "UTF-8"))).alias("_tkey"))
    joined = keyed.join(keep, F.col("_of").eqNullSafe(F.col("doc_id")) & (F.col("_tkey") == F.col("tkey")), "leftsemi")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    # only a table that repeats an id can hold two rows of one text and id here
    return (joined.dropDuplicates(["_of", "_tkey"]) if repeated else joined).select("_row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows count in the order of their ids (nulls last), then of their texts' digests; the first keeps what repeats. A row that had a text
    and loses all of it goes; null and empty texts stay."""
    return suffix_dedup.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; equal texts are replaced alike."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row, repeated ones too, becomes pieces of its own; a null or empty text is one end id."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("suffix_dedup", cut_repeats), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs


#: SQL expresses neither the learned model nor the merges of the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None
