"""Records to parts: grouping by description, sums, occurrences, suppliers, and the nested document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean_description, description_key, shortened

GROUP = ["doc_id", "key"]


def keyed(records: DataFrame) -> DataFrame:
    """records with cleaned description and key; records without a key go, with all they hold."""
    cleaned = records.withColumn("cleaned", clean_description(F.col("description"), F.col("commodity")))
    return cleaned.withColumn("key", description_key(F.col("cleaned"))).filter("key != ''")


def _joined(sorted_structs, field: str):
    return F.transform(F.array_sort(sorted_structs), lambda x: x[field])


def groups(rows: DataFrame) -> DataFrame:
    """One row a part: doc_id, key, first_seq, description, total_quantity, uom, commodity, n_occurrences.

    All are partial aggregates: the first of each by ordered minimum, the sum exact in decimals.
    """
    some = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("record_seq"))
    return rows.groupBy(*GROUP).agg(
        F.min("record_seq").alias("first_seq"),
        F.min_by("cleaned", "record_seq").alias("description"),
        F.sum(F.coalesce("quantity", F.lit(0.0)).cast("decimal(38,6)")).cast("double").alias("total_quantity"),
        F.min_by("uom", some("uom")).alias("uom"),
        F.min_by("commodity", some("commodity")).alias("commodity"),
        F.count(F.lit(1)).alias("n_occurrences"),
    )


def internal_parts(rows: DataFrame) -> DataFrame:
    """doc_id, key, parts: distinct part numbers in order of first appearance."""
    first = rows.groupBy(*GROUP, "internal_part").agg(F.min("record_seq").alias("seq"))
    return first.groupBy(*GROUP).agg(_joined(F.collect_list(F.struct("seq", "internal_part")), "internal_part").alias("parts"))


def occurrences(rows: DataFrame) -> DataFrame:
    """doc_id, key, occurrences: array of (internal_author_part, quantity, parent_internal_part) in order."""
    x = F.array_sort(F.collect_list(F.struct("record_seq", "internal_part", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), "parent")))
    return rows.groupBy(*GROUP).agg(F.transform(x, lambda r: F.struct(r["internal_part"].alias("internal_author_part"), r["quantity"].alias("quantity"), r["parent"].alias("parent_internal_part"))).alias("occurrences"))


def candidates(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Supplier rows (doc_id, record_seq, row_pos, name_text, part_text, page) with their part's key, in document order: seq."""
    first = rows.groupBy(*GROUP).agg(F.min("record_seq").alias("group_seq"))
    both = suppliers.join(rows.select("doc_id", "record_seq", "key"), ["doc_id", "record_seq"]).join(first, GROUP)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("group_seq", "record_seq", "row_pos")).cast("long"))


def unique_suppliers(accepted: DataFrame) -> DataFrame:
    """One row for each part, canonical name and part number: the first seen (confidence depends on the number alone)."""
    order = Window.partitionBy(*GROUP, "canonical", "part_text").orderBy(F.desc("confidence"), "seq")
    return accepted.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def hard_rejected(scored: DataFrame) -> DataFrame:
    """doc_id, nth, token, reason, page, row of date- and quantity-shaped supplier parts, in document order."""
    some = scored.filter(F.col("reason").isin("date_shaped", "quantity_shaped"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return some.select("doc_id", nth.alias("nth"), F.col("part_text").alias("token"), "reason", "page", F.col("row_pos").alias("row"))


def first_warnings(warnings: DataFrame) -> DataFrame:
    """warnings (doc_id, source_rank, page, code, ..): the first of each code."""
    order = Window.partitionBy("doc_id", "code").orderBy("source_rank", "page")
    return warnings.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def parts(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Nested parts: suppliers are unique_suppliers' rows."""
    own = suppliers.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("name_text").alias("name_raw"), F.col("canonical").alias("name_normalized"), F.col("part_text").alias("part_number"), F.col("confidence").alias("confidence_score"), F.col("is_internal").alias("is_internal_author_part")))).alias("s"))
    drop = lambda x: F.struct(*(x[f].alias(f) for f in ("name_raw", "name_normalized", "part_number", "confidence_score", "is_internal_author_part")))
    none = "array<struct<name_raw:string,name_normalized:string,part_number:string,confidence_score:double,is_internal_author_part:boolean>>"
    out = groups(rows).join(internal_parts(rows), GROUP).join(occurrences(rows), GROUP).join(own, GROUP, "left")
    return out.select("doc_id", "first_seq", "description", "total_quantity", "uom", "commodity", F.col("parts").alias("internal_author_parts"), "occurrences", F.coalesce(F.transform("s", drop), F.array().cast(none)).alias("suppliers"))


def documents(part_rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """doc_id, metadata, parts: one nested row a document; metadata has doc_id and the fields of the struct."""
    fields = [c for c in metadata.columns if c != "doc_id"]
    inner = [c for c in part_rows.columns if c not in ("doc_id", "first_seq")]
    nested = part_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", F.struct(*inner).alias("p"))), lambda a, b: F.when(a["first_seq"] < b["first_seq"], -1).otherwise(1)).alias("x"))
    return metadata.join(nested, "doc_id", "left").select("doc_id", F.struct(*fields).alias("metadata"), F.coalesce(F.transform("x", lambda r: r["p"]), F.array()).alias("parts"))


def violations(part_rows: DataFrame) -> DataFrame:
    """doc_id, description, rule for parts that break the contract: ranges, and strings without outer blanks."""
    rules = {
        "total_quantity": F.col("total_quantity") < 0,
        "occurrence_quantity": F.exists("occurrences", lambda o: o["quantity"] < 0),
        "confidence": F.exists("suppliers", lambda s: (s["confidence_score"] < 0) | (s["confidence_score"] > 1)),
        "trimmed": (F.trim("description") != F.col("description")) | F.exists("suppliers", lambda s: F.trim(s["part_number"]) != s["part_number"]),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return part_rows.select("doc_id", "description", F.explode(broken).alias("rule"))


def occurrence_lines(part_rows: DataFrame, width: int = 80) -> DataFrame:
    """doc_id, first_seq, occ_idx, line: the summary report."""
    names = F.array_join(F.transform("suppliers", lambda s: F.concat(s["name_normalized"], F.lit(" "), s["part_number"])), "; ")
    rows = part_rows.withColumn("names", F.when(F.size("suppliers") > 0, names).otherwise("(none)"))
    rows = rows.select("doc_id", "first_seq", "description", "names", F.posexplode("occurrences").alias("occ_idx", "o"))
    parent = F.col("o.parent_internal_part")
    under = F.when(parent.isNotNull() & (parent != ""), F.concat(F.lit(" (parent="), parent, F.lit(")"))).otherwise("")
    line = F.concat(F.col("o.internal_author_part"), under, F.lit("  |  "), shortened(F.col("description"), width), F.lit("  |  "), F.col("names"))
    return rows.select("doc_id", "first_seq", "occ_idx", line.alias("line"))
