"""The whole plan: words to lines, layout, pattern, records, parts and nested documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import idpattern, layout, lines, names, records, rollup, scoring
from millrace.sources import config
from millrace.sources.scratch import Scratch
from millrace.sources.words import SPARSE_WORDS, sparse_pages

VERSION = "0.1.0"


class HeaderError(RuntimeError):
    """A page's header lacks a mandatory column."""


@dataclass
class Parse:
    """Relations of all documents at once; each is a lazy plan. ``strict`` raises for the first page whose header is incomplete, otherwise
    such pages are left out and stand in ``errors``."""

    spark: SparkSession
    words: DataFrame
    pages: DataFrame
    strict: bool = False
    synonyms: dict | None = None
    aliases: dict | None = None
    weights: config.Weights = config.Weights()
    min_words: int = SPARSE_WORDS

    @cached_property
    def keep(self):
        """Writes a stage's table to the shared folder and rereads it: later stages use it several times, and a lost executor repeats one stage only."""
        return Scratch(self.spark, "parse").keep

    @cached_property
    def placed(self):
        return self.keep(lines.line_words(self.words))

    @cached_property
    def lines(self):
        return self.keep(lines.lines(self.placed))

    @cached_property
    def hits(self):
        return self.keep(layout.phrase_hits(self.placed, config.synonym_table(self.spark, self.synonyms)))

    @cached_property
    def runs(self):
        return layout.header_runs(self.lines, self.hits)

    @cached_property
    def best(self):
        return self.keep(layout.best_runs(self.runs))

    @cached_property
    def matched(self):
        return self.keep(layout.best_matches(self.hits, self.best))

    @cached_property
    def missing(self):
        out = layout.missing_columns(self.pages, self.matched)
        if self.strict and (row := out.orderBy("doc_id", "page", "column").first()):
            raise HeaderError(f"{row.doc_id}, page {row.page}: no header for {row.column}")
        return out

    @cached_property
    def errors(self):
        some = self.missing.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("missing"))
        return some.join(layout.suspected_words(self.placed, self.best, self.missing), ["doc_id", "page"], "left")

    @cached_property
    def layouts(self):
        return self.keep(layout.page_layout(self.placed, self.lines, self.pages, self.best, self.missing))

    @cached_property
    def bands(self):
        return self.keep(layout.column_bands(self.matched, self.layouts))

    @cached_property
    def id_tokens(self):
        pooled = idpattern.pool_id_tokens(self.words, self.layouts, self.bands)
        return self.keep(pooled.withColumn("seq", F.col("page").cast("long") * 1_000_000 + F.col("word_id")))

    @cached_property
    def docs(self):
        return self.pages.select("doc_id").distinct()

    @cached_property
    def patterns(self):
        return self.keep(idpattern.discovered(self.docs, self.id_tokens))

    @cached_property
    def body_words(self):
        return self.keep(records.body_words(self.placed, records.body_lines(self.lines, self.layouts), self.bands))

    @cached_property
    def kinds(self):
        return records.classified(self.body_words, self.patterns)

    @cached_property
    def assigned(self):
        return records.assigned(self.kinds)

    @cached_property
    def record_words(self):
        return self.keep(records.record_words(self.body_words, self.assigned))

    @cached_property
    def records(self):
        return self.keep(records.records(self.record_words, self.bands, self.keep))

    @cached_property
    def supplier_rows(self):
        return self.keep(records.supplier_rows(self.record_words))

    @cached_property
    def keyed(self):
        return self.keep(rollup.keyed(self.records))

    @cached_property
    def scored(self):
        rows = rollup.candidates(self.keyed, self.supplier_rows).join(self.patterns.select("doc_id", "pattern"), "doc_id")
        return self.keep(scoring.scored(rows, "part_text", weights=self.weights))

    @cached_property
    def names(self):
        rows = scoring.accepted(self.scored).select("doc_id", "seq", F.col("name_text").alias("raw_name"))
        return self.keep(names.resolved(rows, config.alias_table(self.spark, self.aliases)))

    @cached_property
    def suppliers(self):
        rows = scoring.accepted(self.scored).join(self.names.select("doc_id", F.col("raw_name").alias("name_text"), "canonical"), ["doc_id", "name_text"])
        return self.keep(rollup.unique_suppliers(rows))

    @cached_property
    def parts(self):
        return self.keep(rollup.parts(self.keyed, self.suppliers))

    @cached_property
    def warnings(self):
        """doc_id, source_rank, page, code: from reading, layout and pattern discovery."""
        sparse = sparse_pages(self.words, self.pages, self.min_words).select("doc_id", F.lit(0).alias("source_rank"), "page", F.lit("ocr_fallback_used").alias("code"))
        apart = layout.adjacency_warnings(self.bands).select("doc_id", F.lit(1).alias("source_rank"), "page", "code")
        unsure = self.patterns.filter("fallback").select("doc_id", F.lit(2).alias("source_rank"), F.lit(None).cast("int").alias("page"), F.lit("low_confidence_internal_pattern").alias("code"))
        return rollup.first_warnings(sparse.unionByName(apart).unionByName(unsure))

    @cached_property
    def metadata(self):
        ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
        pages = self.pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
        new = names.new_suppliers(self.names).groupBy("doc_id").agg(F.transform(ordered("nth", "canonical"), lambda x: x["canonical"]).alias("new_supplier_candidates"))
        rejects = rollup.hard_rejected(self.scored).groupBy("doc_id").agg(F.transform(ordered("nth", "token", "reason", "page", "row"), lambda x: x.dropFields("nth")).alias("hard_rejected_candidates"))
        warned = self.warnings.groupBy("doc_id").agg(F.transform(ordered("source_rank", "page", "code"), lambda x: F.struct(x["code"].alias("code"), x["page"].alias("page"))).alias("warnings"))
        out = pages.join(self.patterns.select("doc_id", F.col("pattern").alias("discovered_internal_pattern")), "doc_id")
        for more in (new, rejects, warned):
            out = out.join(more, "doc_id", "left")
        return out.withColumns({"source_file": F.regexp_extract("doc_id", "[^/]*$", 0), "parser_version": F.lit(VERSION), "extracted_at": F.current_timestamp()})

    @cached_property
    def documents(self):
        return rollup.documents(self.parts, self.metadata)

    @cached_property
    def summary(self):
        return rollup.occurrence_lines(self.parts)

    def inspect(self) -> dict[str, DataFrame]:
        """What a reader wants to see first: counts, the first page's bands, and the patterns."""
        counts = self.pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count")).join(self.words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words")), "doc_id", "left")
        return {"counts": counts.withColumn("n_words", F.coalesce("n_words", F.lit(0))), "bands": self.bands.filter("page = 0"), "patterns": self.patterns}
