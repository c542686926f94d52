"""One registered query for each operator, over whole tables. Their SQL is in oracle.py, written apart from this code."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import geometry, idpattern, layout, names, records, rollup, scoring
from millrace.operators import lines as L
from millrace.plans import render
from millrace.plans.parse import Parse
from millrace.sources import config, sinks
from millrace.sources.scratch import Scratch
from millrace.sources.words import doc_metadata, list_sources, read_words, sparse_pages, word_projection

SPARSE = 90  # the rendering's last pages have fewer words
_parses: dict[tuple[str, str], Parse] = {}


def parsed(spark: SparkSession, sf_dir: str) -> Parse:
    """The parse of the rendered part table; queries of one session share the stages that it has written."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _parses:
        _parses.clear()
        _parses[key] = Parse(spark, *render.rendered(spark, sf_dir), min_words=SPARSE)
    return _parses[key]


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made records: each order a document, each of its lines a record. Windows and groups stay within an order or a part."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    item = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    commodity = F.upper(F.element_at(F.split("p_type", " "), 1))
    return item.join(part, "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        seq.alias("record_seq"),
        F.format_string("LB%06d", "l_partkey").alias("internal_part"),
        F.concat_ws(" ", F.when(F.col("l_linenumber") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")), F.lit("HD 5"), commodity).alias("description"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("quantity"),
        F.when(F.col("l_linenumber") != 1, "EA").alias("uom"),
        F.when(F.col("l_linenumber") % 3 != 1, commodity).alias("commodity"),
        F.lit(None).cast("string").alias("parent"),
        "l_suppkey", "p_brand", "p_size", "l_linenumber",
    )


def score_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, token, pattern: every shape of part number, and shapes that are none, over the whole part table."""
    k = F.col("p_partkey").cast("string")
    shapes = ["12/5/2019", "1998-1-30", "37.5000", "", "   ", "88 K 140", "TRV 90-Q-7-B-20-2-PLC-", "410077.3105", "gasket", "QR,ST", "K,L;M", "W4V", '18"', "9-foot hose, 3yard", "  rsTUv  "]
    token = F.coalesce(F.get(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % 20).cast("int")), F.when(F.col("p_partkey") % 20 == 15, F.concat(F.lit("KV"), F.lpad(k, 6, "0"))).when(F.col("p_partkey") % 20 == 16, F.concat(F.lit("731-"), k)).when(F.col("p_partkey") % 20 == 17, F.concat(F.lit("worn label, "), k)).when(F.col("p_partkey") % 20 == 18, F.concat(F.col("p_name"), F.lit("?"))).otherwise(F.regexp_replace("p_brand", "#", "-")))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("seq"), token.alias("token"), F.lit(T.FALLBACK_ID).alias("pattern"))


RAW_NAMES = ("mcmaster-carr ", "NORTH  COAST", "Modicon:", "ncc;", "Larkspur Valves", "HD Motion", "12/40", "Café Müller", "OE", "usS", "quill", "SE", "LARCO", "US   Sensor", "Omega!", "Škoda Ŵerke", "LV")


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, raw_name over the whole supplier table."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    spelled = F.get(F.array(*map(F.lit, RAW_NAMES)), (F.col("s_suppkey") % 20).cast("int"))
    return s.select(F.col("s_nationkey").cast("string").alias("doc_id"), F.col("s_suppkey").alias("seq"), F.coalesce(spelled, F.col("s_name")).alias("raw_name"))


def aliases(spark):
    return config.alias_table(spark)


def _keyed(spark, d):
    return rollup.keyed(order_records(spark, d))


def _order_candidates(spark, d):
    """Supplier rows of the orders' records, scored; the supplier's name stands for its canonical one."""
    recs = order_records(spark, d)
    supplier = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("canonical"))
    number = F.when(F.col("l_linenumber") == 4, "2024-04-18").when(F.col("l_linenumber") == 5, "no,;").otherwise(F.concat(F.lit("MPN-"), F.col("p_size").cast("string")))
    rows = recs.join(supplier, "l_suppkey").select("doc_id", "record_seq", F.lit(0).alias("row_pos"), F.col("canonical").alias("name_text"), "canonical", number.alias("part_text"), F.lit(0).alias("page"))
    return scoring.scored(rollup.candidates(rollup.keyed(recs), rows).withColumn("pattern", F.lit(T.FALLBACK_ID)), "part_text")


def flagship(spark, d):
    """Parts of all orders: quantities, occurrences and suppliers rolled up by description."""
    recs = _keyed(spark, d).withColumn("doc_id", F.lit("all"))
    # a supplier counts once a part: one scan, sums of pairs before the shuffle, then sums of those by part
    pairs = recs.groupBy("key", "l_suppkey").agg(F.sum(F.coalesce("quantity", F.lit(0.0)).cast("decimal(28,6)")).alias("q"), F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col("key").alias("description")).agg(F.sum("q").cast("double").alias("total_quantity"), F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_suppliers"))


def _of(relation: str, *columns: str):
    return lambda spark, d: getattr(parsed(spark, d), relation).select(*columns)


def _flat(df: DataFrame, **arrays: str) -> DataFrame:
    return df.withColumns({k: F.array_join(v, "|") for k, v in arrays.items()})


def _metadata_fixture(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return doc_metadata(s.select(F.col("s_suppkey").cast("string").alias("doc_id"), F.when(F.col("s_suppkey") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "s_name")).alias("title"), F.lit(None).cast("string").alias("creator"), F.lit("pdf").alias("producer")))


def _part_rows(documents):
    """The content of nested documents, a row a part."""
    p = documents.select("doc_id", F.posexplode("parts").alias("nth", "p")).select("doc_id", "nth", "p.*")
    said = lambda o: F.concat_ws(":", o["internal_author_part"], F.format_string("%.2f", o["quantity"]), F.coalesce(o["parent_internal_part"], F.lit("")))
    named = lambda s: F.concat_ws(" ", s["name_normalized"], s["part_number"])
    return p.select("doc_id", "nth", "description", "total_quantity", "uom", "commodity", F.array_join("internal_author_parts", "|").alias("internal_parts"), F.array_join(F.transform("occurrences", said), "|").alias("occurrences"), F.array_join(F.transform("suppliers", named), "|").alias("suppliers"))


def _written_documents(spark, d, write=sinks.write_documents, some="true"):
    """The documents, written as JSON and read again."""
    at = f"{Scratch(spark, 'json').at}/documents"
    write(parsed(spark, d).documents.filter(some), at)
    return sinks.read_documents(spark, at)


def _golden(spark, d):
    kind = f"struct<metadata:struct<page_count:bigint,discovered_internal_pattern:string,extracted_at:string>,parts:array<{sinks.PART}>>"
    g = sinks.golden(parsed(spark, d).documents).withColumn("g", F.from_json("json", kind))
    total = F.aggregate("g.parts", F.lit(0.0), lambda a, p: a + p["total_quantity"])
    return g.select("doc_id", F.col("g.metadata.page_count").alias("page_count"), F.col("g.metadata.discovered_internal_pattern").alias("pattern"), F.size("g.parts").alias("n_parts"), F.when(F.size("g.parts") > 0, F.round(total, 2)).alias("total"), F.col("g.metadata.extracted_at").isNull().alias("timeless"))


def _word_files(spark, d):
    """The rendered words as tab-separated files, a document each."""
    at = f"{Scratch(spark, 'files').at}/words"
    line = F.concat_ws("\t", "page", "text", "x0", "x1", "top", "bottom")
    ordered = parsed(spark, d).words.repartition("doc_id").sortWithinPartitions("doc_id", "page", "word_id")
    ordered.select("doc_id", line.alias("value")).write.partitionBy("doc_id").text(at)
    return at


def _doc_of(path):
    return F.regexp_extract(path, "doc_id=([^/]+)", 1).alias("doc_id")


def _scanned(spark, d):
    return read_words(spark, _word_files(spark, d), glob="*.txt", recursive=True).select(_doc_of("doc_id"), "page", "word_id", "text", "x0", "x1", "top", "bottom")


def _listed(spark, d):
    return list_sources(spark, _word_files(spark, d), recursive=True, glob="*.txt").select(_doc_of("path"), (F.col("length") > 0).alias("filled"))


def _configured(spark, value, read):
    """``read`` of a configuration file that holds ``value``; JSON is YAML, too."""
    at = f"{Scratch(spark, 'config').at}/file"
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(at)
    return read(spark, at)


def _summary_file(spark, d):
    at = f"{Scratch(spark, 'summary').at}/lines"
    sinks.write_summary(_order_lines(spark, d), at)
    return spark.read.text(at).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def _order_lines(spark, d):
    return rollup.occurrence_lines(rollup.parts(_keyed(spark, d), rollup.unique_suppliers(scoring.accepted(_order_candidates(spark, d)))), 24)


def _inspect(spark, d):
    x = parsed(spark, d).inspect()
    bands = x["bands"].groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "column"))), lambda r: r["column"]), ",").alias("columns"))
    return x["counts"].join(x["patterns"].select("doc_id", "pattern", F.round("match_rate", 6).alias("match_rate")), "doc_id").join(bands, "doc_id", "left")


def _overlaps(spark, d):
    p = parsed(spark, d)
    hit = geometry.span_overlaps(F.col("x0"), F.col("x1"), F.col("x_min"), F.col("x_max"))
    return p.words.join(p.bands, ["doc_id", "page"]).filter(hit).groupBy("doc_id", "page", "column").agg(F.count(F.lit(1)).alias("n"))


def _contains(spark, d):
    p = parsed(spark, d)
    hit = geometry.span_contains((F.col("x0") + F.col("x1")) / 2, F.col("x_min"), F.col("x_max"))
    return p.words.join(p.bands, ["doc_id", "page"]).filter(hit).groupBy("doc_id", "page", "column").agg(F.count(F.lit(1)).alias("n"))


def _measures(spark, d):
    p = parsed(spark, d)
    order = F.array(*map(F.lit, config.COLUMNS))
    return p.bands.select("doc_id", "page", "column", geometry.span_width(F.col("x_min"), F.col("x_max")).alias("width"), geometry.column_rank(order, F.col("column")).alias("place"), geometry.column_rank(order, F.lit("none")).alias("nowhere"))


def _candidates(spark, d):
    return idpattern.candidates(parsed(spark, d).id_tokens)


def _cont(spark, d):
    p = parsed(spark, d)
    return records.continuation(p.record_words, p.bands)


def _resolved(spark, d):
    return names.resolved(raw_names(spark, d), aliases(spark)).select("doc_id", "raw_name", "canonical", "how")


def _scored(spark, d):
    return scoring.scored(score_tokens(spark, d)).withColumn("confidence", F.round("confidence", 6))


def _warnings(spark, d):
    return parsed(spark, d).warnings.select("doc_id", "code", "page")


def _document_rows(x):
    return x.select("doc_id", F.col("metadata.page_count").alias("page_count"), F.col("metadata.discovered_internal_pattern").alias("pattern"), F.coalesce(F.array_join("metadata.new_supplier_candidates", "|"), F.lit("")).alias("new_suppliers"), F.coalesce(F.size("metadata.hard_rejected_candidates"), F.lit(0)).alias("n_rejected"), F.size("parts").alias("n_parts"))


QUERIES = {
    "flagship_parts_rollup": flagship,
    "a3_word_projection": lambda s, d: word_projection(parsed(s, d).words.withColumn("top", F.col("top").cast("string"))).select("doc_id", "page", "word_id", "text", "x0", "x1", "top", "bottom"),
    "a4_doc_metadata": _metadata_fixture,
    "a5_sparse_page_warning": lambda s, d: sparse_pages(parsed(s, d).words, parsed(s, d).pages, SPARSE),
    "a1_scan_words": _scanned,
    "a6_list_sources": _listed,
    "a7_load_synonyms": lambda s, d: config.synonym_table(s, _configured(s, config.SYNONYMS, config.read_synonyms)).select("column", "phrase_idx", "phrase"),
    "a8_load_weights": lambda s, d: config.weight_table(s, _configured(s, asdict(config.Weights()), config.read_weights)),
    "a9_load_aliases": lambda s, d: config.alias_table(s, _configured(s, config.ALIASES, config.read_aliases)).select("canonical", "canon_idx", "alias"),
    "a10_read_result_json": lambda s, d: _part_rows(_written_documents(s, d)),
    "b1_write_document": lambda s, d: _part_rows(_written_documents(s, d, sinks.export_documents, "doc_id = 'doc03'")),
    "b2_batch_write": lambda s, d: _document_rows(_written_documents(s, d)),
    "b4_write_summary": _summary_file,
    "b3_inspect": _inspect,
    "b5_golden_writer": _golden,
    "c1_bbox_measures": lambda s, d: geometry.bbox_measures(parsed(s, d).words).select("doc_id", "page", "word_id", "width", "height", "x_center"),
    "c2_span_contains": _contains,
    "c3_span_overlaps": _overlaps,
    "c4_span_width": _measures,
    "c4_line_center": lambda s, d: parsed(s, d).lines.select("doc_id", "page", "line_no", geometry.line_center(F.col("y_top"), F.col("y_bottom")).alias("y_center")),
    "d1_y_tolerance": lambda s, d: L.y_tolerance(parsed(s, d).words).select("doc_id", "page", F.round("tol", 6).alias("tol")),
    "d2_line_grouping": lambda s, d: L.line_numbers(parsed(s, d).words),
    "d3_line_finalize": _of("lines", "doc_id", "page", "line_no", "y_top", "y_bottom", "n_words"),
    "e1_token_norm": lambda s, d: parsed(s, d).words.groupBy(T.token_norm(F.concat(F.lit("  "), "text")).alias("token")).agg(F.count(F.lit(1)).alias("n")),
    "e2_phrase_match": _of("hits", "doc_id", "page", "line_no", "column", "phrase_idx", "n_words", "start", "x0", "x1"),
    "e3_row_break_threshold": lambda s, d: layout.row_breaks(parsed(s, d).lines).select("doc_id", "page", F.round("threshold", 6).alias("threshold")),
    "e4_header_runs": _of("runs", "doc_id", "page", "first_line", "last_line", "n_columns"),
    "e5_best_run": _of("best", "doc_id", "page", "first_line", "last_line", "n_columns"),
    "e6_best_match_per_column": _of("matched", "doc_id", "page", "column", "n_words", "x0", "x1"),
    "e7_required_columns_check": _of("missing", "doc_id", "page", "column"),
    "e8_suspected_words": lambda s, d: parsed(s, d).errors.select("doc_id", "page", "missing", "words"),
    "e9_header_y_band": _of("layouts", "doc_id", "page", "hdr_top", "body_y_top", "body_y_bottom"),
    "e10_column_bands": _of("bands", "doc_id", "page", "column", "x_min", "x_max"),
    "e11_column_order": _of("bands", "doc_id", "page", "column", "rank"),
    "e12_adjacency_warning": lambda s, d: layout.adjacency_warnings(_shuffled_bands(s, d)).select("doc_id", "page", "code", "distance"),
    "e13_detect_page_layout": lambda s, d: parsed(s, d).bands.join(parsed(s, d).layouts, ["doc_id", "page"]).select("doc_id", "page", "column", "x_min", "x_max", "rank", "body_y_top"),
    "f1_pool_id_tokens": _of("id_tokens", "doc_id", "page", "word_id", "token"),
    "f2_candidate_filter": lambda s, d: _candidates(s, d).select("doc_id", "seq", "token"),
    "f3_token_shape": lambda s, d: parsed(s, d).id_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("shape", T.token_shape(F.col("token"))),
    "f4_shape_frequency": lambda s, d: idpattern.shape_frequencies(_candidates(s, d)).select("doc_id", "shape", "n", "first_seq"),
    "f5_pattern_synthesis": lambda s, d: idpattern.synthesized(idpattern.shape_frequencies(_candidates(s, d))),
    "f6_match_rate": lambda s, d: parsed(s, d).patterns.select("doc_id", F.round("match_rate", 6).alias("match_rate")),
    "f7_fallback_pattern": lambda s, d: idpattern.discovered(raw_names(s, d).select("doc_id").distinct(), _lower_ids(s, d)).withColumn("match_rate", F.round("match_rate", 6)),
    "g1_body_lines": lambda s, d: records.body_lines(parsed(s, d).lines, parsed(s, d).layouts).select("doc_id", "page", "line_no", "y_top"),
    "g2_record_start": lambda s, d: parsed(s, d).kinds.filter("kind = 'record_start'").select("doc_id", "page", "line_no"),
    "g3_leftmost_part_word": lambda s, d: records.leftmost_parts(parsed(s, d).body_words).select("doc_id", "page", "line_no", "part_x0", "part"),
    "g4_supplier_row_test": lambda s, d: parsed(s, d).kinds.filter("kind = 'supplier_row'").select("doc_id", "page", "line_no"),
    "g5_classify_line": lambda s, d: parsed(s, d).kinds.select("doc_id", "page", "line_no", "kind"),
    "g6_record_assignment": lambda s, d: parsed(s, d).assigned.select("doc_id", "page", "line_no", "record_seq"),
    "g7_per_record_layout": lambda s, d: _cont(s, d).select("doc_id", "record_seq", "page", "word_id", "start_page", "quantity_min", "quantity_max"),
    "g8_depth": lambda s, d: records.depths(_cont(s, d)),
    "g9_parent": lambda s, d: parsed(s, d).records.select("doc_id", "record_seq", "internal_part", "depth", "parent"),
    "g10_description": lambda s, d: records.descriptions(_cont(s, d)),
    "g11_quantity": lambda s, d: records.quantities(_cont(s, d)),
    "g12_uom": lambda s, d: records.units(_cont(s, d)),
    "g13_commodity": lambda s, d: records.commodities(_cont(s, d)),
    "g14_finalize_record": lambda s, d: parsed(s, d).records,
    "g15_can_assemble": lambda s, d: records.can_assemble(parsed(s, d).bands),
    "h1_supplier_name": lambda s, d: parsed(s, d).supplier_rows.select("doc_id", "record_seq", "row_pos", "name_text"),
    "h2_part_text": lambda s, d: parsed(s, d).supplier_rows.select("doc_id", "record_seq", "row_pos", "part_text", "page", "line_y"),
    "i1_hard_reject": lambda s, d: score_tokens(s, d).select("seq", scoring.hard_reject(F.col("token")).alias("reason")),
    "i2_weighted_confidence": lambda s, d: score_tokens(s, d).filter(F.trim("token") != "").select("seq", F.round(scoring.weighted_confidence(F.col("token")), 6).alias("confidence")),
    "i3_clean_token_ratio": lambda s, d: score_tokens(s, d).filter(F.trim("token") != "").select("seq", F.round(scoring.clean_token_ratio(F.col("token")), 6).alias("ratio")),
    "i4_min_confidence": lambda s, d: _scored(s, d).select("seq", "confidence", "reason"),
    "i5_is_internal_flag": lambda s, d: _scored(s, d).select("seq", "is_internal"),
    "i6_is_accepted": lambda s, d: scoring.accepted(_scored(s, d)).select("seq", "token"),
    "j1_pre_normalize": lambda s, d: raw_names(s, d).select("seq", T.pre_normalize(F.col("raw_name")).alias("key")),
    "j2_alias_lookup": lambda s, d: names.alias_lookup(raw_names(s, d), aliases(s)).select("seq", "key", "canonical"),
    "j3_acronym_match": lambda s, d: names.acronym_lookup(raw_names(s, d), aliases(s)).select("seq", "by_initials"),
    "j4_fuzzy_match": _resolved,
    "j5_mint_canonical": lambda s, d: raw_names(s, d).select("seq", T.minted_name(F.col("raw_name")).alias("minted")),
    "j6_memoisation": lambda s, d: raw_names(s, d).groupBy("doc_id", "raw_name").agg(F.min("seq").alias("first_seq")),
    "j7_document_state": lambda s, d: parsed(s, d).names.select("doc_id", "raw_name", "canonical", "how"),
    "j8_new_supplier_candidates": lambda s, d: names.new_suppliers(parsed(s, d).names),
    "k1_clean_description": lambda s, d: order_records(s, d).select("doc_id", "record_seq", T.clean_description(F.col("description"), F.col("commodity")).alias("cleaned")),
    "k2_description_key": lambda s, d: order_records(s, d).select("doc_id", "record_seq", T.description_key(F.concat(F.col("description"), F.lit("   x "))).alias("key")),
    "k3_drop_empty_key": lambda s, d: rollup.keyed(order_records(s, d).withColumn("description", F.when(F.col("record_seq") % 4 == 0, "HD 5").otherwise(F.col("description")))).select("doc_id", "record_seq", "key"),
    "k4_group_by_description": lambda s, d: rollup.groups(_keyed(s, d)).select("doc_id", "key", "first_seq", "description"),
    "k5_total_quantity": lambda s, d: rollup.groups(_keyed(s, d)).select("doc_id", "key", "total_quantity", "n_occurrences"),
    "k6_first_uom": lambda s, d: rollup.groups(_keyed(s, d)).select("doc_id", "key", "uom", "commodity"),
    "k7_internal_parts": lambda s, d: _flat(rollup.internal_parts(_keyed(s, d)), parts="parts"),
    "k8_occurrences": lambda s, d: rollup.occurrences(_keyed(s, d)).select("doc_id", "key", F.array_join(F.transform("occurrences", lambda o: F.concat(o["internal_author_part"], F.lit(":"), F.format_string("%.2f", o["quantity"]))), "|").alias("occurrences")),
    "k9_score_and_filter_suppliers": lambda s, d: scoring.accepted(_order_candidates(s, d)).select("doc_id", "key", "record_seq", "part_text", F.round("confidence", 6).alias("confidence")),
    "k10_dedupe_suppliers": lambda s, d: rollup.unique_suppliers(scoring.accepted(_order_candidates(s, d))).select("doc_id", "key", "canonical", "part_text", "record_seq"),
    "k11_hard_rejected": lambda s, d: rollup.hard_rejected(_order_candidates(s, d)),
    "k12_dedupe_warnings": _warnings,
    "k13_metadata": lambda s, d: _document_rows(parsed(s, d).documents),
    "k14_assemble_document": lambda s, d: _part_rows(parsed(s, d).documents),
    "k15_contract_validation": lambda s, d: rollup.violations(parsed(s, d).parts.withColumn("total_quantity", F.when(F.col("first_seq") % 7 == 0, -1.0).otherwise(F.col("total_quantity")))),
    "l1_occurrence_lines": _order_lines,
    "l2_inspect_counts": lambda s, d: parsed(s, d).inspect()["counts"].select("doc_id", "page_count", "n_words"),
}


def _shuffled_bands(spark, d):
    """Bands of which each page with an even number has its identifier and supplier part columns exchanged."""
    name = F.when((F.col("page") % 2 == 0) & (F.col("column") == "mfg_part"), "part_identifier").when((F.col("page") % 2 == 0) & (F.col("column") == "part_identifier"), "mfg_part").otherwise(F.col("column"))
    return parsed(spark, d).bands.withColumn("column", name)


def _lower_ids(spark, d):
    """Identifier tokens of which some documents' are lower case: their shape is found, but their expression fails."""
    s = raw_names(spark, d)
    digits = F.lpad(F.col("seq").cast("string"), 6, "0")
    doc = F.col("doc_id").cast("int") % 3
    return s.select("doc_id", "seq", F.when(doc == 0, F.concat(F.lit("ab"), digits)).when(doc == 1, F.concat(F.lit("AB"), digits)).otherwise(F.lit("--")).alias("token"))

