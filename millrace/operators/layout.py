"""Header detection and column bands of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import phrase_norm, token_norm
from millrace.sources.config import REQUIRED

from .lines import LINE, PAGE

WIDEST = 4  # words of the longest phrase that is looked for


def phrase_hits(placed: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The first place of each phrase in each line: column, phrase_idx, n_words, start, x0, x1.

    A line's word n-grams are equi-joined with the phrases; the synonyms are a driver-side constant of a few dozen rows.
    """
    order = Window.partitionBy(*LINE).orderBy("pos")
    grams, so_far = placed.select(*LINE, "pos", "x0", "x1", token_norm(F.col("text")).alias("t")), None
    shifted = grams
    for k in range(1, WIDEST):
        shifted = shifted.withColumns({f"t{k}": F.lead("t", k).over(order), f"e{k}": F.lead("x1", k).over(order)})
    forms = []
    for n in range(1, WIDEST + 1):
        parts = [F.col("t"), *(F.col(f"t{k}") for k in range(1, n))]
        # concat is null where the line ends before the n-gram does
        so_far = F.concat(*(x for p in parts for x in (F.lit(" "), p)))
        forms.append(F.struct(F.lit(n).alias("n_words"), F.substring(so_far, 2, 1_000_000).alias("gram"), (F.col("x1") if n == 1 else F.col(f"e{n - 1}")).alias("end")))
    each = shifted.select(*LINE, "pos", "x0", F.explode(F.array(*forms)).alias("g")).select(*LINE, F.col("pos").alias("start"), "x0", "g.n_words", "g.gram", F.col("g.end").alias("x1"))
    wanted = synonyms.select("column", "column_idx", "phrase_idx", phrase_norm(F.col("phrase")).alias("gram"), F.size(F.split(phrase_norm(F.col("phrase")), " ")).alias("n_words"))
    hits = each.filter(F.col("gram").isNotNull()).join(F.broadcast(wanted), ["gram", "n_words"])
    first = Window.partitionBy(*LINE, "column", "phrase_idx").orderBy("start")
    return hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*LINE, "column", "column_idx", "phrase_idx", "n_words", "start", "x0", "x1")


def row_breaks(line_table: DataFrame) -> DataFrame:
    """doc_id, page, threshold: the gap from which lines count as unrelated."""
    gap = F.lead("y_top").over(Window.partitionBy(*PAGE).orderBy("line_no")) - F.col("y_bottom")
    some = line_table.withColumn("gap", gap).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("m"))
    return some.select(*PAGE, F.when((F.col("n") < 3) | F.col("m").isNull(), 12.0).otherwise(F.greatest(F.col("m") * 1.5, F.lit(6.0))).alias("threshold"))


def header_runs(line_table: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, page, run, first_line, last_line, n_columns: maximal runs of neighbouring lines with hits."""
    per_line = hits.groupBy(*LINE).agg(F.collect_set("column").alias("columns"))
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    flagged = line_table.join(per_line, LINE, "left").join(row_breaks(line_table), PAGE).withColumn("hit", F.col("columns").isNotNull())
    joins = F.col("hit") & F.coalesce(F.lag("hit").over(order), F.lit(False)) & (F.col("y_top") - F.lag("y_bottom").over(order) <= F.col("threshold"))
    marked = flagged.withColumn("run", F.sum((~joins).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("hit")
    return marked.groupBy(*PAGE, "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.size(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("n_columns"))


def best_runs(runs: DataFrame) -> DataFrame:
    """The run with most columns; then the shortest; then the first."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("n_columns"), F.col("last_line") - F.col("first_line"), "first_line")
    return runs.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*PAGE, "first_line", "last_line", "n_columns")


def best_matches(hits: DataFrame, best: DataFrame) -> DataFrame:
    """For each column of the header its longest phrase, the first of equals."""
    inside = hits.join(best, PAGE).filter(F.col("line_no").between(F.col("first_line"), F.col("last_line")))
    order = Window.partitionBy(*PAGE, "column").orderBy(F.desc("n_words"), "line_no", "column_idx", "phrase_idx")
    return inside.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*PAGE, "column", "n_words", "x0", "x1")


def missing_columns(pages: DataFrame, matched: DataFrame) -> DataFrame:
    """doc_id, page, column: mandatory columns that a page lacks."""
    wanted = pages.select(*PAGE, F.explode(F.array(*map(F.lit, REQUIRED))).alias("column"))
    return wanted.join(matched.select(*PAGE, "column"), [*PAGE, "column"], "left_anti")


def suspected_words(placed: DataFrame, best: DataFrame, missing: DataFrame) -> DataFrame:
    """doc_id, page, words: for pages that lack a column, the words of the header, or of the topmost line."""
    bad = missing.select(*PAGE).distinct().join(best, PAGE, "left").select(*PAGE, F.coalesce("first_line", F.lit(0)).alias("a"), F.coalesce("last_line", F.lit(0)).alias("b"))
    own = placed.join(bad, PAGE).filter(F.col("line_no").between(F.col("a"), F.col("b")))
    return own.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "text"))), lambda x: x["text"]), " ").alias("words"))


def page_layout(placed: DataFrame, line_table: DataFrame, pages: DataFrame, best: DataFrame, missing: DataFrame) -> DataFrame:
    """doc_id, page, hdr_top, body_y_top, body_y_bottom, width of the pages whose header is complete."""
    good = best.join(missing.select(*PAGE).distinct(), PAGE, "left_anti")
    edges = line_table.join(good, PAGE).groupBy(*PAGE).agg(F.max(F.when(F.col("line_no") == F.col("first_line"), F.col("y_top"))).alias("hdr_top"), F.max(F.when(F.col("line_no") == F.col("last_line"), F.col("y_bottom"))).alias("body_y_top"))
    bottom = placed.join(edges, PAGE).filter(F.col("top") >= F.col("body_y_top")).groupBy(*PAGE).agg(F.max("bottom").alias("low"))
    return edges.join(pages, PAGE).join(bottom, PAGE, "left").select(*PAGE, "hdr_top", "body_y_top", F.coalesce("low", "height").alias("body_y_bottom"), "width")


def column_bands(matched: DataFrame, layouts: DataFrame) -> DataFrame:
    """doc_id, page, column, x_min, x_max, rank: midpoints between neighbouring headers, the page's edges outside."""
    order = Window.partitionBy(*PAGE).orderBy((F.col("x0") + F.col("x1")) / 2)
    whole = Window.partitionBy(*PAGE)
    edge = F.when(F.col("width") > 0, F.col("width")).otherwise(F.max("x1").over(whole))
    low = F.coalesce((F.lag("x1").over(order) + F.col("x0")) / 2, F.lit(0.0))
    high = F.coalesce((F.col("x1") + F.lead("x0").over(order)) / 2, edge)
    bands = matched.join(layouts.select(*PAGE, "width"), PAGE).select(*PAGE, "column", low.alias("x_min"), high.alias("x_max"))
    return bands.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("x_min")) - 1)


def adjacency_warnings(bands: DataFrame) -> DataFrame:
    """Pages where supplier name and supplier part columns are not neighbours."""
    at = lambda c: F.max(F.when(F.col("column") == c, F.col("rank")))
    both = bands.groupBy(*PAGE).agg(F.abs(at("mfg_name") - at("mfg_part")).alias("distance"))
    return both.filter(F.col("distance") > 1).select(*PAGE, F.lit("non_adjacent_supplier_columns").alias("code"), "distance")


def wide_bands(bands: DataFrame) -> DataFrame:
    """One row a page: <column>_min and <column>_max, null where the column is missing."""
    from millrace.sources.config import COLUMNS

    pick = lambda c, v: F.max(F.when(F.col("column") == c, F.col(v)))
    return bands.groupBy(*PAGE).agg(*(pick(c, f"x_{e}").alias(f"{c}_{e}") for c in COLUMNS for e in ("min", "max")))
