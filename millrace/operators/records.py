"""Line classification, record assembly, hierarchy and supplier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import DATE_SHAPE, DEPTH_MARKER, NAME_BAD, PART_SHAPE, QUANTITY_SHAPE, UNITS

from .geometry import span_overlaps
from .layout import wide_bands
from .lines import LINE, PAGE

PART_GAP, MIN_COMMODITY, MAX_DEPTH = 0.3, 3, 99


def body_lines(line_table: DataFrame, layouts: DataFrame) -> DataFrame:
    return line_table.join(layouts.select(*PAGE, "body_y_top"), PAGE).filter(F.col("y_top") >= F.col("body_y_top")).drop("body_y_top")


def _in(band: str):
    """Whether a word overlaps a band of its page; null where the band is missing."""
    return span_overlaps(F.col("x0"), F.col("x1"), F.col(f"{band}_min"), F.col(f"{band}_max"))


def body_words(placed: DataFrame, body: DataFrame, bands: DataFrame) -> DataFrame:
    """Words of body lines with the bands of their page."""
    return placed.join(body.select(*LINE, "y_top"), LINE).join(wide_bands(bands), PAGE)


def leftmost_parts(words: DataFrame) -> DataFrame:
    """doc_id, page, line_no, part_x0, part_pos, part: the leftmost part-shaped word in the supplier part band."""
    shaped = F.col("text").rlike(PART_SHAPE) & ~F.col("text").rlike(DATE_SHAPE) & ~F.col("text").rlike(QUANTITY_SHAPE)
    return words.filter(F.coalesce(_in("mfg_part"), F.lit(False)) & shaped).groupBy(*LINE).agg(F.min(F.struct("x0", "pos", "text")).alias("p")).select(*LINE, F.col("p.x0").alias("part_x0"), F.col("p.pos").alias("part_pos"), F.col("p.text").alias("part"))


def classified(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, page, line_no, y_top, kind of each body line: record_start, supplier_row or continuation.

    The document's pattern travels with its words; each test is an aggregate over the line.
    """
    parts = leftmost_parts(words)
    # a document holds one pattern, so its rows lie together and the pattern compiles once for them
    rows = words.join(patterns.select("doc_id", "pattern"), "doc_id").join(parts, LINE, "left")
    name = F.col("x0") < F.col("part_x0")
    starts = F.expr("text rlike pattern") & F.coalesce(_in("part_identifier"), F.lit(True))
    facts = rows.groupBy(*LINE).agg(
        F.first("y_top").alias("y_top"),
        F.count(F.lit(1)).alias("n"),
        F.bool_or(starts).alias("id"),
        F.bool_or(F.col("text").rlike(QUANTITY_SHAPE)).alias("quantity"),
        F.first("part_x0").alias("part_x0"),
        F.min(F.when(name, F.struct("pos", "text")))["text"].alias("first_name"),
        F.min(F.when(name, F.col("x0"))).alias("name_x0"),
        F.coalesce(F.bool_or(name & F.col("text").rlike(NAME_BAD)), F.lit(False)).alias("bad"),
        F.first("mfg_name_min").alias("n_min"),
        F.first("mfg_name_max").alias("n_max"),
    )
    near = F.col("name_x0") + 0.5 * (F.col("n_max") - F.col("n_min")) >= F.col("n_min")
    supplier = F.col("part_x0").isNotNull() & F.col("first_name").isNotNull() & ~F.col("first_name").rlike(DEPTH_MARKER) & ~F.col("quantity") & F.coalesce(near, F.lit(True)) & ~F.col("bad")
    kind = F.when((F.col("n") == 1) & F.col("id"), "record_start").when(F.coalesce(supplier, F.lit(False)), "supplier_row").otherwise("continuation")
    return facts.select(*LINE, "y_top", kind.alias("kind"))


def assigned(kinds: DataFrame) -> DataFrame:
    """Lines with record_seq, the number of the latest record start at or before them across the document's pages; earlier lines go."""
    order = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return kinds.withColumn("record_seq", F.sum((F.col("kind") == "record_start").cast("int")).over(order).cast("int")).filter("record_seq > 0")


def record_words(words: DataFrame, lines_of: DataFrame) -> DataFrame:
    """Words with record_seq and kind of their line; the bands are those of the line's own page."""
    return words.join(lines_of.select(*LINE, "record_seq", "kind"), LINE)


def starts(words: DataFrame) -> DataFrame:
    """doc_id, record_seq, internal_part, page, line_y of each record's first line."""
    return words.filter("kind = 'record_start'").select("doc_id", "record_seq", F.col("text").alias("internal_part"), "page", F.col("y_top").alias("line_y"))


RECORD = ["doc_id", "record_seq"]
_ORDER = ["page", "line_no", "pos"]


def continuation(words: DataFrame, bands: DataFrame) -> DataFrame:
    """Continuation words in reading order (ord), with the bands of the page on which their record starts."""
    names = [c for c in wide_bands(bands).columns if c not in PAGE]
    own = words.filter("kind = 'continuation'").drop(*names)
    home = starts(words).select(*RECORD, F.col("page").alias("start_page"))
    at = own.join(home, RECORD)
    start_bands = wide_bands(bands).withColumnRenamed("page", "start_page")
    return at.join(start_bands, ["doc_id", "start_page"]).withColumn("ord", F.struct(*_ORDER))


def _is_depth():
    return (F.col("pos") == 0) & F.col("text").rlike(DEPTH_MARKER)


def _is_quantity():
    return F.col("text").rlike(QUANTITY_SHAPE) & F.coalesce(_in("quantity"), F.lit(True))


def _is_unit():
    return F.col("text").isin(*UNITS) & F.coalesce(_in("uom"), F.lit(True))


def _is_commodity():
    return F.col("text").rlike(rf"^\p{{Lu}}{{{MIN_COMMODITY},}}$") & F.coalesce(_in("commodity"), F.lit(False))


def _is_described():
    return ~F.col("text").rlike(QUANTITY_SHAPE) & ~F.col("text").rlike(DATE_SHAPE)


def _facts() -> dict:
    """What a record's continuation words say, each as one aggregate: a test of the words, and a function of the order of those that pass."""
    return {
        "description": (_is_described(), _described),
        "quantity": (_is_quantity(), lambda o: F.min_by(F.col("text").try_cast("double"), o)),
        "uom": (_is_unit(), lambda o: F.min_by("text", F.when(o.isNotNull(), F.struct((F.length("text") == 1).alias("single"), o.alias("ord"))))),
        "commodity": (_is_commodity(), lambda o: F.min_by("text", F.when(o.isNotNull(), F.struct((-F.col("x1")).alias("right"), o.alias("ord"))))),
        "depth": (_is_depth(), lambda o: F.min_by(F.regexp_extract("text", DEPTH_MARKER, 1).cast("int"), o)),
    }


def _described(ord_):
    """The words in order, from the first that is no depth marker."""
    words = F.transform(F.array_sort(F.collect_list(F.when(ord_.isNotNull(), F.struct(ord_.alias("ord"), "text")))), lambda x: x["text"])
    begun = F.array_position(F.transform(words, lambda w: ~w.rlike(DEPTH_MARKER)), True).cast("int")
    return F.when(begun > 0, F.trim(F.array_join(F.slice(words, F.greatest(begun, F.lit(1)), F.size(words)), " ")))


def _fact(cont: DataFrame, name: str) -> DataFrame:
    test, use = _facts()[name]
    return cont.filter(test).groupBy(*RECORD).agg(use(F.col("ord")).alias(name)).filter(F.col(name).isNotNull())


def facts(cont: DataFrame) -> DataFrame:
    """doc_id, record_seq, description, quantity, uom, commodity, depth: all from one grouping."""
    return cont.groupBy(*RECORD).agg(*(use(F.when(test, F.col("ord"))).alias(name) for name, (test, use) in _facts().items()))


def depths(cont: DataFrame) -> DataFrame:
    """doc_id, record_seq, depth: of the first continuation line that begins with a marker."""
    return _fact(cont, "depth")


def descriptions(cont: DataFrame) -> DataFrame:
    """doc_id, record_seq, description: all words but quantities, dates and leading depth markers."""
    return _fact(cont, "description")


def quantities(cont: DataFrame) -> DataFrame:
    return _fact(cont, "quantity")


def units(cont: DataFrame) -> DataFrame:
    return _fact(cont, "uom")


def commodities(cont: DataFrame) -> DataFrame:
    return _fact(cont, "commodity")


def parents(records: DataFrame) -> DataFrame:
    """records (doc_id, record_seq, internal_part, depth) with parent: the part of the nearest earlier record that is shallower.

    Depth is below 100, so for each depth the latest such record is one running aggregate; no self-join and no collected prefix.
    """
    order = Window.partitionBy("doc_id").orderBy("record_seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.max(F.when(F.col("depth") == k, F.struct("record_seq", "internal_part"))).over(order) for k in range(MAX_DEPTH)]
    seen = records.agg(F.max("depth")).first()[0]  # bounded by the marker's two digits
    above = [F.when(F.col("depth") > k, latest[k]) for k in range(min(MAX_DEPTH, seen or 0))]
    none = F.lit(None).cast("struct<record_seq:int,internal_part:string>")
    best = F.greatest(*above) if len(above) > 1 else above[0] if above else none
    return records.withColumn("parent", best["internal_part"])


def records(words: DataFrame, bands: DataFrame, keep=lambda df: df) -> DataFrame:
    """doc_id, record_seq, internal_part, description, quantity, uom, commodity, depth, parent, page, line_y. ``keep`` may store a table that is read several times."""
    out = starts(words).join(facts(continuation(words, bands)), RECORD, "left")
    out = out.withColumns({"depth": F.coalesce("depth", F.lit(0)), "description": F.coalesce("description", F.lit(""))})
    return parents(keep(out)).select(*RECORD, "internal_part", "description", "quantity", "uom", "commodity", "depth", "parent", "page", "line_y")


def supplier_rows(words: DataFrame) -> DataFrame:
    """doc_id, record_seq, row_pos, name_text, part_text, page, line_y: row_pos counts a record's rows from 0."""
    rows = words.filter("kind = 'supplier_row'")
    rows = rows.join(leftmost_parts(rows), LINE)
    names = rows.filter(F.col("x0") < F.col("part_x0")).groupBy(*LINE).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")).alias("name_text"))
    order = Window.partitionBy(*LINE).orderBy("pos")
    right = rows.filter(F.col("x0") >= F.col("part_x0"))
    gap = F.coalesce((F.col("x0") - F.lag("x1").over(order) > PART_GAP * (F.col("mfg_part_max") - F.col("mfg_part_min"))).cast("int"), F.lit(0))
    # words up to the first wide gap
    close = right.withColumn("gap", gap).withColumn("gaps", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("gaps = 0")
    texts = close.groupBy(*LINE).agg(F.first("record_seq").alias("record_seq"), F.first("y_top").alias("line_y"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")).alias("part_text"))
    out = texts.join(names, LINE).filter("name_text != '' AND part_text != ''")
    nth = F.row_number().over(Window.partitionBy(*RECORD).orderBy("page", "line_no")) - 1
    return out.select(*RECORD, nth.alias("row_pos"), "name_text", "part_text", "page", "line_y")


def can_assemble(bands: DataFrame) -> DataFrame:
    """doc_id, page, ok: whether a page has the identifier and the supplier part columns."""
    has = F.collect_set("column")
    return bands.groupBy(*PAGE).agg((F.array_contains(has, "part_identifier") & F.array_contains(has, "mfg_part")).alias("ok"))
