"""A deterministic rendering of the part table as positioned words, for queries and tests: DataFrame code here, SQL in oracle.py.

A record takes five line slots: identifier; data (depth marker, name, date, quantity, units); brand and commodity; a supplier row; and a second
supplier row, a further description line, or nothing. Pages hold 37 slots, so records run over pages. Perturbations by the part key
break one condition each; every tenth page drifts, one page lacks a header column, odd pages have shifted headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import Scratch

DOCS, PER_DOC, SLOTS, PER_PAGE, WIDTH, HEIGHT = 20, 100, 5, 37, 540.0, 560.0
SUPPLIERS = ("North Coast Com", "McMaster- Carr", "OMEGA", "NCC", "Bestlink", "Allen Bradley", "US Sensor", "Acme, Inc")
HEADER = (("Part", 20, 50), ("Identifier", 52, 84), ("Description", 110, 160), ("Mfg", 190, 212), ("Name", 214, 240), ("Mfg", 270, 292), ("Part", 294, 320), ("Quantity", 350, 390), ("UM", 410, 422), ("Commodity", 440, 490))
TITLE = ("Multi-Level", "Explosion", "By", "Parent", "Part", "Identifier")


def _word(text, x0, x1, when=None, dy=0):
    w = F.struct((text if not isinstance(text, str) else F.lit(text)).cast("string").alias("text"), F.lit(x0).cast("double").alias("x0"), F.lit(x1).cast("double").alias("x1"), F.lit(dy).cast("double").alias("dy"))
    return w if when is None else F.when(when, w)


def part_lines(part: DataFrame) -> DataFrame:
    """doc_id, page, line (slot on the page), slot, k and the part's columns: one row a line."""
    k = F.col("p_partkey")
    docs = max(DOCS, part.count() // PER_DOC)  # documents grow in number with the table, not in length
    base = part.select(k.alias("k"), "p_name", "p_brand", "p_type", "p_size", (k % docs).alias("d"))
    base = base.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("k")) - 1)
    rows = base.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    at = F.col("r") * SLOTS + F.col("slot")
    return rows.withColumns({"doc_id": F.format_string("doc%02d", "d"), "page": F.floor(at / PER_PAGE).cast("int"), "line": (at % PER_PAGE).cast("int")})


def depth_of(r):
    return F.when(r % 13 == 12, 3).when(r % 4 == 0, 1).when(r % 4 == 2, 3).otherwise(2)


def _body(lines: DataFrame) -> DataFrame:
    k, slot = F.col("k"), F.col("slot")
    depth = depth_of(F.col("r"))
    ident = F.when(depth == 1, F.format_string("UA%06d", "k")).when(k % 9 == 0, F.format_string("M%06d", "k")).otherwise(F.format_string("LB%06d", "k"))
    names = F.split("p_name", " ")
    name_words = F.transform(names, lambda w, i: F.struct(w.alias("text"), (110 + 28 * i).cast("double").alias("x0"), (134 + 28 * i).cast("double").alias("x1"), F.lit(0.0).alias("dy")))
    data = F.concat(
        F.array(_word(F.concat(F.repeat(F.lit("."), depth - 1), depth.cast("string")), 20, 28)),
        name_words,
        F.array(
            _word("15", 200, 208, k % 19 == 0),
            _word("4/18/2024", 300, 330, k % 2 == 0),
            _word(F.format_string("%.6f", F.col("p_size").cast("double")), 352, 388, k % 17 != 0, 1),
            _word("U", 405, 409),
            _word("EA", 411, 421, k % 6 != 0),
        ),
    )
    kind = F.array(_word(F.col("p_brand"), 110, 150), _word("HD", 155, 163, k % 5 == 0), _word(F.upper(F.element_at(F.split("p_type", " "), 1)), 445, 485))
    supplier = F.element_at(F.array(*map(F.lit, SUPPLIERS)), (k % len(SUPPLIERS) + 1).cast("int"))
    shift = F.when(k % 23 == 0, -80).otherwise(0)
    sup_words = F.transform(F.split(supplier, " "), lambda w, i: F.struct(w.alias("text"), (190 + shift + 24 * i).cast("double").alias("x0"), (212 + shift + 24 * i).cast("double").alias("x1"), F.lit(0.0).alias("dy")))
    mpn = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("-"), F.col("p_size").cast("string"))
    number = F.when(k % 31 == 0, "2024-04-18").when(k % 37 == 0, F.lower(mpn)).otherwise(mpn)
    first = F.concat(sup_words, F.array(_word(number, 275, 300), _word("X", 304, 310, k % 7 == 0), _word("far", 345, 360, k % 7 == 0), _word("2.000000", 362, 388, k % 29 == 0)))
    second = F.when(k % 3 == 0, F.array(_word("Schneider", 190, 216), _word("Electric", 218, 240), _word(F.concat(F.lit("SE-"), k.cast("string")), 275, 300))).when(k % 3 == 1, F.array(_word("see", 110, 124), _word("note", 126, 144), _word("5", 146, 150)))
    words = F.when(slot == 0, F.array(_word(ident, 22, 70))).when(slot == 1, data).when(slot == 2, kind).when(slot == 3, first).otherwise(second)
    each = lines.select("doc_id", "page", "line", "slot", F.posexplode(F.filter(words, lambda w: w.isNotNull())).alias("i", "w"))
    drift = F.when((F.col("page") % 10 == 9) & (F.col("slot") == 1), 3.0 * F.least(F.col("i"), F.lit(4))).otherwise(0.0)
    return each.select("doc_id", "page", "w.text", "w.x0", "w.x1", (60.0 + 12.0 * F.col("line") + F.col("w.dy") + drift).alias("top"))


def pages(part: DataFrame) -> DataFrame:
    return part_lines(part).select("doc_id", "page").distinct().select("doc_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def words(part: DataFrame) -> DataFrame:
    """The words relation of the whole part table."""
    page_rows = pages(part).select("doc_id", "page")
    dx = 3 * (F.col("page") % 2)
    head = F.array(*(F.struct(F.lit(t).alias("text"), (a + dx).cast("double").alias("x0"), (b + dx).cast("double").alias("x1"), F.lit(40.0).alias("top"), F.lit(6 <= i + 1 <= 7).alias("part")) for i, (t, a, b) in enumerate(HEADER)))
    bad = (F.col("doc_id") == "doc07") & (F.col("page") == 1)
    header = page_rows.select("doc_id", "page", F.explode(head).alias("w")).filter(~(bad & F.col("w.part"))).select("doc_id", "page", "w.text", "w.x0", "w.x1", "w.top")
    title = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(100.0 + 40 * i).alias("x0"), F.lit(136.0 + 40 * i).alias("x1")) for i, t in enumerate(TITLE)))
    titles = page_rows.select("doc_id", "page", F.explode(title).alias("w")).select("doc_id", "page", "w.text", "w.x0", "w.x1", F.lit(10.0).alias("top"))
    foot = F.array(F.struct(F.lit("Page").alias("text"), F.lit(250.0).alias("x0"), F.lit(270.0).alias("x1")), F.struct(F.col("page").cast("string").alias("text"), F.lit(274.0).alias("x0"), F.lit(280.0).alias("x1")))
    feet = page_rows.select("doc_id", "page", F.explode(foot).alias("w")).select("doc_id", "page", "w.text", "w.x0", "w.x1", F.lit(516.0).alias("top"))
    all_ = header.unionByName(titles).unionByName(feet).unionByName(_body(part_lines(part)))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top", "x0", "text"))
    none = {"fontname": F.lit(None).cast("string"), "size": F.lit(None).cast("double")}
    return all_.withColumns({"word_id": nth, "bottom": F.col("top") + 9.0} | none).select("doc_id", "page", "word_id", "text", "x0", "x1", "top", "bottom", "fontname", "size")


def rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    keep = Scratch(spark, "render").keep
    return keep(words(part)), keep(pages(part))
