"""The relation of positioned words, and readers that yield it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null

WORDS = "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, fontname string, size double"
PAGES = "doc_id string, page int, width double, height double"
SPARSE_WORDS = 20


def word_projection(raw: DataFrame) -> DataFrame:
    """Casts extracted rows to the words relation; font columns may be missing or null."""
    have = set(raw.columns)
    out = []
    for name, kind in (c.split() for c in WORDS.split(", ")):
        c = F.col(name) if name in have else F.lit(None)
        out.append(c.try_cast(kind).alias(name))
    return raw.select(*out)


def doc_metadata(raw: DataFrame) -> DataFrame:
    """doc_id with title, creator and producer; blank ones are null."""
    return raw.select("doc_id", *(blank_to_null(F.col(c).cast("string")).alias(c) for c in ("title", "creator", "producer")))


def sparse_pages(words: DataFrame, pages: DataFrame, least: int = SPARSE_WORDS) -> DataFrame:
    """doc_id, page, n_words of pages with too few words; pages without any count."""
    n = words.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_words"))
    return pages.select("doc_id", "page").join(n, ["doc_id", "page"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0))).filter(F.col("n_words") < least)


def list_sources(spark: SparkSession, directory: str, recursive: bool = False, glob: str = "*.pdf") -> DataFrame:
    """path and length of the matching files, by path. A missing directory raises when the plan is made."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return files.select("path", "length").orderBy("path")


def pdf_rows(path: str, content: bytes, opened, x_tolerance: float, y_tolerance: float):
    """The words of a PDF file's pages, by ``opened`` (which takes a binary file and gives pages that extract words)."""
    import io

    with opened(io.BytesIO(content)) as pdf:
        for page, p in enumerate(pdf.pages):
            for n, w in enumerate(p.extract_words(x_tolerance=x_tolerance, y_tolerance=y_tolerance, keep_blank_chars=False, use_text_flow=False, extra_attrs=["fontname", "size"])):
                yield path, page, n, str(w["text"]), float(w["x0"]), float(w["x1"]), float(w["top"]), float(w["bottom"]), w.get("fontname"), w.get("size")


def _pdf_words(batches, x_tolerance: float, y_tolerance: float):
    import pyarrow as pa

    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pdfplumber package") from e
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in WORDS.split(", "))])
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = list(pdf_rows(path, content, pdfplumber.open, x_tolerance, y_tolerance))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_words(spark: SparkSession, path: str, kind: str = "tsv", glob: str | None = None, recursive: bool = False, x_tolerance: float = 1.5, y_tolerance: float = 2.0) -> DataFrame:
    """The words of all matching files in any store that Spark reads; doc_id is the file's path. kind ``pdf`` needs a library, where tasks
    run; ``tsv`` has a line a word: page, text, x0, x1, top, bottom. A missing path raises when the plan is made."""
    options = {"pathGlobFilter": glob or f"*.{kind}", "recursiveFileLookup": str(recursive).lower()}
    if kind == "pdf":
        files = spark.read.format("binaryFile").options(**options).load(path).select("path", "content")
        return files.mapInArrow(lambda batches: _pdf_words(batches, x_tolerance, y_tolerance), WORDS)
    files = spark.read.options(**options).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    each = files.select("doc_id", F.posexplode(F.split("value", "\n")).alias("word_id", "line")).filter("line != ''")
    field = lambda k: F.get(F.split("line", "\t"), k)
    return word_projection(each.select("doc_id", "word_id", *(field(k).alias(n) for k, n in enumerate(("page", "text", "x0", "x1", "top", "bottom")))))
