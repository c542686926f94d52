"""Lines, layout, hierarchy, records and documents: small pages, Python models, and SQL over the rendered tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import lines, records, rollup
from millrace.plans import oracle, queries
from millrace.plans.parse import HeaderError, Parse
from millrace.sources import sinks
from millrace.sources.words import list_sources, pdf_rows, read_words

SF = "/root/testdata/sf0.001"
WORDS = "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, fontname string, size double"
PAGES = "doc_id string, page int, width double, height double"


def words(spark, rows):
    return spark.createDataFrame([("d", p, i, t, float(a), float(b), float(y), float(y) + 9, None, None) for i, (p, t, a, b, y) in enumerate(rows)], WORDS)


def test_lines_follow_their_first_word(spark):
    tol = spark.createDataFrame([("d", 0, 2.0)], "doc_id string, page int, tol double")
    got = lines.line_numbers(words(spark, [(0, "a", 0, 1, 1.0), (0, "b", 2, 3, 2.5), (0, "c", 4, 5, 4.0)]), tol)
    assert [r.line_no for r in got.orderBy("top").collect()] == [0, 0, 1]


def test_lines_against_a_model(spark):
    rng = random.Random(4)
    rows = [(p, "w", 0, 1, round(rng.uniform(0, 120), 2)) for p in range(40) for _ in range(50)]
    got = {(r.page, r.top): (r.line_no) for r in lines.line_numbers(words(spark, rows)).collect()}
    tol = {r.page: r.tol for r in lines.y_tolerance(words(spark, rows)).collect()}
    for p in range(40):
        anchor, n = None, -1
        for top in sorted({y for q, *_, y in rows if q == p}):
            if anchor is None or top - anchor > tol[p]:
                anchor, n = top, n + 1
            assert got[p, top] == n
    one = words(spark, [(0, "a", 0, 1, 5.0)])
    assert lines.y_tolerance(one).first().tol == 3.0


def test_parents_against_a_stack(spark):
    rng = random.Random(3)
    rows = [(f"d{d}", i + 1, f"p{i}", rng.choice([0, 1, 1, 2, 2, 3, 5])) for d in range(30) for i in range(25)]
    got = {(r.doc_id, r.record_seq): r.parent for r in records.parents(spark.createDataFrame(rows, "doc_id string, record_seq int, internal_part string, depth int")).collect()}
    for d in range(30):
        stack = []
        for doc, seq, part, depth in rows:
            if doc == f"d{d}":
                stack = [x for x in stack if x[0] < depth]
                assert got[doc, seq] == (stack[-1][1] if stack else None)
                stack.append((depth, part))
    assert records.parents(spark.createDataFrame([], "doc_id string, record_seq int, internal_part string, depth int")).count() == 0


HEADER = [("Part", 20, 50), ("Identifier", 52, 84), ("Description", 110, 160), ("Mfg", 190, 212), ("Name", 214, 240), ("Mfg", 270, 292), ("Part", 294, 320), ("Quantity", 350, 390), ("UM", 410, 422), ("Commodity", 440, 490)]


def page(*body, header=HEADER, n=0):
    return [(n, t, a, b, 40) for t, a, b in header] + [(n, *w) for w in body]


BODY = [("UA000001", 22, 70, 60), ("1", 20, 28, 72), ("steel", 110, 134, 72), ("15", 138, 150, 72), ("rod", 152, 170, 72), ("4/18/2024", 300, 330, 72), ("2.000000", 352, 388, 72), ("U", 405, 409, 72), ("EA", 411, 421, 72), ("HOSE", 445, 485, 84), ("Acme", 190, 212, 96), ("1010", 275, 290, 96), ("X", 292, 296, 96), ("36", 300, 306, 96), ("far", 345, 360, 96)]


def parse(spark, rows, pages=1, **more):
    return Parse(spark, words(spark, rows), spark.createDataFrame([("d", p, 540.0, 560.0) for p in range(pages)], PAGES), **more)


def test_one_record(spark):
    p = parse(spark, page(*BODY) + page(("SE", 190, 200, 60), ("LATE-1", 275, 300, 60), n=1), 2)
    r = p.records.first()
    assert (r.internal_part, r.description, r.quantity, r.uom, r.commodity, r.depth, r.parent) == ("UA000001", "steel 15 rod U EA HOSE", 2.0, "EA", "HOSE", 1, None)
    # the row at the top of the next page belongs to the open record
    assert [(s.name_text, s.part_text, s.page, s.row_pos) for s in p.supplier_rows.orderBy("row_pos").collect()] == [("Acme", "1010 X 36", 0, 0), ("SE", "LATE-1", 1, 1)]
    doc = p.documents.first()
    assert [x.description for x in doc.parts] == ["steel 15 rod"] and doc.metadata.page_count == 2
    assert [x.name_normalized for x in doc.parts[0].suppliers] == ["Acme", "Schneider Electric"]
    assert p.summary.first().line == "UA000001  |  steel 15 rod  |  Acme 1010 X 36; Schneider Electric LATE-1"


@pytest.mark.parametrize(
    "change",
    [
        lambda b: [(t, a - 80 if t == "Acme" else a, x, y) for t, a, x, y in b],  # the name starts too far left
        lambda b: [("Ac,me" if t == "Acme" else t, a, x, y) for t, a, x, y in b],  # punctuation of descriptions
        lambda b: [("..2" if t == "Acme" else t, a, x, y) for t, a, x, y in b],  # a depth marker is no name
        lambda b: [*b, ("2.000000", 360, 388, 96)],  # a quantity on the line
        lambda b: [w for w in b if w[0] != "Acme"],  # no name
        lambda b: [(t, a - 60 if y == 96 else a, x - 60 if y == 96 else x, y) for t, a, x, y in b if t != "far"],  # the part lies outside its band
    ],
)
def test_each_supplier_condition(spark, change):
    assert parse(spark, page(*change(BODY))).supplier_rows.count() == 0


def test_missing_header(spark):
    p = parse(spark, page(*BODY, header=[h for h in HEADER if h[1] not in (270, 294)]))
    assert [(r.missing, r.words) for r in p.errors.collect()] == [("mfg_part", "Part Identifier Description Mfg Name Quantity UM Commodity")]
    assert p.records.count() == 0 and p.documents.count() == 1
    with pytest.raises(HeaderError):
        parse(spark, page(*BODY, header=HEADER[:3]), strict=True).missing  # noqa: B018
    # a phrase never spans two lines
    split = [(0, t, a, b, 40 if t != "Identifier" else 60) for t, a, b in HEADER]
    assert "part_identifier" in parse(spark, split).errors.first().missing


def test_grouping_and_nulls(spark):
    rows = [("d", 1, "A", "Steel Rod", None, None, None, None), ("d", 2, "B", "steel  rod X", 2.5, "EA", "", "A"), ("d", 3, "A", "HD 5", 9.0, "FT", None, None)]
    keyed = rollup.keyed(spark.createDataFrame(rows, "doc_id string, record_seq int, internal_part string, description string, quantity double, uom string, commodity string, parent string"))
    (g,) = rollup.groups(keyed).collect()
    assert (g.description, g.total_quantity, g.uom, g.commodity, g.n_occurrences) == ("Steel Rod", 2.5, "EA", None, 2)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for f in ("b.pdf", "a.pdf", "sub/c.pdf", "x.txt"):
        (tmp_path / "in" / f).write_text("x")
    name = lambda rows: [r.path.rpartition("/")[2] for r in rows]
    assert name(list_sources(spark, str(tmp_path / "in")).collect()) == ["a.pdf", "b.pdf"]
    assert name(list_sources(spark, str(tmp_path / "in"), recursive=True).collect()) == ["a.pdf", "b.pdf", "c.pdf"]
    (tmp_path / "w.tsv").write_text("0\tLB000300\t22\t70\t60\t69\n1\té\t1\t2\t3\t4\n")
    got = read_words(spark, str(tmp_path / "w.tsv")).orderBy("word_id").collect()
    assert [(r.page, r.word_id, r.text, r.x0) for r in got] == [(0, 0, "LB000300", 22.0), (1, 1, "é", 1.0)] and got[0].doc_id.endswith("/w.tsv")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_words(spark, str(tmp_path / "none"))
    p = parse(spark, page(*BODY))
    sinks.write_documents(p.documents, str(tmp_path / "out"))
    assert sinks.read_documents(spark, str(tmp_path / "out")).first().parts[0].description == "steel 15 rod"
    sinks.export_documents(p.documents, str(tmp_path / "single"))
    (back,) = sinks.read_documents(spark, str(tmp_path / "single")).collect()
    assert back.parts == sinks.read_documents(spark, str(tmp_path / "out")).first().parts and back.metadata.page_count == 1
    sinks.write_summary(p.summary, str(tmp_path / "summary"))
    assert spark.read.text(str(tmp_path / "summary")).count() == 1
    assert "extracted_at" not in sinks.golden(p.documents).first().json


def test_pdf_pages():
    class Page:
        def __init__(self, *texts):
            self.texts = texts

        def extract_words(self, **options):
            assert (options["x_tolerance"], options["y_tolerance"]) == (1.5, 2.0)
            return [{"text": t, "x0": 1, "x1": 2, "top": 3, "bottom": 4, "fontname": "f", "size": 9.0} for t in self.texts]

    class File:
        pages = [Page("a", "b"), Page(), Page("c")]

        def __init__(self, content):
            assert content.read() == b"pdf"

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    got = list(pdf_rows("p", b"pdf", File, 1.5, 2.0))
    assert [r[:4] for r in got] == [("p", 0, 0, "a"), ("p", 0, 1, "b"), ("p", 2, 0, "c")] and got[0][4:] == (1.0, 2.0, 3.0, 4.0, "f", 9.0)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_against_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = tables.execute(f'SELECT {", ".join(f"{chr(34)}{c}{chr(34)}" for c in columns)} FROM ({oracle.SQL[name]})').fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_empty_words(spark):
    p = Parse(spark, spark.createDataFrame([], WORDS), spark.createDataFrame([("d", 0, 540.0, 560.0)], PAGES))
    assert p.records.count() == 0 and p.warnings.count() == 2 and p.documents.select(F.size("parts")).first()[0] == 0
