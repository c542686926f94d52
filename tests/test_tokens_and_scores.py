"""Shapes, scores, identifier patterns and names against fixed expectations."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import idpattern, names, scoring
from millrace.sources import config

SCORES = [
    ("77777777", 0.6, None, False), ("QQQQQQQQ", 0.6, None, False), ("KLMN4821", 0.6, None, True), ("731-00412", 0.6, None, False), ("KV220145", 0.6, None, True),
    ("12/5/2019", 0, "date_shaped", False), ("1998-1-30", 0, "date_shaped", False), ("37.5000", 0, "quantity_shaped", False), ("", 0, "empty_token", False), ("  ", 0, "empty_token", False),
    ("88 K 140", 0.6, None, False), ("TRV 90-Q-7-B-20-2-PLC-", 0.5, None, False), ("410077.3105", 0.6, None, False), ("gasket", 0.5, None, False), ("QR,ST", 0.4, None, False),
    ("K,L;M", 0.2, "below_min_confidence", False), ("W4V", 0, "below_min_confidence", False), ('18"', 0, "below_min_confidence", False), ("9-foot hose, 3yard", 0.1, "below_min_confidence", False),
]


def scores(spark, tokens, weights=config.Weights()):  # noqa: B008
    df = spark.createDataFrame([(i, t, T.FALLBACK_ID) for i, t in enumerate(tokens)], "seq int, token string, pattern string")
    return [(round(r.confidence, 6), r.reason, r.is_internal) for r in scoring.scored(df, weights=weights).orderBy("seq").collect()]


def test_scores(spark):
    assert scores(spark, [t for t, *_ in SCORES]) == [(c, r, i) for _, c, r, i in SCORES]
    assert scores(spark, ["731-00412"], config.Weights(min_confidence=0.9)) == [(0.6, "below_min_confidence", False)]
    assert scores(spark, [None]) == [(0.0, "empty_token", False)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("KQV904-/.", min_size=4, max_size=20), min_size=5, max_size=5))
def test_noise_never_raises_a_score(spark, tokens):
    base = scores(spark, tokens)
    for tail in (" ", "q", ",", '"', "'", "?", "*", ";", ":"):
        for (a, ra, _), (b, rb, _) in zip(base, scores(spark, [t + tail for t in tokens]), strict=True):
            if ra not in ("date_shaped", "quantity_shaped", "empty_token") and rb not in ("date_shaped", "quantity_shaped", "empty_token"):
                assert b <= a + 1e-9


def test_token_shapes(spark):
    rows = [("...4", 0, 1, 0, 0, 0), ("27", 0, 1, 0, 0, 0), ("8", 0, 1, 0, 0, 1), ("30/15", 1, 0, 0, 0, 0), ("4.50000", 1, 0, 1, 0, 0), ("410077.3105", 1, 0, 0, 0, 0), ("12/5/2019", 1, 0, 0, 1, 0), ("1998-01-30", 1, 0, 0, 0, 0), ("FT", 0, 0, 0, 0, 1), ("(31)", 0, 0, 0, 0, 0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select(*(F.col("t").rlike(p).cast("int") for p in (T.PART_SHAPE, T.DEPTH_MARKER, T.QUANTITY_SHAPE, T.DATE_SHAPE, T.FLAG_TOKEN))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_shapes_and_candidates(spark):
    df = spark.createDataFrame([("KV220145", "LLDDDDDD"), ("Q771204", "LDDDDDD"), ("7-Ä½.b", "DXLDXL"), ("", "")], "t string, s string")
    assert df.filter(T.token_shape(F.col("t")) != F.col("s")).count() == 0
    keep, drop = "KV220145 TR000871 Q771204 WX123456 DD55 B7C".split(), ".4 ...2 8 27 ; ) (7) QT k KLMNO 90817".split()
    found = spark.createDataFrame([("d", i, t) for i, t in enumerate(keep + drop)], "doc_id string, seq int, token string")
    assert {r.token for r in idpattern.candidates(found).collect()} == set(keep)


def discover(spark, tokens):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(tokens)], "doc_id string, seq int, token string")
    return idpattern.discovered(spark.createDataFrame([("d",)], "doc_id string"), df).first()


def test_pattern_discovery(spark):
    r = discover(spark, ["KV220145"] * 9 + ["TR000871"] * 9 + ["Q771204"] * 5 + ["WX123456", "HJ654321", ".4", "27", ")"])
    assert (r.pattern, r.match_rate, r.fallback) == (r"^([A-Z]{2}\d{6}|[A-Z]\d{6})$", 1.0, False)
    for tokens in ([], ["...2", "8", ";"]):
        r = discover(spark, tokens)
        assert (r.pattern, r.match_rate, r.fallback) == (T.FALLBACK_ID, 0.0, True)
    r = discover(spark, ["kv220"] * 12)
    assert (r.pattern, r.match_rate, r.fallback) == (T.FALLBACK_ID, 0.0, True)
    # a shape at exactly the least share is kept
    assert "LLLDDD" in discover(spark, ["KV220145"] * 19 + ["QRS417"]).shapes


def test_name_keys(spark):
    pairs = [("Larkspur-Valves", "larkspur-valves"), ("  Blue Ridge  ", "blue ridge"), ("quill!?", "quill"), ("Blue \t Ridge", "blue ridge"), ("Café Müller:", "cafe muller"), ("Škoda Ŵerke", "skoda werke"), ("Larkspur‐Valves", "larkspur-valves"), ("ＡＢ９", "ab9"), ("Ærø’s", "aero's"), ("Việt", "viet")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.a for r in df.filter(T.pre_normalize(F.col("a")) != F.col("b")).collect()] == []
    pairs = [("HD Motion", "Hd Motion"), ("LARKSPUR", "Larkspur"), ("12/40", "12/40"), ("DeWitt", "DeWitt"), ("quill", "Quill"), ("QLL", "QLL")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.filter(T.minted_name(F.col("a")) != F.col("b")).count() == 0


def resolve(spark, *raw, aliases=None):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(raw)], "doc_id string, seq int, raw_name string")
    return {r.raw_name: (r.canonical, r.how) for r in names.resolved(df, config.alias_table(spark, aliases)).collect()}


def test_name_resolution(spark):
    got = resolve(spark, "mcmaster;", "ncc:", "MODICON", "Larkspur", "larkspur", "LARCO", "Norton Gears", "Norton-Gears", "Apex Industries", "  ")
    assert got["mcmaster;"][0] == "McMaster-Carr" and got["ncc:"][0] == "North Coast Components" and got["MODICON"][0] == "Schneider Electric"
    assert got["Larkspur"] == ("Larkspur", "new") and got["larkspur"][0] == "Larkspur" and got["LARCO"][0] != "Larkspur"
    assert got["Norton-Gears"] == ("Norton Gears", "similar") and got["Apex Industries"] == ("Apex Industries", "new") and got["  "][0] == "  "
    # initials need no alias, and one alias under two canonicals goes to the later
    assert resolve(spark, "BRH", aliases={"Blue Ridge Hydraulics": []})["BRH"] == ("Blue Ridge Hydraulics", "initials")
    assert resolve(spark, "either", aliases={"First": ["either"], "Second": ["either"]})["either"][0] == "Second"


def plain_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100


def test_similarity():
    assert names.similarity("norton gears", "norton-gears") == pytest.approx(100 * 22 / 24)
    assert names.similarity("apex industries", "norton gears") < 88
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc de") for _ in range(rng.randint(1, 12))).strip() or "a" for _ in range(2))
        assert names.ratio(a, b) == pytest.approx(plain_ratio(a, b))
        short, long_ = sorted((a, b), key=len)
        # a stretch at an end may be shorter than the string
        stretches = {long_[i:j] for i in range(len(long_)) for j in range(i + 1, len(long_) + 1) if j - i == len(short) or (j - i < len(short) and (i == 0 or j == len(long_)))}
        assert names.partial_ratio(a, b) == pytest.approx(max(plain_ratio(short, x) for x in stretches))
        for least in (50, 88):
            assert names.may_reach(a, b, least) or names.similarity(a, b) < least


def test_weights_and_synonyms(spark, tmp_path):
    (tmp_path / "w.yaml").write_text("length_min: 5\nmin_confidence: 1\n")
    assert config.read_weights(spark, str(tmp_path / "w.yaml")) == config.Weights(length_min=5, min_confidence=1.0)
    (tmp_path / "w.yaml").write_text("no_such: 5\n")
    with pytest.raises(ValueError):
        config.read_weights(spark, str(tmp_path / "w.yaml"))
    (tmp_path / "s.yaml").write_text("mfg_name: Vendor\n")
    with pytest.raises(ValueError):
        config.read_synonyms(spark, str(tmp_path / "s.yaml"))
    (tmp_path / "a.yaml").write_text("")
    assert config.read_aliases(spark, str(tmp_path / "a.yaml")) == {}
    (tmp_path / "a.yaml").write_text("Blue Ridge:\n  - BR\n  - 12\nQuill:\n")
    assert config.read_aliases(spark, str(tmp_path / "a.yaml")) == {"Blue Ridge": ["BR", "12"], "Quill": []}
    (tmp_path / "s.yaml").write_text("uom: [Each, Pack]\n")
    assert config.read_synonyms(spark, str(tmp_path / "s.yaml")) == {"uom": ["Each", "Pack"]}
