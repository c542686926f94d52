"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence. DataFrame functions only.

Base kinds are found leftmost and non-overlapping by regular expressions whose quantifiers are possessive and which start only at the
edge of a run (or where the last match ended), so that any text is scanned in linear time. Offsets count code points.

Disclosure. For an entity e (a base value, case folded) and a term t (a run of letters, at least MIN_TERM, that no base span touches) in the
same text, at any distance,

    IC(e) = log2(N / n(e)),    PMI(t; e) = log2(N n(t, e) / (n(t) n(e)))

with n counting documents of the whole corpus. A term that at least ``support`` different texts hold with e is *generalised*
where PMI >= ``generalise`` * IC and *removed* where PMI >= ``remove`` * IC (for any e). Every occurrence of such a term, in texts with
and without e, becomes a span of kind ``term``. All statistics come from all documents; nothing is capped.

Of the base kinds only addresses hold letters, so terms are looked up where addresses are blotted out by a character that Unicode keeps
out of texts (MARK; a word that stands beside one in a text counts as touched). Offsets are running sums in blocks of fixed size, so
that a text with any number of matches takes time in proportion to it.

The ``FREQUENT`` most frequent terms that aren't flagged are left out by name before texts are joined with the flagged ones.

Copies of a text are counted by their number but handled once. Null texts count as empty; empty texts have no spans; null or repeated ids
keep their rows; an empty table gives no rows; further columns do not matter to :func:`find_pii` and are passed through by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, replaced, table, text_of

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract, up to possessive quantifiers and the anchor that skips starts inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A character of every match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
MIN_TERM, MARK, FREQUENT, BLOCK = 3, "\ufdd0", 2000, 256
WORD = rf"[\p{{L}}\x{{FDD0}}]{{{MIN_TERM},}}"
SPAN = "array<struct<start:int,end:int,value:string>>"
TERMS = "array<struct<start:int,end:int,action:string>>"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _held(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge) -> Column:
    """For each place of an array of integers (from 0 up) the values up to it, merged (sum or maximum): blocks first, then inside each."""

    def scan(xs, start):
        def step(acc, x):
            now = merge(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def blocks(v):
        return F.transform(F.sequence(F.lit(0), (F.floor((F.size(v) - 1) / BLOCK)).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))

    def whole(v):
        totals = scan(F.transform(blocks(v), lambda b: F.aggregate(b, F.lit(0), merge)), F.lit(0))
        return F.flatten(F.zip_with(blocks(v), F.concat(F.array(F.lit(0)), F.slice(totals, 1, F.size(totals) - 1)), scan))

    return _held(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def positions(text: Column, pattern: str | Column) -> Column:
    """Spans of all matches: running sums over the gaps between them and the matches themselves."""

    def placed(found):
        gaps = F.slice(F.split(text, F.lit(pattern), -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda a, x: a + x)
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return _held(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column, kind: str) -> Column:
    spans = F.filter(positions(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    # texts without the character that each match holds aren't scanned
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(SPAN)) if kind in NEEDS else spans


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["start"], F.lit(":"), x["end"]))


def blotted(text: Column) -> Column:
    """The text with MARK in place of each character of an address."""

    def joined(found):
        gaps = F.split(text, F.lit(PATTERNS["email"]), -1)
        parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.concat(g, F.repeat(F.lit(MARK), F.length(m))))
        return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))

    found = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    return F.when(F.contains(text, F.lit("@")), _held(found, lambda f: F.when(F.size(f) > 0, joined(f)).otherwise(text))).otherwise(text)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    words = F.regexp_extract_all(blotted(text), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~F.contains(w, F.lit(MARK))), F.lower))


def _digest() -> Column:
    return F.unhex(F.md5(F.encode(text_of(), "UTF-8")))


def _found(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with a digest of the text, the base spans of each kind, the entities, and the terms of texts that hold some."""
    out = docs.withColumn("_digest", _digest()).withColumns({f"_{k}": base_spans(text_of(), k) for k in KINDS})
    out = out.withColumn("_entities", F.array_distinct(F.transform(F.concat(*(F.col(f"_{k}") for k in KINDS)), lambda s: F.lower(s["value"]))))
    return out.withColumn("_terms", F.when(F.size("_entities") > 0, terms_of(text_of())))


def disclosing(docs: DataFrame, found: DataFrame, scratch: Scratch, generalise: float, remove: float, support: int) -> tuple[DataFrame, DataFrame] | None:
    """term, action for the terms that disclose an entity, and term, n_t of all terms; None if no term is with an entity in enough texts.
    found: _digest, _entities, _terms of docs."""
    hits = found.filter(F.size("_entities") > 0).groupBy("_digest").agg(F.first("_entities").alias("entities"), F.first("_terms").alias("terms"), F.count(F.lit(1)).alias("copies"))
    hits = scratch.keep(hits)
    held = hits.select("_digest", "copies", F.explode("entities").alias("entity"))
    n_e = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    n_e = scratch.keep(n_e.select("entity", "n_e"))  # entities of fewer texts can have no pair with enough of them
    if n_e.isEmpty():
        return None
    shared = held.join(n_e, "entity").groupBy("_digest").agg(F.collect_list("entity").alias("shared"))
    both = hits.join(shared, "_digest").select("copies", "shared", F.explode("terms").alias("term")).select("copies", "term", F.explode("shared").alias("entity"))
    pairs = scratch.keep(both.groupBy("term", "entity").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support).drop("texts"))
    if pairs.isEmpty():
        return None
    n_t = scratch.keep(docs.select(F.explode(terms_of(text_of())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    n = F.lit(float(found.count()))
    ic = F.log2(n / F.col("n_e"))
    pmi = F.log2(n * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    scored = pairs.join(n_e, "entity").join(n_t, "term").withColumn("ratio", F.when(ic > 0, pmi / ic).otherwise(0.0))
    action = F.when(F.max("ratio") >= remove - 1e-9, "removed").otherwise("generalised")
    flagged = scratch.keep(scored.filter(F.col("ratio") >= generalise - 1e-9).groupBy("term").agg(action.alias("action")))
    return None if flagged.isEmpty() else (flagged, n_t)


def holding(docs: DataFrame, flagged: DataFrame, n_t: DataFrame, scratch: Scratch) -> DataFrame:
    """_digest, flagged (map of term to action) for all texts that hold a flagged term."""
    others = n_t.join(flagged, "term", "left_anti").orderBy(F.desc("n_t"), "term").limit(FREQUENT).collect()
    words = docs.select(_digest().alias("_digest"), F.explode(terms_of(text_of())).alias("term")).filter(~F.col("term").isin([r.term for r in others]))
    held = words.join(flagged, "term").groupBy("_digest").agg(F.collect_set(F.struct("term", "action")).alias("held"))
    return scratch.keep(held.select("_digest", F.map_from_entries("held").alias("flagged")))


def term_spans(text: Column, flagged: Column) -> Column:
    """Where flagged terms (map of term to action) stand: array<struct<start, end, action>>."""

    def placed(clear):
        # the terms as this text writes them; letters need no quotes in a pattern
        forms = F.filter(F.array_distinct(F.regexp_extract_all(clear, F.lit(WORD), F.lit(0))), lambda w: F.element_at(flagged, F.lower(w)).isNotNull())
        pattern = F.concat(F.lit(r"(?<![\p{L}\x{FDD0}])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\x{FDD0}])"))
        found = _held(pattern, lambda p: positions(clear, p))
        return F.transform(found, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at(flagged, F.lower(w["value"])).alias("action")))

    return _held(blotted(text), placed)


def _spans(docs: DataFrame, columns: list[str], scratch: Scratch, generalise: float, remove: float, support: int) -> tuple[DataFrame, DataFrame | None]:
    """``columns`` of docs and of what :func:`_found` adds, with _digest; and :func:`holding`, if there are flagged terms. Base patterns run once over each text."""
    found = scratch.keep(_found(docs).select(*columns, "_digest", "_entities", "_terms"))
    flagged = disclosing(docs, found, scratch, generalise, remove, support)
    return found, flagged and holding(docs, *flagged, scratch)


def _no_terms() -> Column:
    return F.array().cast(TERMS)


def find_pii(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, support: int = 2) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts of the base kinds, the digest of the base spans, and all spans."""
    docs, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession, "pii")
    rows, held = _spans(docs, ["doc_id", *(f"_{k}" for k in KINDS)], scratch, generalise, remove, support)
    if held is None:
        rows = rows.withColumn("terms", _no_terms())
    else:
        # one row a text before the join, so that copies don't meet there
        texts = docs.select(_digest().alias("_digest"), text_of().alias("text")).dropDuplicates(["_digest"]).join(held.hint("merge"), "_digest")
        terms = scratch.keep(texts.select("_digest", term_spans(F.col("text"), F.col("flagged")).alias("terms")))
        rows = rows.join(terms, "_digest", "left").withColumn("terms", F.coalesce("terms", _no_terms()))
    base = F.concat(*(_joined(k, F.col(f"_{k}")) for k in KINDS))
    return rows.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), base.alias("_base"), _joined("term", F.col("terms")).alias("_more")).select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.array_join("_base", ","), 256).alias("base_sha256"), F.array_join(F.concat("_base", "_more"), ",").alias("spans")
    )


def replaced_spans(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, by; in order) replaced. Spans that overlap are replaced together, by what stands for the first."""
    # pieces are cut from blocks, as finding a place in a text takes time in proportion to it
    cut = lambda blocks, a, b: F.when(b > a, F.substring(F.array_join(F.slice(blocks, F.floor(a / BLOCK).cast("int") + 1, (F.floor((b - 1) / BLOCK) - F.floor(a / BLOCK)).cast("int") + 1), ""), a % BLOCK + 1, b - a)).otherwise("")

    def joined(x):
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(x["reach"], k - 1))
        heads = F.filter(F.transform(x["spans"], lambda s, k: F.struct(s["start"].alias("start"), s["by"].alias("by"), before(k).alias("before"))), lambda h: h["start"] >= h["before"])
        parts = F.transform(heads, lambda h: F.concat(cut(x["blocks"], h["before"], h["start"]), h["by"]))
        return F.concat(F.array_join(parts, ""), cut(x["blocks"], F.element_at(x["reach"], -1), x["length"]))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    with_reach = lambda s: F.struct(s.alias("spans"), running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x)).alias("reach"), blocks.alias("blocks"), F.length(text).alias("length"))
    return _held(_held(spans, with_reach), joined)


def redact(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, support: int = 2) -> DataFrame:
    """docs with each text's spans replaced by its kind in brackets; removed terms leave ``[REMOVED]``, generalised ones ``[TERM]``.

    Overlapping spans are replaced together, by the kind of the one that starts first (of the least end and kind, if several do).
    Texts without a span come back as they are, null ones as null.
    """
    # the input's columns travel in one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").cast("string").alias("text"))
    found, held = _spans(rows, ["_row", "text", *(f"_{k}" for k in KINDS)], Scratch(docs.sparkSession, "redact"), generalise, remove, support)
    if held is None:
        found = found.withColumn("terms", _no_terms())
    else:
        found = found.join(held, "_digest", "left").withColumn("terms", F.when(F.col("flagged").isNotNull(), term_spans(text_of(), F.col("flagged"))).otherwise(_no_terms()))

    def tag(kind):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by"))

    tagged = [F.transform(F.col(f"_{k}"), tag(k)) for k in KINDS]
    more = F.transform(F.col("terms"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "removed", "[REMOVED]").otherwise("[TERM]").alias("by")))
    spans = F.array_sort(F.concat(*tagged, more))
    text = replaced_spans(F.col("text"), F.col("_spans"))
    touched = F.size("_spans") > 0
    done = found.select("_row", "text", spans.alias("_spans")).select("_row", F.when(touched, text).otherwise(F.col("text")).alias("_new"), touched.alias("_touched"))
    return done.select(*(F.when(F.col("_touched"), new).otherwise(F.col("_row")[c]).alias(c) for c, new in zip(docs.columns, replaced(docs, F.col("_new")), strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
