"""Column functions over tokens, names and descriptions. All stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of tokens.
PART_SHAPE = r"""^[A-Za-z0-9][A-Za-z0-9._/#"'-]{2,30}$"""
DEPTH_MARKER = r"^(?:\.{0,9})(\d{1,2})$"
QUANTITY_SHAPE = r"^\d+\.\d*0{3,}$"
DATE_SHAPE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
ISO_DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"
FLAG_TOKEN = r"^(?:[A-Z]{1,2}|\d)$"
FALLBACK_ID = r"^[A-Z]{1,4}\d{3,8}$"
NAME_BAD = r'[,"?*;:]'
SCORE_BAD = r"[,?*;:]"
TRAILING = ".,;:!?"
UNITS = ("U", "EA", "FT", "LB", "KG", "M", "MM", "CM", "IN", "PC", "RL", "BX", "BG")


def token_norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def phrase_norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def is_id_candidate(c: Column) -> Column:
    """Letters and digits only, at least three, and one of each."""
    return c.rlike(r"^[\p{L}\p{N}]{3,}$") & c.rlike(r"\p{L}") & c.rlike(r"\p{N}")


def token_shape(c: Column) -> Column:
    """L for a letter, D for a digit, X for all else."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{L}", "L"), r"\p{N}", "D"), "[^LD]", "X")


def shape_pattern(shape: Column) -> Column:
    """The regular expression of a shape, run by run."""
    runs = F.regexp_extract_all(shape, F.lit("(L+|D+|X+)"), F.lit(0))

    def one(run: Column) -> Column:
        head = F.substring(run, 1, 1)
        body = F.when(head == "L", "[A-Z]").when(head == "D", r"\d").otherwise("[^A-Za-z0-9]")
        return F.when(F.length(run) > 1, F.concat(body, F.lit("{"), F.length(run).cast("string"), F.lit("}"))).otherwise(body)

    return F.array_join(F.transform(runs, one), "")


def _accents() -> tuple[str, str]:
    # Latin letters with marks, and full-width forms, by their decomposition; dashes and quotes by their blocks
    cps = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F))
    pairs = [(chr(cp), unicodedata.normalize("NFKD", chr(cp))[0]) for cp in cps]
    pairs = [(a, b) for a, b in pairs if b.isascii()] + [(chr(cp), "-") for cp in range(0x2010, 0x2016)] + [(chr(cp), "'") for cp in range(0x2018, 0x201C)] + [(chr(cp), '"') for cp in range(0x201C, 0x2020)]
    pairs += [("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("ı", "i"), ("ħ", "h"), ("Ħ", "H"), ("\u00a0", " ")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()
# Letters that become two.
DOUBLES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}


def ascii_text(c: Column) -> Column:
    out = F.translate(c, _FROM, _TO)
    for a, b in DOUBLES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def pre_normalize(c: Column) -> Column:
    """The key under which spellings of a supplier meet."""
    base = F.regexp_replace(F.lower(F.trim(ascii_text(c))), r"\s+", " ")
    return F.trim(F.regexp_replace(base, "[" + TRAILING + "]+$", ""))


def is_acronym(c: Column) -> Column:
    return F.trim(c).rlike(r"^\p{Lu}{2,4}$")


def initials(c: Column) -> Column:
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w.rlike(r"^\p{L}"))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def smart_title(c: Column) -> Column:
    """Capitalises each word, but keeps one of mixed case as it is."""

    def one(w: Column) -> Column:
        tail = F.substring(w, 2, 1_000_000)
        return F.when(tail.rlike(r"\p{Ll}") & w.rlike(r"\p{Lu}"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(tail)))

    return F.array_join(F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), one), " ")


def minted_name(c: Column) -> Column:
    raw = F.trim(c)
    keep = (F.length(raw) <= 4) & raw.rlike(r"\p{Lu}") & ~raw.rlike(r"\p{Ll}")
    return F.when(keep, raw).otherwise(smart_title(raw))


def clean_description(raw: Column, commodity: Column) -> Column:
    """Without flag tokens and the record's own commodity."""
    kept = F.filter(F.split(F.trim(raw), r"\s+"), lambda t: ~t.rlike(FLAG_TOKEN) & ~F.coalesce(t == commodity, F.lit(False)))
    return F.trim(F.array_join(kept, " "))


def description_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def shortened(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
