"""SQL for op7: base spans from gaps and matches, and disclosing terms by the same statistics."""

_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_VALID = {
    "email": "true",
    "ip": rf"regexp_matches(x.v, '^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$')",
    "card": "len(x.d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(x.d) + 1), lambda i: CASE WHEN (len(x.d) - i) % 2 = 0 THEN x.d[i]::INT ELSE (2 * x.d[i]::INT) // 10 + (2 * x.d[i]::INT) % 10 END)) % 10 = 0",
    "phone": "len(x.d) BETWEEN 8 AND 15",
}


def _positions(text: str, pattern: str) -> str:
    """A list of {s, v, d}: start, value and its digits."""
    g, m = f"string_split_regex({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    return (
        f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': CAST(list_sum(list_transform({g}[1:i], lambda p: len(p))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda p: len(p))), 0) AS INT), "
        f"'v': {m}[i], 'd': regexp_replace({m}[i], '[^0-9]', '', 'g')}})"
    )


def sql() -> str:
    kinds = ", ".join(f"list_transform(list_filter({_positions('text', p)}, lambda x: {_VALID[k]}), lambda x: {{'k': '{k}', 's': x.s, 'e': CAST(x.s + len(x.v) AS INT), 'v': x.v}}) AS {k}" for k, p in _PATTERNS.items())
    word, mark, email = r"[\p{L}\x{FDD0}]{3,}", "chr(64976)", _PATTERNS["email"]
    g, m = f"string_split_regex(text, '{email}')", f"regexp_extract_all(text, '{email}')"
    blotted = f"array_to_string(list_transform(range(1, len({m}) + 1), lambda i: {g}[i] || repeat({mark}, len({m}[i]))), '') || {g}[-1]"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS (SELECT text, count(*) AS copies, CASE WHEN contains(text, '@') THEN {blotted} ELSE text END AS clear, {kinds} FROM docs GROUP BY text
), base AS (SELECT text, copies, clear, email, ip, card, phone, list_concat(list_concat(email, ip), list_concat(card, phone)) AS spans FROM found
), ents AS (SELECT DISTINCT text, copies, lower(x.v) AS entity FROM (SELECT text, copies, unnest(spans) AS x FROM base)
), n_e AS (SELECT entity, sum(copies) AS n_e FROM ents GROUP BY ALL HAVING count(*) >= 2
), words AS (SELECT DISTINCT text, copies, lower(w) AS term FROM (SELECT text, copies, unnest(regexp_extract_all(clear, '{word}')) AS w FROM base) WHERE NOT contains(w, {mark})
), pairs AS (SELECT term, entity, sum(words.copies) AS n_te FROM words JOIN ents USING (text) JOIN n_e USING (entity) GROUP BY ALL HAVING count(*) >= 2
), n_t AS (SELECT term, sum(copies) AS n_t FROM words GROUP BY ALL
), flagged AS (SELECT DISTINCT term FROM (SELECT term, CASE WHEN n > n_e THEN log2(n * n_te::DOUBLE / (n_t::DOUBLE * n_e)) / log2(n::DOUBLE / n_e) ELSE 0 END AS ratio
    FROM pairs JOIN n_e USING (entity) JOIN n_t USING (term), (SELECT count(*) AS n FROM docs)) WHERE ratio >= 0.8 - 1e-9
), held AS (SELECT text, clear FROM base WHERE text IN (SELECT text FROM words JOIN flagged USING (term))
), places AS (SELECT text, w.s AS s, CAST(w.s + len(w.v) AS INT) AS e, lower(w.v) AS term FROM (SELECT text, unnest({_positions('clear', word)}) AS w FROM held) WHERE NOT contains(w.v, {mark})
), terms AS (SELECT text, string_agg('term:' || s || ':' || e, ',' ORDER BY s) AS terms FROM places JOIN flagged USING (term) GROUP BY ALL
), joined AS (SELECT text, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone, array_to_string(list_transform(spans, lambda x: x.k || ':' || x.s || ':' || x.e), ',') AS plain FROM base)
SELECT doc_id, n_email, n_ip, n_card, n_phone, sha256(plain) AS base_sha256, concat_ws(',', nullif(plain, ''), terms) AS spans FROM docs JOIN joined USING (text) LEFT JOIN terms USING (text)
"""


SQL = sql()
