"""Resolution of supplier names: aliases and initials by joins, the rest in order within each document."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import initials, is_acronym, minted_name, pre_normalize

MIN_SCORE = 88.0


def alias_keys(aliases: DataFrame) -> DataFrame:
    """key, canonical: later entries of the configuration overwrite earlier ones."""
    keyed = aliases.withColumn("key", pre_normalize(F.col("alias")))
    return keyed.groupBy("key").agg(F.max_by("canonical", "entry").alias("canonical"))


def alias_lookup(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (.., raw_name) with key and canonical, null where no alias is known. The alias table is a driver-side constant."""
    return names.withColumn("key", pre_normalize(F.col("raw_name"))).join(F.broadcast(alias_keys(aliases)), "key", "left")


def acronym_lookup(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names with by_initials: the first canonical whose initials a short upper-case name spells."""
    known = aliases.select("canonical", "canon_idx").distinct().withColumn("spelled", initials(F.col("canonical")))
    first = known.groupBy("spelled").agg(F.min_by("canonical", "canon_idx").alias("by_initials"))
    token = F.when(is_acronym(F.col("raw_name")), F.trim("raw_name"))
    return names.withColumn("spelled", token).join(F.broadcast(first), "spelled", "left").drop("spelled")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity in percent by insertions and deletions."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a stretch of the longer one of its length, or a shorter one at either end."""
    short, long_ = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0.0
    return max(ratio(short, long_[max(0, s) : s + n]) for s in range(1 - n, len(long_)))


def may_reach(a: str, b: str, least: float) -> bool:
    """Whether ``similarity`` can reach ``least``: with c letters in common no ratio is above that of the shorter string to a stretch of c letters."""
    short, long_ = sorted((a, b), key=len)
    if {*a.split()} & {*b.split()}:
        return True  # a shared word may count fully
    common = sum((Counter(short) & Counter(long_)).values())
    return bool(short) and 200.0 * common / (len(short) + common) >= least


def similarity(a: str, b: str) -> float:
    """A weighted best of plain, word-sorted, word-set and partial ratios; an approximation by the published descriptions."""
    if not a or not b:
        return 0.0
    wa, wb = sorted(a.split()), sorted(b.split())
    both, only_a, only_b = sorted({*wa} & {*wb}), sorted({*wa} - {*wb}), sorted({*wb} - {*wa})
    shared, sa, sb = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    words = max(ratio(" ".join(wa), " ".join(wb)), ratio(sa, sb), *((ratio(shared, sa), ratio(shared, sb)) if both else (0.0,)))
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * words)
    scale = 0.9 if spread <= 8 else 0.6
    set_part = 100.0 if both else partial_ratio(sa, sb)
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * max(partial_ratio(" ".join(wa), " ".join(wb)), set_part))


def _resolver(seed: list[tuple[str, str, str]], least: float):
    """seed: canonical, its key, its initials, in order. Walks a document's unresolved names in order of their first appearance."""

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        known, cache, out = list(seed), {}, []
        for r in group.sort_values("first_seq").itertuples(index=False):
            canonical = cache.get(r.key)
            how = "key"
            if canonical is None and r.token:
                canonical, how = next((c for c, _, i in known if i == r.token), None), "initials"
            if canonical is None and known:
                score, best = max((similarity(r.key, key) if may_reach(r.key, key, least) else 0.0, -k) for k, (_, key, _) in enumerate(known))
                canonical, how = (known[-best][0], "similar") if score >= least else (None, "")
            if canonical is None:
                canonical, how = r.minted, "new"
                if all(c != canonical for c, _, _ in known):
                    known.append((canonical, r.minted_key, r.minted_initials))
            cache.setdefault(r.key, canonical)
            out.append((r.doc_id, r.raw_name, canonical, how, int(r.first_seq)))
        return pd.DataFrame(out, columns=["doc_id", "raw_name", "canonical", "how", "first_seq"])

    return resolve


def resolved(names: DataFrame, aliases: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """doc_id, raw_name, canonical, how for each distinct raw name of names (doc_id, seq, raw_name).

    Aliases are settled by a join; only a document's distinct unresolved names go through the ordered loop, which is what
    makes one name's canonical available to the next.
    """
    first = names.groupBy("doc_id", "raw_name").agg(F.min("seq").alias("first_seq"))
    looked = alias_lookup(first, aliases)
    blank = F.trim("raw_name") == ""
    easy = looked.filter(F.col("canonical").isNotNull() | blank).select("doc_id", "raw_name", F.coalesce("canonical", "raw_name").alias("canonical"), F.lit("alias").alias("how"), "first_seq")
    minted = minted_name(F.col("raw_name"))
    hard = looked.filter(F.col("canonical").isNull() & ~blank).select("doc_id", "raw_name", "first_seq", "key", F.when(is_acronym(F.col("raw_name")), F.trim("raw_name")).alias("token"), minted.alias("minted"), pre_normalize(minted).alias("minted_key"), initials(minted).alias("minted_initials"))
    # the configured canonicals: a driver-side constant
    seed = [tuple(r) for r in aliases.groupBy("canonical").agg(F.min("canon_idx").alias("i")).orderBy("i").select("canonical", pre_normalize(F.col("canonical")), initials(F.col("canonical"))).collect()]
    loop = hard.groupBy("doc_id").applyInPandas(_resolver(seed, least), "doc_id string, raw_name string, canonical string, how string, first_seq long")
    return easy.unionByName(loop)


def new_suppliers(found: DataFrame) -> DataFrame:
    """doc_id, canonical, nth: names that no alias knew, in the order in which they were minted."""
    new = found.filter("how = 'new'").groupBy("doc_id", "canonical").agg(F.min("first_seq").alias("first_seq"))
    return new.select("doc_id", "canonical", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first_seq")) - 1).alias("nth"))
