"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps homoglyphs of other scripts and digits used as letters, and turns all else into blanks. A
lexicon entry is a whole word or the beginning of a word; its weight is the lower confidence bound of its log odds ratio
between toxic and clean labelled rows. Exception phrases (two words, one of them an entry) take an entry's weight back; they are
given, or learned where the phrase occurs in clean rows only. The weighted sum, normalised by the number of words, gives the
score through a logistic curve in two features: log density and log sum.

Learning uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``SAMPLE`` of them (those with the smallest hash of the id;
a documented bound), one text for each id (that of the least digest, if an id is repeated). All words of these rows may become
entries and all their phrases exceptions; there is no further cap, as the sample bounds both. Labels, lang, source and doc_id are no inputs
of a score. Scoring reads every whole text, of any length, where it is stored, without a shuffle. Null and empty texts get the score
of no match; null ids count as the text ''; repeated rows give a row each, equal texts equal scores; an empty table gives no rows; further
columns are ignored by scoring and passed through by rejecting; without usable labels the lexicon is empty and all scores are 0.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, slices, table

SAMPLE, FOLDS = 20_000, 5
PREFIXES, MIN_WEIGHT, Z = (4, 5, 6), 1.5, 2.0
#: Fixed: letters of other scripts that look like Latin ones, and characters used in place of letters.
HOMOGLYPHS = dict(zip("аеорсхуіјѕԁһкмтвнαεοριυνκτ", "aeopcxyijsdhkmtbhaeopiuvkt", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bag", "clown fish", "idiot proof")


def _folds() -> dict[int, str]:
    out = {}
    for cp in range(0x250):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        out[cp] = base if base.isalpha() else " "
    out |= {cp: " " for cp in (*range(0x2000, 0x2070), *range(0x3000, 0x3004))}
    out |= {cp: "" for cp in (0xAD, *range(0x200B, 0x200E), 0x2060, *range(0x300, 0x370))}
    out |= {ord(a): b for a, b in (HOMOGLYPHS | LEET).items()}
    out[0xDF] = "ss"
    return out


_TABLE = _folds()


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    return (text or "").lower().translate(_TABLE).split()


def entries_of(words: list[str]) -> set[str]:
    """Candidate entries: ' word ' for the whole word, ' wor' for its beginning."""
    distinct = set(words)
    out = {f" {w} " for w in distinct}
    for n in PREFIXES:
        out |= {" " + w[:n] for w in distinct if len(w) >= n}
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] | None = None  # bias, log density, log sum

    def matcher(self):
        import ahocorasick

        if not self.weights:
            return None
        m = ahocorasick.Automaton()
        for k, w in self.weights.items():
            m.add_word(k, (len(k), w))
        m.make_automaton()
        return m

    def hits(self, matcher, words: list[str]) -> tuple[float, list[str]]:
        """The sum of weights of matched entries, and the phrases (pairs of words) around each match."""
        if matcher is None or not words:
            return 0.0, []
        hay = " " + " ".join(words) + " "
        total, phrases, last = 0.0, [], -1
        for end, (n, w) in matcher.iter(hay):
            start = end - n + 1
            if start == last:  # one match a word
                continue
            last = start
            a = hay.find(" ", start + 1)
            before, after = hay.rfind(" ", 0, start), hay.find(" ", a + 1)
            around = [hay[before + 1 : a]] if before >= 0 else []
            around += [hay[start + 1 : after]] if after >= 0 else []
            if any(p in self.exceptions for p in around):
                continue
            phrases += around
            total += w
        return total, phrases

    def score(self, total: float, n_words: int) -> float:
        if self.curve is None:
            return 0.0
        b, d, s = self.curve
        z = b + d * math.log1p(100 * total / max(1, n_words)) + s * math.log1p(total)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def choose_entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries whose log odds ratio is surely high; one that begins with a chosen entry adds nothing and is left out."""
    weighed = []
    for k, (a, b) in counts.items():
        ratio = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        weight = ratio - Z * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if weight >= MIN_WEIGHT:
            weighed.append((k, weight))
    out: dict[str, float] = {}
    for k, weight in sorted(weighed, key=lambda x: (len(x[0].strip()), x[0])):
        if not any(k[: n + 1] in out for n in PREFIXES):
            out[k] = weight
    return out


def fit_curve(total: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float] | None:
    """Logistic regression by Newton's method with a slight ridge."""
    if not toxic.any() or toxic.all():
        return None
    x = np.column_stack([np.ones(len(total)), np.log1p(100 * total / np.maximum(1, words)), np.log1p(total)])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, 0.01, 0.01])
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge + 1e-9 * np.eye(3), x.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def held_out():
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions=EXCEPTIONS) -> Model:
    """A model from at most ``sample`` labelled rows outside the held-out fold."""
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounds what is broadcast and collected below
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # read by the four passes below
    rows = Scratch(docs.sparkSession, "toxicity").keep(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.md5(F.encode("text", "UTF-8")), F.col("text").isNull())).alias("text")).select("toxic", "text"))

    def count(batches):
        counts: Counter = Counter()

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["entry", "toxic", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, 64):
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts.update((e, y) for e in entries_of(fold(text)))
                    counts[("", y)] += 1
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    summed = rows.mapInArrow(count, "entry string, toxic int, n long").groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b"))
    summed = Scratch(docs.sparkSession, "toxicity").keep(summed)
    sizes = summed.filter("entry = ''").first()
    if sizes is None or not sizes.a or not sizes.b:
        return Model()
    toxic, clean = int(sizes.a), int(sizes.b)
    bound = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1)) - Z * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    strong = summed.filter("entry != ''").filter(bound >= MIN_WEIGHT).collect()
    model = Model(choose_entries({r.entry: (int(r.a), int(r.b)) for r in strong}, toxic, clean), frozenset(exceptions))

    def phrases(batches):
        matcher, counts = model.matcher(), Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((p, y) for p in set(model.hits(matcher, fold(text))[1]))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["phrase", "toxic", "n"])

    innocent = rows.mapInArrow(phrases, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b"))
    learned = innocent.filter("a = 0 AND b >= 3").collect()
    model.exceptions |= {r.phrase for r in learned}

    def features(texts):
        matcher = model.matcher()
        words = [fold(t) for t in texts]
        return [[model.hits(matcher, w)[0] for w in words], [len(w) for w in words]]

    seen = map_texts(rows, features, "toxic int, total double, words long").collect()  # at most the sample
    model.curve = fit_curve(np.array([r.total for r in seen]), np.array([r.words for r in seen]), np.array([r.toxic == 1 for r in seen], dtype=float))
    return model


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words for each row of docs."""
    cache: list = []

    def rows(texts):
        if not cache:
            cache.append(model.matcher())
        words = [fold(t) for t in texts]
        scores = [model.score(model.hits(cache[0], w)[0], len(w)) for w in words]
        return [scores, [int(s >= 0.5) for s in scores], [len(w) for w in words]]

    return map_texts(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), rows, "doc_id long, held_out boolean, score double, predicted int, n_words long")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    cache: list = []

    def run(batches):
        if not cache:
            cache.append(model.matcher())
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, 256):
                keep = []
                for t in part.column(at).to_pylist():
                    w = fold(t)
                    keep.append(model.score(model.hits(cache[0], w)[0], len(w)) < 0.5)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_rows(docs, learn(docs, table(spark, sf_dir, "labels")))
