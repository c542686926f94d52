"""BPE encoding by a tokenization automaton, and decoding by the labels of its arcs.

The automaton reads tokens. It starts as one state with a loop for each base symbol; each merge (a, b) -> c then replaces a gadget:
arcs labelled a go to a copy of their target that lacks the arc b, and wherever an arc a leads on to b, an arc c is added to
where b led. All arcs of one label share one target, so a state is told by its parent, the arc it lacks and when it was made,
and whether it has an arc follows from these; nothing of size states x labels is built. A merge whose arc b is already
gone can never apply and gets no arc. The result accepts exactly the token sequences that applying the merges in order gives.

Encoding runs over the bytes of a pre-split word. The subset construction over (state, place within a label) is deterministic,
since each prefix of a word has one correct tokenization; its transitions go into a table as they are met. Each step notes the
label that ends there, and following the labels from the end gives the tokens. The table and the cache of words are cleared at a
fixed size, which changes no result. Decoding joins the labels of the arcs as the vocabulary's decoder does.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

MAX_STATES, MAX_WORDS = 150_000, 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


class Automaton:
    """merges: pairs of token strings, in order; symbols: the base symbols."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        self.text = list(symbols)  # of each label
        self.left, self.right = [-1] * len(symbols), [-1] * len(symbols)
        self.size = [1] * len(symbols)
        self.base = len(symbols)
        self.target = [0] * len(symbols)  # state that each label's arcs lead to
        self.parent, self.lacks, self.born = [-1], [-1], [0]  # of each state
        known = {s: [k] for k, s in enumerate(symbols)}
        made = set(symbols)
        for t, (a, b) in enumerate(merges, 1):
            if a not in made or b not in made:
                raise ValueError(f"merge {t} uses a token that no earlier merge makes")
            made.add(a + b)
            # a token that only merges without effect make has no label
            for x in known.get(a, ()):
                for y in known.get(b, ()):
                    self._gadget(x, y, known)
        self._index()
        self.children: dict[int, int] = {}
        self.ends: dict[int, list[int]] = {}
        self.inner: set[int] = set()
        nodes = 1
        for v in range(len(self.text)):
            node = 0
            for s in self.spelling(v):
                key = node * self.base + s
                if key not in self.children:
                    self.children[key] = nodes
                    self.inner.add(node)
                    nodes += 1
                node = self.children[key]
            self.ends.setdefault(node, []).append(v)
        self.clear()

    def _gadget(self, a: int, b: int, known: dict[str, list[int]]) -> None:
        source = self.target[a]
        if not self.has_arc(source, b):
            return
        c = len(self.text)
        self.text.append(self.text[a] + self.text[b])
        self.left.append(a)
        self.right.append(b)
        self.size.append(self.size[a] + self.size[b])
        self.target.append(self.target[b])
        known.setdefault(self.text[c], []).append(c)
        self.parent.append(source)
        self.lacks.append(b)
        self.born.append(c)
        self.target[a] = len(self.parent) - 1

    def has_arc(self, state: int, label: int) -> bool:
        """Labels are numbered as they are made, so a state made with label c knew all before c; c and later ones follow their first part."""
        while True:
            if label >= self.base and label >= self.born[state]:
                label = self.left[label]
            elif state == 0:
                return True
            elif label == self.lacks[state]:
                return False
            else:
                state = self.parent[state]

    def _index(self) -> None:
        """An Euler tour of the states by parent; for each label the disjoint tour ranges of the states below one that lacks it."""
        below: list[list[int]] = [[] for _ in self.parent]
        for q, p in enumerate(self.parent[1:], 1):
            below[p].append(q)
        self.first, last, clock, todo = [0] * len(self.parent), [0] * len(self.parent), 0, [0]
        while todo:
            q = todo.pop()
            if q < 0:
                last[~q] = clock
                continue
            self.first[q] = clock
            clock += 1
            todo.append(~q)
            todo += below[q]
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        for q in range(1, len(self.parent)):
            ranges.setdefault(self.lacks[q], []).append((self.first[q], last[q], self.born[q]))
        self.lacking = {v: tuple(zip(*sorted(r), strict=True)) for v, r in ranges.items()}

    def allowed(self, state: int, label: int) -> bool:
        """``has_arc`` once all merges are in: the label, or a first part of it, is lacked by an ancestor made while that part stood for the label."""
        at, limit = self.first[state], len(self.text)
        while True:
            found = self.lacking.get(label)
            if found is not None:
                k = bisect_right(found[0], at) - 1
                if k >= 0 and at < found[1][k] and found[2][k] <= limit:
                    return False
            if label < self.base:
                return True
            limit, label = label, self.left[label]

    def spelling(self, label: int) -> list[int]:
        out, todo = [], [label]
        while todo:
            v = todo.pop()
            if v < self.base:
                out.append(v)
            else:
                todo += [self.right[v], self.left[v]]
        return out

    def clear(self) -> None:
        start = ((0, 0),)
        self.sets, self.numbers, self.ended, self.table = [start], {(start, -1): 0}, [-1], {}

    def _step(self, state: int, symbol: int) -> int:
        going, done = [], -1
        for p, node in self.sets[state]:
            node = self.children.get(node * self.base + symbol)
            if node is None:
                continue
            for v in self.ends.get(node, ()):
                if self.allowed(p, v):
                    done = v
                    break
            if node in self.inner:
                going.append((p, node))
        if done >= 0:
            going.append((self.target[done], 0))
        key = (tuple(going), done)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key[0])
            self.ended.append(done)
        self.table[state * self.base + symbol] = out = self.numbers[key]
        return out

    def encode(self, word: list[int]) -> list[int]:
        """Labels of a word given as base symbols."""
        if len(self.sets) > MAX_STATES:
            self.clear()
        state, ended, look, base = 0, [], self.table.get, self.base
        for s in word:
            nxt = look(state * base + s)
            state = self._step(state, s) if nxt is None else nxt
            ended.append(self.ended[state])
        out, at = [], len(word)
        while at:
            v = ended[at - 1]
            out.append(v)
            at -= self.size[v]
        return out[::-1]


class WordCodec:
    """A vocabulary file with word-end suffix, lower-casing normaliser and byte-level symbols."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(symbols + [s + self.suffix for s in symbols], merges)
        self.ids = [model["vocab"][t] for t in self.automaton.text]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        (pattern,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(pattern)
        self.cache: dict[str, tuple[bytes, int, str]] = {}

    @staticmethod
    def normal(text: str) -> str:
        # a capital sigma lower-cases alike everywhere
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word(self, w: str) -> tuple[bytes, int, str]:
        raw = list(w.encode("utf-8"))
        raw[-1] += 256
        labels = self.automaton.encode(raw)
        ids = np.array([self.ids[v] for v in labels], dtype="<u4").tobytes()
        if len(self.cache) >= MAX_WORDS:
            self.cache.clear()
        out = (ids, len(labels), " ".join(self.automaton.text[v] for v in labels))
        if len(w) <= 64:
            self.cache[w] = out
        return out

    def pieces(self, text: str):
        """(ids as bytes, their number, decoded text) of each word or special token."""
        get = self.cache.get
        for part in self.split_special.split(text) if self.split_special else [text]:
            if (special := self.special.get(part)) is not None:
                yield np.array([special], dtype="<u4").tobytes(), 1, part
            elif part:
                for w in self.words.findall(self.normal(part)):
                    yield get(w) or self.word(w)

    def both(self, text: str | None) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        found = list(self.pieces(text or ""))
        ids, counts, texts = zip(*found, strict=True) if found else ((), (), ())
        return sum(counts), b"".join(ids), " ".join(texts).encode("utf-8", "surrogatepass")

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self.pieces(text or "")), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "label_of"):
            self.label_of = dict(zip(self.ids, self.automaton.text, strict=True)) | {k: t for t, k in self.special.items()}
        return " ".join(self.label_of[i] for i in ids)


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (UTF-8) for each row of docs (doc_id, text).

    Null texts count as empty: no ids, nothing decoded. Any length of text or word is encoded whole; ties cannot occur, as merges
    are ordered; repeated rows give a row each, null ids are kept; an empty table gives none; further columns are ignored.
    """
    at = path or vocabulary("word_bpe_49k.json")

    def rows(texts):
        return list(zip(*map(codec(at).both, texts), strict=True))

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id long, n_tokens long, ids binary, decoded binary", 256)


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
