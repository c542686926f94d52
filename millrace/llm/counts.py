"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

The pre-token pattern looks at most two characters ahead and never back, so a match that starts at a boundary depends only on what follows.
After an edit the pieces that end two characters before it are as they were; splitting goes on from there through the
edited region until a boundary falls on an old one behind it; all later pieces are as they were, too. Only the pieces between are
re-encoded. The tree's leaves are slots of pieces and carry sums of code points and of tokens; an edit spreads the new pieces over the
slots it touches and updates the sums on their paths to the root. Slots begin with ``SLOT`` pieces; where an edit would leave more than
``FULL`` in one, new slots are put in and the tree is built anew from the leaves' sums, without counting anything again.

Special-token strings inside a text are counted as ordinary text. Null texts count as empty; empty texts have no pieces, texts of any length
are counted whole; equal texts give equal values, repeated rows a row each, null ids are kept; an empty table gives none; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table
from .tokens import byte_codec

SLOT, FULL, MAX_CACHE = 16, 64, 300_000
#: How many code points behind its end a piece may depend on: blanks give back their last one, a contraction has two letters.
SIGHT = 2


class Counter:
    """Splits text into pre-tokens and counts the tokens of each; counts of short pieces are kept up to a fixed number."""

    def __init__(self, path: str | None = None):
        import regex

        self.codec = byte_codec(path)
        self.pattern = regex.compile(self.codec.pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0  # pieces encoded or looked up so far

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.codec.count_piece(piece)
            if len(self.known) >= MAX_CACHE:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return list(map(self.count, pieces))


class CountedText:
    """A text with its token count, kept right under edits."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.split(text)
        tokens, chars = np.array(counter.counts(pieces), dtype=np.int64), np.array(list(map(len, pieces)), dtype=np.int64)
        starts = np.arange(0, max(1, len(pieces)), SLOT)
        self.slots = [pieces[k : k + SLOT] for k in starts.tolist()]
        self._widen()
        self.chars, self.tokens = (self._tree(np.add.reduceat(x, starts) if len(x) else np.zeros(1, dtype=np.int64)) for x in (chars, tokens))

    def _widen(self) -> None:
        self.width = 1 << max(0, (len(self.slots) - 1).bit_length())

    def _tree(self, leaves: np.ndarray) -> np.ndarray:
        tree = np.zeros(2 * self.width, dtype=np.int64)
        tree[self.width : self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2
        return tree

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join("".join(s) for s in self.slots)

    def _slot_at(self, at: int) -> tuple[int, int]:
        """The slot that holds code point ``at`` (the last with text, if none does), and where that slot starts."""
        at, node, start = max(0, min(at, self.n_chars - 1)), 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def _set(self, slot: int, pieces: list[str]) -> None:
        self.slots[slot] = pieces
        node = slot + self.width
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(map(self.counter.count, pieces))
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces code points start to end; returns the number of pieces that were encoded again."""
        total = self.n_chars
        start = max(0, min(start, total))
        end = max(start, min(end, total))
        first, at = self._slot_at(start - SIGHT - 1)
        pieces = self.slots[first]
        kept, k = at, 0
        while k < len(pieces) and kept + len(pieces[k]) + SIGHT <= start:
            kept += len(pieces[k])
            k += 1
        head, old, slot = pieces[:k], pieces[k:], first
        begin, behind, ends = kept, kept, []

        def more() -> bool:
            nonlocal slot, old
            slot += 1
            if slot >= len(self.slots):
                return False
            old += self.slots[slot]
            return True

        # widen the window until splitting meets an old boundary behind the edit
        while True:
            ends, behind = [], begin
            for p in old:
                behind += len(p)
                ends.append(behind)
            last = slot + 1 >= len(self.slots)
            if not last and behind < end + SIGHT:
                more()
                continue
            source = "".join(old)
            window = source[: start - begin] + new + source[end - begin :]
            shift = len(new) - (end - start)
            boundaries = {e + shift: i + 1 for i, e in enumerate(ends) if e >= end}
            fresh, place, met = [], begin, None
            for m in self.counter.pattern.finditer(window):
                place = begin + m.end()
                if m.end() + SIGHT > len(window) and not last:
                    break  # its end may depend on what follows
                fresh.append(m[0])
                if place in boundaries and place >= start + len(new):
                    met = boundaries[place]
                    break
            if met is not None or last:
                tail = old[met:] if met is not None else []
                break
            more()
        self.counter.encoded += len(fresh)
        pieces, stop = head + fresh + tail, min(slot + 1, len(self.slots))
        share = -(-len(pieces) // (stop - first))
        if share > FULL:
            own = [pieces[k : k + SLOT] for k in range(0, len(pieces), SLOT)]
            leaves = [x[self.width : self.width + len(self.slots)] for x in (self.chars, self.tokens)]
            self.slots[first:stop] = own
            self._widen()
            sums = ([sum(map(len, p)) for p in own], [sum(map(self.counter.count, p)) for p in own])
            self.chars, self.tokens = (self._tree(np.concatenate([x[:first], np.array(n, dtype=np.int64), x[stop:]])) for x, n in zip(leaves, sums, strict=True))
        else:
            for k, s in enumerate(range(first, stop)):
                self._set(s, pieces[k * share : (k + 1) * share])
        return len(fresh)


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """A replacement, a deletion and an insertion at places that the text alone decides; offsets hold for the text as edited so far."""
    seed, n = zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text)
    a, b, c = (seed * k % 2**32 * n >> 32 for k in (2654435761, 2246822519, 3266489917))
    return [(a, a + 8, " revised 2nd draft,"), (b, b + 24, ""), (c, c, " [sic] ")]


@lru_cache(maxsize=2)
def counter(path: str | None) -> Counter:
    return Counter(path)


COUNTED = "doc_id long, n_tokens long, n_edits int, n_tokens_edited long, n_reencoded long, edited_sha256 string"


def edited_counts(docs: DataFrame, edits=sample_edits, path: str | None = None) -> DataFrame:
    """Counts each whole text, applies ``edits(text)`` to its tree and returns the counts before and after, the number of pieces that
    were encoded again, and a digest of the edited text. No shuffle."""

    def one(text):
        text = text or ""
        doc = CountedText(text, counter(path))
        before, again, todo = doc.n_tokens, 0, edits(text)
        for e in todo:
            again += doc.edit(*e)
        return before, len(todo), doc.n_tokens, again, hashlib.sha256(doc.text().encode("utf-8", "surrogatepass")).hexdigest()

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), lambda texts: list(zip(*map(one, texts), strict=True)), COUNTED)


def query(spark, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"))
