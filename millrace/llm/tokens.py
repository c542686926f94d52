"""Byte-level BPE vocabularies of the tokenizers library, encoded by the fastest engine that gives the same ids."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .bpe import byte_symbols, vocabulary

END = 1  # appended to each document


class ByteCodec:
    """A ``tokenizers`` file of byte-level BPE. Where ids grow with the merges, tiktoken's engine runs on the file's own vocabulary
    and gives the same ids; otherwise, and for texts that engine refuses, the tokenizers library encodes."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow = path, None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        self.engine = None
        if all(a < b for a, b in zip(made, made[1:], strict=False)):
            ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.pattern = PATTERN
        self.size = max([*vocab.values(), *self.special.values()]) + 1

    def library(self):
        if self.slow is None:
            import os

            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return self.slow

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.engine is not None:
            try:
                return self.engine.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # noqa: BLE001  its regex engine panics on extreme runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
        return np.array(self.library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def count_piece(self, piece: str) -> int:
        """Tokens of one pre-token (ordinary text)."""
        if self.engine is not None and len(piece) < 2000:
            return len(self.engine._core_bpe.encode_single_piece(piece.encode("utf-8", "surrogatepass")))
        return len(self.encode(piece))


@lru_cache(maxsize=2)
def byte_codec(path: str | None = None) -> ByteCodec:
    return ByteCodec(path or vocabulary("byte_bpe_50k.json"))
