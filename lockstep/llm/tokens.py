"""Byte-pair ids of whole texts, each distinct space-led chunk tokenized once per task.

The splitting pattern never joins a character to a space after it, so a text may be cut before every space; only a space between two
white-space characters is bound to both sides, and texts with one are tokenized whole. Chunks in basic Latin letters go through the rank
file (the same vocabulary), all others through the tokenizer file itself.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

#: Chunks kept in a task's table (about 200 bytes each).
TABLE_CHUNKS = 300_000
KEPT_LENGTH = 64
#: Letters below this code point are classed alike by both libraries' character tables.
PLAIN_BELOW = "ɐ"

_BOUND_SPACE = re.compile(r"\s \s")


class PairTable:
    """Packed little-endian ids of texts under one byte-level vocabulary."""

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str, special: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.known: dict[str, bytes] = {}

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for c in chunks:
            if not c or max(c) < PLAIN_BELOW:
                out[c] = array("I", self.plain.encode_ordinary(c)).tobytes()
            else:
                rest.append(c)
        for c, coded in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            out[c] = array("I", coded.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > TABLE_CHUNKS:
            self.known = {}
        known = self.known
        rows = [None if self.special in t or _BOUND_SPACE.search(t) else t.replace(" ", "\0 ").split("\0") if "\0" not in t else None
                for t in texts]
        fresh = self._fresh(list({c for row in rows if row for c in row if c not in known}))
        known.update((c, ids) for c, ids in fresh.items() if len(c) <= KEPT_LENGTH)
        out = []
        for text, row in zip(texts, rows, strict=True):
            if row is None:
                out.append(array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join([known[c] if c in known else fresh[c] for c in row]))
        return out
