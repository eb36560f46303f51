"""SentencePiece ids and text by a distinct-chunk table.

No piece of the vocabulary holds a space marker after another character, so merges never cross from a word into the next marker. A text
is therefore cut into marked words (a run of markers and what follows it), each distinct marked word is segmented once and the ids are
joined back by position. The table lives in the task that reads the rows: a global one would shuffle every word of the corpus. It is
emptied when it holds ``TABLE_WORDS`` words, which costs time only.

Edge cases: null is encoded as the empty text, which has the end id only; a literal marker character counts as a space, as in the
library; vocabularies with a piece that does cross are refused; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lockstep.llm.common import prepared, strings, with_fields

MARK = "▁"
#: Words kept in a task's table (about 300 bytes each).
TABLE_WORDS = 300_000
#: Longest word kept; longer ones are encoded each time.
KEPT_LENGTH = 64

_CHUNK = re.compile(" +[^ ]*")


class ChunkTable:
    """Ids of marked words under one model."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a space marker")
        self.lone = self.model.encode("a ")[len(self.model.encode("a")):]
        self.end = self.model.eos_id()
        self.surface = [b"" if self.model.is_control(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
                        else self.model.decode([i]).encode() if self.model.is_unknown(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.marked = {i for i, p in enumerate(pieces) if p.startswith(MARK)}
        self.known: dict[str, list[int]] = {" ": self.lone}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, the end id last."""
        if len(self.known) > TABLE_WORDS:
            self.known = {" ": self.lone}
        known = self.known
        # the marker that the library puts before a text is the first chunk's first space
        rows = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = list({c for row in rows for c in row if c not in known})
        fresh = dict(zip(new, self.model.encode([c[1:] for c in new], num_threads=1), strict=True)) if new else {}
        known.update((c, ids) for c, ids in fresh.items() if len(c) <= KEPT_LENGTH)
        out = []
        for row in rows:
            ids: list[int] = []
            for c in row:
                ids += known[c] if c in known else fresh[c]
            ids.append(self.end)
            out.append(ids)
        return out

    def decode(self, rows: list[list[int]]) -> list[str]:
        """Texts of ids: surfaces joined, the first marker dropped; byte pieces that form no character are left to the library."""
        out, surface = [], self.surface
        for ids in rows:
            try:
                joined = b"".join([surface[i] for i in ids]).decode()
                out.append(joined[1:] if ids and ids[0] in self.marked else joined)
            except UnicodeDecodeError:
                out.append(self.model.decode(ids))
        return out


def encode_decode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (array of int, end id last) and ``decoded`` (string) of every row's whole text."""
    prepared(df.sparkSession)
    picked = df.select(*keep, text)
    schema = with_fields(picked.select(*keep), "ids array<int>, decoded string")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model)
        for batch in batches:
            ids = chunks.encode(strings(batch.column(n)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(ids, pa.list_(pa.int32())), pa.array(chunks.decode(ids), pa.string())],
                names=[*keep, "ids", "decoded"])

    return picked.mapInArrow(run, schema)
