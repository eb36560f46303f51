"""Byte-pair ids of whole texts by tree concatenation, and back.

A long text is halved until its leaves have at most ``LEAF_CHARS`` characters; the leaves are encoded apart, as many at a time as there are,
and joined in pairs. Around each join a window of tokens of both sides is encoded anew, and doubled until both sides agree with it exactly at
a place where what lies beyond cannot depend on the window:

* before a space that follows a visible character, where the splitting pattern always breaks: the window's token before such a place in the
  left half, and the one after such a place in the right half, must be those that the halves have there; or
* inside a run that the splitting pattern leaves whole (no spaces: other scripts, long numbers, rows of signs): byte-pair ids are right when
  every two neighbours are, so the window's first and last tokens must be those of the halves.

A window that has reached the whole of a half agrees with that side. Texts of more than ``PART_CHARS`` characters are halved over several
tasks, each part a tree of its own, and only ids meet to be joined. The special token is cut out first, as the library does.

Edge cases: null is the empty text (no ids, empty text back); repeated rows give repeated rows; columns of any name may be kept; an empty
table gives an empty one. Ids come packed as little-endian unsigned 32-bit integers in ``packed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import batches_of, hidden, prepared, strings, text_or_empty, with_fields
from lockstep.llm.tokens import PairTable

#: Characters of a leaf, and of a part that one task encodes.
LEAF_CHARS, PART_CHARS = 4096, 1 << 20
#: Tokens of each side in the first window, and the fewest characters of each side within one run.
FIRST_WINDOW, RUN_CHARS = 8, 8
#: Characters after a window that can still decide where the splitting pattern breaks.
LOOK_AHEAD = 4
EMPTY = np.empty(0, np.uint32)


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible ones stand for themselves, the others for 256 and up, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def halves(text: str, most: int) -> list[str]:
    """The leaves of a text, in order."""
    if len(text) <= most:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], most) + halves(text[middle:], most)


class TreeCoder:
    """Ids of texts under one byte-level vocabulary file."""

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str, special: str):
        self.table = PairTable(tokenizer_file, rank_file, pattern, special)
        self.whole, self.special = self.table.whole, special
        self.special_id = self.whole.token_to_id(special)
        byte_of = _byte_of()
        self.surface = [b""] * self.whole.get_vocab_size(with_added_tokens=True)
        for token, i in self.whole.get_vocab(with_added_tokens=True).items():
            self.surface[i] = token.encode() if i == self.special_id else bytes(byte_of[c] for c in token)

    # --- joining -----------------------------------------------------------------------------------------------------------------------

    def _bytes(self, ids: np.ndarray) -> bytes:
        surface = self.surface
        return b"".join([surface[i] for i in ids.tolist()])

    def _ends(self, ids: np.ndarray) -> np.ndarray:
        surface = self.surface
        return np.cumsum([0, *[len(surface[i]) for i in ids.tolist()]])

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined text of two halves that were encoded apart."""
        if not len(left) or not len(right):
            return left if len(left) else right
        size = FIRST_WINDOW
        while True:
            found = self._window(left, right, size)
            if found is not None:
                return found
            size *= 2

    def _window(self, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray | None:
        a, b = left[-size:], right[:size]
        raw_a, raw_b = self._bytes(a), self._bytes(b)
        while raw_a[0] & 0xC0 == 0x80:  # a token may begin inside a character
            a = left[len(left) - len(a) - 1:]
            raw_a = self._bytes(a)
        all_a, all_b = len(a) == len(left), len(b) == len(right)
        ahead = b"" if all_b else self._bytes(right[len(b):len(b) + 4 * LOOK_AHEAD])
        inside = next((i for i, x in enumerate(ahead) if x & 0xC0 != 0x80), len(ahead))
        while not all_b and inside:
            b = right[:len(b) + 1]
            raw_b, all_b = self._bytes(b), len(b) == len(right)
            ahead = b"" if all_b else self._bytes(right[len(b):len(b) + 4 * LOOK_AHEAD])
            inside = next((i for i, x in enumerate(ahead) if x & 0xC0 != 0x80), len(ahead))
        text_a, text_b = raw_a.decode(), raw_b.decode()
        new = self._encoded(text_a + text_b)
        if all_a and all_b:
            return new
        at = self._ends(new)
        start = 0 if all_a else self._agreed_left(text_a, a, new, at)
        stop = int(at[-1]) if all_b else self._agreed_right(text_a, text_b, len(raw_a), b, new, at)
        if start is not None and stop is not None and start <= stop:
            i, j = np.searchsorted(at, [start, stop])
            head = left[:len(left) - len(a) + int(np.searchsorted(self._ends(a), start))] if not all_a else EMPTY
            tail = right[int(np.searchsorted(self._ends(b), stop - len(raw_a))):] if not all_b else EMPTY
            return np.concatenate([head, new[i:j], tail])
        if len(text_a) >= RUN_CHARS and len(text_b) >= RUN_CHARS and new[0] == a[0] and new[-1] == b[-1]:
            first = self.whole.pre_tokenizer.pre_tokenize_str(text_a + text_b + ahead.decode(errors="ignore")[:LOOK_AHEAD])[0]
            if first[1][1] >= len(text_a) + len(text_b):
                return np.concatenate([left[:len(left) - len(a)], new, right[len(b):]])
        return None

    def _agreed_left(self, text: str, a: np.ndarray, new: np.ndarray, at: np.ndarray) -> int | None:
        """Byte of the last break in the left half before which the window has the half's own token."""
        own = self._ends(a)
        for p in _breaks(text, reversed(range(1, len(text)))):
            place = len(text[:p].encode())
            i, j = int(np.searchsorted(at, place)), int(np.searchsorted(own, place))
            if at[i] == place and i and j and new[i - 1] == a[j - 1]:
                return place
        return None

    def _agreed_right(self, before: str, text: str, offset: int, b: np.ndarray, new: np.ndarray, at: np.ndarray) -> int | None:
        """Byte of the first break in the right half after which the window has the half's own token."""
        own = self._ends(b)
        # the last token of the window may be cut short, so it agrees with nothing
        for p in _breaks(before[-1] + text, range(1, len(text) + 1)):
            place = len(text[:p - 1].encode())
            i, j = int(np.searchsorted(at, offset + place)), int(np.searchsorted(own, place))
            if at[i] == offset + place and i < len(new) - 1 and j < len(b) - 1 and new[i] == b[j]:
                return offset + place
        return None

    def joined(self, nodes: list[np.ndarray]) -> np.ndarray:
        """Neighbours joined in pairs, level by level."""
        while len(nodes) > 1:
            nodes = [self.join(nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else EMPTY

    # --- texts -------------------------------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; the leaves of all of them are encoded together."""
        trees = [[halves(part, LEAF_CHARS) for part in text.split(self.special)] for text in texts]
        coded = iter(self.table.encode([leaf for tree in trees for part in tree for leaf in part]))
        return [self.with_specials([self.joined([np.frombuffer(next(coded), "<u4") for _ in part]) for part in tree]) for tree in trees]

    def with_specials(self, parts: list[np.ndarray]) -> np.ndarray:
        """Ids of the stretches between special tokens, joined by the special id."""
        if len(parts) == 1:
            return parts[0]
        mark = np.array([self.special_id], np.uint32)
        return np.concatenate([x for part in parts for x in (mark, part)][1:])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; what is not a character becomes the replacement sign, as in the library."""
        return self._bytes(ids).decode("utf-8", "replace")


def _breaks(text: str, places) -> Iterator[int]:
    """Those of ``places`` with a space that follows a visible character."""
    for p in places:
        if text[p] == " " and (text[p - 1].isalnum() or "!" <= text[p - 1] <= "~"):
            yield p


def encode_decode(df: DataFrame, tokenizer_file: str, rank_file: str, pattern: str, special: str, text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``packed`` (ids as little-endian unsigned 32-bit integers) and ``decoded`` of every row's whole text."""
    prepared(df.sparkSession)
    given = tuple(hidden("kept") for _ in keep)
    body = hidden("text")
    picked = df.select(*[F.col(k).alias(g) for k, g in zip(keep, given, strict=True)], text_or_empty(text).alias(body))
    kept = picked.select(*given)
    result = with_fields(kept, "packed binary, decoded string")
    n = len(keep)
    names = [*given, "packed", "decoded"]

    def coder() -> TreeCoder:
        return TreeCoder(tokenizer_file, rank_file, pattern, special)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder()
        for batch in batches:
            texts = strings(batch.column(n))
            for i, j in batches_of(texts):
                ids = tree.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns[:n], pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array([tree.decode(x) for x in ids], pa.string())], names=names)

    row, stretch, part, piece = (hidden(c) for c in ("row", "stretch", "part", "piece"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in enumerate(strings(batch.column(n + 1))):
                for s, between in enumerate(whole.split(special)):
                    for p, leaf in enumerate(halves(between, PART_CHARS)):
                        yield pa.RecordBatch.from_arrays(
                            [*batch.slice(i, 1).columns[:n + 1], pa.array([s], pa.int32()), pa.array([p], pa.int32()), pa.array([leaf], pa.string())],
                            names=[*given, row, stretch, part, piece])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder()
        for batch in batches:
            for i, leaf in enumerate(strings(batch.column(n + 3))):
                ids = pa.array([tree.encode([leaf])[0].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:n + 3], ids], names=[*given, row, stretch, part, piece])

    def met(rows: pa.Table) -> pa.Table:
        tree, found = coder(), {}
        for s, p, ids in zip(*(rows.column(c).to_pylist() for c in (stretch, part, piece)), strict=True):
            found.setdefault(s, {})[p] = np.frombuffer(ids, "<u4")
        ids = tree.with_specials([tree.joined([found[s][p] for p in sorted(found[s])]) for s in sorted(found)])
        return pa.Table.from_arrays([*rows.slice(0, 1).columns[:n], pa.array([ids.tobytes()], pa.binary()), pa.array([tree.decode(ids)], pa.string())],
                                    names=names)

    few = F.char_length(body) <= PART_CHARS
    in_one = picked.where(few).mapInArrow(short, result)
    # an id by place: the rows of a scan's split do not change when it is read again
    long = picked.where(~few).select(*given, F.monotonically_increasing_id().alias(row), body)
    keyed = with_fields(kept, f"{row} bigint, {stretch} int, {part} int, {piece} string")
    packed = with_fields(kept, f"{row} bigint, {stretch} int, {part} int, {piece} binary")
    in_parts = (long.mapInArrow(parts, keyed).repartition(row, stretch, part).mapInArrow(coded, packed)
                .groupBy(row).applyInArrow(met, result))
    return in_one.unionByName(in_parts).toDF(*keep, "packed", "decoded")
