"""Cheapest repair of damaged conversations, streamed in the order of their turns.

Rows are dealt out by conversation and sorted by (conversation, turn, role, text); each task reads its sorted rows batch by batch and carries
the state of the conversation it is in over batch borders: counts, the last row, and for each of the four states of ``(s?(ua)+)?`` the cost
of the cheapest repair so far, its rank among the others' edit strings, and the running hash of its repaired text. No conversation is ever
held: a row leaves behind the number of its transition, four bytes, and these backpointers go to a file of the task once there are
``HELD_STEPS`` of them (as Spark's own spills: written and read by one task, made again with it if its executor is lost). Digests of earlier
rows, which duplicates are looked up in, are kept in sorted runs of the same kind.

Ties: edits are compared as strings. At one row all strings hold the same number of K, R and D and end with one, so none of two
states' strings begins the other, and their order never changes by what is appended. Costs relative to the cheapest state, ranks and kind of
row repeat, so each transition is worked out once per task and looked up after that.

Edge cases: null ``conv_id`` is a conversation of its own; null turns come first and do not count in gaps; rows of one turn are taken by
role, then text (both as damaged), repeats next to each other; null roles and texts are one space (a null key is one space within the hashed
``conv_id:turn``); an empty role has no initial, so its pairs are illegal; a conversation without rows left has zeros and an empty audit.
A conversation is one task's stream by its nature (its hash runs over the whole text), so time, not memory, grows with the longest.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import prepared

#: Fixed values of the repair.
KEEP, REROLE, DELETE, INSERT, MENDED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after the system row, after a user row, after an assistant row. What may come next, and where it leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only role that can be given or inserted in each state.
GIVEN = ("u", "u", "a", "u")
ENDS = (0, 3)
#: What state t can do, state o can do for ``BRIDGE[t][o]`` more at most (inserts, or the deletion of a system row): beyond that t is dropped,
#: which no cheapest repair needs and which keeps the costs apart by 7 at most.
BRIDGE = ((0, 6, 7, 4), (0, 0, 3, 0), (3, 3, 0, 3), (6, 6, 3, 0))
SPACES = " \t\n\v\f\r"
#: Backpointers (and digests) held in memory before they are spilled.
HELD_STEPS = 1 << 18
#: Damage, by crc32 of ``conv_id:turn`` modulo ``KINDS``.
KINDS, DROP, EMPTY, UNSTOP, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage, with ``gone`` set on dropped rows (they keep their conversation known)."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = (F.crc32(name) % KINDS).cast("int")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = df.select("conv_id", "turn", F.when(kind == AS_USER, "user").otherwise(role).alias("role"),
                     F.when(kind.isin(DROP, EMPTY), "").when(kind == UNSTOP, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                     (kind == DROP).alias("gone"), F.when(kind == REPEAT, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def fault(text: str, repeated: bool) -> str:
    """``blank``, ``duplicate``, ``truncated`` or nothing."""
    said = text.rstrip(SPACES)
    return "blank" if not said else "duplicate" if repeated else "" if said[-1] in ".!?" else "truncated"


def _edits(initial: str, flaw: str) -> list[tuple[int, str, int, int, str]]:
    """(from state, letters, to state, cost, role given to the row or '') of every way to reach and handle a row."""
    out = []
    for start in range(4):
        state, cost = start, 0
        for inserts in range(3 if start < 2 else 2):  # a third one would only go in circles
            letters = "I" * inserts
            out.append((start, letters + "D", state, cost + DELETE, ""))
            if flaw not in ("blank", "duplicate"):
                more = cost + (MENDED if flaw else 0)
                if initial in NEXT[state]:
                    out.append((start, letters + "K", NEXT[state][initial], more + KEEP, ""))
                given = GIVEN[state]
                out.append((start, letters + "R", NEXT[state][given], more + REROLE, given))
            state, cost = NEXT[state][GIVEN[state]], cost + INSERT
    return out


class Spill:
    """Numbers of one kind in order, all but the last ``HELD_STEPS`` in a file of the task."""

    def __init__(self, code: str):
        self.held, self.file = array(code), None

    def append(self, value: int) -> None:
        self.held.append(value)
        if len(self.held) >= HELD_STEPS:
            self.file = self.file or tempfile.TemporaryFile()
            self.held.tofile(self.file)
            del self.held[:]

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        if self.file:
            self.file.flush()
            block = HELD_STEPS * self.held.itemsize
            for at in range(self.file.tell() - block, -1, -block):
                self.file.seek(at)
                part = array(self.held.typecode)
                part.fromfile(self.file, HELD_STEPS)
                yield from reversed(part)


class Seen:
    """Digests met before; beyond ``HELD_STEPS`` they lie in sorted runs that are mapped, not loaded."""

    def __init__(self) -> None:
        self.fresh: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def meet(self, digest: bytes) -> bool:
        if digest in self.fresh:
            return True
        # the last byte is never zero: numpy drops trailing zeros when it compares
        for run in self.runs:
            at = int(np.searchsorted(run, np.bytes_(digest)))
            if at < len(run) and run[at] == digest:
                return True
        self.fresh.add(digest)
        if len(self.fresh) >= HELD_STEPS:
            with tempfile.TemporaryFile() as file:
                np.sort(np.array(list(self.fresh), "S17")).tofile(file)
                file.flush()
                self.runs.append(np.memmap(file, "S17", "r"))  # the map outlives the closed handle
            self.fresh = set()
        return False


class Steps:
    """The transitions met so far; each is worked out once."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.edits: dict[tuple[str, str], list] = {}

    def number(self, costs: tuple, ranks: tuple, initial: str, flaw: str) -> int:
        key = (costs, ranks, initial, flaw)
        if key not in self.numbers:
            self.numbers[key] = len(self.known)
            self.known.append(self._step(costs, ranks, initial, flaw))
        return self.numbers[key]

    def _step(self, costs: tuple, ranks: tuple, initial: str, flaw: str) -> tuple:
        """(raise of the lowest cost, new relative costs, new ranks, per new state (old state, letters, given role) or None)."""
        if (initial, flaw) not in self.edits:
            self.edits[initial, flaw] = _edits(initial, flaw)
        best: list[tuple | None] = [None] * 4
        for start, letters, end, cost, given in self.edits[initial, flaw]:
            if costs[start] is not None:
                found = (costs[start] + cost, ranks[start], letters, start, given)
                if best[end] is None or found[:3] < best[end][:3]:
                    best[end] = found
        for state in range(4):
            if best[state] and any(best[o] and best[o][0] + more < best[state][0] for o, more in enumerate(BRIDGE[state]) if o != state):
                best[state] = None
        low = min(b[0] for b in best if b)
        order = sorted((s for s in range(4) if best[s]), key=lambda s: best[s][1:3])
        new_ranks = tuple(order.index(s) if best[s] else -1 for s in range(4))
        return low, tuple(b[0] - low if b else None for b in best), new_ranks, tuple((b[3], b[2], b[4]) if b else None for b in best)


START = ((0, None, None, None), (0, -1, -1, -1))


class Conversation:
    """The running state of one conversation."""

    def __init__(self, conv_id, steps: Steps):
        self.conv_id, self.steps = conv_id, steps
        self.low, (self.costs, self.ranks) = 0, START
        self.hashes = [hashlib.sha256(), None, None, None]
        self.path, self.seen = Spill("I"), Seen()
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.initial: str | None = None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        raw_role, raw = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        digest = hashlib.blake2b(len(raw_role).to_bytes(8, "little") + raw_role + raw, digest_size=16).digest() + b"\1"
        flaw = fault(text, self.seen.meet(digest))
        if flaw:
            self.faults[flaw] += 1
        number = self.steps.number(self.costs, self.ranks, initial if initial in ("s", "u", "a") else "-", flaw)
        self.path.append(number)
        raised, self.costs, self.ranks, back = self.steps.known[number]
        self.low += raised
        old, lines = self.hashes, {}
        self.hashes = [None] * 4
        for state in range(4):
            if back[state]:
                start, letters, given = back[state]
                if letters == "D":
                    self.hashes[state] = old[start].copy()
                    continue
                line = lines.get(given)
                if line is None:
                    line = lines[given] = (ROLES[given].encode() if given else raw_role) + b":" + raw
                self.hashes[state] = _continued(old[start], start, letters, line)

    def result(self) -> tuple:
        finals = []
        for state in range(4):
            if self.costs[state] is not None:
                end, letters, cost = state, "", self.costs[state]
                while end not in ENDS:
                    end, letters, cost = NEXT[end][GIVEN[end]], letters + "I", cost + INSERT
                finals.append((cost, self.ranks[state], letters, state))
        cost, _, letters, state = min(finals)
        repaired = _continued(self.hashes[state], state, letters, None).hexdigest()
        back = [letters[::-1]]
        for number in self.path.backwards():
            state, letters, _ = self.steps.known[number][3][state]
            back.append(letters[::-1])
        gaps = 0 if self.first is None else int(self.last) - int(self.first) + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.low + cost, "".join(back)[::-1], repaired)


def _continued(hashed, state: int, letters: str, line: bytes | None):
    """The hash after the inserted rows of ``letters`` and, unless it is deleted, the row."""
    out = hashed.copy()
    for letter in letters:
        if letter == "I":
            given = GIVEN[state]
            out.update((b"\n" if state else b"") + ROLES[given].encode() + b":")
            state = NEXT[state][given]
        elif letter != "D":
            out.update((b"\n" if state else b"") + line)
    return out


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = ("conv_id string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


def repair(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Faults, cheapest repair and its digest per conversation of ``conv_id, turn, role, text`` (and ``gone``: no row, but a conversation)."""
    prepared(rows.sparkSession)
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    picked = rows.select(F.col("conv_id").cast("string"), F.col("turn").isNull().alias("no_turn"),
                         F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                         F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    dealt = picked.repartition(partitions, "conv_id") if partitions else picked.repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", F.desc("no_turn"), "turn", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, now, done = Steps(), None, []

        def told() -> pd.DataFrame:
            frame = pd.DataFrame(done, columns=RESULT)
            done.clear()
            return frame

        for frame in frames:
            for conv_id, no_turn, turn, role, text, gone in zip(*(frame[c].tolist() for c in frame.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id, steps)
                if not gone:
                    now.row(None if no_turn else turn, role, text)
            if done:
                yield told()
        if now is not None:
            done.append(now.result())
            yield told()

    return ordered.mapInPandas(run, SCHEMA).withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
