import hashlib
import itertools
import random
import re
import zlib

import pytest

from lockstep.llm import entries, turns

GOOD = re.compile("(s?(ua)+)?")
VISIBLE = re.compile("[^\x20\x09-\x0d]")


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = VISIBLE.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Cheapest, then least edit string over every keep, rerole, delete and up to two inserts before each row and at the end."""
    best = {"": (0, "", ())}  # by role initials given so far, folded to their state
    def fold(initials):
        return initials if initials in ("", "s") else initials[-1]
    def put(table, initials, cost, audit, lines):
        key = fold(initials)
        if key not in table or (cost, audit) < table[key][:2]:
            table[key] = (cost, audit, lines)
    def grown(table):
        # strings of one state may differ in inserts alone; keep all until the row is handled
        for key, (cost, audit, lines) in table.items():
            for inserted in itertools.chain([()], itertools.product("ua", repeat=1), itertools.product("ua", repeat=2)):
                text = key
                ok = True
                for i in inserted:
                    ok = ok and (text in ("", "s", "a") if i == "u" else text == "u")
                    text = i
                if ok:
                    yield text, cost + 3 * len(inserted), audit + "I" * len(inserted), lines + tuple({"u": "user:", "a": "assistant:"}[i] for i in inserted)
    for (_, _, role, text), flaw in zip(rows, faults, strict=True):
        after = {}
        for key, cost, audit, lines in grown(best):
            put(after, key, cost + 4, audit + "D", lines)
            if flaw in ("", "truncated"):
                more = 3 if flaw else 0
                for new, letter, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    i = new[:1]
                    if (i == "s" and key == "") or (i == "u" and key in ("", "s", "a")) or (i == "a" and key == "u"):
                        put(after, i, cost + more + price, audit + letter, lines + (f"{new}:{text}",))
        best = after
    ends = [(cost, audit, lines) for key, cost, audit, lines in grown(best) if key in ("", "a")]
    return min(ends)


def plain(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        kept = plain_damage(r for r in rows if r[0] == conv_id)
        kept.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = plain_faults(kept)
        known = [r[1] for r in kept if r[1] is not None]
        cost, audit, lines = plain_repair(kept, faults)
        assert GOOD.fullmatch("".join(x[:1] for x in lines))
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(kept, kept[1:], strict=False)]
        out[conv_id] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(rng, n):
    rows = []
    for c in range(n):
        for _ in range(rng.choice([1, 2, 4, 8, 20])):
            rows.append((rng.choice([c, c, None]) if c < 3 else c, rng.choice([None, *range(12)]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]),
                         rng.choice(["Hi.", "Why?", "so", "", None, " \n", "ok!  ", "x\x1c", "deux ", "é."])))
    return rows


def found(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_repair_equals_the_plain_search(spark, tmp_path):
    rows = conversations(random.Random(1), 300)
    frame = spark.createDataFrame([(*r, 1, "g") for r in rows], "conv_id long, turn long, role string, text string, times int, gone string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = entries.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == turns.RESULT and dict(got.dtypes)["conv_id"] == "bigint"
    got = got.collect()
    want = plain(rows)
    assert len(got) == len(want)
    for conv_id, row in found(got).items():
        assert row == want[conv_id], conv_id


def test_giant_conversations_spill(spark, monkeypatch):
    monkeypatch.setattr(turns, "HELD_STEPS", 16)
    rng = random.Random(6)
    rows = [(big, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{rng.randrange(200)}.", f"{t}!"]))
            for big in ("a", "b") for t in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert found(turns.repair(turns.damaged(frame), 2).collect()) == plain(rows)


def test_transitions_stay_few():
    steps, rng = turns.Steps(), random.Random(2)
    talk = turns.Conversation(1, steps)
    for t in range(30_000):
        talk.row(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{t}."]))
    assert len(steps.known) < 2000


@pytest.mark.parametrize("ids", [(0, 500)])
def test_conversations_without_rows_left(spark, ids):
    gone = [(c, 0, "user", "Hi.") for c in range(*ids) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = turns.repair(turns.damaged(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == len(gone) > 0 and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_conversations(spark):
    assert turns.repair(turns.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
