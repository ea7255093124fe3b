"""Conversation repair (13) against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from kestrel.llm import turn_repair as T

NAMES = {"u": "user", "a": "assistant"}
NO_TEXT = re.compile("[^\x20\x09-\x0d]")


def sound(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = NO_TEXT.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows, kinds):
    """Least (cost, audit) with the repaired turns, by plain recursion over prefixes of initials."""
    n = len(rows)

    @functools.lru_cache(None)
    def go(i, last):
        """From turn i on, with the last initial ('' at the start)."""
        found = [(0, "", ())] if i == n and last in ("", "a") else []
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if i < n:
            role, text, kind = rows[i][2], rows[i][3], kinds[i]
            c, a, t = go(i + 1, last)
            found.append((c + 4, "D" + a, t))
            extra = 3 if kind == "truncated" else 0
            if kind not in ("blank", "duplicate"):
                for x in nexts:
                    c, a, t = go(i + 1, x)
                    if role[:1] == x:
                        found.append((c + extra, "K" + a, ((role, text),) + t))
                    if x in NAMES:
                        found.append((c + extra + 3, "R" + a, ((NAMES[x], text),) + t))
        return min(found + inserted(i, last))

    @functools.lru_cache(None)
    def bare(i, last):
        return go(i, last)

    def inserted(i, last, depth=0):
        """Insertions before turn i: at most two are ever useful."""
        out = []
        x = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        if depth < 2:
            for c, a, t in plain(i, x) + inserted(i, x, depth + 1):
                out.append((c + 3, "I" + a, ((NAMES[x], ""),) + t))
        return out

    def plain(i, last):
        """Ways without an insertion first."""
        found = [(0, "", ())] if i == n and last in ("", "a") else []
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if i < n:
            role, text, kind = rows[i][2], rows[i][3], kinds[i]
            c, a, t = go(i + 1, last)
            found.append((c + 4, "D" + a, t))
            extra = 3 if kind == "truncated" else 0
            if kind not in ("blank", "duplicate"):
                for x in nexts:
                    c, a, t = go(i + 1, x)
                    if role[:1] == x:
                        found.append((c + extra, "K" + a, ((role, text),) + t))
                    if x in NAMES:
                        found.append((c + extra + 3, "R" + a, ((NAMES[x], text),) + t))
        return found

    return go(0, "")


def brute(rows):
    """What the query returns, for rows (conv_id, turn, role, text)."""
    out = {}
    broken = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in broken if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        kinds = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, fixed = best(own, kinds)
        initials = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
                     kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
        assert sound("".join(r[:1] for r, _ in fixed))
    return out


def got(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def talk(seed, conv, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "User", "sys"]
    texts = ["Yes.", "No!", "Why? ", "cut", " \t\n", "", None, "a\nb.\x0b", "Long " * 30 + "end.", "é…"]
    return [(conv, r.choice([None, *range(n)]) if r.random() < 0.1 else k, r.choice(roles[:4] if r.random() < 0.8 else roles),
             f"{k} {r.choice(texts)}" if r.random() < 0.7 else r.choice(texts)) for k in range(n)]


KIND = "conv_id long, turn long, role string, text string, chunk int, place long, fault int, edits string, damage int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 0) for r in rows], KIND)


def test_walk_equals_all_edits():
    r = random.Random(4)
    for _ in range(1500):
        n = r.randint(0, 7)
        rows = [(0, k, r.choice(["user", "assistant", "system", "tool", ""]), str(k)) for k in range(n)]
        kinds = [r.choice(["", "", "blank", "duplicate", "truncated"]) for _ in rows]
        cost, audit, fixed = best(rows, kinds)
        codes = [T.code(x[2][:1], ["", "blank", "duplicate", "truncated"].index(k)) for x, k in zip(rows, kinds)]
        v = list(T.END)
        for c in reversed(codes):
            v = T.before(c, v)
        assert v[T.START] == cost
        assert "".join(e for e, _, _ in T.walk(codes, list(T.END), T.START, True)) == audit
        cut = r.randint(0, n)                       # two segments give the same
        ahead = T.behind(T.transfer(codes[cut:]), list(T.END))
        assert T.behind(T.transfer(codes[:cut]), ahead) == v
        first = list(T.walk(codes[:cut], ahead, T.START, False))
        state = T.exits(codes[:cut], ahead)[T.START]
        assert "".join(e for e, _, _ in [*first, *T.walk(codes[cut:], list(T.END), state, True)]) == audit


@pytest.mark.parametrize("segment", [T.SEGMENT, 4])
def test_query_equals_brute_force(spark, segment, monkeypatch):
    monkeypatch.setattr(T, "BODY_BYTES", 64)
    rows = [x for c in range(25) for x in talk(c, c, c % 12 + 1)] + talk(77, 100, 90) + talk(78, None, 13)
    rows += [(200, 5, "user", "same."), (200, 5, "user", "same."), (200, None, "assistant", "x"), (200, 2**40, "assistant", "x" * 300_000)]
    rows += [(k, 0, "user", "gone.") for k in range(1000, 1060)]      # some of them lose every turn
    assert got(T.summary(frame(spark, rows).repartition(3), segment=segment)) == brute(rows)


def test_empty_table(spark):
    assert T.summary(frame(spark, [])).collect() == []


def test_all_given_conversations(spark):
    src = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in src.select("conv_id", "turn", "role", "text").collect()]
    from __spark_entry__ import queries
    assert got(queries()["op13_conversation_repair"](spark, "/root/testdata/sf0.01")) == brute(rows)
