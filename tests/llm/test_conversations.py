import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from helpers import SF_SMALL
from oracle_check import compare, duck

from tablelens.llm import conversations as cv
from tablelens.llm import queries

SOUND = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edits of all rows, the least (cost, audit) for each sentence so far that
    a sound one may begin with: states by the pattern, audits as whole strings."""
    begins = lambda s: any(SOUND.fullmatch(s + e) for e in ("", "a", "ua"))
    best = {"": (0, "", ())}

    def put(into, s, cand):
        key = ("s" if s.startswith("s") else "") + ("ua" if len(s.removeprefix("s")) >= 2 else "") + ("u" if s.endswith("u") else "")
        if key not in into or cand[:2] < into[key][:2]:
            into[key] = cand

    def inserts(state):
        out = dict(state)
        for _ in range(3):
            for s, (c, a, lines) in list(out.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if begins(s + x):
                        put(out, s + x, (c + 3, a + "I", (*lines, f"{role}:")))
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, a, lines) in inserts(best).items():
            put(new, s, (c + 4, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] and begins(s + role[:1]):
                put(new, s + role[:1], (c + more, a + "K", (*lines, f"{role}:{text}")))
            for x, other in (("u", "user"), ("a", "assistant")):
                if begins(s + x):
                    put(new, s + x, (c + 3 + more, a + "R", (*lines, f"{other}:{text}")))
        best = new
    cost, audit, lines = min(v for s, v in inserts(best).items() if SOUND.fullmatch(s))
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(held)
        turns = [r[1] for r in held if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *cheapest(held, faults))
    return out


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_is_its_sql(spark):
    key = "op12_conversation_repair"
    assert compare(spark, duck(SF_SMALL), key, queries.QUERIES[key], queries.ORACLES[key], SF_SMALL)["ok"]


def test_random_conversations_by_brute_force(spark):
    import random

    rng, rows = random.Random(5), []
    for conv in range(300):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", " \t", "", None, f"{conv} {turn}.", f"{conv} {turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    assert got(cv.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_cheapest_edits_over_all_sentences(spark):
    """Every sequence of up to five rows of three roles and two faults, without damage."""
    signs = [("user", "Go."), ("assistant", "Go!"), ("system", "Go?"), ("user", "cut"), ("assistant", "")]
    rows, want = [], {}
    for conv, seq in enumerate(itertools.chain(*[itertools.product(signs, repeat=n) for n in range(1, 5)])):
        held = [(conv, t, r, x) for t, (r, x) in enumerate(seq)]
        rows += held
        want[conv] = cheapest(held, faults_of(held))
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string").selectExpr("*", "true AS there")
    found = {r.conv: (r.cost, r.audit, r.digest) for r in cv.repair(frame).collect()}
    assert found == want


def test_repaired_rows_have_the_digest(spark):
    damaged_ = cv.damage(spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))
    report = cv.repair(damaged_)
    lines, roles = defaultdict(list), defaultdict(str)
    for r in cv.repaired(damaged_, report).orderBy("conv", "place").collect():
        lines[r.conv].append(f"{r.role}:{r.text}")
        roles[r.conv] += r.role[0]
    for r in report.collect():
        assert hashlib.sha256("\n".join(lines[r.conv]).encode()).hexdigest() == r.digest
        assert SOUND.fullmatch(roles[r.conv])


def test_edges(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hello."), (1, 0, "user", "A. " * 20000), (1, 1, "assistant", "B.\x00\U0001f389!"),
        (2, 5, "user", "Tie."), (2, 5, "assistant", "Tie."), (2, 5, "user", "Tie."), (3, None, "", "No role."), (4, -3, "üser", "Hm."),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS there", "3 AS fault", "4 AS `__x`")
    assert got(cv.damaged_and_repaired(frame)) == brute(rows)
    assert cv.damaged_and_repaired(frame.limit(0)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "Gone.")], SCHEMA)
    assert got(cv.damaged_and_repaired(gone)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    text_keys = frame.selectExpr("CAST(conv_id AS STRING) AS `c.id`", "turn AS `t.n`", "role", "text")
    assert cv.damaged_and_repaired(text_keys, "c.id", "t.n").columns[0] == "c.id"
    assert {k if k is None else int(k): v for k, v in got(cv.damaged_and_repaired(text_keys, "c.id", "t.n")).items()} == brute(rows)


def test_a_long_conversation_is_a_stream(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"Row {t}.") for t in range(3000)]
    assert got(cv.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_equal_tops_are_equal_stacks():
    """What the merging relies on: one way only to lie under a state."""
    seen, todo = {(0,)}, [(0,)]
    while todo:
        stack = todo.pop()
        for x in "sua":
            new = cv.shift(stack, x)
            if new and new not in seen:
                seen.add(new)
                todo.append(new)
    assert len({s[-1] for s in seen}) == len(seen) == 6 and max(map(len, seen)) <= 4


@pytest.mark.parametrize("n", range(8))
def test_tables_accept_the_grammar(n):
    for roles in map("".join, itertools.product("sua", repeat=n)):
        stack = (0,)
        for x in roles:
            stack = stack and cv.shift(stack, x)
        assert bool(stack and cv.shift(stack, cv.END)) == bool(SOUND.fullmatch(roles))
