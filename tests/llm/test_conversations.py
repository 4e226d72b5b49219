"""Repair of conversations against a plain dynamic programme, by chunks of any size, and its degenerate inputs."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lanewise.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        role, text = some(role), some(text)
        h = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def repaired(all_rows, rows):
    """The contract, by keeping the best prefix for each state."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    out = []
    for conv in {r[0] for r in all_rows}:
        own = sorted(convs.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, blank, again, cut, bad = set(), 0, 0, 0, 0
        best = filled({0: (0, "", ())})
        for k, (_, role, text) in enumerate(own):
            end = text.rstrip(SPACE)
            gone = not end or (role, text) in seen
            blank, again = blank + (not end), again + bool(end and (role, text) in seen)
            seen.add((role, text))
            late = int(not gone and end[-1] not in ".!?")
            cut += late
            bad += k > 0 and own[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            ways = defaultdict(list)
            for state, (cost, letters, said) in best.items():
                ways[state].append((cost + 3, letters + "D", said))
                if not gone:
                    if role[:1] and (state, role[0]) in ((0, "s"), (0, "u"), (1, "u"), (3, "u"), (2, "a")):
                        ways["sua".index(role[0]) + 1].append((cost + late, letters + "K", (*said, f"{role}:{text}")))
                    ways[3 if state == 2 else 2].append((cost + 2 + late, letters + "R", (*said, f"{'assistant' if state == 2 else 'user'}:{text}")))
            best = filled({s: min(w) for s, w in ways.items()})
        turns = [r[0] for r in own if r[0] is not None]
        cost, letters, said = min(best[s] for s in (0, 3) if s in best)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, again, cut, bad, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def filled(best):
    out = dict(best)
    for _ in range(3):
        for state, (cost, letters, said) in list(out.items()):
            to, line = (3, "assistant:") if state == 2 else (2, "user:")
            new = (cost + 2, letters + "I", (*said, line))
            out[to] = min(out.get(to, new), new)
    return out


def talks(rng, n=60):
    rows = []
    for conv in range(n):
        size, roles = rng.choice([1, 2, 3, 5, 9, 30]), rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "user", "assistant", "tool", "", "Assistant", None], ["user"], ["assistant"]])
        for k in range(size):
            text = rng.choice(["Hi.", "Yes!", "no", "Well, ", " \n", "", None, f"text {k}.", f"text {k}", "Ça va ?\x0b", "x" * 50 + ".\t"])
            rows.append((conv if conv else None, rng.choice([k, k, k + 3, None]) if conv % 3 else k, roles[k % len(roles)] if conv % 2 else rng.choice(roles), text))
    return rows + rows[:7] + [(1000, 5, "user", "twice.")] * 5


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("seed, chunk, passes", [(1, 4096, 4), (2, 4, 4), (3, 2, 0)])
def test_repair(spark, seed, chunk, passes):
    rows = talks(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"code": F.lit("x"), "n": F.lit(9), "seq": F.lit(1), "_conv": F.lit("y")})
    same(C.repair_digest(df, C.damaged(df), chunk=chunk, passes=passes).collect(), repaired(rows, harmed(rows)))


@pytest.mark.parametrize("passes", [0, 1])
def test_long_conversations(spark, passes):
    """Runs of one role keep their parity and never converge; repeated texts only go; rows deal out over all tasks."""
    rng = random.Random(4)
    rows = [(1, k, "user", f"u{k}.") for k in range(301)] + [(2, k, "user", "again.") for k in range(200)] + [(3, k, ["user", "assistant"][k % 2], f"t{k}.") for k in range(300)]
    rows += [(4, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", ""])) for k in range(300)] + [(5, None, "assistant", f"a{k}") for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same(C.repair_digest(df, df, chunk=4, passes=passes).collect(), repaired(rows, rows))


def test_messages_are_whole(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "tool", "cut")]
    found = C.Repair(spark.createDataFrame(rows, SCHEMA))
    said = [(r["role"], r["text"]) for r in found.messages().orderBy("seq", "place").collect()]
    assert said == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]
    assert found.summary().first()["audit"] == "KIKD"


def test_degenerate(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_digest(none, none).count() == 0
    rows = [(None, None, None, None), (7, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    same(C.repair_digest(df, df.filter("conv_id = 7")).collect(), [(None, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()), (7, 0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())])


def test_viterbi_is_least_by_enumeration():
    """Costs and letters against all edits of short rows."""
    viterbi = C.Viterbi()
    for codes in itertools.product([0, 1, 2, 3, 5, 9], repeat=3):
        vectors = []
        out, total = viterbi.back(list(codes), [1] * 3, C.FINAL, vectors)
        letters, state = viterbi.trace(list(codes), [1] * 3, vectors, 0)
        word = "".join(letters) + {1: "II", 2: "I"}.get(state, "")
        ways = {(0, 0, "")}
        for code in codes:
            ways = {w for s, c, t in ways for w in spread(s, c, t)}
            ways = {w for s, c, t in ways for w in moves(s, c, t, code)}
        ways = {w for s, c, t in ways for w in spread(s, c, t)}
        assert (out[0] + total, word) == min((c, t) for s, c, t in ways if s in (0, 3))


def spread(state, cost, letters):
    for _ in range(3):
        yield state, cost, letters
        state, cost, letters = C._AFTER[state], cost + 2, letters + "I"


def moves(state, cost, letters, code):
    yield state, cost + 3, letters + "D"
    if not code & 8:
        late = code >> 2 & 1
        yield C._AFTER[state], cost + 2 + late, letters + "R"
        if (state, code & 3) in C._NEXT:
            yield C._NEXT[state, code & 3], cost + late, letters + "K"
