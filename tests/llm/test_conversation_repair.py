import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tracewright.llm.conversation_repair import damaged, repaired, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, cost string, `a.b` string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def hurt(rows):
    out = []
    for c, t, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(way, text)
        out += [(c, t, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def plain(rows):
    """Whole audits, in a table of the best for each state: inserts are steps of their own, of any number up to five."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        end = text.strip(SPACE)
        kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def inserted(best):
        out = list(best.items())
        for s, (cost, audit, lines) in best.items():
            for _ in range(5):
                role = NEXT[s]
                s, cost, audit, lines = role[0], cost + 2, audit + "I", (*lines, (role, ""))
                out.append((s, (cost, audit, lines)))
        return out

    for (_, _, role, text), kind in zip(rows, kinds):
        ways = []
        for s, (cost, audit, lines) in inserted(best):
            ways.append((s, (cost + 3, audit + "D", lines)))
            if kind in ("blank", "duplicate"):
                continue
            more = kind == "truncated"
            if role and s + role[0] in ("s", "u", "su", "ua", "au"):
                ways.append((role[0], (cost + more, audit + "K", (*lines, (role, text)))))
            ways.append((NEXT[s][0], (cost + more + 2, audit + "R", (*lines, (NEXT[s], text)))))
        best = {}
        for s, v in ways:
            best[s] = min(best.get(s, v), v)
    cost, audit, lines = min(v for s, v in inserted(best) if s in ("", "a"))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marks = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), lines


def rows_of(seed):
    rng = random.Random(seed)
    say = lambda: rng.choice(["Yes.", "No", "", " \n", "Why?\t", "Well.", "é…", "So! "]) if rng.random() < 0.6 else f"t{rng.random()}."
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
    rows = [(c, rng.choice([t, t, t, None, 2 * t]), role(), rng.choice([say(), say(), say(), None])) for c in range(150) for t in range(rng.randrange(9))]
    rows += [(None, t, "user", "Hi.") for t in range(5)]
    rows += [(900, 0, "user", "Same.")] * 3000 + [(901, t // 2, rng.choice(["user", "assistant"]), say()) for t in range(3000)] + [(902, 1, "user", "x" * 2_000_000), (902, 2, "assistant", "y.")]
    rng.shuffle(rows)
    return [(*r, "k", "l") for r in rows]


def test_whole_tables(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r[n] for n in names) for r in repaired(damaged(df), df.select("conv_id")).collect()}
    by, lines = {}, {}
    for r in hurt(rows):
        by.setdefault(r[0], []).append(r)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c in {r[0] for r in rows}:
        want, lines[c] = plain(by[c]) if c in by else (empty, ())
        assert got.pop(c) == want, c
    assert got == {}
    turns = {}
    for r in repaired_turns(damaged(df)).collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c: [x[1:] for x in sorted(t)] for c, t in turns.items()} == {c: list(x) for c, x in lines.items() if x}
    assert all([x[0] for x in sorted(t)] == list(range(len(t))) for t in turns.values())


def test_a_conversation_without_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repaired(damaged(none), none.select("conv_id")).collect() == []
    alone = repaired(none, spark.range(1).select(F.col("id").alias("conv_id"))).collect()
    assert [(r.conv_id, r.cost, r.audit) for r in alone] == [(0, 0, "")]


def test_ids_as_text(spark):
    rows = [("a", 0, "assistant", "Hm."), ("a", 1, "system", "Yes."), ("b", 0, "user", "Hm."), ("b", 3, "assistant", "Go"), (None, 0, "user", "?")]
    out = repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert {r.conv_id: (r.audit, r.cost, r.gaps) for r in out} == {"a": ("RR", 4, 0), "b": ("KK", 1, 2), None: ("KI", 2, 0)}
