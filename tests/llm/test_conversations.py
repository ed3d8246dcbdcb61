"""Conversation repair against a dynamic program over (cost, audit) pairs, whole and cut into blocks."""

import hashlib
import random
import zlib

import pytest

from flowaudit.llm import conversations as C, queries


def cheapest(codes):
    """The least (cost, audit) by plain relaxation from the end of the conversation."""
    legal = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    n = len(codes)
    best = {(n, 0): (0, ""), (n, 3): (0, "")}
    for i in range(n, -1, -1):
        for _ in range(6):
            for s in range(4):
                options = [best[i, s]] if (i, s) in best else []

                def add(cost, letter, node):
                    if node in best:
                        options.append((cost + best[node][0], letter + best[node][1]))

                for r in "ua":
                    if r in legal[s]:
                        add(2, "I", (i, to[r]))
                if i < n:
                    c = codes[i]
                    add(3, "D", (i + 1, s))
                    if c != "x":
                        late = int(c.isupper())
                        if c.lower() in legal[s]:
                            add(late, "K", (i + 1, to[c.lower()]))
                        for r in "ua":
                            if r in legal[s]:
                                add(2 + late, "R", (i + 1, to[r]))
                if options:
                    best[i, s] = min(options)
    return best[0, 0]


@pytest.mark.parametrize("seed", range(5))
def test_auction(seed):
    rng = random.Random(seed)
    for _ in range(150):
        codes = "".join(rng.choice("suaxoSUAOuaua") for _ in range(rng.randrange(14)))
        assert C._whole(codes) == cheapest(codes), codes


def test_long_conversation():
    rng = random.Random(1)
    codes = "".join(rng.choice("suaxoSUAOuaua") for _ in range(1500))
    assert C._whole(codes) == cheapest(codes)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if k == 1:
            text = ""
        if k == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def expected(original, rows):
    blanks = "\x20\x09\x0a\x0b\x0c\x0d"
    out = []
    for conv in {r[0] for r in original}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        turns = {r[1] for r in mine if r[1] is not None}
        codes, seen, faults = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            body = text.rstrip(blanks)
            first = role[:1] if role[:1] in tuple("sua") else "o"
            if not body:
                codes, fault = codes + "x", "blank"
            elif (role, text) in seen:
                codes, fault = codes + "x", "duplicate"
            elif body[-1] not in ".!?":
                codes, fault = codes + first.upper(), "truncated"
            else:
                codes, fault = codes + first, None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = cheapest(codes)
        lines, at, before = [], 0, ""
        for e in audit:
            role, text = mine[at][2:] if e != "I" else ("", "")
            if e in "RI":
                role = "assistant" if before == "u" else "user"
            if e != "D":
                lines.append(f"{role}:{text if e != 'I' else ''}")
                before = role[:1]
            at += e != "I"
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed, conversations=60, longest=9):
    rng = random.Random(seed)
    texts = ["Hello there.", "Fine!", "What?", "cut off", "", " \t\n", "a. ", "Yes. \n", "no", None]
    out = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", ("system", "user", "assistant")[min(turn, 1) + turn % 2 * (turn > 0)], None, "tool", ""]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"Sentence {rng.randrange(99)}."
            out += [(conv, None if rng.random() < 0.05 else turn * rng.choice((1, 1, 1, 2)), role, text)] * (2 if rng.random() < 0.05 else 1)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query(spark, tmp_path):
    rows = sample(7, 150) + [(1000 + k, 0, "user", "x.") for k in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "place", "block", "codes", "cost", "edge"):  # names that the operator uses itself
        df = df.withColumn(name, df.role)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.dtypes == [("conv_id", "bigint"), *[(c, "bigint") for c in C.NUMBERS], ("audit", "string"), ("repaired_sha256", "string")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, damage(rows))
    assert any(r[7] == "" for r in expected(rows, damage(rows)))  # some conversations lose all their rows


@pytest.mark.parametrize("block", [1, 3, 7])
def test_split_conversations(spark, monkeypatch, block):
    """One conversation with most rows, spread over tasks and blocks, gives what it gives whole."""
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    rows = sample(3, 6) + [(77, *r[1:]) for r in sample(5, 1, 2)] + [(77, t, *r[2:]) for t, r in enumerate(sample(8, 25))]
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.repair(df)
    assert found.where("conv_id = 77").count() > 100 // block
    got = C.repair_digest(df, found).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, rows)


def test_empty_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_digest(empty, C.repair(C.damaged(empty))).count() == 0
    long = "word " * 200000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (2, None, None, None), (3, None, "user", "a."), (3, None, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows, [(c, t, r or " ", x or " ") for c, t, r, x in rows])
    assert sorted((tuple(r) for r in C.repair_digest(df, C.repair(df)).collect()), key=str) == want
