"""Conversation repair: cheapest edits by an auction shortest-path search over an integer lattice, traced along tight arcs."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowaudit.llm import common

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows and text bytes of one block. A longer conversation is repaired block by block, by several tasks.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40

# States of the role pattern (s?(ua)+)?: nothing yet, after system, after user, after assistant.
KEEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
TURN = (2, 2, 3, 2)  # the state after the only user or assistant turn that is legal next
ROLES = ("", "system", "user", "assistant")
#: What may still follow the last row: the end itself, or inserted turns.
AT_END = (0, FAR, FAR, 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's test material: rows dropped, emptied, cut, repeated or given to the user, by crc32 of ``conv_id:turn``. Nulls are one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), k.alias("k")).where("k != 0")
    rows = rows.withColumn("text", F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("k") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


# ---------------------------------------------------------------- the lattice
def edits(codes: str, tail: bool):
    """Arcs (letter, cost, node) out of node 4 * row + state, letters in ASCII order.

    A code is x for a row that must go, else the class of its role's initial (s, u, a, o), upper case if its text is truncated.
    Turns may be inserted before every row, and after the last one if ``tail``.
    """
    n = len(codes)

    def out(node: int) -> list[tuple[str, int, int]]:
        row, state = divmod(node, 4)
        insert = ("I", INSERT, 4 * row + TURN[state])
        if row == n:
            return [insert] if tail else []
        code = codes[row]
        arcs = [("D", DELETE, node + 4), insert]
        if code != "x":
            low, extra = code.lower(), TRUNCATED * code.isupper()
            kept = KEEPS[low][state]
            if kept is not None:
                arcs.append(("K", extra, 4 * row + 4 + kept))
            arcs.append(("R", REROLE + extra, 4 * row + 4 + TURN[state]))
        return arcs

    return out


def auction(out, origins: Iterable[int], price: dict[int, int]) -> dict[int, int]:
    """Exact distances of ``origins`` to the nodes that ``price`` holds at first, by the auction algorithm.

    A path grows from its origin. Its last node's price rises to the best offer, arc cost plus the price at the arc's end, and the path
    contracts by that node; or, where the price already equals the offer, the path extends along the offering arc.
    Prices never exceed an arc's cost plus the price at its end, so once the path meets a node of exact price, all prices on it are
    exact. With origins given from the end of the lattice backwards, later paths are short. Cycles must cost more than 0.
    """
    exact = set(price)
    for origin in origins:
        if origin in exact:
            continue
        path = [origin]
        while True:
            node = path[-1]
            offer, to = min(((cost + price.get(end, 0), end) for _, cost, end in out(node)), key=lambda x: x[0])
            if price.get(node, 0) < offer:
                price[node] = offer
                if len(path) > 1:
                    path.pop()
            elif to in exact:
                break
            else:
                path.append(to)
        exact.update(path)
        for node in path:
            price.setdefault(node, 0)
    return price


def solve(codes: str, after: tuple[int, ...], tail: bool) -> dict[int, int]:
    """Prices of all nodes of a block whose end costs ``after`` by state; at the tail inserts may come before it."""
    n = len(codes)
    if not tail:
        return auction(edits(codes, False), range(4 * n - 1, -1, -1), {4 * n + s: p for s, p in enumerate(after)})
    # the end is one step behind the last row's states that the pattern accepts
    arcs, end = edits(codes, True), 4 * n + 4

    def out(node):
        return arcs(node) + ([("", after[node % 4], end)] if node >= 4 * n and after[node % 4] < FAR else [])

    return auction(out, range(4 * n + 3, -1, -1), {end: 0})


def trace(codes: str, price: dict[int, int], state: int, tail: bool) -> tuple[str, int]:
    """(audit, state behind the block): the ASCII-least letters along arcs whose cost is the difference of their prices."""
    out, node, n, audit = edits(codes, tail), state, len(codes), []
    while True:
        if node >= 4 * n and (not tail or price[node] == AT_END[node % 4]):
            return "".join(audit), node % 4
        letter, _, node = next(a for a in out(node) if price[node] == a[1] + price[a[2]])
        audit.append(letter)


@functools.lru_cache(1 << 16)
def _short(codes: str) -> tuple[int, str]:
    return _whole(codes)


def _whole(codes: str) -> tuple[int, str]:
    price = solve(codes, AT_END, True)
    return price[0], trace(codes, price, 0, True)[0]


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; short ones repeat, so they are remembered."""
    return _short(codes) if len(codes) <= 24 else _whole(codes)


def passage(codes: str) -> list[int]:
    """Costs from each state before a block to each state behind its last row, 16 numbers; ``FAR`` where there is no way."""
    n, out, table = len(codes), edits(codes, False), [FAR] * 16
    for goal in range(4):
        states = {0: (0,), 1: (0, 1)}.get(goal, (0, 1, 2, 3))  # states from which the goal can be reached at all

        def arcs(node, states=states):
            return [a for a in out(node) if a[2] % 4 in states]

        price = {4 * n + s: 0 if s == goal else FAR for s in states}
        auction(arcs, [4 * r + s for r in range(n - 1, -1, -1) for s in reversed(states)], price)
        for s in states:
            table[4 * s + goal] = min(FAR, price[s])
    return table


def repaired(audit: str, roles: list[str], texts: list[str], state: int) -> list[dict]:
    """The messages that an audit leaves, from the state before its first letter."""
    out, row = [], 0
    for letter in audit:
        if letter == "K":
            out.append({"role": roles[row], "text": texts[row]})
            state = KEEPS[_initial(roles[row])][state]
        elif letter != "D":
            state = TURN[state]
            out.append({"role": ROLES[state], "text": texts[row] if letter == "R" else ""})
        row += letter != "I"
    return out


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


# ---------------------------------------------------------------- blocks
MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
#: What one block knows about its rows; numbers of a whole conversation follow from those of its blocks in order.
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")


class _Block:
    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts, self.digests, self.seen_at, self.turns = conv, [], [], [], [], [], []
        self.bytes = 0

    def add(self, turn, role, text, seen: set) -> None:
        ending = text.rstrip(BLANKS)[-1:]
        digest = hashlib.blake2b(role.encode() + b"\0" + text.encode(), digest_size=16).digest()
        if not ending:
            code = "x"
        elif digest in seen:
            code = "d"  # a duplicate: deleted like x, but counted apart
        else:
            code = _initial(role) if ending in ".!?" else _initial(role).upper()
        seen.add(digest)
        self.codes.append(code)
        self.digests.append(digest)
        self.roles.append(role)
        self.texts.append("" if code in "xd" else text)
        self.turns.append(turn)
        self.bytes += len(text) + 64

    def counts(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "rows": len(self.codes), "blank": self.codes.count("x"), "duplicate": self.codes.count("d"), "truncated": sum(c.isupper() for c in self.codes),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns))}


def _blocks(batches, conv_type, block_rows, block_bytes):
    """Sorted rows of one task to blocks: a conversation that certainly lies whole in one block is repaired at once.

    Duplicates are found inside a block here; what a long conversation repeats from an earlier block is found by ``_split``.
    """
    names = ["conv_id", "place", "edge", "codes", "roles", "texts", "digests", "counts", "cost", "audit", "messages"]
    kinds = [conv_type, pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()),
             pa.struct([(c, pa.int64()) for c in COUNTS]), pa.int64(), pa.string(), MESSAGES]
    part, made, rows, held = TaskContext.get().partitionId(), 0, [], 0

    def finish(block: _Block, edge: bool) -> tuple:
        nonlocal made
        codes = "".join(block.codes)
        cost, audit = cheapest(codes.replace("d", "x"))
        made += 1
        messages = repaired(audit, block.roles, block.texts, 0)
        # an edge block may be a part of a conversation, so it keeps its rows, too
        own = (block.roles, block.texts, block.digests) if edge else (None, None, None)
        return block.conv, (part << 32) + made, edge, codes, *own, block.counts(), cost, audit, messages

    def record() -> pa.RecordBatch:
        nonlocal rows, held
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        rows, held = [], 0
        return batch

    block, seen, first, cut = None, set(), True, False
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            piece = batch.slice(low, 512)
            for conv, turn, role, text in zip(*[piece.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]):
                if block is None or conv != block.conv:
                    if block is not None:
                        held += block.bytes
                        rows.append(finish(block, first or cut))
                        first = False
                    block, seen, cut = _Block(conv), set(), False
                elif len(block.codes) >= block_rows or block.bytes >= block_bytes:
                    held += block.bytes
                    rows.append(finish(block, True))
                    block, seen, cut = _Block(conv), set(), True
                block.add(turn, role, text, seen)
                if held >= block_bytes or len(rows) >= 4096:
                    yield record()
    if block is not None:
        rows.append(finish(block, True))  # the last conversation may go on in the next task
        yield record()


def _chain(prices_of_block):
    """Prices before each block of one conversation, last block first: the same auction over (block, state)."""
    n = len(prices_of_block)
    price = {4 * n + s: p for s, p in enumerate((0, 2 * INSERT, INSERT, 0))}

    def out(node):
        block, state = divmod(node, 4)
        return [("", cost, 4 * (block + 1) + t) for t, cost in enumerate(prices_of_block[block][4 * state : 4 * state + 4]) if cost < FAR]

    return auction(out, range(4 * n - 1, -1, -1), price)


def _prices_behind(group: pa.Table) -> pa.Table:
    """One conversation's blocks in order (costs only): the cost to go behind each block, and the conversation's numbers."""
    group = group.sort_by("place")
    counts, table = group.column("counts").to_pylist(), group.column("passage").to_pylist()
    price = _chain(table)
    n = len(table)
    behind = [[price.get(4 * (k + 1) + s, FAR) for s in range(4)] for k in range(n)]
    illegal = sum(c["illegal"] for c in counts)
    initials = group.column("ends").to_pylist()
    illegal += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [c for c in counts if c["turns"]]
    turns = sum(c["turns"] for c in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
    total = {k: sum(c[k] for c in counts) for k in ("blank", "duplicate", "truncated")}
    numbers = [gaps, total["blank"], total["duplicate"], total["truncated"], illegal, price[0]]
    return pa.table({
        "key": group.column("key"), "place": group.column("place"), "block": pa.array(range(n), pa.int64()), "blocks": pa.array([n] * n, pa.int64()),
        "behind": pa.array(behind, pa.list_(pa.int64())), **{c: pa.array([v] * n, pa.int64()) for c, v in zip(NUMBERS, numbers)}})


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _entries(group: pa.Table) -> pa.Table:
    """The state before each block of one conversation, from the states that each block leads to."""
    group = group.sort_by("block")
    state, states = 0, []
    for leads in group.column("leads").to_pylist():
        states.append(state)
        state = leads[state]
    return pa.table({"key": group.column("key"), "place": group.column("place"), "state": pa.array(states, pa.int32())})


def _mapped(df: DataFrame, inputs: list[str], name: str, kind: str, fn) -> DataFrame:
    """``df`` with one more column, made row by row from ``inputs``."""

    def run(batches):
        for batch in batches:
            values = [fn(*row) for row in zip(*[batch.column(c).to_pylist() for c in inputs])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], [*batch.schema.names, name])

    arrow = to_arrow_type(T._parse_datatype_string(kind))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def _split(blocks: DataFrame, work: common.Workspace) -> DataFrame:
    """Repair of conversations of several blocks: what a block costs between states, prices behind each, states before each, then each block's edits."""
    # duplicates across blocks: a (role, text) comes first in one block; every other block has it at most once more to mark
    rows = blocks.select("key", "place", "codes", F.posexplode("digests").alias("row", "digest"))
    rows = rows.where(~F.expr("substring(codes, row + 1, 1)").isin("x", "d")).drop("codes")
    firsts = rows.groupBy("key", "digest").agg(F.min("place").alias("first"))
    again = rows.join(firsts, ["key", "digest"]).where("place > first").groupBy("key", "place").agg(F.collect_list("row").alias("again"))
    joined = blocks.join(again, ["key", "place"], "left")
    changed = F.expr("array_join(transform(sequence(0, length(codes) - 1), i -> if(array_contains(again, i), 'd', substring(codes, i + 1, 1))), '')")
    joined = joined.withColumn("codes", F.when(F.col("again").isNull(), F.col("codes")).otherwise(changed))
    upper = F.length(F.regexp_replace("codes", "[^SUAO]", "")).cast("long")
    dups = F.length(F.regexp_replace("codes", "[^d]", "")).cast("long")
    joined = joined.withColumn("counts", F.col("counts").withField("duplicate", dups).withField("truncated", upper))
    initial = lambda r: F.substring(r, 1, 1)
    ends = F.struct(initial(F.get("roles", F.lit(0))).alias("first"), initial(F.element_at("roles", -1)).alias("last"))
    joined = work.table(joined.withColumn("ends", ends).drop("again", "digests", "cost", "audit", "messages"), "split")

    costs = _mapped(joined.select("key", "place", "counts", "ends", F.translate("codes", "d", "x").alias("codes")), ["codes"], "passage", "array<bigint>", passage)
    numbers = ", ".join(f"{c} long" for c in NUMBERS)
    priced = costs.drop("codes").groupBy("key").applyInArrow(_prices_behind, f"key string, place long, block long, blocks long, behind array<bigint>, {numbers}")
    priced = work.table(priced, "priced")

    def run(codes, behind, last):
        return solve(codes, AT_END, True) if last else solve(codes, tuple(behind), False)

    def leads(codes, behind, last):
        price = run(codes, behind, last)
        return [trace(codes, price, s, last)[1] if price.get(s, FAR) < FAR else 0 for s in range(4)]

    known = joined.join(priced.drop("blank", "duplicate", "truncated", "illegal", "gaps", "cost"), ["key", "place"])
    known = known.withColumns({"plain": F.translate("codes", "d", "x"), "last": F.col("block") == F.col("blocks") - 1})
    ways = _mapped(known.select("key", "place", "block", "plain", "behind", "last"), ["plain", "behind", "last"], "leads", "array<int>", leads)
    entries = ways.select("key", "place", "block", "leads").groupBy("key").applyInArrow(_entries, "key string, place long, state int")
    known = known.join(work.table(entries, "entries"), ["key", "place"])

    def audit(codes, behind, last, state):
        return trace(codes, run(codes, behind, last), state, last)[0]

    out = _mapped(known.select("conv_id", "key", "place", "block", "blocks", "plain", "behind", "last", "state", "roles", "texts"),
                  ["plain", "behind", "last", "state"], "audit", "string", audit)
    out = _mapped(out, ["audit", "roles", "texts", "state"], "messages", "array<struct<role:string,text:string>>", repaired)
    return out.join(priced.select("key", "place", *NUMBERS), ["key", "place"]).select("conv_id", "block", "blocks", *NUMBERS, "audit", "messages")


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired conversations, one row a block: conv_id, block, blocks, the conversation's numbers, the block's audit and messages (role, text).

    A conversation's rows go by turn (nulls first), equal turns by role, then the first 64 characters of the text, then its SHA-256. Rows are
    dealt in ranges of that order, so a conversation with a third of all rows is spread over tasks and cut into blocks of ``BLOCK_ROWS``; all others
    are one block. Edits and costs are the contract's: Keep 0, Rerole 2, Delete 3, Insert 2, a truncated row that stays 1 more.

    Null roles and texts are one blank; a null conv_id is a conversation of its own; a null turn comes first and makes no gap. Empty texts are blank. Repeated
    rows are duplicates from the second on. An empty table gives an empty one. Other columns are ignored.
    """
    spark = conversations.sparkSession
    work = common.Workspace(spark, "conversations")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.withColumns({"_start": F.substring("text", 1, 64), "_sha": F.sha2("text", 256), "_row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_start", "_sha", "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    conv = conversations.schema["conv_id"]
    arrow = to_arrow_type(conv.dataType)
    schema = T.StructType([T.StructField("conv_id", conv.dataType), *T._parse_datatype_string(
        "place long, edge boolean, codes string, roles array<string>, texts array<string>, digests array<binary>, "
        f"counts struct<{', '.join(f'{c}:bigint' for c in COUNTS)}>, cost long, audit string, messages array<struct<role:string,text:string>>").fields])
    limits = BLOCK_ROWS, BLOCK_BYTES
    blocks = work.table(ordered.mapInArrow(lambda batches: _blocks(batches, arrow, *limits), schema), "blocks")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    edge = blocks.where("edge").withColumn("key", key)
    # only the first and last conversation of a task and those of several blocks can be split
    several = edge.groupBy("key").count().where("count > 1").select("key")
    gaps = F.when(F.col("counts.turns") > 0, F.col("counts.high") - F.col("counts.low") + 1 - F.col("counts.turns")).otherwise(0)
    numbers = [gaps.alias("gaps"), *[F.col(f"counts.{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], "cost"]
    whole = blocks.where("not edge").unionByName(edge.join(several, "key", "left_anti").drop("key"))
    whole = whole.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"), *numbers, "audit", "messages")
    parts = edge.join(several, "key", "left_semi")
    return whole.unionByName(_split(parts, work)) if parts.limit(1).count() else whole


def repair_digest(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: its numbers, the whole audit, and the SHA-256 of the repaired messages.

    The messages of a conversation of several blocks are hashed block after block, so no task holds them at once.
    """
    message = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    lines = found.select("conv_id", "block", "blocks", *NUMBERS, "audit", F.array_join(message, "\n").alias("body"), F.size("messages").alias("n"))
    one = lines.where("blocks = 1").select("conv_id", *NUMBERS, "audit", F.sha2("body", 256).alias("repaired_sha256"))
    names = ["conv_id", *NUMBERS, "audit", "repaired_sha256"]

    def hashed(batches):
        sha, audits, started = None, [], False
        for batch in batches:
            for low in range(0, batch.num_rows, 16):
                piece = batch.slice(low, 16)
                out = []
                for r in piece.to_pylist():
                    if r["block"] == 0:
                        sha, audits, started = hashlib.sha256(), [], False
                    if r["n"]:
                        sha.update((b"\n" if started else b"") + r["body"].encode())
                        started = True
                    audits.append(r["audit"])
                    if r["block"] == r["blocks"] - 1:
                        out.append((*[r[c] for c in names[:-2]], "".join(audits), sha.hexdigest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    kinds = [to_arrow_type(one.schema[c].dataType) for c in names]
    long = lines.where("blocks > 1").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    done = one.unionByName(long.mapInArrow(hashed, one.schema))
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(done.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in NUMBERS]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
