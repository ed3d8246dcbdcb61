"""Periodic runs of words: an enhanced suffix array, branching tandem repeats per LCP interval, rotated and merged into runs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowaudit.llm import common
from flowaudit.llm.common import U64

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A run is at least so long and holds at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 1 << 17


# ---------------------------------------------------------------- enhanced suffix array
def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, their places) of dense symbols, by prefix doubling; only suffixes still tied are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    heads = np.concatenate(([True], s[order][1:] != s[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 1
    while not heads.all():
        tied = ~heads
        tied[:-1] |= ~heads[1:]
        at = np.flatnonzero(tied)  # places of suffixes whose first h symbols aren't unique
        i = order[at]
        later = np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
        by = np.lexsort((later, rank[i]))
        i, later = i[by], later[by]
        order[at] = i
        first = rank[i]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (later[1:] != later[:-1])))
        heads[at] |= new
        rank[i] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Longest common prefix of each suffix in the order with the one before it (Kasai); the first has -1."""
    n = len(s)
    out = [0] * n
    text, before, places = s.tolist(), order.tolist(), rank.tolist()
    length = 0
    for i, k in enumerate(places):
        if k:
            j = before[k - 1]
            top = n - max(i, j)
            while length < top and text[i + length] == text[j + length]:
                length += 1
            out[k] = length
            if length:
                length -= 1
        else:
            length = 0
    out[0] = -1
    return out


def intervals(lcp: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Borders k between children of an LCP interval: (start of the child left of k, end of the one right of it, interval's first and last place).

    Nearest smaller (or equal) values on both sides, by one stack pass each; no tree node is built.
    """
    n = len(lcp)
    near, first, stack = [0] * n, [0] * n, [0]
    for k in range(1, n):
        v = lcp[k]
        while lcp[stack[-1]] > v:
            stack.pop()
        j = stack[-1]
        near[k] = j
        first[k] = first[j] if lcp[j] == v else j
        stack.append(k)
    after, last, stack = [n] * n, [n] * n, []
    for k in range(n - 1, 0, -1):
        v = lcp[k]
        while stack and lcp[stack[-1]] > v:
            stack.pop()
        j = stack[-1] if stack else n
        after[k] = j
        last[k] = last[j] if j < n and lcp[j] == v else j
        stack.append(k)
    return np.array(near), np.array(after) - 1, np.array(first), np.array(last) - 1


def branching_tandems(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next symbol breaks the period.

    Two suffixes ``d`` apart whose common prefix is exactly ``d`` lie in different children of one interval of depth ``d``. So for
    the suffixes i of all children but the largest, i + d and i - d are looked up by their places: n log n tests, whatever the text.
    """
    n = len(s)
    order, rank = suffix_array(s)
    lcp = common_prefixes(s, order, rank)
    near, after, first, last = intervals(lcp)
    lcp = np.array(lcp)
    k = np.flatnonzero(lcp > 0)
    ends = k[after[k] == last[k]]  # the last border of an interval also ends in a right child
    a = np.concatenate((near[k], ends))
    b = np.concatenate((k - 1, after[ends]))
    lo, hi = np.concatenate((first[k], first[ends])), np.concatenate((last[k], last[ends]))
    depth = np.concatenate((lcp[k], lcp[ends]))
    by = np.lexsort((a - b, depth, lo))  # the largest child of each interval comes first and is left out
    a, b, lo, hi, depth = a[by], b[by], lo[by], hi[by], depth[by]
    small = np.concatenate(([False], (lo[1:] == lo[:-1]) & (depth[1:] == depth[:-1]))) if len(a) else np.empty(0, bool)
    a, b, lo, hi, depth = a[small], b[small], lo[small], hi[small], depth[small]
    starts, periods = [], []
    size = b - a + 1
    total = np.cumsum(size)
    c0 = 0
    while c0 < len(a):  # children by blocks, so that the tests' arrays stay small
        c1 = max(c0 + 1, int(np.searchsorted(total, (total[c0 - 1] if c0 else 0) + (1 << 20), side="right")))
        reps = size[c0:c1]
        place = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(a[c0:c1], reps)
        i, d, low, high = order[place], *(np.repeat(x[c0:c1], reps) for x in (depth, lo, hi))
        for start, other in ((i, i + d), (i - d, i - d)):
            ok = (other >= 0) & (other < n)
            where = rank[np.where(ok, other, 0)]
            ok &= (where >= low) & (where <= high)
            x, p = start[ok], d[ok]
            end = x + 2 * p
            broken = (end >= n) | (s[np.minimum(end, n - 1)] != s[np.minimum(x + p, n - 1)])
            starts.append(x[broken])
            periods.append(p[broken])
        c0 = c1
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.column_stack((np.concatenate(starts), np.concatenate(periods))), axis=0)
    return pairs[:, 0], pairs[:, 1]


def runs(s: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of dense symbols, by start, then period.

    Each branching square ends where its run ends; rotating it to the left while the symbols agree finds the run's start. Squares whose
    period is a multiple of a run's that holds them belong to that run.
    """
    start, period = branching_tandems(s)
    end = start + 2 * period
    need = np.maximum(LEAST_WORDS - 2 * period, (LEAST_PERIODS - 2) * period)  # rotations a run needs at least
    left = np.arange(len(start))
    for step in range(1, LEAST_WORDS + 1):  # most squares are short and drop out here
        x = start[left] - step
        same = (x >= 0) & (s[np.maximum(x, 0)] == s[np.maximum(x, 0) + period[left]])
        left = left[(need[left] < step) | same]
    left = left[np.lexsort((period[left], end[left]))]
    out: list[tuple[int, int, int]] = []
    known: list[tuple[int, int]] = []
    at_end = -1
    for j in left.tolist():
        x, p, e = int(start[j]), int(period[j]), int(end[j])
        if e != at_end:
            at_end, known = e, []
        if any(p % q == 0 and x >= begin for begin, q in known):
            continue
        begin, block = x, 64
        while begin > 0:
            low = max(0, begin - block)
            other = np.flatnonzero(s[low:begin] != s[low + p : begin + p])
            if len(other):
                begin = low + int(other[-1]) + 1
                break
            begin, block = low, 2 * block
        if e - begin >= max(LEAST_WORDS, LEAST_PERIODS * p):
            known.append((begin, p))
            out.append((begin, e - begin, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


# ---------------------------------------------------------------- texts
def _suspects(words: list[np.ndarray]) -> list[int]:
    """Texts that repeat some 16 words: a run of length L and period p repeats its first L - p >= 16 words p later."""
    width = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS
    out = []
    for k, h in enumerate(words):
        grams = common.window_hashes(h, width)
        if len(grams) > 1:
            grams.sort()
            if (grams[1:] == grams[:-1]).any():
                out.append(k)
    return out


def text_runs(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text's words. Suffixes of many texts are sorted at once; symbols are numbered per text, so nothing matches across."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    todo = _suspects([common.word_hashes(w) for w in words])
    while todo:
        size, part = 0, []
        while todo and (not part or size + len(words[todo[0]]) <= BATCH_WORDS):
            part.append(todo.pop(0))
            size += len(words[part[-1]])
        symbols, base, seen = np.empty(size, np.int64), [], 0
        at = 0
        for k in part:
            numbers: dict[bytes, int] = {}
            symbols[at : at + len(words[k])] = [numbers.setdefault(w, len(numbers)) for w in words[k]]
            symbols[at : at + len(words[k])] += seen
            seen += len(numbers)
            base.append(at)
            at += len(words[k])
        for start, length, period in runs(symbols):
            k = int(np.searchsorted(base, start, side="right")) - 1
            found[part[k]].append((start - base[k], length, period))
    return found


def find_runs(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period: by start, then period), collapsed.

    Words are runs of characters other than blank and \\x09-\\x0D. A run is a stretch of words with smallest period q, at
    least 24 words and three periods long, that no neighbouring word extends. ``collapsed`` joins by one space the words that no run holds after its first q.
    Null and empty texts have no words, no runs and an empty collapsed text. Rows with a null doc_id and repeated rows stay; overlapping runs of
    different periods are all listed; an empty table gives an empty one; other columns are ignored. A text is handled whole by one task.
    """
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches):
        for batch in batches:
            for part in common.slices(batch, limit=1 << 20):
                words = [WORD.findall(t) for t in common.texts(part)]
                found = text_runs(words)
                collapsed = []
                for w, rs in zip(words, found):
                    if rs:
                        keep = np.ones(len(w), bool)
                        for start, length, period in rs:
                            keep[start + period : start + length] = False
                        w = [w[k] for k in np.flatnonzero(keep).tolist()]
                    collapsed.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": a, "length": n, "period": p} for a, n, p in rs] for rs in found], pa.list_(span)),
                    pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    common.ship_package(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the contract's test material. Where crc32 of the id ends in 0, the words from place a on repeat with period p."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = documents.select("doc_id", "text", (h % 10 == 0).alias("hit"), g.alias("g"))
    rows = rows.withColumn("w", F.when(F.col("hit"), words)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int")))
    return rows.select("doc_id", F.when(F.col("hit") & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the one with the greatest length / period, and hashes of all runs and of the collapsed text."""
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        # runs come by start, then period: only a greater exponent takes the place
        lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
