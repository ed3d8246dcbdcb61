"""Toxicity of texts restored by noisy-channel decoding of obfuscated words."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowaudit.llm import common
from flowaudit.llm.common import U64
from flowaudit.llm.language import coded_words

# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h",
}
ALPHABET = "^" + "".join(c for c in map(chr, range(97, 256)) if c.isalpha() and c == c.lower() and c not in "ªµº")
CODE = {c: k for k, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET)
#: Price (negative log probability) of writing a letter as itself, as a sign, in between, or again.
SAME, SIGN, NOISE, AGAIN = 0.05, 2.0, 2.5, 2.0
EDGE = ".,;:?\"'`()[]{}<>%&*#~^=/\\"
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)


def character_counts(documents: DataFrame) -> np.ndarray:
    """Counts of three letters in a row (with word borders) over all words of letters of all texts."""

    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        index = np.full(256, -1, np.int64)
        for c, k in CODE.items():
            index[ord(c)] = k
        for batch in batches:
            for part in common.slices(batch):
                words, places, _ = coded_words(part.column("text"))
                times = np.bincount(places, minlength=len(words))
                words = [w.strip(EDGE + "!") for w in words]
                size = np.fromiter(map(len, words), np.int64, len(words)) + 3
                codes = np.frombuffer("".join(f"^^{w}^" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
                ids = np.where(codes < 256, index[np.minimum(codes, 255)], -1)
                weight = np.repeat(times, size)
                left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
                n = max(0, len(codes) - 2)
                a, b, c = ids[:n], ids[1 : n + 1], ids[2 : n + 2]
                good = (a >= 0) & (b >= 0) & (c >= 0) & (left[:n] >= 3)
                total += np.bincount((a[good] * SIZE + b[good]) * SIZE + c[good], weight[:n][good], SIZE**3).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["gram", "n"])

    sums = documents.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)  # the result's size depends on the alphabet alone
    out[sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(SIZE, SIZE, SIZE)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(letter | two before), each order mixed with the next shorter one."""
    one = (counts.sum(axis=(0, 1)) + 0.5) / (counts.sum() + 0.5 * SIZE)
    two = (counts.sum(axis=0) + 20 * one) / (counts.sum(axis=(0, 2))[:, None] + 20)
    return -np.log((counts + 10 * two[None]) / (counts.sum(axis=2, keepdims=True) + 10))


class Decoder:
    """The cheapest words of letters that could have been written as a token, or as tokens in a row."""

    def __init__(self, costs: np.ndarray):
        self.array, self.costs, self.known = costs, costs.tolist(), {}

    def remembered(self, key, make):
        out = self.known.get(key)
        if out is None:
            if len(self.known) > 100_000:
                self.known = {}
            out = self.known[key] = make(key)
        return out

    def decode(self, token: str) -> str:
        return self.remembered(token, self._decode)

    def _decode(self, token: str) -> str:
        states = self._read(token, (0, 0))
        path = min(((p + self.costs[a][b][0], path) for (a, b), (p, path) in states.items()), key=lambda x: x[0])[1]
        return "".join(ALPHABET[c] for c in _steps(path))

    def cut(self, start: tuple[int, int], written: str, after: tuple[int, int] | None, closed: bool) -> tuple[list[bool], list[str]]:
        """For each blank of ``written`` whether it stands for nothing, and the letters of the parts between blanks.

        ``start`` are the two letters before (0, 0 at a border), ``after`` the two that follow for certain; ``closed``: the
        last two letters of ``written`` are certain, so that what follows has no part in the choice.
        """
        return self.remembered((start, written, after, closed), self._cut)

    def _cut(self, key) -> tuple[list[bool], list[str]]:
        start, written, after, closed = key
        states = self._read(written, start)

        def end(a: int, b: int) -> float:
            if closed:
                return 0.0
            return self.costs[a][b][after[0]] + self.costs[b][after[0]][after[1]] if after else self.costs[a][b][0] if a or b else 0.0

        path = min(((p + end(a, b), path) for (a, b), (p, path) in states.items()), key=lambda x: x[0])[1]
        blanks, letters = [], [[]]
        for c in _steps(path):
            if c > 0:
                letters[-1].append(ALPHABET[c])
            else:
                blanks.append(c == NOTHING)
                letters.append([])
        return blanks, ["".join(x) for x in letters]

    def _read(self, token: str, start: tuple[int, int]) -> dict[tuple[int, int], tuple[float, tuple | None]]:
        """Viterbi over the lattice of each sign's readings: a letter, nothing (a sign in between), or the letter before again;
        a blank is a word's border or nothing.

        A state is the last two letters, so the work is linear in the token's length.
        """
        states = {start: (0.0, None)}
        for char in token:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            if char == " ":
                for (a, b), (price, path) in states.items():
                    after[a, b] = min(after.get((a, b), (math.inf,)), (price + NOISE, (path, NOTHING)), key=lambda x: x[0])
                    total = price + SAME + self.costs[a][b][0] if a or b else price
                    if total < after.get((0, 0), (math.inf,))[0]:
                        after[0, 0] = (total, (path, 0))
                states = after
                continue
            own = CODE.get(char)
            readings = [(own, SAME)] if own else [(CODE[c], SIGN) for c in STANDS_FOR.get(char, "")]
            skip = None if own else NOISE
            for (a, b), (price, path) in states.items():
                row = self.costs[a][b]
                for c, cost in readings:
                    total = price + cost + row[c]
                    if total < after.get((b, c), (math.inf,))[0]:
                        after[b, c] = (total, (path, c))
                    if c == b:  # written again: no new letter
                        total = price + cost + AGAIN / 4
                        if total < after.get((a, b), (math.inf,))[0]:
                            after[a, b] = (total, path)
                if skip is not None and price + skip < after.get((a, b), (math.inf,))[0]:
                    after[a, b] = (price + skip, path)
            states = after or states
        return states


#: A blank read as nothing, in a path.
NOTHING = -1


def _steps(path: tuple | None) -> list[int]:
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return out[::-1]


SUSPECT = re.compile(r"[^\W\d_].*[\d@$!|+(€£¡#*._-]|[\d@$!|+(€£¡#].*[^\W\d_]|([^\W\d_])\1\1")


def restored(words: list[str], decoder: Decoder) -> list[str]:
    """Words without outer signs; what holds signs or a letter three times is decoded."""
    out = []
    for word in words:
        core = word.strip(EDGE)
        out.append(core if core.isalpha() and not SUSPECT.search(core) else decoder.decode(core) if SUSPECT.search(core) else core.rstrip("!"))
    return out


LETTERS = frozenset(ALPHABET[1:])
LETTER_AT = np.array([CODE[chr(c)] if chr(c) in LETTERS else 0 for c in range(256)] + [0], np.int64)


def _outer_letters(cores: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
    """Per word: its first two letters and its last two (0, 0 where they aren't certain), whether it's read as written, whether
    it holds a letter outside the alphabet; and what follows the letters at the start of a word whose end isn't certain.

    Two different letters at an end are certain: each is read as itself, or as the letter before, written again.
    """
    n = len(cores)
    size = np.fromiter(map(len, cores), np.int64, n)
    codes = LETTER_AT[np.minimum(np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32), 256)]
    owner, begin = np.repeat(np.arange(n), size), np.cumsum(size) - size
    lettered = np.bincount(owner, codes > 0, n) == size
    thrice = np.zeros(n, bool)
    thrice[owner[2:][(codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (owner[2:] == owner[:-2])]] = True
    written = lettered & (size > 1) & ~thrice
    long = np.flatnonzero(size > 1)
    first, last = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
    first[long] = codes[begin[long, None] + [0, 1]]
    last[long] = codes[(begin + size)[long, None] + [-2, -1]]
    for x in (first, last):
        x[~((x > 0).all(axis=1) & (written | (x[:, 0] != x[:, 1])))] = 0
    foreign, tails = np.zeros(n, bool), {}
    for k in np.flatnonzero(~lettered).tolist():
        core = cores[k]
        foreign[k] = any(c.isalnum() and c not in LETTERS and c not in STANDS_FOR for c in core)
        if first[k, 0] and not last[k, 0]:
            m = next(i for i, c in enumerate(core) if c not in LETTERS)
            if core[m - 2] != core[m - 1]:
                tails[k] = core[m - 2 :]
            else:
                first[k] = 0
    first[~lettered & (last[:, 0] == 0) & ~np.isin(np.arange(n), list(tails))] = 0
    first[lettered & (last[:, 0] == 0)] = 0  # ends in a letter written several times
    first[foreign] = last[foreign] = 0
    return first, last, written, foreign, tails


def spelled(words: list[str], places: np.ndarray, bounds: np.ndarray, decoder: Decoder) -> list[tuple[int, str]]:
    """(text, word) of every word written over several places of ``words``: the blanks between are read as nothing.

    The cheapest reading of each whole text decides, blanks being borders or nothing. Where the two letters on each side of
    a blank are certain, nothing further away has a part in the choice, so these blanks are decided by their own costs, all at
    once; the lattice is run over what lies between: single letters, and words that begin or end with signs.
    """
    n = len(places)
    if not n:
        return []
    cores = [w.strip(EDGE) for w in words]
    first, last, written, foreign, tails = _outer_letters(cores)
    border = np.zeros(n + 1, bool)
    border[bounds] = True
    opens, closes = np.append(first[places, 0] > 0, False), np.append(last[places, 0] > 0, False)  # certain at the start, at the end
    foreign = np.append(foreign[places], True)
    joined = np.zeros(n + 1, bool)  # the blank before a place is nothing

    i = np.flatnonzero(opens[1:n] & closes[: n - 1] & ~border[1:n]) + 1
    (c, d), (a, b), costs = first[places[i]].T, last[places[i - 1]].T, decoder.array
    joined[i] = NOISE + costs[a, b, c] + costs[b, c, d] < SAME + costs[a, b, 0] + costs[0, 0, c] + costs[0, c, d]

    # a run of uncertain blanks: it begins behind a certain end, a border or a foreign word, and ends the same way
    letters = {}
    loose = np.zeros(n + 1, bool)
    loose[1:n] = ~border[1:n] & ~foreign[1:n] & ~foreign[: n - 1] & ~(opens[1:n] & closes[: n - 1])
    found = np.flatnonzero(loose)
    new = np.ones(len(found), bool)
    before = found[1:]
    new[1:] = (np.diff(found) > 1) | (opens | closes)[before - 1]
    starts = np.flatnonzero(new)
    for f, e in zip(found[starts].tolist(), found[np.append(starts[1:], len(found))[: len(starts)] - 1].tolist()):
        inner = [cores[p] for p in places[f:e].tolist()]  # between the run's first and last blank
        left, right = int(places[f - 1]), int(places[e])
        if closes[f - 1]:
            start, head = tuple(last[left].tolist()), ""
        elif opens[f - 1]:
            start, head = (CODE[tails[left][0]], CODE[tails[left][1]]), tails[left][2:]
        else:
            start, head = (0, 0), cores[left]
        after = tuple(first[right].tolist()) if opens[e] else None
        blanks, read = decoder.cut(start, " ".join([head, *inner, "" if after else cores[right]]), after, not after and bool(closes[e]))
        if any(blanks):
            joined[f : e + 1] = blanks
            for k, x in zip(range(f - 1, e + 1), read):
                if not opens[k] and not (closes[k] and k == f - 1):
                    letters[k] = x

    out, hit = [], np.flatnonzero(joined)
    new = np.diff(hit, prepend=-2) > 1
    for f, m in zip(hit[new].tolist(), np.diff(np.append(np.flatnonzero(new), len(hit))).tolist()):
        parts = []
        for k in range(f - 1, f + m):
            word = int(places[k])
            parts.append(letters[k] if k in letters else cores[word] if written[word] else decoder.decode(cores[word]))
        if sum(map(bool, parts)) > 1:
            out.append((int(np.searchsorted(bounds, f, "right") - 1), "".join(parts)))
    return out


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word's prefixes and of the whole word: one row per word, -1 where a prefix is longer than the word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(begin, size)
    part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * common.ODD[place % 64] * (place.astype(np.uint64) // U64(64) + U64(1)), dtype=np.uint64)])
    out = np.full((len(words), len(PREFIXES) + 1), -1, np.int64)
    for k, n in enumerate((*PREFIXES, None)):
        end = begin + (size if n is None else np.minimum(n, size))
        h = common.mix(part[end] - part[begin] + U64(k + 1)) % U64(BUCKETS)
        out[:, k] = np.where(size > 0 if n is None else size >= n, h.astype(np.int64), -1)
    return out


def _words_of(part: pa.RecordBatch, decoder: Decoder):
    """Feature buckets per distinct word, then (text, word) places."""
    words, places, bounds = coded_words(part.column("text"))
    apart = spelled(words, places, bounds, decoder)
    found = restored(words, decoder) + [w for _, w in apart]
    text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    text = np.concatenate([text, np.array([t for t, _ in apart], np.int64)])
    places = np.concatenate([places.astype(np.int64), np.arange(len(words), len(found))])
    return features(found), text, places


def _summary(part: pa.RecordBatch, decoder: Decoder, table: np.ndarray) -> np.ndarray:
    """Per text: strongest evidence of a word, evidence of all strong words (damped), their number (damped), strong share."""
    buckets, text, places = _words_of(part, decoder)
    weight = np.where(buckets >= 0, table[np.maximum(buckets, 0)], 0.0).max(axis=1) if len(buckets) else np.empty(0)
    own = weight[places]
    n = part.num_rows
    most = np.zeros(n)
    np.maximum.at(most, text, own)
    strong = own > 1.5
    total = np.bincount(text[strong], own[strong], n)
    count = np.bincount(text[strong], minlength=n)
    words = np.maximum(np.bincount(text, minlength=n), 1)
    return np.column_stack([most, np.log1p(total), np.log1p(count), np.sqrt(count / words)])


def labelled_sample(documents: DataFrame, labels: DataFrame, chosen: Column, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled rows, half of each class at most, with toxic and a fold (by a hash of the text's id)."""
    usable = labels.where(chosen & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    rule = F.lit(False)
    for toxic, n in counts.items():
        rule = rule | ((F.col("toxic") == toxic) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / 2 / n)) + 1))
    taken = usable.where(rule).limit(rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    return documents.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "toxic", "fold")  # bounded by ``rows``


def word_evidence(sample: DataFrame, decoder) -> np.ndarray:
    """Log odds of each feature bucket from the first fold: in how many toxic and other texts it occurs."""

    def count(batches):
        for batch in batches:
            for part in common.slices(batch):
                buckets, text, places = _words_of(part, decoder.value)
                toxic = part.column("toxic").to_numpy()
                rows = buckets[places]
                pair = np.column_stack([np.repeat(text, rows.shape[1]), rows.ravel()])
                pair = np.unique((pair[:, 0] * BUCKETS + pair[:, 1])[pair[:, 1] >= 0])
                used, where = np.unique(pair % BUCKETS, return_inverse=True)
                bad = toxic[pair // BUCKETS] == 1
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.bincount(where[bad], minlength=len(used))), pa.array(np.bincount(where[~bad], minlength=len(used)))], ["bucket", "bad", "good"])

    counts = sample.where("fold = 0").mapInArrow(count, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counts.where("bad >= 3 and bad > good").toArrow()  # at most BUCKETS rows
    sizes = {r["toxic"]: r["count"] for r in sample.where("fold = 0").groupBy("toxic").count().collect()}
    table = np.zeros(BUCKETS)
    bad, good = found["bad"].to_numpy(), found["good"].to_numpy()
    table[found["bucket"].to_numpy()] = np.log((bad + 0.5) / (sizes.get(1, 0) + 1)) - np.log((good + 0.5) / (sizes.get(0, 0) + 1))
    return np.maximum(table, 0)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton steps with equal weight for both classes."""
    x1 = np.column_stack([x, np.ones(len(x))])
    share = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (p - y)) + ridge * w
        hess = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score_toxicity(documents: DataFrame, labels: DataFrame, chosen: Column, label_rows: int = 20_000) -> DataFrame:
    """doc_id, score (0 to 1), predicted for every row of ``documents``.

    The character model counts all texts. Word evidence and the final logistic layer are learned from at
    most ``label_rows`` rows of ``labels`` where ``chosen`` (a condition on doc_id) holds, one fold each. A score sees the
    whole text only. Defined results: null and empty texts score as texts without evidence; with labels of one class or none all scores are 0;
    other columns are ignored.
    """
    sc = documents.sparkSession.sparkContext
    decoder = sc.broadcast(Decoder(character_costs(character_counts(documents))))
    sample = labelled_sample(documents, labels, chosen, label_rows)
    table = sc.broadcast(word_evidence(sample, decoder).astype(np.float32))

    def summaries(batches):
        for batch in batches:
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summary(part, decoder.value, table.value).T] + [part.column("toxic")], ["a", "b", "c", "d", "toxic"])

    known = sample.where("fold = 1").mapInArrow(summaries, "a double, b double, c double, d double, toxic int").toPandas()
    y = known["toxic"].to_numpy()
    usable = len(set(y.tolist())) == 2
    weights, bias = fit_logistic(known[["a", "b", "c", "d"]].to_numpy(), y) if usable else (np.zeros(4), -30.0)

    def score(batches):
        for batch in batches:
            for part in common.slices(batch):
                z = np.clip(_summary(part, decoder.value, table.value) @ weights + bias, -30, 30)
                p = 1 / (1 + np.exp(-z)) if usable else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")
