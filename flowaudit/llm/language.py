"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowaudit.llm import common
from flowaudit.llm.common import U64

#: Subword lengths (the word with its two borders) and hash buckets.
LENGTHS = (2, 3, 4)
BUCKETS = 1 << 16
UNKNOWN = "und"
#: Up to about so many different texts of a language all are candidates for the training sample.
MANY_TEXTS = 32
#: Text scored at once inside a task.
SCORED_BYTES = 1 << 20


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all subwords, how many belong to each word)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters up to the word's end
    found, owner = [], []
    for n in LENGTHS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            h += codes[k : k + len(h)] * common.ODD[k]
        fits = left[: len(h)] >= n
        found.append((common.mix(h[fits]) % U64(BUCKETS)).astype(np.int32))
        owner.append(word[: len(h)][fits])
    if not found:
        return np.empty(0, np.int32), np.zeros(len(words), np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return found[by], np.bincount(owner, minlength=len(words))


def coded_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct lower-case words, word number at each place, bounds of each text); null is the empty text."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(column)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    least: float  # a smaller calibrated probability is rejected

    def probabilities(self, mean_scores: np.ndarray) -> np.ndarray:
        z = (mean_scores + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], dim: int = 16, epochs: int = 12, rate: float = 2.0, rejected: float = 0.001, seed: int = 11) -> Model:
    """Stochastic gradient descent on documents given as (buckets, shares, language).

    A fifth of the rows isn't trained on: it sets the temperature (least log loss) and the rejection limit, the
    ``rejected`` quantile of the calibrated probability, at most one half.
    """
    languages = sorted({r[2] for r in rows})
    index = {x: k for k, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist()) if len(rows) >= 20 else set()
    docs = [(np.asarray(b), np.asarray(s), index[x]) for b, s, x in rows]
    table = np.zeros((BUCKETS, dim))
    weights = rng.standard_normal((dim, len(languages))) / np.sqrt(dim)
    bias = np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)).tolist():
            if i in held:
                continue
            buckets, share, y = docs[i]
            mean = share @ table[buckets]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            # the mean spreads a gradient over hundreds of buckets; scaling by the number of subwords keeps the step
            table[buckets] -= np.outer(share * (step / (share @ share)) * 0.05, back)
    model = Model(languages, (table @ weights).astype(np.float32), bias, 1.0, 0.0)
    test = [docs[i] for i in (sorted(held) or range(len(docs)))]
    means = np.array([s @ model.scores[b] for b, s, _ in test])
    truth = np.array([y for _, _, y in test])
    loss = []
    for t in (grid := np.geomspace(0.05, 5, 60)):
        model.temperature = t
        loss.append(-np.log(model.probabilities(means)[np.arange(len(truth)), truth] + 1e-12).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    model.least = float(min(0.5, np.quantile(model.probabilities(means).max(axis=1), rejected)))
    return model


def training_rows(documents: DataFrame, chosen: Column, train_rows: int) -> list:
    """Subword shares of at most ``train_rows`` documents with a language, evenly over languages, by a hash of the text.

    The share taken of a language follows its number of different texts, so a language that consists of copies of a few texts gives all of them.
    """
    known = documents.where(chosen & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(train_rows).collect()}
    if not counts:
        return []
    each = max(1, train_rows // len(counts))
    rule = F.lit(False)
    for lang, n in counts.items():
        # a language of few texts gives them all, so that none is left without a training row
        share = 1.0 if n <= MANY_TEXTS else min(1.0, each / n)
        rule = rule | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * share) + 1))

    def shares(batches):
        for batch in batches:
            for part in common.slices(batch):
                words, places, bounds = coded_words(part.column("text"))
                found, sizes = subwords(words)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                buckets, share = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    used, times = np.unique(places[a:b], return_counts=True)
                    sums = np.zeros(BUCKETS)
                    for w, n in zip(used.tolist(), times.tolist()):
                        np.add.at(sums, found[starts[w] : starts[w + 1]], n)
                    hit = np.flatnonzero(sums)
                    buckets.append(hit.astype(np.int32))
                    share.append((sums[hit] / max(1, sums.sum())).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32())), part.column("lang")], ["buckets", "shares", "lang"])

    # a group of exact copies shares one hash, so it would be chosen as a whole: copies count once
    chosen_rows = known.where(rule).dropDuplicates(["text", "lang"])
    # the bound cuts by a place within the language, so that no language is cut off whole
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    first = chosen_rows.withColumn("place", place).orderBy("place", "lang").limit(train_rows).select("text", "lang")
    spread = first.repartition(common.spread(documents.sparkSession), "text")
    taken = spread.mapInArrow(shares, "buckets array<int>, shares array<float>, lang string").toArrow()
    taken = taken.combine_chunks()  # flat arrays: Python lists of the same numbers would take ten times the memory
    rows = []
    for batch in taken.to_batches():
        flat = [batch.column(c).values.to_numpy() for c in ("buckets", "shares")]
        ends = batch.column("buckets").offsets.to_numpy()
        for a, b, lang in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("lang").to_pylist()):
            if b > a:
                rows.append((flat[0][a:b], flat[1][a:b], lang))
    return sorted(rows, key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))


def identify(documents: DataFrame, chosen: Column, train_rows: int = 2400) -> DataFrame:
    """All columns of ``documents`` with lang_pred, score (calibrated probability) and rejected.

    Trained on at most ``train_rows`` documents where ``chosen`` holds and lang isn't null; predictions see the whole
    text alone. Null texts and texts without a letter are "und" with score 0 and rejected; without any labelled row so is everything.
    Clashing columns lang_pred, score and rejected are replaced.
    """
    spark = documents.sparkSession
    documents = documents.drop("lang_pred", "score", "rejected")
    rows = training_rows(documents, chosen, train_rows)
    model = spark.sparkContext.broadcast(train(rows) if rows else None)
    fields = documents.schema.simpleString()[7:-1]

    def predict(batches):
        m = model.value
        for batch in batches:
            for part in common.slices(batch, limit=SCORED_BYTES):
                words, places, bounds = coded_words(part.column("text"))
                lettered = pc.fill_null(pc.match_substring_regex(part.column("text").cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                n = part.num_rows
                if m is None:
                    names, best, low = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                else:
                    found, sizes = subwords(words)
                    own = np.zeros((len(words), len(m.languages)))
                    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                    if len(words):
                        own = np.add.reduceat(m.scores[found], begin, axis=0)  # each word has a subword: its two borders
                    owner = np.repeat(np.arange(n), np.diff(bounds))
                    text = np.column_stack([np.bincount(owner, own[places, k], n) for k in range(own.shape[1])] + [np.bincount(owner, sizes[places], n)])
                    p = m.probabilities(text[:, :-1] / np.maximum(text[:, -1:], 1))
                    top = p.argmax(axis=1)
                    best = np.where(lettered, p[np.arange(n), top], 0.0)
                    names = [m.languages[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), lettered.tolist())]
                    low = ~lettered | (best < m.least)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(low)], [*part.schema.names, "lang_pred", "score", "rejected"])

    return documents.mapInArrow(predict, f"{fields}, lang_pred string, score double, rejected boolean" if fields else "")
