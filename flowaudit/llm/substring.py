"""Exact repeats of word passages by prefix-partitioned suffix trees.

A sparse set of suffixes, chosen by content, stands for all windows: every window of 50 words picks one of the word runs in it (its
anchor), and equal windows pick alike. The suffixes that begin at anchors are split by their prefix, the anchor's words, into groups;
a prefix with too many suffixes is lengthened from 25 to all 50 words. In a group the suffixes are sorted by their words; the common
prefixes of neighbours give the internal nodes at every depth, and the same over the words before the anchors, read backwards, gives the left side. Two
windows are equal when their suffixes lie under one node deep enough and the words before them under one node, too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from flowaudit.llm import common
from flowaudit.llm.common import U64

#: Suffixes of one prefix beyond which the prefix is lengthened, and suffixes whose tree is built at once.
PREFIX_SUFFIXES, TREE_SUFFIXES = 20_000, 100_000
#: Anchors, and suffixes, that a task of the map side gathers before it sends them.
CHUNK_ANCHORS, CHUNK_SUFFIXES = 1_000_000, 100_000
#: Stored input for each hash range of anchors, and suffixes for each group and range of documents.
RANGE_BYTES, GROUP_SUFFIXES = 64 << 20, 50_000
#: Bytes of a word's hash that are sent: two different words agree once in 10^12.
WORD_BYTES = 5


MASK = U64((1 << 8 * WORD_BYTES) - 1)


def anchors(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the run of ``k`` words that each window picks, hashes of all runs): the smallest hash, the first of equals. Places ascend."""
    runs = common.window_hashes(hashes, k)
    span = window - k + 1
    if len(runs) < span:
        return np.empty(0, np.int64), runs
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    return np.arange(len(view)) + view.argmin(axis=1), runs


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return first, np.append(first[1:], len(values)) - 1


def _nodes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of a matrix of words, common prefix of each with the one before it)."""
    order = np.argsort(np.ascontiguousarray(strings.astype(">u8")).view(f"V{8 * strings.shape[1]}").ravel(), kind="stable")
    ranked = strings[order]
    other = ranked[1:] != ranked[:-1]
    return order, np.concatenate(([0], np.where(other.any(axis=1), other.argmax(axis=1), strings.shape[1])))


class Suffixes:
    """Suffixes at anchors, each for the windows ``first`` to ``last`` that picked it, with the words from ``first`` to the end of window ``last``."""

    def __init__(self, anchor, doc, at, first, last, words, window: int):
        self.anchor, self.doc, self.at, self.first, self.last, self.words, self.window = anchor, doc, at, first, last, words, window
        self.begin = np.concatenate(([0], np.cumsum(last - first + window)))[:-1] if len(first) else np.empty(0, np.int64)

    def take(self, which: np.ndarray) -> Suffixes:
        size = (self.last - self.first + self.window)[which]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[which], size)
        return Suffixes(self.anchor[which], self.doc[which], self.at[which], self.first[which], self.last[which], self.words[place], self.window)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, window start) of the windows whose words a window of a smaller document here has as well."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        by = np.argsort(self.anchor, kind="stable")
        start, end = _runs(self.anchor[by])
        a = 0
        while a < len(start):  # whole prefixes, so many that one tree stays small
            b = max(a + 1, int(np.searchsorted(end, start[a] + TREE_SUFFIXES)))
            part = by[start[a] : end[b - 1] + 1]
            of, window = self.take(part)._tree()
            found.append((part[of], window))
            a = b
        return tuple(np.concatenate(x) for x in zip(*found))

    def _tree(self) -> tuple[np.ndarray, np.ndarray]:
        n, window = len(self.at), self.window
        left = self.at - self.first  # words before the anchor, and after it, that any window of the suffix needs
        right = self.last + window - self.at
        most = int(left.max())
        padded = np.append(self.words, U64(0))
        column = np.arange(window)
        after = padded[np.where(column < right[:, None], (self.begin + left)[:, None] + column, len(self.words))]
        back = np.arange(1, max(1, most) + 1)
        before = padded[np.where(back <= left[:, None], (self.begin + left)[:, None] - back, len(self.words))]
        (order_r, lcp_r), (order_l, lcp_l) = _nodes(after), _nodes(before)

        def node(order, lcp, depth):
            """Number of each suffix's node of this depth."""
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(lcp < depth)
            return out

        of, starts = [], []
        for o in range(most + 1):  # windows that begin o words before their anchor
            mine = np.flatnonzero((left >= o) & (self.at - o <= self.last))
            if len(mine) < 2:
                continue
            key = node(order_r, lcp_r, window - o)[mine] * (n + 1) + (node(order_l, lcp_l, o)[mine] if o else 0)
            by = np.lexsort((self.doc[mine], key))
            first, last = _runs(key[by])
            lowest = np.repeat(self.doc[mine][by][first], last - first + 1)
            again = by[self.doc[mine][by] > lowest]
            of.append(mine[again])
            starts.append(self.at[mine[again]] - o)
        if not of:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(of), np.concatenate(starts)

    def without(self, of: np.ndarray, starts: np.ndarray) -> Suffixes:
        """What is left when windows ``starts`` of suffixes ``of`` are taken out; a suffix may fall into several."""
        size = self.last - self.first + 1
        owner = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        window = np.arange(len(owner)) - np.repeat(begin, size) + np.repeat(self.first, size)
        keep = np.ones(len(owner), bool)
        keep[begin[of] + starts - self.first[of]] = False
        owner, window = owner[keep], window[keep]
        a, b = _runs(owner * (1 << 32) + window - np.arange(len(owner)))
        which, first, last = owner[a], window[a], window[b]
        size = last - first + self.window
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[which] + first - self.first[which], size)
        return Suffixes(self.anchor[which], self.doc[which], self.at[which], first, last, self.words[place], self.window)

    FIELDS = (("anchors", np.uint64), ("docs", np.int64), ("at", np.uint32), ("firsts", np.uint32), ("lasts", np.uint32))

    def packed(self) -> dict:
        values = (self.anchor, self.doc, self.at, self.first, self.last)
        row = {name: _pack(v.astype(t)) for (name, t), v in zip(self.FIELDS, values)}
        return row | {"words": _pack(self.words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])}

    @classmethod
    def unpacked(cls, rows: list[dict], window: int) -> Suffixes:
        values = [np.concatenate([_unpack(r[name], t) for r in rows]) for name, t in cls.FIELDS]
        raw = np.concatenate([_unpack(r["words"], np.uint8) for r in rows]).reshape(-1, WORD_BYTES)
        words = np.zeros((len(raw), 8), np.uint8)
        words[:, :WORD_BYTES] = raw
        return cls(values[0], values[1], *[v.astype(np.int64) for v in values[2:]], words.view("<u8").ravel().astype(np.uint64), window)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, indices in it) of 64-bit keys, by hash."""
    bucket = (common.mix(keys) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, last = _runs(bucket[order])
    for a, b in zip(first.tolist(), last.tolist()):
        yield int(bucket[order[a]]), order[a : b + 1]


def shared_anchors(documents: DataFrame, work: common.Workspace, window: int) -> tuple[DataFrame, list[int]]:
    """((doc_id, places): anchors that another document has, too; prefixes with too many suffixes, at most one in PREFIX_SUFFIXES).

    A task keeps its anchors by chunk and sends each distinct one of a chunk once, with its smallest and largest document, so a passage in a
    third of all documents is one entry a chunk. The hash ranges answer every chunk with those of its anchors that several documents have.
    """
    ranges = max(common.spread(documents.sparkSession, 4), common.estimated_bytes(documents) // RANGE_BYTES)
    length = window // 2
    schema = "kind string, chunk long, bucket int, anchors binary, lows binary, highs binary, counts binary, docs binary, at binary"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def find(batches):
        held, size = [], 0

        def send():
            anchor, doc, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, anchor))
            anchor, doc, at = anchor[order], doc[order], at[order]
            first, last = _runs(anchor)
            # a chunk is named after its content, the same whenever the task is repeated
            chunk = int.from_bytes(hashlib.blake2b(doc.tobytes() + anchor.tobytes() + at.tobytes(), digest_size=8).digest(), "little") >> 1
            own, low, high, count = anchor[first], doc[first], doc[last], last - first + 1
            rows = [("local", chunk, None, _pack(anchor), None, None, None, _pack(doc), _pack(at.astype(np.uint32)))]
            for bucket, which in _by_bucket(own, ranges):
                rows.append(("sent", chunk, bucket, *[_pack(x[which]) for x in (own, low, high, count)], None, None))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for part in common.slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), common.texts(part)):
                    chosen, runs = anchors(common.word_hashes(text.split()), window, length)
                    at = np.unique(chosen)
                    held.append((runs[at], np.full(len(at), doc, np.int64), at))
                    size += len(at)
                if size > CHUNK_ANCHORS:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    documents.select("doc_id", "text").mapInArrow(find, schema).write.partitionBy("kind").option("compression", "zstd").parquet(work.path("anchors"))
    found = documents.sparkSession.read.schema(schema).parquet(work.path("anchors"))

    def answer(table):
        rows = table.to_pylist()
        anchor, low, high, count = (np.concatenate([_unpack(r[c], t) for r in rows]) for c, t in (("anchors", np.uint64), ("lows", np.int64), ("highs", np.int64), ("counts", np.int64)))
        chunk = np.repeat(np.arange(len(rows)), [len(_unpack(r["anchors"], np.uint64)) for r in rows])
        order = np.argsort(anchor, kind="stable")
        first, last = _runs(anchor[order])
        size = last - first + 1
        several = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
        total = np.add.reduceat(count[order], first)
        mine = np.empty(len(anchor), bool)
        mine[order] = np.repeat(several, size)
        out = [(r["chunk"], _pack(anchor[mine & (chunk == k)]), None) for k, r in enumerate(rows)]
        often = anchor[order][first][several & (total > limit)]
        if len(often):
            out.append((-1, None, _pack(often)))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()), "anchors": pa.array([o[1] for o in out], pa.binary()), "often": pa.array([o[2] for o in out], pa.binary())})

    limit = PREFIX_SUFFIXES
    answers = found.where("kind = 'sent'").select("chunk", "bucket", "anchors", "lows", "highs", "counts").groupBy("bucket").applyInArrow(answer, "chunk long, anchors binary, often binary")
    answers = work.table(answers, "answers")
    often = [x for r in answers.where("often is not null").select("often").collect() for x in _unpack(r[0], np.uint64).tolist()]

    def places(local, known):
        shared = np.unique(np.concatenate([_unpack(a, np.uint64) for a in known.column("anchors").to_pylist()] or [np.empty(0, np.uint64)]))
        out = {"doc_id": [np.empty(0, np.int64)], "places": []}
        for row in local.to_pylist():
            anchor, doc, at = _unpack(row["anchors"], np.uint64), _unpack(row["docs"], np.int64), _unpack(row["at"], np.uint32)
            if len(shared):
                where = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
                mine = shared[where] == anchor
                order = np.lexsort((at[mine], doc[mine]))
                doc, at = doc[mine][order], at[mine][order].astype(np.int64)
                first, last = _runs(doc)
                out["doc_id"].append(doc[first])
                out["places"] += [at[a : b + 1] for a, b in zip(first.tolist(), last.tolist())]
        return pa.table({"doc_id": np.concatenate(out["doc_id"]), "places": pa.array(out["places"], pa.list_(pa.int64()))})

    local = found.where("kind = 'local'").select("chunk", "anchors", "docs", "at")
    replies = answers.where("chunk >= 0").select("chunk", "anchors")
    near = local.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(places, "doc_id long, places array<long>")
    # a document lies in one chunk unless its row is repeated
    return work.table(near.where("size(places) > 0").dropDuplicates(["doc_id"]), "near"), often


def _document_suffixes(doc: int, hashes: np.ndarray, near: np.ndarray, often: np.ndarray, window: int) -> list[tuple]:
    """(anchor, doc, at, first, last, words) of a document's suffixes at ``near``; too frequent prefixes are lengthened to the whole window."""
    out = []
    picked, runs = anchors(hashes, window, window // 2)
    todo = np.isin(picked, near)
    long = todo & np.isin(runs[picked], often)
    for at, runs, mine in ((picked, runs, np.flatnonzero(todo & ~long)), (np.arange(len(picked)), None, np.flatnonzero(long))):
        if not len(mine):
            continue
        if runs is None:
            runs = common.window_hashes(hashes, window)
        a, b = _runs(at[mine] * (1 << 32) + (mine - np.arange(len(mine))))  # neighbouring windows with one anchor
        for i, j in zip(a.tolist(), b.tolist()):
            first, last, place = int(mine[i]), int(mine[j]), int(at[mine[i]])
            out.append((int(runs[place]), doc, place, first, last, hashes[first : last + window]))
    return out


def repeated_windows(documents: DataFrame, work: common.Workspace, window: int = 50) -> DataFrame:
    """(doc_id, text, places): documents with windows whose words also begin in a document with a smaller doc_id, and where those begin.

    1. Only documents with an anchor that another one has are read on; their texts are compressed before they are shuffled.
    2. A task builds the tree of its own chunk first: what repeats there is known, and each distinct window goes on once, with its smallest doc_id.
    3. Every group of prefixes is a subtree; its repeats, and those known before, go to ranges of documents, packed, and become one row a document.
    """
    spark = documents.sparkSession
    near, often = shared_anchors(documents, work, window)

    def squeezed(batches):
        for batch in batches:
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([zstandard.compress(t, 1) for t in common.texts(part)], pa.binary())], ["doc_id", "text"])

    wanted = common.members(documents.select("doc_id", "text"), "doc_id", near, "doc_id").mapInArrow(squeezed, "doc_id long, text binary")
    held = work.table(wanted.join(near, "doc_id").dropDuplicates(["doc_id"]), "held")
    work.drop("anchors", "answers")
    total = held.agg(F.sum(F.size("places"))).first()[0] or 0
    groups, ranges = (max(common.spread(spark, f), total // GROUP_SUFFIXES) for f in (4, 2))
    frequent = spark.sparkContext.broadcast(np.array(often, np.uint64))
    schema = "bucket long, anchors binary, docs binary, at binary, firsts binary, lasts binary, words binary, range long, starts binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def marks(docs: np.ndarray, starts: np.ndarray) -> list[dict]:
        return [{"range": r, "docs": _pack(docs[which]), "starts": _pack(starts[which].astype(np.uint32))} for r, which in _by_bucket(docs.astype(np.uint64), ranges)]

    def send(batches):
        found = []

        def chunk():
            *numbers, words = zip(*found)
            own = Suffixes(np.array(numbers[0], np.uint64), *[np.array(c, np.int64) for c in numbers[1:]], np.concatenate(words) & MASK, window)
            of, starts = own.repeats()
            rows = marks(own.doc[of], starts)
            rest = own.without(of, starts)
            rows += [rest.take(which).packed() | {"bucket": b} for b, which in _by_bucket(rest.anchor, groups)]
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.int64() if n in ("bucket", "range") else pa.binary()) for n in names], names)

        for batch in batches:
            for doc, raw, places in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                hashes = common.word_hashes(zstandard.decompress(raw).split())
                found += _document_suffixes(doc, hashes, np.array(places, np.int64), frequent.value, window)
                if len(found) > CHUNK_SUFFIXES:
                    yield chunk()
                    found = []
        if found:
            yield chunk()

    sent = work.table(held.mapInArrow(send, schema), "suffixes")
    marked = "range long, docs binary, starts binary"

    def subtree(table):
        own = Suffixes.unpacked(table.to_pylist(), window)
        of, starts = own.repeats()
        rows = marks(own.doc[of], starts)
        return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in (("range", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary()))})

    def by_document(table):
        docs, starts = (np.concatenate([_unpack(r, t) for r in table.column(c).to_pylist()]) for c, t in (("docs", np.int64), ("starts", np.uint32)))
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order].astype(np.int64)
        first, last = _runs(docs)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(docs)).astype(np.int32)), pa.array(starts))
        return pa.table({"doc_id": docs[first], "starts": lists})

    found = sent.where("bucket is not null").select("bucket", *[n for n, _ in Suffixes.FIELDS], "words").groupBy("bucket").applyInArrow(subtree, marked)
    known = sent.where("range is not null").select("range", "docs", "starts")
    places = found.union(known).groupBy("range").applyInArrow(by_document, "doc_id long, starts array<long>")
    return held.select("doc_id", "text").join(work.table(places, "marks"), "doc_id").select("doc_id", "text", F.col("starts").alias("places"))


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``places``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, np.minimum(places + window, n), -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that stays), repeats (maximal removed stretches as [first, last) words).

    A word goes when it lies in ``window`` consecutive words that also begin in a document with a smaller
    doc_id, judged on the input. Words are runs of anything but ASCII white space. Of documents with the
    same word sequence all but the smallest doc_id are removed whole (if they hold a window) and need no
    suffixes. Defined results: null or empty text: no words; a null doc_id is never smaller, and its text stays; a row that repeats a doc_id
    must repeat its text and gets the same result; other columns are ignored.
    """
    spark = documents.sparkSession
    work = common.Workspace(spark, "substring")
    base = documents.select("doc_id", "text")

    def digest(batches):
        for batch in batches:
            for part in common.slices(batch):
                words = [t.split() for t in common.texts(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())],
                    ["doc_id", "n_words", "sha"])

    rows = work.table(base.mapInArrow(digest, "doc_id long, n_words long, sha binary"), "rows")
    lowest = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    # copies that the bitmap lets through only cost work: their smallest document decides below
    single = common.members(base.where("doc_id is not null"), "doc_id", work.table(lowest.select("doc_id"), "lowest"), "doc_id")
    marked = repeated_windows(single, work, window)
    return_rows = "doc_id long, n_removed long, kept string, kept_sha binary, repeats array<array<long>>"

    def cut(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part, out = batch.slice(row, 64), []
                for doc, raw, places in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("places").to_pylist()):
                    words = zstandard.decompress(raw).split()
                    gone = covered(len(words), np.array(places, np.int64), window)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    out.append((doc, int(gone.sum()), kept.decode(), hashlib.sha256(kept).digest(), edges.reshape(-1, 2).tolist()))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_removed", "kept", "kept_sha", "repeats"])

    changed = marked.mapInArrow(cut, return_rows)
    first = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("lowest"))
    copy = (F.col("doc_id") != F.col("lowest")) & (F.col("n_words") >= window)
    gone = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    return rows.join(first, "sha", "left").join(changed, "doc_id", "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.lower(F.hex(F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(copy, gone).otherwise(F.coalesce("repeats", F.array().cast("array<array<bigint>>"))).alias("repeats"))
