"""Periodic runs against brute force over every period and start."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All maximal stretches of every period, smallest period only."""
    out, n = {}, len(w)
    for p in range(1, n // 3 + 1):
        k = 0
        while k + p < n:
            if w[k] != w[k + p]:
                k += 1
                continue
            a = k
            while k + p < n and w[k] == w[k + p]:
                k += 1
            length = k + p - a
            if length >= max(24, 3 * p) and not any(x == a and n2 == length for x, n2 in out):
                out[a, length] = p
    return sorted((a, n2, p) for (a, n2), p in out.items())


def odd_words(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randrange(1, 7)):
        kind = rng.randrange(5)
        if kind == 0:
            out += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        elif kind == 1:
            out += ["x"] * rng.randrange(60)
        elif kind == 2:
            base = [f"w{rng.randrange(3)}" for _ in range(rng.randrange(1, 12))]
            out += (base * rng.randrange(1, 9))[: rng.randrange(1, 90)]
        elif kind == 3:
            inner = (["a"] * 25 + ["b"]) * rng.randrange(1, 5)
            out += inner
        else:
            a, b = ["a"], ["a", "b"]
            while len(b) < 120:
                a, b = b, b + a
            out += b[: rng.randrange(120)]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_odd_words(seed):
    w = odd_words(seed)
    assert runs.text_runs([[x.encode() for x in w]]) == [brute(w)]


def test_many_texts_in_one_order(monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 300)
    texts = [odd_words(k) for k in range(100, 140)] + [[]]
    assert runs.text_runs([[x.encode() for x in w] for w in texts]) == [brute(w) for w in texts]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        order, rank = runs.suffix_array(s)
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert order.tolist() == want and rank[order].tolist() == list(range(n))
        lcp = runs.common_prefixes(s, order, rank)
        for k in range(1, n):
            i, j, m = want[k - 1], want[k], 0
            while max(i, j) + m < n and s[i + m] == s[j + m]:
                m += 1
            assert lcp[k] == m


def expected(doc, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    keep = [True] * n
    for a, length, p in found:
        keep[a + p : a + length] = [False] * (length - p)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_query(spark, documents, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(odd_words(k)) for k in range(200, 260)]
    texts += [" \n".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 400))) for _ in range(60)]
    texts += [None, "", " \t", "a b   c\u0085d", "one " * 3000, texts[0], texts[0]]
    rows = list(enumerate(texts))
    documents(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
                          ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert sorted(tuple(r) for r in got.collect()) == sorted((expected(*r) for r in rows), key=lambda r: r[0])
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t)


def test_long_text_and_repeats(documents):
    rng = random.Random(9)
    w = [f"w{rng.randrange(3000)}" for _ in range(9000)]
    text = " ".join(w + w[-700:] * 3 + ["z"] * 20000)
    got = runs.find_runs(documents([(None, text), (1, text), (1, text)])).collect()
    for r in got:
        assert {(x.start, x.length, x.period) for x in r.runs} >= {(8300, 2800, 700), (11100, 20000, 1)}
        assert len(r.collapsed.split()) == 9001 and r.n_words == 31100


def test_empty_table(documents):
    found = runs.find_runs(runs.planted(documents([])))
    assert runs.run_digest(found).count() == 0
    row = runs.run_digest(runs.find_runs(documents([(3, None)]))).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (3, 0, None, None, None, None, empty, empty)
