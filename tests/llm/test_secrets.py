"""Secret spans against a literal reading of the patterns, and ownership over a planted corpus."""

import hashlib
import random
import re

from flowaudit.llm import queries, secrets


def literal(text):
    """The contract's patterns as they stand."""
    out = []
    t = text or ""
    name = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer("(" + name + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


TRICKY = [
    None, "", "password", "PassWord: 'abcdefgh'", "toKenſ=abcdefgh1", "Key token==abcdefgh", "apikey=short api_key = longenough1",
    "passwd:secret=abcdefghij", "token=a token=abcdefghijk", "AKIAAKIA", "AKIA" + "Z9" * 6, "xAKIA" + "0" * 11, "f" * 31 + "g" + "0" * 32 + "f" * 40,
    "é" * 9 + " secret : \"" + "ab" * 20 + "\"", "token = \"" + "0123456789abcdef" * 3, "password   =   =====x", "İİİ token=abcdefgh", "x" * 200000 + " token=abcdefgh",
    "token" * 3000, "password" + " " * 5000 + "=abcdefgh",
]


def rows():
    rng = random.Random(2)
    out = list(TRICKY)
    for _ in range(300):
        out.append("".join(rng.choice(["token", "Secret", "=", ":", " ", "'", "AKIA", "9Z" * 5, "abcdef0123" * 3, "ab", "\n", "é", "api_key", "q"]) for _ in range(rng.randrange(25))))
    return list(enumerate(out))


def test_base_spans():
    for _, t in rows():
        assert [(s["a"], s["k"], s["kind"], s["b"]) for s in secrets.base_spans(t or "")] == literal(t), t


def test_query(spark, documents, tmp_path):
    data = rows() + [(9000, "token=abcdefgh"), (9000, "token=abcdefgh")]
    documents(data, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_secrets(spark, str(tmp_path))
    assert got.dtypes[:6] == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    got = got.collect()
    want = []
    for i, t in data:
        spans = literal(t)
        kinds = [s[2] for s in spans]
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        want.append((i, *[kinds.count(k) for k in secrets.BASE], digest))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    text = dict(data)
    for r in got:
        listed = r.spans.split(",") if r.spans else []
        base = [f"{k}:{a}:{b}" for a, _, k, b in literal(text[r.doc_id])]
        assert [s for s in listed if s.split(":")[0] in secrets.BASE] == base


OPAQUE = "Zk3v9QpL7xWm2Rt8Yb4Nc6Hd"
COPIED = "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8"


def test_ownership(spark, monkeypatch):
    data = [(k, f"see {COPIED} here", f"owner{k}/repo") for k in range(8)]
    data += [(20, f"key {OPAQUE}.", "owner1/repo"), (21, f"key {OPAQUE}.", "owner1/repo"), (22, f"Bearer {OPAQUE}1x", "owner2/a"), (23, f"Bearer {OPAQUE}1x", "owner3/b")]
    data += [(30, "ghp_" + "a1B2c3D4e5" * 3, None), (31, "https://me:hunter2x9z3@host/", "owner4/x"), (32, "internationalisationsunternehmen/verwaltung", "owner4/x"), (None, None, None)]
    data += [(40 + k, "token=" + COPIED, f"owner{k}/repo") for k in range(2)]
    for frequent in (1000, 2):
        monkeypatch.setattr(secrets, "FREQUENT", frequent)
        docs = spark.createDataFrame(data, "doc_id long, text string, source string")
        got = {r.doc_id: [(s.kind, s.a, s.b, s.owners, s.spread) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
        assert all(got[k] == [] for k in range(8)) and got[None] == [] and got[32] == []
        assert got[20] == got[21] == [("opaque", 4, 28, 1, "specific")]
        assert got[22] == got[23] == [("bearer", 7, 33, 2, "shared")]
        assert got[30] == [("provider", 0, 34, 1, "specific")] and got[31] == [("login", 11, 22, 1, "specific")]
        assert got[40] == [("assign", 0, 30, 8, "example")]  # base spans stay


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secrets.span_digest(secrets.find_secrets(docs)).count() == 0
