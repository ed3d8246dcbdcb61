"""Secrets in texts: shapes propose candidates, their spread over repositories and owners decides which look live."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowaudit.llm import common

# The contract's patterns. Letters of the names match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need not be matched to be dropped
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")

# Shapes of further candidates, each with the group that holds the secret itself.
WIDE = {
    "provider": (re.compile(r"(?<![A-Za-z0-9_-])((?:gh[opsur]_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|npm_|SG\.)[A-Za-z0-9_.-]{16,})"), 1),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"), 1),
    "login": (re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@"), 1),
    "bearer": (re.compile(r"\b[Bb]earer\x20([A-Za-z0-9+/_.=-]{16,})"), 1),
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----([A-Za-z0-9+/=\s]{32,}?)-----END"), 1),
    "opaque": (re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{24,}={0,2})(?![A-Za-z0-9+/_=-])"), 1),
}
#: What a text must hold before a wide shape is tried; None: tried always.
NEEDS = {"provider": ("gh", "glpat-", "xox", "sk_", "sk-", "rk_", "AIza", "npm_", "SG."), "jwt": ("eyJ",), "login": ("://",), "bearer": ("earer ",), "pem": ("PRIVATE KEY",), "opaque": None}
KINDS = BASE + tuple(WIDE)

#: A value of more owners than this is a copied example.
EXAMPLE_OWNERS = 3
#: One in so many candidate spans makes a value frequent; there are at most as many frequent values, so they may be broadcast.
FREQUENT = 1000

SPAN = "struct<a:long,k:int,kind:string,b:long,value:binary>"
SPAN_ARROW = pa.struct([("a", pa.int64()), ("k", pa.int32()), ("kind", pa.string()), ("b", pa.int64()), ("value", pa.binary())])


def _span(kind: str, a: int, b: int, value: str) -> dict:
    """Only a hash of the secret leaves the task."""
    return {"a": a, "k": KINDS.index(kind), "kind": kind, "b": b, "value": hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()}


def base_spans(text: str) -> list[dict]:
    """The contract's spans by start, then kind as listed: whole matches, code points, end exclusive."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [_span("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [_span("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [_span("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s["a"], s["k"]))


def live_looking(value: str) -> bool:
    """Letters and digits in a wide mix of characters: not a word, a path, a ruler or a placeholder."""
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    return digits >= 3 and letters >= 3 and len(set(value)) >= min(10, len(value) // 2)


def wide_spans(text: str, base: list[dict]) -> list[dict]:
    """Further candidates that overlap neither a base span nor an earlier shape's candidate."""
    out, taken = [], [(s["a"], s["b"]) for s in base]
    for kind, (pattern, group) in WIDE.items():
        if NEEDS[kind] is not None and not any(n in text for n in NEEDS[kind]):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if live_looking(m[group]) and not any(x < b and a < y for x, y in taken):
                out.append(_span(kind, a, b, m[group]))
                taken.append((a, b))
    return out


def candidates(documents: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Per row: row number, doc_id, repository, owner, base and wide spans. A null repository or owner counts as one of its own."""

    def find(batches):
        for batch in batches:
            for part in common.slices(batch):
                base, wide = [], []
                for raw in common.texts(part):
                    text = raw.decode()
                    base.append(base_spans(text))
                    wide.append(wide_spans(text, base[-1]))
                spans = [pa.array(x, pa.list_(SPAN_ARROW)) for x in (base, wide)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + spans, [*names, "base", "wide"])

    names = ["row", "doc_id", "repository", "owner"]
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), "text")
    return rows.mapInArrow(find, f"row long, doc_id long, repository string, owner string, base array<{SPAN}>, wide array<{SPAN}>")


def ownership(spans: DataFrame) -> DataFrame:
    """(value, repositories, owners, spans, spread): how far each value is copied over the whole corpus.

    ``spans`` holds (value, repository, owner), one row a span. Equal triples are counted before anything is
    shuffled, so a value with a third of all spans arrives as one row per task and repository.
    """
    triples = spans.groupBy("value", "repository", "owner").agg(F.count("*").alias("n"))
    counted = triples.groupBy("value").agg(
        F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("spans"))
    spread = F.when(F.col("owners") > EXAMPLE_OWNERS, "example").when((F.col("owners") == 1) & (F.col("repositories") == 1), "specific").otherwise("shared")
    return counted.withColumn("spread", spread)


def find_secrets(documents: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Per row: doc_id, spans (a, k, kind, b, repositories, owners, spread), by start, then kind.

    Base spans are the contract's and always stay. Spans of wider shapes (provider keys, signed tokens, logins in
    addresses, bearer tokens, private keys, opaque strings) are added unless their value is a copied example, that is, found
    with more than ``EXAMPLE_OWNERS`` owners in the whole corpus; ``spread`` says for every span whether its value
    is ``specific`` to one owner and repository (looks live), ``shared`` or an ``example``. ``repository`` is the column source unless given,
    ``owner`` the part of the repository before its first slash.
    Null and empty texts have no spans; rows with a null doc_id and repeated rows stay, each with its own spans; equal starts are ordered by kind;
    an empty table gives an empty one; other columns are ignored.
    """
    spark = documents.sparkSession
    repository = F.col("source") if repository is None else repository
    owner = F.substring_index(repository.cast("string"), "/", 1) if owner is None else owner
    work = common.Workspace(spark, "secrets")
    found = work.table(candidates(documents, repository, owner), "candidates")
    spans = found.select("row", "repository", "owner", F.explode(F.concat("base", "wide")).alias("s")).select("row", "repository", "owner", "s.*")
    values = work.table(ownership(spans), "values")
    total = spans.count()
    often = F.col("spans") * FREQUENT >= total
    verdict = ["value", "repositories", "owners", "spread"]
    frequent = F.broadcast(values.where(often).select(*verdict))
    # a frequent value would be one join key with all its spans, so those are resolved without a shuffle
    known = spans.join(frequent, "value")
    rest = spans.join(frequent, "value", "left_anti").join(values.where(~often).select(*verdict), "value")
    judged = known.unionByName(rest).where((F.col("k") < len(BASE)) | (F.col("spread") != "example"))
    fields = F.struct("a", "k", "kind", "b", "repositories", "owners", "spread")
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(fields)).alias("spans"))
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"))


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their SHA-256, all spans as text, and how many values look live, are shared or examples."""
    base = F.filter("spans", lambda s: s["k"] < len(BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")

    def of(field: str, name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id", *[of("kind", k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        *[of("spread", s) for s in ("specific", "shared", "example")])
