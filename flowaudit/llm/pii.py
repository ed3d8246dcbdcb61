"""Personal data in texts: labelers vote on spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowaudit.llm import common

# The contract's patterns. A look-behind only skips starts that can't match anyway.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "handle", "number")

# Gazetteers of the labelers.
NAMES_OF_SECRETS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth")
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "glpat-", "eyJ")
CUES = {
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "auth", "login", "credential"),
    "handle": ("mail", "e-mail", "email", "contact", "write", "kontakt", "correo", "courriel"),
    "number": ("phone", "tel", "call", "fax", "mobile", "card", "account", "ssn", "passport", "iban", "telefon", "teléfono", "téléphone"),
}
WIDE = {
    "secret": re.compile(
        r"(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)[\x20\"']{0,2}[:=][\x20]?[\"']?([^\s\"',;]{6,})"
        r"|(?<![A-Za-z0-9_-])((?:AKIA|ASIA|ghp_|gho_|sk-|xoxb-|xoxp-|glpat-|eyJ)[A-Za-z0-9_.-]{10,})", re.I),
    "handle": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[\[(](?:at|AT)[\])][\x20]?[A-Za-z0-9-]+(?:[\x20]?(?:\.|[\[(](?:dot|DOT)[\])])[\x20]?[A-Za-z0-9-]+)+"),
    "number": re.compile(r"(?<![\w.+-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7})(?![\w-])"),
}
#: Characters before a span that the context labeler reads.
CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by kind as listed, then start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:  # the only match with this @ begins where the characters before it begin
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
        # an @ inside a match is passed over; characters of a match aren't used again
    for m in IP.finditer(text):
        # leading zeros first: thousands of them are legal in a text, but not as a number's digits
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _votes(kind: str, span: str, before: str) -> tuple[int, ...]:
    """Labelers: shape, gazetteer, context, spread of characters, length. 1 personal, -1 not, 0 no opinion."""
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    low = before.lower()
    if kind == "secret":
        shape = 1 if digits >= 3 and letters >= 3 else -1 if digits == 0 and span.islower() else 0
        known = 1 if span.startswith(KEY_STARTS) or any(n in low[-14:] for n in NAMES_OF_SECRETS) else 0
    elif kind == "handle":
        shape = 1 if re.search(r"[\[(]at[\])]", span, re.I) and "." not in span[:1] else -1
        known = 1 if re.search(r"(com|org|net|edu|de|fr|es|info)$", span, re.I) else -1
    else:
        shape = 1 if 9 <= digits <= 34 else -1
        known = 1 if span[:1].isalpha() or digits in (9, 10) else 0
    context = 1 if any(c in low for c in CUES[kind]) else -1 if kind == "number" and low.rstrip().endswith(("$", "€", "£", "=")) else 0
    spread = len(set(span)) / max(1, min(len(span), 20))
    return shape, known, context, (1 if spread > 0.45 else -1 if spread < 0.25 else 0), (1 if 8 <= len(span) <= 80 else -1)


def candidates(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, its base spans, and wider spans with votes and classifier features."""

    def find(batches):
        for batch in batches:
            for part in common.slices(batch):
                rows = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), common.texts(part)):
                    text = raw.decode()
                    base = base_spans(text)
                    taken = sorted((a, b) for _, a, b in base)
                    wide = []
                    for kind, pattern in WIDE.items():
                        for m in pattern.finditer(text) if _may(kind, text) else ():
                            group = m.lastindex or 0
                            a, b = m.span(group)
                            if any(x < b and a < y for x, y in taken):
                                continue
                            span = text[a:b]
                            wide.append({"kind": kind, "a": a, "b": b, "votes": list(_votes(kind, span, text[max(0, a - CONTEXT) : a])), "shape": _shape(span)})
                    rows.append((doc, [{"kind": k, "a": a, "b": b} for k, a, b in base], wide))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "base", "wide"])

    span = [("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]
    kinds = (pa.int64(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("votes", pa.list_(pa.int32())), ("shape", pa.list_(pa.int32()))])))
    return documents.select("doc_id", "text").mapInArrow(
        find, "doc_id long, base array<struct<kind:string,a:long,b:long>>, wide array<struct<kind:string,a:long,b:long,votes:array<int>,shape:array<int>>>")


def _may(kind: str, text: str) -> bool:
    """Cheap necessary condition of a wide pattern."""
    if kind == "secret":
        return "=" in text or ":" in text or any(s in text for s in KEY_STARTS) or bool(re.search("akia|asia|ghp_|gho_|sk-|xox|glpat-|eyj", text, re.I))
    if kind == "handle":
        return "(at)" in text.lower() or "[at]" in text.lower()
    return bool(re.search("[0-9]{3}", text))


def _shape(span: str) -> list[int]:
    """Coarse features of the span alone: length class, share of digits and of letters in tenths, mixed case, signs."""
    n = max(1, len(span))
    return [min(8, n.bit_length()), 10 * sum(c.isdigit() for c in span) // n, 10 * sum(c.isalpha() for c in span) // n,
            int(span.lower() != span and span.upper() != span), min(5, len(re.findall(r"[^\w\s]", span)))]


def reliabilities(votes: np.ndarray, times: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for labelers with three answers: (P(answer | personal), P(answer | not), share of personal spans).

    ``votes`` are the distinct vote patterns, ``times`` how often each occurs; starts from the majority.
    """
    p = np.clip(0.5 + 0.15 * votes.sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        share = float(np.clip((p * times).sum() / times.sum(), 0.02, 0.98))
        like = []
        for weight in (p * times, (1 - p) * times):
            like.append(np.array([[(weight[votes[:, j] == v].sum() + 0.5) / (weight.sum() + 1.5) for v in (-1, 0, 1)] for j in range(votes.shape[1])]))
        new = _posterior(votes, *like, share)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return like[0], like[1], share


def _posterior(votes: np.ndarray, yes: np.ndarray, no: np.ndarray, share: float) -> np.ndarray:
    j = np.arange(votes.shape[1])
    odds = np.log(share / (1 - share)) + (np.log(yes[j, votes + 1]) - np.log(no[j, votes + 1])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _inputs(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.column_stack([votes, shape / np.array([8, 10, 10, 1, 5]), np.ones(len(votes))])


def fit(found: DataFrame, steps: int = 300) -> dict[str, tuple]:
    """Per added kind: labelers weighed by EM over the counts of all spans, then a logistic classifier on its soft labels.

    Votes and shapes take few values, so what comes to the driver is bounded by their combinations.
    """
    spans = found.select(F.explode("wide").alias("s")).select("s.kind", "s.votes", "s.shape")
    counts = spans.groupBy("kind", "votes", "shape").count().orderBy("kind", "votes", "shape").toPandas()
    models = {}
    for kind, rows in counts.groupby("kind"):
        votes, shape, times = np.array(rows["votes"].tolist()), np.array(rows["shape"].tolist()), rows["count"].to_numpy(float)
        yes, no, share = reliabilities(votes, times)
        soft, x = _posterior(votes, yes, no, share), _inputs(votes, shape)
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 0.5 * (x.T @ (times * (p - soft)) / times.sum() + 1e-3 * w)
        models[kind] = (yes, no, share, w)
    return models


def find_personal_data(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, spans (kind, a, b: code points, end exclusive), base spans first by kind, then added ones.

    Base spans are the contract's and always stay. Wider patterns give further candidates (secrets, spelled-out
    addresses, numbers) that don't overlap a base span; a candidate stays when the classifier trained on the weighed votes gives one half or more.
    Null and empty texts have no spans; rows with a null doc_id and repeated rows stay; other columns are ignored.
    """
    work = common.Workspace(documents.sparkSession, "pii")
    found = work.table(candidates(documents), "candidates")
    models = fit(found)

    def decide(batches):
        for batch in batches:
            out = []
            for base, wide in zip(batch.column("base").to_pylist(), batch.column("wide").to_pylist()):
                kept = []
                for s in wide:
                    w = models[s["kind"]][3]
                    if float((_inputs(np.array([s["votes"]]), np.array([s["shape"]])) @ w)[0]) >= 0:
                        kept.append({k: s[k] for k in ("kind", "a", "b")})
                out.append(base + sorted(kept, key=lambda s: (ADDED.index(s["kind"]), s["a"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "spans"])

    return found.select("doc_id", "base", "wide").mapInArrow(decide, "doc_id long, spans array<struct<kind:string,a:long,b:long>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their SHA-256 and all spans as text."""

    def of(*kinds):
        return lambda s: s["kind"].isin(*kinds)

    base = F.filter("spans", of(*BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    return found.select(
        "doc_id", *[F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def mask(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in brackets; nulls stay null, n_chars follows the text if it is there."""
    work = common.Workspace(documents.sparkSession, "pii-mask")
    kept = documents.withColumn("_row", F.monotonically_increasing_id())
    kept = work.table(kept, "rows")
    found = find_personal_data(kept.select(F.col("_row").alias("doc_id"), "text")).where(F.size("spans") > 0)

    def replace(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                end, parts = 0, []
                for s in sorted(spans, key=lambda s: (s["a"], -s["b"])):
                    if s["a"] >= end:
                        parts += [text[end : s["a"]], f"[{s['kind'].upper()}]"]
                        end = s["b"]
                    else:  # overlapping kinds: one mark covers both
                        end = max(end, s["b"])
                out.append("".join(parts) + text[end:])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "masked"])

    masked = kept.select("_row", "text").join(found.withColumnRenamed("doc_id", "_row"), "_row").mapInArrow(replace, "_row long, masked string")
    joined = kept.join(masked, "_row", "left").withColumn("text", F.coalesce("masked", "text"))
    if "n_chars" in documents.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("masked").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(documents.columns)
