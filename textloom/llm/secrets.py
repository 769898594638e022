"""Secret scans by multipart credential linking.

Three strong patterns stand alone. Besides them a text has parts that mean little by themselves:
access identifiers, opaque strings, endpoints. A part's scope is its span widened on both sides; the
scopes of one document are interval-joined, and an opaque string is reported only where an identifier
and, failing that, an endpoint meets it in the same scope.
"""

from __future__ import annotations

import bisect
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

KINDS = ("assign", "access", "hex", "linked")
#: The strong patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: A text without any of these has no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The weak parts.
IDENTIFIER = re.compile(r"\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.I | re.A)
ENDPOINT = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b", re.A)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Code points by which a scope reaches beyond its part, on either side.
SCOPE = 160


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), by start and kind."""
    found = []
    if any(n in low for low in (text.lower(),) for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def interval_join(parts: list[tuple[int, int]], others: list[tuple[int, int]], reach: int) -> list[bool]:
    """For each part, whether another span meets its scope; `others` is sorted and each is shorter than what lies between its neighbours' starts."""
    starts = [s for s, _ in others]
    furthest, top = [], -1
    for _, e in others:
        furthest.append(top := max(top, e))
    return [bool((k := bisect.bisect_right(starts, e + reach)) and furthest[k - 1] >= s - reach) for s, e in parts]


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = SCOPE) -> list[tuple[int, int, int]]:
    """Opaque strings outside the base spans that meet a complementary part."""
    weak = []
    for m in OPAQUE.finditer(text):
        x = m[0]
        if not x.isalpha() and any(c.isdigit() for c in x) and any(c.isalpha() for c in x) and len(set(x)) >= 10:
            weak.append((m.start(), m.end()))
    if weak:
        covered = sorted((s, e) for s, _, e in base)
        inside = interval_join(weak, covered, -1)
        weak = [w for w, no in zip(weak, inside, strict=True) if not no]
    if not weak:
        return []
    identifiers = sorted([(s, e) for s, k, e in base if k == 1] + [m.span() for m in IDENTIFIER.finditer(text)])
    endpoints = sorted(m.span() for m in ENDPOINT.finditer(text))
    apart = lambda spans, w: [s for s in spans if s[1] <= w[0] or s[0] >= w[1]]  # noqa: E731  a part doesn't complement itself
    by_id, by_end = interval_join(weak, identifiers, reach), interval_join(weak, endpoints, reach)
    return [(w[0], 3, w[1]) for w, a, b in zip(weak, by_id, by_end, strict=True) if a and interval_join([w], apart(identifiers, w), reach)[0] or b and interval_join([w], apart(endpoints, w), reach)[0]]


def scan(docs: DataFrame, reach: int = SCOPE) -> DataFrame:
    """doc_id and `found`, an array of (kind, start, end) in code points, end exclusive.

    A null or empty text has no spans. Repeated rows give repeated results; other columns are ignored.
    """

    def run(b: dict) -> dict:
        out = []
        for text in b["text"].to_pylist():
            base = base_spans(text)
            out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + linked_spans(text, base, reach))])
        return {"doc_id": b["doc_id"], "found": out}

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != KINDS[3])
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
