"""Secret scans: multipart credential linking.

Three strong kinds are reported wherever they stand: `assign` (a named
assignment), `access` (an access identifier) and `hex` (a long hex run).
Parts that are too weak alone are *linked*: identifiers, secrets and endpoints
are intervals, the blank lines of a text bound its scopes, and the sorted parts
of a scope are joined, however long they are and however far apart.  A weak
secret is reported only if a complementary part (an identifier or an endpoint)
is in its scope; an endpoint only if it then completes a credential.

Defined results: a null text has no spans; ties at one start are ordered by the
order of KINDS; repeated rows are scanned one by one; other columns are ignored; an
empty table gives an empty one.
Texts of any length are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BASE = ("assign", "access", "hex")
#: Order of kinds that start at the same place.
KINDS = (*BASE, "secret", "endpoint", "identifier")

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

IDENTIFIER = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"\b(?:https?|ftps?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.ASCII)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
#: A weak secret has at least so many bits a character.
MIN_ENTROPY = 3.5


def entropy(value: str) -> float:
    """Bits a character of a string's own distribution of characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Strong spans (start, end, kind), each kind leftmost and without overlaps."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _weak(value: str) -> bool:
    kinds = any(c.isdigit() for c in value) + any("a" <= c <= "z" for c in value) + any("A" <= c <= "Z" for c in value)
    return kinds == 3 and entropy(value) >= MIN_ENTROPY


def link_parts(text: str, strong: list[tuple[int, int, str]]):
    """(added spans, credentials): weak parts that complementary parts confirm.

    A credential is (scope start, scope end, parts by place), one for each scope
    that has an anchor and a secret.  No part holds a line break, so each is in one scope.
    """
    anchors = [(s, e, "access") for s, e, k in strong if k == "access"]
    if ":" in text or "=" in text:
        anchors += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
        anchors += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if not anchors:
        return [], []
    anchors.sort()
    taken = [(s, e) for s, e, _ in strong] + [(s, e) for s, e, k in anchors if k == "endpoint"]
    taken.sort()
    starts = [s for s, _ in taken]
    ends, top = [], -1
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    secrets = [(s, e, "strong") for s, e, k in strong if k in ("assign", "hex")]
    for m in WEAK.finditer(text):
        k = bisect_left(starts, m.end())
        if not (k and ends[k - 1] > m.start()) and _weak(m[0]):
            secrets.append((m.start(), m.end(), "weak"))
    secrets.sort()
    blanks = [m.start() for m in BLANK_LINE.finditer(text)]
    scopes: dict[int, tuple[list, list]] = {}
    for which, parts in enumerate((anchors, secrets)):
        for x in parts:
            scopes.setdefault(bisect_left(blanks, x[0]), ([], []))[which].append(x)
    added, credentials = set(), []
    for k, (mine, near) in sorted(scopes.items()):
        anchored, secret = {x[:2] for x in mine}, {x[:2] for x in near}
        met = [x for x in mine if secret - {x[:2]}] if len(secret) < 2 else mine  # a part doesn't complete itself
        inside = [x for x in near if anchored - {x[:2]}] if len(anchored) < 2 else near
        if not (met and inside):
            continue
        added.update(x for x in met if x[2] in ("endpoint", "identifier"))
        added.update((x[0], x[1], "secret") for x in inside if x[2] == "weak")
        left, right = blanks[k - 1] if k else 0, blanks[k] if k < len(blanks) else len(text)
        credentials.append((left, right, sorted([*met, *((x[0], x[1], "secret") for x in inside)])))
    return sorted(added, key=lambda x: (x[0], KINDS.index(x[2]))), credentials


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, by start and kind."""
    text = text or ""
    strong = base_spans(text)
    added, _ = link_parts(text, strong)
    return sorted({*strong, *added}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `spans`: array<struct<kind, start, end, value>>, a row for each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch):
        spans = []
        for t in batch.column(1).to_pylist():
            spans.append([{"kind": k, "start": s, "end": e, "value": t[s:e]} for s, e, k in scan(t)])
        return {key: batch.column(0), "spans": spans}

    schema = f"`{key}` {kind}, spans array<struct<kind:string,start:int,end:int,value:string>>"
    return map_batches(docs.select(key, text), run, schema)


def span_text(spans, kinds=None):
    """`kind:start:end`, joined by commas; `kinds` keeps some."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the secret scan for `documents`."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(docs).select(
        "doc_id", *(count(k) for k in BASE),
        F.sha2(span_text(spans, BASE), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
