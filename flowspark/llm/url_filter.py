"""URL filters: a sorted digest array, probed by vectorised binary search.

A rule is a host and a path prefix (`example.com/en/`) with a verdict.  The
64-bit xxhash keys of all rules form one sorted array: a file in the shared folder,
which Spark hands to every executor and each worker maps into memory, however many
rules there are.  The candidate keys of a batch of URLs (host suffixes of as many
labels as rules have x the path lengths that occur in rules) are looked up in it with
numpy's binary search, and every hit is confirmed against the stored rule string, so
that a collision of digests can't decide a verdict.  The longest fitting rule wins.

Defined results: a null URL, or one without `://`, has an empty host and path,
fits no rule and is blocked; a URL that no rule fits is allowed.  Repeated rows
are judged one by one; of rules that repeat the last one holds; other columns are
ignored; an empty table gives an empty one.  Hosts keep ports and user names, as the
contract says.  URLs of any length take time linear in it, as only the last labels of
a host can fit.
"""

from __future__ import annotations

import mmap
import re

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import map_batches, shared_file

#: The rules of the contract: verdict, rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower-cased) and path of a URL; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _HOST_END.search(rest)
    host, rest = (rest, "") if m is None else (rest[: m.start()], rest[m.start() :])
    m = _PATH_END.search(rest)
    return host.translate(_UPPER), rest if m is None else rest[: m.start()]


class DigestArray:
    """Rules as sorted 64-bit keys with the full strings beside them.

    `to_bytes` is the file's content; `mapped` maps a file, so that the workers of a
    machine share its pages.
    """

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, strings, allow: np.ndarray):
        self.keys, self.offsets, self.strings, self.allow = keys, offsets, strings, allow
        rules = [self.rule(i) for i in range(len(keys))]
        self.path_lengths = sorted({len(path) for _, path in rules})
        self.labels = max((host.count(".") + 1 for host, _ in rules), default=0)

    @classmethod
    def build(cls, rules) -> DigestArray:
        rows = sorted({r: v for v, r in rules}.items(), key=lambda x: xxhash.xxh64_intdigest(x[0]))
        data = [r.encode() for r, _ in rows]
        keys = np.array([xxhash.xxh64_intdigest(r) for r in data], np.uint64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in data])]).astype(np.uint64)
        return cls(keys, offsets, b"".join(data), np.array([v == "allow" for _, v in rows], np.uint8))

    def to_bytes(self) -> bytes:
        return np.uint64(len(self.keys)).tobytes() + self.keys.tobytes() + self.offsets.tobytes() + self.allow.tobytes() + bytes(self.strings)

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(view, np.uint64, 1)[0])
        keys = np.frombuffer(view, np.uint64, n, 8)
        offsets = np.frombuffer(view, np.uint64, n + 1, 8 + 8 * n)
        allow = np.frombuffer(view, np.uint8, n, 16 + 16 * n)
        return cls(keys, offsets, memoryview(view)[16 + 17 * n :], allow)

    def text(self, i: int) -> str:
        return bytes(self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])]).decode()

    def rule(self, i: int) -> tuple[str, str]:
        """Host and path of rule i."""
        text = self.text(i)
        at = text.find("/")
        return (text, "") if at < 0 else (text[:at], text[at:])

    def probe(self, candidates: list[str]) -> np.ndarray:
        """The index of each candidate string's rule, or -1."""
        wanted = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        at = np.searchsorted(self.keys, wanted)
        out = np.full(len(candidates), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted) if len(self.keys) else []):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                if self.text(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out


def candidates(host: str, path: str, path_lengths, labels: int) -> list[str]:
    """Every rule string that could fit: host suffixes of up to `labels` labels, path prefixes."""
    parts = host.rsplit(".", labels)
    hosts = [".".join(parts[-k:]) for k in range(1, min(labels, len(parts)) + 1)]
    prefixes = [path[:n] for n in path_lengths if n <= len(path)]
    return [h + p for h in hosts for p in prefixes if h]


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """`key`, host, path, rule and verdict of every row."""
    name = shared_file(pages.sparkSession, DigestArray.build(rules).to_bytes(), "rules")
    kind = pages.schema[key].dataType.simpleString()
    cache: list = []

    def run(batch):
        if not cache:
            cache.append(DigestArray.mapped(SparkFiles.get(name)))
        array = cache[0]
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        probes, owner = [], []
        for i, (host, path) in enumerate(parts):
            own = candidates(host, path, array.path_lengths, array.labels)
            probes += own
            owner += [i] * len(own)
        best = [-1] * len(parts)
        found = array.probe(probes)
        for j in np.flatnonzero(found >= 0):
            i, k = owner[j], int(found[j])
            if best[i] < 0 or len(array.text(k)) > len(array.text(best[i])):
                best[i] = k
        return {
            key: batch.column(0), "host": [h for h, _ in parts], "path": [p for _, p in parts],
            "rule": [array.text(k) if k >= 0 else None for k in best],
            "verdict": [("allow" if array.allow[k] else "block") if k >= 0 else "allow" if h else "block" for k, (h, _) in zip(best, parts)],
        }

    return map_batches(pages.select(key, url), run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
WITH rules(host, path, rule, verdict) AS (VALUES
  ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
fits AS (
  SELECT p.page_id, p.host, p.path, arg_max(u.rule, length(u.rule)) AS rule, arg_max(u.verdict, length(u.rule)) AS verdict
  FROM parts p LEFT JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' THEN 'allow' ELSE 'block' END) AS verdict FROM fits
"""
