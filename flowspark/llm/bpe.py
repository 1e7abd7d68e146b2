"""BPE encoding and decoding: prefix-sharing trie traversal.

The distinct words of a batch that are new to the worker go into a trie of
symbols.  A depth-first walk keeps, for every node, only the *last token* of the
encoding of the prefix that ends there: token t ends a prefix if t is a suffix of
it and the pair (last token of what precedes t, t) is stable, that is, no merge
across their border would have been applied before the two were complete.  For a
merge table in training order exactly one token qualifies, so the encoding of a
prefix that many words share is computed once, and a word's ids are read off by
following last tokens back to the root.

Texts are normalised and split as the vocabulary's file says.  Any character
whose handling could differ between this code and the tokenizers library goes
through the library's own normaliser and splitter, never through its encoder.

Defined results: null and empty texts encode to nothing and decode to the empty
string; repeated rows are encoded one by one; extra columns are ignored; an empty
table gives an empty one.  Whole texts are encoded; a word of any length is one
walk (time: its length times the longest token, memory: its length).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Words whose ids a task keeps, and ids of them; nodes of the trie that it keeps, and pairs of
#: tokens that its worker does.  These bound memory, not results.
KEPT_WORDS, KEPT_IDS, KEPT_NODES, KEPT_PAIRS = 220_000, 3_000_000, 300_000, 120_000
#: Longer words, and nodes of longer prefixes, aren't kept.
LONGEST_KEPT = DEEPEST = 64
#: Code points handled at once; longer batches are split between texts.
BLOCK = 4_000_000
#: Marks of special tokens, and of words that the library split; neither is in plain text.
_SPECIAL, _OWN = "\u2028", "\u2029"

#: Characters that normalisation and splitting are known to treat alike here: ASCII but for the
#: separators 1C-1F, and Latin letters with their marks composed.
_PLAIN = regex.compile(r"[^\x00-\x1B\x20-\x7E\xA1-\xA9\xAB\xAC\xAE-\xB1\xB4\xB6-\xB8\xBB\xBF-įĲ-ňŊ-ž‐-‧‰-⁞₠-₿]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: All of these but runs of letters, as a pattern of Arrow's for plain text.
_BETWEEN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\x09-\x0D\x20\p{L}\p{N}]+)"


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


class Vocabulary:
    """Merges of a vocabulary file, with the forests that the stability test needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.table = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {self.ids[a] << 20 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for pair, r in self.rank.items():
            a, b = pair >> 20, pair & 0xFFFFF
            self.parts.setdefault(self.ids[self.tokens[a] + self.tokens[b]], (a, b, r))
        self.letters = {b: c for b, c in _byte_alphabet().items()}
        self.translation = str.maketrans({chr(b): c for b, c in self.letters.items()})
        self.longest = max(len(t) for t in self.ids)
        self.stable: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        known: dict[int, bool] = {}
        self.whole = {t: i for t, i in self.ids.items() if self._is_whole(i, known)}
        self.spines = ({}, {})  # few of all tokens are needed again

    def spine(self, token: int, right: int) -> list[tuple[int, float]]:
        """Tokens on the border of `token` while it is being made, each with the rank of the merge that ends it."""
        known = self.spines[right]
        if (out := known.get(token)) is None:
            out, ends, t = [], float("inf"), token
            while True:
                out.append((t, ends))
                if t not in self.parts:
                    break
                *halves, ends = self.parts[t]
                t = halves[right]
            known[token] = out
        return out

    def is_stable(self, pair: int) -> bool:
        """Whether merging the symbols of tokens a, then b gives just these two; a << 20 | b is the pair.

        A merge over the border happens if its two sides exist together: before
        the left side is merged leftwards (a tie goes to the left), and not after
        the right side is merged rightwards.
        """
        if (out := self.stable.get(pair)) is None:
            rank, right, out = self.rank, self.spine(pair & 0xFFFFF, 0), True
            for x, x_ends in self.spine(pair >> 20, 1):
                for y, y_ends in right:
                    if (r := rank.get(x << 20 | y)) is not None and r < x_ends and r <= y_ends:
                        out = False
            if len(self.stable) > KEPT_PAIRS:
                self.stable.clear()
            self.stable[pair] = out
        return out

    def _is_whole(self, token: int, known: dict[int, bool]) -> bool:
        """Whether the symbols of a token merge to that token: its halves do, and no other merge crosses their border first."""
        if (out := known.get(token)) is None:
            if token in self.parts:
                a, b, _ = self.parts[token]
                others = ((self.rank.get(x << 20 | y), xe, ye) for x, xe in self.spine(a, 1) for y, ye in self.spine(b, 0) if (x, y) != (a, b))
                out = self._is_whole(a, known) and self._is_whole(b, known) and not any(r is not None and r < xe and r <= ye for r, xe, ye in others)
            else:
                out = True
            known[token] = out
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Trie:
    """Prefixes of distinct words as nodes, each with the last token of its encoding.

    A node is a number; `children` leads from a node and a letter to the next one,
    `tokens` and `starts` hold each node's last token and the depth at which that
    token begins.  Words come in sorted order, which is the depth-first order of the
    trie, so the path to the last node is at hand as a stack.  Nodes deeper than
    DEEPEST go when their word is done.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.children: dict[int, int] = {}
        self.tokens, self.starts = [0], [0]

    def encode(self, words) -> dict[str, list[int]]:
        """The ids of every distinct byte-level word."""
        vocab, children, tokens, starts, out = self.vocab, self.children, self.tokens, self.starts, {}
        ids, stable, is_stable, longest, suffix = vocab.whole, vocab.stable, vocab.is_stable, vocab.longest, vocab.suffix
        path, previous = [0], ""  # the nodes of the prefixes

        def step(text: str, end: int, stop: int) -> tuple[int, int]:
            """Last token, and its start, of the prefix with `end` letters; its symbols are those of text[:stop]."""
            extended = starts[path[end - 1]]
            for start in (extended, *range(end - 1, max(-1, end - 1 - longest), -1)):
                if (token := ids.get(text[start:stop])) is not None:
                    if not start:
                        return token, 0
                    pair = tokens[path[start]] << 20 | token
                    if (fits := stable.get(pair)) is None:
                        fits = is_stable(pair)
                    if fits:
                        return token, start
            raise ValueError(f"no token ends {text[:stop]!r}")

        for word in sorted(words):
            n, text = len(word), word + suffix
            common, most = 0, min(len(path) - 1, n - 1)
            while common < most and word[common] == previous[common]:
                common += 1
            del path[common + 1 :]
            node, kept = path[-1], len(tokens)
            for end in range(common + 1, n):
                link = node << 21 | ord(word[end - 1])
                if (node := children.get(link)) is None:
                    token, start = step(text, end, end)
                    node = len(tokens)
                    tokens.append(token)
                    starts.append(start)
                    if end <= DEEPEST:
                        children[link], kept = node, node + 1
                path.append(node)
            token, start = step(text, n, len(text))
            row = [token]
            while start:
                node = path[start]
                row.append(tokens[node])
                start = starts[node]
            row.reverse()
            out[word] = row
            previous = word
            if n > DEEPEST:
                del tokens[kept:], starts[kept:], path[DEEPEST + 1 :]
        return out


class Known:
    """Token ids of words: a row for each, its ids in one growing array; the most used ones are kept."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.used = self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def add(self, words: list[str], coded: list[list[int]]) -> np.ndarray:
        """The rows of new words."""
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        first = len(self.start)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.zeros(len(size), np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), "<u4", int(size.sum()))])
        self.rows.update((w, first + i) for i, w in enumerate(words) if len(w) <= LONGEST_KEPT)
        return np.arange(first, first + len(words))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows one after the other, where each row's ids begin, and the end)."""
        size = self.size[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.start[rows] - bounds[:-1], size) + np.arange(bounds[-1])], bounds

    def shrink(self) -> None:
        """Keep the most used half of KEPT_WORDS, if there are more or their ids too many."""
        if len(self.rows) <= KEPT_WORDS and len(self.ids) <= KEPT_IDS:
            return
        words, rows = list(self.rows), np.fromiter(self.rows.values(), np.int64, len(self.rows))
        best = np.argsort(-self.used[rows], kind="stable")[: KEPT_WORDS // 2]
        kept = rows[best]
        self.ids, bounds = self.gather(kept)
        self.rows = {words[k]: i for i, k in enumerate(best.tolist())}
        self.used, self.start, self.size = self.used[kept] // 2, bounds[:-1], np.diff(bounds)


class Encoder:
    """Encodes texts; keeps the ids of frequent words between batches."""

    def __init__(self, path: str):
        self.path, self.vocab = path, vocabulary(path)
        self.trie, self.known = Trie(self.vocab), Known()

    def _pieces(self, text: str) -> list[str]:
        """Byte-level words of a text without special tokens, by the library's own normaliser and splitter."""
        t = _library(self.path)
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))] if text else []

    def _marked(self, segments: list[str], plain: list[bool]) -> str:
        """The words of a text that isn't plain throughout, special tokens and the library's own words marked."""
        out = []
        for k, (segment, is_plain) in enumerate(zip(segments, plain)):
            if k % 2:
                out.append(f"{_SPECIAL}{self.vocab.added[segment]}")
            elif is_plain:
                out += _WORDS.findall(segment.lower())
            else:
                out += [_OWN + w for w in self._pieces(segment)]
        return " ".join(out)

    def _split(self, texts: list[str | None]) -> pa.LargeListArray:
        """The words of each text."""
        plain, odd, places = [], [], []
        for text in texts:
            segments = self.vocab.split_added.split(text or "") if self.vocab.split_added else [text or ""]
            fits = [not _PLAIN.search(x) and (x.isascii() or unicodedata.is_normalized("NFC", x)) for x in segments]
            is_odd = len(segments) > 1 or not fits[0]
            plain.append("" if is_odd else segments[0].lower())
            places.append(is_odd)
            if is_odd:
                odd.append(self._marked(segments, fits))
        spaced = pc.replace_substring_regex(pa.array(plain, pa.large_string()), _BETWEEN, r" \1 ")
        if odd:
            spaced = pc.replace_with_mask(spaced, pa.array(places), pa.array(odd, pa.large_string()))
        return pc.ascii_split_whitespace(spaced)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct words, marked ones among them."""
        if len(self.trie.tokens) > KEPT_NODES:
            self.trie = Trie(self.vocab)
        translation = self.vocab.translation
        plain = [w[1:] if w[:1] == _OWN else w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(translation) for w in words]
        coded = self.trie.encode({p for w, p in zip(words, plain) if p and w[0] != _SPECIAL})
        return [[] if not w else [int(w[1:])] if w[0] == _SPECIAL else coded[p] for w, p in zip(words, plain)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, start, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= BLOCK or end == len(texts):
                out += self._encode_block(texts[start:end])
                start, size = end, 0
        return out

    def _encode_block(self, texts: list[str | None]) -> list[bytes]:
        self.known.shrink()
        split = self._split(texts)
        coded = split.flatten().dictionary_encode()
        words, places = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        rows = np.fromiter(map(self.known.rows.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(new):
            own = [words[i] for i in new.tolist()]
            rows[new] = self.known.add(own, self._encode_words(own))
        self.known.used[rows] += np.bincount(places, minlength=len(rows))
        ids, bounds = self.known.gather(rows[places])
        cuts = bounds[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> str:
        """The text of ids; a vocabulary without a decoder joins its tokens by spaces."""
        return " ".join(map(self.vocab.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokens: bool = False) -> DataFrame:
    """`key`, n_tokens, ids_sha256 and decoded_sha256 of every text; with `tokens` also ids and decoded."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch, tool):
        coded = tool.encode_batch(batch.column(1).to_pylist())
        decoded = [tool.decode(x) for x in coded]
        out = {
            key: batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
        }
        return out | ({"ids": [np.frombuffer(x, "<u4").tolist() for x in coded], "decoded": decoded} if tokens else {})

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * tokens
    return map_batches(docs.select(key, text), run, schema, start=lambda: Encoder(path))
