"""Byte-level BPE by speculation: greedy longest matches first, exact merging only where they fail.

A word is cut greedily into its longest vocabulary entries. The proposal is the true encoding if and only
if no merge ever crosses one of its cuts, and a cut depends on its two neighbours alone. So all distinct
adjacent pairs of many words are tested together: both tokens are taken apart again, the younger one
first, and at each step the two pieces that face each other must not have a merge that would have come
before the piece was absorbed. Words with a failing pair go through the merges in order.

Only whole words of the tokenizer's own split are looked up, and known words are kept in a bounded table.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from lumenfield.llm.batches import annotate

#: how byte-level tokenizers cut text into words (a fixed public pattern)
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 3_000_000
#: bytes up to which merging scans all pairs
SHORT = 48
KIND = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
_NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge tree and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.ids = {bytes(letters[c] for c in k): v for k, v in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for k, v in self.ids.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.size = size
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.born = np.full(size, -1, np.int64)
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (m.split(" ") if isinstance(m, str) else m)
            x, y = (self.ids[bytes(letters[c] for c in s)] for s in (a, b))
            z = self.ids[self.bytes[x] + self.bytes[y]]
            ranks.setdefault((x, y), (rank, z))
            if self.born[z] < 0:
                self.born[z], self.left[z], self.right[z] = rank, x, y
        self.ranks = ranks
        self.rank = {pair: r for pair, (r, _) in ranks.items()}
        self.made = {r: z for r, z in ranks.values()}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        keys = np.array([x * size + y for x, y in ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in ranks.values()], np.int64)[order]
        self.proper = self._proper()
        #: length of the longest proper entry by its first two bytes
        self.reach: dict[bytes, int] = {}
        for k in self.proper:
            self.reach[k[:2]] = max(self.reach.get(k[:2], 1), len(k))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(x) for x in self.bytes])
        self.offset = np.cumsum(self.length) - self.length

    def _proper(self) -> dict[bytes, int]:
        """Entries that encode to themselves; only these may be proposed."""
        made = np.flatnonzero(self.born >= 0)
        good = np.ones(self.size, bool)
        good[made] = self.compatible(self.left[made], self.right[made], 2 * self.born[made])
        for t in made[np.argsort(self.born[made])]:
            good[t] &= good[self.left[t]] & good[self.right[t]]
        return {k: v for k, v in self.ids.items() if good[v]}

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins the end of token x to the start of token y (before ``until``, twice a rank).

        ``until`` is doubled so that equal ranks compare by position: of two places with the same merge the
        left one comes first, so a piece absorbed on the right side yields to the crossing merge.
        """
        x, y = np.asarray(x, np.int64).copy(), np.asarray(y, np.int64).copy()
        until = np.full(len(x), 2 * _NEVER) if until is None else np.asarray(until, np.int64).copy()
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            a, b = x[open_], y[open_]
            good[open_] = 2 * self.rank_of(a, b) >= until[open_]
            undo_right = self.born[b] >= self.born[a]
            deeper = good[open_] & (np.maximum(self.born[a], self.born[b]) >= 0)
            until[open_] = np.where(undo_right, 2 * self.born[b] + 1, 2 * self.born[a])
            x[open_] = np.where(undo_right | ~deeper, a, self.right[a])
            y[open_] = np.where(undo_right & deeper, self.left[b], b)
            open_ = open_[deeper]
        return good

    def propose(self, word: bytes) -> list[int]:
        """Longest proper vocabulary entry at each place; single bytes are always entries."""
        find, reach, n = self.proper.get, self.reach.get, len(word)
        out, i = [], 0
        while i < n:
            j = i + reach(word[i : i + 2], 1)
            if j > n:
                j = n
            while (t := find(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        if len(word) > SHORT:
            return self._merge_long(word)
        find, never, made = self.rank.get, int(_NEVER), self.made
        token = list(map(self.byte_id.__getitem__, word))
        ranked = [find(p, never) for p in zip(token, token[1:])]  # noqa: B905
        while ranked:
            best = min(ranked)
            if best == never:
                break
            i = ranked.index(best)
            token[i] = made[best]
            del token[i + 1], ranked[i]
            if i:
                ranked[i - 1] = find((token[i - 1], token[i]), never)
            if i < len(ranked):
                ranked[i] = find((token[i], token[i + 1]), never)
        return token

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, for words of any length."""
        token: list[int] = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, token[i], token[i + 1]) for i in range(n - 1) if (r := self.ranks.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = self.ranks[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := self.ranks.get((token[i], token[k])):
                    heapq.heappush(heap, (r[0], i, token[i], token[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((token[h], token[i]))):
                heapq.heappush(heap, (r[0], h, token[h], token[i]))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word: proposals, one test of all distinct adjacent pairs, merging of the rest."""
        found = [self.propose(w) for w in words]
        size = np.array([len(x) for x in found])
        if not len(size) or size.max() < 2:
            return found
        flat = np.fromiter((t for x in found for t in x), np.int64, int(size.sum()))
        cut = np.ones(len(flat), bool)
        cut[np.cumsum(size) - 1] = False  # no pair across two words
        at = np.flatnonzero(cut)
        key, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad = ~self.compatible(key // self.size, key % self.size)[back]
        for i in np.unique(np.repeat(np.arange(len(size)), size)[at[bad]]):
            found[i] = self.merge(words[i])
        return found

    def decode(self, ids: np.ndarray) -> str:
        size = self.length[ids]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.offset[ids] - first, size)
        return self.flat[at].tobytes().decode("utf-8", "replace")


class Encoder:
    """Whole texts to ids. Known words are kept by their 64-bit hash in sorted arrays, about 40 bytes a word."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(WORDS)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.letters = byte_letters()
        self.forget()
        self.seen: set[str] = set()
        self.odd: set[str] = set()

    def note_characters(self, texts: list[str]) -> None:
        """Characters that this regex engine classes otherwise than the tokenizers library: newer or older Unicode."""
        new = set().union(*texts) - self.seen if texts else set()
        if not new:
            return
        self.seen |= new
        line = "".join(sorted(new))
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            theirs = set("".join(x for x, _ in pre_tokenizers.Split(Regex(kind), "removed").pre_tokenize_str(line)))
            self.odd |= theirs ^ {c for c in new if not regex.match(kind, c)}

    def words(self, part: str) -> list[str]:
        if self.odd and not self.odd.isdisjoint(part):
            return [bytes(self.letters[c] for c in w).decode() for w, _ in self.library.pre_tokenize_str(part)]
        return self.split.findall(part)

    def forget(self) -> None:
        self.hash, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split_texts(self, texts: list[str]) -> list[list[str]]:
        """Words of each text; special tokens are words of their own."""
        rows: list[list[str]] = []
        for text in texts:
            if self.special and any(s in text for s in self.vocabulary.special):
                row = []
                for i, part in enumerate(self.special.split(text)):  # special tokens stand at odd places
                    row += [part] if i % 2 else self.words(part)
            else:
                row = self.words(text)
            rows.append(row)
        return rows

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts behind each other, and the n + 1 places where each text's begin."""
        self.note_characters(texts)
        rows = self.split_texts(texts)
        count = np.array([len(r) for r in rows], np.int64)
        words = [w for r in rows for w in r]
        # Python hashes the stored bytes of a string, whatever their width, so the length tells "15" from U+3531
        key = np.fromiter(map(hash, words), np.int64, len(words)) ^ (np.fromiter(map(len, words), np.int64, len(words)) * 0x1E3779B97F4A7C15)
        hashes, where, back = np.unique(key, return_index=True, return_inverse=True)
        row = self._rows(hashes, words, where)[back]
        size = self.size[row]
        total = np.cumsum(size)
        first = np.cumsum(self.size) - self.size
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(first[row] - (total - size), size)]
        return ids, np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(count)])]

    def _rows(self, hashes: np.ndarray, words: list[str], where: np.ndarray) -> np.ndarray:
        """Rows of known words; unknown ones are encoded and added."""
        if len(self.hash) > CACHE:
            self.forget()
        at = np.searchsorted(self.hash, hashes)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            special = self.vocabulary.special
            fresh = [words[i] for i in where[new].tolist()]
            plain = iter(self.vocabulary.encode_words([w.encode() for w in fresh if w not in special]))
            made = [[special[w]] if w in special else next(plain) for w in fresh]
            row = len(self.size) + np.arange(len(new))
            self.size = np.concatenate([self.size, [len(x) for x in made]])
            self.ids = np.concatenate([self.ids, np.fromiter((t for x in made for t in x), np.int32)])
            self.hash, self.row = np.insert(self.hash, at[new], hashes[new]), np.insert(self.row, at[new], row)
            at = np.searchsorted(self.hash, hashes)
        return self.row[at]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "bpe", carry: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the token ids of the whole text, and the text decoded from those ids.

    The ids equal those of the tokenizers library for the byte-level file at ``path`` (no special tokens
    added, no truncation, no padding); special tokens that stand in a text become their ids. A null or
    empty text has no ids and decodes to the empty string. Rows are independent: repeated rows give
    repeated results, other columns pass through, an existing column ``out`` is replaced. Memory follows
    the block of texts, the longest text and the bounded cache.
    """

    def run(texts: pa.Array) -> pa.Array:
        e = encoder(path)
        ids, first = e.encode(texts.fill_null("").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()))
        decoded = [e.vocabulary.decode(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])

    return annotate(df, text, out, KIND, run, carry)
