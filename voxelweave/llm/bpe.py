"""Byte-level BPE in numpy: many short words are merged at once.

A word is a row of part ids with the ranks of its adjacent pairs beside it. One step scans each row for its
minimum rank, deletes that boundary and refreshes the two ranks beside it; rows without a rank are finished.
Words over ``SHORT`` bytes use a heap of ranks over linked parts instead, so that their time stays near linear.
"""

from __future__ import annotations

import gc
import heapq
import json
from collections import defaultdict

import numpy as np
import regex

#: The public pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 48
#: Entries of a cache before it is emptied; a cache changes no result.
CACHE = 600_000
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """encode: texts to ids as little-endian unsigned 32-bit bytes; decode: the way back."""

    def __init__(self, spec: str) -> None:
        spec_ = json.loads(spec)
        vocab, merges = spec_["model"]["vocab"], spec_["model"]["merges"]
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.specials = {x["content"]: x["id"] for x in spec_["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = as_bytes(token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_at = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        n = 256
        self.first = self.ranks(np.repeat(self.byte_ids, n), np.tile(self.byte_ids, n)).reshape(n, n)
        self.pattern = regex.compile(PATTERN)
        #: A space with white space before and after it: there the pattern looks beyond single spaces.
        self.joined = regex.compile(r"(?<=\s) (?=\s|\Z)")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], NONE)

    def merge_short(self, raw: list[bytes]) -> list[bytes]:
        """The ids of words that all have the same length."""
        n, out = len(raw[0]), [b""] * len(raw)
        octets = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), n)
        parts, ranks, who = self.byte_ids[octets], self.first[octets[:, :-1], octets[:, 1:]], np.arange(len(raw))
        while len(who):
            width = parts.shape[1]
            if width > 1:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(who)), at]
                done = best == NONE
            else:
                done = np.ones(len(who), bool)
            if done.any():
                flat, size = parts[done].astype("<u4").tobytes(), 4 * width
                for k, w in enumerate(who[done].tolist()):
                    out[w] = flat[k * size : (k + 1) * size]
                if done.all():
                    break
                live = ~done
                parts, ranks, who, at, best = parts[live], ranks[live], who[live], at[live], best[live]
            rows = np.arange(len(who))
            parts[rows, at] = self.merged[best]
            cols = np.arange(width - 1)
            parts = np.take_along_axis(parts, cols + (cols > at[:, None]), 1)
            if width == 2:
                continue
            ranks = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] >= at[:, None]), 1)
            for beside, ok in ((at - 1, at > 0), (at, at < width - 2)):
                r, c = rows[ok], beside[ok]
                ranks[r, c] = self.ranks(parts[r, c], parts[r, c + 1])
        return out

    def merge_long(self, raw: bytes) -> bytes:
        parts = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        none = int(NONE)
        heap = [(r, i) for i, r in enumerate(ranks) if r != none]
        heapq.heapify(heap)
        ranks.append(none)
        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            j = after[i]
            parts[i], after[i], ranks[j] = int(self.merged[r]), after[j], none
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    ranks[k] = none if after[k] < 0 else int(self.ranks(np.array([parts[k]]), np.array([parts[after[k]]]))[0])
                    if ranks[k] != none:
                        heapq.heappush(heap, (ranks[k], k))
        out, i = [], 0
        while i >= 0:
            out.append(parts[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def add_words(self, words: set[str]) -> None:
        by_size = defaultdict(list)
        for w in words:
            by_size[len(raw := w.encode())].append((w, raw))
        for size, found in by_size.items():
            if size > SHORT:
                self.words.update((w, self.merge_long(raw)) for w, raw in found)
            else:
                self.words.update(zip((w for w, _ in found), self.merge_short([raw for _, raw in found]), strict=True))

    def add_pieces(self, cache: dict[str, bytes], pieces: list[str], before: str) -> None:
        """Put these pieces, each one with `before` ahead of it, into the cache."""
        found = [(before + x,) if x.isalpha() else self.pattern.findall(before + x) for x in pieces]
        if missing := {w for ws in found for w in ws} - self.words.keys():
            self.add_words(missing)
        get = self.words.__getitem__
        for x, ws in zip(pieces, found, strict=True):
            cache[x] = get(ws[0]) if len(ws) == 1 else b"".join([get(w) for w in ws])
        for w in [w for w in missing if len(w) > 4 * SHORT]:
            del self.words[w]

    def parts_of(self, text: str) -> list[str]:
        """A text cut at the strings of special tokens, which stay as parts."""
        return self.split.split(text) if self.split and any(s in text for s in self.specials) else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as `_encode` says; the cycle collector rests meanwhile, for there are no cycles here."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; special tokens' strings become their ids, as the public library's default has it.

        The pattern always starts a match where white space follows other text, so a part is cut at its single
        spaces and each piece is looked up. Where a space stands between white space, the pattern runs over the part.
        """
        for cache in (self.words, self.heads, self.tails):
            if len(cache) > CACHE:
                cache.clear()
        plan: list[list[tuple]] = []
        new: dict[int, set[str]] = {0: set(), 1: set(), 2: set()}
        caches = (self.heads, self.tails, self.words)
        for text in texts:
            steps: list[tuple] = []
            for k, part in enumerate(self.parts_of(text)):
                if k % 2:
                    steps.append(([], [np.array([self.specials[part]], "<u4").tobytes()], 0))
                elif self.joined.search(part):
                    steps.append(self._look_up(self.pattern.findall(part), 2, new))
                else:
                    pieces = part.split(" ")
                    steps += [self._look_up(pieces[:1], 0, new), self._look_up(pieces[1:], 1, new)]
            plan.append(steps)
        if new[2]:
            self.add_words(new[2])
        self.add_pieces(self.heads, list(new[0]), "")
        self.add_pieces(self.tails, list(new[1]), " ")
        out = []
        for steps in plan:
            for missing, parts, kind in steps:
                cache = caches[kind]
                for at, x in missing:
                    parts[at] = cache[x]
            out.append(b"".join([b"".join(parts) for _, parts, _ in steps]))
        for kind, cache in enumerate(caches):
            for x in [x for x in new[kind] if len(x) > 4 * SHORT]:
                del cache[x]
        return out

    def _look_up(self, pieces: list[str], kind: int, new: dict[int, set[str]]) -> tuple[list[tuple[int, str]], list, int]:
        """The ids of the pieces, with the places of those to be filled in later."""
        parts = list(map((self.heads, self.tails, self.words)[kind].get, pieces))
        missing = [(at, pieces[at]) for at, x in enumerate(parts) if x is None] if None in parts else []
        new[kind].update([x for _, x in missing])
        return missing, parts, kind

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens' strings included; broken UTF-8 becomes U+FFFD."""
        return self.decode_ids(np.frombuffer(ids, "<u4").tolist())

    def decode_ids(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_built: dict[int, ByteBpe] = {}


def shared(spec: str) -> ByteBpe:
    """One coder for each worker process and vocabulary."""
    if (key := hash(spec)) not in _built:
        _built.clear()
        _built[key] = ByteBpe(spec)
    return _built[key]
