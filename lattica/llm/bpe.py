"""BPE encoding and decoding by speculation and verification.

For each new word a greedy longest match proposes tokens. That proposal is the
true encoding if every token is what merging makes of its own characters and
if every adjacent pair is compatible: no merge across the seam would have come
before the merges that built the two tokens. Pairs are tested together, with
numpy; only words with a failing pair are merged exactly.

Words and their ids are kept per Python worker (``CACHE`` words at most, then
begun anew), so a repeated word costs one look-up. The text itself stays where
Spark read it: one Arrow pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame

from .common import small

#: Chunks of text, and words, that a worker remembers before it begins anew, and
#: their characters.
CACHE, CACHE_TEXT = 250_000, 16 << 20
#: Fixed value: White_Space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE with word ends, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.symbols = {b: c for b, c in enumerate(byte_symbols())}
        self.reach: dict[str, int] = {}  # the longest token by its first two characters
        for t in self.ids:
            bare = t.removesuffix(self.end) if self.end else t
            self.reach[bare[:2]] = max(self.reach.get(bare[:2], 1), len(bare))
        size = max(self.names) + 1
        rank = {}
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.born = np.zeros(size, dtype=np.int64)  # the merge that makes a token; 0: a character
        for k, (a, b) in enumerate((m.split(" ") if isinstance(m, str) else m) for m in model["merges"]):
            i, j, made = self.ids[a], self.ids[b], self.ids[a + b]
            rank[i, j] = (k + 1, made)
            if self.born[made] == 0:
                self.born[made], self.left[made], self.right[made] = k + 1, i, j
        self.rank = rank
        keys = np.array([i << 32 | j for i, j in rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in rank.values()], dtype=np.int64)[order]
        self.right_edge, self.left_edge = self._edges(self.right), self._edges(self.left)
        self.sound = self._sound()

    def _edges(self, child: np.ndarray) -> np.ndarray:
        """Each token, its outer part, the outer part of that, and so on; -1 beyond."""
        steps = [np.arange(len(child))]
        while (steps[-1] >= 0).any():
            steps.append(np.where(steps[-1] >= 0, child[steps[-1]], -1))
        return np.stack(steps[:-1], axis=1)

    def _crossing(self, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Whether some merge across the seam a|b comes too early.

        Parts x of a and y of b lie at the seam until the merges that take them
        up. The merge (x, y) happens if it comes before both; with equal ranks
        the left one is first. ``whole``: the limit for (a, b) themselves.
        """
        found = np.zeros(len(a), dtype=bool)
        for p in range(self.right_edge.shape[1]):
            x = self.right_edge[a, p]
            if (x < 0).all():
                break
            until_x = self.born[self.right_edge[a, p - 1]] if p else whole
            for q in range(self.left_edge.shape[1]):
                y = self.left_edge[b, q]
                ok = (x >= 0) & (y >= 0)
                if not ok.any():
                    break
                key = x << 32 | y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = self.key_rank[at]
                until_y = self.born[self.left_edge[b, q - 1]] if q else whole + 1
                found |= ok & (self.keys[at] == key) & (rank < until_x) & (rank < until_y + (q > 0))
        return found

    def _sound(self) -> np.ndarray:
        """Tokens that merging makes of their own characters."""
        good = np.ones(len(self.born), dtype=bool)
        made = np.flatnonzero(self.born)
        made = made[np.argsort(self.born[made])]
        bad = self._crossing(self.left[made], self.right[made], self.born[made])
        for t, b in zip(made, bad):
            good[t] = not b and good[self.left[t]] and good[self.right[t]]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        limit = np.full(len(a), 1 << 40, dtype=np.int64)
        return ~self._crossing(a, b, limit)

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; ``word`` is in byte symbols, without its end mark."""
        out, at, n, ids, reach = [], 0, len(word), self.ids, self.reach
        while at < n:
            stop = at + reach.get(word[at : at + 2], 1)
            if stop >= n:
                i = ids.get(word[at:] + self.end)
                if i is not None:
                    out.append(i)
                    break
                stop = n - 1
            while (i := ids.get(word[at:stop])) is None:
                stop -= 1
            out.append(i)
            at = stop
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging, lowest rank first, then from the left.

        Parts are linked to their neighbours, and pairs wait in a heap, so a
        word of n characters takes about n log n steps.
        """
        parts = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.end]]
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A rank stands for one pair, so rank and place say all.
        heap = [r[0] << 32 | k for k, pair in enumerate(zip(parts, parts[1:])) if (r := rank.get(pair))]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            k = top & 0xFFFFFFFF
            j = after[k]
            r = rank.get((parts[k], parts[j])) if j < n else None
            if r is None or r[0] != top >> 32:
                continue  # the pair has gone since
            made = r[1]
            parts[k], parts[j] = made, -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if r := rank.get((made, parts[j])):
                    push(heap, r[0] << 32 | k)
            i = before[k]
            if i >= 0 and (r := rank.get((parts[i], made))):
                push(heap, r[0] << 32 | i)
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words in byte symbols; all pairs are tested at once."""
        proposals = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposals), dtype=np.int64, count=len(words))
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        fails = np.zeros(len(words), dtype=bool)
        np.logical_or.at(fails, owner, ~self.sound[flat])
        inner = owner[:-1] == owner[1:]
        a, b = flat[:-1][inner], flat[1:][inner]
        keys, back = np.unique(a << 32 | b, return_inverse=True)
        np.logical_or.at(fails, owner[:-1][inner], ~self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back])
        for k in np.flatnonzero(fails):
            proposals[k] = self.merge(words[k])
        return proposals


SPACES = regex.compile(f"[{SPACE}]+")
#: The pieces of a normalised text; white space between them is dropped.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


class Encoder:
    """Texts to ids and back, for lower-casing word vocabularies."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.odd = re.compile("[\x1c-\x1f]")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocab.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(32)]

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at white space."""
        if not text.isascii():
            # Lowered character by character: a capital sigma has one form.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split() takes four control characters for spaces.
        return [c for c in SPACES.split(text) if c] if self.odd.search(text) else text.split()

    def learn(self, chunks: set[str]) -> None:
        """Encode all new chunks (texts without spaces) together."""
        if len(self.known) + len(chunks) > CACHE or self.held > CACHE_TEXT:
            self.known, self.held = {}, 0
        if len(self.words) > CACHE or not self.held:
            self.words = {}
        known, by_word, names = self.known, self.words, self.vocab.names
        chunks = [c for c in chunks if c not in known]
        self.held += sum(map(len, chunks))
        pieces = [PIECES.findall(c) for c in chunks]
        words = list({w for p in pieces for w in p if w not in by_word})
        coded = self.vocab.encode_words([w if w.isalnum() and w.isascii() else w.encode().decode("latin-1").translate(self.vocab.symbols) for w in words])
        for w, ids in zip(words, coded):
            by_word[w] = (self.pack[len(ids)](*ids) if len(ids) < 32 else np.array(ids, dtype="<u4").tobytes(), " ".join([names[i] for i in ids]).encode())
        for c, p in zip(chunks, pieces):
            if len(p) == 1:
                known[c] = by_word[p[0]]
            else:
                got = [by_word[w] for w in p]
                known[c] = (b"".join([g[0] for g in got]), b" ".join([g[1] for g in got]))

    def parts(self, text: str) -> list[tuple[bool, list[str] | str]]:
        """The text between special tokens as chunks, and those tokens."""
        if "<|" not in text:
            return [(False, self.chunks(text))]
        return [(True, p) if k % 2 else (False, self.chunks(p)) for k, p in enumerate(self.marks.split(text))]

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (little-endian, 32 bits) and its decoded text in UTF-8.

        Decoding puts a space between the tokens' names.
        """
        split = [self.parts(t) for t in texts]
        self.learn({c for parts in split for special, p in parts if not special for c in p})
        known, special = self.known, self.vocab.special
        for parts in split:
            got = []
            for is_special, p in parts:
                got += [(special[p].to_bytes(4, "little"), p.encode())] if is_special else [known[c] for c in p]
            yield b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode ``text`` of ``docs`` (``doc_id``, ``text``).

    Null and empty texts have no tokens. Rows are taken as they come: repeated
    rows give repeated results and other columns are ignored. ``with_ids`` adds
    the ids and the decoded text themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in small(batches):
            got = list(enc.batch([t or "" for t in b["text"].to_pylist()]))
            columns = {
                "doc_id": b["doc_id"],
                "n_tokens": pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in got], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i, _ in got], pa.list_(pa.int64()))
                columns["decoded"] = pa.array([d.decode() for _, d in got], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + ", ids array<long>, decoded string" * with_ids)
