"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens finds, in one pass over a word, the
longest token that starts at each place. The encoder appends longest matches,
falls back to the next shorter token where the pair with the token before isn't
one that merging would leave side by side, and steps back where no token fits;
each place is given up at most once, so the work is linear in the word.
Decoding gathers token bytes from one blob through an offset table.

Short words and their ids are kept from text to text in caches that are bounded
in entries and in bytes.

Defined cases: a null text is empty and has no ids; special tokens in a text
become their ids; equal rows give equal rows; an empty table gives an empty
result; texts and words of any length are processed whole; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Fixed value: characters that count as white space in the vocabulary's word pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the word pattern of byte-level vocabularies.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: White space and what follows it: words never reach over such a cut.
CHUNK = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Entries that each cache may hold, and the longest word or chunk (in characters) that is kept.
CACHE, LONGEST = 250_000, 64


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Maps a chunk of text to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        spelled = {t: bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        #: Token bytes by id: blob[offset[i]:offset[i + 1]].
        by_id = [b""] * size
        for t, i in vocab.items():
            by_id[i] = spelled.get(t, t.encode())
        for t, i in self.special.items():
            by_id[i] = t.encode()
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in by_id], out=self.offset[1:])
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)

        # Ranks: single bytes first, then results of merges in merge order.
        singles = sorted({b: t for t, b in spelled.items() if len(b) == 1}.items())
        self.rank_id = [vocab[t] for _, t in singles]
        rank = {b: r for r, (b, _) in enumerate(singles)}
        self.length = [1] * len(singles)
        self.parts = [(r, r) for r in range(len(singles))]
        self.merged: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            left, right = (spelled[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = left + right
            if whole not in rank:
                rank[whole] = len(self.rank_id)
                self.rank_id.append(vocab["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")])
                self.length.append(len(whole))
                self.parts.append((rank[left], rank[right]))
                self.merged[rank[left], rank[right]] = rank[whole]
        self.shorter = [next((rank[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in rank), -1) for b in rank]
        self.tokens = ahocorasick.Automaton()
        for b, r in rank.items():
            self.tokens.add_word(b.decode("latin-1"), r)
        self.tokens.make_automaton()
        self.side_by_side: dict[tuple[int, int], bool] = {}
        #: Chunks that came when the cache was full, and words inside chunks.
        self.late: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.word = regex.compile(WORD)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens side by side.

        Undo merges from the latest on, on either side of the border; if a pair
        that meets at the border would have merged earlier than what is undone,
        the border wouldn't be there.
        """
        key = (left, right)
        known = self.side_by_side.get(key)
        if known is not None:
            return known
        bound, answer = len(self.rank_id) + 1, True
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < bound:
                answer = False
                break
            singles = self.parts[left][0] == left, self.parts[right][0] == right
            if all(singles):
                break
            if not singles[0] and (left > right or singles[1]):
                bound, left = left, self.parts[left][1]
            elif not singles[1]:
                bound, right = right + 1, self.parts[right][0]
        if len(self.side_by_side) >= CACHE:
            self.side_by_side.clear()
        self.side_by_side[key] = answer
        return answer

    def encode_word(self, word: bytes) -> list[int]:
        n, length = len(word), self.length
        longest: list[int] = [-1] * n
        for end, r in self.tokens.iter(word.decode("latin-1")):
            start = end - length[r] + 1
            if longest[start] < 0 or length[r] > length[longest[start]]:
                longest[start] = r
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
        return [self.rank_id[r] for r in out]

    def __missing__(self, chunk: str) -> bytes:
        packed = self.late.get(chunk)
        if packed is None:
            packed = b"".join([self.words.get(w) or self.keep(w) for w in self.word.findall(chunk)])
            if len(chunk) > LONGEST:
                return packed
            if len(self) < CACHE:
                self[chunk] = packed
            else:
                if len(self.late) >= CACHE // 4:
                    self.late.clear()
                self.late[chunk] = packed
        return packed

    def keep(self, word: str) -> bytes:
        packed = b"".join([i.to_bytes(4, "little") for i in self.encode_word(word.encode())])
        if len(word) <= LONGEST:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed."""
        if self.cut is None or "<" not in text:
            return b"".join(map(self.__getitem__, CHUNK.findall(text)))
        parts = self.cut.split(text)

        def of(i: int, part: str) -> bytes:
            if i % 2:
                return self.special[part].to_bytes(4, "little")
            return b"".join(map(self.__getitem__, CHUNK.findall(part)))

        return b"".join(of(i, part) for i, part in enumerate(parts))

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids, gathered in slices of bounded size."""
        ids, out = np.frombuffer(packed, "<u4"), []
        for k in range(0, len(ids), 1 << 16):
            some = ids[k : k + (1 << 16)]
            sizes = self.offset[some + 1] - self.offset[some]
            ends = np.cumsum(sizes)
            if len(ends):
                out.append(self.blob[np.arange(ends[-1]) + np.repeat(self.offset[some] - ends + sizes, sizes)].tobytes())
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; rows stay in place."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("text"):
                packed = bpe.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed).decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id"), F.col("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
