"""Operator 11: byte-level BPE as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

A text is cut at the special tokens it spells, each part at the pattern's words, each word into bytes that are merged by the list's order.
Of a text only a slice, of a word only a window is held beside the tokens: a window's tokens that end farther from its end
than the lookahead can't change whatever follows, so they are emitted, and the next window begins behind them. (A merge never crosses the
boundary of two final tokens, so what follows such a boundary is encoded as if it stood alone.)

Lookahead. A merge (x, y) across a place is settled by what follows only if that decides whether y is there. y is lost only to an earlier
merge across its right end, whose left side is y or a right part of y that has not yet been merged into y; that merge's right side
in turn is lost to a still earlier one, and so on. So reach(j) = len(y_j) + the largest reach of such earlier merges, computed in the list's
order; the largest reach is the sufficient lookahead. It is 0 for an empty list.

Decoding turns ids into bytes and these into text as they come: invalid sequences give U+FFFD, one per longest valid beginning,
and a character may be split between tokens.

The path to the tokenizer's file (JSON of a byte-level BPE with the common pattern of seven alternatives) is a parameter; files with a
normalizer, another kind of pre-tokenizer, or merges that use pieces made later are refused. Special tokens in a text are recognised, as the
library does by default; ids that the vocabulary lacks decode to nothing.

Null and empty texts have no ids and decode to an empty text. Each row is encoded on its own: repeated rows get equal results, rows
without doc_id are kept, an empty table gives an empty result, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# The pattern of byte-level BPE, as published with the vocabulary.
# ASCII has the same words by the same pattern with its own classes, which is quicker.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Code points of a slice, bytes of a window (more where the lookahead asks for it), ids that are decoded at a time.
SLICE, WINDOW, IDS = 1 << 16, 1 << 12, 1 << 14
#: Words that a worker remembers with their ids, twice (the latest, and those before them), and the bytes of the longest.
REMEMBER, LONG = 100_000, 64
#: More than any rank; less than any id.
NEVER, GONE = 1 << 62, -2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_character() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, the other bytes for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Merges:
    """A vocabulary of bytes and its list of merges: ranks of pairs of ids, and the id that each makes."""

    def __init__(self, ids: dict[bytes, int], pairs: list[tuple[bytes, bytes]]) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.of_byte = [ids.get(bytes([b]), -1) for b in range(256)]
        made = {bytes([b]) for b in range(256)}
        for i, (x, y) in enumerate(pairs):
            if x not in made or y not in made:
                raise ValueError(f"merge {i} uses a piece that no earlier merge makes")
            made.add(x + y)
            self.rank.setdefault((ids[x], ids[y]), i)
            self.made.append(ids[x + y])
        self.lookahead = sufficient_lookahead(pairs)
        self.window = max(WINDOW, 2 * (self.lookahead + max((len(x + y) for x, y in pairs), default=1)))
        self.size = {i: len(t) for t, i in ids.items()}

    def merged(self, data: bytes) -> list[int]:
        """Ids of data by merges in the list's order, equal ones from the left."""
        out = [self.of_byte[b] for b in data]
        if len(out) > 64:
            return self._by_heap(out)
        get, made = self.rank.get, self.made
        ranks = [get(pair, NEVER) for pair in zip(out, out[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            k = ranks.index(best)
            out[k : k + 2] = [made[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((out[k], out[k + 1]), NEVER)
            if k:
                ranks[k - 1] = get((out[k - 1], out[k]), NEVER)
        return out

    def _by_heap(self, out: list[int]) -> list[int]:
        n, rank, made = len(out), self.rank, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k, p) for k, p in enumerate(zip(out, out[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            best, k, pair = heapq.heappop(heap)
            b = after[k]
            if b >= n or out[k] != pair[0] or out[b] != pair[1]:
                continue
            out[k], out[b] = made[best], GONE
            after[k] = c = after[b]
            if c < n:
                before[c] = k
                if (p := (out[k], out[c])) in rank:
                    heapq.heappush(heap, (rank[p], k, p))
            if (a := before[k]) >= 0 and (p := (out[a], out[k])) in rank:
                heapq.heappush(heap, (rank[p], a, p))
        return [t for t in out if t != GONE]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Ids of data, each as soon as nothing that follows can change it."""
        at, size = 0, self.size
        while len(data) - at > self.window:
            ids, sure, k = self.merged(data[at : at + self.window]), 0, 0
            while sure + size[ids[k]] <= self.window - self.lookahead:
                sure += size[ids[k]]
                k += 1
            yield ids[:k]
            at += sure
        yield self.merged(data[at:])


def sufficient_lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a boundary that decide it (see the module)."""
    makers: dict[bytes, list[int]] = {}
    #: By left side: indexes of its merges in order, and the largest reach up to each.
    by_left: dict[bytes, tuple[list[int], list[int]]] = {}
    most = 0

    def reach(token: bytes, before: int) -> int:
        at, tops = by_left.get(token, ((), ()))
        k = bisect_left(at, before)
        found = tops[k - 1] if k else 0
        for i in makers.get(token, ()):
            if i < before:
                found = max(found, reach(pairs[i][1], i))
        return found

    for j, (x, y) in enumerate(pairs):
        mine = len(y) + reach(y, j)
        most = max(most, mine)
        at, tops = by_left.setdefault(x, ([], []))
        at.append(j)
        tops.append(max(mine, tops[-1] if tops else 0))
        makers.setdefault(x + y, []).append(j)
    return most


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokenizer:
    """Encoder and decoder of a tokenizer's file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or spec["normalizer"] or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer and with the common pattern is supported")
        byte = byte_of_character()
        raw = lambda t: bytes(byte[c] for c in t)
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.merges = Merges(ids, [(raw(a), raw(b)) for a, b in pairs])
        self.bytes = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.in_unicode, self.in_ascii = regex.compile(PATTERN).findall, re.compile(ASCII).findall
        self.edge = regex.compile(r"\S(?=\s)").search
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.latest: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return self.in_ascii(text) if text.isascii() else self.in_unicode(text)

    def _ids(self, word: str) -> bytes:
        """Ids of a word, remembered if it is short."""
        ids = self.latest.get(word)
        if ids is not None:
            return ids
        ids = self.before.get(word)
        if ids is None:
            data = word.encode()
            if len(data) > LONG:
                return b"".join(map(_packed, self.merges.stream(data)))
            ids = _packed(self.merges.merged(data))
        if len(self.latest) >= REMEMBER:
            self.latest, self.before = {}, self.latest
        self.latest[word] = ids
        return ids

    def _slices(self, text: str) -> Iterator[str | int]:
        """Parts of text that are encoded on their own, in order, and ids of the special tokens between them. A space behind another
        character always begins a word."""
        at = 0
        while at < len(text):
            mark = self.marks.search(text, at) if self.marks else None
            end = mark.start() if mark else len(text)
            while end - at > SLICE and (m := self.edge(text, at + SLICE, end)):
                yield text[at : m.end()]
                at = m.end()
            yield text[at:end]
            at = end
            if mark:
                yield self.special[mark[0]]
                at = mark.end()

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids of text as little-endian unsigned 32-bit integers, slice by slice."""
        for part in self._slices(text):
            if isinstance(part, int):
                yield part.to_bytes(4, "little")
                continue
            get = self.latest.get
            words = self.words(part)
            found = list(map(get, words))
            if None in found:
                found = [ids or self._ids(word) for ids, word in zip(found, words, strict=True)]
            yield b"".join(found)

    def text_of(self, ids: np.ndarray) -> Iterator[str]:
        """Text of ids as far as it is settled, some thousand ids at a time."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for k in range(0, len(ids), IDS):
            yield state.decode(b"".join(map(lambda i: self.bytes.get(i, b""), ids[k : k + IDS].tolist())))
        yield state.decode(b"", final=True)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    """One per worker, with what it remembers."""
    return Tokenizer(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers)."""
    path = path or tokenizer_path()
    bounded_batches(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            ids = [b"".join(tokenizer.stream(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(codes: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text of a table (doc_id, ids); null ids decode to an empty text."""
    path = path or tokenizer_path()
    bounded_batches(codes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            texts = ["".join(tokenizer.text_of(np.frombuffer(i or b"", dtype="<u4"))) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return codes.select("doc_id", "ids").mapInArrow(work, f"doc_id {codes.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digests(codes: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a table (doc_id, ids, text)."""
    return codes.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
