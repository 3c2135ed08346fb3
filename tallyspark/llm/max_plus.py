"""Operator 10: SentencePiece encoding and decoding by a max-plus scan.

An encoding is the segmentation of a text into vocabulary pieces with the largest sum of scores: a path of largest weight in
max-plus algebra. A position's value is the largest, over the pieces that end there, of the piece's score plus the value of
the position where the piece begins; numpy computes it for all words of a batch at once, position by position.

No piece has a word mark behind another character, so words are independent, and a batch's distinct words are segmented once.
A giant text (more than GIANT code points) is dealt out in chunks, cut anywhere. Each chunk yields its boundary-state transfer
matrix: entry [a, b] is the best score of the chunk if the piece before reaches a code points into it and its own last piece
reaches b points beyond it. Matrices combine associatively: chunks to segments, segments to the text. From the values at the
boundaries each segment, then each chunk learns its states, and every chunk is backtraced on its own.

A character in no piece becomes the byte pieces of its UTF-8 form. Scores are fixed-point numbers (SCALE parts of 1). A small fixed
amount per piece tells most segmentations of equal score apart; what still ties goes to the longest last piece in words, and to the
smaller state at the boundaries of chunks, so results don't depend on the run.

That is the encoding of unigram models. A model that was trained for merges (BPE) also has scores, but its encoding applies merges
greedily, which no sum of scores reproduces: its words are encoded by their merges, and giant texts are dealt out in chunks that are
cut at word marks.

The path to a SentencePiece model is a parameter. Space is the word mark U+2581, which the model can't tell from a space:
decoding gives a space for either. Null texts have null ids, empty texts none. Repeated rows get equal results; an empty table gives an
empty result; other columns are ignored, whatever their names. Models with user-defined pieces, which stand outside of all scores and
merges, are refused.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, spread

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
GIANT, CHUNK, SEGMENT = 65_536, 2_048, 256
#: Distinct words that a worker remembers, the first it meets; longer words than LONG points take the chunked form inside their task.
REMEMBER, LONG = 100_000, 48
SCALE = 1 << 28
#: No score is below FLOOR; a character without a piece costs UNKNOWN.
FLOOR, UNKNOWN = -100_000, -200_000
NEVER = np.int64(-(1 << 61))
_U = np.uint64
_POINT = _U(0x9E3779B97F4A7C15)
#: The upper 17 bits of a hash lead to the piece's bucket, the upper 20 to a sieve that most strings which are no piece don't pass.
_BUCKET, _SIEVE = _U(64 - 17), _U(64 - 20)
_WORD = re.compile(" +[^ ]*")


class Pieces:
    """Vocabulary of a SentencePiece model as a hash table from strings of code points to scores and ids."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.byte_ids, self.bytes = np.zeros(256, dtype=np.int32), []
        text: list[tuple[str, float, int]] = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_ids[b] = i
                self.bytes.append(bytes([b]))
            elif p.type == 1:
                text.append((p.piece.replace("▁", " "), p.score, i))
                self.bytes.append(text[-1][0].encode())
            elif p.type == 4:
                raise ValueError(f"user-defined piece {p.piece!r}: such models are not supported")
            else:
                self.bytes.append(b"")
        #: What this worker remembers of words: their ids; of models of merges also those that don't decode to themselves.
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.byte_sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        #: Score of each piece, for models of merges only.
        self.merges = {t: s for t, s, _ in text} if proto.trainer_spec.model_type == 2 else None
        self.id_of = {t: i for t, _, i in text}
        if self.merges is not None:
            self._pairs()
        self.longest = max(len(t) for t, _, _ in text)
        assert not any(" " in t.lstrip(" ") for t, _, _ in text), "a piece has a word mark behind another character"
        keys = np.array([hash_points(np.array([ord(c) + 1 for c in t], dtype=_U)) for t, _, _ in text], dtype=_U)
        order = np.argsort(keys)
        self.keys = keys[order]
        buckets = (self.keys >> _BUCKET).astype(np.int64)
        self.first = np.searchsorted(buckets, np.arange(1 << 17)).astype(np.int32)
        self.probes = int(np.bincount(buckets).max())
        self.keys = np.r_[self.keys, np.zeros(self.probes, dtype=_U)]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys >> _SIEVE).astype(np.int64)] = True
        apart = (keys * _U(0xD6E8FEB86659FD93) >> _U(54)).astype(np.int64)
        scores = np.array([round(max(FLOOR, s) * SCALE) for _, s, _ in text], dtype=np.int64) - apart
        self.scores = np.r_[scores[order], np.full(self.probes, NEVER)]
        self.ids = np.r_[np.array([i for _, _, i in text], dtype=np.int32)[order], np.zeros(self.probes, dtype=np.int32)]

    def _pairs(self) -> None:
        """Which two neighbours make a piece: symbols (pieces, and characters of pieces) numbered, keys of pairs sorted, the places of their
        pieces in the order of scores, and the symbols they make."""
        self.symbol_of = {t: i for i, t in enumerate([*self.merges, *({c for t in self.merges for c in t} - self.merges.keys())])}
        number = self.symbol_of
        self.piece_of = np.array([self.id_of.get(t, -1) for t in number], dtype=np.int64)
        place = {t: i for i, t in enumerate(sorted(self.merges, key=lambda t: -self.merges[t]))}
        found = [(number[t[:k]] << 32 | number[t[k:]], place[t], number[t]) for t in self.merges for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
        found.sort()
        key, rank, to = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.pair_keys = np.r_[key, np.int64(np.iinfo(np.int64).max)]
        self.pair_rank, self.pair_to = np.r_[rank, 0].astype(np.int32), np.r_[to, -1]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        at = self.first[(key >> _BUCKET).astype(np.int64)].astype(np.int64)
        out = np.full(key.shape, -1, dtype=np.int64)
        for k in range(self.probes):
            hit = self.keys[at + k] == key
            out[hit] = (at + k)[hit]
        return out


def hash_points(points: np.ndarray) -> np.uint64:
    """Hash of one string, from the sums that `arcs` also forms."""
    total = _U(0)
    with np.errstate(over="ignore"):
        for p in points:
            total = total * _POINT + spread_point(p)
        return finish(np.array([total]))[0]


def spread_point(p: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return p * _U(0xBF58476D1CE4E5B9)


def finish(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)


_loaded: dict[str, Pieces] = {}


def pieces(path: str, model: bytes) -> Pieces:
    """One vocabulary per worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(model)
    return _loaded[path]


def arcs(v: Pieces, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the columns' substrings that are pieces, by end: begin, end, which rows, scores, indexes of pieces; index -2 - point for
    a character that is no piece. points: rows of code points plus 1, 0 where a row has ended."""
    n, width = points.shape
    points = np.ascontiguousarray(points.T)
    p = spread_point(points.astype(_U))
    open_until = points != 0
    with np.errstate(over="ignore"):
        for end in range(1, width + 1):
            total, power = np.zeros(n, dtype=_U), _U(1)
            real = open_until[end - 1]
            for begin in range(end - 1, max(-1, end - 1 - v.longest), -1):
                total = total + p[begin] * power
                power = power * _POINT
                key = finish(total)
                maybe = v.sieve[(key >> _SIEVE).astype(np.int64)]
                if begin == end - 1:
                    rows = np.flatnonzero(real)
                    at = v.find(key[rows])
                    lone = at < 0
                    score = np.where(lone, np.int64(UNKNOWN * SCALE), v.scores[at])
                    at[lone] = -1 - points[begin][rows[lone]].astype(np.int64)
                else:
                    rows = np.flatnonzero(maybe & real)
                    at = v.find(key[rows])
                    hit = at >= 0
                    rows, at = rows[hit], at[hit]
                    score = v.scores[at]
                if len(rows):
                    yield begin, end, rows, score, at


def _better(best: np.ndarray, came: np.ndarray, which: np.ndarray, begin: int, end: int, rows: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
    value = best[begin, rows] + score
    better = value >= best[end, rows]  # arcs come from the shortest to the longest: of equal ones the longest stays, as in the library
    rows = rows[better]
    best[end, rows], came[end, rows], which[end, rows] = value[better], begin, at[better]


def _emit(v: Pieces, index: int) -> list[int]:
    return [int(v.ids[index])] if index >= 0 else v.byte_ids[list(chr(-2 - index).encode("utf-8", "surrogatepass"))].tolist()


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts])
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)
    return out


def encode_words(v: Pieces, some: list[str]) -> list[bytes]:
    """Ids of each word as the bytes of int32."""
    out: dict[str, bytes] = {}
    by_size = sorted(some, key=len)
    for i in range(0, len(by_size), 4096):
        part = by_size[i : i + 4096]
        width = len(part[-1])
        points = _codes(part, width)
        best = np.full((width + 1, len(part)), NEVER)
        best[0] = 0
        came, which = np.zeros((width + 1, len(part)), dtype=np.int16), np.zeros((width + 1, len(part)), dtype=np.int64)
        for arc in arcs(v, points):
            _better(best, came, which, *arc)
        # backtrace all words at once: step k holds each word's k-th piece from its end
        here, rows, steps = np.array([len(t) for t in part]), np.arange(len(part)), []
        while here.any():
            steps.append(np.where(here > 0, which[here, rows], -1))
            here = np.where(here > 0, came[here, rows], 0)
        if not steps:
            continue
        s = np.array(steps[::-1]).T
        used = s != -1
        raw, at = v.ids[np.maximum(s, 0)][used].tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out.update(zip(part, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
        for i in np.flatnonzero(s.min(axis=1) < -1).tolist():
            out[part[i]] = np.array([x for k in s[i].tolist() if k != -1 for x in _emit(v, k)], dtype=np.int32).tobytes()
    return [out.get(t, b"") for t in some]


def transfer(v: Pieces, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Transfer matrices of chunks: rows of code points, each the chunk's own `sizes` points and up to longest - 1 that follow."""
    k = v.longest
    n, width = points.shape
    value = np.full((width + 1, n, k), NEVER)
    for a in range(min(k, width + 1)):
        value[a, :, a] = 0
    for begin, end, rows, score, _ in arcs(v, points):
        own = begin < sizes[rows]
        rows, score = rows[own], score[own]
        value[end, rows] = np.maximum(value[end, rows], np.maximum(value[begin, rows] + score[:, None], NEVER))
    out = np.full((n, k, k), NEVER)
    for b in range(k):
        at = sizes + b
        ok = at <= width
        # a state that no piece of the chunk has reached from inside: the piece before spans all of a short chunk
        out[ok, :, b] = value[at[ok], np.flatnonzero(ok)]
    return out


def times(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Product in max-plus algebra, with unreachable entries kept at NEVER."""
    return np.maximum((m[..., :, :, None] + w[..., None, :, :]).max(axis=-2), NEVER)


def states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all boundaries of consecutive matrices on the best path from state entry to state leave. Only differences count,
    so values are held near 0 however long the text."""
    forward = [np.where(np.arange(len(matrices[0])) == entry, 0, NEVER)]
    for m in matrices:
        f = np.maximum((forward[-1][:, None] + m).max(axis=0), NEVER)
        forward.append(np.where(f > NEVER // 2, f - f.max(), NEVER))
    out = [leave]
    for f, m in zip(forward[-2::-1], matrices[::-1], strict=True):
        out.append(int((f + m[:, out[-1]]).argmax()))
    return out[::-1]


def backtrace(v: Pieces, points: np.ndarray, sizes: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> list[np.ndarray]:
    """Ids of each chunk on its best path between its states."""
    n, width = points.shape
    best = np.full((width + 1, n), NEVER)
    best[entry, np.arange(n)] = 0
    came, which = np.zeros((width + 1, n), dtype=np.int32), np.zeros((width + 1, n), dtype=np.int64)
    for begin, end, rows, score, at in arcs(v, points):
        own = begin < sizes[rows]
        _better(best, came, which, begin, end, rows[own], score[own], at[own])
    out = []
    for i in range(n):
        here, ids = int(sizes[i] + leave[i]), []
        while here > entry[i]:
            ids.append(which[here, i])
            here = came[here, i]
        out.append(np.array([x for k in ids[::-1] for x in _emit(v, int(k))], dtype=np.int32))
    return out


def cut(v: Pieces, text: str) -> list[str]:
    """Chunks of a marked text, each with the points that follow it."""
    return [text[i : i + CHUNK + v.longest - 1] for i in range(0, len(text), CHUNK)]


def encode_long(v: Pieces, word: str) -> bytes:
    """One long stretch without word marks, by chunks, inside a task."""
    parts = cut(v, word)
    points, sizes = _codes(parts, max(map(len, parts))), np.array([min(CHUNK, len(word) - i * CHUNK) for i in range(len(parts))])
    at = states(list(transfer(v, points, sizes)), 0, 0)
    return b"".join(x.tobytes() for x in backtrace(v, points, sizes, np.array(at[:-1]), np.array(at[1:])))


def merge_word(v: Pieces, word: str) -> bytes:
    """Ids of a word by merges: of all neighbours that make a piece, those of the best score first, the leftmost of equal ones."""
    scores, part = v.merges, list(word)
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-scores[x], i, x) for i in range(n - 1) if (x := part[i] + part[i + 1]) in scores]
    heapq.heapify(heap)
    while heap:
        _, i, x = heapq.heappop(heap)
        j = after[i]
        if j >= n or not part[i] or part[i] + part[j] != x:
            continue
        part[i], part[j] = x, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (y := x + part[k]) in scores:
                heapq.heappush(heap, (-scores[y], i, y))
        if (h := before[i]) >= 0 and (y := part[h] + x) in scores:
            heapq.heappush(heap, (-scores[y], h, y))
    ids: list[int] = []
    for x in part:
        if x in v.id_of:
            ids.append(v.id_of[x])
        elif x:
            ids.extend(v.byte_ids[list(x.encode("utf-8", "surrogatepass"))].tolist())
    return np.array(ids, dtype=np.int32).tobytes()


_NONE = np.iinfo(np.int32).max


def _ranked(v: Pieces, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the order of merges, and index in the table, of pairs of symbols; _NONE where they make no piece."""
    key = left << 32 | right
    at = np.searchsorted(v.pair_keys, key)
    hit = (v.pair_keys[at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, v.pair_rank[at], _NONE), at


def merge_words(v: Pieces, some: list[str]) -> list[bytes]:
    """merge_word for many words at once: a step merges the best pair of each, for all words in numpy."""
    out: dict[str, bytes] = {w: merge_word(v, w) for w in some if len(w) > LONG}
    by_size = sorted((w for w in some if len(w) <= LONG), key=len)
    for i in range(0, len(by_size), 8192):
        part = by_size[i : i + 8192]
        width = len(part[-1]) + 1
        points = _codes(part, width)
        known, of = np.unique(points, return_inverse=True)
        # 0 ends a word; a character in no piece is below -1
        symbols = np.array([-1 if p == 0 else v.symbol_of.get(chr(p - 1), -1 - int(p)) for p in known.tolist()], dtype=np.int64)[of].reshape(points.shape)
        done = np.full(points.shape, -1, dtype=np.int64)
        rank, at = _ranked(v, symbols[:, :-1], symbols[:, 1:])
        rows, places = np.arange(len(part)), np.arange(width)
        while len(rows):
            j = rank.argmin(axis=1)
            open_ = rank[np.arange(len(rows)), j] < _NONE
            done[rows[~open_]] = symbols[~open_]
            rows, symbols, rank, at, j = rows[open_], symbols[open_], rank[open_], at[open_], j[open_]
            if not len(rows):
                break
            n = np.arange(len(rows))
            made = v.pair_to[at[n, j]]
            move = np.minimum(places[None, :] + (places[None, :] > j[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, move, axis=1)
            rank, at = (np.take_along_axis(x, np.minimum(move[:, :-1], width - 2), axis=1) for x in (rank, at))
            symbols[n, j] = made
            rank[:, -1] = _NONE
            for k in (j - 1, j):
                ok = (k >= 0) & (k < width - 1)
                rank[n[ok], k[ok]], at[n[ok], k[ok]] = _ranked(v, symbols[n[ok], k[ok]], symbols[n[ok], k[ok] + 1])
        used = done != -1
        ids = np.where(done >= 0, v.piece_of[np.maximum(done, 0)], -1)
        raw, ends = ids[used].astype(np.int32).tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for r in np.flatnonzero((used & (ids < 0)).any(axis=1)).tolist():  # characters in no piece, or that are none themselves
            out[part[r]] = merge_word(v, part[r])
    return [out[w] for w in some]


def marked(text: str) -> str:
    """As the model sees a text: a mark in front, marks for spaces."""
    return " " + text.replace("▁", " ") if text else ""


def parts_of(text: str) -> list[str]:
    """The words of a marked text, each without its first mark."""
    parts = text[1:].split(" ") if text else []
    return [w[1:] for w in _WORD.findall(text)] if "" in parts else parts


def undecoded(v: Pieces, found: dict[str, bytes]) -> set[str]:
    """Words that their ids don't decode to. All are decoded at once: they are right if the bytes are, and begin where the words do."""
    every = np.frombuffer(b"".join(found.values()), dtype=np.int32)
    words = [(" " + p).encode() for p in found]
    sizes = np.array([len(x) // 4 for x in found.values()], dtype=np.int64)
    ends = np.r_[0, np.cumsum(v.byte_sizes[every])][np.cumsum(sizes)]
    if b"".join(map(v.bytes.__getitem__, every.tolist())) == b"".join(words) and np.array_equal(ends, np.cumsum([len(w) for w in words])):
        return set()
    return {p for p, x in found.items() if decode(v, np.frombuffer(x, dtype=np.int32)) != p}


def encode_marked(v: Pieces, texts: list[str]) -> list[tuple[bytes, bool]]:
    """Ids of marked texts, or of chunks that were cut at word marks, by merges; and whether they decode to them. A word is merged and
    decoded once, which is enough: what words decode to is strung together."""
    split = [parts_of(t) for t in texts]
    new = list({p for parts in split for p in parts}.difference(v.known))
    found = dict(zip(new, merge_words(v, [" " + p for p in new]), strict=True))
    odd = v.odd | undecoded(v, found)
    room = REMEMBER - len(v.known)
    kept = [p for p in new if len(p) <= LONG][: max(0, room)]
    v.known.update((p, found[p]) for p in kept)
    v.odd |= odd.intersection(kept)
    known = v.known if len(kept) == len(new) else v.known | found
    return [(b"".join([known[p] for p in parts]) if known is not v.known else b"".join(map(v.known.__getitem__, parts)), not odd or odd.isdisjoint(parts)) for parts in split]


def encode_as_trained(v: Pieces, texts: list[str]) -> tuple[list[bytes], list[bool]]:
    """Ids of each text by the model's own method, and whether they decode to the text."""
    if v.merges is not None:
        found = encode_marked(v, [marked(t) for t in texts])
        return [x for x, _ in found], [same for _, same in found]
    ids = encode(v, texts)
    return ids, [decode(v, np.frombuffer(x, dtype=np.int32)) == t.replace("▁", " ") for x, t in zip(ids, texts, strict=True)]


def encode(v: Pieces, texts: list[str]) -> list[bytes]:
    """Ids of each text, as the bytes of int32."""
    split = [_WORD.findall(marked(t)) for t in texts]
    new = {w for ws in split for w in ws}.difference(v.known)
    short = [w for w in new if len(w) <= LONG]
    known = dict(zip(short, encode_words(v, short), strict=True)) | {w: encode_long(v, w) for w in new if len(w) > LONG}
    if len(v.known) + len(known) <= REMEMBER:
        v.known.update(known)
        known = v.known
    else:
        known |= v.known
    return [b"".join(map(known.__getitem__, ws)) for ws in split]


def decode(v: Pieces, ids: np.ndarray) -> str:
    """The text of ids: byte pieces joined to characters, marks to spaces, without the mark in front."""
    return b"".join(map(v.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _arrays(each: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) // 4 for x in each])
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32(), mask=np.r_[[x is None for x in each], False].astype(bool))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x or b"" for x in each), dtype=np.int32)))


def _groups(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > most:
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if texts:
        yield at, len(texts)


def _encode_task(path: str, model: bytes, keep: list[str]) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path, model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _groups(texts):
                ids, fine = map(iter, encode_as_trained(v, [t for t in texts[a:b] if t is not None]))
                each = [None if t is None else next(ids) for t in texts[a:b]]
                same = [None if t is None else next(fine) for t in texts[a:b]]
                counts = pa.array([None if x is None else len(x) // 4 for x in each], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in keep), _arrays(each), counts, pa.array(same, pa.bool_())], [*keep, "ids", "n_tokens", "round_trip"])

    return work


def _matrix_task(path: str, model: bytes) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path, model)
        for batch in batches:
            parts, sizes = batch.column("part").to_pylist(), batch.column("size").to_numpy().astype(np.int64)
            for i in range(0, len(parts), 256):
                p = parts[i : i + 256]
                m = transfer(v, _codes(p, max(map(len, p))), sizes[i : i + 256])
                yield pa.RecordBatch.from_arrays([batch.column("text_key")[i : i + 256], batch.column("chunk")[i : i + 256], pa.array([x.tobytes() for x in m], pa.binary())], ["text_key", "chunk", "matrix"])

    return work


def _split_task(size: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("text_key").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                parts, held, points = [], [], 0
                for m in _WORD.finditer(text):
                    held.append(m[0])
                    points += len(m[0])
                    if points >= size:
                        parts.append("".join(held))
                        held, points = [], 0
                if held:
                    parts.append("".join(held))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["text_key", "chunk", "part"])

    return work


def _merge_task(path: str, model: bytes) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path, model)
        for batch in batches:
            ids = [x for x, _ in encode_marked(v, batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("chunk"), _arrays(ids)], ["text_key", "chunk", "ids"])

    return work


def _square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw, dtype=np.int64)
    return m.reshape(int(len(m) ** 0.5), -1)


def _segment_product(pdf: pd.DataFrame) -> pd.DataFrame:
    total = None
    for raw in pdf.sort_values("chunk")["matrix"]:
        total = _square(raw) if total is None else times(total, _square(raw))
        # only differences count: values stay near 0 however long the text
        top = total[total > NEVER // 2].max(initial=NEVER)
        total = np.where(total > NEVER // 2, total - top, NEVER)
    return pdf.head(1)[["text_key", "segment"]].assign(matrix=[total.tobytes()])


def _segment_states(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("segment")
    at = states([_square(raw) for raw in pdf["matrix"]], 0, 0)
    return pdf[["text_key", "segment"]].assign(entry=at[:-1], leave=at[1:])


def _chunk_states(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    at = states([_square(raw) for raw in pdf["matrix"]], int(pdf["entry"].iloc[0]), int(pdf["leave"].iloc[0]))
    return pdf[["text_key", "chunk"]].assign(entry=at[:-1], leave=at[1:])


def _trace_task(path: str, model: bytes) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path, model)
        for batch in batches:
            parts = batch.column("part").to_pylist()
            size, entry, leave = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "entry", "leave"))
            for i in range(0, len(parts), 256):
                p, s = parts[i : i + 256], slice(i, i + 256)
                ids = backtrace(v, _codes(p, max(map(len, p))), size[s], entry[s], leave[s])
                yield pa.RecordBatch.from_arrays([batch.column("text_key")[s], batch.column("chunk")[s], _arrays([x.tobytes() for x in ids])], ["text_key", "chunk", "ids"])

    return work


def _decode_task(path: str, model: bytes, keep: list[str]) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path, model)
        for batch in batches:
            out = [None if x is None else decode(v, np.array(x, dtype=np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    return work


def decoded(encoded: DataFrame, model_path: str = MODEL, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids)."""
    with open(model_path, "rb") as f:
        model = f.read()
    rows = encoded.select(key, "ids")
    return rows.mapInArrow(_decode_task(model_path, model, [key]), rows.select(key).withColumn("text", F.lit("")).schema)


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_tokens, round_trip, ids): round_trip tells that decoding the ids gives the text again."""
    with open(model_path, "rb") as f:
        model = f.read()
    bounded_batches(docs)
    rows = docs.select("doc_id", "text")
    giant = F.coalesce(F.length("text") > GIANT, F.lit(False))
    schema = "doc_id long, n_chars long, ids array<int>, n_tokens long, round_trip boolean"
    plain = rows.where(~giant).select(F.col("doc_id").cast("long"), F.length("text").cast("long").alias("n_chars"), "text")
    out = plain.mapInArrow(_encode_task(model_path, model, ["doc_id", "n_chars"]), schema).select("doc_id", "n_chars", "n_tokens", "round_trip", "ids")
    long = rows.where(giant).select(F.col("doc_id").cast("long"), F.length("text").cast("long").alias("n_chars"), "text", F.md5("text").alias("text_key"))
    return out.union(_giants(long, model_path, model))


def _giants(long: DataFrame, path: str, model: bytes) -> DataFrame:
    v = pieces(path, model)
    k = v.longest
    mark = long.select("text_key", F.concat(F.lit(" "), F.translate("text", "▁", " ")).alias("whole")).dropDuplicates(["text_key"])
    if v.merges is not None:
        parts = materialise(mark.mapInArrow(_split_task(CHUNK), "text_key string, chunk int, part string"))
        traced = spread(parts, "text_key", "chunk").mapInArrow(_merge_task(path, model), "text_key string, chunk int, ids array<int>")
    else:
        at = F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / CHUNK).cast("int"))
        chunks = materialise(
            mark.select("text_key", "whole", F.explode(at).alias("chunk"))
            .selectExpr("text_key", "chunk", f"substring(whole, chunk * {CHUNK} + 1, {CHUNK + k - 1}) as part", f"least({CHUNK}, length(whole) - chunk * {CHUNK}) as size")
        )
        m = materialise(spread(chunks, "text_key", "chunk").mapInArrow(_matrix_task(path, model), "text_key string, chunk int, matrix binary").withColumn("segment", F.floor(F.col("chunk") / SEGMENT).cast("int")))
        products = m.groupBy("text_key", "segment").applyInPandas(_segment_product, "text_key string, segment int, matrix binary")
        ends = products.groupBy("text_key").applyInPandas(_segment_states, "text_key string, segment int, entry int, leave int")
        known = m.join(ends, ["text_key", "segment"]).groupBy("text_key", "segment").applyInPandas(_chunk_states, "text_key string, chunk int, entry int, leave int")
        traced = chunks.join(known, ["text_key", "chunk"]).mapInArrow(_trace_task(path, model), "text_key string, chunk int, ids array<int>")
    whole = materialise(traced.groupBy("text_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids")))
    back = whole.mapInArrow(_decode_task(path, model, ["text_key"]), "text_key string, text string").select("text_key", F.col("text").alias("again"))
    return long.join(whole, "text_key").join(back, "text_key").select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_tokens"), (F.col("again") == F.translate("text", "▁", " ")).alias("round_trip"), "ids")
