"""Operator 1: repeated passages, found by MinHash banding of paragraphs.

A paragraph is a line of a text. Paragraphs of LEAST_WORDS words or more get MinHash signatures over five-word shingles, BANDS
bands of ROWS rows (a pair at a similarity of 0.8 collides with a probability of 0.997); colliding paragraphs are verified by
exact Jaccard similarity, and the components of what is left are the classes of near-equal paragraphs.

A passage can also stand inside otherwise different paragraphs. It is looked for in what the removed paragraphs leave, as a run
of RUN_WORDS words or more whose words all stand, in the same order, in an earlier place too. A passage's place is that of each
of its RUN_WORDS-grams: a word is part of a later copy if and only if one of the RUN_WORDS-grams over it occurs earlier, so later
copies go whole, to the word, and shorter repeats are never removed. Grams are compared by 128 bits of hash.

Not all grams are compared. Of each window of WINDOW seeds (SEED words each), which is RUN_WORDS words long, the least by hash is
selected; equal windows select equal seeds, so a repeated gram has a repeated seed, and only grams over one of these are formed.

Of each class the occurrence with the smallest (doc_id, place) is kept, all others are to be removed. A kept passage can have in it
a shorter one that itself stands earlier; that one has its own row. Of a passage that overlaps its own first occurrence only what
lies beyond goes. Null texts and texts without words have no paragraphs. Rows that share a doc_id and are equal are one document;
if their texts differ, their places can't be told apart, so they take no part. Very long texts are searched whole. Columns other than
doc_id and text are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import bounded_batches, fitting, fresh, materialise, release
from .near import near_classes
from .shingles import _BASE, _INVERSE, _power, byte_slices, distinct, mix, shingles, words
from .weighted_minhash import band_keys

LEAST_WORDS = 20
THRESHOLD = 0.8
BANDS, ROWS = 8, 3
HASHES = BANDS * ROWS
#: Signature places that must agree before the exact test; of 24, a pair at 0.8 has fewer with a probability of 0.002.
AGREE = 13
RUN_WORDS = 16
SEED = 8
WINDOW = RUN_WORDS - SEED + 1
_U = np.uint64
_ODD = np.random.default_rng(24).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
UNITS = "doc_id long, key long, start int, end int, n_words int, sig binary"
SEEDS = "doc_id long, pos int, key long"
GRAMS = "doc_id long, pos int, a long, b long, start int, end int"


def minhash(sh: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Signatures of the groups of shingles that begin at `begin`."""
    out = np.zeros((len(begin), HASHES), dtype=np.uint32)
    x = sh ^ (sh >> _U(31))
    for k in range(HASHES if len(begin) else 0):
        out[:, k] = np.minimum.reduceat(x * _ODD[k] >> _U(32), begin)
    return out


def _sequence_keys(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * _power(_BASE, len(h)), out=total[1:])
    return mix((total[end] - total[begin]) * _power(_INVERSE, len(h) + 1)[begin]).view(np.int64)


def layout(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all words of texts, in order: hash, index of the text, line, and the code points from the word to the next one of its line, or
    else to the end of the line."""
    h, of, s, _ = words(texts)
    if not len(h):
        return h, of, of, of, of
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, first[of] + s)
    until = np.r_[first[of[1:]] + s[1:], 0]
    last = np.r_[line[1:] != line[:-1], True]
    until[last] = breaks[line[last]]
    zero = point[first[of]]
    return h, of, line, point[first[of] + s] - zero, point[until] - zero


def units(texts: list[bytes]) -> Iterator[tuple]:
    """Paragraphs of all texts: (text index, key, start and end in code points, words, signatures)."""
    h, of, line, start, until = layout(texts)
    if not len(h):
        return
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    end = np.r_[begin[1:], len(h)]
    long = end - begin >= LEAST_WORDS
    sh, group = shingles(h, line)
    chosen = np.zeros(int(line[-1]) + 1, bool)
    chosen[line[begin[long]]] = True
    keep = chosen[group]
    sh, group = sh[keep], group[keep]
    sig = minhash(sh, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int))
    b, z = begin[long], end[long]
    yield of[b], _sequence_keys(h, b, z), start[b], until[z - 1], z - b, sig


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a, b, texts in byte_slices(batch.column(1)):
            for of, key, start, end, n, sig in units(texts):
                sigs = pa.array([row.tobytes() for row in sig], pa.binary())
                ints = [pa.array(v, pa.int32()) for v in (start, end, n)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][of]), pa.array(key), *ints, sigs], ["doc_id", "key", "start", "end", "n_words", "sig"])


def rest(texts: list[bytes], gone: list[list | None]) -> tuple[np.ndarray, ...]:
    """Of the words outside the spans `gone` of each text: hash, index of the text, place among the text's words, start and end in code
    points, and a number that is equal for words without a gap between them."""
    h, of, _, start, until = layout(texts)
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    pos, left = np.arange(len(h)) - at[of], np.ones(len(h), bool)
    for i, spans in enumerate(gone):
        if spans:
            begin, size = np.array(sorted((x["start"], x["n_chars"]) for x in spans)).T
            here = start[at[i] : at[i + 1]]
            k = np.searchsorted(begin, here, side="right") - 1
            left[at[i] : at[i + 1]] = (k < 0) | (here >= (begin + size)[k])
    h, of, pos, start, until = (x[left] for x in (h, of, pos, start, until))
    group = np.cumsum(np.r_[False, (of[1:] != of[:-1]) | (pos[1:] != pos[:-1] + 1)]) if len(h) else of
    return h, of, pos, start, until, group


def winnowed(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which the selected seeds begin, and the seeds' keys."""
    n = len(h) - RUN_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.arange(n + WINDOW - 1)
    keys = _sequence_keys(h, begin, begin + SEED)
    whole = np.flatnonzero(group[:n] == group[RUN_WORDS - 1 :])
    at = np.unique(whole + np.lib.stride_tricks.sliding_window_view(keys, WINDOW)[whole].argmin(axis=1))
    return at, keys[at]


def _slices(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[tuple]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for a, b, texts in byte_slices(batch.column("text")):
            yield ids[a:b], texts, *(batch.column(c)[a:b].to_pylist() for c in others)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, gone in _slices(batches, ["gone"]):
        h, of, pos, _, _, group = rest(texts, gone)
        at, keys = winnowed(h, group)
        yield pa.RecordBatch.from_arrays([pa.array(ids[of[at]], pa.int64()), pa.array(pos[at], pa.int32()), pa.array(keys, pa.int64())], ["doc_id", "pos", "key"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All grams of RUN_WORDS words over the seeds at the given places."""
    for ids, texts, gone, seeds in _slices(batches, ["gone", "seeds"]):
        h, of, pos, start, until, group = rest(texts, gone)
        n = len(h) - RUN_WORDS + 1
        if n <= 0:
            continue
        seeded = np.zeros(len(h) + 1, np.int64)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        for i, places in enumerate(seeds):
            here = slice(bounds[i], bounds[i + 1])
            seeded[1:][here] = np.isin(pos[here], np.array(places or [], dtype=np.int64))
        seeded = np.cumsum(seeded)
        begin = np.flatnonzero((group[:n] == group[RUN_WORDS - 1 :]) & (seeded[WINDOW : WINDOW + n] > seeded[:n]))
        last = begin + RUN_WORDS - 1
        keys = [_sequence_keys(x, begin, last + 1) for x in (h, mix(h ^ _ODD[0]))]
        ints = [pa.array(v, pa.int32()) for v in (start[begin], until[last])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[of[begin]], pa.int64()), pa.array(pos[begin], pa.int32()), *map(pa.array, keys), *ints], ["doc_id", "pos", "a", "b", "start", "end"])


def _sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, of, _, _ = words(texts)
    ids, of, _, _ = distinct(*shingles(h, of))
    return ids, np.ones(len(ids)), of


def _first() -> list:
    place = F.struct("doc_id", "start", "end")
    return [F.min(place).alias("first"), F.max(place).alias("last")]


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per occurrence of a repeated paragraph or passage: (doc_id, kind, start, n_chars, n_words, class_id, kept).

    start and n_chars count code points; class_id: the smallest doc_id that has the class's first occurrence; kept: this is it."""
    bounded_batches(docs)
    own = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    unclear = fitting(own.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("doc_id"))
    own = own.join(unclear, "doc_id", "left_anti")
    lines = materialise(own.mapInArrow(_cut, UNITS))
    items = materialise(lines.groupBy("key").agg(*_first(), F.first("sig").alias("sig")).withColumnRenamed("key", "item"))
    texts = lambda some: (
        own.join(fitting(some.join(items, "item").select("item", "first.*")), "doc_id").selectExpr("item", "substring(text, start + 1, end - start) as text").dropDuplicates(["item"])
    )
    sigs = items.select("item", "sig")
    classes = near_classes(band_keys(sigs, BANDS, ROWS), sigs, texts, _sets, HASHES, AGREE, threshold)
    known = items.join(classes, "item", "left").withColumn("class", F.coalesce("class_id", "item")).select("item", "class", "first", "last")
    sizes = known.groupBy("class").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last")
    member = known.select("item", "class").join(sizes, "class").select(F.col("item").alias("key"), "first")
    paragraph = materialise(
        lines.join(member, "key")
        .select("doc_id", F.lit("paragraph").alias("kind"), "start", F.expr("end - start").alias("n_chars"), "n_words", F.col("first.doc_id").alias("class_id"), F.expr("doc_id = first.doc_id and start = first.start").alias("kept"))
        .distinct()
    )
    release(lines, items, classes)

    removed = paragraph.where("not kept")
    gone = removed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_chars")).alias("gone"))
    if removed.count() <= common.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = own.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    seeds = materialise(left.mapInArrow(_seeds, SEEDS))
    # only keys and counts move for the many seeds that stand alone; as tables of their own, keys of very many rows are split by the joins
    twice = fitting(seeds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    several = materialise(seeds.join(twice, "key").select("doc_id", "pos"))
    release(seeds, twice)
    places = several.groupBy("doc_id").agg(F.collect_list("pos").alias("seeds"))
    if several.count() <= common.BROADCAST_ROWS:
        places = F.broadcast(places)
    grams = materialise(left.join(places, "doc_id").select("doc_id", "text", "gone", "seeds").mapInArrow(_grams, GRAMS))
    release(several)
    firsts = materialise(
        grams.groupBy("a", "b").agg(F.min(F.struct("doc_id", "pos", "end")).alias("first"), F.max(F.struct("doc_id", "pos")).alias("last"))
        .where("first.doc_id <> last.doc_id or first.pos <> last.pos").select("a", "b", "first")
    )
    over = f"doc_id = first.doc_id and pos > first.pos and pos < first.pos + {RUN_WORDS}"
    by_doc = W.partitionBy("doc_id", "kept").orderBy("word", "till")
    runs = (
        grams.join(firsts, ["a", "b"])
        .selectExpr(
            "doc_id", "doc_id = first.doc_id and pos = first.pos as kept", "first.doc_id as class_id", "end", f"pos + {RUN_WORDS} as till",
            f"if({over}, first.pos + {RUN_WORDS}, pos) as word", f"if({over}, greatest(start, first.end), start) as start",
        )
        .withColumn("new", F.expr("cast(word > coalesce(max(till) over (partition by doc_id, kept order by word, till rows between unbounded preceding and 1 preceding), -1) as int)"))
        .withColumn("run", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    )
    passage = (
        runs.groupBy("doc_id", "kept", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("until"), (F.max("till") - F.min("word")).alias("n_words"), F.min("class_id").alias("class_id"))
        .where(F.col("n_words") >= RUN_WORDS)
    )
    return paragraph.union(passage.selectExpr("doc_id", "'passage' as kind", "start", "until - start as n_chars", "n_words", "class_id", "kept"))


def _without(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for a, n in sorted((x["start"], x["n_chars"]) for x in spans):
        out.append(text[at : max(at, a)])
        at = max(at, a + n)
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the repeated passages that aren't kept, n_chars set anew; a document with nothing left but white space goes.

    Documents without such passages, null texts and rows without doc_id stay as they are; rows that share a doc_id are all cut alike."""
    names, spans = docs.columns, fresh(docs, "spans")
    gone = repeated_passages(docs, threshold).where("not kept").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_chars")).alias(spans))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            has = pc.and_(column(spans).is_valid(), column("text").is_valid())
            new = [_without(t, g) for t, g in zip(column("text").filter(has).to_pylist(), column(spans).filter(has).to_pylist(), strict=True)]
            values = {"text": new, "n_chars": [len(t) for t in new]}
            columns = [pc.replace_with_mask(column(c), has, pa.array(values[c], column(c).type)) if c in values else column(c) for c in names]
            left = pc.replace_with_mask(pa.array([True] * batch.num_rows), has, pa.array([bool(t.strip()) for t in new], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names).filter(left)

    return docs.join(gone, "doc_id", "left").select(*names, spans).mapInArrow(cut, docs.schema)
