"""Substring dedup: recurring passages confirmed across documents, then located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import WordHashes, arrow_schema, discard, gram_hashes, id_and_text, mixed, powers, release, slices, stored

WINDOW = 20
#: A gram of so many words is the anchor of a window: the one with the least hash. A window has 16 grams.
ANCHOR = 5
#: Passages of one automaton and words of its documents; both bound a task's memory.
SHARD_PASSAGES, SHARD_WORDS = 400, 300_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ANCHOR_SCHEMA = "fp long, extent long, part long, doc_id long, start int, size int"
PLACE = ("doc_id", "part", "start")


class SpanHashes:
    """Hashes of spans of one word sequence from running sums; powers are kept for all sequences."""

    rising: dict[int, np.ndarray] = {}

    def __init__(self, words: np.ndarray, base: int) -> None:
        kept = self.rising.get(base)
        if kept is None or len(kept) < len(words) + 1:
            kept = self.rising[base] = powers(base, 2 * len(words) + 1024)
        inverse = self.rising.get(-base)
        if inverse is None or len(inverse) < len(kept):
            inverse = self.rising[-base] = powers(pow(base, -1, 1 << 64), len(kept))
        self.inverse = inverse
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * kept[: len(words)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mixed(value + (end - start).astype(np.uint64))


def leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """For every window of ``size`` values the place of its least, the leftmost of equal ones; windows grow by doubling."""
    at, width = np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        width += step
    return at


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, extent hash, start, size): each window belongs to the leftmost least gram in it.

    The extent of an anchor is the union of its windows, which follow one another. What a window's anchor is depends on
    the window alone, so equal windows have equal anchors, wherever they stand.
    """
    if len(words) < WINDOW:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    grams = gram_hashes(words, ANCHOR)
    at = leftmost_least(grams, WINDOW - ANCHOR + 1)
    start = np.flatnonzero(np.diff(at, prepend=-1))
    end = np.append(start[1:], len(at)) - 1 + WINDOW
    return grams[at[start]], SpanHashes(words, BASES[0]).of(start, end), start, end - start


def with_part(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text): ``part`` tells apart the texts of an id that has several (a hash of the text), else it is 0.

    Only such ids meet the documents in a join; usually there are none, and Spark then sends the empty table along.
    """
    docs = docs.withColumn("hash", F.xxhash64("text"))
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    shared = stored(shared.where("low <> high").select("doc_id", F.lit(True).alias("shared")), "shared")
    part = F.when(F.col("shared"), F.col("hash")).otherwise(F.lit(0).cast("long")).alias("part")
    return docs.join(shared, "doc_id", "left").select("doc_id", part, "text")


def anchor_rows(docs: DataFrame) -> DataFrame:
    target = arrow_schema(ANCHOR_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            found = [anchors(hashes(text.encode().split())) for text in part.column("text").to_pylist()]
            if found:
                sizes = [len(f[0]) for f in found]
                fp, extent, start, size = (np.concatenate([f[k] for f in found]) for k in range(4))
                of, ids = (np.repeat(part.column(c).to_numpy(), sizes) for c in ("part", "doc_id"))
                columns = (fp.view(np.int64), extent.view(np.int64), of, ids, start, size)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, target)], schema=target)

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, ANCHOR_SCHEMA)


def packed_texts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            packed = pa.array([None if t is None else zip_.compress(t.encode()) for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), packed], names=["doc_id", "part", "packed"])

    return docs.mapInArrow(run, "doc_id long, part long, packed binary")


def first_rows(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The first row of each key in the order of PLACE, with the number of rows; made from parts before the shuffle."""
    found = rows.groupBy(*keys).agg(F.min(F.struct(*PLACE, *more)).alias("first"), F.count(F.lit(1)).alias("n"))
    return found.select(*keys, "first.*", "n")


def later_than_first(rows: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that the first row of their key precedes, with its place.

    ``first`` is a stored table and only its keys of several rows are joined, so both sides are shuffled for the join and
    the rows of a hot key can be split.
    """
    several = first.where("n > 1").select(*keys, *[F.col(c).alias(f"from_{c}") for c in PLACE])
    same = [F.col(c) == F.col(f"from_{c}") for c in PLACE]
    return rows.join(several, keys).where(~(same[0] & same[1] & same[2]))


def window_rows(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Every window of the spans (doc_id, part, start, size), with two hashes of its words."""
    listed = spans.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = texts.join(listed, ["doc_id", "part"]).select("doc_id", "part", "packed", "spans.start", "spans.size")
    schema = "one long, two long, part long, doc_id long, start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip, target = WordHashes(), zstandard.ZstdDecompressor(), arrow_schema(schema)
        for part in slices(batches):
            out = []
            for doc, text, packed, start, size in zip(*(part.column(k).to_pylist() for k in range(5))):
                words = hashes(unzip.decompress(packed).split())
                at = np.unique(np.concatenate([np.arange(a, a + n - WINDOW + 1) for a, n in zip(start, size)]))
                both = [SpanHashes(words, base).of(at, at + WINDOW).view(np.int64) for base in BASES]
                out.append((*both, np.full(len(at), text), np.full(len(at), doc), at.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), f.type) for k, f in enumerate(target)], schema=target)

    return joined.mapInArrow(run, schema)


def recurring_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, part, start, size, from_doc_id, from_part, from_start): spans whose every window starts earlier, too.

    Anchors that occur once are dropped first. Equal extents settle all their windows at once. Where an anchor stands in
    different extents (at the ends of a passage and around an edit), the first row of each extent is settled window by
    window. A key with very many rows is reduced before each shuffle and split in each join.
    """
    every = stored(anchor_rows(docs), "every")
    again = stored(every.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "again")
    rows = stored(every.join(again, "fp"), "anchors")
    discard(every, again)
    first = stored(first_rows(rows, ["fp", "extent"], "size"), "first")
    several = stored(first.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "several")
    columns = ("doc_id", "part", "start", "size", *(f"from_{c}" for c in PLACE))
    later = stored(later_than_first(rows, first, ["fp", "extent"]).select(*columns), "later")
    discard(rows)
    windows = stored(window_rows(first.join(several, "fp").select(*PLACE, "size").distinct(), texts), "windows")
    discard(first, several)
    first = stored(first_rows(windows, ["one", "two"]).where("n > 1"), "first")
    later_windows = later_than_first(windows, first, ["one", "two"]).withColumn("size", F.lit(WINDOW)).select(*columns)
    spans = stored(later.unionByName(later_windows).distinct(), "spans")
    discard(windows, first, later)
    return spans


def passages(spans: list[tuple]) -> list[tuple]:
    """Overlapping spans with the same origin at the same distance, joined; (start, end, from_doc, from_start)."""
    joined: list[list[int]] = []
    for doc, distance, start, end in sorted((doc, origin - start, start, start + size) for start, size, doc, origin in spans):
        if joined and joined[-1][:2] == [doc, distance] and start <= joined[-1][3]:
            joined[-1][3] = max(end, joined[-1][3])
        else:
            joined.append([doc, distance, start, end])
    return [(start, end, doc, start + distance) for doc, distance, start, end in joined]


def locate(shard: list[tuple[tuple, list[bytes], list[tuple]]]) -> list[np.ndarray]:
    """For each ((id, part), words, passages) a mark on every word inside an occurrence that another one precedes.

    All passages of the shard go into one automaton over words, and every document of the shard runs through it.
    """
    place = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, words, own in shard for a, b, *_ in own for w in words[a:b]))}
    known: dict[tuple, tuple[int, int, int]] = {}
    lines = [tuple(map(place.get, words, repeat(0))) for _, words, _ in shard]
    for line, (_, _, own) in zip(lines, shard):
        for a, b, doc, start in own:
            known[line[a:b]] = min(known.get(line[a:b], (b - a, doc, start)), (b - a, doc, start))
    marks = [np.zeros(len(line) + 1, np.int64) for line in lines]
    if known:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, value in known.items():
            automaton.add_word(key, value)
        automaton.make_automaton()
        for line, mark, (doc, _, _) in zip(lines, marks, shard):
            for end, (size, from_doc, from_start) in automaton.iter(line) if line and doc[0] is not None else ():
                start = end + 1 - size
                if (from_doc, from_start) < (doc, start):
                    mark[start] += 1
                    mark[end + 1] -= 1
    return [np.cumsum(mark[:-1]) > 0 for mark in marks]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; with ``kept`` also the text that is left.

    Words stand between ASCII white space. A word goes if a window of 20 words over it also starts earlier: in a document
    of smaller id, or earlier in its own. Null, empty and short texts lose nothing; rows that repeat an id and its text
    are one document and lose the same words; different texts of one id are documents of their own, in the order of a
    hash of them; a row without id is compared with nothing.
    """
    docs = with_part(id_and_text(docs, key, text))
    texts = packed_texts(docs)
    spans = recurring_spans(docs, texts)
    listed = spans.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "size", *[f"from_{c}" for c in PLACE])).alias("spans"))
    joined = texts.join(listed, ["doc_id", "part"], "left").select("doc_id", "part", "packed", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if kept else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, target = zstandard.ZstdDecompressor(), arrow_schema(schema)

        def done(shard: list[tuple]) -> pa.RecordBatch:
            rows = []
            for (doc, words, _), gone in zip(shard, locate(shard)):
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                rows.append((doc[0], len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

        shard, n_passages, n_words = [], 0, 0
        for part in slices(batches):
            for doc, text, packed, found in zip(*(part.column(k).to_pylist() for k in range(4))):
                words = unzip.decompress(packed).split() if packed else []
                own = passages([(s["start"], s["size"], (s["from_doc_id"], s["from_part"]), s["from_start"]) for s in found or []])
                shard.append(((doc, text), words, own))
                n_passages += len(own)
                n_words += len(words)
                if n_passages >= SHARD_PASSAGES or n_words >= SHARD_WORDS:
                    yield done(shard)
                    shard, n_passages, n_words = [], 0, 0
        if shard:
            yield done(shard)

    return joined.mapInArrow(run, schema)
