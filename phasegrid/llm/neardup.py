"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import WordHashes, arrow_schema, discard, gram_hashes, id_and_text, map_texts, mixed, release, slices, stored
from phasegrid.llm.graph import components

SHINGLE = 5
SHARE = 75
#: 32 bands of 3 bins: a pair at similarity 0.75 shares no bucket with probability 2e-8.
BANDS, ROWS = 32, 3
BINS = BANDS * ROWS
#: Bins of two sketches that have to agree before texts are compared: five deviations below 0.75.
LEAST_AGREEING = 50
#: Stars of a bucket besides those of its smallest and largest id.
HASHED_STARS = 2
PROBES = 1024
#: Texts that hold a shingle, from which on its frequency is told to all tasks; and the most shingles that are told.
FREQUENT, FREQUENT_KEPT = 8, 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(LOWER).split()


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, no words are none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(SHINGLE, len(words))) + np.uint64(min(SHINGLE, len(words)) % SHINGLE))


@lru_cache(1)
def _probes() -> np.ndarray:
    """For every bin the order in which it looks for a bin to borrow from, the same for all sets."""
    at = np.arange(BINS * PROBES, dtype=np.uint64)
    return (mixed(at + np.uint64(1)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, PROBES)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least value of each bin; an empty bin borrows from the first bin of its own random order that holds one."""
    values = np.sort(mixed(shingles))
    bins = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = values[first], True
    if not full.all():
        probes = _probes()[~full]
        hit = full[probes]
        source = probes[np.arange(len(probes)), hit.argmax(axis=1)]
        source[~hit.any(axis=1)] = np.flatnonzero(full)[0]
        out[~full] = out[source]
    return out


def band_keys(bins: np.ndarray) -> np.ndarray:
    parts = bins.reshape(BANDS, ROWS)
    key = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for k in range(ROWS):
        key = mixed(key + parts[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, same1, same2, bands, marks): the same1/same2 of equal shingle sets are equal."""
    words: dict[int, WordHashes] = {}

    def run(ids, texts):
        hashes = words.setdefault(0, WordHashes())
        out = {c: [] for c in ("n_shingles", "same1", "same2", "bands", "marks")} | {"doc_id": ids}
        for text in texts:
            found = shingle_set(hashes(text_words(text)))
            out["n_shingles"].append(len(found))
            both = [mixed(found + np.uint64(s)).sum(dtype=np.uint64).view(np.int64) for s in (11, 13)]
            out["same1"].append(int(both[0]))
            out["same2"].append(int(both[1]))
            bins = sketch(found) if len(found) else np.zeros(0, np.uint64)
            out["bands"].append(band_keys(bins) if len(found) else [])
            out["marks"].append((bins & np.uint64(255)).astype(np.uint8).tobytes())
        return out

    return map_texts(docs, run, "doc_id long, n_shingles long, same1 long, same2 long, bands array<long>, marks binary")


def agreeing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    shape = (len(a), BINS)
    return (np.frombuffer(b"".join(a), np.uint8).reshape(shape) == np.frombuffer(b"".join(b), np.uint8).reshape(shape)).sum(axis=1)


def sketch_filter(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in enough bins."""
    joined = pairs.join(marks.select(F.col("rep").alias("b"), F.col("marks").alias("mb")), "b").join(
        marks.select(F.col("rep").alias("a"), F.col("marks").alias("ma")), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = agreeing(batch.column("ma").to_pylist(), batch.column("mb").to_pylist()) >= LEAST_AGREEING
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def packed_texts(docs: DataFrame) -> DataFrame:
    def pack(ids, texts):
        zip_ = zstandard.ZstdCompressor(level=3)
        return {"doc_id": ids, "packed": [zip_.compress((t or "").encode().translate(LOWER)) for t in texts]}

    return map_texts(docs, pack, "doc_id long, packed binary")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the share. A pair carries packed texts, which are smaller than sets."""
    texts = packed_texts(docs)
    joined = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "packed": "pb"}), "b").join(
        texts.withColumnsRenamed({"doc_id": "a", "packed": "pa"}), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip, target = WordHashes(), zstandard.ZstdDecompressor(), arrow_schema("a long, b long")
        last, left = None, np.zeros(0, np.uint64)
        for part in slices(batches):
            found = []
            for a, b, pa_, pb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "pa", "pb"))):
                if a != last:
                    last, left = a, shingle_set(hashes(unzip.decompress(pa_).split()))
                right = shingle_set(hashes(unzip.decompress(pb).split()))
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= SHARE * (len(left) + len(right) - both) and both:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=target)

    return joined.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def unresolved(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, component) of every member of a bucket that still holds several components."""
    named = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    # stored, so that both sides of the join are shuffled for it and a hot bucket's rows can be split
    return named.join(stored(several.select("bucket"), "several"), "bucket").select("rep", "component").distinct()


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of most texts, rising, and in how many they are: those of FREQUENT texts on, or of the least power of
    two times as many that leaves FREQUENT_KEPT at most. They only set an order, so any list gives the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip, target = WordHashes(), zstandard.ZstdDecompressor(), arrow_schema("shingle long, n long")
        for part in slices(batches):
            sets = [shingle_set(hashes(unzip.decompress(p).split())) for p in part.column("packed").to_pylist()]
            if sets:
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], schema=target)

    counts = texts.select("packed").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= FREQUENT), "frequent")
    sizes = sorted(((r["p"], r["k"]) for r in counts.groupBy(F.floor(F.log2(F.col("n") / FREQUENT)).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    kept, least = 0, None
    for power, k in sizes:
        kept += k
        if kept > FREQUENT_KEPT:
            break
        least = power
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(F.floor(F.log2(F.col("n") / FREQUENT)) >= least).toArrow()
    discard(counts)
    shingle, n = (table.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(shingle.view(np.uint64))
    return shingle.view(np.uint64)[order], n[order]


def rarest(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's rarest quarter and one shingle more, in the one order (texts that hold it, hash) of all sets."""
    n = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        n = np.where(frequent[at] == found, counts[at], 0)
    return found[np.lexsort((found, n))[: len(found) * (100 - SHARE) // 100 + 1]]


def prefix_pairs(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of all members (rep, component) of different components that can reach the share: a prefix-filter join.

    In one order of all shingles, sets of sizes s and t at the share have at least share / (1 + share) * (s + t) in
    common, and all of that stands from their first common shingle on. So a pair is lost by no order if it is made from
    every shingle that leaves so many places in both sets; rare shingles come first, so that those of a template, which
    all sets hold, are mostly not asked. Within a shingle's largest component nothing is paired.
    """
    spark = docs.sparkSession
    members = stored(members, "members")
    texts = stored(packed_texts(docs).withColumnRenamed("doc_id", "rep").join(members, "rep"), "unresolved")
    held = spark.sparkContext.broadcast(frequent_shingles(texts))
    schema = "shingle long, rep long, component long, size long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip, target = WordHashes(), zstandard.ZstdDecompressor(), arrow_schema(schema)
        frequent, counts = held.value
        for part in slices(batches):
            out = []
            for rep, packed, component in zip(*(part.column(c).to_pylist() for c in ("rep", "packed", "component"))):
                found = shingle_set(hashes(unzip.decompress(packed).split()))
                if len(found):
                    first = rarest(found, frequent, counts)
                    out.append((first.view(np.int64), *(np.full(len(first), x) for x in (rep, component, len(found))), np.arange(len(first))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), f.type) for k, f in enumerate(target)], schema=target)

    rare = stored(texts.mapInArrow(run, schema), "rarest")
    discard(members, texts)
    inside = rare.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    main = inside.groupBy("shingle").agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "component")).alias("c"))
    main = stored(main.where("components > 1").select("shingle", F.col("c.component").alias("main")), "main")
    rows = stored(rare.join(main, "shingle"), "met")
    discard(rare, main)
    x, y = rows.alias("x"), rows.where("component <> main").alias("y")
    needed = SHARE * (F.col("x.size") + F.col("y.size"))
    met = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.component") == F.col("x.main")) | (F.col("x.rep") < F.col("y.rep")))
        & ((100 + SHARE) * (F.col("x.size") - F.col("x.place")) >= needed) & ((100 + SHARE) * (F.col("y.size") - F.col("y.place")) >= needed),
    )
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked from a Jaccard similarity of 0.75 of their shingle sets on; ``component_id`` is the smallest id
    that links reach, and the document of that id is kept. Texts that are null, empty or hold no word have an empty set
    and stand alone; a null id stands alone, with a null component, and is kept; rows that repeat an id are one node.

    Equal sets meet first and go on as one. A bucket makes stars only: every member with the bucket's smallest and its
    largest id and with two members chosen by hash, so that pairs stay in proportion to members. Members of buckets that
    then hold several components meet in a prefix-filter join, which loses no pair, and full sets decide.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, key, text)
    made = stored(sketches(docs), "sketches")
    named = made.where("n_shingles > 0 and doc_id is not null")
    same = ["same1", "same2", "n_shingles"]
    # only sets of several rows are joined, from a stored table, so that the rows of a hot set can be split
    groups = named.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1").drop("n"), "groups")
    member = named.join(groups, same, "left").withColumn("rep", F.coalesce("least", "doc_id"))
    copies = member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    units = stored(member.where("doc_id = rep").select("rep", "bands", "marks").dropDuplicates(["rep", "bands"]), "units")
    marks = units.select("rep", "marks").dropDuplicates(["rep"])

    placed = units.select("rep", F.explode("bands").alias("bucket"))
    by_hash = [F.min_by("rep", F.xxhash64("rep", F.lit(k))) for k in range(HASHED_STARS)]
    centres = placed.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.array_distinct(F.array(F.min("rep"), F.max("rep"), *by_hash)).alias("centres"))
    shared = stored(placed.join(centres.where("low < high").select("bucket", "centres"), "bucket"), "shared")
    pairs = shared.select(F.explode("centres").alias("c"), "rep").where("c <> rep")
    pairs = pairs.select(F.least("c", "rep").alias("a"), F.greatest("c", "rep").alias("b")).distinct()
    close = stored(sketch_filter(pairs, marks), "pairs")
    discard(units)
    links = stored(confirmed(close, docs), "links")
    release(spark)
    labels = components(links)
    members = unresolved(shared.select("rep", "bucket"), labels)
    more = prefix_pairs(members, docs)
    discard(shared)
    more = stored(more.join(close, ["a", "b"], "left_anti"), "pairs")
    release(spark)
    found = stored(confirmed(more, docs), "links")
    release(spark)
    links = labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(found)
    labels = components(links.unionByName(copies))
    return (
        made.select("doc_id", "n_shingles")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )

