"""Hard-negative mining: bounds from segment means and deviations first, exact inner products for what they leave."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import stored

#: A component becomes floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of the positive's score between which a hard negative's score lies.
LEAST, MOST = 50, 95
#: Segments of a vector at the finest level; the coarser one joins MERGED of them.
SEGMENTS, MERGED = 16, 4
#: Rows of a block, anchors of a chunk, and anchors that are compared at once; long vectors make smaller ones.
BLOCK_ROWS, CHUNK_ANCHORS, TOGETHER, COMPONENTS = 4096, 2048, 256, 1 << 22
#: Rows for each task that packs blocks.
PACKED_ROWS = 8192
#: Share of pairs left by the coarse bounds up to which they are refined pair by pair.
SPARSE = 0.1
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min

PACKED = (
    "part int, dim int, kind string, numbers binary, ids binary, labels binary, vectors binary, means binary, deviations binary"
)
FIELDS = [f.split(" ")[0] for f in PACKED.split(", ")]


def taking_part(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector of doubles) of the rows that have an id and a label and only finite components."""
    rows = embeddings.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)


def edges(dim: int) -> np.ndarray:
    """Bounds of the finest segments of a vector; a short vector has one component in each."""
    return np.linspace(0, dim, min(SEGMENTS, dim) + 1).round().astype(int)


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of every segment, and root of the summed squares of what departs from it."""
    cuts = edges(vectors.shape[1])
    if len(cuts) < 2:
        return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
    sizes = np.diff(cuts)
    means = np.add.reduceat(vectors, cuts[:-1], axis=1) / sizes
    rest = vectors - np.repeat(means, sizes, axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1))


def coarser(means: np.ndarray, deviations: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of MERGED neighbouring segments as one, from the segments' own summaries."""
    starts = np.arange(0, len(sizes), MERGED)
    if not len(starts):
        return means, deviations, sizes
    total = np.add.reduceat(sizes, starts)
    joined = np.add.reduceat(means * sizes, starts, axis=1) / total
    each = np.repeat(joined, np.diff(np.append(starts, len(sizes))), axis=1)
    spread = deviations**2 + sizes * (means - each) ** 2
    return joined, np.sqrt(np.add.reduceat(spread, starts, axis=1)), total


class Rows:
    """Vectors of one dimension with ids, labels, row numbers and two levels of segment summaries."""

    def __init__(self, row: dict) -> None:
        self.dim, self.part = row["dim"], row["part"]
        self.numbers, self.ids, self.labels = (np.frombuffer(row[n], np.int64) for n in ("numbers", "ids", "labels"))
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(n, self.dim).astype(np.float64)
        fine = edges(self.dim)
        sizes = np.diff(fine).astype(np.float64)
        means, deviations = (np.frombuffer(row[c], np.float32).reshape(n, len(sizes)).astype(np.float64) for c in ("means", "deviations"))
        self.levels = [coarser(means, deviations, sizes), (means, deviations, sizes)]
        self.largest = float(np.abs(self.vectors).max(initial=0.0))
        self.by_id = np.empty(n, np.int64)
        self.by_id[np.argsort(self.ids, kind="stable")] = np.arange(n)
        self.labels_at = {int(v): np.flatnonzero(self.labels == v) for v in np.unique(self.labels)}


def _block(part: int, numbers, ids, labels, vectors: np.ndarray) -> dict:
    means, deviations = summaries(vectors)
    largest = np.abs(vectors).max(initial=0.0)
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    held = {"numbers": np.asarray(numbers, np.int64), "ids": np.asarray(ids, np.int64), "labels": np.asarray(labels, np.int64),
            "vectors": vectors.astype(kind), "means": means.astype(np.float32), "deviations": deviations.astype(np.float32)}
    return {"part": part, "dim": vectors.shape[1], "kind": kind} | {k: v.tobytes() for k, v in held.items()}


PACKED_SCHEMA = pa.schema([(n, pa.int32() if n in ("part", "dim") else pa.string() if n == "kind" else pa.binary()) for n in FIELDS])


def _packer(most: int | None) -> Callable:
    """Packs (id, label, vector, number) by dimension; rows without a number get one. ``most`` rows, or all of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, open_ = TaskContext.get().partitionId(), 0, {}
        emit = lambda dim: pa.RecordBatch.from_pylist([_block(task, *zip(*((n, i, l) for n, i, l, _ in open_[dim])), np.stack([v for *_, v in open_.pop(dim)]))], PACKED_SCHEMA)  # noqa: E731,E741
        for batch in batches:
            values, offsets = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(2).offsets.to_pylist()
            values = np.floor(values * SCALE) if batch.num_columns == 3 else values
            numbers = batch.column(3).to_pylist() if batch.num_columns == 4 else range((task << 40) + count, (task << 40) + count + batch.num_rows)
            count += batch.num_rows
            for k, (i, label, number) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), numbers)):
                a, b = offsets[k] - offsets[0], offsets[k + 1] - offsets[0]
                open_.setdefault(b - a, []).append((number, i, label, values[a:b]))
                if most and len(open_[b - a]) * max(1, b - a, COMPONENTS // most) >= COMPONENTS:
                    yield emit(b - a)
        for dim in sorted(open_):
            yield emit(dim)

    return run


FLAT = "id long, label long, vector array<double>, number long"
FLAT_SCHEMA = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64())), ("number", pa.int64())])


def _anchors(every: int) -> Callable:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows(row)
                own = np.flatnonzero(rows.ids % every == 0)
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows.ids[own]), pa.array(rows.labels[own]), pa.array(list(rows.vectors[own]), pa.list_(pa.float64())), pa.array(rows.numbers[own])],
                        schema=FLAT_SCHEMA,
                    )

    return run


class Best:
    """The first k of each slot: higher scores first, ties by smaller id, then row number."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot = self.score = self.id = self.number = np.zeros(0, np.int64)
        self.last = np.full(slots, NONE)  # score of the k-th; NONE while there are fewer

    def add(self, slot, score, ids, numbers) -> None:
        if not len(slot):
            return
        joined = [np.concatenate(c) for c in ((self.slot, slot), (self.score, score), (self.id, ids), (self.number, numbers))]
        order = np.lexsort((joined[3], joined[2], -joined[1], joined[0]))
        slot = joined[0][order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        kept = order[place < self.k]
        self.slot, self.score, self.id, self.number = (c[kept] for c in joined)
        full = place == self.k - 1
        self.last[slot[full]] = joined[1][order][full]


def left_by_bounds(a: Rows, some: np.ndarray, b: Rows, others: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Pairs that may score between ``least`` and ``most`` of their anchor: (anchor, row) indices, or None for all.

    In a segment the inner product is size * mean * mean plus that of what departs from the means, which the product of
    both deviations bounds on either side. Pairs that the coarse segments leave are bounded again by the fine ones. Slack
    covers the rounding of stored summaries.
    """
    slack = 1.0 + 1e-6 * a.largest * b.largest * max(a.dim, 1)
    if not a.dim or slack > 1e9:
        return None
    (ma, da, sizes), (mb, db, _) = a.levels[0], b.levels[0]
    middle, reach = (ma[some] * sizes) @ mb[others].T, da[some] @ db[others].T + slack
    may = (middle + reach >= least[:, None]) & (middle - reach <= most[:, None])
    if may.mean() > SPARSE:
        return None
    x, y = np.nonzero(may)
    (ma, da, sizes), (mb, db, _) = a.levels[1], b.levels[1]
    kept = []
    for i in range(0, len(x), 100_000):
        p, q = x[i : i + 100_000], y[i : i + 100_000]
        middle = np.einsum("ij,ij->i", ma[some[p]] * sizes, mb[others[q]])
        reach = np.einsum("ij,ij->i", da[some[p]], db[others[q]]) + slack
        kept.append((middle + reach >= least[p]) & (middle - reach <= most[p]))
    may = np.concatenate(kept) if kept else np.zeros(0, bool)
    return x[may], y[may]


def scores(a: Rows, some: np.ndarray, b: Rows, others: np.ndarray, pairs: bool) -> np.ndarray:
    """Exact inner products, of all combinations or of ``pairs``; one that no long can hold raises."""
    if a.largest * b.largest * max(a.dim, 1) < EXACT:
        x, y = a.vectors[some], b.vectors[others]
        return (np.einsum("ij,ij->i", x, y) if pairs else x @ y.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    x, y = whole(a.vectors[some]), whole(b.vectors[others])
    out = (x * y).sum(axis=1) if pairs else x @ y.T
    if any(not -(1 << 62) < v < 1 << 62 for v in out.flat):
        raise OverflowError("an inner product of these vectors does not fit a long")
    return out.astype(np.int64)


def compare(a: Rows, some, b: Rows, others, bands: list[tuple[np.ndarray, np.ndarray, np.ndarray]], best: Best, unlike: bool) -> None:
    """Add to ``best`` the rows of ``others`` that score within each (slots, least, most) of the anchors ``some``.

    Bands already narrowed to what may still enter; an anchor is never paired with its own row, and only with rows of
    another label if ``unlike``.
    """
    least, most = np.min([m[1] for m in bands], axis=0), np.max([m[2] for m in bands], axis=0)
    left = left_by_bounds(a, some, b, others, least, most)
    if left is not None:
        x, y = left
        found = scores(a, some[x], b, others[y], pairs=True) if len(x) else np.zeros(0, np.int64)
        fits = a.numbers[some[x]] != b.numbers[others[y]]
        if unlike:
            fits &= a.labels[some[x]] != b.labels[others[y]]
        for slots, lo, hi in bands:
            m = fits & (found >= lo[x]) & (found <= hi[x])
            best.add(slots[x[m]], found[m], b.ids[others[y[m]]], b.numbers[others[y[m]]])
        return
    found = scores(a, some, b, others, pairs=False)
    fits = a.numbers[some][:, None] != b.numbers[others][None, :]
    if unlike:
        fits &= a.labels[some][:, None] != b.labels[others][None, :]
    n = len(others)
    narrow = n == 0 or np.abs(found).max(initial=0) < (1 << 62) // n
    key = found * n + (n - 1 - np.argsort(np.argsort(b.by_id[others]))) if narrow else None
    for slots, lo, hi in bands:
        m = fits & (found >= lo[:, None]) & (found <= hi[:, None])
        with_any = np.flatnonzero(m.any(axis=1))
        if not len(with_any):
            continue
        if narrow and n > best.k:  # the first k of each anchor, before they meet those of other blocks
            part = np.where(m[with_any], key[with_any], NONE)
            top = np.argpartition(part, n - best.k, axis=1)[:, n - best.k :]
            x, y = np.repeat(with_any, best.k), top.ravel()
            kept = m[x, y]
            x, y = x[kept], y[kept]
        else:
            x, y = np.nonzero(m)
        best.add(slots[x], found[x, y], b.ids[others[y]], b.numbers[others[y]])


FOUND = "chunk int, dim int, spot int, place int, anchor_id long, positive_id long, positive_score long, id long, number long, score long"
FOUND_SCHEMA = pa.schema([(f.split(" ")[0], pa.int32() if f.split(" ")[1] == "int" else pa.int64()) for f in FOUND.split(", ")])


class PositiveSearch:
    """First rows of the anchors' own labels, over the blocks that pass by."""

    def __init__(self, row: dict) -> None:
        self.anchors = Rows(row)
        self.best = Best(len(self.anchors.ids), POSITIVES)

    def meet(self, block: Rows) -> None:
        a = self.anchors
        for label, own in a.labels_at.items():
            others = block.labels_at.get(label)
            if others is None:
                continue
            for i in range(0, len(own), TOGETHER):
                some = own[i : i + TOGETHER]
                compare(a, some, block, others, [(some, self.best.last[some], np.full(len(some), np.iinfo(np.int64).max))], self.best, unlike=False)

    def result(self) -> list:
        a, b = self.anchors, self.best
        none = np.zeros(len(b.slot), np.int64)
        return [b.slot, none, a.ids[b.slot], none, none, b.id, b.number, b.score]


class NegativeSearch:
    """First rows of other labels within the band of each anchor and positive."""

    def __init__(self, row: dict) -> None:
        self.anchors = Rows(row)
        n = len(self.anchors.ids)
        self.positive, self.of = np.full((n, POSITIVES), NONE), np.zeros((n, POSITIVES), np.int64)
        for p in row["positives"] or ():
            self.positive[p["spot"], p["place"]], self.of[p["spot"], p["place"]] = p["score"], p["id"]
        given = self.positive != NONE
        score = np.where(given, self.positive, -1)
        whole, rest = np.divmod(score, 100)  # in parts, as hundred times a score may not fit
        self.least = np.where(score >= 0, LEAST * whole - (-LEAST * rest) // 100, 1)
        self.most = np.where(score >= 0, MOST * whole + MOST * rest // 100, 0)
        self.best = Best(n * POSITIVES, NEGATIVES)

    def meet(self, block: Rows) -> None:
        a, every = self.anchors, np.arange(len(block.ids))
        wanted = np.flatnonzero((self.least <= self.most).any(axis=1))
        for i in range(0, len(wanted), TOGETHER):
            some = wanted[i : i + TOGETHER]
            slots = [some * POSITIVES + j for j in range(POSITIVES)]
            bands = [(s, np.maximum(self.least[some, j], self.best.last[s]), self.most[some, j]) for j, s in enumerate(slots)]
            compare(a, some, block, every, bands, self.best, unlike=True)

    def result(self) -> list:
        b = self.best
        spot, place = b.slot // POSITIVES, b.slot % POSITIVES
        return [spot, place, self.anchors.ids[spot], self.of[spot, place], self.positive[spot, place], b.id, b.number, b.score]


def _searched(kind: type) -> Callable:
    """Records sorted by chunk and piece: the anchors first, then their blocks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, key = None, None

        def finish():
            columns = search.result()
            head = [np.full(len(columns[0]), v) for v in key[:2]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*head, *columns], FOUND_SCHEMA)], schema=FOUND_SCHEMA)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                now = (row["chunk"], row["dim"], row["piece"])
                if not row["order"]:
                    if search is not None:
                        yield finish()
                    search, key = kind(row), now
                elif key == now:  # blocks whose dimension no anchor of the chunk has are left out
                    search.meet(Rows(row))
        if search is not None:
            yield finish()

    return run


PLACES = "array<struct<spot: int, place: int, id: long, score: long>>"


def _meetings(chunks: DataFrame, blocks: DataFrame, n_chunks: int, pieces: int) -> DataFrame:
    """Every chunk of anchors beside every block, in ``pieces`` tasks for each chunk."""
    first = chunks.select(F.col("part").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.lit(0).alias("order"), *FIELDS, "positives")
    then = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), F.pmod(F.xxhash64("numbers"), F.lit(pieces)).cast("int").alias("piece"),
                         F.lit(1).alias("order"), *FIELDS, F.lit(None).cast(PLACES).alias("positives"))
    return first.unionByName(then).repartition(2 * n_chunks * pieces, "chunk", "dim", "piece").sortWithinPartitions("chunk", "dim", "piece", "order")


def _first(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "number"))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, every: int = 50) -> DataFrame:
    """For each anchor and each of its positives the first rows of other labels whose score lies within the band.

    ``rows`` has id, label and vector as ``taking_part`` gives them. Anchors are the rows whose id ``every`` divides.
    Repeated rows count as often as they stand, also as anchors; an anchor is no positive of itself, an equal row is.
    Vectors of different lengths have no score with each other. A negative positive score leaves no negative. No rows,
    no anchors or one label give no result. Equal rows beyond a first k tie by id and come out alike.

    The anchors are the stated query set: each chunk of them meets each block of rows, so the work grows with anchors
    times rows. Blocks hold a bounded number of rows whatever their labels, so no label gathers in a task; a task holds
    one chunk, one block and the best few of each anchor, and the best of tasks meet in groups of a few rows. The positives
    are stored, as their scores bound the second search.
    """
    spark = rows.sparkSession
    blocks = rows.repartition(max(1, -(-rows.count() // PACKED_ROWS))).mapInArrow(_packer(BLOCK_ROWS), PACKED)
    blocks = stored(blocks, "blocks")
    flat = stored(blocks.mapInArrow(_anchors(every), FLAT), "anchors")
    n_anchors, components = flat.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    n_chunks = max(1, -(-n_anchors // CHUNK_ANCHORS), -(-components // COMPONENTS))
    chunks = stored(flat.repartition(n_chunks).mapInArrow(_packer(None), PACKED), "chunks")
    pieces = max(1, min(blocks.count(), -(-4 * spark.sparkContext.defaultParallelism // n_chunks)))
    alone = chunks.withColumn("positives", F.lit(None).cast(PLACES))
    near = _meetings(alone, blocks, n_chunks, pieces).mapInArrow(_searched(PositiveSearch), FOUND)
    positives = stored(_first(near, ["chunk", "dim", "spot"], POSITIVES), "positives")
    of_chunk = positives.groupBy(F.col("chunk").alias("part"), "dim").agg(
        F.collect_list(F.struct("spot", (F.col("rank") - 1).alias("place"), "id", "score")).alias("positives")  # a chunk's anchors times five
    )
    given = chunks.join(of_chunk, ["part", "dim"], "left").select(*FIELDS, F.col("positives").cast(PLACES).alias("positives"))
    found = _meetings(given, blocks, n_chunks, pieces).mapInArrow(_searched(NegativeSearch), FOUND)
    return _first(found, ["chunk", "dim", "spot", "place"], NEGATIVES).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
