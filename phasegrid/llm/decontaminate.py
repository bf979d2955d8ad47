"""Benchmark decontamination: passages of documents against a BM25 index of test items, with block-max WAND."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import arrow_schema, slices

#: Words of a passage and steps between passages: an item of up to 64 words lies whole in one of them.
PASSAGE, STEP = 128, 64
#: A longer item is retrieved by its pieces too, of STEP words and so many words apart: each lies whole in a passage.
PIECE_STEP = 32
#: Share of an item's own score that a passage has to reach.
LEAST_SHARE = 0.6
#: Shares of the question's and the answer's grams that a confirmed passage has to hold.
LEAST_QUESTION, LEAST_ANSWER, GRAM = 0.5, 0.5, 3
#: Part of an item that counts as its answer: what follows the last line break, or this share of its last words.
ANSWER_SHARE = 0.25
K1, B = 1.2, 0.75
BLOCK = 4
#: Items of a group, whose maxima are asked first for a whole passage.
GROUP = 4
#: Frequent terms are left out of that question as long as all of them together give no item more than this share.
LIGHT_SHARE = 0.25
#: Items and pieces of one part of the index; more of them make more parts, and each part is sent and searched by itself.
PART_ITEMS = 1024
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and other letters, so that punctuation and case do not matter."""
    return (text or "").encode().translate(ALNUM).split()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """An item's last line, or the last quarter of its words, is its answer; the rest is the question."""
    lines = [w for w in map(item_words, (text or "").split("\n")) if w]
    if len(lines) > 1:
        return [w for line in lines[:-1] for w in line], lines[-1]
    words = lines[0] if lines else []
    cut = len(words) - max(1, round(len(words) * ANSWER_SHARE)) if words else 0
    return words[:cut], words[cut:]


def grams_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    size = min(GRAM, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def entries_of(words: list[bytes]) -> list[list[bytes]]:
    """What stands in the index for an item: all its words and, if they are more than STEP, its pieces."""
    starts = [*range(0, len(words) - STEP, PIECE_STEP), len(words) - STEP] if len(words) > STEP else []
    return [words, *(words[i : i + STEP] for i in starts)]


@dataclass
class Index:
    """Postings of one part: for a term its entries (ordinals, rising), its share of each entry's own score, block maxima.

    Entries are items and pieces of long ones; ``owner`` is the entry's item as its place among the rows."""

    items: list[int]
    owner: list[int]
    postings: dict[bytes, tuple[list[int], list[float]]]
    block_max: dict[bytes, list[float]]
    parts: list[tuple[set, set, int]]
    number: dict[bytes, int]
    group_max: np.ndarray
    light: float


def build_index(rows: list[tuple[int, str]], document_count: int, frequency: dict[bytes, int], mean_words: float) -> Index:
    """BM25 weights over all items, divided by the item's own score, so that one threshold fits every item."""
    items, owner, parts, weights = [], [], [], []
    for place, (item, text) in enumerate(sorted(rows, key=lambda r: (r[0], r[1]))):
        words = item_words(text)
        if not words:
            continue
        question, answer = question_and_answer(text)
        part = (grams_of(question), grams_of(answer), len(words))
        for entry in entries_of(words):
            counts, norm = Counter(entry), K1 * (1 - B + B * len(entry) / mean_words)
            own = {t: np.log1p((document_count - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in counts.items()}
            total = sum(own.values())
            weights.append({t: float(w / total) for t, w in own.items()})
            items.append(item)
            owner.append(place)
            parts.append(part)
    postings: dict[bytes, tuple[list[int], list[float]]] = {}
    for ordinal, own in enumerate(weights):
        for term, weight in own.items():
            at, each = postings.setdefault(term, ([], []))
            at.append(ordinal)
            each.append(weight)
    block_max = {t: [max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for t, (_, w) in postings.items()}
    left_out, lifted, light = set(), [0.0] * len(items), 0.0
    for term in sorted(postings, key=lambda t: (-frequency[t], t)):
        reached = max(lifted[i] + w for i, w in zip(*postings[term]))
        if max(light, reached) > LIGHT_SHARE:
            break
        left_out.add(term)
        light = max(light, reached)
        for i, w in zip(*postings[term]):
            lifted[i] += w
    number = {t: i + 1 for i, t in enumerate(t for t in postings if t not in left_out)}
    group_max = np.zeros((len(number) + 1, max(1, -(-len(items) // GROUP))), np.float32)
    for term, row in number.items():
        at, each = postings[term]
        np.maximum.at(group_max[row], np.array(at) // GROUP, np.array(each, np.float32))
    return Index(items, owner, postings, block_max, parts, number, group_max, light)


def search(index: Index, terms: list[bytes], least: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
    """(ordinal, score) of every item from ``low`` up to ``high`` whose score for these distinct terms reaches ``least``.

    Block-max WAND.

    Lists are kept by their current item. The pivot is the first item that the lists up to it could lift over the
    threshold; their block maxima are then asked, and either the item is scored or the lists jump past the blocks.
    """
    found, slack = [], 1e-9
    end = len(index.items) if high is None else min(high, len(index.items))
    lists = []
    for t in terms:
        at, each = index.postings[t]
        i, j = bisect_left(at, low), bisect_left(at, end)
        if i < j:
            lists.append([at[i], i, at, each, index.block_max[t], max(each[i:j])])
    while lists:
        lists.sort(key=lambda p: p[0])
        bound, pivot = 0.0, -1
        for i, p in enumerate(lists):
            bound += p[5]
            if bound + slack >= least:
                pivot = i
                break
        if pivot < 0:
            break
        target = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
            pivot += 1
        in_blocks, next_item = 0.0, end
        for p in lists[: pivot + 1]:
            i = bisect_left(p[2], target, p[1])
            if i < len(p[2]):
                in_blocks += p[4][i // BLOCK]
                last = min((i // BLOCK + 1) * BLOCK, len(p[2])) - 1
                next_item = min(next_item, p[2][last] + 1)
        if in_blocks + slack < least:
            # no item before the end of the nearest block, nor before the next list, can reach the threshold
            to = max(target + 1, min(next_item, lists[pivot + 1][0] if pivot + 1 < len(lists) else end))
        else:
            score = 0.0
            for p in lists[: pivot + 1]:
                i = bisect_left(p[2], target, p[1])
                if i < len(p[2]) and p[2][i] == target:
                    score += p[3][i]
            if score + slack >= least:
                found.append((target, score))
            to = target + 1
        left = []
        for p in lists:
            if p[0] < to:
                p[1] = bisect_left(p[2], to, p[1])
                if p[1] == len(p[2]) or p[2][p[1]] >= end:
                    continue
                p[0] = p[2][p[1]]
            left.append(p)
        lists = left
    return found


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share, start) of every item found in a document.

    Each passage of each whole text is a query; every item over the threshold is retrieved and kept if the grams of its
    question and of its answer are found in the passage in the given shares; the best passage of a document and item is
    returned. An item of more than 64 words is retrieved by itself or by any of its overlapping pieces of 64 words, and
    confirmed as a whole around the passage. ``score`` is the BM25 score as a share of the item's own (of the best
    piece's, if that is more), ``start`` the passage's first word. Null and empty texts and items match nothing; a null id stays null; repeated documents and items give a row each id pair.

    Item statistics come from all items. The index is cut into parts of bounded size, so the benchmark may grow: each
    part is sent to the tasks and searched in a pass of its own. Documents are neither shuffled nor collected.
    """
    found = None
    for held in index_parts(items, item_key, item_text):
        one = _search_documents(docs, held, key, text)
        found = one if found is None else found.unionByName(one)
    return found


def index_parts(items: DataFrame, item_key: str = "item_id", item_text: str = "text") -> list:
    """The parts of the index of all items, each a broadcast."""
    spark = items.sparkSession
    items = items.select(F.col(f"`{item_key}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").distinct()

    def terms(batches):
        for part in slices(batches):
            rows = [(item, t, len(words)) for item, words in zip(part.column(0).to_pylist(), map(item_words, part.column(1).to_pylist())) for t in set(words)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "term", "size"])

    listed = items.mapInArrow(terms, "item_id long, term binary, size long").cache()
    try:
        sizes = listed.select("item_id", "size").distinct()
        entries = F.when(F.col("size") > STEP, F.lit(2) + F.ceil((F.col("size") - STEP) / PIECE_STEP)).otherwise(1)
        totals = sizes.agg(F.count(F.lit(1)).alias("items"), F.avg("size").alias("mean"), F.sum(entries).alias("entries")).first()
        parts = max(1, -(-(totals["entries"] or 0) // PART_ITEMS))
        frequency = listed.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        part_of = F.pmod(F.xxhash64("item_id"), F.lit(parts))
        out = []
        for number in range(parts):
            rows = [(r["item_id"], r["text"]) for r in items.where(part_of == number).collect()]
            own = listed.where(part_of == number).select("term").distinct().join(frequency, "term")
            index = build_index(rows, totals["items"], {bytes(r["term"]): r["df"] for r in own.collect()}, totals["mean"] or 1.0)
            out.append(spark.sparkContext.broadcast(index))
    finally:
        listed.unpersist()
    return out


def _search_documents(docs: DataFrame, held, key: str, text: str) -> DataFrame:
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double, start long"
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, target = held.value, arrow_schema(schema)
        for part in slices(batches):
            rows = []
            for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows += [(doc, *hit) for hit in leaks_of(value, index)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    return docs.mapInArrow(run, schema)


def open_passages(index: Index, at: np.ndarray) -> list[tuple[int, int]]:
    """(passage, group) where the group's maxima of the passage's words could reach the threshold.

    A passage is two steps. Repeated words count repeatedly here, which only lets more through.
    """
    at = np.append(at, np.zeros(-len(at) % STEP, np.int64)).reshape(-1, STEP)
    ones = np.ones(STEP, np.float32)
    step = np.concatenate([ones @ index.group_max[at[low : low + 256]] for low in range(0, len(at), 256)])
    both = step[:-1] + step[1:] if len(step) > 1 else step
    return list(zip(*(x.tolist() for x in np.nonzero(both >= LEAST_SHARE - index.light - 1e-3))))


def leaks_of(value: str | None, index: Index) -> list[tuple]:
    """(item, score, question share, answer share, start) of the items that a text leaks."""
    words = item_words(value)
    if not words or not index.items:
        return []
    at = np.fromiter(map(index.number.get, words, repeat(0)), np.int64, len(words))
    best: dict[int, tuple] = {}
    last, here, terms, shares_of = -1, np.zeros(0, np.int64), [], {}
    for passage, group in open_passages(index, at):
        start = passage * STEP
        if passage != last:
            last, here = passage, np.unique(at[start : start + PASSAGE])
            terms, shares_of = [], {}
        if index.group_max[here, group].sum() < LEAST_SHARE - index.light - 1e-3:
            continue
        terms = terms or list({w for w in words[start : start + PASSAGE] if w in index.postings})
        for ordinal, score in search(index, terms, LEAST_SHARE, group * GROUP, (group + 1) * GROUP):
            owner = index.owner[ordinal]
            if owner not in shares_of:
                question, answer, size = index.parts[ordinal]
                # an item longer than the overlap of two passages is checked with as many words more on both sides
                grams = grams_for(words[max(0, start - size) : start + PASSAGE + size], question | answer)
                shares_of[owner] = [len(part & grams) / len(part) if part else 1.0 for part in (question, answer)]
            shares = shares_of[owner]
            if shares[0] >= LEAST_QUESTION and shares[1] >= LEAST_ANSWER:
                hit = (score, *shares, start, index.items[ordinal])
                old = best.get(owner)
                if old is None or (hit[0], -hit[3]) > (old[0], -old[3]):
                    best[owner] = hit
    return [(item, *hit) for _, (*hit, item) in sorted(best.items())]


def grams_for(words: list[bytes], wanted: set[tuple]) -> set[tuple]:
    """The grams of the words in every length that ``wanted`` has."""
    return {tuple(words[i : i + n]) for n in {len(g) for g in wanted} for i in range(len(words) - n + 1)}
