"""Token counts: pieces counted once for each distinct pre-token, joined to the documents' pre-token frequencies."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import arrow_schema, id_and_text, slices, tokenizer_text

#: A block of documents closes at so many distinct pre-tokens, which bounds the memory of a task and of a group.
BLOCK_PRETOKENS = 600_000
TOKEN_LIMIT = 1024
ENCODE_AT_ONCE = 2000
#: Rows of pre-tokens in one batch, and pre-tokens whose counts a task gathers before it hands them on by block.
WORD_ROWS, GATHERED = 20_000, 500_000
#: Texts of these characters alone split alike in Python's engine and in the tokenizer's.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


class Splitter:
    """Pre-tokens of a byte-level BPE tokenizer; strings of special tokens become pre-tokens of their own."""

    def __init__(self, definition: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special and "<" in text:
            out: list[str] = []
            for i, part in enumerate(self.special.split(text)):
                out += [part] if i % 2 else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PLAIN_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pretokens: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(pretokens), ENCODE_AT_ONCE):
            found = self.tokenizer.encode_batch_fast(pretokens[i : i + ENCODE_AT_ONCE], add_special_tokens=False)
            out += [len(e.ids) for e in found]
        return out


def packed(a: np.ndarray) -> bytes:
    """32-bit numbers, their bytes sorted by rank, which compress well."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32)[:, 0].astype(np.int64)


DOC_COLUMNS = "doc_ids binary, has_id binary, n_bytes binary, distinct binary, places binary, counts binary"
BLOCK_SCHEMA = f"block long, place int, pretoken string, {DOC_COLUMNS}"
COUNT_SCHEMA = f"block long, place binary, n binary, {DOC_COLUMNS}"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, without a list of ids anywhere.

    A task cuts its documents into blocks. A block gives one row for each distinct pre-token, and rows with
    the frequencies of up to 128 documents as places in that list. Pre-tokens meet by their text, each is encoded once for
    all blocks, and the counts go back to the block in packed rows, where they are summed over the frequencies. A frequent pre-token has one row for
    each block, never one for each document. A null text counts as empty (0 bytes, 0 tokens); repeated rows are counted
    each; a null id stays null.
    """
    context = docs.sparkSession.sparkContext
    definition = context.broadcast(tokenizer_text(tokenizer))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, target = Splitter(definition.value), arrow_schema(BLOCK_SCHEMA)
        block = TaskContext.get().partitionId() << 24
        known: dict[str, int] = {}

        def words() -> Iterator[pa.RecordBatch]:
            rest, done = iter(known), 0
            while part := list(islice(rest, WORD_ROWS)):
                n = len(part)
                columns = {"block": [block] * n, "place": range(done, done + n), "pretoken": part}
                done += n
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in target], schema=target)

        for part in slices(batches):
            texts = [value or "" for value in part.column(1).to_pylist()]
            places, counts = [], []
            for value in texts:
                seen = Counter(split(value))
                for pretoken in seen:
                    known.setdefault(pretoken, len(known))
                place = np.fromiter(map(known.__getitem__, seen), np.int64, len(seen))
                order = np.argsort(place, kind="stable")
                places.append(np.diff(place[order], prepend=0))
                counts.append(np.fromiter(seen.values(), np.int64, len(seen))[order])
            columns = {
                "block": [block], "doc_ids": [part.column(0).fill_null(0).to_numpy().tobytes()],
                "has_id": [part.column(0).is_valid().to_numpy(zero_copy_only=False).tobytes()],
                "n_bytes": [np.array([len(t.encode()) for t in texts], np.int64).tobytes()],
                "distinct": [np.array(list(map(len, places)), np.int64).tobytes()], "places": [packed(np.concatenate(places))], "counts": [packed(np.concatenate(counts))],
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None]), f.type) for f in target], schema=target)
            if len(known) >= BLOCK_PRETOKENS:
                yield from words()
                known.clear()
                block += 1
        yield from words()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, target = Splitter(definition.value), arrow_schema(COUNT_SCHEMA)
        counted: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def gathered() -> Iterator[pa.RecordBatch]:
            """One row for each block in what is held: places and counts of its pre-tokens."""
            if not held:
                return
            block, place, n = (np.concatenate(column) for column in zip(*held))
            held.clear()
            order = np.argsort(block, kind="stable")
            block, place, n = block[order], place[order], n[order]
            starts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            ends = np.append(starts[1:], len(block))
            columns = {"block": block[starts], **{k: [packed(v[a:b]) for a, b in zip(starts, ends)] for k, v in (("place", place), ("n", n))}}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(starts), f.type) for f in target], schema=target)

        for batch in batches:
            is_word = batch.column("pretoken").is_valid()
            docs = batch.filter(pc.invert(is_word))
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(docs.num_rows, f.type) if f.name in ("place", "n") else docs.column(f.name) for f in target], schema=target)
            listed = batch.select(["block", "place", "pretoken"]).filter(is_word)
            if not listed.num_rows:
                continue
            words = listed.column("pretoken").to_pylist()
            new = [w for w in dict.fromkeys(words) if w not in counted]
            if len(counted) + len(new) > GATHERED:
                counted.clear()
                new = list(dict.fromkeys(words))
            counted.update(zip(new, split.pieces(new)))
            held.append((listed.column("block").to_numpy(), listed.column("place").to_numpy(), np.fromiter(map(counted.__getitem__, words), np.int64, len(words))))
            if sum(len(h[0]) for h in held) >= GATHERED:
                yield from gathered()
        yield from gathered()

    def total(group: pa.Table) -> pa.Table:
        words = group.filter(group["place"].is_valid())
        rows = group.filter(group["place"].is_null())
        place = [unpacked(p) for p in words["place"].to_pylist()]
        counts = np.zeros(sum(map(len, place)), np.int64)
        for at, n in zip(place, words["n"].to_pylist()):
            counts[at] = unpacked(n)
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_tokens": []}
        for row in rows.select(["doc_ids", "has_id", "n_bytes", "distinct", "places", "counts"]).to_pylist():
            ids, sizes, distinct = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "n_bytes", "distinct"))
            ends = np.cumsum(distinct)
            running = np.cumsum(unpacked(row["places"]))
            # places are steps within each document: what went before it is taken off
            before = np.concatenate([[0], running])[ends - distinct]
            place = running - np.repeat(before, distinct)
            tokens = np.concatenate([[0], np.cumsum(counts[place] * unpacked(row["counts"]))])
            has = np.frombuffer(row["has_id"], bool)
            out["doc_id"] += [i if known else None for i, known in zip(ids.tolist(), has)]
            out["n_bytes"] += sizes.tolist()
            out["n_tokens"] += (tokens[ends] - tokens[ends - distinct]).tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    made = id_and_text(docs, key, text).mapInArrow(blocks, BLOCK_SCHEMA)
    # rows of documents have no pre-token; they are spread by block and id instead of meeting at null
    spread = F.when(F.col("pretoken").isNull(), F.xxhash64("block", "n_bytes")).otherwise(F.xxhash64("pretoken"))
    counted = made.repartition(spread).mapInArrow(pieces, COUNT_SCHEMA)
    summed = counted.groupBy("block").applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
