"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import SLICE_ROWS, arrow_schema, id_and_text, map_texts, slices

GRAMS = (2, 3)
BUCKETS = 1 << 15
#: Languages that a model may have; the matrix has this many rows of len(GRAMS) * BUCKETS at most.
MOST_LANGUAGES = 256
SMOOTHING = 0.1
UNKNOWN = "und"


@lru_cache(1)
def _folding() -> np.ndarray:
    """For every code point its lower-case letter, or a space where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000 and (c := chr(code)).isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each gram size: buckets of all grams of all texts, and first and last-plus-one gram of each text.

    Letters are lower-cased, each run of other characters is one space, and a text stands between spaces.
    """
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]).astype(np.int64)
    folded = _folding()[codes]
    space = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[starts[:-1]] = True
    folded = folded[keep]
    starts = np.concatenate([[0], np.cumsum(keep)])[starts]
    out: tuple[list, list, list] = ([], [], [])
    for k, size in enumerate(GRAMS):
        n = max(0, len(folded) - size + 1)
        h = np.zeros(n, np.uint32)
        for i in range(size):
            h = h * np.uint32(0x01000193) ^ folded[i : i + n]
        h *= np.uint32(0x9E3779B1)
        out[0].append((h >> np.uint32(17)).astype(np.int64) + k * BUCKETS)
        out[1].append(starts[:-1])
        out[2].append(np.maximum(starts[1:] - size + 1, starts[:-1]))
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(docs: DataFrame, label: str = "lang", use: Column | None = None, text: str = "text"):
    """Languages and their log-probabilities from labelled rows; returns (languages, prior, matrix).

    All rows that ``use`` selects and that have a label and a letter count. Tasks add up their gram counts, so the
    shuffle holds at most languages x buckets rows from each task; as much reaches the driver.
    """
    chosen = docs if use is None else docs.where(use)
    wanted = chosen.select(F.col(f"`{label}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = wanted.where("lang is not null and text is not null")
    schema = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            rows: dict[str, list[str]] = {}
            for lang, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if has_letter(value):
                    rows.setdefault(lang, []).append(value)
            for lang, values in rows.items():
                total = sums.setdefault(lang, np.zeros(len(GRAMS) * BUCKETS + 1, np.int64))
                total[-1] += len(values)
                for h, first, last in zip(*grams(values)):
                    marks = np.zeros(len(h) + 1, np.int64)
                    np.add.at(marks, first, 1)
                    np.add.at(marks, last, -1)
                    inside = np.cumsum(marks[:-1]) > 0
                    total[:-1] += np.bincount(h[inside], minlength=len(total) - 1)
        target = arrow_schema(schema)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], schema=target)

    counted = wanted.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toArrow().to_pydict()
    languages = sorted(set(rows["lang"]))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model holds {MOST_LANGUAGES}")
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((len(languages), len(GRAMS) * BUCKETS + 1))
    table[[place[x] for x in rows["lang"]], rows["bucket"]] = rows["n"]
    prior = np.log(table[:, -1] / max(1.0, table[:, -1].sum())) if languages else np.zeros(0)
    matrix = table[:, :-1] + SMOOTHING
    for k in range(len(GRAMS)):
        part = matrix[:, k * BUCKETS : (k + 1) * BUCKETS]
        part /= part.sum(axis=1, keepdims=True)
    return languages, prior, np.log(matrix).astype(np.float32)


def score_texts(texts: list[str | None], languages: list[str], prior: np.ndarray, matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language of each text and its posterior probability; ``und`` and 0 for texts without a letter."""
    if len(texts) > SLICE_ROWS:
        parts = [score_texts(texts[i : i + SLICE_ROWS], languages, prior, matrix) for i in range(0, len(texts), SLICE_ROWS)]
        return [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
    found, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)] if languages else []
    if not known:
        return found, score
    h, first, last = grams([texts[i] for i in known])
    sums = np.tile(prior, (len(known), 1))
    for buckets, a, b in zip(h, first, last):
        for k, row in enumerate(matrix):
            running = np.concatenate([[0.0], np.cumsum(row[buckets], dtype=np.float64)])
            sums[:, k] += running[b] - running[a]
    sums -= sums.max(axis=1, keepdims=True)
    best, share = sums.argmax(axis=1), 1 / np.exp(sums).sum(axis=1)
    for i, k, s in zip(known, best, share):
        found[i], score[i] = languages[k], float(s)
    return found, score


def predict(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row by its whole text.

    A null text and one without a letter give ``und`` with score 0, as does a model without languages. Ties go to the
    language that sorts first; repeated rows are judged alike; a null id stays null. One narrow stage.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        found, score = score_texts(texts, *held.value)
        return {"doc_id": ids, "lang_pred": found, "score": score}

    return map_texts(id_and_text(docs, key, text), run, "doc_id long, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Rows kept for testing: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))
