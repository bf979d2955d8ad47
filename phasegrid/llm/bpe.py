"""BPE encoding and decoding with content-defined chunks: equal chunks are encoded once, joins are encoded anew."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
from pyspark.sql import DataFrame

from phasegrid.llm.common import id_and_text, map_texts, tokenizer_text

#: Bytes that decide a cut, and bits of their hash that have to be zero: chunks have 1 KB on average.
WINDOW, CUT_BITS = 8, 10
#: Text that a task keeps encoded, in bytes, and words that it keeps; both start anew when full.
CHUNK_BYTES, WORD_ENTRIES = 12_000_000, 400_000
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)
SPACES = b" \t\n\r\x0b\x0c"
#: Stands between new words that are encoded in one call; a word that holds it is encoded by itself.
BETWEEN = b"\0"
#: A word of letters and one of these has two pieces.
MARKS = ",.;:!?"
#: A definition has to encode and decode these as their words one by one do; they hold what kinds of tokenizers differ in.
PROBES = ("a b", "Hello  world, 12 345", " it's <|endoftext|> don't\n\n\tX\u0301 ", "\u00e9t\u00e9 \u4f60\u597d \U0001f600x \u00a0 y", "")


def chunks(data: bytes) -> list[bytes]:
    """The text cut where a rolling hash of the last bytes says so: equal passages are cut alike wherever they stand.

    No cut lies inside a character of UTF-8.
    """
    codes = np.frombuffer(data, np.uint8)
    n = len(codes) - WINDOW
    if n <= 0:
        return [data] if data else []
    gear = GEAR[codes]
    rolled = gear[:n].copy()
    for k in range(1, WINDOW):
        rolled = (rolled << np.uint32(1)) + gear[k : k + n]
    ends = np.flatnonzero((rolled >> np.uint32(32 - CUT_BITS)) == 0) + WINDOW
    ends = ends[(codes[ends] & 0xC0) != 0x80]
    return [data[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(data)])]


class Encoder:
    """Encodings of words and chunks as packed 32-bit ids.

    White space always parts pieces in this kind of tokenizer, so the words between white space encode independently.
    A chunk keeps the encoding of what stands between its first and last white space; its open ends depend on the
    neighbours.
    """

    def __init__(self, definition: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = {i: token for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = [vocabulary.get(i, "") for i in range(max(vocabulary) + 1)]
        self.numbers = [str(i) for i in range(len(self.names))]
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.closes = np.array([bool(suffix) and n.endswith(suffix) for n in self.names])
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.held = 0
        between = self.whole(BETWEEN.decode())
        if len(between) != 1:
            raise ValueError("this tokenizer has no single piece for the zero byte")
        self.between = between[0]
        for probe in PROBES:
            ids = self.whole(probe).tolist()
            if self.encode(probe)[1:] != (" ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)):
                raise ValueError("this tokenizer does not encode the words between white space independently")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def encode_words(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.words.__getitem__, words))

    def learn(self, words: list[bytes]) -> None:
        """Encode the words not known yet in two calls.

        Words of letters, with or without one mark at the end, have one or two pieces, whose last tokens show their
        ends. The others stand between separators.
        """
        new = list(set(words).difference(self.words))
        if len(self.words) + len(new) > WORD_ENTRIES:
            self.words.clear()
            new = list(set(words))
        simple, mixed, single = [], [], []
        for word in new:
            text = word.decode()
            n = 1 if text.isalpha() else 2 if text[-1] in MARKS and text[:-1].isalpha() else 0
            if n:
                simple.append((word, text, n))
            else:
                (single if BETWEEN in word else mixed).append((word, text))
        if simple:
            listed, texts, pieces = zip(*simple)
            found = self.whole(" ".join(texts))
            ends, need = np.flatnonzero(self.closes[found]) + 1, np.cumsum(pieces)
            # a word can have more pieces than so, never less; equal sums mean that each has its number
            if len(ends) == need[-1]:
                self.keep(listed, found, ends[need - 1], 0)
            else:
                mixed += zip(listed, texts)
        if mixed:
            listed, texts = zip(*mixed)
            found = self.whole(f" {BETWEEN.decode()} ".join(texts))
            self.keep(listed, found, np.append(np.flatnonzero(found == self.between), len(found)), 1)
        for word, text in single:
            self.words[word] = self.whole(text).tobytes()

    def keep(self, words, found: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Each word's ids end at its place of ``ends``; ``gap`` ids stand between two words."""
        data, ends = found.tobytes(), (4 * ends).tolist()
        starts = [0, *(e + 4 * gap for e in ends[:-1])]
        self.words.update(zip(words, [data[a:b] for a, b in zip(starts, ends)]))

    def encode_chunk(self, chunk: bytes) -> tuple | None:
        """(open head, encoding of the middle, open tail); None for a chunk without white space."""
        if chunk in self.chunks:
            return self.chunks[chunk]
        head = chunk.translate(ASCII_SPACE).split(b" ", 1)
        if len(head) == 1:
            found = None
        else:
            middle, _, tail = chunk[len(head[0]) :].translate(ASCII_SPACE).rpartition(b" ")
            found = (head[0], self.encode_words(middle.split()), tail)
        if self.held > CHUNK_BYTES:
            self.chunks.clear()
            self.held = 0
        self.chunks[chunk] = found
        self.held += len(chunk)
        return found

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text).

        Chunk encodings joined; each open join grows until white space ends it, and is encoded as a whole.
        """
        parts, waiting = [], []
        for chunk in chunks(text.encode()):
            found = self.encode_chunk(chunk)
            if found is None:
                waiting.append(chunk)
                continue
            head, middle, tail = found
            if waiting or head:
                parts.append(self.encode_words(b"".join([*waiting, head]).split()))
            parts.append(middle)
            waiting = [tail] if tail else []
        if waiting:
            parts.append(self.encode_words([b"".join(waiting)]))
        ids = np.frombuffer(b"".join(parts), np.int32).tolist()
        return len(ids), " ".join(map(self.numbers.__getitem__, ids)), " ".join(map(self.names.__getitem__, ids))


ASCII_SPACE = bytes(32 if c in SPACES else c for c in range(256))


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row for each document: n_tokens, digests of its ids and of its decoded text; with ``ids`` also ids and text.

    Equal to encoding each whole text by the tokenizer itself (no special tokens added) and decoding the ids with
    special tokens kept. A null or empty text has no ids and decodes to an empty text; repeated rows are encoded alike;
    a null id stays null. One narrow stage: chunks are kept for the whole task, so a passage that its documents share
    is encoded once there; text is never shuffled. The kept chunks and words have fixed limits. A tokenizer in which white
    space does not part pieces, or whose decoder does more than join tokens by a space, raises a ValueError.
    """
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))
    workers: dict[int, Encoder] = {}

    def run(doc_ids, texts):
        if 0 not in workers:
            workers[0] = Encoder(definition.value)
        workers[0].learn(b" ".join([(t or "").encode() for t in texts]).split())
        found = [workers[0].encode(t or "") for t in texts]
        out = {
            "doc_id": doc_ids,
            "n_tokens": [n for n, _, _ in found],
            "ids_sha256": [hashlib.sha256(i.encode()).hexdigest() for _, i, _ in found],
            "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, _, d in found],
        }
        if ids:
            out |= {"ids": [list(map(int, i.split())) for _, i, _ in found], "decoded": [d for _, _, d in found]}
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(id_and_text(docs, key, text), run, schema + (", ids array<int>, decoded string" if ids else ""))
