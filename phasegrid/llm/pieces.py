"""SentencePiece BPE encoding and decoding: merge rounds over the words of a slice as flat numpy arrays."""

from __future__ import annotations

import hashlib
import heapq
import re
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from phasegrid.llm.common import CACHE_WORDS, id_and_text, map_texts

SPACE = "▁"
#: Words of more characters are merged one by one with a heap and not kept.
LONG_WORD = 128
#: Characters of new words that go through the rounds together.
ROUND_CHARS = 200_000
NO_PAIR, NO_RANK = -1, np.int64(1) << 30
#: Rounds see characters without a piece as symbols below this; they merge with nothing and are written as bytes.
UNKNOWN = -2
SIZE, PROBES = 1 << 19, 64
EMPTY, HAS_IDS = (0, "", ""), itemgetter(0)


class Pieces:
    """What the rounds need of a model: single characters, pairs of pieces that are a piece, and its rank.

    Raises for a model whose rules are not the ones built here: merges by score with byte fallback, a space put before
    the text, spaces kept and written as one symbol, and no piece that goes on behind a space or holds a line break.
    """

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor()
        self.library.load_from_serialized_proto(model)
        sp, n = self.library, self.library.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.names = [sp.id_to_piece(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.of_byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.char = np.full(0x110000, UNKNOWN, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        found = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, self.made = (np.array(c, np.int64) for c in zip(*found))
        self.pairs = dict(zip(zip(left.tolist(), right.tolist()), self.made.tolist()))
        self._place(left * n + right)
        self.n = n
        self.numbers = [str(i) for i in range(n)]
        self.written = [p.replace(SPACE, " ") for p in self.names]
        self._check(ids)

    def _place(self, keys: np.ndarray) -> None:
        """An open-addressing table of pair keys; every key sits within PROBES places of its hash."""
        self.slots, self.values = np.full(SIZE + PROBES, -1, np.int64), np.full(SIZE + PROBES, NO_PAIR, np.int32)
        at, left = self._hash(keys), np.arange(len(keys))
        self.reach = 0
        while len(left):
            self.reach += 1
            if self.reach > PROBES:
                raise ValueError("the pairs of this model do not fit the table")
            free = self.slots[at[left]] == -1
            self.slots[at[left[free]]] = keys[left[free]]  # of keys for one place the last one stays
            sits = self.slots[at[left]] == keys[left]
            self.values[at[left[sits]]] = self.made[left[sits]]
            left = left[~sits]
            at[left] += 1

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, or NO_PAIR."""
        keys = left.astype(np.int64) * self.n + right
        out = np.full(len(keys), NO_PAIR, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._hash(keys[open_])
        for _ in range(self.reach):
            held = self.slots[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (held != -1)
            open_, at = open_[more], at[more] + 1
            if not len(open_):
                break
        return out

    def _check(self, ids: dict[str, int]) -> None:
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("pieces of this model go across words")
        odd = ["", " ", "  a  b ", "a\tb\nc\r", " x　y", "ﬁ Ａ é é", "​﻿z", f"a{SPACE}b", "\U0001f600 你好", "x\x00y", "<s> </s> <unk> <0x41>"]
        for text in [*odd, *self.written[:: max(1, self.n // 500)]]:
            n, found, decoded = encode_all(self, {}, [text])[0]
            want = self.library.encode(text)
            if found != ",".join(map(str, want)) or n != len(want) or decoded != self.library.decode(want):
                raise ValueError(f"this model does not encode {text!r} by merges of words")


def merge_rounds(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words one after the other, the bounds of each word in them, and characters for unknown symbols.

    A round looks up the least rank of each word's pairs, the leftmost of equals, and merges it in all words at once;
    only pairs beside a merge are looked up anew. Words without a pair leave the arrays.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    symbols = pieces.char[codes]
    symbols = np.where(symbols == UNKNOWN, UNKNOWN - codes, symbols).astype(np.int32)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    done_symbols, done_words = [], []
    made = np.full(len(symbols), NO_PAIR, np.int32)  # of a symbol and the one behind it
    inner = np.flatnonzero(word[1:] == word[:-1])
    made[inner] = pieces.pair(symbols[inner], symbols[inner + 1])
    while len(symbols):
        key = np.where(made == NO_PAIR, NO_RANK, pieces.rank[made]) << 32 | np.arange(len(symbols))
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(key, starts)
        merges = (best >> 32) < NO_RANK
        sizes = np.diff(np.append(starts, len(symbols)))
        if not merges.all():
            ended = np.repeat(~merges, sizes)
            done_symbols.append(symbols[ended])
            done_words.append(word[ended])
        at = best[merges] & 0xFFFFFFFF
        if not len(at):
            break
        symbols[at] = made[at]
        keep = np.repeat(merges, sizes)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbols, word, made = symbols[keep], word[keep], made[keep]
        at = place[at]
        beside = np.concatenate((at, at[at > 0] - 1))
        last = np.append(word[1:] != word[:-1], True)[beside]
        made[beside[last]] = NO_PAIR
        beside = beside[~last]
        made[beside] = pieces.pair(symbols[beside], symbols[beside + 1])
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))


def merge_long(pieces: Pieces, word: str) -> list[int]:
    """The same merges of one long word: a heap of pairs by rank and place, so that its time is about its length."""
    codes = list(map(ord, word))
    symbols = [int(s) if s != UNKNOWN else UNKNOWN - c for s, c in zip(pieces.char[codes].tolist(), codes)]
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    waiting: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (made := pieces.pairs.get((symbols[i], symbols[j]))) is not None:
            heapq.heappush(waiting, (int(pieces.rank[made]), i, symbols[i], symbols[j], made))

    for i in range(n):
        offer(i)
    while waiting:
        _, i, a, b, made = heapq.heappop(waiting)
        j = after[i]
        if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], after[i] = made, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s, a in zip(symbols, alive) if a]


def spelled(pieces: Pieces, symbols: list[int]) -> tuple[int, str, str]:
    """(number of ids, ids joined by commas, decoded text) of a word's symbols; unknown characters as bytes."""
    if min(symbols, default=0) >= 0:
        numbers, written = pieces.numbers, pieces.written
        return len(symbols), ",".join([numbers[s] for s in symbols]), "".join([written[s] for s in symbols])
    ids, raw = [], b""
    for s in symbols:
        said = chr(UNKNOWN - s).encode() if s < 0 else pieces.written[s].encode()
        ids += [pieces.of_byte[b] for b in said] if s < 0 else [s]
        raw += said
    return len(ids), ",".join(map(str, ids)), raw.decode()


#: Spaces and what follows up to a space or line break; spaces alone; a line break. No piece goes across.
WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def encode_all(pieces: Pieces, known: dict[str, tuple[int, str, str]], texts: list[str | None]) -> list[tuple[int, str, str]]:
    """(n_tokens, ids joined by commas, decoded text) of each text; words are kept in ``known`` up to CACHE_WORDS."""
    words = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    new = set().union(*words).difference(known)
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = set().union(*words)
    long, short = [w for w in new if len(w) > LONG_WORD], [w for w in new if len(w) <= LONG_WORD]
    for part in in_parts(short):
        symbols, bounds = merge_rounds(pieces, part)
        flat, ends = symbols.tolist(), bounds.tolist()
        for word, a, b in zip(part, ends, ends[1:]):
            known[word] = spelled(pieces, flat[a:b])
    for word in long:
        known[word] = spelled(pieces, merge_long(pieces, word))
    out = []
    for own in words:
        if not own:
            out.append(EMPTY)
            continue
        sizes, ids, said = zip(*map(known.__getitem__, own))
        decoded = "".join(said)
        out.append((sum(sizes), ",".join(ids), decoded[1:] if decoded[:1] == " " else decoded))
    for word in long:
        del known[word]
    return out


def in_parts(words: list[str]):
    part, held = [], 0
    for word in words:
        part.append(word)
        held += len(word)
        if held >= ROUND_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row for each document: n_tokens, digests of ids and decoded text; with ``ids`` also ids and decoded text.

    Equal to the library's encoding of each whole text (no begin or end ids, no sampling) and its decoding of the ids.
    A null or empty text has no ids and decodes to an empty text; repeated rows are encoded alike; a null id stays null;
    other columns are not read. One narrow stage: nothing is shuffled, and words already met by the task are not
    merged again; the words kept have a fixed limit. No task needs the result of another, so a lost one is run again.
    """
    with open(model, "rb") as file:  # under a MB: read by the driver and sent along
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    workers: dict[int, tuple[Pieces, dict]] = {}

    def run(doc_ids, texts):
        if 0 not in workers:
            workers[0] = (Pieces(held.value), {})
        found = encode_all(*workers[0], texts)
        out = {
            "doc_id": doc_ids,
            "n_tokens": [n for n, _, _ in found],
            "ids_sha256": [hashlib.sha256(i.encode()).hexdigest() for _, i, _ in found],
            "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, _, d in found],
        }
        if ids:
            out |= {"ids": [list(map(int, i.split(","))) if i else [] for _, i, _ in found], "decoded": [d for _, _, d in found]}
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(id_and_text(docs, key, text), run, schema + (", ids array<int>, decoded string" if ids else ""))
