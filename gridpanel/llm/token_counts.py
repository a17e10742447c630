"""Token counts by a compiled finite-state transducer.

The merge tokenizer of a vocabulary file is run as a deterministic transducer over bytes; the last byte of a word is a symbol of its own. In
merge tokenization the last token of every prefix is unique: it is the one whose border to the token before it no merge would have crossed. A state
is therefore the longest suffix that may still grow into a token, with the last token and the relative count at its positions; a transition is
annotated with the number of tokens that it adds. The machine is compiled as far as texts need it, and dropped when its tables reach a
limit. The last byte of a word leads back to the start.

The bytes of many texts are cut into chunks of equal length, and all chunks step together. What a chunk does to an entry state (its state map) is
constant behind its first word end, so chunks are first run from there; the heads follow from the exit states of the chunks before them (a prefix scan,
whose further rounds only chunks without any word end need), and running sums give the count of each text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.bpe_trie import has_unknown, library

CHUNK, PART, TABLE_BYTES = 256, 2_000_000, 200_000_000
LAST = 256  # added to the byte that ends a word
_NEW = -128  # mark of a transition that is not compiled yet
# The splitter of the vocabulary file takes these endings as words of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: visible Latin-1 characters for themselves, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for every code point."""
    every = "".join(map(chr, range(0xD800))) + "\x00" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(len(every), 3, np.uint8)
    for code, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"[\p{Z}\t-\r\x85]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = code
    return out


class Transducer:
    """States and transitions of the tokenizer of one vocabulary file, compiled on demand."""

    def __init__(self, path: str):
        self.path = path
        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        at = _byte_of_char()

        def symbols(token: str) -> str:
            body = token.removesuffix("</w>") if len(token) > 4 else token
            codes = [at[c] for c in body]
            if body != token:
                codes[-1] += LAST
            return "".join(map(chr, codes))

        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.number = {chr(c): c for c in range(2 * LAST)}  # tokens are numbered by the order in which merges make them
        self.halves: list[tuple[int, int] | None] = [None] * (2 * LAST)
        self.made: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = self.number[symbols(left)], self.number[symbols(right)]
            self.made[a, b] = len(self.halves)
            self.number[symbols(left) + symbols(right)] = len(self.halves)
            self.halves.append((a, b))
        self.starts = {t[:k] for t in self.number for k in range(1, len(t) + 1)}
        self.borders: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.keys: list[tuple] = [("", ((-1, 0),))]
        self.ids = {self.keys[0]: 0}
        self.column = np.full(2 * LAST, -1, np.int32)
        self.inner = np.zeros(2 * LAST, np.int32)  # column of the next state; words' last bytes share column 0, which leads to the start
        self.out = np.full((1024, 32), _NEW, np.int8)
        self.next = np.zeros((1024, 32), np.int32)
        self.used, self.used_inner = 0, 1

    def holds(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of tokens ``a b``: undo their merges from the latest on and look for an earlier one across."""
        known = self.borders.get((a, b))
        if known is None:
            left, right, limit, known = a, b, len(self.halves), True
            while True:
                across = self.made.get((left, right))
                if across is not None and across < limit:
                    known = False
                    break
                # of equal merges the one on the left is done first
                if self.halves[left] is None and self.halves[right] is None:
                    break
                if self.halves[right] is None or (self.halves[left] is not None and left > right):
                    limit, left = left, self.halves[left][1]
                else:
                    limit, right = right + 1, self.halves[right][0]
            if len(self.borders) > 1_000_000:
                self.borders.clear()
            self.borders[a, b] = known
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and added tokens."""
        tail, marks = self.keys[state]
        grown = tail + chr(symbol)
        for i in range(len(grown)):
            token = self.number.get(grown[i:])
            if token is not None and (mark := marks[i]) is not None and (mark[0] < 0 or self.holds(mark[0], token)):
                added = mark[1] + 1
                break
        if symbol >= LAST:
            return 0, added
        start = 0
        while grown[start:] not in self.starts:
            start += 1
        kept = []
        for i in range(start, len(grown)):
            mark = marks[i] if grown[i:] in self.starts else None
            kept.append(mark and (mark[0], mark[1] - added))
        key = (grown[start:], (*kept, (token, 0)))
        if (known := self.ids.get(key)) is None:
            known = self.ids[key] = len(self.keys)
            self.keys.append(key)
        return known, added

    def fill(self, states: np.ndarray, symbols: np.ndarray) -> None:
        for pair in np.unique(states.astype(np.int64) * 2 * LAST + symbols):
            state, symbol = divmod(int(pair), 2 * LAST)
            if self.column[symbol] < 0:
                self.column[symbol], self.used = self.used, self.used + 1
                if symbol < LAST:
                    self.inner[symbol], self.used_inner = self.used_inner, self.used_inner + 1
            following, added = self.compile(state, symbol)
            self._grow()
            self.out[state, self.column[symbol]] = added
            self.next[state, self.inner[symbol]] = following

    def _grow(self) -> None:
        rows, cols, inner = len(self.keys), self.used, self.used_inner
        if rows > self.out.shape[0] or cols > self.out.shape[1] or inner > self.next.shape[1]:
            wide = [max(rows, self.out.shape[0] * (1 + (rows > self.out.shape[0]))), cols + 16 * (cols > self.out.shape[1]), inner + 8 * (inner > self.next.shape[1])]
            out = np.full((wide[0], max(wide[1], self.out.shape[1])), _NEW, np.int8)
            out[: self.out.shape[0], : self.out.shape[1]] = self.out
            following = np.zeros((wide[0], max(wide[2], self.next.shape[1])), np.int32)
            following[: self.next.shape[0], : self.next.shape[1]] = self.next
            self.out, self.next = out, following

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = self.column[symbols]
        added = self.out.ravel().take(states * np.int64(self.out.shape[1]) + np.maximum(column, 0))
        new = np.flatnonzero((added == _NEW) | (column < 0))
        if len(new):
            if self.out.nbytes + self.next.nbytes > TABLE_BYTES:
                states = self._restart(states)
                new = np.arange(len(states))
            self.fill(states[new], symbols[new])
            added = self.out.ravel().take(states * np.int64(self.out.shape[1]) + self.column[symbols])
        return self.next.ravel().take(states * np.int64(self.next.shape[1]) + self.inner[symbols]), added

    def _restart(self, states: np.ndarray) -> np.ndarray:
        """Drop all states but those in use."""
        keys = [self.keys[i] for i in np.unique(states)]
        places = np.searchsorted(np.unique(states), states)
        self.clear()
        for key in keys:
            if key not in self.ids:
                self.ids[key] = len(self.keys)
                self.keys.append(key)
        self._grow()
        return np.array([self.ids[k] for k in keys], np.int64)[places]


def _symbols(text: str) -> np.ndarray:
    """The bytes of the words of ``text`` (normalized), the last byte of each word marked; white space is dropped."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    starts = np.ones(len(code), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    for at in np.flatnonzero(code == 0x27):
        if starts[at] and (end := next((e for e in ENDINGS if text.startswith(e, at)), None)):
            starts[at + 1 : at + len(end)] = False
            if at + len(end) < len(code):
                starts[at + len(end)] = True
    last = np.append(starts[1:], True) & (kind != 0)
    size = 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000)
    out = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    out[np.cumsum(size)[last] - 1] += LAST
    return out[np.repeat(kind != 0, size)]


def _run(machine: Transducer, symbols: np.ndarray) -> np.ndarray:
    """Tokens that each symbol adds; the symbols end with a word's last byte, or there are none."""
    m = len(symbols)
    if not m:
        return np.zeros(0, np.int64)
    rest = -m % CHUNK
    end = np.int32(LAST + 0x61)
    lanes = np.concatenate((symbols, np.full(rest, end, np.int32))).reshape(-1, CHUNK)
    closed = (lanes >= LAST).any(1)
    head = np.where(closed, (lanes >= LAST).argmax(1) + 1, CHUNK)
    head[0] = 0
    place = np.arange(CHUNK)
    steps = np.ascontiguousarray(np.where(place < head[:, None], end, lanes).T)
    added = np.empty((CHUNK, len(lanes)), np.int8)
    state = np.zeros(len(lanes), np.int64)
    for j in range(CHUNK):
        state, added[j] = machine.step(state, steps[j])
    # heads: every pass serves the chunks whose predecessor's exit state is known
    exits, known = state, closed.copy()
    known[0] = True
    keys = [machine.keys[s] for s in exits]  # by key: the table may be dropped between passes
    todo = np.arange(1, len(lanes))
    while len(todo):
        ready = todo[known[todo - 1]]
        todo = np.setdiff1d(todo, ready, assume_unique=True)
        ready = ready[np.argsort(-head[ready], kind="stable")]
        state = np.array([_state(machine, keys[i - 1]) for i in ready], np.int64)
        for j in range(head[ready[0]]):
            n = int((head[ready] > j).sum())
            state_n, added[j, ready[:n]] = machine.step(state[:n], lanes[ready[:n], j])
            state = np.concatenate((state_n, np.zeros(len(state) - n, np.int64)))
            if n < len(ready):
                state[n:] = 0
        for i, s in zip(ready, state, strict=True):
            if not closed[i]:
                keys[i] = machine.keys[s]
        known[ready] = True
    return added.T.ravel()[:m].astype(np.int64)


def _state(machine: Transducer, key: tuple) -> int:
    if key not in machine.ids:
        machine.ids[key] = len(machine.keys)
        machine.keys.append(key)
        machine._grow()
    return machine.ids[key]


def _library_symbols(text: str, path: str) -> np.ndarray:
    """``_symbols`` of a text with code points newer than Python's Unicode tables: the library itself normalizes and splits it."""
    tokenizer, byte = library(path), _byte_of_char()
    words = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
    out = [byte[c] + LAST * (i == len(w) - 1) for w, _ in words for i, c in enumerate(w)]
    return np.array(out, np.int32)


def _pieces(text: str, special: re.Pattern, path: str) -> tuple[int, list[str | np.ndarray]]:
    """Number of special strings in ``text``, and the normalized texts (or their symbols) between them, cut at white space into parts of bounded size."""
    parts = special.split(text)
    out = []
    for part in parts:
        start = 0
        while start < len(part):
            stop = start + PART
            if stop < len(part):
                gap = next(iter(re.compile(r"[ \n]").finditer(part, stop)), None)
                stop = gap.end() if gap else len(part)
            piece = part[start:stop]
            if not piece.isascii() and has_unknown(piece):
                out.append(_library_symbols(piece, path))
            else:
                piece = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                out.append(piece.lower())
            start = stop
    return len(parts) - 1, out


def count_tokens(machine: Transducer, texts: list[str]) -> list[int]:
    """Tokens of each text as the tokenizer's library counts them, special strings inside texts as one token each."""
    special = re.compile("|".join(map(re.escape, machine.special)) or r"(?!)")
    counts = np.zeros(len(texts), np.int64)
    owner: list[int] = []
    streams: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal size
        total = np.concatenate(([0], np.cumsum(_run(machine, np.concatenate(streams) if streams else np.zeros(0, np.int32)))))
        limits = np.cumsum([0, *map(len, streams)])
        np.add.at(counts, owner, total[limits[1:]] - total[limits[:-1]])
        owner.clear()
        streams.clear()
        size = 0

    for i, text in enumerate(texts):
        n, pieces = _pieces(text, special, machine.path)
        counts[i] += n
        for piece in pieces:
            owner.append(i)
            streams.append(_symbols(piece) if isinstance(piece, str) else piece)
            size += len(piece)
            if size >= PART:
                flush()
    flush()
    return counts.tolist()


@lru_cache(maxsize=2)
def machine_for(path: str) -> Transducer:
    return Transducer(path)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_for(path)
        for batch in batches:
            n = count_tokens(machine, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit for every row of ``docs``; ``path`` is a vocabulary file that every executor can read.

    Null counts as empty (0 bytes, 0 tokens). Repeated rows are counted alike, extra columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_counter(path), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
