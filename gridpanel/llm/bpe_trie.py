"""BPE encoding and decoding by a traversal of a trie of distinct words.

Merge tokenization has one property that a trie can use: the last token of every prefix of a word is unique, and it only depends on the prefix. It is
the token whose border to the last token of the shorter prefix no merge would have crossed. A task therefore inserts the distinct words of its texts into
a trie, visits it depth first and gives every node the last token of its prefix; a node that several words share is computed once. A word's tokens are
read backwards along its path: the last token, then the last token of what stands before it, and so on. The occurrences of words take their ids from there,
so the work grows with the new prefixes, and nothing is shuffled. Decoding maps ids to the strings of the vocabulary, joined by blanks, which is what a file
without a decoder asks for.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = 256  # added to the byte that ends a word
PART = 1_000_000  # characters of a text that are split at once, cut at white space
WORDS, NODES = 150_000, 400_000  # words (of the last while, and as many of the while before) and trie nodes that a task keeps; others are built anew
DEEP = 128  # symbols of a word that get nodes; what is deeper belongs to one word and lives while that word is read
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")  # fixed values: the splitter of the vocabulary file takes these as words of their own


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in vocabulary files: visible Latin-1 characters stand for themselves, the others for 256 and on."""
    hidden, out = 256, []
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            out.append(chr(b))
        else:
            out.append(chr(hidden))
            hidden += 1
    return out


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 other, 4 unknown to this Python's Unicode tables."""
    of = {"L": 1, "N": 2}
    out = np.array([of.get((c := unicodedata.category(chr(i)))[0], 4 if c == "Cn" else 3) for i in range(sys.maxunicode + 1)], np.uint8)
    # fixed values: white space of Unicode
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


class Encoder:
    """Words to ids by a trie; one for each Python worker and vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path) as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = _byte_letters()
        # tokens are numbered by the time at which merges make them: single symbols first
        rank = {chr(c): c for c in range(2 * MARK)}
        self.ids = [vocabulary[self.letters[c % MARK] + "</w>" * (c >= MARK)] for c in range(2 * MARK)]
        self.size = [1] * (2 * MARK)
        self.parts: list[tuple[int, int]] = [(-1, -1)] * (2 * MARK)
        self.merged: dict[tuple[int, int], int] = {}
        spelled = {self.letters[c % MARK] + "</w>" * (c >= MARK): chr(c) for c in range(2 * MARK)}
        for merge in merges:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            symbols, made = spelled[left] + spelled[right], len(self.ids)
            spelled[left + right] = symbols
            a, b = rank[spelled[left]], rank[spelled[right]]
            self.merged[a, b] = rank[symbols] = made
            self.parts.append((a, b))
            self.ids.append(vocabulary[left + right])
            self.size.append(len(symbols))
        # tokens, and -1 for what only begins a token
        self.begins = {token[:n]: -1 for token in rank for n in range(1, len(token))} | rank
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.clear_trie()

    def clear_trie(self) -> None:
        self.child: dict[int, int] = {}
        self.state: list[int] = [0]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether tokens ``a b`` side by side are final: taking back merges, the latest first, shows no earlier merge across their border."""
        key = a << 32 | b
        answer = self.apart.get(key)
        if answer is None:
            before = len(self.ids)  # merges that were made later than this are taken back
            answer = True
            while True:
                across = self.merged.get((a, b))
                if across is not None and across < before:
                    answer = False
                    break
                inner, outer = self.parts[a], self.parts[b]
                if inner[0] < 0 and outer[0] < 0:
                    break
                # of one and the same merge the occurrence on the left came first
                if outer[0] < 0 or (inner[0] >= 0 and a > b):
                    before, a = a, inner[1]
                else:
                    before, b = b + 1, outer[0]
            if len(self.apart) >= WORDS:
                self.apart.clear()
            self.apart[key] = answer
        return answer

    def grow(self, word: str, k: int, states: list[int]) -> int:
        """State of the first ``k`` symbols from those of the shorter prefixes: the last token, and in its low byte the length of the longest end that
        begins a token.
        """
        begins, reach = self.begins, 0
        for n in range((states[k - 1] & 255) + 1, 0, -1):
            token = begins.get(word[k - n : k])
            if token is not None:
                reach = reach or n
                if token >= 0 and (k == n or self.stays_apart(states[k - n] >> 8, token)):
                    return token << 8 | reach
        raise ValueError("the vocabulary lacks a byte")

    def learn(self, words: list[str]) -> None:
        """Put ``words`` into the trie and compute their ids, depth first: words in order share the path of the word before."""
        spelled = []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            spelled.append(data[:-1].decode("latin-1") + chr(data[-1] + MARK))
        child, known, size, number, grow = self.child, self.state, self.size, self.ids, self.grow
        before = ""
        nodes, states = [0], [0]  # along the current path
        for at in sorted(range(len(words)), key=spelled.__getitem__):
            word = spelled[at]
            shared, most = 0, min(len(before), len(word), len(nodes) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del nodes[shared + 1 :], states[shared + 1 :]
            for k in range(shared + 1, len(word) + 1):
                if k > DEEP or k == len(word):  # the end of a word is a leaf that only this word reaches
                    states.append(grow(word, k, states))
                    continue
                edge = nodes[-1] << 9 | ord(word[k - 1])
                node = child.get(edge)
                if node is None:
                    node = child[edge] = len(known)
                    known.append(grow(word, k, states))
                nodes.append(node)
                states.append(known[node])
            ids, k = [], len(word)
            while k:
                token = states[k] >> 8
                ids.append(number[token])
                k -= size[token]
            ids.reverse()
            self.known[words[at]] = pack(f"<{len(ids)}I", *ids)
            before = word

    def words(self, text: str) -> list[str]:
        """The words of ``text`` without special strings."""
        if not text.isascii():
            if has_unknown(text):
                stand_in = dict(zip(self.letters, range(256), strict=True))
                own = library(self.path)
                found = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
                return [bytes(stand_in[c] for c in word).decode("utf-8", "surrogatepass") for word, _ in found]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a last sigma is lower-cased like any other
        text = text.lower()
        if not text:
            return []
        codes = _codes(text)
        kind = _kinds()[codes]
        edge = np.ones(len(codes) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        for at in np.flatnonzero((codes == 0x27) & edge[:-1]).tolist():
            if ending := next((e for e in ENDINGS if text.startswith(e, at)), None):
                edge[at + 1 : at + len(ending)] = False
                edge[at + len(ending)] = True
        places = np.flatnonzero(edge)
        starts, stops = places[:-1], places[1:]
        some = kind[starts] != 0
        return [text[a:b] for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held: list[list[str | int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            new = []
            for w in {w for words in held for w in words if w.__class__ is str}:
                if w not in self.known:
                    if (ids := self.before.get(w)) is None:
                        new.append(w)
                    else:
                        self.known[w] = ids
            self.learn(new)
            known = self.known
            out.extend(b"".join([known[w] if w.__class__ is str else pack("<I", w) for w in words]) for words in held)
            held.clear()
            size = 0
            # words that were not met since the last change go
            if len(known) > WORDS:
                self.known, self.before = {}, known
            if len(self.state) > NODES:
                self.clear_trie()

        for text in texts:
            if len(text) <= PART:
                held.append(self._marked_words(text))
                size += len(text)
            else:
                flush()
                done = []
                for piece in _cut(text):
                    held.append(self._marked_words(piece))
                    flush()
                    done.append(out.pop())
                out.append(b"".join(done))
            if size > PART:
                flush()
        flush()
        return out

    def _marked_words(self, text: str) -> list[str | int]:
        """Words of ``text``; a special string is its id."""
        if self.special_pattern is None or "<" not in text:
            return self.words(text)
        out: list[str | int] = []
        for i, part in enumerate(self.special_pattern.split(text)):
            out.extend([self.special[part]] if i % 2 else self.words(part))
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def has_unknown(text: str) -> bool:
    """Whether ``text`` has code points that this Python's Unicode tables do not know."""
    return bool((_kinds()[_codes(text)] == 4).any())


def _cut(text: str) -> Iterator[str]:
    """Parts of about ``PART`` characters that end before a blank or line feed; words, special strings and compositions never cross one."""
    gap, start = re.compile(r"[ \n]"), 0
    while start < len(text):
        found = gap.search(text, start + PART)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


@lru_cache(maxsize=1)
def library(path: str):
    """The tokenizer's own library; it normalizes and splits texts with code points that are newer than Python's tables."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def strings_for(path: str) -> list[str]:
    """The string of each id."""
    with open(path) as f:
        spec = json.load(f)
    strings = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (1 + max(strings.values()))
    for token, i in strings.items():
        out[i] = token
    return out


def decode_ids(ids: list[int], strings: list[str]) -> str:
    return " ".join(map(strings.__getitem__, ids))


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` in size; a larger row is a range of its own."""
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes, 2 * PART):
                part = batch.slice(a, b - a)
                found = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) for every row of ``docs``, as the library encodes the text without added special tokens.

    ``path`` is a vocabulary file that every executor can read. Null counts as empty and has no ids; special strings inside texts are their special tokens.
    Repeated rows are encoded alike, extra columns are ignored. Ids are those of the whole text, whatever its length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(path), f"doc_id {kind}, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = strings_for(path)
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes, PART // 2):
                part = batch.slice(a, b - a)
                flat, offsets = part.column("ids").flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes[a:b])))
                rows = [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                texts = pa.array([decode_ids(r.tolist(), strings) for r in rows], pa.string())
                digests = pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts, digests], names=[*batch.schema.names, "decoded", "ids_sha256"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with decoded, the tokens' strings joined by blanks, and ids_sha256, the digest of the ids as little-endian 32-bit integers.

    Null ids count as none and decode to an empty text.
    """
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_decode(path), f"doc_id {kind}, ids array<int>, decoded string, ids_sha256 string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``."""
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
