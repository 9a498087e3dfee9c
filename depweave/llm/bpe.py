"""Byte-level BPE with a pair occurrence index.

The distinct pre-tokens of a stretch of a partition are laid out as one array of symbols. An index maps the
rank of every pair to all its positions. Active ranks are taken in ascending order from a heap: all places
of the pair are merged at once, and only the lists of the pairs beside them are updated. Since no merge
makes a pair of lower rank (checked when a vocabulary is loaded), this equals merging word by word.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.memory import let_go

#: The split of GPT-2's byte-level pre-tokenizer (a fixed value of that public format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next
    code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for byte in range(256):
        out.append(chr(byte) if byte in plain else chr(extra))
        extra += byte not in plain
    return out


class _Numbers(dict):
    """Texts numbered in the order in which they are first looked up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class ByteBpe:
    """Encoder and decoder of a ``tokenizers`` file of a plain byte-level BPE.

    ``hold``: cached pre-tokens of a worker beyond which it starts anew; ``symbols``: about as many go into
    one index.
    """

    def __init__(self, path: str, hold: int = 250_000, symbols: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or odd or model.get("ignore_merges") or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.hold, self.symbols = hold, symbols
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        vocab: dict[str, int] = model["vocab"]
        self.first = np.array([vocab[c] for c in characters], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        n = 1 + max([*vocab.values(), *self.specials.values()])
        self.table = [b""] * n
        for token, i in vocab.items():
            self.table[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.table[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        born = np.full(n, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        last = np.full(n, -1, np.int64)
        last[self.made] = np.arange(len(pairs))
        if (born != last).any() or (np.maximum(last[self.left], last[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} has merges that come before their parts")
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.split = regex.compile(SPLIT).findall
        self.apart = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")").split if self.specials else None
        self.numbers, self.coded = _Numbers(), []
        del spec, model, vocab, pairs
        let_go()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 without one."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # A mark (-1) before each word and one at the end: no pair spans it.
        n = int(sizes.sum()) + len(words) + 1
        symbol = np.full(n, -1, np.int32)
        inside = np.ones(n, bool)
        marks = np.concatenate(([0], np.cumsum(sizes + 1)))
        inside[marks] = False
        symbol[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = inside
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into the index."""
            left, right = symbol[at], symbol[after[at]]
            rank = self.ranks(left, right)
            ok = (rank >= 0) & (left >= 0) & (right >= 0)
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = np.concatenate(([0], cuts))
            for r, i, j in zip(rank[starts].tolist(), starts.tolist(), [*cuts.tolist(), len(at)], strict=True):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(inside).astype(np.int32))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[alive[at]]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if len(lists) > 1 or a == b:
                at = np.sort(at)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
            if not len(at):
                continue
            if a == b:  # in a run of equal symbols every second place is merged, from the left
                fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
                start = np.flatnonzero(fresh)
                place = np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate((start, [len(at)]))))
                at = at[place % 2 == 0]
            gone = after[at]
            then = after[gone]
            symbol[at] = self.made[r]
            alive[gone] = False
            after[at] = then
            before[then] = at
            back = before[at]
            beside = np.concatenate((back[symbol[back] >= 0], at))
            note(beside)
        ids = symbol[alive].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(alive)))[np.concatenate((marks[1:], [n]))][:-1].tolist() if len(words) else []
        out, start = [], 0
        for end in ends:
            out.append(ids[4 * start : 4 * end])
            start = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Strings of special tokens are
        those tokens, as the library has it by default."""
        numbers, coded = self.numbers, self.coded
        number, pieces = numbers.__getitem__, []
        for text in texts:  # a text is held as the numbers of its pre-tokens, four bytes each
            own: list[str] = []
            for k, part in enumerate(self.apart(text) if self.apart else [text]):
                own += [part] if k % 2 else self.split(part)
            pieces.append(np.fromiter(map(number, own), np.uint32, len(own)))
        new = list(itertools.islice(numbers, len(coded), None))
        start, size = 0, 0
        for i, w in enumerate(new):
            size += len(w) + 1
            if size > self.symbols or i == len(new) - 1:
                coded += self.encode_words([x.encode("utf-8", "surrogatepass") for x in new[start : i + 1]])
                start, size = i + 1, 0
        for token, i in self.specials.items():
            if token in numbers:
                coded[numbers[token]] = np.array([i], "<u4").tobytes()
        out = [b"".join([coded[n] for n in own.tolist()]) for own in pieces]
        if len(numbers) > self.hold:
            self.forget()
        return out

    def forget(self) -> None:
        """Let go of the cached pre-tokens."""
        self.numbers, self.coded = _Numbers(), []

    def decode(self, ids: bytes) -> str:
        """Table lookup of all ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBpe:
    """One a worker and path."""
    return ByteBpe(path)


def stretches(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts (null: empty) of about ``most`` characters, with the row that each begins at."""
    start, held, size = 0, [], 0
    for i, text in enumerate(column):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def encode_decode(docs: DataFrame, path: str, ids: bool = False, text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``; on request also ``ids`` (binary,
    little-endian unsigned 32-bit integers) and ``decoded`` (text).

    Whole texts of any length; a null text counts as an empty one, which has no ids. Only doc_id and text are read,
    other columns may have any name; a null doc_id stays null; repeated rows each give a row, and an empty table gives an empty result. ``path`` must be readable on
    every worker.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids + ", decoded string" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            for start, texts in stretches(batch.column(1)):
                coded = coder.encode(texts)
                decoded = [coder.decode(x) for x in coded]
                columns = [
                    batch.column(0).slice(start, len(texts)),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]),
                ]
                columns += [pa.array(coded, pa.binary())] * ids + [pa.array(decoded, pa.string())] * text
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * text)
        coder.forget()
        let_go()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
