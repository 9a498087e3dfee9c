"""Token ids in binary blocks: frequency-ranked, in one to four bytes each, lengths in control bytes apart.

The corpus's most frequent id becomes rank 0, so most ids take one byte. Four values share one control byte
(two bits a value: its length less one), data bytes follow apart, and decoding looks the lengths up in a
table of 256 rows and gathers all bytes at once. Blocks are rows of a Parquet dataset in doc_id order, each
with its part, its documents and the tokens before it in its part; the ranks are a dataset beside them.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.store import save


@dataclass(frozen=True)
class TokenFiles:
    """``end_id`` closes each document; a block ends with the document that brings it to ``block`` tokens.
    ``worker_cache``: words in each of a worker's two cache generations."""

    end_id: int = 1
    block: int = 1 << 16
    worker_cache: int = 300_000


#: Letters that the library lowers one by one, whatever stands beside them.
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_MARKS = string.punctuation.replace("'", "")
_other = re.compile(f"[^{_LETTERS}{string.digits}{re.escape(_MARKS)}]").search
_runs = re.compile(f"[{_LETTERS}]+|[{string.digits}]|[{re.escape(_MARKS)}]+").findall


class Runs(dict):
    """The ids of runs of letters, of marks and of digits as bytes; the library's model codes what is lacking."""

    def __init__(self, tokenizer, width: int, most: int):
        self.model, self.most = tokenizer.model, most
        self.code = struct.Struct("<" + "?BHHI"[width]).pack
        pre = lambda c: tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c))
        #: Each character as the model gets it.
        self.shown = {ord(c): "".join(x for x, _ in pre(c)) for c in _LETTERS + string.digits + _MARKS}

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[run] = b"".join([self.code(t.id) for t in self.model.tokenize(run.translate(self.shown))])
        return out


class WordCoder:
    """The ``tokenizers`` library behind a cache of words between ASCII white space, capitals A-Z aside.

    The file's pre-tokenizer drops white space, its normalizer doesn't reach across it and lowers capitals;
    ``__init__`` checks that the ids of a text are those of its words. The cache has two generations: when the
    young one is full it becomes the old one, and what is used again moves over, so frequent words stay. A new word of
    plain characters is put together from its runs of letters, marks and digits, if ``__init__`` finds that the
    pre-tokenizer cuts there.
    """

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        for a, b in (("a", "b"), (".", "x"), ("1", "2"), ("'", "s"), ("x", "'s"), ("A", "\u00c9T")):
            both = self._ids(f"{a} \t{b}\n")
            if both != self._ids(a.lower()) + self._ids(b) or both != self._ids(f"{a}\x0b\r\x0c {b}"):
                raise ValueError(f"{path}: its tokens reach across white space")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Ids in as few bytes as the vocabulary needs.
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        # An added token may be written with capitals only as it is: texts with such strings aren't lowered.
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.young, self.old = most, {}, {}
        self.runs = Runs(self.tokenizer, np.dtype(self.kind).itemsize, most) if self.tokenizer.normalizer and self.tokenizer.pre_tokenizer else None
        # Every character beside a letter, a digit and a mark, and all together.
        probes = [f"a{c}b{c}1{c}.{c}\u00e9{c}{c}" for c in _LETTERS + string.digits + _MARKS] + [_LETTERS, _MARKS, string.digits]
        if self.runs is not None and any(self._of_runs(x) != np.array(self._ids(x), self.kind).tobytes() for x in probes):
            self.runs = None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of_runs(self, word: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, _runs(word)))

    def _learn(self, new: list[bytes], added: bool) -> None:
        """``added``: words may hold added tokens."""
        young = self.young
        if self.runs is not None:
            rest = []
            for w in new:
                word = w.decode()
                if _other(word) or (added and any(t in w.lower() for t in self.special)):
                    rest.append(w)
                else:
                    young[w] = self._of_runs(word)
            new = rest
        for start in range(0, len(new), 20_000):
            words = new[start : start + 20_000]
            coded = self.tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, self.kind)
            of = np.array([-1 if x is None else x for x in coded.word_ids], np.int64)
            if len(of) and (of.min() < 0 or (np.diff(of) < 0).any()):  # added tokens have no word: each by itself
                young.update((w, np.array(self._ids(w.decode()), self.kind).tobytes()) for w in words)
                continue
            ends = (np.searchsorted(of, np.arange(len(words)), side="right") * ids.itemsize).tolist()
            blob, at = ids.tobytes(), 0
            for w, to in zip(words, ends, strict=True):
                young[w] = blob[at:to]
                at = to

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids with the end, each as a little-endian unsigned integer of ``kind``."""
        end = np.array([end_id], self.kind).tobytes()
        pieces, added = [], False
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            low = raw.lower()
            as_is = any(t in low for t in self.special)
            added |= as_is
            pieces.append((raw if as_is else low).split())
        words = set().union(*pieces).difference(self.young)
        known = [w for w in words if w in self.old]
        self.young.update((w, self.old[w]) for w in known)
        self._learn(list(words.difference(known)), added)
        get = self.young.__getitem__
        out = [b"".join(map(get, own)) + end for own in pieces]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out


@lru_cache(maxsize=2)
def _coder(path: str, most: int) -> WordCoder:
    return WordCoder(path, most)


#: For each control byte the lengths of its four values.
_LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values again, by table lookup of the lengths."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = size > k
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_CODED = "doc_id long, n_tokens long, ids binary"
_BLOCK = "part int, block long, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, control binary, data binary"


def encode_ids(docs: DataFrame, path: str, how: TokenFiles) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, how.worker_cache)
        width = np.dtype(coder.kind).itemsize
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                coded = coder.encode([x.as_py() or "" for x in part.column(1)], how.end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // width for x in coded], pa.int64()), pa.array(coded, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _CODED)


def rank_table(coded: DataFrame, kind: str) -> DataFrame:
    """``rank`` and ``id``: ids by falling count, ties by id. As many rows at most as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                own = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(start, 2000).to_pylist()), kind), minlength=len(seen))
                own[: len(seen)] += seen
                seen = own
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(seen[found], pa.int64())], names=["id", "seen"])

    counts = coded.select("ids").mapInArrow(run, "id long, seen long").groupBy("id").agg(F.sum("seen").alias("seen"))
    return counts.select((F.row_number().over(Window.orderBy(F.desc("seen"), "id")) - 1).alias("rank"), "id")


def write_token_files(docs: DataFrame, path: str, how: TokenFiles | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode the whole texts (null: empty) and write blocks and ranks to the shared folder; the two
    datasets. Documents are in ascending doc_id order, null ids first, repeated ids by their token ids."""
    how = how or TokenFiles()
    kind = _coder(path, how.worker_cache).kind
    coded = save(encode_ids(docs, path, how), "tokens-coded")
    ranks = save(rank_table(coded, kind), "tokens-ranks")
    ids = np.array([r.id for r in ranks.orderBy("rank").collect()], np.int64)  # bounded by the vocabulary
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs_, tokens, held, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            control, data = pack(rank_of[np.frombuffer(b"".join(held), kind)])
            row = [part, block, before, size, docs_, tokens, control, data]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=["part", "block", "before", "n_tokens", "doc_ids", "doc_tokens", "control", "data"])

        for batch in batches:
            for doc_id, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs_.append(doc_id)
                tokens.append(n)
                held.append(own.as_py())
                size += n
                if size >= how.block:
                    yield done()
                    block, before = block + 1, before + size
                    docs_, tokens, held, size = [], [], [], 0
        if held:
            yield done()

    ordered = coded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    return save(ordered.mapInArrow(run, _BLOCK), "tokens-blocks"), ranks


def read_token_files(blocks: DataFrame, ranks: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32 from the files; on request also
    ``ids`` (binary, little-endian unsigned 32-bit integers). Empty datasets give an empty result."""
    id_of = np.array([r.id for r in ranks.orderBy("rank").collect()], "<u4")  # bounded by the vocabulary
    # One row a part, and parts are as many as the writing job's tasks.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    rows = blocks.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("start"), "n_tokens", "doc_ids", "doc_tokens", "control", "data")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, doc_ids, tokens, control, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                found = id_of[unpack(control, data, n)].tobytes()
                ends = np.cumsum(tokens)
                own = [found[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), tokens, strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - tokens, pa.int64()), pa.array(tokens, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return rows.mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, how: TokenFiles | None = None) -> DataFrame:
    """Write ``docs`` as token files and read them back: doc_id, start, n_tokens, ids_crc32.

    Whole texts of any length; a null text is an empty one, which has the end id alone. Documents are in ascending doc_id
    order, null ids first, repeated ones by their token ids; repeated rows each give a row; an empty table gives an empty
    result. Only doc_id and text are read, other columns may have any name."""
    return read_token_files(*write_token_files(docs, path, how))
