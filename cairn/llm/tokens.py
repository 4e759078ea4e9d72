"""Token-ID / binary output: documents become token ids, ids become wavelet-matrix shards, one blob per row.

Documents are dealt by ranges of ``doc_id`` (and a hash of the text, should one id stand on many rows) and sorted inside each range, so that a task writes consecutive
shards and never holds more than one of them. The shards are stored as rows of a Parquet table (Spark's writer commits
whole tasks only, on any file system); ``Shard`` opens a row's ``blob``, which is a complete file by itself.

Defined results: a null text is an empty one (only the end id); a null ``doc_id`` sorts first and stays null; repeated
ids stay separate documents, ordered by a hash of their text; a text longer than a shard is a shard of its own; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import wavelet
from .common import has, in_arrow, shuffle_parts, text_of, written

END_ID = 2
SHARD_TOKENS = 1 << 21
SHARD_COLUMNS = "part int, seq int, n_docs long, n_tokens long, blob binary"
CACHE_PIECES = 400_000
TEXTS_AT_ONCE = 500
#: Texts with white space that the pre-tokenizer's pattern and Python's ``re`` may not agree on are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: White space and a Latin word before punctuation, or white space and the run after it.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WORD = re.compile(f" ?[{_LATIN}]+")
_PIECE = re.compile(rf"""\s*+(?:[{_LATIN}]++(?=[.,;:!?|#$%&*"()<>/=+\s-]|$)|\S+)|\s+""", re.ASCII)


class _Known(dict):
    """Encoded strings. Beyond ``CACHE_PIECES`` the table becomes the older one, from which strings in use come back."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        self[piece] = found = self.encode(piece) if found is None else found
        return found


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece of text once.

    A byte-level tokenizer's pre-tokens begin with a space or at a change between letters, digits, punctuation and white space, and
    none reaches over the cut from a visible character to white space or from a letter to ASCII punctuation.
    So a text's ids are those of its pieces in a row. A piece that is one pre-token, letters with at most a space before
    them, goes to the library's model at once. Tokenizers of other kinds encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._model = self.tokenizer.model
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self._code = "H" if self.bits <= 16 else "I"
        self.pieces = _Known(self._piece)
        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        self.by_pieces = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not made["normalizer"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
        other = (b for b in range(256) if b not in plain)
        self._shown = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}

    def _whole(self, text: str) -> bytes:
        return array(self._code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not _WORD.fullmatch(piece):
            return self._whole(piece)
        shown = piece.encode().decode("latin-1").translate(self._shown)
        return array(self._code, [t.id for t in self._model.tokenize(shown)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        get, cut, kind = self.pieces.__getitem__, _PIECE.findall, self.kind
        return [np.frombuffer(self._whole(t) if not self.by_pieces or _ODD.search(t) else b"".join(map(get, cut(t))), kind) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def _blob(docs: list, ids: list[np.ndarray], bits: int) -> bytes:
    starts = np.cumsum([0, *map(len, ids)])[::2]  # ids, end id, ids, ...
    null = np.array([d is None for d in docs], bool)
    return wavelet.pack(np.concatenate(ids), np.array([d or 0 for d in docs], np.int64), null, starts, bits)


def shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard, in the order (part, seq): ``blob`` is the shard's file."""
    has(docs, "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind)
        held_docs, held_ids, held, seq = [], [], 0, 0

        def flush():
            nonlocal held_docs, held_ids, held, seq
            row = {"part": [part], "seq": [seq], "n_docs": [len(held_docs)], "n_tokens": [held], "blob": [_blob(held_docs, held_ids, enc.bits)]}
            held_docs, held_ids, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(k, TEXTS_AT_ONCE)
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    if held and held + len(ids) + 1 > shard_tokens:
                        yield flush()
                    held_docs.append(doc)
                    held_ids += [ids, end]
                    held += len(ids) + 1
        if held_docs:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    order = F.col("doc_id").asc_nulls_first(), "hash"
    spread = rows.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return in_arrow(spread, write, SHARD_COLUMNS)


def read_documents(stored: DataFrame) -> DataFrame:
    """Per document, from the shards alone: doc_id, part, seq, local start, n_tokens, crc32 of its ids as unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                shard = wavelet.Shard(blob)
                ids, (docs, null, starts) = shard.tokens().astype("<u4"), shard.documents()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])

    return in_arrow(stored.select("part", "seq", "blob"), read, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards to the shared folder and returns what they hold for each document: doc_id, start, n_tokens, ids_crc32, part, seq."""
    stored = written(shards(docs, tokenizer_path, end_id, shard_tokens), "token-shards")
    # One row per part: at most as many as the writing job had tasks.
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before_part"))
    before = stored.select("part", "seq", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")).alias("before")).join(before_part, "part")
    rows = read_documents(stored).join(before, ["part", "seq"])
    return rows.select("doc_id", (F.col("before_part") + F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def locate(stored: DataFrame, token: int) -> DataFrame:
    """Where a token occurs: part, seq, position in the shard; only the planes of each shard are read."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                at = wavelet.Shard(blob).locate(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(np.full(len(at), seq, np.int32)), pa.array(at)], ["part", "seq", "at"])

    return in_arrow(stored.select("part", "seq", "blob"), find, "part int, seq int, at long")
