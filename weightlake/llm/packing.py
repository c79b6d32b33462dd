"""Packing by concatenate and cut.

Pass one tokenizes every document once and writes the ids with each document's
place in its partition; the partitions' token totals then give every partition
its global offset by a prefix sum. Pass two cuts the one stream of ids at
multiples of the window, so a piece knows its sequence and offset without any
shuffle, and documents across a window's edge become boundary pieces.

Only the last sequence is not full. Only one number for each task of pass one
comes to the driver.

Defined results: a null or empty text is its end id alone; rows are packed as
they are, so repeated ids are packed repeatedly; a document of any length is
cut as often as needed; an empty table has no pieces; other columns are not
looked at.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .words import find_words, pieces, text_bytes

#: Entries that each generation of a worker's memory of words holds; the older of two generations is dropped.
GENERATION = 150_000


def _worker(key: str, make):
    """What ``make`` gives, once for each worker process: functions come by value, so module globals do not outlive a task."""
    kept = sys.modules.setdefault("_weightlake_worker", types.ModuleType("_weightlake_worker"))
    if not hasattr(kept, key):
        setattr(kept, key, make())
    return getattr(kept, key)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[44, 46]] = True
_PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def _before_tail(data: np.ndarray) -> np.ndarray:
    """Where . or , follows an ASCII letter or digit or a letter from U+00C0 to U+00FF: no token reaches across."""
    out = np.zeros(len(data), bool)
    out[1:] = _TAIL[data[1:]] & _ALNUM[data[:-1]]
    last = data[1:-1]
    out[2:] |= _TAIL[data[2:]] & (data[:-2] == 0xC3) & (last != 0x97) & (last != 0xB7)
    return out


class WordTokenizer:
    """Ids of texts, 16 bits each, by a lower-casing tokenizer whose words do not reach across white space and end in a marked token; repeated words are looked up."""

    def __init__(self, path: str, end_id: int, word_end: str = "</w>") -> None:
        self.path, self.end_id, self.word_end = path, end_id, word_end

    def _load(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        vocabulary = tokenizer.get_vocab()
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids beyond 16 bits")
        last = np.zeros(1 << 16, bool)
        last[[i for t, i in vocabulary.items() if t.endswith(self.word_end)]] = True
        # added tokens are found as they are written, case included
        added = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
        return tokenizer, last, added, [{}, {}]

    @staticmethod
    def _learn(new: list[bytes], tokenizer, last: np.ndarray) -> dict[bytes, bytes]:
        texts = b" ".join(new).decode().split(" ")
        plain = list(map(_PLAIN, texts))
        out: dict[bytes, bytes] = {}
        # words of plain letters are one run each, so many are encoded at once and parted at the marked tokens
        several = [w for w, p in zip(new, plain) if p]
        step = 512
        found = tokenizer.encode_batch_fast([b" ".join(several[i : i + step]).decode() for i in range(0, len(several), step)], add_special_tokens=False)
        for i, e in enumerate(found):
            ids = np.array(e.ids, "<u2")
            raw, cuts, group = ids.tobytes(), ((np.flatnonzero(last[ids]) + 1) * 2).tolist(), several[i * step : (i + 1) * step]
            if len(cuts) != len(group):
                raise ValueError("the tokenizer does not end every word in a marked token")
            out.update(zip(group, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
        other = [w for w, p in zip(new, plain) if not p]
        for w, e in zip(other, tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
            out[w] = np.array(e.ids, "<u2").tobytes()
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids end to end, each row's followed by the end id, and where each row starts."""
        tokenizer, last, added, known = _worker(f"tokenizer {self.path}", self._load)
        raw = text_bytes(col)[0].tobytes().lower()
        words = find_words(col, lower=not any(t in raw for t in added), breaks=_before_tail)
        codes, distinct = words.encode()
        names = distinct.to_pylist()
        ids = list(map(known[0].get, names))
        rest = [w for w, x in zip(names, ids) if x is None]
        if rest:
            again = {w: x for w in rest if (x := known[1].get(w)) is not None}
            if new := [w for w in rest if w not in again]:
                again |= self._learn(new, tokenizer, last)
            if len(known[0]) + len(again) > GENERATION:
                known[:] = [{}, known[0]]
            known[0].update(again)
            ids = [again[w] if x is None else x for w, x in zip(names, ids)]
        ids.append(np.array([self.end_id], "<u2").tobytes())
        n = len(col)
        stream = np.insert(codes, words.rows[1:], len(names)) if n else codes
        taken = pa.array(ids, pa.large_binary()).take(pa.array(stream))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(stream) + 1] // 2
        edges = at[np.concatenate([[0], words.rows[1:] + np.arange(1, n + 1)])]
        return np.frombuffer(data, "<u2")[: at[-1]] if n else np.zeros(0, "<u2"), edges


def tokenize(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: part, place in part, tokens before it in the part, its id and its ids (little-endian, 16 bits each)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in pieces(batches, "t", 2 << 20):
            ids, edges = tokenizer.encode(b.column(1))
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(before + edges[:-1]), b.column(0), raw], names=["part", "before", "id", "ids"])
            before += int(edges[-1])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"part int, before bigint, id {id_type}, ids binary")


def pack(docs: DataFrame, tokenizer: WordTokenizer, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids)."""
    tokens = cut(tokenize(docs, tokenizer, id_col, text_col))
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.octet_length("ids") / 2).cast("long").alias("n")).orderBy("part").collect()
    offset, total = {}, 0
    for r in totals:
        offset[r.part] = total
        total += r.n
    id_type = tokens.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "ids", 8 << 20):
            out: list[list] = [[] for _ in names]
            for part, before, key, raw in zip(*(b.column(k).to_pylist() for k in ("part", "before", "id", "ids"))):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                at, n, start = offset[part] + before, len(ids), 0
                while start < n:
                    size = min(n - start, window - (at + start) % window)
                    piece = ids[start : start + size].tobytes()
                    row = (key, start, size, zlib.crc32(piece), n, (at + start) // window, (at + start) % window, piece)
                    for column, x in zip(out, row):
                        column.append(x)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [b.schema.field("id").type, *[pa.int64()] * 6, pa.binary()])], names=names)

    return tokens.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{k} bigint" for k in names[1:7]) + ", ids binary" * with_ids).withColumnRenamed("id", id_col)
