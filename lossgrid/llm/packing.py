"""Sequence packing with a bounded number of open windows (operator 1).

Every partition reads its documents once, in order, and keeps ``windows`` open
windows of ``length`` tokens.  Whole windows are cut from a long document's
front; the rest goes into the open window that it fills best.  If it fits into
none (and all windows are open), the fullest is filled with the rest's first
tokens and emitted, and what remains is placed again.  Emitted windows are
full, so they need no padding.

Windows still open at the end of a partition are its leftovers.  They are
merged over groups of partitions, then over groups of groups: a merge lays the
pieces end to end, emits every full window and hands on less than one.  The
very last tokens, less than one window, are cut into sequences whose lengths
are powers of two, which stay unpadded.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import slices, stage, texts

LENGTH = 2048
END_ID = 1
WINDOWS = 32
#: Partitions, or groups, whose leftovers meet in one task.
FAN_IN = 64
#: Pre-tokens whose ids a task remembers.
REMEMBERED = 300_000

PIECES = "doc_id long, doc_row long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

# The byte-level pre-token pattern, for texts of these characters only; there
# Python's classes mean what the tokenizer's do.
PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNCOMMON = re.compile("[^\t-\r\x20-\x7e¡¿-ſ–—‘-”…]|<\\|")


def byte_of_symbol() -> dict[str, int]:
    """The symbols by which byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The ids are those of ``tokenizers`` for the given file.  Pre-tokens of
    common characters are looked up among those already seen; a new one is
    encoded by the same merges in ``tiktoken``, which is faster on single
    pre-tokens.  Any other text goes to ``tokenizers`` as a whole, and so do
    all texts if the vocabulary is not of the byte-level kind whose ids follow
    its merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = f.read()
        self.whole = Tokenizer.from_str(content)
        self.pieces = self._pieces(json.loads(content))
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _pieces(spec: dict):
        import tiktoken

        model, first = spec["model"], spec.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
            return None
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        if made != sorted(made) or len(made) + 256 > len(vocabulary):
            return None
        symbols = byte_of_symbol()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def _fresh(self, piece: str) -> bytes:
        ids = self.pieces.encode_ordinary(piece)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(piece) < 64:
            self.known[piece] = found
        return found

    def __call__(self, text: str) -> bytes:
        if self.pieces is None or UNCOMMON.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, fresh = self.known.get, self._fresh
        return b"".join([known(p) or fresh(p) for p in PRE_TOKEN.findall(text)])


class Windows:
    """The open windows of one partition."""

    def __init__(self, length: int, most: int, number: int):
        self.length, self.most, self.number = length, most, number
        self.open: list[list] = []  # [used, [piece, ...]]
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, row, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, row, start, n, total, self.number, offset, ids))
            offset += n
        self.number += 1

    def add(self, doc_id: int | None, row: int, ids: bytes) -> None:
        total, length = len(ids) // 4, self.length
        at = 0
        while total - at >= length:
            self.emit([(doc_id, row, at, ids[4 * at : 4 * (at + length)], total)])
            at += length
        while at < total:
            rest = total - at
            best = max((w for w in self.open if w[0] + rest <= length), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            if best is None:
                best = max(self.open, key=lambda w: w[0])
                rest = length - best[0]
            best[0] += rest
            best[1].append((doc_id, row, at, ids[4 * at : 4 * (at + rest)], total))
            at += rest
            if best[0] == length:
                self.open.remove(best)
                self.emit(best[1])

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


FIELDS = [("doc_id", pa.int64()), ("doc_row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
EXTRA = [("cell", pa.int64()), ("place", pa.int64())]
STAGED = PIECES + ", cell long, place long"


def _batch(rows: list[tuple], cell: int | None = None) -> pa.RecordBatch:
    """Rows of pieces; with ``cell``, leftovers in their order there."""
    arrays = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(FIELDS)]
    arrays.append(pa.array([cell] * len(rows), pa.int64()))
    arrays.append(pa.array(range(len(rows)) if cell is not None else [None] * len(rows), pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in FIELDS + EXTRA])


def _pack(path: str, length: int, end_id: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        state, row = Windows(length, windows, part << 31), part << 34
        for batch in slices(batches, 64):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                state.add(doc_id, row, encoder(text) + end)
                row += 1
            if len(state.done) >= 256:
                yield _batch(state.take())
        if state.done:
            yield _batch(state.take())
        left = [(d, r, start, len(ids) // 4, total, None, None, ids) for _, pieces in state.open for d, r, start, ids, total in pieces]
        if left:
            yield _batch(left, part)

    return run


def _merge(length: int, level: int, last: bool):
    """Leftovers of one group of cells, end to end; see the module's text."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["cell"], r["place"]))
        group = rows[0]["grp"]
        state = Windows(length, 1, (level << 54) + (group << 31))
        used, window, goal = 0, [], length
        tokens = sum(r["length"] for r in rows)

        def bound(left: int) -> int:
            return length if left >= length or not last else 1 << (max(1, left).bit_length() - 1)

        goal = bound(tokens)
        for r in rows:
            at, n = 0, r["length"]
            while at < n:
                take = min(n - at, goal - used)
                window.append((r["doc_id"], r["doc_row"], r["start"] + at, r["ids"][4 * at : 4 * (at + take)], r["doc_tokens"]))
                at, used, tokens = at + take, used + take, tokens - take
                if used == goal:
                    state.emit(window)
                    used, window, goal = 0, [], bound(tokens)
        out = [_batch(state.take())] if state.done else []
        if window:
            out.append(_batch([(d, w, s, len(i) // 4, t, None, None, i) for d, w, s, i, t in window], group))
        return pa.Table.from_batches(out)

    return run


def pack(documents: DataFrame, tokenizer_path: str, *, length: int = LENGTH, end_id: int = END_ID, windows: int = WINDOWS) -> DataFrame:
    """The pieces of all packed sequences.

    ``documents``: doc_id (null stays null), text (null: empty, which still has
    the end id); other columns are ignored.  A document's tokens are those of
    the tokenizer file, which must lie at ``tokenizer_path`` on every worker,
    without special tokens, then ``end_id``.

    One row for each piece: doc_id, doc_row (a number of the input row, so
    rows that repeat an id are told apart), start, length, doc_tokens,
    sequence_id, offset, ids (little-endian unsigned 32-bit).  Every token is
    in exactly one piece; a sequence's pieces lie without a gap from offset 0.
    All sequences have ``length`` tokens, but for the last few, whose lengths
    are powers of two.  An empty table gives an empty table.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = stage(docs.mapInArrow(_pack(tokenizer_path, length, end_id, windows), STAGED), "pieces")
    columns = [n for n, _ in FIELDS]
    done, left, level = staged.where("cell is null").select(columns), staged.where("cell is not null"), 1
    while True:
        highest = left.agg(F.max("cell")).first()[0]
        if highest is None:
            return done
        last = highest < FAN_IN
        grouped = left.withColumn("grp", (F.col("cell") / FAN_IN).cast("long"))
        merged = stage(grouped.groupBy("grp").applyInArrow(_merge(length, level, last), STAGED), "merged")
        done = done.unionByName(merged.where("cell is null").select(columns))
        if last:
            return done
        left, level = merged.where("cell is not null"), level + 1


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, input_ids (binary), doc_ids of every packed sequence."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    found = pieces.groupBy("sequence_id").agg(rows.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return found.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("n_tokens"), joined.alias("input_ids"), F.col("p.doc_id").alias("doc_ids"))
