"""Document fingerprints by order min hash (operator 13).

A text's k-mers are its runs of ``k`` code points, each numbered by how often
it occurred before in the text, so that repeats differ.  Under each of
``sketches`` hash functions the ``keep`` smallest of these numbered k-mers are
selected and put back into text order; the hash of that ordered tuple is one
value of the fingerprint.  Two fingerprints agree in a value when the same
k-mers were selected and stand in the same order, so their likeness (the share
of values that agree) falls with the edit distance and not only with the
overlap of the sets: a text whose halves are swapped keeps its k-mers but not
its fingerprint.

:func:`fingerprint` adds the fingerprint to any table in one pass without a
shuffle.  :func:`against_edits` measures it on neighbouring documents: rows
are dealt by ranges of doc_id, each task streams its sorted rows and holds two
of them, and only the first and the last row of a task meet in a small join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .util import slices, stage, texts

K = 8
KEEP = 2
SKETCHES = 64
#: Numbered k-mers hashed at a time.
BLOCK = 4096

_TAKEN = np.uint32(0xFFFFFFFF)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd(n: int, name: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{name}:{i}".encode()) | 1 for i in range(n)], np.uint64)


class Sketcher:
    """Fingerprints of texts; buffers are reused from text to text."""

    def __init__(self, k: int = K, keep: int = KEEP, sketches: int = SKETCHES):
        self.k, self.keep = k, keep
        self.letters, self.again, self.places = _odd(k, "letter"), _odd(1, "again")[0], _odd(keep, "place")
        self.scale = (_odd(sketches, "scale") & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
        self.shift = (_odd(sketches, "shift") >> np.uint64(32)).astype(np.uint32)[:, None]
        self.buffer = np.empty(sketches * BLOCK, np.uint32)
        self.rows = np.arange(sketches)

    def numbered(self, text: str) -> np.ndarray:
        """64-bit hashes of the k-mers in text order, each with its occurrence number.

        A shorter text is one k-mer; an empty one has none.
        """
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        if not len(points):
            return points
        size = min(self.k, len(points))
        n = len(points) - size + 1
        total = points[:n] * self.letters[0]
        for i in range(1, size):
            total += points[i : i + n] * self.letters[i]
        kmers = _spread(total + np.uint64(size))
        order = np.argsort(kmers, kind="stable")
        ranked = kmers[order]
        repeats = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        if len(repeats):
            at = np.arange(n)
            starts = at.copy()
            starts[repeats] = 0
            before = np.zeros(n, np.uint64)
            before[order] = at - np.maximum.accumulate(starts)
            # First occurrences keep their hash, so texts with and without repeats can agree.
            again = before > 0
            kmers[again] = _spread(kmers[again] + before[again] * self.again)
        return kmers

    def smallest(self, kmers: np.ndarray) -> np.ndarray:
        """Places of the ``keep`` smallest k-mers under each hash function, in text order."""
        keys = (kmers >> np.uint64(32)).astype(np.uint32)
        values = np.empty((len(self.rows), 0), np.uint32)
        places = np.empty((len(self.rows), 0), np.int64)
        for at in range(0, len(keys), BLOCK):
            part = keys[at : at + BLOCK]
            hashed = self.buffer[: len(self.rows) * len(part)].reshape(len(self.rows), len(part))
            np.add(part, self.shift, out=hashed)
            np.multiply(hashed, self.scale, out=hashed)
            for _ in range(min(self.keep, len(part))):
                least = hashed.argmin(axis=1)
                values = np.column_stack([values, hashed[self.rows, least]])
                places = np.column_stack([places, least + at])
                hashed[self.rows, least] = _TAKEN
            best = np.argsort(values, axis=1, kind="stable")[:, : self.keep]
            values, places = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
        return np.sort(places, axis=1)

    def __call__(self, text: str) -> bytes:
        """Two bytes for each hash function; none for an empty text."""
        kmers = self.numbered(text)
        if not len(kmers):
            return b""
        chosen = kmers[self.smallest(kmers)]
        tuples = _spread((chosen * self.places[: chosen.shape[1]]).sum(axis=1, dtype=np.uint64))
        return (tuples >> np.uint64(48)).astype(">u2").tobytes()


def likeness(mine: bytes, its: bytes) -> float:
    """The share of values that agree, 0 to 1; empty fingerprints agree with each other only."""
    if not mine or not its:
        return float(mine == its)
    return float((np.frombuffer(mine, np.uint16) == np.frombuffer(its, np.uint16)).mean())


def fingerprint(documents: DataFrame, *, text: str = "text", column: str = "fingerprint", k: int = K, keep: int = KEEP, sketches: int = SKETCHES) -> DataFrame:
    """``documents`` with one more column, the fingerprint as hexadecimal text.

    A column of that name is replaced.  Null and empty texts get the empty
    string; a text shorter than ``k`` is one k-mer; equal texts have equal
    fingerprints, wherever they stand; an empty table stays empty.  Each
    k-mer of a long text is hashed, ``BLOCK`` at a time.
    """
    others = [c for c in documents.columns if c.lower() != column.lower()]
    given = documents.select(F.struct(*[documents[f"`{c}`"] for c in others]).alias("row"), documents[f"`{text}`"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(k, keep, sketches)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([sketch(x).hex() for x in texts(batch)], pa.string())], ["row", "found"])

    found = given.mapInArrow(run, StructType([given.schema["row"], StructField("found", StringType())]))
    return found.select(*[F.col("row")[c].alias(c) for c in others], F.col("found").alias(column))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by the first code points of ``following``, as many or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Row:
    """A document and its fingerprint, compared with the document that follows it."""

    def __init__(self, doc_id: int | None, text: str, sketch: Sketcher):
        self.doc_id, self.text, self.sketch, self.mark = doc_id, text, sketch, sketch(text)

    def against(self, following: _Row) -> tuple:
        changed = edited(self.text, following.text)
        mark = self.sketch(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, len(self.text), sha, self.mark.hex(), mark.hex(), likeness(self.mark, mark), likeness(self.mark, following.mark)


_COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGED = pa.schema([*_COLUMNS, ("part", pa.int64()), ("head", pa.string()), ("tail", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _neighbours(settings: tuple[int, int, int]):
    """Rows in order to results; the task's first row also gives its text (head), the last one only that (tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, part = Sketcher(*settings), TaskContext.get().partitionId()
        before, head = None, None
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                row = _Row(doc_id, text, sketch)
                if before is None:
                    head = text
                else:
                    out.append((*before.against(row), part, head, None))
                    head = None
                before = row
            if out:
                yield _batch(out, _EDGED)
        if before is not None:
            yield _batch([(before.doc_id, len(before.text), None, None, None, None, None, part, head, before.text)], _EDGED)

    return run


def _closing(settings: tuple[int, int, int]):
    """Last rows of tasks with the first text of the next task to results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(*settings)
        for batch in slices(batches, 16):
            rows = zip(batch.column("doc_id").to_pylist(), texts(batch, "tail"), texts(batch, "following"), strict=True)
            yield _batch([_Row(doc_id, tail, sketch).against(_Row(None, following, sketch)) for doc_id, tail, following in rows], _COLUMNS)

    return run


def against_edits(documents: DataFrame, *, k: int = K, keep: int = KEEP, sketches: int = SKETCHES) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    ``documents`` has doc_id and text; other columns are ignored.  The next
    document is the one with the next larger doc_id (the first one after the
    last; a single document follows itself).  Nulls: a null text is empty, a
    null doc_id comes after all others.  Rows that repeat a doc_id follow each
    other in the order of a hash of their text.  Returns one row for each row:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (0 to 1).  An empty table gives an empty table.

    A run of equal ids or of equal rows may span tasks, as ties are dealt by
    text and by row.
    """
    settings = k, keep, sketches
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = stage(dealt.mapInArrow(_neighbours(settings), f"{RESULT}, part long, head string, tail string"), "neighbours")

    # One row for each task that had rows is all that meets here.
    parts = found.where("head is not null").select("part")
    after = parts.select("part", F.lead("part").over(W.orderBy("part")).alias("next"), F.min("part").over(W.partitionBy()).alias("first"))
    heads = found.where("head is not null").select(F.col("part").alias("its"), F.col("head").alias("following"))
    last = found.where("tail is not null").select("doc_id", "tail", "part").join(after, "part").join(heads, F.coalesce("next", "first") == F.col("its"))
    closed = last.select("doc_id", "tail", "following").mapInArrow(_closing(settings), RESULT)
    return found.where("tail is null").select(closed.columns).union(closed)
