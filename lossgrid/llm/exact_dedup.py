"""Exact deduplication with Patricia-trie owners (operator 5).

Texts are equal when they are identical after the six ASCII white-space
characters are deleted.  Of equal texts the row with the most code points in
the original text stays, then the one with the smallest doc_id (null last),
then the first in its partition.

Two rounds of compressed radix tries over whole byte strings:

1. *Local*: every input partition inserts its texts into a trie whose keys are
   length, content hash, bytes.  A terminal node holds the number of its rows
   and the row that would stay.  Beyond ``held_bytes`` the heaviest subtree is
   spilled: its terminals are written out and forgotten; the same text met
   later starts a new terminal, which the second round unites.
2. *Owners*: the terminals' texts go to the partition that owns their length
   and hash, sorted by it.  One owner trie at a time takes the byte strings of
   one (length, hash); texts meet only by all their bytes, never by the hash
   alone.

A text with a third of all rows reaches its owner once per input partition (or
spill), not once per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import SPACE_BYTES, map_arrow, named, slices, stage

#: Bytes of text that a local trie holds before it spills.
HELD_BYTES = 48 << 20


class Node:
    """A node of a radix trie: the bytes leading to it, children by first byte."""

    __slots__ = ("edge", "children", "terminal", "held")

    def __init__(self, edge: bytes):
        self.edge = edge
        self.children: dict[int, Node] = {}
        self.terminal: list | None = None
        self.held = 0


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, weight: int) -> tuple[Node, bool]:
        """The terminal node of ``key``, and whether it is new; ``weight`` counts on its path then."""
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                node, at = child, len(key)
                path.append(child)
                break
            n = common(child.edge, key, at)
            if n < len(child.edge):
                split = Node(child.edge[:n])
                split.held = child.held
                node.children[key[at]] = split
                child.edge = child.edge[n:]
                split.children[child.edge[0]] = child
                child = split
            node, at = child, at + n
            path.append(node)
        new = node.terminal is None
        if new:
            for step in path:
                step.held += weight
        return node, new

    def spill(self) -> list[list]:
        """Cut off the heaviest subtree below the first branching; its terminals."""
        node, path = self.root, [self.root]
        while len(node.children) == 1 and node.terminal is None:
            node = next(iter(node.children.values()))
            path.append(node)
        if not node.children:  # a single key is left
            self.root = Node(b"")
            return [node.terminal] if node.terminal is not None else []
        first, heaviest = max(node.children.items(), key=lambda x: x[1].held)
        del node.children[first]
        for step in path:
            step.held -= heaviest.held
        return list(terminals(heaviest))


def terminals(node: Node) -> Iterator[list]:
    stack = [node]
    while stack:
        node = stack.pop()
        if node.terminal is not None:
            yield node.terminal
        stack.extend(node.children.values())


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)


def rank(n_points: int, doc_id: int | None, row: int) -> tuple:
    """Rows of one text in the order in which they stay."""
    return -n_points, doc_id is None, doc_id or 0, row


# A terminal: [local class, rows, rank of the best row, best row's columns, n_bytes, hash]
def _local(columns: list[str], with_rows: bool, held_bytes: int):
    """First round over one partition.

    Yields a row with ``member`` true for every document (if ``with_rows``)
    and one with ``member`` false, with the best row's ``columns``, for every
    terminal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 34
        trie, rows, schema = Trie(), 0, None
        for batch in slices(batches):
            if schema is None:
                schema = _staged_schema(batch.schema, columns)
            ids = batch.column("doc_id").to_pylist()
            values = batch.select(columns).to_pylist()
            out = []
            for doc_id, text, row in zip(ids, batch.column("text").to_pylist(), values, strict=True):
                body, number = normalised(text), base + rows
                rows += 1
                digest = xxhash.xxh3_64_intdigest(body)
                node, new = trie.insert(len(body).to_bytes(8, "big") + digest.to_bytes(8, "big") + body, len(body) + 200)
                order = rank(len(text or ""), doc_id, number)
                if new:
                    node.terminal = [number, 0, order, row, len(body), digest - 2**63]
                terminal = node.terminal
                terminal[1] += 1
                if order < terminal[2]:
                    terminal[2], terminal[3] = order, row
                if with_rows:
                    out.append({"member": True, "local_class": terminal[0], "row_number": number, "member_id": doc_id, "text_sha256": hashlib.sha256(body).hexdigest()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
            while trie.root.held > held_bytes:
                yield from _written(trie.spill(), schema)
        if schema is not None:
            yield from _written(terminals(trie.root), schema)

    return run


def _staged_schema(schema: pa.Schema, columns: list[str]) -> pa.Schema:
    own = [("member", pa.bool_()), ("local_class", pa.int64()), ("row_number", pa.int64()), ("member_id", pa.int64()), ("text_sha256", pa.string()), ("n_rows", pa.int64()), ("n_points", pa.int64()), ("n_bytes", pa.int64()), ("content_hash", pa.int64())]
    return pa.schema([*(pa.field(*x) for x in own), pa.field("best", pa.struct([schema.field(c) for c in columns]))])


STAGED = "member boolean, local_class long, row_number long, member_id long, text_sha256 string, n_rows long, n_points long, n_bytes long, content_hash long, best struct<{}>"


def _written(found: Iterator[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for number, n_rows, order, row, n_bytes, digest in found:
        rows.append({"member": False, "local_class": number, "row_number": order[3], "member_id": None if order[1] else order[2], "n_rows": n_rows, "n_points": -order[0], "n_bytes": n_bytes, "content_hash": digest, "best": row})
        held += n_bytes
        if held > 4 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _owners(emit):
    """Second round over rows sorted by (n_bytes, content_hash): one trie at a time.

    ``emit`` makes the output rows of a terminal
    ``[classes, rows, rank of the best row, best row]``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, key, out, schema = Trie(), None, [], None
        for batch in slices(batches):
            schema = schema or batch.schema
            for row in batch.to_pylist():
                if (row["n_bytes"], row["content_hash"]) != key:
                    for t in terminals(trie.root):
                        out.extend(emit(t))
                    trie, key = Trie(), (row["n_bytes"], row["content_hash"])
                    if len(out) >= 256:
                        yield emit.batch(out, schema)
                        out = []
                body = normalised(row["best"]["text"])
                node, new = trie.insert(body, len(body))
                order = rank(row["n_points"], row["member_id"], row["row_number"])
                if new:
                    node.terminal = [[], 0, order, row["best"]]
                t = node.terminal
                t[0].append(row["local_class"])
                t[1] += row["n_rows"]
                if order < t[2]:
                    t[2], t[3] = order, row["best"]
        for t in terminals(trie.root):
            out.extend(emit(t))
        if out:
            yield emit.batch(out, schema)

    return run


class _Classes:
    """Each local class with what its text's group decides."""

    SCHEMA = pa.schema([("local_class", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
    SPARK = "local_class long, keep_id long, keep_row long, group_size long"

    def __call__(self, t: list) -> list[dict]:
        order = t[2]
        return [{"local_class": c, "keep_id": None if order[1] else order[2], "keep_row": order[3], "group_size": t[1]} for c in t[0]]

    def batch(self, rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=self.SCHEMA)


class _Stay:
    """The row that stays of each text."""

    def __call__(self, t: list) -> list[dict]:
        return [t[3]]

    def batch(self, rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(schema.field("best").type)))


def _as_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with doc_id as long and text as string; other columns as they are."""
    typed = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}
    return documents.select(*(typed[c].alias(c) if c in typed else named(c) for c in documents.columns))


def _owned(terminal_rows: DataFrame) -> DataFrame:
    return terminal_rows.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")


def _struct(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in df.schema.fields)


def assign(documents: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text; other columns are ignored).

    doc_id, keep_id (doc_id of the row that stays), group_size, kept,
    text_sha256 (of the normalised text).  Null text counts as empty, so null,
    empty and white-space texts are one group.  Of rows that repeat an id and
    a text exactly one is kept.  An empty table gives an empty table.
    """
    docs = _as_documents(documents.select("doc_id", "text"))
    staged = stage(docs.mapInArrow(_local(["text"], True, held_bytes), STAGED.format("text: string")), "exact")
    classes = _owned(staged.where("not member").select("local_class", "row_number", "member_id", "n_rows", "n_points", "n_bytes", "content_hash", "best")).mapInArrow(_owners(_Classes()), _Classes.SPARK)
    members = staged.where("member").select("local_class", "row_number", F.col("member_id").alias("doc_id"), "text_sha256")
    return members.join(classes, "local_class").select("doc_id", "keep_id", "group_size", (F.col("row_number") == F.col("keep_row")).alias("kept"), "text_sha256")


def keep_one(documents: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The rows that stay, with all their columns; each text goes through one shuffle.

    Null text counts as empty; of rows that repeat an id and a text one stays.
    Other columns may have any name.  An empty table gives an empty table.
    """
    docs = _as_documents(documents)
    local = map_arrow(docs, _local(docs.columns, False, held_bytes), STAGED.format(_struct(docs)))
    rows = _owned(local.select("row_number", "member_id", "local_class", "n_rows", "n_points", "n_bytes", "content_hash", "best"))
    return rows.mapInArrow(_owners(_Stay()), docs.schema)
