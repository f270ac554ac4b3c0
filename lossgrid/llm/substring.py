"""Substring deduplication by sliding sentence spans (operator 3).

Every text is cut into sentences; one of more than ``LONG`` words, such as text
without end marks, is cut further at places that its own words name, so equal
passages are cut alike whatever surrounds them.  Runs of consecutive sentences
of at least ``words`` words are hashed: from each sentence on and up to each
sentence the shortest one, which for a sentence of that length is the sentence
itself.  Any repeated passage of whole sentences and at least ``words`` words is
covered by such runs.  A run that is not the first of its hash over all
documents (by doc_id, then by place) is a repeat, and every sentence that a
repeat covers is removed.

A document is named by its id and the hash of both id and text, so rows equal
in both are one document with one decision.  Runs are counted before they are
joined, and the join deals the runs of a frequent hash to several tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import redealt
from .util import slices, stage, texts

WORDS = 12
#: Sentences of more words are cut at content-defined places, about every STRIDE words.
LONG = 50
STRIDE = 12
#: A sentence: up to an end mark before white space, a full-width mark, or a line's end.
SENTENCE = re.compile(r"[^\n.!?\u3002\uff01\uff0e\uff1f\uff61\u0964\u06d4]*(?:[.!?]+(?![\s.!?\u3002\uff01\uff0e\uff1f\uff61\u0964\u06d4])[^\n.!?\u3002\uff01\uff0e\uff1f\uff61\u0964\u06d4]*)*(?:[.!?\u3002\uff01\uff0e\uff1f\uff61\u0964\u06d4]+|\n|$)\s*")
#: Scripts written without blanks count a word for each character.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
PIECE = re.compile(rf"{UNSPACED.pattern}|(?:(?!{UNSPACED.pattern})\S)+")


def _cuts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of a long sentence: it is cut between two words where the hash of the pair says so."""
    at, before = start, ""
    for match in PIECE.finditer(text, start, end):
        word = match[0]
        if before and xxhash.xxh32_intdigest(f"{before} {word}".encode("utf-8", "surrogatepass")) % STRIDE == 0:
            yield at, match.start()
            at = match.start()
        before = word
    yield at, end


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of every sentence with a word; together they cover the text but for leading white space."""
    split = PIECE.findall if UNSPACED.search(text) else str.split
    found = []
    for match in SENTENCE.finditer(text):
        if match.end() > match.start():
            words = split(match[0])
            if len(words) > LONG:
                found += [(a, b, split(text[a:b])) for a, b in _cuts(text, *match.span())]
            elif words:
                found.append((match.start(), match.end(), words))
            elif found:
                found[-1] = (found[-1][0], match.end(), found[-1][2])
    return found


def runs(found: list[tuple[int, int, list[str]]], words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, words) of the shortest run from and up to each sentence.

    A passage of ``words`` words or more is covered by the runs inside it: the
    one from its first sentence, and for any later sentence that this one does
    not reach, the one up to it.
    """
    counts = np.cumsum([0] + [len(s[2]) for s in found])
    joined = [" ".join(s[2]).encode("utf-8", "surrogatepass") for s in found]
    onward = np.searchsorted(counts, counts[:-1] + words)
    back = np.searchsorted(counts, counts[1:] - words, side="right") - 1
    spans = {(i, e) for i, e in enumerate(onward.tolist()) if e <= len(found)}
    spans |= {(b, i + 1) for i, b in enumerate(back.tolist()) if b >= 0}
    for first, end in sorted(spans):
        yield first, end - first, b" ".join(joined[first:end])


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, str]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
        yield doc_id, xxhash.xxh3_64_intdigest(f"{doc_id}\n{text}".encode("utf-8", "surrogatepass")) - 2**63, text


#: ``span`` is first << 16 | size, as every sentence has a word and a run fewer sentences than words.
RUNS = "h1 long, h2 int, doc_id long, doc_key long, span long"


def _runs(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = []
            for doc_id, key, text in _keyed(batch):
                for first, size, body in runs(sentences(text), words):
                    rows.append((xxhash.xxh3_64_intdigest(body) - 2**63, xxhash.xxh32_intdigest(body) - 2**31, doc_id, key, first << 16 | size))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["h1", "h2", "doc_id", "doc_key", "span"])

    return run


def repeats(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, doc_key, span, first_doc_id of every run that is not the first of its words."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(docs.mapInArrow(_runs(words), RUNS), "runs")
    # The greatest inverted place is the first one; a null id, the least of all, comes last.
    place = F.struct(*(F.bitwise_not(c).alias(c) for c in ("doc_id", "doc_key", "span")))
    origin = found.groupBy("h1", "h2").agg(F.max(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    origin = origin.select(redealt(F.col("h1")).alias("k1"), F.col("h2").alias("k2"), "origin")
    later = found.join(origin, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(~place.eqNullSafe(F.col("origin")))
    return later.select("doc_id", "doc_key", "span", F.bitwise_not("origin.doc_id").alias("first_doc_id"))


def _without():
    """Cut the covered sentences out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            out, totals, removed = [], [], []
            for text, spans in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
                found = sentences(text)
                gone = np.zeros(len(found) + 1, np.int64)
                for span in spans or ():
                    first, size = span >> 16, span & 0xFFFF
                    gone[first] += 1
                    gone[min(len(found), first + size)] -= 1
                gone = np.cumsum(gone)[: len(found)] > 0
                if gone.any():
                    out.append("".join(text[a:b] for (a, b, _), g in zip(found, gone, strict=True) if not g).rstrip())
                else:
                    out.append(text)
                totals.append(len(found))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), batch.column("first_doc_ids")],
                ["doc_id", "text", "n_sentences", "n_removed", "first_doc_ids"],
            )

    return run


def remove_repeats(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text; other columns are ignored).

    doc_id, text (without the covered sentences; unchanged if none is), the
    numbers of sentences and of removed ones, and first_doc_ids (sorted ids of
    the documents that hold the first occurrence of what was removed; empty if
    nothing was).  Null texts count as empty and come back empty; rows with a
    null id come after all others.  A passage is kept where it occurs first, also
    within one text.  Very long texts are hashed whole.  Rows equal in id and text count as one and get the same result.  An empty
    table gives an empty table.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeats(docs, words).groupBy(F.col("doc_id").alias("own_id"), "doc_key").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    keyed = docs.mapInArrow(_with_key, "doc_id long, text string, key long")
    both = keyed.join(spans, (F.col("key") == F.col("doc_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    both = both.select("doc_id", "text", "spans", F.coalesce("first_doc_ids", F.array().cast("array<long>")).alias("first_doc_ids"))
    return both.mapInArrow(_without(), "doc_id long, text string, n_sentences long, n_removed long, first_doc_ids array<long>")


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys = [k for _, k, _ in _keyed(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(keys, pa.int64())], ["doc_id", "text", "key"])
