"""Order min hash against a plain definition, on edits, edge rows and task borders."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from lossgrid.llm import order_minhash as om
from lossgrid.llm import queries
from tests.conftest import SF_SMALL

MASK = (1 << 64) - 1


def spread(x: int) -> int:
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & MASK
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & MASK
    return x ^ (x >> 33)


def plain(text: str, sketch: om.Sketcher) -> str:
    """The fingerprint from its definition, one k-mer and one hash function at a time."""
    if not text:
        return ""
    k = min(sketch.k, len(text))
    letters, seen, kmers = [int(x) for x in sketch.letters], Counter(), []
    for i in range(len(text) - k + 1):
        gram = text[i : i + k]
        h = spread((sum((ord(c) + 1) * f for c, f in zip(gram, letters, strict=False)) + k) & MASK)
        kmers.append(spread((h + seen[gram] * int(sketch.again)) & MASK) if seen[gram] else h)
        seen[gram] += 1
    out = ""
    for scale, shift in zip(sketch.scale[:, 0].tolist(), sketch.shift[:, 0].tolist(), strict=True):
        value = [(((h >> 32) + shift) * scale) & 0xFFFFFFFF for h in kmers]
        chosen = sorted(sorted(range(len(kmers)), key=lambda i: (value[i], i))[: sketch.keep])
        out += f"{spread(sum(kmers[i] * int(f) for i, f in zip(chosen, sketch.places, strict=False)) & MASK) >> 48:04x}"
    return out


TEXTS = ["", "a", "abc", "abcdefgh", "aaaaaaaaaaaaaaaa", "the cat sat on the mat, the cat sat on the hat", "日本語の文書 \U0001f600 " * 7, "x y " * 1500, "".join(chr(97 + (i * i) % 23) for i in range(9001))]


@pytest.mark.parametrize("k,keep,sketches", [(8, 2, 64), (3, 3, 16), (1, 1, 8)])
def test_fingerprints_follow_the_definition(k, keep, sketches):
    sketch = om.Sketcher(k, keep, sketches)
    for text in TEXTS:
        assert sketch(text).hex() == plain(text, sketch)


def test_order_counts_and_likeness_falls_with_edits():
    rng = np.random.default_rng(5)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))
    sketch = om.Sketcher(sketches=256)
    like = []
    for edits in (0, 5, 20, 80, 320):
        changed = list(text)
        for at in rng.choice(len(text), edits, replace=False):
            changed[at] = "#"
        like.append(om.likeness(sketch(text), sketch("".join(changed))))
    assert like[0] == 1 and all(a > b for a, b in zip(like, like[1:], strict=False))
    swapped = text[2000:] + text[:2000]  # the same k-mers but for the seam
    assert om.likeness(sketch(text), sketch(swapped)) < 0.75
    assert om.likeness(b"", b"") == 1 and om.likeness(b"", sketch("a")) == 0
    # A repeated k-mer does not change the hashes of those that stand once.
    assert om.likeness(sketch(text), sketch(text + text[:50])) > 0.9


def expected(rows: list[tuple], sketch: om.Sketcher) -> Counter:
    out = Counter()
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        mine, its, next_one = plain(text, sketch), plain(changed, sketch), plain(following, sketch)
        like = [sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4) if a and b else float(a == b) for a, b in ((mine, its), (mine, next_one))]
        out[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mine, its, *like] += 1
    return out


def test_against_edits_on_edge_rows_and_task_borders(spark):
    rows = [(i * 3 % 40, f"text {i} " * (i % 9) + "tail of it") for i in range(40)] + [(None, None), (41, None), (42, ""), (43, TEXTS[-1])]
    frame = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fingerprint string, part int")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    sketch = om.Sketcher(4, 2, 8)
    want = expected(order, sketch)
    for parts in (1, 7, 40):  # more tasks than rows to fill them
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = om.against_edits(frame, k=4, keep=2, sketches=8).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert Counter(tuple(r) for r in found) == want


def test_repeated_ids_single_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(1, "one text, twice the same")] * 9 + [(1, "another")], "doc_id long, text string")
    found = om.against_edits(same).collect()
    assert len(found) == 10 and sum(r.near_next == 1 for r in found) == 8
    alone = om.against_edits(spark.createDataFrame([(5, "alone")], "doc_id long, text string")).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"alona").hexdigest()
    nothing = om.against_edits(spark.createDataFrame([], "doc_id long, text string"))
    assert nothing.count() == 0 and len(nothing.columns) == 7


def test_fingerprint_column(spark):
    frame = spark.createDataFrame([(1, "some text here", "old", 2.0), (1, "some text here", "old", 2.0), (None, None, None, None)], "doc_id long, text string, Fingerprint string, `a.b` double")
    found = om.fingerprint(frame)
    assert found.columns == ["doc_id", "text", "a.b", "fingerprint"]
    one = om.Sketcher()("some text here").hex()
    assert sorted(r.fingerprint for r in found.collect()) == ["", one, one]
    assert om.fingerprint(frame.limit(0)).count() == 0


def test_query_on_its_whole_table(spark):
    import duckdb

    rows = [(i, t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()]
    found = queries.QUERIES["op13_order_minhash"](spark, SF_SMALL).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    sketch = om.Sketcher()
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        r, changed = by_id[doc_id], om.edited(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        marks = sketch(text), sketch(changed), sketch(following)
        assert (r.fingerprint, r.edited_fingerprint) == (marks[0].hex(), marks[1].hex())
        assert (r.near_edited, r.near_next) == (om.likeness(*marks[:2]), om.likeness(marks[0], marks[2]))
    for r in found[:20]:
        text = dict(rows)[r.doc_id]
        if len(text) < 3000:
            assert r.fingerprint == plain(text, sketch)
