"""Near-duplicate detection with min-max hashing (operator 8).

A document's set: the distinct five-word shingles of its whole text (A-Z
lower-cased; fewer words: the whole sequence as one shingle).  Under each of
``permutations`` hash functions both the smallest and the largest value are
kept, so k evaluations give a signature of 2k values; signatures are cut into
bands.  Documents are linked when the Jaccard similarity of their full sets is
at least ``percent`` / 100.

Steps, none of which emits the pairs of a group:

1. Documents with the same set (128-bit digest) form a class; its smallest
   doc_id represents it, so exact copies never multiply work.
2. Representatives that share a band bucket are candidates.  Each is first
   compared with the bucket's smallest member; the links whose signatures put
   the threshold within reach label what they connect, over all buckets.
3. Only in buckets whose members have different labels do these still have to
   meet: they are dealt into blocks, and each pair of blocks is one piece of
   work that keeps a spanning forest of the pairs within reach.  The largest
   label is the core, whose blocks meet only those of the rest.  So pairs meet
   only if they share a bucket and nothing links them yet, and texts that
   share half their words but few buckets cost little, however many they are.
   The components of these links are the families.
4. Inside a family full sets are compared, first with the family's smallest
   member, then again by pairs of blocks between what that left apart.  A
   family of n members that are all linked to the smallest costs n rows; one
   that is similar only in chains costs up to n times its number of blocks of
   512.  The components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, redealt
from .util import slices, stage, texts

SHINGLE = 5
PERMUTATIONS = 64
BAND_ROWS = 6
#: Estimates this far below the threshold are still confirmed: over 3.5
#: standard deviations of 128 values.
MARGIN = 0.13
BLOCK_ROWS = 512
BLOCK_SHINGLES = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()) | 1 for i in range(n)], np.uint64)


class Shingler:
    """Word hashes are remembered, as words repeat."""

    def __init__(self, size: int = SHINGLE, remember: int = 300_000):
        self.size, self.remember, self.known = size, remember, {}
        self.factors = constants(size, 1)

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of a text."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
        n = len(words) - self.size + 1
        total = hashes[:n] * self.factors[0]
        for i in range(1, self.size):
            total += hashes[i : i + n] * self.factors[i]
        return np.unique(mixed(total))


def min_max(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The smallest and largest value under each permutation, side by side."""
    low = high = None
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * scale + shift
        lo, hi = values.min(axis=0), values.max(axis=0)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return np.column_stack([low, high]).ravel()


def bands(values: np.ndarray, rows: int, factors: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values."""
    n = len(values) // rows
    cut = mixed(values[: n * rows].reshape(n, rows)) * factors
    return mixed(cut.sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64))


def signature(values: np.ndarray) -> bytes:
    """One byte of each value."""
    return (mixed(values) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(permutations: int, rows: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        scale, shift, factors = constants(permutations, 2), constants(permutations, 3), constants(rows, 4)
        for batch in slices(batches):
            sizes, digests, keys, marks = [], [], [], []
            for text in texts(batch):
                found = shingler(text)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), keys.append(None), marks.append(None)
                    continue
                values = min_max(found, scale, shift)
                digests.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                keys.append(bands(values, rows, factors).view(np.int64))
                marks.append(signature(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    return run


def _sets(permutations: int, shingle: int):
    """Replace text by its shingle set, 8 bytes for each, its size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        scale, shift = constants(permutations, 2), constants(permutations, 3)
        for batch in slices(batches):
            found = [s for s in map(shingler, texts(batch))]
            marks = [signature(min_max(s, scale, shift)) if len(s) else bytes(2 * permutations) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("family"), pa.array(map(len, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(marks, pa.binary())],
                ["node", "family", "n_shingles", "shingles", "signature"],
            )

    return run


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Deal the members of each ``family`` into blocks; a row for each pair of blocks a member is in.

    Members with one ``label`` are linked already and need not meet.  The
    label with most members is the family's core: a block of the core meets
    the blocks of the rest only, and a family that is all core needs no work.
    Of all other members every two meet in exactly one pair of blocks.  Blocks
    come from the id's hash, so no window over a family is needed.
    """
    parts = members.groupBy("family", "label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    sizes = parts.groupBy("family").agg(F.max(F.struct("m", "label", "s")).alias("core"), F.sum("m").alias("m"), F.sum("s").alias("s")).where("m > core.m")
    sizes = sizes.select(redealt(F.col("family")).alias("own"), F.col("core.label").alias("core"), _blocks(F.col("core.m"), F.col("core.s")).alias("cores"), _blocks(F.col("m") - F.col("core.m"), F.col("s") - F.col("core.s")).alias("rests"))
    dealt = members.join(sizes, F.col("family") == F.col("own")).drop("own")
    inner, last = F.col("label") == F.col("core"), F.col("cores") + F.col("rests") - 1
    place = F.when(inner, F.pmod(F.xxhash64("node"), F.col("cores").cast("long"))).otherwise(F.col("cores") + F.pmod(F.xxhash64("node"), F.col("rests").cast("long")))
    dealt = dealt.withColumn("block", place.cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(inner, F.col("cores")).otherwise(F.lit(0)), last)))
    dealt = dealt.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("core", "cores", "rests", "other")
    return dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")


def agreement(mine: np.ndarray, its: np.ndarray) -> np.ndarray:
    """Estimated similarity from signatures (rows of bytes); two bytes agree by chance once in 256."""
    return ((mine == its).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _likely(permutations: int, least: float):
    """The star links whose signatures let the threshold seem within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            mine, its = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2 * permutations) for c in ("signature", "pivot"))
            near = pa.array(agreement(mine, its) >= least)
            yield batch.select(["a", "b"]).filter(near)

    return run


def similar(mine: bytes, its: bytes, percent: int) -> bool:
    """Whether two full sets are similar enough, in whole numbers."""
    x, y = np.frombuffer(mine, np.uint64), np.frombuffer(its, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _labelled(percent: int):
    """Label each member of a family: the pivot if confirmed to be linked to it, else itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            columns = (batch.column(c).to_pylist() for c in ("node", "family", "shingles", "pivot"))
            labels = [family if node == family or similar(own, pivot, percent) else node for node, family, own, pivot in zip(*columns, strict=True)]
            kept = batch.drop_columns(["pivot"])
            yield kept.append_column("label", pa.array(labels, pa.int64()))

    return run


def _forest(percent: int, margin: float, confirm: bool):
    """Each pair of blocks to a spanning forest of its links.

    Links are the pairs whose signatures let the threshold seem within reach
    and, with ``confirm``, whose full sets are similar enough in whole
    numbers.  Pairs that are already connected are not looked at.
    """
    reach = percent / 100

    def solve(rows: list[dict]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: r["n_shingles"])
        edges, label = [], np.unique([r["label"] for r in rows], return_inverse=True)[1]
        crossing = rows[0]["i"] != rows[0]["j"]
        blocks = np.array([r["block"] for r in rows])
        sizes = np.array([r["n_shingles"] for r in rows])
        signatures = np.stack([np.frombuffer(r["signature"], np.uint8) for r in rows])
        firsts = np.searchsorted(sizes, sizes * reach - 1e-9)  # smaller sets cannot be similar enough
        for x in range(1, len(rows)):
            wanted = label[firsts[x] : x] != label[x]
            if crossing:
                wanted &= blocks[firsts[x] : x] != blocks[x]
            others = np.flatnonzero(wanted) + firsts[x]
            if not len(others):
                continue
            estimates = agreement(signatures[others], signatures[x])
            for y in others[np.argsort(-estimates, kind="stable")][: int((estimates >= reach - margin).sum())]:
                if label[y] != label[x] and (not confirm or similar(rows[x]["shingles"], rows[y]["shingles"], percent)):
                    label[label == label[y]] = label[x]
                    edges.append((rows[x]["node"], rows[y]["node"]))
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                here = row["family"], row["i"], row["j"]
                if here != key:
                    if len(group) > 1:
                        out += solve(group)
                    key, group = here, []
                    if len(out) > 10_000:
                        yield _edges(out)
                        out = []
                group.append(row)
        if len(group) > 1:
            out += solve(group)
        yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def near_duplicates(documents: DataFrame, *, percent: int = 85, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS, margin: float = MARGIN) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text; other columns are ignored).

    doc_id, n_shingles, component_id (smallest doc_id reachable over links),
    kept (doc_id = component_id).  Documents without a word, null texts
    included, have an empty set and are linked with nothing.  Rows that repeat
    an id are one node: they stay or go together.  A row with a null doc_id is
    linked with nothing and kept; its component_id is null.  An empty table
    gives an empty table.

    With 64 permutations and bands of six values, a pair at the threshold of
    0.85 is missed with a probability under 0.0001 and a more similar one less
    (at 0.80, bands of six miss 0.0017 and bands of five 0.00005).
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(docs.mapInArrow(_signatures(permutations, band_rows, shingle), "doc_id long, n_shingles long, digest string, bands array<long>, signature binary"), "signatures")

    # 1. classes of equal sets
    shown = signed.where("digest is not null and doc_id is not null")
    classes = shown.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n_shingles", "bands", "signature"), "doc_id").alias("of"))
    classes = stage(classes.select("digest", "node", "of.*"), "classes")

    # 2. members of buckets that several share; links to a bucket's smallest member come first
    buckets = classes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select(redealt(F.col("key")).alias("own"), "least")
    members = stage(buckets.join(shared, F.col("key") == F.col("own")).select("key", "node", "least"), "members")
    stars = members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    marks = classes.select("node", "signature")
    pivots = marks.select(redealt(F.col("node")).alias("p"), F.col("signature").alias("pivot"))
    pairs = stars.join(marks, F.col("a") == F.col("node")).join(pivots, F.col("b") == F.col("p")).select("a", "b", "signature", "pivot")
    first = pairs.mapInArrow(_likely(permutations, percent / 100 - margin), "a long, b long")
    labels = stage(components(first, "labels"), "labels")

    # 3. families by estimate: in buckets of several labels these meet
    named = members.join(labels.select(F.col("node").alias("n"), F.col("component").alias("label")), F.col("node") == F.col("n"), "left")
    named = stage(named.select("key", "node", F.coalesce("label", "node").alias("label")), "labelled-members")
    open_ = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(redealt(F.col("key")).alias("own"))
    met = named.join(open_, F.col("key") == F.col("own")).join(classes.select(redealt(F.col("node")).alias("c"), "n_shingles", "signature"), F.col("node") == F.col("c"))
    met = stage(met.select("node", F.col("key").alias("family"), "n_shingles", "signature", "label"), "meeting")
    likely = _in_blocks(met).mapInArrow(_forest(percent, margin, confirm=False), "a long, b long")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    families = stage(components(likely.union(known), "families").select("node", F.col("component").alias("family")), "families")

    # 4. links confirmed on full sets, to each family's pivot (its smallest member) first
    whole = docs.join(families, F.col("doc_id") == F.col("node")).select("node", "family", "text")
    whole = stage(whole.mapInArrow(_sets(permutations, shingle), "node long, family long, n_shingles long, shingles binary, signature binary"), "sets")
    pivots = whole.where("node = family").groupBy("family").agg(F.min("shingles").alias("pivot")).select(redealt(F.col("family")).alias("p"), "pivot")
    known = whole.join(pivots, F.col("family") == F.col("p")).drop("p")
    known = stage(known.mapInArrow(_labelled(percent), "node long, family long, n_shingles long, shingles binary, signature binary, label long"), "labelled")
    to_pivot = known.where("label = family and node <> family").select(F.col("node").alias("a"), F.col("family").alias("b"))
    confirmed = _in_blocks(known).mapInArrow(_forest(percent, margin, confirm=True), "a long, b long").union(to_pivot)
    # Rows of one id with different sets tie their classes together.
    twice = shown.groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select(F.col("doc_id").alias("a"))
    several = shown.join(twice, F.col("doc_id") == F.col("a")).select("a", "digest")
    ties = several.join(classes, "digest").select("a", F.col("node").alias("b"))
    linked = components(confirmed.union(ties), "links")

    named = classes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("own"))
    rows = signed.select("doc_id", "n_shingles", "digest").join(stage(named, "named"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_one(documents: DataFrame, **settings) -> DataFrame:
    """The rows of ``documents`` that stay, one of each group, with all their columns."""
    kept = near_duplicates(documents, **settings).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return documents.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
