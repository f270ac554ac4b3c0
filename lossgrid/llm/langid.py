"""Language identification by interpolated Kneser-Ney character models (operator 7).

One model of order four for each language, over lower-cased words between
spaces.  Learning counts words by language inside tasks, then over all rows,
and turns the distinct words into four-grams; all of the learnable rows count,
so what is gathered grows with the input.  Lower orders use Kneser-Ney
continuation counts (how many different characters precede), which follow from
the four-grams.

The model is a set of sorted arrays of 64-bit n-gram hashes, each with a row of
log probabilities (or back-off weights), one for each language.  A text's
distinct words are scored by binary search over all their characters at once;
the language with the lowest cross-entropy in bits a character is predicted.
Arrays of up to ``MAX_NGRAMS`` four-grams go to every task.  A model of more
stays in staged tables: all orders and back-offs are computed by grouping and
joins, and texts are scored by joining their distinct words' n-grams with them.
No four-gram is left out either way, and both give the same predictions.
A temperature (for the score) and an upper limit of the cross-entropy for each
language (beyond which a prediction counts as rejected) are calibrated on all
learnable rows: their bits by language are staged, losses are added up inside
tasks, and quantiles are found by counting values in ever finer buckets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_arrow, named, slices, small_side, stage, stage_observed, texts

ORDER = 4
DISCOUNT = 0.75
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Four-grams (of a language each) up to which a task holds the model; a larger one is joined.
MAX_NGRAMS = 3_000_000
MIXER = np.uint64(0x9E3779B97F4A7C15)


def hashed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points (n x order)."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for i in range(codes.shape[1]):
        h = (h ^ codes[:, i].astype(np.uint64)) * MIXER
        h ^= h >> np.uint64(29)
    return h


def points(strings: list[str]) -> np.ndarray:
    """Code points of equally long strings, a row for each."""
    joined = "".join(strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4").reshape(len(strings), -1)


class Table:
    """A sorted hash array with a row of numbers for each entry."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the rows of those."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), self.rows
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return there, self.rows[at[there]]


@dataclass
class Model:
    languages: list[str]
    grams: list[Table]  # of order 1 to ORDER: log2 probabilities
    backs: list[Table]  # of contexts of 1 to ORDER - 1 characters: log2 back-off weights
    floor: np.ndarray  # log2 probability of an unseen character
    temperature: float = 10.0
    limits: np.ndarray | None = None

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """log2 probability of the last character of each row given the others, by language."""
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        left = np.arange(len(windows))
        for order in range(ORDER, 0, -1):
            there, rows = self.grams[order - 1].find(hashed(windows[left, ORDER - order :]))
            out[left[there]] += rows
            left = left[~there]
            if not len(left):
                return out
            if order > 1:
                known, weights = self.backs[order - 2].find(hashed(windows[left, ORDER - order : -1]))
                out[left[known]] += weights
        out[left] += self.floor
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits by language and number of characters of every word, its end included."""
        pad = " " * (ORDER - 1)
        joined = "".join([f"{pad}{w} " for w in words]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(lengths.sum()) + np.repeat(np.arange(len(words)) * (ORDER - 1), lengths)
        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at]
        return np.add.reduceat(self.bits(windows), starts, axis=0), lengths


@dataclass
class StagedModel:
    """The same model as tables in the shared folder: gram, p (log2 values by language)."""

    languages: list[str]
    grams: list[DataFrame]  # of order 1 to ORDER: log2 probabilities
    backs: list[DataFrame]  # of contexts of 1 to ORDER - 1 characters: log2 back-off weights
    floor: np.ndarray  # log2 probability of an unseen character
    temperature: float = 10.0
    limits: np.ndarray | None = None


def build_tables(counts: DataFrame) -> StagedModel:
    """Kneser-Ney models from four-gram counts (lang, gram, n), by grouping and joins."""

    def by_gram(values: DataFrame, name: str) -> DataFrame:
        return stage(values.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("p")), name)

    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        tails = levels[0].groupBy("lang", F.expr(f"substring(gram, 2, {order})").alias("gram"))
        levels.insert(0, stage(tails.agg(F.count("*").alias("n")), f"grams-{order}"))  # how many characters precede
    alphabet = levels[0].select("gram").distinct().count() + 1
    tables, backs, floor, lower = [], [], {}, None
    for order, level in enumerate(levels, 1):
        level = level.withColumn("head", F.expr(f"substring(gram, 1, {order - 1})"))
        heads = level.groupBy("lang", "head").agg(F.sum("n").alias("total"), (F.lit(DISCOUNT) * F.count("*") / F.sum("n")).alias("weight"))
        heads = stage(heads, f"heads-{order}")
        known = level.join(heads, ["lang", "head"])
        if order == 1:
            floor = {r["lang"]: float(np.log2(r["weight"] / alphabet)) for r in heads.collect()}  # a row for each language
            known = known.withColumn("base", F.lit(1.0 / alphabet))
        else:
            backs.append(by_gram(heads.select("lang", F.col("head").alias("gram"), F.log2("weight").alias("p")), f"backs-{order - 1}"))
            below = lower.select("lang", F.col("gram").alias("tail"), F.col("probability").alias("base"))
            known = known.withColumn("tail", F.expr(f"substring(gram, 2, {order - 1})")).join(below, ["lang", "tail"])
        probability = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("base")
        lower = stage(known.select("lang", "gram", probability.alias("probability")), f"probabilities-{order}")
        tables.append(by_gram(lower.select("lang", "gram", F.log2("probability").alias("p")), f"model-{order}"))
    languages = sorted(floor)
    return StagedModel(languages, tables, backs, np.array([floor[x] for x in languages]))


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text with their counts."""
    for batch in slices(batches, 16):
        rows, words, counts = [], [], []
        for row, text in zip(batch.column("_row").to_pylist(), texts(batch, "_text"), strict=True):
            found = Counter(LETTERS.findall(text.lower()))
            rows.extend([row] * len(found)), words.extend(found), counts.extend(found.values())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["row", "word", "n"])


def measured_by_join(rows: DataFrame, model: StagedModel) -> DataFrame:
    """row, chars, bits (a character, by language) of each of ``rows`` (_row, _text) that holds a letter.

    Windows are scored once for all words, words once for all texts.  Each join
    has one row for a key on its other side, so a frequent key can be split.
    """
    words = stage(rows.select("_row", "_text").mapInArrow(_document_words, "row long, word string, n long"), "document-words")
    padded = F.concat(F.lit(" " * (ORDER - 1)), "word", F.lit(" "))
    at = words.select("word").distinct().select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: padded.substr(i, F.lit(ORDER)))).alias("window"))
    at = stage(at, "word-windows")
    windows = at.select("window").distinct()

    def looked_up(windows: DataFrame, side: DataFrame, start: int, length: int, name: str) -> DataFrame:
        side = small_side(side.select(F.col("gram").alias("_gram"), F.col("p").alias(name)))
        return windows.join(side, F.expr(f"substring(window, {start}, {length})") == F.col("_gram"), "left").drop("_gram")

    for order in range(ORDER, 0, -1):
        windows = looked_up(windows, model.grams[order - 1], ORDER - order + 1, order, f"own{order}")
        if order > 1:
            windows = looked_up(windows, model.backs[order - 2], ORDER - order + 1, order - 1, f"back{order}")

    def bits(i: int, lang: str):
        value = F.coalesce(F.element_at("own1", F.lit(lang)), F.lit(float(model.floor[i])))
        for order in range(2, ORDER + 1):
            value = F.coalesce(F.element_at(f"own{order}", F.lit(lang)), F.coalesce(F.element_at(f"back{order}", F.lit(lang)), F.lit(0.0)) + value)
        return value

    scored = stage(windows.select("window", F.array(*(bits(i, x) for i, x in enumerate(model.languages))).alias("bits")), "windows")
    size = range(len(model.languages))
    by_word = stage(at.join(scored, "window").groupBy("word").agg(F.array(*(F.sum(F.get("bits", F.lit(i))) for i in size)).alias("bits")), "words")
    chars = F.sum(F.col("n") * (F.length("word") + 1)).cast("double")
    return words.join(by_word, "word").groupBy("row").agg(chars.alias("chars"), F.array(*(-F.sum(F.col("n") * F.get("bits", F.lit(i))) / chars for i in size)).alias("bits"))


def build(counts: pd.DataFrame) -> Model:
    """Kneser-Ney models from four-gram counts (lang, gram, n)."""
    languages = sorted(counts["lang"].unique())
    size = len(languages)
    column = {x: i for i, x in enumerate(languages)}
    types, index = np.unique(counts["gram"].to_numpy(dtype=object).astype(str), return_inverse=True) if len(counts) else (np.empty(0, str), np.empty(0, int))
    matrix = np.zeros((len(types), size))
    np.add.at(matrix, (index, counts["lang"].map(column).to_numpy(int) if len(counts) else index), counts["n"].to_numpy(float))

    levels: list[tuple[np.ndarray, np.ndarray]] = []  # from order 1 on: grams, counts
    grams, numbers = types.astype(str), matrix
    levels.append((grams, numbers))
    while grams.size and len(grams[0]) > 1:
        tails = np.array([g[1:] for g in grams])
        grams, where = np.unique(tails, return_inverse=True)
        previous, numbers = numbers, np.zeros((len(grams), size))
        np.add.at(numbers, where, previous > 0)  # how many characters precede
        levels.append((grams, numbers))
    levels.reverse()
    if not types.size:
        return Model(languages, [Table(np.empty(0, np.uint64), np.zeros((0, size), np.float32)) for _ in range(ORDER)], [Table(np.empty(0, np.uint64), np.zeros((0, size), np.float32)) for _ in range(ORDER - 1)], np.full(size, -20.0))

    alphabet = len(levels[0][0]) + 1
    tables, backs, lower = [], [], None
    floor = np.log2(np.full(size, 1.0 / alphabet))
    for order, (grams, numbers) in enumerate(levels, 1):
        if order == 1:
            heads, where = np.array([""]), np.zeros(len(grams), int)
        else:
            heads, where = np.unique(np.array([g[:-1] for g in grams]), return_inverse=True)
        totals, kinds = np.zeros((len(heads), size)), np.zeros((len(heads), size))
        np.add.at(totals, where, numbers)
        np.add.at(kinds, where, numbers > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(totals > 0, DISCOUNT * kinds / totals, 1.0)
            own = np.where(totals[where] > 0, np.maximum(numbers - DISCOUNT, 0) / totals[where], 0.0)
        if order == 1:
            base = np.full((len(grams), size), 1.0 / alphabet)
            floor = np.log2(weight[0] / alphabet)
        else:
            below, rows = lower
            base = rows[np.searchsorted(below, np.array([g[1:] for g in grams]))]
            backs.append(Table(hashed(points(list(heads))), np.log2(weight).astype(np.float32)))
        probability = own + weight[where] * base
        tables.append(Table(hashed(points(list(grams))), np.log2(probability).astype(np.float32)))
        lower = grams, probability
    return Model(languages, tables, backs, floor.astype(np.float32))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by language, counted inside the task."""

    def written() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

    counts: Counter = Counter()
    for batch in slices(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            by.setdefault(lang, []).extend(LETTERS.findall(text.lower()))
        for lang, words in by.items():
            for word, n in Counter(words).items():
                counts[lang, word] += n
        if len(counts) > 200_000:
            yield written()
            counts.clear()
    yield written()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-grams of counted words, counted inside the task and written out before they grow large."""

    def written() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"])

    counts: Counter = Counter()
    for batch in slices(batches, 4096):
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            padded = " " * (ORDER - 1) + word + " "
            for i in range(len(padded) - ORDER + 1):
                counts[lang, padded[i : i + ORDER]] += n
        if len(counts) > 500_000:
            yield written()
            counts.clear()
    yield written()


def entropies(model: Model, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a character by language, and number of scored characters, of each text."""
    found = [LETTERS.findall(t.lower()) for t in batch]
    flat = [w for words in found for w in words]
    bits, chars = np.zeros((len(batch), len(model.languages))), np.zeros(len(batch))
    if flat:
        codes, unique = pd.factorize(np.array(flat, dtype=object))
        by_word, lengths = model.words(list(unique))
        owner = np.repeat(np.arange(len(batch)), [len(w) for w in found])
        chars = np.bincount(owner, lengths[codes], len(batch))
        for i in range(len(model.languages)):
            bits[:, i] = np.bincount(owner, by_word[codes, i], len(batch))
    return -bits / np.maximum(chars, 1)[:, None], chars


def learn(documents: DataFrame, usable=None, *, max_ngrams: int = MAX_NGRAMS) -> Model | StagedModel:
    """Models of every non-null ``lang`` of ``documents`` (doc_id, text, lang).

    ``usable`` names the ids that may be learned from (a Column over doc_id).
    Other columns are ignored; a repeated row counts again; without a learnable
    row the model knows no language.  A language whose rows hold no letter is
    not learned.  Beyond ``max_ngrams`` the model is a set of staged tables.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    if usable is not None:
        rows = rows.where(usable(F.col("doc_id")))
    words = rows.select("lang", "text").mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams, seen = stage_observed(grams, "four-grams", size=F.count(F.lit(1)))
    model = build(grams.toPandas()) if seen["size"] <= max_ngrams else build_tables(grams)
    if model.languages:
        calibrate(model, rows.select("lang", "text"))
    return model


def calibrate(model: Model | StagedModel, rows: DataFrame) -> None:
    """Set the model's temperature and limits by every one of ``rows`` (lang, text)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, chars = entropies(model, texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(chars), pa.array(list(values), pa.list_(pa.float64()))], ["lang", "chars", "bits"])

    if isinstance(model, StagedModel):
        rows = stage(rows.select("lang", F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row")), "calibration")
        measures = measured_by_join(rows, model).join(rows.select("_row", "lang"), F.col("row") == F.col("_row")).select("lang", "chars", "bits")
    else:
        measures = rows.mapInArrow(measured, "lang string, chars double, bits array<double>")
    own = F.array_position(F.lit(model.languages), F.col("lang")).cast("int") - 1
    measures = stage(measures.where("chars > 0").select(own.alias("own"), "bits").where("own >= 0"), "measures")
    scale = np.geomspace(0.5, 200, 60)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(scale))
        for batch in slices(batches, 4096):
            bits, at = np.array(batch.column("bits").to_pylist()), batch.column("own").to_numpy()
            sums += [-np.log(softmax(-bits * t)[np.arange(len(at)), at] + 1e-9).sum() for t in scale]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(scale)), pa.int32()), pa.array(sums)], ["at", "loss"])

    loss = {r["at"]: r["loss"] for r in measures.mapInArrow(losses, "at int, loss double").groupBy("at").agg(F.sum("loss").alias("loss")).collect()}
    high = quantiles(measures.select("own", F.get("bits", F.col("own")).alias("value")), 0.999)
    if high:
        model.temperature = float(scale[min(loss, key=lambda i: (loss[i], i))])
    model.limits = np.array([high.get(i, np.inf) + 0.5 for i in range(len(model.languages))])


def quantiles(values: DataFrame, share: float, buckets: int = 256) -> dict[int, float]:
    """The exact quantile, interpolated between neighbours, of ``value`` for each ``own``.

    A round counts the values of each interval in equal buckets and goes on in
    the bucket that holds the rank, so the driver gets ``buckets`` rows for a
    search and every round scans ``values``, which should be staged.
    """
    searches, sizes = [], {}
    for own, n, lo, hi in values.groupBy("own").agg(F.count("*"), F.min("value"), F.max("value")).collect():
        sizes[own] = n
        at = int((n - 1) * share)
        searches += [{"own": own, "rank": r, "lo": lo, "hi": hi, "below": 0} for r in {at, min(at + 1, n - 1)}]
    while wide := [s for s in searches if s["lo"] < s["hi"]]:
        asked = values.sparkSession.createDataFrame([(i, s["own"], s["lo"], s["hi"]) for i, s in enumerate(wide)], "search int, own int, lo double, hi double")
        inside = values.join(F.broadcast(asked), "own").where("value between lo and hi")
        place = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)  # the ends fall in the first and the last
        counts = inside.groupBy("search", F.least(place, F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        found = sorted(counts.collect(), key=lambda r: (r["search"], r["bucket"]))
        below = [s["below"] for s in wide]
        for r in found:
            s, seen = wide[r["search"]], below[r["search"]]
            if seen <= s["rank"] < seen + r["n"]:
                s.update(lo=r["lo"], hi=r["hi"], below=seen)
            below[r["search"]] += r["n"]
    at_rank = {(s["own"], s["rank"]): s["lo"] for s in searches}
    out = {}
    for own, n in sizes.items():
        at = int((n - 1) * share)
        low, high = at_rank[own, at], at_rank[own, min(at + 1, n - 1)]
        out[own] = low + (high - low) * ((n - 1) * share - at)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _decided(model: Model | StagedModel, values: np.ndarray, chars: np.ndarray) -> list[pa.Array]:
    """lang_pred, score, entropy and rejected from the bits by language of some texts."""
    n = len(chars)
    names, scores, bits, rejected = [UNKNOWN] * n, np.ones(n), np.zeros(n), np.ones(n, bool)
    if model.languages:
        limits = model.limits if model.limits is not None else np.full(len(model.languages), np.inf)
        best = values.argmin(axis=1)
        some = chars > 0
        likely = softmax(-values * model.temperature)[np.arange(n), best]
        lowest = values[np.arange(n), best]
        names = [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
        scores, bits = np.where(some, likely, 1.0), np.where(some, lowest, 0.0)
        rejected = ~some | (lowest > limits[best])
    return [pa.array(names, pa.string()), pa.array(scores), pa.array(bits), pa.array(rejected)]


RESULT = ["lang_pred", "score", "entropy", "rejected"]


def predict(documents: DataFrame, model: Model | StagedModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, entropy and rejected of every row's whole text.

    A null text or one without a letter is ``und`` with score 1 and rejected.
    ``rejected`` also marks texts whose lowest cross-entropy is beyond what the
    language's own texts have; lang_pred still names the nearest language.
    Ties go to the language first in code point order.  Repeated rows are
    predicted alike; an empty table gives an empty table.
    """
    columns = list(keep)
    rows = documents.select(*map(named, columns), F.col("text").cast("string").alias("_text"))
    types = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["lang_pred string", "score double", "entropy double", "rejected boolean"])

    if isinstance(model, StagedModel):
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
        found = measured_by_join(rows, model)
        rows = rows.join(found, F.col("_row") == F.col("row"), "left").select(*map(named, columns), F.coalesce("chars", F.lit(0.0)).alias("_chars"), F.col("bits").alias("_bits"))
        blank = [0.0] * len(model.languages)
        # The tables stay where they are: a task needs the names and what was calibrated.
        known = Model(model.languages, [], [], model.floor, model.temperature, model.limits)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                values = np.array([x or blank for x in batch.column("_bits").to_pylist()])
                decided = _decided(known, values, batch.column("_chars").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *decided], [*columns, *RESULT])

        return map_arrow(rows, judge, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, chars = entropies(model, texts(batch, "_text")) if model.languages else (np.zeros((batch.num_rows, 0)), np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *_decided(model, values, chars)], [*columns, *RESULT])

    return map_arrow(rows, run, types)
