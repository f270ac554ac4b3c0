"""Toxicity by a weighted finite-state pattern grammar (operator 9).

Five transducers read a clause word by word, each passing what it writes to the
next: *target* (who is spoken to), *threat* (counts only once a target is in
the clause, before or after it), *negation* and *reported speech* (each bears
on the six words that follow) and *insult* (a lexeme learned from labelled
rows).  :func:`compose` turns the cascade into one machine: a state and a word
class give the next state and the factor with which the word's weight is
written out.  A clause scores what the composed machine writes over its words,
so an insult after a negation or inside reported speech counts less and one
after a target counts more.  A document's clause scores become five numbers,
which a logistic model fitted on the labelled rows turns into a probability.

Learning (:func:`learn`) uses at most ``max_rows`` labelled rows, taken by
their id's hash: the lexicon is every word, or word beginning of 4 to 8
characters, that marks toxic rows so clearly that chance is ruled out over all
candidates (binomial tail with Bonferroni correction); rows that share their
lowest shingle hash count once, so copies do not pose as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_arrow, named, slices, stage, stage_observed, texts

# Seed word classes (fixed values): closed-class words in four languages.
TARGETS = frozenset(
    "you your yours u he she they them those him her everyone du dich dir ihr euch sie "
    "tu toi te vous ils elles tú usted ustedes vosotros ellos ellas".split()
)
NEGATIONS = frozenset("not no never none nobody without isn aren wasn don doesn nicht kein keine nie ohne ne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says say quoted quote called wrote claimed sagte sagt schrieb zitierte dit disait écrit dijo dice escribió".split())
THREATS = frozenset("kill murder hurt destroy shoot stab burn hang töten umbringen erschießen tuer frapper brûler matar golpear quemar".split())

LETTERS = re.compile(r"[^\W\d_]+")
CLAUSES = re.compile(r"[.!?;:\n]+")
PREFIXES = range(4, 9)

# Word classes, which are also the symbols between the transducers.
OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)
#: What counts: a threat with its target between transducers, and all that the last one writes.
HARM = 6
#: Words that a negation or a report bears on.
REACH = 6

#: A transducer: transducer[state][symbol] = (next state, symbol written, factor);
#: a symbol that is not named passes through in the same state.
Transducer = list[dict[int, tuple[int, int, float]]]


def target_transducer(aimed: float = 1.25) -> Transducer:
    """After a target, a threat is complete and an insult counts more."""
    return [
        {TARGET: (1, TARGET, 1.0)},
        {THREAT: (1, HARM, 1.0), INSULT: (1, INSULT, aimed)},
    ]


def threat_transducer() -> Transducer:
    """A threat without a target before it waits for one."""
    return [
        {THREAT: (1, OTHER, 1.0)},
        {THREAT: (1, OTHER, 1.0), TARGET: (0, HARM, 1.0)},
    ]


def scope_transducer(opens: int, harm: float, insult: float, ends: bool) -> Transducer:
    """From a word of class ``opens`` on, what counts is scaled for REACH words.

    With ``ends``, an insult or a second such word ends the scope.
    """
    machine: Transducer = [{opens: (1, OTHER, 1.0)}]
    for read in range(1, REACH + 1):
        onward = read + 1 if read < REACH else 0
        passed = {symbol: (onward, symbol, 1.0) for symbol in (OTHER, TARGET, NEGATION, REPORT, THREAT)}
        machine.append(passed | {opens: (0 if ends else 1, OTHER, 1.0), HARM: (onward, HARM, harm), INSULT: (0 if ends else onward, INSULT, insult)})
    return machine


def insult_transducer() -> Transducer:
    return [{INSULT: (0, HARM, 1.0)}]


def compose(*cascade: Transducer) -> list[list[tuple[int, float]]]:
    """One machine for the cascade: machine[state][word class] = (next state, factor written).

    A state stands for a state of each transducer; those that can be reached
    are numbered from the start's 0.  Factors multiply along the cascade, and
    only what leaves it as HARM is written.
    """
    order = [(0,) * len(cascade)]
    numbers, machine = {order[0]: 0}, []
    for states in order:  # grows as states are reached
        row = []
        for symbol in (OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT):
            reached, factor = [], 1.0
            for transducer, state in zip(cascade, states, strict=True):
                state, symbol, scale = transducer[state].get(symbol, (state, symbol, 1.0))
                reached.append(state)
                factor *= scale
            if tuple(reached) not in numbers:
                numbers[tuple(reached)] = len(order)
                order.append(tuple(reached))
            row.append((numbers[tuple(reached)], factor if symbol == HARM else 0.0))
        machine.append(row)
    return machine


GRAMMAR = compose(
    target_transducer(),
    threat_transducer(),
    scope_transducer(NEGATION, harm=0.1, insult=0.5, ends=True),
    scope_transducer(REPORT, harm=0.2, insult=0.6, ends=False),
    insult_transducer(),
)
SEED_WEIGHT = 2.0
FEATURES = ("total", "largest", "clauses", "lexemes", "density")


@dataclass(frozen=True)
class Model:
    """Lexicon (word or beginning to weight) and the logistic model over FEATURES."""

    lexicon: dict[str, float]
    coefficients: tuple[float, ...]
    intercept: float


def beginnings(word: str) -> Iterator[str]:
    """The word marked as whole, then its beginnings of 4 to 8 characters."""
    yield word + "$"
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n]


def word_class(word: str, lexicon: dict[str, float]) -> tuple[int, float, str]:
    best = max(((lexicon[b], b) for b in beginnings(word) if b in lexicon), default=None)
    if best is not None:
        return INSULT, best[0], best[1]
    if word in THREATS:
        return THREAT, SEED_WEIGHT, word
    if word in NEGATIONS:
        return NEGATION, 0.0, word
    if word in REPORTS:
        return REPORT, 0.0, word
    if word in TARGETS:
        return TARGET, 0.0, word
    return OTHER, 0.0, word


def clause_score(words: list[str], classes: dict[str, tuple[int, float, str]]) -> tuple[float, set[str]]:
    """Run the composed machine over one clause: what it writes, and the lexemes matched."""
    state, score, matched = 0, 0.0, set()
    for word in words:
        kind, weight, lexeme = classes[word]
        state, factor = GRAMMAR[state][kind]
        if factor:
            # A target that completes a threat writes the threat's weight.
            score += factor * (weight if kind == INSULT else SEED_WEIGHT)
            if kind != TARGET:
                matched.add(lexeme)
    return score, matched


def features(text: str, lexicon: dict[str, float], known: dict[str, tuple[int, float, str]]) -> tuple[float, ...]:
    """FEATURES of a whole text; ``known`` remembers the classes of words seen."""
    words = LETTERS.findall(text.lower())
    fresh = set(words).difference(known)
    if fresh:
        if len(known) > 200_000:
            known.clear()
            fresh = set(words)
        known.update((w, word_class(w, lexicon)) for w in fresh)
    hits = {w for w in set(words) if known[w][0] >= THREAT}
    if not hits:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    total = largest = 0.0
    clauses, lexemes = 0, set()
    for clause in CLAUSES.split(text.lower()):
        inside = LETTERS.findall(clause)
        if hits.isdisjoint(inside):
            continue
        # Words of a clause are words of the text, but for letters whose case
        # folding depends on their neighbours.
        for w in inside:
            if w not in known:
                known[w] = word_class(w, lexicon)
        score, matched = clause_score(inside, known)
        if score > 0:
            total += score
            largest = max(largest, score)
            clauses += 1
            lexemes |= matched
    return math.log1p(total), math.log1p(largest), math.log1p(clauses), math.log1p(len(lexemes)), math.log1p(1000.0 * total / max(1, len(words)))


def probability(model: Model, values: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(values @ np.array(model.coefficients) + model.intercept, -40, 40)))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys = []
        for text in texts(batch):
            words = LETTERS.findall(text.lower())
            runs = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
            keys.append(min(xxhash.xxh3_64_intdigest(r) for r in runs) - 2**63)
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic").cast(pa.int32()), pa.array(keys, pa.int64())], ["text", "toxic", "copy_key"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold each beginning, counted within a task before the shuffle."""
    counts: Counter[str] = Counter()
    for batch in slices(batches):
        for text in texts(batch):
            counts.update({b for w in set(LETTERS.findall(text.lower())) for b in beginnings(w)})
        if len(counts) > 300_000:
            yield _counted(counts)
            counts.clear()
    yield _counted(counts)


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["mark", "n"])


def chance(k: int, n: int, rate: float) -> float:
    """Natural log of an upper bound of P(at least k of n) at ``rate`` (Chernoff)."""
    p = k / n
    if p <= rate:
        return 0.0
    rest = 0.0 if k == n else (1 - p) * math.log((1 - p) / (1 - rate))
    return -n * (p * math.log(p / rate) + rest)


def learn(documents: DataFrame, labels: DataFrame, usable=None, *, max_rows: int = 20_000, least_rows: int = 4, purity: float = 0.8) -> Model:
    """Fit the lexicon and the logistic model on at most about ``max_rows`` labelled rows.

    ``documents``: doc_id, text; ``labels``: doc_id, toxic (null: not used; an
    id labelled more than once is toxic if any label says so).  ``usable``
    names the ids that may be learned from (a Column over doc_id).  Without a
    toxic and a clean row the model rests on the seed classes alone.
    """
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic is not null")
    if usable is not None:
        marked = marked.where(usable(F.col("label_id")))
    marked = marked.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    share = 1.0 if total <= max_rows else max_rows / total

    def chosen(doc_id):
        return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & chosen(F.col("doc_id")))
    if usable is not None:
        docs = docs.where(usable(F.col("doc_id")))
    rows = docs.join(marked.where(chosen(F.col("label_id"))), F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    # One row for each lowest shingle hash: copies and most near copies count once.
    rows = rows.mapInArrow(_training_rows, "text string, toxic int, copy_key long").groupBy("copy_key").agg(F.max(F.struct("toxic", "text")).alias("row")).select("row.*")
    rows = stage(rows, "toxic-rows")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, (1.0, 1.0, 0.0, 0.0, 0.0), -4.0)

    def counted(label: int) -> DataFrame:
        part = rows.where(F.col("toxic") == label).select("text").mapInArrow(_count, "mark string, n long")
        return part.groupBy("mark").agg(F.sum("n").alias(f"n{label}"))

    often = counted(1).where(F.col("n1") >= least_rows)
    both = often.join(counted(0), "mark", "left").select("mark", F.col("n1").alias("k"), (F.col("n1") + F.coalesce("n0", F.lit(0))).alias("n"))
    both, seen = stage_observed(both, "toxic-marks", tried=F.count(F.lit(1)))
    rate, bound = toxic / (toxic + clean), math.log(0.01 / max(1, seen["tried"]))
    lexicon = {}
    # Beginnings that mostly toxic rows hold, of at most max_rows rows.
    for mark, k, n in both.where(F.col("k") >= purity * F.col("n")).collect():
        if chance(k, n, rate) < bound:
            lexicon[mark] = math.log((k + 0.5) / (n - k + 0.5)) - math.log(rate / (1 - rate))
    # A beginning that adds no row to what a shorter one marks is left out.
    for mark in sorted(lexicon, key=len, reverse=True):
        stem = mark.rstrip("$")
        if any(stem[:n] in lexicon and lexicon[stem[:n]] >= lexicon[mark] - 0.7 for n in PREFIXES if n < len(mark)):
            del lexicon[mark]

    points = rows.select("text", "toxic").mapInArrow(_featured(lexicon), ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").toPandas()
    return _fit(lexicon, points[list(FEATURES)].to_numpy(), points["toxic"].to_numpy())


def _featured(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in slices(batches):
            values = np.array([features(t, lexicon, known) for t in texts(batch)], dtype=float)
            yield pa.RecordBatch.from_arrays([*(pa.array(values[:, i]) for i in range(len(FEATURES))), batch.column("toxic")], [*FEATURES, "toxic"])

    return run


def _fit(lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> Model:
    """Ridge logistic regression by Newton's method; no feature may lower the score."""
    used = [i for i in range(x.shape[1]) if x[:, i].any()]
    while True:
        design = np.column_stack([x[:, used], np.ones(len(x))])
        ridge = np.diag([penalty] * len(used) + [1e-6])
        beta = np.zeros(len(used) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            gradient = design.T @ (y - p) - ridge @ beta
            hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
            step = np.linalg.solve(hessian, gradient)
            beta = beta + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        negative = [i for i, b in zip(used, beta, strict=False) if b < 0]
        if not negative:
            break
        used = [i for i in used if i not in negative]
    coefficients = [0.0] * x.shape[1]
    for i, b in zip(used, beta, strict=False):
        coefficients[i] = float(b)
    return Model(lexicon, tuple(coefficients), float(beta[-1]))


def score(documents: DataFrame, model: Model, keep: list[str] | None = None, column: str = "toxicity") -> DataFrame:
    """Add ``column`` (0 to 1) to every row; whole texts, null counts as empty.

    ``keep`` names the columns to return (all by default); one that is already
    named ``column`` is replaced.  An empty table gives an empty table, an empty text the score of a text without
    a match.  Rows are scored one by one, so repeated rows score alike.
    """
    kept = documents.drop(column)
    columns = [c for c in (keep or kept.columns) if c != column]
    schema = kept.select(*map(named, columns), F.lit(0.0).alias(column)).schema
    kept = kept.select(*map(named, dict.fromkeys([*columns, "text"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in slices(batches):
            values = np.array([features(t, model.lexicon, known) for t in texts(batch)], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(probability(model, values))], [*columns, column])

    return map_arrow(kept, run, schema)
