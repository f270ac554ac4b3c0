"""Conversation structure repair by a persistent audit DP (operator 11).

A conversation is sound when its role initials read ``(s?(ua)+)?``: nothing,
or an optional system turn and then user and assistant in turn.  Rows are kept
(cost 0), given the role user or assistant (3), or deleted (4), and empty
user or assistant turns may be inserted (3).  Blank rows and repeats of an
earlier row must be deleted; a row that breaks off and stays costs 3 more.  The
repair is the cheapest row of edits, written as their initials K, R, D and I;
among equally cheap ones the least in ASCII order.

The search runs over the rows with four states (nothing yet, after system,
after user, after assistant) and keeps the best edits that reach each.  Edits
are nodes that point to the edits before them (:class:`Edits`), so that all
states and rows share their prefixes.  A node knows its ancestors 1, 2, 4, ...
steps back and the rolling hash of its whole prefix; two equally cheap edit
rows are compared by searching their longest common prefix over those hashes,
which is then verified node by node.

Conversations are dealt by id.  Those of more than ``long_rows`` rows or
``long_bytes`` bytes are dealt by ranges of their order instead, cut into
segments, solved for each state they may begin in and joined by the same rule,
so that no task holds a whole long conversation.  Only the hash of its
repaired text, sequential by nature, is taken by one task, which streams it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import slices, stage

LONG_ROWS = 4096
LONG_BYTES = 16_000_000
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or changed row becomes after each state.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: State and role initial to the next state.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: States before the first row, with the inserts that lead there: state, cost, edits.
BEGIN = ((START, 0, ""), (USER, INSERT_COST, "I"), (ASSISTANT, 2 * INSERT_COST, "II"))


class Edits:
    """Edit rows as nodes that share their prefixes; node 0 is the empty row."""

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 0x2545F4914F6CDD1D):
        self.modulus, self.base = modulus, base
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        """The node of ``node``'s edits and one more."""
        new, up = len(self.letter), [node]
        # Ancestor 2^i is ancestor 2^(i-1) of ancestor 2^(i-1).
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.modulus)
        self.up.append(up)
        return new

    def back(self, node: int, depth: int) -> int:
        """The ancestor at ``depth``."""
        away = self.depth[node] - depth
        while away:
            step = away.bit_length() - 1
            node = self.up[node][step]
            away -= 1 << step
        return node

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth spell the same, compared letter by letter down to the node they share."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def less(self, x: int, y: int) -> bool:
        """Whether x spells less than y in ASCII order."""
        shared = min(self.depth[x], self.depth[y])
        a, b = self.back(x, shared), self.back(y, shared)
        if a == b or (self.hash[a] == self.hash[b] and self.same(a, b)):
            return self.depth[x] < self.depth[y]
        if self.hash[a] == self.hash[b]:
            return self.text(x) < self.text(y)  # a collision at the very end
        for step in range(len(self.up[a]) - 1, -1, -1):
            if step < len(self.up[a]):
                p, q = self.up[a][step], self.up[b][step]
                if p != q and self.hash[p] != self.hash[q]:
                    a, b = p, q
        if not self.same(self.up[a][0], self.up[b][0]):
            return self.text(x) < self.text(y)  # a collision on the way
        return self.letter[a] < self.letter[b]


@dataclass
class Turn:
    """A row with its first fault."""

    initial: str
    forced: bool  # blank or repeated: must go
    truncated: bool


def _better(edits: Edits, best: list, state: int, cost: int, node: int, letter: str) -> None:
    """Offer edits to a state; a tie is settled between the two whole edit rows."""
    had = best[state]
    if had is None or cost < had[0]:
        best[state] = (cost, node, letter)
    elif cost == had[0]:
        old = edits.add(had[1], had[2]) if had[2] else had[1]
        new = edits.add(node, letter)
        best[state] = (cost, new if edits.less(new, old) else old, "")


def _settled(edits: Edits, best: list) -> list:
    return [x and (x[0], edits.add(x[1], x[2]) if x[2] else x[1], "") for x in best]


def _inserted(edits: Edits, best: list) -> list:
    """With the turns that may be inserted here: user after all but user, then assistant."""
    best = _settled(edits, best)
    for state in (START, SYSTEM, ASSISTANT):
        if best[state]:
            _better(edits, best, USER, best[state][0] + INSERT_COST, best[state][1], "I")
    best = _settled(edits, best)
    if best[USER]:
        _better(edits, best, ASSISTANT, best[USER][0] + INSERT_COST, best[USER][1], "I")
    return _settled(edits, best)


def solve(turns: Iterable[Turn], edits: Edits, begin: int = START, opening: bool = True) -> list[tuple | None]:
    """For each state (cost, node, "") of the best edits of ``turns`` that lead there from state ``begin``.

    ``opening``: turns may be inserted before the first row, too.
    """
    best: list = [None] * 4
    best[begin] = (0, 0, "")
    if opening:
        best = _inserted(edits, best)
    for turn in turns:
        found: list = [None] * 4
        for state, had in enumerate(best):
            if had is None:
                continue
            cost, node, _ = had
            _better(edits, found, state, cost + DELETE_COST, node, "D")
            if turn.forced:
                continue
            stays = cost + TRUNCATED_COST * turn.truncated
            kept = KEPT.get((state, turn.initial))
            if kept is not None:
                _better(edits, found, kept, stays + KEEP_COST, node, "K")
            _better(edits, found, TURN[state], stays + REROLE_COST, node, "R")
        best = _inserted(edits, found)
    return best


def best_edits(turns: Iterable[Turn], edits: Edits | None = None) -> tuple[int, str]:
    """Cost and edits of the cheapest repair of a whole conversation."""
    edits = edits or Edits()
    best = solve(turns, edits)
    (cost, node, _), other = best[START], best[ASSISTANT]
    if other and (other[0] < cost or (other[0] == cost and edits.less(other[1], node))):
        cost, node, _ = other
    return cost, edits.text(node)


def repaired(rows: Iterable[tuple[str, str]], letters: str, state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the turns that ``letters`` make of ``rows`` (role, text), from ``state``."""
    out, rows = [], iter(rows)
    for letter in letters:
        if letter == "I":
            state = TURN[state]
            out.append((ROLE[state], ""))
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            state = TURN[state]
            role = ROLE[state]
        else:
            state = KEPT[state, role[:1]]
        out.append((role, text))
    return out


def joined(messages: Iterable[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in messages)


@dataclass
class Faults:
    """What a run of rows in order holds: faults, its turns' range and the initials at its ends."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    numbers: int = 0  # distinct turn numbers

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> Turn:
        """Count one more row; its first fault decides."""
        initial, body = role[:1], text.rstrip(SPACE)
        truncated = False
        if not body:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif body[-1] not in ENDS:
            truncated = True
            self.truncated += 1
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.numbers = turn, self.numbers + 1
        return Turn(initial, not body or repeated, truncated)

    def join(self, after: Faults) -> None:
        """The run followed by the next one of the same conversation."""
        self.illegal += after.illegal + (self.last is not None and self.last + after.first not in LEGAL)
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(after, name))
        self.numbers += after.numbers - (after.low is not None and after.low == self.high)
        self.first = after.first if self.last is None else self.first
        self.low = after.low if self.low is None else self.low
        self.last, self.high = after.last, after.high if after.high is not None else self.high

    def row(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


_FAULTS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, numbers long"
_FAULT_NAMES = [x.split()[0] for x in _FAULTS.split(", ")]
_MESSAGES = "array<struct<role:string,text:string>>"
_MESSAGE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
#: Columns of :func:`repair` after the conversation's id.
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
ORDER = ("turn", "role", "text")


def _arrays(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    for batch in slices(batches, size):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _whole(id_type: pa.DataType, messages: bool):
    """Rows in order to one row for each conversation."""
    types = [id_type, *_RESULT_TYPES] + [_MESSAGE] * messages
    names = ["conv_id", *(x.split()[0] for x in RESULT.split(", "))] + ["messages"] * messages

    def solved(conv_id, rows) -> tuple:
        faults, seen, turns, texts = Faults(), set(), [], []
        for _, turn, role, text in rows:
            turns.append(faults.add(turn, role, text, (role, text) in seen))
            seen.add((role, text))
            texts.append((role, text))
        cost, letters = best_edits(turns)
        left = repaired(texts, letters)
        sha = hashlib.sha256(joined(left).encode("utf-8", "surrogatepass")).hexdigest()
        return conv_id, *faults.row(), cost, letters, sha, *([[{"role": r, "text": t} for r, t in left]] * messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, rows in groupby(_rows(batches), itemgetter(0)):
            out.append(solved(conv_id, rows))
            if len(out) >= 256 or messages:
                yield _arrays(out, types, names)
                out = []
        yield _arrays(out, types, names)

    return run


# --- long conversations -------------------------------------------------------


def _segments(id_type: pa.DataType, most_rows: int, most_bytes: int):
    """Rows in order (with copies and whether they are new) to segments solved for every state they may begin in."""
    types = [id_type, pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
    types += [_MESSAGE, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("letters", pa.string())]))]
    names = ["conv_id", "part", "place", *_FAULT_NAMES, "messages", "ways"]

    def spread(rows):
        for conv_id, turn, role, text, copies, new in rows:
            for copy in range(copies):
                yield conv_id, turn, role, text, not new or copy > 0

    def cut(rows):
        """Lists of rows of one conversation, at most so many rows or bytes."""
        for _, own in groupby(spread(rows), itemgetter(0)):
            held, size = [], 0
            for row in own:
                if held and (len(held) >= most_rows or size > most_bytes):
                    yield held
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, rows in enumerate(cut(_rows(batches))):
            faults = Faults()
            turns = [faults.add(*row[1:]) for row in rows]
            kept = [{"role": "", "text": ""} if t.forced else {"role": r[2], "text": r[3]} for t, r in zip(turns, rows, strict=True)]
            ways = []
            for begin in range(4):
                edits = Edits()
                for end, found in enumerate(solve(turns, edits, begin, opening=False)):
                    if found:
                        ways.append({"begin": begin, "end": end, "cost": found[0], "letters": edits.text(found[1])})
            yield _arrays([(rows[0][0], part, place, *(getattr(faults, n) for n in _FAULT_NAMES), kept, ways)], types, names)

    return run


class _Way:
    """A segment's way, linked to the ways before it, which ways to other states share."""

    __slots__ = ("before", "begin", "letters", "cost", "depth")

    def __init__(self, before, begin: int, letters: str, cost: int):
        self.before, self.begin, self.letters, self.cost = before, begin, letters, cost

    def less(self, other: _Way) -> bool:
        """Cheaper, or as cheap and less in ASCII order: only what follows the ways both share is compared."""
        if self.cost != other.cost:
            return self.cost < other.cost
        mine, its, x, y = [], [], self, other
        while x is not y:
            mine.append(x.letters)
            its.append(y.letters)
            x, y = x.before, y.before
        return "".join(reversed(mine)) < "".join(reversed(its))

    def chain(self) -> list[_Way]:
        out, way = [], self
        while way:
            out.append(way)
            way = way.before
        return out[::-1]


def _joined(id_type: pa.DataType):
    """Segments in order to the conversation's result (part null) and the way through each segment."""
    types = [id_type, pa.int64(), pa.int64(), *[pa.int64()] * 6, pa.string(), pa.int64()]
    names = ["conv_id", "part", "place", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "letters", "begin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, segments in groupby(_rows(batches, 1), itemgetter(0)):
            total, places = Faults(), []
            live = {state: _Way(None, START, letters, cost) for state, cost, letters in BEGIN}
            for _, part, place, *counts, ways in segments:
                total.join(Faults(*counts))
                places.append((part, place))
                found: dict[int, _Way] = {}
                for way in ways:
                    if before := live.get(way["begin"]):
                        new = _Way(before, way["begin"], way["letters"], before.cost + way["cost"])
                        if way["end"] not in found or new.less(found[way["end"]]):
                            found[way["end"]] = new
                live = found
            best = live.get(ASSISTANT)
            if START in live and (best is None or live[START].less(best)):
                best = live[START]
            first, *rest = best.chain()
            letters = [way.letters for way in rest]
            begins = [START, *(way.begin for way in rest[1:])]
            letters[0] = first.letters + letters[0]
            out = [(conv_id, part, place, *[None] * 6, piece, begin) for (part, place), piece, begin in zip(places, letters, begins, strict=True)]
            for at in range(0, len(out), 64):
                yield _arrays(out[at : at + 64], types, names)
            yield _arrays([(conv_id, None, None, *total.row(), best.cost, "".join(letters), None)], types, names)

    return run


def _bodies(id_type: pa.DataType):
    """Segments with the way through them to their repaired messages and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, part, place, messages, letters, begin in _rows(batches, 1):
            left = repaired(((m["role"], m["text"]) for m in messages), letters, begin)
            row = (conv_id, part, place, joined(left), [{"role": r, "text": t} for r, t in left])
            yield _arrays([row], [id_type, pa.int64(), pa.int64(), pa.string(), _MESSAGE], ["conv_id", "part", "place", "body", "messages"])

    return run


def _hashed(id_type: pa.DataType):
    """Bodies in order to the hash of each conversation's text; one body is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, bodies in groupby(_rows(batches, 1), itemgetter(0)):
            sha, begun = hashlib.sha256(), False
            for _, body in bodies:
                if body:
                    sha.update((("\n" if begun else "") + body).encode("utf-8", "surrogatepass"))
                    begun = True
            yield _arrays([(conv_id, sha.hexdigest())], [id_type, pa.string()], ["conv_id", "repaired_sha256"])

    return run


def _same(x, y):
    return x.eqNullSafe(y)


def _long(rows: DataFrame, kind: str, id_type: pa.DataType, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(results, messages by segment) of long conversations."""
    # Equal rows of one turn become one row, so that a row repeated without end cannot fill a task.
    merged = rows.groupBy("conv_id", *ORDER).agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = merged.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = merged.join(firsts, _same(F.col("conv_id"), F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    marked = marked.select("conv_id", *ORDER, "copies", _same(when, F.col("first")).alias("new"))
    dealt = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    shape = f"conv_id {kind}, part long, place long, {_FAULTS}, messages {_MESSAGES}, ways array<struct<begin:long,end:long,cost:long,letters:string>>"
    segments = stage(dealt.mapInArrow(_segments(id_type, most_rows, most_bytes), shape), "segments")

    order = "conv_id", "part", "place"
    ways = segments.select(*order, *_FAULT_NAMES, "ways").repartition("conv_id").sortWithinPartitions(*order)
    shape = f"conv_id {kind}, part long, place long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, letters string, begin long"
    found = stage(ways.mapInArrow(_joined(id_type), shape), "ways")
    chosen = found.where("part is not null").select(F.col("part").alias("p"), F.col("place").alias("q"), "letters", "begin")
    bodies = segments.join(chosen, (F.col("part") == F.col("p")) & (F.col("place") == F.col("q"))).select(*order, "messages", "letters", "begin")
    bodies = stage(bodies.mapInArrow(_bodies(id_type), f"conv_id {kind}, part long, place long, body string, messages {_MESSAGES}"), "bodies")
    texts = bodies.select(*order, "body").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "body")
    shas = texts.mapInArrow(_hashed(id_type), f"c {kind}, repaired_sha256 string")
    results = found.where("part is null").join(shas, _same(F.col("conv_id"), F.col("c")))
    return results.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("letters").alias("audit"), "repaired_sha256"), bodies.select(*order, "messages")


def _plan(rows: DataFrame, long_rows: int, long_bytes: int, messages: bool) -> tuple[DataFrame, DataFrame | None]:
    """(short conversations' results, those of long ones or None); with their messages if asked."""
    blank = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if id_type == pa.int64():
        rows, kind = rows.withColumn("conv_id", F.col("conv_id").cast("long")), "bigint"
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    ids = stage(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("its")), "long-ids")
    long, short = None, rows
    if not ids.isEmpty():
        short = rows.join(ids, _same(F.col("conv_id"), F.col("its")), "left_anti")
        own = rows.join(ids, _same(F.col("conv_id"), F.col("its")), "left_semi")
        long = _long(own, kind, id_type, long_rows, long_bytes)[int(messages)]
    dealt = short.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    shape = f"conv_id {kind}, {RESULT}" + f", messages {_MESSAGES}" * messages
    return dealt.mapInArrow(_whole(id_type, messages), shape), long


def repair(rows: DataFrame, *, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text; other columns are ignored).

    conv_id; gaps in the turn numbers (last - first + 1 - distinct, nulls
    ignored, 0 if all are null); rows by their first fault, blank, duplicate
    (role and text seen earlier) and truncated; illegal neighbours (initials
    other than su, ua, au); cost and audit of the cheapest repair (ties: least
    in ASCII order); repaired_sha256 of its ``role:text`` lines.

    Rows count in the order of turn (nulls first), role, text, so repeated
    rows stand together.  A null role or text is one space, a null conv_id a
    conversation of its own.  A conversation of any length has one result; an
    empty table has none.
    """
    short, long = _plan(rows, long_rows, long_bytes, False)
    return short if long is None else short.union(long)


def repaired_messages(rows: DataFrame, *, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations themselves: conv_id, part, place, at (their order), role, text.

    Inserted turns have an empty text.  Nulls, ties and empty tables as in
    :func:`repair`; a conversation that nothing is left of has no rows.
    """
    short, long = _plan(rows, long_rows, long_bytes, True)
    nil = F.lit(0).cast("long")
    short = short.select("conv_id", nil.alias("part"), nil.alias("place"), "messages")
    both = short if long is None else short.union(long)
    each = both.select("conv_id", "part", "place", F.posexplode("messages").alias("at", "message"))
    return each.select("conv_id", "part", "place", "at", "message.role", "message.text")
