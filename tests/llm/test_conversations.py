"""Conversation repair against exhaustive search, a plain string DP, DuckDB and edge rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lossgrid.llm import conversations as cv
from lossgrid.llm import queries
from tests.conftest import SF_SMALL

SOUND = re.compile(r"(s?(ua)+)?")


def cheapest(turns: list[cv.Turn]) -> tuple[int, str]:
    """Best first search over edit rows, which checks the finished initials by the pattern alone."""
    most = 3 * len(turns) + 8
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, initials = heapq.heappop(heap)
        if at == len(turns) and SOUND.fullmatch(initials):
            return cost, edits
        if (at, initials) in done or len(initials) > most:
            continue
        done.add((at, initials))
        prefix = initials.lstrip("s") if initials.startswith("s") else initials
        if re.search("s|uu|aa|^a", prefix) or initials.startswith("ss"):
            continue  # nothing makes it sound any more
        for role in "ua":
            heapq.heappush(heap, (cost + 3, edits + "I", at, initials + role))
        if at < len(turns):
            turn = turns[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, initials))
            if not turn.forced:
                stays = cost + 3 * turn.truncated
                heapq.heappush(heap, (stays, edits + "K", at + 1, initials + (turn.initial or "?")))
                for role in "ua":
                    heapq.heappush(heap, (stays + 3, edits + "R", at + 1, initials + role))
    raise AssertionError


def random_turns(rng: random.Random, n: int) -> list[cv.Turn]:
    return [cv.Turn(rng.choice(["u", "a", "u", "a", "s", "x", ""]), rng.random() < 0.15, rng.random() < 0.25) for _ in range(n)]


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 3, 1])  # hashes that collide often, or always
def test_best_edits_against_exhaustive_search(modulus):
    rng = random.Random(7)
    for _ in range(250):
        turns = random_turns(rng, rng.randrange(7))
        assert cv.best_edits(turns, cv.Edits(modulus=modulus)) == cheapest(turns)


def test_edit_rows_compare_like_strings():
    rng, edits, texts = random.Random(1), cv.Edits(), {0: ""}
    for _ in range(600):
        node, letter = rng.choice([*texts][-60:]), rng.choice("DIKR")
        texts[edits.add(node, letter)] = texts[node] + letter
    some = rng.sample([*texts], 120)
    for x in some:
        assert edits.text(x) == texts[x]
        for y in some:
            assert edits.less(x, y) == (texts[x] < texts[y])
        for depth in range(edits.depth[x] + 1):
            assert edits.text(edits.back(x, depth)) == texts[x][:depth]


def plain(rows: list[tuple]) -> tuple:
    """The result of one conversation's rows (turn, role, text), a None being one space."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns, counts = set(), [], Counter()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        counts[kind] += 1
        turns.append(cv.Turn(role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        seen.add((role, text))
    counts["illegal"] = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    # Plain DP: every state holds its whole string.
    def insert(best):
        for state in (0, 1, 3):
            if state in best:
                c, a, m = best[state]
                best[2] = min(best.get(2, (1e9,)), (c + 3, a + "I", [*m, "user:"]))
        if 2 in best:
            c, a, m = best[2]
            best[3] = min(best.get(3, (1e9,)), (c + 3, a + "I", [*m, "assistant:"]))
        return best

    best = insert({0: (0, "", [])})
    for turn, (_, role, text) in zip(turns, rows, strict=True):
        found: dict = defaultdict(lambda: (1e9,))
        for state, (c, a, m) in best.items():
            found[state] = min(found[state], (c + 4, a + "D", m))
            if not turn.forced:
                c += 3 * turn.truncated
                follow, name = (3, "assistant") if state == 2 else (2, "user")
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, turn.initial))
                if kept:
                    found[kept] = min(found[kept], (c, a + "K", [*m, f"{role}:{text}"]))
                found[follow] = min(found[follow], (c + 3, a + "R", [*m, f"{name}:{text}"]))
        best = insert({k: v for k, v in found.items() if v != (1e9,)})
    cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    texts = ["Hello.", "Is it so?", "No end", " ", "", None, "Done! \n", "日本語。", "x."]
    for conv_id in [*range(40), None]:
        for turn in range(rng.randrange(12)):
            rows.append((conv_id, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts)))
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t % 50}" + "." * (t % 3 > 0)) for t in range(300)]
    rows += [(98, 1, "user", "the same again.")] * 60
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, part string"


def test_repair_of_short_and_long_conversations(spark):
    rows = conversations(4)
    frame = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA).repartition(6)
    want = {i: plain([r[1:] for r in rows if r[0] == i]) for i in {r[0] for r in rows}}
    for settings in ({}, {"long_rows": 25}, {"long_rows": 3}, {"long_bytes": 20}):
        found = cv.repair(frame, **settings).collect()
        assert len(found) == len(want)
        for r in found:
            assert tuple(r)[1:] == want[r.conv_id], (settings, r.conv_id)


def test_repaired_messages(spark):
    rows = conversations(5)
    frame = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA)
    want = {r.conv_id: r.repaired_sha256 for r in cv.repair(frame).collect()}
    for settings in ({}, {"long_rows": 5}):
        lines = defaultdict(list)
        for r in sorted(cv.repaired_messages(frame, **settings).collect(), key=lambda r: (r.part, r.place, r["at"])):
            lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert {i: hashlib.sha256("\n".join(lines[i]).encode()).hexdigest() for i in want} == want
    nothing = spark.createDataFrame([], SCHEMA)
    assert cv.repair(nothing).count() == cv.repaired_messages(nothing).count() == 0


def test_one_very_long_text_and_text_ids(spark):
    frame = spark.createDataFrame([("a", 1, "user", "word " * 200_000), ("a", 2, "assistant", "Yes."), ("b", 1, "assistant", "No.")], "conv_id string, turn int, role string, text string")
    want = [("a", *plain([(1, "user", "word " * 200_000), (2, "assistant", "Yes.")])), ("b", *plain([(1, "assistant", "No.")]))]
    assert sorted(map(tuple, cv.repair(frame).collect())) == want
    assert sorted(map(tuple, cv.repair(frame, long_bytes=1000).collect())) == want


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv_id, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv_id, turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def test_query_on_its_whole_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF_SMALL}/conversations.parquet'").fetchall()
    hurt = damage(rows)
    found = queries.QUERIES["op11_conversations"](spark, SF_SMALL)
    assert len({r[0] for r in rows}) == found.count()
    for r in found.collect():
        assert tuple(r)[1:] == plain([x[1:] for x in hurt if x[0] == r.conv_id])


def test_query_and_sql_on_edge_rows(spark, tmp_path):
    rows = conversations(6)
    frame = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op11_conversations"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_conversations"])
    assert want.columns == found.columns
    assert Counter(map(tuple, found.collect())) == Counter(want.fetchall())
    hurt = damage([r[:4] for r in rows])
    for r in found.collect():
        assert tuple(r)[1:] == plain([x[1:] for x in hurt if x[0] == r.conv_id])


def test_sql_on_the_whole_table(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_conversations"]).fetchall()
    found = queries.QUERIES["op11_conversations"](spark, SF_SMALL).collect()
    assert Counter(map(tuple, found)) == Counter(want)
