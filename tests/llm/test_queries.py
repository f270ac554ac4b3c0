"""The registered queries on whole tables: against DuckDB, and against plain brute force in Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lossgrid.llm import html, queries, substring
from tests.conftest import SF_SMALL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(name: str) -> list[dict]:
    return duckdb.sql(f"SELECT * FROM '{SF_SMALL}/{name}.parquet'").to_arrow_table().to_pylist()


@pytest.fixture(scope="module")
def docs():
    return rows_of("documents")


def run(spark, name):
    return queries.QUERIES[name](spark, SF_SMALL)


def expected_targets(rows: list[dict]) -> tuple[Counter, dict]:
    """Words and target of each source, by filling up one source after another."""
    own = Counter()
    for r in rows:
        own[r["source"]] += len(WORDS.findall(r["text"] or ""))
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(own.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * own[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * own[s] for s in full}
        left -= sum(3.0 * own[s] for s in full)
        free -= full
    return own, target


def shingles(text: str | None) -> frozenset:
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_groups(rows: list[dict], percent: int) -> dict[int, int]:
    """doc_id to the smallest doc_id of its group, from all pairs."""
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    root = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and root[i] != root[j] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {n: low if m == high else m for n, m in root.items()}
    return root


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    found = run(spark, name)
    want = con.execute(queries.ORACLE_SQL[name])
    assert [c[0] for c in want.description] == found.columns
    assert Counter(map(tuple, found.collect())) == Counter(want.fetchall())


def check_packed(pieces: list, rows: list[dict]) -> None:
    """Every id of every row lies in one piece, and sequences are gapless and full."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    known: dict = {}

    def ids(text: str) -> np.ndarray:
        if text not in known:
            known[text] = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        return known[text]

    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids(texts[p.doc_id])
        assert p.doc_tokens == len(own) and zlib.crc32(own[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        by_row[p.doc_row].append(p)
        by_sequence[p.sequence_id].append(p)
    for parts in by_row.values():
        parts.sort(key=lambda p: p.start)
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        assert sum(p.length for p in parts) == parts[0].doc_tokens
    assert Counter(parts[0].doc_id for parts in by_row.values()) == Counter(r["doc_id"] for r in rows)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        total = sum(p.length for p in parts)
        assert [p.offset for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        assert total == 2048 or total & (total - 1) == 0


def test_packing(spark, docs):
    check_packed(run(spark, "op1_packing").collect(), docs)


def test_quality_counts(spark, docs):
    found = {r.doc_id: r for r in run(spark, "op2_quality").collect()}
    assert len(found) == len(docs)
    for d in docs:
        text = d["text"] or ""
        words, lines, seen = WORDS.findall(text), text.split("\n"), set()
        places = defaultdict(list)
        for i in range(len(words) - 4):
            places[tuple(words[i : i + 5])].append(i)
        repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
        dup = 0
        for line in lines:
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
        r = found[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_substring(spark, docs):
    """Rows by id, runs remembered as texts: what was seen before goes."""
    found = {r.doc_id: r for r in run(spark, "op3_substring").collect()}
    seen: dict = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        cut = substring.sentences(d["text"] or "")
        gone, firsts = set(), set()
        spans = set()
        for i in range(len(cut)):
            sizes = [len(s[2]) for s in cut]
            end = next((e for e in range(i + 1, len(cut) + 1) if sum(sizes[i:e]) >= substring.WORDS), None)
            first = next((a for a in range(i, -1, -1) if sum(sizes[a : i + 1]) >= substring.WORDS), None)
            spans |= ({(i, end)} if end else set()) | ({(first, i + 1)} if first is not None else set())
        for i, end in sorted(spans):
            key = " ".join(w for s in cut[i:end] for w in s[2])
            if key in seen:
                gone |= set(range(i, end))
                firsts.add(seen[key])
            else:
                seen[key] = d["doc_id"]
        r = found[d["doc_id"]]
        assert (r.n_sentences, r.n_removed, r.first_doc_ids) == (len(cut), len(gone), sorted(firsts))
        if gone:
            assert r.text == "".join((d["text"])[s[0] : s[1]] for i, s in enumerate(cut) if i not in gone).rstrip()
        else:
            assert r.text == (d["text"] or "")


def check_mixed(taken: dict, rows: list[dict]) -> None:
    """``taken``: words by source that the mix takes."""
    own, target = expected_targets(rows)
    largest = defaultdict(int)
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], len(WORDS.findall(r["text"] or "")))
    for source, want in target.items():
        assert abs(taken.get(source, 0) - want) <= max(0.02 * want, largest[source]), source


def test_mixing(spark, docs):
    found = run(spark, "op4_mixing").collect()
    own, target = expected_targets(docs)
    source = {d["doc_id"]: d["source"] for d in docs}
    taken = Counter()
    for r in found:
        assert r.source_size == own[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert len(found) == len(docs)
    check_mixed(taken, docs)


def test_language_and_toxicity_on_held_out_rows(spark, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    found = [r for r in run(spark, "op7_langid").collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert found and sum(r.lang_pred == lang[r.doc_id] for r in found) >= 0.95 * len(found)
    toxic = {x["doc_id"]: x["toxic"] for x in rows_of("labels")}
    scored = run(spark, "op9_toxicity").collect()
    assert len(scored) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)
    assert not [r for r in scored if r.held_out and r.predicted and toxic.get(r.doc_id) == 0]


def test_html_covers_every_page(spark):
    pages = rows_of("pages")
    found = {r.page_id: r for r in run(spark, "op10_html").collect()}
    assert len(found) == len(pages)
    for p in pages:
        r, blocks = found[p["page_id"]], html.blocks(p["html"] or "")
        article = [t for kind, t in blocks if kind == html.CONTENT]
        assert r.url == p["url"] and r.n_chars == len(r.text)
        if article:
            assert r.text == "\n".join(article)
        else:
            assert set(r.text.split("\n")) <= {t for _, t in blocks} | {""}


def test_shared_runs_by_brute_force():
    rng = np.random.default_rng(11)
    for run_length in (1, 2, 3, 4, 7):
        words, page = [], []
        for p in range(12):
            own = rng.integers(0, 4, rng.integers(0, 25)).tolist()
            words += own + [-1 - p]
            page += [p] * (len(own) + 1)
        places = defaultdict(set)
        for i in range(len(words) - run_length + 1):
            places[tuple(words[i : i + run_length])].add(page[i])
        got = html.shared_starts(np.array(words), np.array(page), run_length)
        want = [i + run_length <= len(words) and len(places[tuple(words[i : i + run_length])]) > 1 for i in range(len(words))]
        assert got.tolist() == want


def test_pipeline_by_brute_force(spark, docs, monkeypatch):
    """Every stage of run() against plain Python on what the stage before kept."""
    kept, write = [], corpus_pipeline.stage

    def recorded(df, name):
        kept.append(write(df, name))
        return kept[-1]

    monkeypatch.setattr(corpus_pipeline, "stage", recorded)
    pieces = corpus_pipeline.run(spark, SF_SMALL)
    pieces = pieces.selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    after = [[r.asDict() for r in df.collect()] for df in kept]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and len(after) == 4

    bad = {r.doc_id for r in run(spark, "op9_toxicity").collect() if r.predicted}
    assert Counter(r["doc_id"] for r in after[0]) == Counter(d["doc_id"] for d in docs if d["doc_id"] not in bad)

    best: dict = {}
    for r in after[0]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after[1]) == sorted(i for _, i in best.values())

    root = near_groups(after[1], corpus_pipeline.NEAR)
    assert sorted(r["doc_id"] for r in after[2]) == sorted(i for i, low in root.items() if i == low)

    before = {r["doc_id"]: r for r in after[2]}
    assert all(r == before[r["doc_id"]] for r in after[3])
    assert max(Counter(r["doc_id"] for r in after[3]).values()) <= 3
    taken = Counter()
    for r in after[3]:
        taken[r["source"]] += len(WORDS.findall(r["text"] or ""))
    check_mixed(taken, after[2])

    check_packed(pieces, after[3])
