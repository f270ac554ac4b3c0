"""The operators against brute force, and on nulls, empty and repeated rows, ties and empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossgrid.llm import exact_dedup, html, langid, licenses, minhash, mixing, packing, quality, queries, substring, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i} and{i % 7}." if i % 9 == 8 else f"word{i}" for i in range(120))
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE.replace(" ", "\n"), "en", "a"),  # equal without white space
    (3, BASE + " tail", "en", None),  # near
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t", None, "c"),
    (7, "one two", "fr", "c"),
    (7, "one two", "fr", "c"),  # a repeated row
    (7, "three four five six", "fr", "c"),  # an id with another text
    (None, "no id here", "en", "b"),
    (8, LONG, "en", "a"),
    (9, "12 34 <|endoftext|> 56", "en", "d"),
    (10, "ONE two", "en", "d"),
    (11, "Ünïcode ﬁ ½ 日本語 \U0001f600 x" * 40, "de", "d"),
    (12, "Released under the MIT License", "en", "e"),
    (13, "Some words.\nLicensed under the Apache License, Version 2.0.", "en", "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string, toxicity int, size string, kept string, text_sha256 string, component_id string, copies double"


@pytest.fixture(scope="module")
def documents(spark):
    """All edge cases, with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, "s", "k", "t", "c", 2.0) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, None, 1), (99, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_exact_dedup(documents, nothing):
    found = exact_dedup.assign(documents, held_bytes=4000).collect()  # spills
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    assert len(found) == len(ROWS)
    assert {r.text_sha256 for r in found} == set(by_sha)
    for r in found:
        assert (r.keep_id, r.group_size) == (by_sha[r.text_sha256][0][2], len(by_sha[r.text_sha256]))
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(dict.fromkeys(by_sha, 1))
    stay = exact_dedup.keep_one(documents)
    assert stay.columns == documents.columns and stay.count() == len(by_sha)
    assert exact_dedup.assign(nothing).count() == exact_dedup.keep_one(nothing).count() == 0


def test_trie_spills_by_subtree():
    trie = exact_dedup.Trie()
    for key in (b"abcd", b"abxy", b"ab", b"q"):
        node, new = trie.insert(key, len(key))
        assert new
        node.terminal = [key]
    assert not trie.insert(b"abxy", 4)[1]
    held = trie.root.held
    assert [t[0] for t in trie.spill()] and trie.root.held < held


def shingles(text: str | None) -> frozenset:
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_near_duplicates(spark, documents, nothing):
    rng = np.random.default_rng(3)
    rows = [(100 + i, " ".join(f"x{j}" if rng.random() > 0.02 * (i % 6) else f"y{rng.integers(1e6)}" for j in range(80))) for i in range(60)]
    both = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = minhash.near_duplicates(both).collect()
    given = [(r[0], r[1]) for r in ROWS] + rows
    sets = [(i, shingles(t)) for i, t in given if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert len(found) == len(given)
    sizes = Counter((i, len(shingles(t))) for i, t in given)
    assert Counter((r.doc_id, r.n_shingles) for r in found) == sizes
    for r in found:
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id))
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert minhash.near_duplicates(nothing).count() == 0


def test_mixing(documents, nothing):
    sizes = mixing.document_sizes(documents)
    found = mixing.mix(sizes).collect()
    assert len(found) == len(ROWS)
    own = Counter()
    for _, text, _, source in ROWS:
        own[source] += len(WORDS.findall(text or ""))
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
    for r in found:
        assert r.source_size == own[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3 and (r["size"] > 0 or r.copies == 0)
    again = mixing.mix(sizes.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.copies)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix(mixing.document_sizes(nothing)).count() == 0


def test_packing_round_trip(documents, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = packing.pack(documents.repartition(3), queries.tokenizer_path(), windows=2)
    rows = pieces.collect()
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r.doc_row].append(r)
        by_sequence[r.sequence_id].append(r)
    got = []
    for parts in by_row.values():
        parts.sort(key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in parts)
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        assert len(ids) == 4 * parts[0].doc_tokens
        got.append((str(parts[0].doc_id), zlib.crc32(ids)))
    want = [(str(i), zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t, *_ in ROWS]
    assert sorted(got) == sorted(want)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        total = sum(r.length for r in parts)
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(nothing, queries.tokenizer_path()).count() == 0
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert {k: sum(p.length for p in v) for k, v in by_sequence.items()} == {k: r.n_tokens for k, r in whole.items()}


def test_quality(documents, nothing, labels):
    found = quality.assess(documents, labels).collect()
    assert len(found) == len(ROWS)
    for r in found:
        if r.doc_id == 8:
            assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (30_000, 0, 30_000)
        if r.doc_id == 4:
            assert (r.n_words, r.word_chars, r.n_symbols) == (0, 0, 0)
        if r.doc_id == 9:
            assert (r.n_words, r.word_chars, r.n_symbols) == (4, 19, 4)
    assert quality.assess(nothing, labels.limit(0)).count() == 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.6) & (rng.random(2000) > 0.1)).astype(float)
    forest = quality.boost(x, y, np.array([-1, 0, 1]))
    grid = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
    for f, sign in ((0, -1), (2, 1)):
        line = grid.copy()
        line[:, :, f] = np.linspace(0, 1, 40)
        margins = forest.margin(line.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(margins, axis=1) >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == (x[:, 0] < 0.6)).mean() > 0.97


def test_language(documents, nothing):
    model = langid.learn(documents)
    seen = {c for _, t, *_ in ROWS for w in langid.LETTERS.findall((t or "").lower()) for c in w} | {" "}
    total = sum(2.0 ** model.bits(np.array([[ord(" ")] * 3 + [ord(c)]], "<u4"))[0] for c in seen)
    assert (total <= 1.001).all()  # probabilities of the next character
    found = {r.doc_id: r for r in langid.predict(documents, model).collect()}
    assert found[1].lang_pred == "en" and found[11].lang_pred == "de"
    for i in (4, 5, 6):
        assert (found[i].lang_pred, found[i].rejected) == ("und", True)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.predict(nothing, langid.learn(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(documents, langid.learn(nothing)).collect()} == {"und"}


def test_toxicity(spark, documents, nothing, labels):
    model = toxicity.learn(documents, labels)
    scored = toxicity.score(documents, model)
    assert set(scored.columns) == set(documents.columns) and scored.count() == len(ROWS)
    assert toxicity.score(nothing, toxicity.learn(nothing, labels.limit(0))).count() == 0
    insults = ["zorgle", "blimfa", "quaddok"]
    rows = []
    for i in range(600):
        rng = np.random.default_rng(i)
        words = [f"w{rng.integers(4000)}" for _ in range(60)]
        if i % 5 == 0:
            for k in rng.choice(60, 3, replace=False):
                words[k] = insults[rng.integers(3)]
        rows.append((i, " ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table, table, usable=lambda c: c % 3 != 1)
    out = toxicity.score(table, model, keep=["doc_id", "toxic"]).where(F.col("doc_id") % 3 == 1)
    assert out.where((F.col("toxicity") >= 0.7) != (F.col("toxic") == 1)).count() == 0


def test_grammar_weighs_clauses():
    lexicon = {"idiot$": 2.0}

    def total(text):
        return toxicity.features(text, lexicon, {})[0]

    assert total("you idiot") > total("idiot") > total("he said idiot") > total("not idiot") > total("") == 0
    assert total("they will kill you") > 0 == total("we kill weeds")
    assert total("kill you") == total("you kill") > total("never kill you") > 0
    assert total("not idiot") < total("not one two three four five six idiot") == total("idiot")  # beyond reach
    assert total("not not idiot") == total("idiot") and total("said not idiot") < total("not idiot")


def test_composed_machine_equals_the_cascade():
    """Random symbols through the transducers one after another, and through the one machine."""
    cascade = (toxicity.target_transducer(), toxicity.threat_transducer(), toxicity.scope_transducer(toxicity.NEGATION, 0.1, 0.5, True), toxicity.scope_transducer(toxicity.REPORT, 0.2, 0.6, False), toxicity.insult_transducer())
    symbols = np.random.default_rng(5).integers(0, 6, 5000).tolist()
    passed = [(s, 1.0) for s in symbols]
    for transducer in cascade:
        state, out = 0, []
        for symbol, factor in passed:
            state, symbol, scale = transducer[state].get(symbol, (state, symbol, 1.0))
            out.append((symbol, factor * scale))
        passed = out
    state, written = 0, []
    for symbol in symbols:
        state, factor = toxicity.GRAMMAR[state][symbol]
        written.append(factor)
    assert written == [f if s == toxicity.HARM else 0.0 for s, f in passed]


def test_language_of_one_short_text_is_learned(spark):
    rows = [(i, "common words of one language come again and again", "aa") for i in range(20)] + [(30, "zq", "xx")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(documents, langid.learn(documents)).collect()}[30] == "xx"


def test_substring(spark, documents, nothing):
    passage = "A passage of several words that repeats here. It has a second sentence with more words. And a third one to end it."
    rows = [(1, f"First text stands alone. {passage} Its end differs."), (2, f"Another start of a text. {passage} Other end."), (3, "Nothing shared at all in this one. Really nothing that is shared here."), (4, passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in substring.remove_repeats(table).collect()}
    assert found[1].text == rows[0][1] and found[3].text == rows[2][1]
    assert (found[2].text, found[2].n_removed, found[2].first_doc_ids) == ("Another start of a text. Other end.", 3, [1])
    assert found[4].text == ""
    edge = substring.remove_repeats(documents).collect()
    assert len(edge) == len(ROWS) and substring.remove_repeats(nothing).count() == 0


def test_substring_finds_single_sentences_unpunctuated_passages_and_other_marks(spark):
    long = "Here one sentence of more than twelve words stands alone and comes back between quite other neighbours later."
    stretch = " ".join(f"plain{i * i % 311}" for i in range(120))
    han = "\u6570\u636e\u5904\u7406\u662f\u4e00\u9879\u91cd\u8981\u7684\u5de5\u4f5c\u5185\u5bb9\u3002"
    rows = [(1, f"One start. {long} One end."), (2, f"Two begins. {long} Two ends."), (3, long), (4, long)]
    rows += [(5, " ".join(f"a{i}" for i in range(60)) + f" {stretch} " + " ".join(f"b{i}" for i in range(60))), (6, " ".join(f"c{i}" for i in range(70)) + f" {stretch} " + " ".join(f"d{i}" for i in range(70)))]
    rows += [(7, f"\u7532\u4e59\u4e19\u3002{han}\u4e01\u3002"), (8, f"\u5b50\u4e11\u3002{han}\u5bc5\u3002")]
    found = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].text == rows[0][1]
    assert (found[2].text, found[2].first_doc_ids) == ("Two begins. Two ends.", [1])
    assert found[3].text == found[4].text == ""
    assert found[5].text == rows[4][1]
    left = found[6].text.split()
    assert set(left) >= {f"c{i}" for i in range(60)} | {f"d{i}" for i in range(10, 70)}
    assert sum(w.startswith("plain") for w in left) < 60  # but for the pieces at both ends
    assert found[8].text == "\u5b50\u4e11\u3002\u5bc5\u3002"


def test_substring_runs_cover_every_repeated_passage():
    rng = np.random.default_rng(5)
    for _ in range(300):
        found = [(0, 0, [f"w{j}"] * n) for j, n in enumerate(rng.integers(1, 16, rng.integers(1, 9)).tolist())]
        spans = [(a, a + n) for a, n, _ in substring.runs(found, 12)]
        for a in range(len(found)):
            for b in range(a + 1, len(found) + 1):
                if sum(len(s[2]) for s in found[a:b]) >= 12:
                    assert {i for x, y in spans if a <= x and y <= b for i in range(x, y)} == set(range(a, b))


def test_licenses(spark, documents, nothing):
    files = documents.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", F.coalesce("source", F.lit("x")), F.col("doc_id").cast("string")).alias("path"), "text")
    more = spark.createDataFrame([(50, "e/sub/deep", "plain text"), (51, "other/y", "plain"), (52, None, None)], "file_id long, path string, text string")
    found = {r.file_id: r for r in licenses.scan(files.union(more)).collect()}
    assert (found[12].own, found[12].licence_file) == ("MIT", True)
    assert (found[13].licence, found[13].origin) == ("Apache-2.0", "notice")
    assert (found[50].licence, found[50].origin, found[50].from_dir) == ("Apache-2.0", "directory", "e")  # equal to MIT, first by name
    assert found[51].licence is None and found[52].licence is None
    assert licenses.scan(nothing.select(F.col("doc_id").alias("file_id"), F.col("text").alias("path"), "text")).count() == 0


def test_full_licences_and_wrapped_headers(spark):
    full = {k: v for k, v in licenses.known_templates() if len(v.split()) > 100}
    filled = lambda k: re.sub("<[^<>\n]*>", "2020 Some Owner", full[k])
    untitled = filled("MIT").split("\n", 1)[1]
    wrapped = "#!/bin/sh\n# This work is licensed under the GNU\n# General Public License,\n# version {}\nset -e\necho a b c d e f g h i j k l m n o p q r s t u v w x y z\n" + "run one more step of this script\n" * 30
    header = "/*\n * Some tool.\n *\n" + "".join(f" * {x}\n" for x in re.findall(r".{1,60}(?:\s|$)", dict(licenses.HEADERS)["LGPL-2.1"])) + " */\nint main() { return 0; }\n" * 30
    embedded = "".join(f"// {x}\n" for x in filled("BSD-2-Clause").split("\n")) + "call(some, other, thing);\n" * 200
    texts = [(f"{k}/LICENSE", filled(k), k, True) for k in sorted(full)] + [("m/LICENSE", untitled, "MIT", True)]
    texts += [(f"w{v}/a.sh", wrapped.format(v), f"GPL-{v}.0", False) for v in (2, 3)] + [("h/a.c", header, "LGPL-2.1", False), ("b/a.c", embedded, "BSD-2-Clause", False)]
    texts += [("GPL-3.0/src/a.c", "int x;", "GPL-3.0", False), ("b/c/d.c", "int x;", None, False)]
    files = spark.createDataFrame([(i, p, t) for i, (p, t, *_) in enumerate(texts)], "file_id long, path string, text string")
    found = {r.path: (r.licence, r.licence_file) for r in licenses.scan(files).collect()}
    assert found == {p: (k, f) for p, _, k, f in texts}


def test_html(spark):
    article = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p><b>One<br><p>Two  three<script>x='</p>'</script></article><div class='comments'><p>bad</p></div><footer>foot</footer>"
    open_page = "<div>Site menu with some words</div><p>Own text number {} stands here alone</p><div>Imprint of this very site</div>"
    rows = [(1, "http://h/x", article), (2, None, None), (3, "http://h/y", "")] + [(10 + i, "http://o/z", open_page.format(f"n{i} m{i}")) for i in range(6)] + [(20, "http://c/1", "<p>a copy of all words here</p>"), (21, "http://c/2", "<p>a copy of all words here</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    for words in (300_000, 5):  # one shard, or many
        found = {r.page_id: r.text for r in html.extract(pages, host_words=words).collect()}
        assert found[1] == "A & B\nOne\nTwo three" and found[2] == found[3] == ""
        assert found[10] == "Own text number n0 m0 stands here alone"
        assert found[20] == found[21] == "a copy of all words here"
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shell", ['<body class="no-sidebar">{}', '<html class="has-sidebar menu-open"><body class="cookie-ok">{}', '<main class="menu">{}</main>', '<div class="sidebar-layout"><p>One</p>{}</div>', '<div class="comment"><div id="footer_wrap">{}</div></div><div>Few words</div>'])
def test_html_marks_on_what_holds_the_article(shell):
    page = shell.format('<article><p>Text of the article goes on</p><p class="share-price">42 is the price</p><p class="legal">A law case</p><p class="share">Share this</p></article><div class="comments">bad</div>')
    found = [t for kind, t in html.blocks(page) if kind == html.CONTENT]
    assert [t for t in found if t != "bad"] == ["Text of the article goes on", "42 is the price", "A law case"]


def test_html_marks_elsewhere():
    kinds = {t: kind for kind, t in html.blocks('<div class="site-footer">a</div><div class="related"><article>teaser</article></div><p>Own text without an article here</p><div role="search">b</div><article class="comment">c</article>')}
    assert kinds == {"a": 2, "teaser": 2, "Own text without an article here": 1, "b": 2, "c": 2}


def test_html_short_blocks_of_two_pages_stay(spark):
    page = "<h2>Summary</h2><p>{0} begins what this page alone tells, x{0} y{0}</p>"
    rows = [(i, "http://s/a", page.format(f"k{i}")) for i in range(4)] + [(None, "http://t/a", "<p>" + "long text " * 50_000 + "</p>")] + [(9, "http://r/a", "<main><p>again</p></main>")] * 2
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and sum(r.text == "again" for r in found) == 2
    assert {r.text.split("\n")[0] for r in found if r.page_id in range(4)} == {"Summary"}
    assert len(next(r.text for r in found if r.page_id is None).split()) == 100_000


def test_html_runs_shared_by_shards_are_found(spark):
    """Blocks that differ, but share long runs, on pages of one host: one shard or one for each page or two."""
    page = "<p>Welcome back dear reader number{0} of page{0}</p><p>Own words of{0} this{0} page{0} stand{0} here</p><p>More</p><p>of</p><p>our</p><p>shop</p><p>last{0}</p>"
    pages = spark.createDataFrame([(i, "http://s/a", page.format(f"k{i}")) for i in range(6)], "page_id long, url string, html string")
    whole, dealt = ({r.page_id: r.text for r in html.extract(pages, host_words=n).collect()} for n in (300_000, 20))
    assert whole == dealt == {i: f"Own words ofk{i} thisk{i} pagek{i} standk{i} here\nlastk{i}" for i in range(6)}


def test_repeated_words_by_suffixes():
    words = np.array([1, 2, 3, 4, -1, 9, 1, 2, 3, 5, -2, 7, 7, -3])
    page = np.array([0] * 5 + [1] * 6 + [2] * 3)
    assert html.covered_by(html.shared_starts(words, page, 3), 3).tolist() == [True] * 3 + [False] * 3 + [True] * 3 + [False] * 5


def test_pipeline_bands_fit_its_threshold(spark, documents, monkeypatch):
    import corpus_pipeline

    given, keep_one = {}, minhash.keep_one
    monkeypatch.setattr(minhash, "keep_one", lambda docs, **settings: given.update(settings) or keep_one(docs, **settings))
    kept = corpus_pipeline.drop_near_copies(spark, documents.where("doc_id in (1, 3, 12)"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 12]
    rows = given.get("band_rows", minhash.BAND_ROWS)
    assert (1 - (given["percent"] / 100) ** rows) ** (2 * minhash.PERMUTATIONS // rows) < 0.0001


def test_pipeline_on_edge_rows(spark, documents, tmp_path):
    import corpus_pipeline

    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == documents.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_clashing_and_dotted_names_pass_through(spark, documents):
    wide = documents.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("n_docs", "multiplier", "point", "_row", "a.b", "b`c", "row_number"))))
    sizes = wide.withColumn("size", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    plain = mixing.mix(sizes.select("doc_id", "source", "size")).select("doc_id", "size", "copies")
    mixed = mixing.mix(sizes)
    assert mixed.columns == [c for c in sizes.columns if c != "copies"] + ["source_size", "target", "rate", "copies"]
    rows = mixed.collect()
    assert {(r["n_docs"], r["multiplier"], r["point"], r["_row"], r["a.b"], r["b`c"], r["row_number"]) for r in rows} == {(0, 1, 2, 3, 4, 5, 6)}
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, mixed.select("doc_id", "size", "copies").collect()))
    empty = toxicity.Model({}, (1.0, 1.0, 0.0, 0.0, 0.0), -4.0)
    assert toxicity.score(wide, empty).columns == [c for c in wide.columns if c != "toxicity"] + ["toxicity"]
    assert {r["a.b"] for r in toxicity.score(wide, empty).collect()} == {4}
    stay = exact_dedup.keep_one(wide)
    assert stay.columns == wide.columns and {(r["a.b"], r["b`c"]) for r in stay.collect()} == {(4, 5)}


def test_newton_steps_end_where_doubles_end(spark, monkeypatch):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 1), ("a", 10**9), ("b", 5), ("b", 5), ("c", 10**6), (None, 7)])]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 2)  # halving does the rest
    per = mixing.targets(sizes)
    got = {r.source: r.multiplier for r in mixing.multipliers(sizes, per).collect()}
    for s, target in ((r.source, r.target) for r in per.collect()):
        own = [n for _, x, n in rows if x == s]
        reached = sum(n * min(3.0, float(np.exp(min(50.0, got[s] * n * len(own) / sum(own))))) for n in own)
        assert abs(reached - target) <= 1e-5 * max(target, 1.0)


def test_mixing_rounds_broadcast_only_their_state(spark):
    small = spark.createDataFrame([(f"s{i % 3}", 1 + i % 9, i / 50.0) for i in range(120)] + [(None, 4, 0.5)], "source string, size long, point double")
    state = spark.createDataFrame([("s0", 40.0, -3.0, 3.0), ("s1", 55.0, -3.0, 3.0), ("s2", 9.0, -3.0, 3.0), (None, 8.0, -3.0, 3.0)], "s string, need double, low double, high double")
    refined = mixing._refined(small, mixing.stage(state, "state"), 3)
    assert refined.count() == 4
    refined.collect()
    plan = refined._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") >= 3


def test_language_model_in_tables_equals_the_arrays(spark, documents, nothing):
    rng = np.random.default_rng(5)
    rows = [(100 + i, " ".join("".join(rng.choice(list(letters), rng.integers(1, 8))) for _ in range(rng.integers(1, 60))), lang) for i, (lang, letters) in enumerate([("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "\u65e5\u672c\u8a9e\u6570\u636e\U00020000")] * 12)]
    table = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    usable = lambda c: c.isNull() | (c % 4 != 2)
    arrays, tables = langid.learn(table, usable), langid.learn(table, usable, max_ngrams=0)
    assert isinstance(tables, langid.StagedModel) and tables.languages == arrays.languages
    assert np.allclose(tables.floor, arrays.floor, atol=1e-5) and np.allclose(tables.limits, arrays.limits, atol=1e-4) and tables.temperature == arrays.temperature
    key = lambda r: (str(r.doc_id), r.text or "")
    one = sorted(langid.predict(table, arrays, keep=("doc_id", "text")).collect(), key=key)
    two = sorted(langid.predict(table, tables, keep=("doc_id", "text")).collect(), key=key)
    assert [(r.doc_id, r.text, r.lang_pred, r.rejected) for r in one] == [(r.doc_id, r.text, r.lang_pred, r.rejected) for r in two]
    assert np.allclose([(r.score, r.entropy) for r in one], [(r.score, r.entropy) for r in two], atol=1e-4)
    assert langid.predict(nothing, tables).count() == 0


def test_language_limits_and_temperature_are_of_all_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(rng.integers(1, 5))), lang) for i, (lang, letters) in enumerate([("aa", "abcde"), ("bb", "defgh")] * 3_500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    arrays, tables = langid.learn(table), langid.learn(table, max_ngrams=0)
    bits, _ = langid.entropies(arrays, [t for _, t, _ in rows])
    own = np.array([arrays.languages.index(x) for *_, x in rows])
    scale = np.geomspace(0.5, 200, 60)
    loss = [-np.log(langid.softmax(-bits * t)[np.arange(len(own)), own] + 1e-9).mean() for t in scale]
    for model, error in ((arrays, 1e-9), (tables, 1e-4)):
        assert np.allclose(model.limits, [np.quantile(bits[own == i, i], 0.999) + 0.5 for i in range(2)], rtol=0, atol=error)
        assert model.temperature == scale[int(np.argmin(loss))]


@pytest.mark.parametrize("values", [[1.0], [2.0] * 500, [0.1 * i for i in range(3001)] + [7.7] * 900, [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 2), 1e9]])
def test_quantiles_are_exact(spark, values):
    table = spark.createDataFrame([(k, float(v) * (k + 1)) for k in range(2) for v in values], "own int, value double")
    for share in (0.0, 0.5, 0.999, 1.0):
        got = langid.quantiles(table, share, buckets=16)
        assert np.allclose([got[k] for k in range(2)], [np.quantile(np.array(values) * (k + 1), share) for k in range(2)], rtol=1e-14, atol=0)


def test_language_probabilities_by_the_formula(spark):
    """Interpolated Kneser-Ney written out for one language, without tables."""
    words = ["aab", "ab", "ba", "aab", "c"]
    grams = Counter(("   " + w + " ")[i : i + 4] for w in words for i in range(len(w) + 1))
    counts = {4: dict(grams)}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    letters = len(counts[1]) + 1

    def p(window: str) -> float:
        if not window:
            return 1 / letters
        level = counts[len(window)]
        total = sum(n for g, n in level.items() if g[:-1] == window[:-1])
        if not total:
            return p(window[1:])
        kinds = sum(g[:-1] == window[:-1] for g in level)
        return max(level.get(window, 0) - 0.75, 0) / total + 0.75 * kinds / total * p(window[1:])

    rows = spark.createDataFrame([(1, " ".join(words), "aa")], "doc_id long, text string, lang string")
    texts = ["aab ab", "bab", "cc", "zzz a", "b"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in (0, 1000):
        got = {r.doc_id: r.entropy for r in langid.predict(asked, langid.learn(rows, max_ngrams=bound)).collect()}
        for i, text in enumerate(texts):
            windows = [("   " + w + " ")[j : j + 4] for w in text.split() for j in range(len(w) + 1)]
            assert abs(got[i] + sum(np.log2(p(w)) for w in windows) / len(windows)) < 1e-4
