"""The numbered operators against brute force, exact round trips and held-out labels, and their odd cases."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clausework.llm import decontaminate, embeddings, graph, html, licenses, mixing, neardup, pii, quality, toxicity, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema="doc_id long, text string"):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("rep", "band", "component_id", "size", "_features", "score", "kept", "label")})


def prose(seed, n=60, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_of(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_words_are_bytes_between_white_space():
    text = "Ab c d\x0be\x1cf \tG\r\n\x0c h"
    (_, got), (_, same) = words.word_hashes([text.encode(), b"AB\xc2\xa0C D E\x1cf g H"])
    assert len(got) == 5 and (got == same).all()
    long = " ".join(f"w{i}" for i in range(400_000)).encode()
    split = dict(words.word_hashes([b"x", long, b"y z", b""]))
    assert [len(split[k]) for k in range(4)] == [1, 400_000, 2, 0] and len(np.unique(split[1])) == 400_000


def near_copies():
    r = random.Random(1)
    rows, base = [], prose(0, 120)
    for i in range(40):  # variants of one text, many of them not similar to each other
        w = base.split()
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(i, prose(i, r.randrange(1, 80))) for i in range(1, 30)]
    rows += [(200 + i, prose(5000, 30) + " " + prose(300 + i, 30)) for i in range(20)]  # a passage in common
    rows += [(300, "A b C"), (301, "a B c"), (302, ""), (303, None), (304, " \n\t "), (305, prose(3, 50).upper()), (306, prose(3, 50))]
    return rows


def test_near_duplicates_are_exact(spark):
    rows = near_copies()
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    sets = {i: shingles(t) for i, t in rows}
    want = groups_of(sorted(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(want) - 20


def test_near_duplicates_odd_tables(spark):
    assert neardup.near_duplicates(documents(spark, [])).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "q w")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in neardup.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, 2, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (2, 2, 1, False)]


def test_block_pairs_find_all_links():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 50)).astype(np.int64) for _ in range(30)]
    part = lambda side: pd.DataFrame({"rep": range(30), "component": range(30), "side": side, "shingles": sets})
    out = neardup._block_links(44)(pd.concat([part(0), part(1)]))
    want = groups_of(range(30), lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 44 * len(np.union1d(sets[a], sets[b])))
    got = groups_of(range(30), lambda a, b: ((out["a"] == b) & (out["b"] == a)).any())
    assert got == want and len(set(want.values())) < 30


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 120)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_around_hot_nodes(spark):
    r = random.Random(2)
    edges = [(5, i) for i in range(100, 160)] + [(i, 1) for i in range(100, 110)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(60)] + [(7, 7), (None, 3)]
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    linked = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    want = groups_of(nodes, lambda a, b: (a, b) in linked)
    assert dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()) == want


@pytest.mark.parametrize("threshold", [0.9, 0.98])
def test_vectors_are_compared_exactly(spark, monkeypatch, threshold):
    monkeypatch.setattr(embeddings, "TILE", 16)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + r.normal(size=16) * 0.12 * (i % 4)], int(i % 2)) for i in range(90)]
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, rows[0][1], None), (206, [1.0, 0.0], 0), (207, [None] * 16, 1), (208, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicate_vectors(df).collect()} if threshold == 0.98 else {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicate_vectors(df, threshold).collect()}
    by = {i: (v, lab) for i, v, lab in rows}

    def linked(a, b):
        (x, p), (y, q) = by[a], by[b]
        if p is None or p != q or not x or not y or len(x) != len(y) or None in x or None in y:
            return False
        x, y = np.array(x), np.array(y)
        with np.errstate(all="ignore"):
            return bool(x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold)

    want = groups_of(sorted(by), linked)
    assert got == {i: (sum(linked(i, j) for j in by if j != i), want[i], want[i] == i) for i in by}
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_extreme_sizes_link(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(1, base, "a"), (2, [1e-200 * x for x in base], "a"), (3, [1e200 * x for x in base], "a"), (4, [5e-324, 0.0, 0.0, 0.0], "a"), (5, [-x for x in base], "a"), (6, [0.0] * 4, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicate_vectors(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_decontamination_against_all_windows(spark):
    items = [(k, prose(1000 + k, 20 + k)) for k in range(12)] + [(50, "only three words"), (51, ""), (52, None), (None, "x y z a b c")]
    w = items[3][1].split()
    edited = " ".join(w[:4] + ["changed"] + w[5:])
    docs = [(1, prose(1) + " " + items[0][1].upper() + " " + prose(2)), (2, prose(3) + " " + edited), (3, prose(4, 300)), (4, items[5][1][: len(items[5][1]) // 2]), (5, None), (6, ""), (7, "only three words"), (8, " ".join(items[7][1].split()[:-2])), (1, items[1][1]), (None, items[2][1])]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(documents(spark, docs), documents(spark, items, "item_id long, text string")).collect()}
    want = {}
    from collections import Counter

    bag = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = (text or "").lower().split(), (item or "").lower().split()
        if not a or not b or i is None:
            continue
        n = min(len(b), len(a)) if len(b) >= 5 else len(a) if len(a) < 5 else 5
        best = max(sum((bag(a[s : s + n]) & bag(b)).values()) / sum((bag(a[s : s + n]) | bag(b)).values()) for s in range(len(a) - n + 1))
        if best >= 0.75:
            want[d, i] = max(want.get((d, i), 0), round(best, 9))
    assert got == want and {(1, 0), (1, 1), (7, 50), (8, 7), (None, 2)} <= set(want)
    assert decontaminate.contaminated(documents(spark, []), documents(spark, items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(documents(spark, docs), documents(spark, [], "item_id long, text string")).count() == 0


def _postings(n):
    (postings,) = decontaminate.BenchmarkIndex.build([(k, prose(k, 30)) for k in range(n)]).lengths.values()
    return postings


def test_multi_index_returns_all_within_the_radius():
    postings = _postings(5)
    r = np.random.default_rng(3)
    for item in range(5):
        for flips in (0, 20, decontaminate.RADIUS):
            for _ in range(20):
                bits = np.unpackbits(postings.prints[item])
                bits[r.choice(decontaminate.BITS, flips, replace=False)] ^= 1
                assert item in postings.near(np.packbits(bits)[None, :], np.zeros(1, bool))[1]


def test_multi_index_looks_at_few_strangers():
    strangers = np.random.default_rng(4).integers(0, 256, (500, decontaminate.BYTES)).astype(np.uint8)
    windows, _ = _postings(300).candidates(strangers)
    assert len(windows) < 0.02 * 300 * 500


def test_copies_at_the_threshold_lie_within_the_radius():
    """Items of 60 shingles of which 51.4 / 60 are common, a similarity of 0.75: the share that the radius misses."""
    r = np.random.default_rng(6)
    n, missed, total = 60, 0, 4000
    for _ in range(total):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - 8], r.integers(0, 1 << 63, 8).astype(np.uint64)])
        x, y = (decontaminate._fingerprints(decontaminate._bit_signs(v).sum(axis=0, keepdims=True, dtype=np.int32))[0] for v in (a, b))
        missed += int(np.bitwise_count(x ^ y).sum()) > decontaminate.RADIUS
    assert missed <= 0.002 * total


def test_heavily_repeated_shingles_are_found(spark):
    base = prose(77, 59).split()
    item = base[:35] + ["x"] * 24
    doc = base[:35] + ["x"] * 27
    got = decontaminate.contaminated(documents(spark, [(1, " ".join(doc))]), documents(spark, [(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(got) == 1


def test_clean_rows_stay_whatever_their_id(spark, monkeypatch):
    items = [(k, prose(500 + k, 30)) for k in range(5)]
    docs = [(1, prose(1)), (1, items[0][1]), (None, prose(2)), (None, items[4][1]), (3, None), (3, "")]
    for lot in (2, 20_000):
        monkeypatch.setattr(decontaminate, "LOT_ITEMS", lot)
        got = decontaminate.without_contaminated(documents(spark, docs), documents(spark, items, "item_id long, text string")).select("doc_id", "text").collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in documents(spark, [docs[k] for k in (0, 2, 4, 5)]).select("doc_id", "text").collect())


PAGES = [
    (1, "http://h.example/a?x=1", "<p>" + "x" * 2000), (2, "http://h.example/a?x=1", "<p>" + "x" * 2000), (3, None, "<p>" + "x" * 2000), (4, "http://B.example/", "short"), (5, "http://b.example/", "short"),
    (6, "http://a.example/é", None), (7, "", ""), (8, "http://b.example/z", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "é" * 600), (None, "http://n.example/", "<p>" + "y" * 1500), (9, "not a url\r\n[", "\x00\n"),
]


def test_archives_round_trip(spark):
    got = warc.capture_history(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)).collect()
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), i if i is not None else -1)
    want = {}
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and i is not None and best[h or ""] != i
        want[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best[h or ""] if revisit else None)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert [r.url_key for r in got] == sorted(r.url_key for r in got) and {r.page_id: r.url for r in got}[3] is None
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_archives_are_noticed():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    row = lambda: (f"k{r.randrange(9)}", "t", r.randrange(50), "", 0, "", "", None, "f", r.randrange(99))
    runs = [sorted((row() for _ in range(r.randrange(0, 20))), key=warc._order) for _ in range(k)]
    assert list(map(warc._order, warc.loser_tree_merge(runs))) == sorted(warc._order(x) for run in runs for x in run)


def test_main_text(spark):
    shell = '<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><a href="/x">Menu</a></nav><div class="cookie-notice">We use cookies</div>%s<aside>Side</aside><div id="comments"><p>First!</p></div><footer>&copy; us</footer></body></html>'
    article = "<article><h1>Title %d</h1><p>A&amp;B <b>bo</b>ld<br>next&nbsp;line<script>var t='</p>';</script></p><div class='ad'>Buy</div><form><p>Mail</p></form><p>Shared   passage</p></article>"
    plain = "<div id=main><p>Body %d text</p><p>more words here</p></div>"
    rows = [(k, f"http://a.example/{k}", shell % (article % k)) for k in range(4)] + [(10 + k, f"http://b.example/{k}", shell % (plain % k)) for k in range(4)]
    rows += [(20, "http://a.example/x", None), (21, None, ""), (22, "http://c.example/", "<p>alone <b>and</b> unclosed"), (23, "bad url", "a < b &lt; c"), (3, "http://a.example/3", shell % (article % 3))]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect())
    text = {k: f"Title {k} A&B bold next line Shared passage" for k in range(4)} | {10 + k: f"Body {k} text more words here" for k in range(4)} | {20: "", 21: "", 22: "alone and unclosed", 23: "a < b < c"}
    assert got == sorted((i, text[i], len(text[i])) for i, *_ in rows)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_pages_without_article(spark):
    shell = "<html><body><div>Home About</div><div class=wrap><div class=content>%s</div></div><div class=footer>us</div></body></html>"
    prose = "<h1>Title %d</h1><p>" + "long text %d " * 20 + "</p><p>more</p><ul><li>item %d</li></ul><table><tr><td>cell %d</td></tr></table><blockquote>quote %d</blockquote><pre>code %d</pre>"
    items = "<h1>Title %d</h1><ul><li>" + "item %d " * 30 + "</li></ul><p>after %d</p>"
    bodies = [(k, shell % (prose.replace("%d", str(k)))) for k in range(5)] + [(10 + k, shell % (items.replace("%d", str(10 + k)))) for k in range(2)]
    alone = [(20, "http://alone.example/", "<div><h2>Head</h2><p>" + "word " * 60 + "</p><ul><li>point</li></ul></div>")]
    got = dict(html.main_text(spark.createDataFrame([(k, f"http://a.example/{k}", b) for k, b in bodies] + alone, "page_id long, url string, html string")).select("page_id", "text").collect())
    for k in range(5):
        assert got[k].split() == f"Title {k} {f'long text {k} ' * 20} more item {k} cell {k} quote {k} code {k}".split()
    for k in (10, 11):
        assert got[k].split() == f"Title {k} {f'item {k} ' * 30} after {k}".split()
    assert got[20].split() == ["Head"] + ["word"] * 60 + ["point"]


def _texts(spark, bodies, host="a"):
    rows = [(k, f"http://{host}.example/{k}", f"<html><body><nav>Menu</nav>{b}<footer>us</footer></body></html>") for k, b in enumerate(bodies)]
    got = dict(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    return [got[k] for k in range(len(bodies))]


def test_slots_decide_and_names_break_ties(spark):
    long = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    n = range(5)
    # two articles are both content; a teaser in an article does not displace the main text
    assert _texts(spark, [f"<article><p>one {k}</p></article><article><p>two {k} {long(k)}</p></article>" for k in n]) == [f"one {k} two {k} {long(k)}" for k in n]
    assert _texts(spark, [f"<article>teaser {k}</article><div class=body><p>{long(k)}</p></div>" for k in n]) == [f"teaser {k} {long(k)}" for k in n]
    # a marking word within another name cuts nothing; whole names do
    inside = "<article><div class='product-notice'>note {0}</div><div class='header-image'><h1>Title {0}</h1></div><div class='article-header'>by {0}</div><p>{1}</p><div class='cookie-notice'>eat {0}</div><div class='ad ad-box'>buy {0}</div></article>"
    assert _texts(spark, [inside.format(k, long(k)) for k in n]) == [f"note {k} Title {k} by {k} {long(k)}" for k in n]
    # unmarked comments beside an article are told apart by it; deeper articles too
    assert _texts(spark, [f"<div class=page><div><article><p>{long(k)}</p></article></div><div>user {k} says hi</div></div>" for k in n]) == [long(k) for k in n]
    assert _texts(spark, [f"<div class=comments><p>user {k} says hi</p></div><div><p>{long(k)}</p></div>" for k in n]) == [long(k) for k in n]


@pytest.mark.parametrize("name", ["div", "section"])
def test_given_pages_need_no_article(spark, sf_dir, name):
    """The wrapper finds the same text where the articles are plain containers."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article\\b", f"$1{name}"))
    assert sorted(html.main_text(plain).collect()) == sorted(html.main_text(pages).collect())


def test_all_layouts_of_a_host_make_its_wrapper(spark):
    orders = list(itertools.permutations(("<p>p %d</p>", "<ul><li>l %d</li></ul>", "<table><tr><td>t %d</td></tr></table>", "<h2>h %d</h2>")))
    common = [(k, "http://a.example/", f"<body><div>Home About</div><section><p>only {k}</p></section></body>") for k in range(40)]
    rare = [(100 + k, "http://a.example/", "<body><div>Home About</div><section>" + "".join(o).replace("%d", str(k)) + "</section></body>") for k, o in enumerate(orders)]
    deep = [(200, "http://a.example/", "<body><div>Home About</div><section><div><b>deep</b><div>down</div></div></section></body>")]
    rows = [(i, u, h) for i, u, h in common + rare + deep] + [(300 + k, "http://b.example/", f"<body><div>Menu</div><dl><dt>{k}</dt></dl>" + f"<div><div>{'<div>' * k}x{'</div>' * k}</div></div>" + "</body>") for k in range(1, 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.host: (r.path, r.dropped) for r in html.wrappers(df).collect()} == {"a.example": ("/#/body/section~1", []), "b.example": ("/#/body", ["/#/body/div~1"])}
    got = dict(html.main_text(df).select("page_id", "text").collect())
    assert got[3] == "only 3" and got[200] == "deep down"
    assert {k: got[100 + k] for k in range(len(orders))} == {k: " ".join(f"{re.search('[plth](?= %d)', x)[0]} {k}" for x in o) for k, o in enumerate(orders)}
    assert all(got[300 + k] == f"{k} x" for k in range(1, 20))


def _site(seed: int, n: int = 8, classes: bool = True) -> list[tuple[str, str]]:
    """(html, main text) of the pages of one site whose class names mean nothing: its template is constant, its content varies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    words = lambda k: " ".join(word() for _ in range(k))
    name = lambda: f' class="{word()}"' if classes else ""
    menu, foot, inside = words(6), words(8), words(5)
    box = [name() for _ in range(5)]
    pages = []
    for _ in range(n):
        parts = [f"<h1>{words(3)}</h1>"] + [r.choice(("<p>%s</p>", "<ul><li>%s</li></ul>", "<blockquote>%s</blockquote>", "<table><tr><td>%s</td></tr></table>")) % words(r.randrange(4, 20)) for _ in range(r.randrange(2, 7))]
        links = "".join(f'<li><a href="/{k}">{word()}</a></li>' for k in range(r.randrange(3, 7)))
        page = f"<html><body><div{box[0]}>{menu}</div><div{box[1]}><ul>{links}</ul></div><div{box[2]}>{''.join(parts[:2])}<div{box[3]}>{inside}</div>{''.join(parts[2:])}</div><div{box[4]}>{foot}</div></body></html>"
        pages.append((page, " ".join(re.sub("<[^>]*>", " ", " ".join(parts)).split())))
    return pages


@pytest.mark.parametrize("classes", [True, False])
def test_main_text_needs_no_names(spark, classes):
    rows = [(100 * k + i, f"http://s{k}.example/{i}", page, text) for k in range(6) for i, (page, text) in enumerate(_site(k, classes=classes))]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert dict(html.main_text(df).select("page_id", "text").collect()) == {r[0]: r[3] for r in rows}


def test_paths_align_as_simple_tree_matching_does():
    for seed in range(20):
        trees = [html.fold(html.parse(page)) for page, _ in _site(seed)]
        for a, b in itertools.combinations(trees[:5], 2):
            at = lambda t: {id(n): path for path, n in html._paths(t)}
            pa_, pb = at(a), at(b)
            _, pairs = html.simple_tree_match(a, b)
            met = {(pa_[id(x)], pb[id(y)]) for x, y in pairs}
            assert all(x == y for x, y in met)
            # paths also align what stands in another order on the two pages
            common = set(pa_.values()) & set(pb.values())
            assert {x for x, _ in met} <= common and len(met) >= 0.6 * len(common)


@pytest.mark.parametrize(
    "page, text",
    [("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p>", "x y"), ('<p>a</p><a ' + '"' * 100001, None), ("<b>" * 20000 + "z", "z"), ("<p>a" + "<" * 100000, None), ("<a '" * 50000 + ">", None), ("</x>" * 100000 + "end", "end"), ("<li>" * 30000 + "q", "q"), ("<p>" + "<i>w</i> " * 50000 + "</p>", "w " * 49999 + "w")],
)
def test_broken_and_deep_pages_take_linear_time(page, text):
    start = time.perf_counter()
    got = html.extract(page, None)
    assert time.perf_counter() - start < 5 and (text is None or got == text)


def test_template_needs_distinct_pages(spark):
    page = "<body><div>Menu</div><section><p>%s</p><ul><li>shared list</li></ul></section></body>"
    copies = [(k, "http://a.example/", page % "same") for k in range(6)] + [(10, "http://a.example/", page.replace("<ul><li>shared list</li></ul>", "") % "other")]
    got = dict(html.main_text(spark.createDataFrame(copies, "page_id long, url string, html string").withColumn("_path", F.lit(1)).withColumn("_Host", F.lit(2))).select("page_id", "text").collect())
    assert got[0] == "same shared list" and got[10] == "other"


#: Examples that the trees have not seen.
OTHER_EXAMPLES = {
    "account": (("transfer it to my account no {d12} please", "bank iban {d18}", "his account {d10} was charged"), ("page {d10} of it", "{w} {w} {d14} {w}", "order number {d11} came")),
    "local_phone": (("you can phone him: {d3}-{d3}-{d4}", "mobile ({d3}) {d3}-{d4}"), ("item {d3}-{d3}-{d4} sold", "{w} {d3}-{d3}-{d4}")),
    "secret": (('the token: "{h24}"', "password={w}{d6}"), ("key = something_nice here", "secret: nobody_knows it")),
    "written_email": (("mail me: {w} [at] {w} [dot] org", "contact {w}(at){w}(dot)com"), ("go {w} (at) {w} (dot) then", "seen {w} [at] {w} [dot] twice")),
}


def test_further_kinds_on_other_examples(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = pii.fit_spans(docs)
    texts = pii.written_examples(docs, OTHER_EXAMPLES, 50)
    found = pii.with_spans(texts, model).selectExpr("kind", "label", "exists(_spans, s -> s.kind = kind) as hit")
    for r in found.groupBy("kind").agg(F.avg(F.expr("case when label = 1 then cast(hit as int) end")).alias("recall"), F.expr("sum(case when hit then label end) / count_if(hit)").alias("precision")).collect():
        assert r.recall >= 0.9 and r.precision >= 0.8, r


def test_many_spans_are_contained_and_rewritten_in_near_linear_time(spark):
    text = " ".join(f"a{k}@b.org token={k:012d}x 10.0.0.{k % 256}" for k in range(4000))
    start = time.perf_counter()
    (row,) = pii.redact(documents(spark, [(1, text)])).select("text").collect()
    assert row.text.count("[EMAIL]") == 4000 and row.text.count("[IP]") == 4000 and time.perf_counter() - start < 120


def test_tree_matching():
    tree = lambda s: html._read_skeleton(s)
    assert html.simple_tree_match(tree("a(b,c(d),e)"), tree("a(b,c(d,f),g,e)"))[0] == 5
    assert html.simple_tree_match(tree("a(b,c)"), tree("a(c,b)"))[0] == 2
    assert html.skeleton(html.fold(html.parse("<ul><li>1<li>2</ul><p>x<p>y"))) == "#(ul(li),p)"


def test_licenses(spark):
    mit = " ".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty"))
    rows = [(1, "x. Released under the MIT License.\nmore"), (2, f"Copyright me\n{mit}"), (3, licenses.SENTENCES["mit-warranty"] + " " + licenses.SENTENCES["mit-grant"]), (4, "a license to write"), (5, None), (6, ""), (1, "LICENSED under the apache license,  version 2.0.")]
    got = sorted((r.doc_id, r.rule) for r in licenses.find_licenses(documents(spark, rows)).collect())
    assert got == [(1, "apache-2.0-reference"), (1, "mit-reference"), (2, "mit-text")]
    assert licenses.find_licenses(documents(spark, [])).count() == 0
    assert all(re.search(licenses.CUES.removeprefix("(?i)"), s, re.I) for s in licenses.SENTENCES.values())


def test_each_known_sentence_alone_is_found(spark):
    rows = list(enumerate(licenses.SENTENCES.values()))
    alone = [(name, name, (name,)) for name in licenses.SENTENCES]
    got = {r.doc_id: r.rule for r in licenses.find_licenses(documents(spark, rows), rules=alone).collect()}
    assert got == dict(enumerate(licenses.SENTENCES))
    (line,) = licenses.find_licenses(documents(spark, [(1, "Some prose. All rights reserved.")])).collect()
    assert (line.rule, line.license) == ("all-rights-reserved-line", "All-Rights-Reserved")
    (own,) = licenses.find_licenses(documents(spark, [(1, "a. Use it as you like.")]), {"own": "Use it as you like."}, [("r", "own", ("own",))]).collect()
    assert own.rule == "r"


def test_wrapped_and_split_sentences(spark):
    import textwrap

    full = {name: " ".join(licenses.SENTENCES[k] for k in ids) for name, _, ids in licenses.RULES}
    names = list(full)
    rows = [(k, "Title\n\n" + textwrap.fill(full[n], 40)) for k, n in enumerate(names)]
    rows += [(100 + k, "/*\r\n" + textwrap.indent(textwrap.fill(full[n], 66), " * ").replace("\n", "\r\n") + "\r\n */\r\ncode") for k, n in enumerate(names)]
    rows += [(200, "Licensed under the Apache License, v. 2.0."), (201, "2.0."), (202, "A title\nReleased under the MIT License.\nmore text"), (203, "Released under\n\nthe MIT License."), (204, "Released under. The MIT License."), (205, "It is released under the MIT License."), (206, "x\n" + "? ! \n" * 30000 + "All rights\nreserved.")]
    got = {}
    for r in licenses.find_licenses(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.rule)
    want = {k + at: {n} for k, n in enumerate(names) for at in (0, 100)}
    assert got == want | {202: {"mit-reference"}, 206: {"all-rights-reserved-line"}}


def test_longest_rule_wins_where_it_matches(spark):
    s = licenses.SENTENCES
    two = " ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    rows = [(1, f"{two} {s['bsd-endorse']}"), (2, two), (3, f"{two} {s['bsd-endorse']}\n\n{two}"), (4, f"{s['gpl-header-3']} {s['gpl-warranty']}")]
    got = {}
    for r in licenses.find_licenses(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.rule)
    assert got == {1: {"bsd-3-clause-text"}, 2: {"bsd-2-clause-text"}, 3: {"bsd-3-clause-text", "bsd-2-clause-text"}, 4: {"gpl-3.0-header"}}


def test_mixing(spark):
    rows = [(i, prose(i, i % 9), f"s{i % 5}" if i % 11 else None) for i in range(300)] + [(None, "a b", "s1"), (7, None, "zero"), (5, prose(5, 5), "s0"), (5, prose(5, 5), "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rank": F.lit(1), "target": F.lit(2)})
    got, again = (sorted((str(r.doc_id), r.size, r.source or "", r.source_size, r.target, r.taken, r.position or -1, r.repeat_position or -1) for r in mixing.mix(x).collect()) for x in (df, df.repartition(7)))
    assert got == again
    p = pd.DataFrame(got, columns="doc_id size source source_size target taken position repeat_position".split())
    by = p.groupby("source").agg({"size": "sum", "source_size": "first", "target": "first", "taken": "sum"})
    assert (by["size"] == by["source_size"]).all() and ((by["taken"] - by["target"]).abs() <= 0.5).all() and (p["taken"] <= 2 * p["size"]).all()
    assert by["target"].sum() == pytest.approx(1.5 * p["size"].sum()) and (by["target"] <= 2 * by["source_size"] + 1e-9).all()
    assert p["position"].max() <= 1 and (p["repeat_position"] <= 1).all()
    assert mixing.mix(df.limit(0)).count() == 0


def test_schedules_are_inverted(spark):
    df = spark.range(1, 100).selectExpr("id / 100D as q")
    for s in mixing.SCHEDULES:
        for r in df.select("q", mixing._position(F.col("q"), s).alias("t")).collect():
            t = np.linspace(0, r.t, 20001)
            area = np.trapezoid(np.interp(t, *zip(*s, strict=True)), t) / np.trapezoid(np.interp(np.linspace(0, 1, 20001), *zip(*s, strict=True)), np.linspace(0, 1, 20001))
            assert area == pytest.approx(r.q, abs=1e-6)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_personal_data(spark):
    r = random.Random(4)
    texts = [None, "", "plain", "😀 é x.y@z-1.co.uk, +44 20 7946 0958", "a@b.c_d@e.f %a@b-c.d.", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 1.1.1.0999", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111", "+1 (706) 555-3138 and +12 or +1234567890123456 +1-2-3-4-5-6-7-8-9", "1 " * 30_000, "7" * 40_000, "a.b" * 20_000 + "@x.y", "x@" + "a." * 20_000 + "z"]
    texts += ["".join(r.choice("0123456789.+-@ ab()") for _ in range(200)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])]
    got = pii.find_personal_data(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        text = texts[x.doc_id if x.doc_id is not None else 3] or ""
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert x.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and x.spans.startswith(joined), text[:80]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == s[0] for s in spans) for k in BASE]
    assert pii.find_personal_data(documents(spark, [])).count() == 0


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "é mail x.y@z.co now 1.2.3.4!", "en", "s", 99), (2, None, "en", None, None), (3, "clean", None, "s", 5), (4, "", "en", "s", 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ("é mail [EMAIL] now [IP]!", 24), 2: (None, None), 3: ("clean", 5), 4: ("", 0)}


def test_trees_are_read_as_fitted(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    r = random.Random(6)
    rows = [([r.random() for _ in pii.FEATURES],) for _ in range(300)]
    df = spark.createDataFrame(rows, "f array<double>").withColumn("label", F.expr("cast(f[0] + f[1] * f[2] > 0.8 as double)")).withColumn("v", array_to_vector("f"))
    model = GBTClassifier(featuresCol="v", maxDepth=3, maxIter=5, seed=1).fit(df)
    own = pii.SpanModel(tuple(pii._read_tree(t.toDebugString) for t in model.trees), tuple(map(float, model.treeWeights)), (("secret", 0.5),))
    both = model.transform(df).select(vector_to_array("probability")[1].alias("p"), own.probability([F.get("f", F.lit(k)) for k in range(len(pii.FEATURES))]).alias("q")).collect()
    assert all(x.p == pytest.approx(x.q, abs=1e-9) for x in both)


def labelled(spark):
    r, rows, labels = random.Random(8), [], []
    for i in range(400):
        text, good, toxic = prose(i, 40, 5000), int(i % 3 > 0), int(i % 4 == 0)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            w = text.split()
            for bad in r.choices(["idiot", "moron", "stupid", "TRASH!", "1d1ot"], k=4):
                w.insert(r.randrange(len(w)), bad)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, good if i % 50 else None, toxic))
    return documents(spark, rows + [(1000, None), (1001, ""), (None, "x"), (5, rows[5][1])]), spark.createDataFrame([*labels, (5, 1, 0), (None, 1, 1), (77777, 0, 1)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("scores, column, threshold", [(quality.quality_scores, 1, 0.7), (toxicity.toxicity_scores, 2, 0.3)])
def test_scores_on_held_out_labels(spark, scores, column, threshold):
    import zlib

    docs, labels, known = labelled(spark)
    got = scores(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    truth = {k[0]: k[column] for k in known if k[column] is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert scores(docs.limit(0), labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == 404


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.withColumns({c: F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = ({(r.doc_id, round(r.score, 9)) for r in scores(docs, x).collect()} for x in (labels, flipped))
        assert a == b
