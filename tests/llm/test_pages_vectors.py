"""Nearest neighbours, main text and url filters."""

import collections
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, html_text, url_filter


@pytest.fixture(scope="module")
def model():
    return html_text.train()


# nearest neighbours -----------------------------------------------------------------------


def brute(rows, queries, k=5):
    """Of vec_ids with one vector each."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            cos = {i: float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)) for i, v in good.items() if i != q and len(v) == len(good[q])}
            out[q] = sorted(cos, key=lambda i: (-round(cos[i], 10), i))[:k]
    return out


def found(spark, rows, every=10):
    df = spark.createDataFrame([(i, v, 3, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, code string, v int")
    out = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append(r["vec_id"])
    return dict(out)


def test_recall(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(1500)]
    want, got = brute(rows, range(0, 1500, 10)), found(spark, rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_odd_vectors(spark):
    ok = [(i, [1.0, float(i), 2.0]) for i in range(1, 8)]
    bad = [(20, None), (30, [0.0, 0.0, 0.0]), (40, [1.0, None, 2.0]), (50, [1.0, float("nan"), 2.0]), (60, [float("inf"), 1.0, 1.0]), (70, []), (None, [1.0, 2.0, 3.0]), (80, [1.0, 2.0])]
    rows = [*ok, (10, [1.0, 3.0, 2.0]), (10, [1.0, 3.0, 2.0]), *bad]
    assert found(spark, rows) == brute(rows, [10])
    assert found(spark, bad[:3]) == {} and found(spark, []) == {}
    assert found(spark, [(10, [1.0, 2.0]), (11, [2.0, 1.0])]) == {10: [11]} and found(spark, [(10, [1.0, 2.0])]) == {}


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=[2, 3, 3, 7][i % 4])]) for i in range(200)] + [(200, [1.0]), (210, [1.0, 2.0, 3.0, 4.0]), (211, [1.0, 2.0, 3.0, 5.0])]
    want, got = brute(rows, range(0, 220, 10)), found(spark, rows)
    assert got.pop(210) == [211] == want[210] and set(got) == {q for q, near in want.items() if near} - {210}
    assert all(len(v) == 5 for v in got.values()) and np.mean([len(set(got[q]) & set(want[q])) / 5 for q in got]) >= 0.9


def test_scores_are_cosines(spark):
    rng = np.random.default_rng(7)
    rows = {i: rng.normal(size=5).astype(np.float32).astype(float) for i in range(80)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<float>")
    for r in ann.search(df, F.col("vec_id") % 10 == 0).collect():
        a, b = rows[r["query_id"]], rows[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(40)] + [(i, [2.0, 1.0, 0.5]) for i in range(40, 60)] + [(i, [0.0, 1.0, float(i)]) for i in range(60, 70)]
    assert found(spark, rows) == brute(rows, range(0, 70, 10))


@pytest.mark.parametrize("cell", [8192, 30])
def test_repeated_rows_take_no_place(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    nearest = {q: near[0] for q, near in brute(rows, range(0, 60, 10)).items()}
    again = [(i, v) for i, v in rows if i in nearest.values() for _ in range(9)]
    # and one vec_id of many vectors, all nearer to the query 0 than any other
    near = [(61, [x + 0.001 * j for x in rows[0][1]]) for j in range(1, 12)]
    got = found(spark, [*rows, *again, *near])
    assert set(got) == set(range(0, 60, 10)) and all(len(v) == len(set(v)) == 5 for v in got.values())
    assert got[0][0] == 61
    if cell == 8192:
        want, got = brute(rows, range(0, 60, 10)), found(spark, [*rows, *again])
        assert all(len(set(v)) == 5 and v[0] == want[q][0] for q, v in got.items())
        assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


@pytest.mark.parametrize("most", [16384, 3])
def test_many_copies_of_one_vector(spark, monkeypatch, most):
    """A third of all rows share a vector, and queries of one cell are dealt over several tasks."""
    monkeypatch.setattr(ann, "ASKED", most)
    monkeypatch.setattr(ann, "CELL", 64)
    rng = np.random.default_rng(9)
    hot, pair = ([float(x) for x in rng.normal(size=8)] for _ in range(2))
    rows = [(i, hot if i % 3 == 0 else pair if i in (40, 80) else [float(x) for x in rng.normal(size=8)]) for i in range(240)]
    want, got = brute(rows, range(0, 240, 10)), found(spark, rows)
    assert set(got) == set(want) and all(len(v) == 5 and q not in v for q, v in got.items())
    assert all(got[q] == want[q] for q in want if q % 3 == 0)
    assert got[40][0] == 80 and got[80][0] == 40
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_best_keeps_distinct_ids():
    rows = pd.DataFrame({"code": [1] * 8 + [2] * 8, "vec_id": [7] * 8 + [7] * 6 + [8, 9], "v": [[1.0, 0.1 * j] for j in range(14)] + [[1.0, 2.0], [1.0, 3.0]]})
    asked = pd.DataFrame({"query_id": [1], "v": [[1.0, 0.0]], "codes": [[1, 2]]})
    got = ann._best(2)((0,), rows, asked)
    assert got["vec_id"].to_list() == [7, 8] and got["score"].to_list()[0] == 1.0


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 50)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.array([5, 1, 2, 3, 1, 1, 0, 2.0]) + rng.normal(size=8) * 0.01]) for i in range(400)] + [(400 + i, [float(x) for x in rng.normal(size=8)]) for i in range(100)]
    want, got = brute(rows, range(0, 500, 10)), found(spark, rows)
    assert set(got) == set(want) and np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_probes_fall_in_chance():
    rng = np.random.default_rng(5)
    p = ann.probes(rng.normal(size=4), rng.uniform(0, 2, 4), 0.6, 0.99)
    assert len(p) == len(set(p)) and len(p) > 3
    assert ann.probes(np.array([0.1, 0.2]), np.array([1.0, 1.0]), 0.999999, 0.9) == [(0, 0)]


# main text --------------------------------------------------------------------------------


def test_blocks():
    b = html_text.blocks("<html><head><title>no</title><script>var a='<p>x</p>';</script></head><body>a<b>b</b>c<p>one<p>two &amp; &lt;three&gt;<br>four<!-- <p>no</p> --><ul><li>x<li>y</ul><a title=\"a>b\" href=x>link</a></body>")
    assert [t for _, t, _ in b] == ["abc", "one", "two & <three>", "four", "x", "y", "link"]
    slots = {html_text._path_slot(t) for t in ("html", "body", "p", "last p")}
    assert set(np.flatnonzero(b[1][0])) == set(np.flatnonzero(b[2][0])) == slots and b[-1][2] == 1.0
    for cut in ("<p>a <b", "<p>a <!-- x", "<p>a <script>x", '<p>a <a href="x', "<", "</", "a < b"):
        assert html_text.blocks(cut)[0][1].startswith("a") if "a" in cut else [t for _, t, _ in html_text.blocks(cut)] == [cut]
    assert html_text.blocks(None) == [] == html_text.blocks("  ")
    assert len(html_text.blocks("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, "<a href='" * 110_000, "<a '\"> \" >" * 90_000, '<a "> ' * 160_000, "<a \">' " * 140_000, "<p>" + "<b>" * 200_000 + "<h1>" * 40_000, "<div>" * 90_000 + "</x>" * 90_000, "<div class='" + "a b " * 240_000 + "'>x"],
)
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - start < 8  # some 0.5 s; a scan from each tag took hours


def test_tag_ends():
    rng = random.Random(2)
    tag = re.compile(r"""<(?:(?:[^>"']|"[^"]*"|'[^']*')*)>|<[^>]*>""")
    for _ in range(3000):
        page = "<" + "".join(rng.choice(["<", ">", "'", '"', "a"]) for _ in range(rng.randint(1, 14)))
        tags, at = html_text._Tags(page), 0
        while (i := page.find("<", at)) >= 0:
            want = tag.match(page, i)
            assert tags.end(i + 1) == (want.end() - 1 if want else -1)
            at = want.end() if want else i + 1


def test_long_pages_are_labelled_in_steps(model, monkeypatch):
    page = "<nav><a>Menu</a></nav><article>" + "<p>Some words here.</p>" * 300 + "</article><footer>end</footer>"
    whole = html_text.extract([page], model)
    found = html_text.blocks(page)
    x, mask = html_text._batch([html_text.vectors(found)])
    monkeypatch.setattr(html_text, "STEPS", 64)
    assert np.abs(html_text._long(model, found) - html_text._forward(model, x, mask)[0][0]).max() < 1e-5
    assert html_text.extract([page], model) == whole


def brute_chances(model, found):
    """The network over one page, in plain loops."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    m = {k: v.astype(float) for k, v in model.items()}
    xs, h_of = [v.astype(float) for v in html_text.vectors(found)], {}
    n = html_text.HIDDEN
    for way, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
        h, c = [0.0] * n, [0.0] * n
        for t in order:
            a = [sum(xs[t][d] * m["w" + way][d, j] for d in np.flatnonzero(xs[t])) + sum(h[k] * m["u" + way][k, j] for k in range(n)) + m["b" + way][j] for j in range(4 * n)]
            c = [sig(a[n + j]) * c[j] + sig(a[j]) * math.tanh(a[3 * n + j]) for j in range(n)]
            h = [sig(a[2 * n + j]) * math.tanh(c[j]) for j in range(n)]
            h_of[way, t] = h
    return [sig(sum(v * o for v, o in zip([*h_of["f", t], *h_of["b", t], *xs[t]], m["o"], strict=True)) + m["ob"][0]) for t in range(len(xs))]


def test_labels_equal_plain_loops(model):
    rng = np.random.default_rng(17)
    pages = [html_text.synthetic_page(rng).translate(html_text._UNMARK) for _ in range(3)]
    for page, text in zip(pages, html_text.extract(pages, model), strict=True):
        found = html_text.blocks(page)
        assert text == " ".join(t for (_, t, _), y in zip(found, brute_chances(model, found), strict=True) if y >= 0.5)


def test_held_out_pages(model):
    rng = np.random.default_rng(99)
    wrong = total = 0
    for _ in range(120):
        found = html_text.blocks(html_text.synthetic_page(rng))
        y = np.array([html_text.MAIN in t for _, t, _ in found])
        x, mask = html_text._batch([html_text.vectors([(p, t.translate(html_text._UNMARK).strip() or "-", n) for p, t, n in found])])
        wrong += int(((html_text._forward(model, x, mask)[0][0] >= 0.5) != y).sum())
        total += len(y)
    assert wrong / total < 0.02


def test_pages(spark, model):
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head</h1><p>First  &amp;\n one.</p><p>Second.</p></article><div class="comments"><p>Nice!</p></div><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page, 0), (2, None, None, 0), (None, "u", "", 0), (1, "u", page, 0), (3, "u", "<p>a</p>" * 3000, 0)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    want = "Head First & one. Second."
    assert sorted((r["page_id"] or 0, r["url"], r["text"][:30], r["n_chars"]) for r in got if r["page_id"] != 3 and r["page_id"] != 2) == [(0, "u", "", 0), (1, "u", want, len(want)), (1, "u", want, len(want))]
    assert [r["n_chars"] for r in got if r["page_id"] == 3] == [5999] and [r["text"] for r in got if r["page_id"] == 2] == [""]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


# url filters ------------------------------------------------------------------------------


def verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for i, c in enumerate(rest + "/"):
            if c in "/?#":
                host, path = rest[:i], rest[i:]
                break
        for i, c in enumerate(path):
            if c in "?#":
                path = path[:i]
                break
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    labels = host.split(".")
    listed = any(".".join(labels[i:]) in url_filter.BLOCKLIST for i in range(len(labels)))
    best = max(fits, default=(0, None, "block" if listed else "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    rng = random.Random(0)
    hosts = ["Example.COM", "a.example.com", "xexample.com", "m.free-bets.example.net", "free-bets.example.net", "com", "net", "a.b.c.org", "ads-track.example.org", "notads-track.example.org", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/75?x", "/de/8", "/de/", "/es/#a", "/EN/", "?en", "#/en/", "/en"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no-scheme.com/en/", "://", "http://a://b/en/", "http://user@example.com:80/en/7"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[0], "x", "y"), (0, urls[0], "x", "y")], "page_id long, url string, host string, key string")
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect())
    want = collections.Counter((i, *verdict(u)) for i, u in [*enumerate(urls), (None, urls[0]), (0, urls[0])])
    assert got == want
    assert url_filter.judge(df.limit(0)).count() == 0


def test_listed_key_is_the_longest(spark):
    deep = "x." * 400 + "deep.example"
    urls = ["http://x.a.com/", "http://y.a.com", "http://b.x.a.com", f"http://{deep}/", "http://nothing.org", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = ["a.com", "x.a.com", "deep.example", "a.b.c.d.not.there"]
    want = ["x.a.com", "a.com", "x.a.com", "deep.example", None, None]
    for level in (url_filter.MAX_LEVEL_BYTES, 1):  # also in several segments
        got = url_filter.judge(rows, rules=(), blocklist=listed, max_level_bytes=level).orderBy("page_id").collect()
        assert [r["listed_key"] for r in got] == want and [r["verdict"] for r in got] == ["block" if k else "allow" for k in want]


def test_list_as_a_table(spark):
    """A list of any size, with other columns, repeats, upper case, nulls and empty names, in many segments."""
    rows = spark.range(400).selectExpr("id AS page_id", "concat('http://h', id % 97, '.d', id % 31, '.net/x') AS url")
    listed = spark.range(5000).selectExpr("concat(IF(id % 2 = 0, 'D', 'H'), id % 40, IF(id % 2 = 0, '', concat('.d', id % 29)), '.net') AS domain", "id AS key")
    listed = listed.unionByName(spark.createDataFrame([(None, 1), ("", 2)], "domain string, key long"))
    names = {r["domain"].lower() for r in listed.collect() if r["domain"]}
    want = {}
    for r in rows.collect():
        host = r["url"][7:-2]
        want[r["page_id"]] = next((k for k in (host, host.split(".", 1)[1], "net") if k in names), None)
    assert None in want.values() and len(set(want.values())) > 20
    for level in (url_filter.MAX_LEVEL_BYTES, 64):
        got = {r["page_id"]: r["listed_key"] for r in url_filter.judge(rows, rules=(), blocklist=listed, max_level_bytes=level).collect()}
        assert got == want


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(url_filter, "PROBES", 1)
    keys = spark.range(3000).selectExpr("CAST(id AS STRING) AS key")
    levels = url_filter.build_cascade(keys, keys.filter("key % 7 = 0"))
    assert len(levels) > 2
    assert keys.filter(url_filter.is_listed(F.col("key"), levels) != (F.col("key") % 7 == 0)).count() == 0
    assert url_filter.build_cascade(keys, keys.limit(0)) == []
