"""Main text and archives of pages, and nearest vectors."""

import base64
import hashlib
import os
import random

import numpy as np
from pyspark.sql import functions as F

from restomart.llm.html import PageReader, extract_main_text, template_subtrees
from restomart.llm.nearest import MultiIndex, hamming, learn_codes, nearest_vectors
from restomart.llm.warc import MAX_GAP, coalesced, parse_record, read_records, write_archives
from restomart.session import shared_path

SCHEMA = "page_id long, url string, html string, host string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


def site(body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li>Home</li><li>Menu</li></ul></nav>{extra}{body}<footer>&copy; us</footer></body></html>")


def text_of(html, templates=frozenset()):
    return PageReader(templates).read(html).text()


def test_articles_lose_everything_around_them():
    body = ("<article><h1>Soup &amp; Salad</h1><p><b>First<br>line <i>of</i>\n\t text.<p>Second&nbsp;one &lt;b&gt; &amp</p>"
            "<div class='ad'>buy</div><aside>side</aside><form>mail<input></form><div id=comments><p>nice</p></div>"
            "<script>x()</script></article>")
    assert text_of(site(body, "<div class='cookie-notice'>ok?</div><!-- no -->")) == (
        "Soup & Salad First line of text. Second one <b> &")


def test_layout_names_keep_the_main_text():
    for opened, closed in (("<div class='content with-sidebar'>", "</div>"), ("<div id='no-sidebar'>", "</div>"),
                           ("<main class='has-sidebar'>", "</main>"), ("<article class='post comments-open'>", "</article>"),
                           ("<article class='category-social'>", "</article>"), ("<main class=menu>", "</main>"),
                           ("<div class=sidebar><main>", "</main></div>"), ("<div class=widget><article>", "</article></div>"),
                           ("<body class=sidebar>", "")):
        assert text_of(site(f"{opened}<p>kept text</p>{closed}")) == "kept text", opened
    for name in ("ad", "sidebar", "cookie-notice", "share-buttons", "related posts", "sidebar_widget", "newsletter-form"):
        assert text_of(site(f"<div><p>kept</p></div><div class='{name}'>gone</div>")) == "kept", name
    comments = "<div id=comments><article class=comment>nice</article></div><article class=comment>too</article>"
    assert text_of(site(f"<article>kept</article>{comments}")) == "kept"


def test_heads_may_be_left_open():
    for start in ("<html><head><title>T</title><body><p>a", "<head><meta charset=utf-8><title>T</title><p>a",
                  "<head><title>T</title><script>x()</script>a", "<head><noscript><style>p{}</style><body><div>a"):
        assert text_of(start) == "a", start
    assert text_of("<head><title>T</title></head><body>a</body>") == "a"


def test_broken_and_empty_pages():
    assert text_of("") == "" and text_of("<") == "<" and text_of("plain  text") == "plain text"
    assert text_of("<article><p>cut in the mid") == "cut in the mid"
    assert text_of("<article><p>a</div></p></article></article> tail") == "a"
    assert text_of("<div>" * 3_000 + "deep") == "deep"
    assert text_of("<main><p>a<p>b</main><p>c") == "a b"
    assert text_of("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"


def test_templates_of_a_host_go(spark):
    box = "<div><p>Follow our kitchen</p></div>"
    rows = [(i, f"https://a.example/{i}", site(f"<div><p>text {i}</p></div>", box)) for i in range(6)]
    rows += [(10 + i, f"https://b.example/{i}", site("<div><p>same page</p></div>", box)) for i in range(6)]
    rows += [(20, "https://a.example/x", site(f"<article><p>Shared passage</p><section class=promo2>{box}</section></article>"))]
    found = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows), min_pages=5).collect()}
    assert [found[i] for i in range(6)] == [f"text {i}" for i in range(6)]
    assert found[10] == "Follow our kitchen same page"  # copies of one page are no template
    assert found[20] == "Shared passage"
    hosts = {r["host"] for r in template_subtrees(pages(spark, rows), 5).collect()}
    assert hosts == {"a.example"}


def test_shared_passages_of_articles_stay(spark):
    rows = [(i, "https://a.example/", site(f"<article><h1>N{i}</h1><p>the same passage</p></article>")) for i in range(12)]
    found = extract_main_text(pages(spark, rows)).collect()
    assert {r["text"] for r in found} == {f"N{i} the same passage" for i in range(12)}


AWKWARD = [(1, None, None), (2, "x", ""), (3, "https://u:p@H.example:8/a b\r\n", "<p>é 🙂</p>"), (3, "https://u:p@H.example:8/a b\r\n", "<p>é 🙂</p>"),
           (None, "https://c.example", "<p>null id</p>"), (5, None, "word " * 50_000), (None, None, "<p>é 🙂</p>"), (7, "y", None)]


def test_text_of_awkward_pages(spark):
    found = extract_main_text(pages(spark, AWKWARD))
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == len(AWKWARD)
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())
    assert {r["text"] for r in found.filter("page_id in (1, 2, 7)").collect()} == {""}
    assert extract_main_text(pages(spark, [])).count() == 0


def test_archive_round_trip(spark):
    rows = AWKWARD + [(100 + i, f"https://d.example/{i}", f"<p>{i % 4}</p>") for i in range(20)]
    root = shared_path(spark, "warc-test")
    index = write_archives(pages(spark, rows), root=root)
    got = sorted((tuple(r) for r in read_records(index, root).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        lead = first.get(h or "")
        revisit = lead is not None and i != lead
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i, len(payload), digest, "revisit" if revisit else "response", lead if revisit else None,
                     None if revisit else bytearray(payload)))
    assert got == sorted(want, key=str)
    some = index.filter("page_id % 3 = 0")
    assert read_records(some, root).count() == some.count()
    assert write_archives(pages(spark, [])).count() == 0


def test_records_are_standard_archives(spark):
    root = shared_path(spark, "warc-test")
    row = write_archives(pages(spark, [(1, "https://a.example/x y", "<p>a</p>")]), root=root).first()
    with open(row["archive"], "rb") as file:
        data = file.read()
    assert len(data) == row["length"] and os.path.basename(row["archive"]).endswith(".warc.gz")
    fields, block = parse_record(data)
    assert fields["WARC-Target-URI"] == "https://a.example/x%20y" and fields["WARC-Record-ID"].startswith("<urn:uuid:")
    assert block == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>a</p>"


def test_small_payloads_never_revisit(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    root = shared_path(spark, "warc-test")
    kinds = read_records(write_archives(pages(spark, rows), 4, root), root).select("page_id", "record_type", "refers_to")
    assert sorted(map(tuple, kinds.collect())) == [(1, "response", None), (2, "response", None), (3, "response", None),
                                                   (4, "revisit", 3)]


def test_reads_are_coalesced():
    ranges = [(0, 10), (10, 5), (15, 5), (20 + MAX_GAP, 5), (26 + 2 * MAX_GAP, 3)]
    assert list(coalesced(ranges)) == [(0, 25 + MAX_GAP, ranges[:4]), (26 + 2 * MAX_GAP, 29 + 2 * MAX_GAP, ranges[4:])]
    assert list(coalesced([])) == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in rows],
                                 "id long, vector array<float>, shard string, rank int")


def exact(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q))
        out += [(q, r, i) for r, (_, i) in enumerate(scores[:k], 1)]
    return out


def clustered(n, size=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, size))
    return [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_recall_of_nearest_vectors(spark):
    rows = clustered(1_500)
    queries = [r for r in rows if r[0] % 20 == 0]
    found = nearest_vectors(vectors(spark, rows), vectors(spark, queries), k=10).collect()
    want = set((q, i) for q, _, i in exact(rows, queries, 10))
    assert len({(r["query_id"], r["id"]) for r in found} & want) >= 0.9 * len(want)
    assert len(found) == 10 * len(queries)
    value = dict(rows)
    for r in found[:200]:
        assert abs(r["score"] - np.dot(np.float64(value[r["query_id"]]), np.float64(value[r["id"]]))) < 1e-12


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    index = MultiIndex(codes)
    for radius in (0, 5, 13, 22, 29):
        for code in codes[:15]:
            found = index.within(code[None], np.array([radius]))
            assert found[0].tolist() == (hamming(codes, code) <= radius).tolist()
    few = learn_codes(rng.normal(size=(5, 3)), 20)
    assert few.encode(np.zeros((1, 3))).shape == (1, 1)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.5]), (8, [1.0, 0.0])]
    bad = [(5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    found = nearest_vectors(vectors(spark, good + bad), vectors(spark, good + bad), k=4)
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect())
    assert got == sorted(exact(good, dict(good).items(), 4))
    assert nearest_vectors(vectors(spark, []), vectors(spark, good)).count() == 0
    assert nearest_vectors(vectors(spark, good), vectors(spark, [])).count() == 0
    assert nearest_vectors(vectors(spark, [(1, [1.0, 2.0])]), vectors(spark, [(1, [1.0, 2.0])])).count() == 0


def test_ties_of_a_hot_vector_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in random.Random(1).sample(range(1_000), 300)] + [(2_000, [0.9, 0.1, 0.5])]
    found = nearest_vectors(vectors(spark, rows), vectors(spark, rows[:3]), k=20)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect()) == sorted(exact(rows, rows[:3], 20))
    assert found.filter(F.col("query_id") == F.col("id")).isEmpty()
