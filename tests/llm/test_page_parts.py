"""What belongs to the main text of a page, and what the templates of a host change."""

import time

import pytest

from restomart.llm.html import PageReader, extract_main_text

LONG = "A paragraph of running text about the kitchen, its dishes and the people who cook them. " * 4


def text(page):
    return PageReader().read(page).text()


@pytest.mark.parametrize("page,want", [
    (f"<body><div class='content'><p>{LONG}</p></div><article class='teaser'>Read more</article></body>", f"{LONG.strip()} Read more"),
    (f"<article><p>{LONG}</p><div class='menu'><p>Soup</p><p>Pie</p></div></article>", f"{LONG.strip()} Soup Pie"),
    (f"<article><p>{LONG}</p><section class='notices'><p>Closed on Monday</p></section></article>", f"{LONG.strip()} Closed on Monday"),
    (f"<body><div class='menu'><a>Home</a></div><article><p>{LONG}</p></article></body>", LONG.strip()),
    *[(f"<article><p>{LONG}</p><div class='{name}'><p>{'Nice place! ' * 9}</p></div></article>", LONG.strip())
      for name in ("article-comments", "user-comments", "post-comments", "sponsored-content", "related-posts", "comments")],
    *[(f"<div class='{name}'><article><p>{LONG}</p></article></div>", LONG.strip())
      for name in ("content with-sidebar", "has-sidebar", "comments-open")],
    (f"<article class='post comments-open'><p>{LONG}</p></article>", LONG.strip()),
    (f"<main><p>{LONG}</p></main><div>Small print</div>", LONG.strip()),
    ("<p>One</p><div>Two</div>", "One Two"),
])
def test_parts_of_a_page(page, want):
    assert text(page) == want


def pages(spark, bodies, host="menus.example.com"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", html) for i, html in enumerate(bodies)],
                                 "page_id long, url string, html string").repartition(3)


def with_and_without(spark, bodies):
    given = pages(spark, bodies)
    read = lambda **o: {r["page_id"]: r["text"] for r in extract_main_text(given, **o).collect()}
    return read(), read(min_pages=10 ** 9)


def test_templates_decide_outside_and_inside_articles(spark):
    box = "<div><p>Open daily from nine, call us for a table, ask for the vegetarian dishes of the season.</p></div>"
    own = [f"Page {i} tells of dish {i}. " * 5 for i in range(8)]
    got, plain = with_and_without(spark, [f"<body>{box}<div><p>{t}</p></div></body>" for t in own])
    assert list(got.values()) != list(plain.values()) and got == {i: t.strip() for i, t in enumerate(own)}
    marked = box.replace("<div>", "<div class='hours'>")
    got, plain = with_and_without(spark, [f"<article><p>{t}</p>{marked}</article>" for t in own])
    assert got == {i: t.strip() for i, t in enumerate(own)} and all("Open daily" in t for t in plain.values())
    # A box longer than the article: only without it the article is most of the page.
    got, plain = with_and_without(spark, [f"<body>{box * 3}<article><p>Dish {i}</p></article></body>" for i in range(8)])
    assert got == {i: f"Dish {i}" for i in range(8)} and all(t.startswith("Open daily") for t in plain.values())


def test_templates_do_not_depend_on_the_size_of_the_host(spark):
    box = "<div><p>On six pages of this host only, whatever the number of the others may be.</p></div>"
    bodies = [f"<body>{box if i < 6 else ''}<div><p>Page {i} and nothing else, {i} times.</p></div></body>" for i in range(400)]
    found = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, bodies)).collect()}
    assert all(t == f"Page {i} and nothing else, {i} times." for i, t in found.items())


def test_deep_and_torn_pages_take_linear_time():
    begun = time.perf_counter()
    text("<div>" * 20_000 + "deep" + "</span>" * 20_000 + "</div>" * 100)
    text("<ul><li>" * 10_000 + "<p>x" * 10_000 + "</b>" * 10_000)
    text("<body>" * 20_000 + "x")
    assert time.perf_counter() - begun < 10
