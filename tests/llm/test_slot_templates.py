"""Operator 8: what the host's template decides on the driver's pages and on pages without it."""

from pyspark.sql import functions as F

from skeinlog.llm import template_slots as T


def texts(pages):
    return {r.page_id: r.text for r in T.extracted(pages).collect()}


def test_template_stands_in_for_article_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = {r.page_id: r.host for r in pages.select("page_id", T.host_of(F.col("url")).alias("host")).collect()}
    many = {k for k, h in host.items() if sum(x == h for x in host.values()) >= 3}
    whole = texts(pages)
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    got = texts(bare)
    alone = {r.page_id: T.main_text(r.html) for r in bare.collect()}
    assert len(many) > 200
    assert all(got[k] == whole[k] for k in many)
    # without the template the adverts would stay
    assert all(alone[k] != whole[k] for k in many)


def test_names_of_classes_decide_nothing():
    assert T.main_text('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>') == "Title Body"
    assert T.main_text('<article><div class="share-of-market">Body text</div></article>') == "Body text"
    assert T.main_text('<main><p>One</p><section id="related-work"><h2>Related work</h2><p>Two</p></section></main>') == "One Related work Two"
    assert T.main_text("<article><p>Text</p><article><p>A reader</p></article></article>") == "Text"


def test_repeated_pages_add_up_and_do_not_cancel(spark):
    page = lambda body: f"<html><body><article>{body}</article></body></html>"
    d, e = page("<p>Dd</p><i>x</i>"), page("<p>Ee</p><b>y</b>")
    rows = [(1, "http://h/1", page("<i>x</i><b>y</b><p>One</p>")), (2, "http://h/2", page("<i>x</i><b>y</b><p>Two</p>"))] + [(3, "http://h/3", d)] * 2 + [(4, "http://h/4", e)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sizes = spark.createDataFrame([("h", 6)], "host string, n_pages long")
    found = T.classes(T.token_counts_by_page(pages, "page_id", "url", "html"), sizes).collect()
    groups = [{m.token for m in c.members} for c in found if c.support == 4 and c.total == 4]
    assert len(groups) == 2 and not groups[0] & groups[1]


def test_slots_beside_and_around_the_main_box(spark):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = []
    for i in range(6):
        rows.append((i, f"http://a/{i}", f'<body><div class="promo">Buy {words(i, 3)}</div><div class="top"><h1>Head {i}</h1></div><div id="text"><p>{words(i, 60)}</p><p>Read on</p></div><div class="says"><p>{words(i + 50, 20)}</p></div></body>'))
    got = texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got == {i: f"Head {i} {words(i, 60)}" for i in range(6)}


def test_stray_and_open_tags_stay_linear():
    import time

    page = lambda n: "<span>" * n + "</b>" * n + "<p>x" * n + '<a "' * n
    began = time.time()
    T.main_text(page(2000))
    small, began = time.time() - began, time.time()
    T.main_text(page(8000))
    assert time.time() - began < 12 * small + 0.5
