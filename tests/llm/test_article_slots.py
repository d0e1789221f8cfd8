"""Operator 8: the template decides within articles."""

from skeinlog.llm import template_slots
from tests.llm.test_rows import page


def test_furniture_within_articles_goes_and_copied_articles_stay(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<nav>Menu</nav><article><h1>Head {i}</h1><p>Report {i} has words of its own</p><div>Join our letter</div></article>")) for i in range(6)]
    copy = page("<article><h1>One head</h1><p>The same words everywhere</p></article>")
    rows += [(10 + i, f"http://copies.example/{i}", copy) for i in range(4)]
    # two pages of three are too few to call a text of theirs furniture
    rows += [(20 + i, f"http://few.example/{i}", page(f"<article><h1>H{i}</h1><p>Long text number {i} of this site</p>{'<b>again</b><i>too</i>' if i else ''}</article>")) for i in range(3)]
    got = {r.page_id: r.text for r in template_slots.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head {i} Report {i} has words of its own" for i in range(6))
    assert all(got[10 + i] == "One head The same words everywhere" for i in range(4))
    assert [got[20 + i] for i in range(3)] == [f"H{i} Long text number {i} of this site" + (" againtoo" if i else "") for i in range(3)]
