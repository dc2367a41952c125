"""Words of doubt in an article: the site's tree decides, where it has seen enough."""

from hydrolith.llm import extract


def html(k, inside):
    return f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title {k}</h1><p>Text {k} of the page and more of it.</p>{inside}</article><footer>Foot</footer></body></html>"


def texts(spark, pages):
    df = spark.createDataFrame([(k, f"http://{h}/p{k}", x) for k, (h, x) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract.extract(df).collect()}


def test_parts_of_an_article_stay(spark):
    """Thirty pages, each with its own discussion, dishes and promotions, but the same
    sharing line, and with comments, a form and an aside of its own."""
    own = lambda k: (
        f"<section class='discussion'><h2>Discussion</h2><p>We discuss result {k}.</p></section><div class='menu'><p>Soup of day {k}.</p></div><div id='promotion'><p>Promoted in year {k}.</p></div>"
        f"<div class='share'><p>Share this</p></div><div id='comments'><p>Reader {k} says no.</p></div><form><p>Form {k}</p></form><aside><p>Aside {k}</p></aside>"
    )
    got = texts(spark, [("one.example", html(k, own(k))) for k in range(30)])
    for k in range(30):
        lines = got[k].split("\n")
        assert f"We discuss result {k}." in lines and f"Soup of day {k}." in lines and f"Promoted in year {k}." in lines and f"Text {k} of the page and more of it." in lines
        assert not {"Share this", f"Reader {k} says no.", f"Form {k}", f"Aside {k}", "Home", "Foot"} & set(lines)


def test_without_evidence_the_name_stands(spark):
    """Two pages of a host, and a menu outside the article on many."""
    got = texts(spark, [("few.example", html(k, f"<div class='discussion'><p>Talk {k}</p></div>")) for k in range(2)] + [("many.example", f"<div class='menu'><p>Dish {k}</p></div>" + html(k, "")) for k in range(2, 12)])
    assert not any("Talk" in x or "Dish" in x for x in got.values())


def test_the_same_everywhere_goes(spark):
    got = texts(spark, [("same.example", html(k, "<div class='promotion'><p>Buy now</p></div>")) for k in range(10)])
    assert not any("Buy now" in x for x in got.values()) and all(f"Text {k}" in got[k] for k in range(10))
