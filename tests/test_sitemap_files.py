"""Sitemap files on disk to addresses in order."""

from tracewell.operators import knowledge
from tracewell.sources import docs

NS = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def urlset(*locs):
    return f"<?xml version='1.0'?><urlset {NS}>" + "".join(f"<url>{x}</url>" for x in locs) + "</urlset>"


def loc(x):
    return f"<loc>{x}</loc>"


def test_order_and_what_gives_no_row(spark, tmp_path):
    at = "https://h.example/maps"
    names = ["b.xml", "gone.xml", "a.xml?x=1", "broken.xml", "b.xml", "one.xml", "empty.xml"]
    index = "".join(f"<sitemap><loc> {at}/{n}\n</loc></sitemap>" for n in names) + "<sitemap></sitemap>"
    write(tmp_path / "index" / "sitemap.xml", f"<sitemapindex {NS}>{index}</sitemapindex>")
    write(tmp_path / "index" / "zz.xml", f"<sitemapindex {NS}><sitemap><loc>{at}/last.xml</loc></sitemap></sitemapindex>")
    children = tmp_path / "children"
    write(children / "a.xml", urlset(loc("https://d/1"), loc(" https://d/2&amp;x\n"), loc("https://blog/3")))
    write(children / "b.xml", urlset("", loc(" "), loc("https://d/4"), "<priority>1</priority>", loc("https://d/1")))
    write(children / "broken.xml", urlset(loc("https://d/9")) + "</oops>")
    write(children / "one.xml", urlset(loc("https://d/5")))
    write(children / "empty.xml", "")
    write(children / "unnamed.xml", urlset(loc("https://d/8")))
    write(children / "deeper" / "last.xml", urlset(loc("https://d/6")))
    found = docs.read_sitemap_tree(spark, str(tmp_path / "index"), str(children))
    assert sorted(map(tuple, found.collect())) == [
        (0, 2, "https://d/4"),
        (0, 4, "https://d/1"),
        (2, 0, "https://d/1"),
        (2, 1, "https://d/2&x"),
        (2, 2, "https://blog/3"),
        (5, 0, "https://d/5"),
        (7, 0, "https://d/6"),
    ]
    urls = docs.ordered_urls(knowledge.discover_urls(found, ["https://d/"]))
    order = [(r.position, r.url) for r in urls.orderBy("position").collect()]
    assert order == [(i, f"https://d/{x}") for i, x in enumerate(["4", "1", "2&x", "5", "6"], 1)]
    capped = knowledge.discover_urls(found, ["https://d/"], max_urls=3)
    assert {r.url for r in capped.collect()} == {"https://d/4", "https://d/1"}


def test_broken_index_names_nothing(spark, tmp_path):
    write(tmp_path / "index.xml", "no xml at all")
    write(tmp_path / "children" / "a.xml", urlset(loc("https://d/1")))
    found = docs.read_sitemap_tree(spark, str(tmp_path / "index.xml"), str(tmp_path / "children"))
    assert found.collect() == []
