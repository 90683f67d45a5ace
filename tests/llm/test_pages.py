"""Page extraction and URL filters."""

import pytest

from wardtable.llm import html, urls

PAGES = "page_id bigint, url string, html string, host string, _id bigint, text string"


@pytest.fixture(scope="module")
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "clash", 1, "clash") for i, u, h in rows], PAGES)


def test_article_lines():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav>"
        "<div class='ad'>Buy</div><article><header><h1>Title &amp; more</h1></header><p><b>One\n two<br><p>Three &lt;x&gt;"
        "<aside>Side</aside><ul><li>a<li>b</ul><div class='comments'><p>Reader</p></div><!-- no --></article>"
        "<footer>&copy;</footer>"
    )
    assert html.main_text(page) == "Title & more\nOne two\nThree <x>\na\nb"
    assert html.main_text("") == "" and html.main_text("<article>open <b>end") == "open end"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    import random

    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.choice("abcde") for _ in range(draw.randrange(12))] for _ in "xy")
        found = sorted(html.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in found)


def test_differencing_removes_the_template(pages):
    def page(body):
        return f"<html><body><div>Site name</div><p>{body}</p><div>All rights</div></body></html>"

    rows = [
        (1, "http://a.org/en/1", page("First")), (2, "http://a.org/en/2", page("Second")),
        (3, "http://a.org/de/3", page("Drittes").replace("Site name", "Seite")), (4, "http://b.org/x", page("Alone")),
        (5, None, None), (6, "http://a.org/en/1", ""), (7, "http://c.org/", "<main><p>Kept</p></main>"),
        (7, "http://c.org/", "<main><p>Kept</p></main>"),
    ]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extraction_report(pages(rows)).collect()]
    want = [
        (1, "First", 5), (2, "Second", 6), (3, "Seite\nDrittes", 13), (4, "Site name\nAlone\nAll rights", 26), (5, "", 0),
        (6, "", 0), (7, "Kept", 4), (7, "Kept", 4),
    ]
    assert sorted(got) == want
    assert html.extraction_report(pages([])).count() == 0


def test_pages_with_an_article_are_differenced_too(pages):
    def page(body):
        return f"<html><body><div>Site</div><article><p>Lead</p><p>{body}</p></article><div>Rights</div></body></html>"

    rows = [
        (1, "http://a.org/x/1", page("First")), (2, "http://a.org/x/2", page("Second")), (3, "http://a.org/x/3", "<div>Site</div><p>Plain</p>"),
        (4, "http://a.org/x/4", "<div>Site</div><p>Other</p>"), (5, "http://b.org/", page("Alone")),
    ]
    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_kept"]) for r in html.extraction_report(pages(rows)).collect()}
    assert got == {
        1: ("Lead\nFirst", 3, 1), 2: ("Lead\nSecond", 3, 1), 3: ("Plain", 1, 0), 4: ("Other", 1, 0), 5: ("Lead\nAlone", 0, 0),
    }


def test_lines_of_its_own_outside_an_article_stay(pages):
    """Differencing decides on the open lines of a page that marks an article, too."""

    def page(i):
        return f"<body><div>Site</div><h1>Title {i}</h1><article><p>Lead</p><p>Body {i}</p></article><div class='ad'>Buy {i}</div><div>Rights</div></body>"

    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_kept"]) for r in html.extraction_report(pages([(i, f"http://a.org/{i}", page(i)) for i in (1, 2)])).collect()}
    assert got == {i: (f"Title {i}\nLead\nBody {i}", 3, 1) for i in (1, 2)}


def link(*hosts):
    return "".join(f'<a class="x" href="https://{h}/p?q">l</a> <a href="/local">m</a>' for h in hosts)


RULES = (("allow", "good.org", "/"), ("block", "bad.com", "/"), ("block", "good.org", "/ads/"))


def plain_scores(graph, trust, distrust, rounds=400):
    def run(seeds, arcs):
        score = {h: (1 - urls.DAMPING) * seeds.get(h, 0) for h in graph}
        now = dict(score)
        for _ in range(rounds):
            new = {h: 0.0 for h in graph}
            for a, outs in arcs.items():
                for b, w in outs.items():
                    new[b] += urls.DAMPING * now[a] * w / sum(outs.values())
            now = new
            score = {h: score[h] + now[h] for h in graph}
        return score

    back = {h: {a: outs[h] for a, outs in graph.items() if h in outs} for h in graph}
    return run(trust, graph), run(distrust, back)


def test_verdicts_follow_links(pages, spark):
    rows = [
        (1, "http://GOOD.org/a", link("friend.net", "friend.net", "mixed.net")), (2, "http://sub.good.org/ads/x", link("bad.com")),
        (3, "http://spam.net/", link("bad.com", "bad.com", "bad.com", "mixed.net")), (4, "http://bad.com/z", link("spam.net")),
        (5, "http://friend.net/q#f", link("mixed.net")), (6, "http://mixed.net/m", link("bad.com", "friend.net")),
        (7, None, None), (8, "nothing", ""), (9, "http://alone.net", ""), (4, "http://bad.com/z", link("spam.net")),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages(rows), RULES).collect()}
    assert got[1] == ("good.org", "/a", "good.org/", "allow")
    assert got[2] == ("sub.good.org", "/ads/x", "good.org/ads/", "block")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == ("alone.net", "", None, "allow")
    graph = {
        "good.org": {"friend.net": 2, "mixed.net": 1}, "sub.good.org": {"bad.com": 1}, "spam.net": {"bad.com": 3, "mixed.net": 1},
        "bad.com": {"spam.net": 2}, "friend.net": {"mixed.net": 1}, "mixed.net": {"bad.com": 1, "friend.net": 1},
    }
    trust, distrust = plain_scores(graph, {"good.org": 1}, {"bad.com": 2, "sub.good.org": 1})
    for page, host in ((3, "spam.net"), (4, "bad.com"), (5, "friend.net"), (6, "mixed.net")):
        assert got[page][3] == ("block" if page == 4 or distrust[host] > trust[host] else "allow")
    arcs = spark.createDataFrame([(a, b, n) for a, outs in graph.items() for b, n in outs.items()], "source string, target string, n bigint")
    seeds = spark.createDataFrame([("good.org", 1.0, 0.0), ("bad.com", 0.0, 2.0), ("sub.good.org", 0.0, 1.0)], "host string, trust double, distrust double")
    for r in urls.spread(arcs, seeds).collect():
        assert r["trust"] == pytest.approx(trust[r["host"]], abs=5e-3)
        assert r["distrust"] == pytest.approx(distrust[r["host"]], abs=5e-3)
    assert urls.judge_urls(pages([]), RULES).count() == 0


def test_verdicts_do_not_hang_on_seeds_elsewhere(pages, spark):
    """A small blocked seed at the end of a chain, beside a large trusted host without links."""
    chain = [(f"h{i}.net", f"h{i + 1}.net", 1) for i in range(12)]
    arcs = spark.createDataFrame([*chain, ("good.org", "h3.net", 1)], "source string, target string, n bigint")
    seeds = spark.createDataFrame([("big.org", 1e6, 0.0), ("good.org", 1e-3, 0.0), ("h12.net", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.spread(arcs, seeds).collect()}
    assert got["big.org"] == (pytest.approx(1.5e5), 0.0)
    for i in range(13):
        trust = 0.15e-3 * urls.DAMPING ** (i - 2) if i >= 3 else 0.0
        share = 0.5 if i < 3 else 1.0  # two links lead to h3
        assert got[f"h{i}.net"] == (pytest.approx(trust), pytest.approx(share * 0.15 * urls.DAMPING ** (12 - i)))


def test_article_marks_elsewhere_leave_pages_to_differencing(pages):
    def page(body):
        return f"<html><!-- <main> --><body><div>Site</div><div><p>{body}</p><article class='comment'><p>Reader</p></article></div></body></html>"

    rows = [(1, "http://a.org/1", page("First")), (2, "http://a.org/2", page("Second")), (3, "http://a.org/3", "<div role='main'><p>Kept</p></div>")]
    got = {r["page_id"]: r["text"] for r in html.extraction_report(pages(rows)).collect()}
    assert got == {1: "First", 2: "Second", 3: "Kept"}


def test_sections_of_articles_stay():
    sections = ["naval-battles", "cookies", "social-history", "related-work", "promotion", "notice-of-award"]
    page = "".join(f"<section id='{n}' class='{n}'><h2 id='related'>{n}</h2><p>t</p></section>" for n in sections)
    around = "".join(f"<div class='{n}'>gone</div>" for n in ["site-footer", "x main-nav", "cookie-banner", "ad", "social_links", "comment-12"])
    assert html.main_text(f"<article>{page}{around}</article>") == "\n".join(f"{n}\nt" for n in sections)
