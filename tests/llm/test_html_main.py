import random
from collections import Counter

from sparkeda.llm import html_main as h
from sparkeda.llm.html_main import Page

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="has-sidebar">
<div id="header"><a href=/>Home</a></div><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   para&nbsp;one<p>Second <b>bold &#39;q&#39;<br>more</p>
<div class="ad-slot">Buy</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form>Sign</form><pre>x  y</pre></article>
<section class="comments"><div class="comment">a reader</div></section></main><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_main_text():
    assert Page(FULL).text() == "Title & more\nFirst para one\nSecond bold 'q' more\none\ntwo\nc1\nc2\nx y"


def test_broken_pages():
    assert Page("").text() == ""
    assert Page("plain &lt; only").text() == "plain < only"
    assert Page("<p>a<p>b").text() == "a\nb"
    assert Page("<article><p>end &am").text() == "end &am"
    assert Page("<article><p>end<a href='x").text() == "end"
    assert Page("<article><p>x<script>never closed").text() == "x"
    assert Page("<div><!-- open comment").text() == ""
    assert Page("</p></div></article>text").text() == "text"
    assert Page("<div>" * 3000 + "deep").text() == "deep"
    assert Page("a < b and 3 > 2").text() == "a < b and 3 > 2"
    assert Page("<article><p hidden>no</p><p>yes</article>").text() == "yes"


def page(kind, words, extra=""):
    rng = random.Random(words)
    body = "".join(f"<p>{' '.join(rng.choice(('alpha', 'beta', 'gamma')) for _ in range(30))}</p>" for _ in range(words))
    return f'<body><div class="x-bar-{words}">{extra}</div><div class="{kind} id-{words}"><h1>Head {words}</h1>{body}</div></body>'


def rows(spark, found):
    return spark.createDataFrame([(*r, "n", 1, "p", 2) for r in found],
                                 "page_id long, url string, html string, path string, votes int, host string, score int")


def test_host_decides_for_its_pages(spark):
    noise = " ".join(["noise"] * 40)
    found = [(i, f"http://u@A.example.com:80/{i}", page("post", 4 + i)) for i in range(5)]
    found.append((9, "https://a.example.com/9", page("post", 2, noise)))
    paths = {r.host: r.path for r in h.host_paths(h._hosted(rows(spark, found), "page_id", "url", "html")).collect()}
    assert paths == {"a.example.com": "html>body>div.id-0.post"}
    got = {r.page_id: r.text for r in h.extract(rows(spark, found)).collect()}
    assert all("noise" not in t and t.startswith("Head") for t in got.values())
    assert Page(found[-1][2]).text().startswith("noise")            # alone, the page would keep it


def test_two_layouts_on_one_host(spark):
    body = lambda word, k: "".join(f"<p>{' '.join([word] * 30)}</p>" for _ in range(k))
    found = [(i, "http://two.example/x", f"<body><article>{body('plain', 5)}</article></body>") for i in range(4)]
    for i, tag in ((8, "section"), (9, "div")):
        found.append((i, "http://two.example/y", f"<body><article>{body('first', 7)}</article><{tag}>{body('second', 3)}</{tag}></body>"))
    got = {r.page_id: Counter(r.text.split()) for r in h.extract(rows(spark, found)).collect()}
    assert got[0] == {"plain": 150} and got[8] == got[9] == {"first": 210, "second": 90}


def test_page_without_the_winning_path(spark):
    found = [(i, "http://h.example/x", page("post", 3)) for i in range(3)] + [(7, "http://h.example/y", "<body><p>Other one</p></body>")]
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(rows(spark, found)).collect()}
    assert got[7] == ("Other one", 9)


def test_many_hosts_are_joined(spark, monkeypatch):
    monkeypatch.setattr(h, "HOSTS_TO_ALL", 0)
    found = [(i, f"http://h{i % 3}.example/x", page("post", 2)) for i in range(6)]
    assert len({r.text for r in h.extract(rows(spark, found)).collect()}) == 1


def test_odd_rows(spark):
    found = [(1, None, None), (2, "", ""), (2, "", ""), (None, "no url", FULL), (4, "http://x.example", "<p>" + "word " * 200_000)]
    got = h.extract(rows(spark, found)).collect()
    assert len(got) == 5
    assert {r.n_chars for r in got} == {0, len(Page(FULL).text()), 999_999}
    assert h.extract(rows(spark, found).limit(0)).count() == 0


def test_all_given_pages_keep_their_article(spark):
    """The article of the given pages stands between two tags; all else on them is to go."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    for r in pages.collect():
        inside = re.sub(r"<[^>]*$", "", r.html.split("<article>", 1)[1].split("</article>")[0])
        blocks = [re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
