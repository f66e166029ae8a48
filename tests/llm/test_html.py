import re
import time
from html import escape, unescape
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from lenscape.llm import html_template as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li>Home<li>More</ul></nav><div class="cookie-notice">We use</div>
<article><h1>Big &amp; small</h1><p>One <b>tw</b>o&nbsp;three<br>four<p>Five<!-- hidden --> six
<aside>Side</aside><form>Name <input></form><p>Seven<div class="ad">Buy</div></article>
<section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; me</footer></body></html>"""


def text(page, region=None, tags=frozenset(), texts=frozenset()):
    return " ".join(t for _, t in h.slots(page, region, tags, texts))


def test_main_text():
    assert text(PAGE) == "Big & small One two three four Five six Seven"


def test_edges():
    assert text(None) == text("") == text("  ") == ""
    assert text("just text & more &lt;") == "just text & more <"
    assert text("a < b <p>c") == "a < b c"
    assert text("<!-- open") == "" and text("<script>x") == "" and text("<p>a</p") == "a"
    assert text("<article>") == ""
    assert text("<article><p>" + "word " * 50000 + "</article>") == ("word " * 50000).strip()
    assert text("<ARTICLE CLASS=x>Up</ARTICLE>") == "Up"


def pages(n, article=True, host="a.example"):
    tag = "article" if article else "div"
    return [
        f"<html><head><title>t{i}</title></head><body><div class='top'>Welcome to us</div><{tag}><h1>Head {i}</h1>"
        + "".join(f"<p>Text {i} {k}</p>" for k in range(i % 4))
        + f"</{tag}><p>All rights kept</p></body></html>"
        for i in range(n)
    ]


def test_template_takes_constant_texts(spark):
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages(9, article=False))]
    rows += [(100 + i, f"https://b.example:80/{i}", p) for i, p in enumerate(pages(2, article=False))]
    rows += [(200, None, None), (201, "", ""), (202, "http://a.example/x", rows[0][2])]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "page_id long, url string, html string, host string, pages int")
    got = {r.page_id: " ".join(s.text for s in r.slots) for r in h.extracted(df).collect()}
    assert len(got) == len(rows)
    for i in range(9):
        assert got[i] == " ".join([f"Head {i}", *(f"Text {i} {k}" for k in range(i % 4))])
    assert got[101] == "Welcome to us Head 1 Text 1 0 All rights kept"  # two pages make no template
    assert got[200] == got[201] == "" and got[202] == "Head 0"
    assert h.extracted(df.limit(0)).count() == 0


def test_copies_of_one_article_stay(spark):
    """Equal pages, and pages that differ in what stands around an equal article."""
    page = pages(1)[0]
    around = ["<html><body><div class=n{0}>{1}</div>".format(i, "link " * i) + page[page.index("<article>") :] for i in range(5)]
    rows = [(i, "http://a.example/", page) for i in range(5)] + [(10 + i, "http://b.example/", x) for i, x in enumerate(around)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {" ".join(s.text for s in r.slots) for r in h.extracted(df).collect()} == {"Head 0"}


def run(spark, pages):
    df = spark.createDataFrame([(i, f"http://a.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: " ".join(s.text for s in r.slots) for r in h.extracted(df).collect()}


def test_the_template_decides(spark, monkeypatch):
    """Constant lines go from an article too; without the template they stay."""
    made = [
        f"<article><h1>Title {i}</h1><p>Read us every day</p><p>{'own words %d ' % i * (i + 9)}</p><p>Tell a friend</p></article>"
        for i in range(6)
    ]
    got = run(spark, made)
    for i in range(6):
        assert got[i] == f"Title {i} " + ("own words %d " % i * (i + 9)).strip()
    monkeypatch.setattr(h, "SUPPORT", 100)
    assert all("Read us every day" in t and "Tell a friend" in t for t in run(spark, made).values())


def test_regions_without_telling_names(spark):
    """No article, no listed name: links that change and a list of other pages stand beside the text."""
    made = []
    for i in range(8):
        links = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in range(i, i + 4))
        words = "".join(f"<p>Sentence {k} of page {i}, with some more words.</p>" for k in range(3 + i % 3))
        made.append(f"<body><div class=x1><ul>{links}</ul></div><div class=x2><div class=y><h2>About {i}</h2>{words}</div></div><div class=x3>See also {i}</div></body>")
    got = run(spark, made)
    for i in range(8):
        assert got[i] == " ".join([f"About {i}", *(f"Sentence {k} of page {i}, with some more words." for k in range(3 + i % 3))])
    odd = run(spark, made + ["<div>Quite another page</div>"])  # nothing in the region
    assert odd[8] == "Quite another page"


def test_long_and_deep_pages_take_seconds():
    began = time.perf_counter()
    for page in ("<a " * 700_000, "</a " * 500_000, "<a '" * 500_000, '<a "x>" ' * 300_001 + '"', "<div>" * 100_000 + "deep", "<p><b>" * 100_000 + "deep", "<!" * 500_000):
        own = text(page)
        assert own in ("", "deep")
        h.page_tokens(page)
    assert time.perf_counter() - began < 60


def test_classes_by_brute_force(spark):
    rows = [(i, f"http://h{i % 2}.example/", p) for i, p in enumerate(pages(12))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = h.classes(df).collect()
    for k in (0, 1):
        counts = {content: found for found, content in (h.page_tokens(p) for i, _, p in rows if i % 2 == k)}
        counts = list(counts.values())
        vectors = {t: tuple(c[t].k if t in c else 0 for c in counts) for c in counts for t in c}
        vectors = {t: v for t, v in vectors.items() if sum(x > 0 for x in v) >= max(3, len(counts) / 2)}
        kinds = {t: c[t].kind for c in counts for t in c}
        tags = {t: v for t, v in vectors.items() if kinds[t]}
        own = {r.token: r for r in got if r.host == f"h{k}.example"}
        assert {t for t, r in own.items() if r.kind} == set(tags)
        name = lambda t: (own[t].vector, own[t].support)  # noqa: B023, E731
        assert all((name(a) == name(b)) == (tags[a] == tags[b]) for a in tags for b in tags)
        assert all(own[t].once == (max(v) == 1) for t, v in tags.items())
        assert {t for t, r in own.items() if not r.kind} == {t for t, v in vectors.items() if not kinds[t] and v in tags.values()}


def test_nesting():
    # token, kind, parent, chars, once, vector, support
    ok = [(1, 1, 0, 0, True, 7, 3), (2, 1, 1, 0, True, 7, 3), (3, 1, 2, 90, False, 8, 3)]
    assert h.template(ok) == (2, [1, 2, 3], [])
    # members of one class stand in two different classes
    assert h.template(ok + [(4, 1, 3, 0, True, 9, 3), (5, 1, 1, 0, True, 9, 3)]) == (2, [1, 2, 3], [])
    # a constant text of a class that nests, and one of a class that does not
    odd = [(4, 1, 3, 0, True, 9, 3), (5, 1, 1, 0, True, 9, 3), (6, 0, 3, 30, True, 7, 3), (7, 0, 5, 30, True, 9, 3)]
    assert h.template(ok + odd) == (2, [1, 2, 3], [6])
    assert h.template([]) == (None, [], [])


def test_sample_files(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in h.query(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1|br)>", inner)
        want = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[r.page_id].text == " ".join(w for w in want if w)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "div", "li", "b", "i", "h2", "td"]), st.text(alphabet="ab &é\n", max_size=8)), max_size=8))
def test_nested_elements_against_the_library_parser(parts):
    """Well-formed markup: the texts in order, blocks apart, inline elements together."""
    page = "<article>" + "".join(f"<{t}>{escape(x)}</{t}>" for t, x in parts) + "</article>"

    class Slow(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out = ""

        def handle_starttag(self, tag, attrs):
            self.out += "" if tag in "bi" else " "

        handle_endtag = lambda self, tag: self.handle_starttag(tag, ())

        def handle_data(self, data):
            self.out += data

    slow = Slow()
    slow.feed(page)
    slow.close()
    assert text(page) == " ".join(slow.out.split())


def test_open_elements_take_linear_time():
    page = "<li><ul>" + "<b>" * 300_000 + "<li>" * 300_000 + "<p>x<div>" * 50_000
    began = time.process_time()
    events = sum(1 for _ in h.parse(page))
    assert events > 600_000 and time.process_time() - began < 30
