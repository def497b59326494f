import random

from loamwork.llm.page_text import main_text, read_lines, settled, shared

SCHEMA = "page_id long, url string, html string, row string, text string, hashes string"


def texts(spark, rows):
    got = main_text(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return sorted((r["page_id"], r["url"], r["text"]) for r in got)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randrange(14))] for _ in range(2))
        at = shared(a, b)
        assert len(at) == lcs(a, b) and at == sorted(set(at))
        left = iter(b)
        assert all(a[i] in left for i in at)  # in this order


def test_parts_that_markup_names_go():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header>
    <nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>We use <div>cookies</div> here</div>
    <article class="with-sidebar"><header><h1>The  head</h1></header><p>One<b>two</b> &lt;three&gt;<br>four<p>five
    <div class="ad">Buy</div><form>Name</form><script>if (a<b) x="</p>";</script><p>six &#233;<!-- no --></p>
    <section id="comments"><article class="comment">Nice</article></section><footer>by me</footer></article>
    <aside>More</aside><div hidden>h</div><div role="navigation">n</div><footer>&copy; us</footer>"""
    assert settled(page)[0] == "The head Onetwo <three> four five six é"
    assert settled("<nav><ul><li>menu<article><p>x")[0] == "x"
    assert settled("<div class=nav>m</div><main><p>y</p></main>z")[0] == "y"
    assert settled('<div>a</div><div class="article-body"><p>b</p></div>')[0] == "b"
    assert settled('<article><p class="open>c</p></article>')[0] == "c"
    assert settled("<article></article>")[0] == "" and settled("") == ("", [], [])
    assert read_lines("a < b <p>c &nbsp;&#x20; d") == (["a < b", "c d"], [0, 0], False, False)


def plain_page(i, lines):
    return "<body><div>Acme portal</div><div>Call us today</div>" + "".join(f"<div>{x}</div>" for x in lines) + f"<div>Page views {i}</div><div>All rights reserved</div></body>"


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [(i, f"http://a.example/news/{i}?x=1", plain_page(i, [f"story {i}", "and more", f"end {i}"])) for i in range(10, 16)]
    rows += [(20, "http://b.example/", plain_page(1, ["alone"])), (21, None, plain_page(2, ["nowhere"])), (22, "not a url", plain_page(3, ["text"]))]
    got = dict((i, t) for i, _, t in texts(spark, rows))
    for i in range(10, 16):
        assert got[i] == f"story {i} end {i} Page views {i}"
    assert got[20] == "Acme portal Call us today alone Page views 1 All rights reserved"
    assert "nowhere" in got[21] and got[22].startswith("Acme portal")


def test_copies_take_nothing_from_each_other(spark):
    page = plain_page(1, ["the very same", "story here"])
    other = plain_page(2, ["another one"])
    rows = [(1, "http://a.example/x", page), (1, "http://a.example/x", page), (3, "http://a.example/y", other)]
    got = texts(spark, rows)
    assert [t for _, _, t in got] == ["the very same story here Page views 1"] * 2 + ["another one Page views 2"]


def test_odd_rows(spark):
    long = "<article>" + "<p>wörd &amp; </p>" * 50_000 + "</article>"
    rows = [(None, None, None), (1, "", ""), (2, "http://h/a", "  \t"), (3, "http://h/a", long), (3, "http://h/a", long), (4, "http://H/a/", "<p>  x</p>")]
    got = {(i, u): t for i, u, t in [(r[0], r[1], r[2]) for r in main_text(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)).select("page_id", "url", "text").collect()]}
    assert got[None, None] == got[1, ""] == got[2, "http://h/a"] == ""
    assert got[3, "http://h/a"] == " ".join(["wörd &"] * 50_000) and got[4, "http://H/a/"] == "x"
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
