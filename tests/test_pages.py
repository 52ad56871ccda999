from pyspark.sql import functions as F

from weftline.operators import html, pages


def cleaned(markup):
    return html.clean(html.parse(markup))


def test_clean():
    assert cleaned("<body><nav>x</nav><p>Hello <b>you</b></p><script>1</script><!-- c --></body>") == "Hello\nyou"
    assert cleaned("<header>ab</header><p>" + "x" * 20 + "</p>") == "x" * 20
    assert cleaned("<header>" + "a" * 20 + "</header><p>bb</p>") == "a" * 20 + "\nbb"
    assert cleaned('<div class="sidebar x">ab</div><p>' + "x" * 20 + "</p>") == "x" * 20
    assert cleaned('<main class="menu">ab</main><div id="cookie">' + "x" * 20 + "</div>") == "ab\n" + "x" * 20
    assert cleaned("<table><tr><th>A</th><td>B</td></tr><tr><td></td></tr><tr><td>C<td>D</table>") == "A | B\nC | D"
    assert cleaned("<p>" + "x" * 13000) == "x" * 12000
    assert cleaned("") == ""


def test_boilerplate_share_falls_as_it_goes():
    # 10 of 40 go; of the 30 left, 10 are over three tenths and stay.
    assert cleaned('<div class="menu">' + "a" * 10 + '</div><div class="menu">' + "b" * 10 + "</div><p>" + "c" * 20 + "</p>") == "b" * 10 + "\n" + "c" * 20


def test_title():
    t = lambda m: html.title(html.parse(m))
    assert t("<title> A &amp; B </title><h1>C</h1>") == "A & B"
    assert t("<h1>C <i>d</i></h1>") == "Cd"
    assert t("<title> </title><h1>C</h1>") == ""
    assert t("<title></title><h1>C</h1>") == "C"
    assert t("<p>x") == ""


def test_names_of_characters_need_their_semicolon():
    root = html.parse('<title>A &amp; &ampB &amp</title><script>x &amp y</script><a href="/x?a=1&copy=2&amp;b=&#39;">&lt;&lt&notit;</a>')
    assert html.title(root) == "A & &ampB &amp"
    assert html.anchors(root) == [{"href": "/x?a=1&copy=2&b='", "text": "<&lt&notit;"}]
    assert [n.parts for n in root.all() if n.name == "script"] == [["x &amp y"]]
    assert html.title(html.parse("<title>\ufdd0 &amp</title>")) == "\ufdd0 &amp"


def test_title_by_expression(values):
    assert values(["<title> A </title>", "<h1>C <i>d</i></h1>", "<title> </title><h1>C</h1>", "x"], html.title_of(F.col("v"))) == ["A", "C d", "", ""]


def links_of(spark, markup, url="http://www.a.org/x/", **more):
    parsed = html.parse_pages(spark.createDataFrame([(url, markup)], "url string, html string"))
    return html.subpages(parsed, **more).first()["subpages"]


def test_links(spark):
    page = (
        '<a href="/p1">x</a><a href="/p1">Keynote</a><a href="#dates">d</a><a href="mailto:call@a.org">m</a><a href="call.pdf">p</a><a href="call.PDF">q</a>'
        '<a href="http://sub.a.org/call">s</a><a href="https://a.org/venue?x#y">v</a><a href="/z?topic=1">z</a><a>call</a><a href="Program">P</a>'
    )
    assert links_of(spark, page) == ["http://www.a.org/x/call.PDF", "https://a.org/venue", "http://www.a.org/z", "http://www.a.org/x/Program"]
    many = "".join(f'<a href="/call{i}">c</a>' for i in range(12))
    assert links_of(spark, many) == [f"http://www.a.org/call{i}" for i in range(8)]
    assert links_of(spark, "") == []


def site(spark, rows):
    return spark.createDataFrame([("http://a.org/", i, u, t, x) for i, (u, t, x) in enumerate(rows)], "site_url string, crawl_idx int, url string, title string, text string")


def test_scores(spark):
    rows = [("http://a.org/call-for-papers", "Call For Papers", ""), ("http://a.org/steaming", "", ""), ("http://a.org/program-committee", None, None), ("http://a.org/", "", "x" * 500 + " venue")]
    got = {r["url"]: r for r in pages.with_scores(site(spark, rows)).collect()}
    assert got[rows[0][0]]["score_basic"] == 15
    assert got[rows[1][0]]["score_committee"] == 3
    assert (got[rows[2][0]]["score_committee"], got[rows[2][0]]["score_speakers"]) == (6, 3)
    assert got[rows[3][0]]["score_basic"] == 0 and got[rows[3][0]]["is_main"]


def test_select_and_context(spark):
    rows = [("http://a.org/keynote1", "", ""), ("http://a.org/keynote2", "", ""), ("http://a.org/keynote3", "", ""), ("http://a.org/", "Main", "m"), ("http://a.org/none", "", ""), ("http://a.org/", "Again", "")]
    scored = pages.with_scores(site(spark, rows))
    chosen = pages.select_pages(scored, ["speakers"])
    assert [r["url"][13:] for r in chosen.orderBy("rank").collect()] == ["", "keynote1", "keynote2"]
    assert [r["title"] for r in pages.select_pages(scored, ["speakers"], {"speakers": 0}).collect()] == ["Main"]
    context = pages.contexts(chosen).first()["context"]
    assert context == "=== PAGE: http://a.org/ ===\nMain\nm\n\n=== PAGE: http://a.org/keynote1 ===\n\n\n\n=== PAGE: http://a.org/keynote2 ===\n\n"
    shown = pages.describe(scored, ["speakers"], 2).orderBy("rank").collect()
    assert [(r["url"][13:], r["score"]) for r in shown] == [("keynote1", 3), ("keynote2", 3)]
    assert pages.full_text(site(spark, rows[:1])).first()["full_text"] == "=== PAGE: http://a.org/keynote1 ===\n\n"
