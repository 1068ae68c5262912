import html
import re

from nestql.llm import html_text as H

LONG = "This is a paragraph of the text and it is long enough to be decided as it has many of the stop words in it. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="page"><header>Site</header>
<div id="cookie-notice">We use cookies to make the site better for you and for us all</div>
<nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="content"><h1>Title &amp;&#32;more</h1><p>{LONG}</p><p>Short <b>o</b>ne.<p>{LONG * 2}</div>
<div class="sidebar">{LONG}<a href="1">Link one</a></div><script>var x = "</p>";</script>
<section id="comments"><p>{LONG}</p></section><form><label>Name</label><input></form>
<footer>&copy; all of us</footer></body></html>"""


def test_parts_that_are_not_content_go():
    assert H.main_text(PAGE) == " ".join(f"Title & more {LONG}Short one. {LONG * 2}".split())


def test_ambiguous_blocks_inherit():
    def b(text, **k):
        return H.Block(text, k.get("links", 0), k.get("bad", False), False, k.get("heading", False))

    good, bad, short = b(LONG), b("x", bad=True), b("Short one.")
    assert H.labels([good, short, good]) == [True] * 3
    assert H.labels([bad, short, bad]) == [False] * 3
    assert H.labels([bad, short, good]) == [False, False, True]
    assert H.labels([bad, short, short, good]) == [False, False, True, True]
    assert H.labels([bad, b("Title", heading=True), good]) == [False, True, True]
    assert H.labels([good, b("a b", links=3), good]) == [True, False, True]
    assert H.labels([short]) == [False] and H.labels([]) == []


def test_articles_keep_every_block():
    page = "<body><div class='ad'>Buy it now</div><article><div class='entry-header'><h1>A</h1></div><p>b<p>c&nbsp;&eacute;<br>d</p><aside>no</aside><div class='comment-list'><p>no</p></div></article><footer>f</footer>"
    assert H.main_text(page) == "A b c é d"


def test_broken_pages():
    for page in ("<", "<div", "a<b", "<p>one<p", "</p></div>x", "<script>never ends", "<!-- never ends", "<p title='", "&am", "<a " * 5000, "<div>" * 3000 + "x"):
        assert isinstance(H.main_text(page), str)
    assert H.main_text("<article><p title='it's\">one</p><p>two</article>") == "one two"
    assert H.main_text(None) == "" and H.main_text("") == ""


def test_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", f"<article><p>{'word ' * 40_000}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as Text")
    out = H.extract(df).collect()
    assert [r.n_chars == len(r.text) for r in out] == [True] * 5
    assert [r.text for r in out if r.page_id in (1, 2)] == ["", ""]
    assert sorted(r.n_chars for r in out)[-1] == 5 * 40_000 - 1
    assert H.extract(df.limit(0)).collect() == []


def test_query_keeps_the_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas().set_index("page_id")
    out = H.op2_html_text(spark, sf_dir).toPandas().set_index("page_id").loc[pages.index]
    for page, text, n in zip(pages.html, out.text, out.n_chars):
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        want = re.sub(r"</?(?:p|h1|br)>", "\n", article)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", want)).split())
        assert text == want and n == len(want)


def test_densities_decide_in_articles_too():
    tags = "Berlin Hamburg Munich Cologne Frankfurt Stuttgart Leipzig Dresden Hanover Nuremberg Bremen " * 3
    links = "".join(f"<a href='{i}'>Another story {i}</a> " for i in range(9))
    page = f"<article><h1>A</h1><p>{LONG * 4}</p><p>Short one.</p><p>{LONG}</p><div>{links}</div><p>{tags}</p><p>More:</p><div>{links}</div></article>"
    assert H.main_text(page) == " ".join(f"A {LONG * 4} Short one. {LONG}".split())
    # few stop words alone don't reject a block among good ones
    assert H.main_text(f"<main><p>{LONG * 4}</p><p>{tags}</p></main>") == " ".join(f"{LONG * 4} {tags}".split())


def test_undecided_pages_keep_their_blocks():
    assert H.main_text("<nav>Home</nav><h1>Title</h1><p>Short one.</p><p>Short two.</p><footer>F</footer>") == "Title Short one. Short two."
    assert H.main_text("<p>Short one.</p>") == "Short one."
    assert H.main_text("<nav>Home</nav><p><a href='1'>Link</a></p>") == ""


def test_unknown_languages_are_not_rejected():
    text = "Litwo ojczyzno moja jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie widzę i opisuję bo tęsknię po tobie panno święta co jasnej bronisz Częstochowy"
    assert len(text) >= H.LONG and H.stop_density(text) < H.STOP_LOW
    for part in ("div", "article"):
        assert H.main_text(f"<header>S</header><{part}><p>{text}</p><p>{text[:120]}</p></{part}><footer>F</footer>") == f"{text} {text[:120].strip()}"


def test_articles_clear_marks_of_their_wrappers():
    article = f"<article><h1>A</h1><p>{LONG}</p></article>"
    want = f"A {LONG}".strip()
    wrappers = ["<div class='has-sidebar'>", "<div class='no-sidebar'>", "<div id='page' class='with-header'>", "<section class='search-result'>", "<form action='x'>", "<div class='sidebar'>", "<main><form>", "<div id='share'><div class='content'>"]
    for w in wrappers:
        assert H.main_text(f"<body>{w}{article}</body>") == want, w
    assert H.main_text(f"<div class='has-sidebar'><p>{LONG}</p></div>") == LONG.strip()
    for w in ("<aside>", "<nav>", "<div hidden>", "<div style='display:none'>"):
        assert H.main_text(f"<body>{w}{article}</body>") == "", w


def test_marked_parts_beside_and_in_articles_stay_bad():
    article = f"<article><h1>A</h1><p>{LONG * 2}</p><div class='ad'>Buy</div><div class='search-box'>Go</div><section id='comments'><article class='comment'><p>{LONG}</p></article><article><p>{LONG}</p></article></section></article>"
    teaser = f"<div class='related-posts'><article><p>{LONG}</p></article></div>"
    want = f"A {LONG * 2}".strip()
    for page in (article + teaser, teaser + article, f"<div class='sidebar'>{article}</div>", f"<form>{article}</form>"):
        assert H.main_text(page) == want


def test_blocks_are_decided_alike_without_article_tags(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    alike = total = 0
    for page in pages.html:
        bare = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page)
        with_tags, without = H.blocks(page), H.blocks(bare)
        assert [b.text for b in with_tags] == [b.text for b in without] and not any(b.good for b in without)
        alike += sum(a == b for a, b in zip(H.labels(with_tags), H.labels(without)))
        total += len(without)
    assert alike >= 0.95 * total


def test_densities_decide_on_pages_without_any_marks():
    links = "".join(f"<li><a href='{i}'>Another story of today {i}</a></li>" for i in range(9))
    tags = "Berlin Hamburg Munich Cologne Frankfurt Stuttgart Leipzig Dresden Hanover Nuremberg Bremen " * 3
    page = f"<div><ul>{links}</ul><p>Sign in</p></div><div><h1>Title</h1><p>{LONG * 3}</p><p>A short one.</p><p>{LONG}</p></div><div>{tags}</div><div>All rights</div>"
    assert H.main_text(page) == " ".join(f"Title {LONG * 3} A short one. {LONG}".split())


def test_marked_parts_say_nothing_about_blocks_beside_them():
    page = f"<nav>Home</nav><div><p>By A. Writer</p><p>{LONG}</p><p>The end.</p><p>Really.</p></div><footer>F</footer>"
    assert H.main_text(page) == " ".join(f"By A. Writer {LONG} The end. Really.".split())


def test_time_is_linear_in_the_page():
    import time

    for make in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<article>" * n, lambda n: "<p><b>x" * n, lambda n: "<a '" * n, lambda n: "<ul><li>x" * n):
        start = time.time()
        H.main_text(make(60_000))
        assert time.time() - start < 6
    assert H.main_text("<div>" * 50_000 + f"<p>{LONG}</p>" + "</div>" * 50_000) == LONG.strip()
