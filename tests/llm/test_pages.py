import time

import pytest

from songloom.llm import markup, pages
from songloom.llm.markup import main_text, parse

SCHEMA = "page_id long, url string, html string"


def text(html):
    return main_text(parse(html))


def test_article_without_its_surroundings():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
    <body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><!-- <article>no</article> --><div class="ad">Buy</div>
    <div class="cookie-banner">We use</div><article><h1>Head &amp; line</h1><p><b>One  two<br><p>Three&nbsp;&eacute; <i>fo</i>ur &lt;b&gt;</p>
    <form><input value="x">Mail?</form><ul><li>a<li>b</ul><aside>More</aside><table><tr><td>c<td>d</table>
    <div class="comments"><p>First!</p></div></article><div id="sidebar">Side</div><footer>&copy; me</footer></body></html>"""
    assert text(html) == "Head & line\nOne two\nThree é four <b>\na\nb\nc\nd"


def test_broken_pages():
    assert text("") == "" and text("<p>") == "" and text("plain") == "plain"
    assert text("<article><p>cut <b>off") == "cut off"
    assert text("<article><p>cut<p cla") == "cut" and text("<article>a &am") == "a &am" and text("<article>a &amp") == "a &"
    assert text("<article>x<!-- never closed <p>y") == "x"
    assert text("<body><script>if (a<b) {</script><p>in</p></body></div></p>") == "in"
    assert text("<main>" + "<div>" * 3000 + "deep") == "deep"
    assert text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("<article><header><h2>Kept</h2></header>x</article>") == "Kept\nx"


def test_names_of_layouts_hide_no_article():
    for name in ("layout has-sidebar", "no-sidebar", "with-nav", "no-comments", "layout sidebar", "widget"):
        for kind in ("article", "main"):
            assert text(f"<body><div class='{name}'><{kind}><p>In</p></{kind}></div></body>") == "In"
    assert text("<main><h1>T</h1><div class='layout sidebar'><article>In</article></div></main>") == "T\nIn"
    assert text("<form><main><p>In</p></main></form>") == "In"
    # Comments and teasers do not stand in for the article beside them.
    assert text("<main><article>In</article><div class='comments'><article>First!</article></div></main>") == "In"
    assert text("<article>In<div class='comments'><article>First!</article></div></article>") == "In"
    assert text("<main>One</main><div><main>Two</main></div><main hidden>No</main><article hidden>No</article>") == "One\nTwo"
    assert text("<article> </article><main>In</main>") == "In"


def test_teasers_do_not_replace_the_text():
    assert text("<main><h1>T</h1><p>Body.</p><article>Teaser</article></main>") == "T\nBody.\nTeaser"
    assert text("<body><h1>T</h1><p>Body one.</p>..<article>Related story</article></body>") == "T\nBody one.\n..\nRelated story"
    assert text("<body><p>In our shop</p><article><h1>T</h1><p>A long story of its own.</p></article></body>") == "T\nA long story of its own."
    assert text("<div role=main><p>In</p></div><p>Out</p>") == "In"


def test_names_do_not_take_the_text():
    assert text("<article><div class='entry related'>Body</div></article>") == "Body"
    assert text("<article><div class='content widget'><p>Body</p></div></article>") == "Body"
    assert text("<article><p>One</p><p class='banner'>Two</p><section id='share'><p>Three.</p></section></article>") == "One\nTwo\nThree."
    assert text("<body><form id=aspnet><h1>T</h1><p>Body of the page.</p></form></body>") == "T\nBody of the page."


def test_comments_and_furniture_go():
    names = "reader-comments post-comments comments-section user-comment site-nav newsletter-signup advertising"
    for name in [*names.split(), "readerComments", "siteNav", "ad-slot", "cookie-consent"]:
        assert text(f"<body><article><h1>T</h1><p>The body of it.</p><div class='{name}'><p>First!</p></div></article></body>") == "T\nThe body of it."
        assert text(f"<body><h1>T</h1><p>The body of it.</p><div class='x {name}'><p>First!</p></div></body>") == "T\nThe body of it."
    # Comments go also where they are most of the page.
    assert text("<article><p>Body</p><div class='comments'><p>A long comment on this and that.</p></div></article>") == "Body"
    assert text("<article><p>A body.</p><ul class='social-share'><li><a>Tweet</a></ul></article>") == "A body."


@pytest.mark.parametrize("open_", ["<div>", "<main><p>", "<ul><li>", "<table><tr><td>", "<article>", "<div class='sidebar'>", "<span>", "<li>", "<td>", "<p><b>"])
def test_deep_pages_take_linear_time(open_):
    n = 100_000 // len(open_.split("<")[1:])
    start = time.process_time()
    root = parse(open_ * n + "deep")
    markup.hash_subtrees(root)
    markup.candidates(root)
    found = main_text(root)
    assert time.process_time() - start < 30 and found in ("deep", "")


def plain_templates(rows, least):
    """Hosts, keys and shapes on enough different pages, counted page by page."""
    pages_of, bodies = {}, set()
    for _, url, html in rows:
        root = parse(html)
        markup.hash_subtrees(root)
        host, body = url.split("/")[2].split(":")[0].lower(), main_text(root)
        if (host, body) in bodies:
            continue
        bodies.add((host, body))
        seen, against, *_ = markup.candidates(root)
        for key in {*seen, *against}:
            votes = pages_of.setdefault((host, key), [0, 0])
            votes[key in against] += 1
    return {(h, k, n) for (h, k), (n, no) in pages_of.items() if n >= least and no * pages.AGAINST <= n}


def site_pages():
    """A site whose menu, box and foot differ on every page and have no telling names."""
    def page(k):
        menu = "".join(f"<li><a href='/{i}'>entry {k} {i}</a>" for i in range(3 + k % 4))
        return (
            f"<body><div class='x1'><ul>{menu}</ul></div><div class='x2'>Word {k} of today</div>"
            f"<div class='x3'><p>Paragraph {k} of the story, which runs.</p><p>It goes on for {k} words and more of them.</p></div>"
            f"<div class='x4'>Printed {k} times</div></body>"
        )

    return [(k, "http://site.example/a", page(k)) for k in range(12)] + [(100, "http://other.example/", page(3))]


def test_shapes_that_recur_go(spark):
    df = spark.createDataFrame(site_pages(), SCHEMA)
    got = {r.page_id: r.text for r in pages.page_texts(df).collect()}
    assert got == {r.page_id: r.text for r in pages.page_texts(df, broadcast=0).collect()}
    for k in range(12):
        assert got[k] == f"Paragraph {k} of the story, which runs.\nIt goes on for {k} words and more of them."
    # A host with one page shows no template.
    assert got[100].startswith("entry 3 0") and got[100].endswith("Printed 3 times")


def test_templates_against_counting_page_by_page(spark):
    rows = site_pages() + [r for r in template_pages() if r[2]]
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (2, 5):
        found = {tuple(r) for r in pages.templates(pages.subtrees_of(df), least).collect()}
        assert found == plain_templates(rows, least) and found


def test_running_text_of_the_same_shape_stays(spark):
    """Every page has its text in the same place and shape; short introductions as well."""
    rows = [
        (k, "http://s/", f"<body><div class=lead><p>Lead {k}.</p></div><div class=body><p>{'Long text. ' * 20}{k}</p></div></body>")
        for k in range(30)
    ]
    got = {r.page_id: r.text for r in pages.page_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].startswith(f"Lead {k}.\nLong") for k in range(30))


def test_hidden_is_an_attribute():
    kept = "<a title='The hidden cost'>a</a> <i class='box hidden md:block'>b</i> <i data-x='display: none'>c</i>"
    gone = "<i hidden>d</i><i class=x hidden=''>e</i><i style='color:red; display : none'>f</i><i aria-hidden=true>g</i>"
    assert text(f"<article><p>{kept}{gone}</p></article>") == "a b c"


def template_pages():
    box = '<div><a href="/x">Read our guide</a><span>Follow</span></div>'
    own = lambda k: f"<article><p>Story {k}</p><p>The same sentence.</p>{box}</article>"
    rows = [(k, "https://a.example/p", f"<body>{own(k)}</body>") for k in range(12)]
    # On another host the box stands on one page, and copies of one page count once.
    rows += [(100, "http://B.example:80/1", f"<body>{own(0)}</body>")]
    rows += [(200 + k, "http://c.example/1", f"<body>{own(0)}</body>") for k in range(30)]
    rows += [(300 + k, "http://d.example/", f"<body><p>Ours.</p><p>Text {k}</p></body>") for k in range(8)]
    return rows


def test_recurring_subtrees_go_per_host(spark):
    got = {r.page_id: r.text for r in pages.page_texts(spark.createDataFrame(template_pages(), SCHEMA)).collect()}
    assert all(got[k] == f"Story {k}\nThe same sentence." for k in range(12))
    assert got[100] == got[200] == "Story 0\nThe same sentence.\nRead our guideFollow"
    # Without an article, paragraphs that a site repeats are its template too.
    assert got[303] == "Text 3"


def test_whole_pages_are_counted(spark):
    # The bar has no name that gives it away; articles' pages are evidence for one without.
    bar = "<div class='x7'><ul><li>Home</ul></div>"
    rows = [(k, "http://a/", f"<body>{bar}<article><p>Story {k}</article><footer>F</footer></body>") for k in range(9)]
    rows += [(9, "http://a/", f"<body>{bar}<p>All stories</p><footer>F</footer></body>"), (10, "http://b/", f"<body>{bar}<p>All</p></body>")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.pages for r in pages.templates(pages.subtrees_of(df)).collect()} == {10}
    got = {r.page_id: r.text for r in pages.page_texts(df).collect()}
    assert got[0] == "Story 0" and got[9] == "All stories" and got[10] == "Home\nAll"


def test_recurrence_does_not_scale_with_the_host(spark):
    box, table = "<div>Read our guide</div>", "<table><tr><td>a<td>b</table>"
    extra = lambda k: box if k < 12 else table if k < 17 else ""
    rows = [(k, "http://big/", f"<article><p>Story {k}</p>{extra(k)}</article>") for k in range(400)]
    rows += [(1000 + k, "http://small/", f"<article><p>Tale {k}</p>{table if k < 5 else ''}</article>") for k in range(20)]
    # Without an article: a sentence recurs in other places by chance, a line at the end is a template.
    rows += [(2000 + k, "http://c/", "<p>x</p>" * k + f"<p>Own {k}</p><p>Thanks.</p>" + f"<p>More {k}</p>" * (9 - k) + "<p>Ours.</p>") for k in range(8)]
    # As many copies of a page as make it hot.
    rows += [(3000 + k, "http://big/", rows[0][2]) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for broadcast in (0, 1 << 20):
        got = {r.page_id: r.text for r in pages.page_texts(df, broadcast=broadcast).collect()}
        assert len(got) == len(rows)
        assert all(got[k] == f"Story {k}" for k in range(12)) and got[3007] == "Story 0"
        assert got[13] == "Story 13\na\nb" and got[1002] == "Tale 2\na\nb"
        assert "Thanks." in got[2003] and "Ours." not in got[2003]
    found = pages.subtrees_of(df)
    known = pages.templates(found)
    plain, salted = (pages.lists_of_pages(found, known, **hot).selectExpr("host", "page", "sort_array(hashes)") for hot in ({}, {"hot_rows": 3}))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, salted.collect()))


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "x", ""), (2, "http://h/", "<p>a</p>"), (2, "http://h/", "<p>a</p>"), (3, "http://h/", "<nav>n</nav>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as text", "2 as host", "3 as hashes", "4 as _html")
    got = sorted([tuple(r) for r in pages.page_texts(df).collect()], key=repr)
    assert got == sorted([(1, None, ""), (None, "x", ""), (2, "http://h/", "a"), (2, "http://h/", "a"), (3, "http://h/", "")], key=repr)
    assert pages.page_texts(df.limit(0)).count() == 0
