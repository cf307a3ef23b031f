"""Main text of pages: structure, broken markup, and templates found by site style trees."""

import html as h

import pyarrow.parquet as pq

from tenderlens.llm.html_extract import Page, extract, low_parts

PAGES = "/root/testdata/sf0.01/pages.parquet"


def text(markup):
    return Page(markup).main_text(set())


def test_structure():
    assert text("<body><nav>menu</nav><header>head</header><article><h1>T</h1><p>a <b>b</b>c<p>d<br>e</article><footer>f</footer>") == "T a bc d e"
    assert text("<div class='sidebar'>x</div><div id=content><p>kept</p></div><div class='ad box'>y</div>") == "kept"
    assert text("<article>a<div class='comments'><article>reader</article></div><form>f<input></form><aside>s</aside>z</article>") == "a z"
    assert text("<article><header><h1>own</h1></header>b</article>") == "own b"
    assert text("<p>x</p><script>var a='</p><p>no';</script><style>p{}</style><!-- c <p>no --><p>y&amp;&lt;b&gt;&nbsp; z</p>") == "x y&<b> z"
    assert text("<main><p>m</p></main><p>outside</p>") == "m"
    assert text("<div class='page-header'>x</div><div class='text with-sidebar has-comments'><div class='header'>y</div><p>z</p></div>") == "z"
    assert text("<article><div class=entry-header>own</div>z</article>") == "own z"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a b c d 1 2 3"
    assert text("<p hidden>no</p><p style='display: none'>no</p><p role=alert>no</p><p>yes</p>") == "yes"


def test_names_never_drop_an_article():
    assert text("<div class=menu>m</div><article class='post category-advertising'><p>a</p></article>") == "a"
    assert text("<p>m</p><article id=login><h1>Login pages</h1>a</article>") == "Login pages a"
    assert text("<article>a<div class=social-history>b</div><div class=share-buttons>no</div><p class=ad>no</p><div id=comments>no</div>c</article>") == "a b c"
    assert text("<article>a<div class='post-comments'><p>no</p></div><div class='comment-culture'>b</div></article>") == "a b"
    assert text("<article>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</article>") == "if x=1 then"
    # The only article counts whatever its surroundings are called; articles beside another one do not.
    assert text("<p>menu</p><div class='layout sidebar'><article><p>a story</p></article></div>") == "a story"
    assert text("<p>menu</p><div class='layout sidebar'><span role=article>a story</span>x</div>") == "a story"
    assert text("<p>a whole story</p><div class=related><article>teaser</article></div>") == "a whole story"
    assert text("<article><div>a <span class=ad><div>no</div></span>b</div></article>") == "a b"
    assert text("<div class=ad><p>no<b>no<div>no</div></div><div>a<span class=ad><div>no") == "a"
    assert text("<article>a</article><div class=related><article>b</article></div>") == "a"
    assert text("<p>a</p><div class=related><article>b</article><article>c</article></div>") == "a"
    assert text("<p>a</p><aside><article>b</article></aside>") == "a"
    assert text("<article>a</article><article class='comment'>b</article><article class=ad-box>c</article>") == "a"
    assert text("<div class=comments><article class=comment>a</article></div><p>b</p>") == "b"
    assert text("<article>a<div class=comments><article>b</article></div></article>") == "a"


def test_broken_markup():
    assert text("") == text("   ") == text("<!-- never closed <p>x") == "" and text("<") == "<"
    assert text("a < b and c > d") == "a < b and c > d"
    assert text("<article><p>cut off <a href='x") == "cut off"
    assert text("<article><p>cut &amp") == "cut &"
    assert text("</div></p><p>a</b></i>b</p></section>") == "ab"
    assert text("<p title='a>b' data-x=\"<p>\">v</p>") == "v"
    assert text("<script>never closed <p>x") == ""
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<p>" + "long " * 50_000 + "</p>") == " ".join(["long"] * 50_000)


def test_given_pages(spark):
    rows = pq.read_table(PAGES).to_pylist()
    import re

    want = {}
    for r in rows:
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)
        want[r["page_id"]] = " ".join(h.unescape(re.sub(r"<[^>]*>?", " ", m[1])).split()) if m else ""
    got = extract(spark.read.parquet(PAGES)).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def plain_low(pages, threshold=0.05, least=8):
    """Blocks on nearly every page of a host, page by page."""
    import math

    seen, at = {}, {}
    for host, markup in pages:
        p = Page(markup)
        for e in {paths[-1] for paths, _ in p.candidates()}:
            at[host, e] = at.get((host, e), 0) + 1
        for e, t in {(paths[-1], t) for paths, t in p.candidates()}:
            seen[host, e, t] = seen.get((host, e, t), 0) + 1
    return {(host, t) for (host, e, t), n in seen.items()
            if n >= least and at[host, e] >= least and 1 - math.log(n) / math.log(at[host, e]) < threshold}


def test_templates(spark):
    def page(i, extra=""):
        return (f"<body><div class=top><p>Welcome to our site</p></div><div class=text><p>story {i} begins</p><p>and goes on {i * 7}</p>{extra}</div>"
                "<div class=end><p>All rights</p></div>")

    rows = [(i, "https://Site.example/a", page(i, "<p>Sign up now</p>")) for i in range(30)]
    rows += [(100 + i, "https://few.example/a", page(1)) for i in range(3)] + [(200, None, "<p>alone</p>"), (201, "x", None), (202, "x", "")]
    rows += [(300 + i, "http://same.example/", "<article><p>all alike</p></article>") for i in range(12)]
    rows += [(400, "https://site.example/b", "<body><div class=top><p>Welcome to our site</p></div><div class=end><p>All rights</p></div>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"story {i} begins and goes on {i * 7}" for i in range(30))
    assert got[100] == "Welcome to our site story 1 begins and goes on 7 All rights"  # too few pages to tell
    assert got[200] == "alone" and got[201] == got[202] == "" and got[300] == "all alike"
    assert got[400] == ""  # template alone
    from tenderlens.llm.html_extract import hash_of

    low = {r.host: set(r.low) for r in low_parts(pages).collect()}
    want = plain_low([("site.example", m) for i, _, m in rows if i < 30])
    assert want and all(hash_of(t) in low[host] for host, t in want)
    assert extract(pages.where("false")).count() == 0


def test_copies_that_share_a_host_lose_nothing(spark):
    marked = "<article><p>a story</p><blockquote>quoted</blockquote><table><tr><td>cell</td></tr></table></article>"
    bare = "<div class=text><p>another story</p></div><div class=once><p>of its own class</p></div>"
    rows = [(i, f"<div class=text><p>story {i}</p></div><div class=end><p>All rights</p></div>") for i in range(20)]
    rows += [(100 + i, marked) for i in range(10)] + [(200 + i, bare) for i in range(10)]
    # Statistics never reach into a marked article, distinct pages or not.
    rows += [(300 + i, f"<article><p>text {i}</p><h2>Further reading</h2></article>") for i in range(12)]
    pages = spark.createDataFrame([(i, "http://host.example/", m) for i, m in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert {got[i] for i, m in rows if m == marked} == {"a story quoted cell"}
    assert {got[i] for i, m in rows if m == bare} == {"another story of its own class"}
    assert all(got[300 + i] == f"text {i} Further reading" for i in range(12))
    assert all(got[i] == f"story {i}" for i in range(20))
