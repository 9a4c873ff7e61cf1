"""Article text of odd pages, and branches that repeat over a host."""

import time
from collections import Counter
from math import log
from random import Random

from hypothesis import given, settings
from hypothesis import strategies as st

from corvana.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header>Top</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">Cookies</div><div id="sidebar">Side</div>
<article><h1>One &lt;two&gt; &amp; &eacute;</h1><p>First <b>bo</b>ld<br>line<p>a < b
 and   more<ul><li>x<li>y</ul><table><tr><td>c<td>d</table><form>F</form><div class="share">S</div>
<section class="comments"><p>Me too</p></section><script>if (a < b) { "</p>" }</script></article><footer>End</footer></body></html>"""


def test_article():
    assert h.main_text(PAGE) == "One <two> & é\nFirst bold line\na < b and more\nx\ny\nc\nd"


def test_without_article():
    assert h.main_text("<body><nav>n</nav><main><p>m</main><p>rest</body>") == "m"
    assert h.main_text("<div>a<div>b</div>c</div><footer>f</footer>") == "a\nb\nc"
    assert h.main_text("just text") == "just text"
    assert h.main_text(None) == h.main_text("") == h.main_text("<p></p>") == ""


def test_odd_markup():
    assert h.main_text("<p title='x>y'>q</p><!-- <p>no</p> --><p hidden>no</p>") == "q"
    assert h.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert h.main_text("<article><p>" + "word " * 100_000) == " ".join(["word"] * 100_000)
    assert h.main_text("<script>never closed") == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</article>", "<article>", "text", "&amp;", "<", ">", "<script>", "</script>", "<!--", "-->", "\"", "'", "<li>", " "]), max_size=30).map("".join))
def test_never_fails(page):
    text = h.main_text(page)
    assert "\n\n" not in text and text == text.strip()
    h.tree_rows(page)


def page(n, body):
    return f"<body><div class='box'><p>Same on all pages</p></div><div class='story'><p>{body} {n}</p></div></body>"


def test_style_tree(spark):
    rows = [(n, f"https://a.example/{n}?q", page(n, "Story"), "x") for n in range(30)] + [(100, "https://b.example/1", page(1, "Only"), "x"), (101, None, None, None), (None, "odd", "<p>t</p>", None), (5, "https://a.example/5?q", page(5, "Story"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id if r.page_id is not None else -1), r.text) for r in h.extract(df).collect())
    assert len(got) == len(rows)
    assert (3, "Story 3") in got and got.count((5, "Story 5")) == 2
    assert (100, "Same on all pages\nOnly 1") in got and (101, "") in got and (-1, "t") in got
    tree = {r.path: r.importance for r in h.style_tree(df.selectExpr("'a' as host", "html").limit(0)).collect()}
    assert tree == {} and h.extract(df.limit(0)).count() == 0


def test_copies_of_an_article_stay(spark):
    rows = [(n, f"https://a.example/{n}", "<body><nav>m</nav><article><h1>T</h1><p>The same text</p></article></body>") for n in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in h.extract(df).collect()} == {"T\nThe same text"}


def test_copies_have_no_weight(spark):
    body = "<body><nav>m</nav><div class='box'>Same on all pages</div><article><h1>T</h1><div class='content'><p>{0}</p><ul><li>{0} x</li></ul><table><tr><td>{0} y</td></tr></table></div></article></body>"
    texts = ["A copied body"] * 60 + [f"Body {n}" for n in range(12)]
    rows = [(n, "https://a.example/", body.format(t)) for n, t in enumerate(texts)]
    rows += [(100 + n, "https://b.example/", page(n % 12 if n > 200 else 0, "Story")) for n in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert [got[n] for n in range(72)] == [f"T\n{t}\n{t} x\n{t} y" for t in texts]
    assert {got[100 + n] for n in range(300)} == {f"Story {n}" for n in range(12)}  # div.story differs on 12 pages, whatever the copies


def test_names():
    for name in ("content has-sidebar", "no-comments", "post-with-menu", "sidebar"):
        assert h.main_text(f"<body><div class='{name}'><p>x</p><article><p>Body</p></article></div></body>") == "Body", name
    assert h.main_text("<div class='content has-sidebar'><p>Body</p></div><div class='sidebar'>no</div>") == "Body"
    anchors = "<h2 id='related-work'>A</h2><section id='social-history'><p>B</p></section><p id='notice-period'>C</p><h2 id='related'>D</h2><div class='notice'>E</div>"
    assert h.main_text(f"<article>{anchors}<div class='related-posts'>no</div><div id='comments'><article>no</article></div></article>") == "A\nB\nC\nD\nE"
    assert h.main_text("<div class='sidebar'><article>teaser</article></div><article>Body</article>") == "Body"
    assert h.main_text("<div class='sidebar'><article>teaser</article></div><main>Body</main>") == "Body"


def test_teaser_in_main():
    assert h.main_text("<main><h1>T</h1><p>The long body of this page</p><article>teaser</article></main>") == "T\nThe long body of this page\nteaser"
    assert h.main_text("<main><p>Lead</p><article>The article itself</article></main>") == "The article itself"


def test_comments_that_are_articles():
    assert h.main_text("<div class='post'><p>The body of this page</p></div><div id='comments'><article>a comment</article></div>") == "The body of this page"


def template(node):
    """A branch's elements in plain text, runs of equal ones as one."""
    inner = [x if isinstance(x, str) else template(x) for x in node.kinds]
    return f"{node.name}({','.join(x for n, x in enumerate(inner) if not n or x != inner[n - 1])})"


def brute_tree(pages):
    """{path: (importance, presentation)} of one host: paths, templates and contents as plain texts."""
    by_text = {}
    for page in pages:
        blocks, nodes = h.parse(page)
        paths, styles, inside = {id(nodes[0]): ""}, {}, set()
        for node in nodes[1:]:
            paths[id(node)] = f"{paths[id(node.parent)]}/{node.name}"
            styles.setdefault(paths[id(node)], []).append(template(node))
            if node.parent.article == 2:
                inside.add(paths[id(node)])
        texts = {p: [] for p in styles}
        for node, text in blocks:
            path = paths[id(node)]
            while path:
                texts[path].append(text)
                path = path.rpartition("/")[0]
        rows = {p: (";".join(x for n, x in enumerate(styles[p]) if not n or x != styles[p][n - 1]), "\n".join(texts[p])) for p in styles if p not in inside}
        by_text.setdefault("\n".join(t for _, t in h.article_blocks([x for x in blocks if not x[0].dropped])), rows)
    out = {}
    for path in {p for rows in by_text.values() for p in rows}:
        found = []
        for kind in (0, 1):
            counts = Counter(rows[path][kind] for rows in by_text.values() if path in rows)
            m = sum(counts.values())
            e = -sum(n / m * log(n / m) for n in counts.values()) / log(m) if m > 1 else 1.0
            found.append((e * m + h.PRIOR) / (m + h.PRIOR))
        out[path] = h.PRESENTATION_SHARE * found[0] + (1 - h.PRESENTATION_SHARE) * found[1], found[0]
    return out


def test_tree_by_brute_force(spark):
    random = Random(3)
    words = ["alpha", "beta", "gamma", "delta", "fixed words"]
    pages = []
    for n in range(40):
        top = "".join(f"<li>{w}</li>" for w in words[: random.choice([2, 2, 2, 3])])
        story = "".join(f"<p>{' '.join(random.choices(words, k=5))}</p>" for _ in range(random.randint(1, 3)))
        pages.append(f"<body><div class='top'><ul>{top}</ul></div><div class='story'>{story}</div><div class='end'><span>By {random.choice(words[:2])}</span></div><article>{n}</article></body>")
    pages += pages[:20]  # copies have no weight
    got = {r.path: r for r in h.style_tree(spark.createDataFrame([("a", p) for p in pages], "host string, html string")).collect()}
    want = brute_tree(pages)

    def key(path):
        at = h.number("/")  # the root's path
        for name in path.split("/")[1:]:
            at = h.number(f"{at}/{name}")
        return at

    assert {key(p): (round(v, 9), round(w, 9)) for p, (v, w) in want.items()} == {p: (round(r.importance, 9), round(r.presentation, 9)) for p, r in got.items()}
    assert {r.parent for r in got.values()} <= {*got, h.number("/")}
    assert max(r.n_pages for r in got.values()) == 40
    low = {p for p, (v, _) in want.items() if v < h.LOW_IMPORTANCE}
    assert "/html" not in low and not any("story" in p for p in low)


def static_page(n):
    return f"<body><div class='top-strip'><p>Welcome to the site</p></div><div class='story'><p>Story {n}</p><p>More of {n}</p></div><div class='legal'>All rights reserved</div></body>"


def test_static_branches_go_also_beyond_the_broadcast(spark):
    df = spark.createDataFrame([(n, "https://a.example/", static_page(n)) for n in range(20)] + [(n, f"https://few{n % 4}.example/", static_page(n)) for n in range(100, 120)], "page_id long, url string, html string")
    for bound in (h.BROADCAST_PATHS, 0):
        got = {r.page_id: r.text for r in h.extract(df, broadcast_paths=bound).collect()}
        assert all(got[n] == f"Story {n}\nMore of {n}" for n in range(20))
        assert all(got[n] == f"Welcome to the site\nStory {n}\nMore of {n}\nAll rights reserved" for n in range(100, 120))


def test_deep_markup_is_linear():
    for page in ("<div>" * 4000 + "<br>x<p>y</p>" * 4000, "<div>" * 4000 + "</b></section>x<p>y</p></div>" * 4000):
        began = time.time()
        h.tree_rows(page)
        assert time.time() - began < 2


def varied_page(random, words):
    """A page without any mark of what is chrome, whose every branch says something else on each page; and its text."""
    some = lambda n: " ".join(random.choices(words, k=n))
    menu = "".join(f"<li><a href='/{n}'>{some(1)} {n}</a></li>" for n in range(random.randint(3, 7)))
    inner = [(random.choice(["p", "h2", "blockquote"]), some(random.randint(4, 30))) for _ in range(random.randint(2, 12))]
    story = "".join(f"<{t}>{x}</{t}>" for t, x in inner)
    page = f"<body><div class='m1'><ul>{menu}</ul></div><div class='x9'>{some(6)}</div><div class='t2'><h1>{some(5)}</h1></div><div class='story'>{story}</div><div class='z'><span>{some(3)}</span> {some(4)}</div></body>"
    heading = page.split("<h1>")[1].split("</h1>")[0]
    return page, "\n".join([heading, *(x for _, x in inner)])


def test_unmarked_branches_of_one_template_go(spark):
    random = Random(11)
    words = [f"w{n}" for n in range(300)]
    made = [varied_page(random, words) for _ in range(60)]
    rows = [(n, "https://a.example/", page) for n, (page, _) in enumerate(made)] + [(n, f"https://few{n % 10}.example/", page) for n, (page, _) in enumerate(made[:50], 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (h.BROADCAST_PATHS, 0):
        got = {r.page_id: r.text for r in h.extract(df, marks=False, broadcast_paths=bound).collect()}
        assert [got[n] for n in range(60)] == [text for _, text in made]
        assert all(len(got[1000 + n]) > len(made[n][1]) for n in range(50))  # of five pages no branch goes


def test_prose_of_one_template_stays(spark):
    rows = [(n, "https://a.example/", f"<body><div class='lead'><p>Lead {n}</p></div><div class='body'>{'<p>x</p><ul><li>y</li></ul>' * (n % 7)}<p>z {n}</p></div></body>") for n in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df, marks=False).collect()}
    assert all(got[n].startswith(f"Lead {n}\n") and got[n].endswith(f"z {n}") for n in range(40))


def test_unclosed_tags_are_linear():
    for piece in ("<a", "<!", "<?", "<a '", '<a "', "<!--", "</", "<a b='<"):
        began = time.time()
        h.main_text("<p>x</p>" + piece * ((1 << 20) // len(piece)))
        assert time.time() - began < 1.5, piece
