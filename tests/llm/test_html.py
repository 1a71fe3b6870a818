import inspect
import os
import random
import re
import xml.etree.ElementTree as ET
from html import unescape

import pytest

from rowforge.llm.html_text import extract_main_text, host_of, main_text, op5, templates
from rowforge.llm.html_tree import hash_subtrees, parse

CASES = [
    ("<p>One<br>two &nbsp; &amp; three<p>Four <b>five</p>", "One two & three\n\nFour five"),
    ("<article><h1>T</h1><p>a</p></article><footer>f</footer>", "T\n\na"),
    ("<nav>n</nav><header>h</header><main><p>x</p><aside>s</aside></main><form>q</form>", "x"),
    ("<article>a<div class='share-buttons'>s</div><section id=comments><article class=comment>c</article></section>b</article>", "a\n\nb"),
    ("<div class='cookie-notice'>c</div><div id=adBanner>a</div><div>x</div>", "x"),
    ("<div class='content-sidebar-wrap'><article>x</article><div class=sidebar>s</div></div>", "x"),
    ("<script>var t='</p><p>no';</script><style>p{}</style><p>x</p><!-- y --><noscript>z</noscript>", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1 2\n\n3"),
    ("<dl><dt>a<dd>b<dt>c</dl><blockquote>q<p>r</blockquote>", "a\n\nb\n\nc\n\nq\n\nr"),
    ("a < b & c &lt;i&gt; &#233;&#x1F600; &unknown;", "a < b & c <i> é😀 &unknown;"),
    ("<p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>z</p><p>w</p>", "w"),
    ("<p title=\"a>b\">x</p><p title='unclosed>y</p>", "x\n\ny"),
    ("<form><main><p>in a form</p></main></form>", "in a form"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T\n\nx"),
    ("<div><b><p>x</b> y</p></div>", "x y"),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("<![CDATA[a < b]]><p>x", "a < b\n\nx"),
    ("<textarea><p>no</p></textarea>yes", "yes"),
    ("</p></div>x</b>", "x"),
    ("<script>never closed <p>x", ""),
    ("<P CLASS=Menu>m</P><DIV>x</DIV>", "x"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_pages(html, text):
    assert main_text(html) == text


def test_every_prefix_parses():
    html = "".join(h for h, _ in CASES)
    for n in range(0, len(html), 3):
        root = parse(html[:n])
        hash_subtrees(root)
        main_text(html[:n])


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(main_text("<p>" + "word " * 200_000)) == 999_999


def site(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_is_removed(spark):
    """Blocks that say nothing about themselves go by how many pages of the host have them; the same block stays elsewhere."""
    block = "<div class=x1><p>All the best from our team in town</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{block}<div class=x2><p>Story number {i}</p></div><div class=x3><p>Read on {i % 2}</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"https://b.example/{i}", f"<body>{block if i == 0 else ''}<div class=x2><p>Other {i}</p></div></body>") for i in range(12)]
    rows += [(200 + i, None, f"<body>{block}<p>none {i}</p></body>") for i in range(12)]
    got = {r.page_id: r.main_text for r in extract_main_text(site(spark, rows)).collect()}
    assert got[3] == "Story number 3" and got[100] == "All the best from our team in town\n\nOther 0"
    assert got[203] == "All the best from our team in town\n\nnone 3"


@pytest.mark.parametrize("most_broadcast", [200_000, -1])
def test_blocks_of_a_part_of_a_host_are_template(spark, most_broadcast):
    """Three layouts on one host, a third of its pages each, and a block that rotates; no name tells what they are."""
    layouts = ["<div class=q1><p>Town hall hours</p></div>{}", "<section class=q2>{}<p>Horaires de la mairie</p></section>", "{}<ul class=q3><li>Rathaus</li></ul>"]
    rows = []
    for i in range(90):
        story, block = f"<div class=x><p>Story number {i}</p></div>", f"<div class=y><p>Offer {i // 3 % 10}</p></div>"
        layout = layouts[i % 3].format("" if i % 3 == 1 else story) + (story if i % 3 == 1 else "")
        rows.append((i, f"https://a.example/{i}", f"<body>{layout}{block}</body>"))
    got = {r.page_id: r.main_text for r in extract_main_text(site(spark, rows), most_broadcast=most_broadcast).collect()}
    assert got == {i: f"Story number {i}" for i in range(90)}


def block(rng, depth=0):
    """A random element of words and elements, as text."""
    tag = rng.choice(["div", "section", "ul", "p"]) if depth else "div"
    words = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 6)))
    if tag == "p" or depth > 2:
        return f"<p>{words()}</p>"
    if tag == "ul":
        return "<ul>" + "".join(f"<li>{words()}</li>" for _ in range(rng.randint(1, 3))) + "</ul>"
    return f'<{tag} class="c{rng.randrange(9)}">' + "".join(block(rng, depth + 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"


def naive_texts(rows, least):
    """Without hashes and without Spark: subtrees as strings, counted per host over different bodies, deleted, and the rest read."""
    bodies, seen = {}, {}
    for _, url, html in rows:
        bodies.setdefault(url.split("/")[2], set()).add(html)
    for host, own in bodies.items():
        for html in own:
            for s in {ET.tostring(e) for e in ET.fromstring(html).iter() if e.tag in ("div", "section", "ul")}:
                seen[host, s] = seen.get((host, s), 0) + 1

    def read(e, host, whole, out):
        size = sum(len(t) for t in e.itertext())
        short = size <= 200 or 2 * size <= whole
        if e.tag in ("div", "section", "ul") and short and seen[host, ET.tostring(e)] >= (least if size <= 200 else 5):
            return
        if e.text and e.text.strip():
            out.append(" ".join(e.text.split()))
        for x in e:
            read(x, host, whole, out)

    texts = {}
    for page, url, html in rows:
        out, top = [], ET.fromstring(html)
        read(top, url.split("/")[2], sum(len(t) for t in top.itertext()), out)
        texts[page] = "\n\n".join(out)
    return texts


@pytest.mark.parametrize("rules", [True, False])
def test_removal_against_a_naive_count_on_pages_without_articles(spark, rules):
    rng = random.Random(7)
    shared = [block(rng) for _ in range(30)]
    rows = []
    for i in range(150):
        host, parts = f"h{rng.randrange(6)}.example", [block(rng) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((i, f"https://{host}/{i}", "<body>" + "".join(parts) + "</body>"))
    rows += [(500 + i, *rows[i][1:]) for i in range(0, 60, 3)]  # copies add nothing
    expected = naive_texts(rows, 2)
    got = {r.page_id: r.main_text for r in extract_main_text(site(spark, rows), rules=rules).collect()}
    assert got == expected
    untouched = {r.page_id: r.main_text for r in extract_main_text(site(spark, rows), rules=rules, least_pages=10**6, least_long=10**6).collect()}
    assert sum(untouched[i] != got[i] for i in got) > 60


def test_removal_alone_finds_the_sites_templates(spark):
    """Without rules and without choosing articles nearly every host loses text, and no article does."""
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a = {r.page_id: r for r in extract_main_text(pages, rules=False).collect()}
    b = {r.page_id: r for r in extract_main_text(pages, rules=False, least_pages=10**6, least_long=10**6).collect()}
    articles = {r.page_id: r.text for r in op5(spark, sf_dir).collect()}
    assert all(articles[i] in r.main_text for i, r in a.items())
    changed = [i for i, r in b.items() if r.main_text != a[i].main_text]
    hosts = {b[i].url.split("/")[2] for i in changed}
    outside = sum(len(r.main_text) - len(articles[i]) for i, r in b.items())
    taken = sum(len(b[i].main_text) - len(a[i].main_text) for i in changed)
    print(f"{len(hosts)} of {len({r.url.split('/')[2] for r in b.values()})} hosts, {len(changed)} of {len(b)} texts, {taken / outside:.3f} of the text outside articles")
    assert len(hosts) >= 55


def test_templates_inside_articles_go(spark):
    """A shared box in each article goes, the paragraphs that articles share stay."""
    rows = [(i, f"https://a.example/{i}", f"<body><article><p>A line that all quote.</p><p>Story {i}</p><div><p>Read our town paper</p></div></article></body>") for i in range(9)]
    got = {r.page_id: r.main_text for r in extract_main_text(site(spark, rows)).collect()}
    assert got == {i: f"A line that all quote.\n\nStory {i}" for i in range(9)}


def test_a_copied_story_is_no_template(spark):
    story = "<div><p>" + "One story that several pages of the site have in full. " * 20 + "</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body><div class=x>Edition {i}</div>{story}</body>") for i in range(9)]
    got = {r.page_id: r.main_text for r in extract_main_text(site(spark, rows)).collect()}
    assert all("One story" in t and f"Edition {i}" in t for i, t in got.items())


def test_few_of_very_many_pages_are_no_template(spark):
    rows = [("a.example", i, [i, *([-1] if i < 5 else []), *([-2] if i < 40 else [])]) for i in range(20_000)]
    rows += [("b.example", i, [-1]) for i in range(5)]
    hashed = spark.createDataFrame(rows, "host string, body long, hashes array<long>")
    share = inspect.signature(extract_main_text).parameters["least_share"].default
    assert sorted(map(tuple, templates(hashed, 5, 5, share).collect())) == [("a.example", -2), ("b.example", -1)]


def test_copies_and_articles_are_no_template(spark):
    page = "<body><div><p>The same page everywhere</p></div></body>"
    rows = [(i, f"https://a.example/{i}", page) for i in range(20)]
    rows += [(50 + i, f"https://b.example/{i}", f"<body><div class=ad>{i}</div><article><p>An opening line that many stories share.</p><p>{i}</p></article></body>") for i in range(20)]
    got = {r.page_id: r.main_text for r in extract_main_text(site(spark, rows)).collect()}
    assert {got[i] for i in range(20)} == {"The same page everywhere"}
    assert got[57] == "An opening line that many stories share.\n\n7"


def test_large_template_tables_take_the_other_join(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><div><p>foot</p></div><div><p>s {i}</p></div></body>") for i in range(12)]
    a = extract_main_text(site(spark, rows)).select("page_id", "main_text").collect()
    b = extract_main_text(site(spark, rows), most_broadcast=-1).select("page_id", "main_text").collect()
    assert sorted(a) == sorted(b) and dict(map(tuple, a))[5] == "s 5"


def test_hosts(spark):
    urls = ["https://WWW.a.example:80/x", "http://u:p@b.example?q", "no url", "", None, "ftp://[::1]/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host_of(df.u)).collect()] == ["www.a.example", "b.example", "", "", "", "[::1]"]


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a", ""), (2, "http://a", "<p>x"), (2, "http://a", "<p>x")]
    df = site(spark, rows).selectExpr("*", "'o' main_text", "1 __uid", "2 uid", "3 __template", "4 __html", "5 hash")
    out = extract_main_text(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted(r.main_text for r in out.collect()) == ["", "", "", "x", "x"] and {r["uid"] for r in out.collect()} == {2}
    assert extract_main_text(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    """The articles of the test pages, cut out by regular expressions."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op5(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1|li|ul|div|table|tr|blockquote|pre)\b[^>]*>", article))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
