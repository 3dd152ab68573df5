import html
import re

from tests.conftest import SF_SMALL
from tidepool.llm import html as H
from tidepool.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav>menu</nav><!-- <p>no</p> -->
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>two</b>&nbsp;three<br>four<p>Five
<ul><li>x<li>y</ul><div class="share-buttons">Share</div><script>if(a<b)"</p>"</script><blockquote>Q <i>r</i></blockquote>tail
</article><section id="comments"><article class="comment">bad</article></section></main>
<div class="cookie-notice">cookies</div><form>f</form><aside>s</aside><footer>&copy; f</footer></body></html>"""


def test_page_without_what_is_no_article():
    assert H.main_text(PAGE, set()) == "Title & more\nOne two three four\nFive\nx\ny\nQ r\ntail"


def test_broken_pages():
    cases = {"": "", "plain < text &lt;b&gt;": "plain < text <b>", "<p>a<p>b": "a\nb", "<div>a<div>b</div>c</div>": "a\nb\nc",
             "<p>unclosed <b": "unclosed <b", "<script>never": "", "<!-- never": "", "<textarea>a</p>": "",
             "<p title='>'>k</p>": "k", "</p></div>x": "x", "<p>&amp &am &#233;&#xe9;": "& &am éé", "<p>a  \n b": "a b"}
    for page, text in cases.items():
        assert H.main_text(page, set()) == text, page
    wrapped = "<body><form id='aspnetForm'><div class='with-sidebar ad-free'><div class='layout-menu'><main><article><p>in</p></article></main></div></div></form>"
    assert H.main_text(wrapped, set()) == "in"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert H.main_text(deep, set()) == "x"
    assert len(H.main_text("<p>" + "word " * 200_000, set())) == 999_999


def test_given_pages_equal_their_articles(spark):
    pages = table(spark, SF_SMALL, "pages")
    got = {r.page_id: r for r in H.op1_html_main_text(spark, SF_SMALL).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_recurring_subtrees_of_a_host_go_but_shared_prose_stays(spark):
    def page(i):
        return (f"<body><div class='x'>Subscribe to our site</div><div><p>own text {i}</p></div>"
                f"<div id='bottom'><p>All rights reserved</p></div></body>")
    shared = "<body><article><p>the same article</p><div>Read also: z</div><p>part {}</p></article></body>"
    rows = [(i, "http://a.example/p", page(i)) for i in range(20)]
    rows += [(100 + i, "http://b.example/p", shared.format(i % 2)) for i in range(20)]
    rows += [(200, "http://c.example/p", page(3)), (201, None, None), (201, None, None), (202, "http://c.example", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as template")
    got = H.extract_main_text(pages, min_pages=10, min_share=0.5).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert [text[i] for i in range(20)] == [f"own text {i}" for i in range(20)]
    assert text[100] == "the same article\npart 0"
    assert text[200] == "Subscribe to our site\nown text 3\nAll rights reserved"  # one page is no recurrence
    assert text[201] == "" and text[202] == ""
    assert H.extract_main_text(pages.where("false")).count() == 0


def test_hosts(spark):
    urls = {"http://A.example:80/x": "a.example", "https://u:p@b.example?q": "b.example", "//c.example/": "c.example", "x": ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.h for r in df.select("url", H.host_of("url").alias("h")).collect()} == urls


def test_all_articles_and_text_beside_a_short_one_stay():
    many = "<body><nav>m</nav><article><p>first</p></article><article><p>second one</p></article></body>"
    assert H.main_text(many, set()) == "first\nsecond one"
    long = "a long text " * 20
    for page in ("<body><article><p>teaser</p></article><main><p>{}</p></main></body>",
                 "<body><article><p>teaser</p></article><div><p>{}</p></div></body>"):
        assert long.strip() in H.main_text(page.format(long), set())
    assert H.main_text(f"<body><p>out</p><main><p>{long}</p></main></body>", set()) == long.strip()
    assert H.main_text("<body><div><p>no root</p></div></body>", set()) == "no root"


def test_class_words_that_name_content_do_not_drop_prose():
    prose = "what others have found out about this question before"
    page = ("<article><h2 id='alert-levels'>Levels</h2><section id='related-work'><p>{0}</p></section>"
            "<p class='notice-period'>{0}</p><div class='related'><a href='x'>{0}</a></div>"
            "<div class='ad related'>{0}</div></article>").format(prose)
    assert H.main_text(page, set()) == f"Levels\n{prose}\n{prose}"
    assert H.main_text(f"<body><div class='cookie-notice'>{prose * 9}</div><p>in</p></body>", set()) == "in"


def test_recurrence_is_judged_alike_on_small_and_large_hosts(spark):
    def page(i, extra):
        return f"<body>{extra}<div><p>own text {i}</p></div></body>"
    menu, shared = "<div>Section menu</div>", f"<div>{'a shared story ' * 60}</div>"
    rows = [(i, "http://small.example/p", page(i, menu)) for i in range(8)]
    rows += [(1000 + i, "http://large.example/p", page(i, f"<div>Notice {i % 25}</div>")) for i in range(750)]
    rows += [(3000 + i, "http://copy.example/p", page(i, shared)) for i in range(4)]
    text = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(text) == len(rows)
    assert all(text[i] == f"own text {i}" for i in range(8))
    assert all(text[1000 + i] == f"own text {i}" for i in range(750))
    assert all(t.startswith("a shared story") for i, t in text.items() if i >= 3000)


def test_a_page_is_freed_without_the_collector():
    import gc
    gc.collect()
    gc.disable()
    try:
        before = len(gc.get_objects())
        for _ in range(50):
            H.main_text("<body><nav>a</nav><article><p>b<b>c</b></p></article></body>", {1})
            H.page_hashes("<body><nav>a</nav><article><p>b<b>c</b></p></article></body>")
        assert len(gc.get_objects()) - before < 200  # a hundred pages of eight elements and their lists
    finally:
        gc.enable()


def test_batches_are_taken_in_slices(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(H, "SLICE_CHARS", 10)
    b = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 50, "", "abcdef", "abcdef"])], ["html"])
    assert [p.column(0).to_pylist() for p in H.slices(b, 0)] == [["abc", None], ["x" * 50, ""][:1], ["", "abcdef"], ["abcdef"]]
