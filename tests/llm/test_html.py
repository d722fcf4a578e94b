import pytest

from rasterlake.llm import html_text
from rasterlake.llm.html_text import Page


def own(html):
    return Page(html).text_at([])


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<ul><li>x<li>y</ul>", "x\ny"),
    ("<script>var a='<p>no</p>';</script><p>yes", "yes"), ("<!-- a <p>b</p> -->c", "c"), ("<!-- open", ""), ("5 < 6 and 7 > 3", "5 < 6 and 7 > 3"),
    ("<p>one\n\t two&nbsp;three<br>four</p>", "one two three four"), ("<a '", ""), ("<p title='a>b'>t", "t"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>x<b>y</b>z <i>w</i></p>", "xyz w"), ("<style>p{}</style>", ""),
    ("<p>keep <span class=ad>drop</span> this", "keep this"), ("<textarea>t</textarea><p>u", "u"),
])
def test_small_pages(html, text):
    assert own(html) == text


ARTICLE = "<h1>Title</h1><p>First sentence of the text.</p><p>Second one, with <a href=x>a link</a>.</p>"
TEXT = "Title\nFirst sentence of the text.\nSecond one, with a link."
AROUND = (
    "<header><p>Site name and claim</p></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div>"
    "{}<aside>Read this too</aside><div id='comments'><p>I like this, said a reader.</p></div><form><label>Name</label></form>"
    "<div class=ad-box2><p>Buy now, it is cheap.</p></div><footer>&copy; me</footer>"
)


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main><div class='post-body'>{}</div></main>", "<div class=content7>{}</div>"])
def test_surroundings_go(box):
    assert own("<html><body>" + AROUND.format(box.format(ARTICLE)) + "</body></html>") == TEXT


def test_wrapper_named_after_its_surroundings_stays():
    assert own(f"<div class='layout has-sidebar'>{ARTICLE}</div>") == TEXT
    assert own(f"<div class='cookie-wrap'><article>{ARTICLE}</article></div>") == TEXT


def test_odd_nesting_is_no_trouble():
    for html in ("<div>" * 30_000 + "x", "<b>x</i>" * 30_000, '<a "' * 3_000, "</p>" * 30_000, "<p>" * 30_000 + "y"):
        Page(html).text_at([])


def pages(spark, rows, more=""):
    return spark.createDataFrame(rows, "page_id long, url string, html string" + more)


def test_hosts_agree_on_a_path(spark):
    page = "<body><div class=c{0}><p>{1}</p></div><div class=x9><p>Other words of the page.</p></div></body>"
    text = "Article {}, and what it says. " * 20
    rows = [(i, "http://h.example/a", page.format(i, text.format(*[i] * 20))) for i in range(9)]
    rows += [(9, "http://H.example:80/b", page.format(2, "Short, but an article.")), (10, "http://other.example/", page.format(2, "Short."))]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert got[9] == "Short, but an article." and got[10] == "Short.\nOther words of the page."
    assert all(got[i] == text.format(*[i] * 20).strip() for i in range(9))
    read = html_text.read_pages(pages(spark, rows))
    best = html_text.winners(html_text.votes(read, html_text.notices(read))).filter("host = 'h.example'").first()
    assert best.paths[0] == best.strong == "body>div.c#"


@pytest.mark.parametrize("crawls", [2, 3, 8])
def test_an_article_crawled_again_stays_whole(spark, crawls):
    body = "".join(f"<p>Paragraph {n} of the only article here, with some words in it.</p>" for n in range(8))
    rows = [(i, "http://h/", f"<body><p>Read on 2024-01-{i:02}.</p><div class=t>{body}</div></body>") for i in range(crawls)]
    got = html_text.extract(pages(spark, rows)).collect()
    assert all(r.text == own(rows[r.page_id][2]) and "Paragraph 7" in r.text for r in got) and len(got) == crawls
    one = [(i, "http://h/", f"<body><p>Read on 2024-01-{i:02}.</p><div class=t><p>{'All in one. ' * 30}</p></div></body>") for i in range(crawls)]
    assert all("All in one." in r.text for r in html_text.extract(pages(spark, one)).collect())


def test_a_teaser_beside_the_path_of_the_host_goes(spark):
    page = "<body><div class=story><p>Story {0} begins. {1}</p><p>Story {0} ends.</p></div>{2}</body>"
    rows = [(i, "http://h/", page.format(i, f"Sentence of {i}. " * 20, "<div><p>Something else to read.</p></div>" if i == 7 else "")) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i} begins. {f'Sentence of {i}. ' * 20}".strip() + f"\nStory {i} ends." for i in range(20))


def test_notices_of_a_host_with_a_hot_page(spark):
    """A page crawled a hundred times counts once; the notice on all pages goes, also where it is the longest block."""
    notice = "<div class=x><p>This site is funded by those who read it, so write to us at once.</p></div>"
    page = "<body><div class=c><p>Read on day {0}.</p><p>{1} begins, as it has to begin.</p><p>{1} goes on, as it has to go on.</p></div>{2}</body>"
    rows = [(i, "http://h/", page.format(i, "The one story", notice)) for i in range(100)]
    rows += [(100 + i, "http://h/", page.format(0, f"Tale {i}", notice)) for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    for i in range(109):
        name = "The one story" if i < 100 else f"Tale {i - 100}"
        day = i if i < 100 else 0
        assert got[i] == f"Read on day {day}.\n{name} begins, as it has to begin.\n{name} goes on, as it has to go on."


def test_title_and_lead_beside_a_long_body_stay(spark):
    page = "<body><main><h1>Title {0}</h1><div class=lead>Lead {0}.</div><div class=body><p>{1}</p></div><p>Closing {0}.</p></main></body>"
    for n in (1, 200):
        body = ("Many words here. " * n).strip()
        assert own(page.format(1, body)) == f"Title 1\nLead 1.\n{body}\nClosing 1."
    rows = [(i, "http://h/", page.format(i, f"Page {i}. " + "Many words here. " * 200)) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(got[i].startswith(f"Title {i}\nLead {i}.\nPage {i}.") and got[i].endswith(f"Closing {i}.") for i in got) and len(got) == 6


def test_each_layout_of_a_host_keeps_its_article(spark):
    a = "<body><div class=body><p>Article {0} of the first layout. {1}</p></div></body>"
    b = "<body><div class=body><p>Teaser {0}.</p></div><section class=text><p>Article {0} of the second layout. {1}</p></section></body>"
    more = "More of it. " * 30
    rows = [(i, "http://h/", (a if i < 14 else b).format(i, more)) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(f"Article {i} of the" in got[i] for i in range(20))


def test_odd_rows(spark):
    rows = [(1, None, "<p>a"), (2, "http://x/", None), (3, "no url", ""), (None, "http://x/", "<p>b"), (1, None, "<p>a")]
    got = html_text.extract(pages(spark, [r + ("t", "h", 1) for r in rows], ", text string, HOST string, paths int"))
    assert got.columns == ["page_id", "url", "text", "HOST", "paths", "_text"]
    assert sorted(((r.page_id, r._text) for r in got.collect()), key=str) == sorted([(1, "a"), (2, ""), (3, ""), (None, "b"), (1, "a")], key=str)
    assert html_text.extract(pages(spark, [])).count() == 0


def test_all_pages_of_the_test_table(spark):
    """Each page's text is that of its article element, taken out by plain patterns."""
    import re
    from html import unescape

    import __spark_entry__ as driver
    from conftest import SF_DIR

    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in driver.queries()["op1_html_extraction"](spark, SF_DIR).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", " ", b)).replace("<b>", "").replace("</b>", "").split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
