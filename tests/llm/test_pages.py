"""Main text of pages written by hand, with and without an element that marks the article."""

import pytest

from wherescore.llm.html import extract, main_text

A = "The first paragraph is long enough to be a surge by itself, as it has about a hundred characters in it."
B = "The second paragraph goes on with the story and is as long as the one that stands before it on the page."
LONG = f"<p>{A}</p><p>{B}</p>"
BOTH = f"{A}\n{B}"
WIDE = f"<p>{A} {B}</p>"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/c>Contact</a></li></ul>"

MARKED = {
    "short paragraphs": ("<article><h1>Hi</h1><p>a</p><p>b</p><p>c</p><p>d</p></article>", "Hi\na\nb\nc\nd"),
    "comments as articles": (
        f'<main><article><h1>T</h1>{LONG}</article><article class="comment"><p>nice post</p></article></main>',
        f"T\n{BOTH}",
    ),
    "comments in the article": (f'<article>{LONG}<section id="comments"><article><p>nice</p></article></section></article>', BOTH),
    "only comments in main": (f'<main><h1>T</h1>{LONG}<article class="comment odd" id="comment-12">me too</article></main>', f"T\n{BOTH}"),
    "comments open": (f'<article class="post comments-open">{LONG}</article>', BOTH),
    "wrapper": (f'<div class="content search"><nav>x</nav><main>{LONG}</main></div><div>about us</div>', BOTH),
    "named article": (f'<article class="post widget-area-free">{LONG}</article>', BOTH),
    "heading ids": (f'<article>{LONG}<h2 id="related-work">Related work</h2><p>x</p><h2 id="social-impact">Impact</h2></article>', f"{BOTH}\nRelated work\nx\nImpact"),
    "own header": (f'<article><div class="article-header"><h1>T</h1></div><header>by me</header>{LONG}</article>', f"T\nby me\n{BOTH}"),
    "label": ("<article><p>a <label>b</label> c</p></article>", "a b c"),
    "comment without text": (f"<article><!-->{LONG}<!---><p>x</p><!-- <p>no</p> --!></article>", f"{BOTH}\nx"),
    "links of the article": (f"<article>{LONG}<p>See</p>{MENU}</article>", f"{BOTH}\nSee\nHome\nNews\nSport\nContact"),
    "paragraph in a link": (f"<article><p>{A}</p><p><a href=x>all of it</a></p><p>{B}</p></article>", f"{A}\nall of it\n{B}"),
    "teaser of links": (f"<article><a href=x>Another page</a></article><div>{MENU}</div><article>{LONG}</article>", BOTH),
    "text beside a teaser": (f"<article>New!</article><div>{WIDE * 3}</div>", f"New!\n{A} {B}\n{A} {B}\n{A} {B}"),
    "text outside": (f"<div>Site</div><article>{LONG}</article><div>All rights reserved.</div>", BOTH),
    "sidebar and advert": (f'<article><p>{A}</p><aside>see also</aside><div class="ad">buy</div><p>{B}</p></article>', BOTH),
    "role": (f'<div>Site</div><div role="main">{LONG}</div><div role="contentinfo">c</div>', BOTH),
    "form": (f"<article>{LONG}<form><label>Mail</label><input><button>Go</button></form></article>", BOTH),
    "two articles": (f"<article>{LONG}</article><article><p>Short.</p></article>", f"{BOTH}\nShort."),
}
UNMARKED = {
    "title above a menu": (f"<body><h1>My title</h1>{MENU}{LONG}<p>The end.</p></body>", f"My title\n{BOTH}\nThe end."),
    "title and short end": (f"<h1>My title</h1>{LONG}<p>End.</p>", f"My title\n{BOTH}\nEnd."),
    "wrapper": (f'<div class="content search"><h1>T</h1>{LONG}</div>', f"T\n{BOTH}"),
    "wrapper with parts": (f'<div id="search"><div class="menu">m</div><h1>T</h1>{LONG}<div class="comments"><h3>2</h3>no</div></div>', f"T\n{BOTH}"),
    "only an advert": ('<div class="ad">buy this</div>', ""),
    "only comments": (f'<div class="comments"><h3>Comments</h3>{LONG}</div>', ""),
    "only short text": ("<p>short</p>", "short"),
    "menu around": (f"{MENU}{LONG}{MENU}", BOTH),
    "footer": (f"{LONG}<footer>{A}</footer><div class='cookie-notice'>{A}</div>", BOTH),
    "headings within": (f"{LONG}<h2 id=menu>Food</h2><p>x</p>{LONG}", f"{BOTH}\nFood\nx\n{BOTH}"),
    "two links within": (f"<p>{A}</p><p><a href=x>one</a></p><p><a href=y>two</a></p><p>{B}</p>", f"{A}\none\ntwo\n{B}"),
    "all in links": ("<a href=x><p>one</p></a>", "one"),
    "nothing": ("<script>x</script><style>y</style>", ""),
}


@pytest.mark.parametrize("name", MARKED)
def test_marked_pages(name):
    page, text = MARKED[name]
    assert main_text(page) == text


@pytest.mark.parametrize("name", UNMARKED)
def test_unmarked_pages(name):
    page, text = UNMARKED[name]
    assert main_text(page) == text


def test_line_blocks_decide_where_an_article_begins():
    assert main_text(f"<div>Logo</div><div>x</div><div>y</div><div>z</div><h1>T</h1>{LONG}") == f"y\nz\nT\n{BOTH}"


def test_rows_of_pages(spark):
    rows = [(1, "u", f"<article>{LONG}</article>", "q"), (1, "u", f"<article>{LONG}</article>", "q"), (2, None, None, None), (None, "u", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(tuple(r) for r in extract(pages).collect() if r.page_id == 1)
    assert found == [(1, "u", BOTH)] * 2
    assert extract(pages).where("text = ''").count() == 2
    assert extract(pages.limit(0)).count() == 0
