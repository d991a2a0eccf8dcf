import pytest
from tablemill.llm.html_text import extract, main_text

ARTICLE = "<h1>A title &amp; more</h1><p>First  paragraph, which is long enough\nto be read.<br>Next line.</p><p>Second <b>bold</b> and <a href='/x'>linked</a> words go on for a while.</p>"
TEXT = "A title & more\n\nFirst paragraph, which is long enough to be read. Next line.\n\nSecond bold and linked words go on for a while."
MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12)) + "</ul></nav>"
NOISE = [
    "", MENU, "<!-- <p>not this</p> -->", '<div class="ad">Buy this now, it is very cheap and very good for you all.</div>', "<script>var t='</p><p>x</p>';</script><style>p{}</style>",
    "<div class='side sidebar'><p>Some text in the sidebar, which is also long.</p></div>", "<form><label>Name</label><input name=a><button>Go</button></form>",
    "<section id=comments><p>First! This is a comment by a reader, and a long one.</p></section>", '<div role="alert">We use cookies on this page and tell you so here.</div>',
    "<footer>&copy; someone &middot; all rights and a lot of other words go here too.</footer>", "<header><h2>Site name</h2></header>",
    "<div><ul><li><a href=1>One of the links</a><li><a href=2>Another of the links</a></ul></div>",
]


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class='post'>{}</div>", "<main><div><div>{}</div></div></main>"])
def test_article_among_noise(noise, shell):
    page = f"<!DOCTYPE html><html lang=en><head><title>x</title></head><body>{noise}{shell.format(ARTICLE)}{noise}</body></html>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<article><h1>T</h1><p><b>T and more.<br><p>Next&nbsp;one &#233;&lt;b&gt;</article>", "T\n\nT and more.\n\nNext one é<b>"),
        ("<article><h1>Short title</h1><p><b>Only one paragraph here, but long.<br></article>", "Short title\n\nOnly one paragraph here, but long."),
        ("<p title='a>b'>x < y & z</p>", "x < y & z"),
        ("<p>open <!-- never closed <p>y</p>", "open"),
        ("<script>never closed <p>y</p>", ""),
        ('<p class="a>x</p><p>y</p>', "x\n\ny"),
    ],
)
def test_shapes(page, text):
    assert main_text(page) == text


def test_long_and_deep():
    assert main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert len(main_text("<article>" + "<p>word word</p>" * 50_000 + "</article>")) == 50_000 * 11 - 2
    main_text("<" * 20_000 + "<!" * 20_000 + "<a b='" * 2_000)


def test_table(spark):
    rows = [(1, "http://a", f"<article>{ARTICLE}</article>", 5), (1, "http://a", None, 5), (None, None, "<p>x</p>", None)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(1, "http://a", TEXT, len(TEXT)), (1, "http://a", "", 0), (None, None, "x", 1)], key=repr)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WRAPPERS = [
    "<div class='layout with-sidebar'>{}</div>", "<div class='no-comments'>{}</div>", "<div id='search-result-page'>{}</div>", "<form action='/x'><fieldset>{}</fieldset></form>",
    "<object>{}</object>", "<div class=hidden><div class='site-overlay'>{}</div></div>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("noise", NOISE[:-1])
def test_article_in_a_wrapper_with_a_hint(wrapper, noise):
    page = f"<html><body>{MENU}{wrapper.format(f'{noise}<div>{ARTICLE}</div>{noise}')}</body></html>"
    assert main_text(page) == TEXT


def test_wrapper_with_less_than_half():
    outside = "<div>" + "<p><a href='/a'>A teaser</a> with some words</p>" * 30 + "</div>"
    assert TEXT.replace("\n\n", "") in main_text(f"<html><body>{outside}<div class='with-sidebar'><article>{ARTICLE}</article></div></body></html>").replace("\n\n", "")
