import html
import re
import time

from chainlens.llm.html import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="post page">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do. Please agree, or leave.</p></div>
<div id=wrap><div class="content"><h2>The &eacute;vent</h2><p>First paragraph, with <b>bold</b> and
  <a href=z>a link</a>; more text follows here.<p>Yes.<ul><li>one item, short<li>two</ul>
<div class="advert">Buy now, cheap, today!</div><script>if (a<b) {"</p>"}</script><blockquote>Quoted &lt;i&gt; words &amp; all&nbsp;that.</blockquote></div>
<aside><p>Aside text, which is long, and has marks; many of them, too.</p></aside>
<section id="comments"><p>I liked it, really, very much. Thanks!</p></section></div>
<form><p>Your mail, please: <input name=q></p></form><footer>&copy; Site, all rights.</footer></body></html>"""


def test_article_alone():
    page = PAGE.replace(' class="post page"', "")
    assert main_text(page) == "The évent First paragraph, with bold and a link; more text follows here. Yes. one item, short two Quoted <i> words & all that."


WORDS = "the river ran past mills, farms and towns; nobody could say, at first, why it had risen so fast that spring."
PARA = f"<p>{WORDS} {WORDS.title()}</p>"
TEXT = f"{WORDS} {WORDS.title()}"


def test_three_layouts_without_names():
    """Divisions without telling names, a layout table, and an old page wrapped in a form; with the prior and without it."""
    menu = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(12))
    divisions = f"<body><div class=x1><ul>{menu}</ul></div><div class=x2><div class=x3><h1>A flood</h1>{PARA * 6}<div class=more>{WORDS} {WORDS}</div><div class=x9>Buy now!</div><ul><li>one</li><li>two</li></ul>{PARA}</div><div class=x4><p>Nice, thanks!</p><p>Agreed.</p></div></div><div class=x5>All rights reserved.</div></body>"
    table = f"<body><table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><h2>A flood</h2>{PARA * 5}<blockquote>Short words.</blockquote></td><td>Weather: rain</td></tr></table><p>Copyright, us.</p></body>"
    form = f"<body><form action=x><div><a href=q>Menu</a> <a href=r>Search</a></div><section><section><h1>A flood</h1>{PARA * 4}</section></section><p>Your mail, please: <input></p><select><option>x</option></select></form></body>"
    for priors in (True, False):
        assert main_text(divisions, priors) == " ".join(["A flood", *[TEXT] * 6, f"{WORDS} {WORDS}", "one", "two", TEXT])
        assert main_text(table, priors) == " ".join(["A flood", *[TEXT] * 5, "Short words."])
        assert main_text(form, priors) == " ".join(["A flood", *[TEXT] * 4])


def test_names_of_wrappers_exclude_nothing():
    for wrapper in ('<div class="layout with-sidebar">', '<div id="main" class="has-header">', '<section class="comments-open ad-free">'):
        assert main_text(f"<body><div>Home page.</div>{wrapper}<article><h1>A flood</h1>{PARA * 3}</article></body>") == " ".join(["A flood", *[TEXT] * 3])


def test_short_articles_beside_long_comments_and_footers():
    comments = f'<div class="comments">{PARA * 8}</div>'
    assert main_text(f"<body><article><h1>A flood</h1><p>{WORDS}</p></article>{comments}</body>") == f"A flood {WORDS}"
    assert main_text(f'<body><article><p>{WORDS}</p><section id="comments"><article>{PARA * 3}</article></section></article></body>') == WORDS
    assert main_text("<body><article><h1>Notice</h1><p>Closed today</p></article><footer><p>All rights reserved, by us; see here.</p></footer></body>") == "Notice Closed today"
    assert main_text(f"<body>{comments}</body>") == " ".join([TEXT] * 8)  # nothing else has text
    bar = '<div class="cookie-bar"><p>We use cookies, as all do; please agree, or leave, now.</p></div>'
    assert main_text(f"<body>{bar}<main><p>Closed.</p></main></body>") == "Closed."


def test_sections_of_an_article_stay_together():
    page = f"<body><nav><a href=a>Home</a></nav><main><section><h2>A</h2>{PARA}</section><section><h2>B</h2>{PARA * 12}</section></main></body>"
    assert main_text(page) == " ".join(["A", TEXT, "B", *[TEXT] * 12])


def test_short_blocks_between_paragraphs():
    page = f'<article>{PARA}<div class="code">x = 1</div>{PARA}<div class="pull">Short quote</div><ul><li><a href=x>A link</a></li></ul>{PARA}<ul><li><a href=y>More news</a></li></ul></article>'
    assert main_text(f"<body>{page}</body>") == " ".join([TEXT, "x = 1", TEXT, "Short quote", "A link", TEXT])


def reading(page):
    """What a reading that knows the table's one layout gives."""
    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1])
    parts = (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]+>", inner))
    return " ".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert sum(got[r.page_id] == reading(r.html) for r in rows) >= 0.99 * len(rows)
    assert sum(main_text(r.html, priors=False) == reading(r.html) for r in rows) >= 0.95 * len(rows)  # by ratios alone


def test_time_grows_with_the_page():
    began = time.time()
    for page in ('<a title="x ' * 40_000, '<a title="x ' * 40_000 + '>"', "<div>" * 40_000 + "deep, text." + "</p>" * 40_000 + "<title>" * 40_000 + "<i '" * 40_000, "<script>" * 40_000, "<p hidden>" * 40_000):
        main_text(page)
    main_text("".join(f"<div class='c{chr(97 + i % 26) * (i % 50 + 1)}{chr(97 + i // 26 % 26) * (i // 1300 + 1)}'>text {i}, more.</div>" for i in range(100_000)))
    assert time.time() - began < 60


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<script>never ends") == ""
    assert main_text("plain words, no tags") == "plain words, no tags"
    assert main_text("<p>one<p>two < three <b>x") == "one two < three x"
    assert main_text("<div>" * 3000 + "deep, text." + "</div>" * 10) == "deep, text."
    assert len(main_text("<article><p>" + "word, " * 200_000 + "</p></article>")) == 6 * 200_000 - 1
    rows = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3), (None, "u", "<p>a b.</p>", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in extract(rows).collect()) == [("", 0), ("", 0), ("a b.", 4)]
    assert extract(rows.limit(0)).collect() == []
