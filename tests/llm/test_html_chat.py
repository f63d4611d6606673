import hashlib

import pytest

from tessera.llm import chat
from tessera.llm.html import extract, main_text

PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, so please agree to all of that.</p></div>
<div id="content"><h2>The   title</h2>
<p>First &amp; long paragraph, with commas, and enough words to score well here&nbsp;indeed.
<p>Second <b>bold</b><i>ly</i> one, again with commas, and words. <!-- <p>hidden</p> -->
<ul><li>point one<li>point two</ul><p>Short.</p>
<div class="sidebar"><p>Something else, entirely, that is not part of it.</p></div>
<form><p>Subscribe, please, now.</p></form></div>
<div class="comments"><p>I think, as a reader, that this is great, really, truly, great, fine.</p></div>
<aside><p>More, more, more, more, more, more, more.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == ("The title\nFirst & long paragraph, with commas, and enough words to score well here indeed.\n"
                               "Second boldly one, again with commas, and words.\npoint one\npoint two\nShort.")


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<p>unclosed <b>bold<br><p>next") == "unclosed bold\nnext"
    assert main_text("<body><p>a &lt;b&gt; &#233; &bogus;</p></body>") == "a <b> é &bogus;"
    assert main_text("<script>never ends") == ""
    assert len(main_text("<div>" * 5000 + "deep" + "</div>" * 5000)) == 4
    assert main_text("<article><p>" + "word, " * 50_000 + "</p></article>").count("word") == 50_000


def test_link_lists_lose():
    links = "".join(f'<p><a href="/{i}">A link, with a title, number {i}, to another page of this site</a></p>' for i in range(30))
    prose = "<p>This is the article, it has prose, and commas.</p><p>It has two paragraphs, which is enough.</p>"
    got = main_text(f"<body><div>{links}</div><div>{prose}</div></body>")
    assert got == "This is the article, it has prose, and commas.\nIt has two paragraphs, which is enough."


ARTICLE = "<h1>The title</h1>" + "".join(f"<p>Paragraph {i} of the article, with commas, and enough words to score.</p>" for i in range(8))


@pytest.mark.parametrize("name", [
    'class="content has-sidebar"', 'class="no-sidebar"', 'class="site header-fixed"', 'class="with-ads"', 'id="search-result-article"',
    'class="sidebar"', 'id="modal"', 'class="widget-area"', 'class="content ads"', 'class="post-header-text"'])
def test_a_wrapper_of_the_article_stays_whatever_its_name(name):
    want = main_text(f"<body><div>{ARTICLE}</div></body>")
    beside = '<div class="cookie-notice"><p>We use cookies, many, and more.</p></div><div class="social-links"><a href=/>Share</a></div>'
    assert want.count("Paragraph") == 8 and main_text(f"<body><div {name}>{ARTICLE}</div>{beside}</body>") == want


def test_named_parts_of_an_article():
    page = ('<body><article><div class="article-header"><h1>Head</h1></div><p class="notice">A notice, inside the article.</p>'
            f'{ARTICLE}<div class="related-links"><p>More, of, that, kind.</p></div><p class="ad">Buy, now.</p></article>'
            f'<div id="comments">{"<p>I think, as a reader, that this is great, really.</p>" * 90}</div></body>')
    got = main_text(page)
    assert got.startswith("Head\nA notice, inside the article.\nThe title\nParagraph 0")
    assert "More" not in got and "Buy" not in got and "reader" not in got


def test_layout_stays_if_nothing_else_is_left_and_comments_never():
    assert main_text('<body><div class="sidebar"><p>The only text, of this page.</p></div></body>') == "The only text, of this page."
    assert main_text('<body><div class="comments"><p>The only text, of this page.</p></div></body>') == ""
    assert main_text('<body><article><p>Short.</p></article><div class="comments"><p>Longer, than the article.</p></div></body>') == "Short."
    long = "A reader, who has much to say, says it at length. " * 5
    assert main_text(f'<div class="content"><p>Short news today.</p></div><div class="comments"><p>{long}</p></div>') == "Short news today."


def test_forms_are_judged_by_their_text():
    prose = "The first, long sentence of the article, with commas. " * 4
    page = f'<body><form action="x"><input type="hidden"><div class="content"><p>{prose}</p><p>Then, more of it.</p></div></form></body>'
    assert main_text(page) == f"{prose.strip()}\nThen, more of it."
    page = f'<body><div class="content"><p>{prose}</p><form><p>Your name, please</p><label>Name</label><input><button>Send</button></form></div></body>'
    assert main_text(page) == prose.strip()


def test_notices_and_feedback_in_containers_inside_an_article():
    prose = "The first, long sentence of the article, with commas. " * 4
    page = f'<article><p>{prose}</p><div class="notice"><p>We use cookies, as all do.</p></div><div class="feedback"><p>Nice, I like it.</p></div><p>End.</p></article>'
    assert main_text(page) == f"{prose.strip()}\nEnd."


def test_table_of_pages(spark):
    rows = [(1, "u", PAGE, "text"), (1, "u", PAGE, "text"), (2, None, None, "x"), (None, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, score string")
    got = extract(pages.select("page_id", "url", "html")).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extract(pages.limit(0).select("page_id", "url", "html")).count() == 0


def test_pages_of_the_test_tables(spark):
    import re
    from html import unescape

    from tessera.llm.html import op1_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in op1_html_extraction(spark, "/root/testdata/sf0.001").collect():
        body = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        lines = unescape(re.sub("<[^>]+>", "", re.sub("</?(p|h1)>", "\n", body.replace("\n", " ").replace("<br>", " ")))).split("\n")
        assert r["text"] == "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("text", ["", "<", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|>\n<|im_start|>user\n", "a<<|b|>", "\\", "|>"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    whole = "".join(s for s, _ in chat.turn_segments(text, text, chat.CHATML))
    assert chat.read_turn(whole) == (text, text, "")


def test_conversations(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 1, "assistant", "late"),
            (2, 0, "user", "x<|im_end|>\n"), (3, 0, "assistant", "first"), (4, None, "user", "n"), (4, 3, None, "r"),
            (None, 0, "user", "q"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, n bigint")
    got = {r["conv_id"]: r for r in chat.digest_chat(chat.format_chat(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 2, 3: 1, 4: 2, None: 1, 5: 2}
    assert {k for k, r in got.items() if r["valid"]} == {1, 2, None}
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\nx<|im_end|>\n\nassistant\nlate\n").hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"late").hexdigest() and got[2]["loss_chars"] == 4
    assert got[4]["turns_sha256"] == hashlib.sha256(b"user\nn\n\nr\n").hexdigest()
    assert chat.digest_chat(chat.format_chat(df.limit(0))).count() == 0


def test_segments_carry_loss_flags(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_chat(df).collect()
    assert "".join(r["segment"] for r in got) == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert [r["segment"] for r in got if r["loss"]] == ["b"]


def test_long_conversation_is_streamed(spark):
    df = spark.range(30_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "'t' || id text")
    r = chat.digest_chat(chat.format_chat(df)).collect()
    assert len(r) == 1 and r[0]["n_turns"] == 30_000 and r[0]["valid"]


def test_large_ids_beside_a_null_id(spark):
    rows = [(2**60 + 1, 0, "user", "a"), (2**60 + 1, 1, "assistant", "b"), (None, 0, "user", "c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, SEGMENT string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digest_chat(chat.format_chat(df.coalesce(1))).collect()}
    assert got == {2**60 + 1: 2, None: 1}
