import html
import re
import time

import pytest

from panelwise.llm.html_text import OUTSIDE_CHARS, SURGE_CHARS, WINDOW, extract, lines_of, main_text

ARTICLE = "<h1>A &amp; B</h1><p>First  line\n of <b>bold</b>text &lt;3.</p><p>Second.<br>Third<p>open <a href='x>y'>link</a> end"
PLAIN = "A & B First line of boldtext <3. Second. Third open link end"
AROUND = {
    "nav": "<nav><ul><li><a href=/a>Menu</a></li></ul></nav>", "header": "<header><h2>Site</h2> name</header>", "footer": "<footer>&copy; us</footer>",
    "aside": "<aside>More <p>to read</aside>", "ad": '<div class="ad">Buy <div>now</div></div>', "cookie": "<div id='cookie-notice'>We use</div>",
    "form": "<form><label>Name</label><input><select><option>x</select></form>", "script": '<script>var t="</p><article>";</script>',
    "style": "<style>p{a:b}</style>", "comment": "<!-- <p>no</p> -->", "readers": "<section class=comments><article class='comment'>Nice!</article></section>",
    "hidden": "<div hidden>secret</div>", "sidebar": "<div class='left sideBar'>side</div>", "noscript": "<noscript><p>turn on</p></noscript>",
}


@pytest.mark.parametrize("name", AROUND)
def test_article(name):
    junk = AROUND[name]
    page = f"<!DOCTYPE html><html><head><title>T &amp; U</title>{AROUND['style']}</head><body class='has-sidebar'>{junk}<article>{ARTICLE}</article>{junk}</body></html>"
    assert main_text(page) == PLAIN
    within = f"<body><main><div class='post-content sidebar'>{ARTICLE}</p>{junk}<p>Last.</p></div></main>"
    assert main_text(within) == PLAIN + ("" if name != "header" else " Site name") + " Last."


def test_surge_and_dive_without_article():
    text = ["Headline", "A paragraph that is long enough to be taken for text, as it goes on and on and on.", "Short one.", "Another paragraph, also long enough to count as running text of the page."]
    links = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(9))
    page = f"<body>{links}<div><h2>{text[0]}</h2>" + "".join(f"<p>{t}</p>" for t in text[1:]) + f"</div>{links}<div>tiny</div></body>"
    assert main_text(page) == " ".join(text)


def test_odd_pages(spark):
    odd = {1: None, 2: "", 3: "just text", 4: "<p>a<", 5: "<article>x &amp", 6: "<!-- never closed <p>a", 7: "<script>never", 8: "<article><p class='ad'>ad<p>text</article>",
           9: "<div><p>" * 3000 + "deep" + "</div>" * 3000, 10: "a < b and c > d", 11: "<article>" + "word " * 200_000 + "</article>", 12: "<nav>open menu <article>t</article>", 13: "<title>only"}
    want = {1: "", 2: "", 3: "just text", 4: "a<", 5: "x &", 6: "", 7: "", 8: "text", 9: "deep", 10: "a < b and c > d", 11: ("word " * 200_000).strip(), 12: "t", 13: "only"}
    df = spark.createDataFrame([(k, "u", v, "t") for k, v in odd.items()] + [(1, "u", None, "t")], "page_id long, url string, html string, text string")
    got = extract(df, keep=["page_id", "url"]).collect()
    assert len(got) == len(odd) + 1
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert extract(df.limit(0), keep=["page_id"]).count() == 0


def test_pages_of_the_tables(spark):
    """Brute force for this table's own shape: what stands between the article's tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in extract(pages, keep=["page_id"]).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b.replace("<br>", " "))).split()) for b in blocks)
        assert texts[r.page_id] == " ".join(want.split())


def test_teaser_articles_beside_a_plain_div():
    text = ["Paragraph one of the page's own text, " * 8, "Paragraph two of it, just as long. " * 8]
    cards = "".join(f"<article><h3>Teaser {i}</h3></article>" for i in range(3))
    page = f"<body><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div>{cards}</div><div>tiny</div></body>"
    got = main_text(page)
    assert all(t.strip() in got for t in text) and "Teaser 2" in got and "tiny" not in got


@pytest.mark.parametrize("size", [600, 10_000])
def test_parts_after_adverts_and_long_paragraphs(size):
    long, last, ad = "x" * size, "A closing paragraph. " * 14, "<div class='ad'>Buy</div>"
    page = f"<body><div><h1>Title</h1><p>by me</p><p>1 May</p><p>{long}</p><p>{long}</p><p><a href=/s>A source</a></p><p>{long}</p>{ad}<p>{last}</p>{ad}<p>End.</p></div>{ad}<div>tiny</div></body>"
    assert main_text(page) == f"Title by me 1 May {long} {long} A source {long} {last.strip()} End."
    apart = f"<body><div><p>{long}</p></div>{ad}<div><p>{last}</p></div>{ad}<div>tiny</div></body>"
    assert main_text(apart) == f"{long} {last.strip()}"


def by_definition(page):
    """Sums, surges and dives line by line, as they are defined, over the lines of the page."""
    lines = lines_of(page)
    marked = any(x.inside for x in lines)
    weigh = lambda x: x.weight + SURGE_CHARS if x.inside else max(0, x.weight - OUTSIDE_CHARS) if marked else x.weight
    rows = []
    for i, x in enumerate(lines):
        rows += [(None, 0)] * (WINDOW if i and x.gap else 0) + [(x, weigh(x))]
    sums = [sum(w for _, w in rows[i:i + WINDOW]) for i in range(len(rows))]
    surge = SURGE_CHARS if marked else min([SURGE_CHARS, *([max(sums)] if sums else [])])
    text = []
    for i, (x, w) in enumerate(rows):
        if x is None or sums[i] == 0:
            continue
        begin, end = i, i
        while begin and sums[begin - 1] > 0:
            begin -= 1
        while end + 1 < len(rows) and sums[end + 1] > 0:
            end += 1
        between = any(v > 0 for _, v in rows[begin:i + 1]) and any(v > 0 for _, v in rows[i:end + 1])
        if max(sums[begin:end + 1]) >= surge and between and (w > 0 or not marked or x.inside):
            text.append(x.text)
    return " ".join(text)


def test_pages_against_the_definition_and_without_article_tags(spark):
    """The sums decide: with the tags that mark the article taken away, nearly all pages give the same text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert all(main_text(p) == by_definition(p) for p in pages)
    bare = [re.sub(r"</?(?:article|main)\b[^>]*>", "", p) for p in pages]
    assert all("<article" not in p for p in bare) and all(main_text(p) == by_definition(p) for p in bare)
    same = sum(main_text(p) == main_text(q) for p, q in zip(pages, bare, strict=True))
    assert same >= 0.95 * len(pages), same / len(pages)


def test_notice_beside_an_article():
    notice = "<div class='box'>We use small files to remember you. By going on you agree to it, as all do.</div>"
    text = "A paragraph that is long enough to be taken for text, as it goes on and on and on."
    page = f"<body>{notice}<article><p>{text}</p><p><a href=/x>a link</a></p></article>{notice}<article><p>{text}</p></article></body>"
    assert main_text(page) == by_definition(page) == f"{text} a link {text}"


@pytest.mark.parametrize("piece", ["<div class='ad'>x", "<script", "<nav><p>y", "<title>z", "<a href='q", "<b>w<!", "<section class=menu>"])
def test_unclosed_tags_take_linear_time(piece):
    page = piece * (1_760_000 // len(piece))
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 20
