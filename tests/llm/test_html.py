import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pairloom.llm.common import table
from pairloom.llm.html_text import BAD, GOOD, UNDECIDED, blocks, extract, first_pass, main_text, second_pass
from pairloom.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"
PROSE = "The house that we saw was on the hill and it had been there for as long as any of us could tell, so we went up to it in the rain. "


class Articles(HTMLParser):
    """Text of articles, parted at headings and paragraphs: enough for the pages of the tables."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts += [""] if tag in ("p", "h1", "article") else []
        self.parts[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts += [""] if tag in ("p", "h1", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data


def plain(html):
    reader = Articles()
    # A tag that the page's end cuts off is no text.
    reader.feed(re.sub(r"<[^>]*\Z", "", html or ""))
    reader.close()
    return "\n\n".join(t for t in (" ".join(p.split()) for p in reader.parts) if t)


def test_query_matches_a_plain_parser(spark, sf_dir):
    got = {r.page_id: r for r in QUERIES["op12_html_extraction"](spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert (got[r.page_id].url, got[r.page_id].text) == (r.url, plain(r.html))
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_page_without_marks():
    """Only words, lengths and links tell the article."""
    page = (
        "<ul><li><a href='/'>Home</a><li><a href='/n'>News of the day and of the week</a></ul><div>Top</div>"
        f"<div><h1>A house</h1><p>{PROSE * 2}<p>Short one.<p>{PROSE * 3}</div>"
        "<div><a href='/1'>One more of the many</a> | <a href='/2'>And what they say about it in the end</a></div><p>&copy; 2020 all of it</p>"
    )
    body = " ".join((PROSE * 2).split())
    assert main_text(page) == f"A house\n\n{body}\n\nShort one.\n\n{' '.join((PROSE * 3).split())}"


def test_boilerplate_is_left_out():
    parts = [
        "<header><p>{}</p></header>", "<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", "<form><p>{}</p></form>", "<div class='cookie-notice'>{}</div>", "<div id='sidebar'>{}</div>",
        "<div role=banner>{}</div>", "<section class='reader comments'><article><p>{}</p></article></section>", "<script>{}</script>", "<style>{}</style>", "<noscript>{}</noscript>", "<!-- {} -->", "<div hidden>{}</div>",
    ]
    noise = "".join(p.format(PROSE.replace("house", "NOISE") * 3) for p in parts)
    # A header within the article is its own.
    own = noise[noise.index("<nav>") :]
    for page in (f"{noise}<main><article><header><h1>Title</h1></header>{own}<p>{PROSE}</p></article></main>{noise}", f"<body>{noise}<div><p>{PROSE * 2}</p></div>{noise}"):
        text = main_text(page)
        assert "NOISE" not in text and PROSE.strip() in text
    assert main_text("<article><h1>T</h1><div class=ad>Buy this now</div><p>Short.</p></article>") == "T\n\nShort."
    assert main_text(f"<main><p>{PROSE}</p></main><p>{PROSE * 4}</p>") == PROSE.strip()
    assert main_text("<article><p>x</p><p><a href=1>only</a> <a href=2>links</a></p><p>y</p></article>") == "x\n\ny"


def test_references_space_and_breaks():
    assert main_text("<article><p>a&amp;b &lt;p&gt; &#233;&#x4E2D; &nbsp; c<br>d\n\t e<b>f</b>g &unknown; &am</article>") == "a&b <p> é中 c d ef" + "g &unknown; &am"
    assert main_text("<article>one<br><br>two<p>three</article>") == "one\n\ntwo\n\nthree"
    assert main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert main_text("<article><p title='a > b' class=\"x>y\">in</p><p>cut <b") == "in\n\ncut"


def test_passes():
    page = [b for b in blocks(f"<p>{PROSE}</p><p>Short</p><p><a>all of the link that is here</a></p><p>{'zzz ' * 40}</p>")]
    assert [first_pass(b, b.text(), False) for b in page] == [UNDECIDED if len(PROSE) < 140 else GOOD, UNDECIDED, BAD, BAD]
    assert first_pass(page[3], page[3].text(), True) is UNDECIDED
    u = UNDECIDED
    assert second_pass([u, GOOD, u, u, BAD, u], BAD) == [1, 1, 1, 0, 0, 0]
    assert second_pass([GOOD, u, BAD], BAD) == [1, 1, 0]
    assert second_pass([u, u], GOOD) == [1, 1] and second_pass([u], BAD) == [0] and second_pass([], BAD) == []


def test_odd_pages(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "no markup"), (5, "u", long), (6, "u", "<article><p>same</p>"), (6, "u", "<article><p>same</p>"), (None, "u", "</p></p><article>x"), (8, "u", "<script>never closed <p>x"), (9, "u", "<<<>>>&&&")]
    df = spark.createDataFrame(rows, PAGES)
    for name in ("_id", "text", "n_chars", "label", "a.b"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert len(got) == len(rows) and got.count((6, "u", "same", 4)) == 2
    by_id = {r[0]: r for r in got}
    assert [by_id[k][2] for k in (1, 2, 3, 8)] == [""] * 4 and by_id[None][2] == "x" and by_id[5][3] == len(PROSE.strip()) * 20_000 + 2 * 19_999
    assert extract(df.limit(0)).collect() == []


def test_time_grows_with_the_page():
    for piece in ("<a ", '<a b="', "<p>", "</p>", "<!--", "<script>", "&amp;", "<", "<br>", "<!", "</", "<div>a"):
        main_text(piece * 50_000)
