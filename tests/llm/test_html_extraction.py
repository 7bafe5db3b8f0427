import html
import re

from pyspark.sql import functions as F

from facsimile.llm.html_extraction import Page, extract, query


def text(page):
    return Page(page).text()


def test_markup():
    assert text("<p>A &amp; B&eacute; &#x41;&nbsp; x\n y</p><div>two <b>bold</b>s</div>") == "A & Bé A x y\ntwo bolds"
    assert text("<p>one<p>two<ul><li>a<li>b</ul>tail") == "one\ntwo\na\nb\ntail"
    assert text("<p><b>open<br><p>next") == "open\nnext"
    assert text('<script>var t="</p><p>no";</script><style>p{}</style><p title="a > b">yes<!-- no <p> --></p>') == "yes"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b\nc"
    assert text("") == text("<p> \n </p>") == ""
    assert text("a < b and <unclosed") == "a < b and <unclosed"


def test_parts_that_are_no_main_text():
    page = """<html><head><title>t</title></head><body><header>Site</header><nav><ul><li>m</ul></nav>
    <div class="ad">buy</div><div id="cookie-notice">we use</div><div class="Content">
    <article class="post"><header><h1>Head</h1></header><p>Body</p><aside>side</aside>
    <form><p>sign</p></form><section class="comments"><p>me first</p></section><p>End</p></article></div>
    <div role="navigation">more</div><footer>foot</footer></body></html>"""
    assert text(page) == "Head\nBody\nEnd"
    assert text(page.replace("article", "div")) == "Body\nEnd"
    assert text("<body><p>loose</p><div hidden>no</div><main><p>core</p></main></body>") == "core"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn(
        "template", F.lit("clash"))


def test_templates_go_and_articles_stay(spark):
    box = "<div><p>Read our other stories</p><ul><li>one</ul></div>"
    rows = [(i, f"https://a.org/{i}", f"<body><p>Story {i}</p>{box}<p>Shown everywhere</p></body>") for i in range(12)]
    rows += [(100 + i, f"https://b.org/{i}", f"<article><p>Same lead</p><p>Story {i}</p>{box}</article>") for i in range(12)]
    rows += [(200 + i, f"http://c{i}.org/", f"<body><p>Story</p>{box}</body>") for i in range(12)]
    rows += [(300, None, f"<p>x</p>{box}"), (301, "no url", None), (302, "https://a.org/", ""), (None, "https://d.org", "<p>y" * 50_000)]
    got = {r.page_id: r for r in extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Story 3"                        # recurs across the host: template
    assert got[103].text == "Same lead\nStory 3"           # plain paragraphs of an article stay
    assert got[203].text == "Story\nRead our other stories\none"  # on one page of each host only
    assert got[300].text.startswith("x\nRead") and got[301].text == got[302].text == ""
    assert got[None].n_chars == 2 * 50_000 - 1
    assert extract(pages(spark, [])).count() == 0
    assert extract(pages(spark, rows[:1] * 3)).count() == 3


def test_driver_table_by_plain_rules(spark, sf_dir):
    """The driver's pages are simple: an article whose blocks begin at a tag of their own."""
    got = {r.page_id: r for r in query(spark, sf_dir).collect()}
    source = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(source)
    for r in source:
        main = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", main)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def texts_of(spark, htmls, host="https://a.org"):
    rows = [(i, f"{host}/{i}", h) for i, h in enumerate(htmls)]
    return {r.page_id: r.text for r in extract(pages(spark, rows)).collect()}


def test_copies_of_an_article_stay_whole(spark):
    story = "<div class='frame'><article class='x'><div><p>Lead</p><p>Body of the story</p></div></article></div>"
    menu = "<div><p>Other stories</p></div>"
    copies = texts_of(spark, [f"<body>{story}</body>"] * 12)
    assert set(copies.values()) == {"Lead\nBody of the story"}
    # copies beside other pages, with a menu on all of them
    mixed = texts_of(spark, [f"<body>{menu}{story}</body>"] * 12 + [f"<body>{menu}<article><p>No {i}</p></article></body>" for i in range(8)])
    assert mixed[0] == "Lead\nBody of the story" and mixed[15] == "No 3"


def test_names_are_whole_and_spare_what_holds_the_article():
    for page in ("<body class='single has-sidebar'><p>Core</p></body>", "<body class='no-comments widget'><p>Core</p></body>",
                 "<article class='post category-social tag-promo promo'><p>Core</p></article>",
                 "<article><div class='widget-text'><p>Core</p></div></article>",
                 "<div class='widget'><h1>Core</h1><article></article></div>", "<html class='modal'><main id='menu'><p>Core</p></main>"):
        assert text(page) == "Core"
    assert text("<main><h1>Head</h1><article><p>Core</p></article><p>After</p></main>") == "Head\nCore\nAfter"
    assert text("<body><p>Body</p><article><p>Teaser</p></article></body>") == "Body\nTeaser"
    assert text("<article><p>Core</p><div class='comments'><article class='comment'>me</article></div></article>") == "Core"
    assert text("<p>a <span class='ad'>buy</span>b</p>") == "a b"


def test_templates_of_less_than_half_of_a_host(spark):
    layouts = [f"<div><p>Layout {k} of this site</p></div>" for k in range(3)]
    for page in ("<body>{}<article><p>Story {}</p></article></body>", "<body><main>{}<p>Story {}</p></main></body>"):
        got = texts_of(spark, [page.format(layouts[i % 3], i) for i in range(30)])
        assert got == {i: f"Story {i}" for i in range(30)}
