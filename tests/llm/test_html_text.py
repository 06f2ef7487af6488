import random

from barwise.llm.html_text import extract, main_text


def test_parts_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header>Site</header><nav>N</nav>
    <div class="ad">buy</div><main><article><header><h1>A &amp; B</h1></header><p><b>one<br>two<p>three\n&nbsp; four &lt;b&gt;
    <script>var t="</p>";</script><aside>side</aside><form>f</form><ul><li>x<li>y</ul><!-- note --><div class="comments"><p>me too</div>
    <table><tr><td>1</td><td>2</td></tr></table></article></main><section id="comments">c</section><footer>&copy; F</footer></body></html>"""
    assert main_text(page) == "A & B\none two\nthree four <b>\nx\ny\n1 2"
    assert main_text("") == "" and main_text("plain &am text") == "plain &am text" and main_text("<script>x") == ""
    assert main_text("<body><div>keep</div><div class='cookie-notice'>no</div></body>") == "keep"


def test_class_words_do_not_take_the_article():
    page = "<body><div id='page' class='content has-sidebar with-footer'><nav>N</nav><article><header class='article-header'><h1>Title</h1></header><div class='side-by-side'><p>one</p></div><p class='social-history'>two</p><div class='ad'>buy</div></article></div></body>"
    assert main_text(page) == "Title\none\ntwo"
    assert main_text("<body><div class='sidebar'><article><p>story</p></article></div><p>more</p></body>") == "story"
    assert main_text("<body><div class='menu'><p>the whole long story</p></div><div class='ads'>buy</div></body>") == "the whole long story"


def test_templates(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><div><p>Welcome to us</p></div><p>story {i}</p><p>end</p></body>") for i in range(8)]
    rows += [(100 + i, "https://b.example/x", "<body><p>same</p></body>") for i in range(9)]  # one page, copied
    rows += [(200 + i, "https://c.example/x", f"<body><nav>m{i}</nav><article><p>same story</p></article><p>Imprint</p></body>") for i in range(9)]
    rows += [(300, None, None), (301, None, "<p>x</p>"), (302, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template", "'t' AS text")
    got = {r.page_id: r for r in extract(df).collect()}
    assert all(got[i].text == f"story {i}" for i in range(8))
    assert all(got[100 + i].text == "same" for i in range(9))
    assert all(got[200 + i].text == "same story" for i in range(9))
    assert (got[300].text, got[301].text, got[302].text, got[300].n_chars, got[301].n_chars) == ("", "x", "", 0, 1)
    assert extract(df.limit(0)).count() == 0


def test_templates_inside_articles(spark):
    """Unmarked notices in different articles go; copied and nearly copied articles, and inline text, stay."""
    page = lambda inner: f"<body><article>{inner}</article></body>"
    rows = [(i, f"https://a.example/{i}", page(f"<p>story {i} is <b>not</b> short and has words of its own</p><div><p>Join our list</p></div>")) for i in range(8)]
    rows += [(50 + i, f"https://a.example/x{i}", page(f"<p>another {i} tale with words of its own</p>")) for i in range(60)]  # 8 of 68: under a fifth
    rows += [(200 + i, f"https://b.example/{i}", f"<body><p>n{i}</p>{page('<p>same story</p>')}</body>") for i in range(9)]
    rows += [(300 + i, f"https://c.example/{i}", page(f"<p>one long story that was copied</p><p>edit {i}</p>")) for i in range(9)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} is not short and has words of its own" for i in range(8))
    assert all(got[200 + i] == "same story" for i in range(9))
    assert all(got[300 + i] == f"one long story that was copied\nedit {i}" for i in range(9))


def test_depth_and_attributes():
    assert main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert main_text("<p title=don't>one</p><p>two</p><p title=isn't>three</p>") == "one\ntwo\nthree"
    assert main_text("<p title=\"a > b\" data-class='ad'>one</p><br/><a href=/x/>two</a>") == "one\ntwo"
    assert main_text("<article><section id='social-sciences'><p>abc</p></section><div class='my-share-price'>def</div><p>a longer text</p></article>") == "abc\ndef\na longer text"


def test_templates_by_brute_force(spark):
    """Blocks of random pages stay exactly if fewer than five different pages of the host hold them; without counts all stay."""
    r = random.Random(3)
    rows, blocks = [], {}
    for i in range(60):
        host = f"h{i % 3}"
        own = [f"own words of page {i} part {k} and some more of them" for k in range(4)] + [f"{host} shared {r.randrange(12)}" for _ in range(3)]
        r.shuffle(own)
        blocks[i] = (host, own)
        rows.append((i, f"https://{host}/p{i}", "<body><article>" + "".join(f"<section><p>{b}</p></section>" for b in own) + "</article></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, plain = ({x.page_id: x.text for x in extract(df, least).collect()} for least in (5, 10**6))
    for i, (host, own) in blocks.items():
        kept = [b for b in own if sum(b in o for h, o in blocks.values() if h == host) < 5]
        assert got[i] == "\n".join(kept) and plain[i] == "\n".join(own)
    assert got != plain


def test_reader_comments_and_adverts_go():
    story = "<article><h1>Title</h1><p>a story of some length that goes on</p>"
    for block in ("<section id='user-comments'><p>me too, and at great length, longer than the story itself</p></section>", "<ol class='comment-list'><li>first<li>second</ol>", "<div class='promo-box'>buy</div>", "<div class='related'><p>a long list of other stories that holds more text than this short one does</p></div>", "<div class='reader-comments top'>x</div>"):
        assert main_text(f"<body>{story}{block}</article></body>") == "Title\na story of some length that goes on", block
    assert main_text("<body><div><p>short story</p></div><div class='related-box'><p>much longer than the short story that it stands behind</p></div></body>") == "short story"
    assert main_text("<body><div class='main'><p>kept</p></div><div class='list'>kept too</div></body>") == "kept\nkept too"


def test_the_story_is_where_most_text_is():
    long = "the long story that the page is about, with many words in it"
    assert main_text(f"<main><p>{long}</p><article>teaser</article></main>") == f"{long}\nteaser"
    assert main_text(f"<main><article><p>{long}</p></article><p>short</p></main>") == long
    assert main_text(f"<article><p>{long}</p></article><article><a href=x>other story, a link to it</a></article>") == long
    assert main_text("<main></main><article>only this</article>") == "only this"


def test_titles_formulas_and_buttons():
    assert main_text("<body><header><h1>The title</h1></header><div><p>story</p></div></body>") == "The title\nstory"
    assert main_text("<body><header><h1><a href=/>Site</a></h1></header><div><p>story</p></div></body>") == "story"
    assert main_text("<body><header><h1>Site</h1><nav>N</nav></header><p>story</p></body>") == "story"
    assert main_text("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>") == "let x=2 hold"
    assert main_text("<p>Press <button>Save</button> to store.</p><div><button>Share</button></div>") == "Press Save to store."


def test_time_follows_the_length_of_unclosed_nesting():
    import time

    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert len(main_text("<div><p>x" * n)) == 2 * n - 1
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def generated(r: random.Random, n: int):
    """A page and its main text: blocks of the story between blocks that are none, in wrappers that say nothing."""
    words = lambda k: " ".join(r.choice("sun moon star sky cloud rain wind".split()) for _ in range(k))
    body, story = [], []
    for _ in range(n):
        kind = r.randrange(8)
        t = words(r.randint(6, 14))
        if kind < 4:
            tag = r.choice(["p", "div", "blockquote", "h2", "pre", "section"])
            inner = t.replace(" ", r.choice([" ", "\n ", "&#32;", " <b></b>"]), 1)
            body.append(f"<{tag}>{inner}</{tag}>" if tag != "p" or r.random() < 0.5 else f"<p>{inner}")
            story.append(t)
        elif kind == 4:
            body.append("<ul>" + "".join(f"<li>{w}" for w in t.split()) + "</ul>")
            story += t.split()
        elif kind == 5:
            body.append(r.choice(["<nav>{}</nav>", "<aside>{}</aside>", "<form>{}</form>", "<footer>{}</footer>", "<div role='banner'>{}</div>"]).format(words(4)))
        elif kind == 6:
            body.append(r.choice(["<div class='ad'>{}</div>", "<p class='cookie-notice'>{}</p>", "<section id='comments'>{}</section>", "<div class='share-bar x'>{}</div>"]).format(words(3)))
        else:
            body.append(r.choice(["<script>if (a < b) {}</script>", "<style>{}</style>", "<!-- {} -->", "<noscript>{}</noscript>"]).format(words(3)))
    inner = "".join(body)
    page = r.choice(["<body><header>H</header><article>{}</article></body>", "<body class=x><div id='page'><main><div>{}</div></main></div><footer>f</footer>", "<html><head><title>T</title></head><body>{}</body></html>", "<div><div>{}</div></div>"]).format(inner)
    return page, "\n".join(story)


def test_generated_pages_give_their_story(spark):
    r = random.Random(11)
    made = [generated(r, r.randint(4, 14)) for _ in range(300)]
    made = [(p, t) for p, t in made if t]
    rows = [(i, f"https://site{i}.example/", p) for i, (p, _) in enumerate(made)]
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i, (_, t) in enumerate(made) if got[i] != t] == []
