import random
import zlib

import numpy as np

from ionweave.llm import html, langid

SYLLABLES = {"aa": ["ba", "lo", "mi", "né"], "bb": ["krt", "schu", "zek", "öv"], "cc": ["tion", "ing", "th", "wh"]}


def corpus(n=240):
    r = random.Random(0)
    rows = []
    for k in range(n):
        lang = list(SYLLABLES)[k % 3]
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(r.choice([3, 40, 400])))
        rows.append((k, text, lang, 0.0))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    odd = [(1000, None, "aa", 0.0), (1001, "", "aa", 0.0), (1002, "12 34!", "aa", 0.0), (1003, "ж" * 5, None, 0.0), (1003, "ж" * 5, None, 0.0)]
    out = langid.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")).collect()
    assert len(out) == len(rows) + len(odd)
    got = {r.doc_id: r for r in out}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    test = [k for k, *_ in rows if got[k].held_out]
    assert np.mean([got[k].lang_pred == list(SYLLABLES)[k % 3] for k in test]) > 0.95
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred != "und"


def test_nothing_to_learn(spark):
    kind = "doc_id long, text string, lang string"
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None)], kind)).collect()] == ["und"]
    assert langid.identify(spark.createDataFrame([], kind)).count() == 0


def test_windows_cover_all_bytes():
    sizes = [0, 1, 255, 256, 257, 1000]
    data = np.random.default_rng(0).integers(1, 255, sum(sizes)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    windows, length, doc = langid.cut_windows(data, offsets)
    for d in range(len(sizes)):
        assert np.concatenate([np.zeros(0, np.uint8), *(w[:n] for w, n, k in zip(windows, length, doc) if k == d)]).tolist() == data[offsets[d] : offsets[d + 1]].tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>x</a></li></ul></nav>
<div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>One  two.<br><p>Three\n four &lt;5&gt;</p><div class="comments"><p>nice</p></div><p>Six</article><footer>&copy; f</footer>"""


def text(page, template=()):
    return html.main_text(html.parse(page), frozenset(template))[0]


def test_article():
    assert text(PAGE) == "A & B\nOne two.\nThree four <5>\nSix"
    assert text("") == "" and text("a<b") == "a" and text("a < b") == "a < b" and text("<p>x<p>y") == "x\ny" and text("<ul><li>a<li>b</ul>c") == "a\nb\nc"
    assert text("<div>a <i>b</i>c<!-- no --></div ><script>x") == "a bc"
    assert text("<article><p>a" + "<div>" * 3000 + "deep") == "a\ndeep"
    assert text("<article>" + "<x" * 3) in ("", "<x<x")


def test_site_template_goes(spark):
    r = random.Random(3)
    say = lambda: " ".join(r.choice(["un", "deux", "trois", "quatre", "cinq"]) + str(r.randrange(999)) for _ in range(20))
    rows, want = [], {}
    for k in range(30):
        own = say()
        rows.append((k, f"http://a.example/{k}", f"<body><div><span>Welcome to A</span></div><div class='x'><p>{own}</p></div><div>Call us <b>now</b></div>", 1))
        want[k] = own
    rows += [(100, "http://b.example/1", "<body><div>Call us <b>now</b></div><p>b", 1), (101, None, None, 1), (102, "x", "", 1)]
    want |= {100: "Call us now\nb", 101: "", 102: ""}
    same = "<article><p>The very same article.</p></article>"
    rows += [(200 + k, f"http://c.example/{k}", same, 1) for k in range(20)]
    want |= {200 + k: "The very same article." for k in range(20)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = html.extract(df).collect()
    assert {x.page_id: x.text for x in out} == want and all(x.n_chars == len(x.text) for x in out)
    assert {x.page_id: x.n_template for x in out} == {k: 2 if k < 30 else 0 for k in want}
    html.BROADCAST_ROWS, kept = -1, html.BROADCAST_ROWS
    try:
        assert {x.page_id: x.text for x in html.extract(df).collect()} == want
    finally:
        html.BROADCAST_ROWS = kept


def test_template_of_a_mixed_site(spark):
    """Articles, galleries and copies of one page on a host; menus in six forms that no name or class gives away."""
    r = random.Random(5)
    say = lambda: " ".join(r.choice(["un", "deux", "trois", "quatre", "cinq"]) + str(r.randrange(9999)) for _ in range(20))
    bar = lambda k: f"<div><ul><li><a>Home {k % 6}</a><li><a>About</a></ul></div>"
    rows, want = [], {}
    for k in range(60):
        own = say()
        body = {0: f"<article><h2>News</h2><p>{own}</article>", 1: f"<table><tr><td>{own}</table>", 2: f"<div><div>{own}</div></div>"}[k % 3]
        rows.append((k, "http://m.example/x", f"<body>{bar(k)}{body}<div><b>Write to us</b></div></body>"))
        want[k] = f"News\n{own}" if k % 3 == 0 else own
    copy = say()
    rows += [(100 + k, "http://copy.example/x", f"<body><div>{copy}</div></body>") for k in range(9)]
    want |= {100 + k: copy for k in range(9)}
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in out} == want
    assert all(x.n_template == 2 * (x.page_id < 100) for x in out)


def test_templates_take_menus_adverts_and_footers_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = {x.page_id: x for x in html.extract(pages).collect()}
    alone = {x.page_id: html.main_text(html.parse(x.html))[0] for x in pages.collect()}
    assert sum(x.n_template > 0 for x in out.values()) > 0.9 * len(out)
    assert {k: x.text for k, x in out.items()} == alone


def test_html_empty(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_accepted_keeps_columns_and_rows(spark):
    good = "the words of this text are plain and there are several of them to go by " * 3
    rows = [(k, good + str(k), "en", "a", k, "x") for k in range(20)] + [(98, None, "en", "a", None, "y"), (99, "12 34", None, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, `r.o w` string")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == rows[:20]
    assert langid.accepted(docs.limit(0)).collect() == []
