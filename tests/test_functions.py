import pytest
from pyspark.sql import functions as F

from siltstone.functions import markup, text, urls

LINKS = {
    "https://www.Example.com/a/b/?utm_source=x&q=1#frag": "https://example.com/a/b?q=1",
    "http://m.example.com/a//": "https://example.com/a",
    "https://youtu.be/abc?t=3": "https://youtube.com/watch?v=abc",
    "https://m.youtube.com/watch?v=abc&list=2": "https://youtube.com/watch?v=abc",
    "https://www.youtube.com/watch?list=2&v=abc": "https://youtube.com/watch?v=abc",
    "https://a.example/p?x=1&y=&ref=z&b=a+b%20c": "https://a.example/p?x=1&b=a+b+c",
    "https://a.example/p?q=%C3%A9*~(1)&bad=100%25zz": "https://a.example/p?q=%C3%A9%2A~%281%29&bad=100%25zz",
    "https://a.example:8080/Path/?A=b": "https://a.example:8080/Path?A=b",
    "HTTPS://WWW.A.EXAMPLE": "https://a.example",
    "https://a.example?x=1": "https://a.example?x=1",
    "https://a.example/p?x=1=2&x=3": "https://a.example/p?x=1%3D2&x=3",
    "https://user@a.example/x/#y?z=1": "https://user@a.example/x",
}


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_canonical(spark):
    assert column(spark, list(LINKS), urls.canonical) == list(LINKS.values())


def test_canonical_of_nothing(spark):
    assert column(spark, [None, "", "no link"], urls.canonical) == [None, None, None]


def test_kinds(spark):
    given = ["https://www.youtube.com/x", "https://m.youtube.com/x", "https://gist.github.com/a/b", "https://github.com/a", "https://huggingface.co/papers/1", "https://x.com/huggingface.co/papers", "https://twitter.com/a", "https://a.example", None]
    assert column(spark, given, urls.fetch_kind) == ["youtube", "blog", "github", "github", "paper", "paper", "tweet", "blog", None]
    assert column(spark, given, urls.share_kind) == ["youtube", "youtube", "blog", "github", "paper", "paper", "tweet", "blog", None]


def test_routes_papers_and_endings(spark):
    routes = ["https://gist.github.com/a", "https://gist.github.com/a/b", "https://github.com/a", "https://github.com/", "https://github.com/a/b/blob/main/x", "https://github.com/a/b/pull/1", "https://github.com/a/b/tree/x"]
    assert column(spark, routes, urls.github_route) == ["skipped", "gist", "user", "skipped", "blob", "issue", "repo"]
    papers = ["http://arxiv.org/abs/2101.00001v2", "https://www.arxiv.org/pdf/2101.00001.pdf", "https://arxiv.org/html/2101.00001/", "https://openreview.net/x"]
    assert column(spark, papers, urls.arxiv_id) == ["2101.00001"] * 3 + [None]
    assert column(spark, ["https://a.b/x.PNG", "https://a.b/x.jpeg2000", "https://a.b/x"], urls.media_extension) == ["png", "jpg", "jpg"]
    assert column(spark, ["git@github.com:o/r.git", "https://github.com/o/r", "https://other.example/o/r"], urls.repo_of_remote) == ["o/r", "o/r", None]


def test_links_in_text(spark):
    got = column(spark, ["see https://a.example/x., (https://b.example/y) and <https://c.example>", "none", None], urls.links_in)
    assert got == [["https://a.example/x", "https://b.example/y", "https://c.example"], [], None]


def test_internal(spark):
    given = ["https://kb.example/x", "http://sub.kb.example", "https://notkb.example", "https://kb.example.org"]
    assert column(spark, given, lambda u: urls.is_internal(u, ["kb.example"])) == [True, True, False, False]
    assert column(spark, given, lambda u: urls.is_internal(u, [])) == [False] * 4


@pytest.mark.parametrize("given, wanted", [("Hello,  World!", "hello-world"), ("--", "untitled"), ("", "untitled"), ("a" * 39 + " b", "a" * 39), ("é", "untitled")])
def test_slugify(spark, given, wanted):
    assert column(spark, [given], text.slugify) == [wanted]


def test_substance_counts_characters_without_links(spark):
    assert column(spark, ["a https://x.example  b\u00a0 c ", "", None], text.substance) == [5, 0, None]


def test_front_matter(spark):
    given = ["\ufeff---\r\na: 1\r\nb: x: y\r\na: 2\r\n---\r\nbody\r\nmore", "---\nopen: 1\nno end", "plain", "---\n---\nempty", "---\nnocolon\n---"]
    got = column(spark, given, text.front_matter)
    assert [(dict(g.fields), g.body) for g in got] == [
        ({"b": "x: y", "a": "2"}, "body\nmore"), ({}, given[1]), ({}, "plain"), ({}, "empty"), ({}, ""),
    ]


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:01 --> 00:02 align:start\n<c>hello</c>\nhello\n\n2\nhello \nworld\nhello"
    assert column(spark, [vtt], text.caption_text) == ["hello\nworld\nhello"]


def test_log_entry(spark):
    got = column(spark, ["## [2024-01-02] lint | all good", "## other"], text.log_entry)
    assert [tuple(g) for g in got] == [("2024-01-02", "lint", "all good"), (None, None, None)]


def test_citations_and_links(spark):
    t = "x `2024-01-02-a-b-0a1b2c` `2024-01-02-a-b-0a1b2c` `bad` [[one]] [[Two]] [[one]] [[a|b]]"
    assert column(spark, [t], text.citations) == [["2024-01-02-a-b-0a1b2c"]]
    assert column(spark, [t], text.wikilinks) == [["one"]]


def test_rewritten_capture(spark):
    df = spark.sql("SELECT map('asset', 'a', 'x', '1', 'name', 'n', 'y', '2') AS f, 'body' AS b, 'media/1' AS m")
    assert df.select(text.rewritten_capture(F.col("f"), F.col("b"), F.col("m"))).first()[0] == "---\nmedia: media/1\nx: 1\ny: 2\n---\n\nbody\n"
    rewritten = lambda note: spark.createDataFrame([(note,)], "v string").select(text.front_matter(F.col("v")).alias("n")).select(
        text.rewritten_capture(F.col("n.fields"), F.col("n.body"), F.lit("media/2"))).first()[0]
    assert rewritten("---\nasset: a\nx: 1\n---\n\n\nnote\n\n") == "---\nmedia: media/2\nx: 1\n---\n\nnote\n"
    assert rewritten("---\nasset: a\nmedia: old\n---\n \n") == "---\nmedia: media/2\nmedia: old\n---\n"


def test_markup(spark):
    pages = ['<meta property="og:image" content="https://i/1.png">', "<meta content='https://i/2.png' name='og:image'/>", "<p>none</p>"]
    assert column(spark, pages, markup.og_image) == ["https://i/1.png", "https://i/2.png", None]
    feed = "<feed><title>q</title><entry><title>A:\n B</title><summary> x\n y </summary><published>2024-05-06T00:00</published></entry></feed>"
    assert tuple(column(spark, [feed], markup.paper_fields)[0]) == ("A - B", "x y", "2024-05-06")
    assert column(spark, [30, 90, 150, None], markup.minutes, "int") == [0, 2, 2, 0]
    page = "<html><head><title>t</title></head><body><nav>menu</nav><h1>Head</h1><p>One &amp; <b>two</b></p><script>x()</script><ul><li>a</li><li>b</li></ul></body></html>"
    assert column(spark, [page, None, ""], markup.article_text) == ["Head\nOne & two\na\nb", None, ""]


def test_caption_track(spark):
    kind = "map<string,array<struct<ext:string,url:string>>>"
    df = spark.createDataFrame(
        [(1, {"de": [("vtt", "d")], "en-GB": [("vtt", "g")], "en": [("srt", "s"), ("vtt", "e")]}, None), (2, {"de": [("vtt", "d")]}, {"en": [("vtt", "auto")]}), (3, None, {"fr": [("vtt", "f")]})],
        f"i int, s {kind}, a {kind}",
    )
    assert [r[0] for r in df.orderBy("i").select(markup.caption_track(F.col("s"), F.col("a"))).collect()] == ["e", "auto", None]


def test_post_text(spark):
    df = spark.createDataFrame([("a", "r", "q", "t"), ("", "r", None, None), (None, None, "q", None)], "t string, r string, n string, q string")
    got = [r[0] for r in df.select(markup.post_text(*map(F.col, "trnq"))).collect()]
    assert got == ["a\n\n> Quoting @q: t", "r", "\n\n> Quoting @q: "]
