import pytest
from pyspark.sql import functions as F

from siltstone.llm import residue as R
from siltstone.llm.residue import judge, residue

CASES = {
    "placeholder": ["# {{ title }}\n\nText by an author.", "Dear [FIRST_NAME], thank you.", "Read more about %(topic)s.", "Hello __USER_NAME__", "by [object Object]", "The ${version} is out.", "fetch of {{page.url}} failed", "Install [your repo] now.", "# <headline>\n\nA text."],
    "error_page": ["404 Not Found", "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1></body></html>", "Home\nAbout\n\nSeite nicht gefunden\n\nTerms | Contact", '{"message": "This domain is for sale.", "code": "404"}', "A fine title\n\nAccess denied\nReference: ab12cd"],
    "script_notice": ["Please enable JavaScript to view this page.", "VEUILLEZ ACTIVER JAVASCRIPT POUR AFFICHER CETTE PAGE.", "One moment, your browser is being checked…"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "A real title\n\nSit amet elit sed do. Ut labore et dolore magna.", "asdkjf sdlfkj asldkfj", "your text here your text here", "Coming soon", "foo bar 1\nItem 2\nTest 3"],
}
CLEAN = [
    "The old viewer asked people to enable JavaScript; the new one renders on the server. It is faster, and nobody has asked for the old one since.",
    "In the template language, `{{ title }}` prints the field. We use it in three places and it has served us well.",
    "```\n<h1>${topic}</h1>\n```\nThat is all the code there is, and the rest of this page explains it.",
    "no caption track found", "page needs scripts, extractor got 12 chars", "template rendering skipped, kind=blog", "HTTPError 404 for a.example", "agreed 👍", "+1",
    "« Une citation ordinaire » dans un texte français qui parle d'autre chose.", "<title>Real page</title> with words of its own about kilns and glazes.",
]


@pytest.mark.parametrize("reason", CASES)
def test_cases(reason):
    for t in CASES[reason]:
        assert judge(t)[0] == reason, t


def test_proper_texts():
    for t in CLEAN:
        assert judge(t)[0] is None, t


def test_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "404 Not Found"), (5, "word " * 200_000), (6, "404 Not Found")], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(residue(F.col("t"))["reason"]).collect()]
    assert got == [None, None, None, "error_page", None, "error_page"]
    assert spark.createDataFrame([], "t string").select(residue(F.col("t"))).count() == 0


def test_the_automaton_finds_placeholders_and_words_of_filler():
    found = ["Dear {{ name }}, welcome.", "Total: %(amount)s", "Hello %USER_NAME%, hello", "See [INSERT TITLE] for more", "Written by XXXX in spring", "Dear <First Name>,",
             "TODO: title", "İ is a letter; <% name %> is none", "Hi $NAME, all is well"]
    assert [R.placeholder(t) for t in found] == [True] * len(found)
    kept = ["Write `{{ name }}` in the template.", "a [link](https://a.example)", "```\n${HOME}\n```", "prices from $5 to $9", "<title>A page</title>", "50% of it", "x[i] = {a}"]
    assert [R.placeholder(t) for t in kept] == [False] * len(kept)
    assert R.judge("Dolor magna sed tempor. Aliqua enim veniam.")[0] == "filler" and R.judge("Foo bar baz")[0] == "filler"
    assert R.judge("asdf jkl asdfgh")[0] == "filler" and R.judge("404")[0] == "error_page" and R.judge("Error 503")[0] == "error_page"
    assert R.judge("The section on tests gives a sample of 404 items, sit in and do read it.")[0] is None
