import random

from siltstone.llm import truncation as T

SENTENCES = ["The kiln was hot for nine days", "A small glaze covers the test tile", "Readers asked for the long chart", "Nobody wrote the recipe down"]


def text(n, stop="."):
    return " ".join(random.choice(SENTENCES) + stop for _ in range(n))


def test_endings():
    whole = ["", "  ", "It is done.", "Is it?", "He said \"yes.\"", "It is done. 🎉", "See https://a.example/x", "Done. #tag #two", "Done.\n\nTags: a, b", "Done.\n\n— the editors", "Done.\n\n```\ncode\n```", "Done.\n\n| a | b |",
             "Done.\n\n## Heading", "Done.\n[music]", "终于完成了。", "Done.\n\nBest wishes\nAnna", "Done.\n\nFiled under kilns", "Done.\n\n## License\n\nFree to copy", "the price is 5.25"]
    assert [T.ending(t)[0] for t in whole] == ["whole"] * len(whole)
    cut = ["It is do�", "It is (more)", "It was… »", "It was [...]", "It was hot Read more", "Done.\n```\ncode"]
    assert [T.ending(t)[0] for t in cut] == ["cut"] * len(cut)
    assert T.ending("Done. The kiln was ho") == ("prose", "ho")
    assert T.ending("- One thing.\n- Another thi") == ("prose", "thi")
    assert T.ending("- one thing\n- another thing") == ("list", "thing")
    assert T.ending("just a short note") == ("informal", "note")
    assert T.ending("Done. And then it was…") == ("dotted", "was")


def test_found_and_report(spark):
    random.seed(1)
    rows, want, i = [], set(), 0
    for source, limit in (("a", 300), ("b", 180), (None, None)):
        for _ in range(120):
            t = text(random.randint(2, 9))
            i += 1
            if limit and len(t) > limit:
                t = t[:limit]
            elif random.random() < 0.05:
                t = t[: random.randint(20, len(t) - 3)].rstrip(". ") + "x"
            rows.append((i, t, source, 0, "x"))
            if t.rstrip()[-1] != ".":
                want.add(i)
        for t in (None, "", " \n", "- one kiln\n- another kiln", "no stops here at all", text(3) + " 🎉"):
            i += 1
            rows.append((i, t, source, 0, "x"))
    rows += [(i + k, "the same text copied many times and of one length only, as copies are.", "b", 0, "x") for k in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, chars int, state string")
    found = T.truncated(df)
    got = {r.doc_id: r.at_limit for r in found.collect()}
    assert set(got) == want and found.count() == len(want)
    assert sum(got.values()) > 20
    report = {r.source: r for r in T.truncation_report(df, found).collect()}
    assert sum(r.cut for r in report.values()) == len(want) and sum(r.documents for r in report.values()) == len(rows)
    assert T.truncated(df.limit(0)).count() == 0


def test_openers_of_closing_lines_begin_sentences_too(spark):
    assert T.ending("By contrast, the repeatable drone pass predicts the rou") == ("prose", "rou")
    assert T.ending("It is done.\n\nRelated work on the slow kiln was read by all of th") == ("prose", "th")
    assert [T.ending(f"Done.\n\n{t}")[0] for t in ("By Anna Lind", "Source: the long chart of a kiln and its glaze", "License")] == ["whole"] * 3
    random.seed(2)
    whole = [text(random.randint(3, 12)) for _ in range(400)]
    cut = [f"By contrast, {t}"[:200] for t in {text(9, " and") for _ in range(20)}] + [f"so {t}".lower()[:196] + f"xq{i:02}" for i, t in enumerate({text(9, ",") for _ in range(20)})]
    tags = [text(3) + f"\n\nTags: kiln, own{i}" for i in range(5)]
    rows = [(i, t, "s") for i, t in enumerate([*whole, *cut, *tags])]
    found = T.truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert {r.doc_id for r in found.collect()} == {i for i, t, _ in rows if t in set(cut)}
