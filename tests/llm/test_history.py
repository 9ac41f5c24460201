import random

import pytest

from siltstone.llm import history as H

SCHEMA = "seq bigint, id string, urls array<string>, body string, batch int, size int, cell int, n int"
WORDS = [f"word{i}" for i in range(400)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def corpus(seed, rows=120, hot=0.0):
    random.seed(seed)
    data, texts = [], []
    for seq in range(1, rows + 1):
        pick = random.random()
        if texts and (pick < 0.25 or random.random() < hot):
            words = list(texts[0] if random.random() < hot else random.choice(texts))
            for _ in range(random.choice([0, 1, 3, 6])):
                words[random.randrange(len(words))] = random.choice(WORDS)
            if pick < 0.05:
                random.shuffle(words)
        else:
            words = random.choices(WORDS, k=random.randint(30, 60))
        texts.append(words)
        links = random.choice([None, [], [f"https://a.example/{random.randrange(60)}?utm_source={seq}"], ["http://www.a.example/x/", f"https://b.example/{seq % 40}#f", None]])
        body = None if pick > 0.97 else f"**A B** (2024-01-02 10:00):\n{' '.join(words).capitalize()}.\n{(links or [''])[0] or ''}"
        if pick > 0.9:
            body = "short"
        data.append((seq, f"i{random.randrange(400)}" if pick < 0.98 else None, links, body, seq // 30, 1, 1, 1))
    return data


def brute(spark, data):
    rows = sorted(H.prepare(spark.createDataFrame(data, SCHEMA)).collect())
    out, ids, links, texts = {}, {}, {}, []
    for r in rows:
        hits = []
        if r.id and r.id in ids:
            hits.append(ids[r.id])
        key = tuple(r.links or ())
        if key and key in links:
            hits.append(links[key])
        if r.words:
            hits += [s for s, w in texts if 2 * lcs(w, r.words) / (len(w) + len(r.words)) >= H.SAME]
            texts.append((r.seq, r.words))
        if r.id:
            ids.setdefault(r.id, r.seq)
        if key:
            links.setdefault(key, r.seq)
        if hits:
            out[r.seq] = min(hits)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bulk_equals_brute_force(spark, seed):
    data = corpus(seed)
    got = H.History(spark).accept(H.prepare(spark.createDataFrame(data, SCHEMA)))
    assert {r.seq: r.first for r in got.collect()} == brute(spark, data)


def test_batches_equal_bulk(spark):
    data = corpus(3)
    index, got = H.History(spark), {}
    for batch in range(5):
        part = [r for r in data if r[4] == batch]
        got |= {r.seq: r.first for r in index.accept(H.prepare(spark.createDataFrame(part, SCHEMA))).collect()}
    assert got == brute(spark, data)
    again = H.History(spark, index.path)
    repeat = H.prepare(spark.createDataFrame([(1000, *data[0][1:])], SCHEMA))
    assert [r.first for r in again.accept(repeat).collect()] == [1]


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(H, "CROWDED", 6)
    monkeypatch.setattr(H, "STEP", 2)
    monkeypatch.setattr(H, "GROWTH", 2)
    monkeypatch.setattr(H, "BLOCK", 4)
    data = corpus(4, 80, hot=0.4)
    got = H.History(spark).accept(H.prepare(spark.createDataFrame(data, SCHEMA)))
    assert {r.seq: r.first for r in got.collect()} == brute(spark, data)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    ledger = spark.createDataFrame([], "hash string, batch int, seq bigint, status string")
    assert H.repeated(none, ledger, H.History(spark)).count() == 0


def test_ledger(spark):
    def digest(link):
        return spark.sql(f"SELECT left(sha1('{link}'), 10)").first()[0]

    a, b = digest("https://a.example/1"), digest("https://a.example/2")
    rows = [(1, "x", ["http://a.example/1/"], "t", 5, 0, 0, 0), (2, "y", ["https://a.example/2", "https://a.example/1"], "t", 5, 0, 0, 0), (3, "z", ["https://a.example/3"], "t", 5, 0, 0, 0), (4, "q", ["https://a.example/2"], "t", 2, 0, 0, 0)]
    lines = [(a, 1, 10, "error"), (a, 3, 12, "done"), (a, 5, 13, "error"), (b, 2, 11, "done"), (b, 4, 14, "dead"), (None, 1, 1, "done")]
    got = H.repeats_of_ledger(H.prepare(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(lines, "hash string, batch int, seq bigint, status string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10), (2, 10)]


def test_common_words():
    random.seed(5)
    for _ in range(200):
        a, b = (random.choices("abcde", k=random.randint(1, 30)) for _ in range(2))
        assert H.common_words(a, b) == lcs(a, b)


def test_scattered_edits_in_a_group(spark):
    random.seed(6)
    data, texts, want = [], [], {}
    first = random.choices(WORDS, k=100)
    for seq in range(1, 301):
        words = list(first)
        share = random.uniform(0.12, 0.2)
        for at in random.sample(range(100), int(100 * share)) if seq % 10 else range(4, 100, 5):
            words[at] = random.choice(["other", "again", "then", f"new{random.randrange(10**6)}"])
        if seq > 1:
            texts.append((seq, words))
        else:
            texts.append((seq, first))
        near = [s for s, w in texts[:-1] if 2 * H.common_words(w, texts[-1][1]) / 200 >= H.SAME]
        if near:
            want[seq] = min(near)
        data.append((seq, f"i{seq}", [], " ".join(texts[-1][1]), 1, 1, 1, 1))
    got = H.History(spark).accept(H.prepare(spark.createDataFrame(data, SCHEMA)))
    assert len(want) > 290 and {r.seq: r.first for r in got.collect()} == want


def test_crowds_are_of_probing_texts(spark, monkeypatch):
    # "of the" is in 24 texts, but few words of four texts only are rarer than it
    monkeypatch.setattr(H, "CROWDED", 8)
    monkeypatch.setattr(H.History, "_crowded", lambda *_: pytest.fail("no cell is crowded"))
    common = [f"common{i}" for i in range(31)]
    data = []
    for seq in range(1, 35):
        own = [f"own{seq}x{i}" for i in range(80 if seq <= 30 else 12)]
        words = common + (["of", "the"] if seq > 10 else []) + own
        data.append((seq, f"i{seq}", [], " ".join(words), 1, 1, 1, 1))
    assert H.History(spark).accept(H.prepare(spark.createDataFrame(data, SCHEMA))).count() == 0


def test_moved_as_far_as_may_be(spark, monkeypatch):
    # all cells in common are 30 places further on; in the third text 31, which is too far
    monkeypatch.setattr(H, "SPLIT", 2)
    monkeypatch.setattr(H, "AT_ONCE", 1)
    body = [f"word{i}" for i in range(120)]
    texts = [body + [f"end{i}" for i in range(30)], [f"start{i}" for i in range(30)] + body, [f"other{i}" for i in range(31)] + body]
    data = [(seq, f"i{seq}", [], " ".join(words), 1, 1, 1, 1) for seq, words in enumerate(texts, 1)]
    got = H.History(spark).accept(H.prepare(spark.createDataFrame(data, SCHEMA)))
    assert {r.seq: r.first for r in got.collect()} == brute(spark, data) == {2: 1}
