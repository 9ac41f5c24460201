import datetime as dt
import random

from pyspark.sql import functions as F

from siltstone.llm import conversations as C

SCHEMA = (
    "channel string, pos int, id string, type string, timestamp string, content string, author struct<id:string,name:string,nickname:string>,"
    " reference struct<messageId:string>, attachments array<struct<url:string,fileName:string>>, ingested_at timestamp_ntz, turn int, root string"
)
DAY = dt.datetime(2024, 1, 1)


def message(id, author, at, ref=None, content="text", type=None, ingested=DAY, files=None, channel="c"):
    kind = type or ("Default" if ref is None else "Reply")
    return (channel, 0, id, kind, at, content, (author, "n", None) if author != "none" else None, (ref,) if ref is not None else None, files, ingested, 1, "clash")


def at(minute):
    return f"2024-01-01T10:{minute:02d}:00Z"


def found(spark, rows):
    df = C.reply_conversations(spark.createDataFrame(rows, SCHEMA))
    return sorted((r.root, r.turn, r.id, r.role) for r in df.collect())


def test_roles_turns_and_ways_to_write(spark):
    rows = [
        message("10", "a", at(0)), message("11", "b", "2024-01-01 12:05:00+02:00", " 10 \n"), message("9", "b", "2024-01-01T10:05:00", "https://chat.example/c/x/11"),
        message("12", "a", at(9), "9"), message("12", "a", at(9), "9"), message("10", "a", at(0), content="edited", ingested=dt.datetime(2024, 2, 1)),
        message("13", "b", at(3), "10", type="Call"), message("14", "b", at(8), "10", type="Default"),
    ]
    assert found(spark, rows) == [("10", 1, "10", "opener"), ("10", 2, "9", "replier"), ("10", 3, "11", "replier"), ("10", 4, "14", "replier"), ("10", 5, "12", "opener")]


def test_dropped_conversations(spark):
    good = [message("1", "a", at(0)), message("2", "b", at(1), "1")]
    for bad in (
        message("3", None, at(2), "2"), message("3", "", at(2), "2"), message("3", "none", at(2), "2"), message("3", "b", "pending", "2"), message("3", "b", None, "2"),
        message("3", "b", "0000-00-00T00:00:00Z", "2"), message("3", "b", at(0), "2"), message("3", None, at(3), "2", content=""),
    ):
        assert found(spark, [*good, bad]) == []
    assert len(found(spark, good)) == 2
    assert found(spark, [message("1", "a", at(0)), message("2", "a", at(1), "1")]) == []
    assert found(spark, [message("1", "a", at(0), content="[deleted]"), message("2", "b", at(1), "1")]) == []
    assert found(spark, [message("1", "a", at(0)), message("2", "b", at(1), "1", content="​ ")]) == []
    assert len(found(spark, [message("1", "a", at(0), content=None, files=[("f", "f")]), message("2", "b", at(1), "1")])) == 2


def test_empty_messages_keep_the_chain_and_circles_are_left_out(spark):
    rows = [message("1", "a", at(0)), message("2", "b", at(1), "1", content=" "), message("3", "c", at(2), "2"), message("7", "a", at(0), "8"), message("8", "b", at(0), "7"), message("9", "b", at(0), "gone"), message("5", "b", at(0), "", type="Reply")]
    assert found(spark, rows) == [("1", 1, "1", "opener"), ("1", 2, "3", "replier")]


def test_channels_are_apart_and_nothing_gives_nothing(spark):
    assert found(spark, [message("1", "a", at(0)), message("2", "b", at(1), "1", channel="d")]) == []
    assert found(spark, []) == []


def test_content(spark):
    notices = ["[deleted]", "~~deleted~~", "(message removed)", "*This message was deleted by its author.*", "Nachricht gelöscht", "[removed by moderator]", "", " \t", "⁠﻿", None]
    real = ["I deleted my older note", "It was removed from X in version 2.", "+1", "👍", "deleted?! why"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(notices + real)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(C.has_content(F.col("t"), F.lit(None).cast("array<string>"))).collect()]
    assert got[: len(notices)] == [False] * len(notices) and all(got[len(notices) + k] for k in (0, 1, 2, 3))


def test_long_and_wide_threads_against_brute_force(spark):
    random.seed(2)
    rows, parent, author, minute = [], {}, {}, {}
    for n in range(400):
        ref = None if n % 57 == 0 else (n - 1 if n < 150 else random.randrange(n))
        parent[n], author[n], minute[n] = ref, random.choice("abc"), n
        t = (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)).isoformat() + "Z"
        rows.append(message(str(n), author[n], t, None if ref is None else str(ref)))

    def root(n):
        while parent[n] is not None:
            n = parent[n]
        return n

    groups = {}
    for n in range(400):
        groups.setdefault(root(n), []).append(n)
    want = sorted((str(r), i + 1, str(n), "opener" if author[n] == author[r] else "replier") for r, ns in groups.items() if {author[n] for n in ns} != {author[r]} for i, n in enumerate(ns))
    assert found(spark, rows) == want


def test_gap_sessions(spark):
    """Channels of fast and of slow talk get gaps of their own; the share of long silences does not matter."""
    rows = []
    for channel, minutes, talks, each in (("fast", 1, 20, 6), ("slow", 600, 12, 3)):
        for s in range(talks):
            for k in range(each):
                t = (dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=30 * s, minutes=minutes * k)).isoformat()
                rows.append(message(f"{s * 10 + k + (100 if channel == 'fast' else 5000)}", "ab"[k % 2] if s else "a", t, channel=channel))
    got = C.gap_sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r.channel, r.session), []).append(r)
    assert sorted((c, len(v)) for (c, _), v in sizes.items()) == [("fast", 6)] * 19 + [("slow", 3)] * 11
    assert all({r.role for r in v if r.author == "a"} == {"opener"} for v in sizes.values())


def test_one_silence_is_no_gap(spark):
    rows = [message(str(100 + k), "ab"[k % 2], (dt.datetime(2024, 1, 1, 9) + dt.timedelta(minutes=k)).isoformat()) for k in range(4)]
    assert {r.session for r in C.gap_sessions(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}
    assert C.gap_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
