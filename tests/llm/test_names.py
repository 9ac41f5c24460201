import itertools
import random

from siltstone.llm import names as N


def test_reading():
    assert N.read_name("Doe, Jane") == ("person", "doe", "jane", True)
    assert N.read_name("DOE Jane") == ("person", "doe", "jane", True)
    assert N.read_name("Jane B. Doe") == ("person", "doe", "jane", True)
    assert N.read_name("J. Doe") == N.read_name("Doe, J.") == N.read_name("J B Doe") == N.read_name("JB Doe") == ("person", "doe", "j.", True)
    assert N.read_name("Dr. Zoë  Doë 🌊") == ("person", "doe", "zoe", False)
    assert N.read_name("JaneDoe") == ("person", "doe", "jane", False)
    assert N.read_name("The Quartz Society of Note Keeping e.V.") == N.read_name("Note Keeping, Quartz Society") == N.read_name("Quartz SNK") == ("org", "quartz", "kns", True)
    for other in ("", " ", "jane.doe", "jane_doe7", "Jane", "?", "n/a", "doejane", "a@b", "relay"):
        assert N.read_name(other) is None, other


def naive(a, b):
    """Distance by search over all edits, for short strings."""
    seen, front, steps = {a}, {a}, 0
    letters = set(b)
    while b not in seen:
        steps += 1
        nxt = set()
        for s in front:
            for i in range(len(s) + 1):
                nxt |= {s[:i] + c + s[i:] for c in letters}
                if i < len(s):
                    nxt.add(s[:i] + s[i + 1:])
                    nxt |= {s[:i] + c + s[i + 1:] for c in letters}
                if i + 1 < len(s):
                    nxt.add(s[:i] + s[i + 1] + s[i] + s[i + 2:])
        front = {x for x in nxt - seen if len(x) <= max(len(a), len(b)) + 1}
        seen |= front
    return steps


def test_edit_distance():
    random.seed(1)
    for _ in range(60):
        a, b = ("".join(random.choices("abc", k=random.randint(1, 4))) for _ in range(2))
        assert N.edit_distance(a, b) == naive(a, b)
    words = ["".join(random.choices("abcd", k=random.randint(2, 7))) for _ in range(25)]
    for a, b, c in itertools.product(words[:12], repeat=3):
        assert N.edit_distance(a, c) <= N.edit_distance(a, b) + N.edit_distance(b, c)


def test_radius_links_against_brute_force(spark):
    random.seed(2)
    keys = {("s" + str(random.randrange(2)), "".join(random.choices("abcd", k=random.randint(2, 9)))) for _ in range(250)}
    got = {(r.space, r.a, r.b): r.distance for r in N.radius_links(spark.createDataFrame(sorted(keys), "space string, key string"), (3, 6), pivots=5).collect()}
    want = {}
    for (s, a), (t, b) in itertools.combinations(sorted(keys, key=lambda x: x[1]), 2):
        d = N.edit_distance(a, b)
        if s == t and min(len(a), len(b)) >= 3 and (d == 1 or (d == 2 and min(len(a), len(b)) >= 6)):
            want[s, min(a, b), max(a, b)] = d
    assert got == want and N.radius_links(spark.createDataFrame([], "space string, key string"), (3, 6)).count() == 0


def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("c", "d"), ("x", "y"), ("z", "y")]
    assert sorted(map(tuple, N.components(spark.createDataFrame(edges, "u string, v string")).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "x")]


GROUPS = [
    ["Jonathan Quimberlund", "Quimberlund, Jonathan", "QUIMBERLUND Jonathan", "Quimberlund Jonathan", "Jon Quimberlund", "J. Quimberlund", "Jonathan  Quimberlund ", "Jonathan Quimbrelund", "Jonathsn Quimberlund", "jonathan quimberlund", "Jonathan Quimberlund (Acme)"],
    ["Dorothy Quimberlund", "Dot Quimberlund", "Dorothy K. Quimberlund"],
    ["Zoë Trabantovik", "Zoe Trabantovik", "Trabantovik, Z."],
    ["Harowend Society of Note Keeping", "The Harowend Society of Note Keeping", "Harowend SNK", "Note Keeping, Harowend Society", "Harowend Note Keeping", "Harowend Soc. of Note Keping"],
    ["Harowend Centre for Tidal Engineering", "Harowend Centre f. Tidal Engineering"],
    ["Jonathan Velk", "Velk, Jonathan", "jonathan.velk", "velkjonathan"], ["Johannes Velk", "Velk, Johannes", "velk-johannes7"],
]
ALONE = ["J. Velk", "j.velk", "velkj4", "jvelk", "Bob", "me", "?", "", None, "Dorothy Lonely", "Gwen Other", "Harold Quimberlund"]


def test_reading_of_accounts():
    assert N.read_account("jane.doe") == N.read_account("jane_doe7") == N.read_account("jane-doe-12") == ("jane", "doe")
    assert N.read_account("doej4") == ("doej", "") and N.read_account("kris-quartz-snk") == ("krisquartz", "snk")
    for other in ("Jane", "a@b", "n/a", "?", "-", "", "jane doe", "4", "jane.4.doe"):
        assert N.read_account(other) is None, other
    assert {"p\tdoering\tj", "p\tdoering\tjane", "o\tdoering\taejn"} <= set(N.spellable(("doering", "jane")) + N.spellable(("doeringj", "")))


ACCOUNTS = [
    ["Thilde Brusenhold", "thilde.brusenhold", "brusenholdt4", "tbrusenhold", "thildebrusenhold", "brusenhold_t", "t.brusenhold", "brusenhold-thilde2"],
    ["Jürgen Trabanzök", "juergen_trabanzoek", "trabanzoekjuergen", "jtrabanzoek"],
    ["Francisca Ollemund", "fran.ollemund46", "franollemund"],
    ["Kelmarund Society of Tidal Archives", "kelmarund-sta", "kelmarundsta"],
    ["Rolf Zwernadik", "Zwernadik Rolf", "rolf.zwernadik"],
]


def test_accounts(spark):
    rest = ["tbrusenhol", "relay", "admin", "kelmarund", "thilde", "Ann Doppelnam", "Adam Doppelnam", "a.doppelnam", "adoppelnam", "doppelnama3"]
    used = ["Thilde Other", "Rolf Other", "Rolf Third"]
    rows = [(n,) for g in ACCOUNTS for n in g] + [(n,) for n in rest + used]
    got = {(r.name_a, r.name_b) for r in N.spelling_pairs(N.spelling_groups(spark.createDataFrame(rows, "name string"))).collect()}
    assert got == {(min(p), max(p)) for g in ACCOUNTS for p in itertools.combinations(g, 2)}


def test_misspelt_given_names_by_share(spark):
    for times in (1, 8):
        full = [(f"family{i}", "gabriela") for i in range(40 * times)] + [(f"family{i}", "gabriele") for i in range(30 * times)]
        full += [(f"family{i}", "gabrielq") for i in range(times)]
        got = {(r.a, r.b) for r in N._misspelt_givens(spark.createDataFrame(full, "family string, given string")).collect()}
        assert got == {("gabriela", "gabrielq"), ("gabriele", "gabrielq")}


def test_groups(spark):
    rows = [(n,) for g in GROUPS for n in g] + [(n,) for n in ALONE] + [("Gwendolyn Different",), ("Lonely, Harold",), ("Other, Dorothy",), ("Jonathan Velk",)]
    got = {(r.name_a, r.name_b) for r in N.spelling_pairs(N.spelling_groups(spark.createDataFrame(rows, "name string"))).collect()}
    want = {(min(p), max(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert got == want
    assert N.spelling_pairs(N.spelling_groups(spark.createDataFrame([], "name string"))).count() == 0
