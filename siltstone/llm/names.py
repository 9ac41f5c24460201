"""Spellings of one person or organisation, linked.

Names are read into parts (family and given name, or head and words of an
organisation).  Parts that differ by one typing error are found with a radius
join in a metric space: pivots cut the space into cells, names near a border
are repeated in the neighbouring cells as the triangle inequality asks, and
every cell is joined exactly under an edit distance.  Account names that spell
a name (``jane.doe``, ``doej4``, ``quartz-snk``) belong to it if it is the only
one they can spell.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize, spread, task_udf

#: Number of pivots; each name is repeated in less than this many cells.
PIVOTS = 8
#: Parts shorter than these are allowed no error, and one error; longer ones two.
SHORTEST = {"family": (4, 8), "given": (3, 99)}
#: A given name is taken for another one misspelt if at most this share of the other's families use it.
MISSPELT = 0.05
#: Letters of the shortest family name that is looked for inside an account name without separators.
SHORTEST_GLUED = 4

# Common short forms of given names, without accents; several full names make a short form ambiguous.
# Short forms that are the beginning of a name (three letters or more) need no entry, see ``_short_links``.
SHORT_FORMS = """
abby:abigail|gail:abigail|alex:alexander,alexandra|sasha:alexander,alexandra|sandy:alexander,alexandra|andi:andreas|andy:andrew,andreas
tony:anthony|ant:anthony|ben:benjamin|benji:benjamin|benny:benjamin|lottie:charlotte|charlie:charles,charlotte|chuck:charles
chris:christopher,christian,christine|kit:christopher,katherine|topher:christopher|dot:dorothy|dottie:dorothy|dolly:dorothy
dora:dorothy|dan:daniel|danny:daniel|dave:david|ed:edward,edmund|eddie:edward|ned:edward|ted:edward,theodore|teddy:edward,theodore
liz:elizabeth|beth:elizabeth|betty:elizabeth|betsy:elizabeth|eliza:elizabeth|lizzie:elizabeth|fran:francisca,francoise,frances
paca:francisca|paqui:francisca|cisca:francisca|fanfan:francoise|fanny:francoise|fred:frederick|freddie:frederick|freddy:frederick
rick:frederick,richard|fritz:frederick|gabi:gabriela,gabriele|gaby:gabriela|gabby:gabriela|gwen:gwendolyn|wendy:gwendolyn
hal:harold,henry|harry:harold,henry|izzy:isabella|bella:isabella|isa:isabella|belle:isabella|jen:jennifer|jenny:jennifer
jenn:jennifer|jim:james|jimmy:james|jack:john|johnny:john|hannes:johannes|hans:johannes|jo:johannes,joanna|jon:jonathan
jonny:jonathan|jonty:jonathan|nathan:nathaniel,jonathan|joe:joseph|pepe:jose|chepe:jose|jogi:jurgen|juergen:jurgen|jurg:jurgen
kate:katherine|kathy:katherine|kat:katherine|katie:katherine|kostya:konstantin|kosta:konstantin|konni:konstantin|stan:konstantin
len:leonard|leo:leonard|lenny:leonard|leon:leonard|magda:magdalena|lena:magdalena,helena|leni:magdalena|maggie:margaret
peggy:margaret|meg:margaret|greta:margaret|marge:margaret|daisy:margaret|matt:matthew|matty:matthew|mike:michael|mick:michael
micky:michael|mikey:michael|nat:nathaniel,natalie|nate:nathaniel|nick:nicholas,nikolaus|niko:nikolaus|klaus:nikolaus|nico:nikolaus
ollie:oliver|olly:oliver|pat:patricia,patrick|trish:patricia|patty:patricia|tricia:patricia|penny:penelope|nell:penelope,eleanor
pen:penelope|pip:philippa,philip|pippa:philippa|phil:philip,philippa|becca:rebecca|becky:rebecca|rich:richard|dick:richard
richie:richard|ricky:richard|rob:robert|bob:robert|bobby:robert|robbie:robert|bert:robert|sam:samuel,samantha|sammy:samuel,samantha
steve:stephen|sue:susannah,susan|susie:susannah,susan|suzy:susannah|anna:susannah|zanna:susannah|theo:theodore|tim:timothy
timmy:timothy|tom:thomas|tommy:thomas|uschi:ursula|ulla:ursula|ursel:ursula|val:valentina,valentin|tina:valentina,christine
valya:valentina|vicky:victoria|tori:victoria|vic:victor,victoria|vicki:victoria|will:william|bill:william|billy:william|liam:william
willy:william|wolf:wolfgang|wolfi:wolfgang|gang:wolfgang|xavi:xavier|xav:xavier|javi:xavier|zhenya:yevgenia|zhenia:yevgenia
jenya:yevgenia|evgenia:yevgenia|eugenia:yevgenia|zo:zoe|zozo:zoe|zoey:zoe|zoi:zoe
"""
#: Kinds of organisation with their short forms, and words that join.
ORG_KINDS = set(
    "society soc institute inst laboratory lab association assoc assn centre center ctr cntr university univ college academy"
    " museum library foundation group club company union network council agency department dept office verein institut gesellschaft".split()
)
JOINERS = {"of", "for", "o", "f", "the", "and", "de", "für", "fur", "der", "des"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "mme", "mlle", "sr", "sra", "dipl", "ing", "rev"}
SUFFIXES = {"e.v", "ev", "inc", "ltd", "llc", "gmbh", "ag", "co", "jr", "phd", "ph.d", "md", "esq", "plc"}

# How letters are written where marks above them are missing.
WRITTEN_OUT = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa"}

PARTS = "struct<kind:string,first:string,second:string,sure:boolean,first_alt:string,second_alt:string,spelt:array<string>>"


def fold(token: str) -> str:
    """Letters only, without case and accents."""
    plain = unicodedata.normalize("NFD", token.casefold())
    return "".join(c for c in plain if c.isalpha())


def read_name(spelling: str) -> tuple[str, str, str, bool] | None:
    """(kind, first, second, sure), or None for accounts, placeholders and single words.

    A person is (family, given); with ``sure`` false the two may be the other
    way round.  A given name known by its initial only ends in a dot.  An
    organisation is (head, initials of its other words).
    """
    s = unicodedata.normalize("NFKC", spelling)
    s = regex.sub(r"\([^()]*\)\s*$", " ", s)
    s = regex.sub(r"[^\p{L}\p{M}\p{N}\s.,'’@_/-]", " ", s)
    s = " ".join(s.split()).strip(" ,;-")
    if not s or regex.search(r"[@_/]|\d", s):
        return None
    if " " not in s:
        glued = regex.fullmatch(r"(\p{Lu}\p{Ll}+)(\p{Lu}\p{Ll}+)", unicodedata.normalize("NFC", s))
        if not glued:
            return None
        s = f"{glued[1]} {glued[2]}"
    bare = lambda t: t.strip(".,").casefold()
    left, _, right = s.partition(",")
    if bare(right) in SUFFIXES:
        right = ""
    capital = s.isupper()
    # two capitals without a dot are initials, not a title
    extra = lambda t: bare(t) in TITLES | SUFFIXES and (capital or "." in t or not (t.isupper() and len(t) == 2))
    halves = [[t for t in h.split() if not extra(t)] for h in (left, right)]
    has_kind = any(bare(t) in ORG_KINDS for h in halves for t in h)
    if halves[1] and len(halves[0]) == 1 and len(halves[1]) <= 2 and not has_kind:
        family, given = fold(halves[0][0]), halves[1][0]
        if not family or not fold(given):
            return None
        short = len(fold(given)) == 1 or (given.isupper() and len(fold(given)) == 2)
        return "person", family, fold(given)[0] + "." if short else fold(given), True
    tokens = halves[1] + halves[0]
    if tokens and bare(tokens[0]) == "the":
        tokens = tokens[1:]
    tokens = [t for t in tokens if fold(t)]
    if len(tokens) < 2:
        return None
    initial = [
        len(fold(t)) == 1 or (t.isupper() and not capital and len(fold(t)) == 2) or (t.count(".") > 1 and len(fold(t)) < 4)
        for t in tokens
    ]
    full = [t for t, i in zip(tokens, initial) if not i]
    acronym = len(tokens) == 2 and tokens[1].isupper() and not capital and 3 <= len(tokens[1]) <= 6 and not initial[0]
    joined = len(tokens) >= 4 and not initial[0] and any(bare(t) in JOINERS for t in tokens[1:])
    if acronym:
        return "org", fold(tokens[0]), "".join(sorted(fold(tokens[1]))), True
    if (has_kind and len(tokens) > 1) or joined or len(full) >= 3:
        words = [fold(t) for t in tokens[1:] if bare(t) not in JOINERS]
        return "org", fold(tokens[0]), "".join(sorted(w[0] for w in words)), True
    if len(full) == 1 and any(initial):
        given = next(t for t, i in zip(tokens, initial) if i)
        return "person", fold(full[0]), fold(given)[0] + ".", True
    if len(full) == 2:
        caps = [t.isupper() and len(fold(t)) > 2 for t in full]
        if caps[0] != caps[1]:
            family, given = (full[0], full[1]) if caps[0] else (full[1], full[0])
            return "person", fold(family), fold(given), True
        return "person", fold(full[1]), fold(full[0]), len(tokens) == 3 and initial[1]
    return None


def written_out(spelling: str) -> str:
    """A spelling in lower case with WRITTEN_OUT for letters with marks."""
    return "".join(WRITTEN_OUT.get(c, c) for c in unicodedata.normalize("NFC", spelling.casefold()))


def read_account(spelling: str) -> tuple[str, str] | None:
    """The parts an account name is made of, without the number behind it; the second is empty without separators.

    Of more than two parts the last stands alone.  None for what has other
    marks than separators, and for what is not written in lower case.
    """
    s = unicodedata.normalize("NFKC", spelling)
    if not regex.fullmatch(r"[\p{Ll}\p{Lo}\p{M}]+(?:[._-][\p{Ll}\p{Lo}\p{M}]+)*[._-]?\d*", s):
        return None
    parts = [fold(p) for p in regex.split(r"[._-]", regex.sub(r"[._-]?\d+$", "", s)) if p]
    return ("".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (parts[0], "")


def spellable(account: tuple[str, str]) -> list[str]:
    """Keys of all names an account name can spell: a person's family and given name or its initial in either
    order, an organisation's head and initials."""
    a, b = account
    halves = [(a, b)] if b else [(a[:i], a[i:]) for i in range(1, len(a))]
    least = 1 if b else SHORTEST_GLUED
    keys = {_spelt("p", f, g) for x, y in halves for f, g in ((x, y), (y, x)) if len(f) >= least}
    keys |= {_spelt("o", x, "".join(sorted(y))) for x, y in halves if len(x) >= least and 2 <= len(y) <= 6}
    return sorted(keys)


def _spelt(*parts: str) -> str:
    return "\t".join(parts)


def _read(spelling: str) -> tuple:
    """A row of PARTS: a name's parts, also as an account name writes them, or what an account name can spell."""
    read = read_name(spelling)
    if read:
        out = read_name(written_out(spelling)) if written_out(spelling) != spelling.casefold() else None
        alt = out[1:3] if out and out[0] == read[0] else read[1:3]
        if read[0] == "person" and read[2].endswith("."):
            alt = (alt[0], read[2])
        return (*read, *alt, None)
    account = read_account(spelling)
    if not account:
        return (None,) * 7
    a, b = account
    if not b:
        return ("glued", None, None, None, None, None, spellable(account))
    if min(len(a), len(b)) > 1:
        # one of them may be a given name: read as "given family", in an order that is not sure
        return ("account", b, a, False, b, a, spellable(account))
    family, given = (a, b) if len(b) == 1 else (b, a)
    return ("person", family, given + ".", True, family, given + ".", None) if len(family) > 1 else (None,) * 7


def _parts(name: Column) -> Column:
    @task_udf(PARTS)
    def read(names: pa.Array) -> pa.Array:
        rows = [_read(n) for n in names.to_pylist()]
        kinds = (*[pa.string()] * 3, pa.bool_(), *[pa.string()] * 2, pa.list_(pa.string()))
        fields = [part.split(":")[0] for part in PARTS.removeprefix("struct<").removesuffix(">").split(",")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], fields)

    # else a filter on the result would move the reading below the repartition that spreads it
    return read.asNondeterministic()(name)


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (a metric): letters inserted, dropped, replaced, or neighbours swapped."""
    row_of: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        col = 0
        for j, y in enumerate(b, 1):
            k, m = row_of.get(y, 0), col
            if x == y:
                col = j
            d[i + 1][j + 1] = min(
                d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        row_of[x] = i
    return d[-1][-1]


def _distance(a: Column, b: Column) -> Column:
    @task_udf("int")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([edit_distance(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.int32())

    return of(a, b)


def _without_one(keys: Column) -> Column:
    """Every string of an array, and it without each of its letters."""
    return F.array_distinct(F.flatten(F.transform(keys, lambda k: F.concat(F.array(k), F.transform(
        F.sequence(F.lit(1), F.length(k)),
        lambda i: F.concat(F.substr(k, F.lit(1), i - 1), F.substr(k, i + 1)),
    )))))


def radius_links(keys: DataFrame, shortest: tuple[int, int], pivots: int = PIVOTS) -> DataFrame:
    """(space, a, b, distance) with a < b for keys of one ``space`` that are close.

    ``keys``: ``space`` and ``key``.  Close is a distance of 1, or 2 if both
    have at least ``shortest[1]`` letters; keys with less than ``shortest[0]``
    letters have no links.

    Every key belongs to the cell of its nearest pivot and is repeated in the
    cells of lower number whose pivot is at most 2 x radius further away: by
    the triangle inequality that holds for any pair within the radius whose
    other key belongs there, so each pair meets.  Cells are measured by
    Levenshtein distance, in which two errors are at most 4 apart (a swap
    counts 2).  Within a cell keys meet on the strings left when as many
    letters are dropped as errors are allowed, which all close pairs share,
    and the edit distance decides.  The pivots are the ``pivots`` keys of
    least hash, for any number of keys.
    """
    keys = materialize(keys.where(F.length("key") >= shortest[0]).distinct(), "keys")
    chosen = [r["key"] for r in keys.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(pivots).collect()]
    if not chosen:
        return keys.select("space", F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).alias("distance"))
    long = F.length("key") >= shortest[1]
    radius = F.when(long, 4).otherwise(2)
    far = F.array(*[F.levenshtein(F.col("key"), F.lit(p)) for p in chosen])
    placed = spread(keys).withColumn("far", far).withColumn("home", F.array_position("far", F.array_min("far")) - 1)
    cells = F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.col("home")),
        lambda j: F.element_at("far", (j + 1).cast("int")) <= F.array_min("far") + 2 * radius,
    )
    one = _without_one(F.array("key"))
    traces = F.when(long, _without_one(one)).otherwise(one)
    members = materialize(
        placed.select("space", "key", "home", traces.alias("traces"), F.explode(cells).alias("cell"))
        .select("space", "key", (F.col("cell") == F.col("home")).alias("own"), "cell", F.explode("traces").alias("trace"))
        .select(F.xxhash64("space", "cell", "trace").alias("meet"), "space", "key", "own"),
        "cells",
    )
    own = members.where("own").select("meet", "space", F.col("key").alias("x"))
    every = members.select("meet", "space", F.col("key").alias("y"), F.col("own").alias("y_own"))
    # two keys at home in one cell meet in both orders: one will do
    met = own.join(every, ["meet", "space"]).where("x <> y AND (NOT y_own OR x < y)")
    pairs = met.select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    measured = materialize(pairs.withColumn("distance", _distance(F.col("a"), F.col("b"))), "links")
    both_long = F.least(F.length("a"), F.length("b")) >= shortest[1]
    return measured.where((F.col("distance") == 1) | ((F.col("distance") == 2) & both_long))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node each node of ``edges`` (u, v) is connected with."""
    both = materialize(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("label").alias("offer")
        )
        moved = materialize(
            labels.join(offered, "node").select(
                "node", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("moved")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def _node(kind: str, *cols: str) -> Column:
    return F.concat_ws("\t", F.lit(kind), *cols)


def _given_table(spark) -> DataFrame:
    rows = [
        (short, full) for pair in SHORT_FORMS.replace("\n", "|").split("|") if pair.strip()
        for short, names in [pair.strip().split(":")] for full in names.split(",")
    ]
    return spark.createDataFrame(rows, "short string, full string")


def _persons(people: DataFrame) -> DataFrame:
    """(name, family, given, and both as an account name writes them) with the order of parts settled.

    What is said for sure elsewhere counts first: uses as a given name less
    uses as a family name.  Where that says nothing, the given name is the
    part that goes with more than twice as many other parts, and with more
    than any of them does (a family goes with a given name that goes with many).
    """
    said = people.where("sure").select(F.col("first").alias("part"), F.lit(-1).alias("g")).unionByName(
        people.where("sure AND second NOT LIKE '%.'").select(F.col("second").alias("part"), F.lit(1).alias("g"))
    ).groupBy("part").agg(F.sum("g").alias("given"))
    pairs = materialize(people.where("second NOT LIKE '%.'").select(F.explode(F.array(
        F.struct(F.col("first").alias("part"), F.col("second").alias("other")), F.struct(F.col("second").alias("part"), F.col("first").alias("other"))
    )).alias("p")).select("p.part", "p.other").distinct(), "pairs")
    others = pairs.groupBy("part").agg(F.count(F.lit(1)).alias("others"))
    beside = others.withColumnsRenamed({"part": "other", "others": "beside"})
    lead = pairs.join(beside, "other").groupBy("part").agg(F.count(F.lit(1)).alias("others"), (F.count(F.lit(1)) - F.max("beside")).alias("lead"))
    used = materialize(lead.join(said, "part", "left").select("part", "others", "lead", F.coalesce("given", F.lit(0)).alias("given")), "used")
    placed = people.join(used.select(F.col("part").alias("first"), F.struct("given", "lead", "others").alias("f")), "first", "left").join(
        used.select(F.col("part").alias("second"), F.struct("given", "lead", "others").alias("s")), "second", "left"
    )
    more = (F.col("f.lead") > F.col("s.lead")) & (F.col("f.others") > 2 * F.col("s.others"))
    swap = F.coalesce(~F.col("sure") & F.when(F.col("f.given") == F.col("s.given"), more).otherwise(F.col("f.given") > F.col("s.given")), F.lit(False))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return placed.select(
        "name", pick("first", "second").alias("family"), pick("second", "first").alias("given"),
        pick("first_alt", "second_alt").alias("family_alt"), pick("second_alt", "first_alt").alias("given_alt"),
    )


def _misspelt_givens(full: DataFrame) -> DataFrame:
    """(a, b): given names one error apart of which one is hardly ever used with another family.

    Only shares count, so a table ten times as long gives the same answer.
    """
    families = materialize(full.groupBy("given").agg(F.count_distinct("family").alias("n")), "givens")
    links = radius_links(families.select(F.lit("").alias("space"), F.col("given").alias("key")), SHORTEST["given"])
    return (
        links.join(families.select(F.col("given").alias("a"), (F.col("n") - 1).alias("na")), "a")
        .join(families.select(F.col("given").alias("b"), (F.col("n") - 1).alias("nb")), "b")
        .where(F.least("na", "nb") <= MISSPELT * F.greatest("na", "nb")).select("a", "b")
    )


def _short_links(u: DataFrame, w: DataFrame, families: DataFrame, several: DataFrame) -> DataFrame:
    """(u, v): nodes with a short given name, and the only full name of their family that it can stand for.

    A full name is one of ``several`` (short, full), or begins with the short
    name.  A family one error away counts if the family itself has none.
    """
    listed = u.join(several, u["given"] == several["short"]).select("a", "space", "u", F.col("full").alias("b"))
    near = families.select("space", "a", F.col("b").alias("family"))
    begun = lambda x: x.where((F.length("given") >= 3) & F.startswith("b", "given") & (F.length("b") > F.length("given") + 1))
    at_home = w.select(F.col("family").alias("a"), "b", "v")
    found = (
        listed.join(at_home, ["a", "b"]).select("u", "v", F.lit(0).alias("away"))
        .unionByName(begun(u.join(at_home, "a")).select("u", "v", F.lit(0).alias("away")))
        .unionByName(listed.join(near, ["space", "a"]).join(w, ["family", "b"]).select("u", "v", F.lit(1).alias("away")))
        .unionByName(begun(u.join(near, ["space", "a"]).join(w, "family")).select("u", "v", F.lit(1).alias("away")))
    )
    # of the nearest there must be one only
    each = found.groupBy("u", "away").agg(F.count_distinct("v").alias("n"), F.min("v").alias("v"))
    return each.groupBy("u").agg(F.min_by(F.struct("n", "v"), "away").alias("k")).where("k.n = 1").select("u", "k.v")


def _person_labels(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, label) of persons, and (spelt, label): the keys by which an account name can mean them.

    Initials that could be several persons are left out.
    """
    spark = people.sparkSession
    # of the names a short form can stand for, those that are in use count
    used = people.select(F.col("given").alias("full")).distinct()
    shorts = materialize(_given_table(spark).join(used, "full", "left_semi"), "shorts")
    single = shorts.groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("full")).where("n = 1").drop("n")
    people = materialize(
        people.join(F.broadcast(single), people["given"] == single["short"], "left")
        .select("name", "family", F.coalesce("full", "given").alias("given"), F.col("given").alias("written"), "family_alt", "given_alt"),
        "people",
    )
    full = materialize(people.where("given NOT LIKE '%.'").select("family", "given").distinct(), "forms")
    # families are compared among names with one initial
    letter = F.substring("given", 1, 1)
    families = materialize(
        radius_links(people.select(letter.alias("space"), F.col("family").alias("key")), SHORTEST["family"]).withColumn(
            "near", F.col("distance") == 1).select("space", "a", "b", "near"),
        "families",
    )
    families = families.unionByName(families.select("space", F.col("b").alias("a"), F.col("a").alias("b"), "near"))
    given = materialize(_misspelt_givens(full), "misspelt")
    node = _node("p", "family", "given")
    u = full.select(F.col("family").alias("a"), "given", node.alias("u"), letter.alias("space"))
    v = full.select(F.col("family").alias("b"), "given", node.alias("v"), letter.alias("space"))
    w = full.select("family", F.col("given").alias("b"), node.alias("v"))
    by_family = u.join(families.where("a < b"), ["space", "a"]).join(v, ["space", "b", "given"]).select("u", "v")
    by_given = u.withColumnsRenamed({"a": "family", "given": "a"}).join(given, "a").join(w, ["family", "b"]).select("u", "v")
    by_both = (
        u.join(families.where("near"), ["space", "a"])
        .join(given.select(F.col("a").alias("given"), F.col("b").alias("g")), "given")
        .join(v.withColumnRenamed("given", "g"), ["space", "b", "g"]).select("u", "v")
    )
    called = _short_links(u, w, families, F.broadcast(shorts.join(single, "short", "left_anti")))
    written = people.where("family <> family_alt AND given NOT LIKE '%.'").select(
        node.alias("u"), _node("p", "family_alt", "given").alias("v")).join(full.select(node.alias("v")), "v", "left_semi").select("u", "v")
    found = components(by_family.unionByName(by_given).unionByName(by_both).unionByName(called).unionByName(written))
    nodes = full.select("family", "given", node.alias("u"))
    labelled = materialize(
        nodes.join(found, nodes["u"] == found["node"], "left")
        .select("family", "given", F.coalesce("label", "u").alias("label"), letter.alias("letter")),
        "labelled",
    )
    named = people.join(labelled, ["family", "given"])
    # initials: the one person of that family they can mean, else of a family one error away
    initials = people.where("given LIKE '%.'").select("name", "family", "family_alt", letter.alias("letter"))
    at_home = labelled.groupBy("family", "letter").agg(F.count_distinct("label").alias("n"), F.max("label").alias("label"))
    near = (
        labelled.join(families.select(F.col("b").alias("family"), "a", F.col("space").alias("letter")), ["family", "letter"])
        .groupBy(F.col("a").alias("family"), "letter")
        .agg(F.count_distinct("label").alias("m"), F.max("label").alias("close"))
    )
    initials = materialize(
        initials.join(at_home, ["family", "letter"], "left").join(near, ["family", "letter"], "left")
        .withColumn("label", F.when(F.col("n") == 1, F.col("label")).when(F.col("n").isNull() & (F.col("m") == 1), F.col("close"))
                    .when(F.col("n").isNull() & F.col("m").isNull(), _node("i", "family", "letter")))
        .where("label IS NOT NULL").select("name", "family", "family_alt", "letter", "label"),
        "initials",
    )
    families_of = F.array("family", "family_alt")
    short_of = shorts.groupBy(F.col("full").alias("given")).agg(F.collect_set("short").alias("shorts"))
    ways = (
        named.join(F.broadcast(short_of), "given", "left")
        .withColumn("f", F.explode(F.array_distinct(families_of)))
        .withColumn("g", F.explode(F.array_distinct(F.concat(
            F.array("given", "given_alt", "written", letter), F.coalesce("shorts", F.array().cast("array<string>"))))))
        .select("label", "f", "g")
    ).unionByName(
        initials.withColumn("f", F.explode(F.array_distinct(families_of))).select("label", "f", F.col("letter").alias("g"))
    )
    spelt = ways.select(_node("p", "f", "g").alias("spelt"), "label").distinct()
    return named.select("name", "label").unionByName(initials.select("name", "label")), spelt


def _org_labels(orgs: DataFrame) -> DataFrame:
    """(name, node, label) of organisations: the same head (but for an error) and two initials in common."""
    letters = F.col("letters")
    pairs = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(letters) - 1, F.lit(1))),
        lambda i: F.transform(
            F.sequence(i + 1, F.greatest(F.length(letters), i + 1)),
            lambda j: F.concat(F.substr(letters, i, F.lit(1)), F.substr(letters, j, F.lit(1))),
        ),
    )))
    forms = orgs.select("head", "letters").distinct()
    # words of three or fewer letters can't be told apart by two of them alone
    cells = forms.select("head", _node("o", "head", "letters").alias("u"), F.explode(pairs).alias("pair"))
    stars = materialize(cells.groupBy("head", "pair").agg(F.min("u").alias("hub")), "hubs")
    same = cells.join(stars, ["head", "pair"]).select("u", F.col("hub").alias("v"))
    heads = radius_links(forms.select(F.lit("").alias("space"), F.col("head").alias("key")), SHORTEST["family"]).select("a", "b")
    other = (
        stars.withColumnRenamed("head", "a").join(heads, "a")
        .join(stars.select(F.col("head").alias("b"), "pair", F.col("hub").alias("v")), ["b", "pair"])
        .select(F.col("hub").alias("u"), "v")
    )
    found = components(same.unionByName(other))
    node = _node("o", "head", "letters")
    return orgs.withColumn("node", node).join(found, "node", "left").select("name", "node", F.coalesce("label", "node").alias("label"))


def spelling_groups(names: DataFrame) -> DataFrame:
    """(name, label) for the distinct strings ``name``: equal labels mean one person or organisation.

    Null and empty strings, placeholders and single words have no row, nor
    have initials that fit several persons of a family, nor account names
    that can spell several names, or none.  Repeated strings count once.
    """
    spellings = spread(names.where("name IS NOT NULL AND name <> ''").distinct())
    parsed = materialize(
        spellings.select("name", _parts(F.col("name")).alias("p")).select("name", "p.*").where("kind IS NOT NULL"), "parsed"
    )
    orgs = _org_labels(parsed.where("kind = 'org'").select("name", F.col("first").alias("head"), F.col("second").alias("letters")))
    orgs = materialize(orgs, "organisations")
    org_keys = materialize(orgs.select(F.col("node").alias("spelt"), "label").distinct(), "spelt")
    # account names with the initials of an organisation are no persons
    accounts = parsed.where("kind = 'account'")
    of_orgs = accounts.select("name", F.explode("spelt").alias("spelt")).join(org_keys, "spelt", "left_semi").select("name").distinct()
    of_orgs = materialize(of_orgs, "accounts")
    people = parsed.where("kind = 'person'").unionByName(accounts.join(of_orgs, "name", "left_anti")).drop("spelt", "kind")
    persons, person_keys = _person_labels(_persons(people))
    asked = parsed.where("kind = 'glued'").unionByName(accounts.join(of_orgs, "name", "left_semi"))
    meant = (
        asked.select("name", F.explode("spelt").alias("spelt")).join(person_keys.unionByName(org_keys), "spelt")
        .groupBy("name").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label")).where("n = 1").drop("n")
    )
    return persons.unionByName(orgs.select("name", "label")).unionByName(meant)


def spelling_pairs(groups: DataFrame) -> DataFrame:
    """All unordered pairs (name_a < name_b) of spellings with one label."""
    groups = materialize(groups, "groups")
    a, b = groups.withColumnRenamed("name", "name_a"), groups.withColumnRenamed("name", "name_b")
    return a.join(b, "label").where("name_a < name_b").select("name_a", "name_b")
