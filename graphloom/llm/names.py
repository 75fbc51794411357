"""Variant spellings of people and organisations, linked by exact radius joins in a metric space."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import once
from graphloom.llm.metric import radius_pairs
from graphloom.operators.components import component_labels
from graphloom.operators.skew import skew_join
from graphloom.session import cut_step as cut
from graphloom.session import release

# Titles, particles, nicknames, words of institutions and their short forms.
TITLES = frozenset("dr prof professor mr mrs ms sir dame rev phd md msc ba ma dsc jr sr ii iii".split())
PARTICLES = frozenset("de der den van von la le du di da dos del ter ten zu af".split())
#: Particles as they are shortened; with a point where they are single letters.
SHORT_PARTICLES = {"v.d.": "van der", "vd": "van der", "vd.": "van der", "v.": "van", "d.": "de"}
#: Common short forms of given names, for tables too small to learn from (``learn_nicknames``).
NICKNAMES = {
    nick: name
    for name, nicks in {
        "abigail": "abby", "albert": "al bert", "alejandro": "ale", "aleksandra": "sasha", "alexander": "alex sascha", "alfred": "alf", "andrew": "andy drew", "anthony": "tony", "antonella": "nella", "arthur": "art",
        "barbara": "barb", "benjamin": "ben benny", "bernard": "bernie", "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave",
        "deborah": "debbie deb", "dmitri": "dima", "donald": "don", "dorothy": "dot", "douglas": "doug", "edward": "ted eddie ed", "ekaterina": "katya", "eleanor": "nell ellie", "elizabeth": "liz beth lizzie betty",
        "emanuel": "manny", "eugene": "gene", "florence": "flo", "francisco": "paco pancho", "frederick": "fred freddy", "friedrich": "fritz", "gabriel": "gabe", "gerald": "jerry", "giuseppe": "beppe", "gregory": "greg",
        "guadalupe": "lupe", "harold": "harry", "heinrich": "heinz", "henry": "hank", "isabella": "bella", "jacob": "jake", "james": "jim jimmy", "jennifer": "jenny jen", "johannes": "hannes", "jonathan": "jon",
        "joseph": "joe joey", "josephine": "josie jo", "judith": "judy", "katherine": "kate kathy katie", "kenneth": "ken", "lawrence": "larry", "leonard": "len lenny", "louis": "lou", "margaret": "peggy maggie meg",
        "matthew": "matt", "maximilian": "max", "michael": "mike mick", "mikhail": "misha", "nathaniel": "nate", "nicholas": "nick", "patricia": "patty pat", "peter": "pete", "philip": "phil", "raymond": "ray",
        "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby", "ronald": "ron", "samuel": "sam", "sebastian": "seb", "stephen": "steve", "susan": "sue susie", "theodore": "theo", "thomas": "tom tommy",
        "timothy": "tim", "valentina": "tina", "veronica": "ronnie", "victor": "vic", "victoria": "vicky", "vincent": "vince", "vladimir": "vova", "walter": "walt", "william": "bill will billy", "yevgenia": "zhenya",
    }.items()
    for nick in nicks.split()
}
SHORT = {
    "univ": "university", "inst": "institute", "tech": "technology", "natl": "national", "nat": "national", "lab": "laboratory", "dept": "department",
    "polytech": "polytechnic", "stud": "studies", "consort": "consortium", "collab": "collaboration", "grp": "group", "ctr": "center", "acad": "academy",
}
ORGANISED = frozenset("institute consortium group collaboration laboratory university network survey working society council academy center centre foundation department polytechnic school project team committee".split())
LINKING = frozenset("of for on and the in at".split())

#: A pair of first names is learnt as name and nickname from so many families, which must be this
#: share of all families of the rarer one.
NICK_SUPPORT, NICK_SHARE = 3, 0.25
#: Main parts of so many letters may be two edits apart, where institution and full names agree.
LONG = 8

_LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "a", "œ": "o", "þ": "th", "ð": "d", "ı": "i"}
_UMLAUT = re.compile(r"(?<=[aou])e")
_WORD = re.compile(r"[^\W\d_]+")
_SHORT_PARTICLE = re.compile(r"(?<![\w.])(v\.\s*d\.|vd(?!\w)\.?|v\.|d\.)(?=\s*[^\W\d_]{2})", re.IGNORECASE)


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(_LETTERS.get(c, c) for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def without_umlauts(text: str) -> str:
    """``ae``, ``oe`` and ``ue``, which may stand for umlauts, as one letter."""
    return _UMLAUT.sub("", text)


def place(affiliation: str | None) -> str | None:
    """An affiliation with its short forms spelt out; null if it names nothing."""
    if affiliation is None:
        return None
    return " ".join(SHORT.get(w, w) for w in _WORD.findall(plain(affiliation))) or None


def given_tokens(text: str) -> list[str]:
    """Given names and initials; run-together initials are taken apart, titles left out."""
    out: list[str] = []
    for word in _WORD.findall(text):
        if word.lower() in TITLES:
            continue
        if 1 < len(word) <= 3 and word.isupper():
            out += [plain(c) for c in word]
        else:
            out.append(plain(word))
    return [t for t in out if t]


def _particle(word: str) -> bool:
    return word in PARTICLES or (1 < len(word) < 5 and any(len(p) > 2 and edit_distance(word, p, 1) < 2 for p in PARTICLES))


def _spelt(text: str) -> list[str]:
    """The words of a family name without titles; particles spelt out, exchanged letters put back."""
    long = _SHORT_PARTICLE.sub(lambda m: SHORT_PARTICLES["".join(m[1].lower().split())] + " ", text)
    words = [w for w in (plain(w) for w in _WORD.findall(long)) if w not in TITLES]
    back = lambda w: w[::-1] if len(w) == 2 and w not in PARTICLES and w[::-1] in PARTICLES else w
    return [back(w) for w in words[:-1]] + words[-1:]


def _without_particles(words: list[str]) -> list[str]:
    return [w for i, w in enumerate(words) if not (_particle(w) and any(not _particle(x) for x in words[i + 1 :]))]


def family_words(text: str) -> list[str]:
    """The words of a family name without titles and (mistyped) particles; at least one stays."""
    return _without_particles(_spelt(text))


def organisation(text: str) -> tuple[str, str]:
    """(own name, what kind of body it is) of an organisation, however the two are ordered."""
    front, _, back = text.partition(",")
    words = lambda t: [SHORT.get(w, w) for w in (plain(w) for w in _WORD.findall(t)) if w != "the"]
    if back.strip():
        head, rest = words(back), words(front)
    else:
        every = words(front)
        if len(every) > 2 and every[-2] == "of" and every[0] in ORGANISED:
            head, rest = every[-1:], every[:-2]
        else:
            head, rest = every[:1], every[1:]
    rest = [w for w in rest if w not in LINKING]
    return "".join(head), " ".join(rest)


#: How a name is read: as typed, with given and family name exchanged, by half of a double name,
#: with its particles glued on.
TYPED, EXCHANGED, HALF, GLUED = 0, 1, 2, 3


def _ways(words: list[str], rest: str, how: int) -> list[tuple[str, str, int]]:
    core = "".join(words)
    return [(core, rest, how)] + [(without_umlauts(core), rest, how)] * (without_umlauts(core) != core)


def readings(given: str | None, family: str | None, name: str | None) -> tuple[str, list[tuple[str, str, int]]]:
    """('person' or 'organisation', the ways to read the name as (main part, rest, how))."""
    given, family = (given or "").strip(), (family or "").strip()
    if not family and not given:
        given, _, family = (name or "").strip().rpartition(" ")
    front, comma, back = family.partition(",")
    bare = [w for w in _WORD.findall(back) if w.lower() not in TITLES | PARTICLES]
    if not given:
        spelt = {SHORT.get(w, w) for w in (plain(w) for w in _WORD.findall(family))}
        if not comma or not bare or spelt & ORGANISED:
            head, rest = organisation(family)
            return "organisation", _ways([head], rest, TYPED)
        given, family = back, front
    elif comma and not bare:
        family = front
    words, tokens = family_words(family), given_tokens(given)
    swapped = _ways(family_words(given), " ".join(given_tokens(family)), EXCHANGED)
    if not words or (len("".join(words)) == 1 and len("".join(family_words(given))) > 1):
        return "person", [(main, rest, TYPED) for main, rest, _ in swapped]
    ways = _ways(words, " ".join(tokens), TYPED)
    if len(tokens) == 1 and len(tokens[0]) > 2 and len(words) < 3:
        ways += swapped
    halves = [w for w in words if len(w) > 3]
    if len(words) > 1 and len(halves) > 1:
        ways += [w for half in halves for w in _ways([half], " ".join(tokens), HALF)]
    every = _spelt(family)
    if len(every) > len(words):
        ways += _ways(every, " ".join(tokens), GLUED)
    return "person", ways


def edit_distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent exchange counts one), or ``most`` + 1 if greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _same_given(a: str, b: str, nicknames: dict[str, str]) -> bool:
    a, b = nicknames.get(a, a), nicknames.get(b, b)
    return a == b or edit_distance(a, b, 1) <= 1 or edit_distance(without_umlauts(a), without_umlauts(b), 1) <= 1


def _initials(token: str, nicknames: dict[str, str]) -> set[str]:
    return {token[0], nicknames.get(token, token)[0]}


def given_match(a: list[str], b: list[str], nicknames: dict[str, str]) -> int:
    """2 if given names agree by full first names, 1 if only by an initial, else 0."""
    if not a or not b:
        return 0
    for x, y in zip(a[1:], b[1:], strict=False):
        if not (_initials(x, nicknames) & _initials(y, nicknames)) or (len(x) > 1 and len(y) > 1 and not _same_given(x, y, nicknames)):
            return 0
    if len(a[0]) > 1 and len(b[0]) > 1:
        return 2 if _same_given(a[0], b[0], nicknames) else 0
    return int(bool(_initials(a[0], nicknames) & _initials(b[0], nicknames)))


def _short_form(words: str) -> str:
    return "".join(w[0] for w in words.split())


def organisations_match(a: str, b: str) -> int:
    """2 if two kinds of body agree: nearly the same words, or one is the other's initials."""
    if edit_distance(a, b, 2) <= 2 and min(len(a), len(b)) > 4:
        return 2
    ia, ib = _short_form(a), _short_form(b)
    joined_a, joined_b = a.replace(" ", ""), b.replace(" ", "")
    return 2 * (a == b or (len(ia) > 1 and ia == ib) or joined_a == ib or joined_b == ia)


def _grader(nicknames: dict[str, str]) -> Callable:
    """Grade of two rests whose main parts are near: 0 not the same, 1 the same by an initial, 2 the
    same by full names."""

    @F.pandas_udf(T.IntegerType())
    def grade(kind: pd.Series, rest_a: pd.Series, rest_b: pd.Series) -> pd.Series:
        out = [organisations_match(a, b) if k == "organisation" else given_match(a.split(), b.split(), nicknames) for k, a, b in zip(kind, rest_a, rest_b, strict=True)]
        return pd.Series(out, dtype="int32")

    return grade


_FORM = "author_no bigint, form string, kind string, aff string, full boolean, ways array<struct<main:string,rest:string,how:int>>"


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = lambda v: v if isinstance(v, str) else None
    for batch in batches:
        out = []
        for no, given, family, name, aff in zip(*(batch[c] for c in ("author_no", "given", "family", "name", "affiliation")), strict=True):
            kind, ways = readings(none(given), none(family), none(name))
            ways = [w for w in ways if w[0]]
            if not ways:
                continue
            where = "" if kind == "organisation" else place(none(aff))
            full = kind == "organisation" or any(len(w[1].split(" ")[0]) > 1 for w in ways[:1])
            form = "\x1f".join([kind, "?" if where is None else "=" + where, *(str(p) for w in ways for p in w)])
            out.append((no, form, kind, where, full, [{"main": m, "rest": r, "how": how} for m, r, how in ways]))
        yield pd.DataFrame(out, columns=["author_no", "form", "kind", "aff", "full", "ways"])


def learn_nicknames(ways: DataFrame, known: dict[str, str]) -> dict[str, str]:
    """``known`` and the short forms that the index itself shows.

    Two first names that stand with the same family name at the same institution in at least
    NICK_SUPPORT families, and in NICK_SHARE of all families of the rarer one, are forms of one name,
    for two people chosen by chance rarely meet so; the rarer one is the short form. Counted over all
    rows; the result has at most one entry for each given name with so much support.
    """
    first = F.substring_index("rest", " ", 1)
    held = ways.where((F.col("kind") == "person") & (F.col("reading") == TYPED) & F.col("aff").isNotNull()).select("aff", "main", first.alias("first")).where(F.length("first") > 1).distinct()
    one = held.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    other = held.withColumnRenamed("first", "other")
    met = held.join(other, ["aff", "main"]).where("first < other").groupBy("first", "other").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= NICK_SUPPORT)
    met = met.where(F.levenshtein("first", "other") > 2).join(one, "first").join(one.select(F.col("first").alias("other"), F.col("n").alias("m")), "other")
    out, learnt = dict(known), set()
    for r in met.where(F.col("both") >= NICK_SHARE * F.least("n", "m")).orderBy(F.desc("both"), "first", "other").collect():
        name, nick = (r["first"], r["other"]) if (r["n"], r["other"]) > (r["m"], r["first"]) else (r["other"], r["first"])
        name = out.get(name, name)
        if nick not in learnt and name != out.get(nick, nick) and name != nick:
            learnt.add(nick)
            out = {k: name if v == nick else v for k, v in out.items()} | {nick: name}
    return out


def readings_of(forms: DataFrame, nicknames: dict[str, str]) -> DataFrame:
    """A row for every way to read every form and every letter under which a matching rest is found:
    ``id``, ``kind``, ``aff``, ``reading``, ``main``, ``rest``, ``first`` (name), ``spelt``, the name
    that this is short for, ``letter``, and the blocks ``here`` and, for long main parts, ``named``
    (null without an institution) and ``wide``.

    Two given names that match share the first letter, that of the name a nickname stands for, or the
    second letter, whatever single edit lies between them. A person without a given name matches
    nobody and has no row.
    """
    way = forms.select("id", "kind", "aff", F.explode("ways").alias("way")).select("id", "kind", "aff", F.col("way.how").alias("reading"), F.col("way.main").alias("main"), F.col("way.rest").alias("rest"))
    person = F.col("kind") == "person"
    named = way.where(~person | (F.col("rest") != "")).withColumn("first", F.when(person, F.substring_index("rest", " ", 1)).otherwise("")).select("*", once(_spelt_out("first", nicknames)).alias("spelt"))
    letters = F.array_distinct(F.filter(F.array(F.left("first", F.lit(1)), F.left("spelt", F.lit(1)), F.substr("first", F.lit(2), F.lit(1))), lambda c: c != ""))
    told = named.withColumn("letter", F.explode(F.when(person, letters).otherwise(F.array(F.lit("")))))
    long = person & (F.length("main") >= LONG) & (F.length("first") > 1)
    named = F.when(long, _block(F.lit("n"), "aff", "spelt"))
    return told.withColumn("here", _block(F.lit("h"), "kind", "aff", "letter")).withColumn("wide", _block(F.lit("w"), "kind", "letter")).withColumn("named", named)


def _block(*parts: Column | str) -> Column:
    """A number for a block; null if a part is."""
    text = F.concat(*(x for p in parts for x in (F.lit("\x1f"), F.col(p) if isinstance(p, str) else p)))
    return F.when(text.isNotNull(), F.xxhash64(text))


def _spelt_out(c: str, nicknames: dict[str, str]) -> Column:
    names = F.from_json(F.lit(json.dumps(nicknames)), "map<string,string>")
    return F.coalesce(F.try_element_at(names, F.col(c)), F.col(c)) if nicknames else F.col(c)


def _near(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near main parts (``block``, ``main_a``, ``main_b``, ``d``) in the blocks ``here``, ``named`` and
    ``wide`` of ``ways``, and near full first names (``letter``, ``first_a``, ``first_b``), the empty
    one of organisations included.

    One radius join serves all. In the wide blocks only forms without an institution ask. Main parts
    are near within one edit (if equal, where one has up to three letters), in the blocks ``named``
    of one institution and first name within two.
    """
    firsts = ways.where(F.length("first") != 1).select("letter", "first", "spelt").distinct()
    known = cut(firsts.select("letter", "first", _block(F.lit("f"), "letter").alias("block"), F.explode(F.array_distinct(F.array("spelt", F.regexp_replace("spelt", "(?<=[aou])e", "")))).alias("name")))
    mains = lambda df, c, r: df.where(F.col(c).isNotNull()).select(F.col(c).alias("block"), F.col("main").alias("name"), F.lit(r).alias("radius"))
    both = mains(ways, "here", 1).unionByName(mains(ways, "named", 2)).unionByName(known.select("block", "name", F.lit(1).alias("radius")))
    points = both.unionByName(mains(ways, "wide", 1))
    near = radius_pairs(points, both.unionByName(mains(ways.where(F.col("aff").isNull()), "wide", 1)))
    side = lambda x: known.select("block", "letter", F.col("first").alias(f"first_{x}"), F.col("name").alias(x))
    near_firsts = near.join(side("a"), ["block", "a"]).join(side("b").drop("letter"), ["block", "b"]).select("letter", "first_a", "first_b").distinct()
    near_mains = near.where((F.col("d") == 0) | (F.least(F.length("a"), F.length("b")) > 3))
    return near_mains.select("block", F.col("a").alias("main_a"), F.col("b").alias("main_b"), "d"), cut(near_firsts)


def _two_apart(at: DataFrame, mains: DataFrame, nicknames: dict[str, str]) -> DataFrame:
    """Pairs of people of one institution and first name whose family names of LONG letters are two
    edits apart, graded if all their given names agree."""
    side = lambda x: at.where(F.col("named").isNotNull()).select(F.col("named").alias("block"), *(F.col(c).alias(f"{c}_{x}") for c in ("id", "aff", "rest", "reading", "main"))).distinct()
    met = side("a").join(mains.where("d = 2"), ["block", "main_a"]).join(side("b"), ["block", "main_b"]).where("id_a < id_b AND aff_a = aff_b AND (reading_a = 0 OR reading_b = 0)")
    graded = met.select("id_a", "id_b", "rest_a", "rest_b").distinct().select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), _grader(nicknames)(F.lit("person"), "rest_a", "rest_b").alias("grade"))
    return graded.where("grade = 2").distinct()


def _graded(a: DataFrame, b: DataFrame, near: tuple[DataFrame, DataFrame], block: str, ordered: bool, nicknames: dict[str, str]) -> DataFrame:
    """Graded pairs (``a``, ``b``, ``grade`` > 0) of forms whose main parts and first names are near;
    one side reads the name as typed.

    Full first names meet by the pairs of near ones, so forms that share a family name only don't;
    an initial meets every form with its letter, of which it matches most.
    """
    mains, firsts = near
    side = lambda df, x: df.select(F.col(block).alias("block"), *(F.col(c).alias(f"{c}_{x}") for c in ("id", "kind", "aff", "letter", "main", "rest", "first", "reading")))
    apart = F.col("id_a") < F.col("id_b") if ordered else F.col("id_a") != F.col("id_b")
    left = side(a, "a").withColumnRenamed("letter_a", "letter").join(mains.drop("d"), ["block", "main_a"])
    right = side(b, "b")
    short = lambda x: F.length(f"first_{x}") == 1
    full = left.where(~short("a")).join(firsts, ["letter", "first_a"]).join(right.where(~short("b")), ["block", "main_b", "first_b"])
    initial = left.join(right, ["block", "main_b"]).where(short("a") | short("b"))
    same = (F.col("kind_a") == F.col("kind_b")) & (F.col("letter") == F.col("letter_b"))  # blocks are hashes
    same &= (F.col("aff_a") == F.col("aff_b")) if block == "here" else F.lit(True)
    met = full.unionByName(initial).where(same & apart & ((F.col("reading_a") == TYPED) | (F.col("reading_b") == TYPED)))
    graded = met.select(F.col("kind_a").alias("kind"), "id_a", "id_b", "rest_a", "rest_b").distinct().select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), _grader(nicknames)("kind", "rest_a", "rest_b").alias("grade"))
    return graded.where("grade > 0").groupBy("a", "b").agg(F.max("grade").alias("grade"))


def _attach(loose: DataFrame, ties: DataFrame, labels: DataFrame) -> DataFrame:
    """(``id``, ``label``) of loose forms that are tied to forms of exactly one label."""
    to = ties.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"), F.max("label").alias("last"))
    return loose.select("id").join(to.where("label = last"), "id").select("id", "label")


def _grouped(ids: DataFrame, ties: DataFrame) -> DataFrame:
    """(``id``, ``label``) of all ``ids``; those connected by ``ties`` share a label."""
    groups = component_labels(ties, "a", "b").select("id", F.col("component").alias("label"))
    return ids.select("id").join(groups, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _both(ties: DataFrame) -> DataFrame:
    return ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"), "grade"))


def entities(authors: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(``author_no``, ``entity``): rows of the index that mean the same person or organisation.

    Rows are first reduced to distinct forms (kind, institution, name without titles, accents and
    case), so copies cost nothing. Main parts (family names, own names of organisations) and first
    names meet in the cells of pivots (``radius_pairs``), by exact radius joins over distinct names,
    and forms whose parts are near are graded. Full names at one institution are grouped
    transitively; a form with only an initial joins the group it matches if there is exactly one, so
    it never ties two people together; the same then holds for forms without an institution against
    all institutions. What stays loose is grouped among itself. Namesakes at different institutions
    are never linked. ``nicknames`` (short form to name, NICKNAMES if None) are extended by those the
    index shows (``learn_nicknames``).

    Null or blank names give no row; a null number gives no row; repeated rows fall together; extra
    columns are ignored; an empty table gives no rows.
    """
    spark = authors.sparkSession
    rows = authors.where(F.col("author_no").isNotNull()).select(F.col("author_no").cast("bigint").alias("author_no"), "given", "family", "name", "affiliation").mapInPandas(_reader, _FORM)
    read = cut(rows)
    forms = cut(read.groupBy("form").agg(F.min("author_no").alias("id"), F.first("kind").alias("kind"), F.first("aff").alias("aff"), F.first("full").alias("full"), F.first("ways").alias("ways")))
    plain = readings_of(forms, {}).drop("spelt", "letter", "here", "wide", "named").distinct()
    nick = learn_nicknames(plain, NICKNAMES if nicknames is None else nicknames)
    ways = cut(readings_of(forms, nick))
    near = _near(ways)
    release(spark)
    placed, unplaced = forms.where(F.col("aff").isNotNull()), forms.where(F.col("aff").isNull())
    at, nowhere = ways.where(F.col("aff").isNotNull()), ways.where(F.col("aff").isNull())
    close = cut(_graded(at, at, near, "here", True, nick))
    release(spark)
    ties = cut(close.unionByName(_two_apart(at, near[0], nick)))
    release(spark)
    full = placed.where("full").select("id")
    by_full = cut(_grouped(full, ties.where("grade = 2")))

    initial = placed.where(~F.col("full"))
    joined = cut(_attach(initial, _both(ties), by_full))
    release(spark)
    left = cut(initial.select("id").join(joined, "id", "left_anti"))
    loose_ties = cut(ties.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
    settled = cut(by_full.unionByName(joined).unionByName(_grouped(left, loose_ties)))

    release(spark)
    across = cut(_graded(nowhere, at, near, "wide", False, nick))
    found = cut(_attach(unplaced, across, settled))
    rest = cut(unplaced.select("id").join(found, "id", "left_anti"))
    among = nowhere.join(rest, "id", "left_semi")
    alike = cut(_graded(among, among, near, "wide", True, nick).where("grade = 2"))
    labels = cut(settled.unionByName(found).unionByName(_grouped(rest, alike)))
    release(spark)
    by_form = forms.select("form", "id").join(labels, "id").select("form", F.col("label").alias("entity"))
    return skew_join(read.select("author_no", "form"), by_form, ["form"]).select("author_no", "entity").distinct()


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """(``author_a`` < ``author_b``): every pair of rows of one entity."""
    a, b = linked.select("entity", F.col("author_no").alias("author_a")), linked.select("entity", F.col("author_no").alias("author_b"))
    return a.join(b, "entity").where("author_a < author_b").select("author_a", "author_b")
