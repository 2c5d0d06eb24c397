"""Variant spellings of one person, organisation or place, linked within a scope such as an article.

Each name gets a few normalised forms: as it is written, as a sorted bag of its
words, as initial and family name, as family name, as acronym. Forms are points of
a metric space under the Levenshtein distance. Every scope is cut into cells by
the nearest of some pivots, about as many as the root of its number of points, and a point is copied into every
cell whose pivot is hardly farther than its own one; by the triangle inequality each pair within the radius
then meets in a cell, and the exact distance decides. Forms that can stand for several entities
(initials, family names, acronyms) link only where one entity is meant.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import fold
from graphloom.tables import materialise, small

RADIUS = 2
PIVOTS_PER_ROOT = 0.25  # of the number of points in a scope

# Short for.
ABBREVIATIONS = dict(
    intl="international", natl="national", cttee="committee", comm="commission", assn="association", assoc="association", soc="society",
    fdn="foundation", found="foundation", coll="college", co="company", corp="corporation", univ="university", mus="museum", inst="institute",
    dept="department", bros="brothers", ltd="limited", st="saint", mt="mount", ft="fort", hist="historical", acad="academy",
    admin="administration", agcy="agency", bd="board", bur="bureau", cncl="council", conf="conference", coop="cooperative", corpn="corporation", eng="engineering",
    fed="federation", govt="government", gp="group", hosp="hospital", inc="incorporated", ind="industries", lab="laboratory", lib="library", mfg="manufacturing", mgmt="management",
    min="ministry", orch="orchestra", org="organisation", organization="organisation", sch="school", sci="science", sec="secretariat", svc="service", tech="technology", trib="tribunal", vol="volunteer",
)
# Words before a person's name.
TITLES = {"dr", "prof", "professor", "sir", "lady", "lord", "mr", "mrs", "ms", "miss", "mme", "rev", "capt", "col", "gen", "dame"}
# Words that say nothing about who is meant.
STOP = {"the", "of", "for", "in", "and", "at"}
# Words of names that are no persons' names: of places and buildings, of bodies and firms, of events and works.
KINDS = {
    *"airport archipelago avenue bay beach bridge canal cape cave city coast county creek desert district falls fort forest garden glacier gorge gulf harbour harbor highlands hill hills island islands isle lagoon lake".split(),
    *"lighthouse moor mount mountain mountains ocean park pass peninsula plain plateau point pond port province reef region reserve river road rock sea sound square station strait street town valley village volcano".split(),
    *"abbey castle cathedral chapel church cloister college hall hospital hotel house inn library mill mosque museum observatory palace prison saint school shrine synagogue temple theatre theater tower university".split(),
    *"academy administration agency alliance archive army assembly association authority bank board brigade brothers bureau cabinet centre center chamber choir club commission committee company conference confederation congress".split(),
    *"consortium cooperative corporation council court department enterprise faculty federation fleet force foundation fund government group guild incorporated industries initiative institute institution laboratory league limited".split(),
    *"ministry movement network observatory office orchestra order organisation parliament partnership party police press railway regiment secretariat senate service society sons squadron syndicate team tribunal trust union works".split(),
    *"award battle championship cup exhibition expedition fair festival games mission operation prize programme project revolution survey tournament treaty voyage war".split(),
    *"central european federal historical international municipal national northern provincial regional royal southern state united western eastern".split(),
}
# Everyday forms of given names.
NICKNAMES = {
    short: full
    for full, shorts in dict(
        alexander="alec alex sandy", andrew="andy drew", anthony="tony", benjamin="ben benny", catherine="cathy", charles="charlie chuck", christopher="chris kit",
        daniel="dan danny", david="dave", dorothy="dot dolly dottie", edward="ned eddie ed", eleanor="nell nellie ellie", elizabeth="liz beth betty lizzie eliza", francis="frank",
        frederick="fred", george="georgie", gregory="greg", harold="hal", henry="hank harry", james="jim jimmy jamie", jennifer="jen jenny", john="jack johnny", joseph="joe joey",
        katherine="kate kathy katie kay", lawrence="larry", margaret="peggy maggie meg", matthew="matt", michael="mike mick mickey", nicholas="nick", patricia="pat patty tricia",
        philip="phil", rebecca="becky becca", richard="dick rick richie", robert="bob bobby rob", ronald="ron", samuel="sam sammy", stephen="steve", susan="sue susie",
        theodore="ted teddy theo", thomas="tom tommy", timothy="tim", victoria="vicky vicki tori", walter="walt", william="bill billy will willie",
    ).items()
    for short in shorts.split()
}
# Cyrillic letters in Latin ones.
CYRILLIC = str.maketrans(dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "), strict=True)))
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
_ENDING = re.compile("iy|yy|ij")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


@functools.lru_cache(maxsize=100_000)
def plain(text: str) -> str:
    """Small Latin letters without accents, as far as there is a rule."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(CYRILLIC).translate(_PLAIN)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(CYRILLIC)
    return _ENDING.sub("y", text)


def words(raw: str) -> tuple[list[str], bool]:
    """The words of a name in their usual order, and whether a comma had turned them round."""
    raw = _HIDDEN.sub("", raw).strip(" ,;.:!?\"'«»“”()[]")
    if not re.search(r"[\s_-]", raw):  # words run together
        raw = re.sub(r"(?<=[^\W\d_])(?=\d)|(?<=[a-zß-ÿа-я])(?=[A-ZÀ-ÞА-Я])", " ", raw)
    before, comma, after = raw.partition(",")
    turned = bool(comma and re.search(r"\w", after))
    raw = f"{after} {before}" if turned else raw
    return re.findall(r"\d+(?:[^\w\s]\d+)*|[^\W\d_]+", raw), turned


def forms(raw: str) -> list[tuple[str, str, str, str]]:
    """``(class, form, initials, role)`` of a name.

    Strong classes: ``w`` as written, ``b`` bag of words; ``v`` and ``c`` are the same of names
    with one initial. Weak ones: ``i`` family name under an initial, ``l`` family name, ``a`` acronym;
    their role says whether the name is the short one that asks or a full one that may be meant.
    """
    given, _ = words(raw)
    digits = ".".join(w for w in given if w[0].isdigit())
    letters = [plain(w) for w in given if not w[0].isdigit()]
    letters = [w for w in letters if w]
    if not letters:
        return [("w" + digits, digits, "", "")] if digits else []
    initials = lambda ws: "".join(sorted(w[0] for w in ws))
    written = ["w" + digits, "".join(letters), initials(letters), ""]
    if letters[0] in TITLES and len(letters) > 1:
        letters = letters[1:]
    full = [ABBREVIATIONS.get(w, w) for w in letters]
    content = [w for w in full if w not in STOP] or full
    person = not digits and not KINDS & set(full) and len(content) == len(full) <= 4
    if person and len(content) == 3:  # a middle name may be left out
        content = [content[0], content[2]] if len(content[1]) > 1 or len(content[0]) > 1 else content[1:]
    out, bag_class = [], "b" + digits
    if person and len(content) == 2:
        content = [NICKNAMES.get(w, w) for w in content]
        short = [w for w in content if len(w) <= 2]
        long = [w for w in content if len(w) > 2]
        if len(short) == 1:  # compared with its like only, so that one letter is no edit of a short name
            out.append((f"i{short[0][0]}", long[0], long[0][0], "asks"))
            content, bag_class, written[0] = [short[0][0], *long], f"c{short[0][0]}", f"v{short[0][0]}"
        elif not short:
            for a, b in (content, content[::-1]):
                out.append((f"i{a[0]}", b, b[0], "meant"))
                out.append(("l", b, b[0], "meant"))
    elif person and len(content) == 1:
        word = letters[0]  # as it is written: an acronym may look like an abbreviation
        if len(word) > 2:
            out.append(("l", word, word[0], "asks"))
        if len(word) > 1:
            out.append(("a" + word, "", "", "asks"))
    elif len(content) > 1:
        if person:  # four words: the last may be the family name
            out += [(f"i{content[0][0]}", content[-1], content[-1][0], "meant"), ("l", content[-1], content[-1][0], "meant")]
        out.append(("a" + "".join(w[0] for w in content), "", "", "meant"))
    bag = sorted(content)
    return list(dict.fromkeys([tuple(written), *out, (bag_class, " ".join(bag), initials(bag), "")]))


def points(names: DataFrame) -> DataFrame:
    """``(scope, name, class, form, initials, role)`` from ``(scope, name, raw)``: the forms of every spelling of a name."""
    schema = "scope long, name string, class string, form string, initials string, role string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, n, *f) for s, n, r in zip(batch["scope"], batch["name"], batch["raw"]) for f in forms(r)]
            yield pd.DataFrame(rows, columns=["scope", "name", "class", "form", "initials", "role"])

    return names.select("scope", "name", "raw").mapInPandas(parse, schema)


def cells(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds ``cell`` (a point may be in several) and ``home`` (in one of them).

    The pivots of a scope are a sample of its points by hash, about ``PIVOTS_PER_ROOT`` times the root of their
    number; those of one class are pivots for its points. A class without two of them is one cell.
    """
    group = ["scope", "class"]
    sizes = materialise(found.groupBy("scope").agg(F.count("*").alias("n")), "name-scopes")
    drawn = F.pmod(F.xxhash64(F.lit(3), "class", "form"), F.lit(1 << 30)) / float(1 << 30)
    sample = found.select(*group, "form").join(small(sizes, 1_000_000), "scope").filter(drawn < PIVOTS_PER_ROOT / F.sqrt("n"))
    pivots = materialise(sample.groupBy(*group).agg(F.sort_array(F.collect_set("form")).alias("pivots")).filter(F.size("pivots") > 1), "name-pivots")
    pivots = small(pivots, 1_000_000)
    alone = found.join(pivots.select(*group), group, "left_anti").select(*found.columns, F.lit("").alias("cell"), F.lit(True).alias("home"))
    rows = found.join(pivots, group).withColumn("far", F.transform("pivots", lambda p: F.levenshtein(F.col("form"), p))).withColumn("best", F.array_min("far"))
    near = F.filter(F.arrays_zip("pivots", "far"), lambda x: x["far"] <= F.col("best") + 2 * radius)
    own = F.get("pivots", (F.array_position("far", F.col("best")) - 1).cast("int"))
    cell = F.transform(near, lambda x: F.struct(x["pivots"].alias("cell"), (x["pivots"] == own).alias("home")))
    return alone.unionByName(rows.select(*found.columns, F.explode(cell).alias("c")).select(*found.columns, "c.cell", "c.home"))


def _close(a: str, b: str) -> Column:
    """One edit, or two edits in a longer form where all words begin alike."""
    far = F.levenshtein(F.col(f"{a}.form"), F.col(f"{b}.form"), RADIUS)
    longer = F.least(F.length(f"{a}.form"), F.length(f"{b}.form")) >= 8
    return (far >= 0) & ((far == 0) | ((far == 1) & (F.length(f"{a}.form") > 3)) | (longer & (F.col(f"{a}.initials") == F.col(f"{b}.initials"))))


def links(celled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strong links ``(scope, a, b)`` and weak ones ``(scope, asks, meant)``, by exact joins in the cells."""
    meet = lambda a, b: (F.col(f"{a}.scope") == F.col(f"{b}.scope")) & (F.col(f"{a}.class") == F.col(f"{b}.class")) & (F.col(f"{a}.cell") == F.col(f"{b}.cell"))
    strong = celled.filter("role = ''")
    a, b = strong.alias("a"), strong.alias("b")  # the same on both sides, to be sent once
    same = a.join(b, meet("a", "b") & F.col("a.home") & (F.col("a.name") != F.col("b.name")) & _close("a", "b"))
    same = same.select("a.scope", F.least("a.name", "b.name").alias("a"), F.greatest("a.name", "b.name").alias("b")).distinct()
    x, y = celled.filter("role = 'asks' and home").alias("x"), celled.filter("role = 'meant'").alias("y")
    weak = x.join(y, meet("x", "y") & (F.col("x.name") != F.col("y.name")) & _close("x", "y"))
    return same, weak.select("x.scope", F.col("x.name").alias("asks"), F.col("y.name").alias("meant")).distinct()


def components(edges: DataFrame, gathered: int = 5_000) -> DataFrame:
    """``(scope, name, label)``: the smallest name that each name of some edge is connected with.

    A scope with at most ``gathered`` edges is solved in one place; the rest by passing
    labels on, however large they are.
    """
    wide = materialise(edges.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") > gathered).select("scope"), "wide-links")
    if wide.isEmpty():
        return _gathered_components(edges)
    narrow = edges.join(wide, "scope", "left_anti")
    return _gathered_components(narrow).unionByName(_passed_components(edges.join(wide, "scope", "left_semi")))


def smallest_connected(a: list[str], b: list[str]) -> dict[str, str]:
    """The smallest name that each name is connected with."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(up)}


def _gathered_components(edges: DataFrame) -> DataFrame:
    @F.pandas_udf("array<struct<name:string,label:string>>")
    def solve(firsts: pd.Series, seconds: pd.Series) -> pd.Series:
        found = (smallest_connected(list(a), list(b)) for a, b in zip(firsts, seconds))
        return pd.Series([[{"name": k, "label": v} for k, v in labels.items()] for labels in found])

    rows = edges.groupBy("scope").agg(F.collect_list(F.struct("a", "b")).alias("e"))
    rows = rows.select("scope", F.explode(solve("e.a", "e.b")).alias("x"))
    return rows.select("scope", "x.name", "x.label")


def _passed_components(edges: DataFrame) -> DataFrame:
    """Labels are passed on, and jump to the label of their label, until nothing changes; each round is written to the shared folder."""
    both = materialise(edges.unionByName(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))), "name-edges")
    labels = materialise(both.groupBy("scope", "a").agg(F.min("b").alias("b")).select("scope", F.col("a").alias("name"), F.least("a", "b").alias("label")), "name-labels")
    while True:
        other = labels.select("scope", F.col("name").alias("b"), F.col("label").alias("other"))
        passed = both.join(other, ["scope", "b"]).groupBy("scope", F.col("a").alias("name")).agg(F.min("other").alias("other"))
        step = labels.join(passed, ["scope", "name"]).select("scope", "name", F.least("label", "other").alias("new"), "label")
        up = step.select("scope", F.col("name").alias("new"), F.col("new").alias("jump"))
        step = step.join(up, ["scope", "new"], "left").select("scope", "name", F.least("new", F.coalesce("jump", "new")).alias("new"), "label")
        step = materialise(step, "name-labels")
        labels = step.select("scope", "name", F.col("new").alias("label"))
        if step.filter("new < label").isEmpty():
            return labels


def resolve(same: DataFrame, weak: DataFrame, hints: DataFrame) -> DataFrame:
    """All links ``(scope, a, b)``: the strong ones, and the weak ones that mean one entity.

    If a short form can mean several entities, the one that ``hints`` ``(scope, name, meant)``
    name is taken, and none without a hint. Hints alone link nothing.
    """
    strong = materialise(components(same), "strong-names")
    label = lambda rows, c, to: rows.join(strong.select("scope", F.col("name").alias(c), F.col("label").alias(to)), ["scope", c], "left").withColumn(to, F.coalesce(to, c))
    aimed = label(label(weak, "meant", "target"), "asks", "source").filter("target <> source")
    aimed = aimed.groupBy("scope", "source", "target").agg(F.min("asks").alias("asks"), F.min("meant").alias("meant"))
    hinted = label(label(hints.select("scope", F.col("name").alias("asks"), "meant"), "meant", "target"), "asks", "source").select("scope", "source", "target", F.lit(1).alias("hint")).distinct()
    choices = Window.partitionBy("scope", "source")
    aimed = aimed.join(hinted, ["scope", "source", "target"], "left")
    aimed = aimed.withColumn("n", F.count("*").over(choices)).withColumn("hints", F.count("hint").over(choices))
    sure = aimed.filter("n = 1 or (hints = 1 and hint = 1)")
    return same.unionByName(sure.select("scope", F.least("asks", "meant").alias("a"), F.greatest("asks", "meant").alias("b")))


def variants(mentions: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``(scope, name, label)`` of every name that has a variant; names with one label mean one entity.

    ``mentions`` has ``(scope bigint, raw string)`` in any number of repetitions; names are folded
    (letters and digits only). Rows with a null in either column, or whose name folds to nothing,
    do not count. ``hints`` has ``(scope, raw, meant)``, known variants of which some may be
    wrong.
    """
    spark = mentions.sparkSession
    # spellings are made distinct before they are folded, and those of one name stay apart
    names = mentions.select(F.col("scope").cast("long").alias("scope"), "raw").filter("scope is not null and raw is not null").distinct()
    names = names.select("scope", "raw", fold(F.col("raw")).alias("name")).filter("length(name) > 0")
    if hints is None:
        hints = spark.createDataFrame([], "scope long, raw string, meant string")
    hints = hints.select("scope", fold(F.col("raw")).alias("name"), fold(F.col("meant")).alias("meant")).filter("length(name) > 0 and length(meant) > 0 and name <> meant").distinct()
    same, weak = links(cells(materialise(points(names), "name-forms")))
    same, weak = materialise(same, "same-names"), materialise(weak, "short-names")
    return components(materialise(resolve(same, weak, hints), "name-links"))


def pairs(labels: DataFrame) -> DataFrame:
    """``(scope, name_a, name_b)``: every two names with one label."""
    a, b = labels.alias("a"), labels.alias("b")
    rows = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.name") < F.col("b.name")))
    return rows.select("a.scope", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
