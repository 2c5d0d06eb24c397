"""Sentences and headings of texts in many languages and scripts, as SQL expressions.

A working copy of the text, of the same length as the text, has each full stop that ends
no sentence (decimals, URLs, initials, abbreviations, stops inside a quotation) replaced
by a private-use placeholder, and quotation marks of any style by one opening and
one closing placeholder. Terminator patterns of the scripts then cut it. As every
replacement keeps its length, the cuts are offsets into the text itself, which restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, MAYBE, OPEN, CLOSE, CUT = (chr(c) for c in (0xE000, 0xE001, 0xE010, 0xE011, 0xE0FF))
ENDS = ".!?…。！？؟।॥"
BLANKS = "".join(map(chr, (9, 11, 12, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
LINE_ENDS = "".join(map(chr, (0x2028, 0x2029)))

# Abbreviations after which a sentence goes on, by language. Chinese, Japanese and Thai have none that end in a full stop.
ABBREVIATIONS = {
    "en": (
        "Dr Mr Mrs Ms Messrs Prof Rev Revd Hon Gen Col Maj Cmdr Adm Capt Lt Sgt Cpl Gov Sen Rep Pres Supt Msgr St Ste Mt Mts Ft Rd Ave Blvd Hwy Pkwy Jr Sr No Nos Vol Vols pp cf vs fig figs eq eqs "
        "ed eds transl approx sq viz ca c al Intl Natl Cttee Assn Assoc Coll Univ Inst Dept Mus Acad Soc Hist Jan Feb Aug Sept Oct Nov Dec incl excl esp resp"
    ),
    "de": "Nr Nrn vgl bzw Abb Abs Abg Abt Anm Aufl Bd Bde Bez Bhf Bsp Dipl Fr Frl Hr Hrn Hrsg hrsg Ing Jh Jhd Kap Lkr Mio Mrd Pfr Sekr Str Tab Univ Verf Vors dgl ebd etw evtl exkl geb gegr gest ggf ggfs inkl insb lfd sog spez urspr vorm zzgl zit",
    "fr": "M Mme Mlle Mmes MM Me Mgr Pr av apr env chap éd coll fasc fig janv févr juill oct déc réf St Ste vol",
    "es": "Sr Sra Srta Sres Dr Dra Dña Ud Uds Vd Vds Lic Ing Arq Prof Gral Cnel Tte núm núms aprox pág págs ej Sta Sto Avda Dpto fig vol ene feb abr sept oct dic admón",
    "ru": "гг вв тт стр рис им см ср тыс млн млрд трлн ул пер просп пл наб проф акад доц канд чл напр табл обл р-н гр гл изд ред св соч экз кв ок англ фр лат греч",
    "hi": "डॉ प्रो पृ श्री सं क्र",
    "ar": "أ د ص",
}
# Abbreviations that often are the last word of a sentence.
CLOSING = "Co Cía Cia Cie Ltd Inc Corp Bros Esq etc usw usf ff uvm руб коп др пр"
# The same, made of several parts, with the blanks that may stand in them.
CLOSING_PARTS = (r"a\. ?m", r"p\. ?m", r"u\. ?a\. ?m", r"u\. ?v\. ?m", r"т\. ?д", r"т\. ?п", r"u\. ?s\. ?w")
# Function words that go on with a sentence after such an abbreviation, for texts in one letter case. Left out are
# those that as often begin one: articles, pronouns, and what opens a statement of time or place (in, by, after, when).
CONTINUATIONS = (
    # English
    "and or but nor though although whereas unless than that which who whom whose as of at to from with without within for on onto "
    "near beside behind below above under over between among against along across around about through towards despite except per via while much "
    # German
    "und oder aber denn sondern obwohl dass ob bei mit ohne vom von zu zum zur aus für gegen durch um an am auf über unter hinter neben zwischen seit trotz wegen unweit sowie wie sehr "
    # French
    "et ou mais ni car donc que qui dont où comme avec sans depuis chez sur sous entre vers par pour près malgré non de du des "
    # Spanish
    "y e o u pero ni sino que quien donde como con sin desde hasta según sobre bajo entre hacia para por cerca pese contra a al de del "
    # Russian
    "и или а но да что который где как чтобы с со без во на над под из от для при об о у ко за между около через вопреки недалеко"
)
# What follows a German ordinal.
AFTER_ORDINAL = "Jahrhunderts? Jh Januar Februar März April Mai Juni Juli August September Oktober November Dezember"


def _words(text: str) -> str:
    """A pattern for any of the words, which looks at their first letter first."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(text.split()), key=lambda w: (-len(w), w)):
        by.setdefault(w[0].lower(), []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(dict.fromkeys(rest))})" for first, rest in by.items())


def _one_of(chars: str) -> str:
    """A pattern for any of the characters, which sees first that a common one is beyond them."""
    high = sorted(c for c in chars if c > "\xff")
    return f"[{''.join(c for c in chars if c <= '\xff')}[{high[0]}-{high[-1]}&&[{''.join(high)}]]]"


END = _one_of(ENDS)


def working_copy(text: Column) -> Column:
    """``text`` with plain blanks and line ends, quotation marks that are open or closed, and no placeholder; of equal length."""
    taken, marks = MASK + MAYBE + CUT, "«“「『»”」』"
    any_odd = text.rlike(_one_of("\r" + BLANKS + LINE_ENDS + taken + marks + "„"))  # a text without is its own copy
    return F.when(any_odd, _replaced(text, taken, marks)).otherwise(text)


def _replaced(text: Column, taken: str, marks: str) -> Column:
    text = F.regexp_replace(text, r"\r(?!\n)", "\n")
    text = F.regexp_replace(text, r"„([^„“”\n]*(?:\n[^„“”\n]+)*)[“”]", f"{OPEN}$1{CLOSE}")  # this style opens with what closes elsewhere
    turned = r"»(?<=(?:\A|[\s(\[„“])»)(?=[\p{L}\p{N}])([^«»\n]*(?:\n[^«»\n]+)*)«"  # and this one turns them round
    text = F.regexp_replace(text, turned, f"{OPEN}$1{CLOSE}")
    to = " " * (1 + len(BLANKS)) + "\n" * len(LINE_ENDS) + "x" * len(taken) + OPEN * 4 + CLOSE * 4
    return F.translate(text, "\r" + BLANKS + LINE_ENDS + taken + marks, to)


def _running(parts: Column, length) -> Column:
    """``struct(at, starts)``: where consecutive parts start, and where the last ends."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(parts, start, lambda a, x: F.struct((a.at + length(x)).alias("at"), F.concat(a.starts, F.array(a.at)).alias("starts")))


def _pieces(parts: str, step: int = 500) -> Column:
    """Explodes an array of the consecutive parts of a text into ``struct(start, part)``.

    The lengths of many parts are added up in groups and then over the groups, as appending one
    by one takes time as the square of their number.
    """
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(step)), lambda i: _running(F.slice(parts, i, step), F.length))
    offsets = _running(F.transform(groups, lambda g: g["at"]), lambda n: n)["starts"]
    many = F.flatten(F.zip_with(groups, offsets, lambda g, o: F.transform(g["starts"], lambda x: x + o)))
    starts = F.when(F.size(parts) <= step, _running(F.col(parts), F.length)["starts"]).otherwise(many)
    return F.explode(F.arrays_zip(starts.alias("start"), F.col(parts).alias("part"))).alias("p")


# Every step below reads its argument once: Spark would repeat the whole chain of
# expressions for each further use. Where a pattern depends on the text, it is chosen as a value.


def _blocks(rows: DataFrame, copy: str) -> DataFrame:
    """Replaces the working copy by ``parts``, cut after blank lines and around heading lines."""
    c = F.col(copy)
    rows = rows.withColumn(copy, F.regexp_replace(c, r"(\n[ \n]*\n[ \n]*)", f"$1{CUT}"))
    head = rf"(?m)(?:^|(?<={CUT}))( *(?:=[^\n]*[^= \n][^\n]*=|#{{1,6}} [^\n]*) *(?:\n|\z))"
    marked = F.contains(c, F.lit("=")) | F.contains(c, F.lit("#"))
    rows = rows.withColumn(copy, F.when(marked, F.regexp_replace(c, head, f"{CUT}$1{CUT}")).otherwise(c))
    return rows.withColumn("parts", F.split(c, CUT)).drop(copy)


WORD = r"(?<![\p{L}\p{N}\p{M}])"
SHORT = r"(?<!\p{L}{7}\.)"  # a word this long is no abbreviation; spares most stops the rest


def _abbreviations(b: Column, mixed: Column, linked: Column) -> Column:
    """Masks the full stops of abbreviations; each pattern looks back from a stop, so that only stops cost time."""
    b = F.regexp_replace(b, rf"(?iu)\.{SHORT}(?:(?<={WORD}(?:{'|'.join(CLOSING_PARTS)}|{_words(CLOSING)})\.)(?![ \n]*kg\b)|(?<=[0-9] ?г\.))", MAYBE)
    listed = _words(" ".join(ABBREVIATIONS.values()))
    inside = (
        r"(?<=[0-9@]\.)(?=[0-9@])",
        rf"(?<={WORD}(?:{listed}|co|[ivx]{{2,6}})\.)",
        r"(?<=[0-9] [ad]\.)(?=[ \n]?c\.)",
        rf"(?<={WORD}[ap]\.)(?=[ \n]?m[.{MAYBE}])",
        # initials and other single letters, but not a unit after a number
        rf"(?<={WORD}(?<![0-9][ \n])\p{{L}}\p{{M}}{{0,3}}\.)",
        rf"(?<=(?<![\p{{L}}\p{{N}}])[0-9]{{1,2}}\.)(?=[ \n]*(?:{_words(AFTER_ORDINAL)})\b)",
        # spaced dots stand for something left out
        r"(?<=[ \n]\.)(?=\.)|(?<=[ \n]\.\.)|(?<=[ \n]\.\.\.)",
    )
    b = F.regexp_replace(b, rf"(?iu)\.{SHORT}(?:{'|'.join(inside)})", MASK)
    # from the start of a link on, each match goes on where the last one ended
    b = F.when(linked, F.regexp_replace(b, rf"((?:(?:://|www[.{MASK}])|(?!\A)\G)[^ \n.]*+)\.(?=[^ \n])", f"$1{MASK}")).otherwise(b)
    starts = rf"[ \n]*(?:\z|[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}¿¡—{OPEN}{CLOSE}]|\p{{Ll}}\p{{Lu}})"
    goes_on = rf"(?iu)[ \n]*(?:{_words(CONTINUATIONS)})(?![\p{{L}}\p{{M}}.{MASK}])"
    one_case = rf"(?=[ \n]*(?:\z|[\p{{L}}\p{{N}}¿¡—{OPEN}{CLOSE}]))(?!{goes_on})"
    return F.regexp_replace(b, F.when(mixed, f"{MAYBE}(?={starts})").otherwise(f"(?<![гГ]){MAYBE}{one_case}"), F.lit("."))


GOES_ON = r"(?=[ \n]*[—–][ \n]*\p{L})"
SMALL = r"(?=[)\]]?[ \n]*\p{Ll}(?!\p{Lu}))"  # unless a capital follows the small letter


def _plain(b: Column, mixed: Column) -> Column:
    """Masks ends before what goes on with the sentence: a dash, a small letter."""
    return F.regexp_replace(b, F.when(mixed, f"{END}(?:{SMALL}|{GOES_ON})").otherwise(f"{END}{GOES_ON}"), F.lit(MASK))


def _quoted(b: Column, mixed: Column) -> Column:
    """The same, and masks ends inside quotations and before a reporting clause.

    What lies before a closing mark, back to the next mark of either kind or to the start of the block, is
    quoted, however long it is: each match goes on where the last one ended. So marks may be nested,
    and a quotation may have begun in an earlier block.
    """
    marks = rf"[^{OPEN}{CLOSE}]"
    inner = rf"((?:(?:\A|[{OPEN}{CLOSE}])(?={marks}*+{CLOSE})|(?!\A)\G)[^{ENDS}{OPEN}{CLOSE}]*+)[{ENDS}](?![ \n]*{CLOSE})"
    b = F.regexp_replace(b, rf"[{ENDS}]((?:[ \n]*{CLOSE})+)(?={marks}*+{CLOSE})", f"{MASK}$1")  # of a quotation in a quotation
    b = F.regexp_replace(b, inner, f"$1{MASK}")
    b = _plain(b, mixed)
    report = rf"((?:\A|[{ENDS}][ \n]?[{CLOSE})\]]?)[ \n]*{OPEN}{marks}*)[!?！？؟。]([ \n]*{CLOSE})(?![ \n]*(?:{OPEN}|\z))"
    return F.regexp_replace(b, report, f"$1{MASK}$2")


def _cut(rows: DataFrame, block: str) -> DataFrame:
    """Replaces the column ``block`` by ``parts``, the sentences of a block of a working copy.

    In a block in one letter case, capital and small letters mean nothing. What is needed for
    quotations or Thai only is kept from other blocks.
    """
    thai, free = r"[ก-ฺเ-ๅ็-๎]", r"[^\p{IsLatin}\p{Nd}ๆ \n]"
    b = F.col(block)
    mixed = b.rlike(r"\p{Lu}") == b.rlike(r"\p{Ll}")
    linked = F.contains(b, F.lit("://")) | F.contains(b, F.lit("www."))
    marked = F.regexp_replace(b, '"([^"]*)"', f"{OPEN}$1{CLOSE}")
    rows = rows.withColumns({"__mixed": mixed, "__linked": linked, "__thai": b.rlike(thai), block: marked})
    rows = rows.withColumns({block: _abbreviations(b, F.col("__mixed"), F.col("__linked")), "__quoted": F.contains(b, F.lit(CLOSE))})
    rows = rows.withColumn(block, F.when(F.col("__quoted"), _quoted(b, F.col("__mixed"))).otherwise(_plain(b, F.col("__mixed"))))
    end = rf"({END}(?<!{END}{{2}}){END}*+(?:[ \n]*{CLOSE}|[)\]’'])*+[ \n]*+)(?=[^,;:.)\]，；：、{MASK}])"
    blank = rf"((?:{thai}(?=[ \n]++{free})|{free}(?=[ \n]++{thai}))[ \n]++)"
    rows = rows.withColumn(block, F.regexp_replace(b, end, f"$1{CUT}"))
    rows = rows.withColumn(block, F.when(F.col("__thai"), F.regexp_replace(b, blank, f"$1{CUT}")).otherwise(b))
    return rows.withColumn("parts", F.split(b, CUT)).drop(block, "__mixed", "__linked", "__thai", "__quoted")


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start, end)`` of every sentence or heading of every text.

    Offsets are code points from 0, the end is exclusive, and neither end is white space.
    Null, empty and blank texts have no sentences; a text without any end mark is one.
    Rows with the same key are treated as separate texts.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    rows = _blocks(rows.select("key", working_copy(F.col("text")).alias("copy")), "copy").select("key", _pieces("parts"))
    rows = rows.select("key", F.col("p.start").alias("at"), F.col("p.part").alias("block")).filter(F.col("block").rlike(r"[^ \n]"))
    rows = _cut(rows, "block").select("key", "at", _pieces("parts"))
    rows = rows.select("key", (F.col("at") + F.col("p.start")).alias("at"), F.col("p.part").alias("part"))
    blank = F.lit(" \n")
    left = F.length("part") - F.length(F.ltrim("part", blank))
    rows = rows.select("key", (F.col("at") + left).alias("start"), (F.col("at") + F.length(F.rtrim("part", blank))).alias("end"))
    return rows.filter("end > start").select(F.col("key").alias(key), "start", "end")
