"""Texts cut into chunks of bounded size along their headings, lines and sentences.

The packing depends on a running total that is reset by its own value, which no window
expresses. It is a fold over the lines of one text: nothing is shuffled, and every text is chunked where it
is read. The fold carries numbers only, where each chunk starts; the lines are cut into chunks afterwards, so that
a text as long as a book costs no more a line than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions.text import SPACES, clean, heading, lines, sentences, strip, token_count
from graphloom.tables import materialise, small

INTRODUCTION, PARAGRAPH, WHOLE = "Introduction", "paragraph", "full_article"
_STACK = "array<struct<level:int,name:string>>"
_PLACES = "array<struct<at:int,title:string,stack:array<struct<level:int,name:string>>>>"
_INTS = "array<int>"


def _items(text: Column, limit: int, headings: bool) -> Column:
    """Non-blank lines as ``struct(level, line, n, over, first)``; a line over the limit becomes its sentences."""

    def item(level, line, n, over, first):
        return F.struct(level.cast("int").alias("level"), line.alias("line"), n.cast("int").alias("n"), over.alias("over"), first.alias("first"))

    no, yes, zero = F.lit(False), F.lit(True), F.lit(0)

    def of(x: Column) -> Column:
        line, n = x["line"], x["n"]  # counted once: a lambda would count at each use
        head = heading(line)
        pieces = F.transform(sentences(line), lambda s, i: item(zero, s, token_count(s), yes, i == 0))
        plain = F.when(n > limit, pieces).otherwise(F.array(item(zero, line, n, no, no)))
        return F.when(head.isNotNull(), F.array(item(head["level"], head["name"], zero, no, no))).otherwise(plain) if headings else plain

    kept = F.filter(F.transform(lines(text), strip), lambda line: line != "")
    return F.flatten(F.transform(F.transform(kept, lambda line: F.struct(line.alias("line"), token_count(line).alias("n"))), of))


def _starts(items: Column, limit: int) -> Column:
    """Where the chunks start among the items."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("total"), F.lit(False).alias("open"), F.lit(False).alias("over"), F.array().cast(_INTS).alias("starts"))

    def step(s: Column, x: Column) -> Column:
        head = x["level"] > 0
        fresh = ~s["open"] | x["first"] | (s["over"] & ~x["over"]) | (s["total"] + x["n"] > limit)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(head, 0).when(fresh, x["n"]).otherwise(s["total"] + x["n"]).alias("total"),
            (~head).alias("open"),
            (x["over"] & ~head).alias("over"),
            F.when(fresh & ~head, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(items, zero, step, lambda s: s["starts"])


def _places(items: Column, title: Column) -> Column:
    """After each heading: its place among the items, the title and the stack of names from there on."""
    heads = F.filter(F.transform(items, lambda x, i: F.struct(i.alias("at"), x["level"].alias("level"), x["line"].alias("name"))), lambda h: h["level"] > 0)
    first = F.array(F.struct(F.lit(-1).alias("at"), title.alias("title"), F.array().cast(_STACK).alias("stack"))).cast(_PLACES)

    def step(done: Column, h: Column) -> Column:
        last = F.element_at(done, -1)
        upper = F.filter(last["stack"], lambda e: e["level"] < h["level"])
        deeper = F.concat(upper, F.array(F.struct(h["level"].alias("level"), h["name"].alias("name"))))
        stack = F.when(h["level"] == 1, F.array().cast(_STACK)).otherwise(deeper)
        return F.array_append(done, F.struct(h["at"].alias("at"), F.when(h["level"] == 1, h["name"]).otherwise(last["title"]).alias("title"), stack.alias("stack")))

    return F.aggregate(heads, first, step)


def _packed(rows: DataFrame, cfg: Config, headings: bool, titled: bool) -> DataFrame:
    """Replaces ``text`` by ``found``, its chunks in order, before cleaning: ``array<struct(article_title, section_path, chunk_text)>``.

    A line joins the current chunk while the total stays within the limit. A heading ends the
    chunk under the old path; level 1 clears the path, and with ``titled`` it sets the title, which
    is empty before. The sentences of a line over the limit are packed by themselves; a
    sentence over the limit is a chunk of its own.
    """
    rows = rows.withColumn("items", _items(F.col("text"), cfg.max_tokens, headings)).drop("text")
    rows = rows.withColumns({"starts": _starts(F.col("items"), cfg.max_tokens), "places": _places(F.col("items"), F.lit("") if titled else F.col("title"))})

    def cut(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("items"))
        own = F.filter(F.slice("items", start + 1, end - start), lambda x: x["level"] == 0)
        text = F.array_join(F.transform(own, lambda x: x["line"]), " ")
        place = F.element_at(F.filter("places", lambda p: p["at"] < start), -1)
        path = F.array_join(F.transform(place["stack"], lambda h: h["name"]), " / ")
        title = place["title"] if titled else F.col("title")
        return F.struct(title.alias("article_title"), F.when(F.size(place["stack"]) == 0, INTRODUCTION).otherwise(path).alias("section_path"), text.alias("chunk_text"))

    return rows.withColumn("found", F.transform("starts", cut)).drop("items", "starts", "places")


def chunk(docs: DataFrame, cfg: Config = Config(), strategy: str = "sections", key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """``(doc_id, article_title, section_path, chunk_index, chunk_text, token_approx)``.

    ``strategy``: ``sections`` (headings, title from the record), ``file`` (headings, title from
    level 1), ``packed`` (lines only), ``paragraph`` (one chunk a paragraph, as it is, of any size) or
    ``whole``. Chunks under ``min_tokens`` after cleaning are dropped, except paragraphs, and the
    index counts those kept. The limit is on the tokens before cleaning, ``token_approx`` counts those
    after it. Null, empty and blank texts have no chunks; a null title stays null.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(title).alias("title"), F.col(text).alias("text"))
    named = lambda path, body: F.struct(F.col("title").alias("article_title"), F.lit(path).alias("section_path"), body.alias("chunk_text"))
    if strategy == "paragraph":
        body = F.regexp_replace(strip(F.coalesce("text", F.lit(""))), r"\r\n?", "\n")
        found = F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: p != "")
        rows = rows.withColumn("found", F.transform(found, lambda p: named(PARAGRAPH, p)))
    elif strategy == "whole":
        rows = rows.withColumn("found", F.array(named(WHOLE, clean(F.coalesce("text", F.lit(""))))))
    else:
        rows = _packed(rows, cfg, strategy in ("sections", "file"), strategy == "file")
        rows = rows.withColumn("found", F.transform("found", lambda c: F.struct(c["article_title"], c["section_path"], clean(c["chunk_text"]).alias("chunk_text"))))
    rows = rows.select("doc_id", "found")
    counted = F.transform("found", lambda c: F.struct(c["article_title"], c["section_path"], c["chunk_text"], token_count(c["chunk_text"]).alias("token_approx")))
    rows = rows.select("doc_id", counted.alias("found"))
    least = 1 if strategy == "paragraph" else cfg.min_tokens
    kept = F.filter("found", lambda c: c["token_approx"] >= least)
    rows = rows.select("doc_id", F.posexplode(kept).alias("chunk_index", "c"))
    return rows.select("doc_id", "c.article_title", "c.section_path", "chunk_index", "c.chunk_text", "c.token_approx")


def section_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_index, level, name)`` of the heading lines of each text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(lines(F.col(text))).alias("line_index", "line"))
    rows = rows.filter(F.contains("line", F.lit("="))).select("doc_id", "line_index", heading(F.col("line")).alias("h")).filter("h is not null")
    return rows.select("doc_id", "line_index", "h.level", "h.name")


def sample(docs: DataFrame, cfg: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, article)``: the first long articles, where a text is cut before each level-1 heading.

    The sampler of a corpus file: articles of more than ``sample_min_chars`` characters, the first
    ``sample_articles`` by id and position.
    """
    cut = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), r"\n(?= = (?!=))")
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.transform(cut, strip)).alias("pos", "article"))
    rows = rows.filter(F.length("article") > cfg.sample_min_chars)
    return rows.orderBy("doc_id", "pos").limit(cfg.sample_articles)


def sample_corpus(rows: DataFrame, cfg: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(number, article)``: the first long articles of a corpus whose rows, in the order of a unique ``key``, are joined by line ends.

    An article begins before each level-1 heading and goes on over rows that have none. Nulls are
    empty rows. Where articles begin and end is counted by running sums, first inside ranges of rows and then over the ranges;
    only the articles that are returned are put together.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    parts = rows.select(F.col(key).alias("key"), F.split(body, r"\n(?= = (?!=))").alias("parts")).select("key", F.posexplode("parts").alias("i", "part"))
    begins = ((F.col("i") > 0) | F.col("part").rlike(r"\A = (?!=)")).cast("long").alias("begins")
    # blanks at the ends, and the length with the line end that joins it to the next
    lead = F.length("part") - F.length(F.ltrim("part", F.lit(SPACES)))
    parts = parts.select("key", "i", "part", begins, (F.length("part") + 1).cast("long").alias("n"), lead.alias("lead"), F.length(F.rtrim("part", F.lit(SPACES))).alias("full"))
    parts = materialise(parts.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "sample-parts")
    sums = parts.groupBy("range").agg(F.sum("begins").alias("b"), F.sum("n").alias("c"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("b", "c")))
    inside = Window.partitionBy("range").orderBy("key", "i")
    placed = parts.join(small(sums), "range").withColumn("number", F.col("b0") + F.sum("begins").over(inside))
    placed = placed.withColumn("at", F.col("c0") + F.sum("n").over(inside) - F.col("n"))
    ends = placed.filter("full > 0").groupBy("number").agg((F.max(F.col("at") + F.col("full")) - F.min(F.col("at") + F.col("lead"))).alias("size"))
    chosen = materialise(ends.filter(F.col("size") > cfg.sample_min_chars).orderBy("number").limit(cfg.sample_articles).select("number"), "sampled")
    found = placed.join(F.broadcast(chosen), "number").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("key", "i", "part"))).alias("p"))  # a handful of numbers
    return found.select("number", strip(F.array_join("p.part", "\n")).alias("article"))
