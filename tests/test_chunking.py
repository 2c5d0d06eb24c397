import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.config import Config
from graphloom.operators import chunking

SMALL = Config(max_tokens=10, min_tokens=2)


def chunks(spark, text, cfg=Config(), strategy="sections", title="T"):
    rows = chunking.chunk(spark.createDataFrame([(1, title, text)], "doc_id long, title string, text string"), cfg, strategy)
    return [(r.article_title, r.section_path, r.chunk_text, r.chunk_index, r.token_approx) for r in rows.orderBy("chunk_index").collect()]


def words(n, w="w"):
    return " ".join([w] * n)


def packed(lines, limit, least):
    """The packing written as plain loops over (kind, value): headings and lines of sentences."""
    out, path, buffer, total = [], [], [], 0

    def flush():
        nonlocal buffer, total
        if buffer and len(" ".join(buffer).split()) >= least:
            out.append((" / ".join(n for _, n in path) or "Introduction", " ".join(buffer)))
        buffer, total = [], 0

    for kind, value in lines:
        if kind:
            flush()
            path = [] if kind == 1 else [p for p in path if p[0] < kind] + [(kind, value)]
            continue
        n = sum(len(s.split()) for s in value)
        if total + n > limit:
            flush()
        if n > limit:
            for s in value:
                if total + len(s.split()) > limit:
                    flush()
                buffer.append(s)
                total += len(s.split())
            flush()
        else:
            buffer.append(" ".join(value))
            total += n
    flush()
    return out


@pytest.mark.parametrize(("n", "kept"), [(49, False), (50, True), (550, True)])
def test_sizes(spark, n, kept):
    assert bool(chunks(spark, words(n))) == kept


def test_a_line_over_the_limit_is_cut_into_sentences(spark):
    text = ". ".join(words(200) for _ in range(3)) + "."
    assert [c[4] for c in chunks(spark, text)] == [400, 200]
    assert [c[4] for c in chunks(spark, words(600))] == [600]


def test_size_is_taken_after_cleaning(spark):
    assert chunks(spark, words(48) + " a @-@ b") == []
    assert [c[4] for c in chunks(spark, words(49) + " a @-@ b")] == [50]


def test_sections_and_titles(spark):
    text = f"= Main =\r\n{words(50, 'a')}\r\n= = One = =\n= = = Deep = = =\n{words(50, 'b')}\n= = Two = =\n{words(50, 'c')}\n= = = = = =\n= Next =\n{words(50, 'd')}"
    got = chunks(spark, text)
    assert [c[:2] for c in got] == [("T", "Introduction"), ("T", "One / Deep"), ("T", "Two"), ("T", "Introduction")]
    assert [c[3] for c in got] == [0, 1, 2, 3]
    assert [c[0] for c in chunks(spark, words(50) + "\n" + text, strategy="file")] == ["", "Main", "Main", "Main", "Next"]


def test_other_strategies(spark):
    assert [c[2:] for c in chunks(spark, " a b \n\n\n\n c @-@ d ", strategy="paragraph")] == [("a b", 0, 2), ("c @-@ d", 1, 3)]
    assert [c[1] for c in chunks(spark, words(60), strategy="whole")] == ["full_article"]
    assert [c[1:3] for c in chunks(spark, "= A =\nx y", SMALL, "packed")] == [("Introduction", "= A = x y")]


@pytest.mark.parametrize("strategy", ["sections", "file", "packed", "paragraph", "whole"])
def test_nothing_to_cut(spark, strategy):
    for text in (None, "", " \n\n "):
        assert chunks(spark, text, strategy=strategy, title=None) == []
    empty = spark.createDataFrame([], "doc_id long, title string, text string")
    assert chunking.chunk(empty, strategy=strategy).count() == 0


LINE = st.one_of(
    st.tuples(st.integers(1, 4), st.sampled_from("ABCD")),
    st.tuples(st.just(0), st.lists(st.integers(1, 13).map(lambda n: words(n - 1, "x") + (" " if n > 1 else "") + "y."), min_size=1, max_size=4)),
)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(LINE, max_size=12), min_size=1, max_size=30))
def test_packing_like_loops(spark, docs):
    texts = [(i, "T", "\n".join(" ".join(["="] * k + [v] + ["="] * k) if k else " ".join(v) for k, v in doc)) for i, doc in enumerate(docs)]
    rows = chunking.chunk(spark.createDataFrame(texts, "doc_id long, title string, text string"), SMALL).collect()
    for i, doc in enumerate(docs):
        got = [(r.section_path, r.chunk_text) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_index)]
        assert got == packed(doc, SMALL.max_tokens, SMALL.min_tokens)


def test_partitions_do_not_matter(spark):
    random.seed(1)
    docs = [(i, "T", "\n".join(words(random.randint(1, 12)) for _ in range(20))) for i in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, title string, text string")
    results = [sorted(map(tuple, chunking.chunk(rows.repartition(n), SMALL).collect())) for n in (1, 7, 40)]
    assert results[0] == results[1] == results[2]


def test_sampler(spark):
    text = "x\n = One = \n" + words(1500) + "\n = = Sub = = \nmore\n = Two = \nshort\n = Three = \n" + words(1200)
    got = chunking.sample(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r.pos, r.article[:8]) for r in got] == [(1, "= One = "), (3, "= Three ")]


def test_a_text_as_long_as_a_book(spark):
    text = "\n".join(f"= = Part {i} = =\n" + "\n".join(f"line {i} {j} " + "word " * 17 for j in range(90)) for i in range(250))
    rows = chunks(spark, text)
    assert len(rows) == 1000 and [r[1] for r in rows[::4]] == [f"Part {i}" for i in range(250)]
    assert " ".join(r[2] for r in rows).split() == " ".join(x for x in text.split("\n") if not x.startswith("=")).split()


def article(*sections):
    """Text with the line sizes of an article's sections; ``(n, marks)`` is a line that loses two tokens for each mark."""
    lines = ["= T ="]
    for i, sizes in enumerate(sections):
        lines += [f" = = Section {i} = = "] * (i > 0)
        for size in sizes:
            n, marks = size if isinstance(size, tuple) else (size, 0)
            lines.append(" ".join(["a @-@ b"] * marks + ["w"] * (n - 3 * marks)))
    return "\r\n".join(lines)


@pytest.mark.parametrize(
    ("sections", "sizes"),
    [
        ([[315], [211, 296, 84], [188, 221, 203], [515], [304], [353], [413], [62], [528]], [315, 507, 84, 409, 203, 515, 304, 353, 413, 62, 528]),
        ([[n] for n in (244, 164, 203, 158, 287, 241, 138)] + [[], []] + [[n] for n in (215, 212, 337, 100, 21, 308, 89, 166)], [244, 164, 203, 158, 287, 241, 138, 215, 212, 337, 100, 308, 89, 166]),
        ([[(126, 4)], [(350, 13)], [184]], [118, 324, 184]),
        ([[235], [262], [316], [111], [202], [131]], [235, 262, 316, 111, 202, 131]),
    ],
)
def test_sizes_of_whole_articles(spark, sections, sizes):
    rows = chunks(spark, article(*sections), strategy="file")
    assert [r[4] for r in rows] == sizes and [r[3] for r in rows] == list(range(len(sizes))) and {r[0] for r in rows} == {"T"}


def test_articles_over_rows(spark):
    texts = ["intro", " = A = \none", None, "two", " = = not a title = = \nthree\n = B = \n" + "b" * 30, "", " \n", " = C = \nshort", " = D = \n" + "d" * 40 + "\n \n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [r["article"] for r in chunking.sample_corpus(rows, Config(sample_min_chars=20, sample_articles=2)).orderBy("number").collect()]
    assert got == ["= A = \none\n\ntwo\n = = not a title = = \nthree", "= B = \n" + "b" * 30]
    assert chunking.sample_corpus(rows, Config(sample_min_chars=20)).count() == 3
    assert chunking.sample_corpus(rows.limit(0)).count() == 0
