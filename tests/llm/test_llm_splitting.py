import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import splitting as sp

LIMITS = (40, 200, 6, 30)


def check(text, limits=LIMITS):
    tokens, chars, *_ = limits
    pieces, out = sp.split_text(text, *limits), ""
    for i, (a, b, overlap) in enumerate(pieces):
        if i:
            assert 0 < overlap and len(" ".join(text[a : a + overlap].split())) <= limits[3] + 1 and a + overlap == pieces[i - 1][1] and a >= pieces[i - 1][0]
        else:
            assert (a, overlap) == (0, 0)
        seen = " ".join(text[a:b].split())
        assert len(pieces) == 1 or (len(seen) <= chars and len(seen.split(" ")) <= tokens)
        out += text[a + overlap : b]
    assert out == text
    return [text[a + o : b] for a, b, o in pieces]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é字の.。!? \n\r\t=-,;ไท ​"), max_size=900))
def test_no_text_is_lost_and_limits_hold(text):
    check(text)


def test_structure_first():
    text = "= A =\n" + "One two three. " * 9 + "\n= B =\n" + "Four five six. " * 9
    assert [p.split("\n")[0] for p in check(text, (40, 200, 3, 20))] == ["= A =", "= B ="]
    text = "\n\n".join("word " * 20 for _ in range(4))
    assert all(p.endswith("\n\n") for p in check(text)[:-1])
    assert all(p.rstrip().endswith(".") for p in check("Dr. Who came here. It was so late. " * 12))
    assert all("Dr." not in p[-5:] for p in check("We saw Dr. Who at No. 5 today. " * 12)[:-1])


def test_siblings_are_packed_under_their_parent():
    words = lambda w, n: (w + " ") * n + "\n"
    text = f"= A =\n{words('a', 14)}= = B = =\n{words('b', 9)}= C =\n{words('c', 14)}= = D = =\n{words('d', 9)}"
    assert [p.split()[1] for p in check(text, (40, 200, 3, 20))] == ["A", "C"]  # B stays with A
    # A is over the limit: its sections are packed, and what is left of it does not go with C
    text = f"# A\n{words('a', 20)}## B\n{words('b', 17)}### E\n{words('e', 8)}## F\n{words('f', 4)}# C\n{words('c', 10)}"
    assert [p.split()[1] for p in check(text, (40, 200, 3, 20))] == ["A", "B", "C"]
    items = "".join(f"- item {i} {'x ' * 6}\n  - sub {'y ' * 5}\n  - sub {'z ' * 5}\n" for i in range(6))
    assert all(p.startswith("- item") for p in check(items, (40, 200, 3, 20)))
    deep = "".join(" " * i + f"- item {i}\n" for i in range(1500))
    check(deep)


@pytest.mark.parametrize("text", ["x" * 5000, "字" * 5000, "é" * 3000, " " * 500, "a" + " " * 5000 + "b", "", "ไทย" * 2000])
def test_no_boundaries(text):
    check(text)


def test_very_long_text():
    assert len(check("A sentence of some words. " * 40_000, (550, 4000, 50, 300))) > 250


def test_pieces(spark):
    long = "Some words here. " * 300
    rows = [(1, long, "c"), (1, long, "c"), (2, "short", "d"), (3, None, None), (4, "", "e"), (None, long + ".", "f"), (5, "a @-@ b " * 300, "g"), (6, "字" * 4001, "h")]
    df = spark.createDataFrame(rows, "text_id long, piece string, start string")
    out = sp.pieces(df, ["text_id"], "piece").collect()
    assert {r["text_id"] for r in out} == {1, None, 6}
    one = sorted((r for r in out if r["text_id"] == 1), key=lambda r: r["piece"])
    assert "".join(r["piece_text"][r["overlap"] :] for r in one) == long and one[0]["start"] == 0
    assert all(long[r["start"] : r["end"]] == r["piece_text"] for r in one)
    assert sp.pieces(df.limit(0), ["text_id"], "piece").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        sp.pieces(df, ["text_id"], "piece", overlap_tokens=300)
