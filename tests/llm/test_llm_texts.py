import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import leakage as lk
from graphloom.llm import sentences as se

# "|" marks the cuts.
TEXTS = [
    "Dr. Henry A. Pel came at 5 p.m. on 11 March.| He paid 3.50, i.e. little.| See No. 5, pp. 4–6, cf. fig. 3.",
    '"We sold it," Ann said, "because we had none."|"Who?" asked Bo.|"Is it for sale?" Ann Lee asked in 1503.| He called it "a ornate otter."| Then he left.',
    "By 1610 it was known as Ras & Co.| It grew ... and then fell.| eLog 4 of the club mentions it.",
    "one nearby.Its furnace is lost.| No end here",
    "Um 10 Uhr brannte sie in der Bel GmbH & Co. KG!| Am 19. Mai 1662 kam König Ras II. nach Ort, z. B. Ulm u. a. m.| Die Karte (Nr. 3) stammt aus dem 7. Jahrhundert.|„Wem gehört sie?“, fragte Ann.| Er schrieb: „Sie bleibt.“| Ende.",
    "Le Dr Pel cite la tour, cf. p. 18, vers 730 av. J.-C. près de Ras.|« Où est-elle ? » demanda Ann.| Il écrivit : « Elle est là. »| On y voit une tour, etc.| Et une tour…| Fin.",
    "El siglo 5 a. C. dejó una torre.|—¿Y la torre? —preguntó el Sr. Pel.|«La feria es antigua.»|¡Qué bella!| Pasó a Pel y Cía.| En 1541, p. ej., ardió.",
    "Проф. Белжин, т. е. он, жил здесь в 1660 г. в городе.|«Где она?» — спросил Рен.| А. Г. Рен писал: «Там».| Высота — 24 м.| Цена 5 тыс. руб.| Конец и т. д.",
    "柏岚说：“已毁，至今。”|“有多高？”柏汀问道。|“保住了！它属于县。”沧柏写道。|No.5号长3.8公里……|多么好啊！",
    "「行こう。岬へ。」とキアが書いた。|なぜ消えたのか？|高さは3.5メートルである。",
    "डॉ. नीरा ने 61.6 किमी नापी।|“कहाँ है?” तोमी ने पूछा।| उसने लिखा, “सुरक्षित है।”| कितना सुंदर!",
    "قاس د. ساسا 5.3 كم سنة 1747 م.| هل بقيت؟| قال نوتو: «لنا.»|«أين؟» سأل نومي.",
    "ภาพถ่าย No. 45 แสดงโรงสี| ชาวบ้านต่าง ๆ รักเมืองนี้| มี 70 แห่งและเก่า",
    "the press traded as ras & co. beside dr. pel at 5 p.m. on monday.| it was lost.| see no. 5.",
    " = Head of it = \n|Text one.|\n\n= = Sub = =|\nText two\nwraps.",
    "A line\r\nwraps here.|\r\n\r\nNext one",
]


@pytest.mark.parametrize("marked", TEXTS)
def test_sentences(spark, marked):
    text = marked.replace("|", "")
    want = [p.strip() for p in marked.split("|")]
    if "one nearby.Its" in marked:
        want = ["one nearby.", "Its furnace is lost.", "No end here"]
    rows = se.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [text[r["start"] : r["end"]] for r in rows] == want


@pytest.mark.parametrize(
    "parts",
    [
        ["Fr. Novak und Abg. Meier kamen.", "Die Univ. Bonn liegt dort."],
        ["He lives at 12 Mill Rd. 5 miles away.", "So it is."],
        ["Er sagte: „Sie rief: »" + "Komm her. Nun. " * 100 + "Geh.« Dann ging sie.“", "Ende."],
        ["So it went. Yes. " * 60 + "It did,» said Ann.", "Then he left."],  # begun in an earlier block
        ["See https://x.org/" + "a.b" * 400 + " for it.", "Go."],
        ["ชาวบ้านรักเมืองนี้" + " " * 60, "โรงสีเก่า"],
        ["Who knew?" + " " * 30, "«Who?»" + " " * 20 + "asked Bo.", "End."],
    ],
)
def test_no_rule_ends_at_a_length(spark, parts):
    rows = se.sentences(spark.createDataFrame([(1, text := " ".join(parts))], "doc_id long, text string")).orderBy("start").collect()
    assert [text[r["start"] : r["end"]] for r in rows] == [p.strip() for p in parts]


def test_long_quotations(spark):
    long = "We saw it. Was it so? " * 200
    parts = [f'He said: "{long}It was."', f'"{long}Is it?" asked Bo.', "Then he left.", "So did we."]
    stray = "So it goes. " * 200
    texts = [(1, " ".join(parts)), (2, f"A «stray mark. {stray}End.")]
    rows = se.sentences(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("start").collect()
    assert [texts[0][1][r["start"] : r["end"]] for r in rows if r["doc_id"] == 1] == parts
    assert sum(r["doc_id"] == 2 for r in rows) == 202


def test_offsets_cover_the_text(spark):
    random.seed(7)
    texts = [(i, "".join(random.choices("aB é字ไ.!?。「」“”«»„\"—\n\r 　 😀1=", k=300))) for i in range(200)]
    by = {}
    for r in se.sentences(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        by.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for i, text in texts:
        at = 0
        for a, b in sorted(by[i]):
            assert a >= at and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
            at = b
        assert not text[at:].strip()


def test_texts_without_sentences(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n　 ", "x"), (None, "One. Two.", "x")], "doc_id long, text string, start string")
    assert [r["doc_id"] for r in se.sentences(rows).collect()] == [None, None]
    assert se.sentences(rows.limit(0)).count() == 0


def test_very_long_texts(spark):
    texts = [(1, "He said so. " * 50_000), (2, "x" * 500_000), (3, '"a" ' * 50_000), (4, "." * 100_000)]
    got = se.sentences(spark.createDataFrame(texts, "doc_id long, text string")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got}[1] == 50_000 and len(got) == 4


def leaks_by_brute_force(docs, items, line, share=0.5, errors=0.1):
    skip = {i: len(lk.units(line)) if t.startswith(line) else 0 for i, t in items}
    found = set()
    for d, text in docs:
        words = lk.units(text)
        for i, item in items:
            want = lk.units(item)[skip[i] :]
            for n in range(max(1, math.ceil(share * len(want))), len(want) + 1):
                if any(sum(a != b for a, b in zip(want[s : s + n], words[p : p + n])) <= int(errors * n + 1e-9) for s in range(len(want) - n + 1) for p in range(len(words) - n + 1)):
                    found.add((d, i))
                    break
    return found


def test_leaks_like_brute_force(spark):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(60)]
    line = "Read this and answer all of it. "
    items = [(i, (line if i % 3 else "") + " ".join(random.choices(vocabulary, k=random.randint(12, 40)))) for i in range(12)] + [(90, "汉字测试文章内容一二三四五六"), (91, "tiny one"), (92, ""), (93, None)]
    docs = [(0, None), (1, ""), (2, line * 3)]
    for d in range(3, 120):
        _, item = random.choice(items[:12])
        words = lk.units(item)[7 if item.startswith(line) else 0 :]
        n = random.randint(len(words) // 3, len(words))
        s = random.randint(0, len(words) - n)
        part = [w if random.random() > 0.08 else "zz" for w in words[s : s + n]]
        docs.append((d, " ".join([*random.choices(vocabulary, k=15), *part, *random.choices(vocabulary, k=15)]).upper()))
    docs += [(200, "前言汉字，测试文章！内容后记"), (201, "A tiny ONE here"), (202, "汉字")]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, t) for i, t in items if t]
    want = leaks_by_brute_force(docs, texts, line)
    assert {tuple(r) for r in lk.leaks(D, I).collect()} == want and len(want) > 50
    assert {tuple(r) for r in lk.leaks(D, I, block=3).collect()} == want
    # so many errors leave no shingle of five units whole: they are made shorter
    want = leaks_by_brute_force(docs[:40], texts[:6], line, errors=0.25)
    assert {tuple(r) for r in lk.leaks(D.filter("doc_id < 40"), I.filter("item_id < 6"), errors=0.25).collect()} == want and want
    with pytest.raises(ValueError, match="errors"):
        lk.leaks(D, I, errors=1)
    assert lk.leaks(D.limit(0), I).count() == 0 == lk.leaks(D, I.limit(0)).count()


def test_instructions_are_told_over_all_blocks(spark):
    items = [(i, "Answer the following question with care. " + " ".join(f"w{i}x{j}" for j in range(12))) for i in range(3)]
    docs = [(i, "x y " + " ".join(f"w{i}x{j}" for j in range(6)) + " z") for i in range(3)]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in lk.leaks(docs, items, block=1).collect()) == [(i, i) for i in range(3)]


def test_units():
    assert lk.units("L'Été @-@ 4 @,@ 312 Straße!") == ["l", "ete", "4", "312", "strasse"]
    assert lk.units("柏岚 No.5") == ["柏", "岚", "no", "5"] and lk.units(None) == []
    assert lk.kept_shingles(20, 5, 0.5, 0.1) == 1 and lk.kept_shingles(20, 5, 0.5, 0.2) == 0
    assert lk.shingle_length(20, 0.5, 0.1) == 5 and lk.shingle_length(20, 0.5, 0.25) == 3 and lk.shingle_length(3, 0.5, 0.1) == 2


def test_classes_and_copies_of_every_character(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    chars = spark.createDataFrame([(chr(c),) for c in codes], "c string")
    assert {r["c"] for r in chars.filter(F.col("c").rlike(se.END)).collect()} == set(se.ENDS)
    around = chars.select(F.concat(F.lit("(»a"), "c", F.lit("b« ")).alias("t")).unionByName(chars.select(F.concat(F.lit("a"), "c", F.lit("b")).alias("t")))
    copies = around.select(se.working_copy(F.col("t")).alias("x"), se._replaced(F.col("t"), se.MASK + se.MAYBE + se.CUT, "«“「『»”」』").alias("y"))
    assert copies.filter("x is null or x <> y").count() == 0
