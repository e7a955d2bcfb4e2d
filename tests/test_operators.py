import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import fuzzy
from quillgrid.functions import geometry as G
from quillgrid.functions import text as T
from quillgrid.operators import blocks as B
from quillgrid.operators import layout as Y
from quillgrid.operators import lines as L
from quillgrid.operators import markdown as M
from quillgrid.operators import merge as J
from quillgrid.operators import quality as Q
from quillgrid.operators import render
from quillgrid.sources import pages as P


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lines(spark, texts):
    return P.document_lines(spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string"))


def test_dehyphenate_to_the_end_of_a_chain(spark):
    rng = random.Random(1)
    docs = [["".join(rng.choice("ab- ") for _ in range(rng.randint(0, 4))) for _ in range(12)] for _ in range(60)]
    docs += [["ab--", "", "c"], ["a--", " ", "b"], ["-", "-", "-"], ["a- -", "", "- -", "b"], ["x-"], ["--", "b-", "c"]]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {}
    for r in L.dehyphenate(P.document_lines(df)).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, texts in enumerate(docs):
        want: list[str] = []
        for t in texts:
            if want and want[-1].rstrip().endswith("-"):
                want[-1] = want[-1].rstrip()[:-1] + t.lstrip()
            else:
                want.append(t)
        assert got[i] == want, texts


def test_flowing_markdown_with_tail(spark):
    texts = ["A headline of some length", "first para-", "graph goes on", "OULU 1901,", "third of May", "A. B. EDITOR."]
    got = L.flowing_markdown(lines(spark, texts)).first()["markdown"]
    assert got == "# A headline of some length\n\nfirst paragraph goes on\n\nOULU 1901, third of May\n\n**A. B. EDITOR.**\n"


def test_signature_and_dateline(spark):
    assert one(spark, T.is_signature(F.lit("A. B. EDITOR."))) and not one(spark, T.is_signature(F.lit("An editor.")))
    assert one(spark, T.is_dateline(F.lit("Oulu, 1901"))) and not one(spark, T.is_dateline(F.lit("in 1901 or so")))


def test_geometry(spark):
    a, b = G.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), G.box(F.lit(5), F.lit(0), F.lit(15), F.lit(10))
    assert one(spark, G.iou(a, b)) == pytest.approx(1 / 3)
    pdf = one(spark, G.to_pdf(G.box(F.lit(10), F.lit(20), F.lit(90), F.lit(180)), G.pdf_scale(F.lit(100), F.lit(200))))
    assert (pdf["x1"], pdf["y1"]) == pytest.approx((59.5, 119.0))
    poly = F.array(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(7.0)))
    assert tuple(one(spark, G.poly_box(poly))) == (1.0, 4.0, 3.0, 9.0)
    assert one(spark, G.fit_text(F.lit("x" * 10), F.lit(50.0), F.lit(20.0), F.lit(14.0), 6.0, 0.5, 1.2)) == 10.0


def test_page_json_shapes(spark):
    texts = ['{"res": {"parsing_res_list": [{"label": "text", "content": "a", "bbox": [1, 2, 3, 4]}, null, {"block_label": "header", "block_content": "h"}]}}', '{"rec_texts": ["x", "y"], "rec_scores": [0.5, 1.0]}', "nonsense"]
    pages = P.parse_page_json(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, json string"))
    assert [r["corrupt"] for r in pages.orderBy("path").collect()] == [False, False, True]
    assert [(r["label"], r["x2"]) for r in P.page_blocks(pages).orderBy("pos").collect()] == [("text", 3.0), ("header", None)]
    assert [(r["text"], r["score"]) for r in P.page_lines(pages).orderBy("idx").collect()] == [("x", 0.5), ("y", 1.0)]
    assert [r["text"] for r in P.page_text(pages).orderBy("path").collect()] == ["a", "x\ny", None]


def test_no_provider_raises(spark):
    with pytest.raises(RuntimeError):
        P.inferred(spark.range(1), None, "a int")


def test_fuzzy_ratios():
    assert fuzzy.common("abcde", "xbxd") == 2
    assert fuzzy.token_set_ratio("a b c", "c b a a") == 100 and fuzzy.partial_ratio("bcd", "abcde") == 100
    assert fuzzy.ratio("abc", "abd") == pytest.approx(200 * 2 / 6)


def test_fuzzy_duplicates_keep_the_better(spark):
    rows = [(1, 1, "the quick brown fox jumps", "body", 0.8, 0.0, 0.0, 100.0, 20.0), (1, 2, "the quick brown fox jumped", "body", 0.9, 0.0, 2.0, 100.0, 22.0), (1, 3, "something else at all", "body", 0.8, 0.0, 300.0, 100.0, 320.0)]
    df = spark.createDataFrame(rows, "page long, pos int, text string, region string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert [(r["pos"], r["kept_pos"]) for r in J.fuzzy_duplicates(df).collect()] == [(1, 2)]


def test_mojibake_and_cleanup(spark):
    assert one(spark, T.repair_mojibake(F.lit("pÃ¤ivÃ¤"))) == "päivä"
    assert one(spark, T.repair_mojibake(F.lit("a – b"))) == "a – b"
    assert one(spark, T.cleaned(F.lit("pa\u0308iva\u0308-\nnä Å"))) == "päivänä Å"
    assert one(spark, T.cleaned(F.lit(None).cast("string"))) is None and one(spark, T.cleaned(F.lit(" a\u0308"))) == "ä"
    assert one(spark, T.cleaned(F.lit("sano-\nma ­on (sis. 3,50 mk"))) == "sanoma on (sis. 3,50 mk)"


def test_column_split_needs_three_narrow_blocks(spark):
    rows = [(1, i, "text", "t", float(x), 0.0, float(x + 100), 10.0) for i, x in enumerate((0, 20, 600))]
    schema = "page long, pos int, label string, text string, x1 double, y1 double, x2 double, y2 double"
    assert B.column_split(spark.createDataFrame(rows, schema)).first()["split"] == 360.0
    assert B.column_split(spark.createDataFrame(rows[:2], schema)).count() == 0


def test_verdicts(spark):
    rows = [(1, "a", True), (1, "b_warning", False), (2, "a", None), (3, "a", True)]
    got = Q.verdicts(spark.createDataFrame(rows, "doc_id long, name string, passed boolean"))
    assert {r["doc_id"]: r["status"] for r in got.collect()} == {1: "PASS_WITH_WARNINGS", 2: "FAIL", 3: "PASS"}


def test_markdown_parts(spark):
    md = F.lit("# T\n\nbody one\n\n## H\n\nbody two\n")
    assert one(spark, M.title(md)) == "T" and one(spark, M.body_paragraphs(md)) == ["body one", "## H", "body two"]


def test_file_drop_stream(spark, tmp_path):
    from quillgrid.streaming import file_drop

    spark.createDataFrame([(1, "A title for it\nbody", "en", "s", 3)], file_drop.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = file_drop.markdown_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["markdown"] == "# A title for it\n\nbody\n"


def zone_rows(spark, **given):
    return spark.createDataFrame([(1, z, *map(float, given.get(z, b))) for z, b in B.ZONES.items()], "page long, zone string, x double, y double, w double, h double")


def test_stacked_zones_follow_each_other_within_the_page(spark):
    got = {r["zone"]: r for r in Y.stacked(zone_rows(spark)).collect()}
    order = [z for z, _, _ in Y.STACK]
    for a, b in zip(order, order[1:], strict=False):
        assert got[a]["y"] + got[a]["h"] <= got[b]["y"] + 1e-9
    assert got["sidebar"]["y"] == got["hero"]["y"] and got["sidebar"]["x"] > got["hero"]["x"] + got["hero"]["w"]
    foot = got["columns"]["y"] + got["columns"]["h"]
    assert got["continuation"]["y"] + got["continuation"]["h"] == pytest.approx(foot) and foot <= 714 * 0.965 + 1e-6
    assert got["hero"]["share"] == 0.72 and got["sidebar"]["share"] == 0.22


def test_tall_zones_are_pressed_into_the_page(spark):
    got = {r["zone"]: r for r in Y.stacked(zone_rows(spark, hero=(0, 0.3, 0.9, 0.9), columns=(0, 0.9, 0.7, 0.3))).collect()}
    margin, y = 595 * 0.035, 0.0
    heights = {"masthead": 0.11, "meta": 0.035, "headline": 0.14, "hero": 0.9, "caption": 0.028, "lower": 0.05, "columns": 0.3}
    for zone, _, gap in Y.STACK:
        y += 714 * (heights[zone] + gap * 0.45)
    press = 714 * 0.965 / (y + margin * 0.6)
    assert got["columns"]["y"] + got["columns"]["h"] == pytest.approx(margin / 2 + (y + margin * 0.1) * press)
    assert got["hero"]["h"] == pytest.approx(0.9 * 714 * press)
    assert got["hero"]["share"] + got["sidebar"]["share"] + 0.012 == pytest.approx(1 + 0.012 * (1 - 1 / 1.012), abs=1e-9)


def test_visual_warnings(spark):
    placed = Y.stacked(zone_rows(spark))
    assert Y.visual_metrics(placed).first()["warnings"] == ""
    apart = placed.withColumn("y", F.when(F.col("zone") == "hero", F.col("y") + 60).otherwise(F.col("y")))
    assert Y.visual_metrics(apart).first()["warnings"].startswith("headline_to_hero_gap_too_large")
    assert Y.visual_metrics(placed.where("false")).count() == 0


def test_round_robin_and_photo(spark):
    pars = spark.createDataFrame([(1, n, f"p{n}") for n in range(1, 8)], "doc_id long, n int, text string")
    assert {r["column"]: r["text"] for r in Y.round_robin(pars).collect()} == {0: "p1\n\np6", 1: "p2\n\np7", 2: "p3", 3: "p4", 4: "p5"}
    rows = [(1, 1, "image", "", 100.0, 100.0, 500.0, 500.0), (1, 2, "image", "", 100.0, 100.0, 500.0, 500.0), (1, 3, "image", "", 0.0, 0.0, 1000.0, 500.0), (1, 4, "text", "", 0.0, 0.0, 400.0, 400.0)]
    df = spark.createDataFrame(rows, "page long, pos int, label string, text string, x1 double, y1 double, x2 double, y2 double")
    assert [(r["pos"], round(r["score"], 6)) for r in Y.photo_scores(df).collect()] == [(1, round(160000 / 1200000 + 0.08 + 0.10 + 0.03, 6))]


def test_wrapped_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["", " \n ", "a" * 30] + [" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.wrapped(F.col("t"), 12).alias("v")).collect()
    for r in got:
        want = []
        for w in texts[r["i"]].split():
            if want and len(want[-1]) + 1 + len(w) <= 12:
                want[-1] += " " + w
            else:
                want.append(w)
        assert r["v"] == want


def test_phrase_context(spark):
    assert one(spark, T.phrase_context(F.lit("one two THREE four five"), "three", 4)) == "two THREE fou"
    assert one(spark, T.phrase_context(F.lit("one"), "three")) == "" and one(spark, T.phrase_context(F.lit(None).cast("string"), "x")) is None


def test_photo_points_end_at_their_limit(spark):
    """0.55 of 700 is 385, though not as a product of doubles; scores that differ in their last bits only are equal."""
    rows = [(1, 1, "image", 385.0, 100.0, 585.0, 300.0), (2, 1, "image", 384.0, 100.0, 584.0, 300.0)]
    df = spark.createDataFrame(rows, "page long, pos int, label string, x1 double, y1 double, x2 double, y2 double")
    got = {r["page"]: round(r["score"], 9) for r in Y.photo_scores(df, 700.0, 700.0).collect()}
    assert got == {1: round(40000 / 490000 + 0.08, 9), 2: round(40000 / 490000 + 0.11, 9)}


def test_largest_image_is_the_first_of_equal_areas(spark):
    """Both are 6600 square pixels; as doubles in points the second is larger."""
    points = lambda k: round(k * 0.595, 6)
    rows = [(1, 0, n, "image", 0.0, y, points(w), points(h), "p", 0.0, "") for n, y, w, h in ((3, 7.0, 100, 66), (6, 9.0, 110, 60))]
    plan = spark.createDataFrame(rows, "page long, z int, n int, op string, x double, y double, w double, h double, text string, size double, colour string")
    assert points(110) * points(60) > points(100) * points(66)
    assert render.facts(plan).first()["image_top"] == 7.0


def test_pressed_gaps_lie_on_their_decimal(spark):
    """Order 2975's blocks end at the page's foot: the zones are pressed by 0.965, and 0.0081 * 0.965 is 0.0078165."""
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_orderkey = 2975")
    blocks = P.derived_blocks(lines, spark.read.parquet("/root/testdata/sf0.1/part.parquet"))
    got = Y.visual_metrics(Y.stacked(B.zones(B.classify(blocks)))).select(F.round("headline_hero", 6).alias("v")).first()["v"]
    assert got == 0.007817
