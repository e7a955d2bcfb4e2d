"""The page model and what is made from it, against hand-worked pages; each front query against its SQL."""

import json
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgrid import cli
from quillgrid import settings as S
from quillgrid.functions import fuzzy
from quillgrid.functions import geometry as G
from quillgrid.functions import text as T
from quillgrid.operators import blocks as B
from quillgrid.operators import checks as C
from quillgrid.operators import documents as D
from quillgrid.operators import engines as E
from quillgrid.operators import frontpage as N
from quillgrid.operators import markdown as M
from quillgrid.operators import render as X
from quillgrid.operators import reports as R
from quillgrid.operators import search as L
from quillgrid.operators import typography as K
from quillgrid.plans import front, front_sql
from quillgrid.sources import pages as P

from .test_catalog import SF, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(front_sql.oracle_sql()))
def test_matches_sql(spark, duck, name):
    want, got = duck.sql(front_sql.oracle_sql()[name]).df(), front.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


BLOCK = "page long, id int, ord int, block_type string, text string, x1 double, y1 double, x2 double, y2 double, confidence double"


def page(spark, *blocks):
    made = [(1, i, i, t, s, *map(float, b), 0.5) for i, (t, s, b) in enumerate(blocks)]
    return N.page_model(spark.createDataFrame(made, BLOCK))


def role(model, name):
    r = model.select(f"{name}.*").first()
    return r["text"], r["ids"]


def test_a_page_without_marks_has_defaults(spark):
    m = page(spark, ("body_text", "Nothing in particular", (0, 500, 100, 520)))
    assert role(m, "masthead") == ("KUVA ERIKOIS", []) and role(m, "price_meta") == ("1 mk (sis. lvv)", []) and role(m, "lower_headline") == ("LAPUA ERISTETTIIN", [])
    r = m.first()
    assert r["sidebar"] == [] and r["bottom_columns"] == [] and r["taken"] == [] and r["image_caption"] is None


def test_blocks_and_lines_have_one_owner(spark):
    long = "A line of the story that is long enough for the sidebar."
    m = page(
        spark, ("masthead_logo", "KUVA\nextra", (0, 10, 900, 90)), ("newspaper_name", "ILTA-SANOMAT", (0, 100, 900, 140)), ("issue_meta", "N:o 5\nMAANANTAI 1.\n***\n2 mk (sis. alv)", (0, 210, 900, 250)),
        ("main_headline", "BIG NEWS\nSECOND LINE", (0, 260, 900, 330)), ("right_sidebar", f"N:o 5\nBIG NEWS\n{long}", (700, 500, 950, 600)), ("right_sidebar", f"{long}\nshort", (700, 620, 950, 700)),
        ("bottom_columns", f"right\n{long}", (500, 900, 700, 1000)), ("bottom_columns", "left", (100, 900, 300, 1000)), ("continuation_box", "jatkuu sivulle 5", (700, 1100, 900, 1150)),
    )
    assert role(m, "masthead") == ("KUVA", [0]) and role(m, "newspaper_name") == ("ILTA-SANOMAT", [1])
    assert [role(m, f"{r}_meta") for r in ("issue", "date", "stars", "price")] == [("N:o 5", [2]), ("MAANANTAI 1.", [2]), ("***", [2]), ("2 mk (sis. alv)", [2])]
    assert role(m, "main_headline") == ("BIG NEWS", [3]) and role(m, "secondary_headline") == ("SECOND LINE", [])
    r = m.first()
    assert [(x["text"], x["ids"]) for x in r["sidebar"]] == [(long, [4])]  # metadata and owned lines are out; the second block is too short then
    assert [(x["text"], x["ids"]) for x in r["bottom_columns"]] == [("left", [7]), ("right", [6])]
    assert role(m, "continuation_box") == ("JATKUU SIVULLE 5", [8]) and r["metadata_ids"] == [2] and r["taken"] == [0, 1, 2, 3, 4, 6, 7, 8]
    assert N.reused_blocks(N.roles(m).where("role not like '%_meta'")).count() == 0


def test_low_body_text_is_dealt_to_columns(spark):
    m = page(spark, *[("body_text", f"para {i}", (0, 850 + i, 100, 870 + i)) for i in range(7)])
    assert [x["text"] for x in m.first()["bottom_columns"]] == ["para 0\n\npara 5", "para 1\n\npara 6", "para 2", "para 3", "para 4"]


def test_captions_are_one_for_each_beginning(spark):
    cand = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(n).alias("norm"), F.struct(F.lit(n).alias("text")).alias("c")) for s, n in ((1.0, "a" * 50), (2.0, "a" * 50 + "b"), (9.0, "x" + "a" * 45), (3.0, "other"), (0.5, "other"))])
    assert [(r["score"], r["norm"][:2]) for r in one(spark, N.distinct_captions(cand))] == [(2.0, "aa"), (3.0, "ot")]


def test_engine_captions_count(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "hero_image", "", 0.0, 300.0, 600.0, 600.0, 0.5), (1, 1, 1, "body_text", "x", 0.0, 900.0, 100.0, 920.0, 0.5)], BLOCK)
    extra = spark.createDataFrame([(1, 0, "kuvateksti: Ja Murhe kasvoi uhrien raunioista", 0.0, 610.0, 500.0, 640.0), (1, 1, "Murhe kasvoi uhrien luona kauan sitten", 0.0, 10.0, 500.0, 40.0)], "page long, n int, text string, x1 double, y1 double, x2 double, y2 double")
    r = N.page_model(blocks.where("id = 1"), engine_captions=extra, layout=blocks).first()
    assert r["image_caption"]["text"] == "Murhe kasvoi uhrien raunioista" and len(r["captions"]) == 1 and r["captions"][0]["score"] == 3 + 2 + 2 + 8


def test_story_body_and_primary_markdown(spark):
    md = "# A\n\n## TEHDASRÄJÄYS\n\nbody one\n# not this\nbody two\n\n*Kuvateksti: c*\n\n## Next\nno"
    assert one(spark, M.story_body(F.lit(md))) == "body one\nbody two" and one(spark, M.story_body(F.lit("## Other\nx"))) == ""
    pick = lambda t, a, b: one(spark, M.primary(F.lit(t), F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert pick("newspaper_front_page", "own ", "e") == "own" and pick("generic", "own", " e ") == "e" and pick("newspaper_front_page", None, "e") == "e"
    with pytest.raises(Exception, match="primary markdown is empty"):
        pick("generic", "own", " ")
    assert one(spark, M.engine_markdown(F.lit(" "), F.lit("blocks"))) == "blocks"


def test_text_corrections(spark):
    assert one(spark, T.finalized(F.lit("Tiedettiin etta KASVOL heinkilöä"))) == "Tiedettiin että KASVOI henkilöä"
    assert one(spark, T.cleaned(F.lit("sano-\nma, uh- rien"))) == "sanoma, uhrien" and one(spark, T.cleaned(F.lit("x\n 1 mk (sis. lvv "))) == "x\n 1 mk (sis. lvv)"
    assert one(spark, T.cleanup_issues(F.lit("on- nettomuus 1 mk (sis.\x01"))) == ["control_or_replacement_chars", "broken_hyphen_onnettomuus", "unclosed_price_paren"]
    assert one(spark, T.looks_mojibake(F.lit("Ã©"))) and one(spark, T.looks_mojibake(F.lit("Â§"))) and not one(spark, T.looks_mojibake(F.lit("Ã–")))
    assert one(spark, T.normalized_for_match(F.lit("PÃ¤ivÃ¤!"))) == "päivä"


def test_story_content_checks(spark):
    df = page(spark, ("body_text", "x", (0, 500, 100, 520))).withColumn("markdown", F.lit("1 mk 1 mk\n## TEHDASR\nN : O\n")).withColumn("pdf_text", F.lit(""))
    got = {r["name"]: r["passed"] for r in C.exploded(df, F.concat(C.metadata(), C.story())).collect()}
    assert not got["price_occurrences_in_markdown"] and not got["issue_number_occurrences_in_body"] and got["content_loss_detected"] and got["no_consumed_block_reused"]


def test_verdict_order(spark):
    checks = lambda *c: F.array(*[C.check(n, F.lit(p)) for n, p in c])
    verdict = lambda q, *c: one(spark, C.verdict(checks(*c), F.lit(q)))
    assert verdict("PASS", ("a", True)) == "PASS" and verdict("PASS", ("a_warning", False)) == "PASS_WITH_WARNINGS" and verdict("PASS", ("a", False)) == "FAIL" and verdict("FAIL", ("a", True)) == "FAIL"
    assert one(spark, C.layout_quality(checks(("content_x", False), ("text_cleanup_pass", False)))) == "PASS"
    assert one(spark, C.readability(checks(("bottom_columns_readability_warn", False)))) == "WARN"


def test_crop_policy(spark):
    can = lambda r, c, t, **o: one(spark, B.can_crop(F.lit(r), F.lit(c), F.lit(t), **o))
    assert can("hero_image", 0.1, "") and can("photo", 0.15, "12345 67890 123") and not can("hero_image", 0.2, "") and not can("photo_caption", 0.0, "")
    assert not can("hero_image", 0.0, "a long line of letters") and not can("logo", 0.0, "") and not can("hero_image", 0.0, "", allow_photo_crops=False)


def test_fit_text_and_stack_equal_brute_force(spark):
    rng = random.Random(4)
    for _ in range(12):
        n, w, h, start, least = rng.randint(0, 40), rng.uniform(50, 600), rng.uniform(5, 60), rng.uniform(10, 50), rng.choice([6.0, 14.0])
        size = start
        while size >= least and not (n <= max(1, int(w / (size * 0.5))) and size * 1.15 <= h):
            size -= 0.5
        want = start if not n else size if size >= least else least
        assert one(spark, G.fit_text(F.lit("x" * n), F.lit(w), F.lit(h), F.lit(start), least, 0.5)) == pytest.approx(want)
        label, name, room = rng.uniform(14, 28), rng.uniform(25, 58), rng.uniform(30, 110)
        a, b = label, name
        while a * 1.15 + b * 1.12 > room * 0.9 and b > 30:
            b -= 0.5
        while a * 1.15 + b * 1.12 > room * 0.9 and a > 14:
            a -= 0.5
        got = G.fit_stack(F.lit(label), F.lit(name), F.lit(room))
        assert (one(spark, got[0]), one(spark, got[1])) == pytest.approx((a, b))


LINE = "doc_id long, idx int, text string, x_min double, x_max double, y_min double, y_max double"


def test_documents_from_lines_by_columns(spark):
    made = [(1, 0, "A headline line", 0.0, 100.0, 0.0, 30.0)]
    for i in range(4):
        made += [(1, 1 + 2 * i, f"left {i}", 0.0, 40.0, 40.0 + 12 * i, 50.0 + 12 * i), (1, 2 + 2 * i, f"right {i}", 60.0, 100.0, 41.0 + 12 * i, 51.0 + 12 * i)]
    made += [(1, 9, "Sivu 3", 0.0, 40.0, 90.0, 100.0), (1, 10, "wide at the end", 0.0, 100.0, 120.0, 130.0), (2, 0, "Only a title. And more", 0.0, 100.0, 0.0, 1.0)]
    got = {r["doc_id"]: r for r in D.from_lines(spark.createDataFrame(made, LINE)).select("*", D.structured_markdown().alias("md"), D.column_count().alias("n")).collect()}
    assert got[1]["n"] == 2 and got[1]["md"].startswith("# A headline line\n\n## Vasen palsta\n\n") and "Sivu 3" not in got[1]["md"] and got[1]["md"].endswith("## Leveä lohko\n\nwide at the end\n")
    assert got[2]["title"] == "Only a title" and got[2]["blocks"][0]["paragraphs"] == ["Only a title. And more"]


def test_text_engine_words_fill_the_layout(spark):
    blocks = F.array(*[F.struct(F.lit(float(i)).alias("y_min"), F.lit(i).alias("rank"), F.lit("full").alias("kind"), F.array(F.lit(f"own {i}")).alias("paragraphs")) for i in range(2)])
    fill = lambda *ps: [b["paragraphs"] for b in spark.range(1).select(blocks.alias("blocks")).select(D.with_paragraphs_of(F.array(*map(F.lit, ps)).cast("array<string>")).alias("b")).first()["b"]]
    assert fill() == [["own 0"], ["own 1"]] and fill("a") == [["a"], ["own 1"]] and fill("a", "b", "c") == [["a"], ["b", "c"]]


def test_merged_report_fields(spark):
    make = lambda *kv: spark.createDataFrame([(1, dict(kv))], "doc_id long, fields map<string,string>")
    assert E.merged_fields(make(("a", "1"), ("b", "2")), make(("b", "3"), ("c", "4"))).first()["fields"] == {"a": "1", "b": "3", "c": "4"}


def brute_layer(blocks, others):
    """The steps of a search layer on plain rows, with likeness from the fuzzy module."""
    found = []
    for b in blocks:
        text, norm, best = b["text"], b["norm"], 0.0
        for o in others:
            common, like = L.overlap(b, o), fuzzy.token_set_ratio(norm, o["norm"]) / 100
            if 0.55 * common + 0.45 * like > best and (common >= 0.08 or like >= 0.75):
                best, text, norm = 0.55 * common + 0.45 * like, o["text"], o["norm"]
        found.append(b | {"text": text, "norm": norm})
    return found


def test_search_layer_takes_better_words_and_adds_what_is_missing(spark):
    own = [(1, 1, "text", "the quick brwn fox jumps over", 0.0, 500.0, 400.0, 540.0), (1, 2, "text", "another text entirely here", 0.0, 700.0, 400.0, 740.0), (1, 3, "image", "", 500.0, 300.0, 990.0, 690.0)]
    other = [(1, 1, "text", "the quick brown fox jumps over", 2.0, 501.0, 401.0, 541.0), (1, 2, "text", "a block that only the second engine saw", 0.0, 900.0, 400.0, 940.0), (1, 3, "text", "abc", 0.0, 1000.0, 10.0, 1010.0)]
    schema = "page long, pos int, label string, text string, x1 double, y1 double, x2 double, y2 double"
    blocks = B.classify(spark.createDataFrame(own, schema)).withColumn("confidence", F.lit(0.85))
    r = L.search_text(blocks, spark.createDataFrame(other, schema)).first()
    assert r["segments"] == ["the quick brown fox jumps over", "another text entirely here", "a block that only the second engine saw"] and (r["n_before"], r["n_after"]) == (3, 3)
    alone = L.search_text(blocks).first()
    assert alone["segments"] == ["the quick brwn fox jumps over", "another text entirely here"]


def test_enriching_skips_nothing_that_could_win():
    rng = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta".split()
    block = lambda: {"text": (t := " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))), "norm": t, "x1": (x := rng.uniform(0, 100)), "y1": (y := rng.uniform(0, 100)), "x2": x + rng.uniform(1, 80), "y2": y + rng.uniform(1, 80), "engine": "e", "confidence": 0.5, "quality": 1.0, "worth": 1.0}
    for _ in range(200):
        blocks, others = [block() for _ in range(3)], [block() for _ in range(5)]
        assert [x["text"] for x in brute_layer(blocks, others)] == [L.enriched(b, others)["text"] for b in blocks]


def test_near_is_one_predicate_for_columns_and_rows(spark):
    rng = random.Random(8)
    boxes = [[(x := rng.uniform(0, 100)), (y := rng.uniform(0, 100)), x + rng.uniform(0, 60), y + rng.uniform(0, 40)] for _ in range(120)]
    pairs = list(zip(boxes[::2], boxes[1::2], strict=True))
    named = lambda b: dict(zip(("x1", "y1", "x2", "y2"), b, strict=True))
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double, c double, d double, e double, f double, g double, h double")
    got = {r["i"]: r["n"] for r in df.select("i", G.near(G.box("a", "b", "c", "d"), G.box("e", "f", "g", "h")).alias("n")).collect()}
    want = {i: bool(G.near(named(a), named(b), 0.0, min, max, abs)) for i, (a, b) in enumerate(pairs)}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_render_plans_and_pdf(spark):
    made = [(1, 1, "main_headline", "headline", "text", "ONE\nTWO", 0.0, 100.0, 500.0, 200.0), (1, 2, "hero_image", "body", "image", "", 0.0, 300.0, 500.0, 600.0), (1, 3, "continuation_box", "meta", "box", "GO (ON)", 700.0, 1000.0, 900.0, 1050.0)]
    df = spark.createDataFrame(made, "page long, pos int, block_type string, font_role string, render_mode string, text string, x1 double, y1 double, x2 double, y2 double")
    plan = X.structural(df)
    got = [(r["op"], r["text"], r["colour"]) for r in plan.orderBy("z", "n").collect()]
    assert got == [("image", "2", None), ("text", "ONE", "black"), ("text", "TWO", "black"), ("rect", None, "black"), ("text", "GO (ON)", "white")]
    f = X.facts(plan).first()
    assert (f["pdf_text"], f["images"], f["full_page"], f["white_box"]) == ("ONE\nTWO\nGO (ON)", 1, False, True)
    assert X.facts(X.facsimile(df)).first()["full_page"] and X.overlay(df).count() == 6
    pdf = bytes(X.pdfs(plan).first()["pdf"])
    body = zlib.decompress(pdf[pdf.index(b"stream\n") + 7 : pdf.index(b"\nendstream")])
    assert pdf.startswith(b"%PDF-1.4") and pdf.endswith(b"%%EOF\n") and b"(GO \\(ON\\)) Tj" in body and body.count(b" re f") == 2
    assert int(pdf.split(b"startxref\n")[1].split(b"\n")[0]) == pdf.index(b"xref\n0")


def test_reflow_keeps_every_word_in_its_column(spark):
    docs = spark.createDataFrame([(1, "# Title\n\n---\n" + " ".join(f"w{i}" for i in range(900)))], "doc_id long, markdown string")
    got = X.reflow(docs, columns=2).orderBy("n").collect()
    assert " ".join(r["text"] for r in got if r["op"] == "text").split()[1:] == [f"w{i}" for i in range(900)]
    assert {round(r["x"]) for r in got} == {42, 318} and all(len(r["text"]) * r["size"] * 0.5 <= r["w"] + 1e-6 for r in got if r["op"] == "text")


def test_template_shows_every_role_and_tells_overflow(spark):
    m = K.with_sizes(page(spark, ("body_text", "para " * 900, (0, 850, 100, 870))), 595.0, 714.0, S.Settings())
    zones = spark.createDataFrame([(1, z, 0.0, 10.0 * i, 500.0, 20.0 if z == "columns" else 100.0) for i, z in enumerate(("masthead", "meta", "headline", "hero", "sidebar", "caption", "lower", "columns", "continuation"))], "page long, zone string, x double, y double, w double, h double")
    got = X.overflow(X.template(m, zones)).collect()
    assert {r["text"] for r in got} >= {"KUVA ERIKOIS", "ILTA-SANOMAT", "JATKUU TAKASIVULLE", "hero"} and [r["n"] for r in got if r["over"]] == [10]
    assert K.styles(m).count() == 10


def test_settings_and_choices(tmp_path):
    (tmp_path / "s").write_text("# x\nPARSE_ENGINE=auto\nPARSE_EMIT_CLEAN=true\nOTHER=1\n")
    s = S.load({"PARSE_EMIT_CLEAN": "no"}, tmp_path / "s", pdf_mode="clean")
    assert (s.engine, s.emit_clean, s.pdf_mode) == ("auto", False, "clean") and S.engine_choice(s) == "hybrid" and S.engine_choice(S.Settings(engine="auto", speed_priority=True)) == "layout" and S.engine_choice(s, "text") == "text"
    assert S.output_plan(s) == {"structural": False, "facsimile": False, "clean": True, "debug_overlay": False, "debug_search_layer": False}
    assert S.Settings(primary_language="FI_fi", extra_languages="sv, en,fi").languages() == ["fi", "sv", "en"]
    assert S.device(s, True) == "gpu:0" and S.device(S.Settings(device="cpu"), True) == "cpu" and S.fallback_chain("pdf") == ["native_pdf", "layout", "text"]
    for bad in (lambda: S.load({"PARSE_WRITE_PDF": "maybe"}), lambda: S.Settings(engine="x"), lambda: S.fallback_chain("unknown")):
        with pytest.raises(ValueError):
            bad()


def test_dispatch_falls_back_but_not_silently():
    def fail():
        raise OSError("gone")

    s = S.Settings()
    assert S.dispatch(s, "hybrid", {"text": fail, "layout": lambda: 1}) == {"layout": 1}
    for settings, choice in ((s, "text"), (S.Settings(fallback_on_error=False), "hybrid")):
        with pytest.raises(RuntimeError, match="engine text failed"):
            S.dispatch(settings, choice, {"text": fail, "layout": lambda: 1})
    with pytest.raises(RuntimeError, match="no engine"):
        S.engines_to_run(S.Settings(text_engine_enabled=False), "text")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps({"width": 100, "parsing_res_list": [{"label": "doc_title", "content": "T"}, {"label": "text", "content": "Body"}]}))
    (tmp_path / "bad.json").write_text("[1]")
    assert cli.main(["parse", str(tmp_path / "p.json"), "--out", str(tmp_path / "o"), "--output", "flowing"]) == 0
    row = spark.read.parquet(str(tmp_path / "o" / "markdown")).first()
    assert bytes(row["file"]).decode("utf-8-sig") == "# T\n\nBody\n" and bytes(row["file"]).startswith(b"\xef\xbb\xbf")
    assert cli.main(["parse", str(tmp_path / "none.json")]) == 1 and cli.main(["parse", str(tmp_path / "bad.json"), "--out", str(tmp_path / "x")]) == 1
    assert "no such file" in capsys.readouterr().err
    paths = R.export(spark.read.parquet(str(tmp_path / "o" / "markdown")), str(tmp_path / "single")).collect()
    assert len(paths) == 1 and len(list((tmp_path / "single").iterdir())) == 1


def test_sinks(spark, tmp_path):
    with pytest.raises(Exception, match="empty markdown"):
        R.write_markdown(spark.createDataFrame([(1, " ")], "doc_id long, markdown string"), str(tmp_path / "b"))
    checks = spark.createDataFrame([(1, "a", True, ""), (1, "b", False, "why"), (2, "c", None, None)], "doc_id long, name string, passed boolean, detail string")
    for _ in range(2):
        R.append_errors(checks, str(tmp_path / "log"), "x_")
    assert sorted(r["error_id"] for r in spark.read.json(str(tmp_path / "log")).collect()) == ["x_b", "x_b", "x_c", "x_c"]
    layers = spark.createDataFrame([(1, "text")], "doc_id long, full_text string")
    R.write_search_text(layers, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first()["value"] == "text\n"
    R.write_reports(layers.select("doc_id", R.report("report", "full_text")), str(tmp_path / "r"), "search")
    assert json.loads(spark.read.json(str(tmp_path / "r")).first()["report"]) == {"full_text": "text"}


def test_saved_results_and_engines(spark):
    files = spark.createDataFrame([("a", "a/2.json"), ("a", "a/1.json"), ("b", "b/1.json")], "source string, path string")
    assert {r["source"]: r["path"] for r in P.saved_result(files).collect()} == {"a": "a/1.json", "b": "b/1.json"}
    for engine in P.ENGINES:
        with pytest.raises(RuntimeError, match=engine):
            P.inferred(spark.range(1), None, engine=engine)
    with pytest.raises(ValueError):
        P.inferred(spark.range(1), None, engine="x")


def scans_and_exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning")


def test_lines_and_zones_need_one_scan_and_one_exchange(spark):
    from quillgrid.plans import catalog

    assert scans_and_exchanges(catalog.queries()["doc_flowing_markdown"](spark, SF)) == (1, 1)
    blocks = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey page", "l_returnflag block_type", "double(l_partkey) x1", "double(l_suppkey) y1", "double(l_partkey + 5) x2", "double(l_suppkey + 5) y2")
    assert scans_and_exchanges(B.zones(blocks)) == (1, 1)


def test_pages_merge_at_once_as_block_by_block():
    """All pairs of a page at once, with a table too small for all pages' texts, against the plain steps."""
    import random

    import pyarrow as pa
    from quillgrid.functions.likeness import Likeness

    rng = random.Random(5)
    said = ["large ring", "old plate", "n o 87 1976 old plate", "tiistaina 13 pnä", "kuvateksti murhe kasvoi old bolt uhrien raunioista", "a", "", "the large ring", "old bolts and large rings of the sea", "and large rings of the se"]

    def block(pos):
        t = rng.choice(said) if rng.random() < 0.8 else " ".join(rng.choice("old large ring bolt sea the of 87".split()) for _ in range(rng.randrange(1, 9)))
        t = "".join(rng.sample(t, len(t))) if rng.random() < 0.2 else t
        x, y, sure = rng.randrange(0, 600), rng.randrange(0, 1100), rng.choice([0.5, 0.6, 0.85, 0.95])
        return {"pos": pos, "text": t.upper() if rng.random() < 0.3 else t, "norm": " ".join(t.split()), "engine": "text_engine" if pos >= 1000 else "layout_engine", "confidence": sure, "region": rng.choice(["a", "b", ""]), "block_type": "t", "worth": float(len(t)), "quality": len(t) + 20 * sure, "x1": float(x), "y1": float(y), "x2": float(x + rng.randrange(0, 500)), "y2": float(y + rng.randrange(0, 120))}

    pages = [([block(i) for i in range(rng.randrange(0, 40))] or None, [block(1000 + i) for i in range(rng.randrange(0, 20))] or None) for _ in range(60)]
    kind = pa.list_(pa.struct([(c, pa.string() if isinstance(v, str) else pa.int32() if isinstance(v, int) else pa.float64()) for c, v in block(0).items()]))
    rows = L._Rows(*(pa.array(side, kind) for side in zip(*pages, strict=True)))
    rows.known = Likeness(80)
    shown = lambda p: ([(a, rows.text[b], c) for a, b, c in p[0]], [tuple((a, rows.text[b], c) for a, b, c in g[:2]) + g[2:] for g in p[1]], p[2])
    for page in rows.pages:
        assert shown(rows.merged(*page)) == shown(rows.merged_plainly(*page))
    assert sum(len(rows.merged(*p)[1]) for p in rows.pages) > 100


def test_search_layer_holds_a_batch_of_blocks_and_not_of_pages(spark, tmp_path, monkeypatch):
    """A worker gets so many blocks at once, whatever the number of pages; a page over several batches stays whole, and rows
    of no page are one of each engine, as a join has them."""
    base, seen, key = L._Rows, str(tmp_path / "seen"), "spark.sql.execution.arrow.maxRecordsPerBatch"

    class Seen(base):
        def __init__(self, mine, theirs):
            base.__init__(self, mine, theirs)
            with open(seen, "a") as f:
                f.write(f"{len(self.text)}\n")

    schema = "page long, pos int, label string, text string, x1 double, y1 double, x2 double, y2 double"
    many = lambda page: 250 if page == 7 else 5
    made = [(page, i, "text", "" if i % 5 == 4 else f"block {i * 7919 % 1000} of {page}", 0.0, 30.0 * i, 400.0, 30.0 * i + 20) for page in [*range(200), None] for i in range(many(page))]
    blocks = B.classify(spark.createDataFrame(made, schema)).withColumn("confidence", F.lit(0.85))
    others = spark.createDataFrame([(page, 1, "text", f"only seen by others on {page}", 500.0, 0.0, 900.0, 20.0) for page in (3, 7, 500, None)], schema)
    got = {}
    for most in ("100", "10000"):
        before = spark.conf.get(key)
        spark.conf.set(key, most)
        try:
            with monkeypatch.context() as m:
                m.setattr(L, "_Rows", Seen)
                got[most] = sorted(map(str, L.search_text(blocks, others).collect()))
                if most == "100":
                    sizes = [int(x) for x in open(seen)]
        finally:
            spark.conf.set(key, before)
    assert got["100"] == got["10000"] and len(got["100"]) == 203
    rows = {r["page"]: r["n_before"] for r in L.search_text(blocks, others).where("page is not null").collect()}
    assert rows == {page: many(page) * 4 // 5 + (page in (3, 7)) for page in range(200)} | {500: 1}
    assert sorted(sizes)[-2] <= 105 and max(sizes) <= 100 + 201 and sum(sizes) == sum(rows.values()) + 5
