"""Checks of a front page's outputs, as arrays of (name, passed, detail), and the audit of its content.

Rows: what frontpage.page_model gives, with markdown and pdf_text (the text that a render plan shows). Words and phrases
are parameters; each family is a column over one row, so a page's checks need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import FRONT_PAGE, Lexicon
from . import markdown as M
from .frontpage import SINGLE, column_texts, text_of

#: Checks that warn when they fail; so do all that end in _warning.
SOFT = (
    "headline_to_hero_gap_visual_warning", "hero_to_caption_gap_visual_warning", "total_vertical_whitespace_visual_warning", "caption_to_lower_headline_gap_visual_warning",
    "lower_headline_to_columns_gap_visual_warning", "masthead_similarity_visual_warning", "text_cleanup_pass", "bottom_columns_readability_warn", "headline_to_image_gap_not_too_large",
    "image_to_caption_gap_small", "vertical_whitespace_not_excessive",
)
#: What a column's type must reach, and where a photo's top must be (with what it may be off).
LEAST_COLUMN_SIZE, MIDDLE_ZONE, ZONE_SLACK = 5.5, (0.28, 0.75), 0.02
#: By segment, phrases that must not be lost.
REQUIRED = {
    "masthead": ("KUVA ERIKOIS", "ILTA-SANOMAT"), "meta": ("N:o 87", "TIISTAINA", "1 mk"), "main_headline": ("JO 39 KUOLONUHRIA",), "secondary_headline": ("TEHDASR",),
    "main_story_sidebar": ("Jo 39 ihmistä oli löydetty", "valtioneuvosto kokoontui", "tutkijalautakunta", "patruunatehdas", "luovuttaakseen vertaan", "loukkaantuneille"),
    "image_caption": ("Murhe kasvoi", "Viimeisimpien tietojen", "38 ihmistä kuollut", "lisääntyvän"), "lower_headline": ("LAPUA ERISTET",),
    "lower_story_columns": ("Räjähdys tapahtui tehtaan lataamorakennuksessa", "60 henkilöä", "Tarkkojen tietojen", "Ensimmäinen hälytys", "irrotettavissa olevat", "Miltei kaikki tiet", "lentokieltoalueeksi"),
    "continuation": ("JATKUU TAKASIVULLE",),
}
#: Fragments that show damage, and whether they count as whole words only.
FORBIDDEN = (("Räjäh maata", False), ("loukkaantunei", True), ("lataamorakennu", True), ("johti mm..", False), ("plen tietojen", False), ("LAPUA ERISTETTIIN Räjähdys", False), ("Räjäh maata jonottivat", False))
#: Fragments that show that a segment was cut off.
TRUNCATED = (("loukkaantunei", True), ("lataamorakennu", True), ("Räjäh maata", False))
#: Phrases that may stand once: in the story's body, in all of the Markdown.
ONCE_IN_BODY, ONCE = ("luovuttaakseen vertaan",), ("LAPUA ERISTET",)


def check(name: str, passed: Column, detail: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail"))


def warnings(names: Column, prefix: str, suffix: str) -> Column:
    """A failed check for each name of an array."""
    return F.transform(names, lambda n: F.struct(F.concat(F.lit(prefix), n, F.lit(suffix)).alias("name"), F.lit(False).alias("passed"), n.alias("detail")))


def exploded(rows: DataFrame, checks: Column, key: str = "page") -> DataFrame:
    """(key, name, passed, detail)."""
    return rows.select(key, F.explode(checks).alias("c")).select(key, "c.*")


def sidebar_of() -> Column:
    return F.coalesce(F.col("sidebar_text"), F.lit(""))


def metadata(words: Lexicon = FRONT_PAGE, price: str = "1 MK", month: str = "HUHTIKUUN") -> Column:
    """Metadata is in its role and nowhere in the story."""
    body, markdown, sidebar = F.upper(M.story_body(F.col("markdown"), words)), F.upper("markdown"), F.upper(sidebar_of())
    count, start = T.occurrences(markdown, price), F.upper(F.substring(T.strip(sidebar_of()), 1, 20))
    # blocks by owner; lines of metadata and a second headline out of the first's block don't own one
    own = [F.coalesce(F.col(f"{r}.ids"), F.array().cast("array<int>")) for r in SINGLE if not r.endswith("_meta") and r != "secondary_headline"]
    owners = F.flatten(F.array(*own, F.flatten(F.transform("sidebar", lambda r: r["ids"])), F.flatten(F.transform("bottom_columns", lambda r: r["ids"]))))
    reused = T.once(owners, lambda ids: F.size(ids) == F.size(F.array_distinct(ids)))
    return F.array(
        check("price_meta_exists", F.contains(F.upper(text_of("price_meta")), F.lit(words.currency))), check("price_occurrences_in_markdown", count == 1, F.concat(F.lit("count="), count.cast("string"))),
        check("price_occurrences_in_sidebar", ~F.contains(sidebar, F.lit(price)) & ~F.contains(F.substring(sidebar, 1, 40), F.lit("(SIS."))), check("stars_occurrences_in_body", ~T.holds(body, ("***", "☆"))),
        check("issue_number_occurrences_in_body", ~F.contains(F.replace(body, F.lit(" "), F.lit("")), F.lit("N:O"))), check("date_occurrences_in_body", ~T.holds(body, ("PNÄ", month))),
        check("metadata_blocks_consumed_before_story", F.lit(True)), check("no_consumed_block_reused", reused), check("price_text_in_page_model", F.contains(F.upper(text_of("price_meta")), F.lit(price))),
        check("sidebar_does_not_start_with_price", ~start.startswith(price) & ~F.contains(start, F.lit("SIS."))),
    )


def phrases_in_markdown(phrases: Sequence[str]) -> Column:
    """Each phrase stands in the Markdown, in any case, with or without umlauts."""
    text = F.upper("markdown")
    return F.array(*[check("markdown_contains_" + p.replace(" ", "_").lower(), F.contains(text, F.lit(p.upper())) | F.contains(text, F.lit(p.replace("Ä", "A")))) for p in phrases])


def cleanup() -> Column:
    """Nothing is left to clean in the Markdown, the rendered text and the model's longer texts."""
    texts = F.array(F.col("markdown"), F.col("pdf_text"), sidebar_of(), text_of("image_caption"), text_of("price_meta"), F.array_join(column_texts(), "\n"))
    issues = T.cleanup_issues(F.array_join(F.filter(texts, lambda t: t != ""), "\n"))
    return F.concat(F.array(check("text_cleanup_pass", F.size(issues) == 0, F.array_join(issues, ","))), warnings(issues, "text_cleanup_", "_visual_warning"))


def story(words: Lexicon = FRONT_PAGE, prefix: str = "kuvateksti:", cut_off: str = "vapaaehtoiset", starts: Sequence[str] = ("JO 39",), rendered: Sequence[str] = ("LÖYDETTY KUOLE",), caption_words: Sequence[str] = ("MURHE", "UHRIEN")) -> Column:
    """Sidebar and caption are found, kept and rendered. pdf_text without an umlaut counts as with it."""
    sidebar, caption, pdf = T.strip(sidebar_of()), T.strip(text_of("image_caption")), F.upper("pdf_text")
    many = F.size("captions") > 0
    seen = F.col("sidebar_seen") | (sidebar != "")
    flat = F.translate(pdf, "Ö", "O")
    shown = (sidebar == "") | F.contains(pdf, F.upper(F.substring(sidebar, 1, 24))) | T.holds(pdf, starts) | T.holds(flat, rendered)
    caption_shown = F.when(caption != "", T.holds(pdf, caption_words) | F.contains(F.lower("pdf_text"), F.lower(F.substring(caption, 1, 20)))).otherwise(~many)
    in_markdown = F.contains(F.lower("markdown"), F.lit(prefix)) & F.contains(F.lower("markdown"), F.lower(F.substring(caption, 1, 15)))
    lost = (F.size("missing") > 0) | (seen & (sidebar == "")) | ((sidebar != "") & ~shown) | (many & (caption == "")) | ((caption != "") & ~caption_shown)
    fixed = [
        check("main_story_sidebar_in_page_model", (sidebar != "") | ~seen, F.substring(sidebar, 1, 60)), check("main_story_sidebar_rendered_in_pdf", (sidebar == "") | shown),
        check("image_caption_selected_when_candidates_exist", ~many | (caption != ""), F.concat(F.lit("candidates="), F.size("captions").cast("string"))),
        check("image_caption_rendered_in_pdf", (caption == "") | caption_shown), check("markdown_contains_image_caption", (caption == "") | in_markdown),
    ]
    some = [
        F.when(caption != "", check("caption_contains_murhe", F.contains(F.lower(caption), F.lit(words.caption_pair[0])))),
        F.when(sidebar != "", check("sidebar_not_truncated_at_vapaaehtoiset", ~sidebar.endswith(cut_off), F.substring(sidebar, -40, 40))),
        check("content_loss_detected", ~lost, F.array_join("missing", ",")),
    ]
    return F.array_compact(F.array(*fixed, *some))


def story_report() -> DataFrame | Column:
    """struct: what the model says of the story: sidebar seen, candidates for the caption, one chosen, what is missing."""
    missing = F.col("missing")
    return F.struct(
        (F.col("sidebar_seen") | (T.strip(sidebar_of()) != "")).alias("sidebar_detected"), F.size("captions").alias("caption_candidates"), (T.strip(text_of("image_caption")) != "").alias("caption_selected"),
        (F.size(missing) > 0).alias("content_loss"), missing.alias("missing"),
    )


def typography() -> Column:
    """Of typography.with_sizes' rows: headlines are large against the body, captions aren't, columns can be read."""
    size = lambda r: F.col(f"size_{r}")
    body = size("hero_sidebar_body")
    said = lambda a, b: F.concat(F.lit(f"{a}="), size(b).cast("string"), F.lit(", body="), body.cast("string"))
    fixed = F.array(
        check("style_debug_exists", F.lit(True)), check("main_headline_font_size_gt_3x_body", (body > 0) & (size("main_headline") > 3 * body), said("headline", "main_headline")),
        check("lower_headline_font_size_gt_2x_body", (body > 0) & (size("lower_headline") > 2 * body), said("lower", "lower_headline")), check("caption_font_size_lte_body", (body <= 0) | (size("image_caption") <= body), said("caption", "image_caption")),
        check("bottom_column_font_size_gte_minimum", size("bottom_column_body") >= LEAST_COLUMN_SIZE), check("masthead_not_plain_body_font", F.col("masthead_mode") == "text", F.concat(F.lit("mode="), "masthead_mode")),
    )
    caption = F.when(F.col("image_caption").isNotNull(), F.array(check("image_caption_exists_when_vl_found", T.strip(text_of("image_caption")) != "")))
    return F.concat(fixed, F.coalesce(caption, F.array().cast("array<struct<name:string,passed:boolean,detail:string>>")), warnings(F.col("type_warnings"), "typography_", "_warning"))


def visual(overflow: Column | None = None) -> Column:
    """Of rows with layout.visual_metrics' columns, size_bottom_column_body, masthead_mode and masthead_unlike: thresholds of
    widths, gaps and white space; each of its warnings again."""
    at_most = lambda name, column, most: check(name, F.col(column) <= most, F.concat(F.lit("gap="), F.round(column, 6).cast("string")))
    size, overflow = F.col("size_bottom_column_body"), F.lit(False) if overflow is None else overflow
    fixed = [
        check("visual_metrics_exists", F.lit(True)), check("masthead_overlap", F.lit(True)), check("hero_image_width_ratio_gte_0_70", F.col("hero_width") >= 0.70), check("right_sidebar_width_ratio_gte_0_18", F.col("sidebar_width") >= 0.18),
        check("bottom_column_font_size_gte_5_5", size >= LEAST_COLUMN_SIZE), F.when(size < LEAST_COLUMN_SIZE, check("bottom_columns_readability_fail", F.lit(False))), at_most("headline_to_hero_gap_visual_warning", "headline_hero", 0.045),
        at_most("hero_to_caption_gap_visual_warning", "hero_caption", 0.022), at_most("caption_to_lower_headline_gap_visual_warning", "caption_lower", 0.035), at_most("lower_headline_to_columns_gap_visual_warning", "lower_columns", 0.025),
        at_most("total_vertical_whitespace_visual_warning", "whitespace", 0.15), check("masthead_render_mode_ok", F.col("masthead_mode") == "text"),
        F.when(F.col("masthead_unlike"), check("masthead_similarity_visual_warning", F.lit(False), F.lit("masthead_similarity_warning"))), F.when((size >= LEAST_COLUMN_SIZE) & overflow, check("bottom_columns_readability_warn", F.lit(False), F.lit("bottom_column_overflow"))),
    ]
    named = F.filter(F.split("warnings", ","), lambda n: n != "")
    return F.concat(F.array_compact(F.array(*fixed)), warnings(named, "visual_layout_", "_warning"))


def crops(phrases: Sequence[str] = ("ILTA-SANOMAT", "JO 39 KUOLONUHRIA", "TEHDASR", "LAPUA ERISTET", "JATKUU")) -> Column:
    """Of rows with text_crops and photo_crops (numbers of each in a render plan), forbidden (ids of blocks that were cut
    out against the policy), images, masthead_mode and pdf_text: only photos are cut out, text is text."""
    pdf = F.upper("pdf_text")
    fixed = [
        check("text_crops_used", F.col("text_crops") == 0), check("photo_crops_used", F.col("photo_crops") > 0), check("forbidden_text_crop_blocks_empty", F.size("forbidden") == 0, F.array_join("forbidden", ",")),
        check("masthead_render_mode_text", F.col("masthead_mode") == "text", F.col("masthead_mode")), check("newspaper_name_render_mode_text", F.lit(True), F.lit("text")),
    ]
    said = [check("pdf_text_contains_" + p.replace(" ", "_").lower(), F.contains(pdf, F.lit(p)) | F.contains(pdf, F.lit(p.replace("Ä", "A")))) for p in phrases]
    return F.array(*fixed, *said, check("structural_pdf_only_photo_crops", F.col("images").between(1, 2), F.concat(F.lit("images="), F.col("images").cast("string"))))


def drawn() -> Column:
    """Of render.facts' rows: no image covers the page, and the continuation box is white on black."""
    return F.array(check("no_full_page_background", ~F.col("full_page")), check("continuation_box_white_text", F.col("white_box")))


def order(places: Mapping[str, Column], height: Column) -> Column:
    """Of places' tops (hero, main, secondary, masthead, bottom; null where nothing is there): the photo is in the middle of
    the page, headlines above it, the lower one below, the masthead above all."""
    at = {k: v / height for k, v in places.items()}
    both = lambda name, a, b: F.when(at[a].isNotNull() & at[b].isNotNull(), check(name, at[a] < at[b]))
    middle = at["hero"].between(MIDDLE_ZONE[0] - ZONE_SLACK, MIDDLE_ZONE[1] + ZONE_SLACK)
    return F.array_compact(F.array(
        F.when(at["hero"].isNotNull(), check("hero_image_in_middle_zone", middle)), both("main_headline_above_hero", "main", "hero"), both("secondary_headline_above_hero", "secondary", "hero"),
        both("bottom_headline_below_hero", "hero", "bottom"), both("masthead_above_headline", "masthead", "main"),
    ))


def segment_texts() -> dict[str, Column]:
    """The model's texts by the audit's names."""
    return {
        "masthead": F.concat(text_of("masthead"), F.lit("\n"), text_of("newspaper_name")), "meta": F.concat_ws("\n", text_of("issue_meta"), text_of("date_meta"), text_of("price_meta")), "main_headline": text_of("main_headline"),
        "secondary_headline": text_of("secondary_headline"), "main_story_sidebar": sidebar_of(), "image_caption": text_of("image_caption"), "lower_headline": text_of("lower_headline"),
        "lower_story_columns": F.array_join(column_texts(), "\n\n"), "continuation": text_of("continuation_box"),
    }


def segments() -> Column:
    """array<struct<id, role, text, normalized, confidence, owner, target>>: the model's texts that aren't blank, in order, each
    owned by its role."""
    single = segment_texts() | {"meta": F.array_join(F.filter(F.array(text_of("issue_meta"), text_of("date_meta"), text_of("price_meta")), lambda t: T.strip(t) != ""), "\n")}
    one = lambda key, role, t: F.struct(key.alias("id"), F.lit(role).alias("role"), T.strip(t).alias("text"), T.finalized(T.strip(t)).alias("normalized"), F.lit(0.9).alias("confidence"), F.lit(role).alias("owner"), F.lit(role).alias("target"))
    parts = []
    for name, text in single.items():
        if name == "lower_story_columns":
            parts.append(F.transform(column_texts(), lambda t, i: one(F.concat(F.lit("lower_story_column_"), i.cast("string")), "lower_story_column", t)))
        else:
            parts.append(F.array(one(F.lit(name), name, text)))
    return F.filter(F.concat(*parts), lambda s: s["text"] != "")


def misassigned(words: Lexicon = FRONT_PAGE) -> Column:
    """array<string>: signs that a text stands in another role than its own."""
    sidebar, lower = F.upper(sidebar_of()), F.upper(text_of("lower_headline"))
    squeezed = lambda t: F.upper(F.trim(F.regexp_replace(t, r"\s+", " ")))
    story = T.holds(sidebar, words.lower_story)
    body = F.upper(F.array_join(column_texts(), " "))
    tests = (
        ((lower != "") & F.contains(sidebar, lower), "lower_headline_in_sidebar"), (story, "lower_story_in_sidebar"), ((lower != "") & T.holds(sidebar, words.lower_leak), "lower_headline_leak_in_sidebar"),
        ((text_of("image_caption") != "") & F.contains(sidebar_of(), F.substring(text_of("image_caption"), 1, 30)), "caption_in_sidebar"),
    )
    repeated = F.transform(F.filter(column_texts(), lambda t: (squeezed(F.substring(t, 1, 80)) != "") & F.contains(squeezed(sidebar_of()), squeezed(F.substring(t, 1, 80)))), lambda _: F.lit("duplicate_sidebar_lower_column"))
    start = F.when(F.contains(sidebar, F.lit(words.lower_start)) & T.holds(body, words.lower_story), F.lit("lower_story_start_in_sidebar"))
    return F.concat(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests])), repeated, F.array_compact(F.array(start)))


def for_phrases(text: Column) -> Column:
    """Text as phrases are sought in it: finished, in lower case, white space collapsed."""
    return F.regexp_replace(F.lower(T.finalized(text)), r"\s+", " ")


def has_phrase(ready: Column, phrase: str) -> Column:
    """Whether a text made ready by for_phrases holds a phrase, with umlauts or without; an empty phrase stands in every
    text."""
    if not phrase.strip():
        return F.lit(True)
    sought = for_phrases(F.lit(phrase))
    return F.contains(ready, sought) | F.contains(F.translate(ready, "äö", "ao"), F.translate(sought, "äö", "ao"))


def repeated_phrases(words: Lexicon = FRONT_PAGE, once_in_body: Sequence[str] = ONCE_IN_BODY, once: Sequence[str] = ONCE) -> Column:
    """array<string>: phrases that stand more than once where they may stand once."""
    body, whole = F.upper(M.story_body(F.col("markdown"), words)), F.upper("markdown")
    return F.array_compact(F.array(*[F.when(T.occurrences(body, p.upper()) > 1, F.lit(p)) for p in once_in_body], *[F.when(T.occurrences(whole, p.upper()) > 1, F.lit(p)) for p in once]))


def looks_truncated(text: Column, fragments: Sequence[tuple[str, bool]] = TRUNCATED) -> Column:
    out = F.lit(False)
    for fragment, whole in fragments:
        out |= T.holds_fragment(text, fragment, whole)
    return out


def audit(rows: DataFrame, words: Lexicon = FRONT_PAGE, required: Mapping[str, Sequence[str]] = REQUIRED, forbidden: Sequence[tuple[str, bool]] = FORBIDDEN, truncated: Sequence[tuple[str, bool]] = TRUNCATED, once_in_body: Sequence[str] = ONCE_IN_BODY, once: Sequence[str] = ONCE) -> DataFrame:
    """rows and segment_audit (by required segment: phrases found in model, Markdown and rendered text, which are missing
    in the model, status), forbidden_found, duplicates, misassignments, truncated_segments, content_loss, content_quality
    (FAIL for any of these) and, with layout_quality (a column of rows), quality_result."""
    # each text is made ready once, however many phrases are sought in it
    texts = {n: t for n, t in segment_texts().items() if n in required} | {"markdown": F.col("markdown"), "pdf": F.col("pdf_text"), "body": M.story_body(F.col("markdown"), words)}
    rows = rows.withColumns({f"_{n}": for_phrases(t) for n, t in texts.items()})
    every = lambda n, ps: sum((has_phrase(F.col(f"_{n}"), p).cast("int") for p in ps), F.lit(0)) == len(ps)
    results = []
    for name, phrases in required.items():
        found = (every(name, phrases), every("body" if name == "main_story_sidebar" else "markdown", phrases), every("pdf", phrases))
        lost = F.array_compact(F.array(*[F.when(~has_phrase(F.col(f"_{name}"), p), F.lit(p)) for p in phrases])).cast("array<string>")
        status = F.when(found[0] & found[1] & found[2], "PASS").otherwise("FAIL")
        results.append(F.struct(F.lit(name).alias("name"), *[f.alias(n) for f, n in zip(found, ("in_model", "in_markdown", "in_pdf"), strict=True)], status.alias("status"), lost.alias("missing")))
    rows = rows.withColumn("segment_audit", F.array(*results))
    bad = [F.when(T.holds_fragment(F.col("markdown"), f, w) | T.holds_fragment(F.col("pdf_text"), f, w), F.lit(f)) for f, w in forbidden]
    cut = F.transform(F.filter(segments(), lambda s: looks_truncated(s["normalized"], truncated)), lambda s: s["id"])
    rows = rows.withColumns({
        "forbidden_found": F.array_compact(F.array(*bad)).cast("array<string>"), "duplicates": repeated_phrases(words, once_in_body, once).cast("array<string>"), "misassignments": misassigned(words), "truncated_segments": cut,
        "content_loss": F.exists("segment_audit", lambda s: s["status"] == "FAIL"),
    })
    wrong = F.col("content_loss") | (F.size("misassignments") > 0) | (F.size("truncated_segments") > 0) | (F.size("forbidden_found") > 0) | (F.size("duplicates") > 0)
    rows = rows.withColumn("content_quality", F.when(wrong, "FAIL").otherwise("PASS")).drop(*[f"_{n}" for n in texts])
    good = (F.col("layout_quality") != "FAIL") & (F.col("content_quality") == "PASS")
    return rows.withColumn("quality_result", F.when(good, "PASS").otherwise("FAIL"))


def audit_checks() -> Column:
    """Of audit()'s rows."""
    cut = (F.size("truncated_segments") > 0) | (F.size("forbidden_found") > 0)
    return F.array(
        check("content_quality_pass", F.col("content_quality") == "PASS", F.col("content_quality")), check("content_loss_not_detected", ~F.col("content_loss")), check("content_misassignment_not_detected", F.size("misassignments") == 0),
        check("truncated_text_not_detected", ~cut), check("duplicate_text_not_detected", F.size("duplicates") == 0), check("quality_result_not_fail", F.col("quality_result") != "FAIL", F.col("quality_result")),
        check("quality_result_full_pass", F.col("quality_result") == "PASS", F.col("quality_result")),
    )


#: Checks that are of content and don't count for the layout.
CONTENT = ("content_quality_pass", "content_loss_not_detected", "content_misassignment_not_detected", "truncated_text_not_detected", "duplicate_text_not_detected", "quality_result_not_fail", "quality_result_full_pass")


def is_soft(name: Column) -> Column:
    return name.isin(*SOFT) | name.endswith("_warning")


def layout_quality(checks: Column) -> Column:
    """FAIL if a check fails that neither warns only nor is of content."""
    hard = lambda c: ~c["passed"] & ~is_soft(c["name"]) & ~c["name"].startswith("content_") & ~c["name"].isin(*CONTENT)
    return F.when(F.exists(checks, hard), "FAIL").otherwise("PASS")


def verdict(checks: Column, content_quality: Column) -> Column:
    """FAIL for a failed hard check or content, or columns that can't be read; PASS_WITH_WARNINGS for failed soft ones."""
    unread = F.exists(checks, lambda c: (c["name"] == "bottom_columns_readability_fail") & ~c["passed"])
    soft = F.exists(checks, lambda c: ~c["passed"] & is_soft(c["name"]))
    return F.when((layout_quality(checks) == "FAIL") | (content_quality == "FAIL") | unread, "FAIL").when(soft, "PASS_WITH_WARNINGS").otherwise("PASS")


def readability(checks: Column) -> Column:
    """Of the bottom columns: FAIL, WARN or PASS."""
    failed = lambda n: F.exists(checks, lambda c: (c["name"] == n) & ~c["passed"])
    return F.when(failed("bottom_columns_readability_fail"), "FAIL").when(failed("bottom_columns_readability_warn"), "WARN").otherwise("PASS")
