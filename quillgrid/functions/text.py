"""Text as columns. Word lists are parameters or fixed values marked as such."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import CLEANUP_ISSUES, CORRECTIONS, FINAL_CORRECTIONS, FINAL_WORDS, FRONT_PAGE, LITERAL_FIXES, Lexicon

#: Words that make a line with a year a dateline.
DATE_WORDS = (
    "päivä", "tammikuun", "helmikuun", "maaliskuun", "huhtikuun", "toukokuun", "kesäkuun",
    "heinäkuun", "elokuun", "syyskuun", "lokakuun", "marraskuun", "joulukuun",
)
#: Two-character marks of UTF-8 read as cp1252.
MOJIBAKE_MARKS = ("Ã¤", "Ã¶", "Ã¥", "Â§", "Ã©", "Ã¼")
#: Signs that rate with stars, and languages that the layout model knows, with what it takes for others.
STARS = "*☆★"
MODEL_LANGUAGES, MODEL_DEFAULT = ("en", "sv", "de", "fr", "es", "it", "nl", "pl", "pt", "da", "no", "cs", "hu", "ro", "tr", "vi", "id", "ch"), "sv"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def is_signature(t: Column) -> Column:
    """Ends with a full stop, and 85 % of its letters are capitals."""
    s = strip(t)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (F.length(s) >= 3) & s.endswith(".") & (letters > 0) & (F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) >= 0.85 * letters)


def is_dateline(t: Column, words: Sequence[str] = DATE_WORDS) -> Column:
    """Holds a year of 1800 to 2099 and a comma or a date word, and is no signature."""
    s = strip(t)
    placed = F.contains(s, F.lit(",")) | F.lower(s).rlike("|".join(words))
    return (F.length(s) > 0) & ~is_signature(s) & s.rlike(r"\b(18|19|20)[0-9]{2}\b") & placed


def looks_mojibake(t: Column, marks: Sequence[str] = MOJIBAKE_MARKS) -> Column:
    out = F.contains(t, F.lit("�"))
    for m in marks:
        out |= F.contains(t, F.lit(m))
    return out


def _repaired(t: str | None) -> str | None:
    if t is None:
        return None
    try:
        t = t.encode("cp1252").decode("utf-8")
    except UnicodeError:
        pass
    return t.replace("�", "").replace("–", "-").replace("—", "-")


def repair_mojibake(t: Column) -> Column:
    """Re-reads suspicious texts as UTF-8, if that is possible without loss; drops U+FFFD; dashes become hyphens there.
    Other texts never reach Python."""

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(_repaired)

    return F.when(looks_mojibake(t), repair(F.when(looks_mojibake(t), t))).otherwise(t)


def normalized_for_match(t: Column) -> Column:
    """Mojibake repaired, lower case, signs to spaces, white space collapsed."""
    t = repair_mojibake(t)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def fingerprint(t: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def normalized_segment(t: Column) -> Column:
    """Mojibake repaired, lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(repair_mojibake(t), "\n"), strip), lambda s: s != ""), "\n")


def preview(t: Column, most: int = 72) -> Column:
    s = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def folded(t: Column) -> Column:
    """Lower case, a- and o-umlaut as a and o, white space collapsed: phrases are sought in this."""
    return F.translate(fingerprint(t), "äö", "ao")


def phrase_context(t: Column, phrase: str, window: int = 60) -> Column:
    """The first place of a phrase, in any case, with up to window characters on both sides; empty without one."""
    at = F.instr(F.lower(t), phrase.lower())
    begin = F.greatest(F.lit(1), at - window)
    return F.when(at > 0, strip(F.substring(t, begin, at + len(phrase) + window - begin))).when(t.isNotNull(), "")


def wrapped(t: Column, most: int) -> Column:
    """Lines of whole words, each as long as fits into most characters; a longer word has a line of its own."""
    fold = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("current"))

    def add(state: Column, word: Column) -> Column:
        longer = F.concat(state["current"], F.lit(" "), word)
        fits = F.coalesce(F.length(longer) <= most, F.lit(False))
        full = state["current"].isNotNull() & ~fits
        lines = F.when(full, F.concat(state["lines"], F.array(state["current"]))).otherwise(state["lines"])
        return F.struct(lines.alias("lines"), F.when(fits, longer).otherwise(word).alias("current"))

    words = F.filter(F.split(strip(t), r"\s+"), lambda w: w != "")
    return F.aggregate(words, fold, add, lambda s: F.when(s["current"].isNull(), s["lines"]).otherwise(F.concat(s["lines"], F.array(s["current"]))))


def occurrences(t: Column, phrase: str) -> Column:
    """Non-overlapping places of a phrase; 0 for an empty one."""
    if not phrase:
        return F.lit(0)
    return ((F.length(t) - F.length(F.replace(t, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def corrected(t: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in the table's order; each also in capitals where those differ. The table is one constant, so
    that its length doesn't swell plans."""
    pairs = [x for bad, good in table for x in ((bad, good), (bad.upper(), good.upper()))[: 1 + (bad.upper() != bad)]]
    if not pairs:
        return t
    known = F.array(*[F.struct(F.lit(bad).alias("bad"), F.lit(good).alias("good")) for bad, good in pairs])
    return F.aggregate(known, t, lambda s, p: F.replace(s, p["bad"], p["good"]))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once however often f looks at it. f can't call Python."""
    return F.transform(F.array(x), f)[0]


#: Characters that composing can change: below U+0300 nothing composes.
HIGH = r"[^\x00-\x{2FF}]"


def composed(t: Column, high: Column | None = None) -> Column:
    """NFC. Texts without high characters never reach Python; high: a cheaper way to tell whether t has any."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    high = t.rlike(HIGH) if high is None else high
    return F.when(high, compose(F.when(high, t))).otherwise(t)


def finalized(t: Column, corrections: Sequence[tuple[str, str]] = CORRECTIONS, final: Sequence[tuple[str, str]] = FINAL_CORRECTIONS, words: Sequence[tuple[str, str]] = FINAL_WORDS) -> Column:
    """The corrections, then the final ones, then whole words in any case."""
    t = corrected(corrected(t, corrections), final)
    for bad, good in words:
        pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_]){bad}(?![\p{{L}}\p{{N}}_])"
        t = once(t, lambda s: F.when(F.contains(F.lower(s), F.lit(bad)), F.regexp_replace(s, pattern, good)).otherwise(s))  # noqa: B023
    return t


def closed_price(t: Column) -> Column:
    """By line: one that names a price with tax and opens a parenthesis that it doesn't close has it closed."""

    def close(line: Column) -> Column:
        s = strip(line)
        low = F.lower(s)
        unclosed = F.contains(low, F.lit("mk")) & F.contains(low, F.lit("sis.")) & F.contains(s, F.lit("(")) & ~F.contains(s, F.lit(")"))
        return F.when(unclosed, F.concat(F.regexp_extract(line, r"^\s*", 0), s, F.lit(")"), F.regexp_extract(line, r"\s*$", 0))).otherwise(line)

    some = F.contains(t, F.lit("("))
    return F.when(some, F.array_join(F.transform(F.split(t, "\n"), close), "\n")).otherwise(t)


#: Fixed value: control characters but for tab and line ends, and U+FFFD.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]"
#: Two word characters, a hyphen and white space, two word characters.
BROKEN = r"([\p{L}\p{N}_]{2,})-\s+([\p{L}\p{N}_]{2,})"


def cleaned(t: Column, fixes: Sequence[tuple[str, str]] = LITERAL_FIXES, compose: bool = True, **tables) -> Column:
    """finalized; soft hyphens, control characters and U+FFFD dropped; letters composed (NFC); words broken by a hyphen and
    white space joined, at line ends before others, in up to four rounds; the literal fixes; prices closed; stripped.
    Blank texts are left alone. Texts without a hyphen before white space skip the rounds. compose: no where Python can't
    be called, within other functions' arguments."""
    s = F.regexp_replace(F.replace(finalized(t, **tables), F.lit("\u00ad"), F.lit("")), CONTROL, "")
    if compose:
        s = composed(s, t.rlike(HIGH))  # the tables give no high characters

    def joined(s: Column) -> Column:
        for _ in range(4):
            s = F.regexp_replace(F.regexp_replace(s, r"([\p{L}\p{N}_]{2,})-\s*\n\s*([\p{L}\p{N}_]{2,})", "$1$2"), BROKEN, "$1$2")
        return s

    s = once(s, lambda s: F.when(s.rlike(r"-\s"), joined(s)).otherwise(s))
    return F.when(strip(t) == "", t).otherwise(strip(once(corrected(s, fixes), closed_price)))


def cleanup_issues(t: Column, patterns: Sequence[tuple[str, str]] = CLEANUP_ISSUES) -> Column:
    """Names of what a cleaned text shouldn't hold."""
    found = [F.when(t.rlike(CONTROL), F.lit("control_or_replacement_chars")), F.when(F.contains(t, F.lit("\u00ad")), F.lit("soft_hyphen_present"))]
    return F.array_compact(F.array(*found, *[F.when(t.rlike("(?iu)" + p), F.lit(n)) for n, p in patterns]))


def holds(t: Column, markers: Sequence[str], every: bool = False) -> Column:
    """Whether t (upper- or lower-cased as the markers are) has one of the markers, or every one."""
    out = F.lit(every)
    for m in markers:
        out = out & F.contains(t, F.lit(m)) if every else out | F.contains(t, F.lit(m))
    return F.coalesce(out, F.lit(False))


def text_lines(t: Column) -> Column:
    """array<string>: trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"\r\n|[\n\r\x0B\x0C]"), strip), lambda s: s != "")


def first_line(t: Column) -> Column:
    """The first line that isn't blank, trimmed; empty without one."""
    return F.coalesce(F.get(text_lines(t), F.lit(0)), F.lit(""))


def normalized_stars(t: Column) -> Column:
    s = strip(t)
    return F.when(s.rlike("[☆★]"), "***").otherwise(s)


def is_issue_line(t: Column, words: Lexicon = FRONT_PAGE) -> Column:
    return holds(F.upper(t), words.issue)


def is_date_line(t: Column, words: Lexicon = FRONT_PAGE) -> Column:
    return holds(F.upper(t), words.date)


def is_stars_line(t: Column) -> Column:
    """Up to six stars and spaces."""
    return strip(t).rlike(rf"^[{STARS} ]{{1,6}}$")


def is_price_line(t: Column, words: Lexicon = FRONT_PAGE) -> Column:
    """A currency and a tax word, wherever it stands."""
    return F.contains(F.upper(t), F.lit(words.currency)) & holds(F.upper(t), words.tax)


def is_metadata_line(t: Column, words: Lexicon = FRONT_PAGE) -> Column:
    return is_issue_line(t, words) | is_date_line(t, words) | is_stars_line(t) | is_price_line(t, words)


def starts_with_metadata(t: Column, words: Lexicon = FRONT_PAGE) -> Column:
    """Whether one of the first three lines is metadata or only stars."""
    return F.exists(F.slice(text_lines(t), 1, 3), lambda s: is_metadata_line(s, words) | s.rlike(rf"^[{STARS} ]*$"))


def is_page_number(t: Column) -> Column:
    return strip(t).rlike(r"(?iu)^Sivu\s+[0-9]+$")


def is_noise(t: Column, words: Sequence[str] = ("ERISTETTHIN",)) -> Column:
    """A known misreading, or a character (no line end) four times in a row."""
    return holds(F.upper(t), words) | t.rlike(r"(.)\1{3,}")


def normalized_caption(t: Column, words: Lexicon = FRONT_PAGE) -> Column:
    """Corrected, without a label in front, and without a lone word before the word that begins such captions."""
    s = F.regexp_replace(corrected(strip(t), words.corrections), rf"(?iu)^{words.caption_prefix}\s*:?\s*", "")
    return strip(F.regexp_replace(s, rf"^[A-Za-zÅÄÖåäö]+\s+(?={words.caption_anchor}(?![\p{{L}}\p{{N}}_]))", ""))


def looks_like_caption(t: Column, words: Lexicon = FRONT_PAGE) -> Column:
    """25 characters, no headline or metadata marker, and two keywords or the telling pair."""

    def judged(s: Column) -> Column:
        low, up = F.lower(s), F.upper(s)
        hits = sum((F.contains(low, F.lit(k)).cast("int") for k in words.caption_keywords), F.lit(0))
        telling = (hits >= 2) | holds(low, words.caption_pair, every=True)
        return (F.length(s) >= 25) & ~holds(up, words.headline_markers + words.metadata_markers) & telling

    return once(normalized_caption(t, words), judged)


def holds_fragment(t: Column, fragment: str, whole: bool = False) -> Column:
    """Whether t holds a fragment in any case, or has it as a whole word."""
    if whole:
        return t.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){fragment}(?![\p{{L}}\p{{N}}_])")
    return F.contains(F.lower(t), F.lit(fragment.lower()))


def language_priority(primary: Column, extra: Column) -> Column:
    """array<string>: codes in order, the primary first, each once, empty ones left out."""
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(primary), extra), language_code)), lambda c: c != "")


def model_language(t: Column) -> Column:
    code = language_code(t)
    return F.when(code.isin(*MODEL_LANGUAGES), code).otherwise(MODEL_DEFAULT)


def language_code(t: Column) -> Column:
    """Lower case, the part before a region."""
    return F.split_part(F.replace(F.lower(F.trim(t)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
