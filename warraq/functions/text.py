"""Text functions as Column builders: all but canonical composition stay inside the JVM.

Patterns follow the Unicode meaning of a regular expression over code points: a word character is a letter, a number or
the underscore, white space includes U+001C..U+001F. Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import html as html_entities
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"\p{L}\p{N}_"
SPACE = r"(?U)[\s\x1c-\x1f]"
# Forms of links, addresses, mentions, tags, and the characters a cleaned text keeps.
URL = r"(?U)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
EMAIL = rf"[{WORD}.+-]+@[{WORD}-]+\.[a-zA-Z]{{2,}}"
MENTION, HASHTAG = rf"@[{WORD}]+", rf"#[{WORD}]+"
QUOTES = "\"'«»“”"
# Blocks of Arabic script.
ARABIC_BLOCKS = r"\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff"
ARABIC_BLOCK = r"\u0600-\u06ff"
DIACRITICS = r"[\u064b-\u065f\u0610-\u061a\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed]"
ALEF_FORMS = "آأإٱٲٳٴٵ"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷"  # U+06F8 and U+06F9 stay as they are
DIGITS_TO = "012345678901234567"


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE}+", "")


def words(c: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(strip(c), f"{SPACE}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def truthy(*cs: Column) -> Column:
    """The first that is neither null nor empty; the last one whatever it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs[:-1]], cs[-1])


def remove_html(c: Column) -> Column:
    """Text of markup: scripts, styles and templates go with their content, other tags become a space, entities are decoded once."""
    c = F.regexp_replace(c, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", " ")
    return unescaped(c)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html_entities.unescape, na_action="ignore")


def unescaped(c: Column) -> Column:
    """Character references decoded once. The common ones stay in the JVM; only a text with another leaves it."""
    common = c
    for name, value in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        common = F.replace(common, F.lit(name), F.lit(value))
    return F.when(c.rlike(r"&(?!(?:nbsp|lt|gt|quot|#39|apos|amp);)#?[a-zA-Z0-9]"), _unescape(c)).otherwise(common)


def digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


def clean(c: Column, keep_quotes: bool = True, mentions: bool = True, hashtags: bool = False, numbers: bool = False, html: bool = True) -> Column:
    """Cleaned text: markup, links, addresses, mentions, marks to spaces, runs of three or more of a character to two. Null gives ''."""
    c = F.coalesce(c, F.lit(""))
    if html:
        c = F.when(c.contains("<") | c.contains("&"), remove_html(c)).otherwise(c)
    c = F.regexp_replace(c, URL, " ")
    c = F.regexp_replace(c, EMAIL, " ")
    if mentions:
        c = F.regexp_replace(c, MENTION, " ")
    if hashtags:
        c = F.regexp_replace(c, HASHTAG, " ")
    c = digits(c)
    if numbers:
        c = F.regexp_replace(c, r"\p{Nd}+", " ")
    c = F.regexp_replace(c, rf"(?U)[^{WORD}\s\x1c-\x1f{QUOTES if keep_quotes else ''}]", " ")
    c = F.regexp_replace(c, r"(?d)(.)\1{2,}", "$1$1")
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize(c: Column, alef: bool = True, ya: bool = False, ta_marbuta: bool = False, diacritics: bool = True, tatweel: bool = True, compose: bool = True) -> Column:
    """Normal spelling of Arabic. Null gives ''. Only a text that may need composing leaves the JVM."""
    c = F.coalesce(c, F.lit(""))
    if compose:
        c = F.when(c.rlike(r"[\u0300-\u036f\u0653-\u0655]"), _nfc(c)).otherwise(c)
    if diacritics:
        c = F.regexp_replace(c, DIACRITICS, "")
    if tatweel:
        c = F.replace(c, F.lit("ـ"), F.lit(""))
    if alef:
        c = F.translate(c, ALEF_FORMS, "ا" * len(ALEF_FORMS))
    if ya:
        c = F.translate(c, "ى", "ي")
    return F.translate(c, "ة", "ه") if ta_marbuta else c


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[a-zA-Z0-9{ARABIC_BLOCKS}]+"), F.lit(0))


def without_stopwords(tokens: Column, stop: Sequence[str]) -> Column:
    """Tokens not in the list, repetitions kept."""
    return F.filter(tokens, lambda t: ~t.isin(list(stop)))


def script_share(c: Column, blocks: str = ARABIC_BLOCKS) -> Column:
    """Characters of the blocks among all characters; null for an empty text."""
    return F.try_divide(F.regexp_count(c, F.lit(f"[{blocks}]")), F.length(c))


def is_script(c: Column, least: float = 0.40, blocks: str = ARABIC_BLOCKS) -> Column:
    return F.coalesce(script_share(c, blocks) >= least, F.lit(False))


def is_boilerplate(c: Column, keywords: Sequence[str], below: int = 250, hits: int = 2) -> Column:
    n = F.size(F.filter(lit_array(keywords), lambda k: F.contains(c, k)))
    return F.when(F.coalesce(c, F.lit("")) == "", True).otherwise((F.length(c) < below) & (n >= hits))


# Affixes of the light stemmers, in the order they are tried.
PREFIXES_A = ["ال", "وال", "بال", "فال", "لل"]
PREFIXES_B = ["وال", "بال", "فال", "كال", "لل", "ال", "و", "ب", "ف"]
SUFFIXES = ["ين", "ون", "ات", "يه", "ية", "ها", "هم", "نا", "ي"]


def light_stem(w: Column, prefixes: Sequence[str] = PREFIXES_A, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The first prefix that leaves three letters goes, then the first suffix that leaves two."""
    w = F.translate(w, "ةأإآ", "هااا")
    w = F.regexp_replace(w, "(?s)^(?:" + "|".join(f"{p}(?=...)" for p in prefixes) + ")", "")
    return F.regexp_replace(w, "(?s)(?<=..)(?:" + "|".join(suffixes) + r")\z", "")


def fingerprint(c: Column) -> Column:
    return F.md5(F.lower(strip(F.regexp_replace(c, f"{SPACE}+", " "))))


def shingles(c: Column, size: int = 3) -> Column:
    """Distinct runs of `size` words; fewer words make one run."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
        return F.when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(every))

    return F.transform(F.array(words(c)), runs)[0]  # the words are bound once, as an array of one


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def share_entities(a: Column, b: Column) -> Column:
    """Whether two entity lists meet: an equal one, or one that holds another, both longer than three without the article."""
    bare = lambda x: strip(F.replace(x, F.lit("ال"), F.lit("")))
    held = F.exists(F.transform(a, bare), lambda x: F.exists(F.transform(b, bare), lambda y: (F.length(x) > 3) & (F.length(y) > 3) & (F.contains(x, y) | F.contains(y, x))))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (F.arrays_overlap(a, b) | held), F.lit(False))


def domains(locations: Column, title: Column, gazetteer: dict[str, Sequence[str]]) -> Column:
    """The gazetteer's domains met by a row's places and the words of its title."""
    seen = F.array_union(F.transform(F.coalesce(locations, F.array().cast("array<string>")), F.lower), words(F.lower(F.coalesce(title, F.lit("")))))
    return F.filter(F.array(*[F.when(F.arrays_overlap(seen, lit_array(list(t))), F.lit(d)) for d, t in gazetteer.items()]), lambda d: d.isNotNull())


def geo_conflict(a: Column, b: Column) -> Column:
    """Of two domain lists: each has one the other lacks."""
    return F.exists(a, lambda d: ~F.array_contains(b, d)) & F.exists(b, lambda d: ~F.array_contains(a, d))


def title_words(title: Column, ignored: Sequence[str]) -> Column:
    w = F.filter(words(F.lower(F.coalesce(title, F.lit("")))), lambda x: F.length(x) > 2)
    w = F.transform(w, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\"«»“”']+|[\"«»“”']+$", ""), "^:+|:+$", ""))
    return F.array_except(w, lit_array(ignored))


def title_conflict(a: Column, b: Column) -> Column:
    """Of two word lists (title_words): both there, and no word or stem in common."""
    stem = lambda x: light_stem(x)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b) & ~F.arrays_overlap(F.transform(a, stem), F.transform(b, stem))


def marker_count(c: Column, markers: Sequence[str]) -> Column:
    return F.size(F.filter(lit_array(markers), lambda m: F.contains(c, m)))


def has_marker(c: Column, markers: Sequence[str]) -> Column:
    return F.exists(lit_array(markers), lambda m: F.contains(c, m))


def without_sub_entities(a: Column) -> Column:
    """Entities none of the others contains, longest first, then by text."""
    d = F.array_distinct(a)
    kept = F.filter(d, lambda i: ~F.exists(d, lambda x: (x != i) & F.contains(x, i)))
    keyed = F.transform(kept, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def routed(spans: Column, group: str) -> Column:
    """The words of one group of spans (array of struct entity_group, word) without the marks of word pieces; short ones are left out."""
    hits = F.transform(F.filter(spans, lambda e: e["entity_group"] == group), lambda e: strip(F.replace(e["word"], F.lit("##"), F.lit(""))))
    return without_sub_entities(F.filter(hits, lambda w: F.length(w) > 2))


def loaded_ratio(tokens: Column, lexicon: dict[str, float]) -> Column:
    """Weight of the lexicon's phrases met (greedy, longest first, not overlapping) per stemmed token; 0 without tokens.

    Keys of `lexicon` are stemmed phrases, words joined by one space.
    """
    # the stems of all tokens in a few passes over the joined text, instead of some for every token
    joined = F.translate(normalize(F.array_join(tokens, " "), compose=False), "ةأإآ", "هااا")
    joined = F.regexp_replace(joined, "(?<=^| )(?:" + "|".join(f"{p}(?=[^ ]{{3}})" for p in PREFIXES_B) + ")", "")
    joined = F.regexp_replace(joined, "(?<=[^ ][^ ])(?:" + "|".join(SUFFIXES) + ")(?= |$)", "")
    joined = F.trim(F.regexp_replace(joined, " {2,}", " "))
    phrases = sorted(lexicon, key=lambda p: (-len(p.split()), p))
    pattern = "(?<=^| )(?:" + "|".join("\\Q" + p + "\\E" for p in phrases) + ")(?= |$)"
    weights = F.create_map(*[x for p in phrases for x in (F.lit(p), F.lit(float(lexicon[p])))])

    def share(stems: Column) -> Column:
        met = F.regexp_extract_all(stems, F.lit(pattern), F.lit(0))
        total = F.aggregate(F.transform(met, lambda m: F.coalesce(F.try_element_at(weights, m), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        count = F.when(stems == "", 0).otherwise(F.regexp_count(stems, F.lit(" ")) + 1)
        return F.coalesce(F.try_divide(total, count), F.lit(0.0))

    return F.transform(F.array(joined), share)[0]  # bound once, as an array of one


def head_tail(c: Column, most: int = 200, each: int = 100) -> Column:
    w = words(c)
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, each), " "), F.lit(" ... "), F.array_join(F.slice(w, -each, each), " "))).otherwise(c)


SEPARATOR = " [SEP] "


def split_title(c: Column, default_title: str = "") -> Column:
    """struct(title, content): two parts around the separator, else all of it as content."""
    p = F.split(c, r" \[SEP\] ")
    return F.when(F.size(p) == 2, F.struct(p[0].alias("title"), p[1].alias("content"))).otherwise(F.struct(F.lit(default_title).alias("title"), c.alias("content")))


def mapped(c: Column, pairs: dict[str, int]) -> Column:
    """A label's code; null for a label outside the map."""
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])[c]


# Codes of the label sets.
PROPAGANDA_CODES = {"neutral": 0, "loaded_language": 1, "doubt_casting": 1, "propaganda": 1}
STATEMENT_CODES = {"reporting": 0, "opinion": 1, "speculation": 1}
ATTRIBUTION_CODES = {"supported_claim": 0, "unsupported_claim": 1}


def source_label(c: Column) -> Column:
    """A free label as neutral or propaganda. Only what names propaganda, or says yes, is it; null and unknown labels are neutral."""
    s = F.coalesce(F.lower(strip(c)), F.lit(""))
    yes = s.isin("true", "1", "yes", "propaganda") | (s.contains("propagandistic") & ~s.contains("non-propagandistic"))
    return F.when(yes, "propaganda").otherwise("neutral")


def labels_of_source(c: Column) -> Column:
    """struct(propaganda, statement, attribution): the other two labels follow from the first."""
    p = source_label(c)
    return F.struct(p.alias("propaganda"), F.when(p == "propaganda", "opinion").otherwise("reporting").alias("statement"), F.when(p == "propaganda", "unsupported_claim").otherwise("supported_claim").alias("attribution"))


def gold_labels(labels: Column, first_only: bool = False) -> Column:
    """One gold label from a list: distinct techniques joined by ' | ', or the first one; Neutral for none."""
    t = F.array_distinct(F.filter(F.transform(labels, strip), lambda x: ~F.lower(x).isin("", "none", "false", "no technique") & x.isNotNull()))
    t = F.transform(t, lambda x: F.when(F.lower(x) == "true", "Propaganda").otherwise(x))
    return F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, "Neutral").otherwise(t[0] if first_only else F.array_join(t, " | "))


def gold_label(c: Column) -> Column:
    """`gold_labels` of one label."""
    s = strip(c)
    none = F.coalesce(F.lower(s).isin("", "none", "false", "no technique"), F.lit(True))
    return F.when(none, "Neutral").when(F.lower(s) == "true", "Propaganda").otherwise(s)


def says_propaganda(c: Column) -> Column:
    """Whether a generated text's verdict, or else its first line, is anything but neutral or nothing."""
    verdict = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)verdict\s*:\s*([{WORD}]+)", 1)
    raw = F.when(verdict != "", verdict).otherwise(F.coalesce(c, F.lit("")))
    return ~F.lower(strip(F.substring_index(strip(raw), "\n", 1))).isin("neutral", "", "none")


def long_enough(c: Column, least: int = 10) -> Column:
    """Whether a text has `least` characters without outer white space; a null has none."""
    return F.coalesce(F.length(strip(c)) >= least, F.lit(False))


def query_tokens(query: str, stop: Sequence[str]) -> Column:
    """The tokens of a search text as an article's text gives them: cleaned, normal spelling, without the words of the list."""
    q = unicodedata.normalize("NFC", query or "")
    return without_stopwords(tokenize(normalize(clean(F.lit(q), html=False), compose=False)), stop)


# Fixed value: the mark before a final verdict.
FINAL_MARKER = r"التقييم\s*النهائي\s*[:：]?"


def parse_output(c: Column) -> Column:
    """propaganda, neutral or unknown, from the first line after the last final marker."""
    tail = F.element_at(F.split(F.coalesce(c, F.lit("")), FINAL_MARKER), -1)
    line = F.element_at(F.split(F.lower(strip(tail)), r"\r\n|[\n\r]"), 1)
    return F.when(line.contains("propaganda"), "propaganda").when(line.contains("neutral"), "neutral").otherwise("unknown")


def parse_prediction(c: Column, canonical: dict[str, str]) -> Column:
    """struct(label, format_matched) of a generated verdict and technique."""
    verdict = F.lower(F.regexp_extract(c, rf"(?i)verdict\s*:\s*([{WORD}]+)", 1))
    matched = verdict.isin("propaganda", "neutral")
    raw = strip(F.regexp_extract(c, r"(?i)technique\s*:\s*([^\n]+)", 1))
    raw = strip(F.regexp_replace(raw, r"^\.+|\.+$", ""))
    known = F.create_map(*[x for k, v in canonical.items() for x in (F.lit(k.lower()), F.lit(v))]) if canonical else None
    parts = F.filter(F.transform(F.split(raw, r"\|"), strip), lambda p: p != "")
    if known is not None:
        parts = F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, F.lower(p)), p))
    label = F.when(verdict == "neutral", "Neutral").when(F.size(parts) > 0, F.array_join(parts, " | ")).when(verdict == "propaganda", "Propaganda").otherwise("Neutral")
    return F.struct(label.alias("label"), matched.alias("format_matched"))


def prompt(title: Column, text: Column, ratio: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nText: "), text, F.lit("\nLoaded words: "), F.format_string("%.4f", ratio))


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    turns = [turn("system", system), turn("user", user)]
    return F.array(*turns, *([turn("assistant", assistant)] if assistant is not None else []))


def corrected(correct: Column, correction: Column, original: Column) -> Column:
    """The correction where the original was judged wrong and a correction is there."""
    return F.when((correct == F.lit(False)) & (F.nullif(correction, F.lit("")).isNotNull()), correction).otherwise(original)


def strip_hook(c: Column) -> Column:
    """At most two leading sentences that ask or are short go, if more than 80 characters stay."""
    t = strip(c)
    s = F.split(t, rf"(?<=[.!؟?]){SPACE}+")
    weak = lambda x: strip(x).rlike(r"[؟?]\z") | (F.length(strip(x)) < 25)
    one, two = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(2))
    skip = F.when(~weak(one), 0).when(two.isNull() | ~weak(two), 1).otherwise(2)
    rest = strip(F.array_join(F.slice(s, skip + 1, F.greatest(F.size(s), F.lit(1))), " "))
    return F.when(F.length(rest) > 80, rest).otherwise(t)


# How far from the present a summary's years may lie, its longest length, the length under which it must not ask.
YEARS_BACK, YEARS_AHEAD, LONGEST, ASKING = 5, 2, 600, 200
#: Lines of a list: a number with its mark, or a lone dash.
_NUMBERED, _DASH = r"(?:^|\n)\s*\d+\s*[.\-:]", r"(?:^|\n)\s*[ـ\-]\s*(?:\n|$)"


def is_degenerate(c: Column, year: int) -> Column:
    """A summary that asks, lists, names years far from `year`, or is empty or too long."""
    s = strip(F.coalesce(c, F.lit("")))
    years = F.transform(F.regexp_extract_all(s, F.lit(rf"(?<![{WORD}])([12]\d{{3}})(?![{WORD}])"), F.lit(1)), lambda y: y.cast("int"))
    far = F.exists(years, lambda y: ~y.between(year - YEARS_BACK, year + YEARS_AHEAD))
    asks = s.rlike(r"[؟?]\z") | s.rlike("[؟?]") & (F.length(s) < ASKING)
    return (F.coalesce(c, F.lit("")) == "") | asks | s.rlike(_NUMBERED) | s.rlike(_DASH) | far | (F.length(s) > LONGEST)


def tidy_summary(c: Column, articles: Column) -> Column:
    """A summary without leading dashes, markup, lone dashes, numbered headings and blank lines; one of several articles is a list item."""
    s = strip(F.regexp_replace(strip(c), r"^[\s\-ـ]+", ""))
    s = F.when(articles >= 3, F.concat(F.lit("- "), s)).otherwise(s)
    s = strip(F.regexp_replace(s, "<[^>]+>", ""))
    s = F.regexp_replace(s, _DASH, "\n")
    s = F.regexp_replace(s, r"(?:^|\n)\s*\d+\s*[.\-:]{1,2}\s*[^\n]*?:\s*", "\n")
    return strip(F.regexp_replace(s, r"\n{2,}", "\n"))


def cut_at_space(c: Column, most: int) -> Column:
    """At most `most` characters, cut back to the last space."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*\z", "")).otherwise(head))


def hours(window: str) -> int:
    """'3d' -> 72, '12h' -> 12."""
    n = int("".join(ch for ch in window if ch.isdigit()))
    return n * 24 if window.endswith("d") else n


def parse_time(c: Column, default: Column | None = None) -> Column:
    """A feed's or ISO time as timestamp; the default where none can be read."""
    rfc = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]+,\s*", ""), r"\b(GMT|UTC|Z)$", "+0000")
    tries = [F.try_to_timestamp(rfc, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")] + [F.try_to_timestamp(c)]
    return F.coalesce(*tries, *([default] if default is not None else []))


def without_suffix(title: Column) -> Column:
    """A title without its last ' - suffix'."""
    return F.regexp_replace(title, r"(?s) - (?!.* - ).*\z", "")
