"""Consistent text by look-alike skeletons.

`skeleton` decomposes a text, replaces every character by its prototype from the look-alike table and decomposes again;
texts with one skeleton look the same. `consistent` is the readable form within a text's class of equal skeletons: each
character of a word is exchanged for the common letter of the word's script with the same prototype, split letters are
joined, characters without a look dropped. A field is faulty if it is not that form; both forms must have one skeleton.
`reading` is the form comparisons use.

Defined results: null -> null; "" -> ""; a text without faults comes back as it is, with changed = false. Words wholly in
another script, vowel signs, elongation, Arabic-Indic digits and the spelling variants of Arabic stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.llm import looks
from warraq.runtime import bounded_broadcast, cut

#: A word with one of these is of another language in Arabic script and keeps its letters.
ARABIC_FOREIGN = "پچژگٹڈڑںےۆێڕڵ"
_DIGITS = {0x6F0 + i: 0x660 + i for i in range(10)}

#: Characters that need no look: ASCII, Latin letters, Arabic letters, vowel signs, digits and usual marks.
_CLEAN = r"\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u017f\u060c\u061b\u061f\u0621-\u063a\u0640-\u0652\u0660-\u066c\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac"
_SUSPECT = re.compile(f"[^{_CLEAN}]")
_MARKS = r"\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670"
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}ـ])*")
#: A character with the marks after it, of which one at least may join it.
_MARKED = re.compile(r"[^\u0300-\u036f\u064b-\u065f][\u064b-\u0652]*[\u0300-\u036f\u0653-\u065f][\u0300-\u036f\u064b-\u065f]*")
_DROPPED = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0001-\U000e01ef]")
_SPACES = re.compile(r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\u0085\u2028\u2029]")
_FORMS = re.compile(r"[\ufb00-\ufdef\ufe70-\ufefc\uff01-\uffee\U0001d400-\U0001d7ff\u2011]")
#: Letters that may look like those of another script: all but Latin and Arabic ones.
_OTHER_SCRIPT = re.compile(r"[\u0250-\u02af\u0370-\u05ff\u0780-\u08ff\u0900-\u1fff\u2c00-\u2dff\ua000-\uabff\U00010000-\U0001d3ff\U0001d800-\U0001efff]")
#: Letters of Arabic script beyond those of Arabic.
_OTHER_ARABIC = re.compile(r"[\u063b-\u063f\u066e\u066f\u0671-\u06d5\u06ee-\u06ff\u0750-\u077f\u08a0-\u08c7]")
_NOT_ARABIC = re.compile(r"[^\u0600-\u08ff]+")
_EMOJI = re.compile(r"[\u2600-\u27bf\ufe0f\U0001f000-\U0001faff]")
_SIGNS = dict.fromkeys([*range(0x64B, 0x653), 0x640])
_SIGN = re.compile(r"[\u064b-\u0652\u0640]")


def _form(m: re.Match) -> str:
    c = m[0]
    d = unicodedata.normalize("NFKC", c)
    if d[:1] == " " and len(d) > 1:  # an isolated vowel sign: NFKC puts a space before it
        return d[1:]
    return "-" if d == "\u2010" else d


def _join(m: re.Match) -> str:
    c = m[0]
    d = unicodedata.normalize("NFC", c)
    return d if len(d) < len(c) else c  # only joins; a mere change of order of the signs is no fault


def _word(m: re.Match) -> str:
    """A word of several scripts in one: Latin if it has Latin letters and the others' looks allow it, else the script of most letters."""
    w = m[0]
    if w.isascii():
        return w
    count = Counter(looks.script(c) for c in w if c.isalpha() and c != "ـ")
    odd = count["LATIN"] and next((c for c in w if 0x250 <= ord(c) < 0x2B0), None)  # phonetic letters are Latin by name
    if "ARABIC" in count:  # particles of Arabic may be written on to a foreign word
        return _NOT_ARABIC.sub(_word, w) if len(count) > 2 or odd else w
    if len(count) < 2 and not odd:
        return w
    first = ["LATIN"] if "LATIN" in count else []
    for k in [*first, *sorted(count, key=lambda k: (-count[k], k))]:
        foreign = {c for c in w if c.isalpha() and (looks.script(c) != k or 0x250 <= ord(c) < 0x2B0)}
        to = {c: looks.home(c, k) for c in foreign}
        if all(to.values()):
            return "".join(to.get(c) or c for c in w)
    k = (first or [max(sorted(count), key=lambda k: count[k])])[0]
    return "".join((looks.home(c, k) or c) if c.isalpha() and looks.script(c) != k else c for c in w)


@lru_cache(10_000)
def _arabic_letter(c: str) -> str:
    return (looks.home(c, "ARABIC") or c) if _OTHER_ARABIC.match(c) and c not in ARABIC_FOREIGN else c


def _arabic_word(m: re.Match) -> str:
    w = m[0]
    return w if any(c in ARABIC_FOREIGN for c in w) else "".join(map(_arabic_letter, w))


def _keep_in_emoji(m: re.Match) -> str:
    s, i = m.string, m.start()
    if m[0] == "\ufe0f":  # the mark that a sign is shown as a picture
        return m[0] if i and (_EMOJI.match(s[i - 1]) or s[i - 1] in "\u00a9\u00ae\u203c\u2049\u2122" or 0x2139 <= ord(s[i - 1]) < 0x2C00) else ""
    return m[0] if m[0] == "\u200d" and i and _EMOJI.match(s[i - 1]) and i + 1 < len(s) and _EMOJI.match(s[i + 1]) else ""


def consistent(text: str | None) -> str | None:
    """The one consistent form of a text; the text itself if it holds no fault."""
    if not text or not _SUSPECT.search(text):
        return text
    t = _DROPPED.sub(_keep_in_emoji, text)
    t = _SPACES.sub(" ", t)
    t = _FORMS.sub(_form, t)
    t = _MARKED.sub(_join, t)
    if _OTHER_ARABIC.search(t):
        t = _WORD.sub(_arabic_word, t)
        t = t.translate(_DIGITS)
    if _OTHER_SCRIPT.search(t):
        t = _WORD.sub(_word, t)
    return t


def skeleton(text: str | None) -> str | None:
    """Decompose, replace every character by its prototype, decompose again. Not for display."""
    if not text:
        return text
    t = _FORMS.sub(_form, _SPACES.sub(" ", _DROPPED.sub("", text)))
    t = unicodedata.normalize("NFKD", t).translate(looks.by_code())
    return unicodedata.normalize("NFKD", t)


def reading(text: str | None) -> str | None:
    """The reading form: consistent, lower case, without vowel signs and elongation."""
    if not text:
        return text
    t = consistent(text).lower()
    return t.translate(_SIGNS) if _SIGN.search(t) else t


@F.pandas_udf(T.StringType())
def _consistent_udf(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


@F.pandas_udf(T.StringType())
def _skeleton_udf(s: pd.Series) -> pd.Series:
    return s.map(skeleton, na_action="ignore")


def in_class(text: str | None) -> str | None:
    """The consistent form of a text that is not in it, both having one skeleton; else None."""
    c = consistent(text)
    return c if c != text and skeleton(c) == skeleton(text) else None


@F.pandas_udf(T.StringType())
def _in_class_udf(s: pd.Series) -> pd.Series:
    return s.map(in_class, na_action="ignore")


def consistent_column(c: Column) -> Column:
    looks.ensure(SparkSession.active())
    return _consistent_udf(c)


def skeleton_column(c: Column) -> Column:
    looks.ensure(SparkSession.active())
    return _skeleton_udf(c)


#: The JVM-side gate: only texts with a character outside the harmless ones go through Python.
GATE = f"[^{_CLEAN}]"  # the escapes mean the same in Java


def faulty_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row (id, field_name, original, consistent) per field whose value changes; other columns are ignored.

    Nulls and empty values give no row; ids may repeat, each row stands for itself. The texts never leave the mapper: no shuffle.
    """
    arms = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("original")) for f in fields])
    long = df.select(F.col(id_col).alias("id"), F.explode(F.filter(arms, lambda a: a["original"].rlike(GATE))).alias("v")).select("id", "v.*")
    looks.ensure(df.sparkSession)
    return long.withColumn("consistent", _in_class_udf("original")).filter("consistent is not null")


def same_looking(df: DataFrame, field: str) -> DataFrame:
    """Groups of different values of `field` with one skeleton: (skeleton_hash, n_forms, n_rows, example).

    Rows are first combined by hashes of skeleton and value, so a value held by a third of the rows counts as one and no long
    text moves; only the texts of found groups are read again, for the example. Nulls are left out, empty values form no group.
    """
    v = df.filter(F.col(field).isNotNull()).select(F.col(field).alias("value"))
    s = skeleton_column(F.col("value"))  # of all values: even "1" and "l" look alike
    form = F.unhex(F.sha2("value", 256))
    forms = cut(v.select(F.sha2(s, 256).alias("skeleton_hash"), form.alias("form")).groupBy("skeleton_hash", "form").agg(F.count("*").alias("n")), "forms")
    g = cut(forms.groupBy("skeleton_hash").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_rows")).filter("n_forms > 1"), "groups")
    of_groups = cut(forms.select("skeleton_hash", "form").join(g, "skeleton_hash", "left_semi"), "forms-of-groups")
    least = v.withColumn("form", form).join(bounded_broadcast(of_groups), "form").groupBy("skeleton_hash").agg(F.min("value").alias("example"))
    return g.join(least, "skeleton_hash")
