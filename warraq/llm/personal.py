"""Personal data in free text: e-mail addresses, phone and identity numbers, street addresses, names of persons.

Shapes alone do not tell an invoice number from a phone number, or a verb from a family name. As in information-theoretic
sanitisation, counts of co-occurrence over the whole corpus estimate how strongly a term reveals a protected entity. The
disclosure of a term is the pointwise mutual information of term and entity as a share of the entity's own information,
log(p(entity | term) / p(entity)) / log(1 / p(entity)): 0 for a term that says nothing, 1 for one that always means it. Terms are
the words beside given names (entity: a name of a person) and the words before a number (entity: a phone or identity
number; estimated from numbers of unmistakable form). A candidate is protected data when its term's disclosure reaches the
threshold; it is then generalised to its type, as a placeholder, and the rest of the text stays.

The corpus is read twice: once for the counts and for all that needs none (addresses of mail, numbers, street addresses),
once for names, when the given names that titles reveal are known.

Defined results: null and empty texts hold nothing; an item is reported once per text, type and string; overlapping finds
give way to the longer, then the earlier; repeated rows give repeated finds; an empty table gives empty results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.llm import ship
from warraq.runtime import bounded_broadcast, cut

#: Least disclosure of a family name, as a share of the information that a word is part of a name.
NAME_DISCLOSURE = 0.65
#: A label before sure numbers of a type in this share of its places is of that type. Shares are smoothed towards those of the
#: shorter label, and of the label's words, as if these had been seen so many times more.
LABEL_SHARE, SEEN_MORE = 0.04, 2.0
#: A word after titles so often, and in this share of its places, is a given name.
GIVEN_COUNT, GIVEN_SHARE = 5, 0.02

# Words before a name that are no part of it.
TITLES = {"السيد", "السيدة", "المهندس", "المهندسة", "الدكتور", "الدكتورة", "الأستاذ", "الأستاذة", "د.", "أ.", "م.", "mr.", "ms.", "mrs.", "dr.", "mme", "m.", "mlle", "prof.", "للسيد", "للدكتور", "للمهندس", "للسيدة", "والسيد", "والمهندس", "ود.", "والدكتور", "mr", "ms", "mrs", "dr"}
# Heads of streets and bodies named after persons.
BODIES_BEFORE = {"شارع", "طريق", "زقاق", "جادة", "حي", "مستشفى", "مركز", "مدرسة", "جامعة", "مؤسسة", "شركة", "جمعية", "صحيفة", "نادي", "سوق", "محطة", "مزارع", "مجمع", "مشروع", "جسر", "مطار", "مسجد", "ساحة", "ملعب", "معهد", "قاعة", "جائزة", "منظمة", "حديقة", "rue", "avenue", "boulevard", "école", "hôpital", "plan", "marché", "dépôt", "fondation", "prix", "place", "lycée"}
BODIES_AFTER = {"street", "road", "avenue", "lane", "close", "way", "drive", "hospital", "foundation", "school", "university", "plan", "depot", "estate", "market", "center", "centre", "company", "institute", "college", "prize", "award", "library", "bridge", "square", "park", "stadium", "trust", "charity", "mosque", "airport"}
# Words of labels of numbers, as a start for labels that stand before no sure number.
PHONE_WORDS = {"هاتف", "الهاتف", "جوال", "الجوال", "واتساب", "الاتصال", "اتصل", "موبايل", "رقمي", "tel", "phone", "mobile", "call", "tél", "téléphone", "appelez", "appeler", "whatsapp"}
ID_WORDS = {"هوية", "الهوية", "جواز", "الجواز", "شخصية", "الشخصية", "passport", "passeport", "identité", "id", "الوطني", "القومي", "الإقامة", "إقامة", "ssn", "security", "sécurité", "insurance", "licence", "license"}

_MAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]|[\[(]dot[\])])*[ ]?(?:@|[\[(]at[\])])[ ]?[A-Za-z0-9-]+(?:(?:\.|[ ]?[\[(]dot[\])][ ]?)[A-Za-z0-9-]+)+", re.I)
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_NUMBER = re.compile(r"(?<![\w@/.,:-])(?:[+(]{1,2})?(?:[A-Z]{1,2}[ -]?)?\d(?:[A-Z]{2}(?=\d))?(?:[ .()-]{0,2}\d(?:[A-Z]{2}(?=\d))?)*(?![\w/]|[.,]\d)")
#: A label stands in the line of its number, after the number before.
_AFTER_NUMBER = re.compile(r"(?s)^.*[\d\n]")
#: What every number of interest holds; quick to look for.
_LONG_NUMBER = re.compile(r"\d(?:[ .()-]{0,2}[A-Z]{0,2}\d){4}")
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\.?|\S")
_LETTERS = re.compile(r"[^\W\d_]+")
_AR_ELEMENT = r"(?:الحي|حي|شارع|طريق|زقاق|جادة|بناية|بناء|عمارة|ممر|درب|ساحة|برج)"
_AR_SEP = r"(?:\s*،\s*|\s+[-–]\s+|\s*,\s*)"
_ADDRESS_AR = re.compile(rf"(?<!\w)(?:\d+[A-Za-zأ-ي]?\s+)?{_AR_ELEMENT}\s[^،,\n.؟!]{{1,40}}?(?:{_AR_SEP}[^،,\n.؟!]{{1,40}}?){{0,5}}?{_AR_SEP}(?:مدينة|بلدة|قرية|ناحية|ضاحية|بلدية)\s+(?P<town>[^\W\d_]+)(?:\s+(?P<more>[^\W\d_]+))?(?P<code>{_AR_SEP}?\s*(?:الرمز البريدي|ص\.\s?ب\.?)\s*:?\s*\d+)?")
_ADDRESS_EN = re.compile(r"(?<!\w)(?:(?:Flat|Apt|Apartment|Unit|Suite)\.? \w+, )?\d+[A-Za-z]?,? (?:[A-Z][\w'’-]+ ){1,3}(?:Street|St|Lane|Road|Rd|Avenue|Ave|Close|Way|Drive|Court|Square|Terrace|Row|Crescent|Place|Hill|Gardens|Grove|Walk)\.?,? (?:(?:Flat|Apt|Apartment|Unit|Suite)\.? \w+, )?(?P<town>[A-Z][\w'’-]+)(?: (?P<more>[A-Z][a-z'’-]+))?(?P<code>,? [A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}|,? \d{5}(?!\d))?")
_ADDRESS_FR = re.compile(r"(?<!\w)\d+(?: bis| ter)?,? (?:rue|boulevard|avenue|chemin|impasse|place|allée|quai|route|cours|square) (?:de la |de l['’]|du |des |de |d['’])?[A-ZÀ-Ý][\w'’-]+(?: [\w'’-]+){0,3}, (?:\d{5} )?(?P<town>[A-ZÀ-Ý][\w'’-]+)(?: (?P<more>[A-ZÀ-Ý][\w'’-]+))?(?P<code>(?!x)x)?")


#: Each form of address with strings of which it holds one.
_ADDRESSES = [
    (_ADDRESS_AR, ["مدينة ", "بلدة ", "قرية ", "ناحية ", "ضاحية ", "بلدية "]),
    (_ADDRESS_EN, [" Street", " St", " Lane", " Road", " Rd", " Ave", " Close", " Way", " Drive", " Court", " Square", " Terrace", " Row", " Crescent", " Place", " Hill", " Gardens", " Grove", " Walk"]),
    (_ADDRESS_FR, ["rue ", "boulevard ", "avenue ", "chemin ", "impasse ", "place ", "allée ", "quai ", "route ", "cours ", "square "]),
]


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def sure_type(s: str) -> str:
    """The type of a number of unmistakable form, else ''."""
    if any("A" <= c <= "Z" for c in s):
        return "id_number"
    d = "".join(str(int(c)) for c in s if c.isdigit())
    if s[0] in "+(" or d.startswith("00") and d[2:3] not in ("0", "") and len(d) >= 11 and not s[1:2].isspace():
        return "phone"
    return ""


def numbers(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end, string, labels): numbers of seven to fifteen digits outside links and addresses of mail, with the words before."""
    if not _LONG_NUMBER.search(text):
        return
    hidden = "".join(" " * len(p) if k % 2 else p for k, p in enumerate(re.split(f"({_MAIL.pattern}|{_LINK.pattern})", text))) if "@" in text or "http" in text or "www." in text or "at]" in text or "at)" in text else text
    for m in _NUMBER.finditer(hidden):
        s = m[0]
        n = _digits(s)
        if n < 7 and not (n >= 5 and any("A" <= c <= "Z" for c in s)) or n > 15:
            continue
        before = [w.casefold() for w in _LETTERS.findall(_AFTER_NUMBER.sub("", hidden[max(0, m.start() - 60) : m.start()]))[-4:]]
        hint = next(("phone" if w in PHONE_WORDS else "id_number" for w in reversed(before) if w in PHONE_WORDS or w in ID_WORDS), "")
        yield m.start(), m.end(), s, [" ".join(before[-2:]), before[-1] if before else "", hint]


def addresses(text: str) -> Iterator[tuple[int, int, str, int, str]]:
    """(start, end without the second word of the town, second word, end with it, first word)."""
    for rx, some in _ADDRESSES:
        if not any(w in text for w in some):
            continue
        for m in rx.finditer(text):
            start = m.start()
            if m["code"]:
                yield start, m.end(), "", m.end(), m["town"]
            elif m["more"]:
                yield start, m.end("town"), m["more"], m.end("more"), m["town"]
            else:
                yield start, m.end("town"), "", m.end("town"), m["town"]


def bare(token: str) -> str:
    return token.casefold().rstrip(".")


def is_given(tokens: list[str], i: int, given: frozenset[str] | set[str]) -> int:
    """How many tokens from i make a given name: 0, 1, or 2 for a name in two words."""
    t = tokens[i]
    k = bare(t)
    if k in ("عبد", "abd", "abdul", "abdel") and i + 1 < len(tokens) and tokens[i + 1][0].isalpha():
        return 2
    return 1 if k in given and not is_initial(t) else 0


def is_initial(t: str) -> bool:
    return len(t) == 2 and t[1] == "." and t[0].isalpha()


class Starts(dict):
    """Whether a token may begin a given name of a set, remembered per token."""

    def __init__(self, given: frozenset[str] | set[str]) -> None:
        super().__init__()
        self.given = given

    def __missing__(self, t: str) -> bool:
        k = bare(t)
        yes = k in self.given or k in ("عبد", "abd", "abdul", "abdel") or len(t) > 3 and t[0] in "وفبلك" and (k[1:] in self.given or k[1:] == "عبد")
        if len(self) < 500_000:
            self[t] = yes
        return yes


class Titles(dict):
    """Whether a token is a title, remembered per token."""

    def __missing__(self, t: str) -> bool:
        yes = t.casefold() in TITLES
        if len(self) < 500_000:
            self[t] = yes
        return yes


def name_spans(tokens: list[str], given: frozenset[str] | set[str], starts: Starts) -> Iterator[tuple[int, int, int, bool, int]]:
    """(first, last, family, loose, letters to skip) of every candidate: tokens that may make a name with given names of the
    set. loose: the word before the given name, with no comma between, which is mostly no family name."""
    n, done = len(tokens), 0
    for i in [i for i, t in enumerate(tokens) if starts[t]]:
        if i < done:
            continue
        skip, k = 0, is_given(tokens, i, given)
        if not k and len(tokens[i]) > 3 and tokens[i][0] in "وفبلك" and bare(tokens[i]) not in given:
            one = tokens[:]
            one[i] = tokens[i][1:]
            k = is_given(one, i, given)
            skip = 1 if k else 0
        if not k:
            continue
        j = i + k
        while j < n and not tokens[j - 1].endswith(".") or j < n and is_initial(tokens[j - 1]) and j > i + k:
            if is_initial(tokens[j]):
                j += 1
            elif g := is_given(tokens, j, given):
                j += g
            else:
                break
        ended = tokens[j - 1].endswith(".") and not is_initial(tokens[j - 1])  # a full stop after the given name
        if j < n and not ended and _family_like(tokens[j], tokens[i]):
            yield i, j, j, False, skip
        if not skip:
            b = i - 1
            if b >= 1 and tokens[b] in (",", "،"):
                b -= 1
            elif b >= 0 and ord(tokens[i][0]) < 0x600:
                b = -1  # in Latin letters the family name comes first only before a comma
            if b >= 0 and _family_like(tokens[b], tokens[i]) and bare(tokens[b]) not in given:
                yield b, j - 1, b, b == i - 1, 0
        done = j


def _family_like(t: str, beside: str) -> bool:
    if len(t) < 3 or not t[0].isalpha() or t.casefold() in TITLES:
        return False
    latin = ord(beside[0]) < 0x600
    return (t[0].isupper() or beside[0].islower() and ord(t[0]) < 0x600) if latin else ord(t[0]) >= 0x600


_FIND = ["id", "pii_type", "start", "stop", "item", "key1", "key2", "longer", "longer_item"]
_FOUND = "id bigint, pii_type string, start int, stop int, item string, key1 string, key2 string, longer int, longer_item string"
_COUNTED = "kind string, key string, n bigint, a bigint, b bigint"
_FOUND_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())


def _first_batches(listed: frozenset[str]):
    """Counts of a batch, and the finds that need none; in one pass, told apart by `kind`."""
    starts = Starts(listed)
    titles = Titles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            written: Counter = Counter()
            beside: Counter = Counter()
            titled: Counter = Counter()
            labels: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
            towns: Counter = Counter()
            finds: list[tuple] = []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if not t:
                    continue
                tokens = _TOKEN.findall(t)
                written.update(tokens)
                for k in [k for k, x in enumerate(tokens) if titles[x]]:
                    x = tokens[k]
                    if k + 1 < len(tokens):
                        y = tokens[k + 1]
                        if y[0].isalpha() and y.casefold() not in TITLES and not is_initial(y) and not (is_initial(x) and k and tokens[k - 1][0].isupper() and tokens[k - 1][-1].isalpha()) and tokens[k + 2 : k + 3] not in ([","], ["،"]):
                            titled[bare(y)] += 1
                for _, _, f, loose, _ in name_spans(tokens, listed, starts):
                    if not loose:
                        beside[bare(tokens[f])] += 1
                if "@" in t or "at]" in t or "at)" in t:
                    finds += [(i, "email", m.start(), m.end(), m[0], "", "", -1, "") for m in _MAIL.finditer(t)]
                for x, e, s, keys in numbers(t):
                    kind = sure_type(s)
                    for k in dict.fromkeys(keys[:2]):
                        c = labels[k]
                        c[0] += 1
                        c[1] += kind == "phone"
                        c[2] += kind == "id_number"
                    finds.append((i, kind or "number", x, e, s, keys[0], keys[1], -1, keys[2]))
                for x, e, more, long, town in addresses(t):
                    towns[town] += 1
                    towns[f"{town} {more}"] += 1
                    finds.append((i, "address", x, e, t[x:e], town, f"{town} {more}" if more else "", long, t[x:long]))
            every: Counter = Counter()
            for w, n in written.items():
                if w[0].isalpha():
                    every[bare(w)] += n
            rows = [("word", w, n, beside[w], titled[w]) for w, n in every.items() if w]
            rows += [("label", k, *v) for k, v in labels.items()]
            rows += [("town", k, n, 0, 0) for k, n in towns.items()]
            nothing = (None,) * 9
            full = [(*r, *nothing) for r in rows] + [("find", None, None, None, None, *f) for f in finds]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *_FOUND_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full, strict=True) if full else [[]] * 14, kinds, strict=True)], ["kind", "key", "n", "a", "b", *_FIND])

    return run


def first_pass(docs: DataFrame, listed: frozenset[str]) -> tuple[DataFrame, DataFrame]:
    """(counts, finds), cuts. counts: (kind, key, n, a, b) over all texts: word: its places, those beside given names, those after
    titles; label: the numbers after it, sure phones, sure identity numbers; town: addresses that end in it. finds: all but names."""
    both = cut(docs.select("id", "text").mapInArrow(_first_batches(listed), f"{_COUNTED}, {_FOUND}"), "first-pass")
    c = both.filter("kind <> 'find'").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return cut(c, "disclosure"), both.filter("kind = 'find'").select(*_FIND)


def given_names(counts: DataFrame) -> DataFrame:
    """(key): the words that titles reveal as given names."""
    return counts.filter((F.col("kind") == "word") & (F.col("b") >= GIVEN_COUNT) & (F.col("b") >= F.col("n") * GIVEN_SHARE) & (F.col("a") < F.col("n") * 0.55) & (F.length("key") > 2)).select("key")


def _name_batches(names: tuple[str, ...], listed: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = listed | ship.shipped(names)
        starts = Starts(given)
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if not t:
                    continue
                found = list(name_spans(_TOKEN.findall(t), given, starts))
                if not found:
                    continue
                places = [m.span() for m in _TOKEN.finditer(t)]
                tokens = [t[x:y] for x, y in places]
                for first, last, family, loose, skip in found:
                    if first and bare(tokens[first - 1]) in BODIES_BEFORE or last + 1 < len(tokens) and bare(tokens[last + 1]) in BODIES_AFTER:
                        continue
                    a, e = places[first][0] + skip, places[last][1]
                    if "\n" in t[a:e]:
                        continue
                    if t[e - 1] == ".":
                        e -= 1
                    rows.append((i, "name loose" if loose else "name", a, e, t[a:e], bare(tokens[family]), "", -1, ""))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, _FOUND_TYPES, strict=True)], _FIND)

    return run


def disclosure(with_entity: Column, places: Column, share: Column) -> Column:
    """How much of the information that an entity is here (it is in `share` of all places) a term gives away that stands with it
    in `with_entity` of its `places`. The term's own share is smoothed by one place of the common kind."""
    p = (with_entity + share) / (places + 1)
    return 1 - F.log(p) / F.log(share)


def found(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Of `docs` (id, text) and known given names (given_name): (id, pii_type, start, stop, item), overlaps settled."""
    listed = frozenset(x for r in names.select("given_name").filter("given_name is not null").collect() for x in [r[0].casefold()] if " " not in x)  # a fixed list
    counts, finds = first_pass(docs, listed)
    named = cut(docs.select("id", "text").mapInArrow(_name_batches(ship.words(given_names(counts)), listed), _FOUND), "names")
    out = ["id", "pii_type", "start", "stop", "item"]
    sure = finds.filter(F.col("pii_type").isin("email", "phone", "id_number")).select(*out)
    # numbers: by the two words before, their shares smoothed towards those of the one word, these towards a listed word's
    labels = counts.filter("kind = 'label'").select(F.col("key"), "n", "a", "b")
    one, two = labels.toDF("key2", "n1", "a1", "b1"), labels.toDF("key1", "n2", "a2", "b2")
    num = finds.filter("pii_type = 'number'").join(two, "key1", "left").join(one, "key2", "left")
    # a listed label word counts like sure numbers behind a tenth of its places
    listed_word = lambda x: F.when(F.col("longer_item") == x, 0.1).otherwise(0.0)
    smooth = lambda hits, n, towards: (F.coalesce(hits, F.lit(0)) + SEEN_MORE * towards) / (F.coalesce(n, F.lit(0)) + SEEN_MORE)
    phone, ident = (smooth(F.col(f"{c}2"), F.col("n2"), smooth(F.col(f"{c}1"), F.col("n1"), listed_word(x))) + listed_word(x) for c, x in (("a", "phone"), ("b", "id_number")))
    kind = F.when((F.greatest(phone, ident) >= LABEL_SHARE) & (phone > ident), "phone").when((F.greatest(phone, ident) >= LABEL_SHARE) & (ident > phone), "id_number")
    num = num.withColumn("pii_type", kind).filter("pii_type is not null").select(*out)
    # towns: the second word belongs to the town if the first is mostly followed by it
    towns = counts.filter("kind = 'town'").select("key", "n")
    addr = finds.filter("pii_type = 'address'").join(towns.toDF("key1", "n1"), "key1", "left").join(towns.toDF("key2", "n2"), "key2", "left")
    both = (F.col("key2") != "") & (F.col("n2") >= 0.5 * F.col("n1"))
    addr = addr.select("id", "pii_type", "start", F.when(both | (F.col("key2") == ""), F.col("longer")).otherwise(F.col("stop")).alias("stop"), F.when(both | (F.col("key2") == ""), F.col("longer_item")).otherwise(F.col("item")).alias("item"))
    # names: the word beside the given name discloses a person
    words = counts.filter("kind = 'word'").select(F.col("key").alias("key1"), "n")
    beside = named.filter("pii_type = 'name'").groupBy("key1").agg(F.count("*").alias("a"))
    total = words.agg(F.sum("n").alias("_all")).join(F.broadcast(beside.agg(F.sum("a").alias("_named"))))  # one row
    share = F.least(F.lit(0.5), F.greatest(F.col("_named"), F.lit(1)) / F.col("_all"))
    telling = beside.join(words, "key1").join(F.broadcast(total)).filter(disclosure(F.col("a"), F.col("n"), share) >= NAME_DISCLOSURE).select("key1")
    name = named.join(telling, "key1", "left_semi").select("id", F.lit("name").alias("pii_type"), "start", "stop", "item")
    every = sure.unionByName(num).unionByName(addr).unionByName(name)
    per = every.groupBy("id").agg(F.collect_list(F.struct("pii_type", "start", "stop", "item")).alias("f"))  # as long as one text has finds
    return per.mapInArrow(_settle_batches, "id bigint, pii_type string, start int, stop int, item string")


_ORDER = {"email": 0, "address": 1, "id_number": 2, "phone": 2, "name": 3}


def settle(finds: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Of finds (type, start, stop, item) that overlap, the more certain type, then the longer, then the earlier stays."""
    taken: list[tuple[str, int, int, str]] = []
    for f in sorted(set(finds), key=lambda f: (_ORDER[f[0]], f[1] - f[2], f[1], f[0])):
        if all(f[2] <= g[1] or f[1] >= g[2] for g in taken):
            taken.append(f)
    return sorted(taken, key=lambda f: f[1])


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *f) for i, fs in zip(b["id"].to_pylist(), b["f"].to_pylist(), strict=True) for f in settle([(x["pii_type"], x["start"], x["stop"], x["item"]) for x in fs])]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["id", "pii_type", "start", "stop", "item"])


@F.pandas_udf(T.StringType())
def _replace_udf(text: pd.Series, starts: pd.Series, stops: pd.Series, types: pd.Series) -> pd.Series:
    out = []
    for t, a, b, k in zip(text, starts, stops, types, strict=True):
        if t is not None and a is not None:
            for s, e, x in sorted(zip(a, b, k, strict=True), reverse=True):
                t = f"{t[:s]}[{x.upper()}]{t[e:]}"
        out.append(t)
    return pd.Series(out, dtype=object)


def redacted(docs: DataFrame, finds: DataFrame) -> DataFrame:
    """(id, text, items): every text with typed placeholders in place of its finds, and how many there were."""
    per = finds.groupBy("id").agg(F.collect_list(F.struct("start", "stop", "pii_type")).alias("f"))
    j = docs.select("id", "text").join(bounded_broadcast(per), "id", "left")
    return j.select("id", F.when(F.col("f").isNull(), F.col("text")).otherwise(_replace_udf("text", F.col("f.start"), F.col("f.stop"), F.col("f.pii_type"))).alias("text"), F.coalesce(F.size("f"), F.lit(0)).alias("items"))
