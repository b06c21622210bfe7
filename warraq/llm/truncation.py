"""Texts that stop before their end, from right-censored length distributions and the way they end.

1. Site lines: short lines that many documents of a source, or of several sources, hold after different lines. They,
   credits, tags, links and marks are no running text; what follows the running text is set aside.
2. Ending evidence: how often each word ends a sentence or stands inside one, and how long sentences are, counted over all
   texts. A last word that only stands inside sentences, or is no word at all, speaks for a cut.
3. Censoring posterior: per source a log-normal length distribution, right-censored at the candidate limits (lengths at
   which too many texts stop), is fitted by maximum likelihood; at each limit the posterior that a text of that length was
   cut there becomes the prior odds of the ending evidence. Off the limits, the prior is the source's share of cut texts among
   its open endings, fitted by maximum likelihood too; what the evidence weighs is estimated from the texts at sure limits.
   An ending that is complete, or that shows the cut itself (half a character, an open bracket), is settled without a prior.

Defined results: null and blank texts are no records (they count in no share); a text of site lines only is complete; a
null source is a source of its own; repeated rows each count; an empty table gives empty results.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm import looks, ship
from warraq.llm.lines import not_blank, source_key, with_lines_of_source
from warraq.llm.skeleton import reading
from warraq.runtime import bounded_broadcast, cut

#: A site line stands in so many documents of its source and in this share of them, after different lines; a larger share if it ends like a sentence, as items of price lists and tables do.
MIN_DOCS, MIN_SHARE, MIN_SHARE_STOPPED = 5, 0.005, 0.03
#: A word seen less often than this tells nothing by its own counts; a limit of this posterior is sure.
RARE, SURE = 3, 0.9
_NOT_KEY = re.compile(r"[\W\d_]+")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_END = ".؟!?"
_CLOSERS = "\"'»”’)]）"
_WORDS = re.compile(r"[^\W_]+")
_TAIL = re.compile(r"[^\W_]+$")
_SENTENCE_END = re.compile(r"[.؟!?]+[\"'»”’)\]]*(?:\s+|$)")
_LINK = re.compile(r"(?:https?://|www\.)\S+|[#@]\S+|\S+@\S+\.\S+")
_LABEL = re.compile(r"^[\W_]*(?:[^\W\d_]+[ ]){0,2}[^\W\d_]+\s*[:：]\s*\S")
# Words that open a line of credits or tags.
CREDITS = {"تحرير", "المصدر", "مصدر", "الصورة", "صورة", "صور", "وسوم", "كتب", "إعداد", "by", "edited", "source", "photo", "tags", "file", "editing", "reporting", "edition", "editor", "photos", "credit"}
#: Marks of omission or remains of a character or markup at the end.
_OMISSION = re.compile(r"(?:\[\s*\+?\s*\d+\s*(?:chars|characters|حرفا|حرف)\s*\]|\[?\s*(?:\.{2,}|…)+\s*\]?|\(\s*(?:\.{2,}|…)\s*\)|(?:اقرأ|تابع) (?:المزيد|القراءة)|read more|continue reading|>>|»»)\s*$", re.I)
_REMAINS = re.compile(r"(?:�+|&#?\w{0,8}|</?[a-zA-Z]{0,10}(?:\s[^<>]*)?|<)$")
_PLAIN_MARK = re.compile(r"^[\W_]*$")
_ABBREVIATION = re.compile(r"(?:^|\s)(?:[^\W\d_]|Dr|Mr|Mrs|Ms|Mme|Prof|St|No|أ\.د)\.$")


def line_key(line: str) -> str:
    """The letters of a line (in reading form)."""
    return _NOT_KEY.sub("", line)


def _site_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, key, before, stopped): the lines of each text, once per text, with a hash of the line before."""
    for b in batches:
        source, keys, before, stopped = [], [], [], []
        for s, t in zip(b["source"].to_pylist(), b["text"].to_pylist(), strict=True):
            r = reading(t).split("\n")
            prev, seen = 0, set()
            for line in r:
                k = line_key(_TAGS.sub("", line))
                if not k:
                    continue
                if k not in seen:
                    seen.add(k)
                    source.append(s)
                    keys.append(k)
                    before.append(prev)
                    stopped.append(line.rstrip().rstrip(_CLOSERS)[-1:] in tuple(_END + "．"))
                prev = hash_of(k)
        yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(keys, pa.string()), pa.array(before, pa.int64()), pa.array(stopped, pa.bool_())], ["source", "key", "before", "stopped"])


def hash_of(k: str) -> int:
    return (xxhash.xxh64_intdigest(k.encode()) >> 1) or 1


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (source, key, before, stopped) with a hash in place of the key: what is counted is small, lines of any length are seen."""
    for b in _site_candidates(batches):
        yield b.set_column(1, "key", pa.array([hash_of(k) for k in b["key"].to_pylist()], pa.int64()))


def site_lines(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """((source, lines), shipped files): per source the keys of its site lines; the keys of those that several sources share. docs: (id, source, text)."""
    n = docs.groupBy("source").agg(F.count("*").alias("docs"))
    few = [F.count("*").alias("n"), F.min("before").alias("lo"), F.max("before").alias("hi"), F.max("stopped").alias("stopped")]
    seen = docs.mapInArrow(_repeated, "source string, key bigint, before bigint, stopped boolean").groupBy("source", "key").agg(*few)
    seen = cut(seen.filter("n > 1"), "repeated-lines")
    own = seen.join(bounded_broadcast(n), "source").filter((F.col("n") >= MIN_DOCS) & (F.col("n") >= F.col("docs") * F.when(F.col("stopped"), MIN_SHARE_STOPPED).otherwise(MIN_SHARE)) & (F.col("lo") != F.col("hi"))).select("source", "key", F.lit(False).alias("shared"))
    shared = seen.filter("not stopped").groupBy("key").agg(F.count("*").alias("sources"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("sources >= 3 and lo <> hi and n >= 5").select("key")
    wanted = cut(own.select("source", "key").unionByName(shared.join(seen.select("source", "key"), "key").select("source", "key")).distinct(), "site-line-keys")
    # the lines themselves, of the few keys found
    per = wanted.groupBy("source").agg(F.collect_set("key").alias("lines"))
    lines = with_lines_of_source(docs, cut(per, "keys-of-source")).filter("lines is not null").select("source", "text", "lines").mapInArrow(_lines_of_keys, "source string, key bigint, line string").distinct()
    lines = cut(lines, "site-lines")
    mine = lines.join(own.select("source", "key"), ["source", "key"]).groupBy("source").agg(F.collect_set("line").alias("lines"))
    return cut(mine, "own-site-lines"), ship.words(lines.join(shared, "key").select("line"))


def _lines_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, key, line): the wanted lines, each once a task."""
    left: dict[str, set[int]] = {}
    for b in batches:
        out: list[tuple] = []
        for s, t, keys in zip(b["source"].to_pylist(), b["text"].to_pylist(), b["lines"], strict=True):
            if s not in left:
                left[s] = set(keys.as_py())
            if not left[s]:
                continue
            for line in reading(t).split("\n"):
                k = line_key(_TAGS.sub("", line))
                if k and (h := hash_of(k)) in left[s]:
                    left[s].discard(h)
                    out.append((s, h, k))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], ["source", "key", "line"])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, inside, ends): counts of a batch's words inside and at the end of sentences; '\\n<k>' counts sentences of k words."""
    for b in batches:
        every: Counter = Counter()
        ends: Counter = Counter()
        for t in b["text"].to_pylist():
            r = reading(html.unescape(t) if "&" in t else t)
            if "<" in r:
                r = _TAGS.sub("", r)
            r = "\n".join(x for x in map(str.rstrip, r.split("\n")) if len(x) >= 25 and x.rstrip(_CLOSERS)[-1:] in _END)
            if not r:
                continue
            every.update(_WORDS.findall(r))
            for s in _SENTENCE_END.split(r):
                if s:
                    ends[f"\n{min(60, len(s.split()))}"] += 1
                    if (m := _TAIL.search(s[max(s.rfind(" "), s.rfind("\n")) + 1 :].rstrip(_CLOSERS))) and len(m[0]) > 2:
                        ends[m[0]] += 1
        words = list(every | ends)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([every[w] - ends[w] if w[0] != "\n" else 0 for w in words], pa.int64()), pa.array([ends[w] for w in words], pa.int64())], ["word", "inside", "ends"])


def ending_counts(docs: DataFrame) -> DataFrame:
    """(word, inside, ends) over all texts."""
    return docs.mapInArrow(_word_batches, "word string, inside bigint, ends bigint").groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))


class SiteLines:
    """The site lines of a source: its own and those all share; whether a key is one, or the beginning of one."""

    def __init__(self, own: Iterable[str], shared: frozenset[str], ordered: list[str]) -> None:
        self.own, self.shared, self.ordered = set(own), shared, ordered

    def __contains__(self, k: str) -> bool:
        return k in self.own or k in self.shared

    def starts(self, k: str) -> bool:
        at = bisect_left(self.ordered, k)
        return at < len(self.ordered) and self.ordered[at].startswith(k) or any(len(x) > 8 and x.startswith(k) for x in self.own)


def last_prose(text: str, site: SiteLines) -> tuple[int, str]:
    """(length of the text up to the end of its running text, the running text's last line); (0, '') without one."""
    at = len(text)
    for raw in reversed(text.split("\n")):
        end = at
        at -= len(raw) + 1
        line = _TAGS.sub("", raw).strip()
        if not line or _PLAIN_MARK.match(line) and "�" not in line and not _OMISSION.search(line):
            continue
        r = reading(line)
        k = line_key(r)
        if k in site or _PLAIN_MARK.match(_LINK.sub("", line)):
            continue
        first = _WORDS.search(r)
        if first and first[0] in CREDITS and (_LABEL.match(line) or len(line) < 60):
            continue
        if len(r) < 70 and r[:1] in "(-●*•" and len(k) < 40 and k and not r.rstrip(_CLOSERS)[-1:] in _END:
            continue
        if len(k) > 3 and site.starts(k):  # a site line that is cut itself
            continue
        return end - (len(raw) - len(raw.rstrip())), line
    return 0, ""


def judge(line: str) -> tuple[int, str, int, bool]:
    """(verdict, last word, words in the last sentence, omission): 0 complete, 1 cut, 2 open."""
    t = line.replace("．", ".").replace("）", ")")
    t = re.sub(r"[​-‏‪-‮⁠-⁤﻿­]", "", t)
    omitted = False
    whole = html.unescape(t).rstrip()
    if not _REMAINS.search(t) or re.search(r"&#?\w{2,8};$", t):
        t = whole
    while m := _OMISSION.search(t):
        t, omitted = t[: m.start()].rstrip(), True
    if m := _REMAINS.search(t):
        if m[0]:
            t, omitted = t[: m.start()].rstrip(), True
            if not t:
                return 1, "", 0, True
            if m[0][0] in "�&<" and t.rstrip(_CLOSERS)[-1:] not in _END:
                return 1, "", 0, True
    t = t.rstrip()
    if not t:
        return (1 if omitted else 0), "", 0, omitted
    bare = t.rstrip(_CLOSERS + " ")
    if bare[-1:] in _END and not _ABBREVIATION.search(bare):
        return 0, "", 0, omitted
    if bare[-1:] in "،,؛;:：«“(（-–—/" or t[-1:] in "«“(（" or not bare:
        return 1, "", 0, omitted
    if _ABBREVIATION.search(bare):
        return 1, "", 0, omitted
    if t != bare and t[-1] in "\"'»”’":
        opened = t.count("«") + t.count("“") - t.count("»") - t.count("”")
        if opened == 0 and t.count('"') % 2 == 0:
            return 0, "", 0, omitted  # the quotation that ends it is closed
    words = _WORDS.findall(reading(bare))
    last = _SENTENCE_END.split(bare)[-1]
    return 2, words[-1] if words else "", len(last.split()), omitted


def _judge_batches(files: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = ship.shipped(files)
        ordered = sorted(x for x in shared if len(x) > 8)
        sites: dict[str, SiteLines] = {}
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, s, t, keys in zip(b["id"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist(), b["lines"], strict=True):
                if s not in sites:
                    sites[s] = SiteLines(keys.as_py() or [], shared, ordered)
                n, line = last_prose(t, sites[s])
                verdict, word, length, omitted = judge(line) if line else (0, "", 0, False)
                here = verdict == 2 and len(re.findall(rf"(?<!\w){re.escape(word)}(?!\w)", reading(t))) > 1
                for c, v in zip(out, (i, s, n, verdict, word, min(60, length), omitted, here), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "source", "length", "verdict", "word", "words", "omitted", "here"])

    return run


_JUDGED = "id bigint, source string, length int, verdict int, word string, words int, omitted boolean, here boolean"


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: list[int], rounds: int = 60) -> tuple[float, float]:
    """(mean, deviation) of the log-normal that fits best where texts at a limit count as at least that long: by EM."""
    x = np.log(lengths.astype(float))
    limit = np.isin(lengths, limits)
    mean, dev = np.average(x, weights=counts), max(0.05, math.sqrt(np.cov(x, fweights=counts))) if counts.sum() > 1 else 0.5
    for _ in range(rounds):
        a = (x - mean) / dev
        tail = np.array([max(1e-12, 0.5 * math.erfc(v / math.sqrt(2))) for v in a])
        ratio = np.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
        e1 = np.where(limit, mean + dev * ratio, x)
        e2 = np.where(limit, mean**2 + dev**2 + dev * (x + mean) * ratio, x * x)
        new = np.average(e1, weights=counts)
        dev = max(0.05, math.sqrt(max(1e-6, np.average(e2, weights=counts) - new**2)))
        if abs(new - mean) < 1e-6:
            break
        mean = new
    return float(mean), float(dev)


def _posteriors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source's counts (length, n, open): at each candidate limit, the posterior that a text of that length was cut."""
    pdf = pdf[pdf["length"] > 0].sort_values("length")
    out = pd.DataFrame({"source": pd.Series(dtype=str), "length": pd.Series(dtype="int32"), "posterior": pd.Series(dtype=float)})
    if pdf.empty:
        return out
    x, n, o = pdf["length"].to_numpy(), pdf["n"].to_numpy(dtype=float), pdf["open"].to_numpy(dtype=float)
    total = n.sum()
    mean, dev = fit_censored(x, n, [])
    density = np.exp(-(((np.log(x) - mean) / dev) ** 2) / 2) / (x * dev * math.sqrt(2 * math.pi))
    rough = total * density
    limits = x[(o >= 3) & (o > 4 * rough + 2) & (o >= 0.5 * n)].tolist()
    if not limits:
        return out
    mean, dev = fit_censored(x, n, limits)
    rows = []
    for limit in limits:
        k = int(np.flatnonzero(x == limit)[0])
        a = (math.log(limit) - mean) / dev
        f = total * math.exp(-a * a / 2) / (limit * dev * math.sqrt(2 * math.pi))
        rows.append((pdf["source"].iloc[0], int(limit), float(max(0.02, min(0.999, 1 - f / max(n[k], f + 1e-9))))))
    return pd.DataFrame(rows, columns=["source", "length", "posterior"])


#: Bins of an open ending's evidence, a tenth of a nat each, from -BINS to BINS; texts the shared prior counts for in each source.
BINS, PSEUDO = 120, 5.0


def fit_share(evidence: np.ndarray, counts: np.ndarray, towards: float = 0.5, pseudo: float = PSEUDO, rounds: int = 200) -> float:
    """The share of cut texts that makes log likelihood ratios `evidence`, seen `counts` times, most likely: by EM."""
    share = towards
    ratio = np.exp(np.clip(evidence, -30, 30))
    for _ in range(rounds):
        cut_ = share * ratio / (share * ratio + 1 - share)
        new = float(((cut_ * counts).sum() + pseudo * towards) / (counts.sum() + pseudo))
        if abs(new - share) < 1e-7:
            break
        share = new
    return min(0.999, max(0.001, share))


def _shares(towards: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "share": [fit_share(pdf["bin"].to_numpy() / 10, pdf["n"].to_numpy(dtype=float), towards)]})

    return run


def judged(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, length, probability): every text that is not blank, with the probability that it stops early; a cut."""
    looks.ensure(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).filter(not_blank(F.col("text")))
    own, shared = site_lines(docs)
    counts = cut(ending_counts(docs), "ending-counts")
    with_own = with_lines_of_source(docs, own).select("id", "source", "text", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    seen = cut(with_own.mapInArrow(_judge_batches(shared), _JUDGED), "endings")
    lengths = seen.groupBy("source", "length").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") > 0, 1)).alias("open"))
    posts = lengths.groupBy("source").applyInPandas(_posteriors, "source string, length int, posterior double")
    posts = cut(posts, "posteriors")
    is_word = ~F.col("word").startswith("\n")
    rare = F.col("inside") + F.col("ends") < RARE
    totals = counts.filter(is_word).agg(F.sum("inside").alias("all_inside"), F.sum("ends").alias("all_ends"), F.sum(F.when(rare, F.col("ends")).otherwise(0)).alias("rare_ends"), F.sum(F.when(rare, F.col("inside")).otherwise(0)).alias("rare_inside"))
    by_words = counts.filter(~is_word).select(F.substring("word", 2, 9).cast("int").alias("words"), F.col("ends").alias("sentences"))  # 60 rows at most
    reached = by_words.select("words", F.col("sentences").alias("f"), F.expr("sum(sentences) over (order by words desc)").alias("reach"))
    mean = by_words.agg(F.sum("sentences").alias("n"), F.sum(F.col("words") * F.col("sentences")).alias("m"))
    by_length = reached.join(F.broadcast(mean)).select("words", F.log((F.col("reach") / F.col("m")) / ((F.col("f") + 0.5) / F.col("n"))).alias("by_length"))
    ended = seen.filter("verdict < 2").agg(F.count("*").alias("done"), F.count(F.when(F.col("omitted") & (F.col("verdict") == 0), 1)).alias("done_omitted"))
    open_ = seen.filter("verdict = 2").join(counts, "word", "left").join(F.broadcast(by_length), "words", "left").join(bounded_broadcast(posts), ["source", "length"], "left")
    open_ = cut(open_.withColumn("rare", F.coalesce(F.col("inside") + F.col("ends"), F.lit(0)) < RARE), "open-endings")
    limit = F.col("posterior") >= SURE
    rates = open_.agg(F.count(F.when(limit, 1)).alias("at"), F.count(F.when(limit & (~F.col("rare") | F.col("here")), 1)).alias("at_known"), F.count("*").alias("opened"), F.count(F.when(F.col("omitted"), 1)).alias("open_omitted"))
    scored = cut(open_.join(F.broadcast(totals)).join(F.broadcast(rates)).join(F.broadcast(ended)).select("id", "source", "length", "posterior", evidence().alias("evidence")), "evidence")  # one row each
    bins = scored.filter("posterior is null").groupBy("source", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col("evidence") * 10))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = cut(bins, "evidence-bins")
    every = bins.groupBy("bin").agg(F.sum("n").alias("n")).collect()  # at most 241 rows
    overall = fit_share(np.array([r["bin"] / 10 for r in every]), np.array([float(r["n"]) for r in every])) if every else 0.5
    shares = cut(bins.groupBy("source").applyInPandas(_shares(overall), "source string, share double"), "shares")
    odds = scored.join(bounded_broadcast(shares), "source", "left")
    prior = F.coalesce("posterior", "share", F.lit(overall))
    probability = 1 / (1 + F.exp(-F.log(prior / (1 - prior)) - F.col("evidence")))
    settled = seen.filter("verdict < 2").select("id", "source", "length", F.col("verdict").cast("double").alias("probability"))
    return cut(settled.unionByName(odds.select("id", "source", "length", probability.alias("probability"))), "truncation")


def evidence() -> Column:
    """The log likelihood ratio of an open ending: cut, against complete without a full stop.

    A cut falls behind a whole word in the share of cases seen at the sure limits, in proportion to how often the word stands
    inside sentences; a complete text ends in a word as sentences do. Words too rare to have counts of their own are judged as
    rare words are: if they stand elsewhere in the text they are words, else most likely pieces of one.
    """
    inside, ends = F.coalesce("inside", F.lit(0)), F.coalesce("ends", F.lit(0))
    whole = (F.col("at_known") + 1.0) / (F.col("at") + 3.0)
    rare_end = (F.col("rare_ends") + 0.5) / (F.col("all_ends") + 1)
    rare_inside = (F.col("rare_inside") + 0.5) / (F.col("all_inside") + 1)
    known = F.log(whole * ((inside + 0.5) / F.col("all_inside")) / ((ends + 0.2) / F.col("all_ends")))
    word = F.when(F.col("rare") & ~F.col("here"), F.log((1 - whole) / rare_end)).when(F.col("rare"), F.log(whole * rare_inside / rare_end)).otherwise(known)
    marked = F.log(((F.col("open_omitted") + 0.5) / (F.col("opened") + 1)) / ((F.col("done_omitted") + 0.5) / (F.col("done") + 1)))
    return F.greatest(F.lit(-6.0), F.least(F.lit(6.0), word)) + F.coalesce("by_length", F.lit(0.0)) + F.when(F.col("omitted"), F.greatest(marked, F.lit(0.0))).otherwise(0.0)


def per_source(found: DataFrame, names: DataFrame) -> DataFrame:
    """(source_name, articles, cut, share): of `names` (id, source_name), how often each source's texts are cut; texts that are blank count as articles."""
    j = names.join(found.filter("probability >= 0.5").select("id", F.lit(1).alias("hit")), "id", "left")
    return j.groupBy("source_name").agg(F.count("*").alias("articles"), F.count("hit").alias("cut")).withColumn("share", F.col("cut") / F.col("articles"))
