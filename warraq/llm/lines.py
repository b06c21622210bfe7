"""Lines repeated across one source's documents, by suffix arrays over line identifiers.

A document is the sequence of its lines' identifiers. Lines that too few documents of the source hold can be part of no
repeated block, so they act as separators; the suffixes of the runs between them are counted before they move, and a
suffix array is built per (source, first line), the usual bucketing by first symbol; a bucket of very many different suffixes is
parted by the next line, and so on, so no hot line fills a task. Common prefixes of neighbours give the repeated blocks with the
exact number of documents they span; blocks spanning enough documents are deleted.

Defined results: null, empty or blank texts give no lines and count for no source; lines without a letter are never
repeated lines; equal documents (same id twice) count once per row; a null source is a source of its own; an empty table
gives empty results. Extra columns are ignored except by `without_lines`, which keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.llm import looks
from warraq.llm.skeleton import reading
from warraq.runtime import cut, is_small

MIN_SHARE, MIN_DOCS = 0.05, 5
#: Copies of the small side when a join on the source has to shuffle, so that a source with a third of all rows spreads.
SALT = 32
#: Different suffixes of one bucket; larger buckets are parted by one more line.
BUCKET = 50_000
_NOT_LETTER_IN_TEXT = re.compile(r"[^\w\n]+|[\d_]+")


def source_key(c: Column) -> Column:
    """The source of a source name: trimmed, inner spaces collapsed, case ignored; null counts as ''."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def not_blank(c: Column) -> Column:
    """Whether a text holds more than white space of any kind; null does not."""
    return F.coalesce(c.rlike(r"[^\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), F.lit(False))


def line_ids(text: str) -> list[int]:
    """For each line of a text, the 64-bit identifier of its letters in reading form; 0 for a line without a letter."""
    return line_ids_of_reading(reading(text))


def line_ids_of_reading(text: str) -> list[int]:
    """`line_ids` of a text that is in reading form already."""
    t = _NOT_LETTER_IN_TEXT.sub("", text)
    return [(xxhash.xxh64_intdigest(k.encode()) >> 1) or 1 if k else 0 for k in t.split("\n")]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _line_ids_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: line_ids(x) if x is not None else [])


def line_table(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, ids) of every document with a text that is not blank."""
    looks.ensure(df.sparkSession)
    t = df.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    return t.filter(not_blank(F.col("text"))).select("id", "source", _line_ids_udf("text").alias("ids"))


def common_lines(lines: DataFrame, min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(source, line, n_docs, need): lines in enough documents of their source. Counts combine before the shuffle."""
    docs = lines.groupBy("source").agg(F.count("*").alias("docs"))
    seen = lines.select("source", F.explode(F.array_distinct("ids")).alias("line")).filter("line <> 0")
    seen = seen.groupBy("source", "line").agg(F.count("*").alias("n_docs"))
    need = F.greatest(F.ceil(F.col("docs") * F.lit(min_share) - F.lit(1e-9)), F.lit(min_docs)).cast("long")
    return seen.filter(F.col("n_docs") >= min_docs).join(docs, "source").withColumn("need", need).filter("n_docs >= need").drop("docs")


def with_lines_of_source(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """Left-join `per_source` (one row per source, cut) to documents. Broadcast when it is small, in rows and bytes; else a salted shuffle join."""
    if is_small(per_source):
        return docs.join(F.broadcast(per_source), "source", "left")
    copies = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(copies, ["source", "salt"], "left").drop("salt")


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, the suffixes of its runs of common lines, each with the longest prefix it shares with an earlier suffix of the document."""
    for b in batches:
        source, suffix, earlier = [], [], []
        for s, ids, common in zip(b["source"].to_pylist(), b["ids"].to_pylist(), b["lines"].to_pylist(), strict=True):
            if not common:
                continue
            common = set(common)
            runs: list[list[int]] = [[]]
            for i in ids:
                if i in common:
                    runs[-1].append(i)
                elif i and runs[-1]:  # a blank line does not part a block
                    runs.append([])
            seen: dict[int, list[list[int]]] = {}
            for r in runs:
                for k in range(len(r)):
                    x = r[k:]
                    before = seen.setdefault(x[0], [])
                    source.append(s)
                    suffix.append(x)
                    earlier.append(max((_common_prefix(x, y) for y in before), default=0))
                    before.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(suffix, pa.list_(pa.int64())), pa.array(earlier, pa.int32())], ["source", "suffix", "earlier"])


def _common_prefix(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def repeated_in_suffix_array(suffixes: list[tuple[list[int], int, int]], need: int, parent: int = 0) -> list[tuple[list[int], int]]:
    """Blocks of one bucket of suffixes (suffix, longest prefix seen earlier in its document, count) that share more than `parent`
    lines: every maximal prefix interval whose documents number `need` or more, with that number. `suffixes` is sorted here: the suffix array."""
    s = sorted(suffixes)
    out: list[tuple[list[int], int]] = []
    stack: list[tuple[int, int, int]] = [(0, len(s), parent)]
    while stack:
        lo, hi, parent = stack.pop()
        depth = _common_prefix(s[lo][0], s[hi - 1][0])  # of a sorted interval, the common prefix of its ends is that of all
        n = sum(c for _, e, c in s[lo:hi] if e < depth)
        if depth > parent and n >= need:
            out.append((s[lo][0][:depth], n))
        total = sum(c for _, _, c in s[lo:hi])
        if total < need:
            continue
        i = lo
        while i < hi and len(s[i][0]) == depth:
            i += 1
        while i < hi:
            j = i
            while j < hi and s[j][0][depth] == s[i][0][depth]:
                j += 1
            if depth or (i, j) != (lo, hi):
                stack.append((i, j, depth))
            i = j
    return out


def _blocks_of(depth: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        need = int(pdf["need"].iloc[0])
        found = repeated_in_suffix_array([(list(map(int, x)), int(e), int(n)) for x, e, n in zip(pdf["suffix"], pdf["earlier"], pdf["n"], strict=True)], need, depth - 1)
        n = len(found)
        return pd.DataFrame({"source": pd.Series([pdf["source"].iloc[0]] * n, dtype=object), "block": pd.Series([b for b, _ in found], dtype=object), "n_docs": pd.Series([x for _, x in found], dtype="int64"), "need": pd.Series([need] * n, dtype="int64")})

    return run


def repeated_blocks(lines: DataFrame, min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(source, block, n_docs, need): blocks of one or more successive lines in enough documents of their source. `lines` must be a cut."""
    common = cut(common_lines(lines, min_share, min_docs), "common-lines")
    per_source = cut(common.groupBy("source").agg(F.collect_list("line").alias("lines"), F.first("need").alias("need")), "lines-of-source")
    found = with_lines_of_source(lines.filter(F.size("ids") > 0), per_source.select("source", "lines")).filter("lines is not null").select("source", "ids", "lines")
    suffixes = found.mapInArrow(_suffixes, "source string, suffix array<bigint>, earlier int").groupBy("source", "suffix", "earlier").agg(F.count("*").alias("n"))
    work = cut(suffixes.join(per_source.select("source", "need"), "source"), "suffixes")
    schema = "source string, block array<bigint>, n_docs bigint, need bigint"
    out, depth = [], 1
    while True:
        rows = work.withColumn("prefix", F.slice("suffix", 1, depth)).withColumn("bucket", F.xxhash64("prefix"))
        nxt = F.coalesce(F.try_element_at("suffix", F.lit(depth + 1)), F.lit(-1))
        sizes = rows.groupBy("source", "bucket").agg(F.first("prefix").alias("prefix"), F.count("*").alias("rows"), F.sum("n").alias("total"), F.sum(F.when(F.col("earlier") < depth, F.col("n")).otherwise(0)).alias("n_docs"), F.min(nxt).alias("lo"), F.max(nxt).alias("hi"), F.first("need").alias("need"))
        big = cut(sizes.filter((F.col("rows") > BUCKET) & (F.col("total") >= F.col("need"))), "large-buckets")
        if big.isEmpty():
            return reduce(DataFrame.unionByName, out, rows.drop("prefix").groupBy("source", "bucket").applyInPandas(_blocks_of(depth), schema))
        key = ["source", "bucket"]
        out.append(rows.drop("prefix").join(big.select(*key), key, "left_anti").groupBy(*key).applyInPandas(_blocks_of(depth), schema))
        # the prefix itself is a block unless all its suffixes go on with one line
        out.append(big.filter((F.col("n_docs") >= F.col("need")) & (F.col("lo") != F.col("hi"))).select("source", F.col("prefix").alias("block"), "n_docs", "need"))
        work = cut(rows.join(big.select(*key), key, "left_semi").drop("prefix", "bucket").filter(F.size("suffix") > depth), "suffixes")
        depth += 1


def lines_of_blocks(blocks: DataFrame) -> DataFrame:
    """(source, lines): per source, the lines of its blocks. One row a source, at most 1/min_share times its documents' mean number of lines long."""
    return blocks.select("source", F.explode("block").alias("line")).groupBy("source").agg(F.collect_set("line").alias("lines"))


def repeated_lines(lines: DataFrame, per_source: DataFrame) -> DataFrame:
    """(id, line_no) of every line of a repeated block."""
    found = with_lines_of_source(lines, per_source).filter("lines is not null")
    return found.select("id", F.posexplode("ids").alias("pos", "line"), "lines").filter(F.expr("line <> 0 and array_contains(lines, line)")).select("id", (F.col("pos") + 1).cast("int").alias("line_no"))


def strip_lines(text: str | None, lines: set[int]) -> str | None:
    """A text without the lines listed."""
    if not text or not lines:
        return text
    return "\n".join(x for x, i in zip(text.split("\n"), line_ids(text), strict=True) if i not in lines)


@F.pandas_udf(T.StringType())
def _strip_udf(text: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([strip_lines(t, {int(i) for i in s} if s is not None else set()) for t, s in zip(text, lines, strict=True)], dtype=object)


def without_lines(df: DataFrame, source_col: str, text_col: str, id_col: str, per_source: DataFrame) -> DataFrame:
    """`df` with `<text_col>_without_lines`: the text less its repeated lines; all else as it was."""
    looks.ensure(df.sparkSession)
    d = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"))
    j = with_lines_of_source(d, per_source)
    return j.select("row.*", F.when(F.col("lines").isNull(), F.col(f"row.{text_col}")).otherwise(_strip_udf(F.col(f"row.{text_col}"), F.col("lines"))).alias(f"{text_col}_without_lines"))
