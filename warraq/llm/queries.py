"""The pN_ queries: each applies an operator of this subpackage, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm import caps, leaks, lines, mixing, names, nearcopies, packing, personal, skeleton, tokens, truncation
from warraq.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


P1_FIELDS = ["persons", "organizations", "locations"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names.entities(table(spark, sf_dir, "articles"), P1_FIELDS)
    return names.spelling_pairs(found).select(F.col("field").alias("field_name"), F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string that is one spelling of several, with its entity."""
    return names.entities(table(spark, sf_dir, "articles"), P1_FIELDS).withColumnRenamed("field", "field_name")


P2_SHARE = 0.05


def p2_ranked_of(spark: SparkSession, sf_dir: str, by_month: bool) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    order = [-F.coalesce(caps.bounded_quality(F.col("reliability_score")), F.lit(-1.0)), -F.coalesce(F.unix_micros("published_at"), F.lit(-(2**62)))]
    month = F.date_format("published_at", "yyyy-MM") if by_month else None
    ranks = cut(caps.ranked(a, "id", lines.source_key(F.col("source_name")), order, month), "ranks")
    cap = a.agg(F.floor(F.count("*") * P2_SHARE + 1e-9).alias("cap"))
    return caps.capped(ranks, cap)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the cap: one stratum a source, so its best rows stay."""
    return p2_ranked_of(spark, sf_dir, False).filter("not kept").select(F.col("id").alias("article_id"))


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept rows when the cap of each source is split over the months of publication."""
    return p2_ranked_of(spark, sf_dir, True).filter("kept").select(F.col("id").alias("article_id"), F.col("contributor").alias("source"), F.col("stratum").alias("month"), "rank", "slots")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return truncation.judged(a, "id", "source_name", "content").filter("probability >= 0.5").select(F.col("id").alias("article_id"))


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source_name the share of its articles that is cut."""
    a = table(spark, sf_dir, "articles")
    return truncation.per_source(truncation.judged(a, "id", "source_name", "content"), a.select("id", "source_name"))


def p4_links_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, blocks = p6_blocks_of(spark, sf_dir)
    per_source = cut(lines.lines_of_blocks(blocks), "lines-of-blocks")
    a = table(spark, sf_dir, "articles")
    blank = ~lines.not_blank(F.col("content"))
    docs = a.select("id", lines.source_key(F.col("source_name")).alias("source"), F.when(blank, F.col("title")).otherwise(F.col("content")).alias("text"), blank.alias("titled"))
    docs = lines.with_lines_of_source(docs, per_source).select("id", "text", F.when(~F.col("titled"), F.col("lines")).alias("lines"))
    return nearcopies.links(docs, least=0.82, size=3)  # size and bound as TESTDATA.md states them


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.all_pairs(*p4_links_of(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article with shingles: its class of equal texts, the links of the class, the articles in it."""
    return nearcopies.degrees(*p4_links_of(spark, sf_dir)).withColumnRenamed("id", "article_id")


def p5_links_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, sf_dir, "approved_feedback_dataset")
    side = F.coalesce(F.col("split_name") == "train", F.lit(False))
    return leaks.split_links(r.select(F.col("rec_id").alias("id"), side.alias("side"), "text"), overlap=0.82, size=3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = leaks.overlapping_pairs(*p5_links_of(spark, sf_dir))
    return pairs.select(F.least("id_true", "id_false").alias("rec_id_a"), F.greatest("id_true", "id_false").alias("rec_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: its records and those that overlap a record across the border of train."""
    r = table(spark, sf_dir, "approved_feedback_dataset").select("rec_id", "split_name", "source")
    found = leaks.overlapping_records(*p5_links_of(spark, sf_dir)).select(F.col("id").alias("rec_id"), "n_links")
    g = r.join(found, "rec_id", "left").groupBy("split_name", "source")
    return g.agg(F.count("*").alias("records"), F.count("n_links").alias("overlapping"))


def p6_blocks_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The articles' lines (a cut) and the repeated blocks (a cut)."""
    got = cut(lines.line_table(table(spark, sf_dir, "articles"), "id", "source_name", "content"), "lines")
    return got, cut(lines.repeated_blocks(got), "blocks")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, blocks = p6_blocks_of(spark, sf_dir)
    per_source = cut(lines.lines_of_blocks(blocks), "lines-of-blocks")
    return lines.repeated_lines(got, per_source).select(F.col("id").alias("article_id"), "line_no")


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, its repeated blocks: number of lines and of articles."""
    _, blocks = p6_blocks_of(spark, sf_dir)
    return blocks.select("source", F.size("block").alias("n_lines"), "n_docs", F.xxhash64("block").alias("block_id"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article's content without the repeated lines of its source."""
    _, blocks = p6_blocks_of(spark, sf_dir)
    per_source = cut(lines.lines_of_blocks(blocks), "lines-of-blocks")
    a = table(spark, sf_dir, "articles").select("id", "source_name", "content")
    return lines.without_lines(a, "source_name", "content", "id", per_source).select(F.col("id").alias("article_id"), "content_without_lines")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.faulty_fields(table(spark, sf_dir, "articles"), "id", ["title", "content"]).select(F.col("id").alias("article_id"), "field_name")


def p7_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected fields with their text in the consistent form."""
    return skeleton.faulty_fields(table(spark, sf_dir, "articles"), "id", ["title", "content"]).select(F.col("id").alias("article_id"), "field_name", "consistent")


def p7_same_looking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different titles, and different contents, with one skeleton."""
    a = table(spark, sf_dir, "articles")
    title, content = (skeleton.same_looking(a, f).select(F.lit(f).alias("field_name"), "*") for f in ("title", "content"))
    return title.unionByName(content)


def token_sizes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return cut(d.select(F.col("doc_id").alias("id"), "source", tokens.counts(F.col("text")).alias("tokens")), "tokens")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's containers, for each capacity."""
    sizes = token_sizes_of(spark, sf_dir)
    out = None
    for r in table(spark, sf_dir, "pack_capacity").orderBy("max_tokens").collect():  # a fixed table of capacities
        one = packing.packed(sizes.select("id", "tokens"), r["max_tokens"]).select(F.lit(r["capacity_name"]).alias("capacity_name"), F.col("id").alias("doc_id"), "piece", "start", "tokens", "container")
        out = one if out is None else out.unionByName(one)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, pieces, tokens and the share of the containers' space that is used."""
    g = p8_packed(spark, sf_dir).groupBy("capacity_name", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    g = g.groupBy("capacity_name").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return g.join(table(spark, sf_dir, "pack_capacity"), "capacity_name").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("max_tokens")))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed set: which pieces of which texts stand in which slot of which shard."""
    return mixing.mixed(token_sizes_of(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.mixed(token_sizes_of(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p10_finds_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, cut(personal.found(docs, table(spark, sf_dir, "given_names")), "finds")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    finds = p10_finds_of(spark, sf_dir)[1]
    return finds.select(F.col("id").alias("doc_id"), "pii_type", F.col("item").alias("pii_text")).distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of its personal data."""
    return personal.redacted(*p10_finds_of(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {n: f for n, f in list(globals().items()) if n[0] == "p" and n[1].isdigit() and callable(f) and not n.endswith("_of")}
