"""Summaries of stories: prompts, chat rendering, and the default extractive stand-in for a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as t
from warraq.operators.prefix import running_sum

#: Texts a prompt takes, characters of each, and characters a story needs to be summarized at all.
TEXTS, CHARS, LEAST = 5, 2800, 150
TOO_SHORT = "النص المتاح قصير جدا لإعداد ملخص."


def prompt(texts: Column, many: str = "Summarize what the sources agree on.", few: str = "Summarize the text.") -> Column:
    """Numbered texts, each cut at a space, after an instruction that depends on how many there are."""
    kept = F.slice(F.filter(texts, lambda x: F.coalesce(t.strip(x), F.lit("")) != ""), 1, TEXTS)
    parts = F.transform(kept, lambda x, i: F.concat(F.lit("--- "), (i + 1).cast("string"), F.lit(" ---\n"), t.cut_at_space(t.strip_hook(x), CHARS)))
    return F.concat(F.when(F.size(kept) >= 3, many).otherwise(few), F.lit("\n\n"), F.array_join(parts, "\n\n"))


def lead(texts: Column) -> Column:
    """The first sentence of each of the first three texts, without hooks: deterministic, and no model."""
    first = F.transform(F.slice(texts, 1, 3), lambda x: F.regexp_extract(t.strip_hook(x), r"(?s)^.*?[.!؟?](?=\s|\z)|^.+", 0))
    return F.array_join(F.array_distinct(F.filter(first, lambda x: F.coalesce(x, F.lit("")) != "")), " ")


def summary(texts: Column) -> Column:
    """'' without texts, a notice for too little text, else the tidied lead sentences."""
    total = F.aggregate(F.transform(texts, lambda x: F.length(F.coalesce(x, F.lit("")))), F.lit(0), lambda s, n: s + n)
    return F.when(F.coalesce(F.size(texts), F.lit(0)) <= 0, "").when(total < LEAST, TOO_SHORT).otherwise(t.tidy_summary(lead(texts), F.size(texts)))


def cluster_texts(articles: DataFrame, most: int = TEXTS) -> DataFrame:
    """(cluster_id, texts): the first `most` texts of each cluster by id. Ids are ranked alone, texts join those that stay."""
    d = articles.filter("cluster_id is not null").select("cluster_id", "id", t.truthy(F.col("content_clean"), F.col("content"), F.col("title")).alias("text"))
    first = running_sum(d, "id", F.col("cluster_id"), []).filter(F.col("before") < most).select("id")
    g = d.join(first, "id", "left_semi").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("s"))
    return g.select("cluster_id", F.transform("s", lambda x: x["text"]).alias("texts"))


def summarized(clusters: DataFrame, articles: DataFrame, year: int) -> DataFrame:
    """Clusters with a summary: a usable one stays, else it is made from the cluster's texts."""
    new = cluster_texts(articles).select(F.col("cluster_id").alias("id"), summary(F.col("texts")).alias("_new"))
    j = clusters.join(new, "id", "left")
    return j.withColumn("summary", F.when(t.is_degenerate(F.col("summary"), year), F.coalesce("_new", F.lit(""))).otherwise(F.col("summary"))).drop("_new")


def render_chat(turns: Column, generate: bool = False) -> Column:
    """A conversation (array of role, content) as prompt text: a system turn goes before the first user turn, assistant is called model."""
    system = F.when(turns[0]["role"] == "system", F.concat(t.strip(turns[0]["content"]), F.lit("\n\n"))).otherwise("")
    rest = F.filter(turns, lambda x: x["role"] != "system")
    body = F.transform(rest, lambda x, i: F.concat(F.lit("<start_of_turn>"), F.when(x["role"] == "assistant", "model").otherwise(x["role"]), F.lit("\n"), F.when(i == 0, system).otherwise(""), t.strip(x["content"]), F.lit("<end_of_turn>\n")))
    return F.concat(F.array_join(body, ""), F.lit("<start_of_turn>model\n" if generate else ""))


def alternates(turns: Column) -> Column:
    """Whether, but for a system turn, user and assistant take turns, user first."""
    rest = F.filter(turns, lambda x: x["role"] != "system")
    return F.forall(F.transform(rest, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)


def _blank(c: Column) -> Column:
    return F.coalesce(t.strip(c), F.lit("")) == ""


def summary_records(clusters: DataFrame, feedback: DataFrame, articles: DataFrame) -> DataFrame:
    """(feedback_id, cluster_id, article, summary): approved summary feedback (id, cluster_id, user_rating, generated_summary,
    corrected_summary, status) with its cluster's texts in id order, and the correction where the rating was bad and one is there.
    Records with a blank side are left out."""
    text = t.truthy(F.col("content_clean"), F.col("content"), F.col("title"))
    a = articles.select("cluster_id", F.struct("id", text.alias("text")).alias("x")).groupBy("cluster_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    a = a.select("cluster_id", F.array_join(F.transform("x", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("article"))
    f = feedback.filter("status = 'approved'").join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    r = f.join(a, "cluster_id").select(F.col("id").alias("feedback_id"), "cluster_id", "article", t.corrected(F.col("user_rating"), F.col("corrected_summary"), F.col("generated_summary")).alias("summary"))
    return r.filter(~_blank(F.col("article")) & ~_blank(F.col("summary")))


def summary_feedback_inserted(feedback: DataFrame, clusters: DataFrame, given: DataFrame) -> DataFrame:
    """The table with the rows of `given` whose cluster exists, as pending."""
    new = given.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").withColumn("status", F.lit("pending"))
    return feedback.unionByName(new.select(*[c for c in feedback.columns if c in new.columns]), allowMissingColumns=True)


def training_pairs(rows: DataFrame) -> DataFrame:
    """(article, summary) of rows with text, summary and title: the title stands in for a missing summary; pairs with a blank side go."""
    p = rows.select(t.strip(F.col("text")).alias("article"), t.strip(t.truthy(F.col("summary"), F.col("title"))).alias("summary"))
    return p.filter(~_blank(F.col("article")) & ~_blank(F.col("summary")))
