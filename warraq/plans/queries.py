"""Queries for the core operators, each over its whole tables, with the SQL that must agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq import lexicons
from warraq.functions import text as t
from warraq.functions.html import main_text_column
from warraq.operators import clustering, dedup, entities, feedback, metrics, sampling, scoring, similarity, summaries
from warraq.plans import api, pipeline
from warraq.runtime import cut, table
from warraq.sources import feeds
from warraq.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space and strip in the dialect of the checking SQL.
W = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_strip(c)}, '{W}+'), lambda x: x <> '')"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _poll() -> Column:
    """The hour of intake."""
    return F.date_format("scraped_at", "yyyy-MM-dd HH")


def micros(c: str) -> Column:
    return F.unix_micros(c).alias(c)


# ---- lookups, filters, paging


@query("SELECT id, title, source_name, epoch_us(published_at) AS published_at, reliability_score, verified FROM articles ORDER BY id DESC LIMIT 20 OFFSET 20")
def list_articles_page(spark, d):
    return api.listing(table(spark, d, "articles"), skip=20).withColumn("published_at", micros("published_at"))


@query("""SELECT id, title, source_name, epoch_us(published_at) AS published_at, reliability_score, verified, propaganda_label, statement_type, attribution_label,
    (SELECT count(*) FROM articles) AS total, 40 < (SELECT count(*) FROM articles) AS has_next
    FROM articles ORDER BY published_at DESC NULLS FIRST, id DESC LIMIT 20 OFFSET 20""")
def feed_page_nulls_first(spark, d):
    return api.feed(table(spark, d, "articles"), page=2).withColumn("published_at", micros("published_at"))


@query("""SELECT id, title, source_name, epoch_us(published_at) AS published_at, reliability_score, verified, propaganda_label, statement_type, attribution_label, url, content, array_to_string(persons, '|') AS persons, array_to_string(organizations, '|') AS organizations,
    array_to_string(locations, '|') AS locations, array_to_string(misc, '|') AS misc, cluster_id, neutrality_score, attribution_score, epoch_us(scraped_at) AS scraped_at, language, word_count FROM articles WHERE id = (SELECT min(id) FROM articles WHERE cluster_id IS NOT NULL)""")
def article_details(spark, d):
    a = table(spark, d, "articles")
    first = a.filter("cluster_id is not null").agg(F.min("id").alias("id"))
    one = api.article(a, a.join(F.broadcast(first), "id").select("id"))
    return one.withColumns({"published_at": micros("published_at"), "scraped_at": micros("scraped_at")} | {c: F.array_join(c, "|") for c in ("persons", "organizations", "locations", "misc")})


@query("SELECT id, title, source_name, propaganda_label, statement_type FROM articles WHERE propaganda_label = 'propaganda' AND statement_type = 'opinion'")
def feed_details_filtered(spark, d):
    return api.feed_details(table(spark, d, "articles"), "propaganda", "opinion").select("id", "title", "source_name", "propaganda_label", "statement_type")


@query("""WITH m AS (SELECT id, cluster_id FROM articles WHERE id = (SELECT min(id) FROM articles WHERE cluster_id IS NOT NULL)),
    r AS (SELECT a.* FROM articles a JOIN m ON a.cluster_id = m.cluster_id WHERE a.id <> m.id)
    SELECT id, title, source_name, cluster_id, (SELECT count(*) FROM r) AS total FROM r
    ORDER BY verified DESC NULLS FIRST, reliability_score DESC NULLS FIRST, published_at DESC NULLS FIRST, id DESC LIMIT 20""")
def related_articles(spark, d):
    a = table(spark, d, "articles")
    first = a.filter("cluster_id is not null").agg(F.min("id").alias("id"))
    return api.related(a, a.join(F.broadcast(first), "id").select("id")).select("id", "title", "source_name", "cluster_id", "total")


@query("""SELECT a.id, count(b.id) AS related FROM articles a LEFT JOIN articles b ON a.cluster_id = b.cluster_id AND a.id <> b.id GROUP BY a.id""")
def related_counts(spark, d):
    a = table(spark, d, "articles").select("id", "cluster_id")
    n = a.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return a.join(n, "cluster_id", "left").select("id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("related"))


@query("""SELECT id, title, source_name FROM articles WHERE published_at >= TIMESTAMP '2025-01-01' AND (contains(coalesce(title, ''), 'القمح') OR contains(coalesce(content, ''), 'القمح'))
    AND (contains(coalesce(title, ''), 'دمشق') OR contains(coalesce(content, ''), 'دمشق')) ORDER BY published_at DESC, id DESC LIMIT 10""")
def keyword_search(spark, d):
    return api.search_local(table(spark, d, "articles"), ["القمح", "دمشق"], F.lit("2025-01-01").cast("timestamp")).select("id", "title", "source_name")


@query("""SELECT id FROM articles WHERE (contains(coalesce(title, ''), 'القمح') OR contains(coalesce(content, ''), 'القمح')) AND (contains(coalesce(title, ''), 'دمشق') OR contains(coalesce(content, ''), 'دمشق'))""")
def keyword_matches(spark, d):
    return api.keyword_filter(table(spark, d, "articles"), ["القمح", "دمشق"]).select("id")


@query(f"SELECT id, url FROM articles WHERE NOT ({' OR '.join(f'''contains(coalesce(url, ''), '{h}')''' for h in lexicons.BLOCKED_HOSTS)})")
def blocklist_filter(spark, d):
    return feeds.not_blocked(table(spark, d, "articles").select("id", "url"), lexicons.BLOCKED_HOSTS)


@query("""SELECT id, source_name FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS k FROM articles WHERE NOT is_processed AND url IS NOT NULL)
    WHERE k = 1 AND url NOT IN (SELECT url FROM articles WHERE is_processed AND url IS NOT NULL)""")
def new_urls_only(spark, d):
    a = table(spark, d, "articles").select("id", "url", "source_name", "is_processed")
    return dedup.new_urls(a.filter("not is_processed"), a.filter("is_processed")).select("id", "source_name")


@query("SELECT DISTINCT a.url FROM articles a WHERE a.url IN (SELECT url FROM articles WHERE is_processed)")
def known_urls_semi(spark, d):
    a = table(spark, d, "articles").select("url", "is_processed")
    return a.join(a.filter("is_processed").select("url"), "url", "left_semi").select("url").distinct()


@query("SELECT id, coalesce(nullif(content_clean, ''), nullif(content, ''), title) AS text FROM articles")
def truthy_text(spark, d):
    return table(spark, d, "articles").select("id", t.truthy(F.col("content_clean"), F.col("content"), F.col("title")).alias("text"))


@query("SELECT id, published_at IS NULL AS undated FROM articles WHERE published_at IS NULL OR published_at >= TIMESTAMP '2025-06-01'")
def age_filter_keeping_undated(spark, d):
    return ingest.fresh(table(spark, d, "articles"), F.lit("2025-06-03").cast("timestamp")).select("id", F.col("published_at").isNull().alias("undated"))


@query("SELECT id, coalesce(nullif(content, ''), title) AS text FROM articles WHERE scraped_at >= (SELECT max(scraped_at) FROM articles) - INTERVAL 48 HOUR ORDER BY id DESC LIMIT 100")
def warm_up_rows(spark, d):
    return api.warm_up(table(spark, d, "articles"))


# ---- joins


# the table's rows in the order they are stored: the last listing of a name counts
_LAST_AUTHORITY = "(SELECT name, reliability_score AS s FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC) AS r FROM (SELECT *, row_number() OVER () AS k FROM sources)) WHERE r = 1)"


@query(f"SELECT a.id, coalesce(s.s, 0.40) AS authority FROM articles a LEFT JOIN {_LAST_AUTHORITY} s ON a.source_name = s.name")
def authority_lookup(spark, d):
    return scoring.authority(table(spark, d, "articles").select("id", "source_name"), table(spark, d, "sources")).select("id", "authority")


@query("SELECT name, name_ar, reliability_score, political_lean, region, len(rss_urls)::INT AS rss_count FROM sources")
def source_registry(spark, d):
    return api.sources(table(spark, d, "sources"))


@query("""SELECT f.id, f.article_id, a.title, a.source_name, f.propaganda_prediction, f.propaganda_correct, f.corrected_propaganda
    FROM article_feedback f JOIN articles a ON f.article_id = a.id WHERE lower(f.status) = 'pending'""")
def pending_feedback_join(spark, d):
    return api.pending_feedback(table(spark, d, "article_feedback"), table(spark, d, "articles"))


@query("SELECT f.id, a.title AS title, a.source_name AS source_name, f.status AS status, f.notes AS notes FROM article_feedback f JOIN articles a ON f.article_id = a.id")
def feedback_details_nested(spark, d):
    x = api.feedback_details(table(spark, d, "article_feedback"), table(spark, d, "articles"))
    return x.select("id", F.col("article.title").alias("title"), F.col("article.source_name").alias("source_name"), F.col("feedback.status").alias("status"), F.col("feedback.notes").alias("notes"))


_FIX = "CASE WHEN {0}_correct = false AND nullif(corrected_{0}, '') IS NOT NULL THEN corrected_{0} ELSE {0}_prediction END"


@query(f"""SELECT f.id AS feedback_id, coalesce(nullif(a.content_clean, ''), nullif(a.content, ''), a.title) AS text, a.title, a.source_name AS source, {_FIX.format('propaganda')} AS propaganda_label, {_FIX.format('statement')} AS statement_type,
    {_FIX.format('attribution')} AS attribution_label, a.verified, strftime(a.published_at, '%Y-%m-%d') AS date FROM article_feedback f JOIN articles a ON f.article_id = a.id WHERE f.status = 'approved'""")
def export_feedback(spark, d):
    return feedback.export(table(spark, d, "article_feedback"), table(spark, d, "articles")).drop("reliability_score")


@query("""SELECT c.id, count(a.id) AS n, coalesce(string_agg(a.id::VARCHAR, ',' ORDER BY a.id), '') AS ids FROM clusters c LEFT JOIN articles a ON a.cluster_id = c.id GROUP BY c.id""")
def parent_children_collect(spark, d):
    x = api.cluster_members(table(spark, d, "clusters"), table(spark, d, "articles"))
    return x.select("id", F.size("articles").cast("bigint").alias("n"), F.array_join(F.transform("articles", lambda a: a["id"].cast("string")), ",").alias("ids"))


@query("""SELECT cluster_id, md5(string_agg(coalesce(nullif(content, ''), title, ''), chr(10) || chr(10) ORDER BY id)) AS joined FROM articles WHERE cluster_id IS NOT NULL GROUP BY cluster_id""")
def cluster_text(spark, d):
    a = table(spark, d, "articles").filter("cluster_id is not null").select("cluster_id", "id", F.coalesce(F.nullif("content", F.lit("")), "title", F.lit("")).alias("t"))
    g = a.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("id", "t"))).alias("s"))
    return g.select("cluster_id", F.md5(F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")).alias("joined"))


# ---- aggregates


@query("SELECT source_name, count(*) AS articles FROM articles GROUP BY source_name")
def source_stats(spark, d):
    return api.by_source(table(spark, d, "articles"))


@query("SELECT count(*) AS total, count(*) FILTER (is_processed) AS processed, count(*) - count(*) FILTER (is_processed) AS unprocessed FROM articles")
def processed_stats(spark, d):
    return api.stats(table(spark, d, "articles"))


@query("""SELECT cluster_id, source_name, articles, count(*) OVER (PARTITION BY cluster_id) AS total, row_number() OVER (PARTITION BY cluster_id ORDER BY articles DESC, source_name NULLS FIRST) AS place
    FROM (SELECT cluster_id, source_name, count(*) AS articles FROM articles WHERE cluster_id IS NOT NULL GROUP BY cluster_id, source_name)""")
def cluster_sources(spark, d):
    g = api.cluster_sources(table(spark, d, "articles"))
    return g.withColumn("place", F.expr("row_number() over (partition by cluster_id order by articles desc, source_name nulls first)").cast("bigint"))  # one row a source


@query("SELECT propaganda_label, count(*) AS n, floor(10000.0 * count(*) / sum(count(*)) OVER () + 0.5) / 100 AS percent FROM articles GROUP BY propaganda_label")
def label_distribution_pct(spark, d):
    g = table(spark, d, "articles").groupBy("propaganda_label").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("all"))
    return g.join(F.broadcast(total)).select("propaganda_label", "n", (F.floor(F.lit(10000.0) * F.col("n") / F.col("all") + 0.5) / 100).alias("percent"))


@query("""SELECT label, n, floor(10000.0 * n / sum(n) OVER () + 0.5) / 100 AS percent, row_number() OVER (ORDER BY n DESC, label) AS place
    FROM (SELECT coalesce(propaganda_label, 'Missing Label') AS label, count(*) AS n FROM approved_feedback_dataset GROUP BY 1)""")
def label_counter(spark, d):
    g = table(spark, d, "approved_feedback_dataset").groupBy(F.coalesce("propaganda_label", F.lit("Missing Label")).alias("label")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("all"))
    g = g.join(F.broadcast(total)).select("label", "n", (F.floor(F.lit(10000.0) * F.col("n") / F.col("all") + 0.5) / 100).alias("percent"))
    # one row a label: a handful
    return g.withColumn("place", F.expr("row_number() over (order by n desc, label)").cast("bigint")).orderBy("place")


@query("SELECT statement_type, count(*) AS n, max(word_count) AS longest, count(*) FILTER (word_count > 200) AS over FROM articles GROUP BY statement_type")
def length_by_statement(spark, d):
    return table(spark, d, "articles").groupBy("statement_type").agg(F.count("*").alias("n"), F.max("word_count").alias("longest"), F.count(F.when(F.col("word_count") > 200, 1)).alias("over"))


@query("SELECT count(*) FILTER (status = 'approved' AND training_job_id IS NULL) AS free, count(DISTINCT article_id) AS articles FROM article_feedback")
def unused_feedback(spark, d):
    return table(spark, d, "article_feedback").agg(F.count(F.when((F.col("status") == "approved") & F.col("training_job_id").isNull(), 1)).alias("free"), F.countDistinct("article_id").alias("articles"))


# ---- order in groups


@query("SELECT id, source_name, k FROM (SELECT id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY id) AS k FROM articles) WHERE k <= 50")
def first_n_per_source(spark, d):
    # the places are exact running counts: no source passes through one task
    from warraq.operators.prefix import running_sum

    return running_sum(table(spark, d, "articles"), "id", F.col("source_name"), []).filter("before < 50").select("id", F.col("group").alias("source_name"), (F.col("before") + 1).alias("k"))


@query("""SELECT id FROM (SELECT *, row_number() OVER (ORDER BY finished_at DESC NULLS LAST, id DESC) AS k FROM training_job WHERE model_path IS NOT NULL AND lower(status) = 'completed')
    WHERE k > 5 AND NOT coalesce(is_active, false)""")
def retain_newest_k(spark, d):
    return feedback.purged_models(table(spark, d, "training_job")).select("id")


@query("SELECT id, article_id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, status) AS k FROM (SELECT DISTINCT id, article_id, status, created_at FROM article_feedback)) WHERE k = 1")
def feedback_delivered_once(spark, d):
    f = table(spark, d, "article_feedback").select("id", "article_id", "status", "created_at").distinct()
    g = f.groupBy("id").agg(F.min_by(F.struct("article_id", "status"), F.struct((-F.unix_micros("created_at")).alias("t"), "status")).alias("r"))
    return g.select("id", "r.article_id", "r.status")


# ---- set operations


@query(f"""WITH u AS (SELECT *, split_name <> 'train' AS fb, md5(coalesce({sql_strip("title")}, '') || chr(10) || coalesce({sql_strip("text")}, '')) AS k FROM approved_feedback_dataset)
    SELECT rec_id, propaganda_label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fb DESC, rec_id DESC) AS p FROM u) WHERE p = 1""")
def merge_override(spark, d):
    r = table(spark, d, "approved_feedback_dataset")
    return feedback.merged(r.filter("split_name = 'train'"), r.filter("split_name <> 'train'"), "rec_id").select("rec_id", "propaganda_label")


@query("""WITH b AS (SELECT title, text FROM approved_feedback_dataset WHERE split_name = 'train'), e AS (SELECT title, text FROM approved_feedback_dataset WHERE split_name <> 'train'),
    n AS (SELECT DISTINCT title, text FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.title = e.title AND b.text = e.text)) SELECT (SELECT count(*) FROM n) AS added, (SELECT count(*) FROM e) - (SELECT count(*) FROM n) AS skipped""")
def union_distinct_counts(spark, d):
    r = table(spark, d, "approved_feedback_dataset")
    return feedback.union_new(r.filter("split_name = 'train'"), r.filter("split_name <> 'train'"), ["title", "text"])[1]


# ---- text


@query(r"""SELECT id, translate(replace(regexp_replace(nfc_normalize(coalesce(title, '')), '[\x{064b}-\x{065f}\x{0610}-\x{061a}\x{06d6}-\x{06dc}\x{06df}-\x{06e8}\x{06ea}-\x{06ed}]', '', 'g'), chr(1600), ''),
    'آأإٱٲٳٴٵ', 'اااااااا') AS title FROM articles""")
def normalize_text(spark, d):
    return table(spark, d, "articles").select("id", t.normalize(F.col("title")).alias("title"))


def _plain_sql(c: str) -> str:
    """A text without markup, links, addresses, mentions and marks, blanks and runs of letters as they are."""
    x = rf"""regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g')"""
    for e, v in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{e}', {v})"
    x = f"CASE WHEN contains({c}, '<') OR contains({c}, '&') THEN {x} ELSE coalesce({c}, '') END"
    for pattern in (f"https?://[^{W[1:]}+|www\\.[^{W[1:]}+", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}", r"@[\p{L}\p{N}_]+"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return f"""regexp_replace(translate({x}, '{t.DIGITS_FROM}', '{t.DIGITS_TO}'), '[^\\p{{L}}\\p{{N}}_{W[1:-1]}"''«»“”]', ' ', 'g')"""


def _joined_sql(c: str) -> str:
    """The text of a list of characters, runs of three or more of one as two, blanks as one."""
    return sql_strip(f"regexp_replace(array_to_string(list_filter({c}, lambda x, i: NOT coalesce(i > 2 AND x = {c}[i - 1] AND x = {c}[i - 2], false)), ''), '{W}+', ' ', 'g')")


@query(f"""SELECT id, {_joined_sql('c')} AS text FROM (SELECT id, string_split(p, '') AS c FROM (SELECT id, {_plain_sql('content')} AS p FROM articles))""")
def clean_text(spark, d):
    return table(spark, d, "articles").select("id", t.clean(F.col("content")).alias("text"))


_TOKENS = r"regexp_extract_all(coalesce(content, ''), '[a-zA-Z0-9\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]+')"


@query(f"SELECT id, len({_TOKENS})::INT AS tokens, len(list_filter({_TOKENS}, lambda x: NOT list_contains({sql_list(lexicons.STOPWORDS)}, x)))::INT AS kept FROM articles")
def tokenize_count(spark, d):
    a = table(spark, d, "articles").select("id", t.tokenize(F.coalesce("content", F.lit(""))).alias("w"))
    return a.select("id", F.size("w").alias("tokens"), F.size(t.without_stopwords(F.col("w"), lexicons.STOPWORDS)).alias("kept"))


@query(f"SELECT id, word_count, len({sql_words('content')})::INT AS counted FROM articles WHERE content IS NOT NULL AND word_count <> len({sql_words('content')})")
def word_count_mismatch(spark, d):
    a = table(spark, d, "articles").filter("content is not null").select("id", "word_count", t.word_count(F.col("content")).alias("counted"))
    return a.filter("word_count <> counted")


@query(r"""SELECT id, n::DOUBLE / length(content) AS share FROM (SELECT id, content, length(regexp_replace(content, '[^\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]', '', 'g')) AS n FROM articles WHERE content <> '') WHERE n::DOUBLE / length(content) >= 0.40""")
def script_ratio_filter(spark, d):
    a = table(spark, d, "articles").filter("content <> ''").select("id", t.script_share(F.col("content")).alias("share"))
    return a.filter("share >= 0.40")


@query(f"""SELECT id, coalesce(content, '') = '' OR (length(content) < 250 AND len(list_filter({sql_list(lexicons.BOILERPLATE)}, lambda k: contains(content, k))) >= 2) AS boilerplate FROM articles""")
def boilerplate_flag(spark, d):
    return table(spark, d, "articles").select("id", t.is_boilerplate(F.col("content"), lexicons.BOILERPLATE).alias("boilerplate"))


_FP = f"md5(lower({sql_strip(f'''regexp_replace(content, '{W}+', ' ', 'g')''')}))"


@query(f"SELECT min(id) AS id, {_FP} AS fp, count(*) AS copies FROM articles WHERE content IS NOT NULL GROUP BY 2")
def fingerprint_exact_dedup(spark, d):
    a = table(spark, d, "articles").filter("content is not null")
    return a.groupBy(t.fingerprint(F.col("content")).alias("fp")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


_RUNS = f"""w AS (SELECT id, {sql_words('lower(content)')} AS w FROM articles WHERE content IS NOT NULL),
    s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w WHERE len(w) > 0),
    f AS (SELECT id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS f FROM s GROUP BY id), c AS (SELECT f, min(id) AS rep, count(*) AS copies, any_value(n) AS n FROM f GROUP BY f)"""


@query(f"""WITH {_RUNS}, p AS (SELECT x.id AS a, y.id AS b, count(*) AS inter FROM s x JOIN s y ON x.x = y.x AND x.id < y.id WHERE x.id IN (SELECT rep FROM c) AND y.id IN (SELECT rep FROM c) GROUP BY ALL)
    SELECT a, b, inter::DOUBLE / (ca.n + cb.n - inter) AS overlap FROM p JOIN c ca ON a = ca.rep JOIN c cb ON b = cb.rep WHERE inter::DOUBLE / (ca.n + cb.n - inter) >= 0.82""")
def shingle_jaccard_pairs(spark, d):
    """Links between classes of articles whose contents have the same shingles, each named by its least id."""
    rows = cut(dedup.shingle_rows(table(spark, d, "articles"), "id", F.col("content")), "shingles")
    return dedup.set_links(rows)[1]


@query(f"WITH {_RUNS} SELECT f.id, rep, copies FROM f JOIN c USING (f)")
def shingle_classes(spark, d):
    """Every article with a content: its class of equal shingles and the size of it."""
    rows = cut(dedup.shingle_rows(table(spark, d, "articles"), "id", F.col("content")), "shingles")
    members = dedup.set_links(rows)[0]
    return members.join(members.groupBy("rep").agg(F.count("*").alias("copies")), "rep").select("id", "rep", "copies")


@query()
def greedy_near_dedup(spark, d):
    return dedup.deduplicated(table(spark, d, "articles"), "id", F.col("content"))


@query(f"""SELECT id, CASE WHEN len(w) > 200 THEN array_to_string(w[1:100], ' ') || ' ... ' || array_to_string(w[-100:], ' ') ELSE content END AS text FROM (SELECT id, content, {sql_words('content')} AS w FROM articles WHERE content IS NOT NULL)""")
def head_tail(spark, d):
    return table(spark, d, "articles").filter("content is not null").select("id", t.head_tail(F.col("content")).alias("text"))


@query("SELECT id, title || ' [SEP] ' || content AS text FROM articles WHERE title IS NOT NULL AND content IS NOT NULL")
def sep_round_trip(spark, d):
    a = table(spark, d, "articles").filter("title is not null and content is not null").select("id", F.concat_ws(t.SEPARATOR, "title", "content").alias("text"))
    p = a.select("id", t.split_title(F.col("text")).alias("p"))
    return p.select("id", F.concat("p.title", F.lit(t.SEPARATOR), "p.content").alias("text"))


def _stem_sql(w: str) -> str:
    w = f"translate({w}, 'ةأإآ', 'هااا')"
    cut = "CASE " + " ".join(f"WHEN starts_with({w}, '{p}') AND length({w}) > {len(p) + 2} THEN substring({w}, {len(p) + 1})" for p in t.PREFIXES_A) + f" ELSE {w} END"
    return "CASE " + " ".join(f"WHEN ends_with(c, '{s}') AND length(c) > {len(s) + 1} THEN left(c, length(c) - {len(s)})" for s in t.SUFFIXES) + " ELSE c END", cut


_STEM, _CUT = _stem_sql("w")


@query(f"SELECT w AS word, {_STEM} AS stem FROM (SELECT w, {_CUT} AS c FROM (SELECT DISTINCT unnest(regexp_split_to_array(title, ' ')) AS w FROM articles))")
def light_stems(spark, d):
    w = table(spark, d, "articles").select(F.explode(F.split("title", " ")).alias("word")).distinct()
    return w.select("word", t.light_stem(F.col("word")).alias("stem"))


@query("""SELECT id, array_to_string(list_sort(list_filter(list_distinct(locations), lambda i: NOT list_contains(list_transform(list_distinct(locations), lambda x: x <> i AND contains(x, i)), true))), '|') AS kept FROM articles WHERE locations IS NOT NULL""")
def sub_entity_removal(spark, d):
    return table(spark, d, "articles").filter("locations is not null").select("id", F.array_join(F.array_sort(t.without_sub_entities(F.col("locations"))), "|").alias("kept"))


@query()
def story_candidates(spark, d):
    """New articles with the stored ones of their poll that nothing keeps apart, and how sure a match would be."""
    a = table(spark, d, "articles").withColumn("poll", _poll())
    x = cut(pipeline.traits(a, "poll", "id", "is_processed"), "traits")
    return clustering.candidates(x.filter("not is_processed"), x.filter("is_processed"), "poll")


# ---- scores


_WHOLE = "(coalesce(title, '') || ' ' || left(coalesce(content, ''), 600))"
_ATTR = f"""floor((CASE WHEN length(regexp_replace({_WHOLE}, '[^"«»“”]', '', 'g')) >= 2 THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(coalesce(title, ''), '[\\p{{L}}\\p{{N}}_]+\\s*:\\s*[\\p{{L}}\\p{{N}}_]+') THEN 0.35::DOUBLE ELSE 0 END
    + least(0.60::DOUBLE, len(list_filter({sql_list(lexicons.ATTRIBUTION_MARKERS)}, lambda m: contains({_WHOLE}, m))) * 0.15::DOUBLE)) * 100 + 0.5) / 100"""


@query(f"SELECT id, s AS score, CASE WHEN s >= 0.30 THEN 'supported_claim' ELSE 'unsupported_claim' END AS label FROM (SELECT id, {_ATTR} AS s FROM articles)")
def attribution_scores(spark, d):
    a = table(spark, d, "articles").select("id", scoring.attribution(F.col("title"), F.col("content"), lexicons.ATTRIBUTION_MARKERS).alias("score"))
    return a.select("id", "score", scoring.attribution_label(F.col("score")).alias("label"))


@query(f"""SELECT id, CASE WHEN len(list_filter({sql_list(lexicons.OPINION_MARKERS)}, lambda m: contains(lower(coalesce(title, '') || ' ' || coalesce(content, '')), m))) > 0 OR neutrality_score < 0.50 THEN 'opinion' ELSE 'reporting' END AS statement FROM articles""")
def statement_types(spark, d):
    # a score of NaN is greater than any number on both sides
    return table(spark, d, "articles").select("id", scoring.statement_type(F.col("title"), F.col("content"), F.col("neutrality_score"), lexicons.OPINION_MARKERS).alias("statement"))


@query("""SELECT id, coalesce(reliability_score >= 0.70 AND neutrality_score >= 0.60 AND statement_type = 'reporting' AND attribution_label = 'supported_claim' AND propaganda_label IN ('neutral', 'no_propaganda'), false) AS verified FROM articles""")
def verified_flags(spark, d):
    cols = [F.col(c) for c in ("reliability_score", "neutrality_score", "statement_type", "attribution_label", "propaganda_label")]
    return table(spark, d, "articles").select("id", scoring.is_verified(*cols).alias("verified"))


def _normal_sql(c: str) -> str:
    return rf"""translate(replace(regexp_replace(nfc_normalize(coalesce({c}, '')), '[\x{{064b}}-\x{{065f}}\x{{0610}}-\x{{061a}}\x{{06d6}}-\x{{06dc}}\x{{06df}}-\x{{06e8}}\x{{06ea}}-\x{{06ed}}]', '', 'g'), chr(1600), ''), 'آأإٱٲٳٴٵ', 'اااااااا')"""


def _tokens_sql(c: str) -> str:
    return rf"regexp_extract_all({c}, '[a-zA-Z0-9\x{{0600}}-\x{{06ff}}\x{{0750}}-\x{{077f}}\x{{fb50}}-\x{{fdff}}\x{{fe70}}-\x{{feff}}]+')"


_BARE = "translate(w, 'ةأإآ', 'هااا')"
_HEADLESS = "CASE " + " ".join(f"WHEN starts_with({_BARE}, '{p}') AND length({_BARE}) > {len(p) + 2} THEN substring({_BARE}, {len(p) + 1})" for p in t.PREFIXES_B) + f" ELSE {_BARE} END"
_TAILLESS = "CASE " + " ".join(f"WHEN ends_with(c, '{s}') AND length(c) > {len(s) + 1} THEN left(c, length(c) - {len(s)})" for s in t.SUFFIXES) + " ELSE c END"
_PHRASES = sorted(lexicons.LOADED, key=lambda p: (-len(p.split()), p))
_WEIGHT = "CASE m " + " ".join(f"WHEN ' {p.replace(' ', '  ')} ' THEN {lexicons.LOADED[p]}::DOUBLE" for p in _PHRASES) + " END"


def _stems_sql(tokens: str) -> str:
    return f"list_filter(list_transform(list_transform({tokens}, lambda w: {_HEADLESS}), lambda c: {_TAILLESS}), lambda x: x <> '')"


def _share_sql(w: str) -> str:
    """Each stem between blanks of its own, so that phrases met one after the other don't share one."""
    met = f"regexp_extract_all(array_to_string(list_transform({w}, lambda x: ' ' || x || ' '), ''), '{'|'.join(' ' + p.replace(' ', '  ') + ' ' for p in _PHRASES)}')"
    return f"CASE WHEN len({w}) = 0 THEN 0 ELSE coalesce(list_reduce(list_transform({met}, lambda m: {_WEIGHT}), lambda a, b: a + b, 0::DOUBLE), 0) / len({w}) END"


@query(f"SELECT id, {_share_sql('w')} AS ratio FROM (SELECT id, {_stems_sql(_tokens_sql(_normal_sql('content')))} AS w FROM articles)")
def loaded_ratio(spark, d):
    a = table(spark, d, "articles").select("id", t.tokenize(t.normalize(F.col("content"))).alias("w"))
    return a.select("id", t.loaded_ratio(F.col("w"), lexicons.LOADED).alias("ratio"))


_ARABIC_SHARE = r"length(regexp_replace(x, '[^\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]', '', 'g'))::DOUBLE / length(x)"
_NOT_BODY = f"c0 = '' OR (length(c0) < 250 AND len(list_filter({sql_list(lexicons.BOILERPLATE)}, lambda k: contains(c0, k))) >= 2) OR length({sql_strip('c0')}) < 40"
_OPINION = f"len(list_filter({sql_list(lexicons.OPINION_MARKERS)}, lambda m: contains(lower(coalesce(title, '') || ' ' || coalesce(content, '')), m))) > 0"


@query(f"""WITH p AS (SELECT id, source_name, title, CASE WHEN {_NOT_BODY} THEN title ELSE c0 END AS content FROM (SELECT *, coalesce(content, '') AS c0 FROM articles)),
    g AS (SELECT * FROM (SELECT *, concat_ws(' ', title, content) AS x FROM p) WHERE length(x) > 0 AND {_ARABIC_SHARE} >= 0.40),
    c AS (SELECT *, string_split({_plain_sql('title')}, '') AS ct, string_split({_plain_sql('content')}, '') AS cc FROM g),
    n AS (SELECT *, {_normal_sql(_joined_sql('ct'))} AS nt, {_normal_sql(_joined_sql('cc'))} AS nc FROM c),
    k AS (SELECT *, {_tokens_sql("concat_ws(' ', nt, nc)")} AS w FROM n),
    s AS (SELECT *, {_stems_sql('w')} AS every, {_stems_sql(f"list_filter(w, lambda x: NOT list_contains({sql_list(lexicons.STOPWORDS)}, x))")} AS kept FROM k),
    r AS (SELECT *, {_share_sql('every')} AS ratio, floor(greatest(0::DOUBLE, 1 - 20 * {_share_sql('kept')}) * 100 + 0.5) / 100 AS neutrality_score, {_ATTR} AS attribution_score FROM s),
    a AS (SELECT r.*, floor((0.35::DOUBLE * coalesce(l.s, 0.40) + 0.35::DOUBLE * neutrality_score + 0.15::DOUBLE * attribution_score + 0.15::DOUBLE) * 100 + 0.5) / 100 AS reliability_score,
        CASE WHEN {_OPINION} OR neutrality_score < 0.50 THEN 'opinion' ELSE 'reporting' END AS statement_type, CASE WHEN attribution_score >= 0.30 THEN 'supported_claim' ELSE 'unsupported_claim' END AS attribution_label,
        CASE WHEN ratio >= 0.02 OR (1 - neutrality_score) * 100 > 50 THEN 'propaganda' ELSE 'neutral' END AS propaganda_label FROM r LEFT JOIN {_LAST_AUTHORITY} l ON r.source_name = l.name)
    SELECT id, reliability_score, neutrality_score, attribution_score, propaganda_label, statement_type, attribution_label,
        reliability_score >= 0.70 AND neutrality_score >= 0.60 AND statement_type = 'reporting' AND attribution_label = 'supported_claim' AND propaganda_label = 'neutral' AS verified FROM a""")
def scored_articles(spark, d):
    a = table(spark, d, "articles").select("id", "url", "title", "content", "source_name")
    return pipeline.scored(pipeline.prepared(a), table(spark, d, "sources")).select("id", "reliability_score", "neutrality_score", "attribution_score", "propaganda_label", "statement_type", "attribution_label", "verified")


@query()
def ingest_pipeline(spark, d):
    a = table(spark, d, "articles").select("id", "url", "title", "content", "source_name", "is_processed", "persons", "organizations", "locations", "scraped_at")
    return pipeline.ingest_stories(a.filter("not is_processed"), a.filter("is_processed"), table(spark, d, "sources"), _poll()).select("id", "reliability_score", "propaganda_label", "verified", "batch", "cluster")


# ---- vectors


@query("""WITH c AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos),
    n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM c GROUP BY label), e AS (SELECT vec_id, label AS own, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    s AS (SELECT vec_id, own, c.label, sum(x::DOUBLE * m) / any_value(norm) AS sim FROM e JOIN c USING (pos) JOIN n ON n.label = c.label GROUP BY ALL)
    SELECT own AS label, nearest, count(*) AS n FROM (SELECT vec_id, own, arg_max(label, sim) AS nearest FROM s GROUP BY ALL) GROUP BY ALL""")
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    c = similarity.centroids(e, "label", "embedding").select(F.col("label").alias("to"), "centroid")
    # one centroid per label: a bounded set of rows against all rows
    packed = c.agg(F.collect_list(F.struct("to", "centroid")).alias("all"))
    s = e.join(F.broadcast(packed)).select("vec_id", "label", F.transform("all", lambda x: F.struct(similarity.dot(F.col("embedding"), x["centroid"]).alias("sim"), x["to"].alias("to"))).alias("s"))
    return s.select("label", F.array_max("s")["to"].alias("nearest")).groupBy("label", "nearest").agg(F.count("*").alias("n"))


@query()
def incremental_cluster(spark, d):
    """Stories among the articles of each poll, over all sources, dated or not."""
    a = table(spark, d, "articles").select("id", "title", "title_clean", "content_clean", "persons", "organizations", "locations", _poll().alias("batch"))
    return pipeline.stories(a, "batch", "id")


# ---- metrics and samples

_GOLD = _FIX.format("propaganda")


@query(f"""WITH x AS (SELECT {_GOLD} AS g, propaganda_prediction AS p FROM article_feedback), b AS (SELECT g <> 'neutral' AS g, p <> 'neutral' AS p FROM x WHERE g IS NOT NULL AND p IS NOT NULL),
    c AS (SELECT count(*) FILTER (NOT g AND NOT p) AS tn, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (g AND p) AS tp FROM b)
    SELECT tn, fp, fn, tp, (tp + tn)::DOUBLE / (tn + fp + fn + tp) AS accuracy, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1 FROM c""")
def confusion_matrix(spark, d):
    f = table(spark, d, "article_feedback")
    gold = t.corrected(F.col("propaganda_correct"), F.col("corrected_propaganda"), F.col("propaganda_prediction"))
    return metrics.binary(f, gold != "neutral", F.col("propaganda_prediction") != "neutral")


@query(f"""WITH x AS (SELECT {_GOLD} AS g, propaganda_prediction AS p FROM article_feedback WHERE propaganda_prediction IS NOT NULL),
    a AS (SELECT g AS label, count(*) AS support, count(*) FILTER (g = p) AS tp FROM x GROUP BY 1), b AS (SELECT p AS label, count(*) AS predicted FROM x GROUP BY 1)
    SELECT coalesce(a.label, b.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted,
    CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE coalesce(tp, 0)::DOUBLE / predicted END AS precision, CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall,
    2 * coalesce(tp, 0)::DOUBLE / (coalesce(support, 0) + coalesce(predicted, 0)) AS f1 FROM a FULL JOIN b ON a.label = b.label""")
def per_class_prf(spark, d):
    f = table(spark, d, "article_feedback").filter("propaganda_prediction is not null")
    gold = t.corrected(F.col("propaganda_correct"), F.col("corrected_propaganda"), F.col("propaganda_prediction"))
    return metrics.per_class(f.select(gold.alias("g"), F.col("propaganda_prediction").alias("p")), "g", "p")


@query("""WITH x AS (SELECT verified AS g, reliability_score AS s FROM articles WHERE verified IS NOT NULL AND reliability_score IS NOT NULL AND NOT isnan(reliability_score)),
    t AS (SELECT DISTINCT s AS threshold FROM x), c AS (SELECT threshold, count(*) FILTER ((s > threshold) = g) AS correct, count(*) AS total FROM x, t GROUP BY threshold)
    SELECT threshold, correct, total FROM c ORDER BY correct DESC, threshold LIMIT 1""")
def threshold_tune(spark, d):
    a = table(spark, d, "articles").filter("not isnan(reliability_score)")
    return metrics.best_threshold(a, F.col("verified"), F.col("reliability_score"))


@query("""WITH x AS (SELECT rec_id, coalesce(propaganda_label = 'propaganda', false) AS m FROM approved_feedback_dataset), n AS (SELECT count(*) FILTER (m) AS pos, count(*) FILTER (NOT m) AS neg FROM x),
    r AS (SELECT rec_id, m, row_number() OVER (PARTITION BY m ORDER BY rec_id) - 1 AS k FROM x)
    SELECT rec_id, CASE WHEN m THEN greatest(pos, neg) // pos + CASE WHEN k < greatest(pos, neg) % pos THEN 1 ELSE 0 END ELSE 1 END AS copies FROM r, n""")
def oversample_counts(spark, d):
    x = sampling.oversampled(table(spark, d, "approved_feedback_dataset"), "rec_id", F.col("propaganda_label") == "propaganda")
    return x.select("rec_id", F.col("copies").cast("bigint").alias("copies"))


@query("""WITH n AS (SELECT count(*) AS n FROM approved_feedback_dataset), p AS (SELECT rec_id, row_number() OVER (ORDER BY md5(rec_id::VARCHAR || ':11'), rec_id) - 1 AS k FROM approved_feedback_dataset)
    SELECT b AS block, rec_id AS id FROM p, n, range(24) t(b) WHERE k >= b * greatest(0, (n - 250) // 23) AND k < b * greatest(0, (n - 250) // 23) + 250""")
def block_sample(spark, d):
    r = table(spark, d, "approved_feedback_dataset")
    return sampling.blocks(r, "rec_id").select(F.col("block").cast("bigint").alias("block"), "id")


@query("SELECT rec_id AS id FROM (SELECT rec_id, row_number() OVER (PARTITION BY coalesce(propaganda_label, '') ORDER BY md5(rec_id::VARCHAR || ':42'), rec_id) AS k FROM approved_feedback_dataset) WHERE k <= 20")
def stratified_probe(spark, d):
    return sampling.stratified(table(spark, d, "approved_feedback_dataset"), "rec_id", F.col("propaganda_label"), 20)


@query(f"""SELECT rec_id, title, text, {_share_sql('w')} AS ratio, CASE propaganda_label WHEN 'neutral' THEN 0 WHEN 'loaded_language' THEN 1 WHEN 'doubt_casting' THEN 1 WHEN 'propaganda' THEN 1 END AS propaganda,
    CASE statement_type WHEN 'reporting' THEN 0 WHEN 'opinion' THEN 1 WHEN 'speculation' THEN 1 END AS statement FROM (SELECT *, {_stems_sql(_tokens_sql(_normal_sql('text')))} AS w FROM approved_feedback_dataset)
    WHERE propaganda_label IN ('neutral', 'loaded_language', 'doubt_casting', 'propaganda') AND statement_type IN ('reporting', 'opinion', 'speculation') AND text <> ''""")
def supervised_rows(spark, d):
    r = table(spark, d, "approved_feedback_dataset").filter("text <> ''")
    ratio = t.loaded_ratio(t.tokenize(t.normalize(F.col("text"))), lexicons.LOADED)
    x = r.select("rec_id", "title", "text", ratio.alias("ratio"), t.mapped(F.col("propaganda_label"), t.PROPAGANDA_CODES).alias("propaganda"), t.mapped(F.col("statement_type"), t.STATEMENT_CODES).alias("statement"))
    return x.filter("propaganda is not null and statement is not null")


# ---- events


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    s = ingest.sessions(table(spark, d, "events"), "ts", "user_id")
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")


# ---- conversations and summaries


@query("""SELECT rec_id, '<start_of_turn>user' || chr(10) || 'Classify the text.' || chr(10) || chr(10) || """ + sql_strip("title") + """ || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || propaganda_label || '<end_of_turn>' || chr(10) AS text
    FROM approved_feedback_dataset WHERE title IS NOT NULL AND propaganda_label IS NOT NULL""")
def chat_render(spark, d):
    from warraq.operators import summaries

    r = table(spark, d, "approved_feedback_dataset").filter("title is not null and propaganda_label is not null")
    turns = t.messages(F.lit("Classify the text."), F.col("title"), F.col("propaganda_label"))
    return r.select("rec_id", summaries.render_chat(turns).alias("text"))


@query()
def cluster_summaries(spark, d):
    from warraq.operators import summaries

    return summaries.summarized(table(spark, d, "clusters"), table(spark, d, "articles"), 2026).select("id", "summary")


@query("""WITH n AS (SELECT id FROM article_feedback WHERE status = 'approved' AND training_job_id IS NULL GROUP BY id ORDER BY id LIMIT 25)
    SELECT f.id, f.status, CASE WHEN n.id IS NOT NULL AND f.status = 'approved' AND f.training_job_id IS NULL THEN 999 ELSE f.training_job_id END AS training_job_id FROM article_feedback f LEFT JOIN n ON f.id = n.id""")
def stamped_some(spark, d):
    return feedback.stamp_job(table(spark, d, "article_feedback"), 999, most=25).select("id", "status", F.col("training_job_id").cast("bigint").alias("training_job_id"))


@query("""SELECT f.id, f.status, CASE WHEN f.status = 'approved' AND f.training_job_id IS NULL THEN 999 ELSE f.training_job_id END AS training_job_id FROM article_feedback f""")
def stamped_feedback(spark, d):
    return feedback.stamp_job(table(spark, d, "article_feedback"), 999).select("id", "status", F.col("training_job_id").cast("bigint").alias("training_job_id"))


# ---- search, samples and metrics of the rest


@query("""SELECT id, title, source_name FROM articles WHERE published_at >= TIMESTAMP '2025-01-01' AND (contains(coalesce(title, ''), 'القمح') OR contains(coalesce(content, ''), 'القمح'))
    AND (contains(coalesce(title, ''), 'دمشق') OR contains(coalesce(content, ''), 'دمشق')) ORDER BY published_at DESC, id DESC LIMIT 10""")
def typed_search(spark, d):
    return api.search(table(spark, d, "articles"), "القمـــح في دِمشق؟", F.lit("2025-01-01").cast("timestamp"), 50).select("id", "title", "source_name")


@query(f"SELECT rec_id FROM approved_feedback_dataset WHERE length({sql_strip('text')}) >= 10")
def long_enough_rows(spark, d):
    return table(spark, d, "approved_feedback_dataset").filter(t.long_enough(F.col("text"))).select("rec_id")


@query("SELECT propaganda_label, count(*) AS n, avg(word_count) AS mean FROM articles GROUP BY 1")
def class_means(spark, d):
    return metrics.class_means(table(spark, d, "articles"), "propaganda_label", F.col("word_count"))


@query(f"SELECT count(*) AS rows, max(n) AS longest, avg(n) AS mean, count(*) FILTER (n > 120) AS over FROM (SELECT len({sql_words('text')})::INT AS n FROM approved_feedback_dataset ORDER BY rec_id LIMIT 200)")
def length_stats(spark, d):
    return metrics.length_stats(table(spark, d, "approved_feedback_dataset"), "rec_id", t.word_count(F.col("text")), 120)


@query("SELECT id, row_number() OVER (PARTITION BY coalesce(cluster_id, -1) ORDER BY id) AS place FROM articles")
def numbered_in_cluster(spark, d):
    return sampling.numbered(table(spark, d, "articles"), "id", F.coalesce("cluster_id", F.lit(-1)))


@query("SELECT rec_id FROM approved_feedback_dataset ORDER BY md5(rec_id::VARCHAR || ':42'), rec_id LIMIT 400")
def shuffled_cap(spark, d):
    return sampling.shuffled(table(spark, d, "approved_feedback_dataset"), "rec_id", 400).select("rec_id")


@query("SELECT rec_id, row_number() OVER (ORDER BY md5(rec_id::VARCHAR || ':11'), rec_id) > count(*) OVER () - floor(count(*) OVER () * 0.1 + 1e-9) AS held_out FROM approved_feedback_dataset")
def held_out_split(spark, d):
    return sampling.split(table(spark, d, "approved_feedback_dataset"), "rec_id").select("rec_id", "held_out")


_ONCE = "(SELECT DISTINCT id, propaganda_correct FROM article_feedback WHERE propaganda_correct IS NOT NULL)"


@query(f"SELECT id, propaganda_correct AS right FROM (SELECT *, row_number() OVER (PARTITION BY propaganda_correct ORDER BY md5(id::VARCHAR || ':123'), id) AS k FROM {_ONCE}) WHERE k <= 5")
def right_and_wrong_samples(spark, d):
    return sampling.right_and_wrong(table(spark, d, "article_feedback").select("id", "propaganda_correct").distinct(), "id", F.col("propaganda_correct"))


@query("SELECT status, count(*) AS rows, count(*) - count(propaganda_prediction) AS failed, (count(*) - count(propaganda_prediction))::DOUBLE / count(*) AS failure_rate FROM article_feedback GROUP BY status")
def parse_failures(spark, d):
    return metrics.parse_failures(table(spark, d, "article_feedback"), F.col("propaganda_prediction"), ["status"])


@query("SELECT count(*) AS outputs, count(*) FILTER (propaganda_label IN ('propaganda', 'neutral')) AS compliant, count(*) FILTER (propaganda_label IN ('propaganda', 'neutral'))::DOUBLE / count(*) AS compliance FROM articles")
def format_compliance(spark, d):
    text = F.concat(F.lit("Verdict: "), F.coalesce("propaganda_label", F.lit("")), F.lit("\nTechnique: none"))
    return metrics.compliance(table(spark, d, "articles"), t.parse_prediction(text, {})["format_matched"])


@query("""WITH x AS (SELECT verified AS g, reliability_score > 0.6 AS p FROM articles WHERE verified IS NOT NULL AND reliability_score IS NOT NULL),
    c AS (SELECT count(*) FILTER (NOT g AND NOT p) AS tn, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (g AND p) AS tp FROM x)
    SELECT tn, fp, fn, tp, (tp + tn)::DOUBLE / (tn + fp + fn + tp) AS accuracy, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1 FROM c""")
def calibrated_metrics(spark, d):
    return metrics.calibrated(table(spark, d, "articles"), F.col("verified"), F.col("reliability_score"), 0.6)


def _task_sql(x: str) -> str:
    return f"count(*) FILTER ({_FIX.format(x)} = {x}_prediction)::DOUBLE / count({_FIX.format(x)})"


@query(f"""SELECT *, (accuracy_0 + accuracy_1 + accuracy_2) / 3 AS mean_accuracy FROM (SELECT {_task_sql('propaganda')} AS accuracy_0, {_task_sql('statement')} AS accuracy_1, {_task_sql('attribution')} AS accuracy_2 FROM article_feedback)""")
def task_accuracies(spark, d):
    tasks = [(t.corrected(F.col(f"{x}_correct"), F.col(f"corrected_{x}"), F.col(f"{x}_prediction")), F.col(f"{x}_prediction")) for x in feedback.TASKS]
    return metrics.mean_accuracy(table(spark, d, "article_feedback"), tasks)


@query(f"WITH x AS (SELECT {_GOLD} AS g, propaganda_prediction AS p FROM article_feedback) SELECT count(*) AS rows, count(*) FILTER (g = p)::DOUBLE / count(*) AS exact, count(*) FILTER (g = p)::DOUBLE / count(*) AS \"primary\" FROM x WHERE g IS NOT NULL")
def exact_and_primary(spark, d):
    gold = t.corrected(F.col("propaganda_correct"), F.col("corrected_propaganda"), F.col("propaganda_prediction"))
    return metrics.exact_and_primary(table(spark, d, "article_feedback"), gold, F.col("propaganda_prediction"))


@query("""WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (q.l * e.l) AS sim FROM n q, n e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
    SELECT query_id, vec_id, place FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s) WHERE place <= 10""")
def cosine_topk(spark, d):
    """The ten nearest rows of every row whose id is divisible by 100, against all rows."""
    e = table(spark, d, "embeddings")
    return similarity.nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


@query("SELECT DISTINCT event_type, user_id, epoch_us(date_trunc('day', ts)) AS day FROM events")
def stream_distinct(spark, d):
    """Events read as a stream, to its end, without those that repeat user, type and day."""
    from warraq.runtime import shared_dir

    s = ingest.read_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    s = s.select("user_id", "event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("t")).withColumn("k", F.concat_ws("|", "user_id", "event_type", "t")).dropDuplicates(["k"])
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ingest.run(s, ingest.idempotent_sink(f"{at}/out", "k"), f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_type", "user_id", F.unix_micros("t").alias("day"))


# ---- rules on fixed inputs, against results worked out by hand


def fixture(name: str, rows: list[tuple[str, str, str | None]], build: Callable[[DataFrame], DataFrame]) -> None:
    """A query over given inputs (case, input, wanted output): case and output must agree with the wanted ones."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    sql = "SELECT * FROM (VALUES " + ", ".join(f"({quote(c)}, {quote(o)})" for c, _, o in rows) + ") AS v(\"case\", output)"

    def run(spark, d):
        return build(spark.createDataFrame([(c, i) for c, i, _ in rows], "case string, x string")).select("case", "output")

    run.__name__ = name
    query(sql)(run)


_P = "<p>" + "كلمة " * 20 + "</p>"
fixture("html_main_content", [
    ("article", f"<html><body><nav><p>{'menu ' * 50}</p></nav><article>{_P}{_P}<p>short</p></article></body></html>", " ".join(["كلمة " * 19 + "كلمة"] * 2)),
    ("sidebar", f"<div class='sidebar-x'>{_P}</div><div class='article-body'>{_P}{_P}</div>", " ".join(["كلمة " * 19 + "كلمة"] * 2)),
    ("nothing", "<div>tiny</div>", None),
], lambda x: x.withColumn("output", main_text_column(F.col("x"))))

fixture("cleaning_rules", [
    ("marks", "مشرّف", "مشر ف"), ("long letters", "مـــهم", "مــهم"), ("digits", "٠١٢٣ ۰۸", "0123 0۸"), ("runs", "aaaa bbb", "aa bb"), ("link", "see https://a.b/c?d=1 now", "see now"), ("address", "mail x.y@z.org and @me", "mail and"),
    ("quotes", "«قال» “نعم” 'لا'", "«قال» “نعم” 'لا'"), ("colon", "خبر: عاجل!", "خبر عاجل"), ("markup", "<b>one</b> &lt;two&gt; &amp; <script>x</script>three", "one two three"), ("references", "caf&eacute; &#1602;", "café ق"), ("nothing", "", ""),
], lambda x: x.withColumn("output", t.clean(F.col("x"))))

fixture("stemming_rules", [
    ("article", "الكتاب", "كتاب"), ("and the", "والمدرسة", "مدرسه"), ("plural", "معلمون", "معلم"), ("too short", "الي", "ال"), ("hamza", "أحمد", "احمد"), ("for the", "للناس", "ناس"), ("latin", "the", "the"),
], lambda x: x.withColumn("output", t.light_stem(F.col("x"))))

fixture("source_label_rules", [
    ("negated", "Non-Propagandistic", "neutral|reporting|supported_claim"), ("named", "propagandistic text", "propaganda|opinion|unsupported_claim"), ("underscore", "non_propaganda", "neutral|reporting|supported_claim"), ("yes", " YES ", "propaganda|opinion|unsupported_claim"),
    ("one", "1", "propaganda|opinion|unsupported_claim"), ("zero", "0", "neutral|reporting|supported_claim"), ("unknown", "maybe propaganda", "neutral|reporting|supported_claim"), ("word", "propaganda", "propaganda|opinion|unsupported_claim"),
], lambda x: x.withColumn("output", F.concat_ws("|", t.labels_of_source(F.col("x"))["propaganda"], t.labels_of_source(F.col("x"))["statement"], t.labels_of_source(F.col("x"))["attribution"])))

fixture("verdict_rules", [
    ("neutral", "Verdict: Neutral", "false"), ("technique", "verdict : Propaganda\nTechnique: doubt", "true"), ("no verdict", "Doubt\nneutral", "true"), ("only neutral", " neutral ", "false"), ("empty", "", "false"), ("none", "None", "false"),
], lambda x: x.withColumn("output", t.says_propaganda(F.col("x")).cast("string")))

fixture("gold_label_rules", [
    ("none", "No Technique", "Neutral"), ("true", "TRUE", "Propaganda"), ("name", " Doubt ", "Doubt"), ("empty", "", "Neutral"), ("false", "False", "Neutral"),
], lambda x: x.withColumn("output", t.gold_label(F.col("x"))))

fixture("entity_rules", [
    ("words", "زار خالد العلي بيروت", "خالد العلي"), ("inside a word", "الخالد العلية", ""), ("two", "خالد العلي مع سامي", "خالد العلي,سامي"),
], lambda x: x.withColumn("output", F.array_join(t.routed(entities.listed({"PER": ["خالد", "خالد العلي", "سامي"], "LOC": ["بيروت"]})(F.col("x")), "PER"), ",")))

_ITEM = "<rss><channel><item><title>خبر</title><link>http://a/1?x=1&amp;y=2</link><description>{}</description><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate></item></channel></rss>"
fixture("feed_entry_rules", [
    ("escaped markup", _ITEM.format("&lt;p&gt;نص &amp;amp; نص&lt;/p&gt;"), "http://a/1?x=1&y=2|نص & نص|1736157600"), ("cdata", _ITEM.format("<![CDATA[<b>نص</b> قصير]]>"), "http://a/1?x=1&y=2|نص قصير|1736157600"),
    ("twice escaped", _ITEM.format("نص طويل &amp;lt;ب&amp;gt; نص طويل جدا"), "http://a/1?x=1&y=2|نص طويل &lt;ب&gt; نص طويل جدا|1736157600"),
], lambda x: feeds.articles_of(feeds.entries(x.select(F.col("case").alias("feed"), F.col("x").alias("xml")))).select(F.col("feed").alias("case"), F.concat_ws("|", "url", "content", F.unix_seconds("published_at")).alias("output")))


def _halves(of: Callable[[Column], Column]) -> list[Column]:
    return [of(F.split("x", r"\|\|")[k]) for k in (0, 1)]


def _listed(c: Column) -> Column:
    return F.filter(F.split(c, ","), lambda x: x != "")


fixture("entity_overlap_rules", [
    ("equal", "تونس||تونس,بيروت", "true"), ("held without articles", "مدينة الرباط||رباط", "true"), ("too short", "الري||ري", "false"), ("none", "||تونس", "false"), ("different", "بغداد||دمشق", "false"),
], lambda x: x.withColumn("output", t.share_entities(*_halves(_listed)).cast("string")))

_PLACES = {"a": ["x", "two words"], "b": ["y"], "c": ["z"]}
fixture("place_conflict_rules", [
    ("two domains", "x||y", "true"), ("case ignored", "X||y", "true"), ("one within the other", "x,y||y", "false"), ("unknown", "q||y", "false"), ("same", "x||two words", "false"), ("three", "x,y||y,z", "true"),
], lambda x: x.withColumn("output", t.geo_conflict(*_halves(lambda c: t.domains(_listed(c), F.lit(""), _PLACES))).cast("string")))

fixture("title_conflict_rules", [
    ("stems meet", "المدرسة تفتح||مدرسة قديمة", "false"), ("nothing in common", "سعر القمح||حريق بيروت", "true"), ("no words", "||حريق بيروت", "false"), ("quotes and colon", "«القمح» سعر:||القمح يرتفع", "false"), ("only ignored words", "في من على||حريق بيروت", "false"),
], lambda x: x.withColumn("output", t.title_conflict(*_halves(lambda c: t.title_words(c, lexicons.IGNORED_TITLE_WORDS))).cast("string")))

fixture("time_rules", [
    ("zone by name", "Mon, 06 Jan 2025 10:00:00 GMT", "1736157600"), ("offset", "Tue, 07 Jan 2025 01:30:00 +0300", "1736202600"), ("iso", "2025-01-06T10:00:00Z", "1736157600"), ("no time", "soon", None),
], lambda x: x.withColumn("output", F.unix_seconds(t.parse_time(F.col("x"))).cast("string")))

fixture("title_suffix_rules", [("one", "خبر عاجل - الموقع", "خبر عاجل"), ("two", "a - b - c", "a - b"), ("none", "a-b", "a-b")], lambda x: x.withColumn("output", t.without_suffix(F.col("x"))))

fixture("leading_hook_rules", [
    ("question", "ما هذا؟ " + "كلمة " * 20, ("كلمة " * 20).strip()), ("short sentence", "قصير. " + "x" * 90, "x" * 90), ("two of three", "من؟ لماذا؟ أين؟ " + "y" * 90, "أين؟ " + "y" * 90), ("too little left", "سؤال؟ نص", "سؤال؟ نص"),
], lambda x: x.withColumn("output", t.strip_hook(F.col("x"))))

fixture("final_label_rules", [
    ("last marker", "التقييم النهائي: propaganda\nx\nالتقييم النهائي: Neutral", "neutral"), ("both words", "neutral propaganda", "propaganda"), ("second line", "التقييم النهائي:\nx", "unknown"), ("nothing", "", "unknown"),
], lambda x: x.withColumn("output", t.parse_output(F.col("x"))))

fixture("prediction_rules", [
    ("techniques", "Verdict: Propaganda\nTechnique: doubt | LOADED.", "Doubt | Loaded,true"), ("neutral", "verdict: neutral\ntechnique: x", "Neutral,true"), ("no technique", "Verdict: propaganda", "Propaganda,true"), ("no verdict", "Technique: odd", "odd,false"), ("nothing", "", "Neutral,false"),
], lambda x: x.withColumn("output", F.concat_ws(",", *[t.parse_prediction(F.col("x"), {"doubt": "Doubt", "loaded": "Loaded"})[f].cast("string") for f in ("label", "format_matched")])))

fixture("degenerate_summary_rules", [
    ("empty", "", "true"), ("asks", "هل؟", "true"), ("list", "نص\n1. x", "true"), ("lone dash", "a\n-\nb", "true"), ("year near", "it was fine in 2021 and 2028", "false"), ("year before", "since 2020", "true"), ("year after", "until 2029", "true"), ("number", "12345 people", "false"), ("long", "x" * 601, "true"), ("longest", "x" * 600, "false"),
], lambda x: x.withColumn("output", t.is_degenerate(F.col("x"), 2026).cast("string")))

fixture("summary_tidy_rules", [("dashes", " -- نص", "نص"), ("markup", "<b>x</b>", "x"), ("blank lines", "a\n\n\nb", "a\nb"), ("heading", "a\n1. First: b", "a\nb")], lambda x: x.withColumn("output", t.tidy_summary(F.col("x"), F.lit(1))))

fixture("cut_rules", [("short", "abc", "abc"), ("at a space", "hello big world", "hello big"), ("no space", "abcdefghijkl", "abcdefghij")], lambda x: x.withColumn("output", t.cut_at_space(F.col("x"), 10)))

fixture("prompt_rules", [("ratio", "نص", "Title: خبر\nText: نص\nLoaded words: 0.1250")], lambda x: x.withColumn("output", t.prompt(F.lit("خبر"), F.col("x"), F.lit(0.125))))

fixture("script_rules", [("arabic", "نص عربي", "true"), ("latin", "plain", "false"), ("mixed", "نص ab", "true"), ("blank", "", "false"), ("presentation forms", "ﻧﺺ", "false")], lambda x: x.withColumn("output", t.is_script(F.col("x"), blocks=t.ARABIC_BLOCK).cast("string")))

fixture("content_or_title_rules", [
    ("short", "قصير", "عنوان"), ("long", "كلمة " * 10, "كلمة " * 10), ("boilerplate", "جميع الحقوق محفوظة لهذا الموقع الإلكتروني وشارك الخبر", "عنوان"),
], lambda x: x.withColumn("output", feeds.content_or_title(F.lit("عنوان"), F.col("x"), lexicons.BOILERPLATE)))

fixture("body_rules", [
    ("long page", f"<article>{_P * 5}</article>", " ".join(["كلمة " * 19 + "كلمة"] * 5)), ("short page", f"<article>{_P}</article>", "short"), ("no text", "<div>x</div>", "short"),
], lambda x: feeds.with_bodies(x.select("case", F.col("case").alias("url"), F.lit("short").alias("content")), x.select(F.col("case").alias("url"), F.col("x").alias("html"))).withColumnRenamed("content", "output"))

fixture("redirect_rules", [("known", "http://a", "http://b"), ("unknown", "http://c", "http://c")], lambda x: feeds.resolved(x.withColumnRenamed("x", "url"), x.sparkSession.createDataFrame([("http://a", "http://b")], "url string, target string")).withColumnRenamed("url", "output"))

fixture("search_entry_rules", [("new text", "خبر - موقع||نص الخبر", "خبر"), ("suffix kept once", "a - b - c||d", "a - b")], lambda x: feeds.search_entries(x.select("case", F.split("x", r"\|\|")[0].alias("title"), F.split("x", r"\|\|")[1].alias("content"))).withColumnRenamed("title", "output"))

fixture("relaxed_label_rules", [("among", "a | b||b", "b"), ("not among", "a | b||c", "a | b"), ("single", "a||a", "a")], lambda x: x.withColumn("output", metrics.relaxed(*_halves(lambda c: c))))

fixture("override_rules", [("much bias", "0.4,neutral", "propaganda"), ("at the bound", "0.5,neutral", "neutral"), ("other label", "0.1,satire", "satire"), ("none found", "0.2,no_propaganda", "propaganda")], lambda x: x.withColumn("output", scoring.bias_override(F.split("x", ",")[1], F.split("x", ",")[0].cast("double"))))

fixture("reliability_rules", [("all", "0.5,0.8,0.5", "0.68"), ("none", "0,0,0", "0.15"), ("best", "1,1,1", "1.0")], lambda x: x.withColumn("output", scoring.reliability(*[F.split("x", ",")[k].cast("double") for k in range(3)]).cast("string")))

fixture("conversation_rules", [("in turn", "user,assistant,user", "true"), ("system first", "system,user,assistant", "true"), ("twice", "user,user", "false"), ("assistant first", "assistant,user", "false")], lambda x: x.withColumn("output", summaries.alternates(F.transform(F.split("x", ","), lambda r: F.struct(r.alias("role"), r.alias("content")))).cast("string")))

fixture("summary_prompt_rules", [
    ("two texts", "one text here.||another text.", "Summarize the text.\n\n--- 1 ---\none text here.\n\n--- 2 ---\nanother text."), ("blank left out", "one|| ", "Summarize the text.\n\n--- 1 ---\none"),
], lambda x: x.withColumn("output", summaries.prompt(F.split("x", r"\|\|"))))


# ---- changes of tables, as new tables


@query("SELECT id, CASE WHEN article_id IS NULL THEN 'rejected' ELSE status END AS status, CASE WHEN article_id IS NULL THEN 'no article' ELSE admin_notes END AS admin_notes FROM article_feedback")
def feedback_with_status(spark, d):
    return feedback.with_status(table(spark, d, "article_feedback"), F.col("article_id").isNull(), "rejected", "no article").select("id", "status", "admin_notes")


@query("""WITH a AS (SELECT coalesce(max(propaganda_f1), 0) AS best FROM training_job WHERE is_active) SELECT id, CASE WHEN id = 3 THEN 'COMPLETED' ELSE status END AS status, CASE WHEN id = 3 THEN 0.99 ELSE propaganda_f1 END AS propaganda_f1,
    CASE WHEN id = 3 THEN 0.99 >= best ELSE is_active AND NOT (0.99 >= best) END AS is_active FROM training_job, a""")
def finished_job(spark, d):
    return feedback.finish_job(table(spark, d, "training_job"), 3, 0.99).select("id", "status", "propaganda_f1", "is_active")


@query("""SELECT f.id + 1000000 AS id, f.article_id, a.propaganda_label AS propaganda_prediction, a.statement_type AS statement_prediction, a.attribution_label AS attribution_prediction, 'pending' AS status FROM (SELECT DISTINCT id, article_id FROM article_feedback) f JOIN articles a ON a.id = f.article_id""")
def inserted_feedback(spark, d):
    f = table(spark, d, "article_feedback")
    given = f.select((F.col("id") + 1000000).alias("id"), "article_id").distinct()
    every = feedback.inserted(f, table(spark, d, "articles"), given).filter("id >= 1000000")
    return every.select("id", "article_id", "propaganda_prediction", "statement_prediction", "attribution_prediction", "status")


@query("SELECT id, title FROM articles WHERE source_name = 'Luban Telegraph' ORDER BY id DESC LIMIT 20")
def listing_of_source(spark, d):
    return api.listing(table(spark, d, "articles"), "Luban Telegraph").select("id", "title")
