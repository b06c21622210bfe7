from pyspark.sql import functions as F

from warraq.functions import sql
from warraq.operators import feedback, summaries


def test_chat(spark):
    d = spark.createDataFrame([([("system", " be kind "), ("user", " hi "), ("assistant", "yo")],), ([("user", "a"), ("user", "b")],)], "t array<struct<role:string,content:string>>")
    got = [tuple(r) for r in d.select(summaries.render_chat(F.col("t")), summaries.alternates(F.col("t"))).collect()]
    assert got[0] == ("<start_of_turn>user\nbe kind\n\nhi<end_of_turn>\n<start_of_turn>model\nyo<end_of_turn>\n", True) and got[1][1] is False


def test_summaries(spark):
    long = "الجملة الأولى طويلة بما يكفي لتبقى هنا. " + "حشو " * 60
    c = spark.createDataFrame([(1, "ok text in 2025"), (2, None), (3, "")], "id long, summary string")
    a = spark.createDataFrame([(1, 2, long), (2, 2, long), (3, 3, "قصير")], "id long, cluster_id long, content string").withColumns({"content_clean": F.lit(None).cast("string"), "title": F.lit("t")})
    got = {r["id"]: r["summary"] for r in summaries.summarized(c, a, 2026).collect()}
    assert got == {1: "ok text in 2025", 2: "الجملة الأولى طويلة بما يكفي لتبقى هنا.", 3: summaries.TOO_SHORT}


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("select text_strip(' a\t'), text_truthy('', 'b'), set_overlap(array('a'), array('a', 'b')), cosine_of(array(1D, 0D), array(1D, 0D)), text_fingerprint('A  b') = md5('a b')").first()
    assert tuple(r) == ("a", "b", 0.5, 1.0, True)


def test_insert(spark):
    f = spark.createDataFrame([(1, 10, "neutral", "approved")], "id long, article_id long, propaganda_prediction string, status string")
    a = spark.createDataFrame([(11, "propaganda", "opinion", "x")], "id long, propaganda_label string, statement_type string, attribution_label string")
    new = spark.createDataFrame([(2, 11), (3, 99)], "id long, article_id long")
    assert sorted(tuple(r) for r in feedback.inserted(f, a, new).collect()) == [(1, 10, "neutral", "approved"), (2, 11, "propaganda", "pending")]
