import random

import pytest
from pyspark.sql import functions as F

from warraq.operators import clustering, dedup, feedback, metrics, sampling, scoring, similarity, summaries
from warraq.operators.prefix import running_sum
from warraq.runtime import cut
from warraq.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_sum(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randint(0, 5), rng.choice([None, 1, 2, 7])) for i in range(300)]
    d = spark.createDataFrame(data, "id long, g string, k int, v int")
    got = {r["id"]: r["before"] for r in running_sum(d, "id", F.col("g"), [F.col("k")], F.col("v")).collect()}
    want, sums = {}, {}
    for i, g, k, v in sorted(data, key=lambda x: (x[1] or "", x[2], x[0])):
        want[i] = sums.get(g or "", 0)
        sums[g or ""] = want[i] + (v or 0)
    assert got == want
    assert running_sum(d.limit(0), "id", F.col("g"), []).count() == 0


def test_greedy_chain(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "a long, b long, overlap double")
    assert rows(dedup.greedy(ids, pairs)) == [(1, False), (2, True), (3, False), (4, True), (5, False), (6, False)]


def test_dedup_kinds(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words).upper() + " ", " ".join([*words[:39], "zz"]), "", None, "  ", "two words", "two  words", "else"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: (r["is_duplicate"], r["dup_kind"]) for r in dedup.deduplicated(d, "id", F.col("text")).collect()}
    assert got[0] == (False, None) and got[1] == (True, "exact") and got[2] == (True, "near")
    assert got[3] == got[4] == got[5] == (False, None) and got[7] == (True, "exact") and got[8] == (False, None)


def test_dedup_against_known(spark):
    words = [f"w{i}" for i in range(40)]
    text, near, other = " ".join(words), " ".join([*words[:39], "zz"]), " ".join(f"v{i}" for i in range(9))
    known = spark.createDataFrame([(1, text), (9, near), (5, other)], "id long, text string")
    d = spark.createDataFrame([(1, other), (2, near), (3, text.upper()), (4, "a new text here"), (5, "a new text here"), (6, None), (7, " ".join([*words[:38], "yy", "zz"]))], "id long, text string")
    got = {r["id"]: (r["is_duplicate"], r["dup_kind"]) for r in dedup.deduplicated(d, "id", F.col("text"), known=known).collect()}
    assert got == {1: (True, "exact"), 2: (True, "exact"), 3: (True, "exact"), 4: (False, None), 5: (True, "exact"), 6: (False, None), 7: (True, "near")}


def test_ingest_leaves_out_copies_of_stored_articles(spark):
    from warraq.plans import pipeline

    text = "اعلنت الوزارة اليوم عن خطة جديدة لتطوير التعليم في جميع المدارس خلال العام القادم"
    cols = "id long, url string, title string, content string, source_name string"
    known = spark.createDataFrame([(1, "u1", "خطة التعليم", text, "s")], cols)
    raw = spark.createDataFrame([(1, "u2", "خطة التعليم", text, "s"), (2, "u3", "خبر اخر", "زار الوفد مدينة القدس والتقى عددا من السكان في البلدة القديمة", "s")], cols)
    sources = spark.read.parquet("/root/testdata/sf0.001/sources.parquet")
    assert [r["id"] for r in pipeline.ingest(raw, known, sources).collect()] == [2]


def test_overlapping_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.sample(range(1000), rng.randint(5, 40)) for _ in range(12)]
    sets = []
    for i in range(80):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(0, 1000))
        sets.append(s)
    d = cut(spark.createDataFrame([(i, len(s), x) for i, s in enumerate(sets) for x in sorted(s)], "id long, n int, shingle long"))
    want = [(i, j) for i in range(80) for j in range(i + 1, 80) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.82]
    members, links = dedup.set_links(d)
    of = {}
    for i, rep in rows(members):
        of.setdefault(rep, []).append(i)
    got = {tuple(sorted((i, j))) for a, b, _ in rows(links) for i in of[a] for j in of[b]} | {(i, j) for g in of.values() for i in g for j in g if i < j}
    assert sorted(got) == want and want


def test_clustering_thresholds():
    import pandas as pd

    row = lambda v, **k: {"vector": v, "domains": [], "words": [], "stems": [], "persons": [], "organizations": [], "locations": []} | k
    near = [0.83, (1 - 0.83**2) ** 0.5]
    assert clustering.assign(pd.DataFrame([row([1, 0]), row(near)])) == [0, 1]
    who = {"persons": ["same"]}
    assert clustering.assign(pd.DataFrame([row([1, 0], **who), row(near, **who)])) == [0, 0]
    assert clustering.assign(pd.DataFrame([row([1, 0], domains=["a"]), row([1, 0], domains=["b"])])) == [0, 1]
    assert clustering.assign(pd.DataFrame([row([1, 0], words=["x"], stems=["x"]), row([1, 0], words=["y"], stems=["y"])])) == [0, 1]
    assert clustering.assign(pd.DataFrame([row([0, 0]), row([0, 0])])) == [0, 1]
    assert [clustering.threshold(c) for c in (0.6, 0.3, 0.0)] == [0.78, 0.81, 0.84]


def test_published_confusion_matrix(spark):
    data = [(False, False)] * 292 + [(False, True)] * 221 + [(True, False)] * 115 + [(True, True)] * 698
    r = metrics.binary(spark.createDataFrame(data, "g boolean, p boolean"), F.col("g"), F.col("p")).first()
    assert round(r["accuracy"], 4) == 0.7466 and round(r["f1"], 4) == 0.8060


def test_metrics_edges(spark):
    d = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "g string, p string")
    got = {r["label"]: (r["support"], r["predicted"], r["tp"], r["f1"]) for r in metrics.per_class(d, "g", "p").collect()}
    assert got == {"a": (2, 2, 1, 0.5), "b": (0, 1, 0, 0.0), "c": (1, 0, 0, 0.0)}
    assert metrics.averages(metrics.per_class(d, "g", "p")).first()["accuracy"] == pytest.approx(1 / 3)


def test_threshold_against_scan(spark):
    rng = random.Random(4)
    data = [(rng.random() < 0.5, rng.randint(0, 9) / 10) for _ in range(200)]
    r = metrics.best_threshold(spark.createDataFrame(data, "g boolean, s double"), F.col("g"), F.col("s")).first()
    scan = {t: sum((s > t) == g for g, s in data) for t in sorted({s for _, s in data})}
    best = max(scan.values())
    assert (r["threshold"], r["correct"]) == (min(t for t, c in scan.items() if c == best), best)


def test_oversampling(spark):
    d = spark.createDataFrame([(i, i < 3) for i in range(13)], "id long, m boolean")
    got = rows(sampling.oversampled(d, "id", F.col("m")).select("id", "copies"))
    assert [c for i, c in got if i < 3] == [4, 3, 3] and all(c == 1 for i, c in got if i >= 3)


def test_merge_and_union(spark):
    base = spark.createDataFrame([(1, "t", "x", "old"), (2, "u", "y", "old")], "seq long, title string, text string, label string")
    fb = spark.createDataFrame([(1, " t ", "x ", "new")], "seq long, title string, text string, label string")
    assert sorted(r["label"] for r in feedback.merged(base, fb, "seq").collect()) == ["new", "old"]
    union, counts = feedback.union_new(base, fb.unionByName(base), ["title", "text"])
    assert union.count() == 3 and tuple(counts.first()) == (1, 2)


def test_jobs(spark):
    f = spark.createDataFrame([(1, "approved", None), (2, "approved", 9), (3, "pending", None)], "id long, status string, training_job_id long").withColumn("admin_notes", F.lit(None).cast("string"))
    assert rows(feedback.stamp_job(f, 7).select("id", F.coalesce("training_job_id", F.lit(0)))) == [(1, 7), (2, 9), (3, 0)]
    assert rows(feedback.with_status(f, F.col("id") == 3, "approved", "ok").select("id", "status", F.coalesce("admin_notes", F.lit("")))) == [(1, "approved", ""), (2, "approved", ""), (3, "approved", "ok")]
    jobs = spark.createDataFrame([(1, "COMPLETED", 0.7, None, True), (2, "RUNNING", None, None, False)], "id long, status string, propaganda_f1 double, error_message string, is_active boolean")
    assert feedback.running_job(jobs) == 2
    done = {r["id"]: (r["status"], r["is_active"]) for r in feedback.finish_job(jobs, 2, 0.8).collect()}
    assert done == {1: ("COMPLETED", False), 2: ("COMPLETED", True)}
    failed = {r["id"]: (r["status"], r["is_active"]) for r in feedback.finish_job(jobs, 2, None, "boom").collect()}
    assert failed == {1: ("COMPLETED", True), 2: ("FAILED", False)}


def test_last_listing_gives_the_authority(spark):
    s = spark.createDataFrame([("A", 0.9, 0), ("B", 0.7, 1), ("A", 0.4, 2)], "name string, reliability_score double, at int").coalesce(1)
    d = spark.createDataFrame([("A",), ("B",), (None,)], "source_name string")
    want = {("A", 0.4), ("B", 0.7), (None, 0.4)}
    for x in (scoring.authority(d, s), scoring.authority(d, s, position=F.col("at"))):
        assert {tuple(r) for r in x.select("source_name", "authority").collect()} == want


def test_sums_of_any_sign_run_over_parts(spark):
    d = spark.createDataFrame([(i, (i * 7) % 5 - 3) for i in range(60)], "id long, v int")
    got = {r["id"]: r["before"] for r in running_sum(d, "id", F.lit(""), [], F.col("v")).collect()}
    total = 0
    for i in range(60):
        assert got[i] == total
        total += (i * 7) % 5 - 3


def test_nearest_against_scan(spark):
    rng = random.Random(9)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    data[7] = (7, data[8][1])  # a tie
    d = spark.createDataFrame([*data, (60, None)], "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(q, i, k + 1) for q in (0, 20, 40) for k, (_, i) in enumerate(sorted((-round(cos(data[q][1], v), 12), i) for i, v in data if i != q)[:4])}
    assert {tuple(r) for r in similarity.nearest(d.filter("id % 20 = 0"), d, "id", "v", 4).collect()} == want
    assert similarity.nearest(d.limit(0), d, "id", "v", 4).count() == 0


def test_samples(spark):
    d = spark.createDataFrame([(i, i % 3 == 0 if i % 7 else None) for i in range(50)], "id long, ok boolean")
    s = sampling.split(d, "id").groupBy("held_out").count().collect()
    assert {tuple(r) for r in s} == {(False, 45), (True, 5)}
    assert sampling.shuffled(d, "id", 10).count() == 10 and sampling.shuffled(d.limit(0), "id", 10).count() == 0
    assert sorted(r["right"] for r in sampling.right_and_wrong(d, "id", F.col("ok")).collect()) == [False] * 5 + [True] * 5
    assert sorted(r["place"] for r in sampling.numbered(d, "id", F.col("ok").cast("string")).filter("place = 1").collect()) == [1, 1, 1]


def test_near_duplicate_sink_keeps_its_state_in_the_store(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    schema = "id long, text string"
    known = spark.createDataFrame([(1, "old " + text)], schema)
    sink = ingest.near_deduplicated_sink(f"{tmp_path}/store", "id", "text", known=known)
    sink(spark.createDataFrame([(2, text + " end"), (3, "another text of some words here"), (4, None)], schema), 0)
    again = spark.createDataFrame([(3, "another text of some words here"), (5, "another text of some words here"), (6, "new words " + text[::-1])], schema)
    sink(again, 1)
    sink(again, 1)
    # 2 nearly copies what was known, 5 copies 3, and the batch that comes twice adds nothing
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [3, 4, 6]


def test_summary_feedback(spark):
    clusters = spark.createDataFrame([(1, "s"), (2, None)], "id long, summary string")
    articles = spark.createDataFrame([(1, 1, "", "body", "t"), (2, 1, None, None, "title"), (3, None, "x", "x", "x")], "id long, cluster_id long, content_clean string, content string, title string")
    f = spark.createDataFrame([(1, 1, False, "gen", "better", "approved"), (2, 1, True, "gen", "better", "approved"), (3, 1, False, "gen", "", "pending"), (4, 9, True, "gen", "", "approved")], "id long, cluster_id long, user_rating boolean, generated_summary string, corrected_summary string, status string")
    assert {tuple(r) for r in summaries.summary_records(clusters, f, articles).collect()} == {(1, 1, "body\n\ntitle", "better"), (2, 1, "body\n\ntitle", "gen")}
    new = spark.createDataFrame([(7, 2, True, "g", None), (8, 5, True, "g", None)], "id long, cluster_id long, user_rating boolean, generated_summary string, corrected_summary string")
    got = summaries.summary_feedback_inserted(f, clusters, new).filter("id > 6").collect()
    assert [(r["id"], r["status"]) for r in got] == [(7, "pending")]
    pairs = spark.createDataFrame([("a ", "s", "t"), ("b", "", "t"), ("", "s", "t"), ("c", None, None)], "text string, summary string, title string")
    assert {tuple(r) for r in summaries.training_pairs(pairs).collect()} == {("a", "s"), ("b", "t")}


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from warraq import runtime

    none = SimpleNamespace(get=lambda *a: None)
    s = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://host:7077"))
    try:
        runtime.shared_dir(s)
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError


def test_broadcasts_are_bounded_by_bytes(spark):
    from warraq.runtime import is_small

    d = spark.range(10).withColumn("x", F.lit("y" * 100))
    assert is_small(d, 10, 2000) and not is_small(d, 9, 10_000) and not is_small(d, 10, 500)


def test_story_candidates_against_all_pairs(spark):
    from warraq.functions import text as t

    rng = random.Random(3)
    pick = lambda xs, n: [rng.choice(xs) for _ in range(rng.randint(0, n))]
    data = [(i, rng.choice("pq"), pick(["gulf", "nile"], 2), sorted(set(pick(["القمح", "السوق", "سوق", "حريق", "مدرسة", "المدرسة"], 2))), pick(["قمح", "سوق"], 2), pick(["خالد العلي", "رنا"], 1), [], pick(["دمشق", "مدينة دمشق"], 1)) for i in range(60)]
    d = spark.createDataFrame(data, "id long, poll string, domains array<string>, words array<string>, stems array<string>, persons array<string>, organizations array<string>, locations array<string>")
    new, old = d.filter("id % 2 = 0"), d.filter("id % 2 = 1")
    got = clustering.candidates(new, old, "poll").collect()
    x, y = new.alias("x"), old.alias("y")
    fit = ~t.geo_conflict(F.col("x.domains"), F.col("y.domains")) & ~t.title_conflict(F.col("x.words"), F.col("y.words"))
    want = {tuple(r) for r in x.join(y, F.col("x.poll") == F.col("y.poll")).filter(fit).select("x.id", "y.id").collect()}
    assert {(r["id"], r["other"]) for r in got} == want and len(got) == len(want) > 20
    assert all(0 <= r["confidence"] <= 1.55 for r in got)
