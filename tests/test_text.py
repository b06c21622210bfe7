from pyspark.sql import functions as F

from warraq.functions import text as t
from warraq.functions.html import main_text


def run(spark, values, *columns):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r)[1:] for r in d.select("i", *columns).orderBy("i").collect()]


EDGES = [None, "", "   ", "😀 ok", "مشرّف", "مـــهم", "أحمد إلى آخر", "٠١٢٣ ۰۸۹", "aaaa bbb", "see https://a.b/c?d=1 now", "mail x.y@z.org and @me", "«قال» “نعم” 'لا'", "a b c", "خبر: عاجل!", "A\x1cB"]


CLEANED = [
    (None, ""), ("", ""), ("   ", ""), ("😀 ok", "ok"), ("مشرّف", "مشر ف"), ("٠١٢٣ ۰۸۹", "0123 0۸۹"), ("aaaa bbb", "aa bb"), ("see https://a.b/c?d=1 now", "see now"), ("mail x.y@z.org and @me", "mail and"), ("www.a.b", ""),
    ("«قال» “نعم” 'لا'", "«قال» “نعم” 'لا'"), ("خبر: عاجل!", "خبر عاجل"), ("A\x1cB", "A B"), ("a_b - c", "a_b c"), ("«««x", "««x"),
]


def test_clean(spark):
    assert [r[0] for r in run(spark, [v for v, _ in CLEANED], t.clean(F.col("x"), html=False))] == [w for _, w in CLEANED]
    flags = {"a #b 12 «c»": [("a b 12 «c»", {}), ("a 12 «c»", {"hashtags": True}), ("a b «c»", {"numbers": True}), ("a b 12 c", {"keep_quotes": False})]}
    for v, wants in flags.items():
        assert [run(spark, [v], t.clean(F.col("x"), **f))[0][0] for _, f in wants] == [w for w, _ in wants]


def test_markup_and_references(spark):
    values = ["<p>a</p><script>b</script> &lt;c&gt;", "&amp;lt; &#1602; &eacute; &nosuch;", "a < b & c", None]
    got = [r[0] for r in run(spark, values, t.remove_html(F.col("x")))]
    assert [" ".join(x.split()) if x else x for x in got] == ["a <c>", "&lt; ق é &nosuch;", "a < b & c", None]


def test_labels(spark):
    got = [r[0] for r in run(spark, ["non_propaganda", "Non-Propagandistic", "propagandistic", "propaganda", "what propaganda", None, " TRUE", "0"], t.source_label(F.col("x")))]
    assert got == ["neutral", "neutral", "propaganda", "propaganda", "neutral", "neutral", "propaganda", "neutral"]
    assert [r[0] for r in run(spark, ["123456789", " 1234567890 ", None], t.long_enough(F.col("x")))] == [False, True, False]


def test_words_strip_length(spark):
    got = run(spark, EDGES, t.strip(F.col("x")), t.words(F.col("x")))
    for v, (s, w) in zip(EDGES, got, strict=True):
        assert (s, w) == ((None, None) if v is None else (v.strip(), v.split()))


def test_normalize(spark):
    assert [r[0] for r in run(spark, ["مُشَرَّف", "مـهم", "أإآ", "أ", None], t.normalize(F.col("x")))] == ["مشرف", "مهم", "ااا", "ا", ""]


# word, stem with the short list of prefixes, stem with the long one
STEMS = [
    ("", "", ""), ("ال", "ال", "ال"), ("الكتاب", "كتاب", "كتاب"), ("والمدرسة", "مدرسه", "مدرسه"), ("بالقلم", "قلم", "قلم"), ("للناس", "ناس", "ناس"), ("كالبحر", "كالبحر", "بحر"), ("وقال", "وقال", "قال"), ("بيت", "بيت", "بيت"), ("ببيت", "ببيت", "بيت"),
    ("معلمون", "معلم", "معلم"), ("معلمات", "معلم", "معلم"), ("عربية", "عرب", "عرب"), ("كتابها", "كتاب", "كتاب"), ("بيتي", "بيت", "يت"), ("أحمد", "احمد", "احمد"), ("آن", "ان", "ان"), ("مدين", "مد", "مد"), ("word", "word", "word"),
]


def test_stems(spark):
    for k, prefixes in ((1, t.PREFIXES_A), (2, t.PREFIXES_B)):
        assert [r[0] for r in run(spark, [s[0] for s in STEMS], t.light_stem(F.col("x"), prefixes))] == [s[k] for s in STEMS]


def test_loaded_ratio_is_greedy_longest_match(spark):
    lexicon = {"ab": 1.0, "ab cd": 3.0, "cd": 0.5, "x y z": 2.0}
    values = ["ab cd ab", "x y", "x y z cd", "", "qq", "ab ab cd cd"]
    got = [r[0] for r in run(spark, values, t.loaded_ratio(t.words(F.col("x")), lexicon))]
    assert got == [4 / 3, 0.0, 2.5 / 4, 0.0, 0.0, 4.5 / 4]


def test_shingles_jaccard(spark):
    d = spark.createDataFrame([("a b c d", "a b c e"), ("a b", "a b"), ("", "")], "x string, y string")
    got = [r[0] for r in d.select(t.jaccard(t.shingles(F.col("x")), t.shingles(F.col("y")))).collect()]
    assert got == [1 / 3, 1.0, 1.0]


def test_sub_entities_and_sharing(spark):
    d = spark.createDataFrame([(["الرباط", "مدينة الرباط", "تونس"], ["رباط"]), ([], ["x"]), (None, ["x"])], "a array<string>, b array<string>")
    got = d.select(t.without_sub_entities(F.col("a")), t.share_entities(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(["مدينة الرباط", "تونس"], True), ([], False), (None, False)]


def test_conflicts(spark):
    gaz = {"a": ["x", "two words"], "b": ["y"], "c": ["z"]}
    d = spark.createDataFrame([(["X"], "t", ["y"], "t"), (["x", "y"], "", ["y"], ""), (["two words"], "", [], "z")], "la array<string>, ta string, lb array<string>, tb string")
    got = [r[0] for r in d.select(t.geo_conflict(t.domains(F.col("la"), F.col("ta"), gaz), t.domains(F.col("lb"), F.col("tb"), gaz))).collect()]
    assert got == [True, False, True]


def test_outputs(spark):
    values = ["blah التقييم النهائي: Neutral\npropaganda", "propaganda neutral", "", "التقييم النهائي : x\n"]
    assert [r[0] for r in run(spark, values, t.parse_output(F.col("x")))] == ["neutral", "propaganda", "unknown", "unknown"]
    values = ["Verdict: Propaganda\nTechnique: doubt | LOADED.", "verdict: neutral", "verdict: maybe", "Technique: a"]
    got = [tuple(r[0]) for r in run(spark, values, t.parse_prediction(F.col("x"), {"doubt": "Doubt", "loaded": "Loaded"}))]
    assert got == [("Doubt | Loaded", True), ("Neutral", True), ("Neutral", False), ("a", False)]


def test_small_functions(spark):
    long = "كلمة " * 30
    got = run(spark, ["ما هذا؟ " + long, "short. " + "x" * 90], t.strip_hook(F.col("x")))
    assert got[0][0] == long.strip() and got[1][0] == "x" * 90
    assert [r[0] for r in run(spark, ["a - b - c", "a"], t.without_suffix(F.col("x")))] == ["a - b", "a"]
    assert [r[0] for r in run(spark, ["", "هل؟", "1. x", "fine text in 2025", "in 1999"], t.is_degenerate(F.col("x"), 2026))] == [True, True, True, False, True]
    assert t.hours("3d") == 72 and t.hours("12h") == 12
    assert [r[0] for r in run(spark, ["a [SEP] b", "c"], t.split_title(F.col("x"), "T")["title"])] == ["a", "T"]
    assert run(spark, ["Mon, 06 Jan 2025 10:00:00 GMT", "nonsense"], t.parse_time(F.col("x")).cast("string")) == [("2025-01-06 10:00:00",), (None,)]


def test_main_text():
    p = "<p>" + "word " * 20 + "</p>"
    page = f"<html><body><nav><p>{'menu ' * 50}</p></nav><div class='sidebar-x'>{p}</div><article>{p}{p}{p}<p>short</p></article></body></html>"
    assert main_text(page) == " ".join(["word " * 19 + "word"] * 3)
    assert main_text(f"<div>{'tiny '}</div>") is None and main_text(None) is None
    assert main_text("<p>" + "open " * 40 + "<p>" + "next " * 40).startswith("open open")
