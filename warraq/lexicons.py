"""Word lists as data: small defaults, to be replaced by a user's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

STOPWORDS = ["في", "من", "على", "إلى", "عن", "أن", "مع", "كما", "the", "of", "and", "to", "in", "a", "an"]
BOILERPLATE = ["جميع الحقوق محفوظة", "اشترك في النشرة", "تابعوا آخر", "اقرأ أيضا", "شارك الخبر", "All rights reserved", "Share this story", "Sign up"]
IGNORED_TITLE_WORDS = ["في", "من", "على", "خلال", "بعد", "قبل", "the", "over", "for", "and"]
ATTRIBUTION_MARKERS = ["قال", "وقال", "أكد", "أعلن", "بحسب", "وفق", "according to", "said", "confirmed"]
OPINION_MARKERS = ["نراهن", "يجب", "مؤامرة", "كارثة", "للأسف", "should", "in the view of", "called the"]
GAZETTEER = {"gulf": ["الدوحة", "الكويت", "مسقط", "المنامة"], "levant": ["دمشق", "بيروت"], "maghreb": ["تونس", "الرباط", "نواكشوط", "طرابلس"], "nile": ["القاهرة", "الخرطوم"]}
LOADED = {"مؤامر": 1.0, "كارث": 1.0, "فوضي": 0.8, "مدمر": 0.6, "مشبوه": 0.7, "خطير": 0.5, "حمل مشبوه": 1.5, "مؤامر مكشوف": 1.6, "failur": 0.5, "surprise": 0.3}
BLOCKED_HOSTS = ["-weeklypost.example", "tawasul.example"]


def weights(lexicon: DataFrame) -> dict[str, float]:
    """Stemmed phrase -> greatest weight, from a table (category, phrase, weight); a lexicon is a small fixed table."""
    from pyspark.sql import functions as F

    from warraq.functions import text as t

    stems = F.array_join(F.transform(t.tokenize(F.col("phrase")), lambda w: t.light_stem(t.normalize(w, compose=False), t.PREFIXES_B)), " ")
    rows = lexicon.select(stems.alias("p"), "weight").filter("p <> ''").groupBy("p").agg(F.max("weight").alias("w")).collect()
    return {r["p"]: r["w"] for r in rows}
