"""Each operator against brute force and on the edges: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.llm import caps, leaks, lines, looks, mixing, names, nearcopies, packing, personal, skeleton, tokens, truncation
from warraq.runtime import cut


@pytest.fixture(autouse=True, scope="module")
def _table_of_looks(spark):
    looks.ensure(spark)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- consistent text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None), ("", ""), ("plain", "plain"), ("ＡＢ１", "AB1"), ("café", "café"), ("a​b c", "ab c"), ("Trаnsport", "Transport"), ("Светогор", "Светогор"), ("فی", "في"), ("أ", "أ"),
        ("نَّ", "نَّ"), ("مـهم", "مـهم"), ("٣٤", "٣٤"), ("دوﻻر", "دولار"), ("پگ ی", "پگ ي"), ("x" * 100_000 + "‏", "x" * 100_000),
    ],
)
def test_consistent(text, want):
    assert skeleton.consistent(text) == want


def test_same_look_same_skeleton(spark):
    assert skeleton.skeleton("Раураl") == skeleton.skeleton("Paypal") and skeleton.skeleton(None) is None
    d = spark.createDataFrame([("Раураl",), ("Paypal",), ("Paypal",), ("other",), (None,), ("",)], "title string")
    got = skeleton.same_looking(d, "title").select("n_forms", "n_rows").collect()
    assert [tuple(r) for r in got] == [(2, 3)]


def test_clean_title_looks_like_its_faulty_twin(spark):
    twins = [("أنباء إيران", "أنباء\u200b إيران"), ("سؤال", "سو\u0654ال"), ("café noir", "café\u00a0noir"), ("cote", "cot\u0435"), ("فى بيت", "في بيت")]
    d = spark.createDataFrame([(x,) for pair in twins for x in pair], "title string")
    got = sorted(r["example"] for r in skeleton.same_looking(d, "title").filter("n_forms = 2 and n_rows = 2").collect())
    assert got == sorted(min(p) for p in twins)  # the published table has the two forms of ya as look-alikes


def test_same_looking_contents(spark, tmp_path):
    from warraq.llm.queries import p7_same_looking

    d = [("t", "أنباء إيران"), ("t", "أنباء\u200b إيران"), ("t\u200b", "أنباء إيران"), ("u", None), (None, "أنباء\u200b إيران")]
    spark.createDataFrame(d, "title string, content string").write.parquet(f"{tmp_path}/articles.parquet")
    got = rows(p7_same_looking(spark, str(tmp_path)).select("field_name", "n_forms", "n_rows", "example"))
    assert got == [("content", 2, 4, "أنباء إيران"), ("title", 2, 3, "t")]


def test_found_values_look_like_their_consistent_form():
    for x in ("Trаnsport", "a\u200bb\u00a0c", "فی", "دوﻻر", "cafe\u0301", "ＡＢ１"):
        c = skeleton.consistent(x)
        assert c != x and skeleton.skeleton(c) == skeleton.skeleton(x)
    assert skeleton.skeleton("cafe\u0301") == "cafe\u0301"  # a fault that a change of skeleton would not show


def test_faulty_fields(spark):
    d = spark.createDataFrame([(1, "a​", None, "x"), (1, "a​", "ok", "y"), (None, "", "b c", "z")], "id long, title string, content string, field_name string")
    got = [tuple(r) for r in skeleton.faulty_fields(d, "id", ["title", "content"]).select("id", "field_name", "consistent").collect()]
    assert Counter(got) == Counter([(1, "title", "a"), (1, "title", "a"), (None, "content", "b c")])
    assert skeleton.faulty_fields(d.limit(0), "id", ["title"]).count() == 0


# ---- repeated lines


def test_repeated_lines_against_count(spark):
    rng = random.Random(1)
    data = []
    for i in range(120):
        s = rng.choice(["Hot", " hot ", "HOT", "other", None])
        body = [f"unique {rng.random()}" + "".join(rng.choice("abcdef") for _ in range(12)) for _ in range(3)]
        tail = [x for x in ("share it!", "SHARE IT", "all rights 2024", "12 34", "") if rng.random() < 0.4]
        data.append((i, s, "\n".join(body[:1] + tail[:1] + body[1:] + tail[1:])))
    data += [(500, "hot", None), (501, "hot", "  \n "), (502, None, "")]
    d = spark.createDataFrame(data, "id long, source_name string, content string")
    got = lines.line_table(d, "id", "source_name", "content")
    got = cut(got)
    blocks = cut(lines.repeated_blocks(got))
    found = set(rows(lines.repeated_lines(got, cut(lines.lines_of_blocks(blocks)))))
    keys = {i: (" ".join((s or "").split()).lower(), lines.line_ids(x)) for i, s, x in data if x and x.strip()}
    total, n = Counter(s for s, _ in keys.values()), Counter((s, k) for s, ks in keys.values() for k in set(ks) if k)
    want = {(i, p + 1) for i, (s, ks) in keys.items() for p, k in enumerate(ks) if k and n[s, k] >= 5 and n[s, k] >= 0.05 * total[s]}
    assert found == want and want
    assert all(r["n_docs"] >= r["need"] for r in blocks.collect())
    empty = cut(lines.line_table(d.limit(0), "id", "source_name", "content"))
    assert lines.repeated_blocks(empty).count() == 0


def test_large_buckets_are_parted(spark, monkeypatch):
    rng = random.Random(11)
    body = ["share it", "all rights", "sign up", "follow us"]
    data = [(i, "s", "\n".join([f"unique {''.join(rng.choice('abcdef') for _ in range(12))}", *rng.choices(body, k=rng.randint(1, 6))])) for i in range(150)]
    got = cut(lines.line_table(spark.createDataFrame(data, "id long, source_name string, content string"), "id", "source_name", "content"))
    blocks = lambda: sorted((tuple(r["block"]), r["n_docs"]) for r in lines.repeated_blocks(got).collect())
    whole = blocks()
    for limit in (20, 2):
        monkeypatch.setattr(lines, "BUCKET", limit)
        assert blocks() == whole and len(whole) > 10


def test_suffix_array_counts_documents():
    # A B in two documents, once twice in one of them
    suffixes = [([1, 2], 0, 2), ([1, 2], 2, 1), ([1, 3], 0, 1)]
    found = {tuple(b): n for b, n in lines.repeated_in_suffix_array(suffixes, 2)}
    assert found == {(1, 2): 2, (1,): 3}


def test_without_lines_keeps_columns(spark):
    d = spark.createDataFrame([(1, "s", "Keep me\nDrop, it 3!", 7), (2, "s", None, 8), (3, None, "x", 9)], "id long, source_name string, content string, lines int")
    per = spark.createDataFrame([("s", [lines.line_ids("drop it")[0]])], "source string, lines array<long>")
    got = {r["id"]: (r["content_without_lines"], r["lines"]) for r in lines.without_lines(d, "source_name", "content", "id", per).collect()}
    assert got == {1: ("Keep me", 7), 2: (None, 8), 3: ("x", 9)}


# ---- near-copies and leaks


def _texts(seed, n=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 90))] for _ in range(25)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return [*out, None, "", "  ", "one two", "A b c d", "a B c d"]


def _overlaps(texts, size, least):
    sets = []
    for x in texts:
        w = nearcopies.words(x or "")
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)))
    return {(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}


def test_near_copies_against_brute_force(spark, monkeypatch):
    texts = _texts(2)
    d = spark.createDataFrame([(i, x, "r", 1) for i, x in enumerate(texts)] + [(3, texts[3], "again", 2), (None, "a b c d", "", 0)], "id long, text string, rep string, n int")
    members, pairs = nearcopies.links(d, least=0.82, size=3)
    got = nearcopies.all_pairs(members, pairs).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _overlaps(texts, 3, 0.82)
    assert nearcopies.degrees(members, pairs).count() == len({r["id"] for r in members.collect()})
    small = nearcopies.candidate_pairs
    monkeypatch.setattr(nearcopies, "candidate_pairs", lambda reps, least: small(reps, least, block=4))  # every bucket is split
    assert {tuple(r) for r in nearcopies.all_pairs(*nearcopies.links(d, least=0.82, size=3)).collect()} == _overlaps(texts, 3, 0.82)
    assert nearcopies.all_pairs(*nearcopies.links(d.limit(0), 0.8)).count() == 0


def test_bit_slices_count_exactly():
    rng = np.random.default_rng(0)
    sketch = rng.integers(0, 2**63, size=(150, 4), dtype=np.uint64)
    bits = np.unpackbits(sketch.view(np.uint8), axis=1)[:, :252]
    group = np.sort(rng.integers(0, 3, size=150))
    i, j = nearcopies.close_pairs(group, sketch, 120, at_once=50)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if group[a] == group[b] and (bits[a] != bits[b]).sum() <= 120}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_leaks_against_brute_force(spark, monkeypatch):
    texts = _texts(3)
    side = [i % 3 > 0 for i in range(len(texts))]
    d = spark.createDataFrame([(i, s, x, "c") for i, (s, x) in enumerate(zip(side, texts, strict=True))], "id long, side boolean, text string, term string")
    want = {(i, j) for i, j in _overlaps(texts, 3, 0.82) if side[i] != side[j]}
    for piece in (5000, 3):
        monkeypatch.setattr(leaks, "PIECE", piece)
        members, links = leaks.split_links(d, 0.82, 3)
        got = {tuple(sorted(r[:2])) for r in leaks.overlapping_pairs(members, links).collect()}
        assert got == want and want
    assert {r["id"] for r in leaks.overlapping_records(members, links).collect()} == {x for p in want for x in p}
    assert leaks.overlapping_pairs(*leaks.split_links(d.limit(0), 0.82, 3)).count() == 0


def test_leaks_weighted_by_rarity_against_brute_force(spark, monkeypatch):
    texts = _texts(6, 120)
    side = [i % 3 > 0 for i in range(len(texts))]
    d = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(zip(side, texts, strict=True))], "id long, side boolean, text string")
    sets = []
    for x in texts:
        w = nearcopies.words(x or "")
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)))
    classes = {(s, k) for s, k in zip(side, sets, strict=True) if k}
    df = Counter(t for _, k in classes for t in k)
    idf = {t: np.log1p(len(classes) / n) for t, n in df.items()}
    norm = lambda k: sum(idf[t] ** 2 for t in k) ** 0.5
    cos = {(i, j): sum(idf[t] ** 2 for t in sets[i] & sets[j]) / (norm(sets[i]) * norm(sets[j])) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and side[i] != side[j]}
    for least, piece in ((0.7, 5000), (0.5, 2)):
        monkeypatch.setattr(leaks, "PIECE", piece)
        got = {tuple(sorted(r[:2])) for r in leaks.overlapping_pairs(*leaks.split_links(d, size=3, cosine=least)).collect()}
        assert got == {p for p, c in cos.items() if c >= least} and got


def test_prefix_bound():
    w = np.full(10, 10**-0.5)
    assert leaks.prefix_length(w, w, 0.9) == 2 and leaks.prefix_length(w, np.zeros(10), 0.9) == 0


# ---- caps


def test_apportion():
    assert caps.apportion(10, [1, 2, 3]) == [1, 2, 3]
    assert caps.apportion(5, [100, 10, 1]) == [5, 0, 0] or sum(caps.apportion(5, [100, 10, 1])) == 5
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.randint(0, 9) for _ in range(6)]
        cap = rng.randint(0, 40)
        out = caps.apportion(cap, sizes)
        assert sum(out) == min(cap, sum(sizes)) and all(0 <= o <= s for o, s in zip(out, sizes, strict=True))


def test_caps(spark):
    nan = float("nan")
    data = [(1, "a", 0.5, "x"), (2, "a", None, "x"), (3, "a", nan, "y"), (4, "a", 0.9, "y"), (5, "a", 7.0, None), (6, "b", 0.1, "x"), (7, None, 0.3, "x"), (8, "a", 0.9, "y")]
    d = spark.createDataFrame(data, "id long, s string, q double, contributor string")
    order = [-F.coalesce(caps.bounded_quality(F.col("q")), F.lit(-1.0))]
    cap = spark.createDataFrame([(3,)], "cap long")
    out = caps.capped(cut(caps.ranked(d, "id", F.col("s"), order)), cap)
    assert sorted(r["id"] for r in out.filter("kept").collect()) == [1, 4, 6, 7, 8]
    split = caps.capped(cut(caps.ranked(d, "id", F.col("s"), order, F.col("contributor"))), cap).filter("kept")
    assert Counter(r["contributor"] for r in split.collect()) == {"a": 3, "b": 1, "": 1}
    assert caps.capped(cut(caps.ranked(d.limit(0), "id", F.col("s"), order)), cap).count() == 0


# ---- truncation


def test_judge():
    assert truncation.judge("كل شيء تمام.")[0] == 0
    for x in ("قال إن المدي�", "the plan &qu", "the plan, ", "they met Dr.", "شرح [+12 chars]", "وأضاف <b"):
        assert truncation.judge(x)[0] == 1 or truncation.judge(x)[3], x
    assert truncation.judge("ورد: «نعم تمام»")[0] == 0 and truncation.judge("the plan was")[0] == 2


def test_censored_fit_finds_the_mean():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(6.5, 0.4, 4000)).astype(int)
    x = np.minimum(x, 700)
    values, counts = np.unique(x, return_counts=True)
    mean, dev = truncation.fit_censored(values, counts.astype(float), [700])
    assert abs(mean - 6.5) < 0.03 and abs(dev - 0.4) < 0.03


def test_truncated_articles(spark):
    rng = random.Random(6)
    nouns, ends = ["market", "school", "harbour", "library"], ["today", "tomorrow", "yesterday"]
    sentence = lambda: f"The {rng.choice(nouns)} office said that the {rng.choice(nouns)} will open {rng.choice(ends)}."
    data, cuts = [], set()
    for i in range(400):
        text = " ".join(sentence() for _ in range(rng.randint(6, 14)))
        if i % 5 == 0 and len(text) > 400 and text[399] not in " .":
            text = text[:400]
            cuts.add(i)
        if i % 3 == 0:
            text += "\nShare this story on any network"
        elif i % 3 == 1:
            text += "\n\nSign up for our letter"
        if i % 7 == 1 and i not in cuts:
            text = text.replace(".\n\nSign", "\n\nSign")
        data.append((i, "site", text, 0.1))
    data += [(900, "site", None, 0.2), (901, None, " ", 0.3), (902, "site", "Share this story on any network", 0.3)]
    d = spark.createDataFrame(data, "id long, source_name string, content string, length double")
    found = {r["id"] for r in truncation.judged(d, "id", "source_name", "content").filter("probability >= 0.5").collect()}
    assert len(found & cuts) >= 0.9 * len(cuts) and len(found - cuts) <= 0.05 * len(data)
    assert truncation.judged(d.limit(0), "id", "source_name", "content").count() == 0


def test_share_of_cut_texts_is_found():
    rng = np.random.default_rng(2)
    cut_ = rng.random(5000) < 0.3
    e = np.where(cut_, rng.normal(2, 1.5, 5000), rng.normal(-2, 1.5, 5000))  # of two such normals, the log ratio at x is 4 x / 2.25
    assert abs(truncation.fit_share(4 * e / 2.25, np.ones(5000)) - 0.3) < 0.03
    assert truncation.fit_share(np.zeros(0), np.zeros(0), 0.4) == 0.4


def test_long_site_lines_are_seen(spark):
    line = "this notice is far longer than one hundred and ten letters " * 4
    d = spark.createDataFrame([(i, "s", f"The office number {'abcdefghij'[i % 10]}{'klmno'[i // 10]} will open today.\n{line}") for i in range(50)], "id long, source string, text string")
    own, files = truncation.site_lines(d)
    assert [r["lines"] for r in own.collect()] == [[truncation.line_key(line)]]


# ---- tokens, packing, mixing


def test_token_counts():
    e = tokens.encoding(tokens.VOCABULARY)
    for x in ["", "plain words  and   runs\n\n", "كلمات عربية، وأرقام ١٢٣", "😀 mixed é", "a" * 5000]:
        assert tokens.count(x) == len(e.encode_ordinary(x))
    assert tokens.count(None) == 0


def test_packing(spark):
    rng = random.Random(7)
    data = [(i, rng.choice([0, 3, 10, 37, 60, 61, 100, 250, 999])) for i in range(600)] + [(1, 37), (None, 5), (700, None)]
    d = cut(spark.createDataFrame(data, "id long, tokens long"))
    out = packing.packed(d, 100).collect()
    load = Counter()
    for r in out:
        load[r["container"]] += r["tokens"]
    assert max(load.values()) <= 100
    assert sum(load.values()) == sum(n for i, n in data if n and i is not None)
    assert sum(load.values()) / (100 * len(load)) > 0.95
    parts = Counter(r["id"] for r in out)
    assert parts[next(i for i, n in data if n == 250)] == 3 and parts[1] >= 2
    assert packing.packed(cut(d.limit(0)), 100).count() == 0


def test_long_texts_of_one_id_fill_containers_of_their_own(spark):
    d = cut(spark.createDataFrame([(1, 250), (1, 250), (2, 100)], "id long, tokens long"))
    load = Counter()
    for r in packing.packed(d, 100).collect():
        load[r["container"]] += r["tokens"]
    assert sorted(load.values()) == [100] * 6


def test_fillings_are_those_of_best_fit_text_by_text():
    rng = np.random.default_rng(3)
    for _ in range(60):
        k = int(rng.integers(5, 60))
        hist = np.zeros(k + 1, dtype=np.int64)
        for x in rng.integers(1, k + 1, size=rng.integers(1, 12)):
            hist[x] = rng.integers(1, 40)
        sizes = np.repeat(np.arange(k + 1), hist).tolist()
        by_text: dict[int, list[int]] = {}
        for s, c in zip(sizes, packing.best_fit(sizes, k), strict=True):
            by_text.setdefault(c, []).append(s)
        got = packing.fillings(hist)
        used = np.zeros(k + 1, dtype=np.int64)
        for p, n in got.items():
            assert sum(b * m for b, m in p) <= k
            for b, m in p:
                used[b] += m * n
        assert (used == hist).all() and sum(got.values()) == len(by_text)


def test_nnls():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, size=(8, 5)).astype(float)
    x = np.array([2.0, 0, 1, 3, 0])
    r, c = np.nonzero(a)
    assert np.allclose(packing.nnls(r, c, a[r, c], a @ x, 5, 4000), x, atol=0.05)


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_mixing(spark):
    rng = random.Random(8)
    data = [(i, rng.choice(["big", "big", "big", "small"]), rng.choice([0, 50, 200, 700])) for i in range(400)] + [(900, "alien", 100), (901, None, 5), (902, "big", None)]
    sizes = cut(spark.createDataFrame(data, "id long, source string, tokens long"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    texts, shares = mixing.mixed(sizes, targets, block=100)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big"]["share"] - 0.5) < 0.02 and got["small"]["copies"] <= 2 and got["absent"]["tokens"] == 0
    used = Counter()
    for r in texts.collect():
        for k in range(r["from_token"], r["to_token"]):
            used[r["id"], k] += 1
    assert max(used.values()) <= 2
    texts, shares = mixing.mixed(cut(sizes.limit(0)), targets)
    assert texts.count() == 0 and shares.count() == 3
    # a size the small source can't serve: it gives all it may, and what is missing is reported
    texts, shares = mixing.mixed(sizes, targets, block=100, total=120_000)
    got = {r["source"]: r for r in shares.collect()}
    assert got["small"]["copies"] == 2 and got["small"]["shortfall"] > 0.05 and got["big"]["share"] > 0.5 and got["big"]["copies"] == 1


# ---- names


def test_name_words():
    assert names.words_of("persons", "السداخلي، عبد الله") == ["عبدالله", "سداخلي"] and names.words_of("persons", "Dr. Ali Al-Hakmi") == ["dr", "ali", "hakmi"]
    assert names.words_of("organizations", "Al Hakmi & Co. (ش.م.م)") == ["hakmi", "and", "co", "شمم"] and names.words_of("persons", "م.ناصر") == ["م.", "ناصر"]
    for a, b in [("السداخلي", "Al-Sadakhli"), ("شاهغيان", "Shahghayan"), ("بوحضاسها", "Bouhdasha")]:
        assert names.rows_of(names.words_of("persons", a)[0]) == names.rows_of(names.words_of("persons", b)[0])


def test_slips_keep_a_high_cosine():
    for a, b in [("bouhdasha", "bouhhdasha"), ("narhaafi", "narhaaif"), ("sadakhli", "sadkhli"), ("بولشاكقا", "بولشاكقتا")]:
        assert names.cosine(a, b) >= 0.65 and set(names.features(names.once(names.rows_of(a)))) & set(names.features(names.once(names.rows_of(b))))
    assert names.cosine("hdasha", "sadakhli") < 0.5 and names.cosine("a", "a") == 1.0 and names.cosine("abc", "xyz") == 0.0


def _greedy_linkage(n, sim, least):
    groups = [[i] for i in range(n)]
    mean = lambda g, h: sum(sim.get((min(x, y), max(x, y)), 0) for x in g for y in h) / (len(g) * len(h))
    while len(groups) > 1:
        m, i, j = max((mean(groups[i], groups[j]), i, j) for i, j in combinations(range(len(groups)), 2))
        if m < least:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups if len(g) > 1}


def test_average_linkage_by_rounds_is_the_greedy_one(spark):
    rng = random.Random(4)
    for _ in range(3):
        n = 24
        sim = {(i, j): rng.random() for i, j in combinations(range(n), 2) if rng.random() < (0.8 if i // 6 == j // 6 else 0.1)}
        d = spark.createDataFrame([(f"{i:02}", f"{j:02}", s) for (i, j), s in sim.items()], "x string, y string, similarity double")
        got = {}
        for r in names.average_linkage(d, 0.4).collect():
            got.setdefault(r["root"], set()).add(int(r["node"]))
        assert {frozenset(g) for g in got.values()} == _greedy_linkage(n, sim, 0.4)
    assert names.average_linkage(d.limit(0)).count() == 0


def test_bridge_keeps_groups_apart(spark):
    d = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.6)], "x string, y string, similarity double")
    assert {r["node"] for r in names.average_linkage(d, 0.5).collect()} == {"a", "b"}


def test_entities(spark):
    d = spark.createDataFrame([(["خالد السداخلي", "السداخلي، خالد", "خالد السدااخلي", None, ""], ["دمشق"], 1), (None, ["دمشق", "دمشق "], 2), (["خالد السداخلي"], [], 3), (["x"], None, 4)], "persons array<string>, locations array<string>, name int")
    got = {tuple(r) for r in names.spelling_pairs(names.entities(d, ["persons", "locations"])).collect()}
    people = ["السداخلي، خالد", "خالد السدااخلي", "خالد السداخلي"]
    assert got == {("persons", *p) for p in combinations(sorted(people), 2)} | {("locations", "دمشق", "دمشق ")}
    assert names.entities(d.limit(0), ["persons"]).count() == 0


def test_names_send_no_growing_table_through_the_driver(spark, monkeypatch):
    """Small files may hold many rows once exploded; only the totals, one row a field, are broadcast, however small the tables are."""
    plans = []

    def seen(df, name="cut"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, name)

    monkeypatch.setattr(names, "cut", seen)
    d = spark.createDataFrame([(["خالد السداخلي", "خالد السدااخلي"], ["كفر السداخلي", "دمشق"])], "persons array<string>, locations array<string>")
    found = names.spelling_pairs(names.entities(d, ["persons", "locations"]))
    plans.append(("pairs", found._jdf.queryExecution().executedPlan().toString()))
    joins = {n: p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin") for n, p in plans}
    assert {n for n, k in joins.items() if k} <= {"associations", "words-of-contexts"} and max(joins.values()) == 1
    assert found.count() == 1


def test_meanings_are_learnt(spark):
    """Kinds and given names of both scripts are linked by the cores they share, others are kept apart."""
    rng = random.Random(5)
    letter = dict(zip("بدفكلمنرسز", "bdfklmnrsz", strict=True))
    used: set[str] = set()

    def core():  # no core is a slip of another
        while True:
            c = "".join(rng.choice("بدفكلمنرسز") + "ا" for _ in range(6))
            near = {x for f in names.features(names.once(names.rows_of(c))) for x in names.features(f)}
            if not near & used:
                used.update(near)
                return c

    latin = lambda c: "".join(letter.get(x, "a") for x in c).capitalize()
    places, people, want = [], [], set()
    for k in range(40):
        c, (ar, la) = core(), [("كفر", "Kafr"), ("جبل", "Jabal"), ("وادي", "Wadi")][k % 3]
        places += [f"{ar} {c}", f"{la} {latin(c)}"]
        want.add(("locations", f"{la} {latin(c)}", f"{ar} {c}"))
        c, (full, short) = core(), [("وائل", "لولو"), ("مصطفى", "صطوف"), ("هدى", "دودو")][k % 3]
        people += [f"{full} {c}", f"{short} {c}"]
        want.add(("persons", *sorted((f"{full} {c}", f"{short} {c}"))))
        if k < 3:  # a relative
            people.append(f"{['هدى', 'وائل', 'مصطفى'][k]} {c}")
    d = spark.createDataFrame([(people, places)], "persons array<string>, locations array<string>")
    assert {tuple(r) for r in names.spelling_pairs(names.entities(d, ["persons", "locations"])).collect()} == want


# ---- personal data


def test_personal_data(spark):
    people = [("Ali", "Hakmi"), ("Rana", "Sabbagh"), ("Omar", "Zaytoun")]
    texts = [f"Mr. {g} {f} said that the market opened. {g} {f} left." for g, f in people * 3]
    texts += ["Write to ali.h@mail.example or a [at] b[dot]test. Call +1-303-555-0115 now.", "Invoice no. 48966140 was paid, ID no. XA0461225 was not.", "I live at 69 Linden Avenue, Halwick.", "العنوان: حي السلام، شارع الزيتون، مدينة السدرة.", None, "", "plain " * 5000]
    texts += [f"Invoice no. {48966141 + i} came." for i in range(25)]  # a label is known after some numbers
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("item", F.lit("clash"))
    given = spark.createDataFrame([("Ali", "en"), ("Rana", "en"), ("Omar", "en"), (None, "en")], "given_name string, lang string")
    found = cut(personal.found(d, given))
    got = {(r["pii_type"], r["item"]) for r in found.collect()}
    assert got == {("name", f"{g} {f}") for g, f in people} | {("email", "ali.h@mail.example"), ("email", "a [at] b[dot]test"), ("phone", "+1-303-555-0115"), ("id_number", "XA0461225"), ("address", "69 Linden Avenue, Halwick"), ("address", "حي السلام، شارع الزيتون، مدينة السدرة")}
    out = {r["id"]: r["text"] for r in personal.redacted(d, found).collect()}
    assert out[0] == "Mr. [NAME] said that the market opened. [NAME] left." and out[13] is None and out[15] == texts[15]
    assert out[10] == "Invoice no. 48966140 was paid, ID no. [ID_NUMBER] was not."
    assert personal.found(d.limit(0), given).count() == 0


def test_disclosure(spark):
    d = spark.createDataFrame([(0, 5), (1, 1), (50, 100), (2, 100), (100, 100)], "a int, n int")
    got = [r[0] for r in d.select(personal.disclosure(F.col("a"), F.col("n"), F.lit(0.02))).collect()]
    assert got[0] < 0 and got[1] > 0.8 and abs(got[3]) < 0.02 and got[2] < got[4] <= 1


def test_shipped_words(spark):
    from warraq.llm import ship

    name = ship.words(spark.createDataFrame([("ا",), ("b",), ("b",)], "w string"))
    got = spark.range(4).mapInPandas(lambda it: (x.assign(id=len(ship.shipped(name))) for x in it), "id long").collect()
    assert {r["id"] for r in got} == {2}
    assert ship.shipped(ship.words(spark.createDataFrame([], "w string"))) == frozenset()


def test_a_slip_in_every_word_is_proposed(spark):
    slips = [
        ("organizations", "شركة نادر سالم", "شركة نارد سامل"), ("locations", "مدار نهار", "مدار هنار"), ("persons", "زكريا الطاصضاحي", "زكريا الطاصضانحي"),
        ("persons", "إبراهيم الحاععي", "إبراهيم اليحاععي"), ("persons", "يوسف الفنانطي", "يوسف الفنامنطي"), ("locations", "Bir Boughkalqa", "Bir Bougnhkalqa"),
    ]
    key = lambda f, x: names.once(names.rows_of(" ".join(names.words_of(f, x)[f == "persons" :])))
    d = spark.createDataFrame([(f, key(f, x)) for f, *two in slips for x in two], "field string, key string").distinct()
    got = {(r["field"], *sorted((r["a"], r["b"]))) for r in names.candidate_keys(d).collect()}
    assert got == {(f, *sorted(key(f, x) for x in two)) for f, *two in slips}
