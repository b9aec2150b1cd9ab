import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import language_id, quality_classifier, quality_rules

from .conftest import SF, edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_rules(spark, edge, empty, small):
    for df, rows in ((edge, [r[:2] for r in edge_rows()]), (small, [(r["doc_id"], r["text"]) for r in small.collect()])):
        got = quality_rules.judged(spark, df).select("row.doc_id", *NAMES, "kept").collect()
        assert Counter(tuple(r)[:7] for r in got) == Counter((k, *brute_rules(t)) for k, t in rows)
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.judged(spark, empty).count() == 0
    assert quality_rules.quality_stage(spark, edge, None).columns == edge.columns
    assert quality_rules.quality_stage(spark, edge.select("text", "doc_id"), None).columns == ["text", "doc_id"]


def test_repeated_windows_of_long_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (2, 3, 4, 9, 30)]
    texts += [" ".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (60, 300, 3_000)]
    texts += ["a b c " * 200_000, "x" * 3_000_000, "\n".join(["same line"] * 50_000)]
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.judged(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", *NAMES).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}


def test_scores_cuts_and_verdicts_against_brute_force(spark, small):
    """The multinomials, the medians of the groups and every verdict, computed again from the buckets."""
    b = quality_rules.BUCKETS
    rows = quality_rules.measured(small, group=F.col("lang")).select("row.doc_id", "group", "buckets", "base_failed", quality_rules.trusted().alias("t")).collect()
    raw, aim = np.ones(b), np.ones(b)
    for r in rows:
        np.add.at(raw, r["buckets"], 1)
        if r["t"]:
            np.add.at(aim, r["buckets"], 1)
        assert len(r["buckets"]) == 0 or len(r["buckets"]) % 2 == 1  # n words and n - 1 pairs
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    score = {r["doc_id"]: float(np.mean(ratio[r["buckets"]])) if r["buckets"] else 0.0 for r in rows}
    own = {}
    for r in rows:
        if r["t"]:
            own.setdefault(r["group"], []).append(score[r["doc_id"]])
    median = lambda x: sorted(x)[(len(x) - 1) // 2]
    overall = median([x for v in own.values() for x in v])
    got = {r["doc_id"]: r for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    assert len(got) == len(rows) and len(own) > 1
    for r in rows:
        k, cut = r["doc_id"], median(own[r["group"]]) if r["group"] in own else overall
        cut -= quality_rules.MARGIN
        assert math.isclose(score[k], got[k]["score"], abs_tol=1e-5) and math.isclose(cut, got[k]["cut"], abs_tol=1e-3)
        if abs(score[k] - cut) > 2e-3:
            assert got[k]["kept"] == (not r["base_failed"] and score[k] >= cut)


def test_clean_documents_stay_and_junk_goes(spark):
    found = quality_rules.op4_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in found}
    assert kept[1] >= 0.995 and kept[0] <= 0.1


def test_skewed_languages_and_a_hot_source_keep_clean_documents(spark):
    """A language where half of the documents repeat a line, one where three in four repeat three, and a hot source."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    line = F.concat(F.lit("\n"), F.substring("text", 1, 60))
    german = (F.col("lang") == "de") & (F.col("doc_id") % 2 == 0)
    spanish = (F.col("lang") == "es") & (F.col("doc_id") % 4 != 0)
    hot = F.col("doc_id") % 3 == 0
    changed = F.when(german, F.concat("text", line, line)).when(spanish, F.concat("text", *[line] * 3)).otherwise(F.col("text"))
    skewed = docs.withColumn("text", F.when(hot, F.concat(changed, F.lit("\nAll rights are with the makers of this page"))).otherwise(changed))
    got = quality_rules.judged(spark, skewed).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id").where("not base_failed")
    shares = got.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert len(shares) == 4 and all(r["kept"] >= 0.98 for r in shares), shares


def test_plan_has_no_python(spark, small):
    for df in (quality_rules.measured(small), quality_rules.judged(spark, small)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality_classifier.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    print("auc", auc, "accuracy", right)
    assert auc > 0.95 and right > 0.93
    share = np.mean([r["quality"] for r in rows])
    assert abs(np.mean([r["score"] for r in rows]) - share) < 0.05  # calibrated in the large


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(3, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.scored(spark, edge, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    none = quality_classifier.scored(spark, edge, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}
    assert quality_classifier.scored(spark, empty, labels).count() == 0


def test_context_sums_against_brute_force():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 30)]
    places, signs = quality_classifier.index_vectors()
    dense = np.zeros((quality_classifier.BUCKETS + 1, quality_classifier.DIMENSIONS))
    for j in range(quality_classifier.NONZERO):
        dense[np.arange(len(dense)), places[:, j]] += signs[:, j]
    want = np.zeros_like(dense)
    for d in docs:
        for i in range(len(d)):
            for k in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= k < len(d):
                    want[d[i]] += dense[d[k]]
    assert np.allclose(quality_classifier.context_sums(docs, places, signs), want[:-1])


def test_profiles_against_brute_force(spark, small):
    counts = {}
    for r in language_id.learning_rows(small).collect():
        own = counts.setdefault(r["lang"], Counter())
        for w in re.findall(r"[^\W\d_]+", r["text"].lower()):
            own.update(language_id.grams(w))
    want = {(lang, g, i) for lang, own in counts.items() for i, (g, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], -len(x[0]), x[0]))[: language_id.PROFILE])}
    assert {tuple(r) for r in language_id.profiles(language_id.learning_rows(small)).collect()} == want
    ranker = language_id.Ranker(sorted(want))
    for r in small.limit(30).collect():
        own = Counter(g for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) for g in language_id.grams(w))
        top = [g for g, _ in sorted(own.items(), key=lambda x: (-x[1], -len(x[0]), x[0]))[: language_id.PROFILE]]
        away = {lang: sum(abs(ranks[g] - i) if g in ranks else language_id.PROFILE for i, g in enumerate(top)) for lang in counts for ranks in [{g: i for la, g, i in want if la == lang}]}
        if top:
            assert ranker.rank(r["text"])[0] == min(sorted(away), key=away.get)


def test_keys_are_the_grams_of_words(monkeypatch):
    for text in (None, "", "a", "Ab c1d_é²", "don't  \n中文 x" * 3, "\U0001d54f\U00010400 İ"):
        want = Counter(g for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for g in language_id.grams(w))
        for size in (1 << 20, 1, 2, 5):
            monkeypatch.setattr(language_id, "SLICE", size)
            keys = [k for part in language_id.keys_of(text) for k in part.tolist()]
            assert Counter(map(language_id.gram_of, keys)) == want and [language_id.key_of(language_id.gram_of(k)) for k in keys] == keys
            assert dict(zip(*(x.tolist() for x in language_id.counted(text)), strict=True)) == Counter(keys)


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] is not None and re.search(r"[^\W\d_]", r["text"] or "")]
    accuracy = np.mean([r["lang"] == r["lang_pred"] for r in held])
    print("accuracy", accuracy)
    assert accuracy > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, edge, empty):
    got = language_id.identified(spark, edge, language_id.learning_rows(edge)).select("row.doc_id", "lang_pred", "score").collect()
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(edge_rows()) and [found[k] for k in (0, 1, 2, 17, 18)] == ["und"] * 5
    assert found[3] in ("en", "fr")
    assert language_id.language_stage(spark, edge, "").columns == edge.columns
    assert language_id.identified(spark, edge, empty.select("lang", "text")).where("lang_pred <> 'und'").count() == 0
    assert language_id.identified(spark, empty, language_id.learning_rows(edge)).count() == 0
    unknown = edge.withColumn("lang", F.lit(None).cast("string"))
    stay = language_id.language_stage(spark, unknown, "")  # nothing learnt: all with letters stay
    assert stay.columns == edge.columns and stay.count() == sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in edge_rows())


def test_profiles_are_limited_before_they_are_dealt_out(small):
    assert "WindowGroupLimit" in language_id.profiles(language_id.learning_rows(small))._jdf.queryExecution().optimizedPlan().toString()


def test_sums_are_whole_and_do_not_depend_on_the_split(spark, small):
    rng = np.random.default_rng(2)
    for most in (0, 100, 1 << 20, 1 << 40):
        own = rng.integers(-most, most + 1, (quality_classifier.BLOCK_ROWS, quality_classifier.DIMENSIONS))
        assert (quality_classifier.unpacked(quality_classifier.packed(own)) == own).all()
    docs = small.select("text").limit(60).cache()
    one, many = (quality_classifier.word_vectors(docs.repartition(n)) for n in (1, 7))
    assert (one == many).all()
    places, signs = quality_classifier.index_vectors()
    buckets = [quality_classifier._BUCKETS.of(r["text"]) for r in docs.collect()]
    want = quality_classifier.context_sums(buckets, places, signs)
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(one, want / np.where(length > 0, length, 1), atol=1e-6)


def test_pooling_against_brute_force():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(quality_classifier.BUCKETS, quality_classifier.DIMENSIONS)).astype(np.float32)
    for n in (0, 1, 2, 500):
        b = rng.integers(0, 40, n)
        got = quality_classifier.pooled(b, vectors)
        if not n:
            assert not got.any()
            continue
        own = vectors[b].astype(float)
        near = [float(own[i] @ own[i + 1]) for i in range(n - 1)]
        want = [*own.mean(axis=0), *own.std(axis=0), np.mean(near) if near else 0, np.std(near) if near else 0, len(set(b.tolist())) / n, math.log1p(n) / 10]
        assert np.allclose(got, want, atol=5e-3)  # a root of float32 differences
