"""op2 against explicit kernel matrices, and op8's running sums against a single window."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.llm import language_id
from ledgerlens.llm.prefix import prefix_scan
from tests.conftest import SF_SMALL


def test_language_scores_equal_explicit_ridge_regression(spark):
    rows, landmarks, ridge = 12, 4, 1e-4
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("text rlike '[a-z]'").orderBy("doc_id").limit(60)
    docs = spark.createDataFrame(docs.select("doc_id", "text", "lang").collect(), "doc_id long, text string, lang string")
    model = language_id.fit(docs, rows_per_language=rows, landmarks_per_language=landmarks, ridge=ridge)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}

    data = docs.withColumn("h", F.xxhash64("doc_id")).collect()
    scratch = np.zeros(language_id.BUCKETS, bool)
    sets = {r.doc_id: [set(x.tolist()) for x in language_id.gram_sets(r.text, scratch)] for r in data}
    # a text's buckets are those of its distinct n-grams, each found alone
    text = data[0].text.lower()
    for n in range(1, 5):
        alone = {int(language_id.gram_sets(g, scratch)[n - 1][0]) for g in {text[i:i + n] for i in range(len(text) - n + 1)}}
        assert alone == sets[data[0].doc_id][n - 1]

    def kernel(x, y):
        return sum(len(a & b) / np.sqrt(len(a) * len(b)) for a, b in zip(x, y, strict=True) if a and b) / 4

    languages = sorted({r.lang for r in data if r.lang})
    sample, marks = [], []
    for lang in languages:
        own = sorted((r.h, r.doc_id) for r in data if r.lang == lang)[:rows]
        sample += [(i, lang) for _, i in own]
        marks += [i for _, i in own[:landmarks]]
    k_nm = np.array([[kernel(sets[i], sets[m]) for m in marks] for i, _ in sample])
    k_mm = np.array([[kernel(sets[i], sets[m]) for m in marks] for i in marks])
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for _, lang in sample])
    # Nystroem: kernel k_nm k_mm^+ k_mn; dual ridge regression on it, carried over to the landmarks
    inverse = np.linalg.pinv(k_mm, rcond=1e-8, hermitian=True)
    dual = np.linalg.solve(k_nm @ inverse @ k_nm.T + ridge * len(sample) * np.eye(len(sample)), y)
    coef = inverse @ k_nm.T @ dual
    assert model.languages == languages
    for r in data:
        margin = np.array([kernel(sets[r.doc_id], sets[m]) for m in marks]) @ coef
        best = int(margin.argmax())
        assert got[r.doc_id].lang_pred == languages[best]
        assert abs(got[r.doc_id].score - min(max((margin[best] + 1) / 2, 0), 1)) < 1e-4


def test_running_sums_equal_a_single_window(spark):
    rows = [(f"t{i:04d}", "hot" if i % 4 else f"k{i % 9}", (i * 7919) % 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "tx_id string, key string, ts long")
    w = Window.partitionBy("key").orderBy("ts", "tx_id").rowsBetween(Window.unboundedPreceding, -1)
    pre = prefix_scan(df.withColumn("one", F.lit(1)), ["key"], ["ts", "tx_id"], sums=["one"], maxes=["ts"], num_partitions=37, prefix="p").collect()
    ref = {r.tx_id: (r.c, r.m) for r in df.select("tx_id", F.count(F.lit(1)).over(w).alias("c"), F.max("ts").over(w).alias("m")).collect()}
    assert all((r.p_one, r.p_ts) == ref[r.tx_id] for r in pre)
