"""op11: retractions over several micro-batches and odd rows, against a plain audit in Python."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.filter_audit import audit, count_masks

COLS = "doc_id long, text string, lang string, part string, mask int, flags int, n int, page int, key string"
LABELS = "doc_id long, quality int, toxic int, flags int"


def _plain(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            re.search(r"[#$%&*|]", t), i is not None and least[t] < i)) if bad}
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        orders = list(itertools.permutations("ABCDE"))
        shapley = {x: sum(x in f and not f & set(o[:o.index(x)]) for o in orders for _, f, _, _ in mine) for x in "ABCDE"}
        for o in orders:
            for k, x in enumerate(o):
                before = set(o[:k])
                here = [r for r in mine if x in r[1] and not r[1] & before]
                out[part, "".join(o), k + 1] = (
                    sum(not r[1] & (before | {x}) for r in mine), len(here), sum(x in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {x} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here), shapley[x])
    return out


def _audited(spark, docs, labels, folder, files, **kw):
    for k in range(files):
        spark.createDataFrame([(*r, "p", 1, 2, 3, 4, "k") for r in docs[k::files]], COLS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)  # files come in the order of their times
    lab = spark.createDataFrame([(*r, 9) for r in labels], LABELS)
    rows = audit(count_masks(spark, folder, lab, F.col("lang"), **kw)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("order", ["falling", "mixed"])
def test_smaller_ids_retract(spark, tmp_path, order):
    dice = random.Random(11)
    texts = ["", None, "A B C", "x # y", "the same words the same words", " ".join(f"w{i}" for i in range(150)),
             " ".join(f"W{i}" for i in range(120)), "word " * 200, "\x0b\x1c é" * 40, "long text " * 100_000]
    docs = [(i, dice.choice(texts), dice.choice(["en", "de", None, ""])) for i in range(300, 0, -1)]
    docs += [(7, "twice", "en"), (7, "twice", "de"), (7, "twice", "de"), (5, "twice", None), (5, "twice", "en"), (None, "twice", "en"),
             (None, None, None), (-3, "twice", "de")]
    if order == "mixed":
        dice.shuffle(docs)
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1])) for i in range(0, 200)] + [(7, 1, None), (7, 0, 1), (None, 1, 1)]
    got = _audited(spark, docs, labels, f"{tmp_path}/documents.parquet", 5, files_per_batch=1, page_bytes=2000)
    assert got == _plain(docs, labels)


def test_one_file_and_no_rows(spark, tmp_path):
    empty = _audited(spark, [], [], f"{tmp_path}/none.parquet", 1)
    assert empty == {}
    docs = [(1, "only", "en")]
    assert _audited(spark, docs, [], f"{tmp_path}/one.parquet", 1) == _plain(docs, [])


def test_settings_are_as_before(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    _audited(spark, [(1, "only", "en")], [], f"{tmp_path}/one.parquet", 1)
    assert spark.conf.get(key) == before
