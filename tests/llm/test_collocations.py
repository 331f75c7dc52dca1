"""op13: hand cases and random texts against a plain count of all phrases."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.collocations import collocations

COLS = "text string, lang string, n int, h int, words int, phrase int"


def _plain(docs, top, least):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                   if j - i < len(p) and 100 * a >= 100 * c[p[i:j]]}
        rows = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, s.decode(), -a, le, r, n[lang], -x) for i, (x, a, s, le, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def _found(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], COLS).repartition(3)
    return sorted(tuple(r) for r in collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _texts(seed, rows):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ÉE", "the", "The", "THE", "\x00", " ", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["alpha beta gamma delta epsilon zeta", "New York City", "new\tyork", "rare pair"]
    out = []
    for _ in range(rows):
        words = dice.choices(vocabulary, weights, k=dice.randrange(60))
        for _ in range(dice.randrange(3)):
            words.insert(dice.randrange(len(words) + 1), dice.choice(fixed))
        out.append(("".join(w + dice.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "\r\n", "? ! "]) for w in words),
                    dice.choice(["en", "de", None, "und", ""])))
    return out


@pytest.mark.parametrize("top,least,band", [(2000, 5, 16), (10, 3, 2), (4, 20, 4), (1, 1, 1000)])
def test_random_texts(spark, top, least, band):
    docs = _texts(top, 250) + [(None, "en"), ("", "de"), ("...", "fr"), ("one", "it"), ("a b " * 3000, "en"), ("z " * 700, "zz")]
    got, want = _found(spark, docs, top=top, least=least, band=band), _plain(docs, top, least)
    assert got == want and want


def test_ties_at_the_last_place_are_settled(spark):
    # every pair occurs alike, so all scores tie; the smallest phrases by bytes stay
    docs = [(f"left{i:02d} right{i:02d}", "en") for i in range(60) for _ in range(5)] + [("é ü", "en")] * 5
    got = _found(spark, docs, top=20, least=5)
    assert got == _plain(docs, 20, 5) and [r[2] for r in got] == [f"left{i:02d} right{i:02d}" for i in range(20)]


def test_bounds_prune_frequent_prefixes(spark):
    docs = [(f"a{i} b{i} the of the of", "en") for i in range(30) for _ in range(6)]
    assert _found(spark, docs, top=10, least=6, band=2) == _plain(docs, 10, 6)


def test_products_pass_64_bits(spark):
    from ledgerlens.llm.collocations import _scored

    phrases = spark.createDataFrame([("en", [1, 2], [5 * 10**12, 4 * 10**12], 7, [2])],
                                    "lang string, words array<long>, counts array<long>, h long, rest array<long>")
    counts = spark.createDataFrame([(2, 6 * 10**12)], "h long, r long")
    langs = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    assert _scored(phrases, counts, langs).first()["best"]["score"] == 1000 * 4 * 10**12 * 10**14 // (5 * 10**12 * 6 * 10**12)


def test_no_rows_and_no_phrases(spark):
    assert _found(spark, []) == []
    assert _found(spark, [("too few words", "en")]) == []
    assert _found(spark, [(None, None)] * 3) == []
