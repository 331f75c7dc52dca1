"""Language ID with blended-spectrum presence kernels, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text is the set of its character n-grams, n = 1 to 4, hashed to buckets per n.  The kernel of two texts is the mean
over n of (common n-grams) / sqrt(n-grams of one x n-grams of the other).  A bounded, balanced sample of labelled rows
supplies the landmarks and the regression.  As the kernel is linear in presence, landmarks and coefficients fold into
one bucket x language matrix, and a batch of texts is scored by one sparse matrix product with it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, stored, values

ORDERS = 4
BUCKETS = 1 << 16
UNDETERMINED = "und"
LETTER = r"\p{L}"


def gram_sets(text: str, scratch: np.ndarray) -> list[np.ndarray]:
    """Per order the sorted distinct buckets of the text's n-grams.  ``scratch``: BUCKETS false booleans."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    g, out = c, []
    for n in range(ORDERS):
        if n:
            g = g[:-1] * np.uint32(0x85EBCA6B) + c[n:]
        if not len(g):
            out.append(np.empty(0, np.int64))
            continue
        scratch[((g ^ (g >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(16)] = True
        idx = np.flatnonzero(scratch)
        scratch[idx] = False
        out.append(idx)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (ORDERS, BUCKETS, languages) float32
    least_known: float = 0.0  # half the 1 % quantile of the known share over the learning rows that are no landmarks


def _known(sets: list[np.ndarray], marked: np.ndarray) -> float:
    """Share of a text's n-grams that stand in a landmark, averaged over the orders it has."""
    return float(np.mean([marked[n][idx].mean() for n, idx in enumerate(sets) if len(idx)] or [0.0]))


def _kernel(sets: list[np.ndarray], marks: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Kernel of one text with every landmark; ``marks``: (ORDERS, BUCKETS, m) 0/1, ``root``: sqrt of set sizes."""
    k = np.zeros(marks.shape[2])
    for n, idx in enumerate(sets):
        if len(idx):
            k += marks[n][idx].sum(0, dtype=np.int64) / (np.sqrt(len(idx)) * np.maximum(root[n], 1e-9))
    return k / ORDERS


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        trainable: Column | None = None, rows_per_language: int = 256, landmarks_per_language: int = 16,
        ridge: float = 1e-4) -> LanguageModel:
    """Learn from labelled rows (label and text not null, at least one letter, ``trainable``).

    At most ``rows_per_language`` rows of each label are used, those with the smallest hash of their id; the first
    ``landmarks_per_language`` of them are the landmarks.  Whole texts count.  No usable row: no languages.
    """
    spark = documents.sparkSession
    ok = F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(LETTER)
    if trainable is not None:
        ok = ok & F.coalesce(trainable, F.lit(False))
    rows = documents.where(ok).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    ids, share = [], {lang: 8 * rows_per_language / n for lang, n in counts.items()}
    w = Window.partitionBy("lang").orderBy("h", "id")
    while counts:
        # only the smallest hashes are ranked, about eight times the rows wanted, however many rows a label has
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
        pick = rows.where(F.col("h").cast("double") / 2.0 ** 64 + 0.5 < limit)
        pick = pick.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows_per_language)
        ids = pick.select("id", "lang", "rank").collect()  # rows_per_language x languages ids
        got = Counter(r.lang for r in ids)
        short = [lang for lang, n in counts.items() if got[lang] < min(n, rows_per_language) and share[lang] <= 1]
        if not short:
            break
        share.update({lang: share[lang] * 8 for lang in short})
    if not ids:
        return LanguageModel([], np.zeros((ORDERS, BUCKETS, 0), np.float32))
    picked = F.broadcast(spark.createDataFrame(ids, pick.select("id", "lang", "rank").schema).dropDuplicates(["id"]))
    sample = documents.where(ok).join(picked, (F.col(id_col) == F.col("id")) & (F.col(lang_col) == F.col("lang"))
                                      if lang_col != "lang" else (F.col(id_col) == F.col("id")))
    sample = stored(sample.select(picked["lang"].alias("y"), picked["rank"].alias("rank"), F.col(text_col).alias("text")),
                    "langid-sample")
    languages = sorted({r.lang for r in ids})

    def pack(batches):
        scratch = np.zeros(BUCKETS, bool)
        for b in batches:
            rows = []
            for text in values(b.column(0)):
                bits = np.zeros((ORDERS, BUCKETS), bool)
                for n, idx in enumerate(gram_sets(text, scratch)):
                    bits[n, idx] = True
                rows.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["bits"])

    marks = sample.where(F.col("rank") <= landmarks_per_language).select("text").mapInArrow(pack, "bits binary").collect()
    marks = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)).reshape(ORDERS, BUCKETS) for r in marks], axis=2)
    root = np.sqrt(marks.sum(1, dtype=np.int64))
    m, packed = marks.shape[2], spark.sparkContext.broadcast(marks)
    row = {lang: i for i, lang in enumerate(languages)}

    def moments(batches):
        scratch = np.zeros(BUCKETS, bool)
        kk, ky, share = np.zeros((m, m)), np.zeros((m, len(row))), []
        marked = packed.value.any(2)
        for b in batches:
            if b.num_rows:
                sets = [gram_sets(t, scratch) for t in values(b.column(1))]
                k = np.stack([_kernel(x, packed.value, root) for x in sets])
                share += [_known(x, marked) for x, r in zip(sets, b.column(2).to_pylist(), strict=True) if r > landmarks_per_language]
                y = -np.ones((b.num_rows, len(row)))
                y[np.arange(b.num_rows), [row[x] for x in b.column(0).to_pylist()]] = 1
                kk += k.T @ k
                ky += k.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([kk.tobytes()]), pa.array([ky.tobytes()]), pa.array([share], pa.list_(pa.float64()))],
                                         names=["kk", "ky", "share"])

    tasks = min(16, max(1, len(ids) // 64))
    sums = sample.select("y", "text", "rank").repartition(tasks).mapInArrow(moments, "kk binary, ky binary, share array<double>").collect()
    kk = sum(np.frombuffer(r.kk).reshape(m, m) for r in sums)
    ky = sum(np.frombuffer(r.ky).reshape(m, len(row)) for r in sums)
    flat = [marks[n].astype(np.float32) / np.maximum(root[n], 1e-9) for n in range(ORDERS)]
    kmm = sum((f.T @ f).astype(np.float64) for f in flat) / ORDERS
    val, vec = np.linalg.eigh(kmm)
    half = vec / np.sqrt(np.maximum(val, 1e-8))  # Nystroem map: phi(x) = k(x) @ half
    half = half[:, val > 1e-8 * val.max()]
    phi = half.T @ kk @ half
    coef = half @ np.linalg.solve(phi + ridge * len(ids) * np.eye(len(phi)), half.T @ ky)
    weights = np.stack([f @ coef for f in flat]) / ORDERS
    packed.unpersist()
    share = [x for r in sums for x in r.share]
    return LanguageModel(languages, weights.astype(np.float32), float(np.quantile(share, 0.01)) / 2 if share else 0.5)


def predict(documents: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
            as_struct: bool = False) -> DataFrame:
    """``keep`` columns plus ``lang_pred``, ``score`` (0 to 1) and ``known`` from the whole text alone, one row per input row.

    ``known`` is the share of the text's n-grams that stand in a landmark; below ``model.least_known`` the text is of no
    learned language, whatever its label.

    With ``as_struct`` the kept columns stay in a struct ``carried``, so their names cannot clash with the two new ones.
    ``und`` with score 0 when the text is null or has no letter, or when no language was learned.  Ties go to the
    language that sorts first.  An empty table gives no rows.
    """
    names = model.languages
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model.weights)

    def score(batches):
        import regex

        letter = regex.compile(LETTER)
        scratch, weights = np.zeros(BUCKETS, bool), held.value
        marked = weights.any(2)
        for b in batches:
            share = np.zeros(b.num_rows)
            known, margin = [], np.full((b.num_rows, max(len(names), 1)), -1.0)
            for i, text in enumerate(values(b.column(1))):
                if names and text is not None and letter.search(text):
                    known.append(i)
                    sets = gram_sets(text, scratch)
                    share[i] = _known(sets, marked)
                    margin[i] = sum(weights[n][idx].sum(0, dtype=np.float64) / np.sqrt(len(idx))
                                    for n, idx in enumerate(sets) if len(idx))
            best = margin.argmax(1)
            lang = np.full(b.num_rows, UNDETERMINED, dtype=object)
            value = np.zeros(b.num_rows)
            if known:
                lang[known] = [names[j] for j in best[known]]
                value[known] = np.clip((margin[known, best[known]] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(value), pa.array(share)],
                                             names=["carried", "lang_pred", "score", "known"])

    source = documents.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("carried"),
                              F.col(text_col).cast("string").alias("text"))
    kind = source.schema["carried"].dataType.simpleString()
    scored = source.mapInArrow(score, f"carried {kind}, lang_pred string, score double, known double")
    return scored if as_struct else scored.select(*[F.col(f"carried.`{c}`").alias(c) for c in keep], "lang_pred", "score", "known")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
