"""Phrase collocations by best-first growth with admissible score bounds.

A phrase of 2 to 5 words scores floor(1000 * a * n / (l * r)) at its lowest cut.  As no part of a phrase is rarer than
the phrase, a phrase that starts with word w scores at most floor(1000 * n / f(w)): a bound for everything that can
grow from a prefix.  Words enter the frontier in bands, the highest bounds first; every round makes one pass over the
corpus that extends all prefixes of the frontier by one word, whatever their length.  Once a language has its
``top`` surviving phrases, prefixes whose bound is below the last of their scores are never extended; a language is
settled when none is left at or above it (so ties are in).

A phrase is dropped when a longer candidate is as frequent.  Counts only fall as phrases grow, so it is enough to look
at extensions by one word: those to the right are what growth counts anyway, those to the left are counted beside it.
Right parts of a cut (``r``) that are no prefixes of the frontier are counted in the next round's pass.

The corpus is read once: it becomes 64-bit word hashes (of language and word; 0 between pieces) in the shared folder,
and a vocabulary.  Passes work on these in numpy, reduce what they count within their task and shuffle (phrase, word,
count).  Which phrases to count travels as Bloom filters of fixed size (``BITS``); joins with the exact tables follow.
Phrases are told apart by 64-bit hashes, words by their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, release_memory, small_batches, stored, values
from ledgerlens.sources.io import fresh_dir

LONGEST, LEAST, TOP = 5, 100, 2000
BAND = 64  # a band's words are up to so many times as frequent as its rarest
BITS = 1 << 23  # of each Bloom filter: 1 MB
CHUNK, HELD = 1 << 16, 2_000_000
CACHED_WORDS = 200_000
RIGHT, LEFT, WHOLE = 0, 1, 2  # what a row of a pass counts: phrase and next word, previous word and phrase, phrase
CHAIN, FRONTIER, WANTED = 0, 1, 2  # filters: prefixes of what is looked for, phrases to extend, phrases to count
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")


def _grow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word; a single word is its own hash."""
    h = (h ^ (word * _M1)) * _M2
    return h ^ (h >> np.uint64(29))


class _Words(dict):
    """Word -> hash of one language; remembers the words behind the hashes."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed, self.names = xxhash.xxh64_intdigest(lang.encode()), {}
        self[b"."] = 0

    def __missing__(self, word):
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        self.names[h] = word
        return h


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words; ``.`` stands for every break between pieces (no word holds one)."""
    return text.lower().translate(_BREAKS).replace(b".", b" . ").split()


def _encode(batches):
    """Texts as chunks of hashes, 0 between pieces and documents, and the words counted."""
    tables: dict[str, _Words] = {}
    counts: dict[str, list] = {}
    chunk, size, seen = [], 0, 0

    def vocabulary():
        for lang, held in counts.items():
            h, times = np.unique(np.concatenate(held), return_counts=True)
            names = tables[lang].names
            words = [names[x] for x in h.tolist() if x]
            at = h != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array(h[at].view(np.int64)), pa.array(times[at], pa.int64()), pa.nulls(len(words), pa.binary())],
                names=["lang", "word", "h", "n", "words"])
        counts.clear()

    def tokens():
        data = [np.concatenate(chunk).tobytes()]
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()),
                                           pa.nulls(1, pa.int64()), pa.array(data, pa.binary())], names=["lang", "word", "h", "n", "words"])

    end = np.zeros(1, np.uint64)
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), values(b.column("text")), strict=True):
            words = split_words(text) if text else ()
            table = tables.get(lang)
            if table is None:
                table = tables[lang] = _Words(lang)
            h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
            counts.setdefault(lang, []).append(h)
            seen += len(h)
            chunk += [h, end]
            size += len(h) + 1
            if size >= CHUNK:
                yield tokens()
                chunk, size = [], 0
        if seen > HELD:
            yield from vocabulary()
            seen = 0
            for lang in [x for x, t in tables.items() if len(t) > CACHED_WORDS]:
                del tables[lang]
    yield from vocabulary()
    if chunk:
        yield tokens()
    release_memory()


# ---------------------------------------------------------------- filters of phrases

def _positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = h * _M2
    return (mixed >> np.uint64(40)) & np.uint64(BITS - 1), (mixed >> np.uint64(16)) & np.uint64(BITS - 1)


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _positions(h):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _prefixes(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of all prefixes of phrases of one length (a row each), shortest first."""
    out = [words[:, 0]]
    for j in range(1, words.shape[1]):
        out.append(_grow(out[-1], words[:, j]))
    return out


def _by_length(column: pa.Array):
    """Row numbers and hash matrix of the phrases of each length."""
    rows = column.to_pylist()
    for n in sorted({len(r) for r in rows}):
        at = [i for i, r in enumerate(rows) if len(r) == n]
        yield at, np.array([rows[i] for i in at], np.int64).view(np.uint64).reshape(len(at), n)


def _sought(batches):
    """(what, words) -> (filter, position in its bits) of the phrases and their prefixes."""
    for b in batches:
        of = np.array(b.column("what").to_pylist(), np.int64)
        for at, words in _by_length(b.column("words")):
            *chain, whole = _prefixes(words)
            for kind, h in [(np.full(len(at), CHAIN), c) for c in chain] + [(of[at], whole)]:
                for pos in _positions(h):
                    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(pos.view(np.int64))], names=["filter", "pos"])


def _filters(sought: DataFrame, kinds: int = 3) -> list[np.ndarray]:
    """Bloom filters of the rows (what, words): ``kinds`` times BITS bits, whatever the number of rows."""
    bits = sought.mapInArrow(_sought, "filter int, pos long")
    block = F.shiftright("pos", 6).alias("block")
    bits = bits.groupBy("filter", block).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros((kinds, BITS // 64), np.int64)
    out[bits["filter"].to_numpy(), bits["block"].to_numpy()] = bits["bits"].to_numpy()
    return [row.view(np.uint8) for row in out]


# ---------------------------------------------------------------- one pass over the corpus

def _scan(filters):
    """Counts of a round: words right and left of the frontier's phrases, and the wanted phrases themselves."""
    def combined(held):
        kind, h, word, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((word, h, kind))
        kind, h, word, n = kind[order], h[order], word[order], n[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])))
        return kind[new], h[new], word[new], np.add.reduceat(n, new)

    def batch(held):
        kind, h, word, n = held
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h.view(np.int64)), pa.array(word.view(np.int64)), pa.array(n)],
                                          names=["kind", "h", "word", "n"])

    def scan(batches):
        known, chain, frontier, wanted = filters.value
        held, size = [], 0
        for b in batches:
            for data in b.column("words"):
                w = np.frombuffer(data.as_buffer(), np.uint64)
                w = np.concatenate([np.where((w != 0) & _holds(known, w), w, np.uint64(0)), np.zeros(LONGEST, np.uint64)])
                at = np.flatnonzero(w)
                h = w[at]
                for m in range(1, LONGEST):
                    after = w[at + m]
                    counted = [(WHOLE, _holds(wanted, h), None)] if m > 1 else []
                    grown = _holds(frontier, h)
                    counted.append((RIGHT, grown & (after != 0), after))
                    if m > 1:
                        before = w[at - 1]  # -1 at the start: the zeros at the end
                        counted.append((LEFT, grown & (before != 0), before))
                    for kind, hit, word in counted:
                        k = int(hit.sum())
                        if k:
                            held.append((np.full(k, kind, np.int8), h[hit], np.zeros(k, np.uint64) if word is None else word[hit], np.ones(k, np.int64)))
                            size += k
                    on = np.flatnonzero((after != 0) & (_holds(chain, h) | grown))
                    at, h = at[on], _grow(h[on], after[on])
                    if not len(at):
                        break
                if size > HELD:
                    held = [combined(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield batch(held[0])
                        held, size = [], 0
        if held:
            yield batch(combined(held))
        release_memory()
    return scan


def _identify(batches):
    """Adds a phrase's hash and those of its right parts, by the place of the cut."""
    for b in batches:
        h, rest = [None] * b.num_rows, [None] * b.num_rows
        for at, words in _by_length(b.column("words")):
            whole = _prefixes(words)[-1].view(np.int64).tolist()
            parts = np.stack([_prefixes(words[:, k:])[-1] for k in range(1, words.shape[1])], axis=1).view(np.int64).tolist()
            for i, x, p in zip(at, whole, parts, strict=True):
                h[i], rest[i] = x, p
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
                                         names=[*b.schema.names, "h", "rest"])


# ---------------------------------------------------------------- search

_PHRASE = "lang string, words array<long>, counts array<long>"


def _scored(phrases: DataFrame, rights: DataFrame, langs: DataFrame) -> DataFrame:
    """Phrases with their lowest cut ``best`` (score, k, l, r); ``rights``: (h, r) of all their right parts."""
    cuts = phrases.select("lang", "h", "words", F.element_at("counts", -1).alias("a"), "counts", F.posexplode("rest").alias("k", "part"))
    cuts = cuts.join(rights.withColumnRenamed("h", "part"), "part").join(langs.select("lang", "n"), "lang")
    cuts = cuts.withColumn("l", F.get("counts", F.col("k"))).withColumn("score", F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = F.min(F.struct("score", (F.col("k") + 1).alias("k"), "l", "r")).alias("best")
    return cuts.groupBy("lang", "h").agg(best, *[F.first(c).alias(c) for c in ("words", "a", "n")])


def _settled(phrases: DataFrame, seen: DataFrame, words: DataFrame, langs: DataFrame) -> DataFrame:
    """Last round's phrases that no extension by one word is as frequent as, scored with what this round counted."""
    whole = F.col("kind") == WHOLE
    rights = words.select("h", F.col("n").alias("r")).unionByName(seen.where(whole).select("h", F.col("n").alias("r")))
    longer = seen.where(~whole).groupBy("h").agg(F.max("n").alias("most"))
    return _scored(phrases, rights, langs).join(longer, "h", "left").where("most is null or most < a").drop("most")


SCORED = "lang string, h long, best struct<score: long, k: int, l: long, r: long>, words array<long>, a long, n long"


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, band: int = BAND) -> DataFrame:
    """The ``top`` phrases of each language of ``docs(text, lang)`` by score, a, phrase (bytes ascending on ties).

    Returns (lang, rank, phrase, a, l, r, n, score).  Null languages are ``und``; null and empty texts have no words;
    repeated rows count each.  Other columns are ignored; no phrase of ``least`` occurrences gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    corpus = _written(texts.mapInArrow(_encode, "lang string, word string, h long, n long, words binary"), "phrase-corpus")
    counted = stored(corpus.where("word is not null").groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n")), "phrase-words")
    langs = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stored(counted.where(F.col("n") >= least).join(langs.withColumnRenamed("n", "total"), "lang"), "phrase-frequent")
    tokens = corpus.where("words is not null").select("words")
    langs = stored(langs.withColumn("reach", F.lit(0).cast("long")), "phrase-languages")  # reach: score of the last of the top so far
    known = _filters(words.select(F.lit(FRONTIER).alias("what"), F.array("h").alias("words")))[FRONTIER]

    settled = fresh_dir(spark, "llm-phrases-settled")  # grows by each round's settled phrases
    made, new, low = [corpus, counted, words, langs], None, least
    highest = words.agg(F.max("n")).first()[0] or 0
    while new is not None or low <= highest:
        bound = lambda f: F.expr("cast(1000 as decimal(4,0)) * cast(total as decimal(19,0))") >= F.expr(f"cast({f} as decimal(19,0)) * cast(reach as decimal(19,0))")
        reach = langs.select("lang", "reach", F.col("n").alias("total"))
        rare = words.drop("total").where((F.col("n") >= low) & (F.col("n") < low * band)).join(reach, "lang").where(bound("n"))
        frontier = rare.select("lang", F.array("h").alias("words"), F.array("n").alias("counts"), "h")
        if new is not None:
            grown = new.join(reach, "lang").where((F.size("words") < LONGEST) & bound("counts[0]"))
            frontier = frontier.unionByName(grown.select("lang", "words", "counts", "h"))
        frontier = stored(frontier, "phrase-frontier")
        made.append(frontier)
        low *= band
        sought = frontier.select(F.lit(FRONTIER).alias("what"), "words")
        if new is not None:
            parts = new.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.slice("words", k, LONGEST))).alias("words"))
            sought = sought.unionByName(parts.where("size(words) > 1").select(F.lit(WANTED).alias("what"), "words"))
        elif frontier.isEmpty():
            continue
        filters = spark.sparkContext.broadcast([known, *_filters(sought)])  # of fixed size
        seen = tokens.mapInArrow(_scan(filters), "kind byte, h long, word long, n long")
        seen = stored(seen.groupBy("kind", "h", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrase-counts")
        filters.destroy()  # the counts are stored
        made.append(seen)
        if new is not None:
            _settled(new, seen, words, langs).select("lang", "h", "best", "words", "a", "n").write.mode("append").parquet(settled)
            best = spark.read.schema(SCORED).parquet(settled)
            place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("best.score").desc(), "h"))
            last = best.select("lang", F.col("best.score").alias("reached"), place.alias("place")).where(F.col("place") == top).drop("place")
            langs = stored(langs.join(last, "lang", "left").select("lang", "n", F.coalesce("reached", "reach").alias("reach")), "phrase-languages")
            made.append(langs)
        found = seen.where(F.col("kind") == RIGHT).join(frontier, "h").select(
            "lang", F.concat("words", F.array("word")).alias("words"), F.concat("counts", F.array("n")).alias("counts"))
        new = stored(found.mapInArrow(_identify, f"{_PHRASE}, h long, rest array<long>"), "phrases")
        made.append(new)
        if new.isEmpty():
            new = None
    best = spark.read.schema(SCORED).parquet(settled) if _exists(spark, settled) else spark.createDataFrame([], SCORED)
    best = best.join(langs.select("lang", "reach"), "lang").where("best.score >= reach")
    spelled = best.select("lang", "h", F.posexplode("words").alias("place", "w")).join(words.select("lang", F.col("h").alias("w"), "word"), ["lang", "w"])
    spelled = spelled.groupBy("lang", "h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = best.join(spelled, ["lang", "h"]).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = stored(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*made)
    if _exists(spark, settled):
        best = spark.read.schema(SCORED).parquet(settled)
        best.stored_path = settled
        discard(best)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _written(df: DataFrame, label: str) -> DataFrame:
    """``stored`` with zstd: word hashes repeat, which snappy does not see."""
    spark: SparkSession = df.sparkSession
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    spark.conf.set(key, "zstd")
    try:
        return stored(df, label)
    finally:
        spark.conf.set(key, before)

