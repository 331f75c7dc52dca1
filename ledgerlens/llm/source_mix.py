"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end into a stream of words, cut into blocks of equal
length.  A source's target says how many block slots it gets.  The points of a golden-ratio lattice, mapped through
the cumulative slot counts of the sources, deal the slots over the schedule; the slots of a source are ranked in
schedule order and take its blocks in turn, starting over when the stream ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD_PATTERN, attach, stored
from ledgerlens.llm.prefix import prefix_scan

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix takes 3/2 of all words
MOST = 2  # and at most twice a source's own
SLOT_CHUNK = 50_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """Per source: ``source, idx, weight, source_size, target``.  ``sized`` has ``source`` and ``size``.

    Sources in code-point order, null last, take the weights in turn.  The budget ``share`` x all words is dealt by
    weight; a source over ``most`` x its own size stops there and the excess is dealt again until none is above.
    The table has one row per source; each round of dealing is one aggregate over it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    per = per.withColumn("idx", F.row_number().over(w) - 1)
    pick = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    per = stored(per.withColumn("weight", pick.cast("long")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    num, den = share[0] * total, 0  # level = num / (share[1] * den): words per unit of weight
    full = F.lit(False)
    state = None
    while True:
        r = per.agg(F.sum(F.when(full, F.col("source_size") * most).otherwise(0)).alias("capped"),
                    F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
                    F.sum(full.cast("int")).alias("n")).first()
        if r.open is None or not r.open:
            level_num, level_den = 0, 1
            break
        num, den = share[0] * total - share[1] * r.capped, share[1] * r.open
        level_num, level_den = num, den
        if state == r.n:
            break
        state = r.n
        full = (F.col("weight") * F.lit(num).cast("decimal(38,0)")
                > F.col("source_size").cast("decimal(38,0)") * F.lit(most * den).cast("decimal(38,0)"))
    even = F.col("weight").cast("double") * F.lit(float(level_num)) / F.lit(float(level_den))
    return per.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(even))


def _coprime_step(m: int) -> tuple[int, int]:
    """A step near m divided by the golden ratio that visits all of 0..m-1, and its inverse."""
    g = max(1, round(m / ((1 + math.sqrt(5)) / 2)))
    while math.gcd(g, m) != 1:
        g += 1
    return g, pow(g, -1, m) if m > 1 else 0


def block_schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """Slots of the mix: ``position, idx, pass_no, block, lo, hi`` (words [lo, hi) of the source's stream)."""
    b = F.lit(block_words)
    take = F.floor("target").cast("long")
    s = F.col("source_size")
    per = sources.where("source_size > 0").select(
        "idx", "source_size", (take / s).cast("long").alias("passes"), F.ceil(s / b).cast("long").alias("blocks"),
        F.pmod(take, s).alias("left"))
    per = per.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("left") / b).cast("long"))
    before = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    per = stored(per.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))), "slots")
    m = per.agg(F.sum("slots")).first()[0] or 0
    _, back = _coprime_step(m) if m else (0, 0)
    # a source's slots are made in chunks, dealt out before they are spelled out
    chunks = per.where("slots > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_CHUNK))))
    point = F.explode(F.sequence(F.col("chunk") * SLOT_CHUNK,
                                 F.least((F.col("chunk") + 1) * SLOT_CHUNK, F.col("slots")) - 1))
    slots = chunks.repartition("idx", "chunk").withColumn("k", point)
    # lattice point number i has the coordinate i * step mod m; the slot whose coordinate is rho has position rho / step
    position = F.pmod((F.col("first") + F.col("k")).cast("decimal(38,0)") * F.lit(back).cast("decimal(20,0)"),
                      F.lit(max(m, 1)).cast("decimal(20,0)")).cast("long")
    slots = slots.select("idx", "source_size", "passes", "blocks", "left", position.alias("position"),
                         F.lit(1).cast("long").alias("one"))
    ranked = prefix_scan(slots, ["idx"], ["position"], sums=["one"], prefix="rank_")
    rank = F.col("rank_one")
    no, block = F.floor(rank / F.col("blocks")).cast("long"), F.pmod(rank, F.col("blocks"))
    end = F.when(no >= F.col("passes"), F.col("left")).otherwise(F.col("source_size"))
    return ranked.select("position", "idx", no.alias("pass_no"), block.alias("block"), (block * b).alias("lo"),
                         F.least((block + 1) * b, end).alias("hi"))


def mix_sources(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                block_words: int = 1024, seed: str = "mix", weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """Words taken of every document: ``doc_id, size, source, source_size, target, taken``, one row per input row.

    ``size`` counts the words of the whole text (null: 0).  ``taken`` is what the scheduled blocks cover of the
    document, repeats counted: at most ``most`` times its size, and the sum over a source is its target rounded down
    to words.  A document without words has 0.  The order inside a source depends on the id and ``seed`` alone, so
    reruns agree; rows repeating an id lie next to each other.  Null sources are one source, the last.  An empty
    table gives no rows.
    """
    # one row per document, without its text
    sized = stored(documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    word_count(text_col).alias("size")), "sized")
    sources = stored(source_targets(sized, weights, share, most), "targets")
    docs = attach(sized, ["source"], sources.select("source", "idx", "source_size", "target"),
                  F.struct("doc_id", "size"))
    docs = docs.withColumn("order", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    laid = stored(prefix_scan(docs.where("size > 0"), ["idx"], ["order", "doc_id", "size"], sums=["size"], prefix="start_"),
                  "laid").withColumnRenamed("start_size", "start")
    slots = block_schedule(sources, block_words).select("idx", "block", "lo", "hi")
    end = F.col("start") + F.col("size")
    pieces = laid.select("doc_id", "idx", "start", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    overlap = F.greatest(F.least("end", "hi") - F.greatest("start", "lo"), F.lit(0))
    taken = (pieces.join(slots, ["idx", "block"]).groupBy("idx", "start").agg(F.sum(overlap).alias("got")))
    with_words = laid.join(taken, ["idx", "start"], "left").withColumn("taken", F.coalesce("got", F.lit(0)).cast("long"))
    cols = ["doc_id", "size", "source", "source_size", "target", "taken"]
    return with_words.select(*cols).unionByName(
        docs.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))
