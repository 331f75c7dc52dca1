"""Filter interaction audit: five text filters in every order, counted by an incremental, retracting stream.

All files of the table run through Structured Streaming as available-now micro-batches of ``files_per_batch`` files.
One pass over a batch's texts gives every document its failure mask (filters A to D) and the key of its text.  Filter E
fails where a smaller id has the same text, which a micro-batch alone cannot know: keyed state holds, for every text,
the smallest id so far and the rows that carry it.  A document with a larger id counts as failing E at once; when a
smaller id arrives, the rows held so far are retracted from their part's counters and counted again as failing E.
The sink gathers counter changes (part, mask, flags, n); their sum is the audit's whole input, at most 128 rows a part.

Copies are reduced before the shuffle: of each Arrow batch only the rows with a text's smallest id go on to the state,
the others are counted where they are.  State is kept in pages of about ``PAGE_BYTES`` of input, so a page holds few
texts at any size of the table.  Stream, state and sink live in the shared folder; a batch that dies with its executor
is run again from there.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import release_memory, small_batches, stored, values
from ledgerlens.sources.io import fresh_dir

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
GOOD, TOXIC = 1, 2
PAGE_BYTES = 1 << 16
_UPPER, _CONTINUED, _ODD = bytes(range(65, 91)), bytes(range(128, 192)), b"#$%&*|"
_COUNT = "part string, mask int, flags int, n long"
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk ahead of need
}


def text_mask(text: bytes) -> int:
    """Which of the filters A to D the text fails, as bits."""
    words = text.split()  # bytes: exactly the ASCII white space of the word rule
    upper = len(text) - len(text.translate(None, _UPPER))
    return (A * (len(words) < 100) | B * (100 * len(set(words)) < 80 * len(words))
            | C * (100 * upper > 10 * len(text.translate(None, _CONTINUED)))
            | D * (len(text.translate(None, _ODD)) < len(text)))


def _marks(pages: int):
    def mark(batches):
        for b in batches:
            masks, keys, page = [], [], []
            for text in values(b.column("text")):
                text = text or b""
                key = hashlib.sha256(text).digest()[:16]
                masks.append(text_mask(text))
                keys.append(key)
                page.append(int.from_bytes(key[:7], "big") % pages)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(page, pa.int64()), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())],
                names=["doc_id", "part", "page", "key", "mask"])
        release_memory()
    return mark


def _combine(batches):
    """Of every text's rows in an Arrow batch those with the smallest id, with their number; the others, and rows
    without an id, as plain counts (no key)."""
    for b in batches:
        least: dict[bytes, list] = {}
        done: Counter = Counter()
        for i, part, page, key, mask, flags in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if i is None:
                done[page, part, mask, flags] += 1
                continue
            held = least.get(key)
            if held is None:
                least[key] = [i, page, mask, Counter({(part, flags): 1})]
            elif i == held[0]:
                held[3][part, flags] += 1
            elif i > held[0]:
                done[page, part, mask | E, flags] += 1
            else:
                for (p, f), n in held[3].items():
                    done[page, p, mask | E, f] += n
                held[0], held[3] = i, Counter({(part, flags): 1})
        rows = [(page, key, i, part, mask, flags, n) for key, (i, page, mask, c) in least.items() for (part, flags), n in c.items()]
        rows += [(page, None, None, part, mask, flags, n) for (page, part, mask, flags), n in done.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r, strict=True)) for r in rows], schema=_SENT)


_SENT = pa.schema([("page", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()),
                   ("mask", pa.int32()), ("flags", pa.int32()), ("n", pa.int64())])


def _retract(page, frames, state):
    """Update a page's texts by a batch's rows; yields the changes of the part counters.

    State: key -> [smallest id, [[part, flags, rows that carry it], ...]] as JSON.
    """
    import pandas as pd

    texts = json.loads(state.get[0]) if state.exists else {}
    change: Counter = Counter()
    touched = False
    for frame in frames:
        for key, i, part, mask, flags, n in zip(*(frame[c].tolist() for c in ("key", "doc_id", "part", "mask", "flags", "n")), strict=True):
            if key is None:
                change[part, mask, flags] += n
                continue
            i, key, touched = int(i), bytes(key).hex(), True
            held = texts.get(key)
            if held is None or i < held[0]:
                for p, f, m in held[1] if held else ():
                    change[p, mask, f] -= m
                    change[p, mask | E, f] += m
                texts[key] = [i, [[part, flags, n]]]
                change[part, mask, flags] += n
            elif i == held[0]:
                held[1].append([part, flags, n])
                change[part, mask, flags] += n
            else:
                change[part, mask | E, flags] += n
    if touched:
        state.update((json.dumps(texts, separators=(",", ":")),))
    rows = [(*k, n) for k, n in change.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "flags", "n"])


def _add_up(batches):
    total: Counter = Counter()
    for b in batches:
        for part, mask, flags, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[part, mask, flags] += n
    rows = [(*k, n) for k, n in total.items() if n]
    names = ["part", "mask", "flags", "n"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=names)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _streamable(spark: SparkSession, path: str) -> str:
    """A stream source must be a folder or a pattern; a table that is one file becomes a pattern that only it matches."""
    fs, p = _folder(spark, path)
    return f"{path[:-1]}[{path[-1]}]" if fs.getFileStatus(p).isFile() else path


def count_masks(spark: SparkSession, path: str, labels: DataFrame, part: Column, files_per_batch: int | None = None,
                page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(part, mask, flags, n): the documents of the Parquet table at ``path`` by part, failed filters and labels.

    ``part`` is a column expression over the table (null: empty string).  ``labels(doc_id, quality, toxic)`` may repeat
    or lack ids; a label counts when any row of the id has it.  A null text is empty.  A document without an id is
    never a copy of a smaller one, nor makes copies.  Repeated rows each count; equal ids with one text are no copies
    of each other.  ``files_per_batch`` defaults to the session's default parallelism: one wave of tasks a batch.
    """
    small_batches(spark)
    whole = spark.read.parquet(path)
    size = int(str(whole._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("flags"))
    marked = marked.select(F.col("doc_id").alias("_id"), F.lit(0).alias("_spread"), "flags")

    stream = (spark.readStream.schema(whole.schema).option("maxFileAge", "36500d")
              .option("maxFilesPerTrigger", files_per_batch or spark.sparkContext.defaultParallelism)
              .parquet(_streamable(spark, path)))
    docs = stream.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    docs = docs.mapInArrow(_marks(max(1, size // page_bytes)), "doc_id long, part string, page long, key binary, mask int")
    spread = F.when(F.col("doc_id").isNull(), F.col("page")).otherwise(F.lit(0))  # rows without an id are many keys
    docs = docs.join(marked, (F.col("doc_id") == F.col("_id")) & (spread == F.col("_spread")), "left").select(
        "doc_id", "part", "page", "key", "mask", F.coalesce("flags", F.lit(0)).alias("flags"))
    sent = docs.mapInArrow(_combine, "page long, key binary, doc_id long, part string, mask int, flags int, n long")
    change = sent.groupBy("page").applyInPandasWithState(_retract, _COUNT, "texts string", "append", "NoTimeout")

    folder = fresh_dir(spark, "llm-filter-audit")
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        run = (change.mapInArrow(_add_up, _COUNT).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
               .outputMode("append").trigger(availableNow=True).start(f"{folder}/changes"))
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    total = spark.read.schema(_COUNT).parquet(f"{folder}/changes").groupBy("part", "mask", "flags").agg(F.sum("n").alias("n"))
    total = stored(total.where("n <> 0"), "filter-counts")
    fs, made = _folder(spark, folder)
    fs.delete(made, True)
    return total


def audit(counts: DataFrame) -> DataFrame:
    """Every order of the five filters, step by step, from the counters of ``count_masks``.

    One row per (part, filter_order, step).  ``shapley`` is the number of documents the step's filter removes, summed
    over all orders: a document failing m filters falls to each of them in 120 / m orders.
    """
    bit = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    steps = [{"filter_order": "".join(o), "step": k + 1, "own": bit[x], "earlier": sum(bit[y] for y in o[:k])}
             for o in itertools.permutations(FILTERS) for k, x in enumerate(o)]
    step = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,earlier:int>>"))
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "flags", "n")).alias("counts")).withColumn("s", step)
    own, earlier = F.col("s.own"), F.col("s.earlier")

    def total(cond, times=lambda c: F.lit(1)):
        return F.aggregate(F.filter("counts", cond), F.lit(0).cast("long"), lambda acc, c: acc + c["n"] * times(c))

    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    here = lambda c: fails(c) & (c["mask"].bitwiseAND(earlier) == 0)
    share = lambda c: (F.lit(120) / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part", "s.filter_order", "s.step",
        total(lambda c: c["mask"].bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"), total(here).alias("removed"),
        total(lambda c: fails(c) & (c["mask"].bitwiseAND(earlier) != 0)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(lambda c: here(c) & (c["flags"].bitwiseAND(F.lit(GOOD)) != 0)).alias("good_lost"),
        total(lambda c: here(c) & (c["flags"].bitwiseAND(F.lit(TOXIC)) != 0)).alias("toxic_lost"),
        total(fails, share).alias("shapley"))
