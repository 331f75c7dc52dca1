"""Exact Jaccard join of word-shingle sets by a distributed token-group matrix.

A document is the set of its distinct 5-word shingles.  Documents link when their sets' Jaccard similarity reaches the
threshold; the result is the connected components of all links.

1. One scan counts shingles approximately and keeps the frequent ones; they order the shingles of every set: rare
   first (by hash), frequent last (by count).  The order only affects speed.
2. Documents with equal sets form one class.  Classes are partitioned into groups of similar ones: min-hash bands
   propose a central class for each group, verified links to the centres are contracted to components.
3. The token-group matrix holds, per group, the union of its members' leading shingles.  By the prefix principle two
   linked sets share at least l leading shingles, l growing with the set size, so groups whose unions overlap in
   fewer shingles cannot hold a link.  Only the qualifying pairs of groups are opened: there the full union of a block
   of members bounds each query's overlap before any set is compared.
4. Links found in opened groups join the groups; as only components matter, pairs inside a group are never compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import (
    agg_back,
    attach,
    components,
    discard,
    release_memory,
    shuffle_partitions,
    small_batches,
    stored,
    values,
)

WORDS = 5
THRESHOLD = (80, 100)  # link when 100 * intersection >= 80 * union
BANDS, ROWS = 4, 2
FREQUENT_LEAST = 8  # shingles counted in this many documents or more are frequent
FREQUENT_MOST = 1 << 19  # at most this many are kept (4 MB), the most frequent; the others are ordered by hash, results are the same
HUB_ROWS, QUERY_ROWS = 128, 256
BROADCAST_IDS = 500_000
COUNT_BLOCK = 1_000_000  # shingles a task holds while counting
CACHED_WORDS = 200_000

_MIX1, _MIX2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_BAND_MULT = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(1, BANDS * ROWS + 1)], np.uint64)


class _WordHash(dict):
    def __missing__(self, word):
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; all words as one shingle when there are fewer than 5."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i:len(w) - k + 1 + i]) * _STEP
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return np.unique(h ^ (h >> np.uint64(31)))


def fingerprint(t: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(t.tobytes(), 7) - (1 << 63)


def least_shared(n):
    """l: how many leading shingles linked sets must share, for the smaller set's size n."""
    return 1 + n // 40


def prefix_lengths(n: int) -> tuple[int, int]:
    """Leading shingles to index of a set of size n, as the smaller and as the larger of a linked pair.

    With overlap O >= t/(1+t) (n_x + n_y): the smaller set has O >= 2t/(1+t) n_x, the larger O >= t n_y, and the l-th
    common shingle stands at most at n - O + l.
    """
    a, b = THRESHOLD
    small = n - -(-2 * a * n // (a + b)) + least_shared(n)
    large = n - -(-a * n // b) + least_shared(n)
    return min(n, small), min(n, large)


def linked(common, n_x, n_y):
    a, b = THRESHOLD
    return b * common >= a * (n_x + n_y - common)


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles with counts, sorted by shingle; tasks drop what is rare within them (a lossy count)."""
    def count(batches):
        cache = _WordHash()
        tokens, counts, held, size, docs, floor = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0, 0, 1

        def merged():
            new, times = np.unique(np.concatenate(held), return_counts=True)
            every, weight = np.concatenate([tokens, new]), np.concatenate([counts, times])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            head = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
            return every[head], np.add.reduceat(weight, head) if len(head) else weight

        for b in batches:
            for text in values(b.column(0)):
                t = shingles(text, cache)
                docs += 1
                held.append(t)
                size += len(t)
                if size > COUNT_BLOCK:
                    tokens, counts = merged()
                    while True:  # what is rare so far goes; the floor rises when too much would stay
                        keep = counts > floor
                        tokens, counts = tokens[keep], counts[keep]
                        if len(tokens) <= COUNT_BLOCK:
                            break
                        floor += 1
                    held, size = [], 0
        if held:
            tokens, counts = merged()
        keep = counts >= max(2, docs // 16_384)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])],
                                         names=["token", "docs"])
        release_memory()

    top = (texts.mapInArrow(count, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))
           .where(F.col("docs") >= FREQUENT_LEAST).orderBy(F.col("docs").desc(), "token").limit(FREQUENT_MOST).toArrow())
    token, docs = top["token"].to_numpy().astype(np.int64).view(np.uint64), top["docs"].to_numpy()
    order = np.argsort(token)
    return token[order], docs[order]


def _sets(docs: DataFrame, frequent) -> DataFrame:
    """Per document: ``doc_id, n, fp, rare, sig, small, prefix`` (leading shingles; the first ``small`` of them short)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches):
        cache = _WordHash()
        heavy, weight = held.value
        for b in batches:
            n, fp, rare, small, sig, prefix = [], [], [], [], [], []
            for text in values(b.column(1)):
                t = shingles(text, cache)
                at = np.searchsorted(heavy, t)
                known = heavy[np.minimum(at, len(heavy) - 1)] == t if len(heavy) else np.zeros(len(t), bool)
                light, often = t[~known], t[known]
                short, length = prefix_lengths(len(t))
                if len(light) < length:
                    often = often[np.lexsort((often, weight[at[known]]))]
                    first = np.concatenate([light, often])[:length]
                else:
                    first = light[:length]
                n.append(len(t))
                fp.append(fingerprint(t))
                rare.append(len(light))
                small.append(short)
                sig.append((t[None, :] * _BAND_MULT[:, None]).min(1).view(np.int64) if len(t)
                           else np.zeros(len(_BAND_MULT), np.int64))
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(rare, pa.int64()),
                 pa.array(small, pa.int32()), pa.array(sig, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "n", "fp", "rare", "small", "sig", "prefix"])

    return docs.mapInArrow(scan, "doc_id long, n long, fp long, rare long, small int, sig array<long>, prefix array<long>")


def _verify(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) found in ``cells(hub, hb, qb, side, id, fp, grp)``: hub members (side 0) against queries (side 1).

    A cell holds at most HUB_ROWS members of one group and QUERY_ROWS queries.  The members' token union bounds a
    query's overlap; qualifying queries are counted against all members at once.  Per query group and cell one link
    is enough.
    """
    spark = cells.sparkSession
    ids = stored(cells.select(F.col("id").alias("doc_id")).distinct(), "jaccard-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    rows = cells.join(texts.withColumnRenamed("doc_id", "id"), "id").select("hub", "hb", "qb", "side", "id", "fp", "grp", "text")
    n = shuffle_partitions(spark)
    dealt = rows.repartition(n, "hub", "hb", "qb").sortWithinPartitions("hub", "hb", "qb", "side")

    def open_cells(batches):
        cache, key = _WordHash(), None
        members, union, owner, start, sizes, found = [], None, None, None, None, set()
        for b in batches:
            out_a, out_b = [], []
            for hub, hb, qb, side, doc, fp, grp, text in zip(*map(values, b.columns), strict=True):
                if (hub, hb, qb) != key:
                    key, members, union, found = (hub, hb, qb), [], None, set()
                t = shingles(text, cache)
                if fingerprint(t) != fp:  # another text under a repeated id
                    continue
                if side == 0:
                    members.append((doc, t))
                    continue
                if not members or grp in found:
                    continue
                if union is None:
                    every = np.concatenate([m for _, m in members])
                    sizes = np.array([len(m) for _, m in members])
                    who = np.repeat(np.arange(len(members)), sizes)
                    order = np.argsort(every, kind="stable")
                    every, owner = every[order], who[order]
                    union, start = np.unique(every, return_index=True)
                    start = np.append(start, len(every))
                at = np.searchsorted(union, t)
                at = at[union[np.minimum(at, len(union) - 1)] == t]
                if THRESHOLD[1] * len(at) < THRESHOLD[0] * len(t):
                    continue  # even the whole union covers too little of the query
                count = start[at + 1] - start[at]
                hits = np.repeat(start[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                common = np.bincount(owner[hits], minlength=len(members))
                good = np.nonzero(linked(common, len(t), sizes))[0]
                good = [i for i in good if members[i][0] != doc]
                if good:
                    found.add(grp)
                    out_a.append(members[good[0]][0])
                    out_b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(open_cells, "a long, b long")


def _similar_groups(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links from every class to the central class of its min-hash buckets (the one with fewest rare shingles)."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.get("sig", F.lit(i * ROWS)).alias("k1"),
                               F.get("sig", F.lit(i * ROWS + 1)).alias("k2")) for i in range(BANDS)])
    keyed = classes.select("rep", "n", "fp", "rare", "sig", F.inline(bands))
    centre = F.struct("rare", F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("fp").alias("hub_fp"),
                      F.col("sig").alias("hub_sig"))
    near = agg_back(keyed, ["band", "k1", "k2"], {"c": ("min", centre)}, F.col("rep"))
    alike = F.size(F.filter(F.zip_with("sig", "c.hub_sig", lambda x, y: x == y), lambda e: e))
    a, b = THRESHOLD
    sizes = (F.col("n") * b >= F.col("c.hub_n") * a) & (F.col("c.hub_n") * b >= F.col("n") * a)
    edges = near.where(F.col("rep") != F.col("c.hub")).where(sizes & (alike >= BANDS * ROWS // 2)).select(
        "c.hub", "c.hub_fp", "rep", "fp").distinct()
    # the queries of a centre are cut into blocks; the centre's text goes to each block once
    block = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.ceil(F.col("many") / QUERY_ROWS))).cast("int")
    edges = stored(agg_back(edges.withColumn("one", F.lit(1).cast("long")), ["hub"], {"many": ("sum", F.col("one"))},
                            F.col("rep")).withColumn("qb", block), "jaccard-stars")
    hubs = edges.select("hub", F.lit(0).alias("hb"), "qb", F.lit(0).alias("side"), F.col("hub").alias("id"),
                        F.col("hub_fp").alias("fp"), F.col("hub").alias("grp")).distinct()
    queries = edges.select("hub", F.lit(0).alias("hb"), "qb", F.lit(1).alias("side"), F.col("rep").alias("id"), "fp",
                           F.col("rep").alias("grp"))
    return stored(_verify(hubs.unionByName(queries), docs), "jaccard-links1")


def _qualifying(grouped: DataFrame) -> DataFrame:
    """Pairs of groups (g, h) whose token unions overlap enough to hold a link."""
    leading = F.posexplode("prefix")
    # shingles that stand in the unions of two groups or more
    tokens = grouped.select("grp", F.explode("prefix").alias("token")).groupBy("token").agg(
        F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token")
    tokens = stored(tokens, "jaccard-tokens")
    few = tokens.count() <= 4 * BROADCAST_IDS
    every = grouped.select("grp", "n", "small", leading.alias("pos", "token"))
    shared = every.join(F.broadcast(tokens) if few else tokens, "token", "left_semi")
    as_small, left = F.col("pos") < F.col("small"), F.col("n") - F.col("pos")
    matrix = stored(shared.groupBy("token", "grp").agg(
        F.min(F.when(as_small, F.col("n"))).alias("s_min"), F.max(F.when(as_small, F.col("n"))).alias("s_max"),
        F.max(F.when(as_small, left)).alias("s_left"), F.min("n").alias("l_min"), F.max("n").alias("l_max"),
        F.max(left).alias("l_left")), "jaccard-matrix")
    a, b = THRESHOLD
    x, y = matrix.where("s_min is not null").alias("x"), matrix.alias("y")
    # the shingles from this one on must leave room for the overlap a link of these sizes needs, less l; room falls by
    # one where l rises, so the smallest overlap goes with the largest l of the group
    room = F.ceil(a * (F.col("x.s_min") + F.col("y.l_min")) / (a + b)) - least_shared(0) - F.floor(F.col("x.s_max") / 40)
    both = x.join(y, F.col("x.token") == F.col("y.token")).where(
        (F.col("x.grp") != F.col("y.grp")) & (F.col("x.s_min") <= F.col("y.l_max"))
        & (F.col("x.s_max") * b >= F.col("y.l_min") * a) & (F.col("x.s_left") > room) & (F.col("y.l_left") > room))
    count = both.groupBy(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).agg(
        F.count(F.lit(1)).alias("common"), F.min("x.s_min").alias("least"))
    open_ = count.where(F.col("common") >= least_shared(0) + F.floor(F.col("least") / 40))
    return open_.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()


def _opened(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Cells that compare the smaller group of every pair with the larger one, block by block."""
    members = grouped.select("grp", "rep", "fp")
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    g = pairs.join(size.select(F.col("grp").alias("g"), F.col("size").alias("g_size")), "g")
    both = g.join(size.select(F.col("grp").alias("h"), F.col("size").alias("h_size")), "h")
    larger = F.col("g_size") >= F.col("h_size")
    told = both.select(F.when(larger, F.col("g")).otherwise(F.col("h")).alias("hub"),
                       F.when(larger, F.col("h")).otherwise(F.col("g")).alias("grp"))
    queries = told.join(members, "grp").select("hub", F.col("rep").alias("id"), "fp", "grp", F.lit(1).cast("long").alias("one"))
    queries = agg_back(queries, ["hub"], {"many": ("sum", F.col("one"))}, F.col("id"))
    hub_size = size.select(F.col("grp").alias("hub"), "size")
    queries = stored(attach(queries.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("many") / QUERY_ROWS)).cast("int"))
                            .drop("one", "many"), ["hub"], hub_size, F.col("id")), "jaccard-queries")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / HUB_ROWS)).cast("int")
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    q = queries.select("hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("hb"), deal("id", F.col("blocks")).alias("qb"),
                       F.lit(1).alias("side"), "id", "fp", "grp")
    hubs = queries.select("hub", "blocks", "size").distinct()
    m = members.withColumnRenamed("grp", "hub").join(hubs, "hub").select(
        "hub", deal("rep", parts).alias("hb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"),
        F.lit(0).alias("side"), F.col("rep").alias("id"), "fp", F.col("hub").alias("grp"))
    return m.unionByName(q)


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, n_shingles, component_id`` (smallest id reachable by links, itself included).

    Sets: distinct 5-word shingles of the whole text, lower-cased in A-Z, words split at ASCII white space; fewer
    words count as one shingle; null and empty texts have the empty set and link with nothing.  Links need
    100 * intersection >= 80 * union.  Rows without an id take no part and have a null component; rows repeating an
    id count as one vertex.  An empty table gives no rows.  Shingles are compared by 64-bit hashes, equal sets by
    size and a 64-bit fingerprint.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    frequent = _frequent(docs.select("text"))
    sets = stored(_sets(docs, frequent), "jaccard-sets")
    # documents with equal sets are one class, represented by the smallest id
    small = stored(sets.select("doc_id", "n", "fp"), "jaccard-documents")
    full = small.where("doc_id is not null and n > 0")
    reps = stored(full.groupBy("n", "fp").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    of_reps = sets.where("doc_id is not null and n > 0").join(
        reps.select(F.col("n").alias("c_n"), F.col("fp").alias("c_fp"), "rep"),
        (F.col("doc_id") == F.col("rep")) & (F.col("fp") == F.col("c_fp")) & (F.col("n") == F.col("c_n")))
    classes = stored(of_reps.select("rep", "n", "fp", "rare", "small", "sig", "prefix").dropDuplicates(["rep", "fp"]),
                     "jaccard-reps")
    discard(sets)
    first = _similar_groups(classes.drop("prefix", "small"), docs)
    groups = stored(components(first), "jaccard-groups").withColumnRenamed("v", "rep")
    grouped = classes.select("rep", "n", "fp", "small", "prefix").join(groups, "rep", "left").withColumn(
        "grp", F.coalesce("root", "rep")).drop("root")
    grouped = stored(grouped, "jaccard-grouped")
    discard(classes)
    pairs = stored(_qualifying(grouped), "jaccard-pairs")
    second = stored(_verify(_opened(pairs, grouped), docs), "jaccard-links2")
    discard(grouped, pairs)
    # texts of one id in several classes make them one vertex already; copies of a class share its component
    roots = components(first.unionByName(second).unionByName(
        small.where("doc_id is not null and n > 0").groupBy("doc_id").agg(
            F.countDistinct("n", "fp").alias("k")).where("k > 1").select("doc_id").join(full, "doc_id")
        .join(reps, ["n", "fp"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    named = reps.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select(
        "n", "fp", F.coalesce("root", "rep").alias("component_id"))
    out = attach(full, ["n", "fp"], named, F.col("doc_id")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = small.where("doc_id is null or n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)
