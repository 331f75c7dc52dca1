"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern.  Their hashes are counted over the corpus by distinct repositories and owners: a value
that many owners hold is a copied example, one that a single owner holds and that looks random is treated as live.
Loose tokens (kind ``blob``) only become findings when ownership says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, stored

KINDS = ("assign", "access", "hex", "blob")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The whole run is taken, so the least length can stand in the pattern; possessive, as shorter matches never count.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
BLOB = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx"

_HIT = "array<struct<kind:int,no:int,gap:int,size:int,value:string>>"


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of (kind, number, characters since the match before, length, value) of all leftmost non-overlapping matches.

    The text between matches comes from splitting at the same pattern; ``located`` adds the lengths up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # zipped, as an array that a lambda names is built again for each element; the last gap has no match
    pairs = F.zip_with(gaps, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    hits = F.transform(pairs, lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("no"), p["gap"].alias("gap"), F.length(p["hit"]).alias("size"),
        (p["hit"] if group == 0 else F.regexp_extract(p["hit"], pattern, group)).alias("value")))
    return F.filter(hits, lambda x: x["value"].isNotNull())


def candidates(text: Column) -> Column:
    """All matches of a text, kind by kind."""
    none = F.array().cast(_HIT)
    assign = F.when(text.rlike(ASSIGN), matches(text, ASSIGN, 0, 2))
    access = F.when(text.contains("AKIA"), matches(text, ACCESS, 1))
    hexes = F.when(text.rlike(HEX), matches(text, HEX, 2))
    blob = F.when(text.rlike("[0-9]") & text.rlike(BLOB), matches(text, BLOB, 3))
    return F.concat(*[F.coalesce(x, none) for x in (assign, access, hexes, blob)])


def located(hits: DataFrame) -> DataFrame:
    """Candidates with ``start`` and ``end`` (code points, end exclusive) from the hits of each (row, kind), a row each.

    Running lengths by a window over one text's matches of one kind.  Assignments of values under 8 characters and
    blobs without a digit and a letter are no candidates.
    """
    upto = Window.partitionBy("row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    placed = hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    kind, value = F.col("kind"), F.col("value")
    return placed.where(((kind != 0) | (F.length(value) >= 8)) & ((kind != 3) | (value.rlike("[0-9]") & value.rlike("[A-Za-z]")))).drop("no", "gap", "size")


def ownership(found: DataFrame, example_owners: int) -> DataFrame:
    """``hash, verdict`` from ``found(hash, repo, owner, value_random)``: example, shared or live."""
    holders = stored(found.groupBy("hash", "repo", "owner").agg(F.max("random").alias("random")), "secret-holders")
    per = holders.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"),
                                      F.max("random").alias("random"))
    verdict = (F.when(F.col("owners") >= example_owners, "example")
               .when((F.col("owners") <= 1) & (F.col("repos") <= 1) & F.col("random"), "live").otherwise("shared"))
    return per.select("hash", "owners", "repos", verdict.alias("verdict"))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None,
                 owner: Column | None = None, example_owners: int = 3) -> DataFrame:
    """Per input row: ``doc_id`` and ``spans``, array of (start, kind, end, verdict) by start, then kind.

    Kinds 0 to 2 (assign, access, hex) are always reported; kind 3 (blob: a run of 20 or more credential characters
    with letters and digits) only where its verdict is live.  A value is an ``example`` from ``example_owners``
    distinct owners on, ``live`` when one repository of one owner holds it and it looks random (8 distinct
    characters, no placeholder word), else ``shared``.  Null owners and repositories count as one more each.  Null
    and empty texts have no spans; repeated rows give a row each; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    null_safe = lambda c: F.coalesce(c.cast("string"), F.lit("\x00null"))
    rows = stored(documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        null_safe(F.lit(None) if repo is None else repo).alias("repo"),
        null_safe(F.lit(None) if owner is None else owner).alias("owner"), candidates(text).alias("found")), "secrets")
    one = located(rows.where(F.size("found") > 0).select("row", "repo", "owner", F.inline("found")))
    looks_random = (F.size(F.array_distinct(F.split("value", ""))) >= 8) & ~F.col("value").rlike(PLACEHOLDER)
    one = stored(one.select("row", "repo", "owner", "kind", "start", "end", F.sha2("value", 256).alias("hash"), looks_random.alias("random")),
                 "secret-candidates")
    judged = attach(one, ["hash"], ownership(one, example_owners).select("hash", "verdict"), F.col("row"))
    judged = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("spans"))
    with_any = rows.where(F.size("found") > 0).select("row", "doc_id").join(spans, "row", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,verdict:string>>")
    return (with_any.select("doc_id", F.coalesce("spans", empty).alias("spans"))
            .unionByName(rows.where(F.size("found") == 0).select("doc_id", empty.alias("spans"))))


def span_text(spans) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
