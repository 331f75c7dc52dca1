"""One whole-table query per operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op1_exact_topk_search", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.topk_search import quantise, topk_search

    vectors = quantise(table(spark, sf_dir, "embeddings"))
    return topk_search(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id
"""


@query("op5_embedding_near_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, upper(sha1(h)) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM d),
b AS (SELECT *, list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * j)) & 31) + 1 AS INTEGER), 1)),
        lambda x, y: x || y)), lambda x, y: x || y) AS digest FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""


@query("op3_warc", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.warc import archive_folder, read_warc, write_warc

    folder = archive_folder(spark)
    index = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx
  FROM d GROUP BY source),
w AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
t AS (SELECT CAST(sum(source_size) AS HUGEINT) AS total FROM w),
-- the sources that stop at twice their size are those with the smallest size per weight; k is how many
k AS (
  SELECT *, coalesce(sum(2 * source_size) OVER x, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER x, 0) AS open
  FROM w WINDOW x AS (ORDER BY source_size / CAST(weight AS DOUBLE), idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT 3 * (SELECT total FROM t) - 2 * capped AS num, 2 * open AS den FROM k
  WHERE weight * (3 * (SELECT total FROM t) - 2 * capped) <= CAST(2 * source_size AS HUGEINT) * 2 * open
  ORDER BY source_size / CAST(weight AS DOUBLE), idx LIMIT 1),
g AS (
  SELECT w.*, CASE WHEN weight * num > CAST(2 * source_size AS HUGEINT) * den THEN CAST(2 * source_size AS DOUBLE)
                   ELSE CAST(weight AS DOUBLE) * CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM w, l),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS take,
         CAST(sum(d.size) OVER (PARTITION BY g.idx ORDER BY d.o, d.doc_id, d.size) - d.size AS BIGINT) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (take // source_size)
            + greatest(0, least(size, take % source_size - start)) END AS BIGINT) AS taken
FROM p
"""


@query("op8_mix_sources", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.source_mix import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.language_id import fit, held_out, predict

    documents = table(spark, sf_dir, "documents")
    model = fit(documents, trainable=~held_out())
    return predict(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.pii import KINDS, find_pii, span_text

    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.withColumn("base", base).select(
        F.col("carried.doc_id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


_OP9_KIND = """
  SELECT doc_id, repo, owner, {k} AS kind, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
    's': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) AS INTEGER)
       + CAST(coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INTEGER),
    'n': CAST(length(h[i]) AS INTEGER), 'v': {v}}})) AS m
  FROM (SELECT doc_id, repo, owner, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h FROM d)
"""
_ASSIGN_RE2 = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source || '/' || lang AS repo, source AS owner FROM documents),
c AS (
  {_OP9_KIND.format(k=0, p=_ASSIGN_RE2, v=f"regexp_extract(h[i], '{_ASSIGN_RE2}', 2)")}
  UNION ALL {_OP9_KIND.format(k=1, p="AKIA[A-Z0-9]{12,}", v="h[i]")}
  UNION ALL {_OP9_KIND.format(k=2, p="[0-9a-f]{32,}", v="h[i]")}
  UNION ALL {_OP9_KIND.format(k=3, p="[A-Za-z0-9+/_=-]{20,}", v="h[i]")}),
f AS (
  SELECT doc_id, coalesce(repo, chr(0) || 'null') AS repo, coalesce(owner, chr(0) || 'null') AS owner, kind, m.s AS s,
         m.s + m.n AS e, m.v AS v FROM c
  WHERE CASE kind WHEN 0 THEN length(m.v) >= 8
        WHEN 3 THEN regexp_matches(m.v, '[0-9]') AND regexp_matches(m.v, '[A-Za-z]') ELSE true END),
o AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos,
         len(list_distinct(string_split(v, ''))) >= 8
           AND NOT regexp_matches(v, '(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx') AS random
  FROM f GROUP BY v),
j AS (
  SELECT f.*, CASE WHEN owners >= 3 THEN 'example' WHEN owners <= 1 AND repos <= 1 AND random THEN 'live' ELSE 'shared' END AS verdict,
         CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'blob' END || ':' || s || ':' || e AS txt
  FROM f JOIN o ON f.v = o.v),
k AS (SELECT * FROM j WHERE kind < 3 OR verdict = 'live'),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (verdict = 'live') AS n_live,
         count(*) FILTER (verdict = 'example') AS n_example,
         sha256(coalesce(string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
         string_agg(txt, ',' ORDER BY s, kind) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


@query("op9_secret_scan", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.secret_scan import KINDS, scan_secrets, span_text

    # a repository is one source's documents in one language, its owner the source
    found = scan_secrets(table(spark, sf_dir, "documents"), repo=F.concat("source", F.lit("/"), "lang"), owner=F.col("source"))
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    kind = lambda i: count(lambda s: s["kind"] == i)
    return found.select(
        "doc_id", *[kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def _op6_sql() -> str:
    from ledgerlens.llm.license_scan import ANCHOR, BLOCKS, TEMPLATES, TERM

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    blocks = ", ".join(f"array_to_string(lines[greatest(1, i - {b}):i + {n - 1 - b}], chr(10))" for b, n in BLOCKS)
    values = ", ".join(f"({i}, {quote(k)}, {quote(t)})" for i, (k, t) in enumerate(TEMPLATES))
    return f"""
WITH f AS (
  SELECT doc_id, text, concat_ws('/', source, lang, array_to_string(string_split(CAST(doc_id AS VARCHAR), ''), '/')) AS path,
         string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
r AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, coalesce(regexp_matches(lines[-1], '{ANCHOR}'), false) AS declares FROM f),
t AS (SELECT v.i AS template, v.k AS licence, unnest(regexp_extract_all(lower(v.x), '{TERM}')) AS term
      FROM (VALUES {values}) v(i, k, x)),
tt AS (SELECT template, licence, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM f) WHERE term IN (SELECT term FROM tt) GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT tt.*, ln((1.0 + n.n) / (1.0 + coalesce(df.df, 0))) + 1.0 AS idf FROM tt LEFT JOIN df USING (term), n),
tn AS (SELECT template, licence, sqrt(sum(tf * idf * tf * idf)) AS t_norm FROM w GROUP BY ALL),
s AS (SELECT doc_id, lines, unnest(list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '{ANCHOR}'))) AS i FROM r),
p AS (SELECT doc_id, unnest([lines[i], {blocks}]) AS passage FROM s),
q AS (SELECT DISTINCT doc_id, passage FROM p),
u AS (SELECT doc_id, passage, unnest(regexp_extract_all(lower(passage), '{TERM}')) AS term FROM q),
x AS (SELECT doc_id, passage, u.term, count(*) AS tf FROM u GROUP BY ALL),
i AS (SELECT DISTINCT term, idf FROM w),
y AS (SELECT x.*, tf * coalesce(i.idf, ln(1.0 + n.n) + 1.0) AS wp FROM x LEFT JOIN i USING (term), n),
pn AS (SELECT doc_id, passage, sqrt(sum(wp * wp)) AS p_norm FROM y GROUP BY ALL),
c AS (SELECT y.doc_id, y.passage, w.template, sum(y.wp * w.tf * w.idf) AS dot FROM y JOIN w USING (term) GROUP BY ALL),
z AS (SELECT c.doc_id, tn.licence, round(dot / (p_norm * t_norm), 9) AS cosine
      FROM c JOIN pn USING (doc_id, passage) JOIN tn USING (template)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) AS k FROM z) WHERE k = 1 AND cosine >= 0.75),
o AS (SELECT r.doc_id, r.path, r.dir, r.declares, b.licence, b.cosine FROM r LEFT JOIN b USING (doc_id)),
d AS (SELECT * FROM (SELECT dir, licence, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) AS k
      FROM o WHERE declares AND licence IS NOT NULL) WHERE k = 1),
h AS (SELECT * FROM (
  SELECT o.doc_id, d.dir, d.licence, row_number() OVER (PARTITION BY o.doc_id ORDER BY length(d.dir) DESC) AS k
  FROM o JOIN d ON o.dir = d.dir OR starts_with(o.dir, d.dir || '/') WHERE o.licence IS NULL) WHERE k = 1)
SELECT o.doc_id, o.path, coalesce(o.licence, h.licence) AS licence, round(o.cosine, 6) AS cosine,
       CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN h.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       h.dir AS declared_in
FROM o LEFT JOIN h USING (doc_id)
"""


@query("op6_license_scan", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.license_scan import ANCHOR, scan_licences

    # documents as files: source / language / digits of the id; one that closes with a notice declares for its directory
    path = F.concat_ws("/", "source", "lang", F.array_join(F.split(F.col("doc_id").cast("string"), ""), "/"))
    last = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n", -1), -1)
    found = scan_licences(table(spark, sf_dir, "documents"), path, licence_file=last.rlike(ANCHOR), carry=("doc_id",))
    return found.select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "origin", "declared_in")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '),
         lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY s)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM c LEFT JOIN n USING (doc_id)
"""


@query("op10_ngram_jaccard_join", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op4_piece_sampling")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.piece_sampling import encode_samples

    return encode_samples(table(spark, sf_dir, "documents"), k=2)


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS role_chars,
         length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS text_chars,
         coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), true) AS opens FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN opens THEN 9 + role_chars + 7 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op12_chat_format", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.chat_format import conversations, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], rows.schema)
    whole = conversations(format_conversations(rows.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(words) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS INTEGER)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false) AS INTEGER) AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS own),
o AS (SELECT letter AS filter_order, 1 AS step, letter, own, 0 AS earlier FROM f
      UNION ALL SELECT o.filter_order || f.letter, o.step + 1, f.letter, f.own, o.earlier + o.own FROM o JOIN f ON NOT contains(o.filter_order, f.letter)),
s AS (SELECT w.filter_order, p.step, p.own, p.earlier FROM o w JOIN o p ON w.step = 5 AND p.filter_order = left(w.filter_order, p.step)),
g AS (SELECT part, own, sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0) AS shapley FROM s, c GROUP BY part, own)
SELECT c.part, s.filter_order, s.step,
       CAST(coalesce(sum(n) FILTER (mask & (s.own | earlier) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & s.own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & s.own <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = s.own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(n) FILTER (mask & s.own <> 0 AND mask & earlier = 0 AND good = 1), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(n) FILTER (mask & s.own <> 0 AND mask & earlier = 0 AND toxic = 1), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(any_value(g.shapley), 0) AS BIGINT) AS shapley
FROM s, c JOIN g ON g.part = c.part WHERE g.own = s.own GROUP BY c.part, s.filter_order, s.step
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.filter_audit import audit, count_masks

    return audit(count_masks(spark, f"{sf_dir.rstrip('/')}/documents.parquet", table(spark, sf_dir, "labels"), part=F.col("lang")))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM w, range(1, 6) r(m) WHERE len(w) >= m),
f AS (SELECT lang, m, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 100),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.m, k.g, k.a, k.k, x.a AS l, y.a AS r, n.n,
         CAST(CAST(1000 AS HUGEINT) * k.a * n.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM k JOIN n ON n.lang = k.lang JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.g = k.g[1:k.k]
  JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.g = k.g[k.k + 1:]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, m, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
z AS (SELECT DISTINCT b.lang, b.m, b.g FROM b JOIN c ON c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 100 * b.a
      AND list_contains(list_transform(range(1, c.m - b.m + 2), lambda i: c.g[i:i + b.m - 1]), b.g)),
q AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score FROM b ANTI JOIN z USING (lang, m, g))
SELECT * FROM (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
                      phrase, a, l, r, n, score FROM q) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))
