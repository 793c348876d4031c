"""The registered queries of this package: thin digests of the operators over whole tables, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactflow.llm import (
    decontamination,
    exact_dedup,
    html_extract,
    language_id,
    line_dedup,
    merkle,
    packing,
    perplexity,
    quality_rules,
    shallot,
    simhash,
    toxicity,
    warc_index,
)
from contactflow.llm.common import table

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql:
            ORACLE[name] = sql.strip()
        return plan
    return add


#: Words and lines as the quality rules and line dedup see them, in DuckDB's SQL.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL_BLANK = r"regexp_matches({}, '^[\x20\x09-\x0D]*$')"


@query("op1_quality_rules", rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {SQL_WORDS} AS w FROM documents),
n AS (SELECT *, len(w) AS n_words, list_sum([length(x) for x in w]) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        [x for x in string_split(text, chr(10)) if NOT {SQL_BLANK.format('x')}] AS l FROM d),
win AS (SELECT doc_id, k, w[k] || ' ' || w[k+1] || ' ' || w[k+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
twice AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
norm AS (SELECT doc_id, source, list_distinct([trim(x, ' ') for x in string_split(regexp_replace(regexp_replace(lower(text),
        '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)) if trim(x, ' ') <> '']) AS l FROM d),
lines AS (SELECT doc_id, source, list_sort([{{'n': length(x), 'x': x}} for x in l])[-1].x AS copy, unnest(l) AS line FROM norm),
hosts AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (SELECT source, line FROM lines JOIN hosts USING (source) GROUP BY source, line, total
        HAVING count(DISTINCT copy) > {quality_rules.MIN_DOCS} AND count(DISTINCT copy) > {quality_rules.HOST_SHARE} * total),
lost AS (SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n, sum(CASE WHEN bad.line IS NULL THEN 0 ELSE len(string_split(l.line, ' ')) END) AS lost
        FROM lines l LEFT JOIN bad ON l.source = bad.source AND l.line = bad.line GROUP BY l.doc_id),
m AS (SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(n.l) - len(list_distinct(n.l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(lost.lost, 0) > 0 AND lost.n - lost.lost < {quality_rules.MIN_LEFT} * lost.n AS depleted
      FROM n LEFT JOIN rep ON rep.doc_id = n.doc_id LEFT JOIN lost ON lost.doc_id = n.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(depleted, false) AS kept FROM m
""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select(*packing.COLUMNS[:-1])


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op10_line_dedup", rf"""
WITH l AS (SELECT doc_id, p, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)),
f AS (SELECT doc_id, p, x, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2
      FROM l WHERE NOT {SQL_BLANK.format('x')} WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT * FROM f WHERE x2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, p) > 1),
marks AS (SELECT DISTINCT doc_id, unnest([p, p1, p2]) AS p FROM later)
SELECT doc_id, count(*) AS n_lines, count(m.p) AS n_removed, coalesce(string_agg(l.x, chr(10) ORDER BY l.p) FILTER (m.p IS NULL), '') AS text
FROM l LEFT JOIN marks m USING (doc_id, p) GROUP BY doc_id
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove(docs).select("doc_id", "n_lines", "n_removed", "text")


#: Base32 of a SHA-1 in SQL: 160 bits, five at a time.
SQL_BASE32 = """list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([CASE WHEN substr(bits, 5 * k + j + 1, 1) = '1' THEN (16 >> j) ELSE 0 END
 for j in [0, 1, 2, 3, 4]])::INT, 1) for k in range(32)], 'string_agg', '')"""


@query("op2_warc_index", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top,
  list_aggregate([lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0') for c in string_split(sha1(html), '')], 'string_agg', '') AS bits FROM p)
SELECT page_id, payload_bytes, {SQL_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM t
""")
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_index.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language_id.fold("doc_id", 5) == 0, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(language_id.fold("doc_id", 3) == 1, F.lit(False))
    model = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.predict(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


@query("op3_kneser_ney")
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)


def sql_kmeans(rounds: int = 10) -> str:
    """SQL of the rounds: m = long form of the vectors, c = centroids in long form, a = nearest centroid of each vector."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
             "m AS MATERIALIZED (SELECT r, generate_subscripts(q, 1) AS j, unnest(q) AS x FROM v)",
             """c0 AS MATERIALIZED (SELECT k, generate_subscripts(q, 1) AS j, unnest(q) AS x FROM
  (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, q FROM v QUALIFY k < 8))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT r, k, d FROM (SELECT m.r, c.k, sum((m.x - c.x) * (m.x - c.x))::BIGINT AS d FROM m JOIN c{r} c USING (j) GROUP BY m.r, c.k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN
  (SELECT k, j, (CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT AS x FROM
    (SELECT a.k, m.j, sum(m.x) AS s, count(*) AS n FROM m JOIN a{r} a USING (r) GROUP BY a.k, m.j)) n ON n.k = c.k AND n.j = c.j)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.k::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY k) h ON h.k = a.k"""


@query("op11_centroid_clustering", sql_kmeans())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.report(table(spark, sf_dir, "embeddings"))


@query("op12_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)
""")
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: CRC-32 of decimal text in SQL: bit by bit, polynomial 0xEDB88320.
SQL_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda z, i: xor(z >> 1, CASE WHEN z % 2 = 1 THEN 3988292384 ELSE 0 END))))"""
SQL_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))


def sql_fold(start: str) -> str:
    """SQL of folding up a chain of (left, right) lists."""
    return f"list_reduce(list_prepend({start}, list_transform(path, lambda p: p.l || '|' || p.r)), lambda d, p: sha256(split_part(p, '|', 1) || d || split_part(p, '|', 2)))"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256({SQL_LEAF} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN {SQL_CRC32} % 5 = 0 THEN sha256({SQL_LEAF} || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM documents),
low AS (SELECT 0 AS level, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM d
  UNION ALL SELECT level + 1, tree, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, tree, i // 16),
subroots AS MATERIALIZED (SELECT tree, h FROM low WHERE n = 1),
high AS (SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM subroots
  UNION ALL SELECT level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 16),
nodes AS MATERIALIZED (SELECT level, tree, i, n, h FROM low UNION ALL SELECT level + 1000, '', i, n, h FROM high),
sides AS MATERIALIZED (SELECT level, tree, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY level, tree, i // 16 ORDER BY i)),
places AS MATERIALIZED (SELECT d.*, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, (SELECT count(*) FROM subroots s WHERE s.tree < d.tree) AS j FROM d),
paths AS (SELECT p.tree, p.i, list(struct_pack(l := s.l, r := s.r) ORDER BY s.level) AS path FROM places p JOIN sides s
  ON (s.level < 1000 AND s.tree = p.tree AND s.i = p.i // (16 ** s.level)::BIGINT) OR (s.level >= 1000 AND s.i = p.j // (16 ** (s.level - 1000))::BIGINT) GROUP BY p.tree, p.i),
out AS (SELECT p.doc_id, p.leaf, u.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(q.path, []) AS path, coalesce(p.other, p.leaf) AS start
  FROM places p JOIN subroots u USING (tree) LEFT JOIN paths q ON q.tree = p.tree AND q.i = p.i)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate([p.l || p.r for p in path], 'string_agg', ''), '')) AS proof_sha256,
  {sql_fold('start')} AS folded_root, {sql_fold('start')} = root AS verified FROM out
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ("doc_id", "source", "lang", "n_chars", "text")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf([small if v == "text" else F.col(v) for v in values])
    return merkle.manifest(table(spark, sf_dir, "documents"), values, other=F.when(language_id.fold("doc_id", 5) == 0, tampered))
