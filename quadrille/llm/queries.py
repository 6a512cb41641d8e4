"""The queries opN_<name> of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.url_reputation import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.sharding import interleave

    return interleave(_table(spark, sf_dir, "documents")).drop("source")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.chat import digest_examples, format_conversations

    said = r"\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest_examples(format_conversations(rows.unionByName(extra)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quadrille.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.media import media_digests

    return media_digests(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.toxicity import held_out, score_documents, train

    docs = _table(spark, sf_dir, "documents")
    out = score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst_start", "worst_end")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.ngram_join import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY doc_id
"""


#: DuckDB has no CRC-32: its table of 256 comes from the polynomial, and the bytes of each text are folded over it.
OP4_SQL = r"""
WITH crc AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, [0::BIGINT FOR x IN range(8)]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS k))),
d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
b AS (SELECT doc_id, source, m, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
  xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [CAST(strpos('0123456789ABCDEF', y[1]) * 16 + strpos('0123456789ABCDEF', y[2]) - 17 AS BIGINT) FOR y IN regexp_extract_all(h, '..')]),
    lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1]))) AS text_crc32 FROM d, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY m, doc_id NULLS FIRST, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, m, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 16 // n AS INT) AS shard, CAST(pos - (pos * 16 // n * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""


OP6_SQL = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT conv_id, coalesce(c.role, '') AS who, coalesce(c.text, '') AS said,
  row_number() OVER (PARTITION BY conv_id ORDER BY c.turn NULLS FIRST, c.role NULLS FIRST, c.text NULLS FIRST) AS pos FROM c),
w AS (SELECT *, length('### : </turn> ') + 1 + length(regexp_replace(who, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(said, '(\\|###|</turn>)', '\\\1', 'g')) AS n FROM t),
e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, pos = count(*) OVER (PARTITION BY conv_id) AS ends FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(who || chr(10) || said || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(said)) FILTER (WHERE who = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE who = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE who = 'assistant' OR ends) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE who = 'assistant' OR ends) AS n_examples
FROM e GROUP BY conv_id
"""


def _op1_sql() -> str:
    from quadrille.llm.url_reputation import RULES, WIDE_SUFFIXES

    wide = r"(?:^|\.)(" + "|".join(x.replace(".", r"\.") for x in WIDE_SUFFIXES) + ")$"
    rules = sorted(RULES, key=lambda x: -len(x[1]))

    def fits(text: str) -> str:
        host, slash, rest = text.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}')"

    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in rules)
    said = " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in rules)

    def weight(units: str, prior: str) -> str:
        mq = f"{prior} * (1 - {prior})"
        s, a, b = f"sum(n * pow(g / n - {prior}, 2))", f"sum({mq})", f"sum({mq} * (n - 1))"
        return f"SELECT CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 2.0), 200.0) ELSE 200.0 END AS k FROM (SELECT coalesce(({s} - {a}) / nullif({b}, 0), 0) AS r FROM {units} WHERE n > 0)"

    return f"""
WITH cut AS (SELECT page_id, html, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
judged AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  CAST((length(html) - length(regexp_replace(html, '[%*#$&@~^|]{{3}}|!!', '', 'g'))) / CAST(greatest(length(html), 1) AS DOUBLE) < 0.01 AS INT) AS good FROM cut),
h0 AS (SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS g, regexp_replace(host, ':[0-9]*$', '') AS bare FROM judged GROUP BY host),
h1 AS (SELECT *, CASE WHEN regexp_matches(bare, '{wide}') THEN regexp_extract(bare, '{wide}', 1) ELSE regexp_extract(bare, '[^.]*$', 0) END AS suffix FROM h0),
h2 AS (SELECT *, regexp_extract(substr(bare, 1, greatest(length(bare) - length(suffix) - 1, 0)), '[^.]*$', 0) AS label FROM h1),
hosts AS (SELECT *, CASE WHEN label <> '' THEN label || '.' || suffix ELSE suffix END AS domain FROM h2),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(g) AS g FROM hosts GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM d0 GROUP BY ALL),
s1 AS (SELECT *, (SELECT (sum(g) + 1) / (sum(n) + 2) FROM s0) AS m0 FROM s0),
s2 AS (SELECT suffix, (g + k * m0) / (n + k) AS m1 FROM s1, ({weight("s1", "m0")})),
d1 AS (SELECT * FROM d0 JOIN s2 USING (suffix)),
d2 AS (SELECT suffix, domain, (g + k * m1) / (n + k) AS m2 FROM d1, ({weight("d1", "m1")})),
h3 AS (SELECT * FROM hosts JOIN d2 USING (suffix, domain)),
h4 AS (SELECT host, n + k + 1 AS w, (g + k * m2) / (n + k) AS m FROM h3, ({weight("h3", "m2")}))
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {said} END, CASE WHEN m - 1.64 * sqrt(m * (1 - m) / w) >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict
FROM judged JOIN h4 USING (host)
"""


def queries() -> dict:
    out = {f.__name__: f for f in (op1_url_reputation, op2_line_dedup, op3_license_scan, op4_sharding, op5_bpe, op6_chat_format, op7_media, op8_toxicity, op9_ngram_join, op10_decontaminate)}
    return out


def oracle_sql() -> dict[str, str]:
    return {"op1_url_reputation": _op1_sql(), "op2_line_dedup": OP2_SQL, "op4_sharding": OP4_SQL, "op6_chat_format": OP6_SQL}
