"""Registered queries of the text operators: each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, html_text, licenses, minhash, mixing, pii, quality, sharding, simhash, spelling, tokens, warc
from .common import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return minhash.with_edited(docs, minhash.near_duplicates(docs))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(pages(spark, sf_dir), least_bytes=0)
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(p.h, CAST(10 * (i // 8) + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT), 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p JOIN f ON p.html = f.html
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("sources")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * n AS cap, row_number() OVER (ORDER BY n / w, source NULLS LAST) - 1 AS k,
    sum(n) OVER () AS total,
    coalesce(sum(3 * n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
c AS (SELECT coalesce(min(k) FILTER (WHERE (total - capped) * w / rest <= cap), count(*)) AS open FROM r),
b AS (SELECT total - capped AS money, rest FROM r, c WHERE k = c.open),
t AS (SELECT source, n, CASE WHEN k < c.open THEN CAST(cap AS DOUBLE) ELSE CAST((SELECT money FROM b) AS BIGINT) * w / (SELECT rest FROM b) END AS target FROM r, c),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * n) AS flow FROM t),
z AS (SELECT d.*, q.n, q.target, q.flow, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
  CAST(CASE WHEN n = 0 THEN 0 ELSE size * (flow // n + CASE WHEN before + size / 2 <= flow % n THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM z
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality.score(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score").withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(pages(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir), secret="surrogates")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert every document, revise those that are labelled toxic to an empty text, delete those of low quality that
    are not, and repeat a commit. Two tokenizer versions are counted.

    Texts are counted once, into a ledger; what a revision or deletion takes out comes from the ledger's narrow rows.
    """
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    toxic, poor = marks.where("toxic = 1").select("doc_id"), marks.where("quality = 0 and coalesce(toxic, 0) <> 1").select("doc_id")
    names = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    ledger = table(tokens.counted(docs, names), "tokens-ledger")
    totals = tokens.Totals(spark)
    totals.commit_rollup("inserts", tokens.rollup(ledger))
    out = ledger.join(toxic, "doc_id", "left_semi").withColumn("sign", F.lit(-1))
    into = docs.drop("text").join(toxic, "doc_id", "left_semi").withColumn("text", F.lit(""))
    totals.commit_rollup("revisions", tokens.rollup(out.unionByName(tokens.counted(into, names))))
    gone = ledger.join(poor, "doc_id", "left_semi").withColumn("sign", F.lit(-1))
    totals.commit_rollup("deletes", tokens.rollup(gone))
    totals.commit_rollup("inserts", tokens.rollup(ledger))
    return totals.totals()


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


# The words' checksums are computed here bit by bit, near words by the words less one code point, and chains by recursion.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(CAST('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i + 1 AS INT), 2) AS INT) AS BIGINT) FOR i IN range(octet_length(encode(id || ':' || run)))]),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS INT)])), 4294967295) AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) + 2 AS INT)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
    UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
q AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN q ON v.word = q.word),
z AS (SELECT word, word AS root, form AS step FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON z.step = f.word)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word AND z.step IS NULL
"""


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
k AS (SELECT substr('ABCDE', CAST(i AS INT), 1) AS f, CAST(1 << (i - 1) AS INT) AS bit FROM (SELECT unnest(range(1, 6)) AS i)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM k a, k b, k c, k d, k e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(j AS INT) AS step, bits[j] AS bit, coalesce(list_sum(bits[1:j - 1]), 0)::INT AS earlier FROM (SELECT *, unnest(range(1, 6)) AS j FROM o)),
r AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN good AND mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN toxic AND mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_tokens": op6_tokens,
    "op7_minhash": op7_minhash,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_licenses": op11_licenses,
    "op12_spelling": op12_spelling,
    "op13_audit": op13_audit,
}

ORACLE: dict[str, str] = {"op8_warc": OP8_SQL, "op9_mixing": OP9_SQL, "op12_spelling": OP12_SQL, "op13_audit": OP13_SQL}
