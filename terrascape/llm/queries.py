"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.llm import fim, llr, minhash, mixing, packing, phrases, prefixjoin, quality, sharding, suffix, toxicity, urlfilter, warc
from terrascape.llm.common import held_out, labelled, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.trained(documents, table(spark, sf_dir, "labels"))
    return quality.classify(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 24)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_neighbours(table(spark, sf_dir, "documents"))


def op6_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixjoin.classes(table(spark, sf_dir, "documents"), n=3, t="0.9")


def op7_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trusted = labelled(table(spark, sf_dir, "labels"), "quality").where("label = 1")
    found = llr.judged(documents.select("doc_id", "text"), llr.log_ratios(documents.withColumn("learnable", ~held_out()), trusted))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.trained(documents, table(spark, sf_dir, "labels"))
    return toxicity.classify(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_hash")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


#: Rules of op13, as its contract fixes them: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, urlfilter.outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_histogram_sharding, op3_warc_index, op4_suffix_dedup, op5_minhash, op6_prefix_tree_join, op7_llr_rules, op8_counterfactual_toxicity, op9_soft_mixing, op10_best_fit_packing, op11_collocations, op12_fill_in_middle, op13_url_filter)}


#: DuckDB SQL for the rows of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op6_prefix_tree_join": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS h FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id""",
    "op3_warc_index": """
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first_id FROM d GROUP BY x)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((('0x' || substr(d.x, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31 AS INT), 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f ON d.x = f.x""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
u AS (SELECT lang, k, phrase, a, cut, array_to_string(x[1:cut], ' ') AS x1, array_to_string(x[cut + 1:], ' ') AS x2 FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
s AS (
  SELECT u.lang, u.phrase, u.a, min(struct_pack(score := (1000000::HUGEINT * u.a * u.a // (l.f::HUGEINT * r.f))::BIGINT, cut := cut, l := l.f, r := r.f)) AS m
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.x1 JOIN f r ON r.lang = u.lang AND r.phrase = u.x2 GROUP BY ALL),
h AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, x[1] || ' ' || x[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, x[2] || ' ' || x[3] FROM c WHERE k = 3) GROUP BY ALL),
o AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY m.score DESC, a DESC, phrase) AS rank
  FROM s LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, m.l AS l, m.r AS r, t.n, m.score AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""",
    "op12_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM h),
c AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o""",
    "op13_url_filter": r"""
WITH x AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
lab AS (SELECT doc_id, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
k AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM x JOIN lab ON lab.doc_id = try_cast(regexp_extract(path, '([0-9]{1,18})(\.html|/)?$', 1) AS BIGINT) GROUP BY host),
nm AS (SELECT DISTINCT host, regexp_extract(host, '^(?:.*@)?(\[[^\]]*\]|[^:]*?)\.?(?::[0-9]*)?$', 1) AS name FROM x),
l AS (SELECT host, name, string_split(name, '.') AS p FROM nm),
d AS (SELECT host, name, (name SIMILAR TO '[0-9.]*' OR name LIKE '[%') AS num, p, array_to_string(p[-2:], '.') AS two FROM l),
e AS MATERIALIZED (
  SELECT d.host, coalesce(k.n, 0)::DOUBLE AS n, coalesce(k.bad, 0)::DOUBLE AS bad,
         CASE WHEN num THEN '' WHEN two IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.au', 'gov.uk', 'net.au', 'ne.jp', 'or.jp', 'org.au', 'org.uk') THEN two ELSE p[-1] END AS suffix,
         CASE WHEN num THEN name WHEN two IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.au', 'gov.uk', 'net.au', 'ne.jp', 'or.jp', 'org.au', 'org.uk') THEN array_to_string(p[-3:], '.') ELSE two END AS domain
  FROM d LEFT JOIN k ON k.host = d.host),
a3 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM e GROUP BY ALL),
a2 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM e) AS mean FROM a3 GROUP BY suffix),
s2 AS (SELECT 1 / round(least(greatest(coalesce(sum((bad - n * mean) ^ 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.5), 1e-4), 0.5), 9) - 1 AS s FROM a2),
m2 AS (SELECT suffix, (s * mean + bad) / (s + n) AS mean FROM a2, s2),
b3 AS (SELECT a3.*, m2.mean FROM a3 JOIN m2 USING (suffix)),
s3 AS (SELECT 1 / round(least(greatest(coalesce(sum((bad - n * mean) ^ 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.5), 1e-4), 0.5), 9) - 1 AS s FROM b3),
m3 AS (SELECT domain, suffix, (s * mean + bad) / (s + n) AS mean FROM b3, s3),
b4 AS (SELECT e.*, m3.mean FROM e JOIN m3 USING (domain, suffix)),
s4 AS (SELECT 1 / round(least(greatest(coalesce(sum((bad - n * mean) ^ 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.5), 1e-4), 0.5), 9) - 1 AS s FROM b4),
m4 AS (SELECT host, (s * mean + bad) / (s + n) AS mean, s + n AS weight FROM b4, s4),
v AS (SELECT host, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.25 THEN 'block' ELSE 'allow' END AS own FROM m4),
r AS (
  SELECT x.page_id, x.host, x.path, v.own,
         CASE WHEN (x.host = 'example.net' OR x.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (x.host = 'example.com' OR x.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (x.host = 'org' OR x.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (x.host = 'net' OR x.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM x JOIN v ON v.host = x.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE own END AS verdict FROM r""",
}
