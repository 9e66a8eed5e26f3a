"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digests
from .centroids import cluster_vectors
from .chat_format import chat_digests, format_chats
from .common import table
from .html_extract import main_texts
from .lang_id import language_of
from .media import media_columns
from .minhash_dedup import near_duplicates
from .packing import pack_documents
from .pii import pii_digests
from .prefix_trie import prefix_trie
from .quality import quality_verdicts
from .secret_scan import scan_secrets
from .url_filter import filter_urls


def tokenizer() -> tuple[str, str]:
    """The vocabulary file and the pre-token pattern used in production."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).drop("shard", "offset")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("reputation")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts look like control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, k, role, CONTROL_TEXT) for k, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    return chat_digests(format_chats(rows.unionByName(more)))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


#: Text of the conversation -7 of op12.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_dedup, op2_secret_scan, op3_html_extract, op4_bpe, op5_pii, op6_lang_id, op7_packing, op8_quality_rules, op9_media, op10_url_filter,
        op11_prefix_trie, op12_chat_format, op13_centroids,
    )
    return {f.__name__: f for f in found}


#: Exact comparison of all documents that share a shingle; production tables are too large for it.
NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
  e AS (SELECT doc_id, unnest(sh) AS x FROM s), f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1), g AS (SELECT doc_id, x FROM e JOIN f USING (x)),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b WHERE 100 * p.c >= 85 * (len(sa.sh) + len(sb.sh) - p.c)),
  u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.reach FROM r JOIN u ON u.a = r.doc_id)
  SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""

#: The rules, then beta-binomial shrinkage from host to domain to suffix; the hosts of pages have suffixes of one label.
URL_FILTER_SQL = """WITH r AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
  h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
  j AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM h),
  c AS (SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM j),
  g AS (SELECT host, CAST(count(action) AS DOUBLE) AS n, CAST(sum(CASE WHEN action = 'block' THEN 1 ELSE 0 END) AS DOUBLE) AS k FROM c GROUP BY host),
  hosts AS (SELECT *, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM g),
  s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM hosts) AS m, 0.0::DOUBLE AS var FROM hosts GROUP BY suffix),
  s1 AS (SELECT suffix, (k + s * m) / (n + s) AS m, (k + s * m) * (n - k + s * (1 - m)) / ((n + s) * (n + s) * (n + s + 1)) + (s / (n + s)) * (s / (n + s)) * var AS var FROM s0, (SELECT CASE WHEN coalesce(top, 0) = 0 THEN 1.0::DOUBLE WHEN ss - v <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, top / (ss - v) - 1)) END AS s FROM (SELECT sum(m * (1 - m) * (n - 1)) AS top, sum(m * (1 - m)) AS v, sum(n * (k / n - m) * (k / n - m)) AS ss FROM s0 WHERE n > 0))),
  d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(s1.m) AS m, any_value(s1.var) AS var FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix),
  d1 AS (SELECT domain, suffix, (k + s * m) / (n + s) AS m, (k + s * m) * (n - k + s * (1 - m)) / ((n + s) * (n + s) * (n + s + 1)) + (s / (n + s)) * (s / (n + s)) * var AS var FROM d0, (SELECT CASE WHEN coalesce(top, 0) = 0 THEN 1.0::DOUBLE WHEN ss - v <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, top / (ss - v) - 1)) END AS s FROM (SELECT sum(m * (1 - m) * (n - 1)) AS top, sum(m * (1 - m)) AS v, sum(n * (k / n - m) * (k / n - m)) AS ss FROM d0 WHERE n > 0))),
  h0 AS (SELECT host, n, k, d1.m, d1.var FROM hosts JOIN d1 USING (domain, suffix)),
  h1 AS (SELECT host, (k + s * m) / (n + s) - 1.645 * sqrt((k + s * m) * (n - k + s * (1 - m)) / ((n + s) * (n + s) * (n + s + 1)) + (s / (n + s)) * (s / (n + s)) * var) AS lower_bound FROM h0, (SELECT CASE WHEN coalesce(top, 0) = 0 THEN 1.0::DOUBLE WHEN ss - v <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, top / (ss - v) - 1)) END AS s FROM (SELECT sum(m * (1 - m) * (n - 1)) AS top, sum(m * (1 - m)) AS v, sum(n * (k / n - m) * (k / n - m)) AS ss FROM h0 WHERE n > 0)))
  SELECT page_id, host, path, rule, coalesce(action, CASE WHEN lower_bound >= 2.0::DOUBLE / 3 THEN 'block' ELSE 'allow' END) AS verdict FROM c LEFT JOIN h1 USING (host)"""


#: Nodes are digests of the turns so far; every node is joined with those above it. CRC-32 bit by bit, over the digits of the id.
PREFIX_TRIE_SQL = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS p FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
  r AS (SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h UNION ALL SELECT conv_id, p, role, text FROM c JOIN t USING (conv_id) WHERE p > h),
  d AS (SELECT conv_id, row_number() OVER w AS d, length(text) AS chars, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
  u AS (SELECT conv_id, d, chars, node FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c), e AS (SELECT conv_id, max(d) AS len FROM u GROUP BY conv_id),
  v AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent, d = len AS ending FROM u JOIN e USING (conv_id)),
  n AS (SELECT node, min(conv_id) AS conv_id, any_value(d) AS d, count(*) AS n, any_value(parent) AS parent, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends FROM v GROUP BY node),
  k AS (SELECT parent AS node, count(*) AS k FROM n WHERE parent IS NOT NULL GROUP BY parent),
  s AS (SELECT u.node, sum(n.saved) AS saved, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves FROM n LEFT JOIN k USING (node) JOIN u ON u.conv_id = n.conv_id AND u.d <= n.d GROUP BY u.node)
  SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
  FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n q ON q.node = n.parent"""


def _escaped(column: str) -> str:
    """A text with its control strings escaped, as the template does."""
    out = f"replace({column}, '\\', '\\\\')"
    for mark in ("turn>", "text>", "/turn>"):
        out = f"replace({out}, '<{mark}', '\\l{mark}')"
    return out


#: Digests of the rows themselves; the length of the formatted text is that of escaped texts, a mark a turn, and the marks of each block.
CHAT_FORMAT_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '{CONTROL_TEXT}' FROM range(2) a(k))),
  b AS (SELECT *, row_number() OVER w AS p, coalesce(role <> lag(role) OVER w, TRUE) AS begins FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(length({_escaped('text')}) + 6 + CASE WHEN begins THEN 13 + length({_escaped('role')}) ELSE 0 END) AS BIGINT) AS formatted_chars FROM b GROUP BY conv_id"""


def _centroids_sql(rounds: int = 10, k: int = 8) -> str:
    """Lloyd's rounds one after the other, in integers."""
    near = f"""SELECT vec_id, any_value(q) AS q, min(CAST(d AS HUGEINT) * {k} + k) AS dk FROM (SELECT v.vec_id, v.q, c.k, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, {{}} c) GROUP BY vec_id"""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))"]
    for i in range(rounds):
        x = f"SELECT dk % {k} AS k, unnest(range(64)) AS j, unnest(q) AS x FROM ({near.format(f'c{i}')})"
        m = f"SELECT k, j, (s - (s % n + n) % n) // n AS m FROM (SELECT k, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM ({x}) GROUP BY k, j)"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT k, list(CAST(m AS BIGINT) ORDER BY j) AS q FROM ({m}) GROUP BY k) m ON m.k = c.k)")
    parts.append(f"a AS (SELECT vec_id, CAST(dk % {k} AS INTEGER) AS cluster, CAST(dk // {k} AS BIGINT) AS distance FROM ({near.format(f'c{rounds}')}))")
    return f"""WITH {', '.join(parts)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.k = a.cluster"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query: decoding, parsing, models and packing can't be; their tests have plain versions."""
    return {
        "op1_minhash_dedup": NEAR_DUPLICATES_SQL, "op10_url_filter": URL_FILTER_SQL,
        "op11_prefix_trie": PREFIX_TRIE_SQL, "op12_chat_format": CHAT_FORMAT_SQL, "op13_centroids": _centroids_sql(),
    }
