"""The operators' registered queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_links, hamming_search, lexical_search, merkle, packed_ids, packing, pseudonyms, quality, simhash, token_counts, url_filter, warc
from .shared import new_path

#: (host, path, verdict) of the production url rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.LineField:
    return quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, fitted(spark, docs, sf_dir), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", F.size("bad_lines").alias("n_bad_lines"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512, keep=["doc_id"])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    packed_ids.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return packed_ids.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: The key where the session names none (``spark.dwellspark.pseudonyms.secret``, a name that Spark redacts).
PSEUDONYM_KEY = "corpus-pseudonyms-1"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.dwellspark.pseudonyms.secret", PSEUDONYM_KEY)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hamming_search.codes(table(spark, sf_dir, "embeddings"))
    return hamming_search.top_k(rows, rows.filter("id % 100 = 0"), k=10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1, 2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.plan(table(spark, sf_dir, "pages")), new_path(spark, "warc"))
    return warc.read(archives, payloads=False)


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in merkle.FIELDS}
    # a tampered copy: of the rows with an even checksum of the id, texts lose their line feeds
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    altered = F.when(hit, merkle.leaf(**fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))}))
    out = merkle.manifest(docs, merkle.leaf(**fields), also={"altered": altered})
    out = out.withColumns({"proof_sha256": merkle.proof_digest(F.col("path")), "folded_root": merkle.fold(F.coalesce("altered", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_OPERATORS = (
    op1_quality_classifier, op2_token_counts, op3_url_filter, op4_simhash, op5_decontamination,
    op6_token_ids, op7_pii, op8_top_k, op9_packing, op10_warc,
    op11_embedding_duplicates, op12_merkle_manifest, op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

#: Pages' links: the urls that canonical links and meta refreshes name; then least reachable url, blocked groups.
_OP3_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM split
), fields AS (
  SELECT url, tag, regexp_extract(tag, '(?i)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS rel,
         regexp_extract(tag, '(?i)[\s"''/]http-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS equiv,
         regexp_extract(tag, '(?i)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS href,
         regexp_extract(tag, '(?i)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS content FROM tags
), named AS (
  SELECT url, trim(replace(CASE WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(string_split_regex(lower(trim(rel.a || rel.b || rel.c)), '\s+'), 'canonical') THEN href.a || href.b || href.c
                           WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim(equiv.a || equiv.b || equiv.c)) = 'refresh'
                           THEN regexp_extract(content.a || content.b || content.c, '(?i)^[^;,]*[;,]\s*url\s*=\s*["'']?([^"''\s]*)', 1) ELSE '' END, '&amp;', '&')) AS target FROM fields
), targets AS (
  SELECT url, regexp_extract(url, '^[^/?#]*://[^/?#]*') AS origin, regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) AS path, target FROM named WHERE target <> ''
), full_urls AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                   WHEN starts_with(target, '//') THEN regexp_extract(url, '^[^/?#]*:') || target WHEN starts_with(target, '?') THEN origin || path || target
                   WHEN starts_with(target, '#') THEN url WHEN starts_with(target, '/') THEN origin || target
                   ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^.*/') END || target END AS target FROM targets
), edges AS (
  SELECT DISTINCT lower(regexp_extract(url, '^[^/?#]*://[^/?#]*')) || regexp_extract(regexp_replace(url, '^[^/?#]*://[^/?#]*', ''), '^[^#]*') AS a,
         lower(regexp_extract(target, '^[^/?#]*://[^/?#]*')) || regexp_extract(regexp_replace(target, '^[^/?#]*://[^/?#]*', ''), '^[^#]*') AS b FROM full_urls
), linked AS (
  SELECT a, b FROM edges WHERE a LIKE '%://%' AND b LIKE '%://%' AND a <> b UNION SELECT b, a FROM edges WHERE a LIKE '%://%' AND b LIKE '%://%' AND a <> b
), reach AS (
  SELECT a AS url, a AS other FROM linked UNION SELECT r.url, l.b FROM reach r JOIN linked l ON r.other = l.a
), rules(rhost, rpath, decision) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
names AS (
  SELECT url, translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT other AS url FROM reach)
), bad AS (
  SELECT url FROM (SELECT n.url, (SELECT decision FROM rules WHERE (n.host = rhost OR n.host LIKE '%.' || rhost) AND starts_with(n.path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS d FROM names n) WHERE d = 'block'
), blocked AS (SELECT DISTINCT r.url FROM reach r JOIN bad ON r.other = bad.url),
fits AS (
  SELECT s.page_id, s.url, s.host, s.path, r.rhost || r.rpath AS rule, r.decision,
         row_number() OVER (PARTITION BY s.page_id, s.url ORDER BY length(r.rhost || r.rpath) DESC, r.decision) AS n
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR s.host LIKE '%.' || r.rhost) AND starts_with(s.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN lower(regexp_extract(url, '^[^/?#]*://[^/?#]*')) || regexp_extract(regexp_replace(url, '^[^/?#]*://[^/?#]*', ''), '^[^#]*') IN (SELECT url FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits WHERE n = 1
"""

_OP8_SQL = """
WITH coded AS (
  SELECT vec_id AS id, list_sum([CASE WHEN embedding[i + 1] > 0 AND NOT isnan(embedding[i + 1]) THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END FOR i IN range(64)])::HUGEINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64
), ranked AS (
  SELECT q.id AS query_id, d.id AS neighbor_id, bit_count(xor(q.code, d.code))::BIGINT AS distance,
         row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.code, d.code)), d.id) AS rank
  FROM coded q, coded d WHERE q.id % 100 = 0
)
SELECT query_id, rank::BIGINT AS rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

_OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM m
"""

#: Nodes level by level, siblings of every node, and the fold of each (tampered) leaf along its path.
_OP12_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars END AS head,
         CASE WHEN list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ascii(ch)::BIGINT)),
              lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))) % 2 = 1
              AND doc_id IS NOT NULL THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN tampered IS NULL THEN '-' ELSE octet_length(encode(tampered)) || ':' || tampered END) AS altered FROM f
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, leaf) AS row_no, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) AS src FROM l
), low AS (
  SELECT 0 AS lvl, src, slot, n, leaf AS d FROM leaves
  UNION ALL
  SELECT lvl + 1, src, slot // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY slot)) FROM low WHERE n > 1 GROUP BY lvl, src, slot // 3
), subroots AS (
  SELECT src, d AS subroot, src - 1 AS slot, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 1000 AS lvl, 0 AS src, slot, n, subroot AS d FROM subroots
  UNION ALL
  SELECT lvl + 1, 0, slot // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY slot)) FROM high WHERE n > 1 GROUP BY lvl, slot // 3
), nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
sides AS (
  SELECT a.lvl, a.src, a.slot, coalesce(string_agg(b.d, '' ORDER BY b.slot) FILTER (WHERE b.slot < a.slot), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.slot) FILTER (WHERE b.slot > a.slot), '') AS after
  FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.src = b.src AND a.slot // 3 = b.slot // 3 WHERE a.n > 1 GROUP BY a.lvl, a.src, a.slot
), paths AS (
  SELECT row_no, lvl, before, after FROM leaves JOIN sides ON sides.src = leaves.src AND lvl < 1000 AND sides.slot = leaves.slot // (3 ** lvl)::BIGINT
  UNION ALL
  SELECT row_no, lvl, before, after FROM leaves JOIN subroots USING (src) JOIN sides ON lvl >= 1000 AND sides.slot = subroots.slot // (3 ** (lvl - 1000))::BIGINT
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY lvl) AS k FROM paths
), folded AS (
  SELECT row_no, 0 AS k, altered AS d FROM leaves
  UNION ALL
  SELECT s.row_no, f.k + 1, sha256(s.before || f.d || s.after) FROM folded f JOIN steps s ON s.row_no = f.row_no AND s.k = f.k + 1
), ends AS (SELECT row_no, arg_max(d, k) AS folded_root FROM folded GROUP BY 1),
proofs AS (SELECT row_no, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256 FROM paths GROUP BY 1),
top AS (SELECT d AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (src) JOIN ends USING (row_no) LEFT JOIN proofs USING (row_no) CROSS JOIN top
"""

_OP13_SQL = r"""
WITH occ AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents)
), tfs AS (SELECT row_no, doc_id, term, count(*) AS tf FROM occ GROUP BY ALL),
sizes AS (SELECT row_no, sum(tf)::BIGINT AS n FROM tfs GROUP BY 1),
whole AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY term, nn),
ms AS (SELECT row_no, 100 - 25 + (25 * n * nn) // ll AS m FROM sizes, whole),
asked AS (
  SELECT item_no, item_id, term, count(*) AS times FROM (
    SELECT item_no, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item_no, item_id, text FROM benchmark)) GROUP BY ALL
), scores AS (
  SELECT item_no, item_id, row_no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN ms USING (row_no) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""

ORACLE_SQL = {"op3_url_filter": _OP3_SQL, "op8_top_k": _OP8_SQL, "op10_warc": _OP10_SQL, "op12_merkle_manifest": _OP12_SQL, "op13_lexical_search": _OP13_SQL}
