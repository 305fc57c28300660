"""The registered queries of the text operators, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm import (bpe, chat, exact, hosts, jaccard, licences, packing, passages, prefixes, quality, ranked, substrings,
                       toxicity)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then divergence from the language references."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or of sentence scores."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")


@query("op3_chat_format", """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(replace(role, '\\', '\\\\'), '(<|\\[)(\\||/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2', 'g'))
              + length(regexp_replace(replace(text, '\\', '\\\\'), '(<|\\[)(\\||/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2', 'g')) + 24 AS width FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(width) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, a record per turn, and conversation -1."""
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    return chat.digests(chat.format_records(rows.select("conv_id", "turn", record.alias("record"))))


@query("op4_jaccard_join", """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.other = e.x)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n""")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at 85 per cent."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
keys AS (SELECT doc_id, i, hash(ws[i:i + 19]) AS h, md5(array_to_string(ws[i:i + 19], ' ')) AS m FROM starts),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) AS r FROM keys),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, p: NOT coalesce(list_contains(ps, p), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 20-word window that also starts earlier are cut."""
    return substrings.digest(table(spark, sf_dir, "documents")).drop("cuts")


@query("op6_passage_quality")
def op6_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention over passages."""
    found = passages.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to."""
    return bpe.digest(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    groups = exact.exact_groups(table(spark, sf_dir, "documents"), smallest=False)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# The rules of the contract: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def page_outcome(html: Column) -> Column:
    """1 for prose, 0 for a page whose visible text has a symbol for every fifth word or more."""
    visible = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "&[a-z]+;", "&")
    symbols = F.length(visible) - F.length(F.translate(visible, "#*$%&|", ""))
    return (symbols * 5 < F.size(F.split(visible, " "))).cast("int")


def _strength_sql(members: str, n: str, k: str, mean: str) -> str:
    """The moment estimate of a prior's strength, between 1 and 10,000 pages; 8 where no member has two."""
    r = f"((sum({n} * ({k} / {n} - {mean}) * ({k} / {n} - {mean})) - sum({mean} * (1 - {mean}))) / sum({mean} * (1 - {mean}) * ({n} - 1)))"
    return (f"SELECT CASE WHEN sum({mean} * (1 - {mean}) * ({n} - 1)) > 0 THEN CASE WHEN {r} > 0 THEN least(greatest(1 / {r} - 1, 1.0), 10000.0) "
            f"ELSE 10000.0 END ELSE 8.0 END AS s FROM {members} WHERE {n} > 1")


_SUFFIX_LIST = ", ".join(f"'{s}'" for s in hosts.SUFFIXES)


@query("op8_host_reputation", rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', '&', 'g') AS t
  FROM pages),
b AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.*(:[0-9]*)?$', '') AS bare,
         CAST((length(t) - length(translate(t, '#*$%&|', ''))) * 5 < len(string_split(t, ' ')) AS INTEGER) AS good
  FROM p),
o AS (
  SELECT *, CASE WHEN starts_with(bare, '[') OR regexp_matches(bare, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN bare
                 WHEN array_to_string(string_split(bare, '.')[-2:], '.') IN ({_SUFFIX_LIST}) THEN array_to_string(string_split(bare, '.')[-2:], '.')
                 ELSE string_split(bare, '.')[-1] END AS zone FROM b),
h AS (
  SELECT bare, zone, CASE WHEN length(bare) <= length(zone) + 1 THEN bare
                          ELSE string_split(left(bare, length(bare) - length(zone) - 1), '.')[-1] || '.' || zone END AS domain,
         count(*) AS n, sum(good) AS k FROM o WHERE good IS NOT NULL AND bare <> '' GROUP BY ALL),
z AS (SELECT zone, (sum(k) + 1) / (sum(n) + 2) AS z_mean FROM h GROUP BY zone),
dd AS (SELECT domain, sum(n) AS dn, sum(k) AS dk, any_value(z_mean) AS z_mean FROM h JOIN z USING (zone) GROUP BY domain),
ds AS ({_strength_sql("dd", "dn", "dk", "z_mean")}),
d AS (SELECT domain, (dk + z_mean * s) / (dn + s) AS d_mean FROM dd, ds),
hd AS (SELECT bare, n, k, d_mean FROM h JOIN d USING (domain)),
hs AS ({_strength_sql("hd", "n", "k", "d_mean")}),
m AS (SELECT bare, (k + d_mean * s) / (n + s) AS mean, n + s AS total FROM hd, hs),
u AS (SELECT bare, mean + 1.645 * sqrt(mean * (1 - mean) / (total + 1)) AS upper_bound FROM m),
r(rule, rule_host, rule_path, action) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
      FROM o JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT o.page_id, o.host, o.path, f.rule,
       coalesce(f.action, CASE WHEN upper_bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM o LEFT JOIN f USING (page_id) LEFT JOIN u USING (bare)""")
def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", page_outcome(F.col("html")).alias("good"))
    return hosts.judge(pages, URL_RULES)


@query("op11_licence_scan")
def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices, tags and licence expressions of every text."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("found", "expressions")


@query("op12_prefix_trie", r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) AS pos, said, words
  FROM (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
bits AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c, conv_id - conv_id % 20 AS base FROM own),
heads AS (  -- h = crc32(decimal id) % 4, bit by bit: a byte is mixed in, then eight shifts (marked -1)
  SELECT conv_id, base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(c) + 1),
      lambda i: [CAST(ascii(substr(c, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
  FROM bits),
taken AS (SELECT h.conv_id, o.pos, o.said, o.words FROM heads h JOIN own o ON o.conv_id = h.base AND o.pos <= h.h),
rest AS (SELECT o.conv_id, o.pos - h.h + (SELECT count(*) FROM taken t WHERE t.conv_id = o.conv_id) AS pos, o.said, o.words
         FROM own o JOIN heads h USING (conv_id) WHERE o.pos > h.h),
turns AS (SELECT * FROM taken UNION ALL SELECT * FROM rest),
paths AS (SELECT h.conv_id, coalesce(list(md5(said) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS p,
                 coalesce(list(words ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ws
          FROM heads h LEFT JOIN turns USING (conv_id) GROUP BY h.conv_id),
members AS (SELECT conv_id, len(p) AS n, d AS depth, array_to_string(p[1:d], '') AS k, array_to_string(p[1:d - 1], '') AS up,
                   CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words
            FROM paths, unnest(range(0, len(p) + 1)) AS r(d)),
nodes AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
          FROM members GROUP BY k, depth),
kids AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (SELECT m.k, m.depth, sum(n.saved) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
          FROM nodes n JOIN paths p ON p.conv_id = n.conv_id
          JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
          LEFT JOIN kids c ON c.k = n.k AND c.depth = n.depth GROUP BY m.k, m.depth)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.k = n.k AND b.depth = n.depth
LEFT JOIN kids c ON c.k = n.k AND c.depth = n.depth
LEFT JOIN nodes u ON n.depth > 0 AND u.k = n.up AND u.depth = n.depth - 1""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefixes.trie(*prefixes.share_heads(prefixes.number_turns(table(spark, sf_dir, "conversations"))))


@query("op13_ranked_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
