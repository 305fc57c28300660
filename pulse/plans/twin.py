"""The same views over the given tables as ANSI SQL, for checking results in another engine."""

from pulse.functions.text import STOP_WORDS

FEED = """
feed AS (
  SELECT event_id, ts, event_type, value, user_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(user_id AS VARCHAR) AS install_id,
         CAST(user_id AS VARCHAR) || '-' ||
           CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS VARCHAR) AS session_id
  FROM events),
stream AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS seq,
         CASE WHEN k % 10 = 0 THEN 'synthetic' WHEN k % 10 < 4 THEN 'dev' ELSE 'prod' END AS env,
         'mod' || CAST(k % 3 AS VARCHAR) AS mod_id,
         epoch_us(ts) AS ts_us, epoch_us(ts) + CAST(k AS BIGINT) * 1000000 AS received_us
  FROM feed)"""

TELEMETRY = FEED + """,
typed AS (
  SELECT *, CASE WHEN k % 25 = 24 THEN 'Heartbeat'
                 WHEN event_type = 'click' THEN 'ConfrontationAttempted'
                 WHEN event_type = 'view' THEN 'AreaEntered'
                 WHEN event_type = 'purchase' THEN 'ConfrontationExited'
                 WHEN event_type = 'signup' THEN 'ConfrontationTopicEntered'
                 WHEN event_type = 'error' THEN 'SkillCheckResolved' END AS type,
         [25, 30, 40, 50, 60, 75, 100][(k % 7) + 1] AS bar, CAST(floor(value) AS INTEGER) AS sv
  FROM stream),
telemetry AS (
  SELECT event_id, install_id, session_id, seq, type, ts, ts_us, received_us, env, mod_id, k,
    CASE WHEN type LIKE 'Confrontation%' THEN 's' || CAST(k % 2 AS VARCHAR) END AS suspect,
    CASE WHEN type IN ('ConfrontationAttempted', 'ConfrontationTopicEntered')
         THEN 't' || CAST((k // 2) % 2 AS VARCHAR) END AS topic,
    CASE WHEN type = 'ConfrontationTopicEntered' THEN ['texture', 'fact', 'pattern'][(k % 3) + 1]
         END AS kind,
    CASE WHEN type = 'ConfrontationAttempted' THEN value < 25
         WHEN type = 'SkillCheckResolved' THEN (sv >= bar OR k % 50 = 7) END AS passed,
    CASE WHEN type = 'ConfrontationAttempted' AND NOT value < 25
         THEN 'r' || CAST(k % 4 AS VARCHAR) END AS reason,
    CASE WHEN type = 'ConfrontationExited' THEN k % 2 = 0 END AS completed,
    CASE WHEN type = 'AreaEntered' THEN 'area' || CAST(k % 25 AS VARCHAR) END AS area,
    CASE WHEN type = 'AreaEntered' THEN k % 2 = 0 END AS interior,
    CASE WHEN type = 'SkillCheckResolved' THEN 'chk_' || CAST(k % 8 AS VARCHAR) END AS check_id,
    CASE WHEN type = 'SkillCheckResolved' THEN 'st' || CAST(k % 5 AS VARCHAR) END AS stat,
    CASE WHEN type = 'SkillCheckResolved'
         THEN CASE WHEN k % 2 = 0 THEN 'skill' ELSE 'attribute' END END AS stat_kind,
    CASE WHEN type = 'SkillCheckResolved' THEN bar END AS threshold,
    CASE WHEN type = 'SkillCheckResolved' THEN sv END AS skill_value,
    CASE WHEN type = 'SkillCheckResolved'
         THEN CASE WHEN k % 10 = 9 THEN 'environment' ELSE 'inspect' END END AS trigger,
    CASE WHEN type = 'SkillCheckResolved' THEN sv >= bar END AS threshold_passed,
    CASE WHEN type = 'SkillCheckResolved' AND k % 3 = 0
         THEN 'route' || CAST(k % 4 AS VARCHAR) END AS skill_route
  FROM typed)"""

EXPLORATION = FEED + """,
typed AS (
  SELECT *, CASE WHEN k % 25 = 24 THEN 'Heartbeat'
                 WHEN event_type = 'click' THEN 'ConfrontationAttempted'
                 WHEN event_type = 'view' THEN 'EvidenceCollected'
                 WHEN event_type = 'purchase' THEN 'ItemConsumed'
                 WHEN event_type = 'signup' THEN 'SkillCheckDisplayed'
                 WHEN event_type = 'error' THEN 'SkillCheckResolved' END AS type,
         CAST(floor(value) AS INTEGER) AS sv
  FROM stream),
exploration AS (
  SELECT event_id, install_id, session_id, seq, type, ts, ts_us, received_us, env, mod_id, k,
    CASE WHEN type = 'EvidenceCollected' THEN 'ev' || CAST(k % 6 AS VARCHAR) END AS evidence_id,
    CASE WHEN type = 'ConfrontationAttempted'
         THEN ['ev' || CAST(k % 6 AS VARCHAR), 'ev' || CAST((k + 2) % 6 AS VARCHAR)] END
      AS evidence_ids,
    CASE WHEN type = 'ConfrontationAttempted' THEN 's' || CAST(k % 2 AS VARCHAR) END AS suspect,
    CASE WHEN type = 'ConfrontationAttempted' THEN 't' || CAST((k // 2) % 2 AS VARCHAR) END
      AS topic,
    CASE WHEN type = 'ConfrontationAttempted' THEN value < 25
         WHEN type = 'SkillCheckResolved' THEN sv >= 20 END AS passed,
    CASE WHEN type = 'ItemConsumed' THEN 'part_' || CAST(k AS VARCHAR) END AS item_id,
    CASE WHEN type LIKE 'SkillCheck%' THEN 'chk_' || CAST(k % 4 AS VARCHAR) END AS check_id,
    CASE WHEN type = 'SkillCheckDisplayed' THEN k % 3 END AS display_group,
    CASE WHEN type = 'SkillCheckDisplayed' THEN sv >= 20 END AS threshold_met,
    CASE WHEN type LIKE 'SkillCheck%' THEN 20 END AS threshold,
    CASE WHEN type = 'SkillCheckResolved' THEN sv END AS skill_value,
    CASE WHEN type = 'SkillCheckResolved' THEN sv - CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END END
      AS base_value,
    CASE WHEN type LIKE 'SkillCheck%' THEN 'st' || CAST(k % 5 AS VARCHAR) END AS stat
  FROM typed)"""

CONTENT = """
records AS (
  SELECT 'Part_' || CAST(p_partkey AS VARCHAR) AS record_id, p_brand AS source,
    CASE p_type WHEN 'STANDARD' THEN 'ALCH' WHEN 'SMALL' THEN 'INGR' WHEN 'LARGE' THEN 'SPEL'
                WHEN 'PROMO' THEN 'ENCH' WHEN 'ECONOMY' THEN 'INFO' ELSE 'BOOK' END AS type,
    p_name AS name, p_name AS full_text
  FROM part),
effects AS (
  SELECT 'Part_' || CAST(p_partkey AS VARCHAR) AS record_id, ordinal,
    CASE WHEN (p_partkey + ordinal) % 4 = 0 THEN 'Drain Attribute' ELSE 'Fortify Attribute' END
      AS effect_name,
    'st' || CAST((p_partkey + ordinal) % 5 AS VARCHAR) AS affected,
    CASE WHEN (p_partkey // 5) % 2 = 0 THEN 'skill' ELSE 'attribute' END AS affected_kind,
    CASE WHEN p_type <> 'SMALL' THEN p_size END AS magnitude_min,
    CASE WHEN p_type <> 'SMALL' THEN CAST(p_size + p_partkey % 30 AS INTEGER) END AS magnitude_max,
    CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 30 END AS duration
  FROM (SELECT *, unnest(range(0, p_partkey % 3 + 1)) AS ordinal FROM part
        WHERE p_type IN ('STANDARD', 'SMALL', 'LARGE', 'PROMO'))),
placements AS (
  SELECT 'area' || CAST(s_nationkey AS VARCHAR) AS area, s_nationkey % 2 = 0 AS is_exterior,
    lower('Part_' || CAST(l_partkey AS VARCHAR)) AS item_record_id,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""

DOCS = """
docs AS (
  SELECT doc_id, 'Doc_' || CAST(doc_id AS VARCHAR) AS record_id, source,
    CASE lang WHEN 'en' THEN 'BOOK' WHEN 'fr' THEN 'INFO' WHEN 'de' THEN 'CELL' ELSE 'SKIL' END
      AS type,
    'Document ' || CAST(doc_id AS VARCHAR) AS name, text AS full_text
  FROM documents)"""

PASSAGES = DOCS + """,
lines AS (
  SELECT doc_id, record_id, type, name, source, unnest(parts) AS text,
         unnest(range(0, len(parts))) AS ordinal
  FROM (SELECT *, string_split(full_text, chr(10)) AS parts FROM docs)),
passages AS (
  SELECT record_id || '#' || CAST(ordinal AS VARCHAR) AS chunk_id, record_id,
         ordinal, type, name, source, text, sha256(text) AS text_hash, embedding
  FROM lines LEFT JOIN embeddings ON vec_id = doc_id AND ordinal = 0
  WHERE trim(text) <> '')"""

VECTORS = """
vectors AS (
  SELECT 'Doc_' || CAST(vec_id AS VARCHAR) || '#0' AS chunk_id, vec_id, label,
         CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings),
query_vectors AS (
  SELECT 'vec' || CAST(vec_id AS VARCHAR) AS query_id, v AS q FROM vectors WHERE vec_id % 20 = 0)"""

# One vector for each label, that of its first member.
LABEL_VECTORS = VECTORS[:VECTORS.index("query_vectors AS")] + """
label_vectors AS (
  SELECT 'label' || CAST(label AS VARCHAR) AS query_id, arg_min(v, vec_id) AS q
  FROM vectors GROUP BY label)"""

QUERY_TEXTS = """
query_texts AS (
  SELECT 'b' || CAST(item_id AS VARCHAR) || '-' || CAST(line AS VARCHAR) AS query_id, text
  FROM (SELECT item_id, unnest(parts) AS text, unnest(range(0, len(parts))) AS line
        FROM (SELECT item_id, string_split(text, chr(10)) AS parts FROM benchmark))
  WHERE trim(text) <> '')"""


HYBRID_TEXTS = """
query_texts AS (
  SELECT 'vec' || CAST(doc_id AS VARCHAR) AS query_id, array_to_string(w, ' or ') AS text
  FROM (SELECT doc_id, string_split(string_split(text, chr(10))[1], ' ') AS w
        FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 20 = 0))"""

WEB_TEXTS = QUERY_TEXTS.replace("query_texts AS", "plain_texts AS") + """,
query_texts AS (
  SELECT query_id, CASE WHEN len(w) >= 5
    THEN '"' || w[1] || ' ' || w[2] || '" ' || array_to_string(w[3:len(w) - 1], ' or ') || ' -' || w[len(w)]
    ELSE text END AS text
  FROM (SELECT query_id, text, string_split(text, ' ') AS w FROM plain_texts))"""


def _terms(word: str) -> str:
    return (f"CASE WHEN length({word}) > 4 THEN regexp_replace({word}, '(ing|ed|es|s)$', '') "
            f"ELSE {word} END")


def _kept(word: str) -> str:
    return f"{word} <> '' AND {word} NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})"


def _words(text: str) -> str:
    return f"string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')"


# Brute force: every query word against every position.
LEXICAL = f"""
positions AS (
  SELECT chunk_id, pos, {_terms("word")} AS term
  FROM (SELECT chunk_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos
        FROM (SELECT chunk_id, {_words("text")} AS w FROM passages))
  WHERE {_kept("word")}),
lengths AS (SELECT chunk_id, count(*) AS n_terms FROM positions GROUP BY ALL),
tokens AS (
  SELECT query_id, unnest(t) AS token, unnest(range(0, len(t))) AS clause
  FROM (SELECT query_id, regexp_extract_all(text, '-?"[^"]*"|\\S+') AS t FROM query_texts)),
alts AS (
  SELECT *, sum(CAST(lower(token) = 'or' AS INT)) OVER (PARTITION BY query_id ORDER BY clause)
    AS alt FROM tokens),
query_words AS (
  SELECT query_id, alt, clause, negative, "offset", {_terms("word")} AS term
  FROM (SELECT query_id, alt, clause, starts_with(token, '-') AS negative, unnest(w) AS word,
          unnest(range(0, len(w))) AS "offset"
        FROM (SELECT *, {_words("token")} AS w FROM alts WHERE lower(token) <> 'or'))
  WHERE {_kept("word")}),
idf AS (
  SELECT term, ln(1 + (SELECT count(DISTINCT chunk_id) FROM positions) / count(DISTINCT chunk_id))
    AS idf FROM positions GROUP BY term),
clauses AS (
  SELECT query_id, alt, clause, negative, count(*) AS width, sum(idf) AS weight
  FROM query_words LEFT JOIN idf USING (term) GROUP BY ALL),
wanted AS (
  SELECT query_id, alt, count(*) AS wanted FROM clauses WHERE NOT negative GROUP BY ALL),
lined AS (
  SELECT q.query_id, q.alt, q.clause, p.chunk_id, p.pos - q."offset" AS start, count(*) AS hit
  FROM query_words q JOIN positions p ON p.term = q.term GROUP BY ALL),
satisfied AS (
  SELECT query_id, alt, clause, negative, weight, chunk_id, count(*) AS tf
  FROM lined JOIN clauses USING (query_id, alt, clause) WHERE hit = width GROUP BY ALL),
per_alt AS (
  SELECT query_id, alt, chunk_id, count(*) FILTER (WHERE NOT negative) AS got,
    count(*) FILTER (WHERE negative) AS banned,
    sum(tf * weight / n_terms) FILTER (WHERE NOT negative) AS score
  FROM satisfied JOIN lengths USING (chunk_id) GROUP BY ALL),
scores AS (
  SELECT query_id, chunk_id, round(sum(score), 9) AS score
  FROM per_alt JOIN wanted USING (query_id, alt) WHERE got = wanted AND banned = 0 GROUP BY ALL),
ranked_lexical AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
    AS lexical_rank FROM scores QUALIFY lexical_rank <= 100)"""


def distance_sql(a: str, b: str) -> str:
    return f"round(1 - list_cosine_similarity({a}, {b}), 6)"


def nearest_sql(k: int, keep: str = "true") -> str:
    return f"""
near AS (
  SELECT query_id, chunk_id, {distance_sql("q", "v")} AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY {distance_sql("q", "v")}, chunk_id)
      AS vector_rank
  FROM query_vectors, vectors WHERE {keep} QUALIFY vector_rank <= {k})"""


def sql(*views: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(views) + body
