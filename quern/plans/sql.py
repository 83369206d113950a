"""Common table expressions for the SQL of the overlay."""

KNOWLEDGE = """knowledge AS (SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS content, d.source AS entity_name,
 CASE WHEN coalesce(l.toxic,0)=1 THEN 'conflicted' WHEN l.quality=1 THEN 'user_confirmed' ELSE 'provisional' END AS trust,
 coalesce(l.toxic,0)<>1 AS active FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)"""
SOURCES = """sources AS (SELECT doc_id AS knowledge_id, 'supports' AS relation, CASE WHEN quality=1 THEN 'accepted' ELSE 'unresolved' END AS resolution FROM labels
 UNION ALL SELECT doc_id, 'contradicts', 'accepted' FROM labels WHERE toxic=1)"""
QUESTIONS = """questions AS (SELECT item_id AS qid, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 12), ' ') AS question FROM benchmark)"""
MESSAGES = """messages AS (SELECT c.conv_id, c.turn, c.role AS author, coalesce(c.text,'') AS text,
 row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS idx, r.root_author FROM conversations c
 LEFT JOIN (SELECT conv_id, arg_min(role, turn) AS root_author FROM conversations WHERE role <> 'system' GROUP BY conv_id) r ON c.conv_id = r.conv_id)"""
VERSIONS = """versions AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version_no,
 lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS previous_id FROM documents)"""
BLOCKS = """blocks AS (SELECT doc_id, source, u.i - 1 AS block_no, u.t AS text FROM (SELECT doc_id, source, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) AS z FROM documents) q,
 LATERAL (SELECT z[1] AS i, z[2] AS t) u WHERE u.t <> '')"""
EDGES = """edges AS (SELECT 'R'||n_regionkey AS parent, 'N'||n_nationkey AS child FROM nation UNION ALL SELECT 'N'||c_nationkey, 'C'||c_custkey FROM customer
 UNION ALL SELECT 'N'||s_nationkey, 'S'||s_suppkey FROM supplier)"""
RUNS = """runs AS (SELECT event_id AS run_id, user_id, event_type, ts AS created_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'answered'
 WHEN 'click' THEN 'needs_clarification' WHEN 'signup' THEN 'no_knowledge' ELSE 'started' END AS status, value, CAST(props->>'$.k' AS BIGINT) AS knowledge_id FROM events)"""
CANDIDATES = """candidates AS (SELECT p_partkey AS id, 'CASE-'||lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS candidate_id, p_type AS knowledge_key, p_name AS title,
 p_brand AS brand, p_size AS size, coalesce(frequency, 0) AS frequency FROM part LEFT JOIN (SELECT l_partkey, count(*) AS frequency FROM lineitem GROUP BY 1) i ON p_partkey = l_partkey)"""
TOKEN = r"[A-Za-z0-9][A-Za-z0-9./()_-]*|[\x{0400}-\x{04ff}]+|[\x{4e00}-\x{9fff}]"


def tokens(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda x: lower(x)))"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "
