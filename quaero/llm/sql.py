"""DuckDB SQL that the queries' rows must equal."""

from quaero.llm import licenses, sharding

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + UPPER.lower() + "'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

# Proximity: each of the three rarest words within five words of where the rarest one puts it.
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
g AS (SELECT item_id, list_slice(ws, i, i + 9) AS gram
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
win AS (SELECT gram, len(gram) AS n, gram[1] AS head FROM g GROUP BY gram),
dw AS (SELECT r, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM d),
freq AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
terms AS (SELECT gram, unnest(gram) AS w, unnest(range(0, len(gram))) AS off FROM win),
ranked AS (SELECT gram, w, off, n, row_number() OVER (PARTITION BY gram ORDER BY n, off) AS k,
                  bool_or(n IS NULL) OVER (PARTITION BY gram) AS missing FROM terms LEFT JOIN freq USING (w)),
rare AS (SELECT gram, w, off, k FROM ranked WHERE k <= 3 AND NOT missing),
lead AS (SELECT r, gram, pos - off AS start FROM rare JOIN dw USING (w) WHERE k = 1),
near AS (SELECT l.r, l.gram, l.start, count(DISTINCT k) AS ks FROM lead l JOIN rare o ON o.gram = l.gram AND o.k > 1
         JOIN dw ON dw.r = l.r AND dw.w = o.w AND abs(dw.pos - l.start - o.off) <= 5 GROUP BY ALL),
near_items AS (SELECT r, count(DISTINCT item_id) AS n_near
               FROM (SELECT l.r, l.gram FROM lead l JOIN (SELECT gram, max(k) AS ks FROM rare GROUP BY gram) m USING (gram)
                     LEFT JOIN near n ON n.r = l.r AND n.gram = l.gram AND n.start = l.start
                     WHERE coalesce(n.ks, 0) = m.ks - 1)
               JOIN g USING (gram) GROUP BY r),
hits AS (SELECT dw.r, dw.pos, win.gram, win.n FROM dw JOIN win ON win.head = dw.w JOIN d ON d.r = dw.r
         WHERE list_slice(d.ws, dw.pos + 1, dw.pos + win.n) = win.gram),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, list(DISTINCT CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL) AS ids
          FROM hits JOIN g USING (gram) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r) LEFT JOIN near_items USING (r)
"""

_TEMPLATES = ", ".join(
    f"({i}, '{label}', {licenses.template_tokens(text)!r}, {2 * len(licenses.template_words(text))})" for i, (label, text) in enumerate(licenses.TEMPLATES)
)
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())

LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {WORDS} AS ws FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM d),
blocks AS (SELECT DISTINCT r, list_distinct({WORDS}) AS ws FROM lines),
t(id, label, tokens, span) AS (VALUES {_TEMPLATES}),
p(phrase, label) AS (VALUES {_PHRASES}),
told AS (SELECT r, ws, id, label, tokens, span, unnest(range(0, len(ws))) AS i
         FROM d, t WHERE len(list_intersect(list_distinct(ws), tokens)) >= ceil(0.8 * len(tokens) - 1e-9)),
runs AS (SELECT r, label, max(len(list_intersect(list_distinct(list_slice(ws, i + 1, i + span)), tokens))) AS n, any_value(len(tokens)) AS size
         FROM told WHERE list_contains(tokens, ws[i + 1]) GROUP BY r, id, label),
held AS (SELECT r, label, len(list_intersect(ws, tokens)) AS n, len(tokens) AS size
         FROM blocks, t WHERE len(list_intersect(ws, tokens)) >= ceil(0.8 * len(tokens) - 1e-9)
         UNION ALL SELECT r, label, n, size FROM runs WHERE n >= ceil(0.8 * size - 1e-9)),
dw AS (SELECT r, ws, unnest(range(0, len(ws))) AS pos FROM d WHERE list_contains(ws, 'license')),
places AS (SELECT r, pos, label FROM dw, p WHERE list_slice(ws, pos + 1, pos + len(phrase)) = phrase),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS z FROM places GROUP BY r),
names AS (SELECT r, label, true AS is_base FROM places UNION SELECT r, label, false FROM held),
named AS (SELECT r, list(DISTINCT label ORDER BY label) AS labels,
                 list(DISTINCT label ORDER BY label) FILTER (is_base) AS base_labels FROM names GROUP BY r),
best AS (SELECT r, max(n / size) AS part FROM held GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
       CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels,
       CAST(CASE WHEN coalesce(base.n, 0) > 0 THEN 1.0 ELSE coalesce(part, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""

_BITS = " || ".join(f"lpad(bin(CAST('0x' || substr(h, {at}, 8) AS BIGINT)), 32, '0')" for at in (1, 9, 17, 25))


def sharding_sql(limit: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest FROM documents),
c AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, digest,
             row_number() OVER (PARTITION BY doc_id, digest) - 1 AS copy FROM d),
h AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest || '|' || copy) AS h FROM c),
b AS (SELECT doc_id, copy, n_bytes, {_BITS} AS bits FROM h),
level AS (
  SELECT *, 0 AS depth, sum(n_bytes) OVER () AS shard_bytes, count(*) OVER () AS shard_rows FROM b
  UNION ALL
  SELECT doc_id, copy, n_bytes, bits, depth + 1, sum(n_bytes) OVER (PARTITION BY left(bits, depth + 1)),
         count(*) OVER (PARTITION BY left(bits, depth + 1))
  FROM level WHERE shard_bytes > {limit} AND shard_rows > 1 AND depth < 128
)
SELECT doc_id, CAST(copy AS BIGINT) AS copy, n_bytes, left(bits, depth) AS shard, CAST(depth AS INT) AS depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM level WHERE shard_bytes <= {limit} OR shard_rows = 1 OR depth = 128
"""


SHARDING = sharding_sql(sharding.QUERY_BYTES)

_PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ""),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ""),
    ("card", r"[0-9]([\x20-]?[0-9])+", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ""),
    ("iban", r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[0-9]{1,3})?", ""),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"\bssn\b|social security"),
]
_MATCHES = " UNION ALL ".join(
    f"SELECT r, {k} AS kind_no, '{name}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS m, "
    f"unnest(regexp_split_to_array(text, '{pattern}')) AS gap, "
    f"generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) AS i FROM d"
    for k, (name, pattern, _) in enumerate(_PLAIN)
)
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, k: CASE WHEN k % 2 = 1 THEN CAST(c AS INT) "
    "ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_IBAN = "replace(m, ' ', '')"
_MOD97 = (
    f"list_reduce(list_prepend(0, list_transform(string_split(substr({_IBAN}, 5) || left({_IBAN}, 4), ''), "
    "lambda c: CAST(CASE WHEN c < 'A' THEN ord(c) - 48 ELSE 1000 + ord(c) - 55 END AS INT))), "
    "lambda a, v: CAST((CASE WHEN v >= 1000 THEN a * 100 + v - 1000 ELSE a * 10 + v END) % 97 AS INT)) = 1"
)

PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT * FROM ({_MATCHES}) WHERE m IS NOT NULL),
ends AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, kind_no ORDER BY i) AS BIGINT) AS e FROM m),
placed AS (SELECT ends.*, text FROM ends JOIN d USING (r)),
kept AS (SELECT r, kind_no, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE CASE kind
  WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda p: TRY_CAST(p AS HUGEINT))) <= 255
  WHEN 'card' THEN length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}
  WHEN 'phone' THEN length({_DIGITS}) BETWEEN 8 AND 15
  WHEN 'iban' THEN {_MOD97}
  WHEN 'ssn' THEN regexp_matches(lower(right(left(text, e - length(m)), 40) || ' ' || substr(text, e + 1, 40)), '{_PLAIN[5][2]}')
  ELSE true END),
per AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (kind = 'ssn') AS n_ssn,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind_no, s) FILTER (kind_no < 4) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind_no, s) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn
FROM d LEFT JOIN per USING (r)
"""

HARD_NEGATIVES = """
with rows as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.row as anchor, a.vec_id as anchor_id, r.vec_id, r.label = a.label as same,
         cast(list_inner_product(a.v, r.v) as bigint) as score
  from rows a join rows r on a.row <> r.row and len(a.v) = len(r.v)
  where a.vec_id % 50 = 0
),
positives as (
  select anchor, anchor_id, vec_id, score, row_number() over (partition by anchor order by score desc, vec_id) as place
  from scored where same
  qualify place <= 5
),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor, p.place order by n.score desc, n.vec_id) as rank
  from positives p join scored n on n.anchor = p.anchor and not n.same
  where 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""
