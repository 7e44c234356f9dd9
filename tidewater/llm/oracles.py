"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Windows of 13 words by their text; a word goes if a window over it also starts in a smaller document.
SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM p),
least_id AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s),
hit AS (SELECT DISTINCT k.doc_id, k.i + o.j AS i FROM k JOIN least_id USING (s), (SELECT unnest(range(0, 13)) AS j) o WHERE m < k.doc_id),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN hit USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_MARKS = "<turn>|<body>|</turn>|### User:|### Assistant:|### System:"


def _escaped(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '(\\*)({_MARKS})', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')"


CHAT_FORMATTING = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(19 + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars FROM t GROUP BY 1"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
k AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM k), (SELECT unnest(range(0, 5)) AS j) WHERE c > 1 GROUP BY 1),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z\x{{C0}}-\x{{10FFFF}}]', '', 'g')) AS n_letters FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 4 * n_symbols > n_words OR (n_letters >= 40 AND 2 * n_upper > n_letters)
  OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 30 * n_words))) AS kept FROM b"""

EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE len(v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
x AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM x"""


def _visible(c: str) -> str:
    return rf"CASE WHEN NOT regexp_full_match({c}, '[\x20\x09-\x0D]*') THEN {c} END AS {c}"


_RECENT = "updated_at DESC NULLS LAST, trust DESC, client_id NULLS LAST"
_TRUSTED = f"stale, trust DESC, {_RECENT}"


def _winner(fields: str, source: str, where: str, order: str, table: str = "s") -> str:
    return f"SELECT cluster_id AS k, {fields}, client_id AS {source} FROM {table} WHERE {where} QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY {order}) = 1"


#: Each field's first record by its own order, over all records of a cluster.
GOLDEN_RECORDS = rf"""
WITH r AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, CASE source WHEN 'partner' THEN 4 WHEN 'store' THEN 3 WHEN 'web' THEN 2 WHEN 'crm' THEN 1 ELSE 0 END AS trust,
  {_visible("name")}, {_visible("email")}, {_visible("segment")}, {_visible("city")}, nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance FROM clients),
s AS (SELECT *, updated_at IS NULL OR epoch_us(max(updated_at) OVER (PARTITION BY cluster_id)) - epoch_us(updated_at) > 2592000000000 AS stale,
  CAST(city IS NOT NULL AS INT) + CAST(nation_id IS NOT NULL AS INT) AS filled FROM r),
c AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale FROM s GROUP BY 1),
n AS ({_winner("name", "name_from", "name IS NOT NULL", f"length(name) DESC, {_TRUSTED}, name")}),
e AS ({_winner("email", "email_from", "email IS NOT NULL", f"{_TRUSTED}, email")}),
g AS ({_winner("segment", "segment_from", "segment IS NOT NULL", f"{_RECENT}, segment")}),
a AS ({_winner("city, nation_id", "address_from", "filled > 0", f"filled DESC, {_TRUSTED}, city NULLS LAST, nation_id NULLS LAST")}),
t AS (SELECT s.*, g.segment IS NOT DISTINCT FROM s.segment AS chosen FROM s LEFT JOIN g ON g.k IS NOT DISTINCT FROM s.cluster_id),
b AS ({_winner("balance", "balance_from", "balance IS NOT NULL", f"chosen DESC, {_RECENT}, balance", "t")})
SELECT cluster_id, n_records, n_stale, name, email, segment, city, nation_id, CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents, name_from, email_from, segment_from, balance_from, address_from
FROM c LEFT JOIN n ON n.k IS NOT DISTINCT FROM cluster_id LEFT JOIN e ON e.k IS NOT DISTINCT FROM cluster_id LEFT JOIN g ON g.k IS NOT DISTINCT FROM cluster_id
LEFT JOIN a ON a.k IS NOT DISTINCT FROM cluster_id LEFT JOIN b ON b.k IS NOT DISTINCT FROM cluster_id"""

#: All phrases of 1 to 4 words, counted as text.
COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE k >= 2),
t AS (SELECT lang, k, phrase, a, v, unnest(range(1, k)) AS j FROM c),
s AS (SELECT t.lang, t.phrase, a, j, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score FROM t
  JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(v[1 : j], ' ') JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(v[j + 1 : t.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
u AS (SELECT lang, v, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k),
o AS (SELECT lang, array_to_string(v[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM u GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000"""
