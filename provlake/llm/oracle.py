"""DuckDB SQL for the operators' queries."""

_WORD = r"[^\x20\x09-\x0D]+"

#: The rows' counts; doc_id is unique in the tables this runs on.
_COUNTS = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '{_WORD}') AS words FROM d),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, words[i:i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM twice) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))"""

_QUARTILES = """
SELECT {by} measure, docs,
  CASE WHEN b1 < 32 THEN b1 ELSE (b1 - (b1 // 16 - 1) * 16) << (b1 // 16 - 1)::INT END AS q1,
  CASE WHEN b2 < 32 THEN b2 ELSE (b2 - (b2 // 16 - 1) * 16) << (b2 // 16 - 1)::INT END AS q2,
  CASE WHEN b3 < 31 THEN b3 ELSE ((b3 + 1 - ((b3 + 1) // 16 - 1) * 16) << ((b3 + 1) // 16 - 1)::INT) - 1 END AS q3
FROM (SELECT {by} measure, max(docs) AS docs, min(CASE WHEN 4 * upto >= docs THEN bucket END) AS b1,
    min(CASE WHEN 4 * upto >= 2 * docs THEN bucket END) AS b2, min(CASE WHEN 4 * upto >= 3 * docs THEN bucket END) AS b3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by} measure) AS docs
    FROM (SELECT {by} measure, bucket, count(*) AS n FROM buckets GROUP BY {by} measure, bucket))
  GROUP BY {by} measure)"""

_DRAWN = "(o.docs * o.q{0} + 200 * p.q{0}) // (o.docs + 200) AS q{0}"

_OP1 = f"""
WITH {_COUNTS},
values_ AS (
  SELECT doc_id, lang, source, n_words, unnest([
    {{'measure': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1)}},
    {{'measure': 'lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1)}},
    {{'measure': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1)}},
    {{'measure': 'chars', 'v': 1000 * word_chars // greatest(n_words, 1)}},
    {{'measure': 'n_words', 'v': n_words}}, {{'measure': 'n_lines', 'v': n_lines}}]) AS m FROM counts),
measured AS (SELECT doc_id, lang, source, n_words, m.measure AS measure, m.v::BIGINT AS v FROM values_),
buckets AS (
  SELECT *, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END AS bucket
  FROM measured WHERE n_words > 0),
whole AS ({_QUARTILES.format(by="")}),
bylang AS (
  SELECT o.lang, o.measure, {", ".join(map(_DRAWN.format, (1, 2, 3)))} FROM ({_QUARTILES.format(by="lang,")}) o JOIN whole p USING (measure)),
own AS (
  SELECT o.lang, o.source, o.measure, {", ".join(map(_DRAWN.format, (1, 2, 3)))}
  FROM ({_QUARTILES.format(by="lang, source,")}) o JOIN bylang p USING (lang, measure)),
limits AS (
  SELECT q.lang, q.source, q.measure, q.q1, q.q3,
    5 * greatest(q.q3 - q.q1, 1000 * (CASE q.measure WHEN 'repeats' THEN 6 ELSE 1 END) // greatest(l.q2, 1)) AS width
  FROM own q JOIN own l ON q.lang = l.lang AND q.source = l.source AND l.measure = CASE q.measure WHEN 'lines' THEN 'n_lines' ELSE 'n_words' END
  WHERE q.measure NOT IN ('n_words', 'n_lines')),
beyond AS (
  SELECT m.doc_id, bool_or(m.v > q3 + width OR (m.measure = 'chars' AND m.v < q1 - width)) AS failed
  FROM measured m JOIN limits f ON m.lang = f.lang AND m.source = f.source AND m.measure = f.measure
  GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(failed, false) AS kept
FROM counts LEFT JOIN beyond USING (doc_id)"""

_WORD9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD9}') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD9}') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n)),
met AS (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM met) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_ESCAPED = r"regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')"

_OP7 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' FROM (SELECT unnest([0, 1]) AS i)),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED}) + CASE WHEN opens THEN length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 ELSE length('<|im_next|>') END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""

ORACLE = {"op7_chat": _OP7, "op8_warc": _OP8, "op1_quality_rules": _OP1, "op9_decontamination": _OP9}


def _op11(k: int = 16, dims: int = 64, rounds: int = 3, seed: int = 1, scale: int = 64) -> str:
    """Lloyd's rounds by comparing every vector with every centroid; a distance and a number make one key, so that the smaller number wins ties."""
    order = f"sha256('{seed}:' || vec_id) NULLS LAST, v"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT c - 1 AS c, v AS m FROM (SELECT v, row_number() OVER (ORDER BY {order}) AS c FROM kept) WHERE c <= {k})"""
    ]
    for i in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({gap} * {k} + c) AS key FROM kept, c{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS m
  FROM (SELECT key % {k} AS c, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT key, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY ALL) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(list_transform(m{i}.m, lambda x: x::BIGINT), c{i}.m) AS m FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return f"""WITH {", ".join(parts)}, t AS (SELECT vec_id, (key % {k})::INT AS cluster, (key // {k})::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM t JOIN c{rounds} ON c = cluster"""


ORACLE["op11_centroids"] = _op11()
