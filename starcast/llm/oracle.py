"""The text queries that SQL can express, for DuckDB. The others are tested against brute force in ``tests/llm``.

Left out: token ids, similarity search, alignment and learned models have no SQL; the near-duplicate and repeated-byte
queries compare all pairs or all positions in SQL, which is too slow on whole tables; Spark's hash, which decides the
fingerprints, has no counterpart.
"""

URL_FILTERS = r"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, min({'n': -length(rule_host || rule_path), 'rule': rule_host || rule_path,
                          'verdict': rule_verdict}) AS best
  FROM (SELECT DISTINCT host, path FROM parsed)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.best.rule AS rule, coalesce(b.best.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

LINE_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, n AS line, trim(parts[n], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS content
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM cut)
), counted AS (
  SELECT doc_id, line, content, len(regexp_extract_all(content, '\S+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k,
         sum(len(regexp_extract_all(content, '\S+'))) OVER (PARTITION BY doc_id ORDER BY line) AS upto
  FROM lines WHERE content <> ''
), windows AS (
  SELECT a.doc_id, a.line, max(b.line) AS last, string_agg(b.content, chr(10) ORDER BY b.line) AS content
  FROM counted a JOIN counted b
    ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 19 AND b.upto - b.words - (a.upto - a.words) < 20
  GROUP BY a.doc_id, a.line HAVING sum(b.words) >= 20
  UNION
  SELECT a.doc_id, min(b.line), a.line, string_agg(b.content, chr(10) ORDER BY b.line)
  FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 19 AND a.k AND a.upto - b.upto < 20
  GROUP BY a.doc_id, a.line HAVING sum(b.words) >= 20
), later AS (
  SELECT doc_id, line, last,
         row_number() OVER (PARTITION BY content ORDER BY doc_id, line) AS place
  FROM windows
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(line, last + 1)))) AS lines FROM later WHERE place > 1 GROUP BY doc_id
), kept AS (
  SELECT c.doc_id, coalesce(len(g.lines), 0) AS n_lines_removed,
         CASE WHEN g.lines IS NULL THEN c.text
              ELSE coalesce(array_to_string([c.parts[n] FOR n IN range(1, len(c.parts) + 1)
                                    IF NOT list_contains(g.lines, n)], chr(10)), '') END AS text
  FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id
)
SELECT doc_id, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(length(text) AS BIGINT) AS n_kept_chars,
       sha256(text) AS kept_sha256
FROM kept
"""

SUBSTRING_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM cut)
), firsts AS (
  SELECT content, min(doc_id) AS low FROM windows GROUP BY content
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (content) WHERE low < doc_id
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM cut) a
  ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
)
SELECT c.doc_id, CAST(len(c.words) AS BIGINT) AS n_words, CAST(len(c.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id
"""

CONVERSATION_TRIE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, codes), lambda crc, code: list_reduce(
           list_prepend(xor(crc, code), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda x, bit: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 4 AS h
  FROM (SELECT conv_id, max(i) + 1 AS n,
               list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT) AS codes
        FROM turns GROUP BY conv_id)
), rebuilt AS (
  SELECT c.conv_id, t.i + 1 AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.i - c.h + 1, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h LEFT JOIN convs b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, depth, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS up, key, words
  FROM (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
               md5(string_agg(md5(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key
        FROM rebuilt)
  UNION ALL
  SELECT conv_id, 0, NULL, '', 0 FROM convs
), nodes AS (
  SELECT key, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved
  FROM prefixes GROUP BY key, depth
), children AS (
  SELECT up AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up
), sums AS (
  SELECT p.key, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum(m.saved) AS saved
  FROM nodes m LEFT JOIN children c ON m.key = c.key JOIN prefixes p ON p.conv_id = m.conv_id AND p.depth <= m.depth
  GROUP BY p.key
), ends AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest
  FROM (SELECT conv_id, arg_max(key, depth) AS key FROM prefixes GROUP BY conv_id) GROUP BY key
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON v.up = u.key LEFT JOIN children c ON v.key = c.key
     JOIN sums s ON v.key = s.key LEFT JOIN ends e ON v.key = e.key
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words)) AS n FROM cut GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM cut, (VALUES (1), (2), (3), (4)) s(k))
  GROUP BY lang, k, phrase HAVING count(*) >= 30
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM grams WHERE k > 1
), inside AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, words, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3)) s(m) WHERE m < k)
  GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, a, j, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) LEFT JOIN inside USING (lang, phrase)
  WHERE most IS NULL OR 100 * most < 80 * a
), scored AS (
  SELECT c.lang, c.phrase, c.a, min({'score': (2000000::HUGEINT * c.a) // (h.a + t.a), 'j': c.j, 'l': h.a, 'r': t.a}) AS low
  FROM cuts c JOIN grams h ON c.lang = h.lang AND c.head = h.phrase JOIN grams t ON c.lang = t.lang AND c.tail = t.phrase
  GROUP BY c.lang, c.phrase, c.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY low.score DESC, a DESC, phrase) AS rank FROM scored
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(low.l AS BIGINT) AS l, CAST(low.r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(low.score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE = {
    "op3_line_dedup": LINE_DEDUP,
    "op6_url_filters": URL_FILTERS,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op12_collocations": COLLOCATIONS,
    "op13_substring_dedup": SUBSTRING_DEDUP,
}
