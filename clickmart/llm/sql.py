"""What the registered queries give, in SQL for DuckDB, where SQL can express it on a whole small table."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

CURRICULUM = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
sources AS (
  SELECT row_number() OVER (ORDER BY source NULLS LAST) AS number, source, source_size, CAST(3 * source_size AS DOUBLE) AS most
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
weights AS (SELECT *, CAST((number - 1) % 3 + 1 AS DOUBLE) AS weight FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) - coalesce(sum(most) OVER (
      ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weights),
targets AS (
  SELECT source, source_size, weight, least(most, (SELECT max(level) FROM levels WHERE level <= most / weight) * weight) AS target
  FROM weights),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.weight, t.target, CAST(floor(t.target) AS BIGINT) AS whole,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
pieces(weight, area_before, start_at, w, slope) AS (
  VALUES (1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.5::DOUBLE, -1.0::DOUBLE), (2.0, 0.0, 0.0, 1.0, 2.0),
    (3.0, 0.0, 0.0, 1.5, 6.0), (3.0, 1.5, 0.5, 4.5, -6.0)),
asked AS (
  SELECT *, CASE WHEN least(whole - start, size) > 0 THEN start / target * weight END AS asked,
    CAST(greatest(least(whole - start, size), 0) + greatest(least(whole - source_size - start, size), 0)
      + greatest(least(whole - 2 * source_size - start, size), 0) AS BIGINT) AS taken
  FROM placed),
timed AS (
  SELECT a.*, p.start_at, p.w, p.slope, a.asked - p.area_before AS rest
  FROM asked a LEFT JOIN pieces p ON p.weight = a.weight AND p.area_before <= a.asked
    AND NOT (p.area_before = 0 AND a.weight = 3 AND a.asked >= 1.5))
SELECT doc_id, size, source_size, target, taken, coalesce(CAST(floor(
    CASE WHEN rest > 0 THEN start_at + 2 * rest / (w + sqrt(w * w + 2 * slope * rest)) ELSE start_at END * 1000000000.0::DOUBLE) AS BIGINT), -1)
    AS first_place
FROM timed
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({TEXT_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS lengths(k) WHERE len(w) >= k),
counted AS (
  SELECT lang, CAST(k AS INTEGER) AS k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM places GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT *, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, t.n, c.j,
    CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM counted m WHERE m.lang = s.lang AND m.k > s.k AND 100 * m.a >= 100 * s.a
      AND contains(' ' || m.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM held QUALIFY rank <= 2000
"""

LEXICAL_SEARCH = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all({TEXT_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT row_number() OVER () AS d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM split WHERE len(terms) > 0),
held AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, size GROUP BY term, docs),
asked AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all({TEXT_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
  GROUP BY ALL),
scores AS (
  SELECT q.i, q.item_id, d.doc_id,
    CAST(sum(q.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (25 + (75 * d.n * s.docs) // s.terms)))) AS BIGINT) AS score
  FROM asked q JOIN held h ON h.term = q.term JOIN weights w ON w.term = q.term JOIN docs d ON d.d = h.d, size s
  GROUP BY q.i, q.item_id, d.d, d.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

LINE_DEDUP = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents),
lines AS (SELECT r, doc_id, unnest(split) AS line, unnest(range(len(split))) AS i FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT k.*, coalesce(k.doc_id > p.first, false) AS dropped FROM keyed k LEFT JOIN repeated p ON p.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""

QUALITY_RULES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
of_words AS (
  SELECT r, count(*) FILTER (word = before) AS n_stutters, max(strlen(word)) AS longest
  FROM (SELECT r, word, lag(word) OVER (PARTITION BY r ORDER BY i) AS before FROM words) GROUP BY r),
windows AS (
  SELECT r, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 7)) AS i FROM docs WHERE len(w) > 7)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) AS t(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
of_lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_open
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words,
    coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_open, 0) AS n_open, coalesce(o.n_stutters, 0) AS n_stutters,
    coalesce(o.longest, 0) AS longest, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
    regexp_matches(t, '(?i:lorem ipsum|\bjavascript (is|must be) (disabled|enabled))') AS placeholder
  FROM docs d LEFT JOIN of_words o USING (r) LEFT JOIN of_lines l USING (r) LEFT JOIN repeats p USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_stutters > 30 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_upper > n_lower OR 2 * n_digits > word_chars
    OR 100 * n_open > 50 * n_lines OR longest > 5000 OR placeholder) AS kept
FROM judged
"""
