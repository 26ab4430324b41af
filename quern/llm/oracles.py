"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

OP10_MIXING = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / coalesce(w.weight, 1.0) AS key
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id) w USING (doc_id)
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound, turn_weight::DOUBLE AS weight FROM (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS turn_weight FROM sources)
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY bound / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM weighted
), targets AS (
  SELECT source, source_size, least(coalesce(max(CASE WHEN own_level * weight <= bound THEN own_level END) OVER () * weight, bound), bound) AS target FROM levels
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, round(p.target)::BIGINT - p.epochs * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""


OP1_MINHASH_DEDUP = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reached r LEFT JOIN sizes s USING (doc_id) GROUP BY r.doc_id
"""

OP6_DECONTAMINATION = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), worded AS (
  SELECT kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM split
), windows AS (
  SELECT DISTINCT id AS item_id, least(len(words), 10) AS size, array_to_string(words[i : i + 9], ' ') AS body FROM (SELECT id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM worded WHERE kind = 'b' AND len(words) > 0)
), places AS (
  SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS body FROM (
    SELECT d.id AS doc_id, d.words, s.size, unnest(range(1, len(d.words) - s.size + 2)) AS i FROM worded d, (SELECT DISTINCT size FROM windows) s WHERE d.kind = 'd')
), hits AS (
  SELECT p.doc_id, p.i, p.size, w.item_id FROM places p JOIN windows w ON w.size = p.size AND w.body = p.body
), hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.id AS doc_id, len(d.words) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(h.n, 0) AS n_items, sha256(coalesce(h.items, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM worded d LEFT JOIN hit_words w ON w.doc_id = d.id LEFT JOIN hit_items h ON h.doc_id = d.id WHERE d.kind = 'd'
"""


OP11_LANGUAGE_ID = r"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, text, lang,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, ignored: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents
), split AS (
  SELECT row, lang, xor(crc, 4294967295) % 4 = 2 AS held_out, ' ' || lower(unnest(regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*'))) || ' ' AS word FROM rows
), words AS (
  SELECT row, lang, held_out, word, count(*) AS n FROM split GROUP BY ALL
), runs AS (
  SELECT row, lang, held_out, n, word, unnest(range(1, length(word) + 1)) AS i FROM words
), grams AS (
  SELECT row, lang, held_out, n, unicode(word[i]) AS gram FROM runs WHERE word[i] <> ' '
  UNION ALL SELECT row, lang, held_out, n, unicode(word[i]) * 2097152 + unicode(word[i + 1]) FROM runs WHERE i < length(word)
  UNION ALL SELECT row, lang, held_out, n, unicode(word[i]) * 4398046511104 + unicode(word[i + 1]) * 2097152 + unicode(word[i + 2]) FROM runs WHERE i < length(word) - 1
), learned AS (
  SELECT lang, gram, sum(n) AS n FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram
), profiles AS (
  SELECT lang, gram, avg(pos) OVER (PARTITION BY lang, n) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS pos FROM learned) WHERE pos <= 1500
), own AS (
  SELECT row, gram, avg(pos) OVER (PARTITION BY row, n) - 1 AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY n DESC, gram) AS pos FROM (SELECT row, gram, sum(n) AS n FROM grams GROUP BY row, gram)) WHERE pos <= 400
), near AS (
  SELECT o.row, p.lang, count(*) AS n, sum(least(abs(o.place - p.place), 1500)) AS apart FROM own o JOIN profiles p USING (gram) GROUP BY o.row, p.lang
), distances AS (
  SELECT s.row, l.lang, (coalesce(n.apart, 0) + 1500.0::DOUBLE * (s.n - coalesce(n.n, 0))) / (1500 * s.n) AS distance
  FROM (SELECT row, count(*) AS n FROM own GROUP BY row) s CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN near n ON n.row = s.row AND n.lang = l.lang
), best AS (
  SELECT row, lang, distance FROM distances QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, lang) = 1
)
SELECT r.doc_id, xor(r.crc, 4294967295) % 4 = 2 AS held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - b.distance, 0.0)::DOUBLE AS score FROM rows r LEFT JOIN best b USING (row)
"""

OP12_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), places AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), counts AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS n FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::HUGEINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, n AS a FROM counts WHERE k > 1 AND n >= 100
), maximal AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, a, j, array_to_string(words[1 : j], ' ') AS first, array_to_string(words[j + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM maximal)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.n AS l, y.n AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.n::HUGEINT * y.n) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

OP13_HARD_NEGATIVES = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": OP1_MINHASH_DEDUP, "op6_decontamination": OP6_DECONTAMINATION, "op10_mixing": OP10_MIXING,
        "op11_language_id": OP11_LANGUAGE_ID, "op12_phrases": OP12_PHRASES, "op13_hard_negatives": OP13_HARD_NEGATIVES,
    }
