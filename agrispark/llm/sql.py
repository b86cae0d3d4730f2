"""SQL twins of the training-data queries, where SQL can express them.

Not expressible: subword pieces and merges (1, 8), crc32 folds and learnt models (3, 5, 10), phrase parsing (6), image
files (9), flows over stored blocks (12). Those are tested against brute force, exact round trips and held-out accuracy.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SOURCE_MIX = f"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, len({_WORDS.format(text="text")})::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS shuffled
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[(place % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2::DOUBLE AS cap
  FROM sources
), filled AS (
  SELECT *, cap / weight AS ratio,
         sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER earlier, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS rest_weight
  FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levelled AS (
  SELECT *, max(CASE WHEN ratio > rest / rest_weight THEN rest / rest_weight END) OVER () AS level FROM filled
), targets AS (
  SELECT source, source_size, weight, least(cap, coalesce(weight * level, cap)) AS target FROM levelled
), served AS (
  SELECT s.*, t.source_size, t.weight, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queued AS (
  SELECT *, sum(size) OVER (
           ORDER BY (served + pass * source_size)::DOUBLE / weight, coalesce(source, ''), source IS NULL, pass, shuffled, doc_id, size, served
           ROWS UNBOUNDED PRECEDING) AS queue
  FROM served, range(2) AS passes(pass)
)
SELECT doc_id, size, source_size, target,
       (size * count(*) FILTER (WHERE queue <= (SELECT sum(size)::DOUBLE * 1.5 FROM sized)))::BIGINT AS taken
FROM queued GROUP BY row, doc_id, size, source_size, target
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM words, unnest(range(1, len(w))) AS t(i) WHERE len(w) > 1
  UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))
), near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, near.b FROM reached JOIN near ON reached.other = near.a
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM reached d LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""

REPEATED_PASSAGES = f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM words, unnest(range(1, len(w) - 48)) AS t(p) WHERE len(w) >= 50
), firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (h), unnest(range(p, p + 50)) AS t(i) WHERE doc_id > least
), kept AS (
  SELECT k.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k.i) AS text
  FROM (SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(i)) k
  LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i WHERE g.i IS NULL GROUP BY k.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""



def _code_round(k: int) -> str:
    """Nearest entries in codebook ``b{k}``, then the codebook of the next round; all numbers are integers in doubles."""
    return f"""
assigned{k} AS MATERIALIZED (
  SELECT row, part, v, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.row, p.part, p.v, b.entry,
           list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS d
    FROM parts p JOIN book{k} b ON p.part = b.part
  ) GROUP BY row, part, v
), book{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY pos) AS v FROM (
      SELECT part, entry, pos, floor(sum(x) / count(*)) AS mean
      FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM assigned{k}) GROUP BY ALL
    ) GROUP BY ALL
  ) m USING (part, entry)
)"""


VECTOR_CODES = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS v FROM kept, range(4) AS t(part)
), book0 AS (
  SELECT part, entry, v FROM parts JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, x) - 1 AS entry FROM kept QUALIFY entry < 256) USING (row)
), {", ".join(_code_round(k) for k in range(5))},
digest AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM book4)
), coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assigned4 GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), digest
"""


def _zero_byte_steps() -> list[int]:
    """What a zero byte makes of each value of the low byte of a CRC-32, bit by bit."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


_IMPORTANCE_WORDS = "regexp_extract_all({words}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(words=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")
IMPORTANCE_RANKS = f"""
WITH source AS (SELECT row_number() OVER () AS row, doc_id, {_IMPORTANCE_WORDS} AS w FROM documents),
target AS (SELECT {_IMPORTANCE_WORDS} AS w FROM benchmark),
found AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM source) GROUP BY ALL),
wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM target) GROUP BY ALL),
steps AS MATERIALIZED (SELECT {_zero_byte_steps()}::BIGINT[] AS step),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM found UNION SELECT word FROM wanted)),
bytes AS (
  SELECT word, list_transform(range(1, len(h), 2), lambda i:
    (16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT) AS b FROM words
), hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, steps
), s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM found JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
         / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), weights AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM found JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i:
           instr('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1)), lambda c, x: 16 * c + x) + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM source LEFT JOIN weights USING (row)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM ranked
"""

SQL: dict[str, str] = {
    "op2_source_mix": SOURCE_MIX, "op4_near_duplicates": NEAR_DUPLICATES, "op7_repeated_passages": REPEATED_PASSAGES,
    "op11_vector_codes": VECTOR_CODES, "op13_importance_ranks": IMPORTANCE_RANKS,
}
