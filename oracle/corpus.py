"""Twins of the corpus queries."""

from __future__ import annotations

from agrispark.plans.corpus_queries import BOILERPLATE_EXPR
from agrispark.rules import corpus as rc
from oracle.chunker import chunks_sql
from oracle.common import literal

_SPACE = "[ \\t\\n\\r\\f\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, '[^\\x{{09}}\\x{{0A}}\\x{{20}}-\\x{{7E}}\\x{{A0}}-\\x{{FFFF}}]', ' ', 'g')"
    x = f"regexp_replace({x}, '[ \\t\\r]+', ' ', 'g')"
    return _strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_BAD = "(" + " OR ".join(
    "regexp_matches({x}, " + literal("(?is)^(?:" + p.removeprefix("^") + ")") + ")" for p in rc.BOILERPLATE
) + ")"
_bad = lambda x: _BAD.replace("{x}", x)

_DIRTY = "chr(160) || chr(9) || ' ' || replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10)) || ' ' || chr(7) || chr(8203) || ' ' || chr(13) || chr(10)"
_LINES = f"""cl AS (SELECT doc_id, source, {_clean('text')} AS text FROM documents),
  ln AS (SELECT doc_id, source AS origin, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cl WHERE text <> ''),
  chunks AS (SELECT *, left(sha256('doc' || doc_id || '::page0::chunk' || i || '::' || left(line, 200)), 32) AS chunk_id FROM ln WHERE line <> '')"""

_tokens = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-zA-Z0-9]'), lambda t: length(t) > 1)"
_POST = f"""dt AS (SELECT 'd' || lpad(cast(doc_id AS varchar), 12, '0') AS chunk_id, {_tokens('text')} AS toks FROM documents),
  dl AS (SELECT chunk_id, len(toks) AS doc_len FROM dt),
  stats AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM dl),
  post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
  raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, stats GROUP BY term, n),
  idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_BM25 = f"""{_POST},
  qt AS (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark),
  qw AS (SELECT query_id, term, count(*) AS qf FROM qt GROUP BY ALL),
  sc AS (SELECT query_id, chunk_id, sum(floor(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)) * (qf * idf) * 1e9::DOUBLE + 0.5::DOUBLE)::BIGINT)::DOUBLE / 1e9::DOUBLE AS score
    FROM qw JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), stats GROUP BY ALL),
  sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10),
  sparsen AS (SELECT *, score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1.0 END AS bm25_score FROM sparse)"""

_LETTERS = "[" + ", ".join(f"cast(length(lower(text)) - length(replace(lower(text), '{chr(97 + i)}', '')) AS DOUBLE)" for i in range(26)) + "]"
_UNIT = "list_transform(c, lambda v: floor(coalesce(v / nullif(sqrt(list_sum(list_transform(c, lambda u: u * u))), 0.0), 0.0) * 67108864 + 0.5::DOUBLE))"  # on a grid, so that products add up exactly
_LIKE = "greatest(0.0, (1.0 + list_dot_product({a}, {b}) / 4503599627370496::DOUBLE) / 2.0)"
_RRF = f"""{_BM25},
  dv AS (SELECT chunk_id, {_UNIT} AS e FROM (SELECT 'd' || lpad(cast(doc_id AS varchar), 12, '0') AS chunk_id, {_LETTERS} AS c FROM documents)),
  qv AS (SELECT query_id, {_UNIT} AS e FROM (SELECT item_id AS query_id, {_LETTERS} AS c FROM benchmark)),
  ds AS (SELECT query_id, chunk_id, {_LIKE.format(a="qv.e", b="dv.e")} AS dense_score FROM qv, dv),
  dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 10),
  fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60.0 + rank)) AS rrf, max(dense_score) AS dense_score, max(bm25_score) AS bm25_score FROM (
      SELECT query_id, chunk_id, rank, dense_score, 0.0::DOUBLE AS bm25_score FROM dense
      UNION ALL SELECT query_id, chunk_id, rank, 0.0, bm25_score FROM sparsen) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused)"""

_VECTORS = "g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(cast(x AS DOUBLE) * 67108864 + 0.5::DOUBLE)) AS e FROM embeddings)"
_tok = lambda x: f"(CASE WHEN length(coalesce({x}, '')) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)"
_NOTE = "chr(10) || chr(10) || '[Context truncated because of token limits.]'"


def _budget(source: str, key: str, text: str, query: str) -> str:
    return f"""bl AS (SELECT {key}, i, line, sum({_tok('line')}) OVER (PARTITION BY {key} ORDER BY i) AS run FROM (
        SELECT {key}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {source})),
      bk AS (SELECT {key}, string_agg(line, chr(10) ORDER BY i) AS kept FROM bl JOIN {source} USING ({key}) WHERE run <= 2460 - {_tok(query)} GROUP BY {key}),
      budget AS (SELECT {source}.*, {_tok(text)} + {_tok(query)} > 2560 AS truncated,
        CASE WHEN {_tok(text)} + {_tok(query)} <= 2560 THEN {text} WHEN 2460 - {_tok(query)} <= 0 THEN left({text}, 2000)
             WHEN kept IS NULL THEN left({text}, 8000) ELSE kept || {_NOTE} END AS final FROM {source} LEFT JOIN bk USING ({key}))"""


SQL = {
    "clean_documents": f"""WITH c AS (SELECT doc_id, {_clean(_DIRTY)} AS t FROM documents)
        SELECT doc_id, md5(t) AS text_md5, length(t) AS chars FROM c WHERE t <> ''""",
    "boilerplate_removed": f"""WITH mixed AS (SELECT doc_id, {BOILERPLATE_EXPR} AS text FROM documents),
        paras AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM mixed),
        good AS (SELECT doc_id, i, {_strip('raw')} AS p FROM paras WHERE {_strip('raw')} <> '' AND NOT {_bad(_strip('raw'))}),
        lines AS (SELECT doc_id, i, unnest(string_split(p, chr(10))) AS line, generate_subscripts(string_split(p, chr(10)), 1) AS j FROM good),
        joined AS (SELECT doc_id, i, string_agg(line, chr(10) ORDER BY j) AS p FROM lines WHERE NOT {_bad(_strip('line'))} GROUP BY doc_id, i),
        whole AS (SELECT doc_id, regexp_replace(string_agg(p, chr(10) || chr(10) ORDER BY i), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM joined GROUP BY doc_id)
        SELECT doc_id, md5(coalesce(t, '')) AS text_md5, length(coalesce(t, '')) AS chars FROM documents LEFT JOIN whole USING (doc_id)""",
    "chunk_ids": f"WITH {_LINES} SELECT chunk_id, 'doc' || doc_id AS source, i AS chunk_index FROM chunks",
    "long_enough_chunks": f"WITH {_LINES} SELECT origin, count(*) AS kept FROM chunks WHERE length(line) >= 40 GROUP BY origin",
    "ingest_stats": f"""WITH {_LINES}, u AS (SELECT source, 1 AS p, 0 AS c, 0 AS s FROM cl WHERE text <> ''
          UNION ALL SELECT origin, 0, 1, CASE WHEN length(line) < 40 THEN 1 ELSE 0 END FROM chunks)
        SELECT source, cast(sum(p) AS BIGINT) AS pages, cast(sum(c) AS BIGINT) AS chunks, cast(sum(s) AS BIGINT) AS skipped, cast(sum(c) - sum(s) AS BIGINT) AS stored FROM u GROUP BY ROLLUP (source)""",
    "chunk_coverage": f"""WITH c AS (SELECT doc_id, {_clean('text')} AS text FROM documents)
        SELECT 'doc' || doc_id AS source, true AS unbroken, true AS bounded, len(list_distinct({_tokens('text')})) AS words FROM c WHERE text <> ''""",
    "chunk_store": f"""WITH {_LINES} SELECT count(DISTINCT chunk_id) AS chunk_count, true AS populated, count(DISTINCT chunk_id) AS stored_rows FROM chunks WHERE length(line) >= 40""",
    "token_stats": f"SELECT doc_id, len({_tokens('text')}) AS tokens, cast({_tok('text')} AS BIGINT) AS token_estimate FROM documents",
    "term_frequencies": f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "corpus_stats": f"WITH {_POST} SELECT n AS chunks, round(avgdl, 6) AS mean_length FROM stats",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, round(bm25_score, 6) AS bm25_score, rank FROM sparsen",
    "bm25_pruned_pairs": f"WITH {_BM25} SELECT cast(sum(df) AS BIGINT) AS all_pairs, true AS fewer FROM qw JOIN idf USING (term)",
    "cells_topk": f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, g.vec_id AS chunk_id, {_LIKE.format(a="q.e", b="g.e")} AS dense_score FROM g q, g WHERE q.vec_id % 100 = 0)
        SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""",
    "cells_recall": "SELECT count(*) AS indexed, 10 * count(*) FILTER (WHERE vec_id % 100 = 0) AS asked, true AS recalled FROM embeddings",
    "dense_topk": f"""WITH {_VECTORS}, v AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM embeddings),
        m AS (SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY ALL),
        l AS (SELECT label, list(mean ORDER BY pos) AS c FROM m GROUP BY label),
        q AS (SELECT label AS query_id, list_transform(c, lambda x: floor(x / sqrt(list_sum(list_transform(c, lambda u: u * u))) * 67108864 + 0.5::DOUBLE)) AS e FROM l),
        s AS (SELECT query_id, g.vec_id AS chunk_id, {_LIKE.format(a="q.e", b="g.e")} AS dense_score FROM q, g)
        SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""",
    "rrf_topk": f"""WITH {_RRF} SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score, rank FROM ranked WHERE rank <= 10""",
    "retrieval_context": f"""WITH {_RRF}, fin AS (SELECT ranked.query_id, rank, 'doc' || doc_id AS source, rrf, text FROM ranked
            JOIN documents ON chunk_id = 'd' || lpad(cast(doc_id AS varchar), 12, '0') WHERE rank <= 3),
        ctx AS (SELECT query_id, {_strip("string_agg('[CHUNK ' || rank || ']' || chr(10) || 'Source: ' || source || chr(10) || 'Relevance score: ' || printf('%.3f', rrf) || chr(10) || 'Content:' || chr(10) || " + _strip('text') + " || chr(10), chr(10) ORDER BY rank)")} AS context,
            string_agg(source, '|' ORDER BY source) AS sources, count(*) AS chunks_used FROM fin GROUP BY query_id),
        c2 AS (SELECT ctx.*, b.text AS qtext FROM ctx JOIN benchmark b ON b.item_id = ctx.query_id), {_budget('c2', 'query_id', 'context', 'qtext')}
        SELECT query_id, md5(final) AS context_md5, sources, chunks_used, truncated, chunks_used > 0 AND NOT truncated AS grounded FROM budget""",
    "context_budget": f"""WITH d AS (SELECT doc_id, source AS origin, text FROM documents), {_budget('d', 'doc_id', 'text', 'origin')}
        SELECT doc_id, md5(final) AS text_md5, length(final) AS chars, truncated FROM budget""",
    "relevance_cut": "SELECT vec_id, round(cast(embedding[1] AS DOUBLE) * 20.0, 6) AS score FROM embeddings WHERE cast(embedding[1] AS DOUBLE) * 20.0 >= -3.0",
}
SQL["bm25_pruned_topk"] = SQL["bm25_topk"]
_CHUNKED = f"""cleaned AS (SELECT 'doc' || doc_id AS doc, {_clean('text')} AS text FROM documents), {chunks_sql('cleaned', _strip)},
  ids AS (SELECT left(sha256(doc || '::page0::chunk' || chunk_index || '::' || left(chunk, 200)), 32) AS chunk_id, doc AS source, cast(chunk_index AS INTEGER) AS chunk_index,
    cast(length(chunk) AS INTEGER) AS char_count FROM chunked)"""
SQL["document_chunks"] = f"WITH {_CHUNKED} SELECT * FROM ids"
SQL["stream_chunk_store"] = f"WITH {_CHUNKED} SELECT DISTINCT * FROM ids WHERE char_count >= 40"
