"""The recursive splitter in SQL: texts are cut by ever finer separators on the way down, pieces joined on the way up."""

from __future__ import annotations

SIZE, OVERLAP = 1000, 200
SEPARATORS = ["\n\n", "\n", ". ", "; ", ": ", ", ", " "]  # then single characters
DEPTH = len(SEPARATORS) + 1


def _quoted(text: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in text)


def _glue(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN {k} THEN {_quoted(s)}" for k, s in enumerate(SEPARATORS)) + " ELSE '' END"


def _down(k: int, strip) -> str:
    """Nodes longer than a chunk get the first separator they hold; ``part{k + 1}`` has their fragments."""
    first = "CASE" + "".join(f" WHEN level <= {i} AND contains(text, {_quoted(s)}) THEN {i}" for i, s in enumerate(SEPARATORS)) + f" ELSE {len(SEPARATORS)} END"
    return f"""
big{k} AS MATERIALIZED (SELECT doc, path, text, {first} AS cut FROM part{k} WHERE length(text) > {SIZE}),
part{k + 1} AS MATERIALIZED (
  SELECT doc, list_append(path, i) AS path, cut, {strip('raw')} AS text, cut + 1 AS level FROM (
    SELECT doc, path, cut, unnest(f) AS raw, generate_subscripts(f, 1) AS i
    FROM (SELECT doc, path, cut, CASE WHEN cut = {len(SEPARATORS)} THEN string_split(text, '') ELSE string_split(text, {_glue('cut')}) END AS f FROM big{k})
  ) WHERE {strip('raw')} <> ''
)"""


def _up(k: int) -> str:
    """``chunks{k}``: the joined pieces of every node at depth k, in order."""
    below = f"UNION ALL SELECT doc, path[:{k}] AS path, path[{k + 1}] AS i, nth, chunk AS piece FROM chunks{k + 1}" if k + 1 < DEPTH else ""
    span = lambda a, b: f"(CASE WHEN {b} > {a} THEN greatest(ends[{b} + 1] - ends[{a} + 1] - g, 0) ELSE 0 END)"
    return f"""
pieces{k} AS MATERIALIZED (
  SELECT doc, path, list(piece ORDER BY i, nth) AS pieces FROM (
    SELECT doc, path[:{k}] AS path, path[{k + 1}] AS i, 0 AS nth, text AS piece FROM part{k + 1} WHERE length(text) <= {SIZE} {below}
  ) GROUP BY ALL
), placed{k} AS MATERIALIZED (
  SELECT doc, path, pieces, glue, length(glue) AS g,
    list_prepend(0, list_transform(range(1, len(pieces) + 1), lambda n: list_sum(list_transform(pieces[:n], lambda p: length(p) + length(glue)))::BIGINT)) AS ends
  FROM (SELECT doc, path, pieces, {_glue('cut')} AS glue FROM pieces{k} JOIN big{k} USING (doc, path))
), walked{k} AS (
  SELECT doc, path, pieces, glue, list_reduce(
    list_transform(range(0, len(pieces)), lambda e: {{'start': 0::BIGINT, 'e': e, 'cuts': []::BIGINT[][]}}),
    lambda s, x: CASE WHEN x.e > s.start AND {span('s.start', '(x.e + 1)')} > {SIZE}
      THEN {{'start': list_filter(range(s.start, x.e + 1), lambda a: a = x.e OR {span('a', 'x.e')} <= {OVERLAP})[1], 'e': x.e, 'cuts': list_append(s.cuts, [s.start, x.e])}}
      ELSE {{'start': s.start, 'e': x.e, 'cuts': s.cuts}} END) AS w
  FROM placed{k}
), chunks{k} AS MATERIALIZED (
  SELECT doc, path, c.nth, list_reduce(pieces[c.span[1] + 1:c.span[2]], lambda a, b: a || glue || b) AS chunk FROM (
    SELECT doc, path, pieces, glue, unnest(list_transform(range(1, len(spans) + 1), lambda n: {{'nth': n, 'span': spans[n]}})) AS c
    FROM (SELECT doc, path, pieces, glue, list_append(w.cuts, [w.start, len(pieces)]) AS spans FROM walked{k})
  ) WHERE c.span[1] < c.span[2]
)"""


def chunks_sql(source: str, strip) -> str:
    """CTEs over ``source`` (doc, text) up to ``chunked`` (doc, chunk_index, chunk); ``strip`` makes SQL that trims."""
    down = ",".join(_down(k, strip) for k in range(DEPTH))
    up = ",".join(_up(k) for k in reversed(range(DEPTH)))
    return f"""part0 AS (SELECT doc, []::BIGINT[] AS path, {strip('text')} AS text, 0 AS level FROM {source}),{down},{up},
chunked AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY nth) - 1 AS chunk_index, {strip('chunk')} AS chunk
  FROM (SELECT doc, nth, chunk FROM chunks0 UNION ALL SELECT doc, 0, text FROM part0 WHERE length(text) BETWEEN 1 AND {SIZE}) WHERE {strip('chunk')} <> ''
)"""
