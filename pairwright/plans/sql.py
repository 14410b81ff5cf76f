"""DuckDB SQL fragments for the oracle side of the query catalog.

They restate the same semantics in plain SQL over the driver tables; they
share only fixed values (word lists, templates, the whitespace set) with the
Spark side.
"""

from __future__ import annotations

from ..functions.text import WHITESPACE, WHITESPACE_CLASS

WS = "(" + "||".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def normalize(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}{WHITESPACE_CLASS}]', '', 'g')"


def first_line(x: str) -> str:
    return f"split_part({strip(x)}, chr(10), 1)"


def re_escape(word: str) -> str:
    out = []
    for ch in word:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch)
    return "".join(out)


def contains_ci(x: str, word: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + re_escape(word))})"


def contains_any_ci(x: str, words) -> str:
    return f"regexp_matches({x}, {lit('(?i)(?:' + '|'.join(re_escape(w) for w in words) + ')')})"


def contains_any_literal(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(upper({x}), {lit(w.upper())})" for w in words) + ")"


def contains_all_ci(x: str, words) -> str:
    return "(" + " AND ".join(contains_ci(x, w) for w in words) + ")"


def keep_unless(cond: str) -> str:
    return f"NOT coalesce({cond}, false)"


def strip_preamble(x: str) -> str:
    fp = first_line(x)
    k = (f"((CASE WHEN contains({fp}, '##') THEN 1 ELSE 0 END) + "
         f"2 * (CASE WHEN contains({fp}, '**') THEN 1 ELSE 0 END) + "
         f"(CASE WHEN {contains_any_ci(fp, ('sure', "here's"))} THEN 1 ELSE 0 END))")
    r1 = f"replace({x}, {fp}, '')"
    r2 = f"replace({r1}, {fp}, '')"
    r3 = f"replace({r2}, {fp}, '')"
    r4 = f"replace({r3}, {fp}, '')"
    return f"(CASE {k} WHEN 0 THEN {x} WHEN 1 THEN {r1} WHEN 2 THEN {r2} WHEN 3 THEN {r3} ELSE {r4} END)"


def render(template: str, **slots) -> str:
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if field is not None:
            parts.append(f"CAST({slots[field]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def ws_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WHITESPACE_CLASS}]+'), lambda w: w <> '')"


def token_count(x: str) -> str:
    return f"(CASE WHEN {strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(x)}, '[{WHITESPACE_CLASS}]+')) END)"


def md5_key(seed, cols) -> str:
    parts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'null')" for c in cols]
    return "md5(concat_ws(chr(1), " + lit(str(seed)) + ", " + ", ".join(parts) + "))"


def dot(a: str, b: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def norm(a: str, n: int) -> str:
    return f"sqrt({dot(a, a, n)})"


def cosine(a: str, b: str, n: int) -> str:
    d = f"({norm(a, n)} * {norm(b, n)})"
    return f"(CASE WHEN {d} = 0 THEN 0.0 ELSE {dot(a, b, n)} / {d} END)"


PAIRS = """pairs AS (
  SELECT d.doc_id AS id, d.text AS original_text, b.text AS rewrite_prompt,
         lead(d.text) OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS rewritten_text,
         CAST(substr(d.source, 4) AS INTEGER) AS cluster
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""

VARIATIONS = """variations AS (
  SELECT o.text AS original, CAST(v.item_id // k AS INTEGER) - 1 AS pos, v.text AS variation
  FROM (SELECT greatest(1, count(*) // 4) AS k FROM benchmark) c
  JOIN benchmark v ON v.item_id >= k JOIN benchmark o ON v.item_id % k = o.item_id AND o.item_id < k)"""

SPLITS = """splits AS (
  SELECT * FROM (VALUES (0, 'test'), (1, 'test'), (2, 'test'), (3, 'test'),
                        (4, 'val'), (5, 'val'), (6, 'val')) t(cluster, split))"""

TURN_PAIRS = """turn_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS prompt_text, a.text AS response_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

VECTORS = """vectors AS (SELECT vec_id, embedding, label AS cluster FROM embeddings),
cands AS (SELECT * FROM vectors WHERE vec_id >= 16),
refs AS (SELECT vec_id + 1 AS ref_id, embedding AS ref FROM vectors WHERE vec_id < 16)"""


def ascii_json(x: str) -> str:
    """JSON text with every character beyond ASCII as \\uXXXX (a pair above U+FFFF)."""
    u = "unicode(c)"
    pair = f"printf('\\u%04X\\u%04X', 55296 + (({u} - 65536) // 1024), 56320 + (({u} - 65536) % 1024))"
    return (f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN {u} < 128 THEN c "
            f"WHEN {u} < 65536 THEN printf('\\u%04X', {u}) ELSE {pair} END), '')")


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def near_identical(source: str, a: str, b: str, least: float) -> str:
    """CTEs for a recursive query that end with ``near_identical(id)``: the rows of ``source`` whose indel ratio of the
    texts ``a`` and ``b`` is at least ``least``.

    A common subsequence that long leaves at most ``edits`` characters over, and each spoils one of the pieces of five
    characters that ``a`` falls into; pairs with more pieces that ``b`` lacks are out. For the others the table of
    longest common subsequences is filled row by row, after the common beginning and end are cut off, in the band of
    columns that so few edits reach: the entry p of row i is column i - drop + p - 1, and -1 is outside of the table."""
    return f"""
        texts AS (SELECT id, {a} AS a, {b} AS b, length({a}) AS la, length({b}) AS lb FROM {source}),
        likely AS (
          SELECT *, CAST(floor(la - {least} * (la + lb) / 200.0 + 1e-9) AS BIGINT) AS drop, CAST(floor(lb - {least} * (la + lb) / 200.0 + 1e-9) AS BIGINT) AS add
          FROM texts WHERE 200.0 * least(la, lb) >= {least} * (la + lb)),
        close AS (
          SELECT * FROM likely
          WHERE len(list_filter(range(0, la // 5), lambda k: NOT contains(b, substr(a, k * 5 + 1, 5)))) <= drop + add),
        chars AS (SELECT id, la, lb, drop, add, string_split(a, '') AS xs, string_split(b, '') AS ys FROM close),
        begun AS (
          SELECT *, coalesce(list_position(list_transform(range(1, least(la, lb) + 1), lambda k: xs[k] = ys[k]), false) - 1, least(la, lb)) AS same
          FROM chars),
        rest AS (SELECT id, la, lb, drop, add, same, xs[same + 1:] AS xs, ys[same + 1:] AS ys FROM begun),
        ended AS (
          SELECT *, coalesce(list_position(list_transform(range(0, least(len(xs), len(ys))), lambda k: xs[len(xs) - k] = ys[len(ys) - k]), false) - 1,
                             least(len(xs), len(ys))) AS tail
          FROM rest),
        cut AS (SELECT id, la, lb, drop, add, same + tail AS same, xs[:len(xs) - tail] AS xs, ys[:len(ys) - tail] AS ys FROM ended),
        table_row AS (
          SELECT id, 0 AS i, list_transform(range(1, drop + add + 2), lambda p: CASE WHEN p - 1 BETWEEN drop AND drop + len(ys) THEN 0 ELSE -1 END::BIGINT) AS lcs
          FROM cut
          UNION ALL
          SELECT id, i, list(best ORDER BY p) AS lcs FROM (
            SELECT id, i, p, CASE WHEN inside THEN max(reached) OVER (PARTITION BY id ORDER BY p) ELSE -1 END AS best FROM (
              SELECT t.id, t.i + 1 AS i, u.p, t.i + u.p - c.drop BETWEEN 0 AND len(c.ys) AS inside,
                     CASE WHEN t.i + u.p - c.drop = 0 THEN 0
                          WHEN t.lcs[u.p] >= 0 AND c.ys[t.i + u.p - c.drop] = c.xs[t.i + 1] THEN t.lcs[u.p] + 1
                          ELSE coalesce(t.lcs[u.p + 1], -1) END AS reached
              FROM table_row t JOIN cut c ON c.id = t.id AND t.i < len(c.xs), unnest(range(1, c.drop + c.add + 2)) u(p)))
          GROUP BY id, i),
        near_identical AS (
          SELECT c.id FROM cut c JOIN table_row t ON t.id = c.id AND t.i = len(c.xs)
          WHERE c.la + c.lb = 0 OR 200.0 * (c.same + t.lcs[len(c.ys) - len(c.xs) + c.drop + 1]) / (c.la + c.lb) >= {least})"""
