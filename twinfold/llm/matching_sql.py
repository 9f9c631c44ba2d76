"""SQL of the matching pairs, written on its own: rare-word prefixes, then the lists themselves."""


def _records(name: str, table: str, key: str) -> str:
    return f"""{name} AS (SELECT {key} AS id, regexp_extract_all(lower(question1), '[\\p{{L}}\\p{{N}}]+') AS l1, regexp_extract_all(lower(question2), '[\\p{{L}}\\p{{N}}]+') AS l2 FROM {table}),
{name}_q AS (SELECT id, 1 AS side, list_distinct(l1) AS w FROM {name} WHERE len(l1) > 0 AND len(l2) > 0 UNION ALL SELECT id, 2, list_distinct(l2) FROM {name} WHERE len(l1) > 0 AND len(l2) > 0),
{name}_b AS (SELECT id, least(array_to_string(l1, ''), array_to_string(l2, '')) AS lo, greatest(array_to_string(l1, ''), array_to_string(l2, '')) AS hi FROM {name} WHERE len(l1) > 0 AND len(l2) > 0)"""


def _prefix(name: str) -> str:
    return f"""{name}_t AS (SELECT id, side, len(w) AS n, unnest(w) AS t FROM {name}_q),
{name}_p AS (SELECT id, side, t FROM (SELECT id, side, n, t, row_number() OVER (PARTITION BY id, side ORDER BY c, t) AS k FROM {name}_t JOIN f USING (t)) WHERE k <= n - (7 * n + 9) // 10 + 1)"""


def matching_sql(left: tuple[str, str], right: tuple[str, str] | None, names: tuple[str, str]) -> str:
    """Pairs of ``left`` and ``right`` (table, key); within ``left`` if right is None."""
    x, y = "x", "x" if right is None else "y"
    order = " AND a.id < b.id" if right is None else ""
    parts = [_records("x", *left)] + ([] if right is None else [_records("y", *right)])
    every = "SELECT w FROM x_q" + ("" if right is None else " UNION ALL SELECT w FROM y_q")
    parts += [f"f AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM ({every})) GROUP BY t)", _prefix("x")] + ([] if right is None else [_prefix("y")])
    parts += [
        f"c AS (SELECT DISTINCT a.id AS i, a.side AS s, b.id AS j, b.side AS u FROM {x}_p AS a JOIN {y}_p AS b ON a.t = b.t{order})",
        f"m AS (SELECT i, s, j, u FROM c JOIN {x}_q AS a ON a.id = i AND a.side = s JOIN {y}_q AS b ON b.id = j AND b.side = u WHERE 17 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w)))",
        "g AS (SELECT i, j FROM m GROUP BY i, j HAVING (bool_or(s = 1 AND u = 1) AND bool_or(s = 2 AND u = 2)) OR (bool_or(s = 1 AND u = 2) AND bool_or(s = 2 AND u = 1)))",
    ]
    return f"WITH {', '.join(parts)} SELECT i AS {names[0]}, j AS {names[1]} FROM g UNION SELECT a.id, b.id FROM {x}_b AS a JOIN {y}_b AS b ON a.lo = b.lo AND a.hi = b.hi{order}"
