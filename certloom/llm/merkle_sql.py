"""The Merkle manifest of `documents` in SQL, for the checking engine."""

from certloom.llm.merkle import ARITY, FIELDS, LOWER, UPPER

# CRC-32 of a text of ASCII characters, bit by bit; 3988292384 is the fixed polynomial.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda k: ascii(({0})[k])::BIGINT)),
  lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _leaf(values: list[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({v} AS varchar)) || ':' || cast({v} AS varchar), '-')" for v in values) + ")"


def _tree(name: str, source: str) -> str:
    """Nodes of all levels over `source` (g, i, n, h), and the runs that have a parent."""
    return f"""{name}(lvl, g, i, n, h) AS (SELECT 0, g, i, n, h FROM {source}
  UNION ALL SELECT lvl + 1, g, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lvl, g, i // {ARITY}, n),
{name}_runs AS (SELECT lvl, g, i // {ARITY} AS p, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _climb(name: str, tree: str, source: str) -> str:
    """From `source` (rid, g, i, n, cur, proof) up to the top of `tree`."""
    slot = f"c.i % {ARITY}"
    left, right = f"array_to_string(hs[1:{slot}], '')", f"array_to_string(hs[{slot} + 2:], '')"
    return f"""{name}(rid, lvl, g, i, n, cur, proof) AS (SELECT rid, 0, g, i, n, cur, proof FROM {source}
  UNION ALL SELECT rid, c.lvl + 1, c.g, c.i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256({left} || cur || {right}), proof || {left} || {right}
  FROM {name} c JOIN {tree}_runs r ON r.lvl = c.lvl AND r.g = c.g AND r.p = c.i // {ARITY} WHERE n > 1)"""


_CHANGED = [f"translate(text, '{UPPER}', '{LOWER}')" if f == "text" else f for f in FIELDS]

MANIFEST = f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {_leaf(list(FIELDS))} AS h,
  CASE WHEN {CRC32.format("cast(doc_id AS varchar)")} % 5 = 0 THEN {_leaf(_CHANGED)} END AS tampered FROM documents),
numbered AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
  count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_tree("tree", "numbered")},
subroots AS (SELECT g AS name, h FROM tree WHERE n = 1),
groups AS (SELECT name, '' AS g, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS n, h FROM subroots),
{_tree("top", "groups")},
starts AS (SELECT rid, g, i, n, coalesce(tampered, h) AS cur, '' AS proof FROM numbered),
{_climb("climb", "tree", "starts")},
middle AS (SELECT rid, '' AS g, s.i, s.n, cur, proof FROM climb c JOIN groups s ON s.name = c.g WHERE c.n = 1),
{_climb("ascent", "top", "middle")},
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, l.h AS leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM numbered l JOIN subroots s ON s.name = l.g JOIN ascent a ON a.rid = l.rid AND a.n = 1 CROSS JOIN root"""
