"""The manifest of documents as SQL: one step per level, enough of them for 3 ** 18 rows a source and 3 ** 6 sources."""

from __future__ import annotations

SOURCE_LEVELS, TOP_LEVELS = 18, 6


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _climb(name: str, levels: int) -> str:
    """Steps from {name}0 (k, pos, d) to {name}{levels}: runs of three become their digest while a key has several nodes;
    {name}{i}s has every node's siblings."""
    steps = []
    for i in range(levels):
        steps.append(f"""
{name}{i}s AS (
  SELECT k, pos, d, count(*) OVER (PARTITION BY k) AS n,
         coalesce(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY k, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (PARTITION BY k, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{i}),
{name}{i + 1} AS (
  SELECT k, pos // 3 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE max(d) END AS d FROM {name}{i}s GROUP BY k, pos // 3)""")
    return ",".join(steps)


def _fold(name: str, start: str, levels: int, key: str) -> str:
    """Steps from {start} (a row per leaf: k, p, f, proof and others) to {name}{levels}."""
    steps, before = [], start
    for i in range(levels):
        steps.append(f"""
f{name}{i} AS (
  SELECT b.* REPLACE (b.p // 3 AS p, b.proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || b.f || s.r) ELSE b.f END AS f)
  FROM {before} b JOIN {name}{i}s s ON {key} = s.k AND b.p = s.pos)""")
        before = f"f{name}{i}"
    return ",".join(steps)


CRC = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce(CAST(range(8) AS BIGINT[]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(crc, byte)),
    CAST(4294967295 AS BIGINT))"""


def manifest_sql() -> str:
    plain = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    found = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "CASE WHEN even THEN replace(text, chr(10), '') ELSE text END"))
    return f"""
WITH marked AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k, coalesce(xor({CRC}, 4294967295) % 2 = 0, false) AS even FROM documents),
leaves AS (SELECT k, doc_id, sha256({plain}) AS leaf, sha256({found}) AS f FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, f) - 1 AS p FROM leaves),
s0 AS (SELECT k, p AS pos, leaf AS d FROM placed),{_climb("s", SOURCE_LEVELS)},
names AS (SELECT k AS name, d AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS place FROM s{SOURCE_LEVELS}),
t0 AS (SELECT 0 AS k, place AS pos, subroot AS d FROM names),{_climb("t", TOP_LEVELS)},
start AS (SELECT k, doc_id, leaf, f, p, '' AS proof FROM placed),{_fold("s", "start", SOURCE_LEVELS, "b.k")},
named AS (SELECT b.* REPLACE (n.place AS p), n.subroot FROM fs{SOURCE_LEVELS - 1} b JOIN names n ON b.k = n.name),{_fold("t", "named", TOP_LEVELS, "0")}
SELECT b.doc_id, b.leaf, b.subroot, r.d AS root, sha256(b.proof) AS proof_sha256, b.f AS folded_root, b.f = r.d AS verified
FROM ft{TOP_LEVELS - 1} b JOIN t{TOP_LEVELS} r ON r.pos = b.p"""
