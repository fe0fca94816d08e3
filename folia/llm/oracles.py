"""DuckDB SQL for the rows of the importance resampling and of the Merkle manifest."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc(value: str) -> str:
    """crc32 of a string's UTF-8 bytes."""
    byte = f"list_transform(range(0, strlen({value})), lambda i: ('0x' || substr(hex({value}), 2 * i::INT + 1, 2))::BIGINT)"
    step = f"xor(a >> 8, ({_crc_table()}::BIGINT[])[1 + (xor(a, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: {step}), 4294967295::BIGINT)"


_WORDS = rf"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP12 = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
aim AS (SELECT {_WORDS} AS w FROM benchmark),
own AS (
  SELECT r, unnest(w) AS f FROM doc
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM doc WHERE len(w) > 1
),
wanted AS (
  SELECT unnest(w) AS f FROM aim
  UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM aim WHERE len(w) > 1
),
place AS MATERIALIZED (SELECT f, {crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM own UNION ALL SELECT f FROM wanted))),
s AS (SELECT bucket, count(*) AS s FROM own JOIN place USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN place USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket)
),
mean AS (SELECT r, count(*) AS n, floor(sum(g) / count(*)::DOUBLE)::BIGINT AS m FROM own JOIN place USING (f) JOIN gain USING (bucket) GROUP BY r),
score AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(m, 0) AS weight,
    coalesce(m, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM doc LEFT JOIN mean USING (r)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k FROM score)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_words >= 20 AND k <= (SELECT 25 * count(*) // 100 FROM score WHERE n_words >= 20) THEN k::BIGINT END AS rank
FROM placed
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _tree(name: str, nodes: str, levels: int) -> str:
    """Levels 0 .. `levels` of the trees of `nodes` (g, pos, d), each with what stands around a node in its run; done: one node is left."""
    out = [f"{name}0 AS MATERIALIZED ({nodes})"]
    for i in range(levels):
        run = "OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(
            f"""{name}r{i} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) = 1 AS done, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
              coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{i})"""
        )
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT g, pos // 8 AS pos, CASE WHEN max(done::INT) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}r{i} GROUP BY g, pos // 8)")
    return ",\n".join(out)


def _fold(name: str, levels: int, start: str, step: str) -> str:
    """CTEs `step`0 ..: rows of `start` (r, g, pos, f, proof) carried up level by level."""
    out = [f"{step}0 AS ({start})"]
    for i in range(levels):
        out.append(
            f"""{step}{i + 1} AS MATERIALIZED (SELECT r, p.g, p.pos // 8 AS pos, CASE WHEN done THEN f ELSE sha256(b || f || a) END AS f, CASE WHEN done THEN proof ELSE proof || b || a END AS proof
              FROM {step}{i} p JOIN {name}r{i} n ON n.g = p.g AND n.pos = p.pos)"""
        )
    return ",\n".join(out)


#: Trees of at most 8^7 documents a language and 8^3 languages.
OP13 = f"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS g, {_leaf("text")} AS leaf,
    CASE WHEN {crc("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
  FROM documents
),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM doc),
{_tree("n", "SELECT g, pos, leaf AS d FROM placed", 7)},
sub AS MATERIALIZED (SELECT g AS lang, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, d FROM n7),
{_tree("t", "SELECT g, pos, d FROM sub", 3)},
{_fold("n", 7, "SELECT r, g, pos, coalesce(changed, leaf) AS f, '' AS proof FROM placed", "u")},
{_fold("t", 3, "SELECT r, sub.g, sub.pos, f, proof FROM u7 JOIN sub ON sub.lang = u7.g", "v")}
SELECT doc_id, leaf, sub.d AS subroot, t3.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t3.d AS verified
FROM placed JOIN v3 USING (r) JOIN sub ON sub.lang = placed.g CROSS JOIN t3
"""
