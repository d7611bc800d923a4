"""DuckDB statements of the operators that SQL can express, written from the
contract's base patterns, independent of the Spark forms."""

from __future__ import annotations

from .pii import CARD_INNER, CONTEXT, CONTEXT_WORDS, IBAN, PHONE_INNER, SSN
from .secret_scan import GITHUB, JWT, PRIVATE_KEY, SLACK
from .urls import BLOCKED_HOSTS, RULES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain(pattern: str) -> str:
    """RE2 has no possessive quantifiers; these patterns need none."""
    return pattern.replace("}+", "}").replace("++", "+")


def spans(text: str, pattern: str, idx: int, kind: str) -> str:
    """List of structs (s, i, e, k, m): offsets from the lengths of the pieces between matches."""
    hits, gaps = f"regexp_extract_all({text}, {q(pattern)})", f"regexp_split_to_array({text}, {q(pattern)})"
    return (f"list_transform(range(1, len({hits}) + 1), lambda i: struct_pack("
            f"s := (list_sum(list_transform({gaps}[:i], lambda g: length(g))) + coalesce(list_sum(list_transform({hits}[:i - 1], lambda g: length(g))), 0))::BIGINT, "
            f"i := {idx}, e := (list_sum(list_transform({gaps}[:i], lambda g: length(g))) + list_sum(list_transform({hits}[:i], lambda g: length(g))))::BIGINT, "
            f"k := {q(kind)}, m := {hits}[i]))")


def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '', 'g')"


def luhn(s: str) -> str:
    d = f"string_split(reverse({digits(s)}), '')"
    return (f"(list_sum(list_transform(range(1, length({digits(s)}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {d}[j]::INT "
            f"WHEN {d}[j]::INT >= 5 THEN {d}[j]::INT * 2 - 9 ELSE {d}[j]::INT * 2 END)) % 10 = 0)")


def text_of(list_sql: str) -> str:
    return f"array_to_string(list_transform(list_sort({list_sql}), lambda x: x.k || ':' || x.s || ':' || x.e), ',')"


def shifted(runs: str, pattern: str, idx: int, kind: str) -> str:
    inner = spans("r.m", pattern, idx, kind)
    return (f"flatten(list_transform({runs}, lambda r: list_transform({inner}, lambda x: "
            f"struct_pack(s := x.s + r.s, i := x.i, e := x.e + r.s, k := x.k, m := x.m))))")


OP2 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text,
  {spans('text', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0, 'email')} AS email,
  {spans('text', r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 1, 'ip')} AS ip,
  {spans('text', r'[0-9](?:[ -]?[0-9])+', 2, 'card')} AS card,
  {spans('text', r'\+[0-9][ ().0-9-]+[0-9]', 3, 'phone')} AS phone,
  {spans('text', IBAN, 4, 'iban')} AS iban,
  {spans('text', SSN, 5, 'ssn')} AS ssn FROM t),
b AS (SELECT doc_id, text, email,
  list_filter(ip, lambda x: len(list_filter(string_split(x.m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256) > 255)) = 0) AS ip,
  list_filter(card, lambda x: length({digits('x.m')}) BETWEEN 12 AND 19 AND {luhn('x.m')}) AS card,
  list_filter(card, lambda x: length({digits('x.m')}) >= 12 AND NOT (length({digits('x.m')}) BETWEEN 12 AND 19 AND {luhn('x.m')})) AS badcard,
  list_filter(phone, lambda x: length({digits('x.m')}) BETWEEN 9 AND 15) AS phone,
  list_filter(phone, lambda x: length({digits('x.m')}) NOT BETWEEN 9 AND 15) AS badphone,
  list_filter(iban, lambda x: list_reduce(list_transform(string_split(x.m[5:] || x.m[:4], ''),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END),
    lambda acc, v: CASE WHEN v > 9 THEN (acc * 100 + v) % 97 ELSE (acc * 10 + v) % 97 END) = 1) AS iban,
  list_filter(ssn, lambda x: regexp_matches(lower(text[greatest(x.s + 1 - {CONTEXT}, 1):x.s]), {q(CONTEXT_WORDS['ssn'])})) AS ssn FROM a),
c AS (SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone,
  list_concat(list_concat(email, ip), list_concat(card, phone)) AS base,
  list_concat(list_concat(list_filter({shifted('badcard', CARD_INNER, 2, 'card')}, lambda x: {luhn('x.m')}),
    {shifted('badphone', PHONE_INNER, 3, 'phone')}), list_concat(iban, ssn)) AS extra FROM b)
SELECT doc_id, n_email, n_ip, n_card, n_phone, sha256({text_of('base')}) AS base_sha256,
       {text_of('list_concat(base, extra)')} AS spans FROM c
"""

_RULE = "\n".join(
    f"    WHEN (host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)}) THEN {q(h + p)}"
    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_BLOCK = " OR ".join(f"host = {q(h)} OR ends_with(host, {q('.' + h)})" for h in BLOCKED_HOSTS)
OP6 = f"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] END, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path, CASE
{_RULE}
    END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({', '.join(q(h + p) for h, p, v in RULES if v == 'allow')}) THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN {_BLOCK} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEY + """["']? *[:=] *["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"
OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id,
  list_filter({spans('text', _ASSIGN + _VALUE, 0, 'assign')}, lambda x: length(regexp_extract(x.m, {q('^' + _ASSIGN + '(' + _VALUE + ')')}, 1)) >= 6) AS assign,
  list_filter({spans('text', 'AKIA[A-Z0-9]+', 1, 'access')}, lambda x: length(x.m) >= 20) AS access,
  list_filter({spans('text', '[0-9a-f]{24,}', 2, 'hex')}, lambda x: length(x.m) >= 24) AS hex,
  list_concat(list_concat({spans('text', plain(PRIVATE_KEY), 3, 'private_key')}, {spans('text', plain(GITHUB), 4, 'github')}),
    list_concat({spans('text', plain(SLACK), 5, 'slack')}, {spans('text', plain(JWT), 6, 'jwt')})) AS extra FROM t),
b AS (SELECT *, list_concat(list_concat(assign, access), hex) AS base FROM a)
SELECT doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex, sha256({text_of('base')}) AS base_sha256,
       {text_of('list_concat(base, extra)')} AS spans FROM b
"""

# every query against every row, whole-number products
OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(reach.b) AS component_id, e.vec_id = min(reach.b) AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id GROUP BY e.vec_id
"""


def centroid_rounds(clusters: int, rounds: int, dim: int, seed: str) -> str:
    """Operator 11: the rounds as a chain of statements, every vector against every centroid."""
    nearest = """SELECT x.rid, min(struct_pack(d := list_sum(list_transform(list_zip(x.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT,
      c := c.c)) AS best FROM v x, c{k} c GROUP BY x.rid"""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({256} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS c, e FROM v
  WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {clusters})"""]
    for k in range(rounds):
        parts += [f"a{k} AS MATERIALIZED ({nearest.format(k=k)})",
                  f"""s{k} AS (SELECT a.best.c AS c, u.pos, sum(u.val) AS s, count(*) AS n FROM a{k} a
  JOIN (SELECT rid, unnest(e) AS val, generate_subscripts(e, 1) AS pos FROM v) u USING (rid) GROUP BY 1, 2)""",
                  f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.e, c{k}.e) AS e FROM c{k} LEFT JOIN (SELECT c,
  list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS e FROM s{k} GROUP BY c) m USING (c))"""]
    return "WITH " + ",\n".join(parts) + f""",
a{rounds} AS MATERIALIZED ({nearest.format(k=rounds)})
SELECT v.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
       (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.c = a.best.c
"""


OP11 = centroid_rounds(40, 5, 64, "2")

# every document against every item; term runs as the contract's class
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
m AS (SELECT rid, doc_id, 75 + (25 * len(t) * c.n) // c.l AS m FROM d, c WHERE len(t) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY 1, 2),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, c.n),
s AS (SELECT q.item_id, p.rid, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s JOIN m USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
