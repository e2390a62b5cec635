"""DuckDB SQL for the queries that SQL can express.

The others are tested against brute force, exact round trips or held-out labels instead: HTML
blocks and trees (1), probabilistic banding (3), alignment (5), hashed models (6), graph search
(7) and sampled lattices (9).
"""

from __future__ import annotations

from . import secrets
from .mixing import BLOCK_WORDS, CAP, SHARD_DOCS, SHARE, WEIGHTS

_WORD = r"[^\x20\x09-\x0D]+"
_REACH = """re AS (SELECT x AS a, x AS b FROM nodes UNION SELECT re.a, l.y FROM re JOIN li l ON re.b = l.x),
  co AS (SELECT a AS x, min(b) AS component_id FROM re GROUP BY a)"""

OP2 = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
  sh AS (SELECT DISTINCT k, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT k, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
  pa AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),
  ok AS (SELECT x, y FROM pa JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
  li AS (SELECT x, y FROM ok UNION ALL SELECT y, x FROM ok), nodes AS (SELECT k AS x FROM w),
  re AS (SELECT x AS a, x AS b FROM nodes UNION SELECT re.a, l.y FROM re JOIN li l ON re.b = l.x),
  co AS (SELECT a AS k, min(doc_id) AS component_id FROM re JOIN w ON w.k = re.b GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w d LEFT JOIN n ON d.k = n.k JOIN co ON co.k = d.k"""

OP8 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  g AS (SELECT * FROM v WHERE len(list_filter(e, lambda z: z IS NULL OR isnan(z) OR isinf(z))) = 0 AND len(list_filter(e, lambda z: z <> 0)) > 0),
  li AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  nodes AS (SELECT DISTINCT vec_id AS x FROM embeddings), {_REACH}, n AS (SELECT x, count(*) AS n FROM li GROUP BY x)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM embeddings m JOIN co ON co.x = m.vec_id LEFT JOIN n ON n.x = m.vec_id"""


def _seeded(*key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '7', {', '.join(key)})), 1, 15) AS BIGINT)"


def _drawn(x: str) -> str:
    c = lambda j: f"((({j}) * q + shift) // n)"
    return f"({BLOCK_WORDS} * {c(f'{x} // {BLOCK_WORDS}')} + ({x} % {BLOCK_WORDS}) * ({c(f'{x} // {BLOCK_WORDS} + 1')} - {c(f'{x} // {BLOCK_WORDS}')}))"


def _seats(name: str, parties: str, group: str, votes: str, seats: str, order: str) -> str:
    """Highest votes / (2 k + 1), one seat at a time."""
    part = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {order}" if group else order
    return f"""{name}_t AS (SELECT *, sum({votes}) OVER ({part}) AS total_, count(*) OVER ({part}) AS n_ FROM {parties}),
  {name}_k AS (SELECT {keys}, CAST({votes} AS DOUBLE) / (2 * k + 1) AS quotient, {seats} AS seats_ FROM (SELECT *, unnest(generate_series(0, CAST(ceil({votes} * ({seats} + n_) / total_) AS BIGINT))) AS k FROM {name}_t WHERE {votes} > 0)),
  {name}_r AS (SELECT *, row_number() OVER ({part} ORDER BY quotient DESC, {order}) AS r FROM {name}_k),
  {name} AS (SELECT {keys}, count(*) AS quota FROM {name}_r WHERE r <= seats_ GROUP BY {keys})"""


OP10 = f"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, {_seeded('doc_id', 'md5(text)')} AS h FROM documents),
  src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY source),
  num AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM src),
  wt AS (SELECT *, CAST(([{', '.join(map(str, WEIGHTS))}])[(nr - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * {float(CAP)} AS cap FROM num),
  lv AS (SELECT *, ({SHARE} * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM wt
    WINDOW b AS (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lw AS (SELECT level FROM lv WHERE level <= cap / weight ORDER BY cap / weight, nr LIMIT 1),
  tg AS (SELECT nr, source, source_size, CAST(ceil(docs / {SHARD_DOCS}.0) AS BIGINT) AS shards, least(cap, coalesce((SELECT level FROM lw), CAST('inf' AS DOUBLE)) * weight) AS target FROM wt),
  tb AS (SELECT *, CAST(floor(sum(target) OVER () / {BLOCK_WORDS} + 0.5) AS BIGINT) AS blocks FROM tg),
  {_seats('sq', 'tb', '', 'target', 'blocks', 'nr')},
  dl AS (SELECT s.doc_id, s.size, s.h, t.nr, t.source, t.source_size, t.target, coalesce(sq.quota, 0) AS source_quota, s.h % t.shards AS shard FROM sized s JOIN tb t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN sq ON sq.nr = t.nr),
  sh AS (SELECT nr, shard, CAST(sum(size) AS BIGINT) AS shard_size, min(source_quota) AS source_quota FROM dl GROUP BY nr, shard),
  {_seats('hq', 'sh', 'nr', 'shard_size', 'source_quota', 'shard')},
  pl AS (SELECT dl.*, sh.shard_size, greatest(1, CAST(ceil(sh.shard_size / {BLOCK_WORDS}.0) AS BIGINT)) AS n, coalesce(hq.quota, 0) AS quota,
      CAST(sum(size) OVER (PARTITION BY dl.nr, dl.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
    FROM dl JOIN sh ON sh.nr = dl.nr AND sh.shard = dl.shard LEFT JOIN hq ON hq.nr = dl.nr AND hq.shard = dl.shard),
  pq AS (SELECT *, e - size AS b, least(quota, {CAP} * n) AS q, {_seeded('nr', 'shard')} % n AS shift FROM pl)
SELECT doc_id, size, source_size, target, CAST({_drawn('e')} - {_drawn('b')} AS BIGINT) AS taken, source, shard AS _shard, nr AS source_nr FROM pq"""

# Letters of the base patterns in either case, spelled out: case folding of other letters differs between engines.
_ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _matches(name: str, pattern: str, group: int = 0) -> str:
    """(k, s, e, m, g): matches with their places, from the lengths of the text between them."""
    q = pattern.replace("'", "''")
    return f"""{name}_l AS (SELECT k, regexp_extract_all(t, '{q}', 0) AS ms, regexp_extract_all(t, '{q}', {group}) AS gs, string_split_regex(t, '{q}') AS bs FROM tx WHERE regexp_matches(t, '{q}')),
  {name}_u AS (SELECT k, unnest(ms) AS m, unnest(gs) AS g, unnest(bs[:len(ms)]) AS b, generate_subscripts(ms, 1) AS i FROM {name}_l),
  {name} AS (SELECT k, m, g, sum(length(b) + length(m)) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS e, e - length(m) AS s FROM {name}_u)"""


def _windows(name: str, c: secrets.EntropyClass) -> str:
    """Merged windows of high entropy of the candidates that no allow-list entry covers."""
    plain, w = c.alphabet.replace("-", r"\-"), c.window
    allowed = " OR ".join([f"regexp_matches(m, '{a}')" for a in secrets.ALLOW if "\\1" not in a] + [f"len(list_filter(string_split('{c.alphabet}', ''), lambda x: contains(m, repeat(x, 8)))) > 0"])
    return f"""{_matches(name, f'[{plain}]{{{w},}}')},
  {name}_w AS (SELECT k, s, unnest(generate_series(0, length(m) - {w})) AS i, m FROM {name} WHERE NOT ({allowed})),
  {name}_h AS (SELECT k, s, s + i AS a FROM {name}_w WHERE list_entropy(string_split(substr(m, CAST(i AS BIGINT) + 1, {w}), '')) >= {c.bits - 1e-9}),
  {name}_g AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY k, s ORDER BY a) <= {w} THEN 0 ELSE 1 END AS new FROM {name}_h),
  {name}_i AS (SELECT *, sum(new) OVER (PARTITION BY k, s ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM {name}_g),
  {name}_m AS (SELECT k, min(a) AS s, max(a) + {w} AS e FROM {name}_i GROUP BY k, s, island)"""


OP4 = f"""WITH tx AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
  {_matches('ma', _ASSIGN, 2)}, {_matches('mc', f'AKIA[A-Z0-9]{{{secrets.MIN_ACCESS - 4},}}')}, {_matches('mh', f'[0-9a-f]{{{secrets.MIN_HEX},}}')},
  {_windows('wh', secrets.HEX_CLASS)}, {_windows('wb', secrets.BASE64_CLASS)},
  sp AS (SELECT k, 1 AS o, 'assign' AS kind, s, e FROM ma WHERE length(g) >= {secrets.MIN_ASSIGN} UNION ALL SELECT k, 2, 'access', s, e FROM mc UNION ALL SELECT k, 3, 'hex', s, e FROM mh
    UNION ALL SELECT k, 4, '{secrets.HEX_CLASS.kind}', s, e FROM wh_m UNION ALL SELECT k, 5, '{secrets.BASE64_CLASS.kind}', s, e FROM wb_m),
  ag AS (SELECT k, count(*) FILTER (o = 1) AS n_assign, count(*) FILTER (o = 2) AS n_access, count(*) FILTER (o = 3) AS n_hex, count(*) FILTER (o > 3) AS n_entropy,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans FROM sp GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM tx LEFT JOIN ag ON tx.k = ag.k"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM {table}"


OP12 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents), i AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
  dt AS (SELECT k, term, count(*) AS tf FROM ({_terms('d', 'k')}) GROUP BY k, term), it AS (SELECT q, term, count(*) AS qf FROM ({_terms('i', 'q')}) GROUP BY q, term),
  dn AS (SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY k), tot AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM dn),
  dm AS (SELECT k, 100 - 75 + ((75 * n * nd) // l) AS m FROM dn, tot),
  w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM dt, tot GROUP BY term, nd),
  sc AS (SELECT q, k, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM it JOIN dt USING (term) JOIN w USING (term) JOIN dm USING (k) GROUP BY q, k),
  rk AS (SELECT q, k, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS r FROM sc JOIN d USING (k) WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM rk JOIN i USING (q) JOIN d USING (k) WHERE r <= 10"""

_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), CAST(4294967295 AS BIGINT))"""

OP11 = f"""WITH cv AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
  tt AS (SELECT r, t, row_number() OVER () AS id, len(regexp_extract_all(t, '{_WORD}')) AS words FROM (SELECT DISTINCT r, t FROM cv)),
  cl AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, substr(sha256(length(r) || ':' || r || t), 1, 32)) AS ts FROM cv JOIN tt USING (r, t) GROUP BY conv_id),
  rb AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM (SELECT *, {_CRC32.format(c='conv_id')} % 4 AS h FROM cl) c LEFT JOIN cl b ON b.conv_id = c.conv_id - c.conv_id % 20),
  ex AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS d, ts FROM rb),
  nd AS (SELECT ts[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM ex GROUP BY ALL),
  ch AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nd WHERE depth > 0 GROUP BY 1),
  sv AS (SELECT nd.p, nd.depth, coalesce((n_convs - 1) * words, 0) AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nd LEFT JOIN tt ON tt.id = nd.p[nd.depth] LEFT JOIN ch ON ch.p = nd.p),
  up AS (SELECT p[1:k] AS p, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM sv) GROUP BY 1)
SELECT nd.conv_id, nd.depth, pa.conv_id AS parent_conv_id, nd.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(nd.ends) AS ends_sha256
FROM nd JOIN up ON up.p = nd.p LEFT JOIN ch ON ch.p = nd.p LEFT JOIN nd pa ON nd.depth > 0 AND pa.p = nd.p[1:nd.depth - 1]"""

ORACLES = {"op11_prefix_trie": OP11, "op12_ranked_search": OP12, "op4_secret_scan": OP4, "op2_ngram_join": OP2, "op8_vector_dedup": OP8, "op10_source_mix": OP10}
