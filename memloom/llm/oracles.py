"""DuckDB SQL of the operators that SQL can express; written from the definitions, not from the operators."""

from __future__ import annotations

from . import exact

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Least label reachable over links(a, b), both directions given, for nodes(id).
_REACH = """
reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT l.a, r.c FROM reach r JOIN links l ON l.b = r.id WHERE r.c < l.a),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, c AS component_id, c = id AS kept FROM comp
"""

MIX = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, (CAST(('0x' || substr(md5('7:' || doc_id), 1, 12)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([1.0, 2.0, 3.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w, sum(cap) OVER q - cap AS cap_before, sum(w) OVER q - w AS w_before FROM w WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - cap_before) / (all_w - w_before) AS level FROM o),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM l WHERE cap > w * level ORDER BY cap / w, source NULLS LAST LIMIT 1)), cap) AS target FROM l),
r AS (SELECT *, greatest(0::DOUBLE, target - whole * source_size) AS residual FROM (SELECT *, floor(target / source_size)::BIGINT AS whole FROM t WHERE source_size > 0 UNION ALL SELECT *, 0 FROM t WHERE source_size = 0)),
k AS (SELECT source, len(bin(size)) AS k, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
v AS (SELECT r.*, k.k, coalesce(sum(words) OVER b, 0)::BIGINT AS certain, (sum(k.k * words) OVER (PARTITION BY k.source) - coalesce(sum(k.k * words) OVER b, 0))::BIGINT AS kw_left FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source WINDOW b AS (PARTITION BY k.source ORDER BY k.k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN kw_left > 0 THEN (residual - certain) / kw_left::DOUBLE END AS level FROM v),
o2 AS (SELECT source, max(k) AS open_k, max_by(level, k) AS open_level FROM m WHERE level * k < 1 GROUP BY 1),
i AS (SELECT m.*, CASE WHEN residual <= 0 THEN 0::DOUBLE WHEN open_k IS NULL OR k > open_k THEN 1::DOUBLE ELSE open_level * k END AS p FROM m LEFT JOIN o2 ON m.source IS NOT DISTINCT FROM o2.source),
x AS (SELECT d.doc_id, d.size, CASE WHEN p >= 1 THEN 0::DOUBLE WHEN p > 0 THEN d.u / (1 - d.u) / (p / (1 - p)) END AS pareto_rank, i.source, source_size, target, whole, residual, p FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source AND len(bin(d.size)) = i.k),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto_rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM x),
e AS (SELECT *, CASE WHEN residual > 0 AND pareto_rank IS NOT NULL AND upto - size / 2::DOUBLE <= residual AND upto - size < residual THEN 1 ELSE 0 END AS extra FROM c)
SELECT doc_id, size, source_size, target, (whole + extra) * size AS taken, whole + extra AS copies, pareto_rank, p FROM e
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) >= 5 THEN ws[i:i + 4] ELSE ws END) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = id AS kept FROM comp LEFT JOIN n ON n.doc_id = id
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, p, hash(ws[p:p + 19]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM again, (SELECT unnest(range(0, 20)) AS k)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS t, count(gone.p) AS n FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""



# The patterns, classes and allow-list of the secret scan, written out once more for this check.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_HELD = r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"
_ALLOWED = r"^[^0-9]*$|^[^A-Za-z]*$|^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$|^/?([A-Za-z0-9_-]{1,15}/)+[A-Za-z0-9_-]{0,15}$"


def _matches(source: str, text: str, pattern: str, group: int = 0) -> str:
    """Rows of ``source`` with their matches (hits, vals) and the text between them (gaps)."""
    p = pattern.replace("'", "''")
    return f"(SELECT doc_id, regexp_extract_all({text}, '{p}') AS hits, regexp_extract_all({text}, '{p}', {group}) AS vals, string_split_regex({text}, '{p}') AS gaps FROM {source})"


def _placed(kind: str, rank: int, matches: str) -> str:
    """Matches with their places, from the gaps between them."""
    start = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, i, ({start})::BIGINT AS s, ({start} + length(hits[i]))::BIGINT AS e, vals[i] AS v FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {matches})"


def _without(matches: str, gone: str) -> str:
    """The texts of ``matches`` with spaces for the matches whose number i is ``gone``."""
    return f"SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i > len(hits) THEN '' WHEN {gone} THEN repeat(' ', length(hits[i])) ELSE hits[i] END), '') AS t FROM {matches}"


def _secrets() -> str:
    steps = [f"a0 AS MATERIALIZED {_matches('d', 't', _ASSIGN, 2)}", f"f0 AS MATERIALIZED (SELECT * FROM ({_placed('assign', 0, 'a0')}) WHERE length(v) >= 8)"]
    steps += [f"f{i} AS ({_placed(k, i, _matches('d', 't', p))})" for i, (k, p) in enumerate((("access", "AKIA[A-Z0-9]{12,}"), ("hex", "[0-9a-f]{32,}")), 1)]
    steps.append(f"t3 AS MATERIALIZED ({_without('a0', 'length(vals[i]) >= 8')})")
    for i, (kind, pattern, bits) in enumerate((("entropy_base64", "[A-Za-z0-9+/_=-]{24,}", 3.9), ("entropy_hex", "[0-9A-Fa-f]{24,}", 3.0)), 3):
        counts = "list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x))::DOUBLE)"
        steps.append(
            f"a{i} AS MATERIALIZED {_matches(f't{i}', 't', pattern)}, w{i} AS (SELECT * EXCLUDE (o), string_split(substr(v, o, 24), '') AS c FROM (SELECT *, unnest(range(1, length(v) - 22)) AS o FROM ({_placed(kind, i, f'a{i}')}) WHERE NOT regexp_matches(v, '{_HELD}') AND NOT regexp_matches(v, '{_ALLOWED}'))), "
            f"f{i} AS MATERIALIZED (SELECT doc_id, rank, kind, i, s, e, v FROM w{i} GROUP BY ALL HAVING max(log2(24) - list_sum(list_transform({counts}, lambda n: n * log2(n))) / 24) >= {bits} - 1e-9), "
            f"l{i} AS (SELECT doc_id, list(i) AS gone FROM f{i} GROUP BY 1), t{i + 1} AS MATERIALIZED ({_without(f'(SELECT a{i}.*, gone FROM a{i} LEFT JOIN l{i} ON a{i}.doc_id = l{i}.doc_id)', 'list_contains(gone, i)')})"
        )
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    kinds = ("assign", "access", "hex")
    count = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    names = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    base, every = (" UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(n)) for n in (3, 5))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(steps)}, b AS (SELECT doc_id, {count}, {text} AS x FROM ({base}) GROUP BY 1), a AS (SELECT doc_id, {text} AS x FROM ({every}) GROUP BY 1) "
        f"SELECT d.doc_id, {names}, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN a ON d.doc_id = a.doc_id"
    )


SECRETS = _secrets()

_SHARE = "1 + 1000000000::HUGEINT * ({} + 2) // ({} + 2 * v)"
_APART = "(({0} - {1}) * ({0} - {1}) // ({0} + {1}))::BIGINT"

AUDIT = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS docs, sum(n) AS n FROM (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM t GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM k GROUP BY 1),
c AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, k.total, v, lang_size FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, {_SHARE.format("n", "(sum(n) OVER (PARTITION BY lang, source))")} AS p, {_SHARE.format("total", "lang_size")} AS q FROM c),
f AS (SELECT x.lang, x.source, y.source AS item, sum({_APART.format("x.p", "y.p")}) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_APART.format("p", "q")} AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op2_nn_descent": EMBEDDINGS, "op3_exact_dedup": exact.ORACLE, "op5_source_mix": MIX, "op6_minhash_dedup": NEAR, "op7_substring_dedup": REPEATS, "op10_secret_scan": SECRETS, "op11_source_divergence": AUDIT}
