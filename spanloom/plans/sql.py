"""The queries of the core as SQL for DuckDB, written from the definitions and not from the plans."""

from __future__ import annotations

from spanloom.plans.experiment import SETTINGS

_DEPTH = 4
_LENGTHS = SETTINGS.workload.lengths
_PER_LENGTH = SETTINGS.workload.per_length
_SEED = SETTINGS.workload.seed

_LE = "printf('%02X%02X%02X%02X', {t} & 255, ({t} >> 8) & 255, ({t} >> 16) & 255, ({t} >> 24) & 255)"

_WORDS = r"""
words AS (SELECT doc_id, shard, lower(trim(split, E' \t\r\n')) AS split,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda x: x <> '') AS ws FROM documents),
tokens AS (SELECT doc_id, split, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM words),
vocab AS (SELECT w, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS tok FROM tokens GROUP BY w),
tk AS MATERIALIZED (SELECT doc_id, split, pos, tok, """ + _LE.format(t="tok") + """ AS key FROM tokens JOIN vocab USING (w))"""

_RANKS = """
train AS (SELECT doc_id, len(ws) AS n FROM words WHERE split = 'train'),
num AS (SELECT coalesce(sum(n + 1), 0)::BIGINT AS num_ranks FROM train),
seq AS (SELECT doc_id, pos, key FROM tk WHERE split = 'train' UNION ALL
    SELECT doc_id, n + 1, 'FFFFFFFF' FROM train WHERE doc_id < (SELECT max(doc_id) FROM train))"""


def _suffixes(name: str, depth: int) -> str:
    """Suffixes cut after depth tokens and the first separator, with their counts."""
    parts = "".join(f" || coalesce(lead(key, {i}) OVER o, '')" for i in range(1, depth))
    return f"""
{name}_all AS (SELECT k FROM (SELECT key, key{parts} AS k FROM seq WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE key <> 'FFFFFFFF'
    UNION ALL SELECT 'FFFFFFFF' FROM train),
{name} AS (SELECT k, count(*) AS cnt FROM {name}_all GROUP BY k)"""


def _level(depth: int) -> str:
    w = 8 * depth
    return f"""
g{depth} AS (SELECT {depth} AS depth, k AS key, (r - cnt)::BIGINT AS lo, r::BIGINT AS hi, cnt FROM
    (SELECT k, cnt, sum(cnt) OVER (ORDER BY k) AS r FROM s{depth}) WHERE length(k) = {w} AND right(k, 8) <> 'FFFFFFFF')"""


_GRAMS = ",".join([_WORDS, _RANKS, *(_suffixes(f"s{d}", d) for d in range(1, _DEPTH + 1)), *(_level(d) for d in range(1, _DEPTH + 1))]) + """,
root AS (SELECT 0 AS depth, '' AS key, 0::BIGINT AS lo, num_ranks AS hi, num_ranks AS cnt FROM num)"""


def _upto(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM g{d}" for d in range(1, depth + 1))


def _cost(d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN 0 ELSE 4 * {d} + 10 END)"


def _fixed(depth: int, name: str = "fixed") -> str:
    return f"""
{name}_rows AS (SELECT * FROM root UNION ALL {_upto(depth)}),
{name}_ends AS (SELECT depth - 1 AS depth, (sum(count(*)) OVER (ORDER BY depth))::BIGINT AS expanded_at FROM {name}_rows GROUP BY depth),
{name} AS (SELECT row_number() OVER (ORDER BY r.depth, lo) - 1 AS entry_no, key, r.depth, lo, hi, cnt, expanded_at,
    (sum({_cost('r.depth')}) OVER (ORDER BY r.depth, lo))::BIGINT AS cum_bytes FROM {name}_rows r LEFT JOIN {name}_ends e ON r.depth = e.depth)"""


#: Doublings of what a rank stands for; enough for repeats of 2**17 tokens.
_DOUBLINGS = 17


def _ranks() -> str:
    """Ranks of all suffixes by prefix doubling; the end of the stream sorts first."""
    flat = """
whole AS MATERIALIZED (SELECT doc_id, 0 AS pos, n, 'FFFFFFFF' AS key, row_number() OVER () AS any FROM train UNION ALL SELECT doc_id, pos, n, key, 0 FROM tk JOIN train USING (doc_id)),
spots AS MATERIALIZED (SELECT row_number() OVER o - 1 AS p, doc_id, pos, CASE WHEN pos = 0 THEN 0 ELSE n - pos + 1 END AS room, key, left(key""" + "".join(f" || coalesce(lead(key, {i}) OVER o, '')" for i in range(1, 10)) + """, 80) AS key10 FROM whole WINDOW o AS (ORDER BY doc_id, pos)),
k0 AS MATERIALIZED (SELECT p, rank() OVER (ORDER BY key) AS r FROM spots)"""
    step = "k{j} AS MATERIALIZED (SELECT a.p, rank() OVER (ORDER BY a.r, coalesce(b.r, 0)) AS r FROM k{i} a LEFT JOIN k{i} b ON b.p = a.p + {span})"
    return ",".join([flat, *(step.format(j=i + 1, i=i, span=1 << i) for i in range(_DOUBLINGS))])


def _nodes() -> str:
    """All windows whose parent occurs twice, and those of up to two tokens: of neighbours in the
    order of suffixes the common tokens are counted, and a window is a stretch of ranks."""
    out = f"""
near0 AS MATERIALIZED (SELECT a.r - 1 AS rank, b.p AS x, a.p AS y, 0 AS n FROM k{_DOUBLINGS} a JOIN k{_DOUBLINGS} b ON b.r = a.r - 1)"""
    for i, j in enumerate(range(_DOUBLINGS, -1, -1)):
        out += f""",
near{i + 1} AS MATERIALIZED (SELECT rank, x, y, n + CASE WHEN u.r = v.r THEN {1 << j} ELSE 0 END AS n FROM near{i} LEFT JOIN k{j} u ON u.p = x + n LEFT JOIN k{j} v ON v.p = y + n)"""
    return _ranks() + "," + out + f""",
sa AS MATERIALIZED (SELECT k.r - 1 AS rank, t.p, t.room, least(coalesce(n, 0), t.room, coalesce(o.room, 0)) AS same FROM k{_DOUBLINGS} k JOIN spots t ON t.p = k.p LEFT JOIN near{_DOUBLINGS + 1} m ON m.rank = k.r - 1 LEFT JOIN spots o ON o.p = m.x),
sb AS (SELECT *, greatest(same, coalesce(lead(same) OVER (ORDER BY rank), 0)) AS m FROM sa),
flat AS (SELECT rank, p, same, unnest(range(1, least(room, greatest(m + 1, 2)) + 1)) AS depth FROM sb),
grouped AS (SELECT *, sum((same < depth)::INT) OVER (PARTITION BY depth ORDER BY rank) AS g FROM flat),
placed AS MATERIALIZED (SELECT depth::INT AS depth, rank, p, min(rank) OVER w AS lo, count(*) OVER w AS cnt FROM grouped WINDOW w AS (PARTITION BY depth, g)),
nodes AS MATERIALIZED (SELECT n.depth, n.p, n.lo, n.lo + n.cnt AS hi, n.cnt, coalesce(u.lo, 0) AS up, coalesce(u.cnt, num_ranks) AS up_cnt FROM num, placed n LEFT JOIN placed u ON u.depth = n.depth - 1 AND u.rank = n.lo WHERE n.rank = n.lo)"""


def _greedy(floor: int) -> str:
    n = f"greedy{floor}"
    return f"""
{n}_all AS (
    SELECT depth, NULL::BIGINT AS p, lo, hi, cnt, 0 AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0::BIGINT AS d, 0 AS e, 0::BIGINT AS f, 0::BIGINT AS g FROM root
    UNION ALL SELECT depth, p, lo, hi, cnt, 0, 0, depth, 0, 0, 0, lo FROM nodes WHERE depth <= {floor}
    UNION ALL SELECT depth, p, lo, hi, cnt, 1, -up_cnt, depth - 1, up, 0, -cnt, lo FROM nodes WHERE depth > {floor} AND up_cnt >= 2
    UNION ALL SELECT depth, NULL, lo, NULL, NULL, 1, -cnt, depth, lo, 1, 0, 0 FROM (SELECT depth, lo, cnt FROM nodes UNION ALL SELECT depth, lo, cnt FROM root) WHERE depth >= {floor} AND cnt >= 2),
{n}_ran AS MATERIALIZED (SELECT *, count(cnt) OVER o AS number, (sum(CASE WHEN cnt IS NULL THEN 0 ELSE {_cost('depth')} END) OVER o)::BIGINT AS cum_bytes FROM {n}_all WINDOW o AS (ORDER BY a, b, c, d, e, f, g ROWS UNBOUNDED PRECEDING)),
{n}_fit AS MATERIALIZED (SELECT * FROM {n}_ran WHERE cnt IS NOT NULL AND cum_bytes <= (SELECT max(budget) FROM all_budgets)),
{n}_ends AS (SELECT depth - 1 AS depth, (sum(count(*)) OVER (ORDER BY depth))::BIGINT AS by_level FROM {n}_fit WHERE depth <= {floor} GROUP BY depth),
{n} AS MATERIALIZED (SELECT r.number - 1 AS entry_no, r.p, r.depth, r.lo, r.hi, r.cnt, coalesce(by_level, m.number) AS expanded_at, r.cum_bytes
    FROM {n}_fit r LEFT JOIN {n}_ran m ON m.cnt IS NULL AND m.depth = r.depth AND m.lo = r.lo AND m.number <= (SELECT count(*) FROM {n}_fit) LEFT JOIN {n}_ends e ON e.depth = r.depth)"""


_LENGTH_LIST = ", ".join(f"({n})" for n in _LENGTHS)
_QUERIES = f"""
lengths AS (SELECT l AS length FROM (VALUES {_LENGTH_LIST}) t(l)),
held AS (SELECT doc_id, len(ws) AS n FROM words WHERE split IN (SELECT lower(trim(split, E' \\t\\r\\n')) FROM heldout_config)),
room AS (SELECT doc_id, length, n - length + 1 AS n, (sum(n - length + 1) OVER (PARTITION BY length ORDER BY doc_id))::BIGINT AS upto FROM held, lengths WHERE n >= length),
totals AS (SELECT length, sum(n)::BIGINT AS windows FROM room GROUP BY length),
draws AS (SELECT length, qid, ('0x' || substr(md5('{_SEED}|' || length || '|' || qid), 1, 8))::BIGINT % windows AS w FROM totals, range({_PER_LENGTH}) q(qid)),
picked AS (SELECT d.length, d.qid, r.doc_id, d.w - (r.upto - r.n) + 1 AS pos FROM draws d JOIN room r ON r.length = d.length AND d.w < r.upto AND d.w >= r.upto - r.n),
q AS (SELECT length, qid::INT AS qid, string_agg(key, '' ORDER BY tk.pos) AS key FROM picked p JOIN tk ON tk.doc_id = p.doc_id AND tk.pos >= p.pos AND tk.pos < p.pos + p.length GROUP BY length, qid)"""

_LOCATED = _suffixes("s10", 10) + """,
qk AS (SELECT DISTINCT key FROM q),
events AS (SELECT k || '!' AS a, cnt, NULL AS key FROM s10 UNION ALL SELECT key || ' ', 0, key FROM qk UNION ALL SELECT key || '~', 0, key FROM qk),
located AS (SELECT key, min(r)::BIGINT AS lo, max(r)::BIGINT AS hi FROM (SELECT key, sum(cnt) OVER (ORDER BY a) AS r FROM events) WHERE key IS NOT NULL GROUP BY key)"""

#: Probes of a search, one row for each state; cases has (id, lo, hi, l, r).
_STEPS = """
walk AS (
    SELECT id, l, r, 0 AS phase, lo AS a, hi AS b, lo AS mi, hi AS top, 0::BIGINT AS steps FROM cases
    UNION ALL
    SELECT id, l, r,
        CASE WHEN phase = 0 AND a >= b THEN 9 WHEN phase = 0 AND m >= l AND m < r THEN 1 WHEN phase = 1 AND b - a <= 1 THEN 2 WHEN phase = 2 AND b - a <= 1 THEN 9 ELSE phase END,
        CASE WHEN phase = 0 AND a < b THEN CASE WHEN m < l THEN m + 1 WHEN m >= r THEN a ELSE a - 1 END WHEN phase = 1 AND b - a <= 1 THEN mi WHEN phase = 1 AND m1 < l THEN m1 WHEN phase = 2 AND b - a > 1 AND m1 < r THEN m1 ELSE a END,
        CASE WHEN phase = 0 AND a < b THEN CASE WHEN m < l THEN b ELSE m END WHEN phase = 1 AND b - a <= 1 THEN top WHEN phase = 1 AND m1 >= l THEN m1 WHEN phase = 2 AND b - a > 1 AND m1 >= r THEN m1 ELSE b END,
        CASE WHEN phase = 0 AND a < b THEN m ELSE mi END,
        CASE WHEN phase = 0 AND a < b AND m >= l AND m < r THEN b ELSE top END,
        steps + CASE WHEN phase = 0 AND a < b OR phase IN (1, 2) AND b - a > 1 THEN 1 ELSE 0 END
    FROM (SELECT *, (a + b - 1) // 2 AS m, (a + b) // 2 AS m1 FROM walk) WHERE phase < 9),
stepped AS (SELECT id, max(steps) AS steps FROM walk GROUP BY id)"""

_FIXED_CACHES = ",".join(["""
none AS (SELECT 0::BIGINT AS entry_no, key, depth, lo, hi, cnt, NULL::BIGINT AS expanded_at, 0::BIGINT AS cum_bytes FROM root)""", _fixed(1, "unigram"), _fixed(2, "bigram"), _fixed(3, "trigram")]) + """,
fixed_caches AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS policy, {d} AS floor_depth, (SELECT max(cum_bytes) FROM {n}) AS budget, (SELECT count(*) FROM {n}) AS entries, * FROM {n}" for d, n in enumerate(("none", "unigram", "bigram", "trigram"))) + ")"

_TEXTS = "texts AS (SELECT doc_id, string_agg(key, '' ORDER BY pos) AS s FROM tk GROUP BY doc_id)"

_BUDGETS = """
all_budgets AS MATERIALIZED (SELECT budget FROM budgets WHERE budget IS NOT NULL UNION SELECT max(cum_bytes) FROM unigram UNION SELECT max(cum_bytes) FROM bigram UNION SELECT max(cum_bytes) FROM trigram)"""

_GREEDY_CACHES = ",".join([_BUDGETS, _nodes(), _greedy(0), _greedy(2)]) + """,
limits AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT {f} AS floor_depth, budget, count(*) AS entries, max(cum_bytes) AS bytes FROM greedy{f} JOIN all_budgets ON cum_bytes <= budget GROUP BY budget HAVING count(*) >= (SELECT count(*) FROM greedy{f} WHERE depth <= {f})" for f in (0, 2)) + """),
greedy_caches AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT 'greedy' AS policy, {f} AS floor_depth, l.budget, l.entries, entry_no, coalesce(left(key10, 8 * depth), '') AS key, depth, lo, hi, expanded_at FROM greedy{f} g JOIN limits l ON l.floor_depth = {f} AND g.entry_no < l.entries LEFT JOIN spots USING (p) WHERE depth <= 10" for f in (0, 2)) + ")"


def _resolved(caches: str, name: str) -> str:
    """Longest cached prefix, then the answer or a search in its ranks."""
    return f"""
{name}_hits AS (SELECT q.length, qid, q.key AS query, policy, floor_depth, budget, c.depth, lo, hi, c.depth = q.length AS exact, coalesce(expanded_at <= entries, false) AS expanded
    FROM q, range(0, 11) p(d), {caches} c WHERE d <= q.length AND c.key = left(q.key, 8 * d::INT) AND entry_no < entries
    QUALIFY row_number() OVER (PARTITION BY q.length, qid, policy, floor_depth, budget ORDER BY c.depth DESC) = 1),
{name}_rows AS (SELECT row_number() OVER () AS id, h.*, t.lo AS l, t.hi AS r FROM {name}_hits h JOIN located t ON t.key = h.query)"""


def _solved(name: str) -> str:
    return f""",
cases AS (SELECT DISTINCT lo || '|' || hi || '|' || l || '|' || r AS id, lo, hi, l, r FROM {name}_rows WHERE NOT exact AND NOT expanded),{_STEPS},
solved AS (SELECT h.*, CASE WHEN exact THEN hi - lo WHEN expanded THEN 0 ELSE r - l END AS cnt, CASE WHEN exact OR expanded THEN lo ELSE l END AS found_lo, CASE WHEN exact THEN hi WHEN expanded THEN lo ELSE r END AS found_hi,
    coalesce(steps, 0) AS steps FROM {name}_rows h LEFT JOIN stepped s ON s.id = lo || '|' || hi || '|' || l || '|' || r AND NOT exact AND NOT expanded)"""


_SUMMARY = "SELECT policy, floor_depth, budget, length, count(*) AS queries, sum(steps)::BIGINT::DOUBLE / count(*) AS mean, quantile_cont(steps, 0.5)::DOUBLE AS p50, quantile_cont(steps, 0.99)::DOUBLE AS p99 FROM solved GROUP BY ALL"


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)} {select}"



def _experiment(select: str, fixed: bool, greedy: bool) -> str:
    parts = [_GRAMS, _QUERIES, _LOCATED, _FIXED_CACHES]
    if greedy:
        parts.append(_GREEDY_CACHES)
    names = []
    if fixed:
        parts.append(_resolved("fixed_caches", "f"))
        names.append("f")
    if greedy:
        parts.append(_resolved("greedy_caches", "e"))
        names.append("e")
    parts.append("x_rows AS (" + " UNION ALL ".join(f"SELECT * FROM {n}_rows" for n in names) + ")")
    return "WITH RECURSIVE " + ",".join(parts) + _solved("x") + f", summary AS ({_SUMMARY}) " + select


_SIZES = """(SELECT policy, floor_depth, budget, count(*) AS entries, max(cum_bytes) AS bytes FROM fixed_caches GROUP BY ALL
    UNION ALL SELECT 'greedy', floor_depth, budget, entries, bytes FROM limits)"""

_HITS = r"""
h AS (SELECT lookup_id, arrived_at, regexp_replace(regexp_replace(upper(key), '^[^0-9A-F]*0X', ''), '[^0-9A-F]', '', 'g') AS key, greatest(lo, hi) - least(lo, hi) AS size, lo, hi FROM hits)"""

SQL = {
    "tokenize_docs": _with(_WORDS, select="SELECT d.doc_id, len(ws) AS n_tokens, coalesce(k, '') AS key FROM words d LEFT JOIN (SELECT doc_id, string_agg(key, '' ORDER BY pos) AS k FROM tk GROUP BY doc_id) USING (doc_id)"),
    "vocab_ids": _with(_WORDS, select=f"SELECT w, tok, cnt, {_LE.format(t='tok')} AS key FROM vocab"),
    "corpus_prefix_limit": _with(_WORDS, select="SELECT doc_id, doc_no, n_tokens FROM (SELECT doc_id, row_number() OVER o - 1 AS doc_no, len(ws) + 1 AS n_tokens, sum(len(ws) + 1) OVER o AS upto FROM words WINDOW o AS (ORDER BY doc_id)) WHERE upto <= 100000 AND doc_no < 500"),
    "doc_offsets": _with(_WORDS, select="SELECT doc_id, n AS n_tokens, (upto - n)::BIGINT AS first_rank, (4 * (upto - n))::BIGINT AS byte_offset, ((4 * upto - 1) // 4096 - (4 * (upto - n)) // 4096 + 1)::BIGINT AS pages FROM (SELECT doc_id, len(ws) + 1 AS n, (sum(len(ws) + 1) OVER (ORDER BY doc_id))::BIGINT AS upto FROM words)"),
    "corpus_stats": _with(_WORDS, _RANKS, select="SELECT (SELECT count(*) FROM train) AS documents, num_ranks, 4 * num_ranks AS ds_size, p AS ptr_size, 4 * num_ranks + num_ranks * p AS index_bytes FROM (SELECT num_ranks, (SELECT min(i) FROM range(1, 9) t(i) WHERE pow(256, i) >= 4 * num_ranks)::INT AS p FROM num)"),
    "shard_meta": _with(_WORDS, select="SELECT printf('en/web-%s.%05d-of-%05d.json.gz', split, shard, max(shard + 1) OVER (PARTITION BY split)) AS file_name, tokens, documents FROM (SELECT split, shard, sum(len(ws) + 1)::BIGINT AS tokens, count(*) AS documents FROM words WHERE split IS NOT NULL AND shard IS NOT NULL GROUP BY split, shard)"),
    "unigram_counts": _with(_WORDS, select="SELECT key, count(*) AS cnt FROM tk GROUP BY key"),
    "bigram_counts": _with(_WORDS, select="SELECT key, count(*) AS cnt FROM (SELECT key || lead(key) OVER (PARTITION BY doc_id ORDER BY pos) AS key FROM tk) WHERE key IS NOT NULL GROUP BY key"),
    "trigram_counts": _with(_WORDS, select="SELECT key, count(*) AS cnt FROM (SELECT key || lead(key) OVER o || lead(key, 2) OVER o AS key FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE key IS NOT NULL GROUP BY key"),
    "distinct_grams_by_depth": _with(_GRAMS, select=f"SELECT depth, count(*) AS grams, sum(cnt)::BIGINT AS occurrences, max(cnt) AS top, CASE depth WHEN 1 THEN 'unigram' WHEN 2 THEN 'bigram' WHEN 3 THEN 'trigram' ELSE depth || '-gram' END AS name FROM ({_upto(_DEPTH)}) GROUP BY depth"),
    "next_tokens_of_prefix": _with(_GRAMS, select="SELECT left(key, 8) AS parent_key, right(key, 8) AS next_token_key, lo, hi, cnt, row_number() OVER (PARTITION BY left(key, 8) ORDER BY cnt DESC, lo)::INT AS place FROM g2"),
    **{f"gram_intervals_d{d}": _with(_GRAMS, select=f"SELECT key, lo, hi, cnt FROM g{d}") for d in (1, 2, 3)},
    "query_windows": _with(_WORDS, _QUERIES, select="SELECT length, qid, key FROM q"),
    "query_counts": _with(_WORDS, _RANKS, _QUERIES, _suffixes("s10", 10), select="SELECT length, qid, coalesce(sum(cnt), 0)::BIGINT AS cnt FROM q LEFT JOIN s10 ON k >= key AND k < key || 'G' GROUP BY length, qid"),
    "query_intervals_absent": _with(_WORDS, _RANKS, _QUERIES, _LOCATED, select="SELECT length, qid, key, lo, hi FROM q JOIN located USING (key)"),
    "uncached_steps": _experiment("SELECT length, qid, found_lo, found_hi, steps FROM solved WHERE policy = 'none'", True, False),
    "fixed_cache_unigram": _with(_GRAMS, _fixed(1), select="SELECT * FROM fixed"),
    "fixed_cache_bigram": _with(_GRAMS, _fixed(2), select="SELECT * FROM fixed"),
    "fixed_cache_trigram": _with(_GRAMS, _fixed(3), select="SELECT * FROM fixed"),
    "fixed_cache_snapshot": _with(_GRAMS, _fixed(3), select="SELECT budget, count(*) AS entries, max(cum_bytes) AS bytes FROM fixed JOIN (SELECT DISTINCT budget FROM budgets) ON cum_bytes <= budget GROUP BY budget"),
    "greedy_cache_floor0": _with(_GRAMS, _FIXED_CACHES, _BUDGETS, _nodes(), _greedy(0), _TEXTS, select="SELECT entry_no, md5(coalesce(substr(s, 8 * (pos - 1) + 1, 8 * depth), '')) AS key_md5, depth, lo, hi, cnt, expanded_at, cum_bytes FROM greedy0 LEFT JOIN spots USING (p) LEFT JOIN texts USING (doc_id)"),
    "greedy_cache_floor2": _with(_GRAMS, _FIXED_CACHES, _BUDGETS, _nodes(), _greedy(2), _TEXTS, select="SELECT entry_no, md5(coalesce(substr(s, 8 * (pos - 1) + 1, 8 * depth), '')) AS key_md5, depth, lo, hi, cnt, expanded_at, cum_bytes FROM greedy2 LEFT JOIN spots USING (p) LEFT JOIN texts USING (doc_id)"),
    "greedy_snapshots": _with(_GRAMS, _FIXED_CACHES, _GREEDY_CACHES, select="SELECT floor_depth, budget, entries, bytes FROM limits"),
    "longest_prefix_hit": _experiment("SELECT floor_depth, budget, length, qid, depth, lo, hi, exact, expanded FROM solved", False, True),
    "cached_resolve": _experiment("SELECT policy, length, qid, cnt, steps FROM solved", True, False),
    "steps_summary_fixed": _experiment("SELECT policy, budget, length, queries, mean, p50, p99 FROM summary", True, False),
    "steps_summary_greedy": _experiment("SELECT floor_depth, budget, length, queries, mean, p50, p99 FROM summary", False, True),
    "steps_by_length": _experiment("""SELECT length, max(mean) FILTER (policy = 'none') AS no_cache, max(mean) FILTER (policy = 'unigram') AS unigram, max(mean) FILTER (policy = 'bigram') AS bigram, max(mean) FILTER (policy = 'trigram') AS trigram,
        max(mean) FILTER (policy = 'greedy' AND floor_depth = 0) AS greedy0, max(mean) FILTER (policy = 'greedy' AND floor_depth = 2) AS greedy2 FROM summary WHERE policy <> 'greedy' OR budget = (SELECT max(cum_bytes) FROM trigram) GROUP BY length""", True, True),
    "pareto_points": _experiment(f"SELECT s.policy, s.floor_depth, s.budget, z.entries, z.bytes, mean, (SELECT mean FROM summary WHERE policy = 'none' AND length = 4) / greatest(mean, 1e-9) AS speedup FROM summary s JOIN {_SIZES} z USING (policy, floor_depth, budget) WHERE length = 4", True, True),
    "fixed_vs_greedy_ratio": _experiment("SELECT f.policy, f.budget, f.length, f.mean AS fixed_steps, g.mean AS greedy_steps, f.mean / greatest(g.mean, 1e-9) AS ratio FROM summary f JOIN summary g ON g.policy = 'greedy' AND g.floor_depth = 0 AND g.budget = f.budget AND g.length = f.length WHERE f.policy NOT IN ('none', 'greedy')", True, True),
    "latency_set": _experiment("SELECT policy, floor_depth, budget, count(*) AS queries, sum(steps)::BIGINT AS steps, greatest(sum(steps), 1)::BIGINT AS divisor FROM solved WHERE length = 4 AND qid < 1000 GROUP BY ALL", True, True),
    "exact_suffix_rank": _with(_WORDS, _RANKS, _ranks(), select=f"SELECT p AS pos, r - 1 AS rank FROM k{_DOUBLINGS}"),
    "p1_found": _with(_HITS, select="SELECT key FROM h WHERE lookup_id IS NOT NULL AND key <> '' GROUP BY key HAVING count(DISTINCT lookup_id) >= (SELECT count(DISTINCT lookup_id) FROM hits) * 0.015"),
    "p1_key_totals": _with(_HITS, """one AS (SELECT key, lookup_id, CASE WHEN lo IS NULL OR hi IS NULL THEN NULL ELSE size END AS size FROM h WHERE lookup_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY key, lookup_id ORDER BY (lo IS NULL OR hi IS NULL), arrived_at NULLS LAST, size) = 1)""", select="SELECT key, count(*) AS lookups, coalesce(sum(size), 0)::BIGINT AS intervals, (count(*) - count(size))::BIGINT AS missing FROM one GROUP BY key"),
    "p1_key_stats": _with(_HITS, "v AS (SELECT key, CASE WHEN lo IS NULL OR hi IS NULL THEN NULL ELSE size END AS size FROM h)", "w AS (SELECT key, size, count(*) AS n FROM v WHERE size IS NOT NULL GROUP BY key, size)", "m AS (SELECT key, size AS mode FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, size) = 1)",
        select="SELECT v.key, count(size) AS n, count(DISTINCT size) AS n_distinct, max(m.mode) AS mode, min(size) AS least, max(size) AS greatest, quantile_disc(size, 0.5) AS p50, quantile_disc(size, 0.99) AS p99 FROM v LEFT JOIN m ON m.key IS NOT DISTINCT FROM v.key GROUP BY v.key"),
}
