"""DuckDB SQL for the queries that SQL can express at this size.

Suffix sorting (op2) would need every 100-byte string as a row; op4's XXH64,
op5's trees, op10's tokenizer and op13's eigenvectors have no SQL. Tests hold
those against brute force.
"""

from __future__ import annotations

from .quality import BINS, FEATURES, HIGHEST, LOWEST, UNIT, chi_square_consistency, chi_square_cut

WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

VANTAGE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM u),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

TEMPLATES = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS nth, unnest(ls) AS line FROM d),
t AS MATERIALIZED (SELECT *, ts[1:2] AS head, array_to_string(ts, ' ') AS whole, len(ts) AS n FROM (SELECT *, list_transform({WORDS.format(x="line")}, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ts FROM l) WHERE len(ts) >= 3),
w AS (SELECT n, head, whole, any_value(ts) AS ts, count(DISTINCT doc_id) AS docs FROM t GROUP BY n, head, whole),
f AS (SELECT n, head, sum(docs) AS of_leaf FROM w GROUP BY n, head HAVING sum(docs) >= 10),
k AS MATERIALIZED (SELECT w.*, of_leaf FROM w JOIN f USING (n, head)),
e AS (SELECT n, head, of_leaf, docs, whole, unnest(range(3, n + 1)) AS pos, unnest(ts[3:]) AS token FROM k),
c AS (SELECT n, head, pos, token FROM e WHERE token <> '<*>' GROUP BY n, head, pos, token HAVING sum(docs) >= greatest(10, ceil(0.02 * max(of_leaf)))),
p AS (SELECT e.n, e.head, whole, count(*) AS fixed, string_agg(e.pos || ' ' || e.token, ' ' ORDER BY e.pos) AS template FROM e JOIN c ON c.n = e.n AND c.head = e.head AND c.pos = e.pos AND c.token = e.token GROUP BY e.n, e.head, whole HAVING count(*) + 2 >= greatest(4, ceil(0.6 * e.n))),
y AS (SELECT doc_id, nth, [n::VARCHAR, 'whole', whole]::VARCHAR AS key FROM t UNION ALL SELECT doc_id, nth, [n::VARCHAR, head::VARCHAR, template]::VARCHAR FROM t JOIN p USING (n, head, whole)),
r AS (SELECT key, min(doc_id) AS first_id FROM y GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT DISTINCT y.doc_id, y.nth FROM y JOIN r USING (key) WHERE y.doc_id <> r.first_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, count(g.nth)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.nth) FILTER (g.nth IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = l.doc_id AND g.nth = l.nth GROUP BY d.doc_id, ls
"""

INTERLEAVE = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
b AS (SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: (strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1) AS bytes FROM documents),
r AS (SELECT doc_id, coalesce('v' || source, 'n') AS stratum, len(bytes)::BIGINT + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])))::BIGINT AS text_crc32, md5('17|' || coalesce(doc_id::VARCHAR, '')) AS key FROM b, tab),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction FROM r),
g AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, text_crc32, size) - 1 AS rank, count(*) OVER () AS total FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (rank * 40 // total)::INTEGER AS shard, (rank - (rank * 40 // total * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM g
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), s AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT *, list_transform(range(8), lambda k: list_reduce(list_transform(range(1, 6), lambda i: strpos('0123456789abcdef', hex[5 * k + i]) - 1), lambda a, b: a * 16 + b)) AS parts, max(page_id) OVER (PARTITION BY hex) AS largest FROM s)
SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda n: concat('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(n >> 15) + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((n >> 10) & 31) + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((n >> 5) & 31) + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(n & 31) + 1])), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM d
"""

MIX = rf"""
WITH r AS (SELECT doc_id, coalesce('v' || source, 'n') AS stratum, len({WORDS.format(x="coalesce(text, '')")})::BIGINT AS size, md5('23|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
z AS (SELECT sum(size)::BIGINT AS total, greatest(1, (sum(size) + 65535) // 65536)::BIGINT AS block FROM r),
s AS (SELECT stratum, sum(size)::BIGINT AS source_size FROM r GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY stratum = 'n', stratum) - 1 AS place FROM s),
x AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS ceiling FROM w),
y AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER a, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER a, 0))::DOUBLE AS level FROM x WINDOW a AS (ORDER BY ceiling / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT stratum, source_size, place, least(ceiling::DOUBLE, weight * max(level) OVER ()) AS target FROM y),
o AS (SELECT t.*, block, greatest(1, (2 * total + block) // (2 * block))::BIGINT AS seats, greatest(total, 1) AS total, count(*) OVER () AS n FROM t, z),
q AS (SELECT *, least(ceil(target * seats / total * (1 + n / (2 * seats)) + 1), 3 * ceil(source_size / block))::BIGINT AS offers FROM o),
j AS (SELECT stratum, place, seats, unnest(range(offers)) AS j, target / (2 * unnest(range(offers)) + 1) AS quotient FROM q),
won AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, place, j) AS seat FROM j),
quota AS (SELECT stratum, count(*) AS quota FROM won WHERE seat <= seats GROUP BY 1),
plan AS (SELECT o.stratum, o.place, o.target, o.source_size, o.block, coalesce(quota, 0)::BIGINT AS quota, greatest(ceil(source_size / block), 1)::BIGINT AS blocks FROM o LEFT JOIN quota USING (stratum)),
shuffled AS (SELECT stratum, b, row_number() OVER (PARTITION BY stratum ORDER BY md5('23|' || stratum || '|' || b), b) - 1 AS place FROM (SELECT stratum, unnest(range(blocks)) AS b FROM plan)),
times AS (SELECT stratum, b, quota // blocks + CASE WHEN shuffled.place < quota % blocks THEN 1 ELSE 0 END AS times FROM shuffled JOIN plan USING (stratum)),
placed AS (SELECT r.*, source_size, target, block, coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM r JOIN plan USING (stratum)),
pieces AS (SELECT *, unnest(range(ahead // block, CASE WHEN size = 0 THEN ahead // block + 1 ELSE (ahead + size - 1) // block + 1 END)) AS b FROM (SELECT *, row_number() OVER () AS nth FROM placed))
SELECT doc_id, size, source_size, target, coalesce(sum((least(ahead + size, (b + 1) * block) - greatest(ahead, b * block)) * times), 0)::BIGINT AS taken
FROM pieces LEFT JOIN times USING (stratum, b) GROUP BY nth, doc_id, size, source_size, target
"""

AUDIT = rf"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
f AS MATERIALIZED (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  [CASE WHEN len(ws) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' END, CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text) THEN 'C' END,
   CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN min(t.doc_id) OVER (PARTITION BY text) < t.doc_id THEN 'E' END] AS fails FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
k AS (SELECT part, list_filter(fails, lambda x: x IS NOT NULL) AS fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, letter, n, good, bad, list_contains(fails, letter) AS fails_it, len(list_intersect(fails, before)) > 0 AS gone, len(fails) = 1 AND list_contains(fails, letter) AS alone FROM k, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails_it AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails_it AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails_it AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (fails_it AND NOT gone), 0)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""

PASSAGES = rf"""
WITH d AS (SELECT row_number() OVER () AS nth, doc_id, {WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
w AS MATERIALIZED (SELECT nth, doc_id, i, array_to_string(ws[i : i + 49], ' ') AS words FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT words, min(doc_id) AS first_id FROM w GROUP BY 1),
g AS (SELECT DISTINCT nth, unnest(range(i, i + 50)) AS place FROM w JOIN f USING (words) WHERE first_id < doc_id),
p AS (SELECT nth, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS word FROM d),
k AS (SELECT p.nth, string_agg(word, ' ' ORDER BY p.place) AS kept, count(*) AS n FROM p ANTI JOIN g ON g.nth = p.nth AND g.place = p.place GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (nth)
"""



def quality_sql(share: float = 0.75, steps: int = 10, tail: float = 1e-5, least_rows: int = 100) -> str:
    """The estimates, all starts through all steps; where an operator's run stops earlier, further steps change nothing."""
    floors = list(FEATURES.values())
    p = len(floors)
    qs = range(p)
    pairs = [(i, k) for i in qs for k in range(i + 1)]
    ms = ", ".join(f"m{i}" for i in qs)
    rs = ", ".join(f"r{i}{k}" for i, k in pairs)
    group = '"group"'

    def middle(name: str, rows: str) -> str:
        per = f"SELECT {group}, f, v, sum(n) AS n FROM (SELECT {group}, n, unnest([{', '.join(map(str, qs))}]) AS f, unnest([{', '.join(f'q{i}' for i in qs)}]) AS v FROM {rows}) GROUP BY ALL"
        upto = f"SELECT *, sum(n) OVER (PARTITION BY {group}, f ORDER BY v) AS upto, sum(n) OVER (PARTITION BY {group}, f) AS total FROM ({per})"
        return f"{name} AS MATERIALIZED (SELECT {group}, {', '.join(f'min(v) FILTER (f = {i}) AS x{i}' for i in qs)} FROM ({upto}) WHERE 2 * upto >= total GROUP BY 1)"

    # Each entry of the root from those before it in the same list.
    entries = []
    for i, k in pairs:
        left = " - ".join([f"v{i}{k}", *(f"r{i}{j} * r{k}{j}" for j in range(k))])
        entries.append(f"sqrt(greatest({left}, {floors[i] ** 2!r}::DOUBLE)) AS r{i}{k}" if i == k else f"({left}) / r{k}{k} AS r{i}{k}")
    root = ", ".join([*entries, " * ".join(f"r{i}{i}" for i in qs) + " AS volume"])
    forward = [f"(q{i} / {UNIT}::DOUBLE - m{i}" + "".join(f" - r{i}{k} * y{k}" for k in range(i)) + f") / r{i}{i} AS y{i}" for i in qs]
    distance = ", ".join([*forward, " + ".join(f"y{i} * y{i}" for i in qs) + " AS d2"])

    def concentrated(name: str, model: str, part: float, start: str = "start") -> list[str]:
        factor = chi_square_consistency(p, part)
        return [
            f"near_{name} AS (SELECT c.*, {model}.* EXCLUDE ({group}, n, volume), {distance} FROM counts c JOIN {model} USING ({group}))",
            f"bins_{name} AS MATERIALIZED (SELECT {group}, {start} AS start, greatest({LOWEST}, least({HIGHEST}, floor({BINS} * log2(d2 + 1e-6))))::INT AS bin, sum(n) AS n, {', '.join(f'sum(n * q{i}) AS s{i}' for i in qs)}, {', '.join(f'sum(n * q{i} * q{k}) AS p{i}{k}' for i, k in pairs)} FROM near_{name} GROUP BY ALL)",
            f"kept_{name} AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY {group}, start ORDER BY bin) - n AS ahead, sum(n) OVER (PARTITION BY {group}, start) AS total FROM bins_{name}) WHERE ahead < {part} * total)",
            f"sum_{name} AS (SELECT {group}, start, max(total)::BIGINT AS n, sum(n)::DOUBLE AS h, {', '.join(f'sum(s{i})::DOUBLE / h / {UNIT} AS m{i}' for i in qs)}, {', '.join(f'sum(p{i}{k})::DOUBLE AS p{i}{k}' for i, k in pairs)} FROM kept_{name} GROUP BY 1, 2)",
            f"sc_{name} AS (SELECT {group}, start, n, {ms}, {', '.join(f'(p{i}{k} / h / {UNIT**2} - m{i} * m{k}) * {factor!r}::DOUBLE + {floors[i] ** 2 if i == k else 0.0!r}::DOUBLE AS v{i}{k}' for i, k in pairs)} FROM sum_{name})",
            f"{name} AS MATERIALIZED (SELECT {group}, start, n, {ms}, {rs}, volume FROM (SELECT *, {root} FROM sc_{name}))",
        ]

    forms = {1: lambda i: f"z{i} / sqrt(1 + z{i} * z{i})", 2: lambda i: f"CASE WHEN far > 0 THEN z{i} / far ELSE 0.0 END", 3: lambda i: f"sign(z{i})::DOUBLE"}

    def scatter(t: int, i: int, k: int) -> str:
        if i == k:
            return f"s{i} * s{i} AS v{i}{i}"
        size = f"sqrt(p{t}{i}{i} * p{t}{k}{k})"
        return f"0.0::DOUBLE AS v{i}{k}" if t == 0 else f"CASE WHEN {size} > 0 THEN p{t}{i}{k} / {size} ELSE 0.0 END * s{i} * s{k} AS v{i}{k}"

    starts = " UNION ALL ".join(f"SELECT {group}, {t} AS start, 0::BIGINT AS n, {', '.join(f'c{i} / {UNIT}::DOUBLE AS m{i}' for i in qs)}, {', '.join(scatter(t, i, k) for i, k in pairs)} FROM summed" for t in (0, *forms))
    parts = [
        r"d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('v' || lang, 'n') AS lk, coalesce('v' || source, 'n') AS sk FROM documents)",
        rf"w AS (SELECT *, {WORDS.format(x='text')} AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d)",
        "win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w))",
        "twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1)",
        "cov AS (SELECT doc_id, sum(step)::BIGINT AS rep FROM (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS step FROM twice) GROUP BY 1)",
        "st AS (SELECT w.doc_id, lk, sk, len(ws)::BIGINT AS n, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS wc, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS sy, len(ls) AS nl, (len(ls) - len(list_distinct(ls)))::BIGINT AS dl, coalesce(rep, 0) AS rep FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id)",
        f"ft AS MATERIALIZED (SELECT *, n < 20 OR 100 * rep > 30 * n AS bad, floor(ln(greatest(wc, 1) / greatest(n, 1)) * {UNIT} + 0.5)::BIGINT AS q0, floor(ln(1 + 100 * sy / greatest(n, 1)) * {UNIT} + 0.5)::BIGINT AS q1, floor(dl / greatest(nl, 1) * {UNIT} + 0.5)::BIGINT AS q2, floor(rep / greatest(n, 1) * {UNIT} + 0.5)::BIGINT AS q3 FROM st)",
        "ok AS (SELECT * FROM ft WHERE NOT bad)",
        "counts AS MATERIALIZED (SELECT \"group\", q0, q1, q2, q3, count(*) AS n FROM (SELECT unnest(['2' || chr(31) || lk || chr(31) || sk, '1' || chr(31) || lk, '0']) AS \"group\", q0, q1, q2, q3 FROM ok) GROUP BY ALL)",
        middle("med", "counts"),
        f"away AS (SELECT c.{group}, n, {', '.join(f'abs(q{i} - x{i}) AS q{i}' for i in qs)} FROM counts c JOIN med USING ({group}))",
        middle("mad", "away"),
        f"frame AS MATERIALIZED (SELECT med.{group}, {', '.join(f'med.x{i} AS c{i}, greatest(1.4826::DOUBLE * mad.x{i} / {UNIT}, {floors[i]!r}::DOUBLE) AS s{i}' for i in qs)} FROM med JOIN mad USING ({group}))",
        f"z AS (SELECT c.{group}, n, {', '.join(f'(q{i} - c{i}) / {UNIT}::DOUBLE / s{i} AS z{i}' for i in qs)}, sqrt({' + '.join(f'z{i} * z{i}' for i in qs)}) AS far FROM counts c JOIN frame USING ({group}))",
        f"b AS (SELECT {group}, n, {', '.join(f'{f(i)} AS b{t}{i}' for t, f in forms.items() for i in qs)} FROM z)",
        f"summed AS MATERIALIZED (SELECT * FROM frame JOIN (SELECT {group}, {', '.join(f'sum(n * floor(b{t}{i} * b{t}{k} * 1e6 + 0.5)::BIGINT)::DOUBLE AS p{t}{i}{k}' for t in forms for i, k in pairs)} FROM b GROUP BY 1) USING ({group}))",
        f"four AS MATERIALIZED (SELECT {group}, start, n, {ms}, {rs}, volume FROM (SELECT *, {root} FROM ({starts})))",
        f"first AS (SELECT * FROM four WHERE start = 0)",
        *concentrated("half", "first", 0.5, str(p)),
        "model0 AS MATERIALIZED (SELECT * FROM four UNION ALL SELECT * FROM half)",
    ]
    for step in range(steps):
        parts += concentrated(f"model{step + 1}", f"model{step}", share)
    columns = f"{ms}, {rs}"
    parts += [
        f"least AS (SELECT {group}, n, {columns} FROM model{steps} QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY volume, start) = 1)",
        "own AS (SELECT DISTINCT lk, sk FROM ok)",
        f"best AS (SELECT lk, sk, {columns} FROM (SELECT lk, sk, unnest(['2' || chr(31) || lk || chr(31) || sk, '1' || chr(31) || lk, '0']) AS \"group\", unnest([0, 1, 2]) AS nth FROM own) o JOIN least m USING ({group}) WHERE m.n >= {least_rows} OR nth = 2 QUALIFY row_number() OVER (PARTITION BY lk, sk ORDER BY nth) = 1)",
        f"judged AS (SELECT ft.*, {distance} FROM ft LEFT JOIN best ON ft.lk = best.lk AND ft.sk = best.sk)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, n AS n_words, wc AS word_chars, sy AS n_symbols, dl AS n_dup_lines, rep AS n_repeat_words, bad AS base_failed, CASE WHEN bad THEN false ELSE coalesce(d2 <= {chi_square_cut(p, tail)!r}::DOUBLE, true) END AS kept FROM judged"


ORACLES = {"op3_mcd": quality_sql(), "op1_vantage": VANTAGE, "op6_templates": TEMPLATES, "op7_interleave": INTERLEAVE, "op8_warc_members": WARC, "op9_sainte_lague": MIX, "op11_term_matrix": AUDIT, "op12_fm_index": PASSAGES}
