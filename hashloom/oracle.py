"""The named queries as DuckDB SQL, written apart from the engine. A query's text holds only the common tables that it uses."""

from __future__ import annotations

import re

from .queries import ALPHA, BINS, BITS, CURVE, DIM, EVERY, HIDDEN, MAX_SCORE, MLP, linear_weights


def _num(x: float) -> str:
    return f"{float(x)!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0"


def _list(xs) -> str:
    return "[" + ", ".join(map(_num, xs)) + "]"


def sq(a: str, b: str) -> str:
    return f"list_reduce(list_prepend(0e0, list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda s, y: s + y)"


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_prepend(0e0, list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])), lambda s, y: s + y)"


def _encoded(model: int = 0) -> str:
    return "SELECT vec_id, label, e, [" + ", ".join(dot("e", _list(w)) for w in linear_weights(model)) + "] AS x FROM v"


def _layer(layer, v: str) -> str:
    each = (f"{dot(v, _list(w))} + {_num(b)}" for w, b in zip(layer.weights, layer.bias))
    return "[" + ", ".join(f"greatest({x}, 0e0)" if layer.relu else x for x in each) + "]"


def _code(x: str, t: str, op: str = ">=") -> str:
    return "(" + " + ".join(f"CASE WHEN {x}[{k + 1}] {op} {t}[{k + 1}] THEN {1 << k}::BIGINT ELSE 0::BIGINT END" for k in range(BITS)) + ")"


def _margin(x: str, t: str, differ: str) -> str:
    return "(" + " + ".join(["0e0", *(f"CASE WHEN ({differ} >> {k}) & 1 = 1 THEN abs({x}[{k + 1}] - {t}[{k + 1}]) ELSE 0e0 END" for k in range(BITS))]) + ")"


def _thresholds(enc: str) -> str:
    return f"SELECT list(m ORDER BY k) AS t FROM (SELECT k, quantile_cont(y, 0.5) AS m FROM (SELECT k, x[k + 1] AS y FROM {enc}, ks) GROUP BY k)"


def _plan(lsel: int, rmax: int) -> str:
    rev = " + ".join(f"(((mask >> {r}) & 1) << {lsel - 1 - r})" for r in range(lsel))
    return f"SELECT mask, row_number() OVER (ORDER BY bit_count(mask), {rev} DESC) - 1 AS plan_idx FROM (SELECT range AS mask FROM range({1 << lsel})) WHERE bit_count(mask) <= {rmax}"


def _probes(lsel: int, rmax: int, limit: str = "") -> str:
    return f"""SELECT p.qid, plan_idx, xor(base, coalesce(sum(1::BIGINT << bit), 0)::BIGINT) AS code, coalesce(sum(cost ORDER BY rnk), 0e0) AS score
        FROM (SELECT qc.qid, base, plan_idx, mask FROM qc, ({_plan(lsel, rmax)})) p
        LEFT JOIN ranks ON ranks.qid = p.qid AND (mask >> rnk::INTEGER) & 1 = 1 GROUP BY p.qid, base, plan_idx {limit}"""


def _nearest(points: str, cents: str) -> str:
    return f"""SELECT vec_id, code, x, cid, d2 FROM (SELECT p.vec_id, p.code, p.x, c.cid, {sq('p.x', 'c.ce')} AS d2,
        row_number() OVER (PARTITION BY p.vec_id ORDER BY {sq('p.x', 'c.ce')}, c.cid) AS r FROM {points} p JOIN {cents} c ON p.code = c.code) WHERE r = 1"""


def _moved(members: str, cents: str) -> str:
    return f"""SELECT c.code, c.cid, coalesce(m.ce, c.ce) AS ce FROM {cents} c LEFT JOIN (SELECT code, cid, list(y ORDER BY k) AS ce FROM
        (SELECT code, cid, k, round(avg(x[k + 1]), 9) AS y FROM {members}, ks GROUP BY ALL) GROUP BY ALL) m ON c.code = m.code AND c.cid = m.cid"""


def _top(src: str, k: int, dist: str = "dist") -> str:
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {dist}, vec_id)::INTEGER AS rank, vec_id, {dist} AS dist FROM {src} QUALIFY rank <= {k}"


def _recall(src: str) -> str:
    return f"""SELECT round(avg(r), 9) AS recall FROM (SELECT t.qid, count(f.vec_id) / count(*)::DOUBLE AS r FROM gt t LEFT JOIN {src} f
        ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid)"""


_RANKED_BALANCE = "count(*) AS nonempty, max(n) AS max_n, " + ", ".join(f"floor(quantile_cont(n::DOUBLE, {q}))::BIGINT AS {p}" for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999), ("p9999", 0.9999)))


def _balance(src: str, group: str = "") -> str:
    by, lead = (f"GROUP BY {group}", f"{group}, ") if group else ("", "")
    return f"""SELECT {lead}{1 << BITS}::BIGINT AS nlist, nonempty, ({1 << BITS} - nonempty)::BIGINT AS empty, round(({1 << BITS} - nonempty) / {1 << BITS}::DOUBLE, 9) AS empty_ratio,
        max_n, p50, p90, p99, p999, p9999 FROM (SELECT {lead}{_RANKED_BALANCE} FROM {src} {by})"""


def _half_up(q: float) -> str:
    return f"list(n ORDER BY n)[floor({q} * (count(*) - 1) + 0.5)::BIGINT + 1]"


_KNOTS = [*CURVE]


def _curve(x: str) -> str:
    out = f"CASE WHEN {x} < {_num(_KNOTS[0][0])} THEN {_num(_KNOTS[0][1])}"
    for (a, ya), (b, yb) in zip(_KNOTS, _KNOTS[1:]):
        out += f" WHEN {x} < {_num(b)} THEN {_num(ya)} + ({_num(yb)} - {_num(ya)}) * ({x} - {_num(a)}) / ({_num(b)} - {_num(a)})"
    return out + f" ELSE {_num(_KNOTS[-1][1])} END"


TABLES = {
    "v": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings",
    "ks": f"SELECT range AS k FROM range({BITS})",
    "q": f"SELECT vec_id AS qid, e FROM v WHERE vec_id % {EVERY} = 0",
    "enc": _encoded(),
    "thr": _thresholds("enc"),
    "coded": f"SELECT vec_id, label, x, {_code('x', 't')} AS code FROM enc, thr",
    "hist": "SELECT code, count(*) AS n FROM coded GROUP BY code",
    "qc": f"SELECT vec_id AS qid, x, code AS base FROM coded WHERE vec_id % {EVERY} = 0",
    "costs": "SELECT qid, k AS bit, abs(x[k + 1] - t[k + 1]) AS cost FROM qc, thr, ks",
    "ranks": "SELECT qid, bit, cost, row_number() OVER (PARTITION BY qid ORDER BY cost, bit) - 1 AS rnk FROM costs",
    "allprobes": _probes(6, 2),
    "probes": f"SELECT *, least(floor(pow(least(greatest(score / {_num(MAX_SCORE)}, 0e0), 1e0), {_num(ALPHA)}) * {_num(BINS)}), {BINS - 1})::BIGINT AS bin FROM allprobes WHERE score <= {_num(MAX_SCORE)}",
    "sizes": "SELECT qid, bin, count(*) AS n_buckets, coalesce(sum(n), 0)::BIGINT AS n_vectors FROM probes LEFT JOIN hist USING (code) GROUP BY qid, bin",
    "scan": f"SELECT qid, v.vec_id, {sq('q.e', 'v.e')} AS dist FROM v, q",
    "gt": f"SELECT * FROM ({_top('(SELECT * FROM scan WHERE qid <> vec_id)', 10)})",
    "cand": "SELECT qid, vec_id FROM probes JOIN coded USING (code)",
    "pts": "SELECT vec_id, code, x, row_number() OVER (PARTITION BY code ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY code) AS n FROM coded",
    "ptk": "SELECT *, CASE WHEN n < 4 THEN 1 WHEN n >= 17 THEN least(ceil(n / 8.0), 2048)::BIGINT ELSE ceil(n / 4.0)::BIGINT END AS k FROM pts",
    "c0": "SELECT code, range AS cid, list_transform(x, lambda y: round(y, 9)) AS ce FROM ptk, range(300) WHERE range < k AND (range * n) // k = pos",
    "m0": _nearest("ptk", "c0"),
    "c1": _moved("m0", "c0"),
    "m1": _nearest("ptk", "c1"),
    "cents": _moved("m1", "c1"),
    "members": _nearest("ptk", "cents"),
    "nk": "SELECT code, count(*) AS k FROM cents GROUP BY code",
    "found": f"SELECT p.qid, p.bin, p.code, c.cid, nk.k, {sq('qc.x', 'c.ce')} AS d2 FROM probes p JOIN cents c ON p.code = c.code JOIN nk ON nk.code = p.code JOIN qc ON qc.qid = p.qid",
    "chosen": "SELECT qid, code, cid, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, code, cid)::INTEGER AS rank FROM found WHERE k > 1 QUALIFY rank <= 10",
    "picked": "SELECT qid, code, cid, 'direct' AS src FROM found WHERE k = 1 UNION ALL SELECT qid, code, cid, 'centroid' FROM chosen",
    "ccand": "SELECT DISTINCT qid, m.vec_id FROM picked p JOIN members m ON p.code = m.code AND p.cid = m.cid",
    "gp": "SELECT g.qid, g.vec_id, g.dist, a.x AS xq, b.x AS xb, a.base AS cq, b.code AS cb FROM gt g JOIN qc a ON a.qid = g.qid JOIN coded b ON b.vec_id = g.vec_id",
    "mp": f"SELECT qid, vec_id, dist AS y, {_margin('xq', 't', 'xor(cq, cb)')} AS x, {_margin('xb', 't', 'xor(cq, cb)')} AS x2 FROM gp, thr",
    "flips": "SELECT rnk, count(*) AS n FROM gp JOIN ranks ON ranks.qid = gp.qid AND (xor(cq, cb) >> bit::INTEGER) & 1 = 1 GROUP BY rnk",
    "bat": "SELECT vec_id, e, floor(((vec_id * 7919) % (SELECT max(vec_id) + 1 FROM v)) / 50)::BIGINT AS batch FROM v",
    "sp": f"SELECT a.batch, a.vec_id AS i, b.vec_id AS j, {sq('a.e', 'b.e')} AS y FROM bat a JOIN bat b ON a.batch = b.batch AND a.vec_id < b.vec_id WHERE a.batch < 4",
    "spk": "SELECT batch, i, j, y FROM sp JOIN (SELECT batch, quantile_cont(y, 0.2) AS cut FROM sp GROUP BY batch) USING (batch) WHERE y <= cut AND y < 1.9e0",
    "gc": f"SELECT g.qid, g.vec_id, {sq('qc.x', 'm.x')} AS d_gt, {sq('qc.x', 'c.ce')} AS d_cent FROM gt g JOIN members m ON m.vec_id = g.vec_id JOIN cents c ON c.code = m.code AND c.cid = m.cid JOIN qc ON qc.qid = g.qid",
    "need": "SELECT qid, b AS x, greatest(m - b, 0e0) AS y FROM (SELECT qid, min(d2) AS b FROM found WHERE k > 1 GROUP BY qid) JOIN (SELECT qid, max(d_cent) AS m FROM gc GROUP BY qid) USING (qid)",
    "win": "SELECT grp, list(m ORDER BY k) AS t FROM (SELECT vec_id // 100 AS grp, k, quantile_cont(x[k + 1], 0.5) AS m FROM enc, ks WHERE vec_id < 400 GROUP BY ALL) GROUP BY grp",
    "u8": "SELECT vec_id, list_transform(e, lambda y: trunc(least(greatest((y + 1e0) * 127.5e0, 0e0), 255e0))) AS b FROM v",
    **{f"enc{m}": _encoded(m) for m in (1, 2)},
    **{f"thr{m}": _thresholds(f"enc{m}") for m in (1, 2)},
}


def sql(final: str) -> str:
    """`final` with the common tables that it names, in order of need."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in TABLES:
            if name not in need and re.search(rf"\b{name}\b(?!\.)(?!\s*\()", re.sub(r"\bAS \w+", "", text)) and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                add(TABLES[name])
                if name not in need:
                    need.append(name)

    add(final)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in need) + "\n" if need else "") + final


def _quantiles(x: str, qs) -> str:
    return ", ".join(f"round(quantile_cont({x}, {q / 100}), 6) AS p{q}" for q in qs)


def _stops() -> str:
    return ", ".join(f"sum(CASE WHEN bin <= {k} THEN n_buckets ELSE 0 END)::BIGINT AS upto{k}" for k in range(3))


_PROBED = "round(score, 6) AS score"
_FIT = "covar_pop(d_cent, d_gt) / var_pop(d_gt)"
_MEASURES = {
    "d_gt": "sqrt(d_gt)", "d_cent": "sqrt(d_cent)", "diff": "sqrt(d_cent) - sqrt(d_gt)", "ratio": "sqrt(d_cent) / (sqrt(d_gt) + 1e-12)",
    "d_gt_sq": "d_gt", "d_cent_sq": "d_cent", "diff_sq": "d_cent - d_gt", "ratio_sq": "d_cent / (d_gt + 1e-20)",
}
_SIM = "(1e0 - dist / 2)"
_SWEEP = " UNION ALL ".join(f"SELECT {_num(t)} AS target, round(greatest(quantile_cont(x - 0.5e0 * y, {1 - t!r}), 0e0), 6) AS b FROM mp" for t in (0.02, 0.01, 0.005, 0.0025, 0.001))


def _config(lsel: int, rmax: int) -> str:
    hit = f"""SELECT gp.qid, gp.vec_id FROM gp LEFT JOIN ranks ON ranks.qid = gp.qid AND (xor(cq, cb) >> bit::INTEGER) & 1 = 1 GROUP BY gp.qid, gp.vec_id HAVING count(rnk) <= {rmax} AND coalesce(max(rnk), 0) < {lsel}"""
    return f"""SELECT {lsel}::BIGINT AS lsel, {rmax}::BIGINT AS rmax, recall, candidates FROM ({_recall(f'({hit})')}),
        (SELECT round(count(*) / (SELECT count(*) FROM qc)::DOUBLE, 6) AS candidates FROM ({_probes(lsel, rmax)}) p JOIN coded USING (code))"""


def _strict(m: int) -> str:
    enc, thr = (f"enc{m}", f"thr{m}") if m else ("enc", "thr")
    return f"SELECT {m}::BIGINT AS model, code, count(*) AS n FROM (SELECT {_code('x', 't', '>')} AS code FROM {enc}, {thr}) GROUP BY code"


ORACLES = {
    "l2sq_pairs": f"SELECT a.vec_id, round({sq('a.e', 'b.e')}, 6) AS d2 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "dot_pairs": f"SELECT a.vec_id, round({dot('a.e', 'b.e')}, 6) AS ip FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "cosine_distance_pairs": f"SELECT a.vec_id, round(greatest(1e0 - {dot('a.e', 'b.e')} / ((sqrt({dot('a.e', 'a.e')}) + 1e-12) * (sqrt({dot('b.e', 'b.e')}) + 1e-12)), 0e0), 6) AS dist FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "l2_normalize": f"SELECT vec_id, range AS k, round((e[range + 1] / 3e0) / greatest(sqrt({dot('list_transform(e, lambda y: y / 3e0)', 'list_transform(e, lambda y: y / 3e0)')}), 1e-12), 6) AS u FROM v, range({DIM})",
    "scale_unit": "SELECT vec_id, round(list_reduce(list_prepend(0e0, list_transform(e, lambda y: y / 255e0)), lambda s, y: s + y), 9) AS s FROM v",
    "u8_l2sq_pairs": f"SELECT a.vec_id, {sq('a.b', 'b.b')}::BIGINT AS d2 FROM u8 a JOIN u8 b ON b.vec_id = a.vec_id + 1",
    "brute_force_top10": f"SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM ({_top('scan', 10)})",
    "brute_force_ip_top10": "SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM (" + _top(f"(SELECT qid, v.vec_id, -{dot('q.e', 'v.e')} AS dist FROM v, q)", 10) + ")",
    "topk_merge": f"SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM ({_top('scan', 10)})",
    "knn_same_label_rate": "SELECT round(avg((b.label = a.label)::INTEGER), 6) AS rate FROM gt g JOIN v b ON b.vec_id = g.vec_id JOIN v a ON a.vec_id = g.qid",
    "encode_linear": "SELECT vec_id, k, round(x[k + 1], 6) AS x FROM enc, ks",
    "encode_mlp": f"SELECT vec_id, k, round(x[k + 1], 6) AS x FROM (SELECT vec_id, {_layer(MLP[1], 'h')} AS x FROM (SELECT vec_id, {_layer(MLP[0], 'e')} AS h FROM v)), ks",
    "first_rows": "SELECT vec_id, label FROM v WHERE vec_id < greatest(1, floor((SELECT max(vec_id) + 1 FROM v) * 0.1e0))",
    "median_thresholds": "SELECT k, round(t[k + 1], 6) AS thr FROM thr, ks",
    "windowed_thresholds": "SELECT grp, k, round(t[k + 1], 6) AS thr FROM win, ks",
    "bucket_codes": "SELECT vec_id, code FROM coded",
    "bucket_histogram": "SELECT code, n FROM hist",
    "bucket_balance": _balance("hist"),
    "bucket_balance_dense_p50": f"SELECT (list(coalesce(n, 0) ORDER BY coalesce(n, 0))[{round(0.5 * ((1 << BITS) - 1)) + 1}])::BIGINT AS p50 FROM range({1 << BITS}) LEFT JOIN (SELECT code, count(*) AS n FROM coded GROUP BY code) h ON h.code = range",
    "top_buckets": "SELECT code, n FROM hist ORDER BY n DESC, code LIMIT 20",
    "best_threshold_group": "SELECT * FROM (" + _balance(f"(SELECT grp, code, count(*) AS n FROM (SELECT grp, {_code('x', 't')} AS code FROM enc, win) GROUP BY ALL)", "grp") + ") ORDER BY max_n, p999, p99, empty_ratio, nonempty DESC, grp LIMIT 1",
    "posting_lists": "SELECT code, pos, vec_id FROM pts",
    "bucket_offsets": "SELECT code, n, (sum(n) OVER (ORDER BY code) - n)::BIGINT AS \"offset\" FROM hist",
    "bucket_stats": f"SELECT min(n) AS min_n, round(avg(n), 9) AS mean_n, max(n) AS max_n, {', '.join(f'{_half_up(q)} AS {p}' for p, q in (('p50', 0.5), ('p90', 0.9), ('p99', 0.99), ('p999', 0.999), ('p9995', 0.9995)))} FROM hist",
    "bucket_tiers": f"SELECT tier, count(*) AS buckets, sum(n)::BIGINT AS vectors FROM (SELECT n, CASE WHEN n >= greatest(p, tiny + 2) THEN 'BIG' WHEN n <= tiny THEN 'TINY' ELSE 'NORMAL' END AS tier FROM hist, (SELECT greatest({_half_up(0.5)}, 3) AS tiny, {_half_up(0.9995)} AS p FROM hist)) GROUP BY tier",
    "bucket_auto_tiny": "SELECT coalesce(min(cut), 128)::BIGINT AS tiny FROM (SELECT 1::BIGINT << range::INTEGER AS cut FROM range(21)) WHERE (SELECT count(*) FROM hist WHERE n <= cut) >= 0.7 * (SELECT count(*) FROM hist) AND (SELECT sum(n) FROM hist WHERE n <= cut) <= 0.15 * (SELECT sum(n) FROM hist)",
    "big_buckets": "SELECT code, n FROM hist WHERE n >= 12",
    "query_bit_costs": "SELECT qid, bit, round(cost, 6) AS cost FROM costs",
    "bit_ranks": "SELECT qid, bit, rnk FROM ranks",
    "mask_plan": f"SELECT plan_idx, mask FROM ({_plan(8, 3)})",
    "probe_buckets": f"SELECT qid, plan_idx, code, {_PROBED} FROM probes",
    "probe_buckets_pruned": f"SELECT qid, code, {_PROBED} FROM probes",
    "probe_bins": f"SELECT qid, plan_idx, code, {_PROBED}, bin FROM probes",
    "probe_bins_capped": f"SELECT qid, plan_idx, code, {_PROBED}, bin FROM probes QUALIFY row_number() OVER (PARTITION BY qid, bin ORDER BY plan_idx) <= 2",
    "probe_bin_sizes": "SELECT qid, bin, n_buckets, n_vectors FROM sizes",
    "probe_first_bins": f"SELECT qid, {_stops()} FROM sizes GROUP BY qid",
    "probe_big_split": "SELECT qid, CASE WHEN coalesce(n, 0) = 0 THEN 'SKIP' WHEN n >= 12 THEN 'BIG' ELSE 'NORMAL' END AS tag, count(*) AS n_buckets, coalesce(sum(n), 0)::BIGINT AS n_vectors FROM probes LEFT JOIN hist USING (code) GROUP BY ALL",
    "sorted_margin_stats": f"SELECT rnk AS pos, round(avg(cost), 6) AS mean, {_quantiles('cost', (10, 50, 90))} FROM ranks GROUP BY rnk",
    "ann_search_top10": f"SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM ({_top('(SELECT * FROM cand JOIN scan USING (qid, vec_id))', 10)})",
    "ann_candidates_per_query": "SELECT qid, count(*) AS n FROM cand GROUP BY qid",
    "recall_at_10": _recall("cand"),
    "recall_by_radius": f"SELECT radius, round(avg((bit_count(xor(cq, cb)) <= radius)::INTEGER), 9) AS recall FROM gp, (SELECT unnest([0, 1, 2, 3, 6])::BIGINT AS radius) GROUP BY radius",
    "cluster_k_policy": "SELECT DISTINCT code, n, k FROM ptk",
    "kmeans_assign": "SELECT vec_id, code, cid, round(d2, 6) AS d2 FROM members",
    "cluster_centroids": "SELECT code, cid, k AS d, round(ce[k + 1], 6) AS x FROM cents, ks",
    "cluster_quality": f"""SELECT n.code, n.k, mean_l2, max_l2, p50_l2, p90_l2, p99_l2, margin_p50, ambiguous, round(separation, 6) AS separation,
        round(CASE WHEN n.k < 2 THEN 0e0 WHEN separation = 0 THEN 'inf'::DOUBLE ELSE 2 * p99 / separation END, 6) AS overlap FROM nk n
        JOIN (SELECT code, round(avg(d), 6) AS mean_l2, round(max(d), 6) AS max_l2, round(quantile_cont(d, 0.5), 6) AS p50_l2, round(quantile_cont(d, 0.9), 6) AS p90_l2, round(quantile_cont(d, 0.99), 6) AS p99_l2,
              quantile_cont(d, 0.99) AS p99, round(quantile_cont(second - d, 0.5), 6) AS margin_p50, round(avg(CASE WHEN second - d < 0.05e0 THEN 1e0 ELSE 0e0 END), 6) AS ambiguous
              FROM (SELECT m.vec_id, m.code, list(sqrt({sq('m.x', 'c.ce')}) ORDER BY sqrt({sq('m.x', 'c.ce')})) AS ds, ds[1] AS d, ds[2] AS second FROM members m JOIN cents c ON c.code = m.code GROUP BY m.vec_id, m.code) GROUP BY code) a ON a.code = n.code
        LEFT JOIN (SELECT a.code, min(sqrt({sq('a.ce', 'b.ce')})) AS separation FROM cents a JOIN cents b ON a.code = b.code AND a.cid < b.cid GROUP BY a.code) s ON s.code = n.code""",
    "cluster_classes": "SELECT CASE WHEN k <= 1 THEN 'SMALL' WHEN k < 1000 THEN 'NORMAL' ELSE 'BIG' END AS class, count(*) AS buckets, sum(n)::BIGINT AS vectors, sum(k)::BIGINT AS clusters FROM (SELECT DISTINCT code, n, k FROM ptk) GROUP BY class",
    "sub_posting_lists": "SELECT code, cid, row_number() OVER (PARTITION BY code, cid ORDER BY vec_id) - 1 AS pos, vec_id FROM members",
    "singleton_split": "SELECT qid, CASE WHEN k = 1 THEN 'direct' ELSE 'multi' END AS src, count(*) AS n FROM found GROUP BY ALL",
    "centroid_topk": "SELECT qid, code, cid, round(d2, 6) AS d2, rank FROM chosen",
    "centroid_topk_gated": f"""SELECT qid, code, cid, round(d2, 6) AS d2, row_number() OVER (PARTITION BY qid ORDER BY d2, code, cid)::INTEGER AS rank FROM
        (SELECT *, min(d2) OVER (PARTITION BY qid ORDER BY bin RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM found WHERE k > 1) WHERE d2 <= b + {_curve('b')} QUALIFY rank <= 10""",
    "candidate_clusters": "SELECT qid, code, cid, src FROM picked",
    "cluster_select_band": """SELECT qid, code, cid, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t DESC, code, cid) AS c FROM
        (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, code, cid) <= 3 AS t, d2 <= min(d2) OVER (PARTITION BY qid) + 0.2e0 AS b FROM found) WHERE t OR b) WHERE c <= 5""",
    "centroid_early_stop_off": "SELECT qid, code, cid, round(d2, 6) AS d2, rank FROM chosen",
    "ann_search_clustered_top10": f"SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM ({_top('(SELECT * FROM ccand JOIN scan USING (qid, vec_id))', 10)})",
    "recall_clustered": _recall("ccand"),
    "gt_hamming_hist": f"SELECT range AS h, count(cq) AS n FROM range({BITS + 1}) LEFT JOIN gp ON bit_count(xor(cq, cb)) = range GROUP BY range",
    "gt_flip_rank": "SELECT rnk, n, round(n / (SELECT sum(n) FROM flips), 6) AS share FROM flips",
    "gt_flip_rank_summary": "SELECT round(sum(n * rnk) / sum(n), 6) AS avg_rank, round(sum(CASE WHEN rnk < 4 THEN n ELSE 0 END) / sum(n), 6) AS top4, round(sum(CASE WHEN rnk < 8 THEN n ELSE 0 END) / sum(n), 6) AS top8 FROM flips",
    "masked_margin_pairs": "SELECT qid, vec_id, round(y, 6) AS dist, round(x, 6) AS x_query, round(x + x2, 6) AS x_both FROM mp",
    "similar_pairs": "SELECT batch, i, j, round(y, 6) AS y FROM spk",
    "similar_pairs_capped": "SELECT batch, i, j, round(y, 6) AS y FROM spk QUALIFY row_number() OVER (PARTITION BY batch ORDER BY (i * 31 + j * 17) % 1009, i, j) <= 40",
    "pair_distance_quantiles": f"SELECT {_quantiles('y', (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100))} FROM sp",
    "deterministic_sample": "SELECT vec_id, label FROM v ORDER BY (vec_id * 7919) % 1000003, vec_id LIMIT 50",
    "train_val_split": "SELECT vec_id, CASE WHEN vec_id < floor((SELECT max(vec_id) + 1 FROM v) * 0.9e0) THEN 'train' ELSE 'val' END AS part FROM v",
    "earlystop_slope": "SELECT round(coalesce(quantile_cont(x / y, 0.995), 0e0), 6) AS a0 FROM mp WHERE y > 1e-12",
    "earlystop_shift_sweep": _SWEEP,
    "earlystop_violation": """SELECT band, count(*) AS n, round(avg((x > greatest(0.3e0 * y + 0.2e0, 0e0) + 1e-8)::INTEGER), 6) AS rate FROM
        (SELECT x, y, unnest(['all', CASE WHEN y <= lo THEN 'low' WHEN y > hi THEN 'high' ELSE 'mid' END]) AS band FROM mp, (SELECT quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM mp)) GROUP BY band""",
    "earlystop_patch": "SELECT qid, vec_id, round(CASE WHEN y * y < 1.5e0 THEN 0.6e0 ELSE 0.4e0 * (y * y) END, 6) AS ub FROM mp",
    "earlystop_shift": "SELECT qid, vec_id, round(greatest(0.4e0 * (y * y) + 0.1e0, 0e0), 6) AS ub FROM mp",
    "earlystop_pick": f"SELECT * FROM ({_SWEEP}) WHERE target = 0.005e0",
    "margin_curve": """SELECT round(knot, 6) AS knot, n, round(a, 6) AS q95_raw, round(b, 6) AS q99_raw, round(max(a) OVER w, 6) AS q95_use, round(max(b) OVER w, 6) AS q99_use FROM
        (SELECT g, quantile_cont(x, 0.5) AS knot, count(*) AS n, quantile_cont(y, 0.95) AS a, quantile_cont(y, 0.99) AS b FROM (SELECT *, ntile(4) OVER (ORDER BY x, qid) AS g FROM need) GROUP BY g)
        WINDOW w AS (ORDER BY knot ROWS UNBOUNDED PRECEDING)""",
    "smax_coverage": """SELECT s_max, round(avg((x <= s_max)::INTEGER), 6) AS pair_cover, round((SELECT avg((w <= s_max)::INTEGER) FROM (SELECT qid, max(x) AS w FROM mp GROUP BY qid)), 6) AS query_cover
        FROM mp, (SELECT unnest([0.25e0, 0.5e0, 1e0, 2e0]) AS s_max) GROUP BY s_max""",
    "margin_lookup": f"SELECT vec_id, y AS x, round({_curve('y')}, 6) AS margin FROM (SELECT vec_id, (vec_id - 5) / 20e0 AS y FROM v)",
    "gt_cluster_distance": "SELECT qid, vec_id, round(d_gt, 6) AS d_gt, round(d_cent, 6) AS d_cent FROM gc",
    "gt_linear_fit": f"""SELECT round({_FIT}, 6) AS slope, round(avg(d_cent) - {_FIT} * avg(d_gt), 6) AS intercept, round(corr(d_cent, d_gt), 6) AS corr,
        round(sqrt(greatest(var_pop(d_cent) - {_FIT} * covar_pop(d_cent, d_gt), 0e0)), 6) AS rmse, count(*) AS n FROM gc""",
    "gt_distance_summary": " UNION ALL ".join(f"SELECT '{k}' AS measure, {_quantiles(e, (50, 90, 99))} FROM gc WHERE d_gt > 0" for k, e in _MEASURES.items()),
    "gt_distance_transform": " UNION ALL ".join(
        f"SELECT qid, vec_id, '{k}' AS how, round({e}, 6) AS dist FROM gt"
        for k, e in {"none": _SIM, "one_minus": f"1e0 - {_SIM}", "auto": f"1e0 - {_SIM}", "two_minus_two_cos": f"2e0 - 2e0 * least(greatest({_SIM}, -1e0), 1e0)", "twice_cosdist": f"greatest(2e0 * {_SIM}, 0e0)"}.items()
    ),
    "model_selection": f"SELECT model, max_n, p99, p999, nonempty, empty_ratio FROM ({_balance('(' + ' UNION ALL '.join(map(_strict, range(3))) + ')', 'model')}) ORDER BY max_n, model LIMIT 1",
    "config_sweep": " UNION ALL ".join(_config(a, b) for a, b in ((4, 1), (6, 1), (6, 2))),
    "selective_similarity_loss": f"""SELECT round(coalesce(sum(CASE WHEN keep THEN (b - s * a) * (b - s * a) END), 0e0) / greatest(sum(keep::INTEGER), 1), 6) AS loss, sum(keep::INTEGER)::BIGINT AS kept FROM
        (SELECT *, a < 1.3e0 OR b < 1.3e0 * s AS keep FROM (SELECT sqrt({sq('i.e', 'j.e')}) AS a, sqrt({sq('i.x', 'j.x')}) AS b, 0.6e0 * sqrt({BITS}e0 / {DIM}e0) AS s FROM enc i JOIN bat bi ON bi.vec_id = i.vec_id JOIN bat bj ON bj.batch = bi.batch JOIN enc j ON j.vec_id = bj.vec_id WHERE i.vec_id <> j.vec_id))""",
}
def _cell(c: str, lo: float, hi: float, bins: int) -> str:
    return f"least(greatest(floor(({c} - {_num(lo)}) / {_num(hi - lo)} * {bins}), 0), {bins - 1})::BIGINT"


def _dense(q: float) -> str:
    return f"list(coalesce(n, 0) ORDER BY coalesce(n, 0))[{int(q * ((1 << BITS) - 1)) + 1}]::BIGINT"


ORACLES |= {
    "pairwise_l2_matrix": f"SELECT a.vec_id, b.vec_id AS j, round({sq('a.e', 'b.e')}, 6) AS d2 FROM bat a JOIN bat b ON a.batch = b.batch AND a.vec_id < b.vec_id",
    "selective_similarity_loss_cosine": f"""SELECT round(coalesce(sum(CASE WHEN keep THEN pow((1 - sm) - 0.9e0 * (1 - si), 2) END), 0e0) / greatest(sum(keep::INTEGER), 1), 6) AS loss, sum(keep::INTEGER)::BIGINT AS kept FROM
        (SELECT *, si > 0.1e0 OR sm > 0.7e0 AS keep FROM (SELECT {dot('i.e', 'j.e')} / (sqrt({dot('i.e', 'i.e')}) * sqrt({dot('j.e', 'j.e')})) AS si, {dot('i.x', 'j.x')} / (sqrt({dot('i.x', 'i.x')}) * sqrt({dot('j.x', 'j.x')})) AS sm
        FROM enc i JOIN bat bi ON bi.vec_id = i.vec_id JOIN bat bj ON bj.batch = bi.batch JOIN enc j ON j.vec_id = bj.vec_id WHERE i.vec_id <> j.vec_id))""",
    "sample_share": "SELECT vec_id, label FROM (SELECT *, row_number() OVER (ORDER BY (vec_id * 7919) % 1000003, vec_id) AS r, count(*) OVER () AS n FROM v) WHERE r <= greatest(1, floor(n * 0.05e0))",
    "cluster_sizes": "SELECT code, cid, n, (sum(n) OVER (ORDER BY code, cid) - n)::BIGINT AS \"offset\" FROM (SELECT code, cid, count(*) AS n FROM members GROUP BY ALL)",
    "bucket_percentiles_dense": f"SELECT {_dense(0.5)} AS p50, {_dense(0.9)} AS p90, {_dense(0.99)} AS p99 FROM range({1 << BITS}) LEFT JOIN (SELECT code, count(*) AS n FROM coded GROUP BY code) h ON h.code = range",
    "y_spaces": " UNION ALL ".join(f"SELECT qid, vec_id, '{k}' AS space, round({e}, 6) AS y FROM gt" for k, e in {"identity": "dist", "square": "dist * dist", "sqrt": "sqrt(greatest(dist, 0e0))", "log1p": "ln(1e0 + greatest(dist, 0e0))"}.items()),
    "probed_spans": """SELECT qid, bin, min(a)::BIGINT AS start, max(b)::BIGINT AS stop FROM (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY qid, bin ORDER BY a) AS g FROM
        (SELECT qid, bin, a, b, max(b) OVER (PARTITION BY qid, bin ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM probes JOIN
        (SELECT code, sum(k) OVER (ORDER BY code) - k AS a, sum(k) OVER (ORDER BY code) AS b FROM nk) USING (code))) GROUP BY qid, bin, g""",
    "probed_spans_capped": "",
    "margin_scatter": "SELECT qid * 100000 + vec_id AS \"key\", round(x, 6) AS x, round(y, 6) AS y FROM mp ORDER BY ((qid * 100000 + vec_id) * 7919) % 1000003, 1 LIMIT 60",
    "margin_summary": "SELECT " + ", ".join(f"round(min({c}), 6) AS {c}_min, round(quantile_cont({c}, 0.5), 6) AS {c}_p50, round(quantile_cont({c}, 0.99), 6) AS {c}_p99, round(max({c}), 6) AS {c}_max" for c in "xy") + " FROM mp",
    "margin_histogram": f"SELECT range AS bin, count(x) AS n FROM range(16) LEFT JOIN mp ON {_cell('x', 0, 2, 16)} = range GROUP BY range",
    "margin_heat_map": f"SELECT {_cell('x', 0, 2, 8)} AS bx, {_cell('y', 0.5, 2, 8)} AS \"by\", count(*) AS n FROM mp GROUP BY 1, 2",
    "margin_bands": "SELECT floor(y * 10)::BIGINT AS band, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM mp GROUP BY 1",
}
ORACLES["encode_mlp_arrow"] = ORACLES["encode_mlp"]
ORACLES["probed_spans_capped"] = f"SELECT qid, bin, a AS start, least(a + 3, stop)::BIGINT AS stop FROM (SELECT *, unnest(range(start, stop, 3)) AS a FROM ({ORACLES['probed_spans']}))"
assert HIDDEN == len(MLP[0].weights)


def oracle_sql() -> dict[str, str]:
    return {k: sql(v) for k, v in ORACLES.items()}
