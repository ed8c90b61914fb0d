"""SQL for DuckDB that gives the rows of the registered queries.

Each statement is put together from named subqueries; a subquery brings those
that it names. Iterations are unrolled or recursive with keys.
"""

from __future__ import annotations

import re

from ..functions.rand import coin_sql, order_sql, threshold
from ..operators.evaluate import ORDER
from ..operators.experiments import ABLATION
from ..operators.learn import RIDGE, grid
from ..operators.report import TIERS
from .inputs import BASELINES, RATE_SAMPLE, RATES, ROUNDS, RUNS, SAMPLE, TRUTH_RUNS, K

CORE_ROUNDS, LEVELS, STEPS, RATE = 16, 9, 20, 0.1

PARTS: dict[str, str] = {
    "p": "SELECT DISTINCT l_orderkey o, l_partkey n FROM lineitem WHERE l_returnflag = 'R'",
    "e": "SELECT DISTINCT a.n u, b.n v FROM p a JOIN p b ON a.o = b.o AND a.n < b.n",
    "adj": "SELECT u, v FROM e UNION ALL SELECT v, u FROM e",
    "deg": "SELECT u node_id, count(*) k FROM adj GROUP BY u",
    "size_": "SELECT count(*) n, avg(k) kbar, max(k) kmax FROM deg",
    "hop1": "SELECT u src, v node FROM adj",
    "hop2": "SELECT DISTINCT a.u src, b.v node FROM adj a JOIN adj b ON a.v = b.u WHERE a.u <> b.v AND NOT EXISTS (SELECT 1 FROM hop1 h WHERE h.src = a.u AND h.node = b.v)",
    "hops": "SELECT src, node, 1 dist FROM hop1 UNION ALL SELECT src, node, 2 FROM hop2",
    # the sparser graph
    "tp": "SELECT DISTINCT l_orderkey o, l_partkey n FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05",
    "te": "SELECT DISTINCT a.n u, b.n v FROM tp a JOIN tp b ON a.o = b.o AND a.n < b.n",
    "tadj": "SELECT u, v FROM te UNION ALL SELECT v, u FROM te",
    "comp": "@USING KEY (node_id)@(node_id, component) SELECT DISTINCT u, u FROM tadj UNION (SELECT a.v, min(c.component) FROM comp c JOIN tadj a ON a.u = c.node_id JOIN recurring.comp o ON o.node_id = a.v WHERE c.component < o.component GROUP BY a.v)",
    "wcomp": "@USING KEY (node_id)@(node_id, component) SELECT DISTINCT u, u FROM adj UNION (SELECT a.v, min(c.component) FROM wcomp c JOIN adj a ON a.u = c.node_id JOIN recurring.wcomp o ON o.node_id = a.v WHERE c.component < o.component GROUP BY a.v)",
    "wlarge": "SELECT node_id FROM wcomp WHERE component = (SELECT component FROM wcomp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
    "large": "SELECT node_id FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
    # features
    "nbr": "SELECT a.u node_id, count(*) degree, avg(d.k) avg_nbr_degree, max(d.k) max_nbr_degree FROM adj a JOIN deg d ON d.node_id = a.v GROUP BY a.u",
    "sub": "SELECT x.u c, x.v a, y.v b FROM adj x JOIN adj y ON x.u = y.u JOIN adj z ON z.u = x.v AND z.v = y.v",
    "clu": "SELECT d.node_id, CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE coalesce(t, 0)::DOUBLE / (k * (k - 1)) END value FROM deg d LEFT JOIN (SELECT c node_id, count(*) t FROM sub GROUP BY c) USING (node_id)",
    "bfs": "@USING KEY (c, s, x)@(c, s, x, d) SELECT DISTINCT c, a, a, 0 FROM sub UNION (SELECT DISTINCT f.c, f.s, g.b, f.d + 1 FROM bfs f JOIN sub g ON g.c = f.c AND g.a = f.x WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs o WHERE o.c = f.c AND o.s = f.s AND o.x = g.b))",
    "eff": "SELECT d.node_id, k, coalesce(s, 0.0) s, coalesce(m, 0) m FROM deg d LEFT JOIN (SELECT c node_id, sum(1.0::DOUBLE / d) s, count(*) m FROM bfs WHERE d > 0 GROUP BY c) USING (node_id)",
    "core0": "SELECT node_id, k core FROM deg",
    "pr0": "SELECT node_id, 1.0::DOUBLE / n r FROM deg, size_",
    # similarity
    "raw7": "SELECT node_id, degree::DOUBLE a, round(avg_nbr_degree, 9) b, max_nbr_degree::DOUBLE c, round(clu.value, 9) d, core::DOUBLE e, round(CASE WHEN k < 2 OR m = 0 THEN 0.0 ELSE s / m END, 9) f, round(r, 9) g FROM nbr JOIN clu USING (node_id) JOIN core USING (node_id) JOIN eff USING (node_id) JOIN pr USING (node_id)",
    "scaled7": "SELECT node_id, " + ", ".join(f"CASE WHEN max({x}) OVER () - min({x}) OVER () > 1e-12 THEN ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) ELSE 0.0 END {x}" for x in "abcdefg") + " FROM raw7",
    "unit7": "SELECT node_id, " + ", ".join(f"{x} / nullif(sqrt(" + " + ".join(f"{y} * {y}" for y in "abcdefg") + f"), 0) {x}" for x in "abcdefg") + " FROM scaled7",
    "sims": "SELECT x.node_id i, y.node_id j, round(least(1.0, greatest(0.0, " + " + ".join(f"x.{y} * y.{y}" for y in "abcdefg") + ")), 9) w FROM unit7 x JOIN unit7 y ON x.node_id <> y.node_id",
    "top10s": "SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) r FROM sims WHERE w > 0) WHERE r <= 10",
    "wk": "SELECT i, j, w / (SELECT max(w) FROM top10s) w FROM top10s",
    "support": "SELECT coalesce(b.i, s.i) i, coalesce(b.j, s.j) j, coalesce(b.a, 0.0) a, coalesce(s.w, 0.0) w FROM (SELECT u i, v j, 1.0::DOUBLE / kbar a FROM adj, size_ UNION ALL SELECT node_id, node_id, 1.0::DOUBLE / kbar FROM deg, size_) b FULL JOIN wk s ON s.i = b.i AND s.j = b.j",
    "gaw": "SELECT i, j, round((1 + a - w + 0.6::DOUBLE * w * w + 0.4::DOUBLE * a * w) / 3, 9) w FROM support",
    "ga": "SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) r FROM gaw WHERE abs(w) > 1e-12) WHERE r <= 10",
    # influence
    "csli": "SELECT h.src node_id, sum(power(0.85::DOUBLE, h.dist) * coalesce(nullif(g.w, 0), 1.0) * d.k / h.dist) csli FROM hops h JOIN deg d ON d.node_id = h.node LEFT JOIN ga g ON g.i = h.src AND g.j = h.node GROUP BY h.src",
    "csi": "SELECT i node_id, sum(w) csi FROM ga GROUP BY i",
    "reach1": "SELECT c, s, min(x) low, count(*) size, sum(d) total FROM bfs GROUP BY c, s",
    "best1": "SELECT c, low, size, sum(total) total FROM reach1 GROUP BY c, low, size QUALIFY row_number() OVER (PARTITION BY c ORDER BY size DESC, low) = 1",
    "ends1": "SELECT c, count(*) m FROM sub GROUP BY c",
    "caspi1": "SELECT node_id, abs(whole - rest) / whole caspi FROM (SELECT node_id, (2.0::DOUBLE * k * (k + 1) - (2 * k + coalesce(m, 0))) / (k * (k + 1)) whole, CASE WHEN size >= 2 THEN total::DOUBLE / (size * (size - 1)) ELSE 0.0 END rest FROM deg LEFT JOIN ends1 ON ends1.c = node_id LEFT JOIN best1 ON best1.c = node_id)",
    "raw4": "SELECT node_id, k::DOUBLE / kmax cli, coalesce(csli, 0.0) csli, caspi, coalesce(csi, 0.0) csi FROM deg JOIN size_ ON true LEFT JOIN csli USING (node_id) JOIN caspi1 USING (node_id) LEFT JOIN csi USING (node_id)",
    "norm4": "SELECT *, " + ", ".join(f"CASE WHEN max({x}) OVER () - min({x}) OVER () > 1e-12 THEN ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) ELSE 0.0 END {x}_n" for x in ("cli", "csli", "caspi", "csi")) + " FROM raw4",
    "parts": "SELECT node_id, " + ", ".join(f"round({x}, 9) {x}, round({x}_n, 9) {x}_norm" for x in ("cli", "csli", "caspi", "csi")) + ", round(0.25 * cli_n + 0.25 * csli_n + 0.25 * caspi_n + 0.25 * csi_n, 9) score FROM norm4",
    # path disruption to two hops around the 20 nodes of highest degree
    "c20": "SELECT node_id c FROM dcs ORDER BY score DESC, node_id LIMIT 20",
    "ball": "SELECT c, node FROM c20 JOIN hops ON src = c UNION ALL SELECT c, c FROM c20",
    "bnode": "SELECT 2 * c g, node FROM ball UNION ALL SELECT 2 * c + 1, node FROM ball WHERE node <> c",
    "bedge": "SELECT x.g, a.u, a.v FROM bnode x JOIN adj a ON a.u = x.node JOIN bnode y ON y.g = x.g AND y.node = a.v",
    "bbfs": "@USING KEY (g, s, x)@(g, s, x, d) SELECT g, node, node, 0 FROM bnode UNION (SELECT DISTINCT f.g, f.s, b.v, f.d + 1 FROM bbfs f JOIN bedge b ON b.g = f.g AND b.u = f.x WHERE NOT EXISTS (SELECT 1 FROM recurring.bbfs o WHERE o.g = f.g AND o.s = f.s AND o.x = b.v))",
    "breach": "SELECT g, s, min(x) low, count(*) size, sum(d) total FROM bbfs GROUP BY g, s",
    "basp": "SELECT g, CASE WHEN size >= 2 THEN sum(total)::DOUBLE / (size * (size - 1)) ELSE 0.0 END asp FROM breach GROUP BY g, low, size QUALIFY row_number() OVER (PARTITION BY g ORDER BY size DESC, low) = 1",
    # all pairs
    "apsp": "@USING KEY (s, x)@(s, x, d) SELECT node_id, node_id, 0 FROM deg UNION (SELECT DISTINCT f.s, a.v, f.d + 1 FROM apsp f JOIN adj a ON a.u = f.x WHERE NOT EXISTS (SELECT 1 FROM recurring.apsp o WHERE o.s = f.s AND o.x = a.v))",
    "close_": "SELECT s node_id, count(*) - 1 reached, sum(d) total FROM apsp GROUP BY s",
    "sg0": "SELECT node_id s, node_id x, 1.0::DOUBLE sigma FROM deg",
    # scores of the baselines
    "ci": "SELECT d.node_id, (d.k - 1) * coalesce(t, 0) value FROM deg d LEFT JOIN (SELECT src node_id, sum(k - 1) t FROM hop2 JOIN deg ON deg.node_id = node GROUP BY src) USING (node_id)",
    "scores": "SELECT 'DC' AS method, node_id, round(k::DOUBLE / (n - 1), 9) score FROM deg, size_ UNION ALL SELECT 'CI', node_id, round(value::DOUBLE, 9) FROM ci UNION ALL SELECT 'PR', node_id, round(r, 9) FROM pr UNION ALL SELECT 'KS', node_id, core::DOUBLE FROM core UNION ALL SELECT 'BC', node_id, round(value, 9) FROM between UNION ALL SELECT 'CC', node_id, round(CASE WHEN total > 0 THEN reached::DOUBLE / total * reached / (n - 1) ELSE 0.0 END, 9) FROM close_, size_",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, node_id) rn FROM scores",
    "dcs": "SELECT node_id, round(k::DOUBLE / (n - 1), 9) score FROM deg, size_",
    "cis": "SELECT node_id, round(value::DOUBLE, 9) score FROM ci",
    "dcranked": "SELECT *, row_number() OVER (ORDER BY score DESC, node_id) rn FROM dcs",
    "ciranked": "SELECT *, row_number() OVER (ORDER BY score DESC, node_id) rn FROM cis",
    "dctop": f"SELECT node_id, rn FROM dcranked WHERE rn <= {K}",
    # ground truth
    "sample": f"SELECT node_id FROM deg ORDER BY {order_sql('node_id')}, node_id LIMIT {SAMPLE}",
    "shown500": f"SELECT node_id FROM deg ORDER BY {order_sql('node_id')}, node_id LIMIT 500",
    "tinf": f"@USING KEY (label, run, node_id)@(label, run, node_id, t) SELECT node_id, r, node_id, 0 FROM sample, range({TRUTH_RUNS}) q(r) UNION (SELECT DISTINCT f.label, f.run, a.v, f.t + 1 FROM tinf f JOIN adj a ON a.u = f.node_id WHERE f.t < {STEPS} AND {coin_sql('a.u', 'a.v', 'f.run', 'f.label')} < {threshold(RATE)} AND NOT EXISTS (SELECT 1 FROM recurring.tinf o WHERE o.label = f.label AND o.run = f.run AND o.node_id = a.v))",
    "truth": f"SELECT label node_id, count(*)::DOUBLE / {TRUTH_RUNS} sir FROM tinf GROUP BY label",
    "scored": "SELECT method, node_id, score, sir FROM scores JOIN truth USING (node_id)",
    "seeds": f"SELECT method AS label, node_id FROM ranked WHERE rn <= {K}",
    "cinf": f"@USING KEY (label, run, node_id)@(label, run, node_id, t) SELECT label, r, node_id, 0 FROM seeds, range({RUNS}) q(r) UNION (SELECT DISTINCT f.label, f.run, a.v, f.t + 1 FROM cinf f JOIN adj a ON a.u = f.node_id WHERE f.t < {STEPS} AND {coin_sql('a.u', 'a.v', 'f.run')} < {threshold(RATE)} AND NOT EXISTS (SELECT 1 FROM recurring.cinf o WHERE o.label = f.label AND o.run = f.run AND o.node_id = a.v))",
    "curve": f"SELECT label, g.t, count(*) FILTER (c.t <= g.t)::DOUBLE / {RUNS} f FROM cinf c, range({STEPS + 1}) g(t) GROUP BY label, g.t",
    "growth": "SELECT *, f - lag(f) OVER (PARTITION BY label ORDER BY t) g, last_value(f) OVER (PARTITION BY label ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) fin FROM curve",
    "metrics": f"SELECT label AS method, any_value(fin) f_final, any_value(fin) / (SELECT n FROM size_) ratio, CASE WHEN any_value(fin) < 1e-12 THEN {STEPS} ELSE min(t) FILTER (f >= 0.95 * fin) END t_sat, coalesce(arg_max(t, (round(g, 9), -t)) FILTER (g IS NOT NULL), 0) t_peak FROM growth GROUP BY label",
    "tau": "SELECT a.method, coalesce(sum(sign(a.score - b.score) * sign(a.sir - b.sir))::DOUBLE / nullif(sqrt(sum(sign(a.score - b.score) ** 2)::DOUBLE * sum(sign(a.sir - b.sir) ** 2)), 0), 0.0) tau FROM scored a JOIN scored b ON a.method = b.method AND a.node_id < b.node_id GROUP BY a.method",
    "lab": f"SELECT *, (row_number() OVER (PARTITION BY method ORDER BY sir DESC, node_id) <= {K})::INT truth, (row_number() OVER (PARTITION BY method ORDER BY score DESC, node_id) <= {K})::INT predicted FROM scored",
    "pk": f"SELECT method, sum(truth * predicted)::DOUBLE / least({K}, count(*)) p_at_k FROM lab GROUP BY method",
    "cells": "SELECT method, sum(truth * predicted)::BIGINT tp, sum((1 - truth) * predicted)::BIGINT fp, sum(truth * (1 - predicted))::BIGINT fn, sum((1 - truth) * (1 - predicted))::BIGINT tn FROM lab GROUP BY method",
    "auc": "SELECT method, (sum(truth * r) - sum(truth)::DOUBLE * (sum(truth) + 1) / 2) / nullif(sum(truth)::DOUBLE * sum(1 - truth), 0) auc FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE r FROM lab) GROUP BY method",
    "thr": "SELECT method, score, sum(t) OVER w tp, sum(n) OVER w - sum(t) OVER w fp, sum(n) OVER w m, sum(t) OVER (PARTITION BY method) pos, sum(n - t) OVER (PARTITION BY method) neg FROM (SELECT method, score, sum(truth) t, count(*) n FROM lab GROUP BY method, score) WINDOW w AS (PARTITION BY method ORDER BY score DESC)",
    "diffs": "SELECT a.method method_a, b.method method_b, a.node_id, round(a.score - b.score, 12) d FROM scored a JOIN scored b ON a.node_id = b.node_id AND a.method < b.method",
    "rk": "SELECT *, count(*) OVER (PARTITION BY method_a, method_b, abs(d)) same, rank() OVER (PARTITION BY method_a, method_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method_a, method_b, abs(d)) - 1) / 2.0::DOUBLE r FROM diffs WHERE d <> 0",
    "wil": "SELECT method_a, method_b, count(*) n, least(coalesce(sum(r) FILTER (d > 0), 0.0), coalesce(sum(r) FILTER (d < 0), 0.0)) w, sum(same::DOUBLE * same - 1) ties FROM rk GROUP BY method_a, method_b",
    # weights
    "cand": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {', '.join(f'{x!r}::DOUBLE' for x in w)})" for i, w in enumerate(grid())) + ") t(candidate, x1, x2, x3, x4)",
    "cscore": "SELECT candidate, node_id, sir, round(x1 * cli_norm + x2 * csli_norm + x3 * caspi_norm + x4 * csi_norm, 9) score FROM parts JOIN truth USING (node_id), cand",
    "ctau": "SELECT a.candidate, coalesce(sum(sign(a.score - b.score) * sign(a.sir - b.sir))::DOUBLE / nullif(sqrt(sum(sign(a.score - b.score) ** 2)::DOUBLE * sum(sign(a.sir - b.sir) ** 2)), 0), 0.0) tau FROM cscore a JOIN cscore b ON a.candidate = b.candidate AND a.node_id < b.node_id GROUP BY a.candidate",
    "loss": f"SELECT candidate, x1, x2, x3, x4, tau, -tau + {RIDGE!r} * (x1 * x1 + x2 * x2 + x3 * x3 + x4 * x4) loss FROM cand JOIN ctau USING (candidate)",
    "abl": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, {', '.join(f'{x!r}::DOUBLE' for x in w)})" for i, (n, w) in enumerate(ABLATION)) + ") t(method, ord, x1, x2, x3, x4)",
    "ascored": "SELECT method, ord, node_id, sir, round(x1 * cli_norm + x2 * csli_norm + x3 * caspi_norm + x4 * csi_norm, 9) score FROM parts JOIN truth USING (node_id), abl",
    "atau": "SELECT a.method, any_value(a.ord) ord, coalesce(sum(sign(a.score - b.score) * sign(a.sir - b.sir))::DOUBLE / nullif(sqrt(sum(sign(a.score - b.score) ** 2)::DOUBLE * sum(sign(a.sir - b.sir) ** 2)), 0), 0.0) tau FROM ascored a JOIN ascored b ON a.method = b.method AND a.node_id < b.node_id GROUP BY a.method",
    "apk": f"SELECT method, sum((a <= {K} AND b <= {K})::INT)::DOUBLE / least({K}, count(*)) p_at_k FROM (SELECT method, row_number() OVER (PARTITION BY method ORDER BY score DESC, node_id) a, row_number() OVER (PARTITION BY method ORDER BY sir DESC, node_id) b FROM ascored) GROUP BY method",
    # ego view around the five nodes of highest degree
    "five": "SELECT node_id, rn AS rank FROM dcranked WHERE rn <= 5",
    "reach": "SELECT node node_id, min((rank, dist)) first_ FROM (SELECT node, rank, dist FROM hops JOIN five ON five.node_id = src UNION ALL SELECT node_id, rank, 0 FROM five) GROUP BY node",
    "filled": "SELECT rank, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM (SELECT first_[1] AS rank, count(*) n FROM reach GROUP BY 1)",
    "ego300": "SELECT node_id, first_[1] AS rank FROM reach WHERE first_[1] IN (SELECT rank FROM filled WHERE before < 300) ORDER BY first_[1], first_[2], node_id LIMIT 300",
    "ego100": "SELECT node_id, first_[1] AS rank FROM reach WHERE first_[1] IN (SELECT rank FROM filled WHERE before < 100) ORDER BY first_[1], first_[2], node_id LIMIT 100",
    # removal
    "e2": "SELECT u, v FROM e WHERE u NOT IN (SELECT node_id FROM dctop) AND v NOT IN (SELECT node_id FROM dctop)",
    "adj2": "SELECT u, v FROM e2 UNION ALL SELECT v, u FROM e2",
    "outer5": f"SELECT node_id FROM deg WHERE node_id NOT IN (SELECT node_id FROM dctop) ORDER BY {order_sql('node_id', 2)}, node_id LIMIT 5",
}
for i in range(1, CORE_ROUNDS + 1):
    PARTS[f"core{i}"] = f"SELECT u node_id, max(least(core, rn)) core FROM (SELECT a.u, c.core, row_number() OVER (PARTITION BY a.u ORDER BY c.core DESC) rn FROM adj a JOIN core{i - 1} c ON c.node_id = a.v) GROUP BY u"
PARTS["core"] = f"SELECT node_id, core FROM core{CORE_ROUNDS}"
for i in range(1, ROUNDS + 1):
    PARTS[f"pr{i}"] = f"SELECT a.v node_id, (1 - 0.85::DOUBLE) / any_value(n) + 0.85::DOUBLE * sum(r.r / d.k) r FROM adj a JOIN pr{i - 1} r ON r.node_id = a.u JOIN deg d ON d.node_id = a.u, size_ GROUP BY a.v"
PARTS["pr"] = f"SELECT node_id, r FROM pr{ROUNDS}"
for i in range(1, LEVELS + 1):
    old = " AND ".join(f"NOT EXISTS (SELECT 1 FROM sg{j} o WHERE o.s = f.s AND o.x = a.v)" for j in range(max(0, i - 2), i))
    PARTS[f"sg{i}"] = f"SELECT f.s, a.v x, sum(f.sigma) sigma FROM sg{i - 1} f JOIN adj a ON a.u = f.x WHERE {old} GROUP BY f.s, a.v"
PARTS[f"dl{LEVELS}"] = f"SELECT s, x, sigma, 0.0::DOUBLE delta FROM sg{LEVELS}"
for i in range(LEVELS - 1, 0, -1):
    got = f"SELECT f.s, a.v x, sum(u.sigma / f.sigma * (1 + f.delta)) got FROM dl{i + 1} f JOIN adj a ON a.u = f.x JOIN sg{i} u ON u.s = f.s AND u.x = a.v GROUP BY f.s, a.v"
    PARTS[f"dl{i}"] = f"SELECT g.s, g.x, g.sigma, coalesce(q.got, 0.0) delta FROM sg{i} g LEFT JOIN ({got}) q ON q.s = g.s AND q.x = g.x"
PARTS["between"] = "SELECT node_id, coalesce(t, 0.0) / ((n - 1)::DOUBLE * (n - 2)) value FROM deg JOIN size_ ON true LEFT JOIN (SELECT x node_id, sum(delta) t FROM (" + " UNION ALL ".join(f"SELECT x, delta FROM dl{i}" for i in range(1, LEVELS + 1)) + ") GROUP BY x) USING (node_id)"

#: Curves from seeds(label, node_id) over an edge table; used with names of their own.
def _spread(name: str, seeds: str, edges: str, runs: int, rate: float = RATE, salt: str = "0") -> str:
    return (
        f"@USING KEY (label, run, node_id)@(label, run, node_id, t) SELECT label, r, node_id, 0 FROM {seeds}, range({runs}) q(r) UNION (SELECT DISTINCT f.label, f.run, a.v, f.t + 1 FROM {name} f JOIN {edges} a ON a.u = f.node_id "
        f"WHERE f.t < {STEPS} AND {coin_sql('a.u', 'a.v', 'f.run', salt)} < {threshold(rate)} AND NOT EXISTS (SELECT 1 FROM recurring.{name} o WHERE o.label = f.label AND o.run = f.run AND o.node_id = a.v))"
    )


PARTS["bseed"] = "SELECT 'before' AS label, node_id FROM outer5"
PARTS["aseed"] = "SELECT 'after' AS label, node_id FROM outer5 WHERE node_id IN (SELECT u FROM adj2)"
PARTS["binf"], PARTS["ainf"] = _spread("binf", "bseed", "adj", RUNS), _spread("ainf", "aseed", "adj2", RUNS)
PARTS["rinf"] = _spread("rinf", "seeds", "adj", 9)
for n, rate in enumerate(RATES):
    PARTS[f"xseed{n}"] = f"SELECT node_id label, node_id FROM deg ORDER BY {order_sql('node_id')}, node_id LIMIT {RATE_SAMPLE}"
    PARTS[f"xinf{n}"] = _spread(f"xinf{n}", f"xseed{n}", "adj", TRUTH_RUNS, rate, "f.label")
PARTS["xtruth"] = " UNION ALL ".join(f"SELECT label node_id, {r!r}::DOUBLE rate, count(*)::DOUBLE / {TRUTH_RUNS} sir FROM xinf{n} GROUP BY label" for n, r in enumerate(RATES))
PARTS["xscored"] = "SELECT method, rate, node_id, score, sir FROM scores JOIN xtruth USING (node_id)"
#: Cascades: for DC and CI and k up to 4, the graph without the first k.
for m in ("DC", "CI"):
    PARTS[f"ks{m}"] = f"SELECT '{m}' AS label, node_id FROM {m.lower()}ranked WHERE rn <= 3"
    PARTS[f"kb{m}"] = _spread(f"kb{m}", f"ks{m}", "adj", RUNS)
    for k in range(1, 5):
        PARTS[f"kg{m}{k}"] = f"SELECT node_id FROM {m.lower()}ranked WHERE rn <= {k}"
        PARTS[f"ka{m}{k}"] = f"SELECT u, v FROM adj WHERE u NOT IN (SELECT node_id FROM kg{m}{k}) AND v NOT IN (SELECT node_id FROM kg{m}{k})"
        left = f"SELECT '{m}' AS label, node_id FROM {m.lower()}ranked WHERE rn > {k} AND rn <= 3 AND node_id IN (SELECT u FROM ka{m}{k})"
        PARTS[f"ke{m}{k}"] = left if k < 3 else f"SELECT '{m}' AS label, min(u) node_id FROM ka{m}{k}"
        PARTS[f"ki{m}{k}"] = _spread(f"ki{m}{k}", f"ke{m}{k}", f"ka{m}{k}", RUNS)
PARTS["kbase"] = " UNION ALL ".join(f"SELECT '{m}' AS method, count(*)::DOUBLE / {RUNS} f FROM kb{m}" for m in ("DC", "CI"))
PARTS["kleft"] = " UNION ALL ".join(f"SELECT '{m}' AS method, {k}::BIGINT k, count(*)::DOUBLE / {RUNS} f FROM ki{m}{k}" for m in ("DC", "CI") for k in range(1, 5))


def statement(body: str) -> str:
    """WITH the subqueries that the body needs, in order, and the body."""
    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+(?:recurring\.)?(\w+)", text)):
            if name in PARTS and name != own and name not in order:
                need(PARTS[name], name)
                order.append(name)

    need(body)
    made = []
    for name in order:
        m = re.match(r"@(.*?)@(\(.*?\)) (.*)$", PARTS[name], re.S)
        made.append(f"{name}{m[2]} {m[1]} AS ({m[3]})" if m else f"{name} AS MATERIALIZED ({PARTS[name]})")
    return ("WITH RECURSIVE " + ",\n".join(made) + "\n" if made else "") + body


_wide = ", ".join(f"max(score) FILTER (method = '{m}') \"{m}\"" for m in BASELINES)
_ranked = ", ".join(f"max(node_id) FILTER (method = '{m}') \"{m}\"" for m in ("SIR", *BASELINES))
_cos = "list_dot_product(x.v, y.v) / nullif(sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)), 0)"
_tier = lambda i: f"CASE WHEN rn <= 5 THEN {TIERS[0][i]!r} WHEN rn <= 10 THEN {TIERS[1][i]!r} WHEN rn <= 50 THEN {TIERS[2][i]!r} ELSE {TIERS[3][i]!r} END"
_ord = "CASE method " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(ORDER)) + f" ELSE {len(ORDER)} END"
_dominant = "CASE WHEN x1 >= greatest(x2, x3, x4) THEN 'cli' WHEN x2 >= greatest(x3, x4) THEN 'csli' WHEN x3 >= x4 THEN 'caspi' ELSE 'csi' END"
_learned = (
    "SELECT round(x1, 6) x1, round(x2, 6) x2, round(x3, 6) x3, round(x4, 6) x4, round(x1 + x2 + x3 + x4, 6) total, " + _dominant + " dominant, round(tau, 6) tau_learned, round(f.tau_fixed, 6) tau_fixed, "
    "round(CASE WHEN abs(f.tau_fixed) > 1e-8 THEN (tau - f.tau_fixed) / abs(f.tau_fixed) * 100 ELSE 0.0 END, 6) improvement FROM ({}) b, (SELECT tau tau_fixed FROM loss WHERE x1 = 0.25 AND x2 = 0.25 AND x3 = 0.25) f"
)
_best = _learned.format("SELECT * FROM loss ORDER BY round(loss, 9), candidate LIMIT 1")
_quant = lambda p: f"quantile_cont(x, {p!r})"
_scaledscores = "(SELECT method, (score - min(score) OVER (PARTITION BY method)) / (max(score) OVER (PARTITION BY method) - min(score) OVER (PARTITION BY method) + 1e-12) x FROM scores)"
_n = lambda x: f"round({x}, 9)"

BODIES = {
    "edge_projection": "SELECT u, v FROM e",
    "adjacency": "SELECT u, v FROM adj",
    "graph_stats": "SELECT count(*) nodes, (sum(k) // 2)::BIGINT edges, round(sum(k)::DOUBLE / count(*), 2) avg_degree, max(k) max_degree, round(sum(k)::DOUBLE / (count(*) * (count(*) - 1)), 9) density FROM deg",
    "connected_components_whole": "SELECT node_id, component FROM wcomp",
    "largest_component_whole": "SELECT node_id FROM wlarge",
    "clean_graph_whole": "SELECT u, v FROM e WHERE u IN (SELECT node_id FROM wlarge)",
    "connected_components": "SELECT node_id, component FROM comp",
    "largest_component": "SELECT node_id FROM large",
    "clean_graph": "SELECT u, v FROM te WHERE u IN (SELECT node_id FROM large) AND v IN (SELECT node_id FROM large)",
    "hop_layers_l2": "SELECT src, dist::BIGINT dist, count(*) n_nodes FROM hops GROUP BY src, dist",
    "ball_sizes": "SELECT center, count(*) n_edges FROM (SELECT DISTINCT x.c center, e.u, e.v FROM (SELECT node_id c, node FROM dctop JOIN hops ON src = node_id UNION SELECT node_id, node_id FROM dctop) x JOIN e ON e.u = x.node JOIN (SELECT node_id c, node FROM dctop JOIN hops ON src = node_id UNION SELECT node_id, node_id FROM dctop) y ON y.c = x.c AND y.node = e.v) GROUP BY center",
    "ball_sizes_no_center": "SELECT x.node_id center, count(*) n_edges FROM dctop x JOIN hops a ON a.src = x.node_id JOIN e ON e.u = a.node JOIN hops b ON b.src = x.node_id AND b.node = e.v GROUP BY x.node_id",
    "ego_subgraph_top5": "SELECT u, v FROM e WHERE u IN (SELECT node_id FROM ego300) AND v IN (SELECT node_id FROM ego300)",
    "network_edges": "SELECT u, v FROM e WHERE u IN (SELECT node_id FROM ego100) AND v IN (SELECT node_id FROM ego100)",
    "remove_top10": "SELECT u, v FROM e2",
    "node_degree_features": f"SELECT node_id, degree, {_n('avg_nbr_degree')} avg_nbr_degree, max_nbr_degree FROM nbr",
    "clustering": f"SELECT node_id, {_n('value')} AS value FROM clu",
    "kcore": "SELECT node_id, core::DOUBLE AS value FROM core",
    "local_efficiency": f"SELECT node_id, {_n('CASE WHEN k < 2 OR m = 0 THEN 0.0 ELSE s / m END')} AS value FROM eff",
    "local_efficiency_standard": f"SELECT node_id, {_n('CASE WHEN k < 2 THEN 0.0 ELSE s / (k * (k - 1)) END')} AS value FROM eff",
    "pagerank_20": f"SELECT node_id, {_n('r')} AS value FROM pr",
    "node_features": f"SELECT node_id, degree::DOUBLE AS degree, {_n('avg_nbr_degree')} avg_nbr_degree, max_nbr_degree::DOUBLE max_nbr_degree, {_n('clu.value')} clustering, core::DOUBLE core, {_n('CASE WHEN k < 2 OR m = 0 THEN 0.0 ELSE s / m END')} local_eff, {_n('r')} pagerank FROM nbr JOIN clu USING (node_id) JOIN core USING (node_id) JOIN eff USING (node_id) JOIN pr USING (node_id)",
    "minmax_features": "SELECT node_id, " + ", ".join(_n(f"CASE WHEN max({c}) OVER () - min({c}) OVER () > 1e-12 THEN ({c} - min({c}) OVER ())::DOUBLE / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END") + f" {c}_norm" for c in ("degree", "avg_nbr_degree", "max_nbr_degree")) + " FROM nbr",
    "cosine_topk_embeddings": f"WITH d AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda q: q::DOUBLE) v FROM embeddings), s AS MATERIALIZED (SELECT x.vec_id i, y.vec_id j, round(least(1.0, greatest(0.0, {_cos})), 9) w FROM d x JOIN d y ON x.vec_id <> y.vec_id), t AS MATERIALIZED (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) r FROM s WHERE w > 0) WHERE r <= 10) SELECT i::BIGINT i, j::BIGINT j, round(w / (SELECT max(w) FROM t), 9) w FROM t",
    "augmented_graph": "SELECT i, j, w FROM ga",
    "local_influence": f"SELECT node_id, {_n('k::DOUBLE / kmax')} AS value FROM deg, size_",
    "semilocal_influence": "SELECT node_id, round(csli, 6) csli FROM csli",
    "path_disruption_top20": f"SELECT c node_id, {_n('CASE WHEN x.asp < 1e-12 THEN 0.0 ELSE abs(x.asp - y.asp) / x.asp END')} caspi FROM c20 JOIN basp x ON x.g = 2 * c JOIN basp y ON y.g = 2 * c + 1",
    "path_disruption_l1": f"SELECT node_id, {_n('caspi')} caspi FROM caspi1",
    "semantic_influence": f"SELECT node_id, {_n('csi')} csi FROM csi",
    "influence_score": "SELECT node_id, cli, round(csli, 6) csli, caspi, csi, score FROM parts",
    "degree_centrality": f"SELECT node_id, {_n('k::DOUBLE / (n - 1)')} AS value FROM deg, size_",
    "betweenness": f"SELECT node_id, {_n('value')} AS value FROM between",
    "closeness": f"SELECT node_id, {_n('CASE WHEN total > 0 THEN reached::DOUBLE / total * reached / (n - 1) ELSE 0.0 END')} AS value FROM close_, size_",
    "collective_influence": "SELECT node_id, value::DOUBLE AS value FROM ci",
    "wide_scores": f"SELECT node_id, {_wide} FROM scores GROUP BY node_id",
    "all_scores": f"SELECT w.*, sir sir_influence FROM (SELECT node_id, {_wide} FROM scores GROUP BY node_id) w LEFT JOIN truth USING (node_id)",
    "ranked_nodes_top20": f"SELECT rn AS rank, {_ranked} FROM (SELECT method, node_id, row_number() OVER (PARTITION BY method ORDER BY score DESC, node_id) rn FROM (SELECT method, node_id, score FROM scores UNION ALL SELECT 'SIR', node_id, coalesce(sir, 0.0) FROM deg LEFT JOIN truth USING (node_id))) WHERE rn <= 20 GROUP BY rn",
    "top_bars": f"SELECT method, ({_ord})::BIGINT ord, rn, node_id, score FROM ranked WHERE rn <= 10",
    "hash_sample_200": f"SELECT node_id FROM deg ORDER BY {order_sql('node_id')}, node_id LIMIT 200",
    "score_quintiles": "SELECT node_id, (len(list_filter((SELECT list_distinct([quantile_cont(score, 0.2), quantile_cont(score, 0.4), quantile_cont(score, 0.6), quantile_cont(score, 0.8)]) FROM cis), lambda q: q < score)) + 1)::BIGINT quintile FROM cis",
    "sir_curve": f"SELECT label, t::BIGINT t, {_n('f')} f FROM curve",
    "sir_single_seed": f"SELECT node_id, {_n('sir')} sir FROM truth",
    "spread_metrics": f"SELECT method, {_n('f_final')} f_final, {_n('ratio')} ratio, t_sat::BIGINT t_sat, t_peak::BIGINT t_peak FROM metrics",
    "kendall_tau": f"SELECT method, {_n('tau')} tau FROM tau",
    "method_tau_matrix": "SELECT method_a, method_b, round(coalesce(sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE / nullif(sqrt(sum(sign(a.x - b.x) ** 2)::DOUBLE * sum(sign(a.y - b.y) ** 2)), 0), 0.0), 9) tau FROM (SELECT m.method method_a, n.method method_b, m.node_id, m.score x, n.score y FROM scores m JOIN scores n ON m.node_id = n.node_id AND m.method < n.method) a JOIN (SELECT m.method method_a, n.method method_b, m.node_id, m.score x, n.score y FROM scores m JOIN scores n ON m.node_id = n.node_id AND m.method < n.method) b USING (method_a, method_b) WHERE a.node_id < b.node_id GROUP BY method_a, method_b",
    "precision_at_k": f"SELECT method, {_n('p_at_k')} p_at_k FROM pk",
    "wilcoxon_z": "SELECT method_a, method_b, n, round(w, 9) w, round((w - n::DOUBLE * (n + 1) / 4) / nullif(sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0), 9) z FROM wil",
    "comparison_report": "SELECT method, round(tau, 9) tau, round(p_at_k, 9) p_at_k, round(f_final, 9) f_final, top5 FROM tau JOIN pk USING (method) JOIN metrics USING (method) JOIN (SELECT method, string_agg(node_id::VARCHAR, ',' ORDER BY rn) top5 FROM ranked WHERE rn <= 5 GROUP BY method) USING (method)",
    "tau_vs_lambda": "SELECT a.method, a.rate, round(coalesce(sum(sign(a.score - b.score) * sign(a.sir - b.sir))::DOUBLE / nullif(sqrt(sum(sign(a.score - b.score) ** 2)::DOUBLE * sum(sign(a.sir - b.sir) ** 2)), 0), 0.0), 9) tau FROM xscored a JOIN xscored b ON a.method = b.method AND a.rate = b.rate AND a.node_id < b.node_id GROUP BY a.method, a.rate",
    "roc_auc": f"SELECT method, {_n('auc')} auc FROM auc",
    "average_precision": "SELECT method, round(sum((tp::DOUBLE / pos - coalesce(before, 0.0)) * tp / m), 9) ap FROM (SELECT *, lag(tp::DOUBLE / pos) OVER (PARTITION BY method ORDER BY score DESC) before FROM thr) GROUP BY method",
    "threshold_curve": "SELECT method, score, tp::BIGINT tp, fp::BIGINT fp, round(tp::DOUBLE / pos, 9) tpr, round(fp::DOUBLE / neg, 9) fpr, round(tp::DOUBLE / m, 9) AS precision, round(tp::DOUBLE / pos, 9) recall FROM thr",
    "confusion": "SELECT method, tp, fp, fn, tn FROM cells",
    "classification": "SELECT method, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 9) recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) f1 FROM cells",
    "weight_grid": "SELECT candidate, round(x1, 9) x1, round(x2, 9) x2, round(x3, 9) x3, round(x4, 9) x4, round(tau, 9) tau, round(loss, 9) loss FROM loss",
    "weight_learned": _learned.format("SELECT * FROM loss ORDER BY round(loss, 9), candidate LIMIT 1"),
    "weights_summary": f"SELECT 'co_return' dataset, x1, x2, x3, x4, total, dominant FROM ({_best})",
    "weight_matrix": f"SELECT 'co_return' dataset, unnest(['cli', 'csli', 'caspi', 'csi']) component, unnest([x1, x2, x3, x4]) weight FROM ({_best})",
    "mean_improvement": f"SELECT round(avg(improvement), 6) improvement FROM ({_best})",
    "removal_summary": f"SELECT round(b, 9) f_before, round(a, 9) f_after, round(CASE WHEN b > 1e-12 THEN (b - a) / b ELSE 0.0 END, 9) reduction, round(b / n, 9) ratio_before, round(a / (n - {K}), 9) ratio_after FROM (SELECT count(*)::DOUBLE / {RUNS} b FROM binf), (SELECT count(*)::DOUBLE / {RUNS} a FROM ainf), size_",
    "all_metrics": "SELECT method, round(auc, 9) auc, ap, accuracy, precision, recall, f1, round(p_at_k, 9) p_at_k FROM auc JOIN ({ap}) USING (method) JOIN ({cl}) USING (method) JOIN pk USING (method)",
    "top_k_labels": "SELECT method, node_id, truth::BIGINT truth, predicted::BIGINT predicted FROM lab",
    "tau_rate_matrix": "SELECT method, " + ", ".join(f"max(tau) FILTER (rate = {r!r}) r_{r:.2f}".replace("r_0.", "r_0_") for r in RATES) + " FROM ({taus}) GROUP BY method",
    "node_removal": f"SELECT label, g.t::BIGINT t, round(count(*) FILTER (c.t <= g.t)::DOUBLE / {RUNS}, 9) f FROM (SELECT * FROM binf UNION ALL SELECT * FROM ainf) c, range({STEPS + 1}) g(t) GROUP BY label, g.t",
    "ablation": "SELECT method, round(tau, 9) tau, round(p_at_k, 9) p_at_k FROM atau JOIN apk USING (method)",
    "component_gain": "SELECT method, round(tau, 9) tau, round(tau - coalesce(lag(tau) OVER (ORDER BY ord), 0.0), 9) gain FROM atau",
    "metric_table": "SELECT method, round(tau, 4) tau, round(p_at_k, 4) p_at_k, round(f_final, 2) f_final, round(ratio, 4) ratio, t_sat::BIGINT t_sat, t_peak::BIGINT t_peak FROM tau JOIN pk USING (method) JOIN metrics USING (method)",
    "cascading_removal": "SELECT l.method, l.k, round((b.f - l.f) / (b.f + 1e-12), 9) reduction FROM kleft l JOIN kbase b ON b.method = l.method",
    "sir_error_bars": "SELECT method, round(avg(f), 9) mean, round(stddev_pop(f), 9) std FROM (SELECT label AS method, run // 3, count(*)::DOUBLE / 3 f FROM rinf GROUP BY label, run // 3) GROUP BY method",
    "curve_heatmap": "SELECT label, t::BIGINT t, round(f / CASE WHEN max(f) OVER (PARTITION BY label) > 0 THEN max(f) OVER (PARTITION BY label) ELSE 1.0 END, 9) AS value FROM curve",
    "box_stats": f"SELECT method, {', '.join(_n(_quant(p)) + ' ' + n for p, n in ((0.0, 'low'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1.0, 'high')))} FROM {_scaledscores} s GROUP BY method",
    "violin_quantiles": f"SELECT method, round(q, 9) q, round(value, 9) AS value FROM (SELECT method, unnest(list_transform(range(21), lambda i: i / 20.0::DOUBLE)) q, unnest([{', '.join(_quant(i / 20) for i in range(21))}]) AS value FROM {_scaledscores} s GROUP BY method)",
    "radar": "SELECT method, round(greatest(tau, 0) / coalesce(nullif(max(abs(tau)) OVER (), 0), 1), 9) tau, round(p_at_k / coalesce(nullif(max(p_at_k) OVER (), 0), 1), 9) p_at_k, round(coalesce(auc, 0.5) / greatest(max(auc) OVER (), 1.0), 9) auc, round(f_final / coalesce(nullif(max(f_final) OVER (), 0), 1), 9) f_final FROM tau JOIN pk USING (method) JOIN auc USING (method) JOIN metrics USING (method)",
    "histogram": "SELECT b::BIGINT bin, round(lo + b * (hi - lo) / 30, 9) low, count(x.node_id) n, round(count(x.node_id)::DOUBLE / (any_value(total) * ((hi - lo) / 30)), 9) density FROM (SELECT min(score) lo, max(score) hi, count(*) total FROM cis) s, range(30) g(b) LEFT JOIN (SELECT node_id, least(29, floor((score - min(score) OVER ()) / ((max(score) OVER () - min(score) OVER ()) / 30))) bin FROM cis) x ON x.bin = b GROUP BY b, lo, hi",
    "scatter_fit": "SELECT method, pearson, slope, intercept, round(tau, 9) tau FROM (SELECT method, round(corr(score, sir), 9) pearson, round(regr_slope(sir, score), 6) slope, round(regr_intercept(sir, score), 9) intercept FROM scored GROUP BY method) JOIN tau USING (method)",
    "pair_table": f"SELECT w.*, quintile FROM (SELECT node_id, {_wide} FROM scores JOIN shown500 USING (node_id) GROUP BY node_id) w JOIN (SELECT node_id, (len(list_filter((SELECT list_distinct([quantile_cont(score, 0.2), quantile_cont(score, 0.4), quantile_cont(score, 0.6), quantile_cont(score, 0.8)]) FROM cis JOIN shown500 USING (node_id)), lambda q: q < score)) + 1)::BIGINT quintile FROM cis JOIN shown500 USING (node_id)) USING (node_id)",
    "network_nodes": f"SELECT node_id, {_tier(0)} tier, {_tier(1)} colour, round({_tier(2)} + x * {_tier(3)}, 6) AS size, CASE WHEN rn <= 5 THEN '★ ' || node_id ELSE node_id::VARCHAR END AS label, 'node ' || node_id || ' | rank ' || rn AS title FROM (SELECT g.node_id, rn, CASE WHEN max(score) OVER () - min(score) OVER () > 1e-12 THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 0.0 END x FROM ego300 g JOIN ranked r ON r.node_id = g.node_id AND r.method = 'DC')",
}
BODIES["all_metrics"] = BODIES["all_metrics"].format(ap=BODIES["average_precision"], cl=BODIES["classification"])
BODIES["tau_rate_matrix"] = BODIES["tau_rate_matrix"].format(taus=BODIES["tau_vs_lambda"])

SQL = {k: statement(b) for k, b in BODIES.items()}
