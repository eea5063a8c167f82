"""Queries over signals derived from the driver's tables, and the DuckDB SQL that each must match.

One text serves both engines where they agree; a pair of texts where spelling differs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec, parity
from . import signals
from .views import duckdb, run

_Z = "CASE WHEN {e} >= 0 THEN 2 * {e} ELSE -2 * {e} - 1 END"


def _z(e: str) -> str:
    return _Z.replace("{e}", f"({e})")


_LAGS = ", ".join(f"lag(x, {j}) OVER w AS x{j}" for j in range(1, 5))
#: Finite differences of order 0 to 4.
_DIFF = ["x", "x - x1", "x - 2 * x1 + x2", "x - 3 * x1 + 3 * x2 - x3", "x - 4 * x1 + 6 * x2 - 4 * x3 + x4"]
_ORDERS = " UNION ALL ".join(f"SELECT chunk, t, {o} AS ord, {d} AS e FROM lagged" for o, d in enumerate(_DIFF))
_FIXED = f"WITH lagged AS (SELECT t, chunk, x, {_LAGS} FROM {{sig}} WINDOW w AS (PARTITION BY chunk ORDER BY t)), every AS ({_ORDERS}), coded AS (SELECT chunk, ord, t, {_z('e')} AS z FROM every WHERE e IS NOT NULL)"
#: Bits of a part of n values that sum to s: 11 if all are 0, else a header of 5 and the best Rice parameter by the mean's bit length.
_K = "greatest(0, length(bin({s} div {n})) - 1)"


def _part_bits(s: str, n: str) -> str:
    k = _K.replace("{s}", s).replace("{n}", n)
    return f"CASE WHEN {s} = 0 THEN 11 ELSE 5 + ({s} >> CAST({k} AS INT)) + {n} * (1 + {k}) END"


_SIZES = ", ".join(f"({s})" for s in (32, 64, 128, 256, 512, 1024))
_PARAMS = ", ".join(f"({k})" for k in range(16))
_GROUPS = 4

TEXTS: dict[str, str] = {
    "pr1_mid_side": "SELECT t, l - r AS side, (l + r) >> 1 AS mid FROM {sig2}",
    "pr2_stereo_pairs": "SELECT t, mode, CASE mode WHEN 'LeftRight' THEN l WHEN 'MidSide' THEN (l + r) >> 1 WHEN 'LeftSide' THEN l ELSE l - r END AS a, CASE mode WHEN 'LeftRight' THEN r WHEN 'SideRight' THEN r ELSE l - r END AS b FROM {sig2} CROSS JOIN (VALUES ('LeftRight'), ('MidSide'), ('LeftSide'), ('SideRight')) AS m(mode)",
    "pr3_stereo_decode": "SELECT t, (2 * m + (s & 1) + s) >> 1 AS l, ((2 * m + (s & 1) + s) >> 1) - s AS r FROM (SELECT t, (l + r) >> 1 AS m, l - r AS s FROM {sig2}) AS p",
    "pr4_zigzag": f"SELECT t, z, CASE WHEN z % 2 = 0 THEN z >> 1 ELSE -((z + 1) >> 1) END AS back FROM (SELECT t, {_z('x - 30000')} AS z FROM {{sig}}) AS q",
    "pr5_wasted_bits": "SELECT chunk, CAST(least(30, bit_count((v & -v) - 1)) AS BIGINT) AS wasted FROM (SELECT chunk, bit_or(x * 8) AS v FROM {sig} GROUP BY chunk) AS o WHERE v <> 0",
    "pr6_code_lengths": "SELECT t, (z >> 8) + 1 + 8 AS rice, greatest((z >> 8) + 8, 10) AS golomb FROM {zig1}",
    "pr7_selector_length": f"WITH p AS (SELECT chunk, i div 256 AS part, CAST({_K.replace('{s}', 'CAST(sum(z) AS BIGINT)').replace('{n}', 'count(*)')} AS BIGINT) AS k FROM {{zig1}} GROUP BY chunk, i div 256), q AS (SELECT chunk, part, k, lag(k) OVER (PARTITION BY chunk ORDER BY part) AS before FROM p) SELECT chunk, part, k, CAST(CASE WHEN before IS NULL THEN 6 WHEN k = before THEN 1 WHEN abs(k - before) = 1 THEN 3 WHEN abs(k - before) = 2 THEN 4 ELSE 9 END AS BIGINT) AS bits FROM q",
    "pr8_map_value": "SELECT t, least(greatest((x * 12884914233 + 549755813888) >> 32, -8388608), 8388607) AS y FROM {sig}",
    "pr11_container_width": "SELECT chunk, max(abs(x)) AS peak, CAST(CASE WHEN max(abs(x)) < 128 THEN 8 WHEN max(abs(x)) < 32768 THEN 16 WHEN max(abs(x)) < 8388608 THEN 24 ELSE 32 END AS BIGINT) AS bits FROM {ordsig} GROUP BY chunk",
    "pr12_filter_input": "SELECT t, least(greatest(e >> 2, -32768), 32767) AS y FROM {res1} WHERE e IS NOT NULL",
    "pr13_bits_needed": "SELECT t, CAST(CASE WHEN x = 0 THEN 0 ELSE length(bin(x)) END AS BIGINT) AS bits, CAST(1 + CASE WHEN x = 0 THEN 0 ELSE length(bin(x)) END AS BIGINT) AS signed_bits FROM {ordsig}",
    "pr14_floor_log2": "SELECT t, CAST(length(bin(x)) - 1 AS BIGINT) AS log2 FROM {ordsig} WHERE x > 0",
    "pr18_chunk_defaults": "SELECT rate, CAST((rate + 4095) div 4096 * 4096 AS BIGINT) AS chunk, CAST(least(greatest((n + 99) div 100, 2), 1024, n) AS BIGINT) AS parity FROM (SELECT CAST(8000 + 100 * n_nationkey AS BIGINT) AS rate, CAST(1 + 40 * n_nationkey AS BIGINT) AS n FROM {nation}) AS q",
    "fi2_seek_frames": "SELECT t, x FROM {sig} WHERE chunk = 500 div 4096 AND t >= 500",
    "fi3_track_range": "SELECT conv_id, track, end_frame - start_frame AS frames FROM {tracks} WHERE start_frame <= 1000 AND 1000 < end_frame",
    "fi8_source_bound": "SELECT chunk, max(abs(x)) <= 1099511627776 AS ok FROM {ordsig} GROUP BY chunk",
    "fi9_map_valid": "SELECT t, x, (p > 4294967296 AND c < p) AS ok FROM (SELECT t, x, x * 200000 AS p, x * 100000 + 4000000000 AS c FROM {sig}) AS q",
    "fi11_tag_match": "SELECT event_id, substring(tag, 3) AS value FROM (SELECT event_id, concat('K=', regexp_extract(props, '[0-9]+', 0)) AS tag FROM {events}) AS q WHERE upper(substring(tag, 1, 1)) = upper('k')",
    "jo1_stereo_pair": "SELECT a.t, a.x AS l, b.r FROM {sig_a} JOIN {sig_b} ON a.t = b.t".replace("{sig_a}", "(SELECT * FROM {sig}) AS a").replace("{sig_b}", "(SELECT * FROM {sig2}) AS b"),
    "jo2_cross_term": "WITH n AS (SELECT chunk, min(t) AS lo, max(t) AS hi FROM {sig2} GROUP BY chunk), at AS (SELECT s.chunk, s.t, k.tap, k.c, least(greatest(s.t + k.tap, n.lo), n.hi) AS u FROM (SELECT * FROM {sig2}) AS s JOIN n ON s.chunk = n.chunk CROSS JOIN (VALUES (-1, 3), (0, 5), (1, -2)) AS k(tap, c)) SELECT a.chunk, a.t, CAST(sum(a.c * r.r) AS BIGINT) >> 3 AS term FROM at AS a JOIN (SELECT * FROM {sig2}) AS r ON a.chunk = r.chunk AND a.u = r.t GROUP BY a.chunk, a.t".replace(" at AS ", " taps AS ").replace("FROM at AS a", "FROM taps AS a"),
    "jo4_corrections": "SELECT s.chunk, s.t, coalesce(c.x, s.y) AS x FROM (SELECT chunk, t, x div 10 * 10 AS y FROM {sig}) AS s LEFT JOIN (SELECT chunk, t, x FROM {sig} WHERE x % 10 <> 0) AS c ON s.chunk = c.chunk AND s.t = c.t",
    "jo6_rebased_exceptions": "SELECT t - 400 AS pos, x FROM {sig} WHERE t >= 400 AND t < 800 AND x % 97 = 0",
    "jo8_damaged_chunks": "SELECT a.chunk, b.s - a.s AS off FROM (SELECT chunk, CAST(sum(x * (t % 4096 + 1)) AS BIGINT) AS s FROM {sig} GROUP BY chunk) AS a JOIN (SELECT chunk, CAST(sum(y * (t % 4096 + 1)) AS BIGINT) AS s FROM (SELECT t, chunk, CASE WHEN t = 777 THEN x + 1 ELSE x END AS y FROM {sig}) AS d GROUP BY chunk) AS b ON a.chunk = b.chunk WHERE a.s <> b.s",
    "jo9_retain_tags": "SELECT n_name AS tag FROM {nation} AS n WHERE NOT EXISTS (SELECT 1 FROM (SELECT upper(substring(r_name, 1, 1)) AS k FROM {region}) AS g WHERE g.k = upper(substring(n_name, 1, 1)))".replace("{nation} AS n", "(SELECT * FROM {nation}) AS n"),
    "ag1_constant_blocks": "SELECT chunk, t div 32 AS block, min(r) = max(r) AS constant FROM {sig2} GROUP BY chunk, t div 32",
    "ag2_palette": "WITH first AS (SELECT chunk, v, min(t) AS pos FROM {sym} GROUP BY chunk, v) SELECT chunk, v, CAST(row_number() OVER (PARTITION BY chunk ORDER BY pos) - 1 AS BIGINT) AS idx, CAST(count(*) OVER (PARTITION BY chunk) AS BIGINT) AS size FROM first",
    "ag3_palette_cost": "WITH p AS (SELECT chunk, count(*) AS n, count(DISTINCT v) AS size FROM {sym} GROUP BY chunk) SELECT chunk, CAST(n * greatest(1, length(bin(size - 1))) + 4 + size * 16 AS BIGINT) AS bits FROM p WHERE size BETWEEN 2 AND 16",
    "ag4_partition_sums": f"SELECT z.chunk, p.size, z.i div p.size AS part, CAST(sum(z.s) AS BIGINT) AS s, max(z.m) AS m FROM (SELECT chunk, i div 32 * 32 AS i, sum(z) AS s, max(z) AS m FROM {{zig1}} GROUP BY chunk, i div 32) AS z CROSS JOIN (VALUES {_SIZES}) AS p(size) GROUP BY z.chunk, p.size, z.i div p.size",
    "ag5_rice_estimate": f"WITH p AS (SELECT chunk, i div 256 AS part, CAST(sum(z) AS BIGINT) AS s, count(*) AS n FROM {{zig1}} GROUP BY chunk, i div 256) SELECT chunk, CAST(3 + sum({_part_bits('s', 'n')}) AS BIGINT) AS bits FROM p GROUP BY chunk",
    "ag7_autocorrelation": "WITH g AS (SELECT t, chunk, x, " + ", ".join(f"lag(x, {j}) OVER w AS x{j}" for j in range(1, 9)) + " FROM {sig} WINDOW w AS (PARTITION BY chunk ORDER BY t)) SELECT chunk, CAST(sum(x * x) AS BIGINT) AS r0, " + ", ".join(f"CAST(coalesce(sum(x * x{j}), 0) AS BIGINT) AS r{j}" for j in range(1, 9)) + " FROM g GROUP BY chunk",
    "ag9_normal_equations": "WITH g AS (SELECT chunk, l, lag(l, 1) OVER w AS a, lag(l, 2) OVER w AS b, r FROM {sig2} WINDOW w AS (PARTITION BY chunk ORDER BY t)) SELECT chunk, CAST(sum(a * a) AS BIGINT) AS aa, CAST(sum(a * b) AS BIGINT) AS ab, CAST(sum(b * b) AS BIGINT) AS bb, CAST(sum(a * r) AS BIGINT) AS ar, CAST(sum(a * l) AS BIGINT) AS al, CAST(sum(b * l) AS BIGINT) AS bl FROM g WHERE b IS NOT NULL GROUP BY chunk",
    "ag11_zero_lag_correlation": "SELECT chunk, CAST(xy AS DOUBLE) / CAST(xx AS DOUBLE) * CAST(xy AS DOUBLE) / CAST(yy AS DOUBLE) AS r2 FROM (SELECT chunk, CAST(sum(l * r) AS BIGINT) AS xy, CAST(sum(l * l) AS BIGINT) AS xx, CAST(sum(r * r) AS BIGINT) AS yy FROM {sig2} GROUP BY chunk) AS q WHERE xx > 0 AND yy > 0",
    "ag12_filter_shift": "SELECT chunk, CAST(length(bin(m)) AS BIGINT) AS bits FROM (SELECT chunk, CAST(sum(least(abs(e), 1099511627776)) AS BIGINT) div count(*) AS m FROM {res1} WHERE e IS NOT NULL GROUP BY chunk) AS q",
    "ag20_disc_ids": "SELECT conv_id, CAST((sum(s) + max(lead)) & 4294967295 AS BIGINT) AS id1, CAST((sum(greatest(s, 1) * (track + 1)) + max(lead) * (count(*) + 1)) & 4294967295 AS BIGINT) AS id2 FROM (SELECT conv_id, track, start_frame div 588 AS s, total div 588 AS lead FROM {tracks}) AS q GROUP BY conv_id".replace("(sum(s) + max(lead))", "CAST(sum(s) + max(lead) AS BIGINT)").replace("(sum(greatest(s, 1) * (track + 1)) + max(lead) * (count(*) + 1))", "CAST(sum(greatest(s, 1) * (track + 1)) + max(lead) * (count(*) + 1) AS BIGINT)"),
    "ag21_scale": "SELECT chunk, CAST(least(max(CASE WHEN x % 8 = 0 THEN 0 WHEN x % 4 = 0 THEN 1 WHEN x % 2 = 0 THEN 2 ELSE 3 END), 31) AS BIGINT) AS scale FROM {sig} GROUP BY chunk",
    "wi2_lpc_residual": f"WITH g AS (SELECT t, chunk, x, {_LAGS} FROM {{sig}} WINDOW w AS (PARTITION BY chunk ORDER BY t)) SELECT t, x - ((13 * x1 - 6 * x2 + 3 * x3 - 2 * x4) >> 4) AS e FROM g WHERE x4 IS NOT NULL",
    "wi5_long_term": "WITH g AS (SELECT t, e, lag(e, 39) OVER w AS a, lag(e, 40) OVER w AS b, lag(e, 41) OVER w AS c FROM {res1} WHERE e IS NOT NULL WINDOW w AS (PARTITION BY chunk ORDER BY t)) SELECT t, e - ((5 * a + 9 * b + 5 * c) >> 6) AS y FROM g WHERE c IS NOT NULL",
    "wi6_rle_runs": "WITH g AS (SELECT t, chunk, v, CASE WHEN v = lag(v) OVER (PARTITION BY chunk ORDER BY t) THEN 0 ELSE 1 END AS new FROM {sym}), r AS (SELECT t, chunk, v, sum(new) OVER (PARTITION BY chunk ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT chunk, CAST(run AS BIGINT) AS run, v, count(*) AS length FROM r GROUP BY chunk, run, v",
    "wi9_track_ranges": "SELECT conv_id, track, start_frame, end_frame FROM {tracks}",
    "tk2_stereo_mode": f"WITH g AS (SELECT t, chunk, l - lag(l) OVER w AS l, r - lag(r) OVER w AS r, ((l + r) >> 1) - lag((l + r) >> 1) OVER w AS m, (l - r) - lag(l - r) OVER w AS s FROM {{sig2}} WINDOW w AS (PARTITION BY chunk ORDER BY t)), c AS (SELECT chunk, CAST(sum({_z('l')}) AS BIGINT) AS l, CAST(sum({_z('r')}) AS BIGINT) AS r, CAST(sum({_z('m')}) AS BIGINT) AS m, CAST(sum({_z('s')}) AS BIGINT) AS s FROM g WHERE s IS NOT NULL GROUP BY chunk), every AS (SELECT chunk, 0 AS o, 'LeftRight' AS mode, l + r AS cost FROM c UNION ALL SELECT chunk, 1, 'MidSide', m + s FROM c UNION ALL SELECT chunk, 2, 'LeftSide', l + s FROM c UNION ALL SELECT chunk, 3, 'SideRight', s + r FROM c), ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY cost, o) AS n FROM every) SELECT chunk, mode, cost FROM ranked WHERE n = 1",
    "tk4_partition_size": f"WITH p AS (SELECT z.chunk, q.size, z.i div q.size AS part, CAST(sum(z.s) AS BIGINT) AS s, CAST(sum(z.n) AS BIGINT) AS n FROM (SELECT chunk, i div 32 * 32 AS i, sum(z) AS s, count(*) AS n FROM {{zig1}} GROUP BY chunk, i div 32) AS z CROSS JOIN (VALUES {_SIZES}) AS q(size) GROUP BY z.chunk, q.size, z.i div q.size), c AS (SELECT chunk, size, CAST(3 + sum({_part_bits('s', 'n')}) AS BIGINT) AS bits FROM p GROUP BY chunk, size), r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY bits, size) AS o FROM c) SELECT chunk, CAST(size AS BIGINT) AS size, bits FROM r WHERE o = 1",
    "se1_concatenate": "SELECT t, x FROM {sig} WHERE chunk % 2 = 0 UNION ALL SELECT t, x FROM {sig} WHERE chunk % 2 = 1",
    "se3_cue_changed": "SELECT count(*) > 0 AS changed FROM ((SELECT conv_id, track, start_frame FROM {tracks} EXCEPT SELECT conv_id, track, start_frame + track % 2 FROM {tracks}) UNION ALL (SELECT conv_id, track, start_frame + track % 2 FROM {tracks} EXCEPT SELECT conv_id, track, start_frame FROM {tracks})) AS q",
    "st4_tag_split": "SELECT c_custkey, substring(tag, 1, p - 1) AS k, substring(tag, p + 1) AS v FROM (SELECT c_custkey, tag, CAST(instr(tag, '=') AS INT) AS p FROM (SELECT c_custkey, concat(c_mktsegment, '=', c_name) AS tag FROM {customer}) AS a) AS b WHERE p > 1",
    "st7_packed_frame": "SELECT t, (l & 65535) | ((r & 65535) * 65536) AS frame FROM {sig2}",
    "sq1_fixed_reconstruct": "WITH e AS (SELECT t, chunk, x, coalesce(x - lag(x) OVER (PARTITION BY chunk ORDER BY t), x) AS e FROM {sig}) SELECT t, CAST(sum(e) OVER (PARTITION BY chunk ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS back, x FROM e",
    "ap7_info": "SELECT count(*) AS chunks, CAST(sum(frames) AS BIGINT) AS total_frames, min(frames) AS least, max(frames) AS most FROM {chunks}",
}

#: One window gives all five differences, and one aggregate the sums of all orders; the oracle takes them order by order.
_WINDOW = f"WITH lagged AS (SELECT t, chunk, x, {_LAGS} FROM {{sig}} WINDOW w AS (PARTITION BY chunk ORDER BY t))"
_SUMS = ", ".join(f"CAST(sum({_z(d)}) AS BIGINT) AS s{o}, count({d}) AS n{o}" for o, d in enumerate(_DIFF))
_STACK = "stack(5, " + ", ".join(f"{o}, s{o}, n{o}" for o in range(5)) + ") AS (ord, s, n)"


def _by_order(group: str, names: str) -> str:
    return f"{_WINDOW}, sums AS (SELECT {group}, {_SUMS} FROM lagged GROUP BY ALL), cost AS (SELECT {names}, {_STACK} FROM sums)"


#: Expected bits of a frame of n codes that sum to s: its header and the best Rice parameter by the mean.
_FRAME = f"CAST(80 + ({_part_bits('s', 'n')}) AS BIGINT)"

#: Codes whose size changes every 2048 places, so that covers differ.
_UNEVEN = "(SELECT t, z >> CAST((t div 2048) % 5 * 3 AS INT) AS z FROM {zig1}) AS u"


def _cover() -> str:
    """Frame lengths 1024 to 16384: each level's sums and best costs come from the one below, one aggregate a level; a leaf's frame is the highest node above it that isn't split."""
    text = f"WITH l0 AS (SELECT j, s, n, {_FRAME} AS best FROM (SELECT t div 1024 AS j, CAST(sum(z) AS BIGINT) AS s, count(*) AS n FROM {_UNEVEN} GROUP BY t div 1024) AS a)"
    for k in range(1, 5):
        text += f", l{k} AS (SELECT j, s, n, {_FRAME} <= parts AS whole, least({_FRAME}, parts) AS best FROM (SELECT j div 2 AS j, CAST(sum(s) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n, CAST(sum(best) AS BIGINT) AS parts FROM l{k - 1} GROUP BY j div 2) AS a{k})"
    joins = " ".join(f"JOIN l{k} ON l0.j div {1 << k} = l{k}.j" for k in range(1, 5))
    return text + " SELECT l0.j AS leaf, CAST(CASE " + " ".join(f"WHEN l{k}.whole THEN {1024 << k}" for k in (4, 3, 2, 1)) + f" ELSE 1024 END AS BIGINT) AS length, l4.best AS cost FROM l0 {joins}"


def _cover_by_lists() -> str:
    """The same from each node's own sum over the samples, and costs of covers as lists from the leaves up."""
    text = f"WITH own AS (SELECT k, j, {_FRAME} AS own FROM (SELECT k, t // (1024 << k) AS j, sum(z)::BIGINT AS s, count(*) AS n FROM {_UNEVEN} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(k) GROUP BY ALL)), c0 AS (SELECT j, [own] AS cover, [1024] AS lengths FROM own WHERE k = 0)"
    for k in range(1, 5):
        joined = "flatten(list({} ORDER BY c.j))"
        text += f", c{k} AS (SELECT j, CASE WHEN own <= list_sum(parts) THEN [own] ELSE parts END AS cover, CASE WHEN own <= list_sum(parts) THEN [{1024 << k}] ELSE lengths END AS lengths FROM (SELECT c.j // 2 AS j, {joined.format('cover')} AS parts, {joined.format('lengths')} AS lengths FROM c{k - 1} c GROUP BY 1) JOIN (SELECT j, own FROM own WHERE k = {k}) USING (j))"
    text += ", placed AS (SELECT j AS top, list_sum(cover)::BIGINT AS cost, lengths, unnest(range(1, len(lengths) + 1)) AS i FROM c4), spans AS (SELECT top, cost, lengths[i] AS length, top * 16384 + coalesce(list_sum(lengths[1 : i - 1]), 0) AS a FROM placed)"
    return text + " SELECT l.j AS leaf, s.length::BIGINT AS length, s.cost FROM (SELECT j FROM own WHERE k = 0) l JOIN spans s ON l.j * 1024 >= s.a AND l.j * 1024 < s.a + s.length"


#: Pairs of texts, Spark's first.
PAIRS: dict[str, tuple[str, str]] = {
    "tk3_frame_cover": (_cover(), _cover_by_lists()),
    "wi1_fixed_residual": (_by_order("chunk", "chunk") + " SELECT chunk, CAST(ord AS BIGINT) AS ord, s, n FROM cost WHERE n > 0", _FIXED + " SELECT chunk, CAST(ord AS BIGINT) AS ord, CAST(sum(z) AS BIGINT) AS s, count(*) AS n FROM coded GROUP BY chunk, ord"),
    "wi11_shortlist": (_by_order("chunk, t div 1024 AS block", "chunk, block") + ", r AS (SELECT *, row_number() OVER (PARTITION BY chunk, block ORDER BY s, ord) AS n_ FROM cost WHERE n > 0) SELECT chunk, block, CAST(ord AS BIGINT) AS ord, CAST(n_ AS BIGINT) AS place, s FROM r WHERE n_ <= 3", _FIXED + ", cost AS (SELECT chunk, t div 1024 AS block, ord, CAST(sum(z) AS BIGINT) AS s FROM coded GROUP BY chunk, t div 1024, ord), r AS (SELECT *, row_number() OVER (PARTITION BY chunk, block ORDER BY s, ord) AS n FROM cost) SELECT chunk, block, CAST(ord AS BIGINT) AS ord, CAST(n AS BIGINT) AS place, s FROM r WHERE n <= 3"),
    "tk1_min_plan": (_by_order("chunk, (t % 4096) div 256 AS part", "chunk, part") + f", f AS (SELECT chunk, ord, CAST(3 + 16 * ord + sum({_part_bits('s', 'n')}) AS BIGINT) AS bits FROM cost WHERE n > 0 GROUP BY chunk, ord), raw AS (SELECT chunk, count(*) * 17 AS verbatim, min(x) = max(x) AS same FROM {{sig}} GROUP BY chunk), plans AS (SELECT chunk, 'Fixed' AS plan, CAST(ord AS BIGINT) AS ord, bits FROM f UNION ALL SELECT chunk, plan, 0, bits FROM (SELECT chunk, same, stack(2, 'Verbatim', verbatim, 'Constant', CAST(17 AS BIGINT)) AS (plan, bits) FROM raw) WHERE plan = 'Verbatim' OR same), best AS (SELECT chunk, min(struct(bits, plan, ord)) AS b FROM plans GROUP BY chunk) SELECT chunk, b.plan AS plan, b.ord AS ord, b.bits AS bits FROM best", _FIXED + f", p AS (SELECT chunk, ord, (t % 4096) div 256 AS part, CAST(sum(z) AS BIGINT) AS s, count(*) AS n FROM coded GROUP BY chunk, ord, (t % 4096) div 256), f AS (SELECT chunk, ord, CAST(3 + 16 * ord + sum({_part_bits('s', 'n')}) AS BIGINT) AS bits FROM p GROUP BY chunk, ord), raw AS (SELECT chunk, count(*) * 17 AS verbatim, min(x) = max(x) AS same FROM {{sig}} GROUP BY chunk), every AS (SELECT chunk, 'Fixed' AS plan, CAST(ord AS BIGINT) AS ord, bits FROM f UNION ALL SELECT chunk, 'Verbatim', 0, verbatim FROM raw UNION ALL SELECT chunk, 'Constant', 0, 17 FROM raw WHERE same), ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY bits, plan, ord) AS n FROM every) SELECT chunk, plan, ord, bits FROM ranked WHERE n = 1".replace(", every AS (SELECT chunk, 'Fixed'", ", plans AS (SELECT chunk, 'Fixed'").replace("AS n FROM every) SELECT chunk, plan", "AS n FROM plans) SELECT chunk, plan")),
    "tk8_rice_parameter": ("WITH c AS (SELECT chunk, i div 256 AS part, " + ", ".join(f"sum((z >> {k}) + {1 + k}) AS b{k}" for k in range(16)) + " FROM {zig1} GROUP BY chunk, i div 256), r AS (SELECT chunk, part, least(" + ", ".join(f"struct(b{k} AS bits, CAST({k} AS BIGINT) AS k)" for k in range(16)) + ") AS b FROM c) SELECT chunk, part, b.k AS k, CAST(b.bits AS BIGINT) AS bits FROM r", f"WITH c AS (SELECT z.chunk, z.part, p.k, CAST(sum((z.z >> p.k) + 1 + p.k) AS BIGINT) AS bits FROM (SELECT chunk, i div 256 AS part, z FROM {{zig1}}) AS z CROSS JOIN (VALUES {_PARAMS}) AS p(k) GROUP BY z.chunk, z.part, p.k), r AS (SELECT *, row_number() OVER (PARTITION BY chunk, part ORDER BY bits, k) AS o FROM c) SELECT chunk, part, CAST(k AS BIGINT) AS k, bits FROM r WHERE o = 1"),
    "jo3_track_cut": ("SELECT k.track, count(*) AS frames, CAST(sum(s.x) AS BIGINT) AS total FROM (SELECT *, t div 1024 AS bucket FROM {sig}) AS s JOIN (SELECT *, explode(sequence(a div 1024, (b - 1) div 1024)) AS bucket FROM (SELECT CAST(n_nationkey AS BIGINT) AS track, CAST(n_nationkey * 300 AS BIGINT) AS a, CAST((n_nationkey + 1) * 300 AS BIGINT) AS b FROM {nation})) AS k ON s.bucket = k.bucket AND s.t >= k.a AND s.t < k.b GROUP BY k.track", "SELECT k.track, count(*) AS frames, CAST(sum(s.x) AS BIGINT) AS total FROM (SELECT * FROM {sig}) AS s JOIN (SELECT CAST(n_nationkey AS BIGINT) AS track, CAST(n_nationkey * 300 AS BIGINT) AS a, CAST((n_nationkey + 1) * 300 AS BIGINT) AS b FROM {nation}) AS k ON s.t >= k.a AND s.t < k.b GROUP BY k.track"),
    "fi1_seek_chunk": ("SELECT q.frame, c.chunk, q.frame - c.start_frame AS within FROM (SELECT CAST(37 * n_nationkey AS BIGINT) AS frame, CAST(37 * n_nationkey AS BIGINT) div 4096 AS bucket FROM {nation}) AS q JOIN (SELECT *, explode(sequence(start_frame div 4096, (start_frame + frames - 1) div 4096)) AS bucket FROM {chunks}) AS c ON q.bucket = c.bucket AND c.start_frame <= q.frame AND q.frame < c.start_frame + c.frames", "SELECT q.frame, c.chunk, q.frame - c.start_frame AS within FROM (SELECT CAST(37 * n_nationkey AS BIGINT) AS frame FROM {nation}) AS q JOIN {chunks} ON c.start_frame <= q.frame AND q.frame < c.start_frame + c.frames".replace("{chunks}", "(SELECT * FROM {chunks}) AS c")),
    "jo7_parity_cover": (f"SELECT c.chunk, g.grp, g.first FROM (SELECT * FROM {{chunks}}) AS c JOIN (SELECT chunk div {_GROUPS} AS grp, min(chunk) AS first, count(*) AS n FROM {{chunks}} GROUP BY chunk div {_GROUPS}) AS g ON c.chunk div {_GROUPS} = g.grp", f"SELECT chunk, chunk div {_GROUPS} AS grp, min(chunk) OVER (PARTITION BY chunk div {_GROUPS}) AS first FROM {{chunks}}"),
    "wi8_frame_positions": ("WITH c AS (SELECT *, chunk div 1024 AS span FROM {chunks}), s AS (SELECT span, sum(sum(frames)) OVER (ORDER BY span) - sum(frames) AS base FROM c GROUP BY span) SELECT c.chunk, c.frames, CAST(s.base + sum(c.frames) OVER (PARTITION BY c.span ORDER BY c.chunk) - c.frames AS BIGINT) AS start_frame FROM c JOIN s ON c.span = s.span", "SELECT chunk, frames, CAST(sum(frames) OVER (ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS BIGINT) - frames AS start_frame FROM {chunks}"),
    "se2_replace_tags": ("WITH fresh AS (SELECT lower(n_name) AS k, 'new' AS v FROM {nation} WHERE n_regionkey = 1 UNION ALL SELECT r_name, 'added' FROM {region}), held AS (SELECT n_name AS k, 'old' AS v FROM {nation}) SELECT * FROM fresh UNION ALL SELECT h.* FROM held AS h LEFT ANTI JOIN fresh AS f ON upper(h.k) = upper(f.k)", "SELECT CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS k, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS v FROM {nation} UNION ALL SELECT r_name, 'added' FROM {region}"),
    "st2_cue_render": ("SELECT conv_id, concat(concat_ws('\\r\\n', 'FILE \"a.wav\" WAVE', array_join(transform(array_sort(collect_list(struct(track, start_frame))), x -> concat('  TRACK ', lpad(CAST(x.track + 1 AS STRING), 2, '0'), ' AUDIO\\r\\n    INDEX 01 ', lpad(CAST(x.start_frame div 588 div 4500 AS STRING), 2, '0'), ':', lpad(CAST(x.start_frame div 588 div 75 % 60 AS STRING), 2, '0'), ':', lpad(CAST(x.start_frame div 588 % 75 AS STRING), 2, '0'))), '\\r\\n')), '\\r\\n') AS sheet FROM {tracks} GROUP BY conv_id", "SELECT conv_id, 'FILE \"a.wav\" WAVE' || chr(13) || chr(10) || string_agg(format('  TRACK {:02d} AUDIO', track + 1) || chr(13) || chr(10) || format('    INDEX 01 {:02d}:{:02d}:{:02d}', start_frame // 588 // 4500, start_frame // 588 // 75 % 60, start_frame // 588 % 75) || chr(13) || chr(10), '' ORDER BY track) AS sheet FROM {tracks} GROUP BY conv_id"),
    "st5_picture_type": ("SELECT p_partkey, CAST(CASE lower(regexp_extract(spec, '^(front|back|artist):', 1)) WHEN 'back' THEN 4 WHEN 'artist' THEN 8 ELSE 3 END AS BIGINT) AS kind, CASE WHEN lower(spec) LIKE '%.png' THEN 'image/png' WHEN lower(spec) RLIKE '[.]jpe?g$' THEN 'image/jpeg' END AS mime FROM (SELECT p_partkey, concat(element_at(array('front:', 'back:', 'artist:', ''), CAST(p_size % 4 + 1 AS INT)), 'C:/', p_name, element_at(array('.png', '.JPG', '.jpeg', '.webp'), CAST(p_partkey % 4 + 1 AS INT))) AS spec FROM {part}) AS q", "SELECT p_partkey, [3, 4, 8, 3][p_size % 4 + 1]::BIGINT AS kind, ['image/png', 'image/jpeg', 'image/jpeg', NULL][p_partkey % 4 + 1] AS mime FROM {part}"),
    "pr9_map_inverse": ("SELECT t, CAST(ceil((CAST(v AS DECIMAL(38,0)) * 4294967296 - 700000001) / 5884105195) AS BIGINT) AS k FROM (SELECT t, (x * 5884105195 + 700000001) >> 32 AS v FROM {sig}) AS q", "SELECT t, x AS k FROM {sig}"),
    "ag10_fitted_line": ("WITH m AS (SELECT chunk, CAST(count(*) AS BIGINT) AS n, CAST(sum(t % 4096) AS BIGINT) AS st, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(t % 4096 * x) AS BIGINT) AS stx, CAST(sum(t % 4096 * (t % 4096)) AS BIGINT) AS stt FROM {sig} GROUP BY chunk) SELECT chunk, round(CAST(n * stx - st * sx AS DOUBLE) / CAST(n * stt - st * st AS DOUBLE), 6) AS slope, round(CAST(sx * stt - st * stx AS DOUBLE) / CAST(n * stt - st * st AS DOUBLE), 3) AS intercept FROM m", "SELECT chunk, round(regr_slope(x, t % 4096), 6) AS slope, round(regr_intercept(x, t % 4096), 3) AS intercept FROM {sig} GROUP BY chunk"),
    "ag18_track_checksum": ("WITH f AS (SELECT t div 4000 AS track, t % 4000 + 1 AS pos, (l & 65535) | ((r & 65535) * 65536) AS frame, count(*) OVER (PARTITION BY t div 4000) AS n FROM {sig2}), b AS (SELECT max(track) AS last FROM f) SELECT track, CAST(sum((frame * pos) & 4294967295) & 4294967295 AS BIGINT) AS v1, CAST((sum((frame * pos) & 4294967295) + sum((frame * pos) >> 32)) & 4294967295 AS BIGINT) AS v2 FROM f CROSS JOIN b WHERE (track > 0 OR pos >= 2940) AND (track < last OR pos <= greatest(0, n - 2940)) GROUP BY track", "WITH f AS (SELECT t div 4000 AS track, list(((l & 65535) | ((r & 65535) * 65536))::HUGEINT ORDER BY t) AS fs FROM {sig2} GROUP BY 1), w AS (SELECT track, [fs[i] * i FOR i IN range(CASE WHEN track = 0 THEN 2940 ELSE 1 END, CASE WHEN track = max(track) OVER () THEN greatest(0, len(fs) - 2940) ELSE len(fs) END + 1)] AS p FROM f) SELECT track, (list_sum([x % 4294967296 FOR x IN p])::HUGEINT % 4294967296)::BIGINT AS v1, ((list_sum([x % 4294967296 FOR x IN p])::HUGEINT + list_sum([x // 4294967296 FOR x IN p])::HUGEINT) % 4294967296)::BIGINT AS v2 FROM w WHERE len(p) > 0"),
    "fi5_cue_in_bounds": ("SELECT conv_id, track FROM {tracks} WHERE start_frame * 2 > total", "SELECT conv_id, track FROM {tracks} WHERE NOT start_frame <= total - start_frame"),
    "fi12_disc_eligible": ("SELECT conv_id, max(channels) = 2 AND max(rate) = 44100 AND max(bits) = 16 AND max(total) % 588 = 0 AND bool_and(start_frame % 588 = 0) AND count(*) <= 99 AS ok FROM (SELECT *, 1 + conv_id % 2 AS channels, CASE WHEN conv_id % 3 = 0 THEN 48000 ELSE 44100 END AS rate, CASE WHEN conv_id % 5 = 0 THEN 24 ELSE 16 END AS bits FROM {tracks}) AS q GROUP BY conv_id", "SELECT conv_id, conv_id % 2 = 1 AND conv_id % 3 <> 0 AND conv_id % 5 <> 0 AND count(*) <= 99 AS ok FROM {tracks} GROUP BY conv_id"),
    "wi10_cue_checks": ("SELECT conv_id, count(*) AS bad FROM (SELECT conv_id, at - lag(at) OVER (PARTITION BY conv_id ORDER BY track) AS step FROM (SELECT conv_id, track, CASE WHEN track % 3 = 2 THEN start_frame - 3 * 588 * (1 + conv_id % 3) ELSE start_frame END AS at FROM {tracks})) AS q WHERE step < 0 GROUP BY conv_id", "SELECT b.conv_id, count(*) AS bad FROM (SELECT * FROM {tracks}) AS b JOIN (SELECT * FROM {tracks}) AS a ON a.conv_id = b.conv_id AND a.track + 1 = b.track WHERE b.track % 3 = 2 GROUP BY b.conv_id"),
    "pr15_windows": ("SELECT t, round(1 - power(2 * p - 1, 2), 6) AS welch, round(0.5 - 0.5 * cos(2 * pi() * p), 6) AS hann, round(CASE WHEN least(p, 1 - p) < 0.25 THEN 0.5 - 0.5 * cos(4 * pi() * least(p, 1 - p)) ELSE 1.0 END, 6) AS tukey FROM (SELECT t, (t % 512 + 0.5D) / 512 AS p FROM {sig}) AS q", "SELECT t, round(4 * p * (1 - p), 6) AS welch, round(power(sin(pi() * p), 2), 6) AS hann, round(CASE WHEN p BETWEEN 0.25 AND 0.75 THEN 1.0 ELSE power(sin(2 * pi() * p), 2) END, 6) AS tukey FROM (SELECT t, (t % 512 + 0.5::DOUBLE) / 512 AS p FROM {sig}) AS q"),
    "ag20_disc_number": ("SELECT conv_id, CAST((sum(aggregate(transform(split(CAST((start_frame div 588 + 150) div 75 AS STRING), ''), d -> CAST(CASE WHEN d = '' THEN '0' ELSE d END AS BIGINT)), CAST(0 AS BIGINT), (a, d) -> a + d)) % 255) * 16777216 + (max(total) div 588 div 75 - min(start_frame) div 588 div 75) * 256 + count(*) AS BIGINT) AS id, concat(array_join(transform(array_sort(collect_list(struct(track, start_frame))), x -> CAST(x.start_frame div 588 AS STRING)), ':'), ':', CAST(max(total) div 588 AS STRING)) AS toc FROM {tracks} GROUP BY conv_id", "SELECT conv_id, ((sum(list_sum([x::INT FOR x IN string_split(((start_frame // 588 + 150) // 75)::VARCHAR, '')])) % 255) * 16777216 + (max(total) // 588 // 75 - min(start_frame) // 588 // 75) * 256 + count(*))::BIGINT AS id, string_agg((start_frame // 588)::VARCHAR, ':' ORDER BY track) || ':' || (max(total) // 588)::VARCHAR AS toc FROM {tracks} GROUP BY conv_id"),
    "ag15_sha256": ("SELECT doc_id, sha2(text, 256) AS digest, length(CAST(text AS BINARY)) AS bytes FROM {documents}", "SELECT doc_id, sha256(text) AS digest, strlen(text)::INTEGER AS bytes FROM documents"),
    "ag20_musicbrainz_digits": ("SELECT conv_id, CAST(sum(aggregate(transform(split(CAST((start_frame div 588 + 150) div 75 AS STRING), ''), d -> CAST(CASE WHEN d = '' THEN '0' ELSE d END AS INT)), 0, (a, d) -> a + d)) % 255 AS BIGINT) AS n FROM {tracks} GROUP BY conv_id", "SELECT conv_id, (sum(list_sum([x::INT FOR x IN string_split(((start_frame // 588 + 150) // 75)::VARCHAR, '')])) % 255)::BIGINT AS n FROM {tracks} GROUP BY conv_id"),
    "wi7_parameter_delta": ("SELECT chunk, t, p - lag(p) IGNORE NULLS OVER (PARTITION BY chunk ORDER BY t) AS d FROM (SELECT chunk, t, CASE WHEN x % 5 = 0 THEN NULL ELSE x % 32 END AS p FROM {sig}) AS q", "SELECT chunk, t, p - lag(p IGNORE NULLS) OVER (PARTITION BY chunk ORDER BY t) AS d FROM (SELECT chunk, t, CASE WHEN x % 5 = 0 THEN NULL ELSE x % 32 END AS p FROM {sig}) AS q"),
}


def _query(text: str):
    return lambda spark, sf_dir: run(spark, sf_dir, text)


QUERIES = {name: _query(text) for name, text in TEXTS.items()} | {name: _query(text) for name, (text, _) in PAIRS.items()}
ORACLES = {name: duckdb(text) for name, text in TEXTS.items()} | {name: duckdb(text) for name, (_, text) in PAIRS.items()}


def _pair(spark, sf_dir):
    """The stereo signal, one row a sample of a channel."""
    long = "SELECT 'events' AS stream_id, CAST(0 AS INT) AS channel, t, l AS x FROM {sig2} UNION ALL SELECT 'events', CAST(1 AS INT), t, r FROM {sig2}"
    return run(spark, sf_dir, long)


def chunk_round_trip(spark, sf_dir):
    """Samples after coding into chunks and decoding."""
    return codec.decode(codec.encode(_pair(spark, sf_dir), 32, 4096), 32).select("t", "channel", "x")


def parity_repair(spark, sf_dir):
    """Samples after one chunk of every eight is lost and rebuilt from parity."""
    chunks = codec.encode(_pair(spark, sf_dir), 32, 4096)
    whole = parity.repair(chunks.where("chunk % 8 <> 0"), parity.protect(chunks, 8, 2), 8)
    whole = whole.withColumns({"start_frame": F.col("chunk") * 4096, "channels": F.lit(2), "crc": F.crc32("payload")})
    return codec.decode(whole, 32).select("t", "channel", "x")


_SAMPLES = duckdb("SELECT t, CAST(0 AS INT) AS channel, l AS x FROM {sig2} UNION ALL SELECT t, CAST(1 AS INT), r FROM {sig2}")
QUERIES |= {"sq15_chunk_round_trip": chunk_round_trip, "sq17_parity_repair": parity_repair}
ORACLES |= {"sq15_chunk_round_trip": _SAMPLES, "sq17_parity_repair": _SAMPLES}
QUERIES |= signals.QUERIES
ORACLES |= signals.ORACLES
