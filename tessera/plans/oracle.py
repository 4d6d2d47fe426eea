"""DuckDB oracle SQL, one per query key (see ``oracle_base`` for the fixture world)."""

from __future__ import annotations

from tessera.plans.oracle_base import SP, VP, WP, compose, d, q6

ORACLE: dict[str, str] = {}


def oracle(key: str, body: str, *needs: str) -> None:
    ORACLE[key] = compose(body, *needs)


# ---- R ------------------------------------------------------------------------
oracle("r_lattice", "SELECT x, y FROM lat", "lat")
oracle("r_normalize_rects", "SELECT k, x1, y1, x2, y2 FROM norm", "norm")
oracle("r_filter_rects", "SELECT k, x1, y1, x2, y2 FROM rooms", "rooms")
oracle("r_rect_centroids", "SELECT k, x, y FROM centroids", "centroids")
oracle("r_rasterize_rects", "SELECT k, x, y FROM floors", "floors")
oracle("r_overlap_counts", "SELECT x, y, count(*) AS n FROM floors WHERE k % 7 <> 0 GROUP BY x, y", "floors")
oracle("r_classify_cells", "SELECT x, y, tile FROM grid", "grid")
oracle("r_grid_extent", "SELECT max(x) AS max_x, max(y) AS max_y FROM grid", "grid")
oracle("r_glyph_cells", """
WITH w AS (
  SELECT p_partkey, string_split(p_name, ' ') AS words FROM part),
l AS (
  SELECT p_partkey, CAST(i - 1 AS INTEGER) AS sy,
         rpad(words[i], CAST(list_max(list_transform(words, lambda v: length(v))) AS INTEGER), '.') AS line
  FROM w, generate_series(1, len(words)) AS g(i))
SELECT p_partkey AS stamp_id, CAST(j - 1 AS INTEGER) AS sx, sy,
       nullif(substr(line, CAST(j AS INTEGER), 1), '.') AS ch
FROM l, generate_series(1, length(line)) AS h(j)""")

# ---- L ------------------------------------------------------------------------
oracle("l_ray_fan", f"SELECT id, col, {q6('angle')} AS angle FROM rays", "rays")
oracle("l_ray_march", f"SELECT id, col, n, cx, cy, {q6('dist')} AS dist, tile FROM march", "march")
oracle("l_visible_cells",
       f"SELECT id, col, tile_x, tile_y, tile, {q6('dist')} AS dist FROM visible", "visible")
oracle("l_first_hit", f"""
SELECT id, col, min(n) AS n, {q6('min(dist)')} AS dist
FROM march WHERE tile = '#' GROUP BY id, col""", "march")
ORACLE["l_skip_hits"] = ORACLE["l_first_hit"]
oracle("l_ray_depth",
       f"SELECT id, col, {q6('angle')} AS angle, {q6('depth')} AS depth FROM depths", "depths")
oracle("l_ray_extent", f"SELECT id, col, {q6('extent')} AS extent FROM extent", "extent")
oracle("l_visible_cell_set", "SELECT id, tile_x, tile_y, tile FROM cellset", "cellset")

FLAGSHIP_SQL = compose(f"""
SELECT id, count(*) AS rays_hit, min(n) AS min_n, max(n) AS max_n,
       {q6('avg(dist)')} AS avg_dist
FROM (SELECT id, col, min(n) AS n, min(dist) AS dist FROM march WHERE tile = '#'
      GROUP BY id, col) h GROUP BY id""", "march")

# ---- C ------------------------------------------------------------------------
oracle("c_observer_frame",
       f"SELECT obs_id, target_id, {q6('depth')} AS depth, {q6('horiz')} AS horiz FROM frame", "frame")
oracle("c_project",
       f"SELECT obs_id, target_id, screen_x, screen_y, {q6('depth')} AS depth FROM screen", "screen")
oracle("c_lod", "SELECT obs_id, target_id, eff_stamp AS stamp_id FROM lodsel", "lodsel")
oracle("c_unhidden", f"""
SELECT DISTINCT t.obs_id, t.target_id
FROM (SELECT l.*, screen_x - round_even(s.w / 2 * sc, 0) AS ax, ceil(s.w * sc) AS cols
      FROM (SELECT *, ({d(VP.projection_factor)} * world_w / depth) AS size FROM lodsel) l
      JOIN stamps s ON s.stamp_id = l.eff_stamp, LATERAL (SELECT l.size / s.w AS sc) z) t
JOIN rays r ON r.id = t.obs_id AND r.col BETWEEN greatest(t.ax, 0) AND least(t.ax + t.cols + 1, {VP.view_w - 1})
LEFT JOIN extent e ON e.id = r.id AND e.col = r.col
WHERE t.depth < coalesce(e.extent, {d(VP.max_steps * VP.step)})""", "lodsel", "stamps", "rays", "extent")
oracle("c_lod_table", f"""
WITH lod AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'bullet' ELSE 'player' END AS kind,
                    ((p_partkey * 6151) % 1200) / {d(100.0)} AS min_depth, CAST(p_partkey % 5 AS INTEGER) AS stamp_id FROM part)
SELECT s.obs_id, s.target_id, coalesce(max(l.stamp_id), any_value(s.stamp_id)) AS stamp_id
FROM screen s LEFT JOIN lod l ON l.kind = s.kind
  AND l.min_depth = (SELECT max(m.min_depth) FROM lod m WHERE m.kind = s.kind AND m.min_depth < s.depth)
GROUP BY s.obs_id, s.target_id""", "screen")
oracle("c_column_height", "SELECT id, col, height FROM heights", "heights")
oracle("c_depth_band", """
SELECT d.id, d.col, g.glyph AS band FROM depths d JOIN glyphs g ON d.depth >= g.lo AND d.depth < g.hi""", "depths", "glyphs")
oracle("c_column_raster", "SELECT id, x, y, ch FROM base", "base")
oracle("c_stamp_expand", f"""
SELECT obs_id, target_id, sx, sy, ch, {q6('scale_x')} AS scale_x, {q6('scale_y')} AS scale_y
FROM expanded""", "expanded")
oracle("c_stamp_spans", "SELECT obs_id, target_id, sx, sy, ch, x0, x1, y0, y1 FROM spans", "spans")
oracle("c_span_pixels",
       f"SELECT obs_id, target_id, sx, sy, px, py, ch, {q6('depth')} AS depth FROM pixels", "pixels")
oracle("c_occlusion",
       f"SELECT obs_id, target_id, sx, sy, px, py, ch, {q6('depth')} AS depth FROM vispix", "vispix")
oracle("c_nearest_pixel",
       f"SELECT id, px, py, ch, target_id, {q6('depth')} AS depth FROM nearest", "nearest")
oracle("c_overlay", "SELECT id, x, y, ch FROM overlay", "overlay")
oracle("c_raster_rows",
       "SELECT id, y, string_agg(ch, '' ORDER BY x) AS row FROM overlay GROUP BY id, y", "overlay")
oracle("c_coverage_map", "SELECT id, x, y, ch FROM coverage", "coverage")
oracle("c_coverage_stats", """
SELECT c.id, count(*) AS cells_seen, count(*) FILTER (WHERE c.tile = '#') AS walls_seen,
       count(*) FILTER (WHERE w.n >= 2) AS shared_cells
FROM cellset c JOIN (SELECT tile_x, tile_y, count(*) AS n FROM cellset GROUP BY 1, 2) w
  ON w.tile_x = c.tile_x AND w.tile_y = c.tile_y
GROUP BY c.id""", "cellset")

oracle("c_coverage_bitmaps", """
WITH c AS (SELECT s.*, a.team FROM cellset s JOIN actors a ON a.id = s.id)
SELECT 'observer' AS level, team, id, count(*) AS cells_seen FROM c GROUP BY team, id
UNION ALL SELECT 'team', team, NULL, count(DISTINCT (tile_x, tile_y)) FROM c GROUP BY team
UNION ALL SELECT 'world', NULL, NULL, n FROM (SELECT count(DISTINCT (tile_x, tile_y)) AS n FROM c) t WHERE n > 0""", "cellset", "actors")

# ---- J ------------------------------------------------------------------------
_BK = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
oracle("j_cell_join", f"""
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, p.owner, t.id AS victim_id,
       {q6('t.x')} AS victim_x, {q6('t.y')} AS victim_y
FROM proj p, targets t
WHERE t.kind = 'player' AND CAST(p.x AS INTEGER) = CAST(t.x AS INTEGER)
  AND CAST(p.y AS INTEGER) = CAST(t.y AS INTEGER) AND p.owner <> t.id""", "proj", "targets")
oracle("j_cell_lookup", f"""
SELECT {_BK}, {q6('a.x')} AS x, {q6('a.y')} AS y
FROM moved a JOIN grid g ON g.x = CAST(a.x AS BIGINT) AND g.y = CAST(a.y AS BIGINT)
WHERE g.tile <> '#'""", "moved", "grid")
oracle("j_blocked", f"""
SELECT {_BK} FROM proj p WHERE EXISTS (SELECT 1 FROM grid g WHERE g.x = CAST(p.x AS INTEGER)
  AND g.y = CAST(p.y AS INTEGER) AND g.tile = '#')""", "proj", "grid")
oracle("j_unblocked", f"""
SELECT {_BK} FROM proj p WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.x = CAST(p.x AS INTEGER)
  AND g.y = CAST(p.y AS INTEGER) AND g.tile = '#')""", "proj", "grid")
oracle("j_out_of_bounds", f"""
SELECT {_BK}, {q6('x')} AS x, {q6('y')} AS y FROM moved
WHERE x < 0 OR x >= (SELECT mx FROM gext) OR y < 0 OR y >= (SELECT my FROM gext)""", "moved", "gext")

# ---- M ------------------------------------------------------------------------
_NOW, _IV = 1704067200 + 7200.5, 900
oracle("m_latest_action", "SELECT key, action, ts, seq FROM latest", "latest")
oracle("m_moves", f"SELECT id, {q6('x')} AS x, {q6('y')} AS y FROM a1", "a1")
oracle("m_turns", f"SELECT id, {q6('dir')} AS dir FROM a2", "a2")
oracle("m_spawn", f"""
SELECT owner, {q6('x')} AS x, {q6('y')} AS y, {q6('dir')} AS dir, kind, stamp_id, icon, world_w
FROM spawned""", "spawned")
oracle("m_assign_ids", """
SELECT (SELECT max(id) FROM actors) + row_number() OVER (ORDER BY owner) AS id, owner
FROM spawned""", "spawned", "actors")
oracle("m_consume_quota", "SELECT id, ammo FROM a3", "a3")
oracle("m_advance", f"SELECT {_BK}, id, {q6('x')} AS x, {q6('y')} AS y FROM adv", "adv")
oracle("m_apply_hits", "SELECT id, hp FROM a4", "a4")
oracle("m_credit", "SELECT id, score FROM a5", "a5")
oracle("m_expire_hits", f"SELECT {_BK}, id FROM remaining", "remaining")
oracle("m_respawn", f"SELECT id, {q6('x')} AS x, {q6('y')} AS y, {q6('dir')} AS dir FROM a6", "a6")
oracle("m_reset", "SELECT id, hp, ammo FROM a7", "a7")
oracle("m_refill", "SELECT id, ammo, last_refill FROM a8", "a8")
oracle("m_upsert", """
SELECT l.key, l.action, l.ts, l.seq FROM latest l
WHERE NOT (l.action = 'd' AND l.ts >= TIMESTAMP '2024-01-15 00:00:00')""", "latest")
oracle("m_clear_actions", """
SELECT a.key, a.seq, a.action FROM actions a
LEFT JOIN (SELECT key, arg_max(seq, (ts, seq)) AS off FROM actions
           WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY key) o ON o.key = a.key
WHERE o.off IS NULL OR a.seq > o.off""", "actions")
oracle("m_get_or_create", f"""
WITH r AS (
  SELECT name, min(icon) AS icon FROM (
    SELECT 'Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS name,
           chr(CAST(65 + user_id % 26 AS INTEGER)) AS icon FROM events) q GROUP BY name),
e AS (SELECT * FROM actors QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1)
SELECT e.name, e.id, false AS created, {q6('e.x')} AS x, {q6('e.y')} AS y, {q6('e.dir')} AS dir, e.kind, e.stamp_id,
       e.icon, e.hp, e.ammo, e.score
FROM r JOIN e ON e.name = r.name
UNION ALL
SELECT r.name, (SELECT max(id) FROM actors) + row_number() OVER (ORDER BY r.name), true, {d(SP.spawn_x)}, {d(SP.spawn_y)},
       {d(SP.spawn_dir)}, 'player', 0, r.icon, {SP.hp_full}, {SP.ammo_max}, 0
FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.name = r.name)""", "actors")
oracle("m_constraint_violations", """
SELECT 'pk_lineitem' AS rule, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS key,
       count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL
SELECT 'pk_events', CAST(event_id AS VARCHAR), count(*) FROM events GROUP BY event_id HAVING count(*) > 1
UNION ALL
SELECT 'unique_supplier_name', s_name, count(*) FROM supplier GROUP BY s_name HAVING count(*) > 1
UNION ALL
SELECT 'not_null_events', CAST(event_id AS VARCHAR), count(*) FROM events
WHERE user_id IS NULL OR ts IS NULL OR event_type IS NULL GROUP BY event_id
UNION ALL
SELECT 'fk_lineitem_part', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem l
WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
GROUP BY l_partkey
UNION ALL
SELECT 'fk_lineitem_supplier', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem l
WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)
GROUP BY l_suppkey
UNION ALL
SELECT 'fk_lineitem_orders', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem l
WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
GROUP BY l_orderkey
UNION ALL
SELECT 'fk_orders_customer', CAST(o_custkey AS VARCHAR), count(*) FROM orders o
WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
GROUP BY o_custkey""")
oracle("m_keyed_state", f"""
SELECT id, name, {q6('x')} AS x, {q6('y')} AS y, {q6('dir')} AS dir FROM actors
WHERE id IN (SELECT key FROM actions WHERE action = 'x')""", "actors", "actions")
oracle("m_trajectory", f"""
SELECT key, seq, {q6('x0 + sx / 1e9')} AS x, {q6('y0 + sy / 1e9')} AS y, {q6('dir')} AS dir
FROM (
  SELECT *,
    sum(CAST(round(sgn * cos(dir) * {d(SP.move_speed)} * 1000000000) AS BIGINT))
      OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sx,
    sum(CAST(round(sgn * sin(dir) * {d(SP.move_speed)} * 1000000000) AS BIGINT))
      OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sy
  FROM (
    SELECT t.*, coalesce(a.x, {d(SP.spawn_x)}) AS x0, coalesce(a.y, {d(SP.spawn_y)}) AS y0,
      coalesce(a.dir, {d(SP.spawn_dir)}) + t.net * {d(SP.turn_speed)} AS dir,
      CASE t.action WHEN 'w' THEN 1.0::DOUBLE WHEN 's' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sgn
    FROM (SELECT *, sum(CASE action WHEN 'd' THEN 1 WHEN 'a' THEN -1 ELSE 0 END)
                      OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS net
          FROM actions) t
    LEFT JOIN actors a ON a.id = t.key) u) v""", "actions", "actors")
# one action after the other, each with the wall test of its own step
oracle("m_replay", f"""
WITH RECURSIVE st AS (
  SELECT t.key, t.i, t.seq, t.action IN ('w', 's') AS is_move, t.x0, t.y0, t.dir,
    CAST(round(sgn * cos(dir) * {d(SP.move_speed)} * 1000000000) AS BIGINT) AS vx,
    CAST(round(sgn * sin(dir) * {d(SP.move_speed)} * 1000000000) AS BIGINT) AS vy
  FROM (SELECT e.*, coalesce(a.x, {d(SP.spawn_x)}) AS x0, coalesce(a.y, {d(SP.spawn_y)}) AS y0,
          coalesce(a.dir, {d(SP.spawn_dir)}) + e.net * {d(SP.turn_speed)} AS dir,
          CASE e.action WHEN 'w' THEN 1.0::DOUBLE WHEN 's' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sgn
        FROM (SELECT *, row_number() OVER w AS i,
                     sum(CASE action WHEN 'd' THEN 1 WHEN 'a' THEN -1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS net
              FROM actions WINDOW w AS (PARTITION BY key ORDER BY ts, seq)) e
        LEFT JOIN actors a ON a.id = e.key) t),
walk(key, i, seq, px, py, dir, moved) AS (
  SELECT key, 0::BIGINT, NULL::BIGINT, CAST(round(x0 * 1000000000) AS BIGINT), CAST(round(y0 * 1000000000) AS BIGINT), dir, false
  FROM st WHERE i = 1
  UNION ALL
  SELECT s.key, s.i, s.seq, CASE WHEN g.x IS NULL THEN w.px ELSE w.px + s.vx END,
         CASE WHEN g.x IS NULL THEN w.py ELSE w.py + s.vy END, s.dir, CASE WHEN s.is_move THEN g.x IS NOT NULL END
  FROM walk w JOIN st s ON s.key IS NOT DISTINCT FROM w.key AND s.i = w.i + 1
  LEFT JOIN (SELECT x, y FROM grid WHERE tile <> '#') g
    ON s.is_move AND g.x = CAST((w.px + s.vx) / 1e9 AS BIGINT) AND g.y = CAST((w.py + s.vy) / 1e9 AS BIGINT))
SELECT key, seq, {q6('px / 1e9')} AS x, {q6('py / 1e9')} AS y, {q6('dir')} AS dir, moved FROM walk WHERE i > 0""",
       "actions", "actors", "grid")
_CAP, _TIV = WP.quota_max, WP.refill_interval_s * 1000000
oracle("m_token_bucket", f"""
WITH RECURSIVE ev AS (
  SELECT key, seq, action, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i
  FROM actions),
tb(key, i, seq, allowed, tokens, last) AS (
  SELECT key, i, seq, allowed,
    CASE WHEN t1 <> {_CAP} AND (us - last0) // {_TIV} > 0 THEN least({_CAP}, t1 + (us - last0) // {_TIV})
         ELSE t1 END,
    CASE WHEN t1 <> {_CAP} AND (us - last0) // {_TIV} > 0 THEN (us + 500000) // 1000000 * 1000000
         ELSE last0 END
  FROM (SELECT e.*, CASE WHEN action = 'x' THEN 1 ELSE 0 END AS allowed,
               {_CAP} - CASE WHEN action = 'x' THEN 1 ELSE 0 END AS t1,
               (us + 500000) // 1000000 * 1000000 AS last0
        FROM ev e WHERE i = 1) f
  UNION ALL
  SELECT key, i, seq, allowed,
    CASE WHEN t1 <> {_CAP} AND (us - last0) // {_TIV} > 0 THEN least({_CAP}, t1 + (us - last0) // {_TIV})
         ELSE t1 END,
    CASE WHEN t1 <> {_CAP} AND (us - last0) // {_TIV} > 0 THEN (us + 500000) // 1000000 * 1000000
         ELSE last0 END
  FROM (SELECT e.key, e.i, e.seq, e.us,
               CASE WHEN e.action = 'x' AND p.tokens > 0 THEN 1 ELSE 0 END AS allowed,
               p.tokens - CASE WHEN e.action = 'x' AND p.tokens > 0 THEN 1 ELSE 0 END AS t1,
               p.last AS last0
        FROM tb p JOIN ev e ON e.key = p.key AND e.i = p.i + 1) r)
SELECT key, seq, CAST(allowed AS INTEGER) AS allowed, CAST(tokens AS INTEGER) AS tokens FROM tb""",
       "actions")

# ---- X ------------------------------------------------------------------------
oracle("x_status_bars", "SELECT id, line FROM status", "status")
oracle("x_ranked_lines", """
SELECT team, id, CAST(row_number() OVER (PARTITION BY team ORDER BY id) - 1 AS INTEGER) AS y, line
FROM status""", "status")
oracle("x_framed_union", "SELECT id, CAST(y AS INTEGER) AS y, line FROM mmf", "mmf")
oracle("x_panel_zip", f"""
SELECT i.id, CAST(i.y AS INTEGER) AS y,
  coalesce(a.line, repeat(' ', {VP.view_w + 2})) || '   ' ||
  coalesce(b.line, repeat(' ', (SELECT w FROM mmw) + 2)) || '   ' ||
  CASE WHEN i.y = 0 THEN coalesce(s.line, '') ELSE '' END AS full_row
FROM (SELECT DISTINCT id, y FROM (SELECT id, y FROM gvf UNION ALL SELECT id, y FROM mmf) u) i
LEFT JOIN gvf a ON a.id = i.id AND a.y = i.y
LEFT JOIN mmf b ON b.id = i.id AND b.y = i.y
LEFT JOIN status s ON s.id = i.id""", "gvf", "mmf", "mmw", "status")

# ---- S ------------------------------------------------------------------------
oracle("s_latest_action", """
SELECT key, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       arg_max(action, (ts, seq)) AS action, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq
FROM actions GROUP BY key, date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM actions) - INTERVAL 1 HOUR""",
       "actions")
ORACLE["s_upsert"] = ORACLE["m_latest_action"]
ORACLE["s_token_bucket"] = ORACLE["m_token_bucket"]
oracle("s_held_action", """
WITH t AS (SELECT event_id AS tick_id, user_id AS key,
                  epoch_us(ts) + (event_id % 4) * 50000 AS tick_us FROM events),
a AS (SELECT key, epoch_us(ts) AS us, seq, action FROM actions)
SELECT t.tick_id, t.key, t.tick_us, CASE WHEN t.tick_us - a.us <= 100000 THEN a.action END AS action
FROM t ASOF LEFT JOIN a ON t.key = a.key AND t.tick_us >= a.us""", "actions")
oracle("s_held_join", """
WITH t AS (SELECT event_id AS tick_id, user_id AS key, epoch_us(ts) + (event_id % 4) * 50000 AS tick_us FROM events),
a AS (SELECT key, epoch_us(ts) AS us, seq, action FROM actions)
SELECT t.tick_id, t.key, t.tick_us, arg_max(a.action, (a.us, a.seq)) AS action
FROM t LEFT JOIN a ON a.key = t.key AND a.us BETWEEN t.tick_us - 100000 AND t.tick_us
WHERE t.tick_us < (SELECT max(us) FROM a) - 3601000000
GROUP BY t.tick_id, t.key, t.tick_us""", "actions")
# gaps and islands, and of these the islands that the watermark has passed
oracle("s_key_release", """
WITH p AS (SELECT key, action, epoch_us(ts) AS us FROM actions),
b AS (SELECT *, coalesce(us - lag(us) OVER w > 21600000000, true) AS first FROM p WINDOW w AS (PARTITION BY key, action ORDER BY us)),
i AS (SELECT *, sum(first::INT) OVER (PARTITION BY key, action ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT key, action, min(us) AS pressed, max(us) + 21600000000 AS released, count(*) AS presses
FROM i GROUP BY key, action, island
HAVING max(us) + 21600000000 < (SELECT max(us) // 1000 * 1000 FROM p) - 3600000000""", "actions")
oracle("s_enforce_keys", """
WITH c AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL OR l_quantity IS NULL OR l_shipdate IS NULL THEN 'not_null'
         WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders) THEN 'fk_orders'
         WHEN l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part) THEN 'fk_part'
         WHEN l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier) THEN 'fk_supplier' END AS rule
  FROM lineitem),
g AS (SELECT rule, l_orderkey, l_linenumber, count(*) AS n FROM c GROUP BY ALL)
SELECT rule, l_orderkey, l_linenumber, n FROM g WHERE rule IS NOT NULL
UNION ALL SELECT 'accepted', l_orderkey, l_linenumber, 1 FROM g WHERE rule IS NULL
UNION ALL SELECT 'pk', l_orderkey, l_linenumber, n - 1 FROM g WHERE rule IS NULL AND n > 1""")
