"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from plumbline.queries import STALE_MINUTES

C1 = """
c1 AS (SELECT l_orderkey AS tile, l_returnflag AS layer,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_quantity, l_shipdate, l_discount, l_tax, l_linestatus) - 1 AS feature_index,
  floor(l_extendedprice / 25)::BIGINT AS x, floor(l_quantity * 80)::BIGINT AS y, l_partkey AS pk, l_suppkey AS sk,
  l_discount > 0.02 AS has_disc, l_tax > 0 AS has_tax FROM lineitem),
tiles AS (SELECT o_orderkey AS tile, 'tiles/' || o_orderstatus || '/' || o_orderkey || '.pbf' AS source FROM orders),
layers AS (SELECT tile, layer, count(*) AS n FROM c1 GROUP BY tile, layer),
totals AS (SELECT tile, source, coalesce((SELECT sum(n) FROM layers WHERE layers.tile = tiles.tile), 0)::BIGINT AS total FROM tiles)
"""

_NULLS = "NULL::VARCHAR AS layer, NULL::INT AS feature_index, NULL::INT AS part_index"


def c2(scale: int) -> str:
    """Parts of the rings carrier as lists of points."""
    return f"""
c2p AS (SELECT vec_id AS tile, 'label' || label AS layer, f::INT AS feature_index, CASE WHEN f % 2 = 0 THEN 3 ELSE 2 END AS type,
  list_transform(range(0, 4), lambda i: {{'x': floor(embedding[8 * f + 2 * i + 1]::DOUBLE * {scale})::BIGINT,
    'y': floor(embedding[8 * f + 2 * i + 2]::DOUBLE * {scale})::BIGINT}}) AS p
  FROM embeddings, range(0, 8) AS r(f)),
c2 AS (SELECT tile, layer, feature_index, type, CASE WHEN feature_index % 4 = 0 THEN list_append(p, p[1]) ELSE p END AS pts FROM c2p),
v AS (SELECT tile, layer, feature_index, type, len(pts) AS n, unnest(range(0, len(pts))) AS i, unnest(pts) AS p FROM c2),
pt AS (SELECT tile, layer, feature_index, type, n, i, p.x AS x, p.y AS y FROM v)
"""


def segments(scale: int) -> str:
    """Pairs of segments of each part that are no neighbours, with their orientations."""
    cross = lambda a, b, p: f"sign(({b}y - {a}y) * ({p}x - {b}x) - ({b}x - {a}x) * ({p}y - {b}y))"
    box = lambda a, p, b: f"{p}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {p}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y)"
    return f"""{c2(scale)},
s AS (SELECT q.tile, q.feature_index, q.type, q.n, q.i, q.x AS pax, q.y AS pay, r.x AS pbx, r.y AS pby FROM pt q JOIN pt r
  ON q.tile = r.tile AND q.feature_index = r.feature_index AND r.i = q.i + 1),
sp AS (SELECT s.*, t.i AS j, t.pax AS pcx, t.pay AS pcy, t.pbx AS pdx, t.pby AS pdy FROM s JOIN s t
  ON s.tile = t.tile AND s.feature_index = t.feature_index AND t.i > s.i + 1),
o AS (SELECT *, {cross('pa', 'pb', 'pc')} AS o1, {cross('pa', 'pb', 'pd')} AS o2, {cross('pc', 'pd', 'pa')} AS o3, {cross('pc', 'pd', 'pb')} AS o4 FROM sp),
hit AS (SELECT *, (o1 <> o2 AND o3 <> o4) AS proper FROM o WHERE (o1 <> o2 AND o3 <> o4) OR (o1 = 0 AND {box('pa', 'pc', 'pb')})
  OR (o2 = 0 AND {box('pa', 'pd', 'pb')}) OR (o3 = 0 AND {box('pc', 'pa', 'pd')}) OR (o4 = 0 AND {box('pc', 'pb', 'pd')})),
ends AS (SELECT tile, feature_index, type, n, bool_or(first_x = last_x AND first_y = last_y) AS loop FROM (
  SELECT tile, feature_index, type, n, max(x) FILTER (i = 0) AS first_x, max(x) FILTER (i = n - 1) AS last_x,
    max(y) FILTER (i = 0) AS first_y, max(y) FILTER (i = n - 1) AS last_y FROM pt GROUP BY ALL) GROUP BY ALL),
dup AS (SELECT pt.tile, pt.feature_index, x, y FROM pt JOIN ends USING (tile, feature_index)
  WHERE NOT (loop AND pt.i = pt.n - 1) GROUP BY pt.tile, pt.feature_index, x, y HAVING count(*) > 1)
"""


_SHARED = "(x = pax AND y = pay AND ((pax = pcx AND pay = pcy) OR (pax = pdx AND pay = pdy))) OR (x = pbx AND y = pby AND ((pbx = pcx AND pby = pcy) OR (pbx = pdx AND pby = pdy)))"
SELF_INTERSECTION = f"""WITH {segments(8)},
ok AS (SELECT h.* FROM hit h JOIN ends USING (tile, feature_index)
  WHERE h.n >= 4 AND NOT ((h.type = 3 OR loop) AND h.i = 0 AND h.j = h.n - 2)
    AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.tile = h.tile AND dup.feature_index = h.feature_index AND ({_SHARED})))
SELECT tile, feature_index, min(struct_pack(i := i, j := j)).i AS first, min(struct_pack(i := i, j := j)).j AS second FROM ok GROUP BY tile, feature_index"""

FLAGGED = f"""WITH {segments(8)},
ok AS (SELECT h.*, loop FROM hit h JOIN ends USING (tile, feature_index) WHERE h.n >= 4 AND NOT (h.type = 3 AND h.i = 0 AND h.j = h.n - 2)),
one AS (SELECT *, row_number() OVER (PARTITION BY tile, feature_index ORDER BY i, j) AS rn FROM ok),
u AS (SELECT tile, feature_index, count(*) - count(DISTINCT (x, y)) AS duplicate_count FROM pt GROUP BY tile, feature_index),
f AS (SELECT tile, feature_index, type, loop, i AS first, j AS second, NOT proper AS is_collinear,
    (pbx = pcx AND pby = pcy) OR (pbx = pdx AND pby = pdy) OR (pax = pcx AND pay = pcy) OR (pax = pdx AND pay = pdy) AS shared_vertex, duplicate_count
  FROM one JOIN u USING (tile, feature_index) WHERE rn = 1),
g AS (SELECT *, CASE WHEN is_collinear THEN 'Cat C (Collinear overlap)' WHEN type = 2 AND loop AND shared_vertex THEN 'Cat B2 (Closed LineString)'
    WHEN duplicate_count > CASE WHEN type = 3 OR loop THEN 1 ELSE 0 END THEN 'Cat A (Quantization spike)' ELSE 'Cat B1 (Genuine crossing)' END AS cause FROM f)
"""

_RANGE = "'Point (' || x || ', ' || y || ') is outside '"
_STRICT = f"SELECT tile, layer, feature_index, 0 AS part_index, {_RANGE} || '0 to 4096.' AS message, x, y FROM c1 WHERE x < 0 OR x > 4096 OR y < 0 OR y > 4096"
REQUIRED = "(VALUES (0, 'A', 0, 'disc'), (1, 'N', 0, 'disc'), (1, 'N', 1, 'tax'), (2, 'R', 0, 'partkey'), (2, 'R', 1, 'tax')) AS w(ord, layer, sub, prop)"
_MISSING = f"""SELECT tile, c1.layer AS layer, feature_index, ord, sub, 'Feature "' || feature_index || '" in layer "' || c1.layer || '" lacks the property "' || prop || '".' AS message
  FROM c1 JOIN {REQUIRED} ON c1.layer = w.layer WHERE (prop = 'disc' AND NOT has_disc) OR (prop = 'tax' AND NOT has_tax)"""
#: Diagnostics of the three rules of the engine queries; k numbers them in emission order within a tile and rule.
ENGINE = f"""{C1},
d0 AS (
  SELECT tile, 'tile/required-properties' AS rule, 0 AS rule_idx, 'error' AS severity, layer, feature_index::INT AS feature_index, NULL::INT AS part_index, message, ord AS e1, feature_index AS e2, sub AS e3 FROM ({_MISSING})
  UNION ALL SELECT tile, 'tile/coordinate-range', 1, 'error', layer, feature_index::INT, part_index, message, CASE layer WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, feature_index, 0 FROM ({_STRICT})
  UNION ALL SELECT tile, 'tile/no-empty', 2, 'warning', NULL, NULL, NULL, 'Tile has no features.', 0, 0, 0 FROM totals WHERE total = 0),
d1 AS (SELECT d0.*, source, row_number() OVER (PARTITION BY tile, rule_idx ORDER BY e1, e2, e3) AS k FROM d0 JOIN tiles USING (tile)),
capped AS (SELECT *, row_number() OVER (ORDER BY tile, rule_idx, e1, e2, e3) AS rn FROM d1 WHERE k <= 2)
"""

#: Only points out of range, and tiles without features, which do not load.
EARLY = f"""{C1},
d0 AS (
  SELECT tile, 'tile/coordinate-range' AS rule, 0 AS rule_idx, 'error' AS severity, layer, feature_index::INT AS feature_index, CASE layer WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS e1, feature_index AS e2 FROM ({_STRICT})
  UNION ALL SELECT tile, 'artifact/load-failed', -1, 'error', NULL, NULL, 0, 0 FROM totals WHERE total = 0),
d1 AS (SELECT *, row_number() OVER (PARTITION BY tile, rule_idx ORDER BY e1, e2) AS k FROM d0),
capped AS (SELECT *, row_number() OVER (ORDER BY tile, rule_idx, e1, e2) AS rn FROM d1 WHERE k <= 2)
"""

C3 = """
c3 AS (SELECT user_id AS style, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, (props->>'$.k')::INT AS k, event_type, value FROM events),
sl AS (SELECT style, idx, CASE WHEN value < 20 THEN '' ELSE event_type || '-' || k END AS id, 'src' || (k % 12) AS source_name, k % 12 AS src, k % 23 AS minzoom,
  floor(value / 20)::INT AS maxzoom, k % 17 = 0 AS has_ref FROM c3),
st AS (SELECT DISTINCT style FROM c3)
"""
_PARSED = "style % 10 <> 3"


def _offsets(extent: int = 512) -> str:
    axis = lambda k: (
        f"CASE WHEN {k} < 0 THEN {k} WHEN {k} > {extent} THEN {k} - {extent} ELSE 0 END AS {k}_offset, "
        f"CASE WHEN {k} < 0 THEN 'below-zero' WHEN {k} > {extent} THEN 'above-extent' ELSE 'in-range' END AS {k}_direction"
    )
    bucket = lambda k: (
        f"CASE WHEN {k} = 0 THEN '0 (in-range)' ELSE (SELECT CASE WHEN a <= 64 THEN s || '1 to ' || s || '64' WHEN a <= 128 THEN s || '65 to ' || s || '128' WHEN a <= 256 THEN s || '129 to ' || s || '256' "
        f"WHEN a <= 512 THEN s || '257 to ' || s || '512' WHEN a <= 1024 THEN s || '513 to ' || s || '1024' WHEN a <= 4096 THEN s || '1025 to ' || s || '4096' ELSE s || '>4096' END "
        f"FROM (SELECT abs({k}) AS a, CASE WHEN {k} < 0 THEN '-' ELSE '+' END AS s)) END"
    )
    return f"""{c2(4096)},
en0 AS (SELECT tile, layer, feature_index, i AS point_index, CASE type WHEN 3 THEN 'Polygon' ELSE 'LineString' END AS geometry_type, x, y, {axis('x')}, {axis('y')} FROM pt
  WHERE x < 0 OR x > {extent} OR y < 0 OR y > {extent}),
en AS (SELECT *, {bucket('x_offset')} AS x_bucket, {bucket('y_offset')} AS y_bucket FROM en0),
ax AS (SELECT layer, geometry_type, 'x' AS axis, x_offset AS off, x_direction AS direction, x_bucket AS bucket FROM en WHERE x_direction <> 'in-range'
  UNION ALL SELECT layer, geometry_type, 'y', y_offset, y_direction, y_bucket FROM en WHERE y_direction <> 'in-range')
"""


_RANK = "(CASE WHEN abs(off) <= 64 THEN 1 WHEN abs(off) <= 128 THEN 2 WHEN abs(off) <= 256 THEN 3 WHEN abs(off) <= 512 THEN 4 WHEN abs(off) <= 1024 THEN 5 WHEN abs(off) <= 4096 THEN 6 ELSE 7 END * sign(off))::INT"
_ORD = "CASE layer WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


_CROSSCHECK = f"""WITH {C1} SELECT tile, layer, NULL::INT AS feature_index, 'layer-names' AS dimension FROM layers WHERE layer = 'R' AND tile % 7 = 0
  UNION ALL SELECT tile, layer, feature_index, 'coordinates' FROM c1 WHERE pk % 13 = 0 AND NOT (layer = 'R' AND tile % 7 = 0)
  UNION ALL SELECT tile, layer, feature_index, 'properties' FROM c1 WHERE pk % 17 = 0 AND NOT (layer = 'R' AND tile % 7 = 0)"""


_CHANGES = f"""WITH o AS (SELECT user_id::VARCHAR AS source, epoch_us(ts) // 1000 AS ms, event_id AS ord, event_type AS digest, coalesce(value >= 20, true) AS pass FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  w AS (SELECT *, lag(ms) OVER x AS before, lag(digest) OVER x AS old, lead(ms) OVER x AS after FROM o WINDOW x AS (PARTITION BY source ORDER BY ms, ord)),
  c AS (SELECT source, ms AS at_ms, CASE WHEN before IS NULL THEN 'new' WHEN digest IS DISTINCT FROM old THEN 'changed' WHEN ms - before > {STALE_MINUTES * 60_000} THEN 'back' END AS event, digest, pass FROM w)
  SELECT * FROM c WHERE event IS NOT NULL UNION ALL SELECT source, ms + {STALE_MINUTES * 60_000}, 'stale', digest, pass FROM w
  WHERE CASE WHEN after IS NULL THEN ms + {STALE_MINUTES * 60_000} < (SELECT max(ms) FROM o) - 60000 ELSE after - ms > {STALE_MINUTES * 60_000} END"""


def _shoelace(term: str, more: str = "") -> str:
    return f"""WITH {c2(16)},
e AS (SELECT q.tile, q.feature_index, q.x AS px, q.y AS py, r.x AS qx, r.y AS qy FROM pt q JOIN pt r
  ON q.tile = r.tile AND q.feature_index = r.feature_index AND (r.i = q.i + 1{more}))
SELECT tile, feature_index, sum({term})::DOUBLE / 2 AS area FROM e GROUP BY tile, feature_index"""


def _style(where: str, path: str, message: str, source: str = "sl") -> str:
    return f"WITH {C3} SELECT style, {path} AS path, {message} AS message FROM {source} WHERE {where}"


#: Columns that DuckDB computes wider or narrower than Spark.
CASTS = {
    "tile_coordinate_range": {"feature_index": "INT"}, "tile_coordinate_range_strict": {"feature_index": "INT"}, "tile_required_properties": {"feature_index": "INT"},
    "tile_self_intersection": {"first": "INT", "second": "INT"}, "tile_self_intersection_join": {"first": "INT", "second": "INT"}, "tile_self_intersection_sweep": {"first": "INT", "second": "INT"}, "segments_intersect_pairs": {"i": "INT", "j": "INT"},
    "viewport_project": {"feature_index": "INT"}, "geometry_walk": {"n_points": "INT"}, "overlay_resolve": {"feature_index": "INT"}, "engine_union_sorted": {"place": "INT"},
    "engine_overrides": {"feature_index": "INT"}, "engine_summary": {"infos": "BIGINT"}, "engine_summary_truncated": {"infos": "BIGINT"}, "engine_early_stop_summary": {"infos": "BIGINT"}, "tile_pyramid": {"x": "INT", "y": "INT"},
    "mvt_roundtrip_features": {"feature_index": "INT"}, "mvt_roundtrip_layers": {"layer_ord": "INT", "extent": "BIGINT", "n_features": "INT"},
    "mvt_light_layers": {"layer_ord": "INT", "extent": "BIGINT", "n_features": "INT"}, "decoder_crosscheck": {"feature_index": "INT"}, "decoder_digest_tree": {"feature_index": "INT"}, "offset_entries": {"point_index": "INT"},
    "cross_provider_identity": {"feature_index": "INT"}, "ring_root_cause": {"first": "INT", "second": "INT", "duplicate_count": "INT"}, "layer_report": {"n_features": "INT"}, "identity_properties": {"feature_index": "INT"},
}


def oracle_sql() -> dict[str, str]:
    """SQL by query name, with Spark's integer widths."""
    wrap = lambda sql, casts: f"SELECT * REPLACE ({', '.join(f'{c}::{t} AS {c}' for c, t in casts.items())}) FROM ({sql})"
    return {name: wrap(sql, CASTS[name]) if name in CASTS else sql for name, sql in _oracles().items()}


def _oracles() -> dict[str, str]:
    summary = "count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, 0 AS infos"
    ring = f"WITH {c2(8)} SELECT tile, layer, feature_index, 0 AS part_index"
    return {
        "tile_coordinate_range": f"WITH {C1} SELECT tile, layer, feature_index, 0 AS part_index, {_RANGE} || '-80 to 4176.' AS message FROM c1 WHERE x < -80 OR x > 4176 OR y < -80 OR y > 4176",
        "tile_coordinate_range_strict": f"WITH {C1} SELECT * EXCLUDE (x, y) FROM ({_STRICT})",
        "tile_required_layers": f"""WITH {C1} SELECT tile, w.layer AS layer, NULL::INT AS feature_index, NULL::INT AS part_index, 'Required layer "' || w.layer || '" is missing.' AS message
          FROM tiles, (VALUES ('A'), ('R')) AS w(layer) WHERE NOT EXISTS (SELECT 1 FROM layers l WHERE l.tile = tiles.tile AND l.layer = w.layer)""",
        "tile_feature_count": f"""WITH {C1} SELECT tile, {_NULLS}, 'Tile has ' || total || ' features, below the bound of 3.' AS message FROM totals WHERE total < 3
          UNION ALL SELECT tile, {_NULLS}, 'Tile has ' || total || ' features, above the bound of 8.' FROM totals WHERE total > 8""",
        "tile_layer_feature_count": f"""WITH {C1}, b(layer, low, high) AS (VALUES ('A', NULL, 3), ('N', 2, 5), ('missing', 1, NULL)), j AS (SELECT * FROM layers JOIN b USING (layer))
          SELECT tile, layer, NULL::INT AS feature_index, NULL::INT AS part_index, 'Layer "' || layer || '" has ' || n || ' features, below the bound of ' || low || '.' AS message FROM j WHERE n < low
          UNION ALL SELECT tile, layer, NULL, NULL, 'Layer "' || layer || '" has ' || n || ' features, above the bound of ' || high || '.' FROM j WHERE n > high""",
        "tile_required_properties": f"WITH {C1} SELECT tile, layer, feature_index, NULL::INT AS part_index, message FROM ({_MISSING})",
        "tile_no_empty": f"WITH {C1} SELECT tile, {_NULLS}, 'Tile has no features.' AS message FROM totals WHERE total = 0",
        "tile_degenerate": f"""WITH {c2(2)}, u AS (SELECT tile, layer, feature_index, type, n, count(DISTINCT (x, y)) AS d FROM pt GROUP BY ALL)
          SELECT tile, layer, feature_index, 0 AS part_index, 'Geometry is degenerate: ' || CASE type WHEN 2 THEN 'DEGENERATE_LINE' ELSE 'DEGENERATE_RING' END || '.' AS message
          FROM u WHERE (type = 2 AND d < 2) OR (type = 3 AND (n < 4 OR d < 3))""",
        "tile_unclosed_ring": f"{ring}, 'Ring is not closed.' AS message FROM c2 WHERE type = 3 AND pts[1] <> pts[-1]",
        "tile_zero_area_ring": f"""WITH {c2(8)}, e AS (SELECT q.tile, q.layer, q.feature_index, q.x * r.y - r.x * q.y AS t FROM pt q JOIN pt r ON q.tile = r.tile AND q.feature_index = r.feature_index AND r.i = q.i + 1 WHERE q.type = 3)
          SELECT tile, layer, feature_index, 0 AS part_index, 'Ring has no area.' AS message FROM e GROUP BY tile, layer, feature_index HAVING sum(t) = 0""",
        "tile_self_intersection": SELF_INTERSECTION,
        "tile_self_intersection_join": SELF_INTERSECTION,
        "tile_self_intersection_sweep": SELF_INTERSECTION,
        "tile_duplicate_vertices": f"""WITH {segments(8)} SELECT tile, feature_index, x, y FROM dup""",
        "segments_intersect_pairs": f"WITH {segments(8)} SELECT tile, feature_index, i, j FROM hit",
        "ring_signed_area": _shoelace("px * qy - qx * py"),
        "ring_signed_area_wrapped": _shoelace("(qx - px) * (qy + py)", " OR (q.i = q.n - 1 AND r.i = 0)"),
        "feature_bbox": f"""WITH {c2(4096)} SELECT tile, feature_index, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, max(x) - min(x) AS width, max(y) - min(y) AS height,
          (min(x) + max(x)) / 2.0::DOUBLE AS center_x, (min(y) + max(y)) / 2.0::DOUBLE AS center_y FROM pt GROUP BY tile, feature_index""",
        "bbox_intersect_pairs": f"""WITH {c2(4096)}, b AS (SELECT tile, feature_index AS f, min(x) - 8 AS x0, min(y) - 8 AS y0, max(x) + 8 AS x1, max(y) + 8 AS y1 FROM pt GROUP BY ALL)
          SELECT b.tile AS tile, b.f AS f, c.f AS f2 FROM b JOIN b c ON b.tile = c.tile AND b.f < c.f AND b.x0 <= c.x1 AND b.x1 >= c.x0 AND b.y0 <= c.y1 AND b.y1 >= c.y0""",
        "bbox_pairs_across_tiles": f"""WITH {c2(4096)}, b AS (SELECT tile * 8 + feature_index AS id, min(x) - 8 + tile % 40 * 2048 AS x0, min(y) - 8 + tile // 40 * 2048 AS y0,
            max(x) + 8 + tile % 40 * 2048 AS x1, max(y) + 8 + tile // 40 * 2048 AS y1 FROM pt GROUP BY tile, feature_index)
          SELECT b.id AS a, c.id AS b FROM b JOIN b c ON b.id < c.id AND b.x0 <= c.x1 AND b.x1 >= c.x0 AND b.y0 <= c.y1 AND b.y1 >= c.y0""",
        "viewport_project": f"WITH {C1} SELECT tile, layer, feature_index, x, y, x * 0.25::DOUBLE AS screen_x, y * 0.25::DOUBLE + 64 AS screen_y FROM c1",
        "geometry_walk": f"WITH {c2(8)} SELECT tile, feature_index, CASE type WHEN 3 THEN 'polygon' ELSE 'line' END AS call, 1 AS n_parts, len(pts) AS n_points FROM c2",
        "screen_shapes": f"""WITH {c2(8)} SELECT tile, CASE type WHEN 3 THEN 'polygon' ELSE 'line' END AS kind, count(*) AS n FROM c2 GROUP BY ALL
          UNION ALL SELECT tile, 'vertex', count(*) FROM pt GROUP BY tile""",
        "overlay_resolve": f"WITH {C1} SELECT tile, layer, feature_index, x * 0.25::DOUBLE AS screen_x, y * 0.25::DOUBLE + 64 AS screen_y FROM ({_STRICT})",
        "style_version": _style("style % 7 = 0", "'$.version'", "'Style version must be the number 8, not 7.'", "st"),
        "style_layer_id_required": _style("id = ''", "'$.layers[' || idx || '].id'", "'Layer ' || idx || ' has no id.'"),
        "style_unique_layer_id": f"""WITH {C3}, m AS (SELECT *, min(idx) OVER (PARTITION BY style, id) AS f FROM sl WHERE id <> '')
          SELECT style, '$.layers[' || idx || '].id' AS path, 'Layer id "' || id || '" of layer ' || idx || ' was used by layer ' || f || '.' AS message FROM m WHERE idx > f""",
        "style_known_source": _style("src >= 10", "'$.layers[' || idx || '].source'", "'Layer ' || idx || ' uses the unknown source \"' || source_name || '\".'"),
        "style_zoom_range": _style("minzoom > maxzoom", "'$.layers[' || idx || ']'", "'Layer ' || idx || ' has minzoom ' || minzoom || '.0 above maxzoom ' || maxzoom || '.0.'"),
        "style_no_deprecated_ref": _style("has_ref", "'$.layers[' || idx || '].ref'", "'Layer ' || idx || ' uses ref.'"),
        "style_valid_json": f"WITH {C3} SELECT style, '$' AS path FROM st WHERE style % 10 = 3",
        "style_sources_present": _style(f"style % 9 = 4 AND {_PARSED}", "'$.sources'", "'Style sources must be an object, not undefined.'", "st"),
        "style_layers_present": _style(f"style % 8 = 5 AND {_PARSED}", "'$.layers'", "'Style layers must be an array, not [object Object].'", "st"),
        "style_version_parsed": _style(f"(style % 7 = 0 OR style % 11 = 0) AND {_PARSED}", "'$.version'", "'Style version must be the number 8, not ' || CASE WHEN style % 7 = 0 THEN 7 ELSE 8 END || '.'", "st"),
        "style_known_source_parsed": _style(f"src >= 10 AND {_PARSED} AND style % 9 <> 4 AND style % 8 <> 5", "'$.layers[' || idx || '].source'", "'Layer ' || idx || ' uses the unknown source \"' || source_name || '\".'"),
        "engine_union_sorted": f"""WITH {ENGINE} SELECT source, row_number() OVER (PARTITION BY source ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, rule, coalesce(layer, ''), coalesce(feature_index, 0), coalesce(part_index, 0), tile, rule_idx, e1, e2, e3) AS place,
          rule AS "ruleId", severity, layer, feature_index FROM d1""",
        "engine_cap_per_rule": f'WITH {ENGINE} SELECT tile, layer, feature_index, part_index, rule AS "ruleId", severity, message FROM d1 WHERE k <= 2',
        "engine_cap_global": f"""WITH {ENGINE} SELECT tile, CASE WHEN rn = 100 THEN 'engine/max-diagnostics' ELSE rule END AS "ruleId", CASE WHEN rn = 100 THEN 'warning' ELSE severity END AS severity,
          CASE WHEN rn < 100 THEN layer END AS layer, CASE WHEN rn < 100 THEN feature_index END AS feature_index FROM capped WHERE rn <= 100""",
        "engine_overrides": f"""WITH {C1}, w AS (SELECT c1.*, source, source LIKE 'tiles/F/%' AS f FROM c1 JOIN tiles USING (tile) WHERE NOT regexp_matches(source, '^tiles/(?:.*/)?1[^/]*[.]pbf$'))
          SELECT tile, layer, feature_index, 0 AS part_index, 'tile/coordinate-range' AS "ruleId", CASE WHEN f THEN 'warning' ELSE 'error' END AS severity,
            {_RANGE} || CASE WHEN f THEN '0 to 4096.' ELSE '-80 to 4176.' END AS message FROM w WHERE (f AND (x > 4096 OR y > 4096)) OR (NOT f AND (x > 4176 OR y > 4176))""",
        "engine_summary": f"""WITH {ENGINE} SELECT {summary}, false AS truncated, (SELECT count(*) FROM tiles) AS "sourceCount", (SELECT count(*) FROM tiles) AS "artifactCount",
          (SELECT 3 * count(*) FROM tiles) AS "ruleExecutions", count(*) FILTER (severity = 'error') = 0 AS pass FROM d1""",
        "engine_summary_truncated": f"""WITH {ENGINE}, kept AS (SELECT * REPLACE (CASE WHEN rn = 100 THEN 'warning' ELSE severity END AS severity) FROM capped WHERE rn <= 100)
          SELECT {summary}, bool_or(rn = 100) AS truncated, (SELECT count(*) FROM tiles) AS "sourceCount", (SELECT count(*) FROM tiles t WHERE t.tile <= coalesce((SELECT tile FROM kept WHERE rn = 100), t.tile)) AS "artifactCount",
          (SELECT count(*) FROM tiles t, range(0, 3) AS r(i), kept k WHERE k.rn = 100 AND (t.tile, r.i) <= (k.tile, k.rule_idx)) AS "ruleExecutions", count(*) FILTER (severity = 'error') = 0 AS pass FROM kept""",
        "engine_early_stop": f"""WITH {EARLY} SELECT tile, CASE WHEN rn = 100 THEN 'engine/max-diagnostics' ELSE rule END AS "ruleId", CASE WHEN rn = 100 THEN 'warning' ELSE severity END AS severity,
          CASE WHEN rn < 100 THEN layer END AS layer, CASE WHEN rn < 100 THEN feature_index END AS feature_index FROM capped WHERE rn <= 100""",
        "engine_early_stop_summary": f"""WITH {EARLY}, kept AS (SELECT * REPLACE (CASE WHEN rn = 100 THEN 'warning' ELSE severity END AS severity) FROM capped WHERE rn <= 100),
          done AS (SELECT count(*) AS n FROM totals WHERE total > 0 AND tile <= coalesce((SELECT tile FROM kept WHERE rn = 100), tile))
          SELECT {summary}, coalesce(bool_or(rn = 100), false) AS truncated, (SELECT count(*) FROM tiles) AS "sourceCount", (SELECT n FROM done) AS "artifactCount",
          (SELECT n FROM done) AS "ruleExecutions", count(*) FILTER (severity = 'error') = 0 AS pass FROM kept""",
        "source_routing": """WITH s AS (SELECT page_id, CASE WHEN page_id % 11 = 3 THEN ' {"page":' || page_id || '}' ELSE url || (['', '.pbf', '.MVT ', '.json', '.mbtiles', '.style', '.vector.pbf'])[page_id % 7 + 1] END AS source FROM pages),
          r AS (SELECT *, CASE WHEN regexp_matches(lower(trim(source)), '[.](pbf|mvt|mbtiles)$') THEN 'tile' WHEN regexp_matches(source, '^\\s*[\\[{]') OR regexp_matches(lower(trim(source)), '[.](json|style)$') THEN 'style' END AS provider FROM s)
          SELECT page_id, source, provider, CASE provider WHEN 'tile' THEN 'VectorTile' WHEN 'style' THEN 'StyleSpecification' ELSE 'unknown' END AS artifact_type FROM r""",
        "tile_pyramid": """SELECT z::INT AS z, x::INT AS x, y::INT AS y FROM range(0, 4) AS a(z), range(0, 8) AS b(x), range(0, 8) AS c(y) WHERE x < (1 << z) AND y < (1 << z)
          UNION ALL SELECT 4, i // 16, i % 16 FROM range(0, 15) AS r(i)""",
        "mvt_roundtrip_features": f"WITH {C1} SELECT tile, layer, feature_index, 1 AS type, x, y, pk AS partkey FROM c1",
        "mvt_roundtrip_layers": f"WITH {C1} SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY layer) - 1 AS layer_ord, layer, 2 AS version, 4096 AS extent, n AS n_features FROM layers",
        "mvt_light_layers": f"WITH {C1} SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY layer) - 1 AS layer_ord, layer, 2 AS version, 4096 AS extent, n AS n_features FROM layers",
        "mvt_corrupt_load_failed": f"""WITH {C1} SELECT tile, 'artifact/load-failed' AS "ruleId", 'error' AS severity FROM totals WHERE total = 0 OR tile % 5 = 0""",
        "decoder_crosscheck": _CROSSCHECK,
        "decoder_digest_tree": _CROSSCHECK,
        "decoder_digest_levels": f"""WITH f AS ({_CROSSCHECK})
          SELECT 'tile' AS level, count(DISTINCT tile) AS differing FROM f UNION ALL SELECT 'layer', count(DISTINCT (tile, layer)) FROM f
          UNION ALL SELECT 'feature', count(DISTINCT (tile, layer, feature_index)) FROM f WHERE feature_index IS NOT NULL""",
        "custom_rule_sql": f"""WITH {C1}, o AS (SELECT tile, x, row_number() OVER w AS k, lag(x) OVER w AS before FROM c1 WINDOW w AS (PARTITION BY tile ORDER BY {_ORD}, feature_index)),
          stop AS (SELECT tile, min(k) AS stop FROM o WHERE x % 997 = 5 GROUP BY tile),
          f AS (SELECT tile, k, 'x jumps by ' || abs(x - before) || '.' AS message, '{{"x": ' || x || '}}' AS data, false AS crashed FROM o LEFT JOIN stop USING (tile) WHERE abs(x - before) > 2000 AND k < coalesce(stop, 1000000)
            UNION ALL SELECT tile, k, 'Rule custom/jumps failed: x is ' || x, NULL, true FROM o JOIN stop USING (tile) WHERE k = stop
            UNION ALL SELECT tile, 1000000, count(*) || ' features.', NULL, false FROM o WHERE tile NOT IN (SELECT tile FROM stop) GROUP BY tile HAVING count(*) > 5)
          SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY k) - 1 AS seq, message, data, crashed FROM f""",
        "watch_changes": _CHANGES,
        "watch_replay": _CHANGES,
        "offset_entries": f"WITH {_offsets()} SELECT * FROM en",
        "offset_histogram": f"WITH {_offsets()} SELECT bucket, {_RANK} AS rank, count(*) AS n FROM ax GROUP BY ALL",
        "offset_breakdowns": f"""WITH {_offsets()} SELECT CASE WHEN grouping(direction) = 0 THEN 'direction' WHEN grouping(layer) = 0 THEN 'layer' ELSE 'geometry_type' END AS grouping,
          coalesce(direction, layer, geometry_type) AS value, count(*) AS n FROM ax GROUP BY GROUPING SETS ((direction), (layer), (geometry_type))""",
        "offset_profile": f"""WITH {_offsets()} SELECT axis, direction, count(*) AS n, min(abs(off)) AS min, floor(quantile_cont(abs(off), 0.5) * 1000 + 0.5)::BIGINT AS median, floor(quantile_cont(abs(off), 0.95) * 1000 + 0.5)::BIGINT AS p95,
          floor(quantile_cont(abs(off), 0.99) * 1000 + 0.5)::BIGINT AS p99, max(abs(off)) AS max FROM ax GROUP BY ALL""",
        "offset_profile_sketched": f"""WITH {_offsets()}, f AS (SELECT tile, layer, feature_index, x_offset AS off, 'x' AS axis, x_direction AS direction FROM en UNION ALL SELECT tile, layer, feature_index, y_offset, 'y', y_direction FROM en)
          SELECT axis, direction, count(*) AS n, min(abs(off)) AS min, max(abs(off)) AS max, count(DISTINCT (tile, layer, feature_index)) AS features, true AS within FROM f WHERE direction <> 'in-range' GROUP BY axis, direction""",
        "axis_feature_differences": f"""WITH {_offsets()}, f AS (SELECT layer, tile, feature_index, bool_or(x_direction <> 'in-range') AS x, bool_or(y_direction <> 'in-range') AS y FROM en GROUP BY ALL)
          SELECT layer, count(*) FILTER (x AND NOT y) AS only_left, count(*) FILTER (y AND NOT x) AS only_right, count(*) FILTER (x AND y) AS both FROM f GROUP BY layer""",
        "direction_balance": f"WITH {_offsets()}, n AS (SELECT axis, direction, count(*) AS n FROM ax GROUP BY ALL) SELECT *, n::DOUBLE / (SELECT sum(n) FROM n)::DOUBLE AS share FROM n",
        "cross_provider_identity": f"""WITH {C1}, p AS (SELECT sk % 3 AS ds, tile, layer, feature_index % 2 AS feature_index, feature_index AS seq, CASE WHEN pk % 3 <> 0 THEN p_name END AS name, p_type AS class FROM c1 JOIN part ON pk = p_partkey),
          l AS (SELECT ds, tile, layer, feature_index, arg_max(struct_pack(name := name, class := class), seq) AS q FROM p GROUP BY ds, tile, layer, feature_index),
          a AS (SELECT tile, layer, feature_index, count(*) AS datasets, arg_min(struct_pack(n := q.name), ds).n AS first, count(q.name) AS named, count(DISTINCT q.name) AS names, count(DISTINCT coalesce(q.class, '')) AS classes FROM l GROUP BY ALL),
          m AS (SELECT *, CASE WHEN first IS NOT NULL THEN CASE WHEN named = datasets AND names = 1 THEN 'name-match' ELSE 'name-mismatch' END WHEN classes = 1 THEN 'class-match' ELSE 'class-mismatch' END AS method FROM a WHERE datasets >= 2)
          SELECT tile, layer, feature_index, datasets, method, method IN ('name-match', 'class-match') AS confirmed FROM m""",
        "ring_root_cause": f"{FLAGGED} SELECT tile, feature_index, first, second, is_collinear, shared_vertex, duplicate_count, cause, CASE WHEN cause LIKE 'Cat B1%' OR cause LIKE 'Cat C%' THEN 'true positive' ELSE 'false positive' END AS verdict FROM g",
        "ring_cause_counts": f"{FLAGGED} SELECT cause, count(*) AS n FROM g GROUP BY cause",
        "rule_histogram_pivot": f"""WITH {ENGINE} SELECT 'ds' || (tile % 3) AS dataset, count(*) FILTER (rule = 'tile/required-properties') AS tile_required_properties,
          count(*) FILTER (rule = 'tile/coordinate-range') AS tile_coordinate_range, count(*) FILTER (rule = 'tile/no-empty') AS tile_no_empty FROM d1 GROUP BY ALL""",
        "before_after_reduction": f"""WITH {C1}, a AS (SELECT 'ds' || (tile % 3) AS dataset, count(*) AS before, count(*) FILTER (x > 4176 OR y > 4176) AS after FROM ({_STRICT}) GROUP BY ALL)
          SELECT *, (before - after)::DOUBLE / before::DOUBLE AS reduction FROM a""",
        "distinct_counts": f"WITH {C1} SELECT count(DISTINCT tile) AS source_idx, count(DISTINCT tile % 3) AS dataset, count(DISTINCT layer) AS layer FROM ({_STRICT})",
        "range_residue": f"WITH {C1} SELECT layer, count(*) AS n FROM ({_STRICT}) GROUP BY layer",
        "tile_report_rollup": f"""WITH {ENGINE}, r AS (SELECT tile, (SELECT count(*) FROM layers l WHERE l.tile = t.tile) AS layers, total AS features FROM totals t),
          n AS (SELECT tile, {summary} FROM d1 GROUP BY tile)
          SELECT r.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS pass FROM r LEFT JOIN n USING (tile)""",
        "layer_report": f"""WITH {ENGINE}, n AS (SELECT tile, layer, {summary} FROM d1 WHERE layer IS NOT NULL GROUP BY tile, layer)
          SELECT tile, layer, n AS n_features, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid FROM layers LEFT JOIN n USING (tile, layer)""",
        "layer_issues": f"""WITH {ENGINE}, o AS (SELECT *, row_number() OVER (PARTITION BY tile, layer, rule ORDER BY e1, e2, e3) AS z FROM d1 WHERE layer IS NOT NULL)
          SELECT tile, layer, rule AS "ruleId", count(*) AS n, least(count(*), 2)::INT AS shown, max(message) FILTER (z = 1) AS first_message FROM o GROUP BY tile, layer, rule""",
        "batch_verdict": f"WITH {ENGINE}, e AS (SELECT tile, coalesce((SELECT count(*) FROM d1 WHERE d1.tile = tiles.tile AND severity = 'error'), 0) = 0 AS ok FROM tiles) SELECT count(*) AS total, count(*) FILTER (ok) AS passed, bool_and(ok) AS pass FROM e",
        "bench_stats": """WITH d AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'legacy' WHEN 'F' THEN 'engine' ELSE 'native' END AS run_mode, l_returnflag AS dataset, floor(l_quantity)::DOUBLE AS tiles, l_extendedprice::DOUBLE AS ms,
            l_quantity::DOUBLE * 1000 / l_extendedprice::DOUBLE AS thr, (l_discount * 1000)::DOUBLE AS heap, (l_tax * 2000)::DOUBLE AS rss FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'F', 'P')),
          s AS (SELECT run_mode, dataset, count(*) AS runs, avg(ms) AS mean_ms, median(ms) AS median_ms, stddev_pop(ms) AS sigma_ms, avg(thr) AS mean_throughput, sum(tiles) * 1000 / sum(ms) AS tiles_per_s,
            10000 * sum(ms) / sum(tiles) / 1000 AS seconds_per_10k, max(heap) AS peak_heap_mb, max(rss) AS peak_rss_mb FROM d GROUP BY run_mode, dataset)
          SELECT run_mode, dataset, runs, """
        + ", ".join(f"floor({c} * 1000 + 0.5)::BIGINT AS {c}" for c in ("mean_ms", "median_ms", "sigma_ms", "mean_throughput", "tiles_per_s", "seconds_per_10k", "peak_heap_mb", "peak_rss_mb"))
        + " FROM s",
        "point_functions": f"""WITH {c2(8)} SELECT tile, feature_index, (pts[1].x - pts[2].x) * (pts[1].x - pts[2].x) + (pts[1].y - pts[2].y) * (pts[1].y - pts[2].y) AS d2, (pts[1].x + pts[2].x) / 2.0::DOUBLE AS mid_x, (pts[1].y + pts[2].y) / 2.0::DOUBLE AS mid_y,
          pts[1].x + (pts[2].x - pts[1].x) * 0.25::DOUBLE AS lerp_x, pts[1].y + (pts[2].y - pts[1].y) * 0.25::DOUBLE AS lerp_y FROM c2""",
        "tile_addresses": "SELECT o_orderkey AS tile, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 15 END::INT AS z, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END::INT AS x, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END::INT AS y FROM orders",
        "no_provider": """WITH s AS (SELECT page_id, CASE WHEN page_id % 11 = 3 THEN ' {"page":' || page_id || '}' ELSE url || (['', '.pbf', '.MVT ', '.json', '.mbtiles', '.style', '.vector.pbf'])[page_id % 7 + 1] END AS source FROM pages)
          SELECT page_id, 'artifact/no-provider' AS "ruleId", 'error' AS severity, 'No provider for ' || source AS message FROM s
          WHERE NOT regexp_matches(lower(trim(source)), '[.](pbf|mvt|mbtiles|json|style)$') AND NOT regexp_matches(source, '^\\s*[\\[{]')""",
        "ring_counters": f"""{FLAGGED} SELECT cause, count(*) AS n, count(*) FILTER (is_collinear) AS collinear, count(*) FILTER (shared_vertex) AS shared, count(*) FILTER (duplicate_count > 0) AS duplicates FROM g GROUP BY cause""",
        "identity_properties": f"""WITH {C1} SELECT tile, layer, feature_index, CASE WHEN pk % 3 <> 0 AND p_name IS NOT NULL THEN 'class,name' ELSE 'class' END AS keys, CASE WHEN pk % 3 <> 0 THEN p_name END AS name FROM c1 JOIN part ON pk = p_partkey""",
    }
