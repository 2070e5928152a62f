"""DuckDB SQL for the registered queries, over the given tables."""

from __future__ import annotations

from wherescore.functions.lookups import (
    COUNTRY_ALIASES,
    COUNTRY_REGIONS,
    CUE_COLORS,
    CUE_HEADERS,
    CUE_LETTERS,
    CUE_TYPES,
    LABEL_REGIONS,
    PROMPT,
)
from wherescore.plans.fixtures import COUNTRIES, MODELS


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def _values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({columns}))"


def _title(x: str) -> str:
    parts = f"regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"coalesce(array_to_string(list_transform({parts}, lambda p: upper(p[1:1]) || lower(p[2:])), ''), '')"


COUNTRY_DIM = _values(
    "country_dim", "nationkey, country, region, variant", [(i, *c) for i, c in enumerate(COUNTRIES)]
)
ALIASES = _values("aliases", "alias, canonical", COUNTRY_ALIASES.items())
REGIONS = _values("regions", "country, region", COUNTRY_REGIONS.items())
LABELS = _values("regions", "country, region", LABEL_REGIONS.items())
MODEL_DIM = _values(
    "model_dim", "model_key, model_id, provider, generation, cost_per_item, min_interval_s", MODELS
)

ANNOTATIONS = f"""{COUNTRY_DIM}, annotations AS (
SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS id,
 'data/images/' || country || '/' || o_orderkey || '.jpg' AS filepath, country,
 CASE o_orderkey % 3 WHEN 0 THEN 'linguistic' WHEN 1 THEN 'environmental' ELSE 'infrastructure' END AS cue_type,
 o_orderpriority = '1-URGENT' AS multi_cue,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'I/E' ELSE '' END AS cue_notes, region
FROM orders JOIN customer ON o_custkey = c_custkey JOIN country_dim ON c_nationkey = nationkey)"""

REPEATED = f"""{ANNOTATIONS}, repeated AS (
SELECT * FROM annotations UNION ALL
SELECT ord + 1000000000, id, filepath, country, 'infrastructure', NOT multi_cue, 'L/I',
 CASE WHEN ord % 2 = 0 THEN 'East Asia' END FROM annotations WHERE ord % 7 = 0)"""

RESPONSES = f"""{ANNOTATIONS}, responses AS (
SELECT l_orderkey * 8 + l_linenumber AS ord, a.id, a.cue_type, a.country AS true_country,
 'model_' || (l_suppkey % 6) AS model, a.region AS true_region, a.multi_cue,
 CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN 'I cannot tell.'
  WHEN l_linenumber = 6 THEN 'country:' || chr(10) || chr(10) || '  ' || v || ' '
  WHEN l_linenumber = 5 THEN 'signs. COUNTRY: ' || v || chr(10) || 'COUNTRY: Peru'
  ELSE 'REASONING: signs and roads.' || chr(10) || 'COUNTRY: ' || v END AS raw_response
FROM (SELECT l.*, CASE WHEN (l_orderkey + l_partkey) % 10 < 6 THEN t.variant ELSE p.variant END AS v
 FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey
 JOIN country_dim t ON c_nationkey = t.nationkey JOIN country_dim p ON s_nationkey = p.nationkey) x
JOIN annotations a ON a.ord = x.l_orderkey)"""

RESULTS = f"""{RESPONSES}, {ALIASES}, {REGIONS}, answers AS (
SELECT *, trim(regexp_extract(raw_response, '(?i)COUNTRY:\\s*(.+)', 1)) AS said,
 trim(regexp_replace(trim(regexp_extract(raw_response, '(?i)COUNTRY:\\s*(.+)', 1)), '[.\\-,;]+$', '')) AS clean
FROM responses), predicted AS (
SELECT r.*, CASE WHEN said = '' THEN 'PARSE_ERROR' ELSE coalesce(canonical, {_title("clean")}) END AS predicted_country
FROM answers r LEFT JOIN aliases ON alias = lower(clean)), results AS (
SELECT p.ord, id, cue_type, true_country, predicted_country,
 predicted_country <> 'PARSE_ERROR' AND lower(predicted_country) = lower(true_country) AS correct,
 true_region,
 predicted_country <> 'PARSE_ERROR' AND true_region <> ''
  AND lower(coalesce(regions.region, '')) = lower(true_region) AS region_correct,
 model, raw_response, multi_cue
FROM predicted p LEFT JOIN regions ON regions.country = predicted_country)"""

COORDS = f"""{COUNTRY_DIM}, coords AS (
SELECT s_suppkey AS ord, CAST(52.497 AS DOUBLE) + CAST((s_suppkey * 7919) % 1000 AS DOUBLE) * CAST(0.000045 AS DOUBLE) AS lat,
 CAST(13.34 AS DOUBLE) + CAST((s_suppkey * 6101) % 1000 AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS lon, country, region
FROM supplier JOIN country_dim ON s_nationkey % 2 = nationkey)"""

FEATURES = """features AS (
SELECT c_custkey AS feature_pos, CAST(8799 + c_custkey % 5 AS INTEGER) AS tile_x,
 CAST(5371 + (c_custkey // 5) % 4 AS INTEGER) AS tile_y,
 CAST((c_custkey * 7919) % 4096 AS DOUBLE) AS px, CAST((c_custkey * 6101) % 4096 AS DOUBLE) AS py,
 CAST(c_custkey AS VARCHAR) AS id
FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 23 <> 0 AND c_custkey % 29 <> 0 AND c_custkey <> 0)"""

LOCATED = f"""{FEATURES}, located AS (
SELECT *, degrees(atan(sinh(pi() * (1 - 2 * (tile_y + py / 4096.0::DOUBLE) / 16384.0::DOUBLE)))) AS flat,
 (tile_x + px / 4096.0::DOUBLE) / 16384.0::DOUBLE * 360 - 180 AS flon FROM features)"""

TILES = f"""{COORDS}, tiles AS (
SELECT *, CAST(floor((lon + 180) / 360 * 16384) AS INTEGER) AS tx,
 CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS INTEGER) AS ty FROM coords)"""


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"12742000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a}))"


def _nearby(limit: int, same_tile: bool = True) -> str:
    on = "tx = tile_x AND ty = tile_y" if same_tile else "abs(tx - tile_x) <= 1 AND abs(ty - tile_y) <= 1"
    return f"""{TILES}, {LOCATED}, pairs AS (
SELECT ord, feature_pos, id, flat, flon, {_haversine("lat", "lon", "flat", "flon")} AS distance_m
FROM tiles JOIN located ON {on}), nearest AS (
SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY distance_m, feature_pos) AS INTEGER) AS rank,
 id, flat, flon, distance_m FROM pairs WHERE distance_m <= 500 QUALIFY rank <= {limit})"""


META = """meta AS (
SELECT CAST(c_custkey AS VARCHAR) AS id,
 CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN 'https://img.example/' || c_custkey END AS url
FROM customer)"""

LIST = f"""{COUNTRY_DIM}, {LABELS}, lines AS (
SELECT p_partkey AS pos, trim(CASE
 WHEN p_partkey % 40 = 0 THEN CASE WHEN country = 'United Kingdom' THEN 'UK' ELSE country END
 WHEN p_partkey % 40 = 2 THEN 'Linguistic' WHEN p_partkey % 40 = 12 THEN '  Environmental '
 WHEN p_partkey % 40 = 22 THEN 'Infrastructural' WHEN p_partkey % 40 = 32 THEN 'Multi-Cue' WHEN p_partkey % 40 = 11 THEN ''
 WHEN p_partkey % 40 = 35 THEN (100000 + p_partkey) || ' E/I' WHEN p_partkey % 40 = 36 THEN '' || (100000 + p_partkey)
 WHEN p_partkey % 40 > 32 THEN (100000 + p_partkey) || '  L / I' ELSE '' || (100000 + p_partkey) END) AS line
FROM part JOIN country_dim ON (p_partkey // 40) % {len(COUNTRIES)} = nationkey), kinds AS (
SELECT *, line IN ({", ".join(_literal(h) for h in CUE_HEADERS)}) AS is_cue,
 NOT regexp_matches(line, '[0-9]') AS no_digit FROM lines WHERE line <> ''), blocks AS (
SELECT *, count(*) FILTER (NOT is_cue AND no_digit) OVER (ORDER BY pos) AS section FROM kinds), filled AS (
SELECT *, last_value(CASE WHEN NOT is_cue AND no_digit THEN line END IGNORE NULLS) OVER (ORDER BY pos) AS header,
 last_value(CASE WHEN is_cue THEN line END IGNORE NULLS) OVER (PARTITION BY section ORDER BY pos) AS cue
FROM blocks), ids AS (
SELECT pos, split_part(line, ' ', 1) AS id, CASE WHEN header = 'UK' THEN 'United Kingdom' ELSE header END AS country, cue,
 trim(regexp_replace(substr(line, length(split_part(line, ' ', 1)) + 1), ' +', ' ', 'g')) AS notes
FROM filled WHERE NOT is_cue AND NOT no_digit AND header IS NOT NULL)"""

_SHARE = "CAST(sum(CAST({0} AS INTEGER)) AS DOUBLE) / nullif(count({0}), 0)"


def _share(flag: str = "correct", where: str | None = None) -> str:
    value = flag if where is None else f"CASE WHEN {where} THEN {flag} END"
    return "round(" + _SHARE.format(value) + ", 6)"


def _cues(flag: str = "correct") -> str:
    return ", ".join(f"{_share(flag, f'cue_type = {_literal(c)}')} AS {c}" for c in CUE_TYPES)


def _case(column: str, mapping, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


SINGLE = "FROM results WHERE NOT multi_cue"
COLUMNS = "id, cue_type, true_country, predicted_country, correct, true_region, region_correct, model, raw_response"
SUMMARY = f"""summary AS (SELECT model, {_SHARE.format("correct")} AS c, {_SHARE.format("region_correct")} AS r,
 {_SHARE.format("CASE WHEN NOT multi_cue THEN correct END")} AS s, {_SHARE.format("CASE WHEN multi_cue THEN correct END")} AS m,
 count(*) AS n FROM results GROUP BY model)"""
MODEL_CUE = f"""model_cue AS (SELECT model, cue_type, {_SHARE.format("correct")} AS accuracy {SINGLE} GROUP BY ALL)"""


def _sample(same_tile: bool = True, more: str = "") -> str:
    """Coordinates in order, each with the first three of its six nearest usable images that none before it took."""
    return f"""WITH RECURSIVE {_nearby(6, same_tile)}, {META}, claims AS (
SELECT n.ord, n.rank, n.id, c.country, c.region, m.url, n.distance_m FROM nearest n JOIN coords c ON n.ord = c.ord
JOIN meta m ON n.id = m.id WHERE m.url IS NOT NULL AND CAST(n.id AS BIGINT) % 13 <> 0{more}), queue AS (
SELECT ord, country, list(id ORDER BY rank) AS ids, row_number() OVER (ORDER BY ord) AS step
FROM claims GROUP BY ord, country), served AS (
SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS ord, CAST([] AS VARCHAR[]) AS picked, CAST([] AS VARCHAR[]) AS taken
UNION ALL
SELECT q.step, q.ord, list_filter(q.ids, lambda x: NOT list_contains(s.taken, q.country || '/' || x))[1:3],
 list_concat(s.taken, list_transform(list_filter(q.ids, lambda x: NOT list_contains(s.taken, q.country || '/' || x))[1:3],
  lambda x: q.country || '/' || x))
FROM served s JOIN queue q ON q.step = s.step + 1)
SELECT c.ord, rank, c.id, c.country, region, 'data/images/' || c.country || '/' || c.id || '.jpg' AS filepath, url,
 round(distance_m, 6) AS distance_m
FROM claims c JOIN served s ON c.ord = s.ord AND list_contains(s.picked, c.id)"""


def sql() -> dict[str, str]:
    """Query name -> SQL."""
    out = {
        "parse_country": f"WITH {RESULTS} SELECT ord, id, model, predicted_country FROM results",
        "normalize_country": f"""WITH {RESULTS} SELECT ord, id, model,
 CASE WHEN predicted_country <> 'PARSE_ERROR' THEN predicted_country END AS country FROM results""",
        "title_case": f"""SELECT p_partkey, {_title("upper(p_name) || '-' || lower(p_type) || '''s 3rd u.k.'")} AS title FROM part""",
        "get_region": f"""WITH {ANNOTATIONS}, {REGIONS}
SELECT id, a.country, coalesce(r.region, '') AS region FROM annotations a LEFT JOIN regions r ON a.country = r.country""",
        "country_match": f"WITH {RESULTS} SELECT ord, id, model, predicted_country, true_country, correct FROM results",
        "region_match": f"""WITH {RESULTS}
SELECT ord, id, model, predicted_country, true_region, region_correct FROM results""",
        "parse_bool": "SELECT o_orderkey AS id, o_orderkey % 7 IN (0, 1, 2) AS flag FROM orders",
        "primary_cue": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 >= 3 AND o_orderkey % 4 <> 3
 THEN {_case("CASE o_orderkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'E' ELSE 'I ' END", CUE_LETTERS, "''")}
 ELSE CASE o_orderkey % 5 WHEN 0 THEN 'linguistic' WHEN 1 THEN 'infrastructure' WHEN 2 THEN '' ELSE 'multi_cue' END
 END AS cue_type FROM orders""",
        "score_responses": f"WITH {RESULTS} SELECT ord, {COLUMNS} FROM results",
        "tag_multicue": f"""WITH {RESPONSES}, flagged AS (
SELECT DISTINCT id FROM annotations WHERE multi_cue OR ord % 7 = 0)
SELECT ord, id, model, id IN (SELECT id FROM flagged) AS multi_cue FROM responses""",
        "multicue_count": f"""WITH {RESPONSES}, flagged AS (
SELECT DISTINCT id FROM annotations WHERE multi_cue OR ord % 7 = 0)
SELECT count(*) FILTER (id IN (SELECT id FROM flagged)) AS n_multi, count(*) AS n_rows FROM responses""",
        "attach_region": f"""WITH {RESPONSES}, again AS (
SELECT id, coalesce(CASE WHEN ord % 7 = 0 THEN CASE WHEN ord % 2 = 0 THEN 'East Asia' ELSE '' END ELSE region END, '') AS region
FROM annotations)
SELECT ord, r.id, model, coalesce(again.region, '') AS true_region FROM responses r LEFT JOIN again ON r.id = again.id""",
        "fallback_region": f"""WITH {RESPONSES}, {REGIONS}
SELECT ord, id, model, true_country, coalesce(regions.region, '') AS true_region
FROM responses LEFT JOIN regions ON true_country = regions.country""",
        "single_cue_only": f"WITH {RESPONSES} SELECT ord, id, model, cue_type FROM responses WHERE NOT multi_cue",
        "overall_accuracy": f"WITH {RESULTS} SELECT {_share()} AS accuracy, count(*) AS n_images FROM results",
        "accuracy_by_model": f"""WITH {RESULTS}
SELECT model, {_share()} AS accuracy, count(correct) AS n_images FROM results GROUP BY model""",
        "accuracy_by_cue": f"""WITH {RESULTS}
SELECT cue_type, {_share()} AS accuracy, count(correct) AS n_images {SINGLE} GROUP BY cue_type""",
        "accuracy_model_cue": f"WITH {RESULTS} SELECT model, {_cues()}, {_share()} AS overall {SINGLE} GROUP BY model",
        "region_by_model": f"""WITH {RESULTS}
SELECT model, {_share("region_correct")} AS region_accuracy, count(region_correct) AS n_images FROM results GROUP BY model""",
        "region_model_cue": f"""WITH {RESULTS}
SELECT model, {_cues("region_correct")}, {_share("region_correct")} AS overall {SINGLE} GROUP BY model""",
        "accuracy_by_country": f"""WITH {RESULTS}
SELECT true_country, {_share()} AS accuracy, count(correct) AS n_images FROM results GROUP BY true_country""",
        "accuracy_model_country": f"""WITH {RESULTS}
SELECT model, true_country, {_share()} AS accuracy, count(correct) AS n_images FROM results GROUP BY ALL""",
        "model_country_pivot": f"""WITH {RESULTS} SELECT model, {", ".join(
            f"{_share('correct', f'true_country = {_literal(c)}')} AS {c.lower().replace(' ', '_')}" for c, _, _ in COUNTRIES
        )}, {_share()} AS overall FROM results GROUP BY model""",
        "model_country_wide": f"""WITH {RESULTS}, shares AS (
SELECT model, true_country, {_SHARE.format("correct")} AS accuracy FROM results GROUP BY ALL), grid AS (
SELECT m.model, c.true_country, s.accuracy FROM (SELECT DISTINCT model FROM shares) m
CROSS JOIN (SELECT DISTINCT true_country FROM shares) c
LEFT JOIN shares s ON s.model = m.model AND s.true_country = c.true_country)
SELECT model, string_agg(true_country || '=' || coalesce(printf('%.1f%%', accuracy * 100), 'N/A'), ', ' ORDER BY true_country) AS by_country,
 any_value(overall) AS overall FROM grid JOIN (SELECT model, {_share()} AS overall FROM results GROUP BY model) USING (model) GROUP BY model""",
        "accuracy_multicue": f"""WITH {RESULTS}
SELECT model, CASE WHEN multi_cue THEN 'multi-cue' ELSE 'single-cue' END AS subset, {_share()} AS accuracy,
 count(correct) AS n_images FROM results GROUP BY ALL""",
        "model_summary": f"""WITH {RESULTS}, {SUMMARY} SELECT model, round(c, 6) AS country_accuracy,
 round(r, 6) AS region_accuracy, round(s, 6) AS single_cue_accuracy, round(m, 6) AS multi_cue_accuracy, n AS n_images
FROM summary""",
        "model_cue_rollup": f"""WITH {RESULTS}
SELECT model, {_cues()}, {_share()} AS overall {SINGLE} GROUP BY model UNION ALL
SELECT 'All models', {_cues()}, {_share()} {SINGLE}""",
        "accuracy_gaps": f"""WITH {RESULTS}, {SUMMARY}
SELECT model, round((r - c) * 100, 6) AS region_gap_pp, round((m - s) * 100, 6) AS multi_gap_pp FROM summary""",
        "cue_spread": f"""WITH {RESULTS}, {MODEL_CUE} SELECT cue_type, round(max(accuracy), 6) AS best,
 round(min(accuracy), 6) AS worst, round((max(accuracy) - min(accuracy)) * 100, 6) AS spread_pp
FROM model_cue GROUP BY cue_type""",
        "provider_delta": f"""WITH {RESULTS}, {MODEL_DIM}, {SUMMARY}
SELECT a.provider, a.generation, a.model_id AS model, round(s.c, 6) AS accuracy, round(t.c, 6) AS previous_accuracy,
 round(s.c - t.c, 6) AS delta FROM model_dim a JOIN summary s ON s.model = a.model_id
LEFT JOIN model_dim b ON b.provider = a.provider AND b.generation = a.generation - 1
LEFT JOIN summary t ON t.model = b.model_id""",
        "model_rank": f"""WITH {RESULTS}, {SUMMARY} SELECT model, round(c, 6) AS accuracy, n AS n_images,
 CAST(dense_rank() OVER (ORDER BY c DESC) AS INTEGER) AS rank FROM summary""",
        "dataset_composition": f"""WITH {ANNOTATIONS}
SELECT region, string_agg(DISTINCT country, ', ' ORDER BY country) AS countries, count(*) AS n_images
FROM annotations GROUP BY region UNION ALL SELECT 'Total', '', count(*) FROM annotations""",
        "cue_composition": f"""WITH {ANNOTATIONS} SELECT cue_type, count(*) AS n_images,
 CAST(sum(CAST(multi_cue AS INTEGER)) AS BIGINT) AS n_multi FROM annotations GROUP BY cue_type""",
        "pending_work": f"WITH {REPEATED} SELECT ord, id FROM repeated WHERE CAST(id AS BIGINT) % 4 <> 0",
        "pending_pilot": f"""WITH {ANNOTATIONS}
SELECT ord, id FROM (SELECT * FROM annotations ORDER BY ord LIMIT 500) WHERE ord % 4 <> 0""",
        "run_summary": f"""WITH {RESULTS} SELECT CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct, count(*) AS processed,
 round(100.0::DOUBLE * sum(CAST(correct AS INTEGER)) / count(*), 6) AS percent_correct FROM results""",
        "cost_estimate": f"""WITH {ANNOTATIONS}, {MODEL_DIM}, total AS (SELECT count(*) AS n FROM annotations)
SELECT model_key, CAST(coalesce(cost_per_item, 0.02) AS DOUBLE) AS cost_per_item, (SELECT n FROM total) AS n_items,
 round(CAST(coalesce(cost_per_item, 0.02) AS DOUBLE) * (SELECT n FROM total), 6) AS estimated_cost FROM model_dim""",
        "running_accuracy": f"""WITH {RESULTS}, so_far AS (
SELECT DISTINCT model, ord, count(*) OVER w AS processed, CAST(sum(CAST(correct AS INTEGER)) OVER w AS BIGINT) AS correct
FROM results WINDOW w AS (PARTITION BY model ORDER BY ord))
SELECT *, CAST(correct AS DOUBLE) / processed AS running_accuracy FROM so_far""",
        "batch_responses": f"""WITH {ANNOTATIONS} SELECT id, country,
 CASE WHEN ord % 10 <> 3 THEN 'COUNTRY: ' || country END AS raw_response,
 CASE WHEN ord % 10 <> 3 THEN 'ok' ELSE 'failed' END AS status FROM annotations""",
        "geo_tile": f"WITH {TILES} SELECT ord, tx AS tile_x, ty AS tile_y FROM tiles",
        "tile_to_latlon": f"""WITH {LOCATED}
SELECT feature_pos, round(flat, 6) AS feature_lat, round(flon, 6) AS feature_lon FROM located""",
        "haversine": f"""WITH {COORDS} SELECT ord, round({_haversine("lat", "lon", "52.52::DOUBLE", "13.39::DOUBLE")}, 6) AS distance_m
FROM coords""",
        "point_features": f"WITH {FEATURES} SELECT feature_pos, tile_x, tile_y, id, px, py FROM features",
        "nearby_topk": f"""WITH {_nearby(5)}
SELECT ord, rank, id, round(flat, 6) AS lat, round(flon, 6) AS lon, round(distance_m, 6) AS distance_m FROM nearest""",
        "nearby_topk_neighbors": f"""WITH {_nearby(5, same_tile=False)}
SELECT ord, rank, id, round(flat, 6) AS lat, round(flon, 6) AS lon, round(distance_m, 6) AS distance_m FROM nearest""",
        "meta_lookup": f"""WITH {META} SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS id, url
FROM orders LEFT JOIN meta ON CAST(o_custkey AS VARCHAR) = id""",
        "sample_images": _sample(),
        "sample_images_neighbors": _sample(same_tile=False),
        "sample_images_failed": _sample(more=" AND CAST(n.id AS BIGINT) % 5 <> 2"),
        "appended_annotations": f"""WITH {ANNOTATIONS} SELECT id,
 CASE WHEN cue_type <> 'linguistic' THEN 'second' WHEN country <> 'Peru' THEN 'first' ELSE nullif(region, '') END AS region,
 CASE WHEN cue_type <> 'linguistic' THEN 2 WHEN country <> 'Peru' THEN 1 ELSE 0 END::BIGINT AS commit,
 1 + (country <> 'Peru')::BIGINT + (cue_type <> 'linguistic')::BIGINT AS n_rows FROM annotations""",
        "load_results": f"""WITH {RESULTS} SELECT id, cue_type, true_country, predicted_country, correct,
 nullif(true_region, '') AS true_region, CASE WHEN model IN ('model_0', 'model_1', 'model_2') THEN region_correct END AS region_correct,
 model, raw_response FROM results""",
        "load_annotations": f"""WITH {ANNOTATIONS} SELECT id, filepath, country, cue_type, multi_cue, nullif(cue_notes, '') AS cue_notes,
 nullif(region, '') AS region FROM annotations""",
        "coords_checked": f"WITH {COORDS} SELECT ord, round(lat, 6) AS lat, round(lon, 6) AS lon, country, region FROM coords",
        "id_list": "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 11 <> 0",
        "parse_image_list": f"""WITH {LIST} SELECT 'list' AS file, pos, id,
 'data/images/' || i.country || '/' || id || '.jpg' AS filepath, i.country,
 CASE WHEN cue = 'Multi-Cue' AND notes <> '' THEN {_case("split_part(notes, '/', 1)", CUE_LETTERS, "''")}
  ELSE {_case("cue", CUE_HEADERS, "''")} END AS cue_type,
 cue = 'Multi-Cue' AS multi_cue, CASE WHEN cue = 'Multi-Cue' THEN notes ELSE '' END AS cue_notes,
 coalesce(regions.region, '') AS region
FROM ids i LEFT JOIN regions ON i.country = regions.country WHERE cue IS NOT NULL""",
        "parse_image_list_ids": f"WITH {LIST} SELECT 'list' AS file, pos, id, country FROM ids",
        "new_annotations": """SELECT CAST(c_custkey AS VARCHAR) AS id, 'data/images/' || c_custkey || '.jpg' AS filepath,
 CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS cue_type, FALSE AS multi_cue, CAST(NULL AS VARCHAR) AS cue_notes,
 CAST(NULL AS VARCHAR) AS region FROM customer WHERE c_custkey % 11 <> 0""",
        "image_payload": f"""WITH names AS (
SELECT CAST(CASE WHEN page_id % 5 = 0 THEN -1 - page_id ELSE page_id END AS VARCHAR) AS id FROM pages)
SELECT id, 'data/images/' || id || '.jpg' AS filepath, to_base64(encode(html)) AS image_b64,
 'data:image/jpeg;base64,' || to_base64(encode(html)) AS data_url, {_literal(PROMPT)} AS prompt,
 CASE WHEN html IS NULL THEN 'IMAGE_NOT_FOUND' END AS raw_response
FROM names LEFT JOIN pages ON id = CAST(page_id AS VARCHAR)""",
        "results_sink": f"WITH {RESULTS} SELECT {COLUMNS} FROM results",
        "replace_results": f"""WITH {RESULTS}, again AS (SELECT r.*, coalesce(t.region, '') AS region_again
FROM results r LEFT JOIN regions t ON r.true_country = t.country)
SELECT id, cue_type, true_country, predicted_country, correct, region_again AS true_region, region_correct, model, raw_response
FROM again""",
        "formatted_table": f"""WITH {RESULTS}, {MODEL_CUE}, shares AS (
SELECT model, {", ".join(f"max(CASE WHEN cue_type = {_literal(c)} THEN accuracy END) AS {c}" for c in CUE_TYPES)}
FROM model_cue GROUP BY model), overall AS (SELECT model, {_SHARE.format("correct")} AS overall {SINGLE} GROUP BY model)
SELECT model, {", ".join(f"coalesce(printf('%.1f%%', {c} * 100), 'N/A') AS {c}" for c in [*CUE_TYPES, "overall"])}
FROM shares JOIN overall USING (model)""",
        "formatted_percent": """WITH shares AS (SELECT p_partkey, p_partkey / 16000.0::DOUBLE AS share FROM part)
SELECT p_partkey, printf('%.1f%%', (share - floor(share)) * 100) AS percent FROM shares""",
        "model_cue_grid": f"""WITH {RESULTS}, {MODEL_CUE}, names AS (SELECT DISTINCT model FROM model_cue),
{_values("cues", "cue_type", [(c,) for c in CUE_TYPES])}
SELECT n.model, c.cue_type, round(coalesce(accuracy, 0), 6) AS accuracy,
 upper(c.cue_type[1:1]) || c.cue_type[2:] AS label
FROM names n JOIN cues c ON TRUE LEFT JOIN model_cue m ON m.model = n.model AND m.cue_type = c.cue_type""",
        "multicue_pivot": f"""WITH {RESULTS}, {SUMMARY}
SELECT model, round(m, 6) AS multi_cue, round(s, 6) AS single_cue FROM summary""",
        "plot_limits": f"""WITH {RESULTS}, {SUMMARY} SELECT model, round(c, 6) AS accuracy, n AS n_images,
 round(least(1.0::DOUBLE, (SELECT max(c) FROM summary) + 0.15::DOUBLE), 6) AS y_max FROM summary""",
        "plot_cue_colors": f"""WITH {RESULTS} SELECT cue_type, {_share()} AS accuracy, count(correct) AS n_images,
 {_case("cue_type", CUE_COLORS, "'#888888'")} AS color {SINGLE} GROUP BY cue_type""",
        "stream_accuracy_again": f"""WITH {RESULTS} SELECT model, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct,
 count(*) AS processed, {_share()} AS accuracy FROM results WHERE ord % 3 = 0 GROUP BY model""",
        "stream_accuracy": f"""WITH {RESULTS} SELECT model, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct,
 count(*) AS processed, {_share()} AS accuracy FROM results GROUP BY model""",
    }
    out["stream_score"] = out["results_sink"]
    return out
