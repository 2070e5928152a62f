"""DuckDB SQL with the results of those training-data queries that SQL can express."""

from __future__ import annotations

from wherescore.llm import decontaminate, queries

SHARDS = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM {docs}
), b AS (
  SELECT d, h >> (60 - d)::INTEGER AS bucket, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM d, range(0, 61) AS r(d) GROUP BY ALL
), leaf AS (
  SELECT doc_id, bytes, h, min(b.d) AS depth
  FROM d, range(0, 61) AS r(d) JOIN b ON b.d = r.d
  WHERE b.bucket = d.h >> (60 - r.d)::INTEGER AND (b.shard_bytes <= {limit} OR b.shard_docs = 1)
  GROUP BY ALL
)
SELECT {columns}leaf.bytes, substr(lpad(bin(h), 60, '0'), 1, leaf.depth::INTEGER) AS shard,
       leaf.depth::INTEGER AS depth, b.shard_bytes, b.shard_docs
FROM leaf JOIN b ON b.d = leaf.depth AND b.bucket = h >> (60 - leaf.depth)::INTEGER{join}
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: 50-byte strings are hexadecimal here; runs that touch are one span.
REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS owner, doc_id, hex(encode(coalesce(text, ''))) AS h,
         strlen(coalesce(text, ''))::BIGINT AS n
  FROM documents
), g AS (
  SELECT r, owner, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM d, range(0, n - 49) AS t(i)
), m AS (
  SELECT s, min(owner) AS least FROM g GROUP BY s HAVING min(owner) <> max(owner)
), c AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS begins
  FROM (SELECT r, i FROM g JOIN m USING (s) WHERE owner > least) WINDOW w AS (PARTITION BY r ORDER BY i)
), spans AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(begins) OVER (PARTITION BY r ORDER BY i) AS k FROM c) GROUP BY r, k
), gaps AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans
), cut AS (
  SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * z + 1)) AS kept
  FROM gaps JOIN d USING (r) JOIN (SELECT r, max(b) AS z FROM spans GROUP BY r) USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

#: Pairs come from rare shingles: of two similar lines, the rarest ones of each (a fifth of them and one) share one.
LINES = """
WITH RECURSIVE l AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), distinct_lines AS (
  SELECT line, row_number() OVER (ORDER BY line) AS k FROM (SELECT DISTINCT line FROM l WHERE trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') <> '')
), shingles AS (
  SELECT DISTINCT k, substr(line, i, 5) AS s FROM distinct_lines, range(1, greatest(length(line) - 4, 1) + 1) AS t(i)
), numbered AS (
  SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY f, s) AS place, count(*) OVER (PARTITION BY k) AS n
  FROM shingles JOIN (SELECT s, count(*) AS f FROM shingles GROUP BY s) USING (s)
), rare AS (
  SELECT k, s, n FROM numbered WHERE place <= n - ceil(n * 0.8) + 1
), pairs AS (
  SELECT DISTINCT a.k AS x, b.k AS y, a.n AS nx, b.n AS ny FROM rare a JOIN rare b ON a.s = b.s AND a.k < b.k
  WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
), links AS (
  SELECT x, y FROM pairs JOIN shingles a ON a.k = x JOIN shingles b ON b.k = y AND a.s = b.s
  GROUP BY x, y, nx, ny HAVING count(*) >= 0.8 * (nx + ny - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT k, k AS other FROM distinct_lines UNION SELECT reach.k, y FROM reach JOIN both_ways ON reach.other = x
), component AS (
  SELECT k, min(other) AS c FROM reach GROUP BY k
), placed AS (
  SELECT doc_id, pos, c, min({'id': doc_id, 'pos': pos}) OVER (PARTITION BY c) AS first
  FROM l LEFT JOIN distinct_lines USING (line) LEFT JOIN component USING (k)
)
SELECT doc_id, pos::INTEGER AS line, CASE WHEN c IS NULL THEN doc_id ELSE first.id END AS keep_doc_id,
       (CASE WHEN c IS NULL THEN pos ELSE first.pos END)::INTEGER AS keep_line,
       c IS NULL OR (first.id = doc_id AND first.pos = pos) AS kept
FROM placed
"""

#: Documents with the benchmark items they hold. Seeds are token lists here instead of hashes.
LEAKS = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w
  FROM {docs}
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w
  FROM benchmark
), m AS (SELECT * FROM (VALUES {masks}) AS t(mask, keep)
), ds AS (
  SELECT doc_id, w, p, mask, list_transform(keep, lambda k: w[p + k]) AS seed FROM d, range(1, len(w) - 6) AS r(p), m
  WHERE len(w) >= 8
), bs AS (
  SELECT item_id, w, p, mask, list_transform(keep, lambda k: w[p + k]) AS seed FROM i, range(1, len(w) - 6) AS r(p), m
  WHERE len(w) >= 8
), hits AS (
  SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS start, bs.p AS place, ds.w AS dw, bs.w AS iw
  FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed
), compared AS (
  SELECT doc_id, item_id, start, place, least(16, len(iw)) AS width, len(iw) AS n,
         list_transform(range(1, len(iw) + 1),
           lambda k: CASE WHEN start + k >= 1 AND start + k <= len(dw) AND iw[k] = dw[start + k] THEN 1 ELSE 0 END) AS same
  FROM hits
), verified AS (
  SELECT DISTINCT doc_id, item_id, start FROM compared, range(greatest(1, place + 8 - width), least(place, n - width + 1) + 1) AS r(s)
  WHERE list_sum(same[s:s + width - 1]) >= ceil(width * 0.8)
)
SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, sum(n)::BIGINT AS n_overlaps
FROM (SELECT doc_id, item_id, count(*) AS n FROM verified GROUP BY ALL) GROUP BY doc_id
"""

MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), n AS (
  SELECT *, len(t) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS r FROM d
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90
              THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n
), p AS (
  SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

#: Trees as lists of digests, level by level.
MANIFEST = """
WITH RECURSIVE r AS (
  SELECT doc_id, source, text, lang, n_chars,
         CASE WHEN crc32 % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM (SELECT *, {crc} AS crc32 FROM documents)
), e AS (
  SELECT doc_id, source, {leaf} AS leaf, {seen} AS seen FROM r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM e
), t AS (
  SELECT source, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM o GROUP BY source
  UNION ALL
  SELECT source, level + 1, {up} FROM t WHERE len(nodes) > 1
), roots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1
), u AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM roots
  UNION ALL
  SELECT level + 1, {up} FROM u WHERE len(nodes) > 1
), steps AS (
  SELECT o.source, o.idx, t.level, {sides} FROM o JOIN t ON t.source IS NOT DISTINCT FROM o.source WHERE len(t.nodes) > 1
), low AS (
  SELECT source, idx, list(l ORDER BY level) AS b, list(x ORDER BY level) AS a FROM steps GROUP BY ALL
), top AS (
  SELECT place, list(l ORDER BY level) AS b, list(x ORDER BY level) AS a
  FROM (SELECT o.place, u.level, {top_sides} FROM roots o, u WHERE len(u.nodes) > 1) GROUP BY ALL
), paths AS (
  SELECT o.doc_id, o.leaf, o.seen, roots.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root,
         coalesce(low.b, []) || coalesce(top.b, []) AS b, coalesce(low.a, []) || coalesce(top.a, []) AS a
  FROM o JOIN roots ON roots.source IS NOT DISTINCT FROM o.source
  LEFT JOIN low ON low.source IS NOT DISTINCT FROM o.source AND low.idx = o.idx LEFT JOIN top ON top.place = roots.place
), f AS (
  SELECT *, list_reduce([seen] || list_transform(b, lambda x, i: x || '|' || a[i]),
    lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root
  FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(b, lambda x, i: x || a[i]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM f
"""


def merkle() -> str:
    def leaf(text: str) -> str:
        columns = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns) + ")"

    def sides(nodes: str, place: str, level: str) -> str:
        at = f"({place} // (3 ** {level})::BIGINT)"
        run = f"({at} - {at} % 3)"
        return (
            f"array_to_string({nodes}[{run} + 1:{at}], '') AS l, array_to_string({nodes}[{at} + 2:{run} + 3], '') AS x"
        )

    # DuckDB has no crc32: eight steps for each byte of the id's digits.
    crc = (
        "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), "
        "lambda x: ascii(x)::BIGINT), lambda a, x: list_reduce([xor(a, x)] || range(8), "
        "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"
    )
    up = "list_transform(range(0, len(nodes), 3), lambda k: sha256(array_to_string(nodes[k + 1:k + 3], '')))"
    return MANIFEST.format(
        crc=crc,
        leaf=leaf("text"),
        seen=leaf("tampered"),
        up=up,
        sides=sides("t.nodes", "o.idx", "t.level"),
        top_sides=sides("u.nodes", "o.place", "u.level"),
    )


def leaks(docs: str) -> str:
    masks = ", ".join(
        f"({k}, [{', '.join(str(i) for i, bit in enumerate(mask) if bit == '1')}])" for k, mask in enumerate(decontaminate.MASKS)
    )
    return LEAKS.format(docs=docs, masks=masks)


def sql() -> dict[str, str]:
    return {
        "op1_extendible_shards": SHARDS.format(
            docs="documents", limit=queries.SHARD_BYTES, columns="leaf.doc_id, ", join=""
        ),
        "op5_decontaminate": leaks("documents"),
        "op3_suffix_dedup": REPEATS,
        "op4_exact_dedup": EXACT,
        "op10_fuzzy_lines": LINES,
        "op11_fill_in_middle": MIDDLE,
        "op13_merkle_manifest": merkle(),
    }
