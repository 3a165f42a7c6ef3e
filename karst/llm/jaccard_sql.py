"""SQL for operators 5 and 12: every pair by its common shingles, and reachability over the links."""

_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(w[p : p + least({size}, len(w)) - 1], ' ') || ' ' || least({size}, len(w)) AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
linked AS (SELECT x, y FROM pairs JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(rid, r) AS (SELECT rid, rid FROM d UNION SELECT reach.rid, l.y FROM reach JOIN both_ways l ON reach.r = l.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach USING (rid) JOIN d e ON e.rid = reach.r LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id
"""


def jaccard_sql(size: int, percent: int) -> str:
    return _SQL.replace("{size}", str(size)).replace("{percent}", str(percent))


OP5_SQL = jaccard_sql(4, 85)
