"""Plain SQL over the tables: the same text runs on both engines."""

from __future__ import annotations

import re

from gaugeworks.sources.tables import table

TEXTS = {
    "sql_filter_cte": "WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})) SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 5 THEN 'many' ELSE 'few' END AS size FROM big GROUP BY o_custkey",
    "sql_joins": "SELECT c_custkey, n_name, count(o_orderkey) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey, n_name",
    "sql_semi_anti": "SELECT c_custkey, 'with' AS kind FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'without' FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10",
    "sql_windows": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS frame FROM {orders}",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_set_ops": "(SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer}) EXCEPT SELECT s_suppkey FROM {supplier}",
    "sql_scalars": "SELECT p_partkey, upper(p_name) AS name, length(p_type) AS n, substring(p_brand, 1, 3) AS brand, abs(p_size - 20) AS away, coalesce(nullif(p_size, 1), 0) AS size FROM {part}",
    "sql_day_buckets": "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day_date, count(*) AS n FROM {events} WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type, CAST(date_trunc('day', ts) AS DATE)",
    "sql_outer_joins": "SELECT n_name, count(c_custkey) AS customers, count(s_suppkey) AS suppliers FROM (SELECT * FROM {customer} WHERE c_custkey % 3 = 0) c FULL JOIN (SELECT * FROM {supplier} WHERE s_suppkey % 2 = 0) s ON c_nationkey = s_nationkey AND c_custkey = s_suppkey RIGHT JOIN {nation} ON n_nationkey = coalesce(c_nationkey, s_nationkey) GROUP BY n_name",
    "sql_cross_and_range_joins": "SELECT n.n_name, r.r_name, count(c_custkey) AS richer FROM {nation} n CROSS JOIN {region} r LEFT JOIN (SELECT c_custkey, c_nationkey, c_acctbal FROM {customer}) c ON c_nationkey = n_nationkey AND c_acctbal > 1000 * r_regionkey GROUP BY n.n_name, r.r_name",
    "sql_all_forms": "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM {events} EXCEPT ALL (SELECT event_type FROM {events} WHERE value > 50 INTERSECT ALL SELECT event_type FROM {events} WHERE user_id % 2 = 0)) x GROUP BY event_type",
    "sql_date_scalars": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofyear(o_orderdate) AS d, CAST(last_day(CAST(o_orderdate AS DATE)) AS STRING) AS month_end FROM {orders}",
    "sql_correlated": "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS most FROM {customer}",
}


def _query(text: str):
    def run(spark, sf_dir):
        return spark.sql(text, **{name: table(spark, sf_dir, name) for name in set(re.findall(r"\{(\w+)\}", text))})

    return run


#: Where the two engines call a function by other names: (text here, text on DuckDB).
TWICE = {
    "sql_lists": (
        "SELECT user_id, size(k) AS n, k[0] AS least, array_contains(k, 3) AS has_3, aggregate(transform(k, x -> x * x), 0L, (a, x) -> a + x) AS squares FROM (SELECT user_id, sort_array(collect_set(CAST(get_json_object(props, '$.k') AS BIGINT))) AS k FROM {events} GROUP BY user_id)",
        "SELECT user_id, len(k)::INT AS n, k[1] AS least, list_contains(k, 3) AS has_3, list_sum(list_transform(k, lambda x: x * x))::BIGINT AS squares FROM (SELECT user_id, list_sort(list(DISTINCT json_extract_string(props, '$.k')::BIGINT)) AS k FROM events GROUP BY user_id)",
    ),
    "sql_maps": (
        "SELECT user_id, m['click'] AS clicks, size(map_keys(m)) AS kinds FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type) GROUP BY user_id)",
        "SELECT user_id, m['click'] AS clicks, len(map_keys(m))::INT AS kinds FROM (SELECT user_id, map_from_entries(list((event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id)",
    ),
    "sql_json": (
        "SELECT event_id, get_json_object(j, '$.a.k') AS k, json_array_length(get_json_object(j, '$.l')) AS n FROM (SELECT event_id, concat('{{\"a\":', props, ',\"l\":[1,2,', event_id, ']}}') AS j FROM {events})",
        "SELECT event_id, json_extract_string(j, '$.a.k') AS k, json_array_length(j, '$.l')::INT AS n FROM (SELECT event_id, concat('{\"a\":', props, ',\"l\":[1,2,', event_id, ']}') AS j FROM events)",
    ),
}

QUERIES = {name: _query(text) for name, text in TEXTS.items()} | {name: _query(text) for name, (text, _) in TWICE.items()}
SQL = {name: re.sub(r"[{}]", "", text) for name, text in TEXTS.items()} | {name: text for name, (_, text) in TWICE.items()}
