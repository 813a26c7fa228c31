"""Probes that a whole SQL query passes through the batch transform, one per kind of query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sql_transform
from .fixtures import table
from .registered import Query

QUERIES: dict[str, Query] = {}

# name: (batch table, other tables as catalog views, query over temp, the same for a plain SQL engine if it differs)
_PROBES: dict[str, tuple[str, tuple[str, ...], str, str | None]] = {
    "t01_filter_project": (
        "events",
        (),
        """SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, round(value * 2 + 1, 4) AS scaled
           FROM temp WHERE event_type IN ('click', 'purchase') AND value >= 10""",
        None,
    ),
    "t02_join_inner": (
        "orders",
        ("customer", "nation"),
        """SELECT o.o_orderkey, c.c_name, n.n_name FROM temp o
           JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
        None,
    ),
    "t02_join_left": (
        "customer",
        ("orders",),
        """SELECT c.c_custkey, o.o_orderkey FROM temp c
           LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'""",
        None,
    ),
    "t02_join_semi": (
        "customer",
        ("orders",),
        "SELECT c.* FROM temp c LEFT SEMI JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000",
        """SELECT c.* FROM customer c WHERE EXISTS (
           SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""",
    ),
    "t02_join_anti": (
        "customer",
        ("orders",),
        "SELECT c.* FROM temp c LEFT ANTI JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000",
        """SELECT c.* FROM customer c WHERE NOT EXISTS (
           SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""",
    ),
    "t03_theta_join": (
        "orders",
        ("region",),
        """SELECT o.o_orderkey, r.r_name FROM temp o
           JOIN region r ON o.o_totalprice >= r.r_regionkey * 100000
                        AND o.o_totalprice < (r.r_regionkey + 1) * 100000""",
        None,
    ),
    "t04_aggregate": (
        "lineitem",
        (),
        """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n,
                  CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, round(sum(l_quantity), 2) AS quantity
           FROM temp GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
        None,
    ),
    "t05_rollup": (
        "orders",
        (),
        """SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n
           FROM temp GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
        None,
    ),
    "t05_cube": (
        "orders",
        (),
        """SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n
           FROM temp GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
        None,
    ),
    "t05_grouping_sets": (
        "orders",
        (),
        """SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n
           FROM temp GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
        None,
    ),
    "t06_window": (
        "events",
        (),
        """SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS position, lag(event_type) OVER w AS previous,
                  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)
                      AS recent
           FROM temp WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
        None,
    ),
    "t07_top_k": (
        "orders",
        (),
        "SELECT o_orderkey, o_totalprice FROM temp ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
        None,
    ),
    "t08_union": (
        "customer",
        ("supplier",),
        "SELECT c_nationkey AS nation FROM temp UNION SELECT s_nationkey AS nation FROM supplier",
        None,
    ),
    "t08_intersect": (
        "orders",
        ("lineitem",),
        "SELECT o_orderkey AS k FROM temp INTERSECT SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'",
        None,
    ),
    "t08_except": (
        "orders",
        ("lineitem",),
        "SELECT o_orderkey AS k FROM temp EXCEPT SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'",
        None,
    ),
    "t09_subquery": (
        "customer",
        ("orders",),
        """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS dearest
           FROM temp c WHERE EXISTS (
               SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
        None,
    ),
    "t10_scalar_functions": (
        "events",
        (),
        """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind,
                  CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS hour FROM temp""",
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind,
                  date_trunc('hour', ts) AS hour FROM events""",
    ),
    "t11_array_functions": (
        "documents",
        (),
        """SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n
           FROM (SELECT doc_id, explode(split(text, ' ')) AS word FROM temp) GROUP BY doc_id, word""",
        """SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n
           FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY doc_id, word""",
    ),
    "t11_higher_order": (
        "embeddings",
        (),
        """SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive,
                  round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE)), 6) AS total
           FROM temp""",
        """SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive,
                  round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 6) AS total FROM embeddings""",
    ),
}


def _probe(batch: str, others: tuple[str, ...], query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for other in others:
            table(spark, sf_dir, other).createOrReplaceTempView(other)
        return sql_transform(table(spark, sf_dir, batch), query)

    return run


for _name, (_batch, _others, _query, _plain) in _PROBES.items():
    QUERIES[_name] = Query(
        _probe(_batch, _others, _query), _plain or f"WITH temp AS (SELECT * FROM {_batch}) {_query}"
    )
