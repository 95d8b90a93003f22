"""The SQL surface: every family of relational operator as SQL on registered tables.

One text serves both engines unless their dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.functions.similarity import register
from tabledoc.operators.ordered import framed, ranked
from tabledoc.operators.quantiles import exact_quantiles
from tabledoc.operators.tabular import asof_join, band_join
from tabledoc.plans.registry import query, sql_query
from tabledoc.plans.sql_passage import bounded_query
from tabledoc.session import load_table

# --------------------------------------------------------------- projection and filter
sql_query(
    "sql_project",
    """SELECT l_orderkey, l_linenumber,
              l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
              upper(l_returnflag) || l_linestatus AS flags
       FROM lineitem""",
)
sql_query(
    "sql_filter",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F')
         AND o_orderpriority LIKE '%-%' AND o_orderpriority NOT ILIKE '%low%'
         AND o_custkey IS NOT NULL AND o_orderkey <> 7 AND regexp_like(o_orderpriority, '^[1-3]')""",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F')
         AND o_orderpriority LIKE '%-%' AND o_orderpriority NOT ILIKE '%low%'
         AND o_custkey IS NOT NULL AND o_orderkey <> 7 AND regexp_matches(o_orderpriority, '^[1-3]')""",
)

# --------------------------------------------------------------- joins
sql_query(
    "sql_join_inner",
    """SELECT n.n_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
)
sql_query(
    "sql_join_left",
    """SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c
       LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'""",
)
sql_query(
    "sql_join_right",
    """SELECT s.s_suppkey, s.s_name, c.n_cust FROM
       (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n_cust FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c
       RIGHT JOIN supplier s ON s.s_nationkey = c.c_nationkey""",
)
# both sides are one row per key before they meet, as a full join cannot split a hot key
sql_query(
    "sql_join_full",
    """SELECT coalesce(a.k, b.k) AS part_key, a.n_lines, b.n_small FROM
       (SELECT l_partkey AS k, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) a
       FULL JOIN
       (SELECT l_partkey AS k, CAST(count(*) AS BIGINT) AS n_small FROM lineitem WHERE l_quantity < 5 GROUP BY l_partkey) b
       ON a.k = b.k""",
)
sql_query(
    "sql_join_semi",
    """SELECT c_custkey, c_name FROM customer c
       WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)
         AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""",
)
sql_query(
    "sql_join_anti",
    """SELECT p_partkey, p_name FROM part p
       WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)""",
)


@query(
    "sql_join_theta",
    """WITH bands AS (SELECT p_brand, avg(p_retailprice) - 5 AS low, avg(p_retailprice) + 5 AS high FROM part GROUP BY p_brand)
       SELECT b.p_brand AS brand, CAST(count(*) AS BIGINT) AS n_parts, CAST(min(p.p_partkey) AS BIGINT) AS first_part
       FROM bands b JOIN part p ON p.p_retailprice >= b.low AND p.p_retailprice < b.high GROUP BY b.p_brand""",
)
def sql_join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load_table(spark, sf_dir, "part")
    mean = F.avg("p_retailprice")
    bands = part.groupBy(F.col("p_brand").alias("brand")).agg((mean - 5).alias("low"), (mean + 5).alias("high"))
    hits = band_join(bands, part.select("p_partkey", "p_retailprice"), "low", "high", "p_retailprice", 10.0)
    return hits.groupBy("brand").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part"))


@query(
    "sql_join_asof",
    """SELECT a.event_id, a.user_id, b.event_id AS view_id FROM
       (SELECT * FROM events WHERE event_type = 'purchase') a
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b
       ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def sql_join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    joined = asof_join(bought, views, ["user_id"], "ts", "ts", ["view_id"], "date_trunc('MINUTE', _at)")
    return joined.select("event_id", "user_id", "view_id")


# --------------------------------------------------------------- aggregation
sql_query(
    "sql_group",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
              round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
              round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
              CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_tax > 0.04) AS BIGINT) AS n_taxed
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
sql_query(
    "sql_distinct_agg",
    """SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts,
              CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_supp, round(sum(DISTINCT l_quantity), 2) AS sum_q
       FROM lineitem GROUP BY l_returnflag""",
)
sql_query(
    "sql_having",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders
       GROUP BY o_custkey HAVING count(*) > 8 AND sum(o_totalprice) > 100000""",
)
_GROUPED = """SELECT {g}, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2,
              CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {by}"""
for _name, _by in {
    "sql_rollup": "ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_cube": "CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
}.items():
    sql_query(_name, _GROUPED.format(g="o_orderstatus, o_orderpriority", by=_by))
# l_quantity has 50 values, so the exact median keeps a bounded count table per group
sql_query(
    "sql_stats",
    """SELECT l_linestatus, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_discount), 8) AS vp,
              round(corr(l_quantity, l_extendedprice), 6) AS cr, median(l_quantity) AS med,
              round(percentile(l_quantity, 0.9), 4) AS q90 FROM lineitem GROUP BY l_linestatus""",
    """SELECT l_linestatus, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_discount), 8) AS vp,
              round(corr(l_quantity, l_extendedprice), 6) AS cr, median(l_quantity) AS med,
              round(quantile_cont(l_quantity, 0.9), 4) AS q90 FROM lineitem GROUP BY l_linestatus""",
)
# the approximation is checked against the exact count, as its value is engine-specific
sql_query(
    "sql_stats_approx",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey))
              <= 0.15 * count(DISTINCT l_partkey) AS close FROM lineitem GROUP BY l_returnflag""",
    "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts, true AS close FROM lineitem GROUP BY l_returnflag",
)


@query(
    "sql_quantiles",
    """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90,
              round(quantile_cont(l_extendedprice, 0.001), 4) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def sql_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of a column with about as many values as rows."""
    lines = load_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    found = exact_quantiles(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"med": 0.5, "q90": 0.9, "low": 0.001, "high": 1.0})
    return found.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("med", "q90", "low")], "high")


# a list of distinct event types is bounded by the number of types
sql_query(
    "sql_listagg",
    """SELECT user_id, listagg(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type) AS types,
              array_join(array_sort(collect_set(event_type)), '|') AS listed FROM events GROUP BY user_id""",
    """SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types,
              array_to_string(list_sort(list(DISTINCT event_type)), '|') AS listed FROM events GROUP BY user_id""",
)
sql_query(
    "sql_pivot",
    """SELECT * FROM (SELECT user_id, event_type, value FROM events)
       PIVOT (CAST(count(value) AS BIGINT) FOR event_type IN ('click' AS n_click, 'view' AS n_view, 'purchase' AS n_purchase))""",
    """SELECT user_id, nullif(CAST(count(value) FILTER (WHERE event_type = 'click') AS BIGINT), 0) AS n_click,
              nullif(CAST(count(value) FILTER (WHERE event_type = 'view') AS BIGINT), 0) AS n_view,
              nullif(CAST(count(value) FILTER (WHERE event_type = 'purchase') AS BIGINT), 0) AS n_purchase
       FROM events GROUP BY user_id""",
)
sql_query(
    "sql_unpivot",
    """SELECT * FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part)
       UNPIVOT (item FOR field IN (p_name, p_brand, p_type))""",
    """SELECT * FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part)
       UNPIVOT (item FOR field IN (p_name, p_brand, p_type))""",
)


# --------------------------------------------------------------- windows
@query(
    "sql_win_rank",
    """SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
              round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""",
)
def sql_win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ranked(events, ["event_type"], "value").select(
        "event_id", "rank", "dense_rank",
        F.round("percent_rank", 6).alias("percent_rank"), F.round("cume_dist", 6).alias("cume_dist"),
    )


@query(
    "sql_win_analytic",
    """SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2,
              first_value(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS first3,
              nth_value(value, 2) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS second3
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def sql_win_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    last3 = lambda w: w.rowsBetween(-2, 0)
    return framed(
        events, ["user_id"], "event_id", before=2, after=2,
        columns={
            "prev": lambda w: F.lag("value").over(w),
            "next2": lambda w: F.lead("value", 2).over(w),
            "first3": lambda w: F.first("value").over(last3(w)),
            "second3": lambda w: F.nth_value("value", 2).over(last3(w)),
        },
    ).drop("user_id", "value")


@query(
    "sql_win_frame",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS running,
              round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS moving
       FROM events""",
)
def sql_win_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    moving = framed(
        events, ["user_id"], "event_id", before=3, after=1, running={"running": "value"},
        columns={"moving": lambda w: F.avg("value").over(w.rowsBetween(-3, 1))},
    )
    return moving.select("event_id", F.round("running", 2).alias("running"), F.round("moving", 4).alias("moving"))


# a window written in SQL; the lines of an order are few
sql_query(
    "sql_win_qualify",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM
       (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem)
       WHERE rn <= 2""",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2""",
)

# --------------------------------------------------------------- sort, limit, sets
sql_query("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
sql_query("sql_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
sql_query(
    "sql_union",
    """SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier
       UNION ALL SELECT k, src FROM (SELECT c_nationkey AS k, 'u' AS src FROM customer UNION SELECT s_nationkey, 'u' FROM supplier)""",
)
sql_query(
    "sql_intersect",
    """SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5
       UNION ALL
       (SELECT l_partkey FROM lineitem WHERE l_tax > 0.06 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_tax < 0.02)""",
    """(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5)
       UNION ALL
       (SELECT l_partkey FROM lineitem WHERE l_tax > 0.06 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_tax < 0.02)""",
)
sql_query(
    "sql_except",
    """(SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
       UNION ALL
       (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""",
)
sql_query(
    "sql_cte",
    """WITH per_cust AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
            per_seg AS (SELECT c_mktsegment, avg(total) AS mean FROM per_cust JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
       SELECT c_mktsegment, round(mean, 2) AS mean FROM per_seg""",
)
# quantities are reduced to their distinct values before the recursion and joined back after
sql_query(
    "sql_recursive",
    """WITH RECURSIVE start AS (SELECT CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY CAST(l_quantity AS BIGINT)),
            halve(q, v, step) AS (
              SELECT q, q, 0 FROM start
              UNION ALL SELECT q, v DIV 2, step + 1 FROM halve WHERE v > 1)
       SELECT CAST(h.v AS BIGINT) AS v, CAST(h.step AS BIGINT) AS step, CAST(sum(s.n) AS BIGINT) AS n
       FROM halve h JOIN start s ON h.q = s.q GROUP BY h.v, h.step""",
    """WITH RECURSIVE start AS (SELECT CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY CAST(l_quantity AS BIGINT)),
            halve(q, v, step) AS (
              SELECT q, q, 0 FROM start
              UNION ALL SELECT q, v // 2, step + 1 FROM halve WHERE v > 1)
       SELECT CAST(h.v AS BIGINT) AS v, CAST(h.step AS BIGINT) AS step, CAST(sum(s.n) AS BIGINT) AS n
       FROM halve h JOIN start s ON h.q = s.q GROUP BY h.v, h.step""",
)
sql_query(
    "sql_subquery",
    """SELECT o_orderkey, o_custkey FROM orders o
       WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
         AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)""",
)

# --------------------------------------------------------------- functions
sql_query(
    "sql_fn_string",
    """SELECT p_partkey, upper(p_name) AS up, initcap(p_name) AS cap, length(p_type) AS len, substring(p_name, 2, 4) AS sub,
              replace(p_brand, '#', '-') AS rep, split_part(p_name, ' ', 1) AS first_word, lpad(p_brand, 12, '*') AS padded,
              reverse(p_name) AS rev, trim('  x ') || repeat('ab', 2) AS misc, instr(p_name, 'r') AS pos, left(p_type, 3) AS l3,
              regexp_replace(p_name, '[aeiou]', '_') AS vow, translate(p_type, 'ECO', 'xyz') AS tr, ascii(p_name) AS asc1,
              md5(p_name) AS digest, concat_ws('/', p_name, p_brand) AS ws
       FROM part""",
    """SELECT p_partkey, upper(p_name) AS up,
              array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS cap,
              length(p_type) AS len, substring(p_name, 2, 4) AS sub,
              replace(p_brand, '#', '-') AS rep, split_part(p_name, ' ', 1) AS first_word, lpad(p_brand, 12, '*') AS padded,
              reverse(p_name) AS rev, trim('  x ') || repeat('ab', 2) AS misc, instr(p_name, 'r') AS pos, left(p_type, 3) AS l3,
              regexp_replace(p_name, '[aeiou]', '_', 'g') AS vow, translate(p_type, 'ECO', 'xyz') AS tr, ascii(p_name) AS asc1,
              md5(p_name) AS digest, concat_ws('/', p_name, p_brand) AS ws
       FROM part""",
)
sql_query(
    "sql_fn_math",
    """SELECT o_orderkey, abs(-o_orderkey) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f,
              round(sqrt(o_totalprice), 6) AS sq, round(ln(o_totalprice + 1), 6) AS lg, round(power(o_custkey, 2), 2) AS pw,
              o_orderkey % 7 AS md, CAST(sign(o_totalprice - 50000) AS BIGINT) AS sg, greatest(o_orderkey, o_custkey) AS gr,
              least(o_orderkey, o_custkey) AS le, round(sin(o_orderkey) + exp(-1) + pi(), 6) AS trig
       FROM orders""",
)
sql_query(
    "sql_fn_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
              CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(quarter(o_orderdate) AS BIGINT) AS q,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d,
              last_day(CAST(o_orderdate AS DATE)) AS ld, date_format(o_orderdate, 'yyyy/MM/dd') AS txt,
              CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
              CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later
       FROM orders""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
              CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(quarter(o_orderdate) AS BIGINT) AS q,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d,
              last_day(CAST(o_orderdate AS DATE)) AS ld, strftime(o_orderdate, '%Y/%m/%d') AS txt,
              CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS BIGINT) AS days,
              CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later
       FROM orders""",
)
sql_query(
    "sql_fn_array",
    """SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(embedding[0] AS DOUBLE) AS first, CAST(array_max(embedding) AS DOUBLE) AS hi,
              CAST(array_min(embedding) AS DOUBLE) AS lo, CAST(slice(embedding, 2, 3)[2] AS DOUBLE) AS s3,
              array_contains(array(label, 1), 2) AS has2, CAST(array_position(array(5, label, 9), label) AS BIGINT) AS pos,
              CAST(element_at(array_sort(embedding), -1) AS DOUBLE) AS top, array_join(array_distinct(array(label, label, 7)), ',') AS d
       FROM embeddings""",
    """SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS hi,
              CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(embedding[4] AS DOUBLE) AS s3,
              list_contains([label, 1], 2) AS has2, CAST(list_position([5, label, 9], label) AS BIGINT) AS pos,
              CAST(list_sort(embedding)[-1] AS DOUBLE) AS top,
              CASE WHEN label = 7 THEN '7' ELSE label || ',7' END AS d
       FROM embeddings""",
)
sql_query(
    "sql_fn_map",
    """SELECT event_id, map(event_type, value, 'k', 1.5D)['k'] AS k, CAST(size(map_keys(m)) AS BIGINT) AS n, element_at(m, event_type) AS v,
              map_contains_key(m, 'nope') AS c
       FROM (SELECT event_id, event_type, value, map(event_type, value, 'other', -1D) AS m FROM events)""",
    """SELECT event_id, 1.5::DOUBLE AS k, CAST(cardinality(m) AS BIGINT) AS n, m[event_type] AS v, map_contains(m, 'nope') AS c
       FROM (SELECT event_id, event_type, value, MAP {event_type: value, 'other': -1::DOUBLE} AS m FROM events)""",
)
sql_query(
    "sql_fn_json",
    """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k INT').k * 2 AS k2,
              to_json(named_struct('id', event_id, 't', event_type)) AS js FROM events""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS INT) * 2 AS k2,
              CAST(to_json({'id': event_id, 't': event_type}) AS VARCHAR) AS js FROM events""",
)
sql_query(
    "sql_fn_cond",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band,
              coalesce(nullif(o_orderstatus, 'O'), 'open') AS st, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f,
              if(o_custkey % 2 = 0, 'even', 'odd') AS par, ifnull(nullif(o_orderpriority, '5-LOW'), 'none') AS pr
       FROM orders""",
)
sql_query(
    "sql_fn_cast",
    """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS b,
              try_cast(o_orderpriority AS INT) AS bad, try_cast(left(o_orderpriority, 1) AS INT) AS good,
              CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS dec, CAST(o_orderdate AS DATE) AS d,
              CAST(o_orderkey % 2 AS BOOLEAN) AS flag FROM orders""",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS b,
              try_cast(o_orderpriority AS INT) AS bad, try_cast(left(o_orderpriority, 1) AS INT) AS good,
              CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS dec, CAST(o_orderdate AS DATE) AS d,
              CAST(o_orderkey % 2 AS BOOLEAN) AS flag FROM orders""",
)
sql_query(
    "sql_unnest",
    """SELECT doc_id, pos + 1 AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line""",
    """SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents""",
)
sql_query(
    "sql_lambda",
    """SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS n_pos,
              round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 5) AS norm2,
              exists(embedding, x -> x > 0.4) AS any_big, CAST(size(transform(embedding, x -> x + 1)) AS BIGINT) AS n
       FROM embeddings""",
    """SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n_pos,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm2,
              list_max(embedding) > 0.4 AS any_big, CAST(len(list_transform(embedding, lambda x: x + 1)) AS BIGINT) AS n
       FROM embeddings""",
)


@query(
    "sql_udf",
    """SELECT p_partkey, round(2.0 * length(p_name) / (2 * length(p_name) + 2), 6) AS ratio FROM part""",
)
def sql_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    load_table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return bounded_query(
        spark, "SELECT p_partkey, round(text_ratio(p_name, p_name || '~~'), 6) AS ratio FROM part"
    )
