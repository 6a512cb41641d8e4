"""Queries of conditional formats and validations, through quadrille.operators.rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import rules
from quadrille.plans.registry import query, table


@query("""SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) <= 10 AS hit FROM orders""")
def rule_top_flags(spark, sf_dir):
    return rules.top(table(spark, sf_dir, "orders"), "o_totalprice", 10, "hit", by=["o_orderstatus"]).select("o_orderkey", "hit")


@query("""SELECT o_orderkey, o_totalprice, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS place FROM orders QUALIFY place <= 10""")
def rule_top10(spark, sf_dir):
    from pyspark.sql import Window as W

    hit = rules.top(table(spark, sf_dir, "orders"), "o_totalprice", 10, "_hit", by=["o_orderstatus"]).filter("_hit")
    place = F.rank().over(W.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice")))
    return hit.select("o_orderkey", "o_totalprice", place.cast("long").alias("place"))


@query("""SELECT o_orderkey, o_totalprice, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS place FROM orders QUALIFY place <= 10""")
def rule_bottom10(spark, sf_dir):
    from pyspark.sql import Window as W

    hit = rules.top(table(spark, sf_dir, "orders"), "o_totalprice", 10, "_hit", bottom=True, by=["o_orderstatus"]).filter("_hit")
    place = F.rank().over(W.partitionBy("o_orderstatus").orderBy("o_totalprice"))
    return hit.select("o_orderkey", "o_totalprice", place.cast("long").alias("place"))


@query("""SELECT o_orderkey, RANK() OVER (ORDER BY o_totalprice DESC) <= 25 AS hit FROM orders""")
def rule_top_sheet(spark, sf_dir):
    return rules.top(table(spark, sf_dir, "orders"), "o_totalprice", 25, "hit").select("o_orderkey", "hit")


@query("""SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY p_brand) * 15 / 100)) AS hit FROM part""")
def rule_top_percent(spark, sf_dir):
    return rules.top(table(spark, sf_dir, "part"), "p_size", 15, "hit", percent=True, by=["p_brand"]).select("p_partkey", "hit")


@query("""SELECT c_custkey, COUNT(*) OVER (PARTITION BY lower(c_mktsegment)) > 1 AS repeated FROM customer""")
def rule_duplicates(spark, sf_dir):
    return rules.repeated(table(spark, sf_dir, "customer"), "c_mktsegment", "repeated").select("c_custkey", "repeated")


@query("""SELECT p_partkey, COUNT(*) OVER (PARTITION BY lower(p_name)) = 1 AS single FROM part""")
def rule_unique(spark, sf_dir):
    return rules.repeated(table(spark, sf_dir, "part"), "p_name", "single", unique=True).select("p_partkey", "single")


@query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%' || 'a' || '%' AND lower(p_type) LIKE 's%'""")
def rule_text(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.filter(rules.text_is(F.col("p_name"), "containsText", "A") & rules.text_is(F.col("p_type"), "beginsWith", "S")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_name FROM part WHERE NOT lower(p_name) LIKE '%b%' AND NOT lower(p_type) LIKE '%l'""")
def rule_text_not(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.filter(rules.text_is(F.col("p_name"), "notContainsText", "b") & ~rules.text_is(F.col("p_type"), "endsWith", "l")).select("p_partkey", "p_name")


@query("""SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 50000) AS n FROM orders GROUP BY 1""")
def rule_cell_is(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(rules.cell_is(F.col("o_totalprice"), "between", 1000, 50000)).alias("n"))


@query("""SELECT p_partkey, p_size = 7 AS equal, p_size <> 7 AS notEqual, p_size > 7 AS greaterThan, p_size < 7 AS lessThan, p_size >= 7 AS greaterThanOrEqual, p_size <= 7 AS lessThanOrEqual,
 p_size BETWEEN 7 AND 9 AS between_, NOT p_size BETWEEN 7 AND 9 AS notBetween, lower(p_brand) = 'brand#11' AS text FROM part""")
def rule_cell_is_all(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    flags = [rules.cell_is(F.col("p_size"), op, 7, 9).alias("between_" if op == "between" else op) for op in rules.COMPARE]
    return t.select("p_partkey", *flags, rules.cell_is(F.col("p_brand"), "equal", "BRAND#11").alias("text"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) > 50000 AS marked FROM lineitem""")
def rule_expression(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", rules.expression(t, "=F2*(1-G2)>50000").alias("marked"))


@query("""SELECT p_partkey, (p_retailprice - MIN(p_retailprice) OVER ()) / (MAX(p_retailprice) OVER () - MIN(p_retailprice) OVER ()) AS bar FROM part""")
def rule_data_bar(spark, sf_dir):
    return rules.data_bar(table(spark, sf_dir, "part"), "p_retailprice", "bar").select("p_partkey", "bar")


@query("""SELECT p_partkey, CAST(least(1, greatest(0, (p_size - 10) / 20)) AS DOUBLE) AS bar FROM part""")
def rule_data_bar_fixed(spark, sf_dir):
    return rules.data_bar(table(spark, sf_dir, "part"), "p_size", "bar", low=10, high=30).select("p_partkey", "bar")


@query("""SELECT c_custkey, c_acctbal > (SELECT CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(c_acctbal) FROM customer) AS above FROM customer""")
def rule_above_average(spark, sf_dir):
    return rules.average(table(spark, sf_dir, "customer"), "c_acctbal", "above", places=2).select("c_custkey", "above")


@query("""SELECT c_custkey, c_acctbal <= CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) OVER (PARTITION BY c_mktsegment) AS DOUBLE) / COUNT(c_acctbal) OVER (PARTITION BY c_mktsegment) AS below FROM customer""")
def rule_below_average(spark, sf_dir):
    return rules.average(table(spark, sf_dir, "customer"), "c_acctbal", "below", below=True, equal=True, by=["c_mktsegment"], places=2).select("c_custkey", "below")


@query("""SELECT p_partkey, CAST(p_retailprice >= lo + (hi - lo) * 0.33::DOUBLE AS INT) + CAST(p_retailprice >= lo + (hi - lo) * 0.67::DOUBLE AS INT) AS icon
 FROM part, (SELECT MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM part)""")
def rule_icon_set(spark, sf_dir):
    return rules.icon_set(table(spark, sf_dir, "part"), "p_retailprice", "icon").select("p_partkey", "icon")


@query("""SELECT p_partkey, CAST((x >= 0.25) AS INT) + CAST((x >= 0.5) AS INT) + CAST((x >= 0.75) AS INT) AS four,
 4 - CAST((x >= 0.2::DOUBLE) AS INT) - CAST((x >= 0.4::DOUBLE) AS INT) - CAST((x >= 0.6::DOUBLE) AS INT) - CAST((x >= 0.8::DOUBLE) AS INT) AS five
 FROM (SELECT p_partkey, (p_size - 1) / 64.0::DOUBLE AS x FROM (SELECT p_partkey, p_partkey % 65 + 1 AS p_size FROM part))""")
def rule_icon_sets(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 65 / 64.0).alias("x"))
    return rules.icon_set(rules.icon_set(t, "x", "four", 4), "x", "five", 5, reverse=True).select("p_partkey", "four", "five")


@query("""SELECT p_partkey, CAST(floor(255 * (1 - t) + 0.5) AS INT) AS red, CAST(floor(255 * t + 0.5) AS INT) AS green
 FROM (SELECT p_partkey, (p_retailprice - MIN(p_retailprice) OVER ()) / (MAX(p_retailprice) OVER () - MIN(p_retailprice) OVER ()) AS t FROM part)""")
def rule_color_scale(spark, sf_dir):
    t = rules.color_scale(table(spark, sf_dir, "part"), "p_retailprice", "_c", ["FF0000", "00FF00"])
    return t.select("p_partkey", F.conv(F.substring("_c", 1, 2), 16, 10).cast("int").alias("red"), F.conv(F.substring("_c", 3, 2), 16, 10).cast("int").alias("green"))


@query("""WITH s AS (SELECT min(p_size) AS lo, median(p_size) AS mid, max(p_size) AS hi FROM part),
t AS (SELECT p_partkey, CASE WHEN p_size < mid THEN (p_size - lo) / nullif(mid - lo, 0) END AS a, CASE WHEN p_size >= mid THEN (p_size - mid) / nullif(hi - mid, 0) END AS b FROM part, s)
SELECT p_partkey, CAST(floor(CASE WHEN a IS NOT NULL THEN 200 + 55 * a ELSE 255 - 155 * b END + 0.5) AS INT) AS red FROM t""")
def rule_color_scale3(spark, sf_dir):
    t = rules.color_scale(table(spark, sf_dir, "part"), "p_size", "_c", ["C80000", "FFFF00", "6400FF"])
    return t.select("p_partkey", F.conv(F.substring("_c", 1, 2), 16, 10).cast("int").alias("red"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 1 WHEN p_size > 20 THEN 2 WHEN lower(p_type) LIKE '%steel%' THEN 3 END AS rule,
 CAST(p_size > 40 AS INT) + CAST(p_size > 20 AS INT) + CAST(lower(p_type) LIKE '%steel%' AS INT) AS met FROM part""")
def rule_priority(spark, sf_dir):
    met = [rules.cell_is(F.col("p_size"), "greaterThan", 40), rules.cell_is(F.col("p_size"), "greaterThan", 20), rules.text_is(F.col("p_type"), "containsText", "STEEL")]
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_match(met).alias("rule"), F.size(rules.matches(met)).alias("met"))


@query("""SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 0 AND 1000000 AS valid FROM orders""")
def validation_check(spark, sf_dir):
    listed = rules.valid(F.col("o_orderpriority"), "list", items=["1-URGENT", "2-HIGH"])
    return table(spark, sf_dir, "orders").select("o_orderkey", (listed & rules.valid(F.col("o_totalprice"), "decimal", a=0, b=1000000)).alias("valid"))


@query("""SELECT o_orderkey, o_custkey BETWEEN 1 AND 500 AS whole, o_totalprice > 100 AS dec, o_orderdate >= TIMESTAMP '1995-01-01' AS day, length(o_orderpriority) <= 6 AS size,
 (o_orderkey % 10) / 10.0 BETWEEN 0.25 AND 0.75 AS clock, o_totalprice > o_custkey AS custom FROM orders""")
def validation_kinds(spark, sf_dir):
    import datetime as dt

    t = table(spark, sf_dir, "orders")
    return t.select(
        "o_orderkey", rules.valid(F.col("o_custkey"), "whole", a=1, b=500).alias("whole"), rules.valid(F.col("o_totalprice"), "decimal", "greaterThan", 100).alias("dec"),
        rules.valid(F.col("o_orderdate"), "date", "greaterThanOrEqual", dt.datetime(1995, 1, 1)).alias("day"), rules.valid(F.col("o_orderpriority"), "textLength", "lessThanOrEqual", 6).alias("size"),
        rules.valid(F.col("o_orderkey") % 10 / 10.0, "time", a=0.25, b=0.75).alias("clock"), rules.valid(F.col("o_orderkey"), "custom", formula=rules.expression(t, "=D2>B2")).alias("custom"),
    )


@query("""SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS valid FROM orders""")
def validation_list_range(spark, sf_dir):
    allowed = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey")
    return rules.valid_member(table(spark, sf_dir, "orders"), "o_custkey", allowed, "valid").select("o_orderkey", "valid")
