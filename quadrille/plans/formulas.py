"""Queries of the formula language: each compiles its formulas with quadrille.functions.formula or fills them down."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions.formula import bind, compile_formula, number
from quadrille.operators.formulas import evaluate_footer, fill_down
from quadrille.plans.registry import query, table


def _compiled(df, formula: str):
    return compile_formula(formula, bind(df))


@query("""SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(28,4))) AS DOUBLE) AS sum_price,
 COUNT(l_quantity) AS n, MIN(l_quantity) AS min_qty, MAX(l_quantity) AS max_qty FROM lineitem GROUP BY 1, 2""")
def order_sheet(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    t = t.select("l_returnflag", "l_linestatus", "l_quantity", F.round(_compiled(t, "=F2*(1-G2)").col, 4).alias("price"))
    footer = {"sum_price": "SUM(D:D)", "n": "COUNT(C:C)", "min_qty": "MIN(C:C)", "max_qty": "MAX(C:C)"}
    out = evaluate_footer(t, footer, ["l_returnflag", "l_linestatus"], exact=4)
    return out.select("l_returnflag", "l_linestatus", "sum_price", F.col("n").cast("long").alias("n"), "min_qty", "max_qty")


@query("""SELECT o_orderkey + 0 AS o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_custkey % 3) END AS value,
 CASE WHEN o_custkey % 3 = 0 THEN '#DIV/0!' END AS err FROM orders""")
def formula_div_error(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 3).alias("third"))
    v = _compiled(t, "=B2/C2")
    return t.select("o_orderkey", v.col.alias("value"), v.err.alias("err"))


@query("""SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS label FROM nation""")
def formula_concat(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return t.select("n_nationkey", _compiled(t, '=B2&"-"&C2').col.alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'low' END AS band FROM orders""")
def formula_if_nested(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", _compiled(t, '=IF(D2>100000,"high",IF(D2>10000,"mid","low"))').col.alias("band"))


@query("""SELECT CAST(COALESCE(SUM(value), 0) AS DOUBLE) AS total, COUNT(value) AS n, CASE WHEN COUNT(value) = 0 THEN '#DIV/0!' END AS average_err FROM events WHERE event_id < 0""")
def formula_empty_range(spark, sf_dir):
    t = table(spark, sf_dir, "events").filter("event_id < 0")
    out = evaluate_footer(t, {"total": "SUM(E:E)", "n": "COUNT(E:E)", "average": "AVERAGE(E:E)"})
    return out.select("total", F.col("n").cast("long").alias("n"), F.col("average_err"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * (1 - l_discount) AS value FROM lineitem""")
def formula_fill_down(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_extendedprice", _compiled(t, "=F2*(1-G2)").col.alias("value"))


@query("""SELECT p_partkey, p_retailprice / 100 AS share, CASE WHEN p_size < 0 THEN NULL ELSE pow(p_size, 2) END AS power FROM part""")
def formula_power_percent(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", _compiled(t, "=F2%").col.alias("share"), _compiled(t, "=E2^2").col.alias("power"))


@query("""SELECT n_nationkey, lower(n_name) > 'f' AS later, TRUE AS text_over_number FROM nation""")
def formula_compare_mixed(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return t.select("n_nationkey", _compiled(t, '=B2>"F"').col.alias("later"), _compiled(t, "=B2>A2").col.alias("text_over_number"))


@query("""SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(COUNT(l_quantity) AS DOUBLE) AS n,
 CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_quantity) AS average, MIN(l_quantity) AS least, MAX(l_quantity) AS most FROM lineitem GROUP BY 1""")
def formula_aggregates(spark, sf_dir):
    footer = {"total": "SUM(E:E)", "n": "COUNT(E:E)", "average": "AVERAGE(E:E)", "least": "MIN(E:E)", "most": "MAX(E:E)"}
    return evaluate_footer(table(spark, sf_dir, "lineitem"), footer, ["l_returnflag"], exact=2).select("l_returnflag", *footer)


@query("""SELECT o_orderkey, sum(CAST(o_orderkey % 97 AS DOUBLE)) OVER (ORDER BY o_orderkey RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three,
 CAST(count(*) OVER (ORDER BY o_orderkey RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS DOUBLE) AS ahead,
 max(CAST(o_orderkey % 97 AS DOUBLE)) OVER (ORDER BY o_orderkey) AS so_far, sum(CAST(o_orderkey % 97 AS DOUBLE)) OVER (ORDER BY o_orderkey) AS running FROM orders""")
def formula_vertical_ranges(spark, sf_dir):
    """Ranges that move along and that grow, over all rows of the sheet."""
    t = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 3).alias("row"), "o_orderkey", (F.col("o_orderkey") % 97).alias("x"))
    out = fill_down(t, {"last_three": "SUM(B8:B10)", "ahead": "COUNT(B11:B12)", "so_far": "MAX(B$1:B10)", "running": "SUM(B$1:B10)"}, first_row=10)
    return out.select("o_orderkey", "last_three", "ahead", "so_far", "running")


@query("""WITH s AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS x FROM orders)
SELECT s.k AS o_orderkey, s.x - coalesce(p.x, 0) AS step, s.x / nullif((SELECT max(x) FROM s WHERE k = (SELECT min(k) FROM s)), 0) AS share,
 s.x - (SELECT sum(x) / count(x) FROM s WHERE k <= 50) AS off FROM s LEFT JOIN s p ON p.k = s.k - 1""")
def formula_other_rows(spark, sf_dir):
    """The row before, one fixed cell and a fixed range, in formulas that are filled down from row 2."""
    t = table(spark, sf_dir, "orders")
    first = t.agg(F.min("o_orderkey").alias("m")).first()["m"] + 10  # one number: the sheet's first row
    t = t.select((F.col("o_orderkey") + 10).alias("row"), "o_orderkey", "o_custkey")
    out = fill_down(t, {"step": "B80-B79", "share": f"B80/B${first}", "off": "B80-AVERAGE(B$1:B$60)"}, first_row=80)
    return out.select("o_orderkey", "step", "share", "off")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '#DIV/0!' END AS ratio_err, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 1 / (o_custkey % 3) + 1 END AS total,
 CASE WHEN o_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 2.0 END AS n FROM orders""")
def formula_error_in_aggregate(spark, sf_dir):
    """SUM gives the first error of its cells; COUNT skips errors."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("one"), (F.col("o_custkey") % 3).alias("third"))
    out = fill_down(t.withColumn("row", F.col("o_orderkey")), {"ratio": "1/C2", "total": "SUM(B2,D2)", "n": "COUNT(B2,D2)"}, first_row=2)
    return out.select("o_orderkey", "ratio_err", "total", "n")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 5.0::DOUBLE ELSE NULL END AS num, CASE WHEN p_size > 25 THEN NULL ELSE 'no' END AS str, p_size <= 25 AS more, p_size > 25 AS is_true FROM part""")
def formula_if_kinds(spark, sf_dir):
    """Branches of unlike kinds keep their kind: text is more than any number; a test alone gives TRUE or FALSE."""
    t = table(spark, sf_dir, "part")
    v = _compiled(t, '=IF(E2>25,5,"no")')
    return t.select("p_partkey", v.col["num"].alias("num"), v.col["str"].alias("str"), _compiled(t, '=IF(E2>25,5,"no")>10').col.alias("more"), _compiled(t, "=IF(E2>25)").col.alias("is_true"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS joined_number, 'p' || CAST(p_size AS VARCHAR) || CASE WHEN p_size > 9 THEN 'TRUE' ELSE 'FALSE' END AS joined FROM part""")
def formula_concatenate(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", _compiled(t, "=CONCATENATE(E2)+0").col.alias("joined_number"), _compiled(t, '=CONCATENATE("p",E2,E2>9)').col.alias("joined"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_number, CASE WHEN TRY_CAST(event_type AS DOUBLE) IS NULL THEN '#VALUE!' END AS err,
 event_type = 'view' AS is_view, CAST(json_extract_string(props, '$.k') AS DOUBLE) <> 0 AS truth FROM events""")
def formula_coercion(spark, sf_dir):
    """Text as a number, as a truth value, and text that is no number."""
    t = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return t.select("event_id", _compiled(t, "=C2+0").col.alias("as_number"), _compiled(t, "=B2*1").err.alias("err"), _compiled(t, '=B2="VIEW"').col.alias("is_view"), _compiled(t, "=IF(C2+0,TRUE,FALSE)").col.alias("truth"))


@query("""SELECT c_custkey, -c_acctbal AS neg, (-c_acctbal) * (-c_acctbal) AS squared, c_acctbal / 100 AS pct, c_acctbal - 2 * c_acctbal / 4 AS mixed,
 CASE WHEN c_acctbal < 0 THEN '#NUM!' END AS root_err FROM customer""")
def formula_precedence(spark, sf_dir):
    """Unary minus binds before the power, the percent sign before all."""
    t = table(spark, sf_dir, "customer")
    of = lambda f: _compiled(t, f)
    return t.select("c_custkey", of("=-D2").col.alias("neg"), of("=-D2^2").col.alias("squared"), of("=+D2%").col.alias("pct"), of("=D2-2*D2/4").col.alias("mixed"), of("=D2^0.5").err.alias("root_err"))


@query("""SELECT n_nationkey, 0.0::DOUBLE AS loop_a, 0.0::DOUBLE AS loop_b, 0.0::DOUBLE AS reads_loop, CAST(NULL AS VARCHAR) AS unsupported, CAST(NULL AS VARCHAR) AS reads_unsupported, n_nationkey + 1.0::DOUBLE AS fine FROM nation""")
def formula_circular(spark, sf_dir):
    """Whatever reaches a cycle is 0 as a whole; what reads an unsupported formula is unsupported."""
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), "n_nationkey")
    formulas = {"loop_a": "C2+1", "loop_b": "B2+1", "reads_loop": "B2*2+5", "unsupported": "VLOOKUP(A2)", "reads_unsupported": "E2+1", "fine": "A2+1"}
    return fill_down(t, formulas).select("n_nationkey", *formulas)


@query("""SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) + 30.0::DOUBLE AS due FROM orders""")
def formula_dates(spark, sf_dir):
    """Dates take part as serials."""
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", _compiled(t, "=E2+30").col.alias("due"))


@query("""SELECT n_nationkey AS row, 'A' || CAST(n_nationkey + 2 AS VARCHAR) || '*$B$1+C' || CAST(n_nationkey + 1 AS VARCHAR) AS formula FROM nation""")
def formula_shared(spark, sf_dir):
    """Followers of a shared formula have their anchor's, moved to their place."""
    from quadrille.operators.catalog import expand_shared

    t = table(spark, sf_dir, "nation").selectExpr("'S' AS sheet", "n_nationkey AS row", "3 AS col", "if(n_nationkey = 0, 'A2*$B$1+C1', null) AS formula", "'0' AS si")
    return expand_shared(t).select("row", "formula")


@query("""SELECT p_partkey, sqrt(p_retailprice) * 2 AS doubled_root FROM part""")
def formula_added_function(spark, sf_dir):
    """A function added by a user."""
    from quadrille.functions.formula import Value, register_function

    def root(args):
        x = number(args[0])
        return Value("n", F.sqrt(x.col), x.err)

    register_function("SQRT", root)
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", _compiled(t, "=SQRT(F2)*2").col.alias("doubled_root"))


@query("""SELECT o_orderkey, o_totalprice, SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)::DOUBLE AS near FROM orders""")
def formula_range_window(spark, sf_dir):
    """A range of rows by key, within the rows of a customer."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("near"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events""")
def formula_coerce_number(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return t.select("event_id", F.when(F.col("k").isNotNull(), _compiled(t, "=B2+0").col).alias("number"))


@query("""SELECT o_orderkey, o_totalprice / (SELECT MAX(o_totalprice) FROM orders WHERE o_orderkey = (SELECT MIN(o_orderkey) FROM orders)) AS share FROM orders""")
def formula_scalar_ref(spark, sf_dir):
    """The referred cell is one row, so it is broadcast."""
    t = table(spark, sf_dir, "orders")
    first = t.agg(F.min("o_orderkey").alias("m")).first()["m"]
    out = fill_down(t.select((F.col("o_orderkey") - first + 2).alias("row"), "o_orderkey", "o_totalprice"), {"share": "B2/B$2"})
    return out.select("o_orderkey", "share")


@query("""SELECT c_mktsegment, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def formula_cross_sheet(spark, sf_dir):
    """Orders are summed up by customer first, so the join moves one row a customer."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("k"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.sum("s").cast("double").alias("total"), F.sum("k").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem""")
def formula_levels(spark, sf_dir):
    """A formula that reads another formula's cell."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return fill_down(t, {"gross": "G2*(1+E2)", "net": "C2*(1-D2)"}).select("l_orderkey", "l_linenumber", "net", "gross")
