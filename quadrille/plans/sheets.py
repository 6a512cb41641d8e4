"""Queries of edits, shapes, ranges and dictionaries of sheets, through quadrille.operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.refs import Axis, letters_of, number_of
from quadrille.operators import catalog, edits, ranges, shaping
from quadrille.plans.registry import query, table

_CELLS_SQL = """(SELECT n_nationkey AS "row", 0 AS col, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 1, n_name FROM nation UNION ALL SELECT n_nationkey, 2, CAST(n_regionkey AS VARCHAR) FROM nation)"""


def _nation_cells(spark, sf_dir) -> DataFrame:
    return shaping.to_cells(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


def _order_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.lit(0).alias("col"), F.col("o_custkey").alias("value"))


# -- edits


@query("""SELECT o_orderkey + CASE WHEN o_orderkey >= 100 THEN 5 ELSE 0 END AS row_number, o_custkey FROM orders""")
def insert_rows(spark, sf_dir):
    return edits.insert_rows(_order_rows(spark, sf_dir), 100, 5, edge=False).select(F.col("row").cast("long").alias("row_number"), F.col("value").alias("o_custkey"))


@query("""SELECT o_orderkey - CASE WHEN o_orderkey >= 105 THEN 5 ELSE 0 END AS row_number, o_custkey FROM orders WHERE NOT o_orderkey BETWEEN 100 AND 104""")
def delete_rows(spark, sf_dir):
    return edits.delete_rows(_order_rows(spark, sf_dir), 100, 5, edge=False).select(F.col("row").cast("long").alias("row_number"), F.col("value").alias("o_custkey"))


@query(f"""SELECT "row", CASE WHEN col >= 1 THEN col + 2 ELSE col END AS col, value FROM {_CELLS_SQL}""")
def insert_columns(spark, sf_dir):
    return edits.insert_columns(_nation_cells(spark, sf_dir), 2, 2).select("row", F.col("col").cast("int").alias("col"), "value")


@query(f"""SELECT "row", CASE WHEN col > 1 THEN col - 1 ELSE col END AS col, value FROM {_CELLS_SQL} WHERE col <> 1""")
def delete_columns(spark, sf_dir):
    return edits.delete_columns(_nation_cells(spark, sf_dir), 2, 1).select("row", F.col("col").cast("int").alias("col"), "value")


@query("""SELECT CASE WHEN k >= 300 THEN k - 17 WHEN k >= 50 THEN k + 3 ELSE k END AS "row", v AS value FROM
 (SELECT o_orderkey AS k, o_custkey AS v FROM orders) WHERE NOT k BETWEEN 280 AND 299""")
def edit_sequence(spark, sf_dir):
    """Three rows in at 50, then, in the places that leaves, twenty deleted from 283 on."""
    return edits.shift(_order_rows(spark, sf_dir), rows=Axis(((50, 3, True), (283, 20, False))), edge=False).select("row", "value")


@query("""SELECT n_nationkey + CASE WHEN n_nationkey >= 10 THEN 2 ELSE 0 END AS "row", 'SUM(A' || CAST(CASE WHEN n_nationkey + 1 >= 10 THEN n_nationkey + 3 ELSE n_nationkey + 1 END AS VARCHAR) || ':A32)+Other!A30+"A30"' AS formula FROM nation""")
def edit_formulas(spark, sf_dir):
    """Formulas follow inserted rows; those of other sheets, strings and names don't."""
    t = table(spark, sf_dir, "nation").select(F.lit("S").alias("sheet"), F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), F.concat(F.lit("SUM(A"), (F.col("n_nationkey") + 1).cast("string"), F.lit(':A30)+Other!A30+"A30"')).alias("formula"))
    return edits.insert_rows(t, 10, 2, sheet="S").select("row", "formula")


@query("""SELECT coalesce(o.o_orderkey, e.k) AS o_orderkey, coalesce(e.v, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN
 (SELECT o_orderkey * 2 AS k, CAST(0 AS DOUBLE) AS v FROM orders WHERE o_orderkey % 7 = 0) e ON o.o_orderkey = e.k""")
def upsert_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    e = o.filter("o_orderkey % 7 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"))
    return edits.set_cells(o, e, keys=["o_orderkey"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN c_acctbal ELSE c_acctbal END AS value, CASE WHEN c_custkey % 5 = 1 THEN 'bold' WHEN c_custkey % 5 = 2 THEN NULL ELSE 'plain' END AS style
 FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 5 <> 2 UNION ALL SELECT c_custkey, -1.0, NULL FROM customer WHERE c_custkey % 5 = 2""")
def edit_clear_and_keep(spark, sf_dir):
    """An edit to null clears the cell, a change of style alone keeps the value, and the last edit of a cell counts."""
    t = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("value"), F.lit("plain").alias("style"))
    key = F.col("c_custkey") % 5
    e = t.filter(key < 3).select(
        "c_custkey", F.when(key == 2, -1.0).alias("value"), F.when(key == 1, "bold").alias("style"), (key == 1).alias("style_only"), F.lit(1).alias("place"))
    stale = e.filter(F.col("c_custkey") % 5 == 2).withColumn("value", F.lit(7.0)).withColumn("place", F.lit(0))
    return edits.set_cells(t, e.unionByName(stale), keys=["c_custkey"], keep="style_only", order="place")


@query("""SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 25 AS k, r_name AS name FROM region""")
def append_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("k"), F.col("r_name").alias("name"))
    return edits.append_rows(n, r, row_col="k")


_SHEETS = "SELECT n_name AS sheet, n_nationkey AS position, CASE WHEN n_nationkey % 4 = 1 THEN 'hidden' ELSE 'visible' END AS state FROM nation"


def _catalog(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("sheet"), k.alias("position"), F.when(k % 4 == 1, "hidden").otherwise("visible").alias("state"))


@query(f"""{_SHEETS} UNION ALL SELECT 'Summary', max(n_nationkey) + 1, 'visible' FROM nation""")
def add_sheet(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    cells = _nation_cells(spark, sf_dir).withColumn("sheet", F.lit("S"))
    return edits.add_sheet(c, cells, "Summary", cells.drop("sheet"))[0]


@query("""SELECT n_name AS sheet, CASE WHEN n_nationkey % 2 = 0 THEN '#REF!*2' ELSE n_name || '!A1*2' END AS formula FROM nation WHERE n_nationkey <> 3""")
def delete_sheet(spark, sf_dir):
    """Formulas that name the sheet that goes get #REF!."""
    c = _catalog(spark, sf_dir)
    gone = c.filter("position = 3").first()["sheet"]
    cells = c.select("sheet", F.when(F.col("position") % 2 == 0, f"{gone}!A1*2").otherwise(F.concat("sheet", F.lit("!A1*2"))).alias("formula"))
    names = c.select(F.col("sheet").alias("name"), F.col("sheet").alias("scope"), F.lit("A1").alias("formula"))
    return edits.delete_sheet(c, cells, names, gone)[1]


@query(f"""SELECT sheet, position FROM ({_SHEETS}) WHERE state = 'visible'""")
def visible_sheets(spark, sf_dir):
    return shaping.visible(_catalog(spark, sf_dir)).select("sheet", "position")


@query("""SELECT n_nationkey AS "row", n_name AS value FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation)""")
def first_sheet(spark, sf_dir):
    """Without a name, the first sheet in tab order is read."""
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("sheet"), F.col("n_nationkey").alias("row"), F.col("n_name").alias("value"))
    tabs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("sheet"), F.col("r_regionkey").alias("position"))
    return shaping.pick_sheet(cells, tabs).select("row", "value")


@query("""SELECT p_brand, CAST(coalesce(CASE WHEN p_size > 10 THEN p_size END, 1) AS INT) AS size, CASE WHEN p_size > 10 THEN 'red' ELSE NULL END AS fill, count(*) AS cells FROM part GROUP BY ALL""")
def style_merge(spark, sf_dir):
    """A patch over a style: its properties win, others stay; a fill is replaced as a whole."""
    t = table(spark, sf_dir, "part")
    base = F.struct(F.lit(1).alias("size"), F.col("p_brand").alias("font"), F.lit(None).cast("string").alias("fill"))
    patch = F.struct(F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), F.lit(None).cast("string").alias("font"), F.when(F.col("p_size") > 10, "red").alias("fill"))
    s = t.select(edits.merge_styles(base, patch, ["size", "font"], ("fill",)).alias("s"))
    return s.groupBy(F.col("s.font").alias("p_brand"), F.col("s.size").alias("size"), F.col("s.fill").alias("fill")).agg(F.count(F.lit(1)).alias("cells"))


@query("""SELECT s_suppkey AS "table", col, header FROM (SELECT s_suppkey, 1 AS col, 'Name' AS header FROM supplier UNION ALL SELECT s_suppkey, 2, 'Column1' FROM supplier UNION ALL SELECT s_suppkey, 3, 'Column3' FROM supplier UNION ALL SELECT s_suppkey, 4, 'Total' FROM supplier)""")
def edit_table_columns(spark, sf_dir):
    """A column inserted inside a table gets a header that is not taken."""
    heads = F.array(*[F.struct(F.lit(k).alias("col"), F.lit(n).alias("header")) for k, n in ((1, "Name"), (2, "Column1"), (3, "Total"))])
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("table"), F.explode(heads).alias("h")).select("table", "h.col", "h.header")
    return edits.shift_table_columns(t, Axis(((3, 1, True),)))


# -- shapes


@query("""SELECT n_nationkey AS row, 0 AS col, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 1, n_name FROM nation UNION ALL SELECT n_nationkey, 2, CAST(n_regionkey AS VARCHAR) FROM nation""")
def sheet_cells_long(spark, sf_dir):
    return _nation_cells(spark, sf_dir)


@query("""SELECT n_nationkey AS "row", CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CAST(n_regionkey AS VARCHAR) AS c FROM nation""")
def rows_wide(spark, sf_dir):
    rows = shaping.to_rows(_nation_cells(spark, sf_dir))
    return rows.select("row", *[F.col("cells")[k].alias(name) for k, name in enumerate("abc")])


@query("""SELECT n_nationkey + 3 AS "row", CAST(n_nationkey AS VARCHAR) AS Name, n_name AS Name_2, CAST(n_regionkey AS VARCHAR) AS Column3, CASE WHEN n_nationkey > 20 THEN 'late' END AS Column4 FROM nation""")
def header_promote(spark, sf_dir):
    """Repeated and blank headers, and a column that only later rows have."""
    body = _nation_cells(spark, sf_dir).withColumn("row", F.col("row") + 3)
    head = spark.createDataFrame([(2, 0, "Name"), (2, 1, "Name")], "row int, col int, value string")
    late = body.filter("col = 0 and row > 23").select("row", F.lit(3).alias("col"), F.lit("late").alias("value"))
    return shaping.promote_header(body.unionByName(head).unionByName(late))


@query("""SELECT o_orderkey, array_to_string(CASE WHEN o_custkey % 3 = 0 THEN [o_orderstatus] ELSE [o_orderstatus, coalesce(CASE WHEN o_custkey % 3 = 1 THEN 'x' END, '-'), 'y'] END, '|') AS trimmed FROM orders""")
def trim_nulls(spark, sf_dir):
    third = F.col("o_custkey") % 3
    cells = F.array(F.col("o_orderstatus"), F.when(third == 1, "x"), F.when(third != 0, "y"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(shaping.trim_nulls(cells), "|", "-").alias("trimmed"))


@query("""SELECT g AS "row" FROM (SELECT unnest(generate_series((SELECT min(o_orderkey) FROM orders WHERE o_custkey % 4 = 0), (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 4 = 0))) AS g)
 WHERE g NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0)""")
def gap_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("row"))
    return shaping.gap_rows(rows, block=1000)


@query("""SELECT event_id, CAST(CASE WHEN event_id % 10 = 0 THEN event_id * 2 WHEN event_id < 10 THEN event_id + 1 ELSE (event_id - event_id % 10) * 2 + event_id % 10 END AS INT) AS "row" FROM (SELECT event_id - (SELECT min(event_id) FROM events) AS event_id FROM events WHERE user_id IS NOT NULL)
 WHERE event_id > 0 AND event_id < 1000 AND event_id % 10 <> 0 OR event_id % 10 = 0 AND event_id > 0 AND event_id < 1000""")
def row_numbers(spark, sf_dir):
    """Rows without a number follow the last one that has one; rubbish is no number."""
    t = table(spark, sf_dir, "events")
    first = t.agg(F.min("event_id").alias("m")).first()["m"]
    t = t.select((F.col("event_id") - first).alias("event_id")).filter("event_id < 1000")
    given = F.when((F.col("event_id") % 10 == 0) & (F.col("event_id") > 0), (F.col("event_id") * 2).cast("string")).otherwise("x")
    return shaping.number_rows(t.withColumn("r", given), "event_id", "r").filter("event_id > 0").select("event_id", "row")


@query("""SELECT p_partkey, unnest(range(1, p_size % 4 + 1)) AS copy FROM part""")
def repeat_expansion(spark, sf_dir):
    t = table(spark, sf_dir, "part").withColumn("_n", F.col("p_size").cast("long") % 4)
    return shaping.expand_repeats(t, "_n", "copy").select("p_partkey", "copy")


@query("""SELECT source, COUNT(*) FILTER (WHERE text IS NOT NULL AND text <> '') AS filled, COUNT(*) AS cells FROM documents GROUP BY 1""")
def cell_counts(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    return t.groupBy("source").agg(F.count_if(shaping.filled(F.col("text"))).alias("filled"), F.count(F.lit(1)).alias("cells"))


@query("""SELECT lang, COUNT(*) FILTER (WHERE coalesce(text, '') <> '' OR coalesce(source, '') <> '') AS "rows", CAST(COALESCE(SUM(CAST(coalesce(text, '') <> '' AS INT) + CAST(coalesce(source, '') <> '' AS INT)), 0) AS BIGINT) AS cells FROM documents GROUP BY 1""")
def row_counts(spark, sf_dir):
    return shaping.count_filled(table(spark, sf_dir, "documents"), ["text", "source"], by=["lang"])


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 200""")
def preview_rows(spark, sf_dir):
    return shaping.preview(table(spark, sf_dir, "orders"), 200, "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey <= 200""")
def preview_first_n(spark, sf_dir):
    """Of rows numbered from 0 or 1: those up to 200."""
    return table(spark, sf_dir, "orders").filter("o_orderkey <= 200").select("o_orderkey", "o_orderpriority")


@query("""SELECT p_partkey, p_brand || ' ' || coalesce(CASE WHEN p_size > 5 THEN p_type END, '') AS text FROM part""")
def rich_text(spark, sf_dir):
    runs = F.array(*[F.struct(c.alias("text"), F.lit(b).alias("bold")) for c, b in ((F.concat("p_brand", F.lit(" ")), True), (F.when(F.col("p_size") > 5, F.col("p_type")), False))])
    return table(spark, sf_dir, "part").select("p_partkey", shaping.plain_text(runs).alias("text"))


@query("""SELECT n_nationkey AS "row", CAST(to_json({'key': n_nationkey, 'name': n_name}) AS VARCHAR) AS record FROM nation""")
def json_records(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return shaping.records(t)


@query("""SELECT n_nationkey AS "row", CAST(n_nationkey AS VARCHAR) || ',' || CASE WHEN regexp_matches(n_name, '[,"\\n\\r]') THEN '"' || replace(n_name, '"', '""') || '"' ELSE n_name END || ',' || CAST(n_regionkey AS VARCHAR) AS line FROM nation""")
def csv_line_export(spark, sf_dir):
    t = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "row").withColumn("k", F.col("row"))
    return shaping.csv_lines(t, ["k", "n_name", "n_regionkey"])


@query("""SELECT o_orderkey AS "row", CASE WHEN o_custkey % 6 = 0 THEN CAST(o_orderkey AS VARCHAR) || ';' || o_orderpriority ELSE '' END AS line FROM orders
 WHERE o_orderkey BETWEEN (SELECT min(o_orderkey) FROM orders WHERE o_custkey % 6 = 0) AND (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 6 = 0)""")
def csv_gap_lines(spark, sf_dir):
    t = table(spark, sf_dir, "orders").filter("o_custkey % 6 = 0").select(F.col("o_orderkey").alias("row"), F.col("o_orderkey").alias("k"), "o_orderpriority")
    return shaping.csv_lines(t, ["k", "o_orderpriority"], delimiter=";")


@query("""SELECT 'p_name' AS name, CAST(LEAST(255, GREATEST(10, MAX(length(p_name)) * 1.2)) AS DOUBLE) AS width FROM part""")
def autofit_width(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.lit("p_name").alias("name"), F.col("p_name").alias("value"))
    return shaping.column_widths(t, by="name")


@query("""SELECT col, CAST(LEAST(255, GREATEST(10, round(MAX(length(value)) * 1.2, 2))) AS DOUBLE) AS width FROM (SELECT 0 AS col, p_name AS value FROM part UNION ALL SELECT 1, p_brand FROM part UNION ALL SELECT 2, p_type FROM part) GROUP BY 1""")
def autofit_columns(spark, sf_dir):
    return shaping.column_widths(shaping.to_cells(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"]))


# -- references and ranges


@query("""SELECT n, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters
 FROM (SELECT DISTINCT p_partkey % 16384 + 1 AS n FROM part)""")
def col_letter(spark, sf_dir):
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") % 16384 + 1).alias("n")).distinct()
    return n.select("n", letters_of(F.col("n")).alias("letters"))


@query("""SELECT n_nationkey, (ascii(upper(n_name)) - 64) * 26 + ascii(upper(substr(n_name, 2))) - 64 - 1 AS col FROM nation""")
def col_index(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", (number_of(F.substring("n_name", 1, 2)) - 1).cast("int").alias("col"))


@query("""SELECT n_nationkey, CAST(list_reduce(list_prepend(0, [ascii(c) - 64 FOR c IN regexp_extract_all(upper(left(n_name, 6)), '[A-Z]')]), lambda a, b: a * 26 + b) AS BIGINT) AS number FROM nation WHERE regexp_full_match(left(n_name, 6), '[A-Za-z]+')""")
def col_number(spark, sf_dir):
    """All letters of a name of up to six; null where one is no letter."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", number_of(F.substring("n_name", 1, 6)).alias("number"))
    return t.filter("number is not null")


_BOXES_SQL = """(SELECT event_id AS id, user_id % 3 AS col, event_id AS "first", event_id + event_id % 5 AS "last" FROM events)"""


def _boxes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id AS r1", "user_id % 3 AS c1", "event_id + event_id % 5 AS r2", "user_id % 3 AS c2")


@query(f"""SELECT a.id AS a, b.id AS b FROM {_BOXES_SQL} a JOIN {_BOXES_SQL} b ON a.col = b.col AND a."first" <= b."last" AND b."first" <= a."last" AND a.id < b.id""")
def range_overlap(spark, sf_dir):
    return ranges.overlaps(_boxes(spark, sf_dir), bucket=8)


@query(f"""SELECT "row", col, COUNT(*) AS boxes FROM (SELECT col, unnest(generate_series("first", "last")) AS "row" FROM {_BOXES_SQL}) GROUP BY ALL""")
def merge_cover(spark, sf_dir):
    return ranges.covered(_boxes(spark, sf_dir)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("boxes"))


@query("""SELECT o_orderkey, c.p_partkey AS merge, c.p_partkey * 20 = o_orderkey AS anchor FROM orders LEFT JOIN part c ON o_orderkey >= c.p_partkey * 20 AND o_orderkey <= c.p_partkey * 20 + c.p_size % 4""")
def merge_marks(spark, sf_dir):
    """Each cell with the merge that it lies in."""
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.lit(1).alias("col"))
    merges = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey * 20 AS r1", "1 AS c1", "p_partkey * 20 + p_size % 4 AS r2", "1 AS c2")
    return ranges.mark_merged(cells, merges).select(F.col("row").alias("o_orderkey"), "merge", "anchor")


@query("""SELECT p_partkey, least(p_partkey % 900 + 1, p_size) AS r1, greatest(p_partkey % 900 + 1, p_size) AS r2, 2 AS c1, 28 AS c2 FROM part""")
def range_parse(spark, sf_dir):
    """Corners in any order, with dollars or without."""
    text = F.concat(F.lit("$AB$"), (F.col("p_partkey") % 900 + 1).cast("string"), F.lit(":b"), F.col("p_size").cast("string"))
    t = table(spark, sf_dir, "part").select("p_partkey", ranges.parse_box(text).alias("b"))
    return t.select("p_partkey", "b.r1", "b.r2", F.col("b.c1").cast("int").alias("c1"), F.col("b.c2").cast("int").alias("c2"))


@query(f"""SELECT id, a, b FROM (SELECT id, CASE WHEN x < 200 THEN x ELSE greatest(200, x - 10) END AS a, CASE WHEN y < 200 THEN y WHEN y >= 210 THEN y - 10 ELSE 199 END AS b
 FROM (SELECT id, "first" + CASE WHEN "first" >= 100 THEN 5 ELSE 0 END AS x, "last" + CASE WHEN "last" >= 100 THEN 5 ELSE 0 END AS y FROM {_BOXES_SQL})) WHERE a <= b""")
def shift_ranges(spark, sf_dir):
    """Five rows inserted at 100, then ten deleted from 200 on."""
    moved = edits.shift_boxes(_boxes(spark, sf_dir), rows=Axis(((100, 5, True), (200, 10, False))))
    return moved.select("id", F.col("r1").alias("a"), F.col("r2").alias("b"))


# -- dictionaries


@query("""SELECT o_orderpriority AS str, ROW_NUMBER() OVER (ORDER BY MIN(o_orderkey)) - 1 AS id, COUNT(*) AS refs FROM orders GROUP BY 1""")
def shared_strings(spark, sf_dir):
    return catalog.shared_strings(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("""WITH d AS (SELECT c_name AS str, ROW_NUMBER() OVER (ORDER BY MIN(c_custkey), c_name) - 1 AS id FROM customer GROUP BY 1)
SELECT o_orderkey, d.str AS name FROM orders LEFT JOIN d ON o_custkey = d.id""")
def string_lookup(spark, sf_dir):
    """Cells that hold an index get its text; an index that is not there gives null."""
    strings = catalog.shared_strings(table(spark, sf_dir, "customer"), "c_name", "c_custkey")
    return catalog.look_up(table(spark, sf_dir, "orders"), "o_custkey", strings, "id", "str", "name").select("o_orderkey", "name")


@query("""SELECT p_brand, p_type, ROW_NUMBER() OVER (ORDER BY p_brand, p_type) - 1 AS id, COUNT(*) AS cells FROM part GROUP BY 1, 2""")
def style_dedupe(spark, sf_dir):
    return catalog.distinct_styles(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("""SELECT o_custkey AS sheet, max(o_orderkey) AS last_row FROM orders GROUP BY 1""")
def last_rows(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row"))
    return catalog.last_row(t, ["sheet"])


@query("""SELECT o_orderkey AS "row", o_orderstatus || ';' || format('{:,.2f}', o_totalprice) || ';' || strftime(o_orderdate, '%d.%m.%Y') || chr(13) AS line FROM orders""")
def csv_formatted_lines(spark, sf_dir):
    """Lines as a person sees the cells: formatted text, another delimiter, CR and LF at the end."""
    from quadrille.functions.csv_text import csv_line
    from quadrille.functions.dates import serial_column
    from quadrille.functions.number_format import format_column

    shown = [F.col("o_orderstatus"), format_column(F.col("o_totalprice"), "#,##0.00"), format_column(serial_column(F.col("o_orderdate")), "dd.mm.yyyy")]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.concat(csv_line(shown, ";"), F.lit("\r")).alias("line"))


@query("""SELECT a.s_suppkey AS comment, n_name AS author FROM supplier a LEFT JOIN nation ON s_nationkey = n_nationkey""")
def author_lookup(spark, sf_dir):
    """Comments name their author by number."""
    comments = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("comment"), "s_nationkey")
    return catalog.look_up(comments, "s_nationkey", table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "author").select("comment", "author")


@query("""SELECT source, CASE WHEN n > 0 THEN ';' ELSE ',' END AS delimiter FROM (SELECT source, 1 AS n FROM documents GROUP BY 1)""")
def delimiter_sniff(spark, sf_dir):
    """The most frequent candidate outside quotes on the first line."""
    from quadrille.functions.csv_text import delimiter_of

    lines = table(spark, sf_dir, "documents").select("source", F.lit('"a,b,c,d";x;y\n1,2,3,4,5').alias("text")).distinct()
    return lines.select("source", delimiter_of(F.col("text")).alias("delimiter"))
