"""Queries of number formats, dates, text, colours and hashes, through quadrille.functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import dates, text
from quadrille.functions.csv_text import quote, typed_number
from quadrille.functions.number_format import BUILTIN, format_column
from quadrille.plans.registry import query, table


@query("""SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), quote(F.col("text"))).alias("field"))


@query("""SELECT event_id, CASE WHEN regexp_full_match(event_type, '-?(0|[1-9][0-9]*)') THEN TRY_CAST(event_type AS DOUBLE) END AS typed FROM events""")
def csv_field_typing(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", typed_number(F.col("event_type")).alias("typed"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS whole, CASE WHEN event_id % 10 < 3 THEN NULL ELSE event_id / 8.0::DOUBLE END AS part, CAST(event_id % 7 AS DOUBLE) / 100 AS power FROM events""")
def csv_number_typing(spark, sf_dir):
    """Whole numbers, decimals, exponents; leading zeros, signs and blanks are no numbers."""
    t = table(spark, sf_dir, "events")
    k, tenth = F.col("event_id").cast("string"), F.col("event_id") % 10
    eighth = (F.col("event_id").cast("decimal(20,3)") / 8).cast("decimal(20,3)").cast("string")
    odd = F.when(tenth == 0, F.concat(F.lit("007"), k)).when(tenth == 1, F.concat(F.lit("+"), k)).when(tenth == 2, F.concat(F.lit(" "), k)).otherwise(eighth)
    power = F.concat((F.col("event_id") % 7).cast("string"), F.lit("e-2"))
    return t.select("event_id", typed_number(F.get_json_object("props", "$.k")).alias("whole"), typed_number(odd).alias("part"), typed_number(power).alias("power"))


@query("""SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial FROM orders""")
def serial_from_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.serial_column(F.col("o_orderdate")).cast("long").alias("serial"))


@query("""SELECT event_id, date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) + CAST(round(1000 * (epoch(ts) - epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)))) AS BIGINT) / 86400000.0::DOUBLE AS serial,
 date_diff('day', DATE '1904-01-01', CAST(ts AS DATE)) AS day_1904 FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def serial_from_time(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return t.select("event_id", dates.serial_column(F.col("ts")).alias("serial"), F.floor(dates.serial_column(F.col("ts"), True)).cast("long").alias("day_1904"))


@query("""SELECT p_partkey, DATE '1899-12-30' + CAST(p_partkey - 1 + CASE WHEN p_partkey - 1 BETWEEN 1 AND 60 THEN 1 ELSE 0 END AS INT) AS day, DATE '1904-01-01' + CAST(p_partkey - 1 AS INT) AS day_1904 FROM part""")
def date_from_low_serial(spark, sf_dir):
    """Serials from 0 on: 1 to 60 are a day later, for the 29 February that 1900 did not have."""
    serial = (F.col("p_partkey") - 1).cast("double")
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", dates.date_column(serial).cast("date").alias("day"), dates.date_column(serial, True).cast("date").alias("day_1904"))


@query("""SELECT p_partkey, DATE '1899-12-30' + CAST(p_partkey + CASE WHEN p_partkey = 0 THEN 61 ELSE 60 END AS INT) AS day FROM part""")
def date_from_serial(spark, sf_dir):
    serial = (F.col("p_partkey") + 60).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", dates.date_column(serial).cast("date").alias("day"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def date_iso(spark, sf_dir):
    """Serials as ISO text, and ISO cells without a zone as UTC."""
    t = table(spark, sf_dir, "orders")
    iso = dates.iso_column(dates.date_column(dates.serial_column(F.col("o_orderdate"))))
    return t.select("o_orderkey", iso.alias("iso"), F.date_format(dates.iso_cell(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd").alias("day"))


@query("""SELECT p_partkey, p_size + (p_partkey % 24 * 3600 + p_partkey % 60 * 60) / 86400.0::DOUBLE AS days, CASE WHEN p_partkey % 24 = 0 AND p_partkey % 60 = 0 THEN 'yyyy-mm-dd' ELSE 'yyyy-mm-dd hh:mm:ss' END AS format FROM part""")
def date_durations(spark, sf_dir):
    d = F.concat(F.lit("P"), F.col("p_size").cast("string"), F.lit("DT"), (F.col("p_partkey") % 24).cast("string"), F.lit("H"), (F.col("p_partkey") % 60).cast("string"), F.lit("M0S"))
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", dates.duration_column(d).alias("days"), dates.default_date_format(dates.date_column(dates.duration_column(d) + 40000)).alias("format"))


@query("""SELECT * FROM (VALUES ('yyyy-mm-dd', TRUE), ('0.00', FALSE), ('"day" 0', FALSE), ('[Red]0.0', FALSE), ('[h]:mm', TRUE), ('d/m', TRUE), ('#,##0 \\d', FALSE), ('General', FALSE), ('ss.0', TRUE), ('0_d', FALSE)) AS t(code, is_date)""")
def date_codes(spark, sf_dir):
    codes = ["yyyy-mm-dd", "0.00", '"day" 0', "[Red]0.0", "[h]:mm", "d/m", "#,##0 \\d", "General", "ss.0", "0_d"]
    return spark.createDataFrame([(c, dates.is_date_format(c)) for c in codes], "code string, is_date boolean")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders""")
def numfmt_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", format_column(dates.serial_column(F.col("o_orderdate")), "yyyy-mm-dd").alias("shown"))


@query("""SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS stamp, strftime(ts, '%A, %B %-d') AS long, strftime(ts, '%-I:%M %p') AS clock,
 CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS VARCHAR) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS elapsed FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)""")
def numfmt_times(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", dates.serial_column(F.date_trunc("minute", "ts")).alias("x"))
    of = lambda code, x=F.col("x"): format_column(x, code)
    return t.select("event_id", of("dd/mm/yyyy hh:mm:ss").alias("stamp"), of("dddd, mmmm d").alias("long"), of("h:mm AM/PM").alias("clock"), of("[h]:mm", F.col("x") - 43831).alias("elapsed"))


@query("""SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS shown FROM lineitem""")
def numfmt_thousands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", format_column(F.col("l_extendedprice"), "#,##0.00").alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) || '%' AS shown FROM lineitem""")
def numfmt_percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", format_column(F.col("l_discount"), "0%").alias("shown"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', -c_acctbal) || ')' WHEN c_acctbal = 0 THEN 'none' ELSE format('{:,.2f}', c_acctbal) || ' ' END AS sections,
 CASE WHEN c_acctbal >= 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'debt' ELSE 'some' END AS conditions, CASE WHEN c_custkey < 1000 THEN 'no ' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE 'no ' || CAST(c_custkey AS VARCHAR) END AS padded FROM customer""")
def numfmt_sections(spark, sf_dir):
    of = lambda c, code: format_column(F.col(c), code)
    return table(spark, sf_dir, "customer").select("c_custkey", of("c_acctbal", '#,##0.00_);(#,##0.00);"none"').alias("sections"), of("c_acctbal", '[>=5000]"rich";[<0]"debt";"some"').alias("conditions"), of("c_custkey", '"no "0000').alias("padded"))


@query("""WITH t AS (SELECT p_partkey, CAST(p_partkey * 12 + 340 AS VARCHAR) AS n FROM part), u AS (SELECT *, length(n) - 1 AS e FROM t)
SELECT p_partkey, CAST(CAST(floor(CAST(n AS DOUBLE) / pow(10, e - 2) + 0.5) AS INT) / 100.0 AS DECIMAL(6,2)) AS m, CAST(e AS VARCHAR) AS e FROM u WHERE CAST(n AS DOUBLE) < 9.99 * pow(10, e)""")
def numfmt_scientific(spark, sf_dir):
    shown = format_column(F.col("p_partkey") * 12 + 340, "0.00E+0")
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 12 + 340).alias("n"), shown.alias("shown"))
    small = F.col("n") < 9.99 * F.pow(F.lit(10.0), F.length(F.col("n").cast("string")) - 1)
    return t.filter(small).select("p_partkey", F.substring_index("shown", "E", 1).cast("decimal(6,2)").alias("m"), F.substring_index("shown", "E+", -1).alias("e"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k % 8 = 0 THEN CAST(k // 8 AS VARCHAR) || '    ' ELSE CASE WHEN k >= 8 THEN CAST(k // 8 AS VARCHAR) ELSE '' END || ' ' || CAST(k % 8 AS VARCHAR) || '/8' END AS eighths FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS k FROM lineitem)""")
def numfmt_fraction(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", format_column(F.col("l_quantity") / 8, "# ?/8").alias("eighths"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS whole, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS half, 'Part: ' || p_name AS named, CAST(p_size AS VARCHAR) || 'k' AS scaled FROM part""")
def numfmt_general(spark, sf_dir):
    of = lambda c, code, kind="n": format_column(c, code, kind)
    return table(spark, sf_dir, "part").select("p_partkey", of(F.col("p_size"), "General").alias("whole"), of(F.col("p_size") / 2, "").alias("half"), of(F.col("p_name"), '"Part: "@', "s").alias("named"), of(F.col("p_size") * 1000, '0,"k"').alias("scaled"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS id1, CAST(p_size AS VARCHAR) || '.00' AS id2, CAST(p_size * 100 AS VARCHAR) || '%' AS id9, strftime(DATE '2020-01-01' + p_size, '%-d-%b-%y') AS id15 FROM part""")
def numfmt_builtin(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", format_column(size, BUILTIN[1]).alias("id1"), format_column(size, BUILTIN[2]).alias("id2"), format_column(size, BUILTIN[9]).alias("id9"), format_column(size + 43831, BUILTIN[15]).alias("id15"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml, text AS back FROM documents""")
def xml_text(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.escape_xml(F.col("text")).alias("xml"))
    return t.select("doc_id", "xml", text.unescape_xml(F.col("xml")).alias("back"))


@query("""SELECT n_nationkey, n_name || '_x0009_' || chr(9) || '_' AS kept, n_name || chr(10) || '_x005F_x0041_' AS coded FROM nation""")
def xml_escapes(spark, sf_dir):
    raw = F.concat("n_name", F.lit("_x0009_\t_"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.decode_escapes(text.encode_escapes(raw)).alias("kept"), text.encode_escapes(F.concat("n_name", F.lit("\n_x0041_"))).alias("coded"))


@query("""SELECT p_partkey, 'FF' || lpad(upper(to_hex(p_partkey % 4096)), 6, '0') AS argb, p_partkey % 2 = 0 AS ok FROM part""")
def color_norm(spark, sf_dir):
    c = F.lower(F.lpad(F.hex(F.col("p_partkey") % 4096), 6, "0"))
    odd = F.when(F.col("p_partkey") % 2 == 0, c).otherwise("12345")
    return table(spark, sf_dir, "part").select("p_partkey", text.argb(F.concat(F.lit("#"), c)).alias("argb"), text.argb(odd).isNotNull().alias("ok"))


@query("""SELECT n_nationkey, 'FF' || CASE n_regionkey % 3 WHEN 0 THEN '4472C4' WHEN 1 THEN '808080' ELSE 'FF8080' END AS color FROM nation""")
def color_resolve(spark, sf_dir):
    """Theme slots, the palette, and tints of grey and red: half as far from white."""
    third = F.col("n_regionkey") % 3
    c = text.resolve_color(F.when(third == 2, "FF0000"), F.when(third == 0, 1), F.when(third == 1, 0), F.when(third == 2, 0.5).otherwise(0.0), ["FFFFFF", "4472C4"], ["808080"])
    return table(spark, sf_dir, "nation").select("n_nationkey", c.alias("color"))


@query("""WITH RECURSIVE w AS (SELECT n_name AS p, length(n_name) AS k, 0 AS h FROM nation UNION ALL SELECT p, k - 1, ((xor(h, ascii(substr(p, k, 1))) << 1) & 32767) | ((xor(h, ascii(substr(p, k, 1))) >> 14) & 1) FROM w WHERE k > 0)
SELECT p AS password, lpad(to_hex(xor(xor(h, length(p)), 52811)), 4, '0') AS hash FROM w WHERE k = 0""")
def sheet_password(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("password"), text.sheet_password(F.col("n_name")).alias("hash"))


@query("""SELECT * FROM (VALUES ('png', 300, 20), ('gif', 258, 3), ('jpeg', NULL, NULL), (NULL, NULL, NULL)) AS t(kind, width, height)""")
def image_sizes(spark, sf_dir):
    heads = [b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\1\x2c\0\0\0\x14", b"GIF89a\x02\x01\x03\0", b"\xff\xd8\xff\xe0", b"text"]
    t = spark.createDataFrame([(bytearray(h),) for h in heads], "content binary").select(text.image_size(F.col("content")).alias("s"))
    return t.select("s.kind", "s.width", "s.height")


@query("""SELECT p_partkey, greatest(0, round((p_size / 2.54 * 96 - 5) / 7, 2)) AS cm, greatest(0, round((p_size - 5) / 7.0::DOUBLE, 2)) AS px FROM part""")
def odf_widths(spark, sf_dir):
    of = lambda unit: text.characters_of(F.concat(F.col("p_size").cast("string"), F.lit(unit)))
    return table(spark, sf_dir, "part").select("p_partkey", of("cm").alias("cm"), of("px").alias("px"))


@query("""SELECT * FROM (VALUES ('Rate', TRUE), ('A1', FALSE), ('R1C1', FALSE), ('_x.y', TRUE), ('9a', FALSE), ('_xlnm.Print', FALSE), ('', FALSE)) AS t(name, ok)""")
def name_rules(spark, sf_dir):
    t = spark.createDataFrame([(n,) for n in ("Rate", "A1", "R1C1", "_x.y", "9a", "_xlnm.Print", "")], "name string")
    return t.select("name", text.valid_name(F.col("name")).alias("ok"))


@query("""SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g')) AS INT) AS units FROM documents""")
def cell_text_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_units(F.col("text")).cast("int").alias("units"))
