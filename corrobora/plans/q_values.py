"""Queries over typed values: each reads values out of table texts and counts what was found."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import values as vs
from . import views
from .catalog import query


def _counted(frame: DataFrame, *keys) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _pick(no: Column, options: list[Column]) -> Column:
    return F.element_at(F.array(*options), (no % len(options) + 1).cast("int"))


_ONES = [w for w, n in fixed.UNIT_WORDS.items() if n < 20]
_TENS = {n: w for w, n in fixed.UNIT_WORDS.items() if n >= 20}


def _spelled(n: Column) -> Column:
    """0..99 in words."""
    small = F.element_at(F.array(*[F.lit(w) for w in _ONES]), (n % 100 + 1).cast("int"))
    ten = F.element_at(F.array(*[F.lit(_TENS[k]) for k in sorted(_TENS)]), (F.floor(n / 10) - 1).cast("int"))
    return F.when(n < 20, small).otherwise(F.concat(ten, F.when(n % 10 == 0, "").otherwise(
        F.concat(F.lit("-"), F.element_at(F.array(*[F.lit(w) for w in _ONES]), (n % 10 + 1).cast("int"))))))


@query("nrm_number", """SELECT CAST(CASE p_partkey % 6 WHEN 3 THEN p_size + 2000 WHEN 4 THEN p_size * 100 WHEN 5 THEN NULL ELSE p_size END AS VARCHAR) AS number, count(*) AS n FROM part GROUP BY 1""")
def nrm_number(spark, sf):
    size = F.col("p_size")
    text = _pick(F.col("p_partkey"), [
        size.cast("string"), _spelled(size), F.concat(F.upper(_spelled(size)), F.lit(" ( "), size.cast("string"), F.lit(".00)")),
        F.concat(F.lit("two thousand "), _spelled(size)), F.concat(_spelled(size), F.lit(" hundred")), F.concat(_spelled(size), F.lit(" or so"))])
    return _counted(views.table(spark, sf, "part"), vs.number(text).alias("number"))


@query("nrm_number_text", """SELECT o_orderstatus, rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS number, count(*) AS n FROM orders GROUP BY ALL""")
def nrm_number_text(spark, sf):
    text = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    return _counted(views.table(spark, sf, "orders"), "o_orderstatus", vs.number_text(text).alias("number"))


@query("nrm_singular", r"""SELECT CASE WHEN length(w) > 3 AND regexp_matches(w, '[^s]s$') THEN left(w, length(w) - 1) ELSE w END AS word, count(*) AS n
FROM (SELECT lower(w) || CASE WHEN p_partkey % 3 = 0 THEN 's' WHEN p_partkey % 3 = 1 THEN 'ss' ELSE '' END AS w FROM part, unnest(string_split(p_name || ' a', ' ')) AS u(w)) GROUP BY 1""")
def nrm_singular(spark, sf):
    p = views.table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit(" a")), " ")).alias("w"))
    return _counted(p, vs.singular(F.concat(F.upper("w"), _pick(F.col("p_partkey"), [F.lit("s"), F.lit("ss"), F.lit("")]))).alias("word"))


@query("nrm_quantity", f"""WITH {views.CLAIMS_SQL}, found AS (
  SELECT document_id, CAST(regexp_extract(x, '^net\\s+(\\d+)', 1) AS BIGINT) AS q, 'day' AS unit FROM (SELECT document_id, unnest(regexp_extract_all(text, 'net\\s+\\d+')) AS x FROM v4)
  UNION ALL SELECT document_id, CAST(replace(q, ',', '') AS DOUBLE), w FROM (SELECT document_id, unnest(regexp_extract_all(text, '(^|[^a-zA-Z0-9_.])(\\d[\\d,]*(\\.\\d+)?)(\\s*-?\\s*([A-Za-z]+))?(\\s+([A-Za-z]+))?', 2)) AS q,
    unnest(regexp_extract_all(text, '(^|[^a-zA-Z0-9_.])(\\d[\\d,]*(\\.\\d+)?)(\\s*-?\\s*([A-Za-z]+))?(\\s+([A-Za-z]+))?', 5)) AS w FROM v4)),
units AS (SELECT document_id, CASE WHEN unit = 'weeks' THEN q * 7 ELSE q END AS q, CASE WHEN unit = 'weeks' THEN 'day' WHEN length(unit) > 3 AND right(unit, 1) = 's' THEN left(unit, length(unit) - 1) ELSE lower(coalesce(unit, '')) END AS unit FROM found)
SELECT regexp_replace(regexp_replace(CAST(CAST(q AS DECIMAL(18, 4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS num, unit, count(*) AS statements, count(DISTINCT document_id) AS documents FROM units GROUP BY ALL""")
def nrm_quantity(spark, sf):
    said = views.claim_table(spark, sf, "v4").groupBy("document_id", "text").agg(F.count(F.lit(1)).alias("n"))  # equal texts of a document are read once
    c = said.select("document_id", "n", F.explode(vs.quantities(F.col("text"))).alias("q"))
    return c.groupBy("q.num", "q.unit").agg(F.sum("n").alias("statements"), F.countDistinct("document_id").alias("documents"))


_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


@query("nrm_money", f"""SELECT currency, regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS amount, n FROM (
  SELECT ['USD', 'USD', 'EUR', 'INR', 'USD', 'GBP'][o_orderkey % 6 + 1] AS currency,
    CASE o_orderkey % 6 WHEN 3 THEN {_PRICE} * 100000 WHEN 4 THEN {_PRICE} * 1000000 ELSE {_PRICE} END AS amount, count(*) AS n FROM orders GROUP BY ALL)""")
def nrm_money(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    grouped = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    text = _pick(F.col("o_orderkey"), [
        F.concat(F.lit("pay USD "), grouped, F.lit(" now")), F.concat(F.lit("a fee of $"), price), F.concat(grouped, F.lit(" euros in total")),
        F.concat(F.lit("Rs. "), price, F.lit(" lakh")), F.concat(price, F.lit(" million dollars")), F.concat(F.lit("£"), grouped)])
    o = views.table(spark, sf, "orders").select(F.explode(vs.money(text)).alias("m"))
    return _counted(o, F.col("m.currency").alias("currency"), F.col("m.amount").alias("amount"))


@query("nrm_percent", """SELECT CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS percent, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""")
def nrm_percent(spark, sf):
    n = F.round(F.col("l_discount") * 100).cast("int")
    text = _pick(F.col("l_orderkey"), [
        F.concat(n.cast("string"), F.lit("% off")), F.concat(F.lit("about "), n.cast("string"), F.lit(".00 percent")),
        F.concat(_spelled(n), F.lit(" per  cent")), F.concat(_spelled(n), F.lit(" ("), n.cast("string"), F.lit(") % of it"))])
    return _counted(views.table(spark, sf, "lineitem").select("l_returnflag", F.explode(vs.percents(text)).alias("percent")), "percent", "l_returnflag")


@query("nrm_date", """SELECT CASE WHEN o_orderkey % 6 <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, count(*) AS n FROM orders GROUP BY 1""")
def nrm_date(spark, sf):
    f = lambda p: F.date_format("o_orderdate", p)
    text = _pick(F.col("o_orderkey"), [
        F.concat(F.lit("on "), f("yyyy-MM-dd"), F.lit(".")), f("d MMM yyyy"), F.concat(f("d"), F.lit("th "), F.upper(f("MMMM")), F.lit(", "), f("yyyy")),
        f("MMMM d, yyyy"), F.concat(F.lit("due "), f("MMM"), F.lit(". "), f("d"), F.lit("rd, "), f("yyyy")), f("dd/MM/yyyy")])
    return _counted(views.table(spark, sf, "orders"), F.try_element_at(vs.dates(text), F.lit(1)).alias("date"))


@query("nrm_boolean", f"""WITH {views.CLAIMS_SQL} SELECT CASE WHEN text LIKE '%not permitted%' THEN 'no' WHEN text LIKE '%permitted%' THEN 'yes' END AS stated,
  CASE WHEN value IN ('yes', 'no') THEN value END AS claimed, count(*) AS n FROM v4 GROUP BY ALL""")
def nrm_boolean(spark, sf):
    return _counted(views.claim_table(spark, sf, "v4"), vs.polarity(F.upper("text"), bare=False).alias("stated"), vs.polarity(F.col("value"), bare=True).alias("claimed"))


@query("nrm_text_key", r"""SELECT trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n FROM part GROUP BY 1""")
def nrm_text_key(spark, sf):
    text = F.concat(_pick(F.col("p_partkey"), [F.lit("The  "), F.lit("an "), F.lit("")]), F.initcap("p_name"), F.lit(", ("), "p_brand", F.lit(")."))
    return _counted(views.table(spark, sf, "part"), vs.text_key(text).alias("key"))


_V4_KEYS = """SELECT value, value_type, document_id, CASE value_type WHEN 'duration' THEN 'quantity:' || regexp_extract(value, '[0-9]+') || '|day' WHEN 'percent' THEN 'percent:' || regexp_extract(value, '[0-9.]+')
  WHEN 'money' THEN 'money:USD|' || replace(regexp_extract(value, '[0-9,]+'), ',', '') WHEN 'boolean' THEN 'boolean:' || value ELSE 'text:' || lower(replace(value, 'The ', '')) END AS key FROM v4"""


@query("nrm_value", f"""WITH {views.CLAIMS_SQL} SELECT key, string_split(key, ':')[1] AS family, count(*) AS claims, count(DISTINCT document_id) AS documents, count(DISTINCT value) AS wordings FROM ({_V4_KEYS}) GROUP BY ALL""")
def nrm_value(spark, sf):
    c = views.claim_table(spark, sf, "v4").select("value", "document_id", vs.normalize(F.col("value"), F.col("value_type")).alias("v"))
    return c.groupBy("v.key", "v.family").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("document_id").alias("documents"), F.countDistinct("value").alias("wordings"))


@query("nrm_display", f"""WITH shown AS (
  SELECT 'money' AS value_type, 'USD ' || format('{{:,}}', CAST(floor({_PRICE}) AS BIGINT)) || '.' || right(CAST({_PRICE} AS VARCHAR), 2) AS display FROM orders
  UNION ALL SELECT 'date', CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ' %b %Y') FROM orders
  UNION ALL SELECT 'duration', CAST(l_quantity AS INTEGER) || CASE WHEN CAST(l_quantity AS INTEGER) = 1 THEN ' month' ELSE ' months' END FROM lineitem
  UNION ALL SELECT 'percent', CAST(round(l_tax * 100) AS INTEGER) || '.5%' FROM lineitem
  UNION ALL SELECT 'boolean', CASE WHEN l_linestatus = 'F' THEN 'No' ELSE 'Yes' END FROM lineitem)
SELECT value_type, display, count(*) AS n FROM shown GROUP BY ALL""")
def nrm_display(spark, sf):
    def said(kind, text):
        return F.struct(F.lit(kind).alias("t"), text.alias("v"))
    o = views.table(spark, sf, "orders").select(F.explode(F.array(
        said("money", F.concat(F.lit("$ "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))), said("date", F.date_format("o_orderdate", "yyyy-MM-dd")))).alias("x"))
    li = views.table(spark, sf, "lineitem").select(F.explode(F.array(
        said("duration", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("-month"))),
        said("percent", F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit(".50 percent"))),
        said("boolean", F.when(F.col("l_linestatus") == "F", "shall not").otherwise("allowed")))).alias("x"))
    said_all = o.unionByName(li).select("x.t", vs.normalize(F.col("x.v"), F.col("x.t")).alias("v"))
    return _counted(said_all, F.col("t").alias("value_type"), F.col("v.display").alias("display"))


@query("nrm_scope", f"""WITH {views.CLAIMS_SQL} SELECT CASE WHEN scope LIKE 'Domestic%' THEN 'domestic orders' END AS scope, count(*) AS n FROM v4 GROUP BY 1""")
def nrm_scope(spark, sf):
    return _counted(views.claim_table(spark, sf, "v4"), vs.scope(F.col("scope")).alias("scope"))


@query("nrm_quote_supports", f"""WITH {views.CLAIMS_SQL} SELECT value_type, value <> '99 days' AS supported, count(*) AS n FROM v4 GROUP BY ALL""")
def nrm_quote_supports(spark, sf):
    c = views.claim_table(spark, sf, "v4").withColumn("v", vs.normalize(F.col("value"), F.col("value_type")))
    return _counted(c, "value_type", vs.quote_supports(F.col("v"), F.col("text")).alias("supported"))
