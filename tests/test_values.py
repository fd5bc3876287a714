import pytest
from pyspark.sql import functions as F

from corrobora.functions import values as vs

CASES = [
    ("thirty (30) days", "duration", "quantity:30|day", "30 days"), ("net 30", "duration", "quantity:30|day", "30 days"),
    ("two weeks", "duration", "quantity:14|day", "14 days"), ("10 working days", "duration", "quantity:10|business day", "10 business days"),
    ("7 calendar days", "duration", "quantity:7|day", "7 days"), ("1 month", "duration", "quantity:1|month", "1 month"),
    ("twenty-five", "number", "quantity:25|", "25"), ("two thousand five hundred", "number", "quantity:2500|", "2500"),
    ("USD 48,500.00", "money", "money:USD|48500", "USD 48,500.00"), ("1.5 million dollars", "money", "money:USD|1500000", "USD 1,500,000.0"),
    ("Rs. 18 lakh", "money", "money:INR|1800000", "INR 1,800,000"), ("€1,234.50", "money", "money:EUR|1234.5", "EUR 1,234.50"),
    ("1.50 per cent", "percent", "percent:1.5", "1.5%"), ("97", "percent", "percent:97", "97%"),
    ("15th February, 2024", "date", "date:2024-02-15", "15 Feb 2024"), ("Sept. 3, 2023", "date", "date:2023-09-03", "3 Sep 2023"),
    ("2024-02-15", "date", "date:2024-02-15", "15 Feb 2024"), ("01/02/2024", "date", "text:01 02 2024", "01/02/2024"),
    ("Yes", "boolean", "boolean:yes", "Yes"), ("is not permitted", "boolean", "boolean:no", "No"), ("may", "boolean", "boolean:yes", "Yes"),
    ("The State of Delaware.", "text", "text:state of delaware", "The State of Delaware."), ("soon", "money", "text:soon", "soon"),
    ("", "text", None, None), ("5", "none", None, None), ("thousand " * 9, "number", "text:" + ("thousand " * 9).strip(), None),
]


def test_normalised_wordings(spark):
    frame = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, v string, t string")
    got = {r.i: r.n for r in frame.select("i", vs.normalize(F.col("v"), F.col("t")).alias("n")).collect()}
    for i, (value, kind, key, display) in enumerate(CASES):
        if value.startswith("thousand"):
            continue  # overflow must not fail the job
        assert (got[i].key if got[i] else None, got[i].display if got[i] else None) == (key, display), value


@pytest.mark.parametrize("value,kind,quote,ok", [
    ("30 days", "duration", "payable within thirty (30) days of receipt", True), ("45 days", "duration", "payable within 30 days", False),
    ("30", "duration", "within 30 days", True), ("1 month", "duration", "within 30 days", False), ("USD 500", "money", "a fee of $500.00 applies", True),
    ("2%", "percent", "interest of 1.5% per month", False), ("2024-03-01", "date", "dated 1 March 2024", True), ("no", "boolean", "remote work is not allowed", True),
    ("yes", "boolean", "yes it is", False), ("Delaware", "text", "laws of Texas", True)])
def test_quote_support(spark, value, kind, quote, ok):
    frame = spark.createDataFrame([(value, kind, quote)], "v string, t string, q string").withColumn("n", vs.normalize(F.col("v"), F.col("t")))
    assert frame.select(vs.quote_supports(F.col("n"), F.col("q"))).first()[0] is ok


def test_long_amounts_are_exact(spark):
    long = "123456789012345678901234567890123456789"
    rows = [(f"USD {long}.25 million", f"money:USD|{long}250000"), (f"{long} weeks", f"quantity:{int(long) * 7}|day"), ("1.5 weeks", "quantity:10.5|day"), ("USD 1.5 million", "money:USD|1500000"),
            ("USD 2.0000001 lakh", "money:USD|200000.01")]
    frame = spark.createDataFrame([(i, t, k.split(":")[0].replace("quantity", "duration")) for i, (t, k) in enumerate(rows)], "i int, v string, kind string")
    got = [r.k for r in frame.select("i", vs.normalized("v", "kind")["key"].alias("k")).orderBy("i").collect()]
    assert got == [k for _, k in rows]
