"""Literal-row tests for the null and edge rules called out in SURVEY §2."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import hashing as FH
from kiln.functions import net as FN
from kiln.functions import strings as FS
from kiln.functions import timefn as FT
from kiln.operators import joins as J
from kiln.operators import prep as P
from kiln.operators import profile as PR
from kiln.operators import quantiles as QT
from kiln.operators import relational as O
from kiln.operators import structured as ST


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_drop_rows_outside_ranges_keeps_nulls_and_bounds(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, None), (4, 10), (5, 11)], "id int, v int")
    out = O.drop_rows_outside_ranges(df, {"v": (5, 10)})
    assert sorted(col(out, "id")) == [1, 3, 4]


def test_winsorize_keeps_null(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 50)], "id int, v int")
    out = P.winsorize_low(df, "v", 30).orderBy("id")
    assert col(out, "v") == [30, None, 50]


def test_email_domain_first_at_and_missing(spark):
    df = spark.createDataFrame([("a@b@C.com ",), ("no-at",), (None,), ("  X@Mail.CO.UK",)], "e string")
    assert col(df.select(FS.email_domain("e").alias("d")), "d") == ["b@c.com", None, None, "mail.co.uk"]


def test_last_two_labels(spark):
    df = spark.createDataFrame([("a.co.uk",), ("com",), ("x.y.example.org",)], "d string")
    assert col(df.select(FS.last_two_labels("d").alias("t")), "t") == ["co.uk", "com", "example.org"]


def test_valid_email_escaped_dot(spark):
    df = spark.createDataFrame([("a@bcde",), ("a@b.cd",), ("a@b.c",)], "e string")
    assert col(df.select(FS.is_valid_email("e").alias("v")), "v") == [False, True, False]


def test_first_token(spark):
    df = spark.createDataFrame([("Central - North",), ("   ",), (None,)], "s string")
    assert col(df.select(FS.first_token("s").alias("t")), "t") == ["Central", None, None]


def test_split_composite_lenient_and_strict(spark):
    df = spark.createDataFrame([("a|b|c",), ("a|b",), ("",), (None,), ("a||c",)], "p string")
    out = ST.split_composite(df, "p", ["x", "y", "z"]).collect()
    assert [tuple(r) for r in out] == [("a", "b", "c"), ("a", "b", None), (None, None, None),
                                       (None, None, None), ("a", None, "c")]
    with pytest.raises(Exception):
        ST.split_composite(df, "p", ["x", "y", "z"], strict=True).collect()


def test_tag_score_first_match_and_hv10(spark):
    df = spark.createDataFrame([("HV3, HV1",), ("HV10",), (None,), ("",), ("HV4",)], "t string")
    assert col(df.select(FS.tag_score("t").alias("s")), "s") == [4, 4, 0, 0, 1]


def test_label_rules_null_handling(spark):
    df = spark.createDataFrame([("Benign",), (None,), ("Malicious   C&C",)], "l string")
    out = df.select(O.label_not_in("l", ["Benign"]).alias("a"), O.label_in("l", ["Malicious   C&C"]).alias("b"))
    assert [tuple(r) for r in out.collect()] == [(False, False), (True, False), (True, True)]


def test_shift_hour_floor_modulo(spark):
    df = spark.createDataFrame([(3.5,), (18.0,), (23.75,)], "h double")
    assert col(df.select(FT.shift_hour("h", -18).alias("s")), "s") == [9.5, 0.0, 5.75]


def test_port_range_boundaries(spark):
    df = spark.createDataFrame([(0,), (1,), (1023,), (1024,), (49151,), (49152,), (65535,), (65536,), (None,)], "p int")
    assert col(df.select(FN.port_range("p").alias("r")), "r") == [3, 0, 0, 1, 1, 2, 2, 3, 3]


def test_mac_normalise(spark):
    df = spark.createDataFrame([("AA-BB-CC-DD-EE-FF",), ("aa:bb:cc:dd:ee:ff",), ("zz:bb:cc:dd:ee:ff",)], "m string")
    assert col(df.select(FN.mac_normalise("m").alias("n")), "n") == ["aa:bb:cc:dd:ee:ff", "aa:bb:cc:dd:ee:ff", None]


def test_short_hostname(spark):
    df = spark.createDataFrame([("Host1.corp.example.",), ("plain",)], "h string")
    assert col(df.select(FN.short_hostname("h").alias("s")), "s") == ["host1", "plain"]


def test_count_distinct_tuple_counts_null_member(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x")], "f string, p string")
    n = df.agg(F.countDistinct(F.struct("f", "p"))).first()[0]
    assert n == 2


def test_filtered_string_agg_null_when_empty(spark):
    from kiln.plans.risk_report import filtered_string_agg
    df = spark.createDataFrame([(1, "BID", "b"), (1, "BID", "a"), (2, "CVE", "c")], "k int, s string, r string")
    out = {r["k"]: r["x"] for r in df.groupBy("k").agg(filtered_string_agg("r", "s <> 'CVE'").alias("x")).collect()}
    assert out == {1: "a, b", 2: None}


def test_html_to_text(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p><script>x<y</script><!-- c -->\n<b>d</b>",)], "h string")
    assert col(df.select(FS.html_to_text("h").alias("t")), "t") == ["a & b d"]


def test_cast_schema_range_assertion(spark):
    df = spark.createDataFrame([(300,)], "v int")
    with pytest.raises(Exception):
        O.cast_schema(df, {"v": "uint8"}).collect()


def test_one_hot_null_is_all_zero(spark):
    df = spark.createDataFrame([("tcp",), (None,), ("udp",)], "p string")
    out = P.one_hot(df, "p").collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 0), (0, 1)]


def test_one_hot_has_no_level_limit(spark):
    df = spark.range(1200).select("id", F.col("id").cast("string").alias("v"))
    wide = P.one_hot(df, "v")
    assert len(wide.columns) == 1201
    assert wide.where("id = 7").select("v_7", "v_8").first() == (1, 0)
    assert P.one_hot_long(df, "id", ["v"]).where("id = 7").collect() == [(7, "v_7")]


def test_constant_columns_give_null_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 4.0), (3.0, 5.0, 9.0)], "a double, k double, t double")
    assert [r.k for r in P.zscore_sample(df, ["a", "k"]).collect()] == [None] * 3
    assert [r.k for r in P.zscore_population(df, ["k"]).collect()] == [None] * 3
    z = {r.column_name: r.z_min for r in PR.zscore_extremes(df).collect()}
    assert z["k"] is None and z["a"] < 0
    corr = PR.feature_target_corr(df, "t").collect()
    assert [r.feature for r in corr] == ["a", "k"] and corr[1].corr is None
    pairs = {(r.col_a, r.col_b): r.corr for r in PR.correlation_pairs(df, ["a", "k", "t"]).collect()}
    assert pairs["k", "a"] is None and abs(pairs["a", "a"] - 1) < 1e-12
    assert PR.drop_low_corr_features(df, "t", 0.5).columns == ["a", "t"]


def test_snapshot_diff_tells_nulls_apart(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "x", "y"), (3, None, None)], "k int, p string, q string")
    new = spark.createDataFrame([(1, None, "a"), (2, "x", "y"), (4, None, None)], "k int, p string, q string")
    got = {r.k: r.status for r in J.snapshot_diff(old, new, "k").collect()}
    assert got == {1: "changed", 2: "unchanged", 3: "removed", 4: "added"}


def test_fingerprints_tell_repeated_and_null_rows_apart(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    for f in (FH.table_fingerprint, FH.table_fingerprint_md5):
        assert f(one(1, 1, 3)).first() != f(one(2, 2, 3)).first()
        assert f(one(3, 1, 2)).first() == f(one(1, 2, 3)).first()
        two = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string")
        assert f(two("x", None)).first() != f(two(None, "x")).first()


def test_json_keys_with_dots_clashes_and_no_limit(spark):
    wide = "{" + ", ".join(f'"k{i}": {i}' for i in range(1100)) + "}"
    df = spark.createDataFrame([('{"a": "1", "b.c": "2", "x": "3"}', "old"), (wide, "w")], "j string, x string")
    out = ST.json_to_columns(df, "j", T.StructType([T.StructField("a", T.StringType())]), {})
    assert len(out.columns) == 1 + 1 + 2 + 1100
    r = out.where("x = 'old'").first()
    assert r["b.c"] == "2" and r["x_json"] == "3" and r["x"] == "old" and r["k7"] is None


def test_none_text_and_null_are_two_values(spark):
    df = spark.createDataFrame([("_None_",), (None,), ("v",)], "s string")
    got = sorted((r.value, r.n) for r in PR.unique_value_counts(df).collect())
    assert got == [("_None_", 1), ("_None_", 1), ("v", 1)]


def test_order_statistics_bring_no_values_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as D
    monkeypatch.setattr(D, "toPandas", lambda self: pytest.fail("values reached the driver"))
    sizes, collect = [], D.collect
    monkeypatch.setattr(D, "collect", lambda self: (lambda rows: sizes.append(len(rows)) or rows)(collect(self)))
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).cast("double").alias("v"))
    assert QT.order_statistics(df, {"v": [0, 17, 2500, 4999]}, buckets=16)["v"] == {0: 0.0, 17: 17.0, 2500: 2500.0, 4999: 4999.0}
    assert max(sizes) <= 16 * 8  # bucket counts only


def test_assert_trainable(spark):
    ok = spark.createDataFrame([(1.0, True)], "a double, b boolean")
    assert P.assert_trainable(ok) is ok
    with pytest.raises(TypeError):
        P.assert_trainable(spark.createDataFrame([("x",)], "s string"))
    with pytest.raises(ValueError):
        P.assert_trainable(spark.createDataFrame([(None,)], "a double"))


def test_json_to_columns_defaults_and_discovery(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([(1, '{"quarter_created": 2, "extra": "x"}'), (2, '{}'), (3, None)],
                               "id int, j string")
    schema = T.StructType([T.StructField("quarter_created", T.IntegerType()),
                           T.StructField("primary_product", T.StringType())])
    out = ST.json_to_columns(df, "j", schema, {"quarter_created": 0}).orderBy("id").collect()
    assert [(r["id"], r["quarter_created"], r["primary_product"], r["extra"]) for r in out] == [
        (1, 2, None, "x"), (2, 0, None, None), (3, 0, None, None)]
    bad = spark.createDataFrame([(1, '{"quarter_created": ')], "id int, j string")
    with pytest.raises(Exception):
        ST.json_to_columns(bad, "j", schema, {}, discover=False).collect()
