"""Queries of cleaning and of the fitted transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions import power
from tabforge.operators import clean as C
from tabforge.operators import preprocess as T
from tabforge.operators import split as D
from tabforge.plans.catalogue import register
from tabforge.plans.support import rounded, union, with_view
from tabforge.sources.tables import table

ALL = ["c_custkey", "acctbal", "segment", "nation", "nation_copy", "const_col", "near_const", "mostly_null", "num_text", "flag_text", "date_text", "label"]
dirty = lambda body: with_view("dirty_customer", body)
clf = lambda body: with_view("clf_lineitem", body)
_CLEAN = "regexp_replace(lower(trim({c})), '[^\\p{{L}}\\p{{N}}_\\s.,;:!?()-]', '', 'g')"


def _dirty(spark, d):
    return table(spark, d, "dirty_customer")


@register("clean_high_null", dirty("SELECT c_custkey, acctbal, segment, nation, nation_copy, const_col, near_const, num_text, flag_text, date_text, label FROM dirty_customer"))
def clean_high_null(spark, d):
    df = _dirty(spark, d)
    return df.drop(*C.high_null_columns(df, ["c_custkey"]))


@register("clean_constant", dirty("SELECT c_custkey, acctbal, segment, nation, nation_copy, near_const, mostly_null, num_text, flag_text, date_text, label FROM dirty_customer"))
def clean_constant(spark, d):
    df = _dirty(spark, d)
    return df.drop(*C.constant_columns(df, ["c_custkey"]))


@register("clean_near_constant", dirty("SELECT c_custkey, acctbal, segment, nation, nation_copy, mostly_null, num_text, flag_text, date_text, label FROM dirty_customer"))
def clean_near_constant(spark, d):
    df = _dirty(spark, d)
    return df.drop(*C.near_constant_columns(df, ["c_custkey"]))


@register("clean_dup_columns", dirty("SELECT c_custkey, acctbal, segment, nation, const_col, near_const, mostly_null, num_text, flag_text, date_text, label FROM dirty_customer"))
def clean_dup_columns(spark, d):
    df = _dirty(spark, d)
    return df.drop(*C.duplicate_columns(df, ["c_custkey"]))


_TEXT = ["segment", "near_const", "num_text", "flag_text", "date_text"]


@register("clean_strings", dirty("SELECT c_custkey, " + ", ".join(f"{_CLEAN.format(c=c)} AS {c}" for c in _TEXT) + " FROM dirty_customer"))
def clean_strings(spark, d):
    df = _dirty(spark, d).select("c_custkey", *_TEXT)
    return df.select("c_custkey", *[C.cleaned_string(F.col(c)).alias(c) for c in C.text_columns(df)])


@register("clean_case", dirty("WITH v AS (SELECT segment AS s, count(*) AS n FROM dirty_customer GROUP BY 1), b AS (SELECT s, row_number() OVER (PARTITION BY lower(s) ORDER BY n DESC, s) AS r FROM v) SELECT c_custkey, b.s AS segment FROM dirty_customer JOIN b ON lower(segment) = lower(b.s) AND r = 1"))
def clean_case(spark, d):
    df = _dirty(spark, d).select("c_custkey", "segment")
    return df.withColumns({c: C.with_case(c, m) for c, m in C.case_maps(df, ["segment"]).items()})


@register("clean_numeric_text", dirty("SELECT c_custkey, TRY_CAST(replace(num_text, '$', '') AS DOUBLE) AS num_text FROM dirty_customer"))
def clean_numeric_text(spark, d):
    df = _dirty(spark, d).select("c_custkey", C.cleaned_string(F.col("num_text")).alias("num_text"))
    return df.withColumns({c: C.converted(F.col(c), k) for c, k in C.text_types(df).items()})


@register("clean_text_dates", dirty("SELECT c_custkey, CAST(date_text AS TIMESTAMP) AS date_text FROM dirty_customer"))
def clean_text_dates(spark, d):
    df = _dirty(spark, d).select("c_custkey", "date_text")
    return df.withColumns({c: C.converted(F.col(c), k) for c, k in C.text_types(df).items()})


@register("clean_bool", dirty("SELECT c_custkey, lower(flag_text) = 'yes' AS flag_text FROM dirty_customer"))
def clean_bool(spark, d):
    df = _dirty(spark, d).select("c_custkey", "flag_text")
    return df.withColumns({c: C.converted(F.col(c), k) for c, k in C.text_types(df).items()})


@register("clean_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def clean_dates(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return df.withColumns({c: C.standard_date(F.col(c), p) for c, p in C.date_patterns(df).items()})


@register("clean_null_rows", dirty("SELECT acctbal, mostly_null FROM dirty_customer WHERE CAST(acctbal IS NULL AS INT) + CAST(mostly_null IS NULL AS INT) <= 1"))
def clean_null_rows(spark, d):
    return C.full_rows(_dirty(spark, d).select("acctbal", "mostly_null"))


_SEGMENT = _CLEAN.format(c="segment")
_ALL_SQL = f"SELECT c_custkey, acctbal, {_SEGMENT} AS segment, nation, TRY_CAST(replace(num_text, '$', '') AS DOUBLE) AS num_text, lower(flag_text) = 'yes' AS flag_text, strftime(CAST(date_text AS DATE), '%Y-%m-%d') AS date_text, label FROM dirty_customer"


@register("clean_numbers", 'SELECT l_orderkey, l_linenumber, l_quantity AS "quantity.of line", l_discount, l_tax FROM lineitem')
def clean_numbers(spark, d):
    """A table without text: a constant, a copy and an empty column go, rows stay."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity.of line"), F.lit(1).alias("one"), "l_discount", F.col("l_discount").alias("again"), F.lit(None).cast("double").alias("empty"), "l_tax")
    return C.apply(df, C.fit(df, ["l_orderkey"]))


@register("clean_all", dirty(_ALL_SQL))
def clean_all(spark, d):
    """Fitted on all rows, applied to them."""
    df = _dirty(spark, d)
    return C.apply(df, C.fit(df, ["c_custkey"], "label"))


@register("clean_stage", dirty(_ALL_SQL + " WHERE c_custkey % 5 = 0"))
def clean_stage(spark, d):
    """Fitted on four fifths, the frozen plan applied to the rest."""
    df = _dirty(spark, d)
    return C.run(df.where("c_custkey % 5 <> 0"), df.where("c_custkey % 5 = 0"), ["c_custkey"], "label")[1]


@register("clean_report", dirty(union([f"SELECT '{c}' AS \"column\", '{a}' AS action, '{t}' AS detail" for c, a, t in [("mostly_null", "dropped", "high_null"), ("const_col", "dropped", "constant"), ("near_const", "dropped", "near_constant"), ("nation_copy", "dropped", "duplicate of nation"), *[(c, "string_cleaning", "") for c in ("segment", "num_text", "flag_text", "date_text")], ("num_text", "converted", "double"), ("flag_text", "converted", "boolean"), ("date_text", "converted", "date"), ("date_text", "date_standardization", "timestamp")]]) + " UNION ALL SELECT '*', 'rows_before', CAST(count(*) AS VARCHAR) FROM dirty_customer UNION ALL SELECT '*', 'rows_after', CAST(count(*) AS VARCHAR) FROM dirty_customer"))
def clean_report(spark, d):
    df = _dirty(spark, d)
    return C.report(df, C.fit(df, ["c_custkey"], "label"))


def _filled(spark, d, method, c):
    df = _dirty(spark, d).select("c_custkey", c)
    v = T.impute_values(df, [c], method)
    return rounded(df.withColumn(c, T.imputed(c, v[c], method in ("mean", "median") and c == "acctbal")))


@register("impute_mean", dirty("SELECT c_custkey, round(coalesce(acctbal, (SELECT avg(acctbal) FROM dirty_customer)), 6) AS acctbal FROM dirty_customer"))
def impute_mean(spark, d):
    return _filled(spark, d, "mean", "acctbal")


@register("impute_median", dirty("SELECT c_custkey, round(coalesce(acctbal, (SELECT median(acctbal) FROM dirty_customer)), 6) AS acctbal FROM dirty_customer"))
def impute_median(spark, d):
    return _filled(spark, d, "median", "acctbal")


@register("impute_mode", "WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer) SELECT c_custkey, coalesce(segment, (SELECT segment FROM n WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM n")
def impute_mode(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return df.withColumn("segment", T.imputed("segment", T.impute_values(df, ["segment"], "mode")["segment"]))


@register("impute_drop", dirty("SELECT * FROM dirty_customer WHERE acctbal IS NOT NULL"))
def impute_drop(spark, d):
    return T.drop_null_rows(_dirty(spark, d), ["acctbal"])


@register("impute_const", dirty("SELECT c_custkey, coalesce(acctbal, 0) AS acctbal FROM dirty_customer"))
def impute_const(spark, d):
    return _filled(spark, d, "constant", "acctbal")


@register("cap_iqr", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS value FROM events, q")
def cap_iqr(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(df.withColumn("value", T.capped(F.col("value"), T.caps(df, ["value"], "IQR")["value"])))


@register("cap_zscore", "WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, round(greatest(least(value, m + 3 * s), m - 3 * s), 6) AS value FROM events, q")
def cap_zscore(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(df.withColumn("value", T.capped(F.col("value"), T.caps(df, ["value"], "Z-Score")["value"])))


def _scaled(spark, d, method):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(df.withColumn("value", T.scaled(F.col("value"), T.scale_values(df, ["value"], method)["value"])))


@register("scale_standard", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events")
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@register("scale_robust", "WITH q AS (SELECT median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM events) SELECT event_id, round((value - m) / w, 6) AS value FROM events, q")
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@register("scale_minmax", "WITH q AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT event_id, round((value - a) / (b - a), 6) AS value FROM events, q")
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


_FLAGS = ["A", "N", "R"]


@register("encode_onehot", clf("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(target = '{v}' AS DOUBLE) AS \"target_{v}\"" for v in _FLAGS) + " FROM clf_lineitem"))
def encode_onehot(spark, d):
    df = table(spark, d, "clf_lineitem")
    return df.select("l_orderkey", "l_linenumber", *T.one_hot("target", T.vocabulary(df, "target")))


@register("encode_dummies", clf("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(target = '{v}' AS INTEGER) AS \"target_{v}\"" for v in _FLAGS[1:]) + " FROM clf_lineitem"))
def encode_dummies(spark, d):
    df = table(spark, d, "clf_lineitem")
    return df.select("l_orderkey", "l_linenumber", *T.one_hot("target", T.vocabulary(df, "target"), "int", drop_first=True))


_CODE = "CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}"


@register("encode_label", "SELECT event_id, " + _CODE.format(c="event_type") + " FROM events")
def encode_label(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", T.label_code("event_type", T.vocabulary(df, "event_type")).alias("event_type"))


@register("target_encode", clf("SELECT l_orderkey, l_linenumber, l_quantity, " + _CODE.format(c="target") + " FROM clf_lineitem"))
def target_encode(spark, d):
    df = table(spark, d, "clf_lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "target")
    return T.Preprocessing("target", dedupe=False).fit(df).transform(df)


@register("target_numeric", dirty("SELECT c_custkey, CAST(label AS DOUBLE) AS label FROM dirty_customer"))
def target_numeric(spark, d):
    return T.Preprocessing("label").fit(df := _dirty(spark, d).select("c_custkey", "label")).transform(df)


@register("drop_ids", "SELECT c_mktsegment, c_acctbal, c_nationkey FROM customer")
def drop_ids(spark, d):
    from tabforge.operators.profile import id_columns

    df = table(spark, d, "customer")
    return df.drop(*id_columns(df)).select("c_mktsegment", "c_acctbal", "c_nationkey")


@register("dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates()


_PRE = """WITH s AS (SELECT median(acctbal) AS med, quantile_cont(acctbal, 0.25) AS a, quantile_cont(acctbal, 0.75) AS b, avg(acctbal) AS m, stddev_pop(acctbal) AS sd FROM dirty_customer)
SELECT round((greatest(least(coalesce(acctbal, med), b + 1.5 * (b - a)), a - 1.5 * (b - a)) - m) / sd, 6) AS acctbal,
 CAST(flag_text = 'Yes' AS DOUBLE) AS "flag_text_Yes", CAST(flag_text = 'no' AS DOUBLE) AS "flag_text_no", CAST(label AS DOUBLE) AS label FROM dirty_customer, s"""


@register("preprocess_all", dirty(_PRE))
def preprocess_all(spark, d):
    df = _dirty(spark, d).select("c_custkey", "acctbal", "flag_text", "label")
    return rounded(T.default_plan(df, "label", ["c_custkey"]).fit(df).transform(df))


@register("preprocess_stage", dirty(_PRE.replace("FROM dirty_customer)", "FROM dirty_customer WHERE c_custkey % 5 <> 0)").replace("FROM dirty_customer, s", "FROM dirty_customer, s WHERE c_custkey % 5 = 0")))
def preprocess_stage(spark, d):
    """Fitted on four fifths, applied to the rest."""
    df = _dirty(spark, d).select("c_custkey", "acctbal", "flag_text", "label")
    plan = T.default_plan(df, "label", ["c_custkey"])
    return rounded(T.run(df.where("c_custkey % 5 <> 0"), df.where("c_custkey % 5 = 0"), plan)[1])


_GRID = "SELECT round(-2 + i * 0.1, 6) AS lam FROM range(41) t(i)"


def _power_sql(psi: str, jacobian: str, src: str) -> str:
    """Fixed grid of 41 exponents: the likeliest one, then the standardised transform."""
    return f"""WITH x AS ({src}), g AS ({_GRID}),
l AS (SELECT lam, -count(*) / 2.0 * ln(var_pop({psi})) + (lam - 1) * sum({jacobian}) AS ll FROM x, g GROUP BY lam),
best AS (SELECT lam FROM l ORDER BY ll DESC, lam LIMIT 1),
t AS (SELECT id, {psi} AS v FROM x, best)
SELECT id AS event_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 4) AS value FROM t"""


_YJ = "CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END ELSE CASE WHEN abs(lam - 2) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END"
_BC = "CASE WHEN abs(lam) < 1e-9 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END"


def _power(spark, d, method):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(df.withColumn("value", power.transformed(F.col("value"), power.fit(df, ["value"], method, refine=0)["value"])), 4)


@register("power_yj", _power_sql(_YJ, "sign(x) * ln(1 + abs(x))", "SELECT event_id AS id, value AS x FROM events"))
def power_yj(spark, d):
    return _power(spark, d, power.YEO)


@register("power_boxcox", _power_sql(_BC, "ln(x)", "SELECT event_id AS id, value + CASE WHEN (SELECT min(value) FROM events) <= 0 THEN abs((SELECT min(value) FROM events)) + 1 ELSE 0 END AS x FROM events"))
def power_boxcox(spark, d):
    return _power(spark, d, power.BOX)


@register("power_refined")
def power_refined(spark, d):
    """Exponents refined to 0.001."""
    df = table(spark, d, "events")
    both = [(c, s["method"], float(s["exponent"]), float(s["shift"])) for m in (power.YEO, power.BOX) for c, s in power.fit(df, ["value"], m).items()]
    return spark.createDataFrame(both, "column string, method string, exponent double, shift double")


def _fits_sql(columns: list[str]) -> str:
    """Both transforms of each column with its likeliest exponent of the grid, their skewness, and the recommendation."""
    parts = []
    for c in columns:
        for m, psi, jacobian, low in (("yj", _YJ, "sign(x) * ln(1 + abs(x))", "0"), ("bc", _BC, "ln(x)", f"(SELECT CASE WHEN min({c}) <= 0 THEN abs(min({c})) + 1 ELSE 0 END FROM lineitem)")):
            n = f"{m}_{c}"
            parts.append(f"""x_{n} AS (SELECT CAST({c} AS DOUBLE) + {low} AS x FROM lineitem WHERE {c} IS NOT NULL),
b_{n} AS (SELECT lam FROM (SELECT lam, -count(*) / 2.0 * ln(var_pop({psi})) + (lam - 1) * sum({jacobian}) AS ll FROM x_{n}, g GROUP BY lam) ORDER BY ll DESC, lam LIMIT 1),
t_{n} AS (SELECT {psi} AS v FROM x_{n}, b_{n}),
s_{n} AS (SELECT avg(pow(v - (SELECT avg(v) FROM t_{n}), 3)) / pow((SELECT stddev_pop(v) FROM t_{n}), 3) AS s FROM t_{n})""")
    one = lambda c: f"SELECT '{c}' AS \"column\", (SELECT s FROM s_bc_{c}) AS a, (SELECT s FROM s_yj_{c}) AS b, (SELECT min({c}) > 0 FROM lineitem) AS positive"
    return "WITH g AS (" + _GRID + "), " + ",\n".join(parts) + f", r AS (SELECT \"column\", round(a, 4) AS skew_box_cox, round(b, 4) AS skew_yeo_johnson, CASE WHEN positive AND abs(a) <= abs(b) THEN 'box-cox' ELSE 'yeo-johnson' END AS recommendation FROM ({union([one(c) for c in columns])}))"


_RECOMMENDED = ["l_quantity", "l_tax"]


@register("power_recommend", _fits_sql(_RECOMMENDED) + " SELECT * FROM r")
def power_recommend(spark, d):
    return rounded(power.recommend(table(spark, d, "lineitem"), _RECOMMENDED, refine=0), 4)


@register("power_vote", _fits_sql(_RECOMMENDED) + ", v AS (SELECT count(*) FILTER (WHERE recommendation = 'box-cox') AS box_cox, count(*) FILTER (WHERE recommendation = 'yeo-johnson') AS yeo_johnson FROM r) SELECT *, CASE WHEN box_cox > yeo_johnson THEN 'box-cox' ELSE 'yeo-johnson' END AS choice FROM v")
def power_vote(spark, d):
    return power.vote(power.recommend(table(spark, d, "lineitem"), _RECOMMENDED, refine=0))


@register("stream_clean", dirty(_ALL_SQL))
def stream_clean(spark, d):
    """The frozen plan over customer read as a stream, written and read again."""
    import uuid

    from tabforge.sources.tables import VIEWS, scratch_dir
    from tabforge.streaming.apply import prepared_stream, write_stream

    plan = C.fit(_dirty(spark, d), ["c_custkey"], "label")
    base = spark.read.parquet(f"{d}/customer.parquet")
    stream = spark.readStream.schema(base.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/customer.parquet*")
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    write_stream(prepared_stream(spark.sql(VIEWS["dirty_customer"], customer=stream), plan), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")
