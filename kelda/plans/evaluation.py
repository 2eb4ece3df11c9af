"""Evaluation, panels, samples and sets over the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions.dates import day_sql, iso, readable_day
from kelda.operators.evaluate import availability_mask, compare_versions, confusion, discordant, frame_cells, histogram, lift, size_strata, split_half, threshold_curve
from kelda.operators.ranking import rank_within
from kelda.operators.sampling import bernoulli, hash_sample, per_outcome, round_robin
from kelda.operators.sets import fingerprint, insert_absent, key_changes, nested, new_since, symmetric_difference
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

# A mass in [0, 1) and a truth for every order, so that thresholds have something to tell apart.
_MASS = "CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000"
_TRUTH = "(o_orderkey * 7919) % 1000 + (o_custkey % 400) > 700"
SCORED = f"(SELECT o_orderkey, o_custkey, o_orderpriority, {_MASS} AS mass, {_TRUTH} AS truth FROM orders)"
_THRESHOLDS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.6, 0.75, 0.9, 0.95]


def scored(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    k = (F.col("o_orderkey") * 7919) % 1000
    return o.withColumn("mass", k.cast("double") / 1000).withColumn("truth", k + F.col("o_custkey") % 400 > 700)


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / {n})", "1.96"
    centre = f"({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n})"
    return (f"round(CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END, 6)", f"round(CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, {centre} + {half}) END, 6)")


_P, _R = _wilson_sql("tp", "(tp + fp)"), _wilson_sql("tp", "(tp + fn)")


@catalog.query(
    "confusion",
    f"""SELECT o_orderpriority, tp, fp, tn, fn, CAST(0 AS BIGINT) AS unscored, round(tp / nullif(tp + fp, 0), 6) AS precision, {_P[0]} AS precision_low, {_P[1]} AS precision_high, round(tp / nullif(tp + fn, 0), 6) AS recall, {_R[0]} AS recall_low, {_R[1]} AS recall_high
    FROM (SELECT o_orderpriority, count(*) FILTER (WHERE truth AND mass >= 0.6) AS tp, count(*) FILTER (WHERE NOT truth AND mass >= 0.6) AS fp, count(*) FILTER (WHERE NOT truth AND mass < 0.6) AS tn, count(*) FILTER (WHERE truth AND mass < 0.6) AS fn FROM {SCORED} GROUP BY 1)""",
)
def confusion_by_class(spark: SparkSession, d: str) -> DataFrame:
    return confusion(scored(spark, d).withColumn("decided", F.col("mass") >= 0.6), "truth", "decided", ["o_orderpriority"])


@catalog.query(
    "threshold_curve",
    " UNION ALL ".join(
        f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE m >= {t}) AS admitted, count(*) FILTER (WHERE m >= {t} AND truth) AS hits, round(count(*) FILTER (WHERE m >= {t} AND truth) / count(*) FILTER (WHERE truth), 6) AS recall, round(count(*) FILTER (WHERE m >= {t} AND truth) / nullif(count(*) FILTER (WHERE m >= {t}), 0), 6) AS precision FROM (SELECT *, CAST(round_even(CAST(mass AS DECIMAL(9, 3)), 2) AS DOUBLE) AS m FROM {SCORED})"
        for t in _THRESHOLDS
    ),
)
def threshold_points(spark: SparkSession, d: str) -> DataFrame:
    return threshold_curve(scored(spark, d).withColumn("mass", F.col("mass").cast("decimal(9,3)")).withColumn("mass", F.bround("mass", 2).cast("double")), "mass", "truth", _THRESHOLDS)


@catalog.query("mass_histogram", f"SELECT CAST(b AS INT) AS bin, (SELECT count(*) FROM {SCORED} WHERE truth AND least(floor(mass * 10), 9) = b) AS n_rows FROM range(10) t(b)")
def mass_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(scored(spark, d).where("truth"), "mass")


@catalog.query(
    "version_changes",
    f"""SELECT CASE WHEN x = y THEN 'unchanged' WHEN x = truth AND y <> truth THEN 'regression' WHEN x <> truth AND y = truth THEN 'recovered' WHEN y THEN 'newly_admitted' ELSE 'newly_rejected' END AS change, count(*) AS n_rows
    FROM (SELECT truth, mass >= 0.6 AS x, mass >= 0.5 OR o_custkey % 11 = 0 AS y FROM {SCORED}) GROUP BY 1""",
)
def version_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    base = rows.select("o_orderkey", "truth", (F.col("mass") >= 0.6).alias("decided"))
    other = rows.select("o_orderkey", ((F.col("mass") >= 0.5) | (F.col("o_custkey") % 11 == 0)).alias("decided"))
    return compare_versions(base, other, "o_orderkey", "decided", "truth")


@catalog.query(
    "discordant_counts",
    f"""SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither
    FROM (SELECT (mass >= 0.6) = truth AS a, (mass >= 0.5) = truth AS b FROM {SCORED})""",
)
def discordant_counts(spark: SparkSession, d: str) -> DataFrame:
    return discordant(scored(spark, d), (F.col("mass") >= 0.6) == F.col("truth"), (F.col("mass") >= 0.5) == F.col("truth"))


_PANEL = """(SELECT c_custkey, c_nationkey, count(o_orderkey) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS prior, coalesce(max(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01'), 0) AS largest,
  count(o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01') AS after FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer: what was known before 1998, and what came in that year; orders are reduced before the join."""
    split, end = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")
    day = F.col("o_orderdate")
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(day < split).alias("prior"), F.max(F.when(day < split, F.col("o_totalprice"))).alias("largest"), F.count_if((day >= split) & (day < end)).alias("after")
    )
    every = table(spark, d, "customer", "c_custkey", "c_nationkey").join(o, "c_custkey", "left")
    return every.select("c_custkey", "c_nationkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("prior", "largest", "after")])


@catalog.query("panel_features", f"SELECT c_custkey, prior, CAST(largest AS DOUBLE) AS largest, after FROM {_PANEL}")
def panel_features(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).select("c_custkey", "prior", F.col("largest").cast("double").alias("largest"), "after")


@catalog.query(
    "lift_marginals",
    " UNION ALL ".join(
        f"SELECT '{n}' AS signal, count(*) FILTER (WHERE {t}) AS n_signal, count(*) FILTER (WHERE {t} AND after > 1) AS n_hits, round(count(*) FILTER (WHERE {t} AND after > 1) / nullif(count(*) FILTER (WHERE {t}), 0), 6) AS rate, round((count(*) FILTER (WHERE {t} AND after > 1) / nullif(count(*) FILTER (WHERE {t}), 0)) / nullif(count(*) FILTER (WHERE after > 1) / count(*), 0), 6) AS lift FROM {_PANEL}"
        for n, t in (("frequent", "prior >= 5"), ("large", "largest >= 300000"), ("absent", "prior = 0"))
    ),
)
def lift_marginals(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    p = p.select((F.col("prior") >= 5).alias("frequent"), (F.col("largest") >= 300000).alias("large"), (F.col("prior") == 0).alias("absent"), (F.col("after") > 1).alias("hit"))
    return lift(p, ["frequent", "large", "absent"], "hit")


_NATIONS = f"(SELECT c_nationkey, CAST(sum(prior) AS BIGINT) AS size, CAST(sum(after) AS BIGINT) AS after, count(*) AS n FROM {_PANEL} GROUP BY 1)"


@catalog.query(
    "size_strata",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY size, c_nationkey) - 1 AS k, count(*) OVER () AS total FROM {_NATIONS})
    SELECT CAST(least(k // greatest(total // 3, 1), 2) AS INT) AS stratum, count(*) AS n_bodies, CAST(sum(size) AS BIGINT) AS size, CAST(sum(after) AS BIGINT) AS after FROM r GROUP BY 1""",
)
def strata(spark: SparkSession, d: str) -> DataFrame:
    """Nations in three strata by size; at most one row per nation is ranked."""
    n = _panel(spark, d).groupBy("c_nationkey").agg(F.sum("prior").alias("size"), F.sum("after").alias("after"))
    return size_strata(n, "size", "c_nationkey").groupBy("stratum").agg(F.count("*").alias("n_bodies"), F.sum("size").alias("size"), F.sum("after").alias("after"))


_LABELS = """SELECT dept_key, count(DISTINCT e) AS n_events FROM (SELECT trim(unnest(string_split(org_keys, ','))) AS dept_key, CASE WHEN lower(trim(coalesce(solicitation_number, ''))) IN ('', '-', 'nan') THEN 'r:' || reference_number ELSE 's:' || trim(solicitation_number) END AS e,
  try_cast(publication_date AS DATE) AS day FROM notices) WHERE day >= DATE '2020-04-01' AND day < DATE '2021-04-01' AND dept_key <> '' GROUP BY 1"""


@catalog.query("panel_labels", _LABELS)
def panel_labels(spark: SparkSession, d: str) -> DataFrame:
    """Distinct procurements published in a fiscal year per body, its first day in and its last day out."""
    from kelda.functions.text import event_identity, split_keys

    rows = table(spark, d, "notices", "org_keys", "solicitation_number", "reference_number", "publication_date").withColumn("day", readable_day("publication_date"))
    rows = rows.where((F.col("day") >= F.lit("2020-04-01").cast("date")) & (F.col("day") < F.lit("2021-04-01").cast("date")))
    return rows.select(F.explode(split_keys("org_keys")).alias("dept_key"), event_identity("solicitation_number", "reference_number").alias("e")).groupBy("dept_key").agg(F.countDistinct("e").alias("n_events"))


@catalog.query(
    "frame_cells",
    """WITH e AS (SELECT o_orderpriority AS p, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS DATE) AS t0),
    daily AS (SELECT p, s, d, count(*) AS n FROM e GROUP BY 1, 2, 3)
    SELECT p, s, strftime(t0, '%Y-%m-%d') AS t0, CAST(coalesce(sum(n) FILTER (WHERE d <= t0), 0) AS BIGINT) AS prior, CAST(coalesce(sum(n) FILTER (WHERE d > t0 AND d <= t0 + INTERVAL 12 MONTH), 0) AS BIGINT) AS after,
      CAST(coalesce(sum(n) FILTER (WHERE d >= t0 - INTERVAL 12 MONTH AND d < t0), 0) AS BIGINT) AS activity FROM daily, g GROUP BY p, s, t0""",
)
def frame(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_orderdate").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").cast("date").alias("d"))
    return frame_cells(rows, ["p", "s"], "d", "1997-01-01", "1999-12-01").withColumn("t0", iso("t0"))


@catalog.query(
    "availability_mask",
    """SELECT reg_id, CASE WHEN effective_date <= '2018-01-01' THEN client_num END AS client_num, CASE WHEN posted_date <= '2018-01-01' THEN registrant_num END AS registrant_num
    FROM (SELECT DISTINCT reg_id, effective_date, posted_date, client_num, registrant_num FROM registration_versions WHERE regexp_matches(effective_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) WHERE effective_date <= '2018-01-01' OR posted_date <= '2018-01-01'""",
)
def masked(spark: SparkSession, d: str) -> DataFrame:
    """Clients as of their start and registrants as of posting, both as known on 1 January 2018."""
    rows = table(spark, d, "registration_versions", "reg_id", "effective_date", "posted_date", "client_num", "registrant_num").where(F.col("effective_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).distinct()
    at = F.lit("2018-01-01").cast("date")
    return availability_mask(rows, [(readable_day("effective_date"), ["client_num"]), (readable_day("posted_date"), ["registrant_num"])], at).select("reg_id", "client_num", "registrant_num")


@catalog.query(
    "availability_mask_all",
    f"""SELECT reg_id, CASE WHEN started <= DATE '2018-01-01' THEN client_num END AS client_num, CASE WHEN posted <= DATE '2018-01-01' THEN registrant_num END AS registrant_num
    FROM (SELECT reg_id, {day_sql('effective_date')} AS started, {day_sql('posted_date')} AS posted, client_num, registrant_num FROM (SELECT DISTINCT reg_id, effective_date, posted_date, client_num, registrant_num FROM registration_versions))
    WHERE started <= DATE '2018-01-01' OR posted <= DATE '2018-01-01'""",
)
def masked_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over every row, whatever notation its days are in."""
    rows = table(spark, d, "registration_versions", "reg_id", "effective_date", "posted_date", "client_num", "registrant_num").distinct()
    at = F.lit("2018-01-01").cast("date")
    return availability_mask(rows, [(readable_day("effective_date"), ["client_num"]), (readable_day("posted_date"), ["registrant_num"])], at).select("reg_id", "client_num", "registrant_num")


@catalog.query("hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 200")
def sample(spark: SparkSession, d: str) -> DataFrame:
    return hash_sample(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", 200, 42)


@catalog.query("bernoulli_sample", "SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE CAST('0x' || left(sha256(CAST(o_orderkey AS VARCHAR) || ':7'), 8) AS BIGINT) < CAST(0.1 * 4294967296 AS BIGINT) GROUP BY 1")
def bernoulli_rows(spark: SparkSession, d: str) -> DataFrame:
    return bernoulli(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey", 0.1, 7).groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


@catalog.query(
    "round_robin_draw",
    """SELECT p_brand, p_partkey, CAST(turn AS INT) AS turn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(CAST(p_partkey AS VARCHAR) || ':3'), p_partkey) AS turn FROM part) ORDER BY turn, sha256(p_brand || ':3'), p_brand LIMIT 60""",
)
def round_robin_rows(spark: SparkSession, d: str) -> DataFrame:
    return round_robin(table(spark, d, "part", "p_brand", "p_partkey"), "p_brand", "p_partkey", 60, 3).select("p_brand", "p_partkey", "turn")


@catalog.query("sample_per_outcome", "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || ':9'), o_orderkey) <= 25")
def outcome_rows(spark: SparkSession, d: str) -> DataFrame:
    return per_outcome(table(spark, d, "orders", "o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 25, 9)


@catalog.query("new_since", "SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 09:00:00')")
def new_users(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "ts")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return new_since(e.where(F.col("ts") >= at("2024-01-20")), e.where(F.col("ts") < at("2024-01-01 09:00:00")), "user_id")


@catalog.query(
    "symmetric_difference",
    """WITH a AS (SELECT DISTINCT dept_key FROM communication_dpohs WHERE dept_key IS NOT NULL), b AS (SELECT DISTINCT dept_key FROM registration_institutions WHERE dept_key IS NOT NULL)
    SELECT dept_key, 'left' AS side FROM a WHERE dept_key NOT IN (SELECT dept_key FROM b) UNION ALL SELECT dept_key, 'right' FROM b WHERE dept_key NOT IN (SELECT dept_key FROM a)""",
)
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    known = lambda t: table(spark, d, t, "dept_key").where("dept_key IS NOT NULL")
    return symmetric_difference(known("communication_dpohs"), known("registration_institutions"), "dept_key")


@catalog.query(
    "insert_absent",
    """WITH old AS (SELECT DISTINCT reference_number, amendment_number FROM notices WHERE publication_date < '2019-01-01' AND reference_number IS NOT NULL AND amendment_number IS NOT NULL)
    SELECT reference_number, amendment_number, publication_date, first_seen FROM (SELECT DISTINCT reference_number, amendment_number, publication_date, first_seen FROM notices WHERE publication_date >= '2018-06-01' AND reference_number IS NOT NULL AND amendment_number IS NOT NULL) n
    WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.reference_number = n.reference_number AND old.amendment_number = n.amendment_number)
    QUALIFY row_number() OVER (PARTITION BY reference_number, amendment_number ORDER BY publication_date NULLS FIRST, first_seen NULLS FIRST) = 1""",
)
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a later delivery adds: the first version of a key wins, stored ones are never touched."""
    n = table(spark, d, "notices", "reference_number", "amendment_number", "publication_date", "first_seen").distinct()
    keys = ["reference_number", "amendment_number"]
    return insert_absent(n.where("publication_date < '2019-01-01'"), n.where("publication_date >= '2018-06-01'"), keys, ["publication_date", "first_seen"])


@catalog.query(
    "nested_sets",
    """WITH f AS (SELECT o_orderpriority AS p, o_custkey AS c, max(CAST(o_totalprice > 300000 AS INT)) AS a, max(CAST(o_totalprice > 200000 AS INT)) AS b, max(CAST(o_orderstatus = 'F' AS INT)) AS z FROM orders GROUP BY 1, 2)
    SELECT p, 'large' AS "inner", 'middle' AS "outer", count(*) FILTER (WHERE a = 1 AND b = 0) AS missing FROM f GROUP BY p UNION ALL SELECT p, 'middle', 'filled', count(*) FILTER (WHERE b = 1 AND z = 0) FROM f GROUP BY p""",
)
def nested_levels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderpriority", "o_custkey", "o_totalprice", "o_orderstatus")
    price = F.col("o_totalprice")
    tags = F.array_compact(F.array(F.when(price > 300000, F.lit("large")), F.when(price > 200000, F.lit("middle")), F.when(F.col("o_orderstatus") == "F", F.lit("filled")), F.lit("any")))
    rows = o.select(F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c"), F.explode(tags).alias("level"))
    return nested(rows, "p", "level", "c", ["large", "middle", "filled"])


@catalog.query(
    "key_changes",
    """WITH a AS (SELECT reference_number AS k, max(status) AS s FROM notices WHERE publication_date < '2020-01-01' AND reference_number IS NOT NULL GROUP BY 1), b AS (SELECT reference_number AS k, max(status) AS s FROM notices WHERE publication_date >= '2016-01-01' AND reference_number IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' ELSE 'same' END AS change, count(*) AS n_rows FROM a FULL JOIN b USING (k) GROUP BY 1""",
)
def changes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notices", "reference_number", "publication_date", "status").where("reference_number IS NOT NULL")
    part = lambda test: n.where(test).groupBy("reference_number").agg(F.max("status").alias("s"))
    return key_changes(part("publication_date < '2020-01-01'"), part("publication_date >= '2016-01-01'"), "reference_number", "s").groupBy("change").agg(F.count("*").alias("n_rows"))


@catalog.query("fingerprint", "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT)) AS BIGINT) AS digest FROM orders")
def orders_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint(table(spark, d, "orders", "o_orderkey"), "o_orderkey")


@catalog.query("json_props", "SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n_rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "props", "value")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n_rows"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@catalog.query("slope", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(corr(l_extendedprice, l_quantity), 4) AS correlation, count(*) AS n_rows FROM lineitem GROUP BY 1")
def slope(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares slope of price on quantity."""
    rows = table(spark, d, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity")
    return rows.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.corr("l_extendedprice", "l_quantity"), 4).alias("correlation"), F.count("*").alias("n_rows"))


@catalog.query(
    "program_trail",
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1, 2)
    SELECT o_custkey, string_agg(CAST(y AS VARCHAR) || ':' || CAST(total AS VARCHAR), ' ' ORDER BY y) AS trail, arg_max(total, y) AS latest FROM y GROUP BY o_custkey""",
)
def program_trail(spark: SparkSession, d: str) -> DataFrame:
    """Totals in cents of every year of a customer in order; at most one entry per year is packed."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    y = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("total"))
    packed = y.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("y", "total"))).alias("t"))
    return packed.select("o_custkey", F.array_join(F.transform("t", lambda x: F.concat(x["y"].cast("string"), F.lit(":"), x["total"].cast("string"))), " ").alias("trail"), F.element_at("t", -1)["total"].alias("latest"))


@catalog.query("base_rates", "SELECT coalesce(CAST(y AS VARCHAR), 'pooled') AS year, count(*) AS n_rows, round(avg(CAST(hit AS DOUBLE)), 6) AS rate FROM (SELECT year(o_orderdate) AS y, o_totalprice > 250000 AS hit FROM orders) GROUP BY ROLLUP (y)")
def base_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per year and pooled, from one rollup."""
    o = table(spark, d, "orders", "o_orderdate", "o_totalprice").select(F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 250000).cast("double").alias("hit"))
    r = o.rollup("y").agg(F.count("*").alias("n_rows"), F.round(F.avg("hit"), 6).alias("rate"))
    return r.select(F.coalesce(F.col("y").cast("string"), F.lit("pooled")).alias("year"), "n_rows", "rate")


@catalog.query("latest_year_rows", "SELECT o_orderpriority, count(*) AS n_rows, round(max(o_totalprice), 2) AS most FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1")
def latest_year_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderpriority", "o_orderdate", "o_totalprice").withColumn("y", F.year("o_orderdate"))
    return o.join(F.broadcast(o.agg(F.max("y").alias("y"))), "y").groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"), F.round(F.max("o_totalprice"), 2).alias("most"))


@catalog.query(
    "deciles",
    """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, CAST(k AS INT) AS decile, o_totalprice AS cut FROM r, range(1, 10) t(k) WHERE i = n * k // 10""",
)
def deciles(spark: SparkSession, d: str) -> DataFrame:
    """Positional cut points sorted[n * k // 10] of each class: places in one order of all rows, so no class is one task's."""
    o = rank_within(table(spark, d, "orders", "o_orderpriority", "o_totalprice", "o_orderkey"), ["o_orderpriority"], ["o_totalprice", "o_orderkey"])
    at = F.explode(F.filter(F.sequence(F.lit(1), F.lit(9)), lambda k: F.floor(F.col("class_size") * k / 10) == F.col("rank") - 1))
    return o.select("o_orderpriority", at.alias("decile"), F.col("o_totalprice").alias("cut"))


@catalog.query(
    "split_half",
    f"""WITH s AS (SELECT o_orderkey, mass >= 0.6 AS a, truth AS t, CAST(unnest(range(0, 20)) AS INT) AS split FROM {SCORED}),
    h AS (SELECT * FROM s WHERE left(md5(CAST(o_orderkey AS VARCHAR) || ':' || CAST(split AS VARCHAR) || ':1'), 1) < '8')
    SELECT split, round(count(*) FILTER (WHERE a AND t) / nullif(count(*) FILTER (WHERE t), 0), 6) AS recall, round(count(*) FILTER (WHERE a AND t) / nullif(count(*) FILTER (WHERE a), 0), 6) AS precision FROM h GROUP BY split""",
)
def halves(spark: SparkSession, d: str) -> DataFrame:
    return split_half(scored(spark, d), "o_orderkey", "mass", "truth", 0.6, 20)


@catalog.query(
    "split_half_fifty",
    f"""WITH s AS (SELECT o_orderkey, mass >= 0.6 AS a, truth AS t, CAST(unnest(range(0, 50)) AS INT) AS split FROM {SCORED}),
    h AS (SELECT * FROM s WHERE left(md5(CAST(o_orderkey AS VARCHAR) || ':' || CAST(split AS VARCHAR) || ':1'), 1) < '8')
    SELECT split, round(count(*) FILTER (WHERE a AND t) / nullif(count(*) FILTER (WHERE t), 0), 6) AS recall, round(count(*) FILTER (WHERE a AND t) / nullif(count(*) FILTER (WHERE a), 0), 6) AS precision FROM h GROUP BY split""",
)
def fifty_halves(spark: SparkSession, d: str) -> DataFrame:
    return split_half(scored(spark, d), "o_orderkey", "mass", "truth", 0.6, 50)
