"""Queries of the metadata, selection, alignment and grid operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import relational as R
from ..operators.signal import CHANNELS
from ..sources.views import emb_signal, run_log, table
from .registry import query, r, rounded

_NAMES = "[" + ", ".join(f"'{c}'" for c in CHANNELS) + "]"


@query("""with p as (select page_id, split(url, '/') as tok from pages)
select page_id, tok[-1] as last, tok[-2] as folder, coalesce(tok[3], '') as host, len(tok)::bigint as depth, coalesce(try_cast(nullif(regexp_extract(tok[-1], '([0-9]+)', 1), '') as bigint), -1) as number from p""")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = F.split("url", "/")
    number = F.coalesce(F.nullif(F.regexp_extract(F.try_element_at(tok, F.lit(-1)), "([0-9]+)", 1), F.lit("")).try_cast("bigint"), F.lit(-1).cast("bigint"))
    return table(spark, sf_dir, "pages").select("page_id", F.try_element_at(tok, F.lit(-1)).alias("last"), F.try_element_at(tok, F.lit(-2)).alias("folder"), F.coalesce(F.try_element_at(tok, F.lit(3)), F.lit("")).alias("host"), F.size(tok).cast("bigint").alias("depth"), number.alias("number"))


_PATHS = """select c_custkey as k, '/data/v2.0/' || case when c_custkey % 2 = 0 then '00_epilepsy' else '01_no_epilepsy' end || '/sub' || c_nationkey || '/s' || lpad((c_custkey % 7)::varchar, 3, '0') || '_' || (2000 + c_custkey % 20) || '/01_tcp/sub' || c_nationkey || '_t' || lpad((c_custkey % 5)::varchar, 3, '0') || '.edf' as path from customer"""


def _paths(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), lambda x: x.cast("string")
    k, n = F.col("c_custkey"), s(F.col("c_nationkey"))
    return c.select(k.alias("k"), F.concat(F.lit("/data/v2.0/"), F.when(k % 2 == 0, "00_epilepsy").otherwise("01_no_epilepsy"), F.lit("/sub"), n, F.lit("/s"), F.lpad(s(k % 7), 3, "0"), F.lit("_"), s(2000 + k % 20), F.lit("/01_tcp/sub"), n, F.lit("_t"), F.lpad(s(k % 5), 3, "0"), F.lit(".edf")).alias("path"))


@query(f"""with p as ({_PATHS}), t as (select path, split(path, '/') as tok from p)
select path, tok[-6] as version, tok[-4] as subject, regexp_extract(tok[-3], '^s([0-9]+)', 1)::int as session, regexp_extract(tok[-1], '_t([0-9]+)', 1)::int as segment, regexp_extract(tok[-3], '_([0-9]{{4}})', 1)::int as year,
case when list_contains(tok, '00_epilepsy') then 0 else 1 end as epilepsy from t""")
def path_description(spark, sf_dir):
    return R.require_label(R.path_description(_paths(spark, sf_dir)))


@query(f"""with p as ({_PATHS}), t as (select split(path, '/') as tok, path from p), d as (select tok[-4] as subject, regexp_extract(tok[-3], '_([0-9]{{4}})', 1)::int as year, 1 as month, 1 as day, regexp_extract(tok[-3], '^s([0-9]+)', 1)::int as session, regexp_extract(tok[-1], '_t([0-9]+)', 1)::int as segment, path from t)
select year, subject, session, segment from d order by year, month, day, subject, session, segment limit 25""")
def chronological_first(spark, sf_dir):
    d = R.path_description(_paths(spark, sf_dir)).withColumn("month", F.lit(1)).withColumn("day", F.lit(1))
    return R.chronological(d, 25).select("year", "subject", "session", "segment")


_HEADERS = """select c_custkey as k, case c_custkey % 4 when 0 then 'x  Age:' || (c_custkey % 90) || '  F  y' when 1 then 'x M  Age:' || (c_custkey % 90) || ' Age:7' when 2 then 'no header' else 'p F q M r Age:0.0109' end as header from customer"""


@query(f"""with h as ({_HEADERS}), x as (select k, regexp_extract_all(header, 'Age:([0-9]+)', 1) as a, regexp_extract_all(header, '\\s([F|M])\\s', 1) as g from h)
select k, case when len(a) = 1 then a[1]::int else -1 end as age, case when len(g) = 1 then g[1] else 'X' end as gender from x""")
def header_age_gender(spark, sf_dir):
    k = F.col("c_custkey")
    age = (k % 90).cast("string")
    h = F.when(k % 4 == 0, F.concat(F.lit("x  Age:"), age, F.lit("  F  y"))).when(k % 4 == 1, F.concat(F.lit("x M  Age:"), age, F.lit(" Age:7"))).when(k % 4 == 2, "no header").otherwise("p F q M r Age:0.0109")
    return R.age_gender(table(spark, sf_dir, "customer").select(k.alias("k"), h.alias("header"))).drop("header")


@query(f"""with n as (select c_custkey as k, case when c_custkey % 23 < 20 then 'EEG ' || ({_NAMES})[(c_custkey % 23)::int + 1] || case when c_custkey % 2 = 0 then '-REF' else '-LE' end else 'EKG' || (c_custkey % 23) end as name from customer),
c as (select k, upper(trim(regexp_replace(regexp_replace(name, '-(REF|LE)$', ''), '^EEG ', ''))) as channel from n)
select k, channel, coalesce(list_position({_NAMES}, channel) - 1, -1)::int as row, case when channel = 'PHOTIC PH' then 'stim' when list_contains({_NAMES}, channel) then 'eeg' else 'misc' end as kind from c""")
def channel_rename(spark, sf_dir):
    k, names = F.col("c_custkey"), F.array(*map(F.lit, CHANNELS))
    m = (k % 23).cast("int")
    name = F.when(m < 20, F.concat(F.lit("EEG "), F.try_element_at(names, m + 1), F.when(k % 2 == 0, "-REF").otherwise("-LE"))).otherwise(F.concat(F.lit("EKG"), m.cast("string")))
    return R.rename_channels(table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("name"))).select("k", "channel", F.coalesce("row", F.lit(-1)).alias("row"), "kind")


@query(f"select event_id, {r('case when value > 90 then null else value end')} as v from events")
def sanitise(spark, sf_dir):
    x = F.when(F.col("value") > 95, float("nan")).when(F.col("value") > 90, float("inf")).otherwise(F.col("value"))
    return rounded(table(spark, sf_dir, "events").select("event_id", R.sanitise(x).alias("v")), "v")


@query("select o_orderkey, o_custkey from orders anti join (select c_custkey from customer where c_nationkey = 3) c on o_custkey = c_custkey")
def discard_antijoin(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return R.discard(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), listed, ["o_custkey"])


@query("""select c_custkey, c_mktsegment from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and c_nationkey not in (2, 3)""")
def include_exclude_subjects(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    inc = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    exc = spark.createDataFrame([("2 ",), (" 3",)], "c_nationkey string")
    return R.include_exclude(c, "c_nationkey", inc, exc).drop("c_nationkey")


@query("select o_custkey, arg_min(o_orderpriority, o_orderkey) as o_orderpriority from orders group by o_custkey")
def first_label(spark, sf_dir):
    return R.first_label(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


_FIRST = "f as (select o_custkey as subject, o_totalprice as x, o_orderkey as pos from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderstatus = 'F') where k = 1)"


def _sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").alias("pos"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("pos"))
    return c, o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus")


@query(f"with {_FIRST} select c_custkey as subject, c_acctbal as x, c_custkey as pos, f.x as x_2 from customer join f on f.subject = c_custkey")
def align_two_sources(spark, sf_dir):
    a, b, _ = _sources(spark, sf_dir)
    return R.align(a, b, key="subject")


@query(f"with {_FIRST}, g as (select o_custkey as subject, o_totalprice as x from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderstatus = 'O') where k = 1) select c_custkey as subject, c_acctbal as x, c_custkey as pos, f.x as x_2, g.x as x_3 from customer join f on f.subject = c_custkey join g on g.subject = c_custkey")
def align_three_sources(spark, sf_dir):
    a, b, c = _sources(spark, sf_dir)
    return R.align(a, b, c, key="subject")


@query("select family, montage, length, count(*) as n from runs where (family, montage, length) in (('A', 'F', 1), ('N', 'O', 2), ('R', 'F', 7)) group by all", "runs")
def best_params_lookup(spark, sf_dir):
    p = spark.createDataFrame([("A", "F", 1, "mean"), ("N", "O", 2, "mean"), ("R", "F", 7, "mean")], "family string, montage string, length int, combiner string")
    return R.best_params(run_log(spark, sf_dir).withColumn("combiner", F.lit("mean")), p).groupBy("family", "montage", "length").agg(F.count(F.lit(1)).alias("n"))


_GRID = """with m(mi, montage) as (values (0, 'CAR'), (1, 'Cz'), (2, 'BipolarDB'), (3, 'Laplacian')), f(fi, family) as (values (0, 'spectral'), (1, 'gcc'), (2, 'utm')), s(si, seconds) as (values (0, 1), (1, 2), (2, 5)), c(ci, combiner) as (values (0, 'mean'), (1, 'std')),
g as (select (((mi * 3 + fi) * 3 + si) * 2 + ci)::bigint as config, montage, family, seconds, combiner from m, f, s, c)"""


def _grid(spark):
    return R.config_grid(spark, montage=["CAR", "Cz", "BipolarDB", "Laplacian"], family=["spectral", "gcc", "utm"], seconds=[1, 2, 5], combiner=["mean", "std"])


@query(f"{_GRID} select config, montage, family, seconds, combiner from g where not (family = 'gcc' and seconds = 1)")
def config_grid(spark, sf_dir):
    return _grid(spark).where("not (family = 'gcc' and seconds = 1)")


@query(f"{_GRID} select config, montage, family, seconds, combiner from g where config >= 20 and not (montage = 'Cz' and family = 'utm')")
def resume_and_skip(spark, sf_dir):
    done = spark.createDataFrame([("Cz", "utm")], "montage string, family string")
    return R.skip_existing(R.resume_from(_grid(spark), 20), done, ["montage", "family"]).select("config", "montage", "family", "seconds", "combiner")


_FAM = ["spectral", "cwt", "dwt", "mst", "sst", "cc", "plv", "gcc", "gplv", "utm"]


@query("""with f as (select [%s] as n), m as (select range as combo from range(1, 1024))
select combo, bit_count(combo)::bigint as size, array_to_string(list_filter(n, lambda x, i: (combo >> (i - 1)::bigint) & 1 = 1), '+') as feature_set from f, m where bit_count(combo) >= 2 and bit_count(combo) < 10""" % ", ".join(f"'{x}'" for x in _FAM))
def feature_combinations(spark, sf_dir):
    return R.combinations(spark, _FAM, 2, 10)


@query("with s as (select distinct rec as fold from sig) select fold, rec, case when rec = fold then 'test' else 'train' end as role from s, (select distinct rec from sig) r", "sig")
def loso_splits(spark, sf_dir):
    rows = emb_signal(spark, sf_dir).select("rec").distinct().withColumn("subject", F.col("rec"))
    return R.loso_splits(rows, "subject", "rec")


@query("""with r as (select distinct rec, rec % 2 as y from sig), x as (select f.rec as fold, r.rec, r.y, row_number() over (partition by f.rec, r.y order by md5('0/' || f.rec || '/' || r.rec), r.rec) as k, count(*) over (partition by f.rec, r.y) as n from r, r f where r.rec <> f.rec)
select fold, rec, y, case when k <= round(n * 0.3) then 'validation' else 'train' end as role from x union all select rec, rec, y, 'test' from r""", "sig")
def stratified_split(spark, sf_dir):
    rows = emb_signal(spark, sf_dir).select("rec").distinct().withColumn("y", F.col("rec") % 2)
    return R.train_validation(rows, "rec", "y", 0.3)


def _pair_sql(n: int) -> str:
    return f"select row_number() over (order by j, k) - 1 as p, j, k from range(0, {n}) a(j), range(0, {n}) b(k) where j > k"


@query(f"""with p as ({_pair_sql(19)}), b(bi, band) as (values (0, 'raw'), (1, 'delta'), (2, 'theta'), (3, 'alpha'), (4, 'beta'), (5, 'gamma'))
select bi * 171 + p as idx, band || '_' || ({_NAMES})[j + 1] || '_' || ({_NAMES})[k + 1] as name from p, b""")
def index_to_name_plv(spark, sf_dir):
    return R.plv_name(spark)


@query(f"""with m(mi, metric) as (values (0, 'mean'), (1, 'median'), (2, 'std'), (3, 'skewness'), (4, 'kurtosis'), (5, 'zero_crossings'), (6, 'nleo_env_diff'), (7, 'nleo_teager'), (8, 'energy_time'), (9, 'energy_freq'), (10, 'shannon_entropy'), (11, 'vpp'), (12, 'npeaks'))
select c * 13 + mi as idx, ({_NAMES})[c + 1] || '_' || metric as name from range(0, 19) x(c), m""")
def index_to_name_utm(spark, sf_dir):
    return R.utm_name(spark)


@query(f"""with b(bi, band) as (values (0, 'delta'), (1, 'theta'), (2, 'alpha'), (3, 'beta'), (4, 'gamma')) select bi * 19 + c as idx, band || '_' || ({_NAMES})[c + 1] as name from range(0, 19) x(c), b""")
def index_to_name_spectral(spark, sf_dir):
    return R.spectral_name(spark)


@query("select c_nationkey, array_to_string(list_sort(list(c_custkey)), ',') as ids from customer group by all")
def groups_to_ids(spark, sf_dir):
    return R.groups_to_ids(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey").withColumn("ids", F.array_join("ids", ","))


@query("with n as (select rec, ch, count(*) as n from evt group by all) select rec, ch, n, i as i_window, i * 5 as i_start, i * 5 + 5 as i_stop from n, unnest(range(0, n // 5)) as u(i)", "evt")
def windows_metadata(spark, sf_dir):
    from ..sources.views import evt_signal

    n = evt_signal(spark, sf_dir).groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"))
    return R.windows_metadata(n, 5)


@query("select user_id, case when event_type = 'click' then value else 250.0 end as fs from events")
def sampling_frequency(spark, sf_dir):
    source = F.when(F.col("event_type") == "click", "ips").otherwise("background")
    return table(spark, sf_dir, "events").select("user_id", R.sampling_frequency(source, F.col("value")).alias("fs"))
