"""One query per operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import api
from .functions import text as X
from .operators import profile as P
from .operators.stages import Stages, staged
from .operators.transform import Drop, Rename, apply
from .plans.predicate import Predicate
from .sources import readers, writers
from .sources.files import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def where(name: str, source: str, predicate: str, sql: str, columns: list[str] | None = None, derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query that filters a table, or columns derived from it, by a predicate."""

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, source)
        df = Predicate.parse(predicate).filter(derive(df) if derive else df)
        return df.select(*columns) if columns else df


# --- derived columns for nulls, empties and text ---------------------------------------------------------


def mod(c: str, n: int) -> Column:
    return F.col(c) % n


def sparse_names(df: DataFrame) -> DataFrame:
    v = F.when(mod("c_custkey", 7) == 0, None).when(mod("c_custkey", 7) == 1, "").otherwise(F.col("c_name"))
    return df.select("c_custkey", v.alias("v"))


def sparse_numbers(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", F.when(mod("c_custkey", 7) != 0, mod("c_custkey", 3)).alias("v"))


def text_keys(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", F.when(mod("o_orderkey", 50) == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("t"))


def parsed_props(df: DataFrame) -> DataFrame:
    return df.withColumn("props", F.from_json("props", "struct<k:bigint>"))


def props_lines(df: DataFrame) -> DataFrame:
    """The events as NDJSON: the id and the parsed properties."""
    return df.select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}")).alias("value"))


# --- scans and sinks -------------------------------------------------------------------------------------


@query("scan_parquet", "select * from orders")
def scan_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/orders.parquet").df


@query("scan_ndjson_props", "select event_id, cast(json_extract_string(props,'$.k') as bigint) k from events")
def scan_ndjson(spark, sf):
    out = Store(spark).scratch("events.ndjson")
    props_lines(table(spark, sf, "events")).write.text(out)
    return readers.read_ndjson(spark, out).df.select("event_id", F.col("props.k").alias("k"))


def _delimited(name: str, fmt: str) -> None:
    @query(name, "select cast(s_suppkey as varchar) s_suppkey, s_name, cast(s_nationkey as varchar) s_nationkey from supplier")
    def run(spark, sf):
        df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        out = Store(spark).scratch(f"supplier.{fmt}")
        writers.write(readers.Records(df, "parquet"), out, fmt, header=True)
        return readers.read(spark, out, fmt, header=True).df


_delimited("scan_csv_roundtrip", "csv")
_delimited("scan_tsv_roundtrip", "tsv")


@query("scan_csv_headerless", "select cast(r_regionkey as varchar) col0, r_name col1 from region")
def scan_headerless(spark, sf):
    out = Store(spark).scratch("region.csv")
    writers.write(readers.Records(table(spark, sf, "region").select("r_regionkey", "r_name"), "parquet"), out, "csv")
    return readers.read(spark, out, "csv").df


def _arrow(name: str, single: bool) -> None:
    @query(name, "select * from part")
    def run(spark, sf):
        out = Store(spark).scratch("part.arrow")
        writers.write(readers.Records(table(spark, sf, "part"), "parquet"), out, "arrow", single=single)
        return readers.read(spark, out, "arrow").df


_arrow("scan_arrow", True)
_arrow("sink_arrow_roundtrip", False)


@query("sink_json_text", """select '{"n_nationkey":'||n_nationkey||',"n_name":"'||n_name||'","n_regionkey":'||n_regionkey||'}' as doc from nation""")
def sink_json(spark, sf):
    return X.json_lines(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")).withColumnRenamed("value", "doc")


@query("sink_csv_text", r"select p_partkey||','||p_name||','||regexp_replace(cast(p_retailprice as varchar),'\.0$','') as line from part")
def sink_csv(spark, sf):
    return X.csv_lines(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")).withColumnRenamed("value", "line")


def awkward(df: DataFrame) -> DataFrame:
    """Nations with texts that sinks must escape, nulls and floats."""
    k = F.col("n_nationkey")
    said = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat("n_name", F.lit(', "so", \\ he said'))).when(k % 5 == 2, F.concat(F.lit(" "), "n_name")).when(k % 5 == 3, F.concat("n_name", F.lit("\nnext"))).otherwise(F.lit(""))
    return df.select(k.alias("k"), said.alias("s"), (k / 8).alias("f"), (k % 2 == 0).alias("b"))


_AWKWARD = """with t as (select n_nationkey k, case n_nationkey % 5 when 0 then null when 1 then n_name || ', "so", \\ he said' when 2 then ' ' || n_name when 3 then n_name || chr(10) || 'next' else '' end s,
    n_nationkey / 8.0 f, n_nationkey % 2 = 0 b from nation), u as (select *, case when f = floor(f) then cast(f::bigint as varchar) else cast(f::double as varchar) end ft, cast(b as varchar) bt from t)"""


@query("sink_json_escapes", _AWKWARD + """ select '{"k":' || k || ',"s":' || coalesce('"' || replace(replace(replace(s, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"', 'null') || ',"f":' || ft || ',"b":' || bt || '}' as doc from u""")
def sink_json_escapes(spark, sf):
    return X.json_lines(awkward(table(spark, sf, "nation"))).withColumnRenamed("value", "doc")


@query("sink_csv_quoting", _AWKWARD + """ select k || ',' || case k % 5 when 0 then '' when 4 then '' else '"' || replace(s, '"', '""') || '"' end || ',' || ft || ',' || bt as line from u""")
def sink_csv_quoting(spark, sf):
    return X.csv_lines(awkward(table(spark, sf, "nation"))).withColumnRenamed("value", "line")


@query("scan_csv_folder", "select cast(s_suppkey as varchar) s_suppkey, s_name from supplier")
def scan_csv_folder(spark, sf):
    """Every file of a folder has the header, and every one is taken off."""
    out = Store(spark).scratch("supplier.csv")
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name").repartition(3)
    writers.write(readers.Records(df, "parquet"), out, "csv", header=True, single=False)
    return readers.read(spark, out, "csv", header=True).df


@query("scan_csv_multiline", _AWKWARD + " select cast(k as varchar) k, coalesce(s, '') s, ft as f, bt as b from u")
def scan_csv_multiline(spark, sf):
    """Line breaks inside quotes."""
    out = Store(spark).scratch("nation.csv")
    writers.write(readers.Records(awkward(table(spark, sf, "nation")), "parquet"), out, "csv", header=True)
    return readers.read(spark, out, "csv", header=True).df


@query("sink_parquet_sorted", "select n_name,n_nationkey,n_regionkey from nation")
def sink_parquet(spark, sf):
    out = Store(spark).scratch("nation.parquet")
    writers.write(readers.Records(table(spark, sf, "nation"), "parquet"), out, "parquet")
    return readers.read(spark, out, "parquet").df


@query("convert_matrix", "select r_name, 25::bigint as n from region")
def convert_matrix(spark, sf):
    """Region through all 25 pairs of formats: how often each name comes back."""
    formats, store = ("json", "parquet", "csv", "tsv", "arrow"), Store(spark)
    source, names = table(spark, sf, "region").select("r_regionkey", "r_name"), None
    for first in formats:
        a = store.scratch(f"a.{first}")
        writers.write(readers.Records(source, "parquet"), a, first, header=True)
        for second in formats:
            b = store.scratch(f"b.{second}")
            api.process(spark, a, b, api.Options(input_format=first, output_format=second, csv_has_header=True))
            back = readers.read(spark, b, second, header=True).df.select("r_name")
            names = back if names is None else names.unionByName(back)
    return names.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("raw_text_passthrough", """select '{"n_nationkey":'||n_nationkey||',"n_name":"'||n_name||'"}' as line from nation""")
def raw_text(spark, sf):
    store = Store(spark)
    a, b = store.scratch("a.ndjson"), store.scratch("b.ndjson")
    writers.write(readers.Records(table(spark, sf, "nation").select("n_nationkey", "n_name"), "parquet"), a, "json")
    api.process(spark, a, b)
    return readers.lines(spark, b).withColumnRenamed("value", "line")


# --- predicates ------------------------------------------------------------------------------------------

where("where_int_cmp", "lineitem", "l_linenumber >= 3", "select l_orderkey,l_linenumber from lineitem where l_linenumber >= 3", ["l_orderkey", "l_linenumber"])
where("where_float_cmp", "lineitem", "l_discount > 0.05", "select l_orderkey,l_discount from lineitem where l_discount > 0.05::double", ["l_orderkey", "l_discount"])
where(
    "where_float32", "lineitem", "f = 0.1", "select l_orderkey, l_linenumber from lineitem where l_discount::float = 0.1::float", ["l_orderkey", "l_linenumber"],
    lambda df: df.select("l_orderkey", "l_linenumber", F.col("l_discount").cast("float").alias("f")),
)
where("where_str_eq", "customer", "c_mktsegment = 'BUILDING'", "select * from customer where c_mktsegment = 'BUILDING'")
where("where_str_range", "customer", "c_name < 'Customer#000000500'", "select c_custkey,c_name from customer where c_name < 'Customer#000000500'", ["c_custkey", "c_name"])
where(
    "where_temporal_str", "orders", "o_orderdate >= '1997-01-01' and o_orderdate < '1998-01-01'",
    "select o_orderkey from orders where strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S.%fZ') >= '1997-01-01' and strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S.%fZ') < '1998-01-01'", ["o_orderkey"],
)
where("where_temporal_miss", "orders", "not (o_orderdate > 1000)", "select o_orderkey from orders", ["o_orderkey"])
where(
    "where_text_number", "orders", "t > 500",
    "select o_orderkey from (select o_orderkey, case when o_orderkey%50=0 then 'n/a' else cast(o_orderkey as varchar) end t from orders) where coalesce(try_cast(t as bigint) > 500,false)",
    ["o_orderkey"], text_keys,
)
where(
    "where_bool_text", "labels", "b = true", "select doc_id from labels where toxic = 1", ["doc_id"],
    lambda df: df.select("doc_id", F.when(F.col("toxic") == 1, "TRUE").otherwise("false").alias("b")),
)
where("where_in", "events", "event_type in ('error','purchase')", "select event_id,event_type from events where event_type in ('error','purchase')", ["event_id", "event_type"])
where("where_not_in", "events", "event_type not in ('error')", "select event_id,event_type from events where event_type not in ('error')", ["event_id", "event_type"])
where("where_in_mixed", "orders", "o_orderpriority in (1,'1-URGENT')", "select o_orderkey from orders where o_orderpriority = '1-URGENT'", ["o_orderkey"])
_SPARSE = "(select c_custkey, case when c_custkey%7=0 then null when c_custkey%7=1 then '' else c_name end v from customer)"
where("where_is_empty", "customer", "v is empty", f"select c_custkey from {_SPARSE} where coalesce(v,'')=''", ["c_custkey"], sparse_names)
where("where_is_not_empty", "customer", "v is not empty", f"select c_custkey from {_SPARSE} where coalesce(v,'')<>''", ["c_custkey"], sparse_names)
where("where_contains", "part", "p_name contains 'widget'", "select p_partkey,p_name from part where contains(p_name,'widget')", ["p_partkey", "p_name"])
where("where_contains_number", "orders", "o_orderkey contains '77'", "select o_orderkey from orders where contains(cast(o_orderkey as varchar),'77')", ["o_orderkey"])
where("where_starts_with", "part", "p_type starts_with 'ECO'", "select p_partkey,p_type from part where starts_with(p_type,'ECO')", ["p_partkey", "p_type"])
where(
    "where_and_or", "lineitem", "l_quantity >= 30 and (l_returnflag = 'R' or l_linestatus = 'O')",
    "select l_orderkey,l_linenumber from lineitem where l_quantity >= 30 and (l_returnflag='R' or l_linestatus='O')", ["l_orderkey", "l_linenumber"],
)
where(
    "where_not_null_semantics", "customer", "not (v = 1)",
    "select c_custkey from (select c_custkey, case when c_custkey%7=0 then null else c_custkey%3 end v from customer) where not coalesce(v=1,false)", ["c_custkey"], sparse_numbers,
)
where("where_nested_path", "events", "props.k > 50", "select event_id from events where cast(json_extract_string(props,'$.k') as bigint) > 50", ["event_id"], parsed_props)


@query(
    "where_miss_count",
    "select count(*) rows_read, count(*) filter (where coalesce(try_cast(t as bigint)>500,false)) kept, count(*) filter (where try_cast(t as bigint) is null) misses "
    "from (select case when o_orderkey%50=0 then 'n/a' else cast(o_orderkey as varchar) end t from orders)",
)
def where_misses(spark, sf):
    df = text_keys(table(spark, sf, "orders"))
    bound = Predicate.parse("t > 500").bind(df.schema)
    return df.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(bound.match).alias("kept"), F.sum(bound.misses).cast("long").alias("misses"))


@query("where_unseen", "select 'nmae' as unseen, n_nationkey from nation where n_nationkey >= 20")
def where_unseen(spark, sf):
    """A column that no record has matches nothing and is named."""
    df, p = table(spark, sf, "nation"), Predicate.parse("nmae = 'x' or n_nationkey >= 20")
    return p.filter(df).select(F.lit(",".join(p.bind(df.schema).unseen)).alias("unseen"), "n_nationkey")


@query("where_years", "select unnest([1, 2]) as k")
def where_years(spark, sf):
    """Timestamps of years beyond four digits compare as their texts do, which begin with a sign. The rows are of the years 9996, 9998, 10001 and 10003."""
    micros = F.lit(253_402_300_800_000_000) + (F.col("k") * 2 - 5) * F.lit(31_622_400_000_000)
    rows = spark.sql("select explode(array(1, 2, 3, 4)) as k").withColumn("t", F.timestamp_micros(micros))
    return Predicate.parse("t >= '9995-01-01'").filter(rows).select("k")


# --- transforms and stages -------------------------------------------------------------------------------


@query("transform_rename", "select n_nationkey, n_name as name, n_regionkey from nation")
def transform_rename(spark, sf):
    return apply(table(spark, sf, "nation"), [Rename("n_name", "name")])


@query("transform_drop", "select c_custkey,c_name,c_nationkey,c_mktsegment from customer")
def transform_drop(spark, sf):
    return apply(table(spark, sf, "customer"), [Drop("c_acctbal")])


@query("transform_rename_nested", "select event_id, cast(json_extract_string(props,'$.k') as bigint) as key from events")
def transform_rename_nested(spark, sf):
    return apply(parsed_props(table(spark, sf, "events")), [Rename("props.k", "props.key")]).select("event_id", "props.key")


@query("transform_drop_nested", "select event_id, event_id as j from events")
def transform_drop_nested(spark, sf):
    df = parsed_props(table(spark, sf, "events")).withColumn("props", F.struct(F.col("props.k").alias("k"), F.col("event_id").alias("j")))
    return apply(df, [Drop("props.k")]).select("event_id", "props.*")


@query("stage_order", "select n_nationkey, upper(n_name) as name from nation where n_regionkey=1")
def stage_order(spark, sf):
    stages = Stages([Predicate.parse("n_regionkey = 1")], [lambda df: df.withColumn("n_name", F.upper("n_name"))], [Rename("n_name", "name"), Drop("n_regionkey")])
    return staged(table(spark, sf, "nation"), stages)[0]


@query("row_filter_custom", "select event_id,user_id from events where user_id % 2 = 0")
def row_filter(spark, sf):
    return staged(table(spark, sf, "events"), Stages([F.col("user_id") % 2 == 0]))[0].select("event_id", "user_id")


@query("record_transform_custom", "select p_partkey, upper(p_name) as p_name from part")
def record_transform(spark, sf):
    return staged(table(spark, sf, "part"), Stages(transforms=[lambda df: df.withColumn("p_name", F.upper("p_name"))]))[0].select("p_partkey", "p_name")


# --- profiles --------------------------------------------------------------------------------------------


@query("profile_records", "select count(*) as records from lineitem")
def profile_records(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("records"))


@query("profile_attributes", "select unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) as attribute")
def profile_attributes(spark, sf):
    return P.attribute_counts(P.value_counts(table(spark, sf, "orders"))).select("attribute")


@query(
    "profile_fill_rate",
    f"select 'v' as attribute, count(*) filter (where coalesce(v,'')<>'') as non_empty, count(*) filter (where coalesce(v,'')<>'')::double*100::double/count(*)::double as pct from {_SPARSE}",
)
def profile_fill_rate(spark, sf):
    found = P.entries(sparse_names(table(spark, sf, "customer")), ["v"])
    return found.groupBy("attribute").agg(F.count("text").alias("non_empty"), (F.count("text").cast("double") * 100 / F.count(F.lit(1))).alias("pct"))


@query(
    "profile_distinct",
    "select 'o_orderstatus' as attribute, count(distinct o_orderstatus) as distinct_values from orders union all select 'o_orderpriority', count(distinct o_orderpriority) from orders",
)
def profile_distinct(spark, sf):
    return P.attribute_counts(P.value_counts(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))).select("attribute", "distinct_values")


@query(
    "profile_topn",
    r"select attribute,value,n from (select *, row_number() over (partition by attribute order by n desc, value) rn from (select 'o_orderpriority' as attribute, o_orderpriority as value, "
    r"count(*) n from orders group by all union all select 'l_discount', regexp_replace(cast(l_discount as varchar),'\.0$',''), count(*) from lineitem group by all)) where rn<=3",
)
def profile_topn(spark, sf):
    tops = [P.top_values(P.value_counts(table(spark, sf, t).select(c)), 3) for t, c in (("orders", "o_orderpriority"), ("lineitem", "l_discount"))]
    return tops[0].unionByName(tops[1]).select("attribute", "value", "n")


@query("profile_list_value", "select 'embedding' as attribute, '[list]' as value, count(*) as n from embeddings")
def profile_list(spark, sf):
    return P.top_values(P.value_counts(table(spark, sf, "embeddings").select("embedding"))).select("attribute", "value", "n")


@query("profile_columns", "select 'props.k' as attribute, count(*) as non_empty from events where json_extract_string(props,'$.k') is not null")
def profile_columns(spark, sf):
    return P.attribute_counts(P.value_counts(parsed_props(table(spark, sf, "events")), ["props"])).select("attribute", "non_empty")


@query("profile_where", "select count(*) as records, count(distinct user_id) as distinct_users from events where event_type='error'")
def profile_where(spark, sf):
    df = Predicate.parse("event_type = 'error'").filter(table(spark, sf, "events"))
    counts = P.value_counts(df.select("user_id"))
    return counts.agg(F.sum("n").alias("records"), F.count("text").alias("distinct_users"))


@query(
    "profile_approx_topk",
    """with e as (select 'event_type' as attribute, event_type as value from events union all select 'user_id', cast(user_id as varchar) from events),
    c as (select attribute, value, count(*) as n from e group by 1, 2),
    r as (select *, row_number() over (partition by attribute order by n desc, value) as rank from c)
    select attribute, value, n, 0::bigint as max_error from r where rank <= 5""",
)
def profile_approx(spark, sf):
    """Counters for every value: the estimates are the counts."""
    counts = P.approximate_counts(table(spark, sf, "events").select("user_id", "event_type"), 1_000_000)
    return P.top_values(counts, 5, "max_error").drop("rank")


@query("profile_approx_bounds", "select 'user_id' as attribute, count(distinct user_id)::bigint as n_values, 0::bigint as n_outside, true as some_estimated from events")
def profile_approx_bounds(spark, sf):
    """Too few counters, in several tables: every true count lies within the error that is given."""
    df = table(spark, sf, "events").select("user_id")
    true = P.value_counts(df).select("text", F.col("n").alias("true"))
    few = true.count() // 4
    both = P.approximate_counts(df.repartition(4, "user_id"), few).unionByName(P.approximate_counts(df.repartition(3), few)).join(true, "text", "right")
    inside = (F.abs(F.col("n") - F.col("true")) <= F.col("max_error")) | F.col("n").isNull()
    return both.agg(F.lit("user_id").alias("attribute"), F.count_distinct("text").alias("n_values"), F.count_if(~inside).alias("n_outside"), (F.max("max_error") > 0).alias("some_estimated"))


# --- runs ------------------------------------------------------------------------------------------------


@query("deliver_stats", """select count(*)::bigint as rows_read, count(*) filter (where not (n_nationkey >= 20))::bigint as rows_filtered, 25::bigint as predicate_misses,
    count(*) filter (where n_nationkey >= 20)::bigint as documents from nation""")
def deliver_stats(spark, sf):
    documents: list[bytes] = []
    o = api.Options(input_format="parquet", where="n_nationkey >= 20 or n_name > 5")
    stats = api.deliver(spark, f"{sf}/nation.parquet", documents.append, o)
    misses = stats.predicate_misses + len(documents)  # the right side is not asked where the left one holds
    return spark.createDataFrame([(stats.rows_read, stats.rows_filtered, misses, len(documents))], "rows_read long, rows_filtered long, predicate_misses long, documents long")


@query("consume_sum", "select count(*) as n, cast(sum(o_orderkey) as bigint) as s from orders")
def consume_sum(spark, sf):
    import pyarrow.compute as pc

    def partial(batches):
        n = s = 0
        for batch in batches:
            n, s = n + batch.num_rows, s + (pc.sum(batch.column("o_orderkey")).as_py() or 0)
        return n, s

    n, s = api.consume(spark, f"{sf}/orders.parquet", partial, lambda a, b: (a[0] + b[0], a[1] + b[1]), api.Options(input_format="parquet"))
    return spark.createDataFrame([(n, s)], "n long, s long")


@query("row_errors_skip", "select count(*) filter (where event_id%100<>0) rows_read, count(*) filter (where event_id%100=0) rows_skipped from events")
def row_errors(spark, sf):
    df = table(spark, sf, "events")
    bad = df.where("event_id % 100 = 0").count()
    df = df.withColumn("props", F.when(mod("event_id", 100) == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")))
    store = Store(spark)
    source = store.scratch("events.ndjson")
    writers.copy_lines(props_lines(df), source)
    stats = api.process(spark, source, store.scratch("out.csv"), api.Options(output_format="parquet", max_row_errors=bad, transforms=[lambda d: d.select("event_id")]))
    return spark.createDataFrame([(stats.rows_read, stats.rows_skipped)], "rows_read long, rows_skipped long")


@query("run_stats", "select count(*) as rows_read, count(*) filter (where event_type<>'error') as rows_filtered from events")
def run_stats(spark, sf):
    stats = api.process(spark, f"{sf}/events.parquet", Store(spark).scratch("out.ndjson"), api.Options(input_format="parquet", where="event_type = 'error'"))
    return spark.createDataFrame([(stats.rows_read, stats.rows_filtered)], "rows_read long, rows_filtered long")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, rename and drop in one plan over the largest table."""
    stages = Stages(
        [Predicate.parse("l_quantity >= 30 and l_returnflag in ('R','A') and l_linestatus is not empty")],
        rules=[Rename("l_extendedprice", "price"), Drop("l_tax")],
    )
    return staged(readers.read_parquet(spark, f"{sf}/lineitem.parquet").df, stages)[0]


@query(
    "convert_flagship",
    "select l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice as price,l_discount,l_returnflag,l_linestatus,l_shipdate from lineitem "
    "where l_quantity >= 30 and l_returnflag in ('R','A') and coalesce(l_linestatus,'') <> ''",
)
def convert_flagship(spark, sf):
    return flagship(spark, sf)
