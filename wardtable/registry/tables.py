"""Queries for columns, expressions, joins, pivots and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardtable.functions import expressions as X
from wardtable.functions.tables import literal_table
from wardtable.operators import columns as C
from wardtable.operators import joins as J
from wardtable.operators import reshape as R
from wardtable.operators import stats as S
from wardtable.operators.scaling import MinMax
from wardtable.registry.base import query

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# --- the flagship: item table -> wide, two versions per item, joined to its base ----


def symptom_wide(customers, events):
    keys = ["user_id", "day"]
    items = events.select("user_id", events.ts.cast("date").cast("string").alias("day"), "event_type", "value")
    wide = R.pivot_sum(items, keys, "event_type", F.col("value"))
    names = C.other_columns(wide, keys)
    both = wide.select(
        F.col("user_id").alias("c_custkey"),
        "day",
        *[X.presence(F.col(n)).alias(n) for n in names],
        *[X.duration_class(F.col(n)).alias(f"{n}_class") for n in names],
    )
    joined = J.join_forms(customers.select("c_custkey"), [both], ["c_custkey"], balance=True)
    return C.fill_missing(joined, 0, only=C.other_columns(joined, ["c_custkey", "day"]))


_sums = ", ".join(
    f"coalesce(sum(value) filter (where event_type = '{t}'), 0) as {t}" for t in EVENT_TYPES
)
_flags = ", ".join(
    f"coalesce(case when w.{t} > 0 then 1 else 0 end, 0) as {t}, "
    f"case when w.{t} is null or w.{t} = 0 then 0 when w.{t} <= 7 then 1 else 2 end as {t}_class"
    for t in EVENT_TYPES
)


@query(
    "symptom_wide",
    f"""
    with w as (select user_id, cast(cast(ts as date) as varchar) as day, {_sums}
               from events group by 1, 2)
    select c.c_custkey, w.day, {_flags}
    from customer c left join w on w.user_id = c.c_custkey""",
)
def _(t):
    return symptom_wide(t("customer"), t("events"))


# --- pivots -----------------------------------------------------------------


@query(
    "pivot_count_prefixed",
    """
    select o_custkey,
      count(*) filter (where o_orderstatus = 'F') as "colo_F",
      count(*) filter (where o_orderstatus = 'O') as "colo_O",
      count(*) filter (where o_orderstatus = 'P') as "colo_P"
    from orders group by 1""",
)
def _(t):
    wide = R.pivot_count(t("orders"), ["o_custkey"], "o_orderstatus")
    return C.prefix_columns(wide, "colo_", ["o_custkey"])


@query(
    "one_hot",
    "select c_custkey, "
    + ", ".join(
        f"case when c_mktsegment = '{s}' then 1 else 0 end as \"c_mktsegment_{s}\""
        for s in SEGMENTS
        if s != "BUILDING"
    )
    + " from customer",
)
def _(t):
    c = t("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    wide = R.one_hot(c, ["c_mktsegment"])
    return wide.select("c_custkey", *[wide[n].cast("int").alias(n) for n in wide.columns[1:]])


@query(
    "positive_names",
    "with w as (select user_id, cast(cast(ts as date) as varchar) as day, "
    + ", ".join(f"count(*) filter (where event_type = '{t}') as {t}" for t in EVENT_TYPES)
    + " from events group by 1, 2) select user_id, day, coalesce(nullif(concat_ws(', ', "
    + ", ".join(f"case when {t} = 1 then '{t}' end" for t in EVENT_TYPES)
    + "), ''), 'NEGATIVE') as result from w",
)
def _(t):
    e = t("events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type")
    wide = R.pivot_count(e, ["user_id", "day"], "event_type")
    names = C.other_columns(wide, ["user_id", "day"])
    return wide.select("user_id", "day", F.array_join(X.positive_names(names), ", ").alias("result"))


@query(
    "explode_weight",
    "with w as (select user_id, cast(cast(ts as date) as varchar) as day, "
    + ", ".join(f"count(*) filter (where event_type = '{t}') as {t}" for t in EVENT_TYPES)
    + " from events group by 1, 2), r as ("
    + " union all ".join(f"select user_id, day, '{t}' as result from w where {t} = 1" for t in EVENT_TYPES)
    + " union all select user_id, day, 'NEGATIVE' from w where "
    + " and ".join(f"{t} <> 1" for t in EVENT_TYPES)
    + """), j as (select c.c_custkey, r.day, r.result from customer c left join r on r.user_id = c.c_custkey)
    select c_custkey, day, result, round(1.0 / n, 9) as weight, case when n > 1 then 1 else 0 end as co_infection
    from (select *, count(*) over (partition by c_custkey) as n from j)""",
)
def _(t):
    e = t("events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type")
    wide = R.pivot_count(e, ["user_id", "day"], "event_type")
    names = C.other_columns(wide, ["user_id", "day"])
    lists = wide.select(F.col("user_id").alias("c_custkey"), "day", X.positive_names(names).alias("result"))
    joined = J.join_forms(t("customer").select("c_custkey"), [lists], ["c_custkey"], balance=True)
    rows = R.row_weight(R.explode_list(joined, "result"), "c_custkey")
    return rows.withColumn("weight", F.round("weight", 9))


# --- joins ------------------------------------------------------------------


@query(
    "exists_flag",
    """select c_custkey, case when exists (select 1 from orders o where o.o_custkey = c_custkey
       and o.o_orderpriority = '1-URGENT') then 1 else 0 end as has_urgent from customer""",
)
def _(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.exists_flag(t("customer").select("c_custkey"), urgent, ["c_custkey"], "has_urgent")


@query(
    "any_positive",
    """with a as (select o_custkey, max(case when o_totalprice - 450000 > 0 then 1 else 0 end) as hit
                  from orders group by 1)
       select c_custkey, coalesce(hit, 0) as any_large from customer left join a on o_custkey = c_custkey""",
)
def _(t):
    orders = t("orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.nullif(F.col("o_totalprice") - 450000, F.lit(0)).alias("over"),
    )
    hits = S.any_positive(orders, ["c_custkey"], "over", "any_large")
    joined = J.join_forms(t("customer").select("c_custkey"), [hits], ["c_custkey"])
    filled = C.fill_missing(joined, False, only=["any_large"])
    return filled.withColumn("any_large", F.when(F.col("any_large"), 1).otherwise(0))


@query(
    "natural_left_join",
    """select o_orderkey, o_orderdate_text, n_lines, qty
       from (select o_orderkey, cast(cast(o_orderdate as date) as varchar) as o_orderdate_text from orders)
       left join (select l_orderkey as k, count(*) as n_lines, round(sum(l_quantity), 2) as qty
                  from lineitem group by 1) on k = o_orderkey""",
)
def _(t):
    orders = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate_text"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )
    return J.natural_left_join(orders, lines)


@query(
    "form_chain_join",
    """
    with a as (select o_custkey as k, count(*) as n_orders from orders where o_orderstatus = 'F' group by 1),
         b as (select o_custkey as k, count(*) as n_orders, round(max(o_totalprice), 2) as top from orders
               where o_orderpriority = '1-URGENT' group by 1),
         d as (select user_id as k, count(*) as n_events from events group by 1)
    select c_custkey, a.n_orders as n_orders_x, b.n_orders as n_orders_y, b.top,
           coalesce(d.n_events, 0) as n_events
    from customer left join a on a.k = c_custkey left join b on b.k = c_custkey left join d on d.k = c_custkey""",
)
def _(t):
    key = F.col("o_custkey").alias("c_custkey")
    orders = t("orders")
    a = orders.filter("o_orderstatus = 'F'").groupBy(key).agg(F.count(F.lit(1)).alias("n_orders"))
    b = orders.filter("o_orderpriority = '1-URGENT'").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.max("o_totalprice"), 2).alias("top")
    )
    d = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    base = J.join_forms(t("customer").select("c_custkey"), [a, b], ["c_custkey"])
    return J.join_zero_filled(base, [d], ["c_custkey"])


@query(
    "inner_last_date",
    """
    with d as (select o_custkey, cast(o_orderdate as date) as day from orders),
         v as (select o_custkey, count(distinct day) as n_visits, max(day) as last_day from d group by 1)
    select distinct d.o_custkey, cast(d.day as varchar) as day, v.n_visits, cast(v.last_day as varchar) as last_day,
           cast(date_diff('day', v.last_day, d.day) as integer) as days
    from d join v on d.o_custkey = v.o_custkey""",
)
def _(t):
    visits = t("orders").select("o_custkey", X.parse_date(F.col("o_orderdate").cast("string").substr(1, 10)).alias("day"))
    last = S.latest_per_key(visits, ["o_custkey"], "day", "last_day")
    count = S.distinct_per_key(visits, ["o_custkey"], "day", "n_visits")
    rows = J.balanced_join(visits.distinct(), last, ["o_custkey"], "inner", right_unique=True)
    rows = J.balanced_join(rows, count, ["o_custkey"], right_unique=True)
    return rows.select(
        "o_custkey",
        F.col("day").cast("string").alias("day"),
        "n_visits",
        F.col("last_day").cast("string").alias("last_day"),
        X.days_between(F.col("day"), F.col("last_day")).alias("days"),
    )


_DICTIONARY = """dict as (select cast(n_nationkey as varchar) as code,
       case when n_regionkey = 2 then null else n_name end as label from nation where n_regionkey <> 4)"""


def _dictionary(t):
    return (
        t("nation")
        .filter("n_regionkey <> 4")
        .select(
            F.col("n_nationkey").cast("string").alias("code"),
            F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("label"),
        )
    )


@query(
    "lookup_null",
    f"with {_DICTIONARY} select c_custkey, label from customer left join dict on code = cast(c_nationkey as varchar)",
)
def _(t):
    c = t("customer")
    return J.lookup(c, F.col("c_nationkey"), _dictionary(t), "code", "label", "label").select("c_custkey", "label")


@query(
    "lookup_default",
    f"""with {_DICTIONARY} select c_custkey, case when code is null then 'NEGATIVE' else label end as label
        from (select c_custkey, coalesce(cast(nullif(c_nationkey, 7) as varchar), '0') as k from customer)
        left join dict on code = k""",
)
def _(t):
    raw = F.nullif(F.col("c_nationkey").cast("double"), F.lit(7.0))
    c = t("customer").select("c_custkey", raw.cast("string").alias("raw"))
    out = J.lookup(c, X.normalise_code(F.col("raw")), _dictionary(t), "code", "label", "label", default="NEGATIVE")
    return out.select("c_custkey", "label")


def _code_table(t):
    nations = t("nation").select(
        F.lit("customer").alias("form"), F.lit("c_nation").alias("variable"),
        F.col("n_nationkey").cast("double").cast("string").alias("value"), F.col("n_name").alias("name"),
    )
    regions = t("region").select(
        F.lit("supplier").alias("form"), F.lit("s_nationkey").alias("variable"),
        F.col("r_regionkey").cast("string").alias("value"), F.col("r_name").alias("name"),
    )
    return nations.unionByName(regions)


@query(
    "codes_to_names",
    """select c_custkey, n_name as c_nationkey, c_mktsegment from customer left join nation
       on n_nationkey = c_nationkey""",
)
def _(t):
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return J.codes_to_names(c, _code_table(t), "customer", alias={"c_nation": "c_nationkey"})[0]


@query(
    "codes_to_names_errors",
    """select 'supplier' as form, 's_nationkey' as variable, 'value without a name' as problem, count(*) as n
       from supplier where s_nationkey not in (select r_regionkey from region)""",
)
def _(t):
    return J.codes_to_names(t("supplier"), _code_table(t), "supplier")[1]


# --- expressions ------------------------------------------------------------


@query("first_label", "select p_brand, min(nullif(p_type, 'ECONOMY')) as label from part group by 1")
def _(t):
    parts = t("part").select("p_brand", F.nullif("p_type", F.lit("ECONOMY")).alias("label"))
    return J.first_label(parts, "p_brand", "label")


@query(
    "first_number",
    r"""select 'page' as src, page_id as id, 0 as turn,
          try_cast(nullif(regexp_extract(url, '[0-9]+\.[0-9]+|[0-9]+'), '') as double) as number from pages
        union all select 'talk', conv_id, turn,
          try_cast(nullif(regexp_extract(text, '[0-9]+\.[0-9]+|[0-9]+'), '') as double) from conversations""",
)
def _(t):
    pages = t("pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), F.lit(0).cast("bigint").alias("turn"),
        X.first_number(F.col("url")).alias("number"),
    )
    talks = t("conversations").select(
        F.lit("talk").alias("src"), F.col("conv_id").alias("id"), "turn", X.first_number(F.col("text")).alias("number")
    )
    return pages.unionByName(talks)


@query(
    "threshold_flags",
    """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(q as double) as q,
      case when q is null then null when q >= 38 then 2 when q >= 36 then 0 else 1 end as temperature_class,
      case when q is null then recorded when q <= 20 then 1 else 0 end as low_flag,
      case when q is null then recorded when q > 40 then 0 else 1 end as below_flag,
      case when mode = 'N' then 0 else 1 end as differs,
      case when q is not null and mode is not null then recorded end as complete_score
    from (select *, nullif(l_quantity, 25) as q, l_linenumber % 2 as recorded, nullif(l_returnflag, 'A') as mode
          from lineitem)""",
)
def _(t):
    rows = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.nullif("l_quantity", F.lit(25)).alias("q"),
        (F.col("l_linenumber") % 2).alias("recorded"),
        F.nullif("l_returnflag", F.lit("A")).alias("mode"),
    )
    q, recorded, mode = F.col("q"), F.col("recorded"), F.col("mode")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q",
        X.temperature_class(q).alias("temperature_class"),
        X.threshold_flag(q, recorded, "<=", 20).alias("low_flag"),
        X.threshold_flag(q, recorded, ">", 40, met=0, unmet=1).alias("below_flag"),
        X.differs_flag(mode, "N").alias("differs"),
        X.only_if_complete(recorded, [q, mode]).alias("complete_score"),
    )


@query(
    "fix_dates",
    """
    select o_orderkey, raw, case when regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then 0 else 1 end as bad,
      cast(try_cast(case when raw = '323-05-01' then '2023-05-01' else raw end as date) as varchar) as day
    from (select o_orderkey, case when o_orderpriority = '2-HIGH' and o_orderstatus = 'P' then '323-05-01'
          else cast(cast(o_orderdate as date) as varchar) end as raw from orders)""",
)
def _(t):
    typo = F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "P"), "323-05-01")
    rows = t("orders").select(
        "o_orderkey", typo.otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("raw")
    )
    raw = F.col("raw")
    day = X.parse_date(X.fix_values(raw, {"323-05-01": "2023-05-01"}))
    return rows.select("o_orderkey", "raw", X.is_bad_date(raw).cast("int").alias("bad"), day.cast("string").alias("day"))


@query(
    "text_clean",
    r"""
    select p_partkey, concat('tbl_', replace(trim(p_name), ' ', '_')) as form,
      regexp_replace(concat('[', p_name, ']'), '[\[\]]', '', 'g') as stripped,
      regexp_replace(p_name, '(.{4})', E'\\1\n', 'g') as label_raw,
      case when contains(p_brand, '#1') then 1 else 0 end as has_one,
      cast(trunc(p_retailprice) as integer) as price_int,
      case when p_type = 'SMALL' then 1 else 0 end as flag,
      case when p_type = 'PROMO' then 0 when p_type = 'LARGE' then 1 end as as_int,
      cast(p_size as varchar) as code
    from part""".replace(
        r"regexp_replace(p_name, '(.{4})', E'\\1\n', 'g') as label_raw",
        r"""rtrim(regexp_replace(p_name, '(.{4})', '\1~', 'g'), '~') as label""",
    ),
)
def _(t):
    named = F.when(F.col("p_type") == "SMALL", "True").otherwise(F.col("p_type"))
    texts = F.when(F.col("p_type") == "PROMO", "False").when(F.col("p_type") == "LARGE", "1.0").otherwise("x")
    return t("part").select(
        "p_partkey",
        F.concat(F.lit("tbl_"), F.replace(F.trim("p_name"), F.lit(" "), F.lit("_"))).alias("form"),
        X.strip_brackets(F.concat(F.lit("["), F.col("p_name"), F.lit("]"))).alias("stripped"),
        F.replace(X.break_label(F.col("p_name"), 4), F.lit("\n"), F.lit("~")).alias("label"),
        F.contains(F.col("p_brand"), F.lit("#1")).cast("int").alias("has_one"),
        F.col("p_retailprice").cast("int").alias("price_int"),
        X.text_flag(named).alias("flag"),
        X.false_text_to_int(texts).alias("as_int"),
        X.normalise_code(F.col("p_size").cast("double").cast("string")).alias("code"),
    )


@query("run_stamp", "select r_regionkey, 1 as well_formed, 15 as length from region")
def _(t):
    """The stamp differs from run to run; its form does not."""
    stamped = t("region").select("r_regionkey", X.run_stamp().alias("stamp"))
    well_formed = F.col("stamp").rlike("^20[0-9]{6}_[0-2][0-9][0-5][0-9][0-5][0-9]$").cast("int")
    return stamped.select("r_regionkey", well_formed.alias("well_formed"), F.length("stamp").alias("length"))


@query(
    "round_even",
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_discount * 5, 1) as d, "
    "round_even(l_extendedprice, 1) as p from lineitem",
)
def _(t):
    return t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        X.round_half_even(F.col("l_discount") * 5).alias("d"), X.round_half_even(F.col("l_extendedprice")).alias("p"),
    )


@query(
    "minmax_scale",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
         round((l_extendedprice - lo) / (hi - lo), 9) as price, round((l_quantity - qlo) / (qhi - qlo), 9) as qty, 0.0::double as fixed
       from lineitem, (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, min(l_quantity) as qlo,
                       max(l_quantity) as qhi from lineitem)""",
)
def _(t):

    rows = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.lit(7.0).alias("fixed"),
    )
    scaled = MinMax.fit(rows, ["price", "qty", "fixed"]).transform(rows)
    return scaled.withColumn("price", F.round("price", 9)).withColumn("qty", F.round("qty", 9))


# --- columns ----------------------------------------------------------------


@query(
    "rename_columns",
    """select c_custkey, "A", "B" from (select o_custkey as c_custkey,
         count(*) filter (where o_orderstatus = 'F') as "A", count(*) filter (where o_orderstatus = 'O') as "B"
       from orders group by 1)""",
)
def _(t):
    wide = R.pivot_count(t("orders"), ["o_custkey"], "o_orderstatus")
    names = C.names_from_codes([{"value": "F", "name": " A"}, {"value": "O", "name": " B"}], "{}", "{}")
    renamed = C.rename_columns(wide, {**names, "o_custkey": "c_custkey", "absent": "x"})
    wanted = ["c_custkey", *C.merged_names(["B", "A"], ["A"])]
    return C.keep_columns(C.drop_columns(renamed, ["P", "not_there"]), wanted)


@query("head_rows", "select c_custkey, c_mktsegment from customer order by c_custkey nulls last limit 5")
def _(t):
    """The first rows of a table are the feature here."""
    return t("customer").select("c_custkey", "c_mktsegment").orderBy(F.asc_nulls_last("c_custkey")).limit(5)


def _holey(t):
    """Line items with planted gaps: 0 % / about 2 % / about 33 %, and a constant column."""
    return t("lineitem").select(
        "l_quantity",
        F.nullif("l_linenumber", F.lit(3)).alias("line"),
        F.nullif("l_quantity", F.lit(25)).alias("qty"),
        F.nullif("l_returnflag", F.lit("A")).alias("flag"),
        F.lit(4).alias("fixed"),
    )


_HOLEY = """h as (select l_quantity, nullif(l_linenumber, 3) as line, nullif(l_quantity, 25) as qty,
            nullif(l_returnflag, 'A') as flag, 4 as fixed from lineitem)"""


@query(
    "drop_sparse",
    f"""with {_HOLEY}, s as (select unnest(['l_quantity', 'line', 'qty', 'flag', 'fixed']) as "column",
           unnest([1 - count(l_quantity) / count(*), 1 - count(line) / count(*), 1 - count(qty) / count(*),
                   1 - count(flag) / count(*), 1 - count(fixed) / count(*)]) as share from h)
        select "column", round(share, 9) as share, case when share > 0.1 then 1 else 0 end as dropped from s""",
)
def _(t):
    _, report = C.drop_sparse_columns(_holey(t), 0.1)
    return report.select("column", F.round("share", 9).alias("share"), F.col("dropped").cast("int").alias("dropped"))


@query(
    "complete_cases",
    f"with {_HOLEY} select l_quantity, qty, fixed from h where qty is not null",
)
def _(t):
    return C.drop_incomplete_rows(C.drop_sparse_columns(_holey(t), 0.1)[0])


@query(
    "drop_low_variance",
    f"""with {_HOLEY} select unnest(['l_quantity', 'line', 'qty', 'fixed']) as "column",
          unnest([round(var_samp(l_quantity), 6), round(var_samp(line), 6), round(var_samp(qty), 6),
                  round(var_samp(fixed), 6)]) as variance, unnest([0, 0, 0, 1]) as dropped from h""",
)
def _(t):
    _, report = C.drop_low_variance(_holey(t))
    return report.select("column", F.round("variance", 6).alias("variance"), F.col("dropped").cast("int").alias("dropped"))


def _related(t):
    return t("lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]
_CORR = (
    "with x as (select *, l_extendedprice * (1 - l_discount) as net from lineitem), c as ("
    + " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as r from x" for a, b in _PAIRS
    )
    + ")"
)


@query("correlation", f"{_CORR} select * from c")
def _(t):
    return S.correlations(_related(t), _NUMBERS).withColumn("r", F.round("r", 6))


def _average_rank(c: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}"


_RANK_COLUMNS = ["l_quantity", "l_discount", "l_extendedprice", "l_linenumber"]
_RANKS = "with x as (select " + ", ".join(_average_rank(c) for c in _RANK_COLUMNS) + " from lineitem) "


@query(
    "correlation_spearman",
    _RANKS
    + " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as r from x"
        for i, a in enumerate(_RANK_COLUMNS)
        for b in _RANK_COLUMNS[i + 1 :]
    ),
)
def _(t):
    return S.correlations(t("lineitem"), _RANK_COLUMNS, "spearman").withColumn("r", F.round("r", 6))


@query(
    "drop_correlated",
    f"""{_CORR}, a as (select column_a as kept, column_b as dropped, r,
           row_number() over (partition by column_b order by column_a) as i from c where abs(r) > 0.8)
        select kept, dropped, r from a where kept not in (select dropped from a)
        and kept = (select min(b.kept) from a b where b.dropped = a.dropped and b.kept not in (select dropped from a))""",
)
def _(t):
    return S.drop_correlated(_related(t), 0.8)[1].withColumn("r", F.round("r", 6))


@query(
    "classify_columns",
    """
    select * from (values ('l_orderkey'), ('l_linenumber'), ('l_quantity'), ('l_discount'), ('quality'), ('lang')) v("column")
    join (select 'l_orderkey' as "column", case when count(distinct l_orderkey) < 15 then 'levels' else 'continuous' end as kind from lineitem
      union all select 'l_linenumber', case when count(distinct l_linenumber) < 15 then 'levels' else 'continuous' end from lineitem
      union all select 'l_quantity', case when count(distinct l_quantity) < 15 then 'levels' else 'continuous' end from lineitem
      union all select 'l_discount', case when count(distinct l_discount) < 15 then 'levels' else 'continuous' end from lineitem
      union all select 'quality', case when max(case when quality in (0, 1) then 0 else 1 end) = 0 then 'binary' else 'levels' end from labels
      union all select 'lang', 'text' from documents having count(*) > 0) using ("column")""",
)
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    docs = t("labels").join(t("documents"), "doc_id").select("quality", "lang")
    rows = [
        (name, kind)
        for df in (lines, docs)
        for kind, names in C.classify_columns(df).items()
        for name in names
    ]
    return literal_table(t.spark, rows, "column string, kind string")


@query(
    "plot_groups",
    """select * from (values ('l_discount', 'family'), ('returned', 'binary'), ('l_quantity', 'numeric'),
         ('l_extendedprice', 'numeric')) v("column", kind)
       where (select count(distinct l_quantity) > 2 and max(l_discount) <= 1 from lineitem)""",
)
def _(t):
    rows = t("lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("returned")
    )
    groups = C.plot_groups(rows, "discount")
    return literal_table(t.spark, [(c, k) for k, cs in groups.items() for c in cs], "column string, kind string")


def _families(t):
    wide = R.pivot_sum(
        t("lineitem"), ["l_orderkey"], "l_returnflag", F.nullif("l_quantity", F.lit(25)), prefix="tipo_cancer_"
    )
    more = R.pivot_count(t("lineitem"), ["l_orderkey"], "l_linestatus", prefix="colo_")
    return J.join_forms(wide, [more], ["l_orderkey"])


_FAM = """f as (select l_orderkey,
    coalesce(sum(nullif(l_quantity, 25)) filter (where l_returnflag = 'A'), 0) as ca,
    coalesce(sum(nullif(l_quantity, 25)) filter (where l_returnflag = 'N'), 0) as cn,
    coalesce(sum(nullif(l_quantity, 25)) filter (where l_returnflag = 'R'), 0) as cr,
    count(*) filter (where l_linestatus = 'F') as f, count(*) filter (where l_linestatus = 'O') as o
    from lineitem group by 1)"""


@query(
    "combine_columns",
    f'with {_FAM} select l_orderkey, f as "colo_F", o as "colo_O", cast(ca + cn + cr as integer) as tumores from f',
)
def _(t):
    wide = _families(t)
    return C.combine_columns(wide, C.columns_like(wide, "cancer"), "tumores")


@query(
    "organism_totals",
    f"""with {_FAM} select l_orderkey, ca as "tipo_cancer_A", cn as "tipo_cancer_N", cr as "tipo_cancer_R",
        f as "colo_F", o as "colo_O", ca as "_A_total", cast(f as bigint) as "_F_total" from f""",
)
def _(t):
    wide = _families(t)
    return C.sum_by_name(wide, ["_A", "_F"])


# --- quantiles, outliers, recodes -------------------------------------------

_LIMITS = """q as (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {t}),
  lim as (select q1 - {k} * (q3 - q1) as lo, q3 + {k} * (q3 - q1) as hi from q)"""


def _priced(t):
    """Prices with a stretched upper tail, so that outliers exist."""
    return t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_quantity") == 50, F.col("l_extendedprice") * 9).otherwise(F.col("l_extendedprice")).alias("price"),
    )


_PRICED = """p as (select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    case when l_quantity = 50 then l_extendedprice * 9 else l_extendedprice end as price from lineitem)"""


@query(
    "outliers_iqr",
    f"""with {_PRICED}, {_LIMITS.format(c="price", t="p", k=3)}
        select 'price' as "column", round(min(lo), 4) as lower_limit, round(min(hi), 4) as upper_limit,
          count(*) filter (where price < lo or price > hi) as n_outliers from p, lim""",
)
def _(t):
    rows = _priced(t)
    report = S.outlier_report(rows, S.outlier_limits(rows, ["price"]))
    return report.withColumn("lower_limit", F.round("lower_limit", 4)).withColumn("upper_limit", F.round("upper_limit", 4))


@query(
    "outlier_rows",
    f"""with {_PRICED}, {_LIMITS.format(c="price", t="p", k=3)}
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(price, 2) as price from p, lim where price < lo or price > hi""",
)
def _(t):
    rows = _priced(t)
    limits = S.outlier_limits(rows, ["price"])
    return S.outlier_rows(rows, "price", limits["price"]).withColumn("price", F.round("price", 2))


@query(
    "quartile_recode",
    f"""with {_PRICED}, {_LIMITS.format(c="price", t="p", k=3)},
         c as (select l_orderkey, l_partkey, l_suppkey, l_linenumber,
               case when price < lo or price > hi then null else price end as price from p, lim),
         e as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.5) as b, quantile_cont(price, 0.75) as d from c)
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(price, 2) as price,
          case when price is null then null when price <= a then 0 when price <= b then 1 when price <= d then 2 else 3 end
            as price_recoded from c, e""",
)
def _(t):
    return S.outliers_and_quartiles(_priced(t), ["price", "absent"]).withColumn("price", F.round("price", 2))


@query(
    "mean_gap",
    """
    with d as (select distinct o_custkey, cast(o_orderdate as date) as day from orders),
         g as (select o_custkey, date_diff('day', lag(day) over (partition by o_custkey order by day), day) as gap from d)
    select o_custkey, round(avg(gap), 6) as mean_gap from g group by 1""",
)
def _(t):
    return S.mean_gap(t("orders"), ["o_custkey"], "o_orderdate", "mean_gap").withColumn("mean_gap", F.round("mean_gap", 6))


# --- summaries --------------------------------------------------------------


@query(
    "value_counts",
    "select source as value, count(*) as n from documents where source is not null group by 1",
)
def _(t):
    return S.value_counts(t("documents"), "source")


@query("shape", "select count(*) as n_rows, cast(6 as bigint) as n_columns from orders")
def _(t):
    return S.shape(t("orders"))


@query(
    "null_report",
    f"""with {_HOLEY} select unnest(['l_quantity', 'line', 'qty', 'flag', 'fixed']) as "column",
          unnest([count(*) - count(l_quantity), count(*) - count(line), count(*) - count(qty), count(*) - count(flag),
                  count(*) - count(fixed)]) as n_missing,
          unnest([round(100.0 * (count(*) - count(l_quantity)) / count(*), 6), round(100.0 * (count(*) - count(line)) / count(*), 6),
                  round(100.0 * (count(*) - count(qty)) / count(*), 6), round(100.0 * (count(*) - count(flag)) / count(*), 6),
                  round(100.0 * (count(*) - count(fixed)) / count(*), 6)]) as pct from h""",
)
def _(t):
    return C.null_report(_holey(t)).withColumn("pct", F.round("pct", 6))


@query("sparse_subset", f"with {_HOLEY} select flag from h")
def _(t):
    return C.sparse_subset(_holey(t), 30.0)


@query(
    "missing_cells",
    f"""with {_HOLEY} select line is null as line, qty is null as qty, flag is null as flag, count(*) as n from h group by 1, 2, 3""".replace(
        "line is null as line", "case when line is null then 1 else 0 end as line"
    )
    .replace("qty is null as qty", "case when qty is null then 1 else 0 end as qty")
    .replace("flag is null as flag", "case when flag is null then 1 else 0 end as flag"),
)
def _(t):
    marks = C.missing_cells(_holey(t).select("line", "qty", "flag"))
    return marks.select(*[F.col(c).cast("int").alias(c) for c in marks.columns]).groupBy("line", "qty", "flag").agg(
        F.count(F.lit(1)).alias("n")
    )


_PROFILE = " union all ".join(
    f"""select '{c}' as "column", '{ty}' as type, count(*) as n, count(*) - count({c}) as n_missing,
      {"cast(min(%s) as double)" % c if num else "cast(null as double)"} as min,
      {"cast(max(%s) as double)" % c if num else "cast(null as double)"} as max,
      {"round(avg(%s), 6)" % c if num else "cast(null as double)"} as mean,
      {"round(stddev_samp(%s), 6)" % c if num else "cast(null as double)"} as std,
      count(distinct {c}) as n_distinct,
      (select max(k) from (select count(*) as k from c where {c} is not null group by {c})) as top_freq,
      (select cast(v as varchar) from (select {c} as v, count(*) as k from c where {c} is not null group by {c})
       order by k desc, cast(v as varchar) limit 1) as top from c"""
    for c, ty, num in [
        ("c_custkey", "bigint", True), ("c_nationkey", "int", True), ("c_acctbal", "double", True),
        ("c_mktsegment", "string", False),
    ]
)


@query(
    "profile",
    f"""with c as (select c_custkey, nullif(c_nationkey, 3) as c_nationkey, c_acctbal,
        nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer) {_PROFILE}""",
)
def _(t):
    rows = t("customer").select(
        "c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), "c_acctbal",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
    )
    return (
        S.profile(rows)
        .withColumn("mean", F.round("mean", 6))
        .withColumn("std", F.round("std", 6))
    )


@query(
    "profile_quantiles",
    """select unnest(['l_quantity','l_quantity','l_quantity','l_extendedprice','l_extendedprice','l_extendedprice']) as "column",
         unnest([0.25::double, 0.5, 0.75, 0.25, 0.5, 0.75]) as share,
         unnest([round(quantile_cont(l_quantity, 0.25), 6), round(quantile_cont(l_quantity, 0.5), 6), round(quantile_cont(l_quantity, 0.75), 6),
                 round(quantile_cont(l_extendedprice, 0.25), 6), round(quantile_cont(l_extendedprice, 0.5), 6),
                 round(quantile_cont(l_extendedprice, 0.75), 6)]) as value from lineitem""",
)
def _(t):
    found = S.profile_quantiles(t("lineitem").select("l_quantity", "l_extendedprice"), [0.25, 0.5, 0.75])
    return found.withColumn("value", F.round("value", 6))


@query(
    "duplicates",
    """select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1""",
)
def _(t):
    return S.duplicate_rows(t("lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "histogram",
    """with b as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 as w from lineitem)
       select l_returnflag, cast(least(floor((l_extendedprice - lo) / w), 19) as integer) as bin, count(*) as n,
         round(min(lo) + least(floor((l_extendedprice - lo) / w), 19) * min(w), 4) as "left",
         round(min(lo) + (least(floor((l_extendedprice - lo) / w), 19) + 1) * min(w), 4) as "right"
       from lineitem, b group by l_returnflag, least(floor((l_extendedprice - lo) / w), 19)""",
)
def _(t):
    h = S.histogram(t("lineitem"), "l_extendedprice", 20, ["l_returnflag"])
    return h.withColumn("left", F.round("left", 4)).withColumn("right", F.round("right", 4))


def _flags(t):
    return t("lineitem").select(
        "l_returnflag",
        (F.col("l_linestatus") == "O").cast("int").alias("open"),
        (F.col("l_quantity") > 25).cast("int").alias("many"),
        (F.col("l_discount") > 0.05).cast("int").alias("cheap"),
    )


_FLAGS = """g as (select l_returnflag, case when l_linestatus = 'O' then 1 else 0 end as open,
    case when l_quantity > 25 then 1 else 0 end as many, case when l_discount > 0.05 then 1 else 0 end as cheap from lineitem)"""


@query(
    "pair_means",
    f"with {_FLAGS} "
    + " union all ".join(
        f"""select '{x}' as x, '{y}' as y, cast({x} as double) as level, l_returnflag as hue, round(avg({y}), 9) as mean,
            round(stddev_samp({y}), 9) as std, count(*) as n from g group by {x}, l_returnflag"""
        for x in ["open", "many", "cheap"]
        for y in ["open", "many", "cheap"]
        if x != y
    ),
)
def _(t):
    means = S.pair_means(_flags(t), ["open", "many", "cheap"], "l_returnflag")
    return means.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(
    "pair_bins",
    """with b as (select min(l_extendedprice) as plo, (max(l_extendedprice) - min(l_extendedprice)) / 10 as pw,
                  min(l_quantity) as qlo, (max(l_quantity) - min(l_quantity)) / 10 as qw from lineitem)
       select 'l_extendedprice' as x, 'l_quantity' as y, cast(least(floor((l_extendedprice - plo) / pw), 9) as integer) as x_bin,
         cast(least(floor((l_quantity - qlo) / qw), 9) as integer) as y_bin, l_returnflag as hue, count(*) as n
       from lineitem, b group by 3, 4, 5""",
)
def _(t):
    return S.pair_bins(t("lineitem"), ["l_extendedprice", "l_quantity"], "l_returnflag", bins=10)


@query(
    "density",
    """with s as (select min(l_quantity) as lo, max(l_quantity) as hi, (max(l_quantity) - min(l_quantity)) / 50 as w,
                  stddev_samp(l_quantity) * power(count(*), -0.2) as h from lineitem),
       b as (select l_returnflag, least(floor((l_quantity - lo) / w), 49) as bin, count(*) as n from lineitem, s group by 1, 2),
       g as (select cast(i as integer) as i from range(0, 20) r(i))
       select l_returnflag, i, round(min(lo) + i * min(hi - lo) / 19, 6) as x,
         round(sum(n * exp(-0.5 * power(((lo + i * (hi - lo) / 19) - (lo + (bin + 0.5) * w)) / h, 2)) / (h * sqrt(2 * pi())))
               / sum(n), 7) as density
       from b, g, s group by l_returnflag, i""",
)
def _(t):
    d = S.density(t("lineitem"), "l_quantity", bins=50, grid=20, by=["l_returnflag"])
    return d.withColumn("x", F.round("x", 6)).withColumn("density", F.round("density", 7))


# --- NaN is missing ---------------------------------------------------------


def _with_nan(t):
    """Customers with NaN planted in the balance, and a flag."""
    nan = F.lit(float("nan"))
    balance = F.when(F.col("c_custkey") % 7 == 0, nan).otherwise(F.col("c_acctbal"))
    flag = F.when(F.col("c_custkey") % 5 == 0, nan).otherwise((F.col("c_custkey") % 2).cast("double"))
    return t("customer").select("c_custkey", "c_nationkey", balance.alias("balance"), flag.alias("flag"))


_WITH_NAN = """n as (select c_custkey, c_nationkey, case when c_custkey % 7 <> 0 then c_acctbal end as balance,
            case when c_custkey % 5 <> 0 then cast(c_custkey % 2 as double) end as flag from customer)"""


@query(
    "nan_flags",
    f"""with {_WITH_NAN} select c_custkey,
        case when balance >= 5000 then 2 when balance >= 0 then 0 when balance is not null then 1 end as class,
        case when balance is null then c_nationkey when balance > 1000 then 1 else 0 end as raised,
        case when flag > 0 then 1 else 0 end as present,
        case when balance is not null and flag is not null then c_nationkey end as score from n""",
)
def _(t):
    return _with_nan(t).select(
        "c_custkey",
        X.temperature_class(F.col("balance"), 5000, 0).alias("class"),
        X.threshold_flag(F.col("balance"), F.col("c_nationkey"), ">", 1000).alias("raised"),
        X.presence(F.col("flag")).alias("present"),
        X.only_if_complete(F.col("c_nationkey"), [F.col("balance"), F.col("flag")]).alias("score"),
    )


@query(
    "nan_complete_cases",
    f"""with {_WITH_NAN} select c_custkey, c_nationkey, balance, flag from n where balance is not null and flag is not null
        union all select c_custkey, c_nationkey, coalesce(balance, 0), coalesce(flag, 0) from n
        where balance is null or flag is null""",
)
def _(t):
    rows = _with_nan(t)
    complete = C.drop_incomplete_rows(rows)
    rest = rows.join(complete.select("c_custkey"), "c_custkey", "left_anti")
    return complete.unionByName(C.fill_missing(rest, 0))


@query(
    "nan_scale_histogram",
    f"""with {_WITH_NAN}, b as (select min(balance) as lo, max(balance) as hi from n),
        h as (select least(cast(floor((balance - lo) / ((hi - lo) / 8)) as integer), 7) as bin,
                     (balance - lo) / (hi - lo) as scaled from n, b where balance is not null)
        select bin, count(*) as n, round(avg(scaled), 6) as scaled from h group by bin""",
)
def _(t):
    rows = _with_nan(t)
    counts = S.histogram(rows, "balance", 8).select("bin", "n")
    scaled = MinMax.fit(rows, ["balance"]).transform(rows)
    bins = scaled.select(S.bin_of(F.col("balance"), 0.0, 1.0, 8).alias("bin"), F.col("balance").alias("scaled"))
    means = bins.filter("bin is not null").groupBy("bin").agg(F.round(F.avg("scaled"), 6).alias("scaled"))
    return counts.join(means, "bin")
