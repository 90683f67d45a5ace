"""Queries for splits, scores, curves, choices, imputation and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardtable.operators import evaluate as E
from wardtable.operators import impute as I
from wardtable.operators import neighbors as N
from wardtable.operators import selection as L
from wardtable.operators import split as P
from wardtable.operators.ordered import HASH_BITS
from wardtable.registry.base import query

TEST_LIMIT = int(0.3 * (1 << HASH_BITS))


def hash_sql(key: str, seed: int = 99) -> str:
    return f"cast(concat('0x', substr(md5(concat_ws('|', cast({key} as varchar), '{seed}')), 1, 15)) as bigint)"


# --- splits -----------------------------------------------------------------


@query(
    "hash_split",
    f"select o_orderkey, case when {hash_sql('o_orderkey')} < {TEST_LIMIT} then 'test' else 'train' end as part from orders",
)
def _(t):
    train, test = P.split(t("orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "exact_split",
    f"""select o_orderkey, case when row_number() over (order by {hash_sql('o_orderkey')}, o_orderkey)
          <= (select ceil(0.3 * count(*)) from orders) then 'test' else 'train' end as part from orders""",
)
def _(t):
    train, test = P.split(t("orders").select("o_orderkey"), "o_orderkey", exact=True)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "folds",
    f"""select o_orderkey, o_orderstatus, cast((row_number() over (partition by o_orderstatus
          order by {hash_sql('o_orderkey')}, o_orderkey) - 1) % 10 as integer) as fold from orders""",
)
def _(t):
    return P.stratified_folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


# --- scores: label = returned lines, score = a fixed formula over the line -----------

SCORE = "(cast(floor((l_discount * 5 + l_quantity / 100 + l_tax) * 100) as double) / 150)"


def scored(t):
    return t("lineitem").select(
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.expr(SCORE).alias("score"),
        (F.expr(SCORE) > 0.35).cast("int").alias("prediction"),
    )


SCORED = f"""s as (select l_linestatus, case when l_returnflag = 'R' then 1 else 0 end as label, {SCORE} as score,
    case when {SCORE} > 0.35 then 1 else 0 end as prediction from lineitem)"""
POINTS = """p as (select score, sum(label) as own_tp, sum(1 - label) as own_fp from s group by 1),
    c as (select *, sum(own_tp) over (order by score desc) as tp, sum(own_fp) over (order by score desc) as fp from p),
    n as (select sum(label) as p, sum(1 - label) as n from s)"""


@query(
    "confusion",
    f"""with {SCORED} select l_linestatus, count(*) filter (where label = 0 and prediction = 0) as tn,
        count(*) filter (where label = 0 and prediction = 1) as fp, count(*) filter (where label = 1 and prediction = 0) as fn,
        count(*) filter (where label = 1 and prediction = 1) as tp from s group by 1""",
)
def _(t):
    return E.confusion(scored(t), "label", "prediction", ["l_linestatus"])


@query(
    "class_scores",
    f"""with {SCORED}, k as (select count(*) as n, sum(label * prediction) as tp, sum(prediction) as pp, sum(label) as p,
          sum(case when label = prediction then 1 else 0 end) as ok from s)
        select round(ok / n, 9) as accuracy, round(tp / pp, 9) as "precision", round(tp / p, 9) as recall,
          round(2 * tp / (pp + p), 9) as f1 from k""",
)
def _(t):
    s = E.class_scores(scored(t), "label", "prediction")
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query(
    "roc_points",
    f"""with {SCORED}, {POINTS} select round(score, 9) as threshold, round(fp / n, 9) as fpr, round(tp / p, 9) as tpr from c, n
        union all select null, 0.0, 0.0""",
)
def _(t):
    r = E.roc_points(scored(t), "label", "score")
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query(
    "pr_points",
    f"""with {SCORED}, {POINTS} select round(score, 9) as threshold, round(tp / (tp + fp), 9) as "precision",
          round(tp / p, 9) as recall from c, n union all select null, 1.0, 0.0""",
)
def _(t):
    r = E.pr_points(scored(t), "label", "score")
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query(
    "roc_auc",
    f"""with {SCORED}, {POINTS}, w as (select tp / p as tpr, fp / n as fpr, lag(tp / p, 1, 0.0) over (order by score desc) as tpr0,
          lag(fp / n, 1, 0.0) over (order by score desc) as fpr0 from c, n)
        select round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 9) as roc_auc from w""",
)
def _(t):
    return E.ranking_scores(scored(t), "label", "score").select(F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "avg_precision",
    f"""with {SCORED}, {POINTS} select round(sum(own_tp / p * tp / (tp + fp)), 9) as avg_precision from c, n""",
)
def _(t):
    return E.ranking_scores(scored(t), "label", "score").select(F.round("avg_precision", 9).alias("avg_precision"))


@query(
    "log_loss",
    f"""with {SCORED}, l as (select label, least(greatest(score, 1e-15), 1 - 1e-15) as a,
          case when prediction = 1 then 1 - 1e-15 else 1e-15 end as b from s)
        select 'score' as kind, round(avg(-ln(case when label = 1 then a else 1 - a end)), 6) as log_loss from l
        union all select 'labels', round(avg(-ln(case when label = 1 then b else 1 - b end)), 6) from l""",
)
def _(t):
    rows = scored(t)
    soft = E.log_loss(rows, "label", "score").withColumn("kind", F.lit("score"))
    hard = E.log_loss(rows, "label", "prediction", from_labels=True).withColumn("kind", F.lit("labels"))
    return soft.unionByName(hard).select("kind", F.round("log_loss", 6).alias("log_loss"))


_KINDS = """k as (select cast(count(*) as double) as n, sum(label * prediction) as tp, sum(prediction) as pp, sum(label) as p,
    sum((1 - label) * (1 - prediction)) as tn from s),
  m as (select *, tn / (n - pp) as p0, tn / (n - p) as r0, 2 * tn / (2 * n - pp - p) as f0, tp / pp as p1, tp / p as r1,
    2 * tp / (pp + p) as f1, (tp + tn) / n as acc from k)"""


@query(
    "class_report",
    f"""with {SCORED}, {POINTS.replace(" n as (", " cnt as (")}, a as (select sum(own_fp * (tp - own_tp / 2.0)) / (min(cnt.p) * min(cnt.n)) as auc from c, cnt), {_KINDS},
     r as (select '0' as "row", p0 as "precision", r0 as recall, f0 as f1, n - p as support from m
      union all select '1', p1, r1, f1, p from m
      union all select 'accuracy', acc, acc, acc, acc from m
      union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from m
      union all select 'weighted avg', (p0 * (n - p) + p1 * p) / n, (r0 * (n - p) + r1 * p) / n, (f0 * (n - p) + f1 * p) / n, n from m)
     select "row", round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1,
       round(cast(support as double), 9) as support, round(auc, 9) as roc_auc from r, a""",
)
def _(t):
    r = E.class_report(scored(t), "label", "prediction", "score")
    return r.select("row", *[F.round(c, 9).alias(c) for c in r.columns if c != "row"])


@query(
    "compare_models",
    f"""with {SCORED}, p as (select l_linestatus, score, sum(label) as own_tp, sum(1 - label) as own_fp from s group by 1, 2),
      c as (select *, sum(own_tp) over w as tp from p window w as (partition by l_linestatus order by score desc)),
      a as (select l_linestatus, sum(own_fp * (tp - own_tp / 2.0)) / (sum(own_tp) * sum(own_fp)) as auc from c group by 1),
      k as (select l_linestatus, cast(count(*) as double) as n, sum(label * prediction) as tp, sum(prediction) as pp, sum(label) as p,
        sum(case when label = prediction then 1 else 0 end) as ok,
        avg(-ln(case when label = 1 then least(greatest(score, 1e-15), 1 - 1e-15) else 1 - least(greatest(score, 1e-15), 1 - 1e-15) end)) as ll
        from s group by 1)
    select l_linestatus as model, round(ok / n, 9) as accuracy, round(tp / pp, 9) as "precision", round(tp / p, 9) as recall,
      round(2 * tp / (pp + p), 9) as f1, round(auc, 9) as roc_auc, round(ll, 6) as log_loss from k join a using (l_linestatus)""",
)
def _(t):
    rows = scored(t).withColumnRenamed("l_linestatus", "model")
    c = E.compare_models(rows, "label", "prediction", "score")
    return c.select("model", *[F.round(x, 6 if x == "log_loss" else 9).alias(x) for x in c.columns if x != "model"])


# --- choices ----------------------------------------------------------------


@query(
    "pareto_front",
    """select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b
         where b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice
           and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice))""",
)
def _(t):
    return L.pareto_front(t("part"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query(
    "first_of_front",
    """select min(p_partkey) as p_partkey from part a where not exists (select 1 from part b
         where b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice
           and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice))""",
)
def _(t):
    return L.first_of_front(t("part"), "p_size", "p_retailprice", "p_partkey").select("p_partkey")


@query(
    "best_so_far",
    """select p_type, p_partkey, p_retailprice, max(p_retailprice) over (partition by p_type order by p_partkey) as best from part""",
)
def _(t):
    rows = t("part").select("p_type", "p_partkey", "p_retailprice")
    return L.best_so_far(rows, "p_partkey", "p_retailprice", by=["p_type"])


@query("arg_max", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 1")
def _(t):
    return L.arg_max(t("part"), "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query(
    "ranked_features",
    "select p_brand as feature, round(avg(p_retailprice), 6) as importance from part group by 1",
)
def _(t):
    rows = t("part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice"), 6).alias("importance"))
    return L.ranked_features(rows)


@query(
    "consensus",
    """select p_size from part where p_retailprice > 1000 group by 1
       having count(distinct p_brand) = (select count(distinct p_brand) from part where p_retailprice > 1000)""",
)
def _(t):
    return L.consensus(t("part").filter("p_retailprice > 1000"), "p_size", "p_brand")


@query("distinct_labels", "select distinct p_type as label from part")
def _(t):
    return t("part").select(F.col("p_type").alias("label")).distinct()


# --- imputation and neighbours ----------------------------------------------


@query(
    "mode_impute",
    """
    with c as (select c_custkey, nullif(c_nationkey, 3) as nation, nullif(c_mktsegment, 'BUILDING') as segment from customer),
      a as (select nation from c where nation is not null group by 1 order by count(*) desc, nation limit 1),
      b as (select segment from c where segment is not null group by 1 order by count(*) desc, segment limit 1)
    select c_custkey, coalesce(c.nation, a.nation) as nation, coalesce(c.segment, b.segment) as segment from c, a, b""",
)
def _(t):
    c = t("customer").select(
        "c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    return I.impute_most_frequent(c, ["nation", "segment"], as_integer=False)


_PARTS = """p as (select p_partkey, nullif(p_size, 25) as size, case when p_brand <> 'Brand#7' then p_retailprice end as price,
    length(p_name) * 3.7 as words from part)"""


def _knn_sql(target: str, others: list[str]) -> str:
    terms = " + ".join(f"coalesce(power(a.{c} - b.{c}, 2), 0)" for c in others)
    shared = " + ".join(f"case when a.{c} - b.{c} is null then 0 else 1 end" for c in others)
    return f"""{target}_d as (select a.p_partkey as q, b.p_partkey as d, b.{target} as v, sqrt(({terms}) * 3.0 / nullif({shared}, 0)) as dist
        from p a, p b where a.{target} is null and b.{target} is not null),
      {target}_k as (select * from (select *, row_number() over (partition by q order by dist, d) as i from {target}_d where dist is not null) where i <= 5),
      {target}_w as (select q, v, case when min(dist) over (partition by q) = 0 then case when dist = 0 then 1.0 else 0.0 end else 1 / dist end as w from {target}_k),
      {target}_m as (select q, sum(w * v) / sum(w) as v from {target}_w group by 1)"""


@query(
    "knn_impute",
    f"""with {_PARTS}, {_knn_sql("size", ["price", "words"])}, {_knn_sql("price", ["size", "words"])}
      select p_partkey, round_even(cast(coalesce(size, s.v, (select avg(size) from p)) as double), 1) as size,
        round_even(cast(coalesce(price, r.v, (select avg(price) from p)) as double), 1) as price,
        round_even(cast(words as double), 1) as words
      from p left join size_m s on s.q = p_partkey left join price_m r on r.q = p_partkey""",
)
def _(t):
    parts = t("part").select(
        "p_partkey",
        F.nullif("p_size", F.lit(25)).cast("double").alias("size"),
        F.when(F.col("p_brand") != "Brand#7", F.col("p_retailprice")).alias("price"),
        (F.length("p_name") * F.lit(3.7)).alias("words"),
    )
    return I.impute_neighbors(parts, "p_partkey", ["size", "price", "words"])


_EMBED = f"""v as (select vec_id, cast(embedding as double[]) as e, label, {hash_sql('vec_id')} < {TEST_LIMIT} as test from embeddings),
   d as (select a.vec_id as q, b.vec_id as d, b.label, list_distance(a.e, b.e) as dist from v a, v b where a.test and not b.test),
   k as (select * from (select *, row_number() over (partition by q order by dist, d) as i from d) where i <= 5)"""


@query(
    "knn_classify",
    f"""with {_EMBED}, w as (select q, label, sum(1 / dist) as votes from k group by 1, 2)
        select q as vec_id, cast(label as double) as prediction, score from
        (select *, row_number() over (partition by q order by votes desc, label) as i,
           round(sum(case when label = 1 then votes else 0 end) over (partition by q) / sum(votes) over (partition by q), 6) as score
         from w) where i = 1""",
)
def _(t):
    train, test = P.split(t("embeddings"), "vec_id")
    found = N.knn_classify(train, test, "vec_id", "embedding", "label", 64, 5, "distance")
    return found.withColumn("score", F.round("score", 6))
