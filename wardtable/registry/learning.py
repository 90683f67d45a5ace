"""Queries that train, search and explain models; checked by their rows and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardtable.operators import models as M
from wardtable.operators import search as S
from wardtable.operators import selection as L
from wardtable.plans import forms as FP
from wardtable.plans import modelling as MP
from wardtable.registry.base import query
from wardtable.registry.forms import form, with_steps
from wardtable.registry.metrics import TEST_LIMIT, hash_sql
from wardtable.session import new_folder
from wardtable.sources import catalog as K

# --- data sets from the given tables ----------------------------------------


def documents_set(t):
    """Text statistics of the labelled documents; label: quality."""
    text = F.col("text")
    return (
        t("labels")
        .join(t("documents"), "doc_id")
        .select(
            F.col("doc_id").alias(MP.KEY),
            F.col("n_chars").cast("double").alias("chars"),
            F.size(F.split(text, r"\s+")).cast("double").alias("words"),
            F.size(F.split(text, "\n")).cast("double").alias("lines"),
            F.regexp_count(text, F.lit(r"[0-9]")).cast("double").alias("digits"),
            F.regexp_count(text, F.lit(r"[.,;]")).cast("double").alias("marks"),
            (F.col("lang") == "en").cast("double").alias("english"),
            F.size(F.array_distinct(F.split(text, r"\s+"))).cast("double").alias("distinct_words"),
            F.col("quality").alias(MP.LABEL),
        )
    )


#: Line items that one task tells apart, where there are enough of them for every core.
LINES_PER_TASK = 500_000


def lines_set(t):
    """Every line item once, label: returned; key: all columns that tell lines apart, as one text.

    Rows are told apart by the columns themselves; the text is made for the rows that stay. Only where a column is missing, or the
    price is a zero of either sign, could different columns give one text or the other way round; such rows are told apart by the text,
    which no other row has. Rows are dealt out before they are compared, so that no task holds a table of all rows it reads; how many
    rows a task compares does not grow with the table.
    """
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    text = F.concat_ws("|", *ids, "l_extendedprice")
    odd = F.expr(" or ".join([f"{c} is null" for c in [*ids, "l_extendedprice"]] + ["l_extendedprice = 0"]))
    apart = [*ids, "l_extendedprice", "_text"]
    lines = t("lineitem").select(
        *[F.when(~odd, F.col(c)).alias(c) for c in ids], "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(odd, text).alias("_text")
    )
    tasks = t("lineitem").count() // LINES_PER_TASK
    dealt = lines.repartition(tasks, *apart) if tasks >= lines.sparkSession.sparkContext.defaultParallelism else lines.repartition(*apart)
    return dealt.dropDuplicates(apart).select(
        F.coalesce("_text", text).alias(MP.KEY), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_quantity") * (1 + F.col("l_tax")) + F.col("l_discount") * 100 > 32).cast("int").alias(MP.LABEL),
    )


def vectors_set(t):
    return t("embeddings").select(
        F.col("vec_id").alias(MP.KEY), F.col("embedding").cast("array<double>").alias("e"),
        (F.col("label") >= 5).cast("int").alias(MP.LABEL),
    )


def scores_of(t, family, params, data=lines_set):
    """Fit on the training rows, score the test rows, one row of metrics."""
    parts = MP.prepare(data(t))
    model = M.fit(parts.train, family, params, MP.LABEL, MP.KEY)
    return MP.compare_on({family: model}, parts.test, MP.LABEL)


# --- one query per family ---------------------------------------------------

_FITS = {
    "model_logistic_regression": ("logistic_regression", {"C": 10, "penalty": "elasticnet", "max_iter": 50, "solver": "saga"}),
    "model_random_forest": ("random_forest", {"n_estimators": 10, "max_depth": 8, "criterion": "log_loss", "min_samples_leaf": 2}),
    "model_decision_tree": ("decision_tree", {"max_depth": 12}),
    "model_linear_svc": ("svc", {"kernel": "linear", "C": 1.0, "class_weight": "balanced", "max_iter": 20}),
    "model_rbf_svc": ("svc", {"kernel": "rbf", "C": 1.0, "gamma": "scale", "components": 32, "max_iter": 20}),
    "model_poly_svc": ("svc", {"kernel": "poly", "C": 1.0, "degree": 2, "max_iter": 20}),
    "model_bernoulli_bayes": ("bernoulli_bayes", {"alpha": 0.5, "binarize": 0.5, "fit_prior": False}),
    "model_gradient_boosting": (
        "gradient_boosting",
        {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.2, "subsample": 0.8, "scale_pos_weight": 2, "reg_alpha": 0.1,
         "reg_lambda": 2.0, "gamma": 0.05, "min_child_weight": 2},
    ),
    "model_sgd_hinge": ("sgd_classifier", {"loss": "hinge", "alpha": 0.001, "max_iter": 20}),
    "model_sgd_log_loss": ("sgd_classifier", {"loss": "log_loss", "alpha": 0.001}),
}
for _name, (_family, _params) in _FITS.items():
    query(_name)(lambda t, f=_family, p=_params: scores_of(t, f, p))


def rows_of(t, family, params, data, digits=6):
    """Fit on the unscaled training rows: key, label, prediction and rounded score of every test row."""
    parts = MP.prepare(data(t), scale=False)
    scored = M.score_rows(M.fit(parts.train, family, params, MP.LABEL, MP.KEY), parts.test, MP.LABEL, [MP.KEY])
    return scored.withColumn("score", F.round("score", digits))


#: Line items as ``lines_set`` has them, with the part each one falls in.
_LINES_SQL = f"""lines as (
    select row_key, any_value(l_quantity) as q, any_value(l_discount) as d, any_value(l_tax) as x, any_value(label) as label,
      {hash_sql('row_key')} < {TEST_LIMIT} as test
    from (select concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as row_key, l_quantity, l_discount, l_tax,
            cast(l_quantity * (1 + l_tax) + l_discount * 100 > 32 as integer) as label from lineitem)
    group by 1)"""


def small_lines_set(t):
    """``lines_set`` without the price: features with few values, so that every value is a cut."""
    return lines_set(t).drop("l_extendedprice")


@query(
    "boosted_stump",
    f"""with {_LINES_SQL},
    cells as (select 0 as f, q as v, label from lines where not test union all
      select 1, d, label from lines where not test union all select 2, x, label from lines where not test),
    sums as (select f, v, sum(case when label = 1 then -1.0 else 0.5 end) as g, sum(case when label = 1 then 0.5 else 0.25 end) as h
      from cells group by 1, 2),
    upto as (select f, v, sum(g) over w as gl, sum(h) over w as hl, sum(g) over (partition by f) as g, sum(h) over (partition by f) as h
      from sums window w as (partition by f order by v)),
    drawn as (select *, greatest(abs(gl) - 0.5, 0) as tl, greatest(abs(g - gl) - 0.5, 0) as tr, greatest(abs(g) - 0.5, 0) as tw from upto),
    gains as (select *, tl * tl / (hl + 2) + tr * tr / (h - hl + 2) - tw * tw / (h + 2) as gain from drawn where hl >= 3 and h - hl >= 3),
    best as (select * from gains order by gain desc, f, v limit 1),
    margins as (select row_key, label, case when (case f when 0 then q when 1 then d else x end) <= v
        then -0.3 * sign(gl) * tl / (hl + 2) else -0.3 * sign(g - gl) * tr / (h - hl + 2) end as m
      from lines, best where test)
    select row_key, label as {MP.LABEL}, cast(m > 0 as integer) as prediction, round(1 / (1 + exp(-m)), 6) as score from margins""",
)
def _(t):
    """One boosted split with every penalty, whose leaves plain SQL can count."""
    params = {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.3, "reg_alpha": 0.5, "reg_lambda": 2.0, "min_child_weight": 3,
              "scale_pos_weight": 2, "gamma": 0.1}
    return rows_of(t, "gradient_boosting", params, small_lines_set)


def _bayes_sql(prior: str) -> str:
    """Bernoulli scores from counted values above 0.05, smoothed by 0.5; ``prior`` is the log-odds that is added."""
    bits = [f"cast({c} > 0.05 as integer)" for c in "qdx"]
    ones = ", ".join(f"(sum({b}) filter (where label = {y}) + 0.5) / (count(*) filter (where label = {y}) + 1.0) as p{k}{y}"
                     for k, b in enumerate(bits) for y in (0, 1))
    terms = " + ".join(f"case when {b} = 1 then ln(p{k}1) - ln(p{k}0) else ln(1 - p{k}1) - ln(1 - p{k}0) end" for k, b in enumerate(bits))
    return f"""with {_LINES_SQL},
    learnt as (select {ones}, count(*) filter (where label = 1) + 0.5 as n1, count(*) filter (where label = 0) + 0.5 as n0 from lines where not test),
    odds as (select row_key, label, {prior} + {terms} as m from lines, learnt where test)
    select row_key, label as {MP.LABEL}, cast(m > 0 as integer) as prediction, round(1 / (1 + exp(-m)), 6) as score from odds"""


@query("bayes_scores", _bayes_sql("ln(n1) - ln(n0)"))
def _(t):
    return rows_of(t, "bernoulli_bayes", {"alpha": 0.5, "binarize": 0.05}, small_lines_set)


@query("bayes_scores_even", _bayes_sql("0"))
def _(t):
    return rows_of(t, "bernoulli_bayes", {"alpha": 0.5, "binarize": 0.05, "fit_prior": False}, small_lines_set)


@query("model_knn")
def _(t):
    return scores_of(t, "knn_classifier", {"n_neighbors": 7, "weights": "distance", "metric": "manhattan"}, documents_set)


#: Test rows with their labels, and what holds for every scored row.
_SCORED = f"""select cast(doc_id as bigint) as {MP.KEY}, quality as {MP.LABEL}, %s
    from labels join documents using (doc_id) where {hash_sql('doc_id')} < {TEST_LIMIT}"""


def _agreement():
    """1 where the score is a probability and the prediction is what it says."""
    said = (F.col("score") > 0.5).cast("int") == F.col("prediction")
    return (said & F.col("score").between(0, 1)).cast("int").alias("agrees")


@query("score_rows", _SCORED % "1 as agrees")
def _(t):
    parts = MP.prepare(documents_set(t))
    model = M.fit(parts.train, "logistic_regression", {}, MP.LABEL)
    scored = M.score_rows(model, parts.test, MP.LABEL, [MP.KEY])
    return scored.select(MP.KEY, MP.LABEL, _agreement())


@query("class_balance", """select quality, count(*) as n, round(sum(w), 6) as weight from
    (select quality, case when quality = 1 then n / (2.0 * p) else n / (2.0 * (n - p)) end as w
     from labels, (select count(*) as n, sum(quality) as p from labels)) group by 1""")  # fmt: skip
def _(t):
    weighted = M.class_weights(t("labels"), "quality", "balanced")
    return weighted.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("pca")
def _(t):
    wide = vectors_set(t).select(MP.KEY, *[F.col("e")[i].alias(f"e{i}") for i in range(64)])
    return M.principal_components(wide, [f"e{i}" for i in range(64)], 3, [MP.KEY])[0]


@query("pca_variance")
def _(t):
    from wardtable.functions.tables import literal_table

    wide = vectors_set(t).select(*[F.col("e")[i].alias(f"e{i}") for i in range(64)])
    shares = M.principal_components(wide, [f"e{i}" for i in range(64)], 2)[1]
    return literal_table(t.spark, [(i + 1, s) for i, s in enumerate(shares)], "component int, share double")


# --- search -----------------------------------------------------------------


def _folded(t, folds=3):
    return MP.prepare(documents_set(t), folds=folds)


@query("grid_search")
def _(t):
    grid = {"C": [0.1, 10], "penalty": ["l2", "l1"], "max_iter": [40], "solver": ["saga"]}
    return S.cv_search(_folded(t).train, {"logistic_regression": grid}, MP.LABEL)[1]


@query("random_search")
def _(t):
    spaces = {
        "logistic_regression": {"C": S.LogUniform(0.1, 500), "penalty": ["l2", "l1", "elasticnet"], "max_iter": [40]},
        "bernoulli_bayes": {"alpha": S.Uniform(0.1, 2.0), "fit_prior": [True, False], "binarize": S.Uniform(0.0, 2.0)},
    }
    return S.cv_search(_folded(t).train, spaces, MP.LABEL, n_iter=3)[0].drop("elapsed_time")


_SMALL_TRIALS = {
    "random_forest": {**S.TRIAL_SPACES["random_forest"], "n_estimators": S.IntRange(5, 20), "max_depth": S.IntRange(3, 8)},
    "svc": {**S.TRIAL_SPACES["svc"], "kernel": ["linear", "rbf"]},
    "gradient_boosting": {**S.TRIAL_SPACES["gradient_boosting"], "n_estimators": S.IntRange(5, 20), "max_depth": S.IntRange(3, 8)},
}


def _trial_log(t, family="random_forest", n=4):
    parts = MP.prepare(documents_set(t), validation=0.2)
    return S.run_trials(parts.train, parts.validation, family, _SMALL_TRIALS[family], n, MP.LABEL)


@query("trials")
def _(t):
    return _trial_log(t)


@query(
    "refit_from_log",
    f"""select 1 as trials, count(*) filter (where quality = 0) as n0, count(*) filter (where quality = 1) as n1
        from labels join documents using (doc_id) where {hash_sql('doc_id')} < {TEST_LIMIT}""",
)
def _(t):
    """A trial log is written, read, and its first front trial refitted: class totals of the test rows."""
    folder = new_folder(t.spark, "trial-log")
    log = MP.save_tables({"trials": _trial_log(t, n=3)}, folder)["trials"]
    refit = MP.refit_from_log(documents_set(t), log)
    none = F.lit(0)
    counts = refit["confusion"].select(none.alias("trials"), (F.col("tn") + F.col("fp")).alias("n0"), (F.col("fn") + F.col("tp")).alias("n1"))
    chosen = refit["chosen"].select(F.lit(1).alias("trials"), none.alias("n0"), none.alias("n1"))
    return counts.unionByName(chosen).agg(F.sum("trials").cast("int").alias("trials"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@query("trial_history")
def _(t):
    log = S.complete_trials(_trial_log(t, "svc", 3))
    return L.best_so_far(log, "trial_id", "f1", by=["model"]).select("model", "trial_id", "f1", "log_loss", "best")


@query("param_influence")
def _(t):
    return S.parameter_influence(_trial_log(t))


@query(
    "variance_shares",
    """with log as (select l_linenumber as a, l_returnflag as b, avg(l_extendedprice) as y from lineitem group by 1, 2),
    alone as (select 'l_linenumber' as parameter, var_pop(e) as v from (select avg(y) as e from log group by a)
      union all select 'l_returnflag', var_pop(e) from (select avg(y) as e from log group by b))
    select parameter, round(v / (select sum(v) from alone), 6) as influence, round(v / (select var_pop(y) from log), 6) as share from alone""",
)
def _(t):
    """Every pair of line number and return flag as a trial whose result is the mean price: shares that plain SQL can count."""
    pairs = t("lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_extendedprice").alias("f1"))
    log = pairs.select(F.lit("COMPLETE").alias("state"), F.to_json(F.struct("l_linenumber", "l_returnflag")).alias("params"), "f1")
    found = S.parameter_influence(log, trees=1)
    return found.select("parameter", F.round("influence", 6).alias("influence"), F.round("share", 6).alias("share"))


@query("feature_elimination")
def _(t):
    parts = _folded(t, 2)
    return S.eliminate_features(parts.train, parts.features, "logistic_regression", {"max_iter": 30}, MP.LABEL, step=2)[1]


@query("perm_importance")
def _(t):
    parts = MP.prepare(lines_set(t))
    model = M.fit(parts.train, "logistic_regression", {}, MP.LABEL)
    found = S.permutation_importance(model, parts.train, parts.features, MP.KEY, MP.LABEL, repeats=3)
    return L.ranked_features(found)


# --- whole modelling jobs ---------------------------------------------------



def clinical_set(t):
    """Patients, comorbidities, signs of mental state and laboratory values, one row per admission."""
    forms = [
        FP.comorbidities(form(t, "tbl_comorbilidad")),
        FP.sepsis_labs(form(t, "tbl_sepsis")),
        form(t, "tbl_signos").select(*FP.KEYS.both, "estado_mental_alterado"),
    ]
    base = FP.patients(form(t, "tbl_paciente"), form(t, "tbl_personid2center"), form(t, "tbl_infecciones_previas"))
    joined = FP.J.join_forms(base, forms, FP.KEYS.both)
    return MP.with_row_key(joined, FP.KEYS.both)


@query(
    "modelling_complete",
    with_steps(
        """select concat_ws('|', person_id, fecha_ingreso_urgencias) as row_key, edad, mujer_gestante, inf_previa_sino,
             bmr_infec_previa, diabetes, lactato_serico, proteina_c_reactiva, qsofa, creatinina, plaquetas, respiracion, vasopresores,
             cardiovascular, sepsis, proteina_c_reactiva_recoded,
             "tipo_hepatopatia_1.0" + "tipo_hepatopatia_2.0" + "tipo_hepatopatia_3.0" as enf_hepaticas,
             "tipo_cancer_1.0" + "tipo_cancer_2.0" + "tipo_cancer_3.0" + "tipo_cancer_4.0" as tumores
           from patients join comorbidities using (person_id, fecha_ingreso_urgencias)
           join sepsis_labs using (person_id, fecha_ingreso_urgencias) where proteina_c_reactiva is not null"""
    ),
)
def _(t):
    return MP.complete_set(clinical_set(t))


@query("modelling_imputed")
def _(t):
    return MP.imputed_set(clinical_set(t))


@query("experiment")
def _(t):
    """The whole study: all families, full ranges, every trial."""
    return MP.experiment(MP.complete_set(clinical_set(t)).drop("mujer_gestante")).comparison


def long_documents_set(t):
    """Text statistics of the labelled documents; label: more than 250 words, which every family can learn."""
    return documents_set(t).withColumn(MP.LABEL, (F.col("words") > 250).cast("int"))


#: Label of ``long_documents_set`` for the test rows, and both class totals.
_LONG_SQL = f"""tested as (select doc_id, cast(length(regexp_split_to_array(text, '\\s+')) > 250 as integer) as y
      from labels join documents using (doc_id) where {hash_sql('doc_id')} < {TEST_LIMIT}),
    totals as (select count(*) filter (where y = 0) as n0, count(*) filter (where y = 1) as n1 from tested)"""


def _right(metric, least):
    return F.coalesce((F.col(metric) >= least).cast("int"), F.lit(0))


@query(
    "experiment_reports",
    f"""with {_LONG_SQL} select model, n0, n1, 1 as learnt, 5 as lines, 1 as roc_whole, 1 as pr_whole
    from totals, (values ('gradient_boosting'), ('random_forest'), ('svc')) v(model)""",
)
def _(t):
    """All three families tuned; per model the class totals of the test rows, and whether its reports are whole and the label was learnt."""
    reports = MP.experiment_reports(MP.experiment(long_documents_set(t), _SMALL_TRIALS, 2))
    n0, n1 = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    counts = reports["confusion"].select("model", n0.alias("n0"), n1.alias("n1"), ((F.col("tn") + F.col("tp")) / (n0 + n1)).alias("hit"))
    lines = reports["class_report"].groupBy("model").agg(F.count(F.lit(1)).cast("int").alias("lines"), F.min("roc_auc").alias("area"))
    ends = [F.min("fpr") == 0, F.min("tpr") == 0, F.max("fpr") == 1, F.max("tpr") == 1]
    roc = reports["roc_points"].groupBy("model").agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)])
    roc = roc.select("model", (F.col("e0") & F.col("e1") & F.col("e2") & F.col("e3")).cast("int").alias("roc_whole"))
    pr = reports["pr_points"].groupBy("model").agg(((F.min("recall") == 0) & (F.max("recall") == 1)).cast("int").alias("pr_whole"))
    joined = counts.join(lines, "model", "left").join(roc, "model", "left").join(pr, "model", "left")
    learnt = _right("hit", 0.8) * _right("area", 0.9)
    return joined.select("model", "n0", "n1", learnt.alias("learnt"), "lines", "roc_whole", "pr_whole")


def signs_set(t):
    """``clinical_set`` with the vital signs that the selection study kept."""
    signs = FP.vital_signs(form(t, "tbl_signos")).select(*FP.KEYS.both, "saturacion_o2", "frec_cardiaca")
    keyed = MP.with_row_key(signs, FP.KEYS.both).drop(*FP.KEYS.both)
    return clinical_set(t).join(keyed, MP.KEY)


@query("experiment_selected")
def _(t):
    """The whole study over the features of the selection."""
    return MP.experiment(MP.selected_set(signs_set(t))).comparison


@query("feature_selection")
def _(t):
    families = {"logistic_regression": {"max_iter": 30}, "decision_tree": {"max_depth": 5}}
    return MP.select_features(documents_set(t), families, folds=2, step=3)["metrics"]


@query("boosted_refit")
def _(t):
    return MP.refit_and_report(documents_set(t))["report"]


@query("run_testing")
def _(t):
    grid = {"logistic_regression": {"C": [1.0, 100.0]}}
    return MP.run_testing(documents_set(t), grid, folds=2, repeats=2)["report"]


def bulk_lines_set(t):
    """``lines_set`` whose label is a bound on the quantity alone."""
    return lines_set(t).withColumn(MP.LABEL, (F.col("l_quantity") > 25).cast("int"))


@query(
    "run_testing_importance",
    """select feature, cast(feature = 'l_quantity' as integer) as leads
    from (select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as feature) where (select count(*) from lineitem) > 0""",
)
def _(t):
    """Permutation importance of the best tree of a search: the label is a bound on the quantity, so that feature leads alone."""
    grid = {"decision_tree": {"max_depth": [1, 2]}}
    ranked = MP.run_testing(bulk_lines_set(t), grid, folds=2, repeats=2)["importance"]
    return ranked.select("feature", (F.col("importance") > 0.2).cast("int").alias("leads"))


# --- sources and sinks ------------------------------------------------------


@query(
    "catalog",
    """select form, n_columns from (values ('customer', 5), ('events', 6), ('lineitem', 11), ('nation', 3), ('orders', 6),
       ('part', 6), ('region', 2), ('supplier', 4), ('documents', 5), ('embeddings', 3), ('pages', 3), ('benchmark', 2), ('labels', 3),
       ('conversations', 4)) v(form, n_columns) where (select count(*) from region) > 0""",
)
def _(t):
    return K.describe_catalog(K.load_catalog(t.spark, t.sf_dir)).select("form", F.size("columns").alias("n_columns"))


@query(
    "recode_catalog",
    """select 'supplier' as form, 's_nationkey' as variable, 'value without a name' as problem, count(*) as n
       from supplier where s_nationkey not in (select r_regionkey from region)
       union all select 'nation', 'n_absent', 'no such column', null""",
)
def _(t):
    regions = t("region")
    codes = regions.select(
        F.lit("supplier").alias("form"), F.lit("s_nationkey").alias("variable"),
        F.col("r_regionkey").cast("string").alias("value"), F.col("r_name").alias("name"),
    ).unionByName(
        regions.select(
            F.lit("nation").alias("form"), F.lit("n_absent").alias("variable"),
            F.col("r_regionkey").cast("string").alias("value"), F.col("r_name").alias("name"),
        )
    )
    forms = {f"tbl_{n}": t(n) for n in ["supplier", "nation", "customer"]}
    return K.recode_catalog(forms, codes)[1]


@query(
    "csv_roundtrip",
    "select o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') as o_orderpriority, o_totalprice from orders",
)
def _(t):
    rows = t("orders").select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_totalprice"
    )
    path = new_folder(t.spark, "csv")
    K.write_csv(rows, path)
    return K.read_csv(t.spark, path, schema="o_orderkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double")


@query("save_load", _SCORED % "1 as valid, 0 as differs")
def _(t):
    """Scores of a model that was written and read, and where they differ from those before."""
    parts = MP.prepare(documents_set(t))
    path = new_folder(t.spark, "model")
    fitted = M.fit(parts.train, "svc", {"kernel": "rbf", "components": 16, "gamma": "auto"}, MP.LABEL)
    fitted.save(path)
    scored = M.score_rows(M.load(path, "svc"), parts.test, MP.LABEL, [MP.KEY])
    before = M.score_rows(fitted, parts.test, MP.LABEL, [MP.KEY])
    before = before.select(MP.KEY, F.col("prediction").alias("_prediction"), F.col("score").alias("_score"))
    same = (F.col("prediction") == F.col("_prediction")) & (F.col("score") == F.col("_score"))
    return scored.join(before, MP.KEY, "left").select(
        MP.KEY, MP.LABEL, F.col("score").between(0, 1).cast("int").alias("valid"), F.coalesce((~same).cast("int"), F.lit(1)).alias("differs")
    )


