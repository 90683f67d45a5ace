"""From per-form tables to one wide row per admission.

Each function is one result table; ``build`` chains them. Table and column names are
the input format of the study, so they are fixed values; keys are arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardtable.functions import expressions as X
from wardtable.functions.expressions import col
from wardtable.operators import columns as C
from wardtable.operators import joins as J
from wardtable.operators import reshape as R
from wardtable.operators import stats as S

# Classification of organisms. Names with "_" are the broad groups.
ORGANISM_GROUPS = {
    "NOEB": "_Other bacteria",
    "VIRUS": "_Virus",
    "FUNGUS": "_Fungi",
    "OEB": "_Enterobacteria",
    "ECOLI": "Escherichia coli",
    "SA": "Staphylococcus aureus",
    "PSA": "Pseudomonas aeruginosa",
    "KP": "Klebsiella pneumoniae",
    "SP": "Streptococcus pneumoniae",
    "EC": "Enterococcus",
}
NEGATIVE = "NEGATIVE"

# Symptom codes and their names.
SYMPTOMS = [
    "fiebre", "tos", "dificultad para respirar", "dolor costal", "disuria",
    "síndrome de disuria - polaquiuria", "tenesmo de ano y/o recto",
    "dolor en el ángulo renal", "náuseas", "vómitos", "dolor abdominal", "diarrea",
    "lesión de la piel", "lesión de mucosa", "cefalea", "dolor articular",
]
SYMPTOM_CODES = [{"value": str(i), "name": n} for i, n in enumerate(SYMPTOMS, start=1)]

# Measured signs, and the laboratory text that means "not raised".
SIGNS = ["temperatura", "frec_respiratoria", "frec_cardiaca", "tension_arterial", "saturacion_o2"]
LOW_LACTATE = "<= 2 millimole per liter"
DATE_TYPOS = {"323-05-01": "2023-05-01"}
QSOFA_PARTS = ["taquipnea", "estado_mental_alterado", "hipotension"]


@dataclass(frozen=True)
class Keys:
    person: str = "person_id"
    admission: str = "fecha_ingreso_urgencias"

    @property
    def both(self) -> list[str]:
        return [self.person, self.admission]


KEYS = Keys()


def _code_text(df: DataFrame, column: str):
    """Code as text: text as it is, numbers as whole-number text."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return col(column)
    return X.normalise_code(col(column), missing=None)


def _numbers_from_text(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every column but the keys as its first number; number columns lose their sign only."""
    out = []
    for f in df.schema.fields:
        if f.name in keys:
            out.append(col(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.abs(col(f.name).cast("double")).alias(f.name))
        else:
            out.append(X.first_number(col(f.name).cast("string")).alias(f.name))
    return df.select(*out)


# --- one table per form -----------------------------------------------------


def patients(patient: DataFrame, centers: DataFrame, infections: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Patients with centre, any-previous-infection and any-previous-resistance flags.

    All other gaps of the patient table are filled too (0, false or the text ``False``).
    """
    flagged = J.exists_flag(
        J.natural_left_join(patient, centers), infections, [keys.person], "inf_previa_sino"
    )
    resistant = S.any_positive(infections, [keys.person], "bmr_infec_previa", "bmr_infec_previa")
    joined = J.join_forms(flagged, [resistant], [keys.person], balance=True)
    return C.fill_missing(joined, False).withColumn("bmr_infec_previa", F.col("bmr_infec_previa").cast("int"))


def comorbidities(
    form: DataFrame, columns: Sequence[str] = ("tipo_cancer", "tipo_hepatopatia"), values: dict | None = None
) -> DataFrame:
    return R.one_hot(form, list(columns), values)


def symptoms(form: DataFrame, keys: Keys = KEYS, values: Sequence[str] | None = None) -> DataFrame:
    """Presence and duration class of each symptom, both from the same pivot."""
    named = form.withColumn("sintoma", F.concat(F.lit("sintoma_"), X.number_code(col("sintoma"))))
    wide = R.pivot_sum(named, keys.both, "sintoma", col("duracion_sintoma"), values)
    names = C.other_columns(wide, keys.both)
    return wide.select(
        *keys.both,
        *[X.presence(col(n)).alias(n) for n in names],
        *[X.duration_class(col(n)).alias(f"{n}_categorico") for n in names],
    )


def vital_signs(form: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Numbers from text, flags from measurements, outliers out, quartile labels."""
    n = _numbers_from_text(form, keys.both)
    flags = {
        "hipotension": X.threshold_flag(col("tension_arterial"), col("hipotension"), "<=", 100),
        "taquipnea": X.threshold_flag(col("frec_respiratoria"), col("taquipnea"), ">", 20),
        "taquicardia": X.threshold_flag(col("frec_cardiaca"), col("taquicardia"), ">", 90),
        "hipoxemia": X.threshold_flag(col("saturacion_o2"), col("hipoxemia"), ">", 90, met=0, unmet=1),
    }
    flagged = n.select(
        *[flags[c].alias(c) if c in flags else col(c) for c in n.columns],
        X.temperature_class(col("temperatura")).alias("hipotermia_hipertermia"),
    )
    return S.outliers_and_quartiles(flagged, SIGNS)


def sepsis_labs(form: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Lactate flag (missing counts as raised), numbers from text, C-reactive protein labels."""
    flagged = form.withColumn("lactato_serico", X.differs_flag(col("lactato_serico"), LOW_LACTATE))
    return S.outliers_and_quartiles(_numbers_from_text(flagged, keys.both), ["proteina_c_reactiva"])


def organism_dictionary(form: DataFrame) -> DataFrame:
    """One group label per code: named species before broad groups, missing labels last."""
    labelled = form.select("snomed_code", J.map_values(col("label"), ORGANISM_GROUPS).alias("label"))
    return J.first_label(labelled, "snomed_code", "label")


def infection_groups(infections: DataFrame, organisms: DataFrame) -> DataFrame:
    """Previous infections with their organism group instead of the raw codes."""
    found = J.lookup(
        infections, _code_text(infections, "microorganism_infec_prev"), organisms, "snomed_code", "label",
        "grupo_microorganismo",
    )
    return C.drop_columns(
        found, ["microorganism_infec_prev", "bmr_infec_previa", "feno_resist_infec_prev"], strict=True
    )


def previous_infections(
    groups: DataFrame, keys: Keys = KEYS, values: Sequence[str] | None = None
) -> DataFrame:
    return R.pivot_count(groups, keys.both, "grupo_microorganismo", values)


def blood_cultures(
    form: DataFrame, organisms: DataFrame, keys: Keys = KEYS, values: Sequence[str] | None = None
) -> DataFrame:
    """Organisms found per admission as a list; exactly one positive isolate counts as found."""
    named = J.lookup(
        form, X.normalise_code(col("microorganismo")), organisms, "snomed_code", "label", "microorganismo",
        default=NEGATIVE,
    )
    isolates = C.drop_columns(named, ["bmr_etiologia", "fenotipo_resistencia"], strict=True).distinct()
    wide = R.pivot_sum(isolates, keys.both, "microorganismo", col("hemo_positivo_si_no"), values)
    names = C.other_columns(wide, keys.both)
    return wide.withColumn("resultado_hemo", X.positive_names(names, NEGATIVE))


def colonisations(
    form: DataFrame, organisms: DataFrame, keys: Keys = KEYS, values: Sequence[str] | None = None
) -> DataFrame:
    found = J.lookup(
        form, _code_text(form, "microorganism_colonizador"), organisms, "snomed_code", "label",
        "microorganism_colonizador",
    )
    wide = R.pivot_count(found, keys.both, "microorganism_colonizador", values)
    return C.prefix_columns(wide, "colo_", keys.both)


def bad_infection_dates(infections: DataFrame) -> DataFrame:
    """Rows whose infection date does not look like a date."""
    return infections.filter(X.is_bad_date(col("fecha_infeccion")))


def visits(groups: DataFrame, keys: Keys = KEYS) -> tuple[DataFrame, DataFrame]:
    """Per person: distinct infection dates; per admission: last date and days since it."""
    dates = groups.select(
        keys.person,
        keys.admission,
        X.parse_date(X.fix_values(col("fecha_infeccion"), DATE_TYPOS)).alias("fecha_infeccion"),
    )
    count = S.distinct_per_key(dates, [keys.person], "fecha_infeccion", "numero_visitas")
    last = S.latest_per_key(dates, [keys.person], "fecha_infeccion", "ultima_fecha")
    admissions = dates.select(*keys.both).distinct()
    since = J.balanced_join(admissions, last, [keys.person], "inner", right_unique=True).withColumn(
        "tiempo_ultima", X.days_between(X.parse_date(col(keys.admission)), col("ultima_fecha"))
    )
    return count, since


def mean_days_between_infections(groups: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Mean days between successive infection dates of a person."""
    fixed = groups.select(
        keys.person, X.parse_date(X.fix_values(col("fecha_infeccion"), DATE_TYPOS)).alias("fecha_infeccion")
    )
    return S.mean_gap(fixed, [keys.person], "fecha_infeccion", "tiempo_medio")


def infections_complete(
    pivoted: DataFrame, groups: DataFrame, keys: Keys = KEYS, on_admission: bool = True
) -> DataFrame:
    """Infection counts with visits and recency.

    Recency joins its own admission; without ``on_admission`` it joins on the person alone, so a person
    with several admissions gets every combination.
    """
    count, since = visits(groups, keys)
    joined = J.join_forms(pivoted, [count], [keys.person], balance=True)
    if on_admission:
        return J.join_forms(joined, [since], keys.both)
    crossed = J.join_with_suffixes(joined, since, [keys.person], balance=True)
    return crossed.drop(f"{keys.admission}_y")


def other_cultures(
    form: DataFrame, organisms: DataFrame, keys: Keys = KEYS, values: Sequence[str] | None = None
) -> DataFrame:
    named = J.lookup(
        form, X.normalise_code(col("microorganismo_otros_cult")), organisms, "snomed_code", "label",
        "otro_cult_microorganismo", default=NEGATIVE,
    )
    slim = C.drop_columns(
        named,
        ["microorganismo_otros_cult", "id_otros_cultivos", "fecha_otros_cultivos", "bmr_etiologia_otros",
         "fenotipo_resistencia_otros"],
        strict=True,
    )
    filled = C.fill_missing(slim, 0, only=["tipo_cultivo"])
    wide = R.pivot_count(
        C.drop_incomplete_rows(filled).distinct(), keys.both, "otro_cult_microorganismo", values
    )
    return C.prefix_columns(wide, "otros_cult_", keys.both)


# --- the wide tables --------------------------------------------------------


def _history(
    base: DataFrame, infections: DataFrame, colonised: DataFrame, keys: Keys, on_admission: bool
) -> DataFrame:
    """Adds previous infections and colonisations; new number columns are 0 where absent."""
    before = base.columns
    if on_admission:
        out = J.join_forms(base, [infections, colonised], keys.both)
    else:
        out = J.join_forms(base, [infections], [keys.person], balance=True)
        out = J.join_person(out, colonised, *keys.both)
    return C.fill_missing(out, 0, only=C.added_columns(before, out))


def _with_result(base: DataFrame, cultures: DataFrame, keys: Keys, on_admission: bool) -> DataFrame:
    on = keys.both if on_admission else [keys.person]
    return J.join_forms(base, [cultures.select(*on, "resultado_hemo")], on, balance=not on_admission)


def wide_table(
    base: DataFrame,
    forms: Sequence[DataFrame],
    infections: DataFrame,
    colonised: DataFrame,
    cultures: DataFrame,
    keys: Keys = KEYS,
    on_admission: bool = True,
) -> DataFrame:
    """All forms on the patients; history and result columns by person or by admission."""
    joined = J.join_forms(base, forms, keys.both)
    return _with_result(_history(joined, infections, colonised, keys, on_admission), cultures, keys, on_admission)


def organism_totals(wide: DataFrame, organisms: DataFrame) -> DataFrame:
    """``{organism}_total`` over own, colonisation and other-culture counts."""
    # At most one name per organism group.
    names = [r["label"] for r in organisms.filter("label is not null").select("label").distinct().collect()]
    return C.sum_by_name(wide, names)


def explode_weighted(wide: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """One row per organism found, with the person's row weight and co-infection flag."""
    return R.row_weight(R.explode_list(wide, "resultado_hemo"), keys.person)


def aetiology_table(
    base: DataFrame,
    cultures: DataFrame,
    infections: DataFrame,
    colonised: DataFrame,
    labs: DataFrame,
    keys: Keys = KEYS,
    on_admission: bool = True,
) -> DataFrame:
    """History-only table for predicting the organism, exploded and weighted."""
    joined = _with_result(base, cultures, keys, on_admission)
    joined = _history(joined, infections, colonised, keys, on_admission)
    return explode_weighted(J.join_forms(joined, [labs], keys.both), keys)


def final_columns(wide: DataFrame) -> DataFrame:
    """Pregnancy as 0/1, score only with all its parts, symptom names instead of codes."""
    fixed = wide.withColumn("mujer_gestante", X.false_text_to_int(col("mujer_gestante")))
    fixed = fixed.withColumn("qsofa", X.only_if_complete(col("qsofa"), [col(c) for c in QSOFA_PARTS]))
    slim = C.drop_columns(fixed, ["sintoma_nan", "sintoma_nan_categorico"])
    names = C.names_from_codes(SYMPTOM_CODES, "sintoma_{}.0", "sintoma_{}")
    classes = C.names_from_codes(SYMPTOM_CODES, "sintoma_{}.0_categorico", "sintoma_{}_categorico")
    return C.rename_columns(slim, {**names, **classes})


# --- the whole job ----------------------------------------------------------


def build(
    catalog: dict[str, DataFrame],
    keys: Keys = KEYS,
    on_admission: bool = True,
    stable_columns: bool = True,
) -> Mapping[str, DataFrame]:
    """Every result table by name; see ``save_results`` for the sinks.

    A table is made when it is first asked for, and then only with the tables it needs: quantiles of
    the signs, for instance, are looked for only by tables that hold signs.

    ``stable_columns`` takes the organism columns from the dictionary: one small job instead
    of one pass over each form, and the same columns on every run. A group that a form never
    mentions is then a column of zeros; without it the column is left out.
    """
    forms = ["comorbidities", "risk_factors", "sepsis_labs", "vital_signs", "symptoms", "other_cultures"]

    def labels(t: Built) -> list | None:
        return t.once("labels", lambda: R.level_values(t["organisms"], "label")) if stable_columns else None

    def results(t: Built) -> list | None:
        return sorted([*labels(t), NEGATIVE]) if stable_columns else None

    def groups(t: Built) -> DataFrame:
        return t.once("groups", lambda: infection_groups(catalog["tbl_infecciones_previas"], t["organisms"]))

    return Built(
        {
            "patients": lambda t: patients(
                catalog["tbl_paciente"], catalog["tbl_personid2center"], catalog["tbl_infecciones_previas"], keys
            ),
            "comorbidities": lambda t: comorbidities(catalog["tbl_comorbilidad"]),
            "risk_factors": lambda t: catalog["tbl_factores_riesgo_bmr"],
            "symptoms": lambda t: symptoms(catalog["tbl_sintomas"], keys),
            "vital_signs": lambda t: vital_signs(catalog["tbl_signos"], keys),
            "sepsis_labs": lambda t: sepsis_labs(catalog["tbl_sepsis"], keys),
            "organisms": lambda t: organism_dictionary(catalog["tbl_microorganismos"]),
            "blood_cultures": lambda t: blood_cultures(
                catalog["tbl_hemocultivo_de_urgencias"], t["organisms"], keys, results(t)
            ),
            "colonisations": lambda t: colonisations(
                catalog["tbl_colonizaciones_previas"], t["organisms"], keys, labels(t)
            ),
            "other_cultures": lambda t: other_cultures(
                catalog["tbl_otros_cultivos_en_urgencias"], t["organisms"], keys, results(t)
            ),
            "previous_infections": lambda t: previous_infections(groups(t), keys, labels(t)),
            "infections_complete": lambda t: infections_complete(t["previous_infections"], groups(t), keys, on_admission),
            "wide": lambda t: organism_totals(
                wide_table(
                    t["patients"], [t[f] for f in forms], t["infections_complete"], t["colonisations"],
                    t["blood_cultures"], keys, on_admission,
                ),
                t["organisms"],
            ),
            "exploded": lambda t: explode_weighted(t["wide"], keys),
            "aetiology": lambda t: aetiology_table(
                t["patients"], t["blood_cultures"], t["infections_complete"], t["colonisations"], t["sepsis_labs"],
                keys, on_admission,
            ),
            "processed": lambda t: final_columns(t["wide"]),
        }
    )


class Built(Mapping):
    """Tables by name, each made once, when it is first asked for."""

    def __init__(self, recipes: dict[str, Callable[[Built], DataFrame]]):
        self._recipes = recipes
        self._made: dict = {}

    def once(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.once(name, lambda: self._recipes[name](self))

    def __iter__(self):
        return iter(self._recipes)

    def __len__(self) -> int:
        return len(self._recipes)


def save_results(
    catalog: dict[str, DataFrame], folder: str, keys: Keys = KEYS, on_admission: bool = True
) -> dict[str, DataFrame]:
    """Runs the whole job with one named parquet sink per table, each read back by its name.

    The wide table is written once; the exploded and the processed tables start from the
    written copy, so its joins are not repeated and a lost executor costs one stage only.
    """
    tables = build(catalog, keys, on_admission)
    spark = tables["wide"].sparkSession

    def stored(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    wide = stored("wide", tables["wide"])
    return {
        "wide": wide,
        "exploded": stored("exploded", explode_weighted(wide, keys)),
        "aetiology": stored("aetiology", tables["aetiology"]),
        "processed": stored("processed", final_columns(wide)),
    }
