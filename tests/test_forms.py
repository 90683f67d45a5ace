"""The form jobs on hand-made tables, one golden value per rule."""

import datetime as dt
import uuid

import pytest

from wardtable.plans import forms as P

A, B = "2024-01-10", "2024-02-10"


@pytest.fixture(scope="module")
def catalog(spark):
    def table(data, schema):
        return spark.createDataFrame(data, schema)

    k = "person_id bigint, fecha_ingreso_urgencias string, "
    return {
        "tbl_paciente": table([(1, A, None, 70), (1, B, "False", 70), (2, A, "True", None)], k + "mujer_gestante string, edad int"),
        "tbl_personid2center": table([(1, 5)], "person_id bigint, center int"),
        "tbl_microorganismos": table(
            [("10", "VIRUS"), ("10", "ECOLI"), ("11", "VIRUS"), ("12", "???"), ("13", "KP")], "snomed_code string, label string"
        ),
        "tbl_comorbilidad": table([(1, A, 1.0, None), (2, A, 2.0, 1.0)], k + "tipo_cancer double, tipo_hepatopatia double"),
        "tbl_factores_riesgo_bmr": table([(1, A, 1)], k + "sonda int"),
        "tbl_sintomas": table(
            [(1, A, 1.0, 3.0), (1, A, 1.0, 5.0), (1, A, 2.0, 7.0), (1, A, None, 1.0), (2, A, 2.0, 0.0), (2, A, 1.0, None), (1, None, 1.0, 9.0)],
            k + "sintoma double, duracion_sintoma double",
        ),
        "tbl_signos": table(
            [(1, A, "38.5 C", "22", "95", "95/60", "91 %", 0, 0, 0, 0, 1), (2, A, None, None, "x", None, None, 1, 1, 1, 1, None),
             (1, B, "35.9", "20", "90", "101", "90", 1, 1, 1, 0, 0)],
            k + "temperatura string, frec_respiratoria string, frec_cardiaca string, tension_arterial string, saturacion_o2 string, "
            "hipotension int, taquipnea int, taquicardia int, hipoxemia int, estado_mental_alterado int",
        ),
        "tbl_sepsis": table(
            [(1, A, "<= 2 millimole per liter", "12.5 mg", 2, 1), (1, B, None, "-3", 1, 0), (2, A, "> 2 millimole per liter", "n/a", 3, 0)],
            k + "lactato_serico string, proteina_c_reactiva string, qsofa int, sepsis int",
        ),
        "tbl_infecciones_previas": table(
            [(1, A, "10", 1, 0, "2023-05-01"), (1, A, "10", None, 0, "323-05-01"), (1, B, "11", 0, 0, "2023-06-01"), (3, A, "99", 0, 0, "2024-01-01")],
            k + "microorganism_infec_prev string, bmr_infec_previa int, feno_resist_infec_prev int, fecha_infeccion string",
        ),
        "tbl_hemocultivo_de_urgencias": table(
            [(1, A, 10.0, 1, 0, 0), (1, A, 10.0, 1, 1, 1), (1, A, 13.0, 1, 0, 0), (1, B, None, 0, 0, 0), (2, A, 12.0, 1, 0, 0), (2, A, 77.0, 0, 0, 0)],
            k + "microorganismo double, hemo_positivo_si_no int, bmr_etiologia int, fenotipo_resistencia int",
        ),
        "tbl_colonizaciones_previas": table([(1, A, "13"), (1, A, "13"), (2, A, "12")], k + "microorganism_colonizador string"),
        "tbl_otros_cultivos_en_urgencias": table(
            [(1, A, 10.0, None, 1, "x", 0, 0), (1, A, 10.0, None, 2, "y", 1, 1), (1, A, 10.0, 4.0, 3, "z", 0, 0), (2, A, None, 1.0, 4, "w", 0, 0), (2, A, 12.0, 1.0, 5, "v", 0, 0)],
            k + "microorganismo_otros_cult double, tipo_cultivo double, id_otros_cultivos int, fecha_otros_cultivos string, "
            "bmr_etiologia_otros int, fenotipo_resistencia_otros int",
        ),
    }


def test_patients(catalog, rows):
    out = P.patients(catalog["tbl_paciente"], catalog["tbl_personid2center"], catalog["tbl_infecciones_previas"])
    assert rows(out, "person_id", "fecha_ingreso_urgencias", "mujer_gestante", "edad", "center", "inf_previa_sino", "bmr_infec_previa") == [
        (1, A, "False", 70, 5, 1, 1), (1, B, "False", 70, 5, 1, 1), (2, A, "True", 0, 0, 0, 0),
    ]


def test_symptoms(catalog, rows):
    out = P.symptoms(catalog["tbl_sintomas"])
    assert out.columns[2:] == [
        "sintoma_1.0", "sintoma_2.0", "sintoma_nan", "sintoma_1.0_categorico", "sintoma_2.0_categorico", "sintoma_nan_categorico",
    ]
    assert rows(out) == [(1, A, 1, 1, 1, 2, 1, 1), (2, A, 0, 0, 0, 0, 0, 0)]


def test_vital_signs(catalog, rows):
    out = P.vital_signs(catalog["tbl_signos"])
    got = rows(
        out, "person_id", "fecha_ingreso_urgencias", "temperatura", "hipotermia_hipertermia", "hipotension", "taquipnea",
        "taquicardia", "hipoxemia", "temperatura_recoded",
    )
    assert got == [(1, A, 38.5, 2, 1, 1, 1, 0, 3), (1, B, 35.9, 1, 0, 0, 0, 1, 0), (2, A, None, None, 1, 1, 1, 1, None)]


def test_sepsis_labs(catalog, rows):
    out = P.sepsis_labs(catalog["tbl_sepsis"])
    assert rows(out, "person_id", "fecha_ingreso_urgencias", "lactato_serico", "proteina_c_reactiva", "qsofa") == [
        (1, A, 0.0, 12.5, 2.0), (1, B, 1.0, 3.0, 1.0), (2, A, 1.0, None, 3.0),
    ]


def test_organisms(catalog, rows):
    assert rows(P.organism_dictionary(catalog["tbl_microorganismos"])) == [
        ("10", "Escherichia coli"), ("11", "_Virus"), ("12", None), ("13", "Klebsiella pneumoniae"),
    ]


def test_blood_cultures(catalog, rows):
    organisms = P.organism_dictionary(catalog["tbl_microorganismos"])
    out = P.blood_cultures(catalog["tbl_hemocultivo_de_urgencias"], organisms)
    # Two identical isolates count once; a known code without label vanishes; unknown is NEGATIVE.
    assert rows(out, "person_id", "fecha_ingreso_urgencias", "Escherichia coli", "resultado_hemo") == [
        (1, A, 1, ["Escherichia coli", "Klebsiella pneumoniae"]), (1, B, 0, ["NEGATIVE"]), (2, A, 0, ["NEGATIVE"]),
    ]


def test_two_isolates_of_one_group_are_not_listed(spark, catalog, rows):
    organisms = P.organism_dictionary(catalog["tbl_microorganismos"])
    extra = spark.createDataFrame([(9, A, 1), (9, A, 1)], "person_id bigint, fecha_ingreso_urgencias string, hemo_positivo_si_no int")
    form = catalog["tbl_hemocultivo_de_urgencias"].limit(0).unionByName(extra, allowMissingColumns=True)
    form = form.withColumn("microorganismo", form["hemo_positivo_si_no"] * 13.0)
    out = P.blood_cultures(form, organisms)
    assert rows(out, "resultado_hemo") == [(["Klebsiella pneumoniae"],)]  # identical rows collapse first


def test_other_cultures_and_colonisations(catalog, rows):
    organisms = P.organism_dictionary(catalog["tbl_microorganismos"])
    out = P.other_cultures(catalog["tbl_otros_cultivos_en_urgencias"], organisms)
    assert rows(out) == [(1, A, 2, 0), (2, A, 0, 1)]
    assert out.columns[2:] == ["otros_cult_Escherichia coli", "otros_cult_NEGATIVE"]
    colo = P.colonisations(catalog["tbl_colonizaciones_previas"], organisms)
    assert colo.columns[2:] == ["colo_Klebsiella pneumoniae"] and rows(colo) == [(1, A, 2)]


def test_visits_fan_out_by_person_and_not_by_admission(catalog, rows):
    organisms = P.organism_dictionary(catalog["tbl_microorganismos"])
    groups = P.infection_groups(catalog["tbl_infecciones_previas"], organisms)
    pivoted = P.previous_infections(groups)
    by_person = P.infections_complete(pivoted, groups, on_admission=False)
    assert by_person.count() == 4 and "fecha_ingreso_urgencias_x" in by_person.columns
    by_admission = P.infections_complete(pivoted, groups, on_admission=True)
    last = dt.date(2023, 6, 1)
    assert rows(by_admission, "person_id", "fecha_ingreso_urgencias", "Escherichia coli", "_Virus", "numero_visitas", "ultima_fecha", "tiempo_ultima") == [
        (1, A, 2, 0, 2, last, 223), (1, B, 0, 1, 2, last, 254),
    ]
    assert rows(P.mean_days_between_infections(groups)) == [(1, 31.0), (3, None)]
    assert P.bad_infection_dates(catalog["tbl_infecciones_previas"]).count() == 1


@pytest.mark.parametrize("on_admission", [False, True])
def test_whole_job(spark, catalog, rows, tmp_path, on_admission):
    out = P.save_results(catalog, str(tmp_path), on_admission=on_admission)
    wide = out["wide"]
    # person 1: 2 admissions; by person they meet 4 visit rows x 1 colonisation x 2 cultures each
    assert wide.filter("person_id = 1").count() == (2 if on_admission else 2 * 4 * 2)
    assert wide.filter("person_id = 2").count() == 1
    one = wide.filter(f"person_id = 1 and fecha_ingreso_urgencias = '{A}' and array_contains(resultado_hemo, 'Klebsiella pneumoniae')").first()
    assert one["Klebsiella pneumoniae_total"] == 2  # twice colonised
    two = wide.filter("person_id = 2").first()
    assert two["numero_visitas"] == 0 and two["ultima_fecha"] is None and two["tiempo_ultima"] == 0
    processed = out["processed"]
    assert {"sintoma_fiebre", "sintoma_tos_categorico"} <= set(processed.columns)
    assert not {"sintoma_nan", "sintoma_1.0"} & set(processed.columns)
    assert processed.filter("person_id = 2").first()["qsofa"] is None  # a component is missing
    assert processed.filter("person_id = 2").first()["mujer_gestante"] == 1
    exploded = out["exploded"]
    sums = exploded.groupBy("person_id").agg({"weight": "sum"}).collect()
    assert all(r[1] == pytest.approx(1.0) for r in sums)
    assert out["aetiology"].filter("person_id = 2").first()["co_infection"] == 0


def test_stable_columns_add_only_zero_columns(catalog):
    a = P.build(catalog, on_admission=True)["wide"]
    b = P.build(catalog, on_admission=True, stable_columns=False)["wide"]
    extra = set(a.columns) - set(b.columns)
    assert set(b.columns) <= set(a.columns)
    row = a.selectExpr(*[f"sum(coalesce(`{c}`, 0)) as c{i}" for i, c in enumerate(sorted(extra))]).first()
    assert all(v == 0 for v in row)


def jobs_of(spark, make):
    """Number of Spark jobs that ``make`` starts."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    made = make()
    group = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setJobGroup("other", "other")
    return len(set(group)), made


def test_a_table_runs_only_its_own_jobs(spark, catalog):
    tables = P.build(catalog)
    assert jobs_of(spark, lambda: tables["patients"])[0] == 0
    assert jobs_of(spark, lambda: tables["symptoms"])[0] <= 2  # its levels
    own = sum(jobs_of(spark, lambda n=n: tables[n])[0] for n in ("vital_signs", "sepsis_labs", "comorbidities", "organisms"))
    before, wide = jobs_of(spark, lambda: tables["wide"])
    assert before <= 8 and own > 0  # the organism names, each query in several steps
    assert jobs_of(spark, lambda: tables["exploded"])[0] == 0
    assert tables["wide"] is wide
