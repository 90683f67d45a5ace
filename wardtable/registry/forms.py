"""The form-table jobs on forms derived from the given tables.

An admission is an order (customer x day); line items stand for symptoms and
cultures, priority classes for infections and colonisations, parts for the organism
dictionary. The derivations below are plain SQL that both engines run as it is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardtable.functions import expressions as X
from wardtable.plans import forms as P
from wardtable.registry.base import Tables, query

_KEYS = "o_custkey as person_id, concat(cast(o_orderdate as date), '') as fecha_ingreso_urgencias"
_ADM = f"(select {_KEYS}, min(o_orderkey) as m from {{orders}} group by 1, 2) a"
_LINES = "{lineitem} join {orders} on l_orderkey = o_orderkey"

FORMS = {
    "tbl_paciente": f"""select person_id, fecha_ingreso_urgencias, m % 90 as edad, 10000 + person_id % 100 as codigo_postal,
        case when m % 10 = 0 then 'True' when m % 10 < 7 then 'False' end as mujer_gestante from {_ADM}""",
    "tbl_personid2center": "select c_custkey as person_id, nullif(c_nationkey, 4) as center from {customer}",
    "tbl_comorbilidad": f"""select person_id, fecha_ingreso_urgencias, cast(nullif(m % 5, 0) as double) as tipo_cancer,
        cast(1 + m % 3 as double) as tipo_hepatopatia, m % 2 as diabetes from {_ADM}""",
    "tbl_factores_riesgo_bmr": f"""select person_id, fecha_ingreso_urgencias, m % 4 as institucionalizado from {_ADM}
        where m % 13 <> 0""",
    "tbl_sintomas": f"""select {_KEYS}, cast(nullif(l_linenumber, 7) as double) as sintoma,
        floor(l_quantity / 5) - 1 as duracion_sintoma from {_LINES}""",
    "tbl_signos": f"""select person_id, fecha_ingreso_urgencias,
        case when m % 17 = 0 then null when m % 101 = 1 then '371.2 C' else concat(34 + m % 7, '.', m % 10, ' C') end as temperatura,
        concat(10 + m % 25, ' rpm') as frec_respiratoria, concat(60 + m % 80, '') as frec_cardiaca,
        case when m % 11 = 0 then 'nan' else concat(80 + m % 70, '/60') end as tension_arterial,
        concat(80 + m % 20, '%') as saturacion_o2, m % 2 as hipotension, m % 3 as taquipnea, m % 2 as taquicardia,
        m % 2 as hipoxemia, nullif(m % 9, 0) as estado_mental_alterado from {_ADM}""",
    "tbl_sepsis": f"""select person_id, fecha_ingreso_urgencias,
        case m % 4 when 0 then '<= 2 millimole per liter' when 1 then null else '> 2 millimole per liter' end as lactato_serico,
        case when m % 97 = 0 then '9999.0' when m % 19 = 0 then null else concat(m % 300, '.5 mg/L') end as proteina_c_reactiva,
        m % 4 as qsofa, concat(m % 3, '.', m % 10) as creatinina, 100 + m % 200 as plaquetas, 0 - m % 5 as respiracion,
        m % 2 as vasopresores, m % 4 as cardiovascular,
        case when m % 7 + m % 3 > 4 then 1 else 0 end as sepsis from {_ADM}""",
    "tbl_infecciones_previas": f"""select {_KEYS}, concat(1 + o_orderkey % 60, '') as microorganism_infec_prev,
        case when o_orderkey % 5 = 0 then null else o_orderkey % 2 end as bmr_infec_previa, o_orderkey % 3 as feno_resist_infec_prev,
        case when o_orderkey % 211 = 0 then '323-05-01'
             else concat(cast(o_orderdate as date) - cast(o_orderkey % 300 as int), '') end as fecha_infeccion
        from {{orders}} where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "tbl_microorganismos": """select distinct concat(p_size, '') as snomed_code,
        case when p_type = 'SMALL' and p_size < 25 then 'OEB' else
          case p_size % 11 when 0 then 'NOEB' when 1 then 'VIRUS' when 2 then 'FUNGUS' when 3 then 'OEB' when 4 then 'ECOLI'
            when 5 then 'SA' when 6 then 'PSA' when 7 then 'KP' when 8 then 'SP' when 9 then 'EC' else 'ZZZ' end end as label
        from {part}""",
    "tbl_hemocultivo_de_urgencias": f"""select {_KEYS}, case when l_quantity <= 45 then l_quantity end as microorganismo,
        case when l_returnflag = 'R' then 1 else 0 end as hemo_positivo_si_no, l_linenumber as bmr_etiologia,
        l_tax as fenotipo_resistencia from {_LINES} where l_linestatus = 'F'""",
    "tbl_colonizaciones_previas": f"""select {_KEYS}, concat(1 + o_orderkey % 55, '') as microorganism_colonizador
        from {{orders}} where o_orderpriority = '5-LOW'""",
    "tbl_otros_cultivos_en_urgencias": f"""select {_KEYS}, nullif(l_quantity, 13) as microorganismo_otros_cult,
        cast(nullif(l_linenumber, 2) as double) as tipo_cultivo, l_partkey as id_otros_cultivos, l_suppkey as fecha_otros_cultivos,
        l_discount as bmr_etiologia_otros, l_tax as fenotipo_resistencia_otros from {_LINES} where l_linestatus = 'O'""",
}

GIVEN = ["orders", "lineitem", "customer", "part"]


def form(t: Tables, name: str):
    text = FORMS[name]
    used = {g: t(g) for g in GIVEN if "{" + g + "}" in text}
    return t.spark.sql(text, **used)


def catalog(t: Tables):
    return {name: form(t, name) for name in FORMS}


# --- SQL twins --------------------------------------------------------------

LABELS = sorted(P.ORGANISM_GROUPS.values())
RESULTS = sorted([*LABELS, P.NEGATIVE])
K = "person_id, fecha_ingreso_urgencias"


def _first_number(c: str) -> str:
    return f"try_cast(nullif(regexp_extract({c}, '[0-9]+\\.[0-9]+|[0-9]+'), '') as double)"


def _clean(source: str, out: str, cols: list[str]) -> str:
    """Outliers to null and quartile labels, for SQL over a CTE named ``source``."""
    lim = ", ".join(
        f"quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo_{c}, "
        f"quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi_{c}"
        for c in cols
    )
    nulled = ", ".join(f"case when {c} < lo_{c} or {c} > hi_{c} then null else {c} end as {c}" for c in cols)
    edges = ", ".join(f"quantile_cont({c}, {s}) as e{i}_{c}" for c in cols for i, s in enumerate([0.25, 0.5, 0.75]))
    labels = ", ".join(
        f"case when {c} is null then null when {c} <= e0_{c} then 0 when {c} <= e1_{c} then 1 "
        f"when {c} <= e2_{c} then 2 else 3 end as {c}_recoded"
        for c in cols
    )
    gone = ", ".join(f"lo_{c}, hi_{c}" for c in cols)
    gone_edges = ", ".join(f"e{i}_{c}" for c in cols for i in range(3))
    return f"""{out}_l as (select {lim} from {source}),
      {out}_c as (select * exclude ({gone}) replace ({nulled}) from {source}, {out}_l),
      {out}_e as (select {edges} from {out}_c),
      {out} as (select * exclude ({gone_edges}), {labels} from {out}_c, {out}_e)"""


_MAP = "case label " + " ".join(f"when '{a}' then '{b}'" for a, b in P.ORGANISM_GROUPS.items()) + " end"
_CODE = "coalesce(cast(cast({} as bigint) as varchar), '0')"
_ONE = "case when {c} = {v} then 1 else 0 end as \"{c}_{v}\""

STEPS = {
    "patients": f"""select p.person_id, p.fecha_ingreso_urgencias, p.edad, p.codigo_postal, coalesce(p.mujer_gestante, 'False') as mujer_gestante,
        coalesce(c.center, 0) as center,
        case when exists (select 1 from tbl_infecciones_previas i where i.person_id = p.person_id) then 1 else 0 end as inf_previa_sino,
        case when exists (select 1 from tbl_infecciones_previas i where i.person_id = p.person_id and i.bmr_infec_previa > 0) then 1 else 0 end as bmr_infec_previa
        from tbl_paciente p left join tbl_personid2center c on c.person_id = p.person_id""",
    "comorbidities": f"select {K}, diabetes, "
    + ", ".join(_ONE.format(c="tipo_cancer", v=f"{v}.0") for v in [1, 2, 3, 4])
    + ", " + ", ".join(_ONE.format(c="tipo_hepatopatia", v=f"{v}.0") for v in [1, 2, 3]) + " from tbl_comorbilidad",
    "risk_factors": "select * from tbl_factores_riesgo_bmr",
    "symptom_sums": f"select {K}, "
    + ", ".join(f"coalesce(sum(duracion_sintoma) filter (where sintoma = {i}), 0) as s{i}" for i in range(1, 7))
    + f", coalesce(sum(duracion_sintoma) filter (where sintoma is null), 0) as s7 from tbl_sintomas group by {K}",
    "symptoms": f"select {K}, "
    + ", ".join(
        f'case when s{i} > 0 then 1 else 0 end as "sintoma_{n}", '
        f'case when s{i} = 0 then 0 when s{i} <= 7 then 1 else 2 end as "sintoma_{n}_categorico"'
        for i, n in [*[(i, f"{i}.0") for i in range(1, 7)], (7, "nan")]
    )
    + " from symptom_sums",
    "sign_numbers": f"select {K}, "
    + ", ".join(f"{_first_number(c)} as {c}" for c in P.SIGNS)
    + ", "
    + ", ".join(
        f"abs(cast({c} as double)) as {c}"
        for c in ["hipotension", "taquipnea", "taquicardia", "hipoxemia", "estado_mental_alterado"]
    )
    + " from tbl_signos",
    "sign_flags": """select * replace (
          case when tension_arterial is null then hipotension when tension_arterial <= 100 then 1 else 0 end as hipotension,
          case when frec_respiratoria is null then taquipnea when frec_respiratoria > 20 then 1 else 0 end as taquipnea,
          case when frec_cardiaca is null then taquicardia when frec_cardiaca > 90 then 1 else 0 end as taquicardia,
          case when saturacion_o2 is null then hipoxemia when saturacion_o2 > 90 then 0 else 1 end as hipoxemia),
        case when temperatura is null then null when temperatura >= 38 then 2 when temperatura >= 36 then 0 else 1 end
          as hipotermia_hipertermia from sign_numbers""",
    "lab_numbers": f"""select {K}, case when lactato_serico = '<= 2 millimole per liter' then 0.0::double else 1.0::double end as lactato_serico,
        {_first_number('proteina_c_reactiva')} as proteina_c_reactiva, abs(cast(qsofa as double)) as qsofa,
        {_first_number('creatinina')} as creatinina, abs(cast(plaquetas as double)) as plaquetas,
        abs(cast(respiracion as double)) as respiracion, abs(cast(vasopresores as double)) as vasopresores,
        abs(cast(cardiovascular as double)) as cardiovascular, abs(cast(sepsis as double)) as sepsis from tbl_sepsis""",
    "organisms": f"select snomed_code, min({_MAP}) as label from tbl_microorganismos group by 1",
    "previous_infections": f"select {K}, "
    + ", ".join(f"count(*) filter (where label = '{x}') as \"{x}\"" for x in LABELS)
    + f""" from tbl_infecciones_previas join organisms on snomed_code = microorganism_infec_prev
          where label is not null group by {K}""",
    "isolates": f"""select distinct {K}, case when snomed_code is null then 'NEGATIVE' else label end as name, hemo_positivo_si_no
        from tbl_hemocultivo_de_urgencias left join organisms on snomed_code = {_CODE.format("microorganismo")}""",
    "culture_sums": f"select {K}, "
    + ", ".join(f"sum(case when name = '{x}' then hemo_positivo_si_no else 0 end) as \"{x}\"" for x in RESULTS)
    + f" from isolates where name is not null group by {K}",
    "blood_cultures": f"select {K}, "
    + ", ".join(f'cast("{x}" as bigint) as "{x}"' for x in RESULTS)
    + ", coalesce(nullif(concat_ws(', ', "
    + ", ".join(f"case when \"{x}\" = 1 then '{x}' end" for x in RESULTS)
    + "), ''), 'NEGATIVE') as resultado_hemo from culture_sums",
    "colonisations": f"select {K}, "
    + ", ".join(f"count(*) filter (where label = '{x}') as \"colo_{x}\"" for x in LABELS)
    + f""" from tbl_colonizaciones_previas join organisms on snomed_code = microorganism_colonizador
          where label is not null group by {K}""",
    "infection_days": f"""select {K}, try_cast(case when fecha_infeccion = '323-05-01' then '2023-05-01' else fecha_infeccion end as date) as day
        from tbl_infecciones_previas""",
    "last_visit": "select person_id, count(distinct day) as numero_visitas, max(day) as ultima_fecha from infection_days group by 1",
    "since": f"""select distinct i.person_id, i.fecha_ingreso_urgencias, cast(ultima_fecha as varchar) as ultima_fecha,
        cast(date_diff('day', ultima_fecha, cast(i.fecha_ingreso_urgencias as date)) as integer) as tiempo_ultima
        from infection_days i join last_visit v on v.person_id = i.person_id""",
    "infections_by_person": """select p.* exclude (fecha_ingreso_urgencias), p.fecha_ingreso_urgencias as fecha_ingreso_urgencias_x,
        v.numero_visitas, s.ultima_fecha, s.tiempo_ultima from previous_infections p
        left join last_visit v on v.person_id = p.person_id left join since s on s.person_id = p.person_id""",
    "infections_complete": """select p.*, v.numero_visitas, s.ultima_fecha, s.tiempo_ultima from previous_infections p
        left join last_visit v on v.person_id = p.person_id left join since s
          on s.person_id = p.person_id and s.fecha_ingreso_urgencias = p.fecha_ingreso_urgencias""",
    "cultures": f"""select distinct {K}, coalesce(tipo_cultivo, 0) as tipo, case when snomed_code is null then 'NEGATIVE' else label end as name
        from tbl_otros_cultivos_en_urgencias left join organisms on snomed_code = {_CODE.format("microorganismo_otros_cult")}""",
    "other_cultures": f"select {K}, "
    + ", ".join(f"count(*) filter (where name = '{x}') as \"otros_cult_{x}\"" for x in RESULTS)
    + f" from cultures where name is not null group by {K}",
    "wide_raw": """select * from patients
        left join comorbidities using (person_id, fecha_ingreso_urgencias) left join risk_factors using (person_id, fecha_ingreso_urgencias)
        left join sepsis_labs using (person_id, fecha_ingreso_urgencias) left join vital_signs using (person_id, fecha_ingreso_urgencias)
        left join symptoms using (person_id, fecha_ingreso_urgencias) left join other_cultures using (person_id, fecha_ingreso_urgencias)
        left join infections_complete using (person_id, fecha_ingreso_urgencias) left join colonisations using (person_id, fecha_ingreso_urgencias)
        left join (select person_id, fecha_ingreso_urgencias, resultado_hemo from blood_cultures) using (person_id, fecha_ingreso_urgencias)""",
    "wide": "select * replace ("
    + ", ".join(
        f'coalesce("{c}", 0) as "{c}"'
        for c in [*LABELS, "numero_visitas", "tiempo_ultima", *[f"colo_{x}" for x in LABELS]]
    )
    + ") from wide_raw",
    "totals": "select *, "
    + ", ".join(
        f'coalesce("{x}", 0) + coalesce("colo_{x}", 0) + coalesce("otros_cult_{x}", 0) as "{x}_total"' for x in LABELS
    )
    + " from wide",
    "exploded": """select t.* exclude (resultado_hemo), r.name as resultado_hemo from totals t
        left join lateral (select unnest(string_split(t.resultado_hemo, ', ')) as name) r on true""",
    "aetiology_raw": """select p.*, i.* exclude (person_id, fecha_ingreso_urgencias), c.* exclude (person_id, fecha_ingreso_urgencias),
          l.* exclude (person_id, fecha_ingreso_urgencias), unnest(string_split(coalesce(b.resultado_hemo, '?'), ', ')) as resultado_hemo
        from patients p left join infections_complete i using (person_id, fecha_ingreso_urgencias)
        left join colonisations c using (person_id, fecha_ingreso_urgencias) left join sepsis_labs l using (person_id, fecha_ingreso_urgencias)
        left join blood_cultures b using (person_id, fecha_ingreso_urgencias)""",
    "aetiology": "select * replace (nullif(resultado_hemo, '?') as resultado_hemo, "
    + ", ".join(
        f'coalesce("{c}", 0) as "{c}"'
        for c in [*LABELS, "numero_visitas", "tiempo_ultima", *[f"colo_{x}" for x in LABELS]]
    )
    + ") from aetiology_raw",
}
DERIVED = {
    "vital_signs": _clean("sign_flags", "vital_signs", P.SIGNS),
    "sepsis_labs": _clean("lab_numbers", "sepsis_labs", ["proteina_c_reactiva"]),
}


def with_steps(final: str) -> str:
    """All form and step CTEs (unused ones cost nothing), then the final select."""
    ctes = [
        f"{name} as ({text.format(**{g: g for g in GIVEN})})" for name, text in FORMS.items()
    ]
    for name, text in STEPS.items():
        ctes.append(f"{name} as ({text})")
        if name == "sign_flags":
            ctes.append(DERIVED["vital_signs"])
        if name == "lab_numbers":
            ctes.append(DERIVED["sepsis_labs"])
    return "with " + ", ".join(ctes) + " " + final


def plain(df):
    """Comparable types: flags as integers, dates and lists as text."""
    out = []
    for name, kind in df.dtypes:
        c = X.col(name)
        if kind == "boolean":
            c = c.cast("int")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("array"):
            c = F.array_join(c, ", ")
        out.append(c.alias(name))
    return df.select(*out)


def _organisms(t):
    return P.organism_dictionary(form(t, "tbl_microorganismos"))


def _groups(t):
    return P.infection_groups(form(t, "tbl_infecciones_previas"), _organisms(t))


@query("patients_table", with_steps("select * from patients"))
def _(t):
    return P.patients(form(t, "tbl_paciente"), form(t, "tbl_personid2center"), form(t, "tbl_infecciones_previas"))


@query("comorbidities_table", with_steps("select * from comorbidities"))
def _(t):
    return plain(P.comorbidities(form(t, "tbl_comorbilidad")))


@query("symptoms_table", with_steps("select * from symptoms"))
def _(t):
    return P.symptoms(form(t, "tbl_sintomas"))


@query("vital_signs_table", with_steps("select * from vital_signs"))
def _(t):
    return P.vital_signs(form(t, "tbl_signos"))


@query("sepsis_labs_table", with_steps("select * from sepsis_labs"))
def _(t):
    return P.sepsis_labs(form(t, "tbl_sepsis"))


@query("organism_dictionary", with_steps("select * from organisms"))
def _(t):
    return _organisms(t)


@query("previous_infections", with_steps("select * from previous_infections"))
def _(t):
    return P.previous_infections(_groups(t))


@query("blood_cultures", with_steps("select * from blood_cultures"))
def _(t):
    return plain(P.blood_cultures(form(t, "tbl_hemocultivo_de_urgencias"), _organisms(t)))


@query("colonisations", with_steps("select * from colonisations"))
def _(t):
    return P.colonisations(form(t, "tbl_colonizaciones_previas"), _organisms(t))


@query("visits_by_person", with_steps("select * from infections_by_person"))
def _(t):
    groups = _groups(t)
    return plain(P.infections_complete(P.previous_infections(groups), groups, on_admission=False))


@query("visits_by_admission", with_steps("select * from infections_complete"))
def _(t):
    groups = _groups(t)
    return plain(P.infections_complete(P.previous_infections(groups), groups, on_admission=True))


@query(
    "bad_infection_dates",
    with_steps("select person_id, fecha_ingreso_urgencias, fecha_infeccion from tbl_infecciones_previas where fecha_infeccion = '323-05-01'"),
)
def _(t):
    return P.bad_infection_dates(form(t, "tbl_infecciones_previas")).select(
        "person_id", "fecha_ingreso_urgencias", "fecha_infeccion"
    )


@query("other_cultures", with_steps("select * from other_cultures"))
def _(t):
    return P.other_cultures(form(t, "tbl_otros_cultivos_en_urgencias"), _organisms(t))


def built(t):
    return P.build(catalog(t), on_admission=True)


@query("wide_table", with_steps("select * from totals"))
def _(t):
    return plain(built(t)["wide"])


@query(
    "exploded_table",
    with_steps(
        """select *, round(1.0 / count(*) over (partition by person_id), 9) as weight,
           case when count(*) over (partition by person_id) > 1 then 1 else 0 end as co_infection from exploded"""
    ),
)
def _(t):
    return plain(built(t)["exploded"]).withColumn("weight", F.round("weight", 9))


@query(
    "aetiology_table",
    with_steps(
        """select *, round(1.0 / count(*) over (partition by person_id), 9) as weight,
           case when count(*) over (partition by person_id) > 1 then 1 else 0 end as co_infection from aetiology"""
    ),
)
def _(t):
    return plain(built(t)["aetiology"]).withColumn("weight", F.round("weight", 9))


_RENAMED = ", ".join(
    f'"sintoma_{i}.0" as "sintoma_{n}", "sintoma_{i}.0_categorico" as "sintoma_{n}_categorico"'
    for i, n in [(d["value"], d["name"].replace(" ", "_")) for d in P.SYMPTOM_CODES[:6]]
)
_CODED = ", ".join(f'"sintoma_{i}.0", "sintoma_{i}.0_categorico"' for i in range(1, 7))


@query(
    "processed_table",
    with_steps(
        f"""select * exclude (sintoma_nan, sintoma_nan_categorico, {_CODED}) replace (
              case mujer_gestante when 'True' then 1 else 0 end as mujer_gestante,
              case when taquipnea is not null and estado_mental_alterado is not null and hipotension is not null then qsofa end as qsofa),
            {_RENAMED} from totals"""
    ),
)
def _(t):
    return plain(built(t)["processed"])


@query("risk_factors_table", with_steps("select * from risk_factors"))
def _(t):
    return form(t, "tbl_factores_riesgo_bmr")
