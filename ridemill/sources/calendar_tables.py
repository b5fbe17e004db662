"""Calendar dimensions: dated events, fare changes and public holidays."""

# The three lookup tables, one row per line, fields separated by "|".

EVENTS = """
date|label_es|label_en|color
2014-01-23|Devaluación Kicillof (+23%)|Kicillof devaluation (+23%)|gray
2016-04-01|1er tarifazo Macri — fin subsidios kirchneristas|1st Macri fare shock — subsidy cuts begin|blue
2018-02-01|2do tarifazo Macri (+64% en 3 tramos)|2nd Macri fare shock (+64% in 3 tranches)|blue
2018-08-01|Crisis cambiaria Macri — colapso del peso|Macri currency crisis — peso collapse|gray
2019-08-12|Shock PASO 2019 — Macri pierde primarias|PASO 2019 shock — Macri loses primary|gray
2019-09-01|Congelamiento tarifario (Macri → Alberto → COVID)|Fare freeze begins (Macri → Alberto → COVID)|blue
2020-03-20|ASPO (cuarentena estricta)|ASPO (strict lockdown)|red
2020-11-01|Inicio DISPO|DISPO begins|orange
2021-04-09|ASPO 2 (2da cuarentena)|ASPO 2 (2nd lockdown)|red
2022-03-01|Recuperación post-COVID|Post-COVID recovery|green
2022-03-01|Fin congelamiento tarifario (3 años)|End of 3-year fare freeze|blue
2022-07-01|Renuncia Guzmán — crisis cambiaria|Guzmán resigns — FX crisis|gray
2023-08-14|Devaluación post-PASO (+22%)|Post-PASO devaluation (+22%)|gray
2023-12-13|Devaluación Milei (+118%) + fin subsidios|Milei devaluation (+118%) + subsidy cuts|purple
2024-01-15|Inicio shock tarifario Milei|Milei fare shock begins|purple
2025-04-14|Salida del cepo cambiario|Capital controls lifted|blue
"""

FARE_HIKES = """
date|scope|magnitude|label_es|label_en
2016-04-01|national|92|1er tarifazo Macri — descongelamiento kirchnerista|1st Macri hike — Kirchner-era freeze ends
2018-02-01|national|28|2do tarifazo Macri — tramo 1 (feb)|2nd Macri hike — tranche 1 (Feb)
2018-04-01|national|18|2do tarifazo Macri — tramo 2 (abr)|2nd Macri hike — tranche 2 (Apr)
2018-06-01|national|14|2do tarifazo Macri — tramo 3 (jun)|2nd Macri hike — tranche 3 (Jun)
2019-01-12|national|16|3er aumento Macri — tramo 1 (ene)|3rd Macri hike — tranche 1 (Jan)
2019-02-01|national|9|3er aumento Macri — tramo 2 (feb)|3rd Macri hike — tranche 2 (Feb)
2019-03-01|national|7|3er aumento Macri — tramo 3 (mar)|3rd Macri hike — tranche 3 (Mar)
2019-09-01|national|0|Congelamiento tarifario pre-electoral (Macri)|Pre-election fare freeze (Macri)
2022-03-01|national|30|Fin del congelamiento — indexación mensual CPI|Freeze ends — monthly CPI indexation begins
2023-08-01|national|0|Congelamiento tarifario (Res. 501/2023, post-PASO)|Fare freeze — post-PASO election halt (Res. 501/2023)
2024-01-15|national|45|1er aumento Milei — acuerdo UTA/empresas (+45%)|1st Milei hike — UTA/operators agreement (+45%)
2024-02-06|national|66|2do aumento Milei — eliminación subsidios (+66%)|2nd Milei hike — subsidy elimination (+66%)
2024-08-12|amba|37|Aumento agosto AMBA (+37%)|Aug 2024 AMBA hike (+37%)
2024-11-18|amba|10|Aumento noviembre AMBA (+10%)|Nov 2024 AMBA hike (+10%)
2025-03-01|amba_local|10|CABA/PBA: +10% + indexación mensual CPI+2%|CABA/PBA: +10% + monthly CPI+2% indexation
2025-05-23|national|7|Aumento nacional (+21.5% en 3 etapas) — etapa 1|National hike (+21.5% in 3 stages) — stage 1
2025-06-18|national|7|Aumento nacional — etapa 2|National hike — stage 2
2025-07-16|national|7|Aumento nacional — etapa 3|National hike — stage 3
2025-11-17|national|10|Aumento noviembre 2025 (+10%)|Nov 2025 hike (+10%)
2026-02-18|national|31|Aumento febrero 2026 (+31%) — etapa 1|Feb 2026 hike (+31%) — stage 1
2026-03-01|amba_local|5|Actualización mensual CABA/PBA — marzo 2026|CABA/PBA monthly update — Mar 2026
2026-03-16|national|8|Aumento nacional — etapa 2 marzo 2026|National hike — Mar 2026 stage 2
"""

HOLIDAYS = """
date|name_es|name_en|type
2020-01-01|Año Nuevo|New Year's Day|inamovible
2020-02-24|Carnaval (lunes)|Carnival Monday|carnaval
2020-02-25|Carnaval (martes)|Carnival Tuesday|carnaval
2020-03-23|Feriado puente turístico|Tourism bridge holiday|puente
2020-03-24|Día de la Memoria por la Verdad y la Justicia|Truth and Justice Memorial Day|inamovible
2020-03-31|Día de Malvinas (trasladado — decreto COVID)|Malvinas Day (moved — COVID decree)|trasladable
2020-04-10|Viernes Santo|Good Friday|semana_santa
2020-05-01|Día del Trabajador|Labour Day|inamovible
2020-05-25|Revolución de Mayo|May Revolution Day|inamovible
2020-06-20|Paso a la Inmortalidad del Gral. Manuel Belgrano|Flag Day / General Belgrano Day|trasladable
2020-07-09|Día de la Independencia|Independence Day|inamovible
2020-07-10|Feriado puente turístico|Tourism bridge holiday|puente
2020-08-17|Paso a la Inmortalidad del Gral. San Martín (trasladado)|San Martín Day (moved to Mon)|trasladable
2020-10-12|Día del Respeto a la Diversidad Cultural (trasladado)|Cultural Diversity Day (moved)|trasladable
2020-11-23|Día de la Soberanía Nacional (trasladado)|National Sovereignty Day (moved to Mon)|trasladable
2020-12-07|Feriado puente turístico|Tourism bridge holiday|puente
2020-12-08|Inmaculada Concepción de María|Immaculate Conception|inamovible
2020-12-25|Navidad|Christmas Day|inamovible
2021-01-01|Año Nuevo|New Year's Day|inamovible
2021-02-15|Carnaval (lunes)|Carnival Monday|carnaval
2021-02-16|Carnaval (martes)|Carnival Tuesday|carnaval
2021-03-24|Día de la Memoria por la Verdad y la Justicia|Truth and Justice Memorial Day|inamovible
2021-04-02|Día de Malvinas / Viernes Santo (coinciden)|Malvinas Day / Good Friday (coincide)|semana_santa
2021-05-01|Día del Trabajador|Labour Day|inamovible
2021-05-24|Feriado puente (25 de Mayo)|Bridge holiday (May Revolution)|puente
2021-05-25|Revolución de Mayo|May Revolution Day|inamovible
2021-06-20|Paso a la Inmortalidad del Gral. Manuel Belgrano|Flag Day / General Belgrano Day|inamovible
2021-06-21|Paso a la Inmortalidad del Gral. Martín M. de Güemes (trasladado)|Güemes Day (moved to Mon)|trasladable
2021-07-09|Día de la Independencia|Independence Day|inamovible
2021-08-16|Paso a la Inmortalidad del Gral. San Martín (trasladado)|San Martín Day (moved to Mon)|trasladable
2021-10-08|Feriado puente (Diversidad Cultural)|Bridge holiday (Cultural Diversity)|puente
2021-10-11|Día del Respeto a la Diversidad Cultural (trasladado)|Cultural Diversity Day (moved to Mon)|trasladable
2021-11-22|Día de la Soberanía Nacional (trasladado)|National Sovereignty Day (moved to Mon)|trasladable
2021-12-08|Inmaculada Concepción de María|Immaculate Conception|inamovible
2021-12-25|Navidad|Christmas Day|inamovible
2022-01-01|Año Nuevo|New Year's Day|inamovible
2022-02-28|Carnaval (lunes)|Carnival Monday|carnaval
2022-03-01|Carnaval (martes)|Carnival Tuesday|carnaval
2022-03-24|Día de la Memoria por la Verdad y la Justicia|Truth and Justice Memorial Day|inamovible
2022-04-02|Día de Malvinas|Malvinas Day|inamovible
2022-04-14|Jueves Santo|Maundy Thursday|semana_santa
2022-04-15|Viernes Santo|Good Friday|semana_santa
2022-05-01|Día del Trabajador|Labour Day|inamovible
2022-05-18|Feriado puente turístico|Tourism bridge holiday|puente
2022-05-25|Revolución de Mayo|May Revolution Day|inamovible
2022-06-17|Paso a la Inmortalidad del Gral. Martín M. de Güemes|Güemes Day|inamovible
2022-06-20|Paso a la Inmortalidad del Gral. Manuel Belgrano|Flag Day / General Belgrano Day|inamovible
2022-07-09|Día de la Independencia|Independence Day|inamovible
2022-08-15|Paso a la Inmortalidad del Gral. San Martín (trasladado)|San Martín Day (moved to Mon)|trasladable
2022-10-07|Feriado puente turístico|Tourism bridge holiday|puente
2022-10-10|Día del Respeto a la Diversidad Cultural (trasladado)|Cultural Diversity Day (moved to Mon)|trasladable
2022-11-20|Día de la Soberanía Nacional|National Sovereignty Day|trasladable
2022-11-21|Feriado puente turístico|Tourism bridge holiday|puente
2022-12-08|Inmaculada Concepción de María|Immaculate Conception|inamovible
2022-12-09|Feriado puente turístico|Tourism bridge holiday|puente
2022-12-25|Navidad|Christmas Day|inamovible
2023-01-01|Año Nuevo|New Year's Day|inamovible
2023-02-20|Carnaval (lunes)|Carnival Monday|carnaval
2023-02-21|Carnaval (martes)|Carnival Tuesday|carnaval
2023-03-24|Día de la Memoria por la Verdad y la Justicia|Truth and Justice Memorial Day|inamovible
2023-04-02|Día de Malvinas|Malvinas Day|inamovible
2023-04-06|Jueves Santo|Maundy Thursday|semana_santa
2023-04-07|Viernes Santo|Good Friday|semana_santa
2023-05-01|Día del Trabajador|Labour Day|inamovible
2023-05-25|Revolución de Mayo|May Revolution Day|inamovible
2023-05-26|Feriado puente (Revolución de Mayo)|Bridge holiday (May Revolution)|puente
2023-06-17|Paso a la Inmortalidad del Gral. Martín M. de Güemes|Güemes Day|inamovible
2023-06-19|Feriado puente (Día de la Bandera)|Bridge holiday (Flag Day)|puente
2023-06-20|Paso a la Inmortalidad del Gral. Manuel Belgrano|Flag Day / General Belgrano Day|inamovible
2023-07-09|Día de la Independencia|Independence Day|inamovible
2023-08-21|Paso a la Inmortalidad del Gral. San Martín (trasladado)|San Martín Day (moved to Mon)|trasladable
2023-10-13|Feriado puente turístico|Tourism bridge holiday|puente
2023-10-16|Día del Respeto a la Diversidad Cultural (trasladado)|Cultural Diversity Day (moved to Mon)|trasladable
2023-11-20|Día de la Soberanía Nacional|National Sovereignty Day|trasladable
2023-12-08|Inmaculada Concepción de María|Immaculate Conception|inamovible
2023-12-25|Navidad|Christmas Day|inamovible
2024-01-01|Año Nuevo|New Year's Day|inamovible
2024-02-12|Carnaval (lunes)|Carnival Monday|carnaval
2024-02-13|Carnaval (martes)|Carnival Tuesday|carnaval
2024-03-24|Día de la Memoria por la Verdad y la Justicia|Truth and Justice Memorial Day|inamovible
2024-03-28|Jueves Santo|Maundy Thursday|semana_santa
2024-03-29|Viernes Santo|Good Friday|semana_santa
2024-04-01|Feriado puente turístico|Tourism bridge holiday|puente
2024-04-02|Día de Malvinas|Malvinas Day|inamovible
2024-05-01|Día del Trabajador|Labour Day|inamovible
2024-05-25|Revolución de Mayo|May Revolution Day|inamovible
2024-06-17|Paso a la Inmortalidad del Gral. Martín M. de Güemes|Güemes Day|inamovible
2024-06-20|Paso a la Inmortalidad del Gral. Manuel Belgrano|Flag Day / General Belgrano Day|inamovible
2024-06-21|Feriado puente turístico|Tourism bridge holiday|puente
2024-07-09|Día de la Independencia|Independence Day|inamovible
2024-08-19|Paso a la Inmortalidad del Gral. San Martín (trasladado)|San Martín Day (moved to Mon)|trasladable
2024-10-11|Feriado puente turístico|Tourism bridge holiday|puente
2024-10-12|Día del Respeto a la Diversidad Cultural|Cultural Diversity Day|trasladable
2024-11-18|Día de la Soberanía Nacional (trasladado)|National Sovereignty Day (moved to Mon)|trasladable
2024-12-08|Inmaculada Concepción de María|Immaculate Conception|inamovible
2024-12-25|Navidad|Christmas Day|inamovible
2025-01-01|Año Nuevo|New Year's Day|inamovible
2025-03-03|Carnaval (lunes)|Carnival Monday|carnaval
2025-03-04|Carnaval (martes)|Carnival Tuesday|carnaval
2025-03-24|Día de la Memoria por la Verdad y la Justicia|Truth and Justice Memorial Day|inamovible
2025-04-02|Día de Malvinas|Malvinas Day|inamovible
2025-04-17|Jueves Santo|Maundy Thursday|semana_santa
2025-04-18|Viernes Santo|Good Friday|semana_santa
2025-05-01|Día del Trabajador|Labour Day|inamovible
2025-05-25|Revolución de Mayo|May Revolution Day|inamovible
2025-06-16|Paso a la Inmortalidad del Gral. Martín M. de Güemes (trasladado)|Güemes Day (moved to Mon)|trasladable
2025-06-20|Paso a la Inmortalidad del Gral. Manuel Belgrano|Flag Day / General Belgrano Day|inamovible
2025-07-09|Día de la Independencia|Independence Day|inamovible
2025-08-15|Feriado puente turístico|Tourism bridge holiday|puente
2025-08-18|Paso a la Inmortalidad del Gral. San Martín (trasladado)|San Martín Day (moved to Mon)|trasladable
2025-10-13|Día del Respeto a la Diversidad Cultural (trasladado)|Cultural Diversity Day (moved to Mon)|trasladable
2025-11-21|Feriado puente turístico|Tourism bridge holiday|puente
2025-11-24|Día de la Soberanía Nacional (trasladado)|National Sovereignty Day (moved to Mon)|trasladable
2025-12-08|Inmaculada Concepción de María|Immaculate Conception|inamovible
2025-12-25|Navidad|Christmas Day|inamovible
2026-01-01|Año Nuevo|New Year's Day|inamovible
2026-02-16|Carnaval (lunes)|Carnival Monday|carnaval
2026-02-17|Carnaval (martes)|Carnival Tuesday|carnaval
2026-03-23|Feriado puente turístico|Tourism bridge holiday|puente
2026-03-24|Día de la Memoria por la Verdad y la Justicia|Truth and Justice Memorial Day|inamovible
2026-04-02|Día del Veterano y de los Caídos en la Guerra de Malvinas|Veterans and Fallen of the Malvinas War Day|inamovible
2026-04-03|Viernes Santo|Good Friday|semana_santa
2026-05-01|Día del Trabajador|Labour Day|inamovible
2026-05-25|Revolución de Mayo|May Revolution Day|inamovible
2026-06-15|Paso a la Inmortalidad del Gral. Martín M. de Güemes (trasladado)|Güemes Day (moved to Mon)|trasladable
2026-06-20|Paso a la Inmortalidad del Gral. Manuel Belgrano|Flag Day / General Belgrano Day|inamovible
2026-07-09|Día de la Independencia|Independence Day|inamovible
2026-07-10|Feriado puente turístico|Tourism bridge holiday|puente
2026-08-17|Paso a la Inmortalidad del Gral. San Martín (trasladado)|San Martín Day (moved to Mon)|trasladable
2026-10-12|Día del Respeto a la Diversidad Cultural (trasladado)|Cultural Diversity Day (moved to Mon)|trasladable
2026-11-23|Día de la Soberanía Nacional (trasladado)|National Sovereignty Day (moved to Mon)|trasladable
2026-12-07|Feriado puente turístico|Tourism bridge holiday|puente
2026-12-08|Inmaculada Concepción de María|Immaculate Conception|inamovible
2026-12-25|Navidad|Christmas Day|inamovible
"""

# End of fixed values.
