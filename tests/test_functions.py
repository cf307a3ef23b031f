from datetime import date

import pytest
from pyspark.sql import functions as F

from tenderlens import functions as fn


def test_parse_money(apply):
    cases = {
        "7.801,45 €": 7801.45, "7,801.45": 7801.45, "23000": 23000.0, "23.000": 23000.0, "6.240,00 EUR": 6240.0,
        "  31.900 €  ": 31900.0, "465 euros": 465.0, "1.5": 1.5, "1.234.567": 1234567.0, "1,2,345": 12345.0,
        "1,50": 1.5, "1,234": 1234.0,
    }
    assert apply(fn.parse_money, list(cases)) == pytest.approx(list(cases.values()))


@pytest.mark.parametrize("text", [None, "", "abc", "—", "0", "0,00", "-100", " -5", ".", ",", "1,234,567", "1.234,5,6"])
def test_parse_money_rejects(apply, text):
    assert apply(fn.parse_money, [text]) == [None]


def test_format(apply):
    assert apply(fn.format_euros, [9876543.21, 0.25, None, float("nan")], "double") == ["9.876.543,21 €", "0,25 €", "—", "—"]
    assert apply(fn.format_pct, [93.3, 1196.0, 0.25, None], "double") == ["93,3 %", "1196,0 %", "0,2 %", "—"]


def test_fold_text(apply):
    cases = {
        "Álava  Ñandú": "alava nandu", "ÁB": "ab", "ﬁn ½…": "fin 1⁄2...", "plain  X ": "plain x", "İstanbul": "istanbul",
        "œuvre": "œuvre", "ＡＢ １": "ab 1",
    }
    assert apply(fn.fold_text, list(cases)) == list(cases.values())


def test_title_place(apply):
    cases = ["SANTIAGO DE COMPOSTELA", "la coruña", " el  ejido"]
    assert apply(fn.title_place, cases) == ["Santiago de Compostela", "La Coruña", "El Ejido"]


def test_provinces(apply):
    assert apply(fn.normalize_province, ["CORUÑA (A)", "alava", "valència", "somewhere DE x", " . ", None]) == [
        "A Coruña", "Álava", "Valencia", "Somewhere de X", None, None]
    assert apply(fn.province_from_postcode, ["36201", "E 15001 X", "99999", "123456", None]) == [
        "Pontevedra", "A Coruña", None, None, None]
    assert apply(fn.province_in_text, ["Santa Cruz de Tenerife", "Lugones", "x"]) == [
        "Santa Cruz de Tenerife", "Lugo", None]
    assert apply(fn.region_from_province, ["Lugo", "ALAVA", "x"]) == ["Galicia", "País Vasco", None]


def test_municipalities(apply):
    assert apply(fn.normalize_municipality, [
        "SANTIAGO DE COMPOSTELA (A CORUÑA)", "Vigo - Pontevedra", "A CORUÑA", "VALÈNCIA", "vigo", "", None,
    ]) == ["Santiago de Compostela", "Vigo", "A Coruña", "Valencia", "Vigo", None, None]
    assert apply(fn.infer_municipality, [
        "Alcaldía del Concello de Boiro", "Junta de Gobierno del Ayuntamiento de Tudela",
        "Órgano de Contratación de la Ciudad Autónoma de Melilla", "Instituto Riojano de Salud",
    ]) == ["Boiro", "Tudela", "Melilla", None]


def test_buyers(apply):
    geography = apply(fn.infer_geography, ["Gobierno de Aragón", "Universidad de León", "x", None])
    assert [tuple(g) for g in geography] == [(None, "Aragón"), ("León", "Castilla y León"), (None, None), (None, None)]
    assert apply(fn.infer_buyer_type, ["AYUNTAMIENTO de X", "Diputación Foral de Álava", "Diputación de X", "x"]) == [
        "Ayuntamiento", "Diputación foral", "Diputación provincial", None]


def test_award_dates(apply):
    def read(c):
        return fn.normalize_award_date(c, max_year=2026)

    cases = {
        "0019-11-08": date(2019, 11, 8), "0022-06-30": date(2022, 6, 30), "0311-04-02": None, "1931-09-17": None,
        "2007-08-12": None, "2023-02-30": None, " 2024-1-5T00": date(2024, 1, 5), "2027-01-01": None, "x": None,
    }
    assert apply(read, list(cases)) == list(cases.values())


def test_mixed_dates(apply):
    cases = {
        "2024-01-28": date(2024, 1, 28), "28/01/2024": date(2024, 1, 28), "28-01-2024": date(2024, 1, 28),
        "5.6.24": date(2024, 6, 5), "2024/01/28": date(2024, 1, 28), "2024.1.8": date(2024, 1, 8), "20240128": date(2024, 1, 28),
        " 20240128 10:00": date(2024, 1, 28), "20241328": None, "2024012": None, "202401281": None, "2024-01-28T10:00:00Z": date(2024, 1, 28), "2024-13-01": None, "x": None,
    }
    assert apply(fn.parse_mixed_dates, list(cases)) == list(cases.values())


def test_summary_and_type(apply):
    rows = apply(fn.extract_summary, ["Órgano de Contratación: Concello de Lalín; Importe: 8123,40", "x", None])
    assert [tuple(r) for r in rows] == [("Concello de Lalín", 8123.4), (None, None), (None, None)]
    assert apply(lambda c: fn.contract_type_label(c, F.lit(False)), ["2", " 31 ", "99", "", None]) == [
        "Servicios", "Concesión de obras", "Tipo 99", "Otros", "Otros"]
    assert apply(lambda c: fn.contract_type_label(c, F.lit(True)), ["2", None]) == ["Servicios", "Obras"]
    assert apply(fn.legal_limit, ["Obras", "Concesión de OBRAS", "Servicios", None]) == [40000, 40000, 15000, 15000]
