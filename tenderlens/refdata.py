"""Reference values of the audit domain.

Fixed values: legal limits, province and region names, keyword lists, text patterns and coordinates
are given by law, by official code lists or by the expected results, and are stated here as they are.
"""

from __future__ import annotations

# Legal limits of minor contracts, in euros.
LIMIT_SERVICES = 15_000.0
LIMIT_WORKS = 40_000.0
LIMIT_INGEST = 50_000.0
ALERT_SHARE = 0.90
ALERT_SERVICES = 13_500.0
ALERT_WORKS = 36_000.0

NO_SUPPLIER = "No consta"
NO_SUBJECT = "Sin concepto"
OTHER_TYPE = "Otros"
WORKS = "Obras"

CONTRACT_TYPES = {
    "1": "Suministros",
    "2": "Servicios",
    "3": "Obras",
    "7": "Concesión de servicios",
    "8": "Administrativo especial",
    "21": "Concesión de servicios",
    "22": "Concesión de obras",
    "31": "Concesión de obras",
    "32": "Concesión de servicios",
    "40": "Privado",
    "50": "Patrimonial",
}
WORKS_CODES = ("3", "WORKS", "works")

RISK_NONE = "✅ Sin alerta"
RISK_OVER = "🚨 Acumulado > límite legal"
RISK_GRAZES = "🔴 Roza el límite (>95%)"
RISK_NEAR = "🟠 Cerca del límite (>90%)"

# Official two-digit province codes, which are also the postcode prefixes.
INE_PROVINCES = {
    "01": "Álava", "02": "Albacete", "03": "Alicante", "04": "Almería", "05": "Ávila",
    "06": "Badajoz", "07": "Baleares", "08": "Barcelona", "09": "Burgos", "10": "Cáceres",
    "11": "Cádiz", "12": "Castellón", "13": "Ciudad Real", "14": "Córdoba", "15": "A Coruña",
    "16": "Cuenca", "17": "Girona", "18": "Granada", "19": "Guadalajara", "20": "Gipuzkoa",
    "21": "Huelva", "22": "Huesca", "23": "Jaén", "24": "León", "25": "Lleida",
    "26": "La Rioja", "27": "Lugo", "28": "Madrid", "29": "Málaga", "30": "Murcia",
    "31": "Navarra", "32": "Ourense", "33": "Asturias", "34": "Palencia", "35": "Las Palmas",
    "36": "Pontevedra", "37": "Salamanca", "38": "Santa Cruz de Tenerife", "39": "Cantabria",
    "40": "Segovia", "41": "Sevilla", "42": "Soria", "43": "Tarragona", "44": "Teruel",
    "45": "Toledo", "46": "Valencia", "47": "Valladolid", "48": "Bizkaia", "49": "Zamora",
    "50": "Zaragoza", "51": "Ceuta", "52": "Melilla",
}
GALICIA_CODES = ("15", "27", "32", "36")

# Region of each province, with the spellings in use.
PROVINCE_REGION = {
    "Almería": "Andalucía",
    "Cádiz": "Andalucía",
    "Córdoba": "Andalucía",
    "Granada": "Andalucía",
    "Huelva": "Andalucía",
    "Jaén": "Andalucía",
    "Málaga": "Andalucía",
    "Sevilla": "Andalucía",
    "Huesca": "Aragón",
    "Teruel": "Aragón",
    "Zaragoza": "Aragón",
    "Asturias": "Asturias",
    "Baleares": "Islas Baleares",
    "Illes Balears": "Islas Baleares",
    "Las Palmas": "Canarias",
    "Santa Cruz de Tenerife": "Canarias",
    "Tenerife": "Canarias",
    "Gran Canaria": "Canarias",
    "Cantabria": "Cantabria",
    "Albacete": "Castilla-La Mancha",
    "Ciudad Real": "Castilla-La Mancha",
    "Cuenca": "Castilla-La Mancha",
    "Guadalajara": "Castilla-La Mancha",
    "Toledo": "Castilla-La Mancha",
    "Ávila": "Castilla y León",
    "Burgos": "Castilla y León",
    "León": "Castilla y León",
    "Palencia": "Castilla y León",
    "Salamanca": "Castilla y León",
    "Segovia": "Castilla y León",
    "Soria": "Castilla y León",
    "Valladolid": "Castilla y León",
    "Zamora": "Castilla y León",
    "Barcelona": "Cataluña",
    "Girona": "Cataluña",
    "Gerona": "Cataluña",
    "Lleida": "Cataluña",
    "Lérida": "Cataluña",
    "Tarragona": "Cataluña",
    "Alicante": "Comunidad Valenciana",
    "Alacant": "Comunidad Valenciana",
    "Castellón": "Comunidad Valenciana",
    "Castelló": "Comunidad Valenciana",
    "Valencia": "Comunidad Valenciana",
    "València": "Comunidad Valenciana",
    "Badajoz": "Extremadura",
    "Cáceres": "Extremadura",
    "A Coruña": "Galicia",
    "La Coruña": "Galicia",
    "Coruña": "Galicia",
    "Lugo": "Galicia",
    "Ourense": "Galicia",
    "Orense": "Galicia",
    "Pontevedra": "Galicia",
    "Madrid": "Comunidad de Madrid",
    "Murcia": "Región de Murcia",
    "Navarra": "Navarra",
    "Nafarroa": "Navarra",
    "Álava": "País Vasco",
    "Araba": "País Vasco",
    "Gipuzkoa": "País Vasco",
    "Guipúzcoa": "País Vasco",
    "Bizkaia": "País Vasco",
    "Vizcaya": "País Vasco",
    "La Rioja": "La Rioja",
    "Rioja": "La Rioja",
    "Ceuta": "Ceuta",
    "Melilla": "Melilla",
}
# Longest name first; names of one length keep the order above.
PROVINCES_LONGEST_FIRST = tuple(sorted(PROVINCE_REGION, key=len, reverse=True))

CORUNA_SPELLINGS = ("a coruna", "coruna a", "coruna")
VALENCIA_SPELLINGS = ("valencia valencia", "valencia")
PLACE_STOP_WORDS = ("a", "al", "da", "de", "del", "do", "el", "la", "las", "los")

# Buyer types by keyword; the first keyword found wins.
BUYER_TYPE_KEYWORDS = (
    ("Diputación Foral", "Diputación foral"),
    ("Foru Aldundia", "Diputación foral"),
    ("Diputación", "Diputación provincial"),
    ("Cabildo", "Cabildo insular"),
    ("Consell Insular", "Consell insular"),
    ("Mancomunidad", "Mancomunidad"),
    ("Comarca", "Comarca"),
    ("Consorcio", "Consorcio"),
    ("Ayuntamiento", "Ayuntamiento"),
    ("Concello", "Ayuntamiento"),
    ("Concejo", "Ayuntamiento"),
    ("Udala", "Ayuntamiento"),
    ("Alcaldía", "Ayuntamiento"),
    ("Universidad", "Universidad"),
    ("Universidade", "Universidad"),
    ("Hospital", "Hospital / Sanidad"),
    ("Servicio de Salud", "Sanidad autonómica"),
    ("Servizo Galego de Saúde", "Sanidad autonómica"),
    ("Ministerio", "Administración General del Estado"),
    ("Subdelegación del Gobierno", "Administración General del Estado"),
    ("Delegación del Gobierno", "Administración General del Estado"),
    ("Agencia Estatal", "Administración General del Estado"),
    ("Junta de", "Comunidad autónoma"),
    ("Generalitat", "Comunidad autónoma"),
    ("Xunta de Galicia", "Comunidad autónoma"),
    ("Gobierno de", "Comunidad autónoma"),
    ("Govern", "Comunidad autónoma"),
    ("Comunidad de Madrid", "Comunidad autónoma"),
    ("Eusko Jaurlaritza", "Comunidad autónoma"),
)

# Regions named outright by their own government; the first keyword found wins.
REGION_KEYWORDS = (
    ("Xunta de Galicia", "Galicia"),
    ("Junta de Andalucía", "Andalucía"),
    ("Junta de Castilla y León", "Castilla y León"),
    ("Junta de Comunidades de Castilla-La Mancha", "Castilla-La Mancha"),
    ("Junta de Castilla-La Mancha", "Castilla-La Mancha"),
    ("Junta de Extremadura", "Extremadura"),
    ("Generalitat de Catalunya", "Cataluña"),
    ("Generalitat Valenciana", "Comunidad Valenciana"),
    ("Govern de les Illes Balears", "Islas Baleares"),
    ("Gobierno de Canarias", "Canarias"),
    ("Gobierno Vasco", "País Vasco"),
    ("Eusko Jaurlaritza", "País Vasco"),
    ("Gobierno de Aragón", "Aragón"),
    ("Gobierno del Principado de Asturias", "Asturias"),
    ("Gobierno de Cantabria", "Cantabria"),
    ("Gobierno de Navarra", "Navarra"),
    ("Gobierno de La Rioja", "La Rioja"),
    ("Comunidad de Madrid", "Comunidad de Madrid"),
    ("Región de Murcia", "Región de Murcia"),
)

# Patterns that find the municipality in the name of a local buyer.
MUNICIPALITY_PATTERNS = (
    r"\b(?:Ayuntamiento|Concello|Concejo|Ajuntament|Ajuntamento|Udala|Alcald[ií]a)\s+"
    r"(?:del|de|da|do|d'|l')?\s*([^,;()\-/]+(?:\s+[^,;()\-/]+){0,5})",
    r"\b(?:Municipio|Entidad Local Menor)\s+(?:del|de|da|do)?\s*"
    r"([^,;()\-/]+(?:\s+[^,;()\-/]+){0,5})",
)
MUNICIPALITY_ARTICLE = r"^(?:el|la|l)\s+"
MUNICIPALITY_PREFIX = r"^(?:Ayuntamiento|Concello|Concejo|Ajuntament|Ajuntamento|Udala)\s+(?:del|de|da|do|d'|l')?\s*"
MUNICIPALITY_SUFFIX = r"\s+(?:S\.A\.|S\.L\.|NIF|CIF)\b.*$"
AUTONOMOUS_CITIES = (("ciudad autónoma de ceuta", "Ceuta"), ("ciudad autónoma de melilla", "Melilla"))

# Folded buyer names that belong to a town hall.
MUNICIPAL_BUYER = (
    "ayuntamiento|concello|ajuntament|ayuntamento|udal|udala|alcaldia|alcaldía|junta de gobierno"
)

SUMMARY_BUYER = r"(?:Órgano de Contratación|Órgano Contratante):\s*(.*?)(?:;|$)"
SUMMARY_AMOUNT = r"Importe:\s*([\d.,]+)"

# Text patterns of the forensic scan.
AMOUNTS = "Importes (€)"
SCAN_PATTERNS = {
    "Emails": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "DNI/NIF": r"\b\d{8}[-\s]?[A-Z]\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}(?:[\s]?\d{2})?\b",
    "Teléfonos": r"\b(?:\+34|0034)?(?:6\d{2}|7\d{2}|9\d{2})[ -.]?\d{3}[ -.]?\d{3}\b",
    "Fechas": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    AMOUNTS: r"[0-9.,]+\s?(?:€|euros|EUR)",
}
SCAN_CONTEXT = 45

# Amounts that hug a limit, or a limit plus VAT: (from, to, flag), the first band that holds wins.
FLAG_OK = "OK"
AMOUNT_FLAGS = (
    (14_000.0, 15_000.0, "🚩 Roza 15k (sin IVA)"),
    (39_000.0, 40_000.0, "🚩 Roza 40k — Obras (sin IVA)"),
    (17_900.0, 18_150.0, "🚨 Trampa IVA 21% ≈ 15k sin IVA"),
    (47_500.0, 48_400.0, "🚨 Trampa IVA 21% ≈ 40k sin IVA"),
    (16_300.0, 16_500.0, "🚨 Trampa IVA 10% ≈ 15k sin IVA"),
)

# Approximate coordinates (latitude, longitude) for bubble maps.
REGION_CENTROIDS = {
    "Andalucía": (37.40, -4.60), "Aragón": (41.60, -0.90), "Asturias": (43.35, -5.85),
    "Canarias": (28.30, -15.60), "Cantabria": (43.18, -3.99), "Castilla-La Mancha": (39.50, -3.00),
    "Castilla y León": (41.65, -4.72), "Cataluña": (41.80, 1.80), "Ceuta": (35.89, -5.32),
    "Comunidad Valenciana": (39.50, -0.75), "Comunidad de Madrid": (40.42, -3.70),
    "Extremadura": (39.00, -6.00), "Galicia": (42.80, -8.00), "Islas Baleares": (39.57, 2.65),
    "La Rioja": (42.30, -2.45), "Melilla": (35.29, -2.94), "Navarra": (42.80, -1.65),
    "País Vasco": (43.00, -2.60), "Región de Murcia": (37.99, -1.13),
}
PROVINCE_CENTROIDS = {
    "A Coruña": (43.36, -8.41), "La Coruña": (43.36, -8.41), "Coruña": (43.36, -8.41),
    "Alacant": (38.35, -0.49), "Albacete": (38.99, -1.86), "Alicante": (38.35, -0.49),
    "Almería": (36.84, -2.46), "Araba": (42.85, -2.67), "Asturias": (43.36, -5.84),
    "Álava": (42.85, -2.67), "Ávila": (40.66, -4.70), "Badajoz": (38.88, -6.97),
    "Baleares": (39.57, 2.65), "Barcelona": (41.39, 2.17), "Bizkaia": (43.26, -2.93),
    "Burgos": (42.34, -3.70), "Cáceres": (39.47, -6.37), "Cádiz": (36.53, -6.29),
    "Cantabria": (43.46, -3.81), "Castelló": (39.99, -0.04), "Castellón": (39.99, -0.04),
    "Ceuta": (35.89, -5.32), "Ciudad Real": (38.98, -3.93), "Córdoba": (37.88, -4.78),
    "Cuenca": (40.07, -2.14), "Gerona": (41.98, 2.82), "Gipuzkoa": (43.32, -1.98),
    "Girona": (41.98, 2.82), "Gran Canaria": (28.12, -15.43), "Granada": (37.18, -3.60),
    "Guadalajara": (40.63, -3.17), "Guipúzcoa": (43.32, -1.98), "Huelva": (37.26, -6.94),
    "Huesca": (42.14, -0.41), "Illes Balears": (39.57, 2.65), "Jaén": (37.78, -3.79),
    "La Rioja": (42.47, -2.45), "Las Palmas": (28.12, -15.43), "León": (42.60, -5.57),
    "Lleida": (41.62, 0.62), "Lérida": (41.62, 0.62), "Lugo": (43.01, -7.56),
    "Madrid": (40.42, -3.70), "Málaga": (36.72, -4.42), "Melilla": (35.29, -2.94),
    "Murcia": (37.99, -1.13), "Navarra": (42.82, -1.64), "Nafarroa": (42.82, -1.64),
    "Orense": (42.34, -7.86), "Ourense": (42.34, -7.86), "Palencia": (42.01, -4.53),
    "Pontevedra": (42.43, -8.64), "Rioja": (42.47, -2.45), "Salamanca": (40.97, -5.66),
    "Santa Cruz de Tenerife": (28.47, -16.25), "Segovia": (40.95, -4.12), "Sevilla": (37.39, -5.99),
    "Soria": (41.76, -2.47), "Tarragona": (41.12, 1.24), "Tenerife": (28.47, -16.25),
    "Teruel": (40.34, -1.11), "Toledo": (39.86, -4.03), "Valencia": (39.47, -0.38),
    "València": (39.47, -0.38), "Valladolid": (41.65, -4.72), "Vizcaya": (43.26, -2.93),
    "Zamora": (41.50, -5.75), "Zaragoza": (41.65, -0.89),
}
