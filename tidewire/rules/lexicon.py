# -*- coding: utf-8 -*-
"""Word lists, labels, ordered rules and thresholds.

Everything in this file is a fixed value that decides results. Patterns run on
lower-case text without accents (see ``functions.text.norm``).
"""

# --- fixed values: stop words ------------------------------------------------
STOPWORDS = (
    "de la el los las un una unos unas del al y e en por para con sin sobre tras su sus lo le "
    "les que se es son fue fueron ha han hay a o u the of in on at to for and por como mas más "
    "segun según ano año anos años nuevo nueva"
).split()

# --- fixed values: HTML entities (the lookup is on the lower-cased name) ------
ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«", "raquo": "»",
    "ldquo": "“", "rdquo": "”", "rsquo": "’", "lsquo": "‘",
    "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú",
    "ntilde": "ñ", "deg": "°",
}

# --- fixed values: numbers in words -------------------------------------------
NUMBER_WORDS = {
    "un": 1, "uno": 1, "una": 1, "unos": 1, "unas": 1, "dos": 2, "tres": 3, "cuatro": 4,
    "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11,
    "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17,
    "dieciocho": 18, "diecinueve": 19, "veinte": 20, "treinta": 30,
}
COUNTABLE = (
    r"\d{1,2}|un|uno|una|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|"
    "catorce|quince|dieciseis|diecisiete|dieciocho|diecinueve|veinte|treinta"
)
SPELLED = {
    1: "un", 2: "dos", 3: "tres", 4: "cuatro", 5: "cinco", 6: "seis", 7: "siete", 8: "ocho",
    9: "nueve", 10: "diez", 11: "once", 12: "doce", 13: "trece", 14: "catorce", 15: "quince",
    16: "dieciseis", 17: "diecisiete", 18: "dieciocho", 19: "diecinueve", 20: "veinte",
    21: "veintiuno", 22: "veintidos", 23: "veintitres", 24: "veinticuatro",
    25: "veinticinco", 26: "veintiseis", 27: "veintisiete", 28: "veintiocho",
    29: "veintinueve", 30: "treinta",
}
HEADLINE_NUMBERS = {
    "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6,
    "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12,
}

# --- fixed values: casualty patterns -------------------------------------------
NO_INJURY = r"\biles[oa]s?\b|\bsin lesion(?:es)?\b|\b(?:sin|no hay|no hubo)\s+herid"
INJURY_COUNT = rf"\b({COUNTABLE})\s+(?:personas\s+)?herid[oa]s?\b"
INJURY_BARE = r"\bherid[oa]s?\b"
DEATH_COUNT = rf"\b({COUNTABLE})\s+(?:personas\s+)?(?:fallecid[oa]s?|muert[oa]s?|victimas)\b"
DEATH_BARE = r"\b(?:fallecid[oa]|fallecimiento|murio|murieron|muere)\b"
ROAD = r"(?i)\bL\.?\s?Z\.?\s?-?\s?(\d{1,3})\b"
TIME_OF_DAY = (
    r"\b(?:sobre\s+las|alrededor\s+de\s+las|a\s+las|pasadas\s+las|hacia\s+las|cerca\s+de\s+las)"
    r"\s+(\d{1,2})(?::|\s*h\s*)(\d{2})?\b"
)

# --- fixed values: incident categories, labels and families --------------------
INCIDENT_FAMILY = [
    "ACCIDENTE_TRAFICO", "ATROPELLO", "INCENDIO", "RESCATE", "EMERGENCIA_SANITARIA",
    "ACTUACION_SERVICIOS", "DESAPARICION",
]
CATEGORY_LABEL = {
    "ACCIDENTE_TRAFICO": "Accidente", "ATROPELLO": "Atropello", "INCENDIO": "Incendio",
    "RESCATE": "Rescate", "EMERGENCIA_SANITARIA": "Emergencia sanitaria",
    "ACTUACION_SERVICIOS": "Servicios de emergencia", "DESAPARICION": "Desaparición",
    "POLITICA": "Política", "INSTITUCIONES": "Instituciones", "ECONOMIA": "Economía",
    "EMPLEO": "Empleo", "EMPRESAS": "Empresas", "SERVICIOS": "Servicios públicos",
    "TRANSPORTE": "Transporte", "URBANISMO": "Urbanismo", "AGUA": "Agua",
    "ENERGIA": "Energía", "RESIDUOS": "Residuos", "SANIDAD": "Sanidad",
    "EDUCACION": "Educación", "SOCIEDAD": "Sociedad", "VIVIENDA": "Vivienda",
    "BIENESTAR_SOCIAL": "Bienestar social", "MEDIO_AMBIENTE": "Medio ambiente",
    "AGRICULTURA_GANADERIA": "Agricultura y ganadería", "PESCA_MAR": "Pesca y mar",
    "TURISMO": "Turismo", "CULTURA": "Cultura",
    "FIESTAS_Y_TRADICIONES": "Fiestas y tradiciones", "GASTRONOMIA": "Gastronomía",
    "DEPORTES": "Deportes", "TELEVISION_Y_ESPECTACULOS": "Televisión y espectáculos",
    "CIENCIA_TECNOLOGIA": "Ciencia y tecnología", "METEOROLOGIA": "Meteorología",
    "MAR": "Mar", "SEGURIDAD_CIUDADANA": "Seguridad ciudadana",
    "JURIDICO": "Judicial y legal", "TRAMITES_Y_SERVICIOS_CIUDADANO": "Trámites",
    "RELIGION": "Religión", "ACTOS_PROTOCOLARIOS": "Actos protocolarios",
    "SUERTES_Y_OCIO": "Suerte y ocio", "OTRO": "Otro",
}
TOPIC_MENU = [
    "POLITICA", "INSTITUCIONES", "ECONOMIA", "EMPLEO", "EMPRESAS", "SERVICIOS", "TRANSPORTE",
    "URBANISMO", "AGUA", "ENERGIA", "RESIDUOS", "SANIDAD", "EDUCACION", "VIVIENDA",
    "SOCIEDAD", "BIENESTAR_SOCIAL", "MEDIO_AMBIENTE", "AGRICULTURA_GANADERIA", "PESCA_MAR",
    "TURISMO", "CULTURA", "FIESTAS_Y_TRADICIONES", "GASTRONOMIA", "DEPORTES",
    "TELEVISION_Y_ESPECTACULOS", "CIENCIA_TECNOLOGIA", "METEOROLOGIA", "MAR",
    "SEGURIDAD_CIUDADANA", "JURIDICO", "TRAMITES_Y_SERVICIOS_CIUDADANO",
]
MONTH_LABELS = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre",
    "Octubre", "Noviembre", "Diciembre",
]
STATUSES = ["PENDING_REVIEW", "PUBLISHED", "REJECTED", "ARCHIVED"]
ORIGINS = ["MANUAL", "AI"]
VEHICLES = ["COCHE", "MOTO", "CAMION", "BICICLETA", "PEATON", "OTROS"]
SEVERITIES = ["LEVE", "MODERADO", "GRAVE"]

# --- fixed values: category rules, first match wins ------------------------------
STRONG_SIGNAL = (
    r"\b(?:accidente|accidentad|accidento|colision|choc|chocad|atropell|herid|herida|herido|"
    r"fallec|muer|rescat|emergencia|bomberos|guardia civil|ambulancia|urgencias|incendio|"
    r"incendi|explosion|desaparecid)"
)
INCIDENT_RULES = [
    ("DESAPARICION", r"\b(?:desaparecid[oa]s?|desaparicion)\b"),
    ("ATROPELLO", r"\b(?:atropell[oa]s?|atropello|peaton|peatona|peatones|ciclista)\b"),
    ("INCENDIO", r"\b(?:incendio|incendiado|incendios|arder|llamas|humo)\b"),
    ("ACCIDENTE_TRAFICO",
     r"\b(?:accidente|accidentes|accidentado|accidentada|collision|colision|choque|choca|"
     r"chocaron|vuelco|volcar|volco|salida de via|siniestro|siniestralidad)\b"),
    ("RESCATE",
     r"\b(?:rescate|rescatad[oa]s?|helicoptero|buzo|equipo de rescate|evacuad[oa]s?|kaplan)\b"),
    ("EMERGENCIA_SANITARIA", r"\b(?:emergencia|urgencias|ambulancia|112|botiquin)\b"),
    ("ACTUACION_SERVICIOS",
     r"\b(?:guardia civil|cuerpo de bomberos|proteccion civil|cruz roja|cruz verde|"
     r"personal sanitario|servicios de emergencia|policia local|guardia de seguridad)\b"),
]
EARLY_RULES = [
    ("DEPORTES",
     r"\b(?:futbol|balonmano|balon|ciclismo|ciclista|atletismo|baloncesto|voleibol|voleybol|"
     r"tenis|natacion|motociclismo|maraton|deporte|deportes|deportista|club|equipo|cicar|"
     r"corbelo|portero|entrenador|jugador|descenso|campeonato|torneo)\b"),
    ("CULTURA",
     r"\b(?:museo|museos|festival|concierto|conciertos|teatro|exposicion|exposiciones|"
     r"microrrelato|certamen|novela|escritor|escritora|literario|concurso)\b"),
]
TOPIC_RULES = [
    ("SUERTES_Y_OCIO", r"\b(?:horoscopo|zodiaco|zodiacal|quiro|quiromancia|tarot|suerte|mayor[ez])\b"),
    ("FIESTAS_Y_TRADICIONES", r"\b(?:fiestas|festejos|procesion|romeria|feria|carnaval|festejo|patronal|romeria)\b"),
    ("AGRICULTURA_GANADERIA",
     r"\b(?:agricultura|agricola|ganaderia|ganadero|viticola|vid|vinedo|uva|platanera|olivar|"
     r"oliva|cosecha|siembra|riego|agricultor|cubo|malvasia|vaca|vacuno|caprino|oveja|cordero|"
     r"granja|ganado|apicultura)\b"),
    ("PESCA_MAR",
     r"\b(?:pesca|pescador|pesquera|cofradia|atun|atunero|marisqu|almunia|puerto pesquero|jabega|cebada)\b"),
    ("POLITICA",
     r"\b(?:ayuntamiento|alcalde|alcaldesa|corregidor|concejal|concejala|partido|partidos|"
     r"politica|electoral|elecciones|elecciones municipales|pleno|mojon|alcaldia)\b"),
    ("INSTITUCIONES",
     r"\b(?:cabildo|parlamento|diputacion|consejo insular|consejo de|lastribuna|presidencia|generalitat)\b"),
    ("EMPLEO",
     r"\b(?:empleo|trabajadores|trabajadoras|sindicato|sindical|paro|desempleo|sueldos|"
     r"convenio colectivo|nomina)\b"),
    ("ECONOMIA",
     r"\b(?:economia|economico|inflacion|ipc|vivienda|hipoteca|alquiler|mercantil|banco|pib|impuestos|iva)\b"),
    ("EMPRESAS",
     r"\b(?:empresa|empresas|empresarial|industria|industrial|fabrica|planta|sociedad|mercantil|comercio)\b"),
    ("SANIDAD", r"\b(?:sanidad|sanitario|salud|hospital|centenario|clinica|residencia|urgencias)\b"),
    ("EDUCACION",
     r"\b(?:educacion|colegio|colegios|instituto|escuela|universidad|profesorado|profesor|"
     r"alumno|alumnos|academia|matricula)\b"),
    ("AGUA", r"\b(?:agua|aguas|hidraulica|riego|embalse|pozo|desalinadora|pluviales|alcantarillado)\b"),
    ("ENERGIA", r"\b(?:energia|electrica|eletrica|luz|placas solares|fotovoltaic|gas natural)\b"),
    ("TRANSPORTE",
     r"\b(?:guaguas|bus|transport|transporte|aeropuerto|vueling|ryanair|linea 30|linea 40|taxi)\b"),
    ("URBANISMO",
     r"\b(?:urbanismo|urbanistica|obra|obras|licitacion|planeamiento|edificacion|viviendas|constructor)\b"),
    ("RESIDUOS", r"\b(?:residuo|residuos|basura|vertedero|punto limpio|reciclaje|reciclar)\b"),
    ("SERVICIOS",
     r"\b(?:servicio|recogida|limpieza|limpieza viaria|alcantarillado|servicios municipales|"
     r"adjudicacion|concesion)\b"),
    ("VIVIENDA", r"\b(?:vivienda|viviendas|vivienda vdh|promocion|promocion de viviendas|vivienda publica)\b"),
    ("BIENESTAR_SOCIAL",
     r"\b(?:ayuda social|inclusion social|residencia|centro de mayores|personas mayores|familia|menores|infancia)\b"),
    ("CULTURA",
     r"\b(?:cultura|cultural|arte|artistico|museo|museos|exposicion|festival|concierto|conciertos|"
     r"teatro|danza|musica|musical|libro|libros|novela|escritor|escritora|premio|premios|"
     r"patrimonio|concurso|certamen|microrrelato|poesia|pintura|escultura|cine|cinema)\b"),
    ("TELEVISION_Y_ESPECTACULOS",
     r"\b(?:television|serie|series|reality|telenovela|hbo|netflix|canal|prime time)\b"),
    ("DEPORTES",
     r"\b(?:futbol|balonmano|balon|ciclismo|ciclista|atletismo|baloncesto|voleibol|tenis|natacion|"
     r"motociclismo|maraton|deporte|deportes|deportista|club|equipo|cicar|corbelo|portada|"
     r"las palmas de canarias cicar|playas de cartaya)\b"),
    ("SOCIEDAD",
     r"\b(?:sociedad|veterinari|perro|gato|loros|mascota|mascotas|ave|aves|pajaro|pajaros|animal|"
     r"animales|domestico|protector)\b"),
    ("TURISMO", r"\b(?:turismo|turistico|turistas|hotel|hoteles|resort|playas|playa|vacaciones|aloja)\b"),
    ("GASTRONOMIA",
     r"\b(?:restaurante|restaurantes|gastronom|gastronomia|restauracion|cocina|menu|delicatessen|catrufia)\b"),
    ("MEDIO_AMBIENTE",
     r"\b(?:medioambiente|ecolog|ecologica|sostenib|contaminacion|biodiversidad|especie|reserva|"
     r"carbonero|basura plastic)\b"),
    ("METEOROLOGIA",
     r"\b(?:meteo|meteorolog|aemet|alerta naranja|lluvia|viento|calima|tormancha|oleaje)\b"),
    ("MAR", r"\b(?:oleaje|maritimo|marea|bahia|puerto)\b"),
    ("CIENCIA_TECNOLOGIA",
     r"\b(?:ciencia|cientifico|tecnolog|telecomunic|telefonia|internet|digital|innovacion|investiga)\b"),
    ("SEGURIDAD_CIUDADANA",
     r"\b(?:policia|policia local|policia nacional|guardia civil|detenido|detencion|atentado|atraco|delito)\b"),
    ("JURIDICO",
     r"\b(?:juzgado|juez|tribunal|sentencia|condena|condenado|demanda|juicio|audiencia penal|"
     r"investigacion judicial)\b"),
    ("TRAMITES_Y_SERVICIOS_CIUDADANO",
     r"\b(?:tramite|tramites|cita previa|padron|documentacion|dni|nie)\b"),
    ("RELIGION",
     r"\b(?:iglesia|iglesias|romeria|dioces|parroquia|obispo|papa|beatificacion|procesion)\b"),
    ("ACTOS_PROTOCOLARIOS",
     r"\b(?:presidente|ministra|monarca|visita oficial|inauguracion|homenaje|conmemoracion|aniversario)\b"),
]

# --- fixed values: vehicle and severity rules -------------------------------------
VEHICLE_RULES = [
    ("CAMION", r"\b(?:furgoneta|camion|camioneta|bus|cisterna|trailer|vehiculos pesados|grua)\b"),
    ("BICICLETA", r"\b(?:ciclista|ciclismo|bicicleta|bici|patinete)\b"),
    ("MOTO", r"\b(?:moto|motocicleta|motociclista|motorista|motoneta)\b"),
    ("PEATON", r"\b(?:peaton|peatona|peatones)\b"),
    ("COCHE", r"\b(?:turismo|automovil|coche|carro|vehiculo)\b"),
]
SEVERITY_WORDS = [
    ("GRAVE", r"\b(?:grave|graves|critico|critica)\b"),
    ("MODERADO", r"\b(?:moderado|moderada|moderados|moderadas)\b"),
    ("LEVE", r"\b(?:leve|leves|contusiones|sin lesion|ileso|ilesa)\b"),
]

# --- fixed values: relevance terms and weights -------------------------------------
RELEVANCE = [
    ("accidente", 3), ("accidentes", 3), ("accidentado", 3), ("accidentada", 3),
    ("atropello", 3), ("colision", 3), ("choque", 3), ("choca", 2), ("vuelco", 3),
    ("volcar", 3), ("volco", 3), ("salida de via", 3), ("siniestro", 3),
    ("siniestralidad", 2), ("herido grave", 3), ("heridos", 2), ("herida", 2),
    ("herido", 2), ("fallecido", 2), ("fallecimiento", 2), ("fallece", 2),
    ("fallecen", 2), ("emergencia", 2), ("rescate", 2), ("rescatado", 2),
    ("rescatada", 2), ("incendio", 2), ("bomberos", 1), ("112", 1), ("guardia civil", 1),
    ("carretera", 1), ("corte de circulacion", 2), ("aturdido", 2), ("imputado", 1),
    ("testigos", 1), ("cuesta abajo", 1),
]

# --- fixed values: other islands, local words and mainland cities --------------------
OTHER_ISLANDS = [
    "corralejo", "puerto del rosario", "la oliva", "pajara", "ajuy", "fuerteventura",
    "gran tarajal", "antigua", "caleta de fuste", "tenerife", "santa cruz de tenerife",
    "las palmas de gran canaria", "las palmas", "telde", "teide", "la gomera", "la palma",
    "el hierro", "gran canaria", "maspalomas", "playa del ingles",
]
LOCAL_WORDS_FIRST = ["lanzarote", "la graciosa", "la graciosa village"]
LOCAL_WORDS_LAST = [
    "papagayo", "el jable", "jable", "la geria", "geria", "malpaso", "puerto de naos", "naos",
    "los marmoles", "marmoles", "la isleta", "las canteras", "temisas", "las manras",
    "famara", "san sebastian de la gomera", "el golfo", "cabildo de lanzarote",
    "patronato de volcanes", "consejo insular", "ayuntamiento de teguise",
]
LOCAL_ROAD = r"\blz\s?-?\d{1,2}\b"
MAINLAND_CITIES = [
    "madrid", "barcelona", "valencia", "sevilla", "granada", "bilbao", "vizcaya",
    "pontevedra", "vigo", "ourense", "a coruna", "santander", "asturias", "gijon", "oviedo",
    "burgos", "valladolid", "salamanca", "zamora", "leon", "palencia", "toledo",
    "ciudad real", "cuenca", "guadalajara", "albacete", "alicante", "murcia", "cartagena",
    "almeria", "huelva", "cadiz", "malaga", "cordoba", "jaen", "tarragona", "girona",
    "lerida", "terrassa", "sabadell", "badalona", "mataro", "reus", "mallorca", "ibiza",
    "palma", "menorca", "merida",
]

# --- fixed values: traffic gate roots and whole phrases -------------------------------
EVENT_ROOTS = [
    "accidente", "accidentad", "siniestr", "colision", "choque", "choc", "vuelc", "volc",
    "atropell", "atropelo", "arroll", "embist", "carrocer", "topista", "golpeo",
    "rozamiento", "alcant", "invadi",
]
EVENT_PHRASES = [
    "salida de via", "salidas de via", "salio de la via", "se salio de la via",
    "sale de la via", "se sale de la via", "salirse de la via", "salida via", "caida",
    "cayo", "cayend", "cayose", "cayo el", "cayo una", "cayo un", "roce", "roces", "alcance",
    "carroceria", "carrocerias", "cambio de sentido", "salto el",
]
FIRE_ROOTS = ["incend", "arder", "ardiendo", "fuego", "llamas", "chamaco", "hollin", "humo"]
VEHICLE_ROOTS = [
    "vehicul", "turismo", "automovil", "automot", "motociclet", "ciclomotor", "patinete",
    "scooter", "biciclet", "ciclista", "camion", "furgonet", "furgon", "autobus", "guagua",
    "cuadricicl", "caravan", "remolque", "carretera", "autopista", "autovia", "avenida",
    "rotonda", "rotatoria", "glorieta", "circunvalacion", "arcen", "tunel", "aparcamiento",
    "carreteras", "carretero", "interurbana", "conductor", "conductora", "condutores",
    "motorista", "ciclistas",
]
VEHICLE_WORDS = [
    "coche", "coches", "moto", "motos", "bici", "bici-electrico", "vehiculo", "vehiculos",
    "taxi", "taxis", "tractor", "tractores", "grua", "gruas", "furgoneta", "caravana", "movilidad", "via",
    "vias", "vial", "calle", "calles", "carretera", "cruce", "cruces", "crucero", "carril",
    "carriles", "pista", "pistas", "puente", "puentes", "parking", "garaje", "curva",
    "curvas", "recta", "km",
]
GATE_ROAD = r"\blz\s?\d"
ROOT_SLACK = 4

# --- fixed values: personal-data rules, in order ----------------------------------------
PII_RULES = [
    ("MATRICULA", r"\b\d{4}\s?[\s-]?[A-Z]{3}\b", "[matricula omitida]"),
    ("MATRICULA", r"\b[A-Z]{2}\s?-\s?\d{4}\s?-\s?[A-Z]{1,2}\b", "[matricula omitida]"),
    ("MATRICULA", r"\b[A-Z]{2}\s?\d{4}\s?[A-Z]{1,2}\b", "[matricula omitida]"),
    ("TELEFONO", r"\+?34[\s-]?[6-9]\d{2}[\s-]?\d{3}[\s-]?\d{3}\b", "[telefono omitido]"),
    ("TELEFONO", r"\b[6-9]\d{2}[\s-]?\d{3}[\s-]?\d{3}\b", "[telefono omitido]"),
    ("DOCUMENTO", r"\b\d{8}\s?-[A-HJ-NP-TV-Z]\b", "[documento omitido]"),
    ("DOCUMENTO", r"\b[XYZ]\d{7}\s?-[A-HJ-NP-TV-Z]\b", "[documento omitido]"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[correo omitido]"),
]

# --- fixed values: URL parameters ----------------------------------------------------------
TRACKING_FEED = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid",
    "fbclid", "mc_cid", "mc_eid", "ref", "amp",
]
TRACKING_DEDUPE = TRACKING_FEED + ["output", "ito", "ns_campaign", "ns_mchannel", "ns_source"]
SECRET_PARAMS = ["token", "key", "apikey", "api_key", "access_token", "secret", "password"]

# --- fixed values: page markup names ---------------------------------------------------------
ARTICLE_TYPES = ["NewsArticle", "Article", "ReportageNewsArticle", "LiveBlogPosting", "BlogPosting"]
STRIP_TAGS = [
    "script", "style", "noscript", "iframe", "ins", "aside", "nav", "header", "footer",
    "form", "button",
]
STRIP_CLASSES = [
    "advert", "ads", "advertisement", "publicidad", "banner", "share", "social", "compartir",
    "related", "relacionados", "comment", "comments", "comentarios", "newsletter",
    "suscribete", "cookie", "cookies", "consent", "sidebar", "widget",
]
#: Elements whose content is no text, elements without an end, those that may hold an article, and those that end a paragraph.
RAW_TAGS = ["script", "style", "noscript", "iframe"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
CONTAINERS = ["article", "div", "section", "main"]
PARAGRAPH_ENDS = [
    "div", "section", "main", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre",
    "form", "hr", "header", "footer", "nav", "aside", "body", "html",
]
ARTICLE_HINT = r"\b(article|post|entry|content|body|txt|story|noticia)\b"
NAVIGATION_HINT = (
    r"\b(nav|menu|sidebar|footer|header|widget|share|social|comment|related|advert|promo|"
    r"banner|cookie|newsletter)\b"
)
PUBLISHED_META = [
    ("property", "article:published_time"), ("name", "article:published_time"),
    ("name", "date"), ("name", "publish-date"), ("name", "DC.date"),
    ("itemprop", "datePublished"),
]

# --- fixed values: thresholds and weights ------------------------------------------------------
WINDOW_HOURS = 72
SIMHASH_MAX = 12
HASHED_TOKENS = 200  # of the option that hashes the opening of a text
TITLE_WITH_SIMHASH = 0.86
TITLE_ALONE = 0.95
SEMANTIC_MIN = 0.93
REPORT_MIN = 0.8
CLEANUP_HOURS, CLEANUP_SIMHASH, CLEANUP_TITLE = 48, 8, 0.6
CANDIDATE_CAP = 60
MAX_OVERLAP = 0.12
MISSING_AFTER = 6
FAILING_AFTER = 3
TRAILING_RUNS = 20
ALERT_SILENCE_HOURS = 12
FEED_CAP, MAX_AGE_DAYS, LOOKBACK_MINUTES, CADENCE_MINUTES = 25, 30, 90, 60
CHECK_WEIGHTS = {"date": 0.2, "place": 0.2, "consistency": 0.25, "body": 0.2, "relevance": 0.15}
GOOD_CONFIDENCE, MIN_CONFIDENCE = 0.8, 0.55
PUBLISH = {
    "min_confidence": 0.85, "min_source": 0.6, "min_words": 120, "max_age_hours": 24,
    "max_warnings": 0,
}
PIN_RADIUS_KM = 1.2
LAND_MARGIN_M, SAFE_INLAND_M, EDGE_M = 150, 200, 50
LOCAL_ZONE = "Atlantic/Canary"

# What surrounds a number that counts victims, and what a number refers to instead.
VICTIM_AFTER = r"\b(herid|fallecid|muerto|muert|víctim|victima|personas|implicad|lesionad)\w*"
VICTIM_BEFORE = r"\b(herid|fallecid|muerto|muert|víctim|victima)\w*"
REF_BEFORE = r"\b(h|lz|carretera|km|kilometro|puerto|camino|vía|via)\s*-?\s*$"
REF_AFTER = r"^\s*(h|hs|horas|min|minutos)\b"
CALENDAR = (
    r"\b(lunes|martes|miercoles|jueves|viernes|sabado|domingo|enero|febrero|marzo|abril|mayo|"
    r"junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\b"
)

# Words for deaths and injuries, a count of injured, and what each inconsistency costs.
DEATH_WORDS = r"(?i)\b(fallecid\w*|murio|murieron|muerte|muertos?|decresid\w*)\b"
HURT_WORDS = r"(?i)\bherid"
HURT_COUNT = rf"(?i)(\d{{1,2}}|{'|'.join(HEADLINE_NUMBERS)})\s+(?:\w+\s+){{0,2}}herid"
CONSISTENCY_COSTS = {
    "muerte_solo_en_titular": 0.45, "heridos_solo_en_titular": 0.3, "grave_sin_cifras": 0.25, "grave_a_cero": 0.3,
    "cifras_distintas": 0.35, "cuerpo_corto": 0.5,
}
