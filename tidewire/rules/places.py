# -*- coding: utf-8 -*-
"""Municipalities and zones with coordinates and other spellings."""

# slug, name, latitude, longitude
MUNICIPALITIES = [
    ("arrecife", "Arrecife", 28.9640, -13.5499),
    ("san-bartolome", "San Bartolomé", 29.0017, -13.6139),
    ("tias", "Tías", 28.9543, -13.6529),
    ("yaiza", "Yaiza", 28.9529, -13.7642),
    ("tinajo", "Tinajo", 29.0666, -13.6765),
    ("teguise", "Teguise", 29.0593, -13.5602),
    ("haria", "Haría", 29.1459, -13.5001),
]

# slug, name, municipality, latitude, longitude, other spellings
ZONES = [
    ("arrecife-pueblo", "Arrecife", "arrecife", 28.9640, -13.5499, []),
    ("costa-teguise", "Costa Teguise", "teguise", 28.9959, -13.4972, []),
    ("tahiche", "Tahíche", "teguise", 29.0136, -13.5431, []),
    ("nazaret", "Nazaret", "teguise", 29.0379, -13.5608, []),
    ("teseguite", "Teseguite", "teguise", 29.0546, -13.5318, []),
    ("teguise-pueblo", "Teguise", "teguise", 29.0593, -13.5602, []),
    ("soo", "Soo", "teguise", 29.0993, -13.6223, []),
    ("munique", "Muñique", "teguise", 29.0709, -13.6345, []),
    ("tiagua", "Tiagua", "teguise", 29.0546, -13.6336, []),
    ("tao", "Tao", "teguise", 29.0395, -13.6245, []),
    ("mozaga", "Mozaga", "teguise", 29.0219, -13.6126, []),
    ("caleta-de-famara", "Caleta de Famara", "teguise", 29.1188, -13.5660, ["famara"]),
    ("las-caletas", "Las Caletas", "teguise", 28.9820, -13.5116, []),
    ("guatiza", "Guatiza", "teguise", 29.0738, -13.4792, []),
    ("los-valles", "Los Valles", "teguise", 29.0840, -13.5231, []),
    ("el-mojon", "El Mojón", "teguise", 29.0683, -13.5178, ["mojon"]),
    ("mala", "Mala", "haria", 29.0983, -13.4679, []),
    ("haria-pueblo", "Haría", "haria", 29.1459, -13.5001, []),
    ("maguez", "Máguez", "haria", 29.1600, -13.4951, []),
    ("ye", "Yé", "haria", 29.1949, -13.4791, []),
    ("orzola", "Órzola", "haria", 29.2217, -13.4519, []),
    ("arrieta", "Arrieta", "haria", 29.1318, -13.4618, []),
    ("punta-mujeres", "Punta Mujeres", "haria", 29.1448, -13.4476, []),
    ("tabayesco", "Tabayesco", "haria", 29.1274, -13.4796, []),
    ("charco-del-palo", "Charco del Palo", "haria", 29.0841, -13.4517, []),
    ("san-bartolome-pueblo", "San Bartolomé", "san-bartolome", 29.0017, -13.6139, []),
    ("playa-honda", "Playa Honda", "san-bartolome", 28.9551, -13.5903, []),
    ("guime", "Güime", "san-bartolome", 28.9725, -13.6140, []),
    ("montana-blanca", "Montaña Blanca", "san-bartolome", 28.9879, -13.6374, []),
    ("tias-pueblo", "Tías", "tias", 28.9543, -13.6529, []),
    ("puerto-del-carmen", "Puerto del Carmen", "tias", 28.9204, -13.6507, ["puerto carmen"]),
    ("macher", "Mácher", "tias", 28.9484, -13.6839, []),
    ("la-asomada", "La Asomada", "tias", 28.9611, -13.6908, []),
    ("conil", "Conil", "tias", 28.9679, -13.6680, []),
    ("masdache", "Masdache", "tias", 28.9973, -13.6564, []),
    ("puerto-calero", "Puerto Calero", "yaiza", 28.9210, -13.7037, []),
    ("yaiza-pueblo", "Yaiza", "yaiza", 28.9529, -13.7642, []),
    ("playa-blanca", "Playa Blanca", "yaiza", 28.8632, -13.8299, []),
    ("uga", "Uga", "yaiza", 28.9502, -13.7441, []),
    ("femes", "Femés", "yaiza", 28.9138, -13.7789, []),
    ("las-brenas", "Las Breñas", "yaiza", 28.9199, -13.8104, []),
    ("playa-quemada", "Playa Quemada", "yaiza", 28.9075, -13.7322, []),
    ("el-golfo", "El Golfo", "yaiza", 28.9822, -13.8314, ["golfo"]),
    ("tinajo-pueblo", "Tinajo", "tinajo", 29.0666, -13.6765, []),
    ("la-santa", "La Santa", "tinajo", 29.1077, -13.6657, []),
    ("mancha-blanca", "Mancha Blanca", "tinajo", 29.0430, -13.6898, []),
    ("la-vegueta", "La Vegueta", "tinajo", 29.0474, -13.6509, []),
    ("el-cuchillo", "El Cuchillo", "tinajo", 29.0819, -13.6644, []),
    ("los-dolores", "Los Dolores", "tinajo", 29.0443, -13.6816, []),
    ("islote", "Islote", "san-bartolome", 29.0180, -13.6292, ["el islote"]),
    ("caleta-de-caballo", "Caleta de Caballo", "teguise", 29.1165, -13.6403, []),
]
