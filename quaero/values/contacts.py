"""Institutions and their published contact points. All of them are fixed values."""

# Fixed value: key, name, address, phone, email, url.
INSTITUTIONS = [
    ("botanica", "Pretura sectorului Botanica", "str. Teilor nr. 10, Chișinău",
     "022 76-75-75", "pretura.botanica@pmc.md", "https://botanica.md/"),
    ("centru", "Pretura sectorului Centru", "str. Columna 147, Chișinău",
     "022 22-26-32", "pretura.centru@pmc.md", "https://www.chisinau.md/"),
    ("buiucani", "Pretura sectorului Buiucani", "str. Ion Creangă 4/2, Chișinău",
     "022 74-94-40", "pretura.buiucani@pmc.md", "https://www.chisinau.md/"),
    ("ciocana", "Pretura sectorului Ciocana", "str. Mircea cel Bătrân 4/2, Chișinău",
     "022 31-55-91", "pretura.ciocana@pmc.md", "https://www.chisinau.md/"),
    ("rascani", "Pretura sectorului Râșcani", "str. Kiev 147A, Chișinău",
     "022 44-01-12", "pretura.rascani@pmc.md", "https://www.chisinau.md/"),
    ("primarie", "Primăria Municipiului Chișinău — Ghișeul Unic",
     "bd. Ștefan cel Mare și Sfânt 83, Chișinău",
     "+373 22 20 15 05", "primaria@pmc.md", "https://www.chisinau.md/"),
    ("dgaurf", "DGAURF", "Chișinău",
     "+373 68 675 889", "dgaurf@cmc.md", "https://dgaurf.md/ro/regulatory"),
]
INSTITUTION_SCHEMA = "institution string, name string, address string, phone string, email string, url string"

# Fixed value: where a question without a matching topic link is sent: label, url, contact.
PERMIT_OFFICE = (
    "DGAURF — Cadrul normativ", "https://dgaurf.md/ro/regulatory",
    "dgaurf@cmc.md · +373 68 675 889",
)
FRONT_DESK = (
    "Ghișeul Unic Primăria Chișinău", "https://www.chisinau.md/",
    "+373 22 20 15 05 · primaria@pmc.md",
)
# Fixed value: front pages that are never offered as the next step.
FRONT_PAGES = ["http://chisinau.md", "https://chisinau.md", "https://www.chisinau.md"]
