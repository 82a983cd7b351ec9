"""Fixed values the matching rules need to give the same answers as the
original pipeline. They are data, kept together and in their natural order.
"""

# --- Fixed values: country name -> country code overrides (P6) ------------
COUNTRY_CODE_FIXES = {
    "Chile": "CHL", "Burkina Faso": "BFA", "Morocco": "MAR", "Nigeria": "NGA",
    "Paraguay": "PRY", "Palestine": "PSX", "Chad": "TCD", "Central African Republic": "CAF",
    "Democratic Republic of Congo": "COD", "Niger": "NER", "South Africa": "ZAF",
    "Sudan": "SDN", "South Sudan": "SDS", "Cameroon": "CMR", "Nepal": "NPL", "Mozambique": "MOZ",
    "Sri Lanka": "LKA", "Madagascar": "MDG", "Portugal": "PRT", "Belgium": "BEL", "Mauritania": "MRT",
    "Algeria": "DZA", "Burundi": "BDI", "Guinea": "GIN", "Mali": "MLI", "Equatorial Guinea": "GNQ",
    "Republic of the Congo": "CON", "Tanzania": "TZA", "Uruguay": "URY", "Angola": "AGO", "Mayotte": "FRA",
    "Trinidad and Tobago": "TTO", "Ivory Coast": "CIV", "Zimbabwe": "ZWE", "Lesotho": "LSO", "Zambia": "ZMB",
    "Botswana": "BWA", "Puerto Rico": "PRI", "Sierra Leone": "SLE", "Gambia": "GMB", "Togo": "TGO",
    "eSwatini": "SWZ",
}

# --- Fixed values: point overrides (P7), applied in this order -------------
CRIMEA_ADMIN, CRIMEA_CODE = "Crimea", "RUS"
COUNTRY_AS_ADMIN1 = ["Mayotte", "Martinique", "Guam"]
CODE_TO_ADMIN1 = {"PRI": "Puerto Rico"}

# --- Fixed values: normalised region-name renames (P8) ---------------------
ADMIN_NAME_FIXES = {
    "Hadarom": "Southern", "Hazafon": "Northern", "Hamerkaz": "Central", "Ituri": "Orientale",
    "Province 1": "Koshi", "Vlaanderen": "Vlaams Gewest", "Menaka": "Gao",
}

# --- Fixed values: countries whose regions come from the second boundary set
# (MAR appears twice in the original list; duplicates are harmless here)
REPLACED_COUNTRIES = ["NPL", "ESP", "BFA", "LKA", "PHL", "LBN", "MAR", "BEL", "BGD",
                      "AFG", "MAR", "KEN", "ISL", "COD", "XKX", "SOM", "MTQ", "MNE", "CIV"]

# --- Fixed values: French departments by merged region (U3) ----------------
FRANCE_REGIONS = {
    "Auvergne-Rhone-Alpes": ["Ain", "Allier", "Ardèche", "Cantal", "Drôme", "Isère", "Haute-Loire",
                             "Loire", "Puy-de-Dôme", "Rhône", "Savoie", "Haute-Savoie"],
    "Bourgogne-Franche-Comte": ["Côte-d’Or", "Doubs", "Jura", "Nièvre", "Haute-Saône",
                                "Saône-et-Loire", "Yonne", "Territoire de Belfort"],
    "Bretagne": ["Côtes-d'Armor", "Finistère", "Ille-et-Vilaine", "Morbihan"],
    "Centre-Val De Loire": ["Cher", "Eure-et-Loir", "Indre", "Indre-et-Loire", "Loir-et-Cher", "Loiret"],
    "Corse": ["Corse-du-Sud", "Haute-Corse"],
    "Grand Est": ["Ardennes", "Aube", "Bas-Rhin", "Haut-Rhin", "Haute-Marne", "Marne",
                  "Meurthe-et-Moselle", "Meuse", "Moselle", "Vosges"],
    "Hauts-De-France": ["Aisne", "Nord", "Oise", "Pas-de-Calais", "Somme"],
    "Ile-De-France": ["Paris", "Seine-et-Marne", "Yvelines", "Essonne", "Hauts-de-Seine",
                      "Seine-Saint-Denis", "Val-de-Marne", "Val-d'Oise"],
    "Normandie": ["Calvados", "Eure", "Manche", "Orne", "Seine-Maritime"],
    "Nouvelle-Aquitaine": ["Charente", "Charente-Maritime", "Corrèze", "Creuse", "Dordogne", "Gironde",
                           "Landes", "Lot-et-Garonne", "Pyrénées-Atlantics", "Deux-Sèvres", "Vienne",
                           "Haute-Vienne"],
    "Occitanie": ["Ariège", "Aude", "Aveyron", "Gard", "Haute-Garonne", "Gers", "Hérault", "Lot",
                  "Lozère", "Hautes-Pyrénées", "Pyrénées-Orientales", "Tarn", "Tarn-et-Garonne"],
    "Pays De La Loire": ["Loire-Atlantique", "Maine-et-Loire", "Mayenne", "Sarthe", "Vendée"],
    "Provence-Alpes-Cote D'Azur": ["Alpes-de-Haute-Provence", "Hautes-Alpes", "Alpes-Maritimes",
                                   "Bouches-du-Rhône", "Var", "Vaucluse"],
}

# --- Fixed values: Libyan districts by merged region (U4) ------------------
LIBYA_REGIONS = {
    "West": ["Tripoli District", "Zawiya", "Misrata", "Murqub", "Nuqat al Khams", "Jafara", "Mizdah"],
    "East": ["Butnan", "Derna", "Jabal al Akhdar", "Marj", "Benghazi", "Al Qubbah", "Ajdabiya"],
    "South": ["Ghadames", "Ghat", "Murzuq", "Wadi al Hayaa", "Sabha", "Ash Shati", "Jufra", "Kufra"],
}

# --- Fixed values: model settings (event types, named sub-events, predictors
# in model order, targets) --------------------------------------------------
EVENT_TYPES = ["Battles", "Explosions/Remote violence", "Protests", "Riots",
               "Strategic developments", "Violence against civilians"]
SUB_EVENT_TYPES = ["Excessive force against protesters", "Agreement"]
PREDICTORS = [
    "Battles (t-1)", "Explosions/Remote violence (t-1)", "Protests (t-1)", "Riots (t-1)",
    "Strategic developments (t-1)", "Violence against civilians (t-1)",
    "Excessive force against protesters (t-1)", "Agreement (t-1)",
    "Explosions/Remote violence_neighbours (t-1)", "Strategic developments_neighbours (t-1)",
    "Protests_neighbours (t-1)", "Violence against civilians_neighbours (t-1)",
    "Battles_neighbours (t-1)", "Riots_neighbours (t-1)",
    "linear_month_trend", "year",
    "month_2", "month_3", "month_4", "month_5", "month_6", "month_7", "month_8", "month_9",
    "month_10", "month_11", "month_12", "quarter_2", "quarter_3", "quarter_4",
    "importance_weight",
]
TARGETS = ["Battles", "Explosions/Remote violence", "Violence against civilians"]
START_YEAR = 2018

FUZZY_THRESHOLD = 60


def group_rows(groups: dict[str, list[str]], country: str) -> list[tuple[str, str, str]]:
    """(country, child_name, parent_name) rows for :func:`merge_groups`."""
    return [(country, child, parent) for parent, kids in groups.items() for child in kids]
