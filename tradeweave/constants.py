"""Domain constants of the trade-flow model.

FIXED VALUES: every table below must equal the values the analysed pipeline
uses, or results differ. They are listed plainly and in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — raw flow record column names → clean names
# ---------------------------------------------------------------------------
FLOW_RENAME = {
    "refYear": "year",
    "reporterCode": "reporter_code",
    "reporterISO": "reporter_iso3",
    "partnerCode": "partner_code",
    "partnerISO": "partner_iso3",
    "cmdCode": "hs_code",
    "cmdDesc": "commodity_desc",
    "flowCode": "flow_code",
    "primaryValue": "trade_value_usd",
    "netWgt": "net_weight_kg",
    "qty": "quantity",
    "qtyUnitAbbr": "qty_unit",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — flow codes, simple direction, valuation basis
# ---------------------------------------------------------------------------
FLOW_CODE_LABELS = {"M": "Import", "X": "Export", "RM": "Re-import", "RX": "Re-export"}
FLOW_SIMPLE = {"Import": "Import", "Re-import": "Import", "Export": "Export", "Re-export": "Export"}
FLOW_VALUATION = {"Import": "CIF", "Re-import": "CIF", "Export": "FOB", "Re-export": "FOB"}

IMPORT_LABELS = ("Import", "Re-import")
EXPORT_LABELS = ("Export", "Re-export")

# ---------------------------------------------------------------------------
# FIXED VALUES — partner codes meaning "World"/undisclosed; commodity aggregates
# ---------------------------------------------------------------------------
WORLD_PARTNER_CODES = ("0", "W00", "WLD")
AGGREGATE_HS_CODES = ("TOTAL", "AG2", "ALL", "AG4", "AG6", "99")

# Reference dedup keys of a flow table (reporter not included) and our default,
# which adds the reporter so that several reporters never collapse into one.
REFERENCE_DEDUP_KEYS = ("year", "partner_code", "hs_code", "flow_code")
DEFAULT_DEDUP_KEYS = ("year", "reporter_code", "partner_code", "hs_code", "flow_code")

# ---------------------------------------------------------------------------
# FIXED VALUES — indicator feed: aggregate (non-country) ISO3 codes, indicator names
# ---------------------------------------------------------------------------
INDICATOR_AGGREGATE_ISO3 = (
    "WLD", "EUU", "HIC", "LIC", "LMC", "UMC", "MIC", "OEC", "FCS", "HPC",
    "IBD", "IBT", "IDA", "IDB", "IDX", "LAC", "EAP", "ECA", "MNA", "SAR",
    "SSA", "NAC", "INX", "PRE", "SST", "TMN", "TSA", "TSS", "EMU", "ARB",
    "CSS", "CEB", "EAR", "EAS", "ECS", "LCN", "LDC", "MEA", "SAS", "SSF",
    "TEA", "TEC", "TLA", "AFE", "AFW", "TBT", "XZN",
)
INDICATOR_NAMES = {"NY.GDP.MKTP.CD": "gdp_usd", "SP.POP.TOTL": "population"}

# ---------------------------------------------------------------------------
# FIXED VALUES — HS chapter ranges → section (first chapter, last chapter, code, name)
# ---------------------------------------------------------------------------
HS_SECTIONS = (
    (1, 5, "I", "Live Animals & Animal Products"),
    (6, 14, "II", "Vegetable Products"),
    (15, 15, "III", "Animal or Vegetable Fats & Oils"),
    (16, 24, "IV", "Prepared Foodstuffs, Beverages & Tobacco"),
    (25, 27, "V", "Mineral Products"),
    (28, 38, "VI", "Chemical & Allied Industries"),
    (39, 40, "VII", "Plastics & Rubber"),
    (41, 43, "VIII", "Hides, Skins, Leather & Furskins"),
    (44, 46, "IX", "Wood & Articles of Wood"),
    (47, 49, "X", "Pulp, Paper & Paperboard"),
    (50, 63, "XI", "Textiles & Textile Articles"),
    (64, 67, "XII", "Footwear, Headgear & Umbrellas"),
    (68, 70, "XIII", "Stone, Plaster, Cement & Glass"),
    (71, 71, "XIV", "Pearls, Precious Metals & Stones"),
    (72, 83, "XV", "Base Metals & Articles"),
    (84, 85, "XVI", "Machinery & Electrical Equipment"),
    (86, 89, "XVII", "Vehicles, Aircraft & Vessels"),
    (90, 92, "XVIII", "Optical, Photographic & Medical Instruments"),
    (93, 93, "XIX", "Arms & Ammunition"),
    (94, 96, "XX", "Miscellaneous Manufactured Articles"),
    (97, 97, "XXI", "Works of Art & Collectors' Pieces"),
    (98, 99, "SPECIAL", "Special Classifications"),
)
UNKNOWN_SECTION = ("?", "Unknown")

# FIXED VALUES — HS chapter names, chapters 1..99 in order
HS_CHAPTER_NAMES = (
    "Live animals",
    "Meat & edible offal",
    "Fish & crustaceans",
    "Dairy, eggs, honey",
    "Other animal products",
    "Live trees & plants",
    "Edible vegetables",
    "Edible fruit & nuts",
    "Coffee, tea, spices",
    "Cereals",
    "Milling industry products",
    "Oil seeds & misc grains",
    "Lac, gums & resins",
    "Vegetable plaiting materials",
    "Animal or vegetable fats & oils",
    "Preparations of meat or fish",
    "Sugars & confectionery",
    "Cocoa & cocoa preparations",
    "Cereals, flour, starch preparations",
    "Preparations of vegetables & fruit",
    "Miscellaneous edible preparations",
    "Beverages, spirits & vinegar",
    "Food industry residues & waste",
    "Tobacco & manufactured tobacco",
    "Salt, sulphur, earths & stone",
    "Ores, slag & ash",
    "Mineral fuels & oils",
    "Inorganic chemicals",
    "Organic chemicals",
    "Pharmaceutical products",
    "Fertilisers",
    "Tanning & dyeing extracts",
    "Essential oils & cosmetics",
    "Soap, lubricants, waxes",
    "Albuminoidal substances, starches",
    "Explosives & pyrotechnics",
    "Photographic goods",
    "Miscellaneous chemical products",
    "Plastics & articles thereof",
    "Rubber & articles thereof",
    "Raw hides & skins",
    "Leather articles & saddlery",
    "Furskins & artificial fur",
    "Wood & articles of wood",
    "Cork & articles of cork",
    "Manufactures of straw & plaiting",
    "Pulp of wood",
    "Paper & paperboard",
    "Printed books & newspapers",
    "Silk",
    "Wool & fine animal hair",
    "Cotton",
    "Other vegetable textile fibres",
    "Man-made filaments",
    "Man-made staple fibres",
    "Wadding, felt & nonwovens",
    "Carpets & floor coverings",
    "Special woven fabrics",
    "Impregnated textile fabrics",
    "Knitted or crocheted fabrics",
    "Knitted or crocheted apparel",
    "Woven apparel",
    "Other made-up textile articles",
    "Footwear",
    "Headgear",
    "Umbrellas & walking sticks",
    "Feathers, artificial flowers",
    "Articles of stone, plaster, cement",
    "Ceramic products",
    "Glass & glassware",
    "Pearls, precious metals, jewellery",
    "Iron & steel",
    "Articles of iron or steel",
    "Copper & articles thereof",
    "Nickel & articles thereof",
    "Aluminium & articles thereof",
    "Reserved",
    "Lead & articles thereof",
    "Zinc & articles thereof",
    "Tin & articles thereof",
    "Other base metals",
    "Tools, implements of base metal",
    "Miscellaneous articles of base metal",
    "Nuclear reactors, boilers, machinery",
    "Electrical machinery & equipment",
    "Railway locomotives & rolling stock",
    "Vehicles (not railway)",
    "Aircraft & spacecraft",
    "Ships & floating structures",
    "Optical & medical instruments",
    "Clocks & watches",
    "Musical instruments",
    "Arms & ammunition",
    "Furniture, bedding, mattresses",
    "Toys, games & sports equipment",
    "Miscellaneous manufactured articles",
    "Works of art & collectors' pieces",
    "Special classifications (national)",
    "Special classifications (national)",
)

# ---------------------------------------------------------------------------
# FIXED VALUES — ISO3 → UN numeric code overrides attached to country metadata
# ---------------------------------------------------------------------------
ISO3_UN_NUMERIC = {
    "USA": 842, "CHN": 156, "DEU": 276, "ISR": 376, "TUR": 792, "ITA": 380,
    "CHE": 756, "GBR": 826, "NLD": 528, "IND": 356, "KOR": 410, "JPN": 392,
    "FRA": 250, "BEL": 56, "ESP": 724, "RUS": 643, "BRA": 76, "CAN": 124,
    "AUS": 36, "MEX": 484, "SAU": 682, "ZAF": 710, "NGA": 566, "EGY": 818,
    "ARG": 32, "IDN": 360, "POL": 616, "SWE": 752, "NOR": 578, "DNK": 208,
    "FIN": 246, "AUT": 40, "PRT": 620, "GRC": 300, "CZE": 203, "HUN": 348,
    "ROU": 642, "UKR": 804, "THA": 764, "VNM": 704, "MYS": 458, "SGP": 702,
    "PHL": 608, "PAK": 586, "BGD": 50, "IRN": 364, "IRQ": 368, "JOR": 400,
    "LBN": 422, "SYR": 760, "YEM": 887, "MAR": 504, "DZA": 12, "TUN": 788,
    "LBY": 434, "ETH": 231, "KEN": 404, "TZA": 834, "GHA": 288, "CIV": 384,
    "CMR": 120, "UGA": 800, "AGO": 24, "MOZ": 508, "ZMB": 894, "ZWE": 716,
    "COL": 170, "VEN": 862, "CHL": 152, "PER": 604, "ECU": 218, "BOL": 68,
    "PRY": 600, "URY": 858, "HKG": 344, "TWN": 490, "NZL": 554,
}

# ---------------------------------------------------------------------------
# FIXED VALUES — time dimension labels (upper bound inclusive → label; else last)
# ---------------------------------------------------------------------------
DEFAULT_YEAR_RANGE = (2014, 2024)
DEFAULT_PERIODS = ((2019, "Pre-COVID 2014-2019"), (2021, "COVID era 2020-2021"))
DEFAULT_LAST_PERIOD = "Post-COVID 2022+"

# ---------------------------------------------------------------------------
# FIXED VALUES — thresholds
# ---------------------------------------------------------------------------
HHI_MODERATE = 1500
HHI_HIGH = 2500
ALERT_MIN_SHARE = 50.0
ALERT_HIGH_SHARE = 70.0
MIRROR_FLAG_PCT = 20.0
MIRROR_CHAPTER_FLOOR = 1e6
EMERGING_FLOOR = 1e6
NULL_RATE_HIGH = 20.0
NULL_RATE_MODERATE = 5.0
MIRROR_KEY_OFFSET = 10_000_000

# ---------------------------------------------------------------------------
# FIXED VALUES — region patches on the country dimension
# ---------------------------------------------------------------------------
REGION_OVERWRITE = {
    "Middle East & North Africa": (
        "ARE", "BHR", "QAT", "KWT", "OMN", "SAU", "JOR", "LBN",
        "IRQ", "IRN", "ISR", "PSE", "SYR", "YEM", "EGY", "LBY",
        "TUN", "DZA", "MAR",
    ),
}
REGION_FILL_IF_NULL = {
    "East Asia & Pacific": ("TWN", "HKG", "MAC"),
    "Europe & Central Asia": ("XKX", "IMN", "GIB"),
}

# FIXED VALUES — labels shown for emerging-supplier growth quartiles
QUARTILE_LABELS = {1: "Q1 — Top 25%", 2: "Q2 — Upper 50%", 3: "Q3 — Lower 50%", 4: "Q4 — Bottom 25%"}
