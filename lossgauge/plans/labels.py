"""Names and labels of the published loss and indicator data."""

# Supply stages that count as food loss. NULL stages are left out.
LOSS_STAGES = (
    "Whole supply chain",
    "Storage",
    "Processing",
    "Trader",
    "Wholesale",
    "Post-harvest",
    "Transport",
    "Export",
    "<NA>",
    "Distribution",
    "Market",
    "Stacking",
    "Grading",
    "Packing",
)

# Country names of the loss data and their names in the country table.
COUNTRY_NAMES = {
    "United Republic of Tanzania": "Tanzania",
    "Democratic Republic of the Congo": "Congo, Dem. Rep.",
    "Iran (Islamic Republic of)": "Iran",
    "Bolivia (Plurinational State of)": "Bolivia",
    "Viet Nam": "Vietnam",
    "China,Taiwan": "Taiwan",
    "Democratic People's Republic of Korea": "Korea, North",
    "Republic of Korea": "Korea, South",
    "Lao People's Democratic Republic": "Laos",
    "Venezuela (Bolivarian Republic of)": "Venezuela",
    "The former Yugoslav Republic of Macedonia": "North Macedonia",
}

# Entries of the country column that are left out.
DENIED_AREAS = (
    "Australia and New Zealand",
    "Africa",
    "Europe",
    "Latin America and the Caribbean",
    "Northern Africa",
    "Northern America",
    "South-Eastern Asia",
    "Southern Asia",
    "Sub-Saharan Africa",
    "United Kingdom of Great Britain and Northern Ireland",
    "Western Africa",
    "Western Asia",
)

# Income labels, keyed by the cleaned text (no trailing blanks).
INCOME_LABELS = {
    "UPPER-MIDDLE-INCOME ECONOMIES ($4,256 TO $13,205)": "Upper-Middle-Income Economies",
    "LOW-INCOME ECONOMIES ($1,085 OR LESS)": "Low-Income Economies",
    "LOWER-MIDDLE INCOME ECONOMIES ($1,086 TO $4,255)": "Lower-Middle Income Economies",
    "HIGH-INCOME ECONOMIES ($13,205 OR MORE)": "High-Income Economies",
}

# Fixed value: the explorers also give the unlabelled group a label; the ranking does not.
UNLABELLED_INCOME = {"Nan": "Lower-Middle Income Economies"}

# Region labels.
REGION_LABELS = {
    "SUB-SAHARAN AFRICA": "Sub-Saharan Africa",
    "MIDDLE EAST AND NORTH AFRICA": "Middle East and North Africa",
    "SOUTH ASIA": "South Asia",
    "LATIN AMERICA AND THE CARIBBEAN": "Latin America & the Caribbean",
    "EAST ASIA AND PACIFIC": "East Asia and Pacific",
    "EUROPE AND CENTRAL ASIA": "Europe and Central Asia",
    "NORTH AMERICA": "North America",
}

# Year columns of the indicator data.
YEAR_COLUMNS = {
    "2007 [YR2007]": 2007,
    "2010 [YR2010]": 2010,
    "2012 [YR2012]": 2012,
    "2014 [YR2014]": 2014,
    "2016 [YR2016]": 2016,
    "2018 [YR2018]": 2018,
}

# Overall series of the indicator data.
OVERALL_SCORE = "Logistics performance index: Overall score (1=low to 5=high)"
OVERALL_RANK = "Logistics performance index: Overall rank (1=highest performance)"

# Category scores and the policy category each belongs to.
SCORE_CATEGORIES = {
    "Ability to track and trace consignments, score (1=low to 5=high)": "Tracking and Tracing",
    "Competence and quality of logistics services, score (1=low to 5=high)": "Quality of log services",
    "Ease of arranging competitively priced international shipments, score (1=low to 5=high)": "Ease of arranging shipments",
    "Efficiency of the clearance process, score (1=low to 5=high)": "Customs",
    "Frequency with which shipments reach consignee within scheduled or expected time, score (1=low to 5=high)": "Timeliness",
    "Quality of trade- and transport-related infrastructure, score (1=low to 5=high)": "Infrastructure",
}

# Rank series of the indicator data.
RANK_SERIES = (
    OVERALL_RANK,
    "Ability to track and trace consignments, rank (1=highest performer)",
    "Competence and quality of logistics services, rank (1=highest performer)",
    "Ease of arranging competitively priced international shipments, rank (1=highest performer)",
    "Efficiency of the clearance process, rank (1=highest performer)",
    "Frequency with which shipments reach consignee within scheduled or expected time, rank (1=highest performer)",
    "Quality- of trade and transport-related infrastructure, rank (1=highest performer)",
)

SCORE_SERIES = (OVERALL_SCORE, *SCORE_CATEGORIES)

# Short series names shown by the indicator explorer.
SHORT_SERIES = {
    OVERALL_SCORE: "LPI Overall score",
    "Ability to track and trace consignments, score (1=low to 5=high)": "Tracking and tracing",
    "Competence and quality of logistics services, score (1=low to 5=high)": "Quality of log. services",
    "Ease of arranging competitively priced international shipments, score (1=low to 5=high)": "Ease of arranging shipments",
    "Efficiency of the clearance process, score (1=low to 5=high)": "Customs",
    "Frequency with which shipments reach consignee within scheduled or expected time, score (1=low to 5=high)": "Timeliness",
    "Quality of trade- and transport-related infrastructure, score (1=low to 5=high)": "Infrastructure",
}
