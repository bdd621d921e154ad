"""Fixed values.

Codes, labels and constants that the count data and the published tables use. They are data,
not logic: operators take them as arguments, and only the presets in ``plans.study`` bind them.
"""

# --- fixed values: warehouse predicates -------------------------------------------------
VALIDATED_STATUS = ("CHECKED",)
UNCOVERED_CODES = ("-", "N")
MIDMONTH_ANALYSIS_SETS = (2, 3, 4)

# --- fixed values: area groups and their classes ----------------------------------------
AREA_CODES = ("ZS", "ZR", "ZSVAL", "SEST", "WETL", "NOH")
CLUSTER_CODES = ("BW", "DM", "DU", "KM", "KBR", "NG", "OV", "WZ")
AREA_CLASSES = {
    "SEST": "Sigmagebied",
    "WETL": "Sigmagebied",
    "ZSVAL": "Valleigebied",
    "ZS": "Estuarium",
    "ZR": "Estuarium",
    "NOH": "Haven",
}
SITE_CLASS = "Sigmagebied"
OVERLAPPING_CLASSES = {
    "Estuarium": ("Estuarium",),
    "Estuarium + Sigma": ("Estuarium", "Sigmagebied"),
}
SITE_TYPES = ("Sigma-Estuarien", "Sigma-Wetland")

# --- fixed values: clusters -------------------------------------------------------------
CLUSTER_SHORT_PATTERN = "Kruibeke"
CLUSTER_SHORT_NAME = "KBR"
CLUSTER_LEVELS = (
    "Burchtse Weel",
    "Dijlemonding",
    "Durme",
    "Kalkense Meersen",
    "KBR",
    "Noordelijk Gebied",
    "Wal-Zwijn",
    "Overige",
)

# --- fixed values: taxon groups ---------------------------------------------------------
GULLS_AND_TERNS = "Meeuwen en Sternen"
WADERS_CODE = "S"
UNKNOWN_GROUP = "-"
SECOND_SOURCE_GROUPS = {"Meeuwen, Sterns en Schaarbekken (Laridae)": "Meeuwen en Sternen"}
REST_LABEL = "Andere"
LATER_START_TAXA = {"Kievit": 1998, "Wulp": 1998}
TOP_LIST_EXCLUDED = ("Kievit",)
SECOND_SOURCE_UNRANKED = ("Canadese Gans onbekend",)

# --- fixed values: count rounds by calendar month ---------------------------------------
ROUNDS = {
    10: "Oktober",
    11: "November",
    12: "December",
    1: "Januari",
    2: "Februari",
    3: "Maart",
}
ROUNDS_PER_WINTER = 6

# --- fixed values: replaced location ----------------------------------------------------
REPLACED_LOCATION = "Prosperpolder DOEL"
REPLACED_AFTER = 2012

# --- fixed values: chart statistics -----------------------------------------------------
MOVING_ROWS = 5
TARGET_LEVEL = 40000
SMOOTH_SPAN = 0.75
SMOOTH_POINTS = 80
NORMAL_975 = 1.959964

# --- fixed values: axis limits of the charts, outside of which points are not fitted ----
LIMITS_WITHOUT_WADERS = {
    "site_means": (0, 20000),
    "valley_means": (0, 125000),
    "region_means": (0, 320000),
    "site_and_valley_means": (0, 125000),
    "valley_and_region_means": (0, 320000),
    "site_share_of_valley": (0, 0.4),
    "valley_share_of_region": (0, 0.5),
    "site_share_of_region": (0, 0.1),
}
LIMITS_WITH_WADERS = {
    "site_means": (0, 20000),
    "valley_means": (0, 125000),
    "region_means": (0, 320000),
    "site_and_valley_means": (0, 125000),
    "valley_and_region_means": (0, 370000),
    "site_share_of_valley": (0, 0.4),
    "valley_share_of_region": (0, 0.5),
    "site_share_of_region": (0, 0.1),
}
LIMITS_MOVING_MEANS = (0, 50000)
LIMITS_SITE_TYPES = (0, 15000)

# --- fixed values: column headers of the exported files ---------------------------------
COUNTS_HEADER = {
    "ProjectCode": ("survey_code", "string"),
    "Project": ("survey", "string"),
    "RegioCode": ("region_code", "string"),
    "Regio": ("region", "string"),
    "GebiedsCode": ("location_code", "string"),
    "Gebied": ("location", "string"),
    "Telseizoen": ("season", "string"),
    "TellingCode": ("round_code", "string"),
    "Telling": ("round", "string"),
    "TellingSortOrder": ("round_order", "int"),
    "Teldatum": ("sample_date", "date"),
    "Telvolledigheid": ("coverage", "string"),
    "NedNaam": ("taxon", "string"),
    "WetNaam": ("scientific_name", "string"),
    "Aantal": ("individuals", "bigint"),
    "Groepscode": ("taxon_group_code", "string"),
    "Groep": ("taxon_group", "string"),
}
MEMBERSHIP_HEADER = {
    "LocationGroupCode": ("area_code", "string"),
    "LocationGroupNaam": ("area_name", "string"),
    "LocationGroupTypeCode": ("area_type_code", "string"),
    "LocationGroupTypeNaam": ("area_type", "string"),
    "LocationWVCode": ("location_code", "string"),
    "LocationWVNaam": ("location", "string"),
    "StartDate": ("valid_from", "date"),
    "EndDate": ("valid_to", "date"),
}
SECOND_SOURCE_HEADER = {
    "location": ("location", "string"),
    "species name": ("taxon", "string"),
    "date": ("sample_date", "date"),
    "number": ("individuals", "bigint"),
    "family": ("taxon_group", "string"),
}

# --- fixed values: column names of the warehouse tables ---------------------------------
WAREHOUSE_COLUMNS = {
    "FactAnalyseSetOccurrence": {
        "surveykey": ("survey_key", "bigint"),
        "locationwvkey": ("location_key", "bigint"),
        "seasonkey": ("season_key", "bigint"),
        "eventkey": ("event_key", "bigint"),
        "samplekey": ("sample_key", "bigint"),
        "taxonwvkey": ("taxon_key", "bigint"),
        "Taxoncount": ("individuals", "bigint"),
        "Analysesetkey": ("analysis_set", "int"),
    },
    "DimSurvey": {
        "surveykey": ("survey_key", "bigint"),
        "SurveyCode": ("survey_code", "string"),
        "SurveyNaam": ("survey", "string"),
    },
    "DimLocationWV": {
        "locationwvkey": ("location_key", "bigint"),
        "RegioWVCode": ("region_code", "string"),
        "RegioWVNaam": ("region", "string"),
        "LocationWVCode": ("location_code", "string"),
        "LocationWVNaam": ("location", "string"),
    },
    "DimSeason": {
        "seasonkey": ("season_key", "bigint"),
        "Seasonname": ("season", "string"),
    },
    "DimEvent": {
        "eventkey": ("event_key", "bigint"),
        "EventCode": ("round_code", "string"),
        "EventLabel": ("round", "string"),
        "SortOrder": ("round_order", "int"),
    },
    "DimSample": {
        "samplekey": ("sample_key", "bigint"),
        "sampleDate": ("sample_date", "date"),
        "CoverageCode": ("coverage", "string"),
        "samplestatus": ("sample_status", "string"),
    },
    "DimTaxonWV": {
        "taxonwvkey": ("taxon_key", "bigint"),
        "Commonname": ("taxon", "string"),
        "scientificname": ("scientific_name", "string"),
        "TaxonGroupCode": ("taxon_group_code", "string"),
        "TaxonGroupDescription": ("taxon_group", "string"),
    },
    "FactLocationGroup": {**MEMBERSHIP_HEADER, "IsDeleted": ("is_deleted", "int")},
}
