"""Reference maps as DataFrames: symbol catalog, country links, code groups.

All maps written in this file or shipped beside it (``data/``) are fixed values and tiny (229
rows at most), so they are the only DataFrames the package ever marks for broadcast.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: tracked symbols by category --------------------------------
SYMBOLS = {
    "commodities": {
        "CL=F": "Crude Oil (WTI)",
        "BZ=F": "Brent Crude",
        "GC=F": "Gold",
        "SI=F": "Silver",
        "NG=F": "Natural Gas",
        "ZW=F": "Wheat",
        "ZC=F": "Corn",
        "ZS=F": "Soybeans",
    },
    "currencies": {
        "EURUSD=X": "Euro/USD",
        "USDJPY=X": "USD/Yen",
        "GBPUSD=X": "British Pound/USD",
        "USDCNY=X": "USD/Chinese Yuan",
        "USDRUB=X": "USD/Russian Ruble",
        "USDINR=X": "USD/Indian Rupee",
        "USDBRL=X": "USD/Brazilian Real",
    },
    "etfs": {
        "SPY": "S&P 500",
        "QQQ": "Nasdaq 100",
        "EEM": "Emerging Markets",
        "VWO": "Emerging Markets (Vanguard)",
        "EWZ": "Brazil",
        "EWJ": "Japan",
        "FXI": "China Large Cap",
        "EWG": "Germany",
        "EWT": "Taiwan",
        "EWY": "South Korea",
        "INDA": "India",
        "XLE": "Energy Sector",
        "XLF": "Financial Sector",
        "GDX": "Gold Miners",
    },
    "volatility": {"^VIX": "CBOE Volatility Index"},
    "bonds": {
        "TLT": "20+ Year Treasury",
        "IEF": "7-10 Year Treasury",
        "HYG": "High Yield Corporate",
    },
}

# ---- fixed values: assets moved by a country ----------------------------------
COUNTRY_ASSETS = {
    "RUS": ["USDRUB=X", "NG=F", "CL=F"],
    "CHN": ["USDCNY=X", "FXI", "EEM"],
    "SAU": ["CL=F", "BZ=F"],
    "IRN": ["CL=F", "BZ=F", "GC=F"],
    "UKR": ["ZW=F", "ZC=F", "NG=F"],
    "BRA": ["USDBRL=X", "EWZ", "ZS=F"],
    "JPN": ["USDJPY=X", "EWJ"],
    "DEU": ["EURUSD=X", "EWG"],
    "TWN": ["EWT", "QQQ"],
    "KOR": ["EWY", "QQQ"],
    "IND": ["USDINR=X", "INDA"],
    "GBR": ["GBPUSD=X"],
    "ISR": ["GC=F", "CL=F"],
    "VEN": ["CL=F"],
    "NGA": ["CL=F"],
}

# ---- fixed values: countries a symbol is sensitive to --------------------------
SYMBOL_COUNTRIES = {
    "CL=F": ["RUS", "SAU", "IRN", "VEN", "NGA", "ISR"],
    "BZ=F": ["SAU", "IRN"],
    "NG=F": ["RUS", "UKR"],
    "ZW=F": ["UKR", "RUS"],
    "ZC=F": ["UKR"],
    "ZS=F": ["BRA", "USA", "ARG"],
    "GC=F": ["IRN", "ISR"],
    "USDRUB=X": ["RUS"],
    "USDCNY=X": ["CHN"],
    "USDJPY=X": ["JPN"],
    "EURUSD=X": ["DEU", "FRA", "ITA", "ESP"],
    "GBPUSD=X": ["GBR"],
    "USDBRL=X": ["BRA"],
    "USDINR=X": ["IND"],
    "FXI": ["CHN"],
    "EWZ": ["BRA"],
    "EWJ": ["JPN"],
    "EWG": ["DEU"],
    "EWT": ["TWN", "CHN"],
    "EWY": ["KOR"],
    "INDA": ["IND"],
    "EEM": ["CHN", "BRA", "IND", "KOR", "TWN"],
    "^VIX": [],
    "SPY": ["USA"],
    "QQQ": ["USA", "TWN", "KOR"],
}

# ---- fixed values: CAMEO root codes --------------------------------------------
CAMEO_LABELS = {
    "01": "public_statement",
    "02": "appeal",
    "03": "intent_to_cooperate",
    "04": "consult",
    "05": "diplomatic_cooperation",
    "06": "material_cooperation",
    "07": "provide_aid",
    "08": "yield",
    "09": "investigate",
    "10": "demand",
    "11": "disapprove",
    "12": "reject",
    "13": "threaten",
    "14": "protest",
    "15": "exhibit_force",
    "16": "reduce_relations",
    "17": "coerce",
    "18": "assault",
    "19": "fight",
    "20": "mass_violence",
}
EVENT_GROUPS = {
    "verbal_cooperation": ["01", "02", "03", "04", "05"],
    "material_cooperation": ["06", "07", "08"],
    "verbal_conflict": ["09", "10", "11", "12", "13"],
    "material_conflict": ["14", "15", "16", "17"],
    "violent_conflict": ["18", "19", "20"],
}

# ---- fixed values: spellings of news sources -----------------------------------
SOURCE_NAMES = {
    "reuters": "reuters",
    "ap": "ap",
    "bbc": "bbc",
    "aljazeera": "aljazeera",
    "al jazeera": "aljazeera",
    "al_jazeera": "aljazeera",
}

# ---- fixed values: indicator series --------------------------------------------
SERIES_NAMES = {
    "GDP": "Gross Domestic Product",
    "CPIAUCSL": "Consumer Price Index",
    "UNRATE": "Unemployment Rate",
    "DFF": "Federal Funds Rate",
    "DGS10": "10-Year Treasury Yield",
    "UMCSENT": "Consumer Sentiment (Michigan)",
}

# ---- fixed values: tags that admit or bar a prediction market ------------------
INCLUDE_TAGS = [
    "geopolitics", "world", "politics", "economy", "economic-policy",
    "elections", "global-elections", "world-elections",
    "foreign-policy", "diplomacy-ceasefire", "military-strikes",
    "iran", "russia", "china", "ukraine", "israel", "middle-east",
    "fed", "fed-rates", "tariffs", "sanctions", "oil", "commodities",
]
EXCLUDE_TAGS = [
    "sports", "soccer", "nba", "nfl", "nhl", "mlb", "basketball", "baseball",
    "football", "mma", "games", "epl", "crypto", "pop-culture", "tweets-markets",
]

# ---- fixed values: words that name a country in a free-text query --------------
COUNTRY_WORDS = {
    "russia": "RUS", "russian": "RUS", "moscow": "RUS", "kremlin": "RUS",
    "china": "CHN", "chinese": "CHN", "beijing": "CHN",
    "iran": "IRN", "iranian": "IRN", "tehran": "IRN",
    "ukraine": "UKR", "ukrainian": "UKR", "kyiv": "UKR",
    "israel": "ISR", "israeli": "ISR",
    "saudi": "SAU", "saudi arabia": "SAU", "riyadh": "SAU",
    "brazil": "BRA", "brazilian": "BRA",
    "japan": "JPN", "japanese": "JPN",
    "germany": "DEU", "german": "DEU",
    "taiwan": "TWN", "taiwanese": "TWN",
    "korea": "KOR", "korean": "KOR",
    "india": "IND", "indian": "IND",
    "uk": "GBR", "britain": "GBR", "british": "GBR",
    "venezuela": "VEN",
    "nigeria": "NGA",
}
DEFAULT_SYMBOLS = ["SPY", "GC=F", "CL=F", "^VIX"]
GLOBAL_SYMBOLS = ["SPY", "CL=F", "GC=F", "^VIX", "TLT", "EEM"]
KEY_SYMBOLS = ["CL=F", "GC=F", "SPY", "QQQ", "^VIX", "EURUSD=X", "TLT", "EEM"]

# ---- data: FIPS 10-4 codes of countries and territories ----
# ``spark.eventlens.fips.path`` (or the ``path`` argument) names another CSV with columns fips,iso.
FIPS_ISO = dict(
    line.split(",") for line in resources.files("eventlens").joinpath("data/fips_to_iso.csv").read_text("utf-8").split()[1:]
)
FIPS_PATH_CONF = "spark.eventlens.fips.path"

VIOLENT_ROOTS = EVENT_GROUPS["violent_conflict"]
CONFLICT_ROOTS = EVENT_GROUPS["material_conflict"] + EVENT_GROUPS["violent_conflict"]
COOPERATION_ROOTS = EVENT_GROUPS["verbal_cooperation"] + EVENT_GROUPS["material_cooperation"]
# The daily feature layer counts a narrower set as cooperation.
FEATURE_COOPERATION_ROOTS = ["03", "04", "05", "06"]
CONFLICT_GROUPS = ["material_conflict", "violent_conflict"]
COOPERATION_GROUPS = ["verbal_cooperation", "material_cooperation"]
# Most severe first; decides ties between equally frequent groups.
GROUP_SEVERITY = [
    "violent_conflict", "material_conflict", "verbal_conflict",
    "material_cooperation", "verbal_cooperation",
]


def all_symbols() -> list[str]:
    return [s for names in SYMBOLS.values() for s in names]


def _small(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Constant string rows as a local relation, whose exact size the optimizer knows."""
    quoted = [", ".join("'" + v.replace("'", "\\'") + "'" for v in row) for row in rows]
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(f'({q})' for q in quoted)} AS constants({names})"
    )


def event_group_map(spark: SparkSession) -> DataFrame:
    return _small(
        spark,
        [(code, group) for group, codes in EVENT_GROUPS.items() for code in codes],
        "code, event_group",
    )


def cameo_label_map(spark: SparkSession) -> DataFrame:
    return _small(spark, list(CAMEO_LABELS.items()), "code, cameo_label")


def code_map(spark: SparkSession) -> DataFrame:
    """Group and label of each root code in one table."""
    group_of = {code: group for group, codes in EVENT_GROUPS.items() for code in codes}
    return _small(
        spark,
        [(code, group_of[code], label) for code, label in CAMEO_LABELS.items()],
        "code, event_group, cameo_label",
    )


def country_asset_map(spark: SparkSession) -> DataFrame:
    return _small(
        spark,
        [(c, s) for c, symbols in COUNTRY_ASSETS.items() for s in symbols],
        "country_code, symbol",
    )


def symbol_country_map(spark: SparkSession) -> DataFrame:
    return _small(
        spark,
        [(s, c) for s, countries in SYMBOL_COUNTRIES.items() for c in countries],
        "symbol, country_code",
    )


def source_normalization(spark: SparkSession) -> DataFrame:
    return _small(spark, list(SOURCE_NAMES.items()), "raw, canonical")


def series_config(spark: SparkSession) -> DataFrame:
    return _small(spark, list(SERIES_NAMES.items()), "series_id, series_name")


def fips_to_iso_map(spark: SparkSession, path: str | None = None) -> DataFrame:
    """FIPS -> ISO-3 table: the CSV the caller names, else the one of the package."""
    path = path or spark.conf.get(FIPS_PATH_CONF, None)
    if path:
        return spark.read.csv(path, header=True, schema="fips string, iso string")
    return _small(spark, list(FIPS_ISO.items()), "fips, iso")


def load_seeds(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    """The five seed tables, from CSV files in ``folder`` or from the maps above.

    Schemas are explicit: an inferred ``code`` would turn 01 into 1 and miss every join.
    """
    if folder is None:
        return {
            "event_group_map": event_group_map(spark),
            "cameo_label_map": cameo_label_map(spark),
            "fips_to_iso": fips_to_iso_map(spark),
            "country_asset_map": country_asset_map(spark),
            "source_normalization": source_normalization(spark),
        }
    schemas = {
        "event_group_map": "code string, event_group string",
        "cameo_label_map": "code string, cameo_label string",
        "fips_to_iso": "fips string, iso string",
        "country_asset_map": "country_code string, symbol string",
        "source_normalization": "raw string, canonical string",
    }
    return {
        name: spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema)
        for name, schema in schemas.items()
    }


def symbol_catalog(spark: SparkSession) -> DataFrame:
    """Flat catalog: (symbol, name, category)."""
    return _small(
        spark,
        [(s, n, c) for c, names in SYMBOLS.items() for s, n in names.items()],
        "symbol, name, category",
    )


def symbol_catalog_nested(catalog: DataFrame) -> DataFrame:
    """One row per category with its (symbol, name) list."""
    return catalog.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("symbol", "name"))).alias("symbols"),
        F.count(F.lit(1)).alias("total"),
    )


def symbol_availability(catalog: DataFrame, market: DataFrame) -> DataFrame:
    """Catalog rows with the span and size of the prices held for each symbol."""
    held = market.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return catalog.join(held, "symbol", "left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0))
    )


def countries_of_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol) -> (symbol, sensitive_to_countries) with an empty list where none."""
    links = (
        symbol_country_map(symbols.sparkSession)
        .groupBy("symbol")
        .agg(F.sort_array(F.collect_list("country_code")).alias("sensitive_to_countries"))
    )
    return symbols.join(F.broadcast(links), "symbol", "left").withColumn(
        "sensitive_to_countries",
        F.coalesce("sensitive_to_countries", F.array().cast("array<string>")),
    )


def assets_of_countries(countries: DataFrame) -> DataFrame:
    """(country_code) -> (country_code, assets)."""
    links = (
        country_asset_map(countries.sparkSession)
        .groupBy("country_code")
        .agg(F.sort_array(F.collect_list("symbol")).alias("assets"))
    )
    return countries.join(F.broadcast(links), "country_code", "left").withColumn(
        "assets", F.coalesce("assets", F.array().cast("array<string>"))
    )
