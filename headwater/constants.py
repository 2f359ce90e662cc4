"""Fixed values. They must stay as they are for results to be comparable."""

# Forecast horizons in days, and the rain windows in rows.
HORIZONS = (1, 2, 3, 4, 5, 6, 7)
BACKWARD_WINDOWS = (1, 3, 7, 14, 30)
FORWARD_WINDOWS = (3, 7)
LEADS = (1, 2, 3, 4, 5, 6, 7)

# Alert forecasts.
ALERT_HORIZONS = (1, 2, 3)
ALERT_FEATURES = ("watch_today", "watch_3d", "watch_7d", "streak", "national_share")
ALERT_MIN_DAYS = 30
ALERT_MIN_EVENTS = 10

# Scoreboard.
MIN_SCORED = 200
CURVE_WINDOW = 20
CURVE_MIN_BACKTEST = 5
CURVE_MIN_LIVE = 3

# Publication.
HISTORY_DAYS = 60
STALE_AFTER_DAYS = 2

# Scaling.
Z_CLIP = 5.0
FLAT_SD = 1e-6
SEARCH_SCALE_MIN_N = 5
SEARCH_SCALE_FLOOR = 1e-3

# Search protocol.
SPLIT_DATE = "2025-11-01"
RATIO_CAP = 3.0
SHRINKS = (1.0, 0.8, 0.6, 0.4, 0.2)
BLENDS = (0.3, 0.6, 1.0, 2.0)
REFINE_FAMILIES = 6
BLEND_FAMILIES = 4

# Forest of the deployed model.
FOREST_TREES = 50
FOREST_SEED = 7

# Labels that the search's neighbours remember in pools over many entities.

# Catchment sampling.
CATCHMENT_RADIUS_KM = 12.0
KM_PER_DEGREE = 111.32

# Incremental reads.
WEATHER_TRAILING_DAYS = 30
WEATHER_ARCHIVE_LAG_DAYS = 6
FORECAST_TRAILING_DAYS = 10
FORECAST_CHUNK_DAYS = 180

# Text markers of a missing number.
MISSING_MARKERS = ("", "-", "--", "N/A", "n/a")

# Weather variables of the daily payload.
DAILY_VARIABLES = (
    "precipitation_sum",
    "temperature_2m_mean",
    "temperature_2m_max",
    "relative_humidity_2m_mean",
    "et0_fao_evapotranspiration",
)

# Column order of the 13-column bulletin table.
BULLETIN_COLUMNS = (
    "dam", "when", "rwl_m", "dev_hour", "dev_24h_m", "nhwl_m", "dev_nhwl_m",
    "rule_curve_m", "dev_rule_curve_m", "gates", "gate_opening_m",
    "inflow_cms", "outflow_cms",
)

# Named feature sets.
BASE_FEATURES = (
    "rwl_m", "dev_24h_m", "dev_rule_curve_m", "dev_nhwl_m",
    "rain_1d", "rain_3d", "rain_7d", "rain_14d", "rain_30d",
    "rain_next_3d", "rain_next_7d",
    "temperature_2m_mean", "et0_fao_evapotranspiration",
    "doy_sin", "doy_cos",
)
LEAN_FEATURES = (
    "dev_24h_m", "dev_rule_curve_m", "rain_1d", "rain_3d", "rain_7d",
    "rain_next_3d", "rain_next_7d", "doy_sin", "doy_cos",
)
TINY_FEATURES = ("dev_24h_m", "rain_3d", "rain_next_3d", "rain_next_7d")
WIDE_FEATURES = BASE_FEATURES + (
    "inflow_cms", "outflow_cms", "basins_on_watch", "relative_humidity_2m_mean",
)
FEATURE_SETS = {
    "base": BASE_FEATURES,
    "lean": LEAN_FEATURES,
    "tiny": TINY_FEATURES,
    "wide": WIDE_FEATURES,
}

# Name variants seen on the bulletin, lower case, and their canonical names.
ALIASES = {
    "magat dam": "Magat",
    "magat": "Magat",
    "angat dam": "Angat",
    "ipo dam": "Ipo",
    "la mesa dam": "La Mesa",
    "ambuklao dam": "Ambuklao",
    "binga dam": "Binga",
    "san roque dam": "San Roque",
    "pantabangan dam": "Pantabangan",
    "caliraya dam": "Caliraya",
}

# Reservoirs: name, latitude, longitude, river basin.
REGISTRY = (
    ("Angat", 14.91139, 121.16500, "Angat"),
    ("Ipo", 14.87500, 121.06222, "Angat"),
    ("La Mesa", 14.71372, 121.07316, "Angat"),
    ("Ambuklao", 16.46111, 120.74389, "Agno"),
    ("Binga", 16.39611, 120.72667, "Agno"),
    ("San Roque", 16.14600, 120.68400, "Agno"),
    ("Pantabangan", 15.81833, 121.10944, "Pampanga"),
    ("Magat", 16.83333, 121.45056, "Cagayan"),
    ("Caliraya", 14.28830, 121.50140, "Pasig-Laguna"),
)

# Risk labels and what each one tells a reader.
NORMAL = "Normal"
WATCH = "Watch"
SPILL_WATCH = "Spill Watch"
NOT_RATED = "Not rated"
RISK_NOTES = {
    NORMAL: "Forecast level stays below the operating rule curve.",
    WATCH: "Forecast level crosses the rule curve within the next 7 days.",
    SPILL_WATCH: "Forecast level reaches the normal high water level within 7 days; "
                 "a gate release becomes likely.",
    NOT_RATED: "No authority publishes a reference elevation for this dam.",
}
DISCLAIMER = (
    "This is a forecast for study and warns of nothing officially. "
    "Follow your weather service and the disaster office of your area."
)
