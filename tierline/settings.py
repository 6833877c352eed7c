"""Fixed values the results depend on.

These are behavioural constants of the pipeline being rebuilt (thresholds,
defaults, contract field lists, zone names). They are stated here once, in
natural order, and every operator takes them as overridable parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: thresholds and defaults -------------------------------
POLL_INTERVAL_MINUTES = 5          # expected arrival cadence of a feed
DEFAULT_ROW_LIMIT = 10             # first-N cap per source fetch
RETENTION_DAYS = 90                # age-based bronze retention
LOOKBACK_HOURS = 48                # snapshot min/max range
MIN_DATA_POINTS = 5                # anomaly baseline needs this many points
Z_ELEVATED = 1.0                   # |z| at or above: yellow
Z_HIGH = 2.0                       # |z| at or above: red
Z_CRITICAL = 3.0                   # |z| at or above: critical
PRICE_NORMAL_MAX = 50.0            # price band: below is "normal"
PRICE_ELEVATED_MAX = 100.0         # price band: below is "off", else "inverse"
FRESHNESS_WARNING_MINUTES = 15
FRESHNESS_ERROR_MINUTES = 60
SIZE_WARNING_GB = 1.0              # stored size health check
SIZE_ERROR_GB = 2.0
BRONZE_WARNING_GB = 4.0            # size-based retention
BRONZE_CAP_GB = 5.0
HISTOGRAM_BINS = 20
MIX_DISPLAY_MIN = 1.0              # components at or below are not shown
UNKNOWN_MARKET = "UNKNOWN"
SYNTHETIC_MARKET = "SYNTHETIC"
ARCHIVE_LISTING_LIMIT = 10

# --- fixed values: feed column names -------------------------------------
# Raw price feed: source column -> normalized column.
PRICE_COLUMN_MAP = {
    "Interval Start": "interval_start",
    "Interval End": "interval_end",
    "LMP": "price",
    "Location": "location",
    "Location Type": "location_type",
    "Market": "market",
    "time": "interval_start",
}
# Raw mix feed: source column -> normalized column.
MIX_COLUMN_MAP = {
    "Time": "time",
    "Natural Gas": "natural_gas",
    "Wind": "wind",
    "Solar": "solar",
    "Coal": "coal",
    "Nuclear": "nuclear",
    "Other": "other",
}
PRICE_SILVER_COLUMNS = ["entity", "interval_start", "location", "location_type", "price", "market"]
MIX_COMPONENTS = ["natural_gas", "wind", "solar", "coal", "nuclear", "other"]
MIX_SHARE_COMPONENTS = ["wind", "solar"]

# --- fixed values: entity time zones (unknown entities fall back to UTC) --
ENTITY_TIME_ZONES = {
    "ERCOT": "America/Chicago",
    "CAISO": "America/Los_Angeles",
    "PJM": "America/New_York",
    "MISO": "America/Chicago",
    "SPP": "America/Chicago",
    "NYISO": "America/New_York",
    "ISONE": "America/New_York",
    "IESO": "America/Toronto",
    "AESO": "America/Edmonton",
}

# --- fixed values: zone abbreviations: zone -> (standard UTC offset in minutes,
# standard-time abbreviation, daylight-time abbreviation) ------------------
ZONE_ABBREVIATIONS = {
    "America/Chicago": (-360, "CST", "CDT"),
    "America/Los_Angeles": (-480, "PST", "PDT"),
    "America/New_York": (-300, "EST", "EDT"),
    "America/Toronto": (-300, "EST", "EDT"),
    "America/Edmonton": (-420, "MST", "MDT"),
    "Europe/Berlin": (60, "CET", "CEST"),
    "UTC": (0, "UTC", "UTC"),
}
WINDOW_LABEL_PREFIX = "Window: "

# --- fixed values: report texts (printf-style; Spark and the oracle share them)
MSG_FRESH_NONE = "No data ingested yet — run the pipeline"
MSG_FRESH_STALE = "No new data for %.1f minutes"
MSG_FRESH_OK = "Last ingest %.1f minutes ago"
MSG_GAP_NONE = "No data in database yet — first run."
MSG_GAP_FOUND = "Gap detected: %d missed intervals (%.1f minutes)"
MSG_GAP_OK = "No gap detected. Last ingested %.1f minutes ago."
MSG_LAYERS_EMPTY = "Empty layers: "
MSG_LAYERS_OK = "All layers populated — %s: %d rows"
MSG_SPACING_NONE = "No gold data available for gap analysis"
MSG_SPACING_FOUND = "%d entities with gaps"
MSG_SPACING_OK = "No significant data gaps detected"
MSG_SIZE_ERROR = "Size critical: %.2fGB — consider aging off data"
MSG_SIZE_WARNING = "Size elevated: %.2fGB"
MSG_SIZE_OK = "Size: %.1fMB"
MSG_SCHEMA_OK = "All expected columns present"
MSG_SCHEMA_MISSING = "Missing columns: "
MSG_FIELD_PRESENT = "Field '%s' is present"
MSG_OPTIONAL_MISSING = "Optional field '%s' is missing from DataFrame"
MSG_REQUIRED_MISSING = "Required field '%s' is missing from DataFrame"
MSG_REQUIRED_NULLS = "Field '%s' has %d null values but is required non-null"
MSG_WRONG_TYPE = "Field '%s' expected type '%s'"
MSG_BAD_VALUES = "Field '%s' has %d values not of type '%s'"
MSG_UNKNOWN_TYPE = "Unknown type '%s' in contract for field '%s'"
MSG_Z_SHORT = "insufficient data (need %d points)"
MSG_Z_SCORE = "z_score=%.2f"
MSG_Z_FLAT = "std=0"
MSG_Z_NO_VALUE = "no current price"

# --- fixed values: health check -> domain ---------------------------------
CHECK_DOMAINS = {
    "connectivity": "System",
    "dataset_size": "Storage",
    "schema": "System",
    "last_ingest": "Data Freshness",
    "row_counts": "Data Quality",
    "data_gap": "Data Quality",
}


@dataclass(frozen=True)
class MixSpec:
    """Names of the mix components and which of them form the share."""

    components: tuple[str, ...] = tuple(MIX_COMPONENTS)
    share_of: tuple[str, ...] = tuple(MIX_SHARE_COMPONENTS)
    time_col: str = "time"
    share_col: str = "share_pct"

    def silver_columns(self) -> list[str]:
        return ["entity", self.time_col, *self.components, self.share_col]


@dataclass(frozen=True)
class Thresholds:
    min_points: int = MIN_DATA_POINTS
    z_elevated: float = Z_ELEVATED
    z_high: float = Z_HIGH
    z_critical: float = Z_CRITICAL


DEFAULT_MIX = MixSpec()
DEFAULT_THRESHOLDS = Thresholds()


@dataclass(frozen=True)
class Field:
    name: str
    type: str          # string | float | int | datetime | bool
    nullable: bool = True


@dataclass(frozen=True)
class Contract:
    """What a normalized dataset must look like before it may enter silver."""

    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def required(self) -> list[str]:
        return [f.name for f in self.fields if not f.nullable]


# --- fixed values: contracts ---------------------------------------------
PRICE_CONTRACT = Contract("prices", (
    Field("entity", "string", False),
    Field("interval_start", "datetime", False),
    Field("price", "float", False),
    Field("location", "string", True),
    Field("location_type", "string", True),
    Field("market", "string", True),
))
# The mix contract lists the entity, the time and five components; the sixth
# component and the share are silver columns that are not checked.
MIX_CONTRACT = Contract("mix", (
    Field("entity", "string", False),
    Field("time", "datetime", False),
    Field("natural_gas", "float", True),
    Field("wind", "float", True),
    Field("solar", "float", True),
    Field("coal", "float", True),
    Field("nuclear", "float", True),
))
CONTRACTS = {"prices": PRICE_CONTRACT, "mix": MIX_CONTRACT}


def load_contract(source: str, dataset: str, registry: dict | None = None) -> Contract:
    """Look up a contract: unknown source -> FileNotFoundError, unknown dataset -> KeyError."""
    sources = registry if registry is not None else {"feeds": CONTRACTS}
    if source not in sources:
        raise FileNotFoundError(f"Contract not found: {source}")
    datasets = sources[source]
    if dataset not in datasets:
        raise KeyError(f"Dataset '{dataset}' not found in contract '{source}'")
    return datasets[dataset]
