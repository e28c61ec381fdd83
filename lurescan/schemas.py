"""Fixed schemas of the inputs."""

from pyspark.sql import types as T

from lurescan.functions import constants as C

URL_LIST = T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.IntegerType())])

SKIPPED = "global_idx long, url string, label string, reason string"
DOMAIN_REGISTRY = (
    "domain string, domain_names array<string>, creation_dates array<timestamp>, "
    "expiration_dates array<timestamp>, lookup_status string"
)
DNS_SNAPSHOT = "domain string, ip string"
DNS_NS = "domain string, ns_count int, lookup_status string"
DOMAIN_RANK = "domain string, rank int, lookup_status string"
INDEX_STATUS = "url string, status string, lookup_status string"
PREDICT_REQUEST = "request_id long, url string, model string, threshold double, scan_mode string"
VISITS = (
    "request_id long, tab_id long, ts_us long, url string, model string, threshold double, "
    "scan_mode string"
)
ATTRIBUTIONS = "sample_id long, pos int, token string, class_idx int, value double"
BASES = "sample_id long, class_idx int, base double"


def crawl_record() -> T.StructType:
    """One JSON object of the crawler: page features under its own names, and the crawl facts."""
    features = [C.CRAWL_FIELD_NAMES.get(c, c) for c in C.PAGE_FEATURE_COLUMNS if c != "is_alive"]
    viewport = T.StructType(
        [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
    )
    texts = [
        "url", "original_url", "final_url", "title", "error_reason", "extraction_timestamp",
        "user_agent", "screenshot_path",
    ]
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in texts]
        + [T.StructField(c, T.IntegerType()) for c in ("is_alive", "status_code")]
        + [T.StructField("redirect_detected", T.BooleanType()), T.StructField("viewport", viewport)]
        + [T.StructField(c, T.DoubleType()) for c in features]
    )
