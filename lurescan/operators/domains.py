"""Domain features from snapshot tables instead of live lookups.

Snapshots hold one row per domain. They are combined into one table per domain, which the facts join
once; a domain with many pages is spread over several tasks. ``lookup_status = 'timeout'`` in a
snapshot gives the feature's timeout value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.operators.tables import join_split_hot

DAY_SECONDS = 86_400

# --- fixed values: result of a lookup that ran into its deadline ---------------------------------
TIMEOUT_VALUES = {
    "whois_reg_domain": 0, "domain_reg_len": 0, "domain_age": 0, "dns_record": 1,
    "google_index": 1, "page_rank": -1, "global_rank": -1,
}


def known_dates(dates: Column) -> Column:
    return F.filter(dates, lambda d: d.isNotNull())


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between two instants, rounded down (also below zero)."""
    seconds = (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000 * DAY_SECONDS)
    return F.floor(seconds).cast("int")


def _status(snapshot: DataFrame) -> Column:
    return F.col("lookup_status") if "lookup_status" in snapshot.columns else F.lit("ok")


def registry_record(registry: DataFrame) -> DataFrame:
    """What the registry says of a domain; ``registry`` has domain, domain_names, creation_dates and
    expiration_dates (arrays; one date is an array of one), all in UTC, and optionally lookup_status."""
    return registry.select(
        "domain",
        F.col("domain_names").alias("_names"),
        F.array_min(known_dates(F.col("creation_dates"))).alias("_created"),
        F.array_min(known_dates(F.col("expiration_dates"))).alias("_expires"),
        _status(registry).alias("_registry_status"),
        F.lit(True).alias("_known"),
    )


def registry_values(as_of: Column) -> dict[str, Column]:
    """whois_reg_domain, domain_reg_len and domain_age from a registry record."""
    unknown, late = F.col("_known").isNull(), F.col("_registry_status") == "timeout"
    age = whole_days(as_of, F.col("_created"))
    left = whole_days(F.col("_expires"), as_of)
    named = F.exists("_names", lambda n: F.col("domain").contains(F.lower(n)))

    def feature(name: str, without_record: int, value: Column) -> Column:
        return (
            F.when(unknown, without_record).when(late, TIMEOUT_VALUES[name]).otherwise(value)
        ).cast("int")

    return {
        "whois_reg_domain": feature(
            "whois_reg_domain", 1, F.when(F.coalesce(named, F.lit(False)), 0).otherwise(1)
        ),
        "domain_reg_len": feature(
            "domain_reg_len", -1, F.greatest(F.coalesce(left, F.lit(0)), F.lit(0))
        ),
        "domain_age": feature("domain_age", -1, F.when(age >= 0, age).otherwise(-2)),
    }


def lookup_record(snapshot: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A looked-up value and its status under names of their own."""
    return snapshot.select(key, F.col(value).alias(f"_{name}"), _status(snapshot).alias(f"_{name}_status"))


def lookup_values(name: str, features: dict[str, Column]) -> dict[str, Column]:
    """The timeout rule applied to features of a looked-up value."""
    late = F.col(f"_{name}_status") == "timeout"
    return {
        feature: F.when(late, TIMEOUT_VALUES.get(feature, 0)).otherwise(column).cast("int")
        for feature, column in features.items()
    }


def server_values() -> dict[str, Column]:
    """dns_record: 0 with a name server, 1 without."""
    return lookup_values("servers", {"dns_record": F.when(F.col("_servers") > 0, 0).otherwise(1)})


def index_values() -> dict[str, Column]:
    """google_index per URL: 0 indexed, -1 blocked, 1 otherwise."""
    status = F.col("_index")
    value = F.when(status == "indexed", 0).when(status == "blocked", -1).otherwise(1)
    return lookup_values("index", {"google_index": value})


def rank_values() -> dict[str, Column]:
    """page_rank and global_rank (-1 if absent) and web_traffic (0 if absent)."""
    rank = F.col("_rank")
    return lookup_values("rank", {
        "page_rank": F.coalesce(rank, F.lit(-1)),
        "global_rank": F.coalesce(rank, F.lit(-1)),
        "web_traffic": F.coalesce(rank, F.lit(0)),
    })


def index_record(index_status: DataFrame) -> DataFrame:
    return lookup_record(index_status, "url", "status", "index")


def domain_table(registry: DataFrame, dns_ns: DataFrame, domain_rank: DataFrame, *more: DataFrame) -> DataFrame:
    """One row per domain with all that the snapshots know of it.

    The records are put under each other and combined by one aggregate instead of a chain of joins. A
    snapshot with several records of a domain gives one of them whole, chosen by a hash of the record.
    ``more`` are further tables with a domain and columns of their own.
    """
    records = [
        registry_record(registry),
        lookup_record(dns_ns, "domain", "ns_count", "servers"),
        lookup_record(domain_rank, "domain", "rank", "rank"),
        *more,
    ]
    columns = [[c for c in record.columns if c != "domain"] for record in records]
    whole = [r.select("domain", F.struct(*c).alias(f"_r{i}")) for i, (r, c) in enumerate(zip(records, columns))]
    stacked = whole[0]
    for record in whole[1:]:
        stacked = stacked.unionByName(record, allowMissingColumns=True)
    names = [f"_r{i}" for i in range(len(records))]
    chosen = [F.max_by(r, F.when(F.col(r).isNotNull(), F.xxhash64(r))).alias(r) for r in names]
    combined = stacked.filter("domain IS NOT NULL").groupBy("domain").agg(*chosen)
    return combined.select("domain", *[F.col(f"{r}.{c}") for r, listed in zip(names, columns) for c in listed])


def domains_to_look_up(df: DataFrame, *snapshots: DataFrame) -> DataFrame:
    """Distinct domains that no snapshot holds yet."""
    todo = df.select("domain").distinct()
    for snapshot in snapshots:
        todo = todo.join(snapshot.select("domain").distinct(), "domain", "left_anti")
    return todo


def domain_features(
    df: DataFrame,
    registry: DataFrame,
    dns_ns: DataFrame,
    index_status: DataFrame,
    domain_rank: DataFrame,
    as_of: Column,
) -> DataFrame:
    """All domain columns for rows with ``url`` and ``domain``: one join by domain, one by url."""
    by_domain = join_split_hot(df, domain_table(registry, dns_ns, domain_rank), "domain")
    joined = join_split_hot(by_domain, index_record(index_status), "url")
    return joined.select("*", *[c.alias(k) for k, c in all_values(as_of).items()]).drop(*LOOKED_UP)


LOOKED_UP = (
    "_names _created _expires _registry_status _known _servers _servers_status _index _index_status _rank _rank_status"
).split()


def all_values(as_of: Column) -> dict[str, Column]:
    return registry_values(as_of) | server_values() | index_values() | rank_values()
