"""Names that readers see: devices, endpoints, counts, paths and links, nothing private in them by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col, mask_ip

# What a reader sees for nodes without a name of their own, and in place of a private value.
EVERYONE, ROUTER, NOBODY, UNKNOWN = "Everyone (broadcast)", "Router / Gateway", "Unidentified device", "Unknown"
REDACTED = "[REDACTED]"
#: Pages that a link may lead to.
PAGES = ("activity", "captures", "observations")


def display_name(name: Column | str, role: Column | str, mac: Column | str) -> Column:
    """A device's own name, else its role, else the end of its MAC."""
    own = F.nullif(col(name), F.lit(""))
    tag = F.when(F.coalesce(col(mac), F.lit("")) != "", F.concat(F.lit("Device …"), F.right(col(mac), F.lit(5))))
    return F.coalesce(own, F.when(col(role) == "gateway", ROUTER).when(col(role) == "broadcast", EVERYONE), tag, F.lit(NOBODY))


def inventory_name(device: Column | str, hostnames: Column | str) -> Column:
    """The name given in an inventory, else the first host name; null without either."""
    first = F.split(col(hostnames), r"[,;\s]+")[0]
    return F.coalesce(F.nullif(F.trim(col(device)), F.lit("")), F.nullif(F.trim(first), F.lit("")))


def node_labels(nodes: DataFrame, devices: DataFrame, endpoints: DataFrame, reveal: bool = False) -> DataFrame:
    """nodes (node, ...) with label; devices: (id, name, role, mac), endpoints: (id, ip, is_aggregate), ids unique in each.

    Two equi-joins, so any number of nodes; "broadcast" is everyone.
    """
    d = devices.select(F.col("id").alias("node"), display_name("name", "role", "mac").alias("_device"))
    shown = F.col("ip") if reveal else mask_ip("ip")
    e = endpoints.select(F.col("id").alias("node"), F.when(F.col("is_aggregate"), F.concat(F.lit("Other internet endpoints "), "ip")).otherwise(shown).alias("_end"))
    out = nodes.join(d, "node", "left").join(e, "node", "left")
    label = F.when(F.col("node") == "broadcast", EVERYONE).otherwise(F.coalesce("_device", "_end", F.lit(UNKNOWN)))
    return out.withColumn("label", label).drop("_device", "_end")


def plural(word: str, count: Column | str) -> Column:
    return F.when(col(count) == 1, word).otherwise(f"{word}s")


def count_noun(count: Column | str, word: str) -> Column:
    """A count with thousands parted, and its word."""
    return F.concat(F.format_number(col(count), 0), F.lit(" "), plural(word, count))


def was_were(count: Column | str) -> Column:
    return F.when(col(count) == 1, "was").otherwise("were")


def file_date(at: Column | str) -> Column:
    """The day of a timestamp for a file's name, in the session's time zone."""
    return F.date_format(col(at), "yyyy-MM-dd")


def safe_link(href: Column | str) -> Column:
    """A link to one of PAGES as it is, any other as #."""
    page = rf"^/(?:{'|'.join(PAGES)})(?:[/?#][A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*)?\z"
    return F.when(col(href).rlike(page), col(href)).otherwise("#")


def client_path(path: Column | str, root: str) -> Column:
    """A path below root as seen from it, any other as its last part; . and .. are no parts of either."""
    plain = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), "/+", "/")
    below = root.rstrip("/") + "/"
    return F.when(plain.startswith(below) & ~plain.rlike(r"(^|/)\.\.?(/|$)"), F.substr(plain, F.lit(len(below) + 1))).otherwise(F.element_at(F.split(F.rtrim(plain, F.lit("/")), "/"), -1))


def client_paths(groups: Column | str, root: str) -> Column:
    """The same for a map of lists of paths."""
    return F.transform_values(col(groups), lambda _, paths: F.transform(paths, lambda p: client_path(p, root)))


def hidden(rows: DataFrame, always: tuple[str, ...] = ("ip",), filled: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """rows with private columns hidden: some always, others where they hold anything; those that are not there don't matter."""
    some = {c: F.lit(REDACTED) for c in always if c in rows.columns}
    return rows.withColumns(some | {c: F.when(F.coalesce(F.col(c), F.lit("")) != "", REDACTED) for c in filled if c in rows.columns})
