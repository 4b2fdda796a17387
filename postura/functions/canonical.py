"""Canonical JSON of any depth, and the ids that are hashed from it.

A VARIANT keeps the names of an object in the order of their UTF-16 units and
its numbers without needless zeros, so writing one out gives one text for all
spellings of a value: no walk over its parts is needed.

Other than a browser would, whole numbers beyond 2**53 keep all their digits,
numbers with an exponent are written as 1.5E30, escapes have capital digits
(\\u001F), and an object that names a field twice is no value: its text is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col, identity_text

_TEXT = r'("(?:[^"\\]|\\.)*+")'


def canonical(value: Column | str) -> Column:
    """Canonical text of a JSON text; null if it is none."""
    plain = F.to_json(F.try_parse_json(col(value)))
    return F.regexp_replace(plain, _TEXT + r"|(-?\d++)\.0(?![\dE])", "$1$2")


def canonical_of(value: Column) -> Column:
    """Canonical text of a struct, array or map, nulls kept."""
    return canonical(F.to_json(value, {"ignoreNullFields": "false"}))


def content_hash(value: Column | str) -> Column:
    """SHA-256 of a JSON text in canonical form."""
    return F.sha2(canonical(value), 256)


def event_id(seed: Column) -> Column:
    """Id of a change event from what it says."""
    return F.concat(F.lit("chg-"), F.substring(F.sha2(canonical_of(seed), 256), 1, 16))


def response_id(site: Column | str, kind: Column | str, identity_hash: Column | str) -> Column:
    """Id of a user's response for a device of a site."""
    seed = F.concat_ws("|", identity_text(site), col(kind), col(identity_hash))
    return F.concat(F.lit("dresp_"), F.substring(F.sha2(seed, 256), 1, 32))


def id_part(text: Column | str, size: int, allowed: str = "a-z0-9") -> Column:
    """Lower-cased, anything else than allowed as one hyphen, none at either end before it is cut."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(col(text)), f"[^{allowed}]", "-"), "-+", "-")
    return F.substring(F.regexp_replace(plain, "^-|-$", ""), 1, size)


def registry_id(observed_at: Column | str, site_id: Column | str, network: Column | str, hashed: Column | str) -> Column:
    """obs_date_site_hash; observed_at is an ISO text."""
    day = F.coalesce(F.replace(F.substring(col(observed_at), 1, 10), F.lit("-"), F.lit("")), F.lit("undated"))
    site = F.coalesce(F.nullif(col(site_id), F.lit("")), col(network))
    return F.concat_ws("_", F.lit("obs"), day, F.substring(F.coalesce(F.nullif(id_part(site, 64, "a-z0-9_-"), F.lit("")), F.lit("site")), 1, 32), col(hashed))


def combined_hash(hashes: Column | str) -> Column:
    """Hash of a set of files from their hashes, which stand in order of path; empty for none."""
    return F.when(F.size(col(hashes)) > 0, F.sha2(F.array_join(col(hashes), ":"), 256)).otherwise(F.lit(""))


def run_uid(network: Column | str, at: Column | str, run_type: Column | str, hashed: Column | str) -> Column:
    """network_time_type_hash; at is a UTC timestamp.  Without files a hash of the rest stands in, so the id can be built again."""
    named = lambda c: id_part(F.coalesce(F.nullif(col(c), F.lit("")), F.lit("unknown")), 32)
    when = F.coalesce(F.date_format(col(at), "yyyy-MM-dd'T'HH-mm-ss"), F.lit("notime"))
    start = F.concat_ws("_", named(network), when, named(run_type))
    return F.concat_ws("_", start, F.substring(F.coalesce(F.nullif(col(hashed), F.lit("")), F.sha2(start, 256)), 1, 12))
