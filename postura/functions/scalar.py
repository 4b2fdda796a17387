"""Column helpers: identifiers, text, time and formatting, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import LEVELS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mac(c: Column | str, invalid: str = "null", upper: bool = True) -> Column:
    """Twelve hex digits in colon pairs; another text is kept or null."""
    digits = F.regexp_replace(col(c), "[^0-9A-Fa-f]", "")
    pairs = F.regexp_replace(digits, "(..)(?=.)", "$1:")
    good = F.upper(pairs) if upper else F.lower(pairs)
    return F.when(F.length(digits) == 12, good).otherwise(col(c) if invalid == "keep" else F.lit(None))


def identity_text(c: Column | str) -> Column:
    """Trimmed, lower-cased, runs of white space as one space."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def header_name(c: Column | str) -> Column:
    """Letters and digits of a header, lower-cased."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def is_ipv4(c: Column | str) -> Column:
    """Strict dotted quad."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.coalesce(col(c).rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


def octet(c: Column | str, k: int) -> Column:
    return F.try_element_at(F.split(col(c), r"\."), F.lit(k)).try_cast("int")


def is_local(c: Column | str) -> Column:
    """Private, loopback and link-local addresses; IPv6 by text prefix."""
    ip = F.lower(col(c))
    a, b = octet(ip, 1), octet(ip, 2)
    four = (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    six = ip.isin("::1", "0:0:0:0:0:0:0:1") | ip.rlike("^fe[89ab]") | ip.startswith("fc") | ip.startswith("fd")
    return F.coalesce(F.when(is_ipv4(ip), four).otherwise(six), F.lit(False))


def is_multicast(c: Column | str) -> Column:
    ip = F.lower(col(c))
    return F.coalesce(F.when(is_ipv4(ip), octet(ip, 1).between(224, 239) | (ip == "255.255.255.255")).otherwise(ip.startswith("ff")), F.lit(False))


def ip_order(c: Column | str) -> Column:
    """Sort key of an address: its octets, other texts last."""
    return F.when(is_ipv4(c), F.transform(F.split(col(c), r"\."), lambda x: x.cast("int"))).otherwise(F.array(*[F.lit(999)] * 4))


def mask_ip(c: Column | str) -> Column:
    """First two octets, or the first part of an address with colons; another text as it is."""
    parts, at = F.split(col(c), r"\."), F.instr(col(c), ":")
    four = F.when(F.size(parts) == 4, F.concat_ws(".", parts[0], parts[1], F.lit("•"), F.lit("•"))).otherwise(col(c))
    return F.when(col(c).contains("."), four).when(at > 1, F.concat(F.substring_index(col(c), ":", 1), F.lit(":…"))).otherwise(col(c))


def mask_mac(c: Column | str) -> Column:
    """Vendor half only; a dash for none, dots for what has not six parts."""
    parts = F.split(col(c), ":")
    half = F.concat_ws(":", parts[0], parts[1], parts[2], F.lit("••"), F.lit("••"), F.lit("••"))
    return F.when(F.coalesce(col(c), F.lit("")) == "", "—").when(F.size(parts) == 6, half).otherwise("…")


def domain_summary(c: Column | str) -> Column:
    """Last two labels of a name."""
    labels = F.filter(F.split(F.lower(col(c)), r"\."), lambda x: x != "")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def format_bytes(c: Column | str) -> Column:
    """B, KB and MB with one decimal, GB with two; no number or a negative one is 0 B."""
    n = col(c)
    scaled = lambda d, unit, k=1: F.concat(F.format_string(f"%.{k}f", F.round(n / F.lit(float(d)), k)), F.lit(unit))
    text = F.when(n.isNull() | (n < 0), "0 B").when(n < 1024, F.concat(F.floor(n + F.lit(0.5)).cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024, " KB"))
    return text.when(n < 1024**3, scaled(1024**2, " MB")).otherwise(scaled(1024**3, " GB", 2))


def format_duration(ms: Column | str) -> Column:
    """A rounded length of time in words: seconds below 90, minutes below 90, then hours with one decimal."""
    s = col(ms) / F.lit(1000.0)
    whole = lambda x: F.floor(x + F.lit(0.5)).cast("string")
    minutes = F.concat(F.lit("about "), whole(s / 60), F.when(F.floor(s / 60 + F.lit(0.5)) == 1, " minute").otherwise(" minutes"))
    text = F.when(s.isNull() | (s < 0), "an unknown amount of time").when(s < 1, "under a second").when(s < 90, F.concat(F.lit("about "), whole(s), F.lit(" seconds")))
    return text.when(s / 60 < 90, minutes).otherwise(F.concat(F.lit("about "), F.format_string("%.1f", F.round(s / 3600, 1)), F.lit(" hours")))


def iso_millis(ms: Column | str) -> Column:
    """Epoch milliseconds as an ISO text in UTC."""
    return F.date_format(F.timestamp_millis(col(ms).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def strict_iso(c: Column | str) -> Column:
    """Timestamp of a zoned ISO text with a real date, else null."""
    text = col(c)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(shaped, F.try_to_timestamp(text))


def minute_key(ts: Column | str) -> Column:
    return F.floor(F.unix_seconds(F.to_timestamp(col(ts))) / 60).cast("long")


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Full days between two instants, never negative."""
    seconds = F.unix_seconds(F.to_timestamp(col(end))) - F.unix_seconds(F.to_timestamp(col(start)))
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("long")


def short_hash(*parts: Column | str, size: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def canonical_json(*names: str) -> Column:
    """JSON of columns in order of name, nulls kept."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def js_int(c: Column | str) -> Column:
    """Leading integer of a text, as lenient parsers read it."""
    return F.regexp_extract(col(c), r"^\s*([+-]?\d+)", 1).try_cast("int")


def csv_field(c: Column | str) -> Column:
    """Quoted where it holds a comma, quote or line break."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def markdown(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"([\\`*_{}\[\]<>|#])", r"\\$1")


def level_rank(c: Column | str) -> Column:
    """Place of a risk level, unknown ones last."""
    out = F.lit(len(LEVELS))
    for k, level in enumerate(LEVELS):
        out = F.when(col(c) == level, k).otherwise(out)
    return out


#: White space as the report's readers take it.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Fixed values: (characters of which a text needs one, pattern, what stands for it), in the order they apply.
REDACTIONS = (
    ("", r"[\x00-\x1F\x7F]", " "),
    ("<", r"(?i)<\??xml\b[^>]*>|<(?:nmaprun|host|packet)\b[^>]*>|</(?:nmaprun|host|packet)>", "[redacted raw evidence]"),
    ("", rf"(?i)\b(?:pcap(?:ng)?[{SPACE}]+global[{SPACE}]+header|raw[{SPACE}]+(?:packet|payload|scan|capture))\b", "[redacted raw evidence]"),
    (":=", rf"(?i)\b(?:api[_-]?key|secret|password|token)[{SPACE}]*[:=][{SPACE}]*[^{SPACE},;]+", "[redacted secret]"),
    ("-", r"\bsk-[A-Za-z0-9_-]{10,}\b", "[redacted secret]"),
    ("", r"(?i)BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY", "[redacted secret]"),
    (".", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "[redacted ip]"),
    (":-.", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b|\b[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\b", "[redacted mac]"),
    ("\\", rf"[A-Za-z]:\\[^{SPACE},;)\"']+", "[redacted path]"),
    ("\\", rf"\\\\[^\\{SPACE}]+\\[^{SPACE},;)\"']+", "[redacted path]"),
    ("/", rf"/(?:home|tmp|Users|var|etc|workspace|opt)/[^{SPACE},;)\"']*", "[redacted path]"),
)


def _let(c: Column, f) -> Column:
    """f of a column that is computed once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _replaced(has: Column, pattern: str, by: str):
    return lambda x: F.when(has, F.regexp_replace(x, pattern, by)).otherwise(x)


def redact(c: Column | str, most: int | None = 800) -> Column:
    """Control characters, raw evidence, secrets, addresses and paths out, white space collapsed, at most so many characters; nothing left: a mark.

    Patterns are tried only on texts with a character they need.
    """
    text = out = col(c)
    for need, pattern, by in REDACTIONS:
        if need:
            has = text.contains(need[0])
            for x in need[1:]:
                has = has | text.contains(x)
            out = _let(out, _replaced(has, pattern, by))
        else:
            out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(F.regexp_replace(out, f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+", " ")
    return _let(out, lambda x: F.when(x == "", "[redacted]").otherwise(F.substring(x, 1, most) if most else x))


def folder_name(c: Column | str) -> Column:
    """(timestamp, type) of a run folder's name, YYYY-MM-DD_HHMM_type."""
    pattern = r"^(\d{4}-\d{2}-\d{2})_(\d{4})_(.+)$"
    part = lambda k: F.regexp_extract(col(c), pattern, k)
    return F.when(col(c).rlike(pattern), F.struct(F.try_to_timestamp(F.concat_ws(" ", part(1), part(2)), F.lit("yyyy-MM-dd HHmm")).alias("timestamp"), part(3).alias("run_type")))


def size_class(packets: Column | str) -> Column:
    """floor(log2) of a count, at most 7."""
    return F.least(F.lit(7), F.floor(F.log2(F.greatest(F.lit(1), col(packets))))).cast("long")
