"""Fixed values of the domain as small tables and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ports by risk level.
PORT_RISK = {
    "v1": {
        "P0": (23, 445, 3389, 5900, 135, 139, 1080, 5985, 5986, 1433, 1434, 3306, 5432, 6379, 27017, 9200),
        "P1": (8080, 8443, 8888, 9000, 9090, 10000, 2375, 2376, 4444, 7001, 8000, 8081, 8082),
        "P2": (22, 80, 443, 21, 25, 53, 110, 143, 993, 995),
    },
    "legacy": {"P0": (23, 445, 3389, 5900, 135, 139, 1080), "P1": (8080, 8443, 8888), "P2": (22, 80, 443)},
}
# Service category by protocol and port.
SERVICE_PORTS = {
    "tcp": {53: "dns", 80: "http", 443: "https", 22: "ssh", 445: "smb", 3389: "rdp"},
    "udp": {53: "dns", 5353: "mdns", 5355: "llmnr", 1900: "ssdp", 443: "quic"},
}
ENCRYPTED = ("https", "quic", "ssh")
# Ports the watch rules look at.
ADMIN_PORTS = (22, 8080, 8443, 8888, 9000, 9090, 5985, 5986)
CRITICAL_PORTS = (23, 445, 3389, 5900, 135, 139, 1080, 1433, 3306, 5432, 6379, 27017, 9200)
# Thresholds of the watch rules, all exceeded strictly.
OUTBOUND_BYTES, DEVICE_DNS, UNIQUE_DNS, EXTERNAL_PEERS = 52_428_800, 150, 300, 25
# Weight of each source in a coverage score.
COVERAGE_WEIGHTS = {"ports": "0.35", "discovery": "0.25", "hosts_up": "0.20", "arp_snapshot": "0.15", "scan_metadata": "0.05"}
# Base coverage score of a capture by vantage.
VANTAGE_SCORES = {"this-computer": "0.45", "gateway-router": "0.65", "mirror-tap": "0.70", "unknown": "0.25"}
# What to do about a port at P0, and names of services.
P0_ACTIONS = {
    23: "Disable Telnet and use SSH instead", 445: "Block at perimeter or isolate to internal VLAN only", 3389: "Block RDP at perimeter, use VPN or bastion for remote access",
    5900: "Block VNC at perimeter, use secure alternatives", 135: "Block MSRPC at perimeter firewall", 139: "Block NetBIOS at perimeter firewall", 1080: "Disable SOCKS proxy or restrict to internal use",
    5985: "Block WinRM at perimeter, use internal management only", 5986: "Block WinRM at perimeter, use internal management only", 1433: "Block MSSQL externally, use internal connections only",
    1434: "Block MSSQL Browser externally", 3306: "Block MySQL externally, use internal connections only", 5432: "Block PostgreSQL externally, use internal connections only",
    6379: "Block Redis externally, enable authentication", 27017: "Block MongoDB externally, enable authentication", 9200: "Block Elasticsearch externally, enable authentication",
}
SERVICE_NAMES = {
    21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 135: "MSRPC", 139: "NetBIOS", 143: "IMAP", 443: "HTTPS", 445: "SMB", 993: "IMAPS", 995: "POP3S", 1080: "SOCKS",
    1433: "MSSQL", 1434: "MSSQL Browser", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 5985: "WinRM HTTP", 5986: "WinRM HTTPS", 6379: "Redis", 8080: "HTTP Proxy", 8443: "HTTPS Alt",
    8888: "HTTP Alt", 9200: "Elasticsearch", 27017: "MongoDB",
}
# What a flagged port is, in the reason of a change.
FLAG_NOTES = {
    23: "Telnet (cleartext remote shell)", 445: "SMB (Windows file sharing)", 3389: "RDP (remote desktop)", 5900: "VNC (remote desktop)", 135: "RPC endpoint mapper", 139: "NetBIOS/SMB legacy", 1080: "SOCKS proxy (possible pivot)",
    8080: "HTTP alt / admin panel common", 8443: "HTTPS alt / admin panel common", 8888: "Dev/admin service common (Jupyter/etc.)", 22: "SSH (remote admin)", 80: "HTTP (web UI/admin possible)", 443: "HTTPS (web UI/admin possible)",
}
FRESH_DAYS, AGING_DAYS = 30, 37
LEVELS = ("P0", "P1", "P2")


def port_risk(spark: SparkSession, profile: str = "v1") -> DataFrame:
    """(port, risk) of a profile; give operators another table to override it."""
    return spark.createDataFrame([(p, level) for level, ports in PORT_RISK[profile].items() for p in ports], "port int, risk string")


def service_ports(spark: SparkSession) -> DataFrame:
    """(protocol, port, category)."""
    return spark.createDataFrame([(a, p, c) for a, ports in SERVICE_PORTS.items() for p, c in ports.items()], "protocol string, port int, category string")


def flag_notes(spark: SparkSession) -> DataFrame:
    """(port, note)."""
    return spark.createDataFrame(sorted(FLAG_NOTES.items()), "port int, note string")


def port_notes(spark: SparkSession) -> DataFrame:
    """(port, service_name, action)."""
    ports = sorted(P0_ACTIONS.keys() | SERVICE_NAMES.keys())
    return spark.createDataFrame([(p, SERVICE_NAMES.get(p), P0_ACTIONS.get(p)) for p in ports], "port int, service_name string, action string")
