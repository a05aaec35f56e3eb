"""Small lookup tables.  Each is an argument of the operators that use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Client fingerprints and the malware that they are known from.
MALWARE_JA3 = {
    "e7d705a3286e19ea42f587b344ee6865": "Cobalt Strike default",
    "6734f37431670b3ab4292b8f60f29984": "Metasploit Meterpreter",
    "a0e9f5d64349fb13191bc781f81f42e1": "Metasploit stager",
    "de9f2c7fd25e1b3afad3e85a0226823f": "TrickBot / Emotet",
    "e7eca2baf4458d095b7f45da28c16c34": "Dridex banking trojan",
    "b386946a5a44d1ddcc843bc75336dfce": "Trickbot HTTPS",
    "192a954d99b56e72cc6fcd974b862bb9": "AgentTesla stealer",
}
# Fingerprints of intercepting proxies.
PROXY_JA3S = {
    "eb1d94daa7e0344597e756a1fb6e117a": "Burp Suite",
    "4d7a28d6f2263ed61de88ca66eb011e3": "Charles Proxy",
    "e35df3e00ca4ef31d42b3a9bca7e81be": "Fiddler",
    "ae4edc6faf64d08308082ad26be60767": "mitmproxy",
    "29d1850a769c1803eda455e4f6ab1945": "ZScaler MITM",
}
# Weak cipher suites.
WEAK_CIPHERS = (0x0004, 0x0005, 0x000A, 0x0013, 0x002F, 0x0033, 0x0035, 0x0039, 0x003C)
# Administration ports, their service and technique.
ADMIN_PORTS = {
    22: ("SSH", "T1021.004"), 135: ("DCOM/WMI", "T1021.003"), 139: ("NetBIOS/SMB", "T1021.002"), 445: ("SMB", "T1021.002"), 3389: ("RDP", "T1021.001"),
    5985: ("WinRM", "T1021.006"), 5986: ("WinRM HTTPS", "T1021.006"), 88: ("Kerberos", "T1558"), 389: ("LDAP", "T1087.002"), 5900: ("VNC", "T1021.005"),
}
AUTH_PORTS = (88, 389, 636)
C2_PORTS = (4444, 1337, 31337, 8888, 9999, 6666, 6667, 1234, 12345, 55555)
TLS_PORTS = (443, 8443, 465, 587, 993, 995, 636, 853, 8080, 8888)
COMMON_PORTS = (80, 443, 53, 22)
DEPRECATED_TLS = ("SSL 2.0", "SSL 3.0", "TLS 1.0", "TLS 1.1")
# Names in queries that tunnelling tools leave, in order.
TUNNEL_SIGNATURES = {"t.v0": "iodine", "dnscat": "dnscat2", "dns2tcp": "dns2tcp", "pwn": "DNSExfiltrator"}
# Directory authorities, one exit and one guard; whole lists come from feeds.
RELAY_NODES = {
    "128.31.0.34": "authority", "86.59.21.38": "authority", "194.109.206.212": "authority", "199.58.81.140": "authority", "131.188.40.189": "authority",
    "193.23.244.244": "authority", "171.25.193.9": "authority", "154.35.175.225": "authority", "45.66.33.45": "authority", "185.220.101.47": "exit", "5.45.98.176": "guard",
}
# Fingerprints of relay clients.
RELAY_CLIENT_JA3 = {
    "e7d705a3286e19ea42f587b344ee6866": "Tor Browser 12.x",
    "c12f54a3b91eb38a1b4e3f1c3d4e5f6a": "Tor Browser 13.x",
    "a8b7c6d5e4f3a2b1c0d9e8f7a6b5c4d3": "Tor Browser (obfs4)",
    "b523d03bce13c0e06cc6a8db6cf3b1aa": "Tor Browser 14.x (ESR128)",
    "d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8a9": "Tor Browser (snowflake)",
}
# Cipher suites that relay clients offer.
RELAY_CLIENT_CIPHERS = (0x1301, 0x1302, 0x1303, 0xC02C, 0xC02B, 0xC030, 0xC02F, 0xCCA9, 0xCCA8)


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def malware_ja3(spark: SparkSession) -> DataFrame:
    return _frame(spark, [*MALWARE_JA3.items()], "ja3 string, malware string")


def relay_client_ja3(spark: SparkSession) -> DataFrame:
    return _frame(spark, [*RELAY_CLIENT_JA3.items()], "ja3 string, client string")


def admin_ports(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(p, n, t) for p, (n, t) in ADMIN_PORTS.items()], "dst_port int, service string, technique string")


def relay_nodes(spark: SparkSession) -> DataFrame:
    return _frame(spark, [*RELAY_NODES.items()], "ip string, node_type string")
