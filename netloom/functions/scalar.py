"""Scalar column expressions for network metadata.  No user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_binary(x: C, places: int) -> Column:
    """``x`` rounded as databases round doubles: scaled, then to the nearest whole number.
    ``round`` takes the shortest decimal of ``x``, so 8.825 is a tie there and not here."""
    return F.round(_c(x) * float(10**places)) / float(10**places)


def entropy_of(text: C) -> Column:
    """Shannon entropy in bits of the characters of ``text``; 0 for empty or null.

    ``H = log2(n) - sum(c * log2(c)) / n`` over the counts of distinct characters.
    Counts are what is missing once the character is taken out, so no character is
    compared with every other one.
    """
    # a lambda's variable holds a value; a column would be worked out for each character
    return F.get(F.transform(F.array(_c(text)), _entropy), F.lit(0))


def _entropy(text: Column) -> Column:
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda x: (n - F.length(F.replace(text, x, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * F.log2(F.greatest(x, F.lit(1.0))))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(F.lit(0.0))


def first_label(domain: C) -> Column:
    return F.substring_index(_c(domain), ".", 1)


def label_entropy(domain: C) -> Column:
    """Entropy of the first label, rounded to 4 places."""
    return F.round(F.coalesce(entropy_of(first_label(domain)), F.lit(0.0)), 4)


def consonant_ratio(domain: C, places: int | None = 3) -> Column:
    label = F.lower(first_label(domain))
    n = F.length(label)
    ratio = F.when(n > 0, F.length(F.regexp_replace(label, "[^bcdfghjklmnpqrstvwxyz]", "")) / n).otherwise(F.lit(0.0))
    return F.round(ratio, places) if places is not None else ratio


def dga_score(domain: C) -> Column:
    """Heuristic score of an algorithm-made name: entropy, consonants, length."""
    e, c, n = label_entropy(domain), consonant_ratio(domain), F.length(first_label(domain))
    score = F.when(e > 3.5, 0.4).otherwise(0.0) + F.when(c > 0.65, 0.3).otherwise(0.0) + F.when(n > 12, 0.2).otherwise(0.0) + F.when(n > 20, 0.1).otherwise(0.0)
    return F.coalesce(F.round(F.least(score, F.lit(1.0)), 3), F.lit(0.0))


def labels(domain: C) -> Column:
    return F.split(_c(domain), r"\.")


def base_domain(domain: C) -> Column:
    return F.lower(F.substring_index(_c(domain), ".", -2))


def subdomain(domain: C) -> Column:
    """All labels but the last two, joined without dots, in lower case."""
    p = labels(F.lower(_c(domain)))
    return F.when(F.size(p) > 2, F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 2, F.lit(0))), "")).otherwise(F.lit(""))


def subdomain_entropy(domain: C) -> Column:
    return F.round(entropy_of(subdomain(domain)), 4)


def mean_label_length(domain: C) -> Column:
    p = labels(domain)
    return F.round(F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x)) / F.size(p), 2)


def longest_label(domain: C) -> Column:
    return F.array_max(F.transform(labels(domain), lambda x: F.length(x)))


def text_entropy(text: C) -> Column:
    return F.round(F.coalesce(entropy_of(F.lower(_c(text))), F.lit(0.0)), 4)


def ip_to_long(ip: C) -> Column:
    """IPv4 text to its number; null for other text."""
    p = F.split(_c(ip), r"\.")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("bigint")
    value = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    ok = F.size(p) == 4
    for i in (1, 2, 3, 4):
        ok = ok & part(i).between(0, 255)
    return F.when(ok, value)


def is_internal(ip: C, strict: bool = True) -> Column:
    """RFC 1918 and 127.0.0.1; loosely: 10., 192.168. and any 172."""
    ip = _c(ip)
    if not strict:
        return F.coalesce(F.regexp_like(ip, F.lit(r"^(10[.]|192[.]168[.]|172[.])")), F.lit(False))
    return F.coalesce(F.regexp_like(ip, F.lit(r"^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])")) | (ip == "127.0.0.1"), F.lit(False))


def prefix24(ip: C) -> Column:
    return F.substring_index(_c(ip), ".", 3)


def os_of_ttl(ttl: C) -> Column:
    """Likely system of a dominant TTL; first matching band."""
    t = _c(ttl)
    return F.when(t.between(60, 65), "Linux / Android").when(t.between(126, 129), "Windows").when(t.between(253, 256), "Cisco / network device").when(t.between(30, 35), "Solaris / AIX").otherwise("Unknown")


def severity_of(score: C, cuts=(0.90, 0.75, 0.55)) -> Column:
    s = _c(score)
    return F.when(s >= cuts[0], "CRITICAL").when(s >= cuts[1], "HIGH").when(s >= cuts[2], "MEDIUM").otherwise("LOW")


def severity_rank(severity: C) -> Column:
    """4 for CRITICAL down to 0 for INFO and anything else."""
    s = F.upper(_c(severity))
    return F.when(s == "CRITICAL", 4).when(s == "HIGH", 3).when(s == "MEDIUM", 2).when(s == "LOW", 1).otherwise(0)


def modified_z(x: C, median: C, mad: C) -> Column:
    return F.when(_c(mad) == 0, F.lit(0.0)).otherwise(F.round(0.6745 * (_c(x) - _c(median)) / _c(mad), 3))


def hour_of(ts: C) -> Column:
    """UTC hour of epoch seconds."""
    return F.pmod(F.floor(_c(ts) / 3600), F.lit(24)).cast("int")


def short_id(*parts: C, n: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts])), 1, n)


def human_duration(seconds: C) -> Column:
    s = _c(seconds)
    return F.when(s < 60, F.format_string("%.0fs", s.cast("double"))).when(s < 3600, F.format_string("%.1fm", (s / 60).cast("double"))).otherwise(F.format_string("%.1fh", (s / 3600).cast("double")))


def is_cell_size(size: C, cell: int, tolerance: int) -> Column:
    """Whether a packet size is near one to three relay cells."""
    s = _c(size)
    return (F.abs(s - cell) <= tolerance) | (F.abs(s - 2 * cell) <= 2 * tolerance) | (F.abs(s - 3 * cell) <= 3 * tolerance)


def ja3(version: C, ciphers: C, extensions: C, groups: C, formats: C) -> Column:
    """JA3: md5 of the dash-joined lists, comma-joined, without GREASE values."""
    grease = [0x0A0A + 0x1010 * i for i in range(16)]
    clean = lambda x: F.array_join(F.filter(F.coalesce(_c(x), F.array().cast("array<int>")), lambda v: ~v.isin(grease)).cast("array<string>"), "-")
    return F.md5(F.concat_ws(",", _c(version).cast("string"), *[clean(x) for x in (ciphers, extensions, groups, formats)]))


def http2_fingerprint(settings: C, window: C | None = None) -> Column:
    """md5 of the sorted ``k:v`` settings, ``;``-joined, and ``|w:window``."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries(_c(settings))), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ";")
    return F.md5(text if window is None else F.concat(text, F.coalesce(F.concat(F.lit("|w:"), _c(window).cast("string")), F.lit(""))))


def sla_hours(severity: C, table=(1, 4, 8, 24, 72)) -> Column:
    r = severity_rank(severity)
    out = F.when(r == 4, table[0])
    for k, h in zip((3, 2, 1), table[1:4], strict=True):
        out = out.when(r == k, h)
    return out.otherwise(table[4])


