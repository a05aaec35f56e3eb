"""Alerts of all detectors in one shape; threats, campaigns, techniques, triage."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import scalar as S
from netloom.operators.graph import connected_components
from netloom.operators.scans import running_sums, segments, stored

# Technique ids, their names and tactics.
TECHNIQUES = {
    "T1046": ("Network Service Discovery", "Discovery"),
    "T1190": ("Exploit Public-Facing Application", "Initial Access"),
    "T1059": ("Command and Scripting Interpreter", "Execution"),
    "T1078": ("Valid Accounts", "Persistence"),
    "T1021": ("Remote Services", "Lateral Movement"),
    "T1570": ("Lateral Tool Transfer", "Lateral Movement"),
    "T1071.001": ("Web Protocols", "Command and Control"),
    "T1071.004": ("DNS", "Command and Control"),
    "T1573": ("Encrypted Channel", "Command and Control"),
    "T1090.003": ("Multi-hop Proxy", "Command and Control"),
    "T1568": ("Dynamic Resolution", "Command and Control"),
    "T1571": ("Non-Standard Port", "Command and Control"),
    "T1041": ("Exfiltration Over C2 Channel", "Exfiltration"),
    "T1558": ("Steal or Forge Kerberos Tickets", "Credential Access"),
    "T1205": ("Traffic Signaling", "Defense Evasion"),
}
# Tactics in their order.
TACTICS = (
    "Reconnaissance", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access",
    "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
)
# Stages of an attack in their order.
STAGES = ("reconnaissance", "initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion", "lateral_movement", "command_control", "exfiltration")
# The stage of an alert category, and the category's rank as a threat's main one.
CATEGORY_STAGE = {"exfiltration": "exfiltration", "c2": "command_control", "lateral": "lateral_movement", "tor": "defense_evasion", "dns_tunnel": "defense_evasion", "evasion": "defense_evasion"}


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, t, TACTICS.index(t)) for k, (n, t) in TECHNIQUES.items()], "technique string, name string, tactic string, tactic_order int")


def detector_alerts(outputs: dict[str, DataFrame]) -> DataFrame:
    """Rows of detectors, by name, as ``engine, category, src_ip, dst_ip, severity,
    score, technique``; detectors that are absent give no rows."""
    high = F.col("confidence") == "HIGH" if "beacons" in outputs else None
    rules = {
        "beacons": lambda: ("c2", "dst_ip", F.when(high, "CRITICAL").otherwise("HIGH"), F.when(high, 80.0).otherwise(60.0), "T1071.001"),
        "dga_domains": lambda: ("c2", None, F.when(F.col("score") > 0.8, "HIGH").otherwise("MEDIUM"), F.col("score") * 80, "T1568"),
        "exfiltration": lambda: ("exfiltration", "dst_ip", F.when(F.col("ratio") > 50, "CRITICAL").otherwise("HIGH"), F.least(F.lit(95.0), 50 + F.col("ratio")), "T1041"),
        "relay_flows": lambda: ("tor", "relay_ip", F.lit("HIGH"), F.lit(60.0), "T1090.003"),
        "internal_scans": lambda: ("lateral", "dst_ip", F.col("severity"), F.col("score").cast("double"), "T1046"),
        "dns_tunnels": lambda: ("dns_tunnel", None, F.lit("HIGH"), F.col("score").cast("double"), "T1071.004"),
        "ttl_anomalies": lambda: ("evasion", None, F.lit("MEDIUM"), F.lit(40.0), "T1205"),
    }
    parts = []
    for engine, df in outputs.items():
        category, dst, severity, score, technique = rules[engine]()
        x = df.select(
            F.lit(engine).alias("engine"), F.lit(category).alias("category"), "src_ip", (F.col(dst) if dst else F.lit(None).cast("string")).alias("dst_ip"),
            severity.alias("severity"), F.round(score, 4).alias("score"), F.lit(technique).alias("technique"),
        )
        parts.append(x)
    return reduce(DataFrame.unionByName, parts)


def _by_address(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("ip", F.explode(F.array_distinct(F.array_compact(F.array("src_ip", "dst_ip")))))


def _joined(col: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(col)), ",")


def unify(alerts: DataFrame, least: int = 2, alone: float = 80.0, bonus: int = 8, most: int = 20) -> DataFrame:
    """Threats: addresses with ``least`` alerts, or with one of score ``alone``.
    Each further engine adds to the score; the most pressing category names it."""
    rank = F.lit(len(CATEGORY_STAGE))
    for i, c in enumerate(CATEGORY_STAGE):
        rank = F.when(F.col("category") == c, i).otherwise(rank)
    x = _by_address(alerts).withColumn("_rank", rank).groupBy("ip").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_distinct("engine").alias("_engines"), F.max("score").alias("_top"), _joined("engine").alias("engines"), _joined("technique").alias("techniques"), F.min_by("category", F.struct("_rank", "category")).alias("category")
    )
    x = x.where((F.col("alerts") >= least) | (F.col("_top") >= alone))
    score = F.least(F.lit(100.0), F.col("_top") + F.least(F.lit(most), bonus * (F.col("_engines") - 1)))
    stage = F.coalesce(*[F.when(F.col("category") == c, s) for c, s in CATEGORY_STAGE.items()], F.lit("unknown"))
    x = x.withColumn("score", F.round(score, 1))
    return x.select(S.short_id("ip", "engines").alias("threat_id"), "ip", "alerts", "engines", "techniques", "category", stage.alias("stage"), "score", S.severity_of("score", (80, 60, 40)).alias("severity"))


def summary(threats: DataFrame) -> DataFrame:
    return threats.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("threats"), F.round(F.avg("score"), 4).alias("mean_score"))


def campaigns(alerts: DataFrame, threats: DataFrame, least_threats: int = 2, least_techniques: int = 3) -> DataFrame:
    """Connected addresses with several threats and techniques."""
    edges = alerts.where("src_ip is not null and dst_ip is not null").select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")).distinct()
    of = connected_components(edges)
    t = threats.join(of, threats["ip"] == of["node"]).withColumn("_t", F.explode(F.split("techniques", ",")))
    x = t.groupBy("component").agg(F.count_distinct("ip").alias("threats"), F.count_distinct("_t").alias("n_techniques"), F.max("score").alias("score"), _joined("_t").alias("techniques"))
    return x.where((F.col("threats") >= least_threats) & (F.col("n_techniques") >= least_techniques)).select(S.short_id(F.lit("campaign"), "component").alias("campaign_id"), "component", "threats", "techniques", "score")


def timed_groups(alerts: DataFrame, key: str, ts: str = "created", tie: str = "alert_id", seconds: float = 300.0) -> DataFrame:
    """Column ``group_no``: a new group starts when an alert is more than
    ``seconds`` after its group's first.  A pause of as much always starts one, so a
    key is cut there into stretches that are different tasks' work; they are
    numbered on after running sums.  Only a group's start is held.  Alerts without a
    time are left out."""
    by = [key, "segment"]
    x = segments(alerts.select(key, ts, tie), [key], ts, seconds, tie).repartition(*by).sortWithinPartitions(*by, ts, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, no = (object(), 0), 0.0, 0
        for b in batches:
            out = []
            for k, g, t in zip(b[key], b["segment"], b[ts], strict=True):
                if (k, g) != now:
                    now, start, no = (k, g), t, 0
                elif t - start > seconds:
                    start, no = t, no + 1
                out.append(no)
            yield b.assign(group_no=pd.Series(out, index=b.index, dtype="int64"))

    numbered = stored(x.mapInPandas(run, T.StructType([*x.schema.fields, T.StructField("group_no", T.LongType())])))
    groups = numbered.groupBy(*by).agg((F.max("group_no") + 1).alias("_n"))
    before = running_sums(groups, [key], ["segment"], _sum=F.col("_n")).select(F.col(key).alias("_key"), F.col("segment").alias("_segment"), (F.col("_sum") - F.col("_n")).alias("_before"))
    y = numbered.join(before, numbered[key].eqNullSafe(before["_key"]) & (F.col("segment") == F.col("_segment")))
    return y.select(key, ts, tie, (F.col("group_no") + F.col("_before")).alias("group_no"))


def technique_map(alerts: DataFrame) -> DataFrame:
    """Techniques seen, with name, tactic, counts and the worst severity."""
    x = alerts.groupBy("technique").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("src_ip").alias("sources"), F.max("score").alias("score"), F.max(S.severity_rank("severity")).alias("severity_rank"), _joined("engine").alias("engines"))
    return x.join(F.broadcast(techniques(alerts.sparkSession)), "technique")


def tactic_coverage(alerts: DataFrame) -> DataFrame:
    """Every tactic that has techniques: how many are known and how many seen."""
    seen = alerts.groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
    x = techniques(alerts.sparkSession).join(seen, "technique", "left").groupBy("tactic", "tactic_order")
    return x.agg(F.count(F.lit(1)).alias("known"), F.count("n").alias("seen"), F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("technique")))), ",").alias("techniques"))


def navigator_layer(alerts: DataFrame) -> DataFrame:
    """One JSON object per technique for a matrix viewer."""
    r = F.col("severity_rank")
    score = F.when(r >= 3, 100).when(r == 2, 50).otherwise(25)
    return technique_map(alerts).select("technique", F.to_json(F.struct(F.col("technique").alias("techniqueID"), score.alias("score"), F.col("engines").alias("comment"))).alias("line"))


def attack_chains(alerts: DataFrame, least: int = 2) -> DataFrame:
    """Sources whose alerts cover several stages of an attack."""
    stage = F.coalesce(F.when(F.col("technique") == "T1046", "reconnaissance"), *[F.when(F.col("category") == c, s) for c, s in CATEGORY_STAGE.items()])
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    x = alerts.withColumn("stage", stage).where("stage is not null").withColumn("_at", at).groupBy(F.col("src_ip").alias("ip"))
    x = x.agg(F.count_distinct("stage").alias("n_stages"), (F.max("_at") - F.min("_at") + 1).alias("_span"), _joined("stage").alias("stages"), _joined("technique").alias("techniques"))
    score = F.least(F.lit(100), F.col("n_stages") * 15 + F.col("_span") * 10)
    return x.where(F.col("n_stages") >= least).select(S.short_id(F.lit("chain"), "ip", n=10).alias("chain_id"), "ip", "n_stages", "stages", "techniques", score.alias("score"), F.round(F.least(F.lit(1.0), F.col("n_stages") / 5), 4).alias("confidence"))


# Hypotheses; signals that each requires and those that support it.
HYPOTHESES = {
    "c2_active": (("beacon", "malware_ja3"), ("dga_domain", "tor_usage"), "T1071.001"),
    "exfil_active": (("high_outbound", "asymmetric_traffic"), ("off_hours", "encrypted"), "T1041"),
    "lateral_movement": (("internal_scan", "multi_port"), ("smb_traffic", "rdp_traffic"), "T1021"),
    "tor_c2": (("tor_usage", "beacon"), ("encrypted", "off_hours"), "T1090.003"),
    "insider_threat": (("off_hours", "high_outbound"), ("asymmetric_traffic",), "T1078"),
}


def flow_signals(flows: DataFrame, alerts: DataFrame, malware: DataFrame, heavy: int = 10_000_000) -> DataFrame:
    """``ip, signal``: what flows and alerts say about each source."""
    f = flows.join(malware.select("ja3", F.lit(True).alias("_bad")), "ja3", "left")
    off = F.avg((S.hour_of("start_time") <= 5).cast("double"))
    x = f.groupBy(F.col("src_ip").alias("ip")).agg(
        F.sum("total_bytes").alias("_b"), F.bool_or("_bad").alias("_bad"), F.count_distinct("dst_port").alias("_p"), F.bool_or(F.col("dst_port") == 445).alias("_smb"), F.bool_or(F.col("dst_port") == 3389).alias("_rdp"), F.avg((F.col("protocol") == "TLS").cast("double")).alias("_tls"), off.alias("_off")
    )
    flags = {"high_outbound": F.col("_b") > heavy, "malware_ja3": F.col("_bad"), "multi_port": F.col("_p") > 3, "smb_traffic": F.col("_smb"), "rdp_traffic": F.col("_rdp"), "encrypted": F.col("_tls") > 0.8, "off_hours": F.col("_off") > 0.4}
    a = x.select("ip", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))).alias("signal"))
    named = {"beacons": "beacon", "dga_domains": "dga_domain", "exfiltration": "asymmetric_traffic", "relay_flows": "tor_usage", "internal_scans": "internal_scan"}
    b = alerts.select(F.col("src_ip").alias("ip"), F.coalesce(*[F.when(F.col("engine") == e, s) for e, s in named.items()]).alias("signal")).where("signal is not null")
    return a.unionByName(b).distinct()


def hypotheses(signals: DataFrame) -> DataFrame:
    """Hypotheses all of whose required signals an address shows."""
    rows = [(h, s, True, len(need), t) for h, (need, _, t) in HYPOTHESES.items() for s in need] + [(h, s, False, len(need), t) for h, (need, more, t) in HYPOTHESES.items() for s in more]
    known = signals.sparkSession.createDataFrame(rows, "hypothesis string, signal string, required boolean, needed int, technique string")
    x = signals.join(F.broadcast(known), "signal").groupBy("ip", "hypothesis", "needed", "technique").agg(F.count_if("required").alias("met"), F.count_if(~F.col("required")).alias("support"), _joined("signal").alias("evidence"))
    x = x.where("met = needed").withColumn("confidence", F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.col("support")), 3))
    verdict = F.when(F.col("confidence") > 0.8, "confirmed").when(F.col("confidence") > 0.6, "likely").when(F.col("confidence") > 0.4, "possible").otherwise("unlikely")
    return x.select("ip", "hypothesis", "technique", "evidence", "confidence", verdict.alias("verdict"))


def hunt(chains: DataFrame, found: DataFrame, outliers: DataFrame, n: int | None = 30) -> DataFrame:
    """Findings of the hunting operators by score."""
    a = chains.select("ip", F.lit("attack_chain").alias("kind"), F.col("score").cast("double").alias("score"), F.col("stages").alias("detail"))
    b = found.select("ip", F.lit("hypothesis").alias("kind"), F.round(F.col("confidence") * 100, 1).alias("score"), F.col("hypothesis").alias("detail"))
    c = outliers.select(F.col("src_ip").alias("ip"), F.lit("outlier").alias("kind"), F.round(F.least(F.lit(100.0), F.col("score") * 10), 1).alias("score"), F.col("features").alias("detail"))
    x = reduce(DataFrame.unionByName, [a, b, c])
    return x if n is None else x.orderBy(F.desc("score"), "kind", "ip", "detail").limit(n)


# Triage rules in order: column, test, value, action, what the action sets.
TRIAGE_RULES = (
    ("severity", "eq", "CRITICAL", "escalate", "soc_manager"),
    ("severity", "eq", "INFO", "auto_close", "auto_triaged"),
    ("category", "contains", "tor", "tag", "tor_related"),
    ("threat_score", "gt", 85, "auto_assign", "senior_analyst"),
)


def triage(alerts: DataFrame, rules=TRIAGE_RULES) -> DataFrame:
    """Rules one after the other; a later rule sees what an earlier one changed.
    ``actions`` lists what was done; a null value meets no test."""
    x = alerts.withColumn("tags", F.array().cast("array<string>")).withColumn("actions", F.array().cast("array<string>"))
    for col, test, value, action, arg in rules:
        v = F.col(col)
        met = {
            "eq": lambda: v.cast("string") == str(value), "gt": lambda: v.try_cast("double") > float(value), "lt": lambda: v.try_cast("double") < float(value),
            "contains": lambda: F.contains(F.lower(v.cast("string")), F.lit(str(value).lower())), "in": lambda: v.cast("string").isin(*map(str, value)) if value else F.lit(False),
        }[test]()
        met = F.coalesce(met, F.lit(False))
        change = {"actions": F.when(met, F.concat("actions", F.array(F.lit(f"{action}={arg}")))).otherwise(F.col("actions"))}
        if action == "tag":
            change["tags"] = F.when(met, F.array_union("tags", F.array(F.lit(arg)))).otherwise(F.col("tags"))
        else:
            state = {"escalate": "escalated", "auto_close": "resolved", "auto_assign": "triaged"}[action]
            change["status"] = F.when(met, F.lit(state)).otherwise(F.col("status"))
            if action == "auto_assign":
                change["assignee"] = F.when(met, F.lit(arg)).otherwise(F.col("assignee"))
        x = x.withColumns(change)
    return x


# The states that may follow each state.
TRANSITIONS = {
    "new": ("triaged", "investigating", "escalated", "resolved", "false_positive"), "triaged": ("investigating", "escalated", "resolved", "false_positive"),
    "investigating": ("escalated", "resolved", "false_positive"), "escalated": ("investigating", "resolved"), "resolved": ("new",), "false_positive": ("new",),
}


def check_transitions(events: DataFrame) -> DataFrame:
    """Each change of state (``alert_id, status, at``) with the state before and
    whether it may follow; an alert's first state must be ``new``."""
    before = F.lag("status").over(W.partitionBy("alert_id").orderBy("at"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    x = events.withColumn("before", before)
    return x.withColumn("valid", F.when(F.col("before").isNull(), F.col("status") == "new").otherwise(F.array_contains(allowed, F.concat_ws(">", "before", "status"))))


def latest_states(events: DataFrame) -> DataFrame:
    return events.groupBy("alert_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


# Fixed values, in tenths: what a pair of alerts scores for each thing that it shares.
SESSION, SOURCE, ADDRESS, CATEGORY, TECHNIQUE = 3, 2, 1, 2, 2


def _shared_keys(least: int) -> Column:
    """All things, or sets of things, that an alert shares with any alert that it
    scores ``least`` tenths or more with, as strings."""
    c, none = F.col, F.lit(None).cast("string")
    one = lambda x: F.array(x)
    longer = lambda found, values: F.flatten(F.transform(found, lambda k: F.transform(F.coalesce(values, F.array(none)), lambda v: F.concat(k, F.lit("\x1f"), v))))
    ips = F.array_distinct(F.array_compact(F.array("src_ip", "dst_ip")))
    two = F.when(c("src_ip") != c("dst_ip"), F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")))
    ends = F.when(c("src_ip") != c("dst_ip"), F.concat_ws("|", "src_ip", "dst_ip"))
    addresses = [(0, None), (ADDRESS, ips), (2 * ADDRESS, one(two)), (SOURCE + ADDRESS, one(c("src_ip"))), (SOURCE + 2 * ADDRESS, one(ends))]
    sessions, categories = [(0, None), (SESSION, one(c("session_id")))], [(0, None), (CATEGORY, one(c("category")))]
    keys = []
    for combo in itertools.product(sessions, categories, [(0, None), (TECHNIQUE, c("techniques"))], addresses):
        if sum(w for w, _ in combo) < least or not any(w for w, _ in combo):
            continue
        name = "".join(str(w) if v is not None else "-" for w, v in combo)
        found = F.array(F.lit(name))
        for _, values in combo:
            if values is not None:
                found = longer(found, values)
        keys.append(found)
    return F.array_distinct(F.array_compact(F.flatten(F.array(*keys)))) if keys else F.array().cast("array<string>")


def _related(alerts: DataFrame, to: DataFrame, least: int, n: int, only: bool) -> DataFrame:
    """The ``n`` best of those that score ``least`` tenths or more; ``only`` lists just
    the sets of things that alerts of ``to`` have."""
    cols = ("alert_id", "session_id", "src_ip", "dst_ip", "category", "techniques")
    keyed = lambda df, p: df.select(F.struct(*cols).alias(p), F.explode(_shared_keys(least)).alias("_k"))
    asked, listed = keyed(to, "a"), keyed(alerts, "b")
    if only:
        listed = listed.join(asked.select("_k").distinct(), "_k", "left_semi")
    place = F.row_number().over(W.partitionBy("_k").orderBy("b.alert_id"))
    listed = listed.withColumn("_p", place).where(F.col("_p") <= n + 1).drop("_p")
    x = asked.join(listed, "_k").where("a.alert_id <> b.alert_id")
    same = lambda c: F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False)).cast("int")
    shared = F.size(F.array_intersect(F.array_compact(F.array("a.src_ip", "a.dst_ip")), F.array_compact(F.array("b.src_ip", "b.dst_ip"))))
    technique = F.coalesce(F.size(F.array_intersect(F.array_compact("a.techniques"), F.array_compact("b.techniques"))) > 0, F.lit(False)).cast("int")
    score = SESSION * same("session_id") + SOURCE * same("src_ip") + ADDRESS * shared + CATEGORY * same("category") + TECHNIQUE * technique
    x = x.select(F.col("a.alert_id").alias("alert_id"), F.col("b.alert_id").alias("related_id"), F.round(score / 10, 2).alias("score")).where(F.col("score") >= least / 10).distinct()
    best = F.row_number().over(W.partitionBy("alert_id").orderBy(F.desc("score"), "related_id"))
    return x.withColumn("place", best).where(F.col("place") <= n)


def related_alerts(alerts: DataFrame, to: DataFrame | None = None, least: float = 0.3, n: int = 10, levels: tuple[int, ...] = (10, 8, 6)) -> DataFrame:
    """For each alert of ``to`` (all, if not given), the ``n`` alerts that share the
    most with it: session .3, source .2, each address .1, category .2, any of
    ``techniques`` (an array column that may be absent) .2; of equal scores the
    lesser ids.

    Exact without listing the pairs of a hot session or address: whoever shares a
    given set of things with an alert scores at least that set's sum, so of all
    alerts with one set only the ``n + 1`` least ids can be among an alert's ``n``
    best.  Sets are dealt by value and cut to that many before the shuffle.  Sets of
    high sums come first: an alert with ``n`` others that score a level (in tenths) or
    more needs no set of a lower sum, and only the rest are taken to the next level.
    Null values are shared with no one; alert ids must be unique.
    """
    cols = ("alert_id", "session_id", "src_ip", "dst_ip", "category", "techniques")
    full = lambda df: (df if "techniques" in df.columns else df.withColumn("techniques", F.array().cast("array<string>"))).select(*cols)
    alerts = stored(full(alerts))
    rest, last, done = alerts if to is None else stored(full(to)), round(least * 10), []
    for i, level in enumerate(v for v in levels if v > last):
        if rest.isEmpty():
            break
        found = stored(_related(alerts, rest, level, n, i > 0))
        enough = found.where(F.col("place") == n).select("alert_id")
        done.append(found.join(enough, "alert_id", "left_semi"))
        rest = stored(rest.join(enough, "alert_id", "left_anti"))
    return reduce(DataFrame.unionByName, [*done, _related(alerts, rest, last, n, bool(done))])


def event_timeline(alerts: DataFrame, ts: str = "created", width: int = 60) -> DataFrame:
    """Counts by severity in buckets counted from the first event."""
    first = alerts.agg(F.min(ts).alias("_first"))
    x = alerts.crossJoin(F.broadcast(first)).withColumn("bucket", F.floor((F.col(ts) - F.col("_first")) / width))
    return x.groupBy("bucket").agg(F.count(F.lit(1)).alias("events"), *[F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")], F.round(F.avg("threat_score"), 4).alias("mean_score"))


def risk_report(threats: DataFrame) -> DataFrame:
    """One row: threats by severity and the overall risk."""
    x = threats.agg(F.count(F.lit(1)).alias("threats"), *[F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")], F.coalesce(F.max("score"), F.lit(0.0)).alias("top"))
    return x.withColumn("risk", S.severity_of("top", (90, 70, 40)))


def iocs(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """Indicators: external addresses of alerts, names and fingerprints of the
    flows between addresses that alerts name."""
    ips = _by_address(alerts).where(~S.is_internal("ip")).groupBy(F.col("ip").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    bad = _by_address(alerts).select("ip").distinct()
    f = flows.join(bad.withColumnRenamed("ip", "src_ip"), "src_ip", "left_semi").join(bad.withColumnRenamed("ip", "dst_ip"), "dst_ip", "left_semi")
    of = lambda col, kind: f.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return reduce(DataFrame.unionByName, [ips.select(F.lit("ip").alias("kind"), "value", "n"), of("sni", "domain"), of("ja3", "ja3")])


def to_stix(threats: DataFrame, as_of: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Objects ``stix_id, type, line``: an indicator per address, an attack pattern
    per technique and the relations between them; ids follow from their content."""
    uid = lambda kind, *parts: F.concat(F.lit(f"{kind}--"), F.regexp_replace(F.md5(F.concat_ws(":", *parts)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    t = threats.select("ip", "score", F.explode(F.split("techniques", ",")).alias("technique"))
    ind, pat = uid("indicator", F.lit("ip"), F.col("ip")), uid("attack-pattern", F.col("technique"))
    row = lambda df, i, kind, body: df.select(i.alias("stix_id"), F.lit(kind).alias("type"), F.to_json(F.struct(F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), i.alias("id"), F.lit(as_of).alias("created"), *body)).alias("line"))
    a = row(threats.groupBy("ip").agg(F.max("score").alias("score")), ind, "indicator", [F.concat(F.lit("[ipv4-addr:value = '"), "ip", F.lit("']")).alias("pattern"), F.col("score").cast("int").alias("confidence")])
    b = row(t.select("technique").distinct(), pat, "attack-pattern", [F.col("technique").alias("external_id")])
    c = row(t.select("ip", "technique").distinct(), uid("relationship", F.col("ip"), F.col("technique")), "relationship", [F.lit("indicates").alias("relationship_type"), ind.alias("source_ref"), pat.alias("target_ref")])
    return reduce(DataFrame.unionByName, [a, b, c])


def similar_flows(flows: DataFrame, threshold: float = 0.95, within: int = 49, seconds: float = 3600.0) -> DataFrame:
    """Pairs of alike flows among each flow's ``within`` successors in time, within
    one port and hour, so that no single task orders all flows."""
    w = W.partitionBy("dst_port", F.floor(F.col("start_time") / seconds)).orderBy("start_time", "flow_id")
    v = [F.col("packet_count").cast("double"), F.col("total_bytes") / 1e6, F.col("session_duration").cast("double"), F.col("dst_port") / 65535]
    # a flow's length is worked out once, not for each pair, and a pair carries no more than it takes
    x = flows.select("flow_id", "start_time", "dst_port", *[c.alias(f"v{i}") for i, c in enumerate(v)])
    dot = sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(4)), F.lit(0.0))
    x = x.withColumn("n", F.when(dot > 0, F.sqrt(dot)).otherwise(1.0))
    me = F.struct("flow_id", "v0", "v1", "v2", "v3", "n")
    x = x.withColumn("_next", F.collect_list(me).over(w.rowsBetween(1, within))).withColumn("b", F.explode("_next")).drop("_next")
    pair = sum((F.col(f"v{i}") * F.col(f"b.v{i}") for i in range(4)), F.lit(0.0)) / (F.col("n") * F.col("b.n"))
    # to four places as the SQL rounds, without the decimal text that round makes of each number
    x = x.withColumn("similarity", F.floor(pair * 10000 + 0.5) / 10000).where(F.col("similarity") >= threshold)
    return x.select(F.col("flow_id").alias("flow_a"), F.col("b.flow_id").alias("flow_b"), "similarity")
