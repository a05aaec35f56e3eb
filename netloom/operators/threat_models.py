"""The flow feature table, five threat scorers over it, and their combined run.

Scorers take one row per flow (or endpoint) with its features and the scores of
the models, ``clf`` and ``iso``, and keep those over their threshold.  A null
feature counts as zero; an empty table gives empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import reference as R
from netloom.operators.features import PROTOCOL_CODES, endpoint_features, fan_metrics, movement_scores, timing_sequences
from netloom.operators.models import IsolationForest, logistic_fits, min_max
from netloom.operators.scans import stored
from netloom.operators.windows import best_by, gaps, mode

# Ports of relays and of bridges, technique of each kind of threat.
RELAY_PORTS = (9001, 9030, 9050, 9051, 9150, 9151)
BRIDGE_PORTS = (443, 80, 8080, 8443)
TECHNIQUES = {"malware_beaconing": "T1071.001", "abnormal_traffic_flow": "T1071", "tor_c2": "T1090.003", "suspicious_encrypted_session": "T1573.002", "lateral_movement": "T1021"}
# The features in the order of the models.
FEATURES = (
    "interval_mean", "interval_stdev", "interval_cv", "interval_jitter", "periodicity_score", "burst_ratio", "total_bytes", "total_packets", "bytes_per_packet", "bytes_per_second", "pkt_size_stdev",
    "flow_duration", "protocol_code", "dst_port_norm", "port_entropy", "unique_dst_ratio", "ja3_rarity", "sni_entropy", "sni_length_norm", "tls_version_score", "dns_query_entropy", "dns_label_length",
    "dns_consonant_ratio", "fan_out", "fan_in", "betweenness_proxy",
)
TLS_FEATURES = ["ja3_rarity", "sni_entropy", "sni_length_norm", "tls_version_score"]
ENDPOINT_FEATURES = ["total_bytes", "total_packets", "duration", "bytes_per_second", "port_entropy", "destination_ratio", "tls_ratio", "ja3_rarity", "gap_cv", "autocorrelation", "fan_out", "fan_in", "betweenness"]


def _one(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def packet_measures(packets: DataFrame) -> DataFrame:
    """Timing, sizes and queried names of each flow's packets.  Gaps of a
    millisecond or less don't count; without two packets a flow has no timing."""
    w = W.partitionBy("flow_id").orderBy("timestamp", "packet_id")
    g = gaps(packets, ["flow_id"], "timestamp", 0.001, "packet_id").select("flow_id", "gap", F.lead("gap").over(w).alias("next"))
    mid = g.groupBy("flow_id").agg(F.avg("gap").alias("mid"), F.median("gap").alias("half"))
    c = F.col
    t = g.join(mid, "flow_id").groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("mid").alias("interval_mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("interval_stdev"), F.coalesce(F.var_samp("gap"), F.lit(0.0)).alias("spread"),
        F.coalesce(F.avg(F.abs(c("next") - c("gap"))), F.lit(0.0)).alias("interval_jitter"), F.avg((c("gap") - c("mid")) * (c("next") - c("mid"))).alias("shared"), F.avg((c("gap") < c("half") / 2).cast("double")).alias("burst_ratio"),
    )
    again = F.when(c("spread") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), _one(c("shared") / c("spread"))))
    t = t.select("flow_id", "interval_mean", "interval_stdev", (c("interval_stdev") / c("interval_mean")).alias("interval_cv"), "interval_jitter", F.when(c("n") >= 4, F.round(again, 4)).otherwise(0.0).alias("periodicity_score"), "burst_ratio")
    q = F.when(c("dns_query") != "", c("dns_query"))
    p = packets.where("flow_id is not null").groupBy("flow_id").agg(
        F.stddev_samp(F.when(c("size") != 0, c("size"))).alias("pkt_size_stdev"), F.avg(F.when(q.isNotNull(), S.text_entropy(q))).alias("q_entropy"), F.avg(F.length(S.first_label(q))).alias("q_length"), F.avg(F.when(q.isNotNull(), S.consonant_ratio(q, None))).alias("q_consonants"),
    )
    return p.join(t, "flow_id", "left")


def flow_features(flows: DataFrame, packets: DataFrame, also: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``flow_id, src_ip, dst_ip, dst_port, protocol`` and the 26 features of each
    flow, to six places.  ``port_entropy`` and ``unique_dst_ratio`` belong to
    endpoints and are zero here.  Packets carry ``flow_id``.  Counts a fingerprint and
    an address are written first: where they are small, flows are dealt by id alone,
    and then without what those joins and the measures of texts have used.  Columns of
    the tables in ``also``, one row a ``flow_id``, come along in the same deal."""
    c = F.col
    tls = flows.where("protocol = 'TLS'")
    seen = stored(tls.where("ja3 <> ''").groupBy("ja3").agg(F.count(F.lit(1)).alias("_seen")))
    # read by two features, so worked out once
    named = F.col("sni") != ""
    x = flows.withColumns({
        "_entropy": F.when(named, S.text_entropy("sni")), "_consonants": F.when(named, S.consonant_ratio("sni", None)), "_length": F.when(named, F.length("sni")), "_label": F.when(named, F.length(S.first_label("sni"))),
        "_old": c("tls_version").isin(*R.DEPRECATED_TLS),
    }).join(seen, "ja3", "left").withColumn("_rarity", F.when(c("ja3") != "", F.coalesce(c("_seen"), F.lit(1))))
    fans = stored(fan_metrics(flows.where("src_ip is not null and dst_ip is not null")).withColumnRenamed("ip", "src_ip"))
    x = x.join(fans, "src_ip", "left").crossJoin(F.broadcast(tls.agg(F.count(F.lit(1)).alias("_tls"))))
    x = reduce(lambda a, b: a.join(b, "flow_id", "left"), [packet_measures(packets), *also], x)
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    some = lambda v: F.coalesce(c(v), F.lit(0))
    seconds = F.when(some("session_duration") == 0, 0.1).otherwise(c("session_duration"))
    code = reduce(lambda a, kv: a.when(c("protocol") == kv[0], kv[1]), PROTOCOL_CODES.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    cols = {
        **{k: zero(c(k)) for k in FEATURES[:6]},
        "total_bytes": F.log1p(some("total_bytes")), "total_packets": F.log1p(some("packet_count")), "bytes_per_packet": some("total_bytes") / F.greatest(some("packet_count"), F.lit(1)), "bytes_per_second": some("total_bytes") / seconds,
        "pkt_size_stdev": zero(c("pkt_size_stdev")), "flow_duration": F.log1p(seconds), "protocol_code": code, "dst_port_norm": some("dst_port") / 65535, "port_entropy": F.lit(0.0), "unique_dst_ratio": F.lit(0.0),
        "ja3_rarity": zero(1 - c("_rarity") / F.greatest(c("_tls"), F.lit(1))), "sni_entropy": F.coalesce(c("_entropy"), F.lit(0.0)),
        "sni_length_norm": zero(F.when(c("_length").isNotNull(), _one(c("_length") / 50))), "tls_version_score": F.when(c("_old"), 1.0).otherwise(0.0),
        "dns_query_entropy": zero(F.coalesce(c("q_entropy"), c("_entropy"))), "dns_label_length": zero(_one(F.when(c("q_entropy").isNotNull(), c("q_length")).otherwise(c("_label")) / 30)),
        "dns_consonant_ratio": zero(F.coalesce(c("q_consonants"), c("_consonants"))), "fan_out": F.log1p(some("fan_out")), "fan_in": F.log1p(some("fan_in")), "betweenness_proxy": zero(c("betweenness")),
    }
    # rounded by a lambda a group: as one stage's expressions they'd be a method too long
    # for the JVM to compile, and a group that nobody reads isn't worked out
    keys, cols["ja3_rarity"] = ("flow_id", "src_ip", "dst_ip", "dst_port", "protocol", *[k for t in also for k in t.columns if k != "flow_id"]), F.round(cols["ja3_rarity"], 4)
    groups = [FEATURES[i:j] for i, j in zip((0, 6, 12, 16, 20, 23), (6, 12, 16, 20, 23, 26), strict=True)]
    rounded = lambda g: F.transform(F.array(*[cols[k] for k in g]), lambda v: F.when(v == 0, 0.0).otherwise(F.round(v, 6)))
    x = x.select(*keys, *[rounded(g).alias(f"_{i}") for i, g in enumerate(groups)])
    return x.select(*keys, *[F.get(f"_{i}", F.lit(j)).alias(k) for i, g in enumerate(groups) for j, k in enumerate(g)])


def ewma_scores(sequences: DataFrame, alpha: float = 0.3, least: int = 4) -> DataFrame:
    """``flow_id, ewma``: 1 less the mean distance of each gap from the moving
    average before it, over the mean gap; 0 with fewer than ``least`` gaps."""
    g = F.filter(F.transform("sequence", lambda s: F.get(s, F.lit(0))), lambda v: v > 0)
    x = sequences.select("flow_id", g.alias("g")).withColumn("n", F.size("g"))
    step = lambda a, v: F.struct((alpha * v + (1 - alpha) * a["level"]).alias("level"), (a["off"] + F.abs(v - a["level"])).alias("off"))
    off = F.aggregate(F.slice("g", 2, F.greatest(F.col("n") - 1, F.lit(0))), F.struct(F.get("g", F.lit(0)).alias("level"), F.lit(0.0).alias("off")), step)["off"] / (F.col("n") - 1)
    mean = F.aggregate("g", F.lit(0.0), lambda a, v: a + v) / F.col("n")
    return x.select("flow_id", F.when(F.col("n") < least, 0.0).otherwise(F.round(_one(F.greatest(F.lit(0.0), 1 - off / F.greatest(mean, F.lit(0.001)))), 4)).alias("ewma"))


def _threats(x: DataFrame, kind: str, keep: float, entity: str, confident: Column, evidence: dict[str, Column]) -> DataFrame:
    """Rows over the threshold; ``evidence`` names the signs that hold."""
    signs = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in evidence.items()])), ",")
    return x.where(F.col("score") >= keep).select(
        F.col(entity).alias("entity"), F.lit(kind).alias("kind"), "score", S.severity_of("score").alias("severity"), F.when(confident, "HIGH").otherwise("MEDIUM").alias("confidence"), F.lit(TECHNIQUES[kind]).alias("technique"), signs.alias("evidence")
    )


def beacon_threats(scored: DataFrame, keep: float = 0.40) -> DataFrame:
    """Regular flows.  ``scored`` has ``ewma`` too: null where no sequence is known."""
    c = F.col
    x = scored.withColumn("regular", F.greatest(F.lit(0.0), 1 - F.least(c("interval_cv"), F.lit(3.0)) / 3.0))
    base = F.round(0.35 * c("clf") + 0.25 * c("regular") + 0.20 * c("periodicity_score") + 0.20 * c("iso"), 4)
    x = x.withColumn("score", base).withColumn("score", F.when(c("ewma").isNull(), c("score")).otherwise(F.round(0.7 * c("score") + 0.3 * c("ewma"), 4)))
    signs = {"regular_timing": c("regular") > 0.6, "autocorrelation": c("periodicity_score") > 0.5, "classifier": c("clf") > 0.5, "rare_ja3": c("ja3_rarity") > 0.7, "single_destination": c("unique_dst_ratio") < 0.05}
    return _threats(x, "malware_beaconing", keep, "flow_id", c("score") > 0.75, signs)


def abnormal_threats(scored: DataFrame, keep: float = 0.42) -> DataFrame:
    """Flows whose volume stands out of their protocol's."""
    c = F.col
    # read twice, so what is needed of the flows is written once
    scored = stored(scored.select("flow_id", "protocol", "total_bytes", "bytes_per_second", "burst_ratio", "clf", "iso"))
    named = scored.where("protocol <> '' and total_bytes > 0")
    usual = named.groupBy("protocol").agg(F.avg("total_bytes").alias("_m"), F.stddev_samp("total_bytes").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_n > 2")
    x = scored.join(stored(usual), "protocol", "left").withColumn("z", F.when(c("_s") > 0, F.abs(c("total_bytes") - c("_m")) / c("_s")).otherwise(0.0)).withColumn("score", F.round(0.40 * c("iso") + 0.35 * c("clf") + 0.25 * _one(c("z") / 5.0), 4))
    signs = {"isolated": c("iso") > 0.65, "volume": c("z") > 3.0, "high_rate": c("bytes_per_second") > 100_000, "bursts": c("burst_ratio") > 0.6}
    return _threats(x, "abnormal_traffic_flow", keep, "flow_id", c("score") > 0.75, signs)


def relay_threats(scored: DataFrame, keep: float = 0.38) -> DataFrame:
    """Control channels over relays: ports, few partners, odd names, rare clients."""
    c = F.col
    x = scored.withColumns({
        "port": F.when(c("dst_port").isin(*RELAY_PORTS), 0.9).when(c("dst_port").isin(*BRIDGE_PORTS) & (c("ja3_rarity") > 0.7), 0.6).otherwise(0.0), "alone": F.when((c("fan_out") < F.log1p(F.lit(2))) & (c("betweenness_proxy") < 0.02), 0.6).otherwise(0.0),
        "name": F.when(c("sni_entropy") > 3.5, _one(c("sni_entropy") / 5.0)).otherwise(0.0),
    })
    x = x.withColumn("score", F.round(0.30 * c("clf") + 0.20 * c("port") + 0.20 * c("alone") + 0.15 * c("name") + 0.15 * c("ja3_rarity"), 4))
    signs = {"relay_port": c("port") > 0.5, "single_relay": c("alone") > 0.4, "odd_name": c("name") > 0.3, "rare_ja3": c("ja3_rarity") > 0.65, "deprecated_tls": c("tls_version_score") > 0}
    return _threats(x, "tor_c2", keep, "flow_id", c("port") > 0.7, signs)


def session_threats(scored: DataFrame, keep: float = 0.40) -> DataFrame:
    """Encrypted sessions.  ``scored`` has ``rate`` too: the share of threats among
    the labelled flows of its cluster."""
    c = F.col
    x = scored.where("protocol_code >= 0.45").withColumn("even", 1 - _one(c("pkt_size_stdev") / 500.0))
    x = x.withColumn("score", F.round(0.30 * c("clf") + 0.25 * F.coalesce(c("rate"), F.lit(0.0)) + 0.25 * c("iso") + 0.20 * (0.5 * c("ja3_rarity") + 0.5 * c("even")), 4))
    signs = {"cluster": c("rate") > 0.5, "even_sizes": c("even") > 0.7, "rare_ja3": c("ja3_rarity") > 0.7, "deprecated_tls": c("tls_version_score") > 0}
    return _threats(x, "suspicious_encrypted_session", keep, "flow_id", c("score") > 0.75, signs)


def movement_threats(scored: DataFrame, movement: DataFrame, keep: float = 0.38) -> DataFrame:
    """Endpoints (``src_ip, clf, iso, port_entropy, fan_out``) that move between
    internal addresses, with the scores of ``movement_scores``."""
    c = F.col
    x = scored.join(movement.select(c("ip").alias("src_ip"), c("score").alias("moves")), "src_ip", "left").withColumns({"moves": F.coalesce(c("moves"), F.lit(0.0)), "ports": _one(c("port_entropy") / 4.5), "wide": _one(c("fan_out") / 50)})
    x = x.withColumn("score", F.round(0.30 * c("clf") + 0.25 * c("moves") + 0.20 * c("ports") + 0.15 * c("wide") + 0.10 * c("iso"), 4))
    signs = {"port_entropy": c("ports") > 0.5, "many_hosts": c("wide") > 0.4, "central": c("moves") > 0.5, "classifier": c("clf") > 0.5}
    return _threats(x, "lateral_movement", keep, "src_ip", c("score") > 0.75, signs)


def linear_scores(train: DataFrame, rows: DataFrame, cols: list[str], kinds: list[str], key: str, label: str = "label") -> DataFrame:
    """``key`` and ``clf_<kind>`` for each kind: logistic regression of that kind
    against all else, fitted on the labelled rows.  0 for a kind that no row, or
    every row, is labelled with."""
    return with_linear_scores(train, rows.na.fill(0.0, cols), cols, kinds, label).select(key, *[f"clf_{k}" for k in kinds])


def with_linear_scores(train: DataFrame, rows: DataFrame, cols: list[str], kinds: list[str], label: str = "label") -> DataFrame:
    """``rows`` and the scores of ``linear_scores``.  The fits don't depend on the
    columns' scales.  ``train`` is read once for each of some ten steps."""
    number = F.coalesce(*[F.when(F.col(label) == k, i) for i, k in enumerate(kinds)], F.lit(-1))
    fit = train.na.fill(0.0, cols).select(*cols, number.alias("_kind"))
    seen = {r["_kind"]: r["count"] for r in fit.groupBy("_kind").count().collect()}
    due = [i for i in range(len(kinds)) if 0 < seen.get(i, 0) < sum(seen.values())]
    coef = np.zeros((len(cols) + 1, len(kinds)))
    if due:
        coef[:, due] = np.column_stack(logistic_fits(fit, cols, "_kind", due))

    @F.pandas_udf(", ".join(f"_{i} double" for i in range(len(kinds))))
    def run(*columns: pd.Series) -> pd.DataFrame:
        m = np.column_stack([c.to_numpy(dtype=float) for c in columns]) @ coef[1:] + coef[0]
        return pd.DataFrame(0.5 * (1 + np.tanh(m / 2)), columns=[f"_{i}" for i in range(len(kinds))])

    out = rows.withColumn("_scores", run(*[F.col(c).cast("double") for c in cols]))
    return out.withColumns({f"clf_{k}": F.round(F.col(f"_scores._{i}"), 4) if i in due else F.lit(0.0) for i, k in enumerate(kinds)}).drop("_scores")


def cluster_rates(rows: DataFrame, labelled: DataFrame, cols: list[str], key: str, k: int = 5, seed: int = 7) -> DataFrame:
    """``key, rate``: share of rows not labelled benign in each row's cluster."""
    return with_cluster_rates(rows, labelled, cols, k, seed).select(key, "rate")


def with_cluster_rates(rows: DataFrame, labelled: DataFrame, cols: list[str], k: int = 5, seed: int = 7) -> DataFrame:
    """``rows`` and the ``rate`` of ``cluster_rates``.  Labelled rows of equal columns are
    one point of their weight, so clusters are sought among distinct points."""
    made, threat = VectorAssembler(inputCols=cols, outputCol="_v"), (F.col("label") != "benign").cast("double")
    known = made.transform(stored(labelled.na.fill(0.0, cols).groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.count("label").alias("_known"), F.sum(threat).alias("_bad"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", weightCol="_n").fit(known)
    rate = stored(model.transform(known).groupBy("_c").agg(F.try_divide(F.sum("_bad"), F.sum("_known")).alias("rate")))
    return model.transform(made.transform(rows.na.fill(0.0, cols))).join(F.broadcast(rate), "_c", "left").drop("_c", "_v")


def cluster_profiles(clustered: DataFrame) -> DataFrame:
    """Means of each cluster's flows, its commonest protocol and its behaviour."""
    c = F.col
    mean = lambda v, name: F.round(F.avg(v), 4).alias(name)
    x = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("flows"), mean("interval_cv", "interval_cv"), mean("fan_out", "fan_out"), mean("port_entropy", "port_entropy"), mean("total_bytes", "total_bytes"),
        mean("ja3_rarity", "ja3_rarity"), mean("periodicity_score", "periodicity"), mean("dns_query_entropy", "dns_query_entropy"),
    ).join(mode(clustered, ["cluster"], "protocol", "protocol"), "cluster", "left")
    # Behaviours and their thresholds, the first that holds.
    kind = F.when(c("interval_cv") < 0.3, "periodic_c2").when(c("fan_out") > 2.0, "scanning_lateral").when(c("total_bytes") > 8.0, "bulk_transfer").when(c("dns_query_entropy") > 3.5, "dga_dns")
    return x.withColumn("behaviour", kind.when((c("protocol") == "TLS") & (c("ja3_rarity") > 0.6), "suspicious_tls").otherwise("normal_traffic"))


def rank_threats(threats: DataFrame) -> DataFrame:
    """The highest threat of each entity; of equal scores the first kind by name."""
    return best_by(threats, ["entity"], "score", "kind")


def detect_all(flows: DataFrame, packets: DataFrame, labels: DataFrame, endpoint_labels: DataFrame, k: int = 6, trees: int = 60, parts: tuple[str, ...] = ("threats", "scores", "clusters", "counters")) -> dict[str, DataFrame]:
    """All five scorers with models fitted on the labels given (``flow_id, label``
    and ``src_ip, label``; kinds as in ``TECHNIQUES``, else benign; of several labels of
    a flow the first by name counts).  Returns those of ``parts`` that are asked for:
    ``threats`` (ranked, one an entity), ``scores`` of each flow, ``clusters`` and
    ``counters`` a kind.  The forest over the features serves every scorer.

    Labels and moving averages come to the flows in the deal that makes the features;
    from there on models are applied row by row, without a join."""
    cols, kinds = [*FEATURES], [*TECHNIQUES]
    known = labels.groupBy("flow_id").agg(F.min("label").alias("label"), F.lit(True).alias("known"))
    raw = stored(flow_features(flows.where("flow_id is not null"), packets, (known, ewma_scores(timing_sequences(packets)))))
    limits = stored(min_max(raw, cols)[1])
    x = min_max(raw, cols, limits)[0]
    # the fits and the forest don't depend on the features' scales, so they read them as they are
    scored = with_linear_scores(raw.where("known"), raw, cols, kinds[:4])
    scored = IsolationForest(trees).fit(raw, cols, "flow_id").score(scored, "iso").withColumn("iso", F.round("iso", 4))
    near = [f"_{c}" for c in TLS_FEATURES]
    bounds = limits.select(*[F.col(f"{c}_{e}").alias(f"_{c}_{e}") for c in TLS_FEATURES for e in ("lo", "hi")])
    beside = lambda df: min_max(df.withColumns({f"_{c}": F.col(c) for c in TLS_FEATURES}), near, bounds)[0]
    scored = stored(with_cluster_rates(beside(scored), beside(raw.where("known")), near).drop(*near, "label", "known"))
    of = lambda kind: scored.withColumn("clf", F.col(f"clf_{kind}"))
    ends = stored(endpoint_features(flows, packets))
    scaled = stored(min_max(ends, ENDPOINT_FEATURES)[0])
    marked = stored(scaled.join(endpoint_labels.select("src_ip", "label"), "src_ip"))
    end_clf = linear_scores(marked, scaled, ENDPOINT_FEATURES, kinds[4:], "src_ip").withColumnRenamed(f"clf_{kinds[4]}", "clf")
    end_iso = IsolationForest(trees, 200).fit(scaled, ENDPOINT_FEATURES, "src_ip").score(scaled, "iso").select("src_ip", "iso")
    moving = movement_threats(ends.select("src_ip", "port_entropy", "fan_out").join(end_clf, "src_ip").join(end_iso, "src_ip"), movement_scores(flows))
    every = reduce(DataFrame.unionByName, [beacon_threats(of(kinds[0])), abnormal_threats(of(kinds[1])), relay_threats(of(kinds[2])), session_threats(of(kinds[3])), moving])
    every = every if len(parts) == 1 else stored(every)
    out, ranked = {}, rank_threats(every)
    if "threats" in parts:
        out["threats"] = ranked
    if "counters" in parts:
        out["counters"] = every.groupBy("kind").agg(F.count(F.lit(1)).alias("threats"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.max("score").alias("top_score"))
    if "scores" in parts or "clusters" in parts:
        points = VectorAssembler(inputCols=cols, outputCol="_v").transform(x).select("flow_id", "_v").persist()
        named = stored(KMeans(k=k, seed=42, featuresCol="_v", predictionCol="cluster").fit(points).transform(points).select("flow_id", "cluster"))
        points.unpersist()
        scores = scored.select("flow_id", "iso").join(named, "flow_id").join(ranked.select(F.col("entity").alias("flow_id"), F.col("score").alias("threat_score")), "flow_id", "left")
        made = {"scores": scores.withColumn("threat_score", F.coalesce("threat_score", F.lit(0.0))), "clusters": cluster_profiles(raw.join(named, "flow_id"))}
        out |= {p: made[p] for p in made if p in parts}
    return out
