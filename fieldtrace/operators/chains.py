"""Attack phases, chains of phases, and the stories told about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import format_duration, utc_text
from fieldtrace.operators.shaping import severity_name, severity_rank
from fieldtrace.operators.sliced import HOUR, numbered, running, seconds, slice_of
from fieldtrace.session import stage

# fixed values: phases in order with the words that reveal them; the first match wins
PHASES = [
    ("RECONNAISSANCE", ["SCAN", "PROBE", "ENUM", "DISCOVERY"]),
    ("INITIAL_ACCESS", ["BRUTE", "EXPLOIT", "PHISHING", "ACCESS"]),
    ("EXECUTION", ["WEBSHELL", "MALWARE", "SCRIPT", "EXECUTE", "COMMAND"]),
    ("PERSISTENCE", ["BACKDOOR", "PERSIST", "IMPLANT"]),
    ("PRIVILEGE_ESCALATION", ["PRIVILEGE", "ESCALAT", "ROOT", "ADMIN"]),
    ("LATERAL_MOVEMENT", ["LATERAL", "SMB", "RDP", "SSH", "PIVOT"]),
    ("COLLECTION", ["COLLECT", "HARVEST", "CAPTURE"]),
    ("EXFILTRATION", ["EXFIL", "TUNNEL", "C2", "BEACON", "DNS_TUNNEL"]),
    ("IMPACT", ["MODBUS_WRITE", "PLC", "RANSOMWARE", "WIPER", "STOP", "DAMAGE"]),
]
PHASE_NAMES = [name for name, _ in PHASES]
# fixed values: what the parts of an alert type say about its weight
SIGNIFICANCE = [
    (["WEBSHELL", "C2", "PLC"], "CRITICAL - Immediate action required"),
    (["LATERAL", "BRUTE", "EXPLOIT"], "HIGH - Active attack in progress"),
    (["SCAN", "PROBE"], "MEDIUM - Reconnaissance activity"),
]
# fixed values: story kinds, most serious first
STORY_WORDS = [
    ("PLC_MANIPULATION", ["MODBUS_WRITE", "PLC", "S7COMM", "DNP3", "IEC104", "WRITE_COIL", "WRITE_REGISTER"]),
    ("WEBSHELL_TO_OT", ["WEBSHELL", "PHP_EXECUTION", "SHELL_EXEC"]),
    ("DATA_EXFIL_DETECTED", ["EXFIL", "TUNNEL", "DNS_TUNNEL", "DATA_STEAL"]),
    ("C2_BEACON_DETECTED", ["C2_BEACON", "BEACON", "COMMAND_CONTROL", "C2"]),
]
KNOWN_WORDS = ["SCAN", "PROBE", "BRUTE", "EXPLOIT", "WEBSHELL", "MALWARE", "BACKDOOR", "LATERAL", "COLLECT", "EXFIL", "C2"]
STORY_TITLES = {
    "PLC_MANIPULATION": "Direct manipulation of controllers", "WEBSHELL_TO_OT": "From web shell to the plant network",
    "DATA_EXFIL_DETECTED": "Data leaving the network", "C2_BEACON_DETECTED": "Command-and-control traffic",
    "GENERIC_ATTACK_CHAIN": "Multi-stage attack", "UNKNOWN_PATTERN": "Unclassified sequence of alerts",
}


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def first_match(text: Column, table: list[tuple]) -> Column:
    """First entry (words, value) of an ordered table with a word in the text, else null."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(value)) for words, value in table], F.lit(None).cast("string"))


def detect_phase(kind: Column) -> Column:
    return first_match(F.upper(kind), [(words, name) for name, words in PHASES])


def phase_index(phase: Column) -> Column:
    """0-8, or -1 for an unknown phase."""
    return F.array_position(F.array(*[F.lit(n) for n in PHASE_NAMES]), phase).cast("int") - 1


def event_significance(kind: Column) -> Column:
    return F.coalesce(first_match(F.upper(kind), SIGNIFICANCE), F.lit("NORMAL - Part of attack chain"))


def _phased(alerts: DataFrame) -> DataFrame:
    # exploded and not filtered: a filter on the phase would be pushed below the type and work it out again for every word
    phase = F.explode(F.array_compact(F.array(detect_phase(F.col("anomaly_type")))))
    return alerts.where(F.coalesce("src_ip", F.lit("")) != "").withColumn("phase", phase)


def attack_chains(alerts: DataFrame, gap_s: float = 1800.0, ot_assets: DataFrame | None = None,
                  max_chains: int | None = None) -> DataFrame:
    """Runs of phase-bearing alerts of one source without a long silence, with two phases or more.

    Every phase of a run is first reduced to its earliest alert, so a run that holds
    most of the alerts shrinks to nine rows before it is assembled. ``ot_assets(ip)``
    lists the industrial hosts, optionally with a ``device_type``.
    """
    gap = seconds(gap_s)
    rows = _phased(alerts).select("ts_us", "seq", "src_ip", "dst_ip", "severity", "mitre", "phase")
    rows = running(rows, ["src_ip"], {"_prev": ("prev", F.col("ts_us"))})
    rows = rows.withColumn("_new", F.when(F.col("ts_us") - F.col("_prev") > gap, 1).otherwise(0).cast("long"))
    rows = stage(running(rows, ["src_ip"], {"run": ("sum", F.col("_new"))}))     # three branches read it
    first = rows.groupBy("src_ip", "run", "phase").agg(
        F.min(F.struct("ts_us", "seq", "severity", "mitre")).alias("f"), F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.max(severity_rank(F.col("severity"))).alias("sev"))
    heads = first.groupBy("src_ip", "run").agg(
        F.array_sort(F.collect_list(F.struct(phase_index(F.col("phase")).alias("idx"), "phase", F.col("f.ts_us").alias("ts_us"),
                                             F.col("f.severity").alias("severity")))).alias("phases"),
        F.sum("n").alias("total_events"), F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.max("sev").alias("sev"))
    heads = heads.where((F.col("total_events") >= 2) & (F.size("phases") >= 2))
    targets = (rows.where(F.trim(F.coalesce("dst_ip", F.lit(""))) != "").select("src_ip", "run", "dst_ip").distinct())
    sets = targets.groupBy("src_ip", "run").agg(F.array_sort(F.collect_set("dst_ip")).alias("target_ips"))
    techniques = (rows.select("src_ip", "run", F.explode("mitre").alias("t")).distinct()
                  .groupBy("src_ip", "run").agg(F.array_sort(F.collect_set("t")).alias("techniques")))
    chains = heads.join(sets, ["src_ip", "run"], "left").join(techniques, ["src_ip", "run"], "left")
    chains = (chains.withColumn("target_ips", F.coalesce("target_ips", F.array("src_ip")))
              .withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>")))
              .withColumn("severity", severity_name(F.col("sev"))))
    if ot_assets is not None:
        keep = [F.col("ip").alias("dst_ip")] + ([F.col("device_type")] if "device_type" in ot_assets.columns else [])
        risk = targets.join(ot_assets.select(*keep).distinct(), "dst_ip")
        device = F.max(device_bonus(F.col("device_type"))) if len(keep) > 1 else F.lit(0.0)
        risk = risk.groupBy("src_ip", "run").agg(F.array_sort(F.collect_set("dst_ip")).alias("ot_at_risk"),
                                                 device.alias("device_bonus"))
        chains = chains.join(risk, ["src_ip", "run"], "left")
    else:
        chains = chains.withColumn("ot_at_risk", F.lit(None).cast("array<string>")).withColumn("device_bonus", F.lit(0.0))
    chains = (chains.withColumn("ot_at_risk", F.coalesce("ot_at_risk", F.array().cast("array<string>")))
              .withColumn("has_ot_impact", F.size("ot_at_risk") > 0)
              .withColumn("confidence", F.least(F.lit(1.0), 0.3 + 0.15 * F.size("phases")))
              .withColumn("escalation", ot_escalation(F.transform("phases", lambda p: p["phase"]), F.col("severity"),
                                                      F.col("has_ot_impact"), F.coalesce("device_bonus", F.lit(0.0)))))
    chains = stage(chains).withColumn("_all", F.lit("")).withColumn("_tie", F.xxhash64("src_ip"))
    low, high = chains.agg(F.min("start_us"), F.max("start_us")).first()
    # all chains are one key: its slices follow their span, or a short capture would be numbered in one task
    chains = numbered(chains, ["_all"], "_n", ts="start_us", seq="_tie", width=((high - low) // 256 + 1) if low is not None else HOUR)
    chains = chains.withColumn("chain_id", chain_id(F.col("start_us"), F.col("_n") - 1))
    if max_chains is not None:
        chains = chains.where(F.col("_n") <= max_chains)
    return chains.drop("_all", "_tie", "_n", "run", "sev", "device_bonus").withColumnRenamed("src_ip", "source_ip")


def device_bonus(device: Column) -> Column:
    kind = F.upper(device)
    return (F.when(kind.isin("PLC", "RTU"), 0.2).when(kind.isin("HMI", "SCADA"), 0.15)
            .when(kind == "HISTORIAN", 0.1).otherwise(0.0))


def ot_escalation(phases: Column, severity: Column, reaches_ot: Column, device: Column) -> Column:
    """How close a chain is to the process: proximity, severity, progress and kind of device, at most 1."""
    def has(name):
        return F.array_contains(phases, name)
    near = F.when(reaches_ot, 0.3).when(has("LATERAL_MOVEMENT"), 0.2).otherwise(0.1)
    weight = (F.when(severity == "CRITICAL", 0.3).when(severity == "HIGH", 0.2).when(severity == "MEDIUM", 0.1)
              .when(severity == "LOW", 0.05).otherwise(0.0))
    far = (F.when(has("IMPACT"), 0.2).when(has("LATERAL_MOVEMENT") | has("EXFILTRATION"), 0.15)
           .when(has("EXECUTION"), 0.1).when(has("INITIAL_ACCESS"), 0.05).otherwise(0.0))
    return F.least(F.lit(1.0), near + weight + far + device)


def chain_id(start_us: Column, index: Column) -> Column:
    return F.concat(F.lit("CHAIN-"), F.date_format(F.timestamp_micros(start_us), "yyyyMMddHHmmss"), F.lit("-"),
                    F.format_string("%03d", index))


_ALERT = ["ts_us", "seq", "anomaly_type", "src_ip", "dst_ip"]      # what makes an alert; several may come of one event


def _lifetimes(chains: DataFrame, slack_s: float) -> DataFrame:
    return chains.select("chain_id", "start_us", (F.col("end_us") + seconds(slack_s)).alias("_until"), "source_ip",
                         F.array_distinct(F.array_compact("target_ips")).alias("target_ips")).distinct()


def _mean_lifetime(lives: DataFrame) -> int:
    """Slices this wide lay the chains out over three rows each on average, however long single ones last."""
    mean = lives.agg(F.avg(F.col("_until") - F.col("start_us"))).first()[0]
    return max(1, int(mean or HOUR))


def chain_alerts(chains: DataFrame, alerts: DataFrame, slack_s: float = 60.0, width: int | None = None) -> DataFrame:
    """Alerts belonging to a chain (one row per id): same source or one of its targets, within its time.

    Chains are laid out over the time slices they last, by default as wide as a chain lasts on average, so an alert meets only
    the chains of its address that live around it. Repeated alerts go first, and an alert that a chain has by its source is not
    taken by its target again, so the pairs, of which there may be many more than alerts, are not sorted or exchanged.
    """
    lives = _lifetimes(chains, slack_s)
    if width is None:
        lives = stage(lives)
        width = _mean_lifetime(lives)
    span = lives.withColumn("_slice", F.explode(F.sequence(slice_of(F.col("start_us"), width), slice_of(F.col("_until"), width))))
    rows = alerts.select("ts_us", "seq", "anomaly_type", "severity", "src_ip", "dst_ip").dropDuplicates(_ALERT)
    placed = rows.withColumn("_slice", slice_of(F.col("ts_us"), width))
    inside = F.col("ts_us").between(F.col("start_us"), F.col("_until"))
    cols = ["chain_id", *rows.columns]
    by_source = placed.join(span.drop("target_ips").withColumnRenamed("source_ip", "src_ip"), ["src_ip", "_slice"]).where(inside)
    aims = span.withColumn("dst_ip", F.explode("target_ips")).drop("target_ips")
    by_target = placed.join(aims, ["dst_ip", "_slice"]).where(inside & ~F.col("src_ip").eqNullSafe(F.col("source_ip")))
    return by_source.select(*cols).unionByName(by_target.select(*cols))


_KEY = ["_side", "_a", "_b"]


def _sides(source: Column, target: Column) -> list[Column]:
    """The addresses under which an alert is found: its source, its target, and both, which the first two count twice."""
    def side(n, a, b):
        return F.struct(F.lit(n).alias("_side"), a.alias("_a"), b.alias("_b"))
    return [side(0, source, F.lit("")), side(1, F.lit(""), target), side(2, source, target)]


def _known(key: Column) -> Column:
    return key["_a"].isNotNull() & key["_b"].isNotNull()


def chain_summary(chains: DataFrame, alerts: DataFrame, slack_s: float = 60.0) -> DataFrame:
    """Per chain id the number of its alerts and enough of their types to classify it, without pairing chains with alerts.

    Alerts and the starts and ends of chains are put in one order per address; between a chain's two marks the running count
    grows by its alerts there. ``_types`` has for each list of words that stories ask for the chain's last type with such a
    word. ``_ends`` has per source or target (``_side``, ``_a``, ``_b``) the places of the chain's alerts: after ``lo``, up to ``hi``.
    """
    words = [w for _, w in STORY_WORDS] + [KNOWN_WORDS]
    rows = alerts.where("ts_us IS NOT NULL").select(*_ALERT).dropDuplicates()
    kind = F.upper("anomaly_type")
    rows = rows.select("ts_us", "anomaly_type", F.array(*[contains_any(kind, w) for w in words]).alias("_has"),
                       F.explode(F.filter(F.array(*_sides(F.col("src_ip"), F.col("dst_ip"))), _known)).alias("_k"))
    rows = rows.select("ts_us", F.lit(1).alias("_mark"), *[F.col(f"_k.{c}").alias(c) for c in _KEY], "anomaly_type", "_has")
    lives = _lifetimes(chains, slack_s).where("start_us IS NOT NULL AND _until IS NOT NULL")
    aims = F.flatten(F.transform("target_ips", lambda t: F.array(*_sides(F.col("source_ip"), t)[1:])))
    keys = F.filter(F.concat(F.array(_sides(F.col("source_ip"), F.lit(""))[0]), F.coalesce(aims, F.array())), _known)
    marks = lives.select("chain_id", "start_us", "_until", F.explode(keys).alias("_k"))
    at = F.array(F.struct(F.col("start_us").alias("ts_us"), F.lit(0).alias("_mark")), F.struct(F.col("_until").alias("ts_us"), F.lit(2).alias("_mark")))
    marks = marks.select("chain_id", "start_us", *[F.col(f"_k.{c}").alias(c) for c in _KEY], F.explode(at).alias("_at")).select(
        "*", "_at.*").drop("_at")
    merged = rows.unionByName(marks, allowMissingColumns=True)
    seen = F.struct("ts_us", "anomaly_type")
    last = {f"_last{i}": ("last", F.when(F.get("_has", i), seen)) for i in range(len(words))}
    merged = running(merged, _KEY, {"_place": ("sum", F.when(F.col("_mark") == 1, 1).otherwise(0).cast("long")), **last}, seq="_mark")
    types = F.transform(F.filter(F.array(*last), lambda x: x["ts_us"] >= F.col("start_us")), lambda x: x["anomaly_type"])
    ended = F.col("_mark") == 2
    spans = merged.where("_mark <> 1").groupBy("chain_id", *_KEY).agg(
        F.max(F.when(~ended, F.col("_place"))).alias("lo"), F.max(F.when(ended, F.col("_place"))).alias("hi"),
        F.max(F.when(ended, types)).alias("_types"))
    places = F.when((F.col("_side") < 2) & (F.col("hi") > F.col("lo")), F.struct(*_KEY, "lo", "hi"))
    return spans.groupBy("chain_id").agg(
        F.sum(F.when(F.col("_side") == 2, -1).otherwise(1) * (F.col("hi") - F.col("lo"))).cast("int").alias("_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_side") < 2, F.array_compact("_types")))))).alias("_types"),
        F.collect_list(places).alias("_ends"))


def first_alerts(summary: DataFrame, alerts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` alerts of each chain of :func:`chain_summary`, as ``_e``.

    The alerts of an address lie in blocks of ``k``, so a chain's first ones there lie in two blocks at most.
    """
    event = F.struct("ts_us", "seq", "anomaly_type", "severity", "src_ip", "dst_ip")
    rows = alerts.where("ts_us IS NOT NULL").select("ts_us", "seq", "anomaly_type", "severity", "src_ip", "dst_ip").dropDuplicates(_ALERT)
    sides = F.filter(F.array(*_sides(F.col("src_ip"), F.col("dst_ip"))[:2]), _known)
    rows = rows.select(event.alias("_event"), F.explode(sides).alias("_k")).select(
        "_event", F.col("_event.ts_us").alias("ts_us"), *[F.col(f"_k.{c}").alias(c) for c in _KEY])
    rows = numbered(rows, _KEY, "_place", seq="_event").withColumn("_block", F.expr(f"(_place - 1) div {k}"))
    blocks = rows.groupBy(*_KEY, "_block").agg(F.collect_list(F.struct("_place", "_event")).alias("_held"))
    ends = summary.select("chain_id", F.explode("_ends").alias("_end")).select("chain_id", "_end.*")
    ends = ends.withColumn("hi", F.least(F.col("hi"), F.col("lo") + k))
    ends = ends.withColumn("_block", F.explode(F.expr(f"sequence(lo div {k}, (hi - 1) div {k})")))
    own = F.filter("_held", lambda x: (x["_place"] > F.col("lo")) & (x["_place"] <= F.col("hi")))
    found = ends.join(blocks, [*_KEY, "_block"]).select("chain_id", F.transform(own, lambda x: x["_event"]).alias("_own"))
    return found.groupBy("chain_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_own")))), 1, k).alias("_e"))


def classify_storyline(types: Column, has_ot: Column, escalation: Column, phases: Column, events: Column) -> Column:
    """Kind of story told by the alert types of a chain (an array)."""
    def any_word(words):
        return F.exists(types, lambda t: contains_any(F.upper(t), words))
    plc, shell, exfil, c2 = (any_word(words) for _, words in STORY_WORDS)
    return (F.when(plc, STORY_WORDS[0][0]).when(shell & (has_ot | (escalation > 0.5)), STORY_WORDS[1][0])
            .when(exfil, STORY_WORDS[2][0]).when(c2, STORY_WORDS[3][0])
            .when(any_word(KNOWN_WORDS) & (phases >= 2), "GENERIC_ATTACK_CHAIN")
            .when((phases >= 2) | (events >= 5), "UNKNOWN_PATTERN").otherwise("GENERIC_ATTACK_CHAIN"))


def production_risk(escalation: Column) -> Column:
    return (F.when(escalation >= 0.8, "CRITICAL").when(escalation >= 0.6, "HIGH").when(escalation >= 0.4, "MEDIUM")
            .when(escalation >= 0.2, "LOW").otherwise("NONE"))


def velocity(phases: Column, span_us: Column) -> Column:
    rate = phases / (span_us / 3.6e9)
    return (F.when(span_us <= 0, "").when(rate > 2, "RAPID PROGRESSION (high threat urgency)")
            .when(rate > 1, "Moderate progression").otherwise("Slow progression (patient attacker)"))


def storyline_table(chains: DataFrame, alerts: DataFrame, key_events: int = 20) -> DataFrame:
    """A row per chain: kind, risk and pace, judged from all its alerts, and as a sample its first ``key_events`` ones."""
    known = stage(chain_summary(chains, alerts))        # the first alerts are looked up by it
    told = first_alerts(known, alerts, key_events).withColumn("_e", F.transform("_e", lambda e: F.struct(
        e["ts_us"].alias("ts_us"), e["seq"].alias("seq"), e["anomaly_type"].alias("anomaly_type"), e["severity"].alias("severity"),
        e["src_ip"].alias("source"), e["dst_ip"].alias("target"), event_significance(e["anomaly_type"]).alias("significance"))))
    rows = chains.join(known.drop("_ends"), "chain_id", "left").join(told, "chain_id", "left").withColumns(
        {"_types": F.coalesce("_types", F.array().cast("array<string>")), "_count": F.coalesce("_count", F.lit(0))})
    kind = classify_storyline(F.col("_types"), F.col("has_ot_impact"), F.col("escalation"), F.size("phases"), F.col("total_events"))
    titles = F.create_map(*[x for k, v in STORY_TITLES.items() for x in (F.lit(k), F.lit(v))])
    span = F.col("end_us") - F.col("start_us")
    return rows.withColumn("attack_type", kind).select(
        "chain_id", "source_ip", "severity", "confidence", "attack_type",
        F.element_at(titles, F.col("attack_type")).alias("title"), production_risk(F.col("escalation")).alias("production_risk"),
        velocity(F.size("phases"), span).alias("velocity"), format_duration(span).alias("duration"),
        utc_text(F.col("start_us")).alias("started"),
        F.array_join(F.transform("phases", lambda p: p["phase"]), " -> ").alias("timeline"),
        F.col("_e").alias("key_events"), F.col("_count").alias("alerts"))


def chain_list(chains: DataFrame, storylines: DataFrame, limit: int = 50) -> DataFrame:
    """Most severe and most recent chains with their story."""
    rows = chains.join(storylines.select("chain_id", "attack_type", "title"), "chain_id", "left")
    return rows.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("start_us"), "chain_id").limit(limit)
