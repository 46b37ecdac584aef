"""Sensor and station state, divergence from what is declared, and the proposals' event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.stats import DAY, HOUR, micros
from gaugewright.operators.longterm import drift
from gaugewright.operators.series import SERIES, last_days, trailing_run
from gaugewright.params import DEFAULTS, Params

# States from best to worst, and the statuses of proposals.
STATES = ("marche", "critique", "arret")
PENDING, CONFIRMED, REPAIRED, FALSE_ALARM, VOID = "en_attente", "confirme", "repare", "faux_positif", "caduque"


def sensor_state(m: DataFrame, params: Params = DEFAULTS, silence_h: float | None = None) -> DataFrame:
    """Each series' state: muet (silent), degrade or ok, and the rule behind it. (AGG-20)

    One reading window of 14 days serves the battery's level and drift and the trailing plateau.
    """
    silence_h = params.state_silence_h if silence_h is None else silence_h
    summary = m.groupBy(*SERIES).agg(F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"))
    clock = summary.agg(F.max("last_ts").alias("_now"))
    tail = last_days(m, 14, SERIES)
    falling = drift(tail.where(F.col("sensor") == params.battery), params).select(*SERIES, "slope")
    flat = trailing_run(tail.where(F.col("sensor").isin(params.level, params.discharge))).select(*SERIES, "hours", F.col("value").alias("flat_value"))
    s = summary.crossJoin(F.broadcast(clock)).join(falling, list(SERIES), "left").join(flat, list(SERIES), "left")  # the clock is one row
    lag = (micros("_now") - micros("last_ts")) / float(HOUR)
    battery = F.col("sensor") == params.battery
    resting = (F.col("sensor") == params.discharge) & (F.col("flat_value") == 0)
    rule = (
        F.when(lag >= silence_h, "L3")
        .when(battery & (F.col("last_value") <= params.battery_alert), "BAT")
        .when(F.coalesce(F.col("slope") <= -params.drift_per_day, F.lit(False)), "L2")
        .when(F.coalesce(F.col("hours") >= params.flatline_long_h, F.lit(False)) & ~resting, "L1")
    )
    state = F.when(rule == "L3", "muet").when(rule.isNotNull(), "degrade").otherwise("ok")
    return s.select(*SERIES, "last_ts", lag.alias("lag_h"), state.alias("state"), rule.alias("rule"))


def station_state(sensors: DataFrame) -> DataFrame:
    """The worst of a station's sensors: all silent, any not well, or running. (AGG-20)"""
    s = sensors.groupBy("station").agg(F.bool_and(F.col("state") == "muet").alias("silent"), F.bool_or(F.col("state") != "ok").alias("unwell"), F.count("*").alias("n_sensors"), F.count_if(F.col("state") != "ok").alias("n_unwell"))
    return s.select("station", F.when(F.col("silent"), "arret").when(F.col("unwell"), "critique").otherwise("marche").alias("state"), "n_sensors", "n_unwell")


def divergence(detected: DataFrame, declared: DataFrame) -> DataFrame:
    """Detected against declared state; a missing declaration is no divergence. (JN-05, Q-19)"""
    joined = detected.join(declared.select("station", F.col("state").alias("declared")), "station", "left")
    return joined.withColumn("diverges", F.coalesce(F.col("state") != F.col("declared"), F.lit(False)))


def active_coverage(m: DataFrame, sensors: DataFrame, days: int = 7) -> DataFrame:
    """Hours that each station's sensors that are not silent cover in the network's last days. (AGG-27)"""
    active = sensors.where("state <> 'muet'").select(*SERIES)
    clock = m.agg(F.max("ts").alias("_now"))
    recent = m.join(active, list(SERIES), "left_semi").crossJoin(F.broadcast(clock)).where(micros("ts") >= micros("_now") - days * DAY)  # one row
    return recent.groupBy("station").agg(((micros(F.max("ts")) - micros(F.min("ts"))) / float(HOUR)).alias("hours"))


def _order(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state)


def justified(diverging: DataFrame, coverage: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Divergences worth a proposal: a change for the better needs hours enough of readings. (ST-07)"""
    joined = diverging.join(coverage, "station", "left")
    better = _order(F.col("state")) < _order(F.col("declared"))
    return joined.withColumn("justified", F.col("diverges") & (~better | (F.coalesce("hours", F.lit(0.0)) >= params.recovery_h)))


def proposal_merge(pending: DataFrame, detected: DataFrame) -> DataFrame:
    """What to do for each station: open, enrich, close or nothing. (ST-02 to ST-04, ST-07)

    ``pending``: station, proposed, provenance (at most one a station). ``detected``: station, state,
    justified, provenance. An enriched proposal takes the new provenance where there is one.
    """
    p = pending.select("station", F.col("proposed").alias("_was"), F.col("provenance").alias("_from"), F.lit(True).alias("_p"))
    d = detected.select("station", "state", "justified", F.col("provenance").alias("_new"))
    both = p.join(d, "station", "full")
    wanted, there = F.coalesce("justified", F.lit(False)), F.coalesce("_p", F.lit(False))
    action = F.when(wanted & there, "enrich").when(wanted, "open").when(there, "close").otherwise("ignore")
    return both.select("station", action.alias("action"), F.when(wanted, F.col("state")).otherwise(F.col("_was")).alias("proposed"), F.coalesce("_new", "_from").alias("provenance"))


def answers(events: DataFrame) -> DataFrame:
    """Proposals with their first answer; later answers are errors. (ST-05)

    ``events``: proposal_id, station, proposed, status, at. Rows: the proposal, its status, whether
    its state takes effect (confirmed only), and how many answers came too late.
    """
    order = Window.partitionBy("proposal_id").orderBy("at", "status")
    ranked = events.where(F.col("status") != PENDING).withColumn("_rn", F.row_number().over(order))
    first = ranked.where("_rn = 1").select("proposal_id", "station", "proposed", "status", "at")
    late = ranked.groupBy("proposal_id").agg((F.count("*") - 1).alias("n_late"))
    return first.join(late, "proposal_id").withColumn("takes_effect", F.col("status") == CONFIRMED)


def latest_state(history: DataFrame) -> DataFrame:
    """Each station's last validated state, by date, then id. (JN-19, WIN-15, Q-13)"""
    order = Window.partitionBy("station").orderBy(F.desc("at"), F.desc("id"))
    return history.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def effective_states(declared: DataFrame, latest: DataFrame, pending: DataFrame) -> DataFrame:
    """Declared states replaced by validated ones, and flags for validated and pending. (JN-03, JN-04)"""
    v = latest.select("station", F.col("state").alias("_v"))
    p = pending.select("station").distinct().withColumn("_p", F.lit(True))
    joined = declared.join(v, "station", "left").join(p, "station", "left")
    return joined.select("station", F.coalesce("_v", "state").alias("state"), F.col("_v").isNotNull().alias("validated"), F.col("_p").isNotNull().alias("pending"))


def proposal_stats(proposals: DataFrame) -> DataFrame:
    """Counts by status, and the share of answers that were right in percent (null without answers). (AGG-21)"""
    count = lambda s: F.count_if(F.col("status") == s)
    right, wrong = count(CONFIRMED) + count(REPAIRED), count(FALSE_ALARM)
    return proposals.agg(F.count("*").alias("n"), *[count(s).alias(f"n_{s}") for s in (PENDING, CONFIRMED, REPAIRED, FALSE_ALARM, VOID)], (F.lit(100.0) * right / F.nullif(right + wrong, F.lit(0))).alias("precision_pct"))


def oldest_pending(proposals: DataFrame, now: Column) -> DataFrame:
    """Days since the oldest pending proposal, 0 if there is none. (AGG-23)"""
    return proposals.agg(F.coalesce((micros(now) - micros(F.min(F.when(F.col("status") == PENDING, F.col("at"))))) / float(DAY), F.lit(0.0)).alias("days"))


def declared_state(transmits: Column, n_faults: Column) -> Column:
    """Not transmitting, transmitting with a fault, or running."""
    return F.when(~F.coalesce(transmits, F.lit(False)), STATES[2]).when(F.coalesce(n_faults, F.lit(0)) > 0, STATES[1]).otherwise(STATES[0])


# What a proposal's status is called on a page.
STATUS_LABELS = {PENDING: "En attente de vérification", VOID: "Sans objet (problème disparu)"}


def _decoded(proposals: DataFrame) -> DataFrame:
    """Proposals with ``sensors`` as a map (from JSON text, if it is text; empty if it is none) and the label of their status. (ST-06, SCA-json)"""
    sensors = F.from_json("sensors", "map<string,string>") if dict(proposals.dtypes)["sensors"] == "string" else F.col("sensors")
    known = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return proposals.withColumns({"sensors": F.coalesce(sensors, F.create_map().cast("map<string,string>")), "status_label": F.coalesce(F.try_element_at(known, F.col("status")), F.col("status"))})


def encoded(proposals: DataFrame) -> DataFrame:
    """Proposals with ``sensors`` as JSON text. (SCA-json)"""
    return proposals.withColumn("sensors", F.to_json("sensors"))


def pending_proposals(proposals: DataFrame) -> DataFrame:
    """Those that wait for an answer, the oldest first. (ST-06)"""
    return _decoded(proposals.where(F.col("status") == PENDING)).orderBy("created_at", "id")


def proposal_journal(proposals: DataFrame, station: str | None = None, limit: int = 200) -> DataFrame:
    """The last proposals, of one station or all, the newest first. (ST-06, SRT-03)"""
    own = proposals.where(F.col("station") == station) if station is not None else proposals
    return _decoded(own.orderBy(F.desc("created_at"), F.desc("id")).limit(limit))


def one_pending(proposals: DataFrame) -> DataFrame:
    """Proposals of which each station has at most one pending: of several the first stays so, the others become void. (ST-02)"""
    order = Window.partitionBy("station", F.col("status") == PENDING).orderBy("created_at", "id")
    extra = (F.col("status") == PENDING) & (F.row_number().over(order) > 1)
    return proposals.withColumn("_extra", extra).withColumn("status", F.when(F.col("_extra"), VOID).otherwise(F.col("status"))).drop("_extra")


def synchronise(proposals: DataFrame, detected: DataFrame, now: Column, dry_run: bool = False) -> DataFrame:
    """What a comparison with the network does to the proposals: the actions (dry run), or the table after them. (ST-03, ST-04, ST-07)

    ``detected``: station, state, declared, justified, reason, sensors (map), rules, provenance. A
    justified divergence opens a proposal or enriches the station's pending one; a pending one without
    it becomes void. At most one proposal of a station is pending afterwards. What is enriched takes
    the new state, reason, sensors and rules, even where these say nothing (no sensors are an empty
    map, no rules an empty text); it keeps its date, the state declared when it was opened, and its
    provenance unless there is a new one. A justified state that isn't one of ``STATES`` is an error.
    """
    proposals = one_pending(proposals)
    pending = proposals.where(F.col("status") == PENDING)
    actions = proposal_merge(pending, detected)
    if dry_run:
        return actions
    d = detected.select("station", *[F.col(c).alias(f"_{c}") for c in ("state", "declared", "reason", "sensors", "rules", "provenance")])
    acts = F.col("action").isin("open", "enrich")
    strange = F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce("_state", F.lit("none")))).cast("string")
    known = F.when(acts & ~F.coalesce(F.col("_state").isin(*STATES), F.lit(False)), strange).otherwise(F.col("_state"))
    told = actions.select("station", "action").join(d, "station", "left").withColumns({"_state": known, "_sensors": F.coalesce("_sensors", F.create_map().cast("map<string,string>")), "_rules": F.coalesce("_rules", F.lit(""))})
    mine = F.col("status") == PENDING
    enriched, closed = mine & (F.col("action") == "enrich"), mine & (F.col("action") == "close")
    new = {"proposed": "_state", "reason": "_reason", "sensors": "_sensors", "rules": "_rules"}
    kept = proposals.join(told, "station", "left").withColumns(
        {c: F.when(enriched, F.col(x)).otherwise(F.col(c)) for c, x in new.items()}
        | {"provenance": F.when(enriched, F.coalesce("_provenance", "provenance")).otherwise(F.col("provenance")), "updated_at": F.when(enriched | closed, now).otherwise(F.col("updated_at")), "status": F.when(closed, VOID).otherwise(F.col("status"))}
    )
    opened = told.where("action = 'open'").select(
        F.sha2(F.concat_ws("|", "station", now.cast("string")), 256).alias("id"), "station", F.col("_declared").alias("declared"), F.col("_state").alias("proposed"), F.col("_reason").alias("reason"), F.col("_sensors").alias("sensors"), F.col("_rules").alias("rules"),
        F.col("_provenance").alias("provenance"), now.alias("created_at"), now.alias("updated_at"), F.lit(PENDING).alias("status"),
    )
    return kept.select(proposals.columns).unionByName(opened, allowMissingColumns=True)
