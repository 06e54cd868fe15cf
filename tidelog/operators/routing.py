"""Brokers, routes and clients; all of these tables are small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a broker group.
READ_WRITE, READ, WRITE, NEITHER = 1, 3, 2, 4


def routed(subjects: DataFrame, groups: DataFrame) -> DataFrame:
    """(subject, group_name, ...) of the groups that a subject's JSON list names and that exist."""
    names = F.explode(F.from_json("broker_groups", "array<string>"))
    return subjects.select("subject", names.alias("group_name")).distinct().join(groups, "group_name")


def available(subjects: DataFrame, groups: DataFrame, default: str) -> DataFrame:
    """(subject, group_name) by tag: the subject's groups, or the default tag's if it has none, that can read or write."""
    usable = groups.filter(F.col("broker_state") != NEITHER)
    own = subjects.join(groups.select("tag").distinct().withColumn("_known", F.lit(True)), "tag", "left")
    chosen = own.withColumn("tag", F.when(F.col("_known"), F.col("tag")).otherwise(default)).drop("_known")
    return chosen.join(usable, "tag").select("subject", "group_name")


def _names(groups: DataFrame) -> Column:
    """All groups' names as one array; broker groups are a dimension of at most some thousands."""
    return groups.agg(F.array_sort(F.collect_set("group_name"))).scalar()


def idle_groups(subjects: DataFrame, groups: DataFrame) -> DataFrame:
    """(subject, group_name) of the groups that a subject could still be given."""
    left = F.array_except(_names(groups), F.from_json("broker_groups", "array<string>"))
    return subjects.select("subject", F.explode(left).alias("group_name"))


def delay_route(clients: DataFrame, groups: DataFrame) -> DataFrame:
    """(client_id, groups): producers of delayed messages send to any group of that kind."""
    return clients.filter("client_type = 'producer'").select("client_id", _names(groups.filter("kind = 'delay'")).alias("groups"))


def writable(routes: DataFrame, readonly: DataFrame) -> DataFrame:
    """Routes without those set read-only for the subject or for all ("*"); two joins by key."""
    for_all = readonly.filter("subject = '*'").select("group_name")
    return routes.join(readonly.filter("subject <> '*'"), ["subject", "group_name"], "left_anti").join(for_all, "group_name", "left_anti")


def client_states(clients: DataFrame, states: DataFrame) -> DataFrame:
    """The clients with `state`: their own, else that of all clients of the subject and group, else of the client everywhere, else online."""
    own = states.filter("client_id <> '*' AND subject <> '*'").withColumnRenamed("state", "_own")
    group = states.filter("client_id = '*'").select("subject", "group", F.col("state").alias("_group"))
    client = states.filter("client_id <> '*' AND subject = '*'").select("client_id", F.col("state").alias("_client"))
    found = clients.join(own, ["client_id", "subject", "group"], "left").join(group, ["subject", "group"], "left").join(client, "client_id", "left")
    return found.withColumn("state", F.coalesce("_own", "_group", "_client", F.lit("online"))).drop("_own", "_group", "_client")


def sync_peers(brokers: DataFrame) -> DataFrame:
    """(group_name, role, address, peer): slaves follow the group's master, backups its slave."""
    leads = brokers.select("group_name", F.col("role").alias("_lead"), F.col("address").alias("peer"))
    wanted = F.when(F.col("role") == "slave", "master").when(F.col("role") == "backup", "slave")
    return brokers.withColumn("_lead", wanted).join(leads, ["group_name", "_lead"], "left").drop("_lead")


def visible(routes: DataFrame, client_type: str) -> DataFrame:
    """What a client sees of its route: consumers groups that can be read, producers those that can be written, numbered from 0."""
    states = [READ_WRITE, READ] if client_type == "consumer" else [READ_WRITE, WRITE]
    good = routes.filter(F.col("broker_state").isin(states) & (F.trim("group_name") != ""))
    return good.withColumn("index", F.row_number().over(Window.partitionBy("subject").orderBy("group_name")) - 1)


def merged_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group_name, master, failures): groups whose master stayed keep their failures, others begin at 0."""
    kept = old.select("group_name", "master", F.col("failures").alias("_failures"))
    return new.join(kept, ["group_name", "master"], "left").select("group_name", "master", F.coalesce("_failures", F.lit(0)).cast("long").alias("failures"))


def extended(routes: DataFrame, add: Column, remove: Column) -> DataFrame:
    """Routes (subject, names) with groups added and removed; the last group of a subject stays."""
    grown = F.array_union("names", add)
    left = F.array_except(grown, remove)
    return routes.withColumn("names", F.sort_array(F.when(F.size(left) == 0, F.slice(F.sort_array(grown), 1, 1)).otherwise(left)))


def consumers_of(clients: DataFrame, endpoint: Column) -> DataFrame:
    """(subject, group, endpoints): the consumers of each group."""
    return clients.filter("client_type = 'consumer'").groupBy("subject", "group").agg(F.array_sort(F.collect_set(endpoint)).alias("endpoints"))


def spread(clients: DataFrame) -> DataFrame:
    """(app_code, subject, rooms): apps whose consumers of a subject are in more than one room."""
    rooms = clients.filter("client_type = 'consumer'").groupBy("app_code", "subject").agg(F.count_distinct("room").alias("rooms"))
    return rooms.filter("rooms > 1")


def alive(beats: DataFrame, now: Column, seconds: int = 200) -> DataFrame:
    """(client_id, last_seen) of the clients heard of within so many seconds."""
    return beats.groupBy("client_id").agg(F.max("ts").alias("last_seen")).filter(F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(seconds)))


def slave_lag(seen: DataFrame, keys: list[str], time: str, written: str, copied: str, seconds: int = 5) -> DataFrame:
    """(keys, caught_up, read_only) by reported positions: when the slave last had all, and whether that is too long ago."""
    last = seen.groupBy(*keys).agg(F.max(F.when(F.col(copied) >= F.col(written), F.col(time))).alias("caught_up"), F.max(time).alias("_last"))
    late = F.col("_last") - F.col("caught_up") > F.make_dt_interval(secs=F.lit(seconds))
    return last.select(*keys, "caught_up", F.coalesce(late, F.lit(True)).alias("read_only"))


# The bits of those who can switch a client off.
SWITCHES = {"health": 1, "ops": 2, "code": 4}


def switches(words: DataFrame, keys: list[str], source: str, on: str, order: str) -> DataFrame:
    """(keys, state, switched_on): the bits that are on by the last word of each source; a client is on with all of them."""
    last = words.groupBy(*keys, source).agg(F.max_by(on, order).alias("_on"))
    bit = F.coalesce(*(F.when(F.col(source) == name, bit) for name, bit in SWITCHES.items()))
    state = last.groupBy(*keys).agg(F.coalesce(F.bit_or(F.when(F.col("_on"), bit)), F.lit(0)).cast("long").alias("state"))
    return state.withColumn("switched_on", F.col("state") == sum(SWITCHES.values()))


def group_list(groups: DataFrame, routes: DataFrame) -> DataFrame:
    """The groups with `subjects`, those that are routed to them."""
    named = routes.groupBy("group_name").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    return groups.join(named, "group_name", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))


def liveness(beats: DataFrame, keys: list[str], now: Column, gone: int = 2 * 24 * 60) -> DataFrame:
    """(keys, last_seen, status): online, offline after three silent minutes, gone for ever after two days (in minutes)."""
    last = beats.groupBy(*keys).agg(F.max("ts").alias("last_seen"))
    silent = now - F.col("last_seen")
    status = F.when(silent >= F.make_dt_interval(mins=F.lit(gone)), "forever").when(silent >= F.make_dt_interval(mins=F.lit(3)), "offline").otherwise("online")
    return last.withColumn("status", status)


def heartbeat_states(beats: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """(group_name, state): neither reads nor writes after so many silent seconds."""
    last = beats.groupBy("group_name").agg(F.max("ts").alias("last_seen"))
    return last.select("group_name", F.when(F.col("last_seen") < now - F.make_dt_interval(secs=F.lit(seconds)), NEITHER).otherwise(READ_WRITE).cast("long").alias("state"))
