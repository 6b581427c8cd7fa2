"""Stable host identities from DHCP: bindings, leases, assets, as-of resolution.

Bindings are few against events. Resolution never joins ranges: each address has sorted lists of its bindings, one for each
block of time, blocks being so long that a list holds about SHORT of them; a list is searched by halving. Where the bindings
are counted to be few, the lists go to the events; else events and lists meet by address and block. Where lists get long all
the same, events and bindings of an address and day go into one window and each event takes the last binding before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import scalars as S
from wirelake.operators.common import cut

#: Bindings, and addresses with bindings, of at most about 60 bytes each that may be broadcast.
FEW = 200_000
#: Bindings that a list is to hold, and the most that one may hold if it is put beside each of its events in a shuffle.
SHORT, LONG = 4, 128
DAY_MS = 86_400_000
#: Lists of each address that the blocks after the last binding share by turns, so that its events there are so many tasks.
TAILS = 32
DEFAULT_LEASE_S = 3600


def dhcp_bindings(dhcp: DataFrame, raw: bool = False) -> DataFrame:
    """event_time, mac (upper case), ip, hostname (lower case), lease_s of events that hold a MAC and an address.

    raw: also raw_mac, the MAC as the event writes it, by which vendors are looked up.
    """
    ip = F.nullif(F.col("assigned_addr"), F.lit(""))
    if "client_addr" in dhcp.columns:
        ip = F.coalesce(ip, F.nullif(F.col("client_addr"), F.lit("")))
    lease = F.when(F.col("lease_time") > 0, F.col("lease_time")).otherwise(DEFAULT_LEASE_S)
    rows = dhcp.select("event_time", F.upper("mac").alias("mac"), ip.alias("ip"), F.lower(F.trim(F.coalesce("host_name", F.lit("")))).alias("hostname"), lease.alias("lease_s"), *([F.col("mac").alias("raw_mac")] if raw else []))
    return rows.filter("mac <> '' AND ip IS NOT NULL")


def ip_leases(bindings: DataFrame, honor_lease: bool = False) -> DataFrame:
    """ip, mac, start, end: until the address's next binding (null: open), or the lease's end if that is sooner."""
    by_ip = Window.partitionBy("ip").orderBy("event_time", "mac")
    end = F.lead("event_time").over(by_ip)
    if honor_lease:
        end = F.least(end, F.col("event_time") + F.col("lease_s") * 1000)
    return bindings.select("ip", "mac", F.col("event_time").alias("start"), end.alias("end"))


def ip_conflicts(bindings: DataFrame) -> DataFrame:
    """Bindings of an address that another MAC held, with that MAC."""
    before = F.lag("mac").over(Window.partitionBy("ip").orderBy("event_time", "mac"))
    return bindings.withColumn("old_mac", before).filter("old_mac <> mac").select("event_time", "ip", "old_mac", "mac")


def mac_assets(bindings: DataFrame) -> DataFrame:
    """mac, root (the MAC whose first sight made the asset), first_seen of the root.

    A new randomised MAC whose host name was seen before belongs to the asset of the last binding with that
    name. Each such MAC points to the binding's MAC at which the name's run of such MACs began; these pointers are
    followed by doubling, so a chain over n names takes log n rounds. Rounds are written to the checkpoint folder where
    one is set.
    """
    by_name = Window.partitionBy("hostname").orderBy("event_time", "mac", "ip")
    first = Window.partitionBy("mac").orderBy("event_time", "ip")
    ranked = cut(bindings.filter("hostname IS NOT NULL").select("mac", "ip", "event_time", "hostname").withColumn("rank", F.row_number().over(first)), "ranked")
    # bindings without a name belong to no name's window, where they could be one task's
    # a row that is no MAC's first sight, or of no randomised one, ends the run of pointers through its name
    stays = (F.col("rank") > 1) | ~F.coalesce(S.is_local_mac(F.col("mac")), F.lit(False)) | (F.row_number().over(by_name) == 1)
    named = ranked.filter("hostname <> ''").withColumn("_stays", stays)
    named = named.withColumn("named", F.last(F.when(F.col("_stays"), F.col("mac")), ignorenulls=True).over(by_name.rowsBetween(Window.unboundedPreceding, -1)))
    rows = named.filter("rank = 1").select("mac", "event_time", F.when(~F.col("_stays"), F.col("named")).alias("named"))
    rows = rows.unionByName(ranked.filter("hostname = '' AND rank = 1").select("mac", "event_time", F.lit(None).cast("string").alias("named")))
    links = rows.select("mac", F.coalesce("named", "mac").alias("root"), F.col("event_time").alias("first_seen"))
    links = cut(links, "links")
    while True:
        up = links.select(F.col("mac").alias("_mac"), F.col("root").alias("_root"))
        further = links.join(up, F.col("root") == F.col("_mac")).select("mac", F.col("_root").alias("root"), "first_seen", (F.col("_root") != F.col("root")).alias("moved"))
        further = cut(further, "links")
        done = further.filter("moved").limit(1).count() == 0
        links = further.drop("moved")
        if done:
            break
    seen = links.select(F.col("mac").alias("_mac"), F.col("first_seen").alias("_seen"))
    return links.join(seen, F.col("root") == F.col("_mac")).select("mac", "root", F.col("_seen").alias("first_seen"))


def asset_ids(assets: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """mac, ip, asset_id (AST-0001 on, by first sight): assets by MAC, then addresses without a lease.

    The numbers go over the different assets alone, not over events: within ranges of first sight, after the
    counts of the ranges before; one row for each range is all that one task sees.
    """
    keys = assets.select(F.col("root").alias("key"), "first_seen").distinct()
    if fallback is not None:
        fallback = cut(fallback, "unleased")  # it comes from all events: worked out once
        keys = keys.unionByName(fallback.select(F.col("ip").alias("key"), "first_seen"))
    # ranges of first sight are written with their place, so that counts and rows speak of the same ranges
    ranges = cut(keys.repartitionByRange("first_seen", "key").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"))
    number = F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy("first_seen", "key"))
    named = ranges.join(ahead, "range").select("key", F.format_string("AST-%04d", number).alias("asset_id"))
    out = assets.select("mac", F.lit(None).cast("string").alias("ip"), F.col("root").alias("key"))
    if fallback is not None:
        out = out.unionByName(fallback.select(F.lit(None).cast("string").alias("mac"), "ip", F.col("ip").alias("key")))
    return out.join(named, "key").select("mac", "ip", "asset_id")


def resolve_ip(events: DataFrame, bindings: DataFrame, ip: str = "src_ip", few: int = FEW) -> DataFrame:
    """The events with mac: of the address's last binding at or before their time, else null.

    Up to so many bindings, their lists go to the events, which stay where they are. With more bindings of few addresses, only
    the events of these addresses move; else all with an address do. Events of null address never move.
    """
    # a binding without a MAC (there is none from dhcp_bindings) tells nothing
    bindings = bindings.filter("mac IS NOT NULL AND event_time IS NOT NULL").select("ip", "event_time", "mac")
    span = bindings.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ip").alias("addresses"), F.min("event_time").alias("first"), F.max("event_time").alias("last")).first()
    n, addresses = span["n"], span["addresses"]
    if not n:
        return events.withColumn("mac", F.lit(None).cast("string"))
    blocks = math.ceil(n / max(1, addresses) / SHORT)
    if n <= few:
        lists, *shape = _lists(bindings, span["first"], span["last"], blocks)
        return _looked_up(events, lists, span["first"], *shape, ip, "broadcast")
    known = F.col(ip).isNotNull()
    if addresses <= few:
        held = F.broadcast(bindings.select(F.col("ip").alias("_held")).distinct())
        rest = events.join(held, F.col(ip) == F.col("_held"), "left_anti")  # null addresses among them
        events = events.join(held, F.col(ip) == F.col("_held"), "left_semi")
    else:
        rest, events = events.filter(~known), events.filter(known)
    # an address of many events is split by day at least
    lists, *shape = _lists(bindings, span["first"], span["last"], max(blocks, math.ceil((span["last"] - span["first"] + 1) / DAY_MS)), TAILS)
    found = _looked_up(events, lists, span["first"], *shape, ip, "shuffle_hash", TAILS) if shape[-1] <= LONG else _by_windows(events, bindings, ip)
    return found.unionByName(rest.withColumn("mac", F.lit(None).cast("string")))


def last_before(times: Column, values: Column, t: Column, most: int) -> Column:
    """Of values whose sorted times are at most t the last one, else null, by halving; most: the longest list's length.

    For short lists the halving is written out, which is compiled; for others it is a loop.
    """
    if most < 32:
        return _halved(times, values, t, 0, most)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(int(most).bit_length()))))
    n = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(times, low + step - 1) <= t, low + step).otherwise(low))
    return F.when(n > 0, F.get(values, n - 1))


def _halved(times: Column, values: Column, t: Column, low: int, high: int) -> Column:
    """The value before place n, where n, the number of times up to t, lies from low to high."""
    if low == high:
        return F.get(values, F.lit(low - 1)) if low else F.lit(None)
    middle = (low + high) // 2
    return F.when(F.get(times, F.lit(middle)) <= t, _halved(times, values, t, middle + 1, high)).otherwise(_halved(times, values, t, low, middle))


def _lists(bindings: DataFrame, first: int, last: int, blocks: int, tails: int = 0) -> tuple[DataFrame, int, int, int]:
    """(_held, _block, _times, _macs; a block's length; the last block; the longest list's length): the span from first to last in
    so many blocks, and tails after the last one. A list begins with the address's last binding before its block.
    """
    length = max(1, math.ceil((last - first + 1) / blocks))
    last_block = (last - first) // length
    # of equal times the last MAC counts
    rows = bindings.groupBy("ip", "event_time").agg(F.max("mac").alias("mac")).withColumn("_block", _block_of(F.col("event_time"), first, length))
    until = F.coalesce(F.lead("_block").over(Window.partitionBy("ip").orderBy("event_time")), F.lit(last_block + tails))
    rows = rows.withColumn("_blocks", F.sequence("_block", F.greatest("_block", until)))
    rows = rows.select("ip", F.explode("_blocks").alias("_block"), F.struct("event_time", "mac").alias("_binding"))
    lists = rows.groupBy("ip", "_block").agg(F.sort_array(F.collect_list("_binding")).alias("_list"))
    lists = cut(lists.select(F.col("ip").alias("_held"), "_block", F.col("_list.event_time").alias("_times"), F.col("_list.mac").alias("_macs")), "lists")
    most = lists.agg(F.max(F.size("_times"))).first()[0] or 0
    return lists, length, last_block, most


def _block_of(t: Column, first: int, length: int) -> Column:
    return F.floor((t - F.lit(first)) / F.lit(length))


def _looked_up(events: DataFrame, lists: DataFrame, first: int, length: int, last_block: int, most: int, ip: str, how: str, tails: int = 0) -> DataFrame:
    """how: broadcast, or shuffle_hash for lists that are too many for that."""
    block = _block_of(F.col("event_time"), first, length)
    block = F.when(block > last_block, last_block + 1 + F.pmod(block, F.lit(tails)) if tails else F.lit(last_block)).otherwise(block)
    found = last_before(F.col("_times"), F.col("_macs"), F.col("event_time"), most)
    rows = events.join(lists.hint(how), (F.col(ip) == F.col("_held")) & (block == F.col("_block")), "left")
    return rows.select(*(F.col(c) for c in events.columns), found.alias("mac"))


def _by_windows(events: DataFrame, bindings: DataFrame, ip: str) -> DataFrame:
    """An address of many events is split by day: each day starts from the last binding before it, so the
    busiest address is as many tasks as days.
    """
    names = events.columns
    day = S.day_of(F.col("_t"))
    left = events.select(F.col(ip).alias("_ip"), F.col("event_time").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_mac"), F.struct(*names).alias("_event"))
    right = bindings.select(F.col("ip").alias("_ip"), F.col("event_time").alias("_t"), F.lit(0).alias("_kind"), F.col("mac").alias("_mac"), F.lit(None).cast(left.schema["_event"].dataType).alias("_event"))
    # carry-in: for each binding, the days until the next one start with it
    reach = F.lead("event_time").over(Window.partitionBy("ip").orderBy("event_time", "mac"))
    last = events.agg(F.max("event_time").alias("_last"))
    carried = bindings.withColumn("_next", reach).crossJoin(F.broadcast(last))  # one row
    carried = carried.withColumn("_days", F.sequence(S.day_of(F.col("event_time")) + 1, F.greatest(S.day_of(F.col("event_time")) + 1, S.day_of(F.coalesce("_next", "_last")))))
    carried = carried.select(F.col("ip").alias("_ip"), F.explode("_days").alias("_day"), F.lit(-1).alias("_kind"), F.col("mac").alias("_mac"), F.col("event_time").alias("_t"))
    rows = left.unionByName(right).withColumn("_day", day).unionByName(carried.withColumn("_event", F.lit(None).cast(left.schema["_event"].dataType)))
    order = Window.partitionBy("_ip", "_day").orderBy("_t", "_kind", F.col("_mac").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("mac", F.last("_mac", ignorenulls=True).over(order)).filter("_kind = 1")
    return rows.select(*(F.col("_event")[n].alias(n) for n in names), "mac")


def _told(bindings: DataFrame, ids: DataFrame, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bindings whose mac also tells its asset and type, addresses without a lease with theirs, broadcast where they are few).

    With types only what trackable addresses stand for is told. It is joined to the bindings, which are fewer than the events, so
    the events move for the as-of lookup alone. The MAC comes first, so that of equal times the last one still counts.
    """
    named = ids.withColumn("_kind", F.lit(None).cast("string"))
    if types is not None:
        named = ids.join(types.select(F.col("asset_id").alias("_typed"), F.col("asset_type").alias("_kind")), F.col("asset_id") == F.col("_typed"), "left")
    named = cut(named.select("mac", "ip", "asset_id", "_kind"), "told")  # ids may look at all events: worked out once
    by_mac = named.filter("mac IS NOT NULL").select(F.col("mac").alias("_by_mac"), F.col("asset_id").alias("_mac_asset"), F.col("_kind").alias("_mac_kind"))
    tracked = S.is_trackable_ip(F.col("ip")) if types is not None else F.lit(True)
    known = lambda c: F.when(tracked, F.col(c))
    told = F.concat_ws("\0", "mac", F.coalesce(known("_mac_asset"), F.lit("")), F.coalesce(known("_mac_kind"), F.lit("")))
    bound = bindings.filter("mac IS NOT NULL").join(by_mac, F.col("mac") == F.col("_by_mac"), "left").select("ip", "event_time", told.alias("mac"))
    by_ip = named.filter(F.col("ip").isNotNull() & tracked).select(F.col("ip").alias("_by_ip"), F.col("asset_id").alias("_ip_asset"), F.col("_kind").alias("_ip_kind"))
    return cut(bound, "told"), F.broadcast(by_ip) if by_ip.count() <= FEW else by_ip


def _part(i: int) -> Column:
    """A part of what a binding tells; null for an empty one."""
    return F.nullif(F.split_part("mac", F.lit("\0"), F.lit(i + 1)), F.lit(""))


def asset_columns(events: DataFrame, bindings: DataFrame, ids: DataFrame, types: DataFrame, ip: str = "src_ip") -> DataFrame:
    """The events with asset_id and asset_type of a trackable source, empty where unknown.

    ids: mac, ip, asset_id (asset_ids with its fallback); types: asset_id, asset_type. The asset is that of the
    MAC that holds the address at the event's time, else that of an address without a lease.
    """
    bound, by_ip = _told(bindings, ids, types)
    rows = resolve_ip(events.drop("asset_id", "asset_type"), bound, ip)
    rows = rows.join(by_ip, F.col("mac").isNull() & (F.trim(F.col(ip)) == F.col("_by_ip")), "left")
    rows = rows.withColumns({"asset_id": F.coalesce(_part(1), "_ip_asset", F.lit("")), "asset_type": F.coalesce(_part(2), "_ip_kind", F.lit(""))})
    return rows.drop("mac", "_by_ip", "_ip_asset", "_ip_kind")


def with_asset(rows: DataFrame, bindings: DataFrame, ids: DataFrame, ip: str = "ip") -> DataFrame:
    """rows with asset_id: of the MAC that holds the address at event_time, else of the address; null where neither is known."""
    bound, by_ip = _told(bindings, ids)
    found = resolve_ip(rows, bound, ip).join(by_ip, F.col("mac").isNull() & (F.col(ip) == F.col("_by_ip")), "left")
    return found.select(*(F.col(c) for c in rows.columns), F.coalesce(_part(1), "_ip_asset").alias("asset_id"))


def fallback_assets(resolved: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Trackable addresses seen without a lease, each its own asset: ip, first_seen."""
    rows = resolved.filter(F.col("mac").isNull() & S.is_trackable_ip(F.col(ip)))
    return rows.groupBy(F.trim(F.col(ip)).alias("ip")).agg(F.min("event_time").alias("first_seen"))


def unleased(events: DataFrame, bindings: DataFrame, ip: str = "src_ip") -> DataFrame:
    """What fallback_assets gives of the resolved events, without a lookup: an address has no MAC before its first binding alone."""
    first = bindings.filter("mac IS NOT NULL").groupBy(F.col("ip").alias("_held")).agg(F.min("event_time").alias("_first"))
    seen = events.groupBy(F.col(ip).alias("_ip")).agg(F.min("event_time").alias("_seen"), F.max(F.col("event_time").isNull()).alias("_untimed"))
    rows = seen.filter(S.is_trackable_ip(F.col("_ip"))).join(first, F.col("_ip") == F.col("_held"), "left")
    early = F.col("_first").isNull() | (F.col("_seen") < F.col("_first"))
    return rows.filter(early | F.col("_untimed")).groupBy(F.trim("_ip").alias("ip")).agg(F.min(F.when(early, F.col("_seen"))).alias("first_seen"))


def asset_known_ips(bindings: DataFrame, assets: DataFrame) -> DataFrame:
    """Per asset (root MAC) its addresses now: those of which it has the last binding."""
    last = F.row_number().over(Window.partitionBy("ip").orderBy(F.desc("event_time"), F.desc("mac")))
    held = bindings.withColumn("_n", last).filter("_n = 1").select("ip", "mac")
    return held.join(assets.select("mac", "root"), "mac").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("ip")), ",").alias("ips"))


def resolver_metrics(resolved: DataFrame, bindings: DataFrame) -> DataFrame:
    """Events resolved or not, bindings and conflicts."""
    hits = resolved.agg(F.count_if(F.col("mac").isNotNull()).alias("hits"), F.count_if(F.col("mac").isNull()).alias("misses"))
    more = bindings.agg(F.count(F.lit(1)).alias("dhcp_events")).crossJoin(F.broadcast(ip_conflicts(bindings).agg(F.count(F.lit(1)).alias("conflicts"))))
    return hits.crossJoin(F.broadcast(more))  # one row each
