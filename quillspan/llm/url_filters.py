"""Temporal URL lists: dated entries become validity intervals, and an as-of join judges each capture by its fetch time.

An entry (domain, action, listed_at) holds for the domain and all hosts below it until the domain's next entry;
``remove`` ends what stood before. For each host the entries of all its parent domains are laid out on one time line of
intervals, in which the most specific domain with an active entry decides. Captures then join that time line on the host and
a time bucket, with the interval as a residual condition, so each capture meets one interval at most: nothing needs to be
grouped by capture afterwards. Only hot hosts have buckets of time, by their own captures, so intervals are not repeated for
the others, and the buckets of all hot hosts together have a fixed bound. A short domain's entries are repeated for each of
``SALTS`` keys, over which the hosts below it are dealt out. Only DataFrame functions.

Defined cases: captures without a host or a fetch time, or before the first entry, are ``none``; entries without a domain
or a date are ignored; of entries of one domain and date ``block`` wins over ``allow`` and ``allow`` over ``remove``; equal
captures stay separate rows; columns named like the results are replaced; empty tables give ``none`` or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A host is hot with more captures than this and than one part in ``HOT`` of all; so there are fewer than ``HOT`` hot hosts.
LEAST, HOT = 4096, 65_536
#: Captures that no entry can reach (no host, no time) are spread over so many keys.
SPREAD = 1024
#: Domains of so few labels (``com``, ``co.uk``) have many hosts below them, which are dealt out over so many keys.
SHORT, SALTS = 2, 32
#: From weak to strong, for entries of one domain and date.
ACTIONS = ("remove", "allow", "block")


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty for what isn't an absolute URL."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains as array<struct<level, domain>>; level is the number of labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("domain")))


def dated(entries: DataFrame) -> DataFrame:
    """(domain, listed_at, action): one entry for each domain and date."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower("action"))
    clean = entries.select(F.lower(F.trim("domain")).alias("domain"), F.col("listed_at").cast("timestamp").alias("listed_at"), rank.alias("rank"))
    best = clean.filter("domain <> '' and listed_at is not null and rank > 0").groupBy("domain", "listed_at").agg(F.max("rank").alias("rank"))
    return best.select("domain", "listed_at", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to): an entry holds until the domain's next one; the last has no end."""
    after = F.lead("listed_at").over(Window.partitionBy("domain").orderBy("listed_at"))
    return dated(entries).select("domain", "action", F.col("listed_at").alias("valid_from"), after.alias("valid_to"))


def time_lines(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, valid_from, valid_to, matched_domain, listed_at, action): each host's intervals, most specific entry first."""
    parts = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("s")).select("host", "s.level", "s.domain", F.when(F.col("s.level") <= SHORT, F.pmod(F.xxhash64("host"), F.lit(SALTS))).otherwise(0).alias("salt"))
    short = F.size(F.split("domain", r"\.")) <= SHORT
    listed = dated(entries).withColumn("salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    events = written(parts.join(listed, ["domain", "salt"]).select("host", "level", "domain", "listed_at", "action"), "events")
    turns = events.select("host", F.col("listed_at").alias("at")).distinct()
    levels = events.select("host", "level", "domain").distinct()
    seen = F.struct("listed_at", "action")
    both = events.select("host", "level", "domain", F.col("listed_at").alias("at"), seen.alias("e")).union(turns.join(levels, "host").select("host", "level", "domain", "at", F.lit(None).cast("struct<listed_at:timestamp,action:string>")))
    merged = both.groupBy("host", "level", "domain", "at").agg(F.max("e").alias("e"))
    standing = F.last("e", ignorenulls=True).over(Window.partitionBy("host", "level").orderBy("at"))
    state = merged.select("host", "level", "domain", "at", standing.alias("e"))
    choice = F.max(F.when(F.col("e.action").isin("allow", "block"), F.struct("level", "domain", "e")))
    line = state.groupBy("host", "at").agg(choice.alias("c"))
    until = F.lead("at").over(Window.partitionBy("host").orderBy("at"))
    return line.select("host", F.col("at").alias("valid_from"), until.alias("valid_to"), F.col("c.domain").alias("matched_domain"), F.col("c.e.listed_at").alias("listed_at"), F.col("c.e.action").alias("action"))


def hot_hosts(hosts: DataFrame) -> DataFrame:
    """(h, start, width) of hosts(host, n, first, last) that take more than one bucket, by the host's hash, marked for broadcast.

    Buckets hold ``LEAST`` captures on average, or more where that would make over ``HOT`` of them; so the rows, of fixed size,
    are fewer than ``HOT`` whatever the captures are. Hosts of equal hash share their buckets' width.
    """
    total = hosts.agg(F.sum("n")).first()[0] or 0
    each = max(LEAST, -(-total // HOT))
    span = F.max("last") - F.min("first")
    width = F.floor(span / F.ceil(F.sum("n") / F.lit(each))).cast("bigint") + 1
    return F.broadcast(hosts.filter(F.col("n") > each).groupBy(F.xxhash64("host").alias("h")).agg(F.min("first").alias("start"), width.alias("width")))


def _bucket(t: Column) -> Column:
    return F.coalesce(F.floor((t - F.col("start")) / F.col("width")), F.lit(0).cast("bigint"))


def bucketed(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """(host, b, lo, hi, ...): intervals within their host's first and last capture, one row for each bucket of a hot host that they touch."""
    spans = lines.select("*", F.unix_micros("valid_from").alias("lo"), F.coalesce(F.unix_micros("valid_to"), F.col("last") + 1).alias("hi")).filter("lo <= last and hi > first")
    at = spans.withColumn("h", F.xxhash64("host")).join(hot, "h", "left")
    buckets = F.sequence(_bucket(F.greatest("lo", "first")), _bucket(F.least(F.col("hi") - 1, F.col("last"))))
    return at.select("host", "matched_domain", "listed_at", "action", "lo", "hi", F.explode(buckets).alias("b"))


def temporal_join(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """All columns of ``captures`` with host, action (block, allow or none), matched_domain, listed_at and blocked."""
    made = ("host", "action", "matched_domain", "listed_at", "blocked")
    names = [c for c in captures.columns if c not in made]
    keyed = captures.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in names], host_of(F.col(f"`{url_col}`")).alias("host"), F.unix_micros(F.col(f"`{time_col}`").cast("timestamp")).alias("t"))
    # hosts and their events are written once: three steps read them, and captures are not scanned again for each
    hosts = written(keyed.filter("host <> '' and t is not null").groupBy("host").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")), "hosts")
    hot = hot_hosts(hosts)
    lines = time_lines(hosts.select("host"), entries).filter("action is not null")
    cut = bucketed(lines.join(hosts.select("host", "first", "last"), "host"), hot)
    reached = (F.col("host") != "") & F.col("t").isNotNull()
    idle = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    placed = keyed.withColumn("h", F.xxhash64("host")).join(hot, "h", "left")
    x, y = placed.withColumn("b", F.when(reached, _bucket(F.col("t"))).otherwise(idle)).alias("x"), cut.alias("y")
    met = x.join(y, (F.col("x.host") == F.col("y.host")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.t") >= F.col("y.lo")) & (F.col("x.t") < F.col("y.hi")), "left")
    return met.select(
        *[F.col(f"x.c_{c}").alias(c) for c in names],
        F.col("x.host").alias("host"),
        F.coalesce("y.action", F.lit("none")).alias("action"),
        F.col("y.matched_domain").alias("matched_domain"),
        F.col("y.listed_at").alias("listed_at"),
        (F.coalesce("y.action", F.lit("none")) == "block").alias("blocked"),
    )
