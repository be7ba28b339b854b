"""Synthetic activity, the same for the same seed however it is partitioned.

Every random choice is a hash of the seed, the row's id and the choice's name, so rows need no
shared state and no order. Users and items are drawn by Zipf's law with the inverse of the
cumulative weights, kept as one sorted array of fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of the types of events.
EVENT_SHARES = {
    "play": 0.40,
    "pause": 0.10,
    "resume": 0.09,
    "search": 0.15,
    "like": 0.08,
    "dislike": 0.02,
    "comment": 0.04,
    "quality_change": 0.03,
    "purchase": 0.02,
    "subscription": 0.01,
    "log": 0.06,
}
#: Shares of the types of events in a stored data set.
STORED_SHARES = {
    "play": 0.45,
    "pause": 0.12,
    "resume": 0.10,
    "search": 0.15,
    "like": 0.08,
    "dislike": 0.02,
    "comment": 0.04,
    "purchase": 0.02,
    "quality_change": 0.02,
}
#: What is searched for, qualities and plans.
SEARCHES = (
    "avengers", "avatar", "dark knight", "inception", "matrix", "interstellar", "parasite", "spider", "thor", "iron man",
    "black panther", "doctor strange", "guardians", "the", "2024",
)
#: Qualities, plans, shares of premium users and bots, and the size of the pool of addresses.
QUALITIES = ("360p", "720p", "1080p", "4K")
PLANS = ("basic", "standard", "premium")
PREMIUM_SHARE, BOT_SHARE, ADDRESSES = 0.15, 0.02, 50_000


def digits(n: int, *parts: Column) -> Column:
    """A number from the first n hexadecimal digits of a digest; the same in any SQL that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, n), 16, 10).cast("long")


def uniform(seed: int, name: str, *keys: Column) -> Column:
    """0 <= x < 1 from a hash."""
    return digits(13, F.lit(seed), F.lit(name), *keys) / float(1 << 52)


def pick(seed: int, name: str, values: tuple, *keys: Column) -> Column:
    at = F.floor(uniform(seed, name, *keys) * len(values)) + 1
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int"))


def cumulative(weights: list[float]) -> list[float]:
    total, upto, out = sum(weights), 0.0, []
    for w in weights:
        upto += w / total
        out.append(upto)
    return out


def law(n: int, alpha: float) -> tuple[list[float], float, float, float]:
    """Cumulative weights of the head of Zipf's law, their end, and the bounds of the continuous law
    that the tail is drawn from."""
    head = min(n, 64)
    weights = [(i + 1) ** -alpha for i in range(head)]
    low, high = (head + 0.5) ** (1 - alpha), (n + 0.5) ** (1 - alpha)
    edges = cumulative([*weights, (low - high) / (alpha - 1) if n > head else 0.0])[:head]
    return edges, edges[-1] if n > head else 1.0, low, high


def ranked(u: Column, n: int, alpha: float) -> Column:
    """A rank from 0 to n - 1 of probability in proportion to (rank + 1) ** -alpha, for a uniform
    u: the cumulative weights up to ``n`` are inverted as for the continuous law and the result
    is moved to the exact rank at the head, where the law is steep."""
    edges, share, low, high = law(n, alpha)
    at_head = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda acc, e: acc + (u >= e).cast("int"))
    rest = (u - share) / max(1 - share, 1e-12)
    tail = F.least(F.floor(F.pow(F.lit(low) + rest * (high - low), F.lit(1 / (1 - alpha))) - 0.5), F.lit(n - 1)).cast("int")
    return F.when(u < share, at_head).otherwise(tail if n > len(edges) else F.lit(n - 1))


def zipf(spark: SparkSession, n: int, size: int, alpha: float = 1.2, seed: int = 42) -> DataFrame:
    """id, rank."""
    return spark.range(size).select("id", ranked(uniform(seed, "zipf", F.col("id")), n, alpha).alias("rank"))


def by_share(u: Column, shares: dict[str, float]) -> Column:
    edges = cumulative(list(shares.values()))[:-1]
    at = F.aggregate(F.array(*map(F.lit, edges)), F.lit(1), lambda acc, e: acc + (u >= e).cast("int"))
    return F.element_at(F.array(*map(F.lit, shares)), at)


def address(number: Column) -> Column:
    """A dotted address for a number of the pool."""
    h = digits(8, F.lit("address"), number)
    part = lambda by, mod, add: (F.floor(h / by) % mod + add).cast("string")
    return F.concat_ws(".", part(1, 254, 1), part(254, 256, 0), part(254 << 8, 256, 0), part(254 << 16, 254, 1))


def described(ids: DataFrame, ts: Column, seed: int, users: int, items: int, shares: dict[str, float], bot_by_event: bool = False) -> DataFrame:
    """Events for rows of ``ids`` (a column id)."""
    i = F.col("id")
    rows = ids.select(i, ts.alias("timestamp"), ranked(uniform(seed, "user", i), users, 1.5).alias("_u"), ranked(uniform(seed, "item", i), items, 1.2).alias("_v"))
    rows = rows.withColumn("event_type", by_share(uniform(seed, "type", i), shares))
    u = F.col("_u")
    bot = uniform(seed, "bot", i if bot_by_event else u) < BOT_SHARE
    own = F.pmod(digits(8, F.lit("home"), u) + F.floor(uniform(seed, "address", i) * 3), F.lit(ADDRESSES))
    anywhere = F.floor(uniform(seed, "anywhere", i) * ADDRESSES)
    kind = F.col("event_type")
    searches = F.create_map(F.lit("query"), pick(seed, "query", SEARCHES, i))
    qualities = F.create_map(F.lit("quality"), pick(seed, "quality", QUALITIES, i))
    pays = F.create_map(F.lit("amount"), F.format_string("%.2f", 4.99 + 15 * uniform(seed, "amount", i)), F.lit("plan"), pick(seed, "plan", PLANS, i))
    payload = F.when(kind == "search", searches).when(kind == "quality_change", qualities).when(kind.isin("purchase", "subscription"), pays)
    session = F.format_string("sess_%07d", F.floor(F.when(bot, uniform(seed, "session", i)).otherwise(uniform(seed, "session", u)) * 10_000_000))
    return rows.select(
        "id", "timestamp", F.format_string("user_%05d", u).alias("user_id"), "event_type",
        F.when(kind != "search", F.format_string("video_%04d", "_v")).alias("video_id"), address(F.when(bot, anywhere).otherwise(own)).alias("ip"),
        (uniform(seed, "premium", u) < PREMIUM_SHARE).alias("is_premium"), session.alias("session_id"),
        F.coalesce(payload, F.expr("cast(map() as map<string,string>)")).alias("payload"),
    )


def events(spark: SparkSession, n: int, seed: int = 42, rate: int = 1000, users: int = 10_000, items: int = 1_000) -> DataFrame:
    """n events at ``rate`` a second from the start of 2025."""
    ts = F.timestamp_micros(F.lit(1_735_689_600_000_000) + F.floor(F.col("id") * (1_000_000 / rate)).cast("long"))
    return described(spark.range(n), ts, seed, users, items, EVENT_SHARES)


def event_stream(spark: SparkSession, rate: int = 1000, seed: int = 42, burst: float = 1.0, burst_at: float = 0.0, burst_seconds: float = 3.0, **options: str) -> DataFrame:
    """An unbounded stream; from ``burst_at`` on its rate is multiplied by ``burst`` for some seconds.

    The rows of a burst are those of a second source that only passes them in these seconds; a source
    counts its rows, so row n of a source of r rows a second is of second n / r.
    """

    def source(rows: int) -> DataFrame:
        reader = spark.readStream.format("rate").option("rowsPerSecond", rows)
        for key, value in options.items():
            reader = reader.option(key, value)
        return reader.load().select(F.col("value").alias("id"), F.col("timestamp").alias("_ts"))

    ids, more = source(rate), int(rate * (burst - 1))
    if more > 0:
        second = F.col("id") / more
        ids = ids.unionByName(source(more).where((second >= burst_at) & (second < burst_at + burst_seconds)).withColumn("id", F.col("id") + (1 << 40)))
    return described(ids.withColumn("_", F.lit(0)), F.col("_ts"), seed, 10_000, 1_000, EVENT_SHARES)


def stored(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """The flat rows of a stored data set: random moments of 2025, bots by event."""
    second = F.floor(uniform(seed, "second", F.col("id")) * 365 * 86_400)
    ts = F.timestamp_seconds(F.lit(1_735_689_600) + second)
    rows = described(spark.range(n), ts, seed, 100_000, 10_000, STORED_SHARES, bot_by_event=True)
    rows = rows.withColumn("video_id", F.format_string("video_%05d", ranked(uniform(seed, "item", F.col("id")), 10_000, 1.2)))
    return rows.select("timestamp", "user_id", "event_type", "video_id", "ip", "is_premium", "session_id", pick(seed, "quality", QUALITIES, F.col("id")).alias("quality"))


def line(event: str = "") -> Column:
    """A readable line for an event."""
    p = f"{event}." if event else ""
    return F.format_string("[%s] %-15s user=%s %s video=%s ip=%s", F.date_format(f"{p}timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.col(f"{p}event_type"), F.col(f"{p}user_id"), F.when(F.col(f"{p}is_premium"), "*").otherwise(" "), F.rpad(F.coalesce(F.col(f"{p}video_id"), F.lit("-")), 12, " "), F.col(f"{p}ip"))


def random_words(spark: SparkSession, n: int, length: int = 8, seed: int = 42) -> DataFrame:
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(uniform(seed, "letter", F.col("id"), k) * 26) + 1).cast("int"), F.lit(1)))
    return spark.range(n).select("id", F.array_join(letters, "").alias("word"))
