"""Jaccard similarity of users' item sets: exact, by MinHash, and by banded hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import hash32
from rillmark.sources.files import stored

from . import neighbours

PRIME = (1 << 31) - 1
#: Members of a bucket that are compared in one task.
BLOCK = 2000


def family(k: int, seed: int = 42) -> list[tuple[int, int]]:
    """k pairs (a, b) from a fixed congruential sequence; products stay below 2**63."""
    out, x = [], seed
    for _ in range(k):
        pair = []
        for _ in range(2):
            x = (x * 48271 + 11) % PRIME
            pair.append(x)
        out.append((max(1, pair[0]), pair[1]))
    return out


def item_hash(item):
    return F.pmod(hash32(item, "mh"), F.lit(PRIME))


def minima(k: int, seed: int) -> list:
    """Of ``_h``, an item's hash."""
    return [F.min(F.pmod(F.col("_h") * a + b, F.lit(PRIME))).alias(f"_m{i}") for i, (a, b) in enumerate(family(k, seed))]


def signatures(watches: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """user_id, sig: k minima in one aggregation, combined before the shuffle, without exploding."""
    hashed = watches.select("user_id", item_hash(F.col("item")).alias("_h"))
    return hashed.groupBy("user_id").agg(*minima(k, seed)).select("user_id", F.array(*(f"_m{i}" for i in range(k))).alias("sig"))


def profiles(watches: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """user_id, sig (as ints; null without an item that is not null), watched (structs of an item, one for each watch).

    Watches are shuffled once, as rows of two ids, and what is read again is written with a row for each user, which is in one task.
    """
    hashed = watches.repartition("user_id").select("user_id", "item", item_hash(F.col("item")).alias("_h"))
    held = hashed.groupBy("user_id").agg(*minima(k, seed), F.sort_array(F.collect_list(F.struct("item"))).alias("watched"))
    sig = F.when(F.col("_m0").isNotNull(), F.array(*(F.col(f"_m{i}").cast("int") for i in range(k))))
    return stored(held.select("user_id", sig.alias("sig"), "watched"), "profiles")


def watches_of(held: DataFrame) -> DataFrame:
    """user_id, item of the watches in ``profiles``."""
    return held.select("user_id", F.explode("watched").alias("_w")).select("user_id", "_w.item")


def signatures_of(users: DataFrame, watches: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The same for all ``users``: who has seen nothing gets ``PRIME``, which no hash reaches, k times."""
    empty = F.array(*(F.lit(PRIME).cast("long") for _ in range(k)))
    return users.select("user_id").distinct().join(signatures(watches, k, seed), "user_id", "left").select("user_id", F.coalesce("sig", empty).alias("sig"))


def agreement(one, two, k: int):
    equal = F.zip_with(one, two, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda acc, x: acc + x).cast("double") / float(k)


def lsh_threshold(k: int, bands: int) -> float:
    if k % bands:
        raise ValueError("the number of hashes must be a multiple of the number of bands")
    return (1 / bands) ** (bands / k)


def band_keys(sigs: DataFrame, k: int, bands: int) -> DataFrame:
    """user_id, band, key (the band's rows joined)."""
    lsh_threshold(k, bands)
    rows = k // bands
    keys = F.array(*(F.concat_ws("-", *(F.col("sig")[b * rows + r] for r in range(rows))) for b in range(bands)))
    return sigs.select("user_id", F.posexplode(keys).alias("band", "key"))


def packed_keys(sigs: DataFrame, k: int, bands: int) -> DataFrame:
    """``band_keys`` with a long as key, where a band's rows fit in one: minima have 31 bits."""
    rows = k // bands
    if rows > 2:
        return band_keys(sigs, k, bands)
    lsh_threshold(k, bands)
    at = lambda b, r: F.col("sig")[b * rows + r].cast("long")
    keys = F.array(*(at(b, 0) if rows == 1 else F.shiftleft(at(b, 0), 31) + at(b, 1) for b in range(bands)))
    return sigs.select("user_id", F.posexplode(keys).alias("band", "key"))


def in_blocks(keys: DataFrame, member: str) -> DataFrame:
    """band, key, i, j, own, ``member`` of buckets with several members: a bucket of many is cut into blocks of some ``BLOCK``
    members, and a member goes to each pair of blocks that its own is one of. Keys are shuffled once to be counted and laid out: as most
    are single, counts made before a shuffle would be as many rows again. A bucket's members are in one task until it is cut."""
    sized = keys.where("key is not null").withColumn("_n", F.count("*").over(Window.partitionBy("band", "key"))).where("_n > 1")
    laid = sized.withColumn("_b", F.ceil(F.col("_n") / BLOCK).cast("int"))
    laid = laid.withColumn("own", F.pmod(F.xxhash64(member), F.col("_b")).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return laid.select("band", "key", F.least("own", "_x").alias("i"), F.greatest("own", "_x").alias("j"), "own", member)


def candidates(keys: DataFrame) -> DataFrame:
    """u < v that share a band. A bucket is compared block by block, so that a large one is many tasks."""
    laid = in_blocks(keys.select("band", "key", "user_id"), "user_id")
    one, two = laid.withColumnRenamed("own", "p").withColumnRenamed("user_id", "u"), laid.withColumnRenamed("own", "q").withColumnRenamed("user_id", "v")
    here = (F.least("p", "q") == F.col("i")) & (F.greatest("p", "q") == F.col("j"))
    return one.join(two, ["band", "key", "i", "j"]).where(here & F.expr("u < v")).select("u", "v").distinct()


def nearest_by_class(sigs: DataFrame, k: int, bands: int, top: int) -> DataFrame:
    """u, v, similarity, rank: what ``nearest`` gives of the scored candidates, without a row for each pair of users.

    Users with equal signatures are one class. Classes meet in buckets; as a class's users tie, only its top + 1
    least are ever wanted, so what a class is given, itself included, are as many rows, and each of its users takes those
    but itself. Rows grow with the pairs of different signatures and with top for each user, not with the pairs of copies.
    Signatures are shuffled once to be compared, and what was shuffled is read by all that asks for classes.
    """
    members = sigs.select("user_id", "sig").where("sig is not null").withColumn("class", F.min("user_id").over(Window.partitionBy("sig")))
    of_class = Window.partitionBy("class").orderBy("user_id")
    some = members.withColumn("_r", F.row_number().over(of_class)).where(F.col("_r") <= top + 1).select(F.col("class").alias("d"), F.col("user_id").alias("v"))
    own = members.where("class = user_id").select("user_id", "sig")
    pairs = scored(candidates(packed_keys(own, k, bands)), own, k)
    self_ = own.select(F.col("user_id").alias("c"), F.col("user_id").alias("d"), F.lit(1.0).alias("similarity"))
    met = both_ways(pairs).toDF("c", "d", "similarity").unionByName(self_)
    best = Window.partitionBy("c").orderBy(F.desc("similarity"), "v")
    given = met.join(some, "d").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top + 1).select("c", "v", "similarity")
    each = members.select(F.col("class").alias("c"), F.col("user_id").alias("u")).join(given, "c").where("u <> v")
    first = Window.partitionBy("u").orderBy(F.desc("similarity"), "v")
    return each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).select("u", "v", "similarity", "rank")


def scored(pairs: DataFrame, sigs: DataFrame, k: int) -> DataFrame:
    """Adds similarity as the signatures estimate it."""
    one = sigs.select(F.col("user_id").alias("u"), F.col("sig").alias("_s"))
    two = sigs.select(F.col("user_id").alias("v"), F.col("sig").alias("_t"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", agreement(F.col("_s"), F.col("_t"), k).alias("similarity"))


def both_ways(pairs: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return pairs.select(F.explode(ways).alias("w"), "similarity").select("w.*", "similarity")


def index_size(keys: DataFrame) -> DataFrame:
    """Users and buckets of a banded index, and the rows of its largest bucket."""
    buckets = keys.groupBy("band", "key").agg(F.count("*").alias("n")).agg(F.count("*").alias("buckets"), F.max("n").alias("largest"))
    return keys.agg(F.countDistinct("user_id").alias("users")).crossJoin(buckets)  # one row each


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar of every user, ties by id."""
    top = Window.partitionBy("u").orderBy(F.desc("similarity"), "v")
    return both_ways(pairs).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def exact_pairs(watches: DataFrame) -> DataFrame:
    """u < v with a common item, and their Jaccard similarity: every pair is counted, in blocks of users (see ``neighbours``), so no
    rows of pairs are shuffled; the result has all pairs all the same. See ``candidates`` for popular items."""
    return neighbours.similar_pairs(watches)


def pairs_at_least(watches: DataFrame, threshold: float) -> DataFrame:
    """u < v, similarity of all pairs whose Jaccard similarity is ``threshold`` (over 0) or more.

    Pairs are counted as by ``exact_pairs``, and those below the threshold are dropped where they are counted. The null item
    is one like others here.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is over 0 and at most 1")
    return neighbours.similar_pairs(watches, threshold, nulls_meet=True)


def jaccard(one, two):
    """Of two arrays; two empty ones are equal."""
    union = F.size(F.array_union(one, two))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(one, two)).cast("double") / union)


def recall(found: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs at or over the threshold, how many are candidates, and the other way round."""
    true = truth.where(F.col("similarity") >= threshold).select("u", "v", F.lit(1).alias("_t"))
    both = found.select("u", "v", F.lit(1).alias("_f")).join(true, ["u", "v"], "full")
    n = [F.count(F.when(c, 1)) for c in (F.expr("_t = 1"), F.expr("_f = 1"), F.expr("_t = 1 and _f = 1"))]
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a.cast("double") / b)
    return both.agg(n[0].alias("true_pairs"), n[1].alias("found_pairs"), n[2].alias("shared"), share(n[2], n[0]).alias("recall"), share(n[2], n[1]).alias("precision"))


def sets_of_similarity(spark, targets: list[float], size: int = 500) -> DataFrame:
    """target, a, b: b is the part of a that makes their similarity the target."""
    rows = [f"select cast({t} as double) target, sequence(0L, {size - 1}L) a, sequence(0L, {max(1, round(t * size)) - 1}L) b" for t in targets]
    return reduce(lambda x, y: x.unionByName(y), map(spark.sql, rows))
