"""The registered queries of the engine, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.operators import bloom, bots, cache, frequency, neighbours, prefix, priority, recommend, similarity, system, windows
from rillmark.sources import events as src
from rillmark.sources import generator

from . import generator_sql

#: How the types of the events table stand for the engine's.
PRIORITIES = {"purchase": 0, "view": 1, "click": 2}
SPARSE = 55
K, BANDS, TOP = 32, 16, 20
#: Error rates that sketches are sized by.
FP_RATE, EPSILON, DELTA = 0.01, 0.001, 0.01
CMS_W, CMS_D = frequency.width_for(EPSILON), frequency.depth_for(DELTA)


def events(spark, d) -> DataFrame:
    return priority.classified(src.activity(spark, d), PRIORITIES, priority.BACKGROUND)


def terms(spark, d) -> DataFrame:
    return prefix.vocabulary(src.titles(spark, d))


def history(spark, d) -> DataFrame:
    """Users and the items of their orders; some users have none."""
    return src.watches(spark, d)


def searches(spark, d) -> DataFrame:
    """What clicks are taken to search for: the beginnings of titles' words."""
    return src.activity(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("search_id"), F.element_at(F.array(*map(F.lit, QUERIES)), (F.col("item") % len(QUERIES) + 1).cast("int")).alias("query"))


QUERIES = (" Re", "bl", "RED\t", "BL", "re", "old", "large g", "s ")
CATALOG_SQL = "select lower(p_name) term, count(*) freq from part where trim(p_name) <> '' group by 1"

EV = """ev as (select event_id, ts, user_id, event_type, cast(json_extract(props, '$.k') as bigint) k, user_id % 5 = 0 premium,
  case when user_id % 5 = 0 and (case event_type when 'purchase' then 0 when 'view' then 1 when 'click' then 2 else 3 end) > 1 then 1
       else (case event_type when 'purchase' then 0 when 'view' then 1 when 'click' then 2 else 3 end) end priority from events)"""
HASH = "('0x' || substr(md5(cast({seed} as varchar) || ':' || cast({x} as varchar)), 1, 8))::bigint"


def h(x: str, seed: str) -> str:
    return HASH.format(x=x, seed=seed)


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- frequencies -----------------------------------------------------------------------------


@query(f"with {EV} select k as item, count(*) cnt from ev where event_type = 'view' group by k order by cnt desc, k limit 10")
def trending_topk(spark, d):
    return frequency.top_k(src.plays(spark, d), "item", 10)


@query(f"with {EV} select k as item, cast(sum(1 + event_id % 3) as bigint) cnt from ev where event_type = 'view' group by k order by cnt desc, k limit 10")
def trending_weighted(spark, d):
    return frequency.top_k(src.plays(spark, d), "item", 10, 1 + F.col("event_id") % 3)


@query(f"with {EV} select k as item, count(*) cnt from ev group by k")
def item_frequency(spark, d):
    return frequency.exact(src.activity(spark, d), "item")


CMS_SQL = f"""cells as (select r as row, {h("k", "r")} % {CMS_W} as col, count(*) cnt from ev, range({CMS_D}) t(r) group by 1, 2),
est as (select i.k as item, min(coalesce(c.cnt, 0)) estimate from (select distinct k from ev) i, range({CMS_D}) t(r)
  left join cells c on c.row = r and c.col = {h("i.k", "r")} % {CMS_W} group by 1)"""


@query(f"with {EV}, {CMS_SQL} select cast(row as integer) as row, col, cnt from cells")
def cms_cells(spark, d):
    return frequency.sketch(src.activity(spark, d), "item", CMS_W, CMS_D)


@query(f"with {EV}, {CMS_SQL} select item, cast(estimate as bigint) estimate from est")
def cms_estimate(spark, d):
    e = src.activity(spark, d)
    return frequency.estimate(e, "item", frequency.sketch(e, "item", CMS_W, CMS_D), CMS_W, CMS_D)


@query(f"with {EV}, {CMS_SQL}, tr as (select k as item, count(*) cnt from ev group by k) select item, cast(estimate as bigint) estimate, cnt, cast(abs(estimate - cnt) as double) / greatest(cnt, 1) as error from est join tr using (item)")
def cms_error(spark, d):
    e = src.activity(spark, d)
    return frequency.relative_error(cms_estimate(spark, d), frequency.exact(e, "item"), "item")


@query("select 2719 as width, 5 as depth, 108760 as memory_bytes, count(*) total, cast(round(0.001 * count(*), 6) as double) as error_bound, 10 as k, least(10, count(distinct json_extract(props, '$.k'))) as tracked from events")
def cms_statistics(spark, d):
    w, depth = frequency.width_for(0.001), frequency.depth_for(0.01)
    e = src.activity(spark, d)
    return e.agg(F.lit(w).alias("width"), F.lit(depth).alias("depth"), F.lit(frequency.memory_bytes(w, depth)).alias("memory_bytes"), F.count("*").alias("total"), F.round(F.count("*") * 0.001, 6).alias("error_bound"), F.lit(10).alias("k"), F.least(F.lit(10), F.countDistinct("item")).alias("tracked"))


@query(f"with {EV} select k as item, count(*) cnt from ev where event_type = 'view' group by k order by cnt desc, k limit 10")
def approx_top_k_native(spark, d):
    return frequency.approximate_top_k(src.plays(spark, d), "item", 10)


@query()
def cms_native(spark, d):
    """The size of Spark's own sketch of all items."""
    return src.activity(spark, d).agg(F.octet_length(F.count_min_sketch("item", F.lit(0.001), F.lit(0.99), F.lit(1))).alias("sketch_bytes"))


# ---- priorities ------------------------------------------------------------------------------


@query(f"with {EV} select event_id, priority, row_number() over (order by priority, ts, event_id) as place from ev")
def priority_order(spark, d):
    return priority.placed(events(spark, d)).select("event_id", "priority", "place")


@query(f"with {EV} select event_id, priority from ev order by priority, ts, event_id limit 1")
def priority_peek(spark, d):
    return priority.batch(events(spark, d), 1).select("event_id", "priority")


@query(f"with {EV} select event_id, priority from ev order by priority, ts, event_id limit 100")
def priority_batch(spark, d):
    return priority.batch(events(spark, d), 100).select("event_id", "priority")


@query(f"with {EV} select cast(priority as integer) priority, count(*) pending, ['PAYMENT', 'PREMIUM', 'STANDARD', 'BACKGROUND'][priority + 1] as name from ev group by priority")
def priority_histogram(spark, d):
    return priority.pending(events(spark, d))


@query("select round(avg((event_id % 50 + 0.0) * 10), 6) as avg_wait_ms, count(*) processed from events")
def priority_wait(spark, d):
    e = events(spark, d).withColumn("processed_ts", F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 50) * 10_000))
    return priority.average_wait_ms(e).withColumn("avg_wait_ms", F.round("avg_wait_ms", 6))


# ---- suspicious accounts ---------------------------------------------------------------------

FLAG_SQL = """flags as (select event_id, user_id, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) addresses
  from (select *, case when row_number() over (partition by user_id, k order by ts, event_id) = 1 then 1 else 0 end f from ev where k is not null))"""


@query(f"with {EV}, {FLAG_SQL} select event_id, user_id, cast(addresses as bigint) addresses, addresses >= 3 as flagged from flags")
def bot_running_flag(spark, d):
    return bots.running_flag(src.activity(spark, d)).select("event_id", "user_id", "addresses", "flagged")


@query(f"with {EV}, {FLAG_SQL} select event_id, user_id, cast(addresses as bigint) addresses from flags where addresses >= {SPARSE}")
def bot_alerts(spark, d):
    return bots.running_flag(src.activity(spark, d), SPARSE).where("flagged").select("event_id", "user_id", "addresses")


@query(f"with {EV} select user_id, count(distinct k) addresses from ev group by user_id having count(distinct k) >= 45")
def bot_suspects(spark, d):
    return bots.suspects(src.activity(spark, d), 45)


# ---- Bloom filter ----------------------------------------------------------------------------

BLOOM_SQL = f"""buyers as (select distinct user_id from events where event_type = 'purchase'), counted as (select greatest(1, count(*)) n from buyers),
sized as (select n, cast(floor(-n * ln({FP_RATE}) / (ln(2) * ln(2))) as bigint) m from counted), size as (select m, greatest(1, cast(floor(m / n * ln(2)) as bigint)) k from sized),
bits as (select distinct {h("user_id", "i")} % m pos from buyers, size, unnest(range(k)) t(i))"""


def buyers(spark, d) -> DataFrame:
    return src.activity(spark, d).where("event_type = 'purchase'").select("user_id").distinct()


def bloom_size(spark, d) -> tuple[int, int]:
    """m and k for all users with a purchase."""
    n = max(1, buyers(spark, d).count())
    m = bloom.bits_for(n, FP_RATE)
    return m, bloom.hashes_for(m, n)


@query(f"""with {BLOOM_SQL}, asked as (select distinct u.user_id, {h("u.user_id", "i")} % m pos from (select distinct user_id from events) u, size, unnest(range(k)) t(i))
select user_id, count(*) = count(b.pos) as maybe from asked left join bits b using (pos) group by user_id""")
def bloom_membership(spark, d):
    """All users against a filter of all buyers, sized by their number."""
    m, k = bloom_size(spark, d)
    return bloom.contains(src.activity(spark, d), "user_id", bloom.build(buyers(spark, d), "user_id", m, k), m, k)


@query(f"with {BLOOM_SQL} select count(*) bits_set, count(*) / any_value(m)::double as fill_ratio from bits, size")
def bloom_fill_ratio(spark, d):
    m, k = bloom_size(spark, d)
    return bloom.fill_ratio(bloom.build(buyers(spark, d), "user_id", m, k), m)


@query("select 9585058 as m, 6 as k, 1198132 as memory_bytes, round(pow(1 - exp(-6.0 * 1000000 / 9585058), 6), 9) as expected_fp")
def bloom_sizing(spark, d):
    m = bloom.bits_for(1_000_000, 0.01)
    k = bloom.hashes_for(m, 1_000_000)
    return spark.range(1).select(F.lit(m).alias("m"), F.lit(k).alias("k"), F.lit(bloom.memory_bytes(m)).alias("memory_bytes"), F.lit(round(bloom.expected_fp(m, k, 1_000_000), 9)).alias("expected_fp"))


@query(f"""with {BLOOM_SQL}, asked as (select distinct c_custkey u, {h("c_custkey", "i")} % m pos from customer, size, unnest(range(k)) t(i) where c_custkey not in (select user_id from buyers)),
judged as (select u, count(*) = count(b.pos) maybe from asked left join bits b using (pos) group by u)
select count(*) probes, count(*) filter (maybe) false_positives from judged""")
def bloom_false_positives(spark, d):
    """Customers that are no buyers but seem to be."""
    m, k = bloom_size(spark, d)
    known = buyers(spark, d)
    unknown = src.read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(known, "user_id", "left_anti")
    judged = bloom.contains(unknown, "user_id", bloom.build(known, "user_id", m, k), m, k)
    return judged.agg(F.count("*").alias("probes"), F.count(F.when(F.col("maybe"), 1)).alias("false_positives"))


# ---- prefixes --------------------------------------------------------------------------------


@query(f"with t as ({CATALOG_SQL}) select term, freq from t")
def catalog(spark, d):
    return terms(spark, d)


@query(f"with t as ({CATALOG_SQL}) select term, freq from t where starts_with(term, 're') order by freq desc, term limit 5")
def autocomplete_one(spark, d):
    return prefix.complete(terms(spark, d), " Re", 5)


PREFIXES = ("re", "BL ", "s", "large", "old b", "zzz", "", "h")


def asked_prefixes(spark):
    return spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")


@query(f"""with t as ({CATALOG_SQL}), p as (select distinct lower(trim(x)) prefix from (values ('re'), ('BL '), ('s'), ('large'), ('old b'), ('zzz'), (''), ('h')) v(x) where trim(x) <> '')
select * from (select prefix, term, freq, cast(row_number() over (partition by prefix order by freq desc, term) as integer) as rank from t join p on starts_with(term, prefix)) where rank <= 5""")
def autocomplete_topk(spark, d):
    return prefix.complete_many(terms(spark, d), asked_prefixes(spark), 5)


@query(f"with t as ({CATALOG_SQL}) select x as word, coalesce(freq, 0) freq from (select p_name x from part union select upper(p_name) from part union select p_name || ' ' from part) left join t on term = lower(x)")
def term_lookup(spark, d):
    """All names of parts, as they are, in upper case, and with white space that makes them no term."""
    part = src.read_table(spark, d, "part")
    words = part.select(F.explode(F.array("p_name", F.upper("p_name"), F.concat("p_name", F.lit(" ")))).alias("word")).distinct()
    return prefix.lookup(terms(spark, d), words)


@query(f"with t as ({CATALOG_SQL}) select x as prefix, bool_or(term is not null) as found from (values ('re'), ('bl'), ('zzz')) v(x) left join t on starts_with(term, x) group by x")
def prefix_exists(spark, d):
    asked = spark.createDataFrame([("re",), ("bl",), ("zzz",)], "prefix string")
    hit = prefix.prefixes(terms(spark, d)).select("prefix", F.lit(True).alias("hit")).distinct()
    return asked.join(hit, "prefix", "left").select("prefix", F.coalesce("hit", F.lit(False)).alias("found"))


@query(f"with t as ({CATALOG_SQL}) select substr(term, 1, n) as prefix, cast(sum(freq) as bigint) total_freq, count(*) terms from t, range(1, 200) r(n) where n <= length(term) group by 1")
def prefix_subtree_freq(spark, d):
    return prefix.subtree_frequency(terms(spark, d))


@query(f"with t as ({CATALOG_SQL}) select term, freq from t where term not in (select lower(p_name) from part group by 1 having max(p_size) >= 50)")
def trie_delete(spark, d):
    """The vocabulary without the names of all parts of size 50 or more, over the whole table."""
    gone = src.read_table(spark, d, "part").where("p_size >= 50").select(F.col("p_name").alias("word"))
    return prefix.without(terms(spark, d), gone)


@query(f"with t as ({CATALOG_SQL}) select x as word, bool_or(term is not null) as existed from (select p_name x from part union select upper(p_name) from part union select p_name || '!' from part) left join t on term = lower(x) group by x")
def trie_deleted(spark, d):
    """Whether each of all names of parts, as they are, in upper case, and changed, is there to delete."""
    words = src.read_table(spark, d, "part").select(F.explode(F.array("p_name", F.upper("p_name"), F.concat("p_name", F.lit("!")))).alias("word"))
    return prefix.deleted(terms(spark, d), words)


@query(f"with t as ({CATALOG_SQL}) select count(*) as terms from t")
def trie_size(spark, d):
    return terms(spark, d).agg(F.count("*").alias("terms"))


SEARCH_SQL = f"""{EV}, s as (select event_id search_id, lower(trim([' Re', 'bl', 'RED', 'BL', 're', 'old', 'large g', 's '][k % 8 + 1])) query from ev where event_type = 'click'), t as ({CATALOG_SQL})"""


@query(f"with {SEARCH_SQL} select term, cast(sum(n) as bigint) freq from (select term, freq n from t union all select query, 1 from s) group by term")
def search_then_record(spark, d):
    said = searches(spark, d).select(F.col("query").alias("term"), F.lit(1).cast("long").alias("n"))
    return prefix.vocabulary(terms(spark, d).withColumnRenamed("freq", "n").unionByName(said), weight="n")


@query(f"with {SEARCH_SQL} select query, count(*) searches from s group by query")
def search_counts(spark, d):
    return prefix.search_counts(searches(spark, d))


@query(f"""with {SEARCH_SQL}, both_ as (select search_id, query, term, freq n from s join t on starts_with(term, query)
  union all select a.search_id, a.query, b.query, 1 from s a join s b on b.search_id < a.search_id and starts_with(b.query, a.query)),
summed as (select search_id, query, term, cast(sum(n) as bigint) freq from both_ group by all)
select * from (select *, cast(row_number() over (partition by search_id order by freq desc, term) as integer) as rank from summed) where rank <= 5""")
def suggest_before_record(spark, d):
    return prefix.suggested_before(searches(spark, d), terms(spark, d), 5)


# ---- similarity ------------------------------------------------------------------------------

WATCH_SQL = "w as (select o_custkey user_id, l_partkey item from lineitem join orders on l_orderkey = o_orderkey), s as (select distinct user_id, item from w)"
FAM = similarity.family(K)
FAM_SQL = f"fam as (select * from (values {', '.join(f'({i}, {a}::bigint, {b}::bigint)' for i, (a, b) in enumerate(FAM))}) v(i, a, b))"
SIG_SQL = f"""{WATCH_SQL}, {FAM_SQL}, m as (select user_id, i, min((a * ({h("item", "'mh'")} % {similarity.PRIME}) + b) % {similarity.PRIME}) mh from s, fam group by 1, 2)"""
BAND_SQL = f"b as (select user_id, i // {K // BANDS} band, string_agg(cast(mh as varchar), '-' order by i) as key from m group by 1, 2), c as (select distinct x.user_id u, y.user_id v from b x join b y on x.band = y.band and x.key = y.key and x.user_id < y.user_id)"
EST_SQL = f"e as (select u, v, count(*) filter (x.mh = y.mh) / {K}.0::double similarity from c join m x on x.user_id = u join m y on y.user_id = v and y.i = x.i group by u, v)"
TWO_SQL = "e2 as (select u, v, similarity from {e} union all select v, u, similarity from {e}), nb as (select * from (select *, row_number() over (partition by u order by similarity desc, v) r from e2) where r <= {n})"
EXACT_SQL = "sz as (select user_id, count(*) n from s group by 1), x as (select a.user_id u, b.user_id v, count(*)::double / (max(p.n) + max(q.n) - count(*)) similarity from s a join s b on a.item = b.item and a.user_id < b.user_id join sz p on p.user_id = a.user_id join sz q on q.user_id = b.user_id group by 1, 2)"
REC_SQL = "rec as (select * from (select *, cast(row_number() over (partition by user_id order by score desc, item) as integer) as rank from (select u user_id, s.item, round(sum(similarity), 9) score from nb join s on s.user_id = v where not exists (select 1 from s z where z.user_id = u and z.item = s.item) group by 1, 2)) where rank <= 10)"


@query(f"with {SIG_SQL} select user_id, string_agg(cast(mh as varchar), ',' order by i) as sig from m group by user_id")
def minhash_signature(spark, d):
    return similarity.signatures(history(spark, d), K).select("user_id", F.array_join("sig", ",").alias("sig"))


@query(f"select {similarity.lsh_threshold(128, 32)}::double as threshold, 4 as rows_per_band")
def lsh_threshold(spark, d):
    return spark.range(1).select(F.lit(similarity.lsh_threshold(128, 32)).alias("threshold"), F.lit(128 // 32).alias("rows_per_band"))


@query(f"with {SIG_SQL}, {BAND_SQL} select user_id, cast(band as integer) band, key from b")
def lsh_bands(spark, d):
    return similarity.band_keys(similarity.signatures(history(spark, d), K), K, BANDS)


def lsh_pairs(spark, d, gone=None):
    sigs = similarity.signatures(history(spark, d), K)
    sigs = sigs.join(gone, "user_id", "left_anti") if gone is not None else sigs
    return similarity.scored(similarity.candidates(similarity.band_keys(sigs, K, BANDS)), sigs, K)


@query(f"with {SIG_SQL}, {BAND_SQL}, {EST_SQL} select * from e")
def lsh_candidate_pairs(spark, d):
    return lsh_pairs(spark, d)


@query(f"with {SIG_SQL}, {BAND_SQL}, {EST_SQL}, {TWO_SQL.format(e='e', n=10)} select u, v, similarity, cast(r as integer) as rank from nb")
def lsh_nearest(spark, d):
    return similarity.nearest_by_class(similarity.signatures(history(spark, d), K), K, BANDS, 10)


@query(f"with {SIG_SQL}, {BAND_SQL}, {EST_SQL}, gone as (select c_custkey from customer where c_acctbal < 0) select * from e where u not in (select * from gone) and v not in (select * from gone)")
def lsh_remove(spark, d):
    """Pairs after the customers that owe money are removed from the index."""
    gone = src.read_table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return lsh_pairs(spark, d, gone)


@query(f"with {SIG_SQL}, {BAND_SQL}, sizes as (select band, key, count(*) n from b group by 1, 2) select (select count(distinct user_id) from b) users, count(*) buckets, max(n) largest from sizes")
def lsh_size(spark, d):
    return similarity.index_size(similarity.band_keys(similarity.signatures(history(spark, d), K), K, BANDS))


@query(f"with {SIG_SQL}, has as (select user_id, string_agg(cast(mh as varchar), ',' order by i) as sig from m group by user_id) select c_custkey user_id, coalesce(sig, '{','.join([str(similarity.PRIME)] * K)}') as sig from customer left join has on user_id = c_custkey")
def minhash_signature_users(spark, d):
    """Of all customers, those that ordered nothing too."""
    users = src.read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return similarity.signatures_of(users, history(spark, d), K).select("user_id", F.array_join("sig", ",").alias("sig"))


@query(f"with {WATCH_SQL}, {EXACT_SQL} select * from x")
def jaccard_exact_pairs(spark, d):
    return similarity.exact_pairs(history(spark, d))


FROM = 0.05


@query(f"with {WATCH_SQL}, {EXACT_SQL} select * from x where similarity >= {FROM}")
def jaccard_pairs_from(spark, d):
    """Pairs from a similarity on, without meeting in every item."""
    return similarity.pairs_at_least(history(spark, d), FROM)


VIEWED_SQL = f"{EV}, s as (select distinct user_id, k as item from ev where event_type = 'view')"


@query(f"with {VIEWED_SQL}, {EXACT_SQL} select * from x where similarity >= 0.2")
def jaccard_pairs_viewers(spark, d):
    """The same of users by what they have viewed."""
    return similarity.pairs_at_least(src.plays(spark, d).select("user_id", "item"), 0.2)


@query("select t as target, case when t < 0.002 then 0.002 else t end as similarity from (values (0.1::double), (0.5::double), (0.9::double)) v(t)")
def jaccard_sets(spark, d):
    sets = similarity.sets_of_similarity(spark, [0.1, 0.5, 0.9])
    return sets.select("target", similarity.jaccard(F.col("a"), F.col("b")).alias("similarity"))


TRIALS, LENGTHS, TARGETS = 5, (8, 16, 32, 64, 128, 256), (0.1, 0.3, 0.5, 0.7, 0.9)
TRIAL_SQL = f"fam as (select * from (values {', '.join(f'({t}, {i}, {a}::bigint, {b}::bigint)' for t in range(TRIALS) for i, (a, b) in enumerate(similarity.family(max(LENGTHS), 100 + t)))}) v(trial, i, a, b))"


@query(f"""with {TRIAL_SQL}, items as (select t target, x, x < greatest(1, round(t * 500)) both_ from (values {", ".join(f"({t}::double)" for t in TARGETS)}) v(t), range(500) r(x)),
h as (select *, {h("x", "'mh'")} % {similarity.PRIME} hx from items),
m as (select target, trial, i, min((a * hx + b) % {similarity.PRIME}) one, min(case when both_ then (a * hx + b) % {similarity.PRIME} end) two from h, fam group by all),
e as (select k, target, trial, count(*) filter (one = two) / k::double estimate from m, (values {", ".join(f"({k})" for k in LENGTHS)}) v(k) where i < k group by k, target, trial)
select cast(k as integer) as k, target, round(avg(abs(estimate - target)), 9) as mean_error from e group by k, target""")
def minhash_error(spark, d):
    """How far signatures of several lengths are from the similarity of sets made for it, on average
    over several families of hashes."""
    sets = similarity.sets_of_similarity(spark, list(TARGETS))
    sides = sets.select((F.col("target") * 10).cast("int").alias("g"), F.posexplode(F.array("a", "b")).alias("side", "items"))
    watched = sides.select((F.col("g") * 2 + F.col("side")).alias("user_id"), F.explode("items").alias("item"))
    out = None
    for trial in range(TRIALS):
        sigs = similarity.signatures(watched, max(LENGTHS), 100 + trial)
        pair = sigs.groupBy(F.floor(F.col("user_id") / 2).alias("g")).agg(F.max(F.when(F.col("user_id") % 2 == 0, F.col("sig"))).alias("one"), F.max(F.when(F.col("user_id") % 2 == 1, F.col("sig"))).alias("two"))
        first = lambda sig, k: F.slice(sig, 1, k)
        found = pair.select((F.col("g") / 10).alias("target"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), similarity.agreement(first("one", k), first("two", k), k).alias("estimate")) for k in LENGTHS))).alias("x"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy(F.col("x.k").alias("k"), "target").agg(F.round(F.avg(F.abs(F.col("x.estimate") - F.col("target"))), 9).alias("mean_error"))


@query(f"with {SIG_SQL}, {BAND_SQL}, {EXACT_SQL}, tr as (select u, v from x where similarity >= 0.05), f as (select c.u cu, tr.u tu from c full join tr on c.u = tr.u and c.v = tr.v) select count(tu) true_pairs, count(cu) found_pairs, count(*) filter (tu is not null and cu is not null) as shared, case when count(tu) = 0 then 0 else (count(*) filter (tu is not null and cu is not null))::double / count(tu) end as recall, case when count(cu) = 0 then 0 else (count(*) filter (tu is not null and cu is not null))::double / count(cu) end as precision from f")
def lsh_recall(spark, d):
    keys = similarity.band_keys(similarity.signatures(history(spark, d), K), K, BANDS)
    return similarity.recall(similarity.candidates(keys), similarity.pairs_at_least(history(spark, d), FROM), FROM)


# ---- recommendations -------------------------------------------------------------------------


@query(f"with {WATCH_SQL}, {EXACT_SQL}, {TWO_SQL.format(e='x', n=TOP)}, {REC_SQL} select * from rec")
def recommend_exact(spark, d):
    return neighbours.recommend_exact(history(spark, d), TOP, 10)


@query(f"with {SIG_SQL}, {BAND_SQL}, {EST_SQL}, {TWO_SQL.format(e='e', n=TOP)}, {REC_SQL} select * from rec")
def recommend_lsh(spark, d):
    return recommended(similarity.profiles(history(spark, d), K))


def recommended(profiles: DataFrame) -> DataFrame:
    sigs = profiles.where("user_id is not null and sig is not null").select("user_id", "sig")
    return recommend.recommend_from_profiles(profiles, similarity.nearest_by_class(sigs, K, BANDS, TOP), TOP, 10)


@query(f"""with {SIG_SQL}, {BAND_SQL}, {EST_SQL}, {TWO_SQL.format(e='e', n=TOP)}, {REC_SQL},
pop as (select *, cast(row_number() over (order by score desc, item) as integer) as rank from (select item, count(*)::double score from w group by item order by 2 desc, 1 limit 10))
select user_id, item, score, rank, 'similar' as source from rec union all
select c_custkey, item, score, rank, 'popular' from customer, pop where c_custkey not in (select user_id from rec)""")
def recommend_fallback(spark, d):
    profiles = similarity.profiles(history(spark, d), K)
    users = src.read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return recommend.with_fallback(users, recommended(profiles), similarity.watches_of(profiles), 10)


@query(f"with {WATCH_SQL} select count(distinct user_id) users, count(distinct item) items, 0.4204::double as lsh_threshold from w")
def recommend_stats(spark, d):
    return recommend.statistics(history(spark, d), 128, 32)


@query(f"with {WATCH_SQL} select item, count(*)::double score, cast(row_number() over (order by count(*) desc, item) as integer) as rank from w group by item order by 2 desc, 1 limit 10")
def watch_popularity(spark, d):
    return recommend.popular(history(spark, d), 10)


# ---- cache -----------------------------------------------------------------------------------


def accesses(spark, d):
    return src.plays(spark, d).select(F.col("event_id").alias("pos"), F.col("item").alias("key"))


ACC_SQL = f"{EV}, a as (select event_id pos, k as key, lag(event_id) over (partition by k order by event_id) p, lead(event_id) over (partition by k order by event_id) n from ev where event_type = 'view'), dist as (select x.pos, x.key, x.p, count(y.pos) c from a x left join a y on y.pos > x.p and y.pos < x.pos and (y.n is null or y.n > x.pos) group by 1, 2, 3)"


@query(f"with {ACC_SQL} select pos, key, p is not null and c < 20 as hit from dist")
def lru_hits(spark, d):
    return cache.play(accesses(spark, d), 20, 2000).select("pos", "key", "hit")


@query(f"""with {ACC_SQL}, miss as (select pos from dist where not (p is not null and c < 20))
select m.pos, y.key evicted from miss m join a y on y.pos < m.pos and (y.n is null or y.n >= m.pos) qualify row_number() over (partition by m.pos order by y.pos desc) = 20""")
def lru_evictions(spark, d):
    return cache.play(accesses(spark, d), 20, 2000).where("evicted is not null").select("pos", "evicted")


@query(f"with {ACC_SQL} select count(*) filter (p is not null and c < 20) as hits, count(*) filter (not (p is not null and c < 20)) as misses, (count(*) filter (p is not null and c < 20))::double / count(*) as hit_rate from dist")
def lru_stats(spark, d):
    return cache.statistics(cache.play(accesses(spark, d), 20, 2000))


@query(f"with {ACC_SQL} select cast(cap as integer) as capacity, count(*) filter (p is not null and c < cap) as hits, count(*) accesses from dist, (values (1), (5), (10), (20), (50), (80)) v(cap) group by cap")
def lru_capacity_sweep(spark, d):
    """Hits at every capacity from one pass of reuse distances."""
    distances = cache.reuse_distance(accesses(spark, d), 80, 2000)
    caps = F.explode(F.array(*map(F.lit, (1, 5, 10, 20, 50, 80)))).alias("capacity")
    return distances.select("distance", caps).groupBy("capacity").agg(F.count(F.when(F.col("distance") < F.col("capacity"), 1)).alias("hits"), F.count("*").alias("accesses"))


@query(f"with {EV}, l as (select k as key, max(event_id) pos from ev where event_type = 'view' group by k order by 2 desc limit 20) select key, pos, cast(row_number() over (order by pos desc) as integer) as rank from l")
def lru_contents(spark, d):
    return cache.contents(accesses(spark, d), 20)


@query(f"with {EV}, l as (select k as key from ev where event_type = 'view' group by k order by max(event_id) desc limit 20) select distinct k as key, k in (select key from l) as held from ev")
def lru_contains(spark, d):
    """Which of all items are in the cache at the end."""
    return cache.contains(accesses(spark, d), src.activity(spark, d).select(F.col("item").alias("key")), 20)


SERVED = 40
SERVED_SQL = f"""{EV}, a as (select event_id pos, user_id as key, event_type = 'click' request, lag(event_id) over w p, lead(event_id) over w n, lag(event_type) over w = 'click' fresh
  from ev where event_type in ('view', 'click') window w as (partition by user_id order by event_id)),
served as (select x.pos, x.key, coalesce(any_value(x.fresh), false) and x.p is not null and count(y.pos) < {SERVED} from_cache
  from a x left join a y on y.pos > x.p and y.pos < x.pos and (y.n is null or y.n > x.pos) where x.request group by x.pos, x.key, x.p)"""


def requests(spark, d):
    """Views, and clicks as requests for recommendations, of all users."""
    log = src.activity(spark, d).where("event_type in ('view', 'click')")
    return log.select(F.col("event_id").alias("pos"), F.col("user_id").alias("key"), (F.col("event_type") == "click").alias("request"))


@query(f"with {SERVED_SQL} select * from served")
def served_from_cache(spark, d):
    """Which requests find recommendations that the user's own views haven't made outdated."""
    return cache.served(requests(spark, d), SERVED, 2000)


@query(f"with {SERVED_SQL} select count(*) requests, count(*) filter (from_cache) hits, {SERVED} as capacity, 0.42::double as lsh_threshold from served")
def served_stats(spark, d):
    done = cache.served(requests(spark, d), SERVED, 2000)
    return done.agg(F.count("*").alias("requests"), F.count(F.when(F.col("from_cache"), 1)).alias("hits"), F.lit(SERVED).alias("capacity"), F.round(F.lit(similarity.lsh_threshold(128, 32)), 3).alias("lsh_threshold"))


# ---- windows ---------------------------------------------------------------------------------


@query(f"with {EV} select event_id, count(*) over (order by ts range between interval 60 minutes preceding and current row) as in_window from ev")
def trailing_window_count(spark, d):
    return windows.trailing_total(src.activity(spark, d), 3600, 3600).select("event_id", "in_window")


@query(f"with {EV} select event_id, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as in_window from ev")
def trailing_window_by_user(spark, d):
    return windows.trailing_count(src.activity(spark, d), 86_400, "user_id").select("event_id", "in_window")


@query(f"with {EV} select event_id, event_type, k as item from ev where ts >= (select max(ts) from ev) - interval 1 hour")
def window_now(spark, d):
    e = src.activity(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).where("ts >= now - interval 1 hour").select("event_id", "event_type", "item")


@query(f"with {EV} select window_start, event_type, cnt, cast(r as integer) as rank from (select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) cnt, row_number() over (partition by time_bucket(interval 1 hour, ts) order by count(*) desc, event_type) r from ev group by 1, 2) where r <= 5")
def window_type_top5(spark, d):
    return windows.top_types(src.activity(spark, d), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"with {EV} select window_start, item, cnt from (select time_bucket(interval 1 hour, ts) window_start, k as item, count(*) cnt, row_number() over (partition by time_bucket(interval 1 hour, ts) order by count(*) desc, k) r from ev group by 1, 2) where r = 1")
def window_hot_item(spark, d):
    return windows.hot_item(src.activity(spark, d), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select event_id, cast(round(avg(cast(round(value * 1000) as bigint)) over (order by event_id rows between 999 preceding and current row), 3) as double) as rolling from events")
def rolling_latency(spark, d):
    thousandths = src.activity(spark, d).withColumn("value", F.round(F.col("value") * 1000).cast("long"))
    return windows.rolling_mean(thousandths, "value", "event_id", span=2000).select("event_id", F.round("rolling", 3).alias("rolling"))


# ---- the whole system ------------------------------------------------------------------------

DISPATCH_SQL = f"{EV}, {FLAG_SQL}, dis as (select e.event_id, e.user_id, event_type, cast(priority as integer) priority, addresses >= {SPARSE} flagged, case when event_type = 'view' then 'watch' when event_type = 'purchase' then 'payment' else 'none' end as action from ev e join flags f using (event_id))"


@query(f"with {DISPATCH_SQL} select * from dis")
def dispatch_actions(spark, d):
    return system.dispatch(events(spark, d), SPARSE, "view")


@query(f"with {DISPATCH_SQL} select count(*) events, count(*) filter (flagged) alerts, count(*) filter (action = 'payment') payments, count(*) filter (action = 'watch') watches, " + ", ".join(f"count(*) filter (priority = {p}) priority_{p}" for p in range(4)) + ", count(distinct user_id) filter (flagged) bots from dis")
def system_stats(spark, d):
    return system.statistics(dispatch_actions(spark, d))


CACHED = 20
PROCESS_SQL = f"""{EV}, {FLAG_SQL}, pl as (select *, row_number() over (order by priority, ts, event_id) place from ev),
a as (select place pos, k as key, lag(place) over (partition by k order by place) p, lead(place) over (partition by k order by place) n from pl where event_type = 'view' and k is not null),
cached as (select x.pos place, case when x.p is not null and count(y.pos) < {CACHED} then 'HIT' else 'MISS' end cache from a x left join a y on y.pos > x.p and y.pos < x.pos and (y.n is null or y.n > x.pos) group by x.pos, x.p),
s as (select place search_id, lower(trim([' Re', 'bl', 'RED', 'BL', 're', 'old', 'large g', 's '][k % 8 + 1])) query from pl where event_type = 'click'), t as ({CATALOG_SQL}),
both_ as (select search_id, term, freq n from s join t on starts_with(term, query) union all select a.search_id, b.query, 1 from s a join s b on b.search_id < a.search_id and starts_with(b.query, a.query)),
best as (select search_id, term, row_number() over (partition by search_id order by sum(n) desc, term) r from both_ group by 1, 2 qualify r <= 5),
offered as (select search_id place, string_agg(term, '|' order by r) suggestions from best group by 1),
done as (select event_id, place, user_id, event_type, cast(priority as integer) priority, coalesce(addresses >= {SPARSE}, false) flagged,
  case event_type when 'view' then 'watch' when 'purchase' then 'payment' when 'click' then 'search' else 'none' end as action, cache, suggestions
  from pl left join (select event_id, addresses from flags) using (event_id) left join cached using (place) left join offered using (place))"""


def processed(spark, d) -> DataFrame:
    query = F.element_at(F.array(*map(F.lit, QUERIES)), (F.col("item") % len(QUERIES) + 1).cast("int"))
    e = events(spark, d).withColumn("query", F.when(F.col("event_type") == "click", query))
    return system.processed(e, terms(spark, d), SPARSE, CACHED, "view", "click", ("purchase",), 2000)


@query(f"with {PROCESS_SQL} select * from done")
def process_events(spark, d):
    """Every event in processing order with what the whole system makes of it."""
    return processed(spark, d)


@query(f"""with {PROCESS_SQL}, plays as (select count(k) trending_total, count(distinct k) catalog, count(distinct user_id) filter (k is not null) indexed_users from ev where event_type = 'view'),
one as (select count(*) processed, 0::bigint pending, {", ".join(f"count(*) filter (priority = {x}) priority_{x}" for x in range(4))}, count(*) filter (flagged) alerts, count(distinct user_id) filter (flagged) bots,
  count(*) filter (cache = 'HIT') cache_hits, count(*) filter (cache = 'MISS') cache_misses, count(suggestions) searches_answered from done)
select *, least(catalog, {CACHED}) cache_size, cache_misses - least(catalog, {CACHED}) cache_evictions, case when cache_hits + cache_misses = 0 then 0 else cache_hits::double / (cache_hits + cache_misses) end cache_hit_rate,
  least(catalog, {TOP}) trending_tracked, 0.42::double lsh_threshold from one, plays""")
def full_system_stats(spark, d):
    return system.full_statistics(processed(spark, d), src.plays(spark, d), CACHED, TOP, 128, 32)


# ---- sources ---------------------------------------------------------------------------------


@query(f"select id, timestamp, user_id, event_type, video_id, ip, is_premium, session_id, payload from ({generator_sql.events(5000, 42, 1000, 10_000, 1_000)})")
def generated_events(spark, d):
    made = generator.events(spark, 5000, seed=42)
    said = F.array_join(F.transform(F.map_entries("payload"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return made.withColumn("payload", said).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(f"""with g as ({generator_sql.events(50_000, 7, 1000, 200, 500)}), b as (select *, case event_type {" ".join(f"when '{n}' then {x}" for n, x in priority.BASE.items())} else {priority.STANDARD} end base from g),
p as (select *, case when is_premium and base > 1 then 1 else base end priority from b),
f as (select *, case when row_number() over (partition by user_id, ip order by timestamp, id) = 1 then 1 else 0 end f from p),
x as (select *, sum(f) over (partition by user_id order by timestamp, id rows unbounded preceding) >= 4 flagged from f)
select count(*) events, count(*) filter (flagged) alerts, count(*) filter (event_type in ('purchase', 'subscription')) payments, count(*) filter (event_type = 'play' and video_id is not null) watches,
  {", ".join(f"count(*) filter (priority = {x}) priority_{x}" for x in range(4))}, count(distinct user_id) filter (flagged) bots from x""")
def generated_system_stats(spark, d):
    """A run over generated events: priorities, suspicious users, payments and plays."""
    made = generator.events(spark, 50_000, seed=7, users=200, items=500)
    told = made.select(F.col("id").alias("event_id"), F.col("timestamp").alias("ts"), "user_id", "event_type", F.col("video_id").alias("item"), F.col("ip").alias("address"), "is_premium")
    return system.statistics(system.dispatch(priority.classified(told), 4))


@query(f"select range id, {generator_sql.ranked(generator_sql.uniform(42, 'zipf', 'range'), 100, 1.2)} as rank from range(20000)")
def zipf_sample(spark, d):
    return generator.zipf(spark, 100, 20_000, 1.2, seed=42)


@query(f"with {EV} select user_id, count(*) events, count(distinct k) items from ev group by user_id")
def csv_round_trip(spark, d):
    """Events written as CSV with a header and read back with a schema."""
    from rillmark.sources.files import csv_of

    back = csv_of(src.activity(spark, d).select("event_id", "user_id", "item"), "event_id long, user_id long, item long")
    return back.groupBy("user_id").agg(F.count("*").alias("events"), F.countDistinct("item").alias("items"))


def queries() -> dict:
    from rillmark.streaming.queries import QUERIES as streams

    return {**Q, **streams}


def oracle_sql() -> dict[str, str]:
    from rillmark.streaming.queries import SQL as streams

    return {**SQL, **streams}
