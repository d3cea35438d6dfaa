"""Crawl analytics, frontier queue, retention and stream plans over the news tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import columns as C
from inkstream.operators import retention, stats, upserts
from inkstream.operators.frontier import ACTIVE, claim, due, reap_expired, token_bucket, touch_urls
from inkstream.sources.tables import read_table
from inkstream.streaming import pipelines

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The moment the plans take as now; the tables end shortly before it.
NOW = "2026-07-01 00:00:00"
_US = f"epoch_us(TIMESTAMP '{NOW}')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


def _day(c: str) -> str:
    return f"strftime(make_timestamp(epoch_us({c})), '%Y-%m-%d')"


@query(f"""SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM articles WHERE epoch_us(created_at) >= {_US} - 30 * 86400000000) AS recent,
    (SELECT count(*) FROM articles WHERE duplicate_of IS NOT NULL) AS duplicates, (SELECT count(*) FROM sources) AS sources,
    (SELECT count(*) FROM sources WHERE enabled) AS enabled, (SELECT coalesce(sum(bytes_downloaded), 0)::BIGINT FROM crawl_attempts) AS bytes""")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    a, s, t = (read_table(spark, d, n) for n in ("articles", "sources", "crawl_attempts"))
    since = F.col("created_at") >= _now() - F.expr("interval 30 days")
    one = a.agg(F.count("*").alias("articles"), F.count_if(since).alias("recent"), F.count("duplicate_of").alias("duplicates"))
    two = s.agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"))
    three = t.agg(F.coalesce(F.sum("bytes_downloaded"), F.lit(0)).alias("bytes"))
    return stats.beside(one, two, three)


@query("SELECT status, failure_category, count(*) AS urls FROM crawl_urls GROUP BY ALL")
def frontier_by_status(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_by(read_table(spark, d, "crawl_urls"), ["status", "failure_category"], "urls")


@query("SELECT language, count(*) AS articles FROM articles GROUP BY ALL")
def articles_by_language(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_by(read_table(spark, d, "articles"), ["language"], "articles")


@query("""WITH a AS (SELECT source_id, count(*) AS n, max(epoch_us(created_at)) // 1000000 AS last_s FROM articles GROUP BY 1),
    u AS (SELECT source_id, count(*) FILTER (status IN ('queued', 'retry_pending')) AS pending, count(*) FILTER (status = 'success') AS ok,
      count(*) FILTER (status IN ('failed', 'blocked')) AS failed FROM crawl_urls GROUP BY 1)
    SELECT slug, coalesce(n, 0) AS articles, last_s, coalesce(pending, 0) AS pending, coalesce(ok, 0) AS success, coalesce(failed, 0) AS failed
    FROM sources s LEFT JOIN a ON a.source_id = s.id LEFT JOIN u ON u.source_id = s.id""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    s, a, u = (read_table(spark, d, n) for n in ("sources", "articles", "crawl_urls"))
    return stats.source_health(s, a, u)


@query(f"""SELECT {_day('created_at')} AS day, slug, count(*) AS articles FROM articles a JOIN sources s ON s.id = a.source_id
    WHERE epoch_us(created_at) >= {_US} - 365 * 86400000000 GROUP BY ALL""")
def articles_timeseries(spark: SparkSession, d: str) -> DataFrame:
    """Articles by day and source over the last year."""
    s = read_table(spark, d, "sources").select(F.col("id").alias("source_id"), "slug")
    rows = read_table(spark, d, "articles").where(F.col("created_at") >= _now() - F.expr("interval 365 days")).join(s, "source_id")
    return stats.daily(rows, "created_at", ["slug"], F.count("*").alias("articles"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_timeseries(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stats.daily(e, "ts", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH o AS (SELECT DISTINCT * FROM crawl_attempts) SELECT strftime(make_timestamp(epoch_us(attempted_at)), '%Y-%m-%d') AS day, source_slug, count(*) AS attempts,
    count(*) FILTER (outcome = 'success') AS success, coalesce(sum(bytes_downloaded), 0)::BIGINT AS bytes FROM o GROUP BY ALL""")
def attempts_daily(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by day and source; a row logged twice counts once."""
    t = read_table(spark, d, "crawl_attempts").select("id", "attempted_at", "source_slug", "outcome", "bytes_downloaded").dropDuplicates(["id"])
    measures = [F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "success").alias("success"), F.coalesce(F.sum("bytes_downloaded"), F.lit(0)).alias("bytes")]
    return stats.daily(t, "attempted_at", ["source_slug"], *measures)


@query("""SELECT p_type AS name, count(*) AS articles FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL ORDER BY articles DESC, name LIMIT 10""")
def top_entities(spark: SparkSession, d: str) -> DataFrame:
    """Ten most linked entities (parts of line items stand for entities of articles)."""
    links = read_table(spark, d, "lineitem").select("l_partkey")
    names = read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("name"))
    return stats.top_k(links, names, "l_partkey", 10)


@query("""SELECT p_type AS name, count(*) AS articles FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10
    GROUP BY ALL ORDER BY articles DESC, name LIMIT 10""")
def top_entities_by_type(spark: SparkSession, d: str) -> DataFrame:
    links = read_table(spark, d, "lineitem").select("l_partkey")
    names = read_table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("name"))
    return stats.top_k(links, names, "l_partkey", 10)


@query("""SELECT s_name AS name, count(*) AS articles FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL ORDER BY articles DESC, name LIMIT 10""")
def top_topics(spark: SparkSession, d: str) -> DataFrame:
    links = read_table(spark, d, "lineitem").select("l_suppkey")
    names = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    return stats.top_k(links, names, "l_suppkey", 10)


@query("""WITH b AS (SELECT CASE WHEN lower(trim(sentiment)) IN ('positive', 'negative', 'neutral') THEN lower(trim(sentiment)) ELSE 'not available' END AS bucket, count(*) AS n
      FROM articles GROUP BY 1)
    SELECT place, bucket, coalesce(n, 0) AS articles FROM (VALUES (1, 'positive'), (2, 'negative'), (3, 'neutral'), (4, 'not available')) v(place, bucket) LEFT JOIN b USING (bucket)""")
def sentiment_buckets(spark: SparkSession, d: str) -> DataFrame:
    return stats.buckets(read_table(spark, d, "articles"), "sentiment", ["positive", "negative", "neutral"], "not available", "articles")


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY 1""")
def latency_p95_by_type(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(read_table(spark, d, "events"), "event_type", "value", 0.95)


@query("""WITH o AS (SELECT DISTINCT id, source_slug, duration_ms FROM crawl_attempts), h AS (SELECT source_slug, unnest([100, 250, 500, 1000, 2500, 5000, 10000, 30000]) AS le, duration_ms FROM o WHERE duration_ms IS NOT NULL)
    SELECT source_slug, le::INT AS le, count(*) FILTER (duration_ms <= le) AS n FROM h GROUP BY ALL""")
def duration_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative histogram of fetch durations by source."""
    return stats.histogram(read_table(spark, d, "crawl_attempts").select("id", "source_slug", "duration_ms").dropDuplicates(["id"]), "source_slug", "duration_ms", [100, 250, 500, 1000, 2500, 5000, 10000, 30000])


@query("""SELECT epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT AS start_s, event_type, round(count(*) / 300.0, 6)::DOUBLE AS rate FROM events GROUP BY ALL""")
def rate_5m(spark: SparkSession, d: str) -> DataFrame:
    return stats.rates(read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], 300)


@query("""SELECT event_type AS stream, count(*) AS depth, max(epoch_us(ts)) // 1000000 AS last_s FROM events GROUP BY 1""")
def queue_depths(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("event_type").alias("stream")).agg(F.count("*").alias("depth"), C.epoch_s(F.max("ts")).alias("last_s"))


@query(f"""WITH l AS (SELECT worker_id, max(epoch_us(recorded_at)) AS last FROM crawl_attempts WHERE epoch_us(recorded_at) <= {_US} GROUP BY 1)
    SELECT worker_id, last // 1000000 AS last_s, (({_US} - last) < 86400000000) AS alive FROM l WHERE worker_id IS NOT NULL""")
def workers_alive(spark: SparkSession, d: str) -> DataFrame:
    """Last sign of life of each worker, and whether it is younger than a day."""
    t = read_table(spark, d, "crawl_attempts").where(F.col("recorded_at") <= _now()).where("worker_id is not null")
    last = t.groupBy("worker_id").agg(F.max("recorded_at").alias("last"))
    return last.select("worker_id", C.epoch_s(F.col("last")).alias("last_s"), (F.unix_micros(_now()) - F.unix_micros("last") < 86_400_000_000).alias("alive"))


@query(f"""SELECT id, priority, epoch_us(next_crawl_at) // 1000000 AS due_s FROM crawl_urls
    WHERE status IN ('queued', 'retry_pending') AND epoch_us(next_crawl_at) <= {_US} ORDER BY priority DESC, next_crawl_at, id LIMIT 20""")
def claim_batch(spark: SparkSession, d: str) -> DataFrame:
    """The 20 due URLs of highest priority (a batch is the feature)."""
    return claim(read_table(spark, d, "crawl_urls"), _now(), 20).select("id", "priority", C.epoch_s(F.col("next_crawl_at")).alias("due_s"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND epoch_us(o_orderdate) < epoch_us(TIMESTAMP '1998-01-01') THEN 'queued' ELSE o_orderstatus END AS status FROM orders""")
def reap_expired_leases(spark: SparkSession, d: str) -> DataFrame:
    """Leases that ran out go back to the queue (pending orders stand for leased URLs)."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("lease_expires_at"))
    return reap_expired(o, F.lit("1998-01-01").cast("timestamp"), leased=["P"]).select("id", "status")


@query("""SELECT id, CASE WHEN status IN ('failed', 'blocked') THEN 'queued' ELSE status END AS status,
    CASE WHEN status IN ('failed', 'blocked') THEN 0 ELSE retry_count END::INT AS retry_count FROM crawl_urls""")
def requeue_failed(spark: SparkSession, d: str) -> DataFrame:
    u = read_table(spark, d, "crawl_urls")
    hit = F.col("status").isin("failed", "blocked")
    return u.select("id", F.when(hit, "queued").otherwise(F.col("status")).alias("status"), F.when(hit, 0).otherwise(F.col("retry_count")).alias("retry_count"))


@query("""SELECT id, CASE WHEN failure_category IN ('http_403', 'http_429') THEN 4 ELSE 1 END * least(60.0 * pow(2, greatest(retry_count, 1) - 1), 21600)::DOUBLE AS wait_s
    FROM crawl_urls WHERE retry_count IS NOT NULL""")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    u = read_table(spark, d, "crawl_urls").where("retry_count is not null")
    blocked = F.coalesce(F.col("failure_category").isin("http_403", "http_429"), F.lit(False))
    return u.select("id", C.backoff_seconds(F.col("retry_count"), blocked=blocked).alias("wait_s"))


@query("""WITH state AS (SELECT url, min(id) AS id FROM crawl_urls WHERE last_crawled_at IS NOT NULL GROUP BY url),
    batch AS (SELECT url, min(id) AS id, max(epoch_us(last_seen_at)) // 1000000 AS seen FROM crawl_urls GROUP BY url)
    SELECT url, coalesce(state.id, batch.id) AS id, seen FROM batch LEFT JOIN state USING (url)""")
def url_upsert_touch(spark: SparkSession, d: str) -> DataFrame:
    """Discovered URLs folded into the crawled ones: known ones are only touched, new ones inserted once."""
    u = read_table(spark, d, "crawl_urls").select("url", "id", "last_crawled_at", C.epoch_s(F.col("last_seen_at")).alias("seen"))
    state = u.where("last_crawled_at is not null").groupBy("url").agg(F.min("id").alias("id"), F.lit(0).cast("bigint").alias("seen"))
    batch = u.groupBy("url").agg(F.min("id").alias("id"), F.max("seen").alias("seen"))
    return touch_urls(state, batch)


@query("""SELECT id, CASE WHEN url_type <> 'article' AND status NOT IN ('leased', 'crawling') THEN 'queued' ELSE status END AS status
    FROM crawl_urls QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY id) = 1""")
def url_upsert_requeue(spark: SparkSession, d: str) -> DataFrame:
    """A job's hub pages are queued again unless a worker holds them."""
    u = upserts.first_per_key(read_table(spark, d, "crawl_urls"), ["url_hash"], ["id"]).select("id", "status", "url_type")
    job = u.where("url_type <> 'article'")
    return upserts.update_matched(u, job, ["id"], {"status": F.lit("queued")}, ~F.col("status").isin(*ACTIVE)).select("id", "status")


@query(f"""WITH a AS (SELECT source_id, count(*) AS n FROM articles GROUP BY 1), q AS (SELECT source_id, count(*) FILTER (url_type <> 'article') AS hubs, count(*) AS due FROM crawl_urls
      WHERE status IN ('queued', 'retry_pending') AND epoch_us(next_crawl_at) <= {_US} GROUP BY 1)
    SELECT slug, row_number() OVER (ORDER BY coalesce(n, 0), coalesce(hubs, 0) DESC, coalesce(due, 0) DESC, slug)::INT AS place FROM sources s
    LEFT JOIN a ON a.source_id = s.id LEFT JOIN q ON q.source_id = s.id""")
def fair_source_order(spark: SparkSession, d: str) -> DataFrame:
    """Order in which sources are served: fewest articles, most pending hubs, most due URLs."""
    s, a, u = (read_table(spark, d, n) for n in ("sources", "articles", "crawl_urls"))
    return stats.fair_order(s, a, u.where(due(_now())))


@query("""SELECT slug, kind, url FROM (SELECT slug, 'homepage' AS kind, base_url AS url FROM sources UNION ALL SELECT slug, 'section', unnest(section_urls) FROM sources
    UNION ALL SELECT slug, 'sitemap', unnest(sitemap_urls) FROM sources UNION ALL SELECT slug, 'rss', unnest(rss_urls) FROM sources) WHERE url IS NOT NULL""")
def job_entry_urls(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "sources")
    parts = [s.select("slug", F.lit("homepage").alias("kind"), F.col("base_url").alias("url"))]
    parts += [s.select("slug", F.lit(k).alias("kind"), F.explode(f"{k}_urls").alias("url")) for k in ("section", "sitemap", "rss")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("url is not null")


@query("""SELECT slug, count(*) AS deleted FROM articles a JOIN sources s ON s.id = a.source_id WHERE epoch_us(created_at) < epoch_us(TIMESTAMP '2025-07-01')
    GROUP BY 1 ORDER BY deleted DESC, slug LIMIT 20""")
def retention_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "sources").select(F.col("id").alias("source_id"), "slug")
    old = read_table(spark, d, "articles").where(F.col("created_at") < F.lit("2025-07-01").cast("timestamp")).join(s, "source_id")
    return stats.count_by(old, ["slug"], "deleted").orderBy(F.desc("deleted"), "slug").limit(20)


@query("""SELECT language, count(*) AS deleted FROM articles WHERE epoch_us(created_at) < epoch_us(TIMESTAMP '2025-07-01') GROUP BY 1""")
def retention_by_language(spark: SparkSession, d: str) -> DataFrame:
    old = read_table(spark, d, "articles").where(F.col("created_at") < F.lit("2025-07-01").cast("timestamp"))
    return stats.count_by(old, ["language"], "deleted")


@query("""WITH v AS (SELECT article_id FROM articles WHERE epoch_us(created_at) < epoch_us(TIMESTAMP '2025-07-01'))
    SELECT article_id, CASE WHEN duplicate_of NOT IN (FROM v) THEN duplicate_of END AS duplicate_of FROM articles WHERE article_id NOT IN (FROM v)""")
def retention_purge_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Articles left after a purge, references to purged ones set to null."""
    a = read_table(spark, d, "articles").select("article_id", "duplicate_of", "created_at")
    victims = a.where(F.col("created_at") < F.lit("2025-07-01").cast("timestamp")).select("article_id")
    left = upserts.delete_cascade(a, {}, "article_id", victims)["parent"]
    return upserts.null_references(left.select("article_id", "duplicate_of"), "duplicate_of", victims, "article_id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')""")
def retention_children_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Child rows left after their parents' purge (line items of orders)."""
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    victims = o.where("o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey")
    left = upserts.delete_cascade(o, {"lines": (li, "l_orderkey")}, "o_orderkey", victims)["lines"]
    return left.select("l_orderkey", "l_linenumber")


@query(f"""WITH c AS (SELECT count(*) AS n, max(article_id) AS top, count(*) FILTER (epoch_us(created_at) < epoch_us(TIMESTAMP '2025-07-01')) AS old FROM articles),
    t AS (SELECT ceil(old / 200.0) AS need FROM c), k AS (SELECT count(*) AS tracked FROM incoming_articles WHERE batch_no <= 2), m AS (SELECT max(article_id) AS made FROM incoming_articles)
    SELECT n - old AS live, old AS purged, least(need, 500)::BIGINT AS batches, greatest(0, made - n - tracked)::BIGINT AS untracked FROM c, t, k, m""")
def retention_overview(spark: SparkSession, d: str) -> DataFrame:
    """Live and purgeable articles, batches of a cycle, and ids given out that are neither there nor tracked (two batches stand for tracked ones)."""
    a, i = read_table(spark, d, "articles"), read_table(spark, d, "incoming_articles")
    c = a.agg(F.count("*").alias("n"), F.count_if(F.col("created_at") < F.lit("2025-07-01").cast("timestamp")).alias("old"))
    c = stats.beside(c, i.agg(F.count_if(F.col("batch_no") <= 2).alias("tracked"), F.max("article_id").alias("made")))
    batches = F.least(F.ceil(F.col("old") / 200), F.lit(500)).cast("bigint")
    lost = retention.untracked(F.col("made"), F.col("n"), F.col("tracked")).cast("bigint")
    return c.select((F.col("n") - F.col("old")).alias("live"), F.col("old").alias("purged"), batches.alias("batches"), lost.alias("untracked"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def purge_daily_merge(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of small and large events merged, as maps of counts by type."""
    e = read_table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", (F.col("value") < 50).cast("int").alias("half"))
    counts = e.groupBy("half", "day", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("half", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # an entry a type
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    a, b = (maps.where(f"half = {h}").select("day", F.col("m").alias(f"m{h}")) for h in (0, 1))
    merged = a.join(b, "day", "full").select("day", upserts.merge_counts(F.coalesce("m0", empty), F.coalesce("m1", empty)).alias("m"))
    return merged.select("day", F.explode("m").alias("event_type", "n"))


@query("""WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS a, count(*) AS b FROM events GROUP BY 1) SELECT day, greatest(a, b) AS n FROM s""")
def daily_stats_greatest_merge(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    state, live = (x.groupBy("day").agg(F.count("*").alias("n")) for x in (e.where("event_type = 'click'"), e))
    return upserts.greatest_merge(state, live, ["day"], "n")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def counter_additive_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    state, delta = (x.groupBy("event_type").agg(F.count("*").alias("n")) for x in (e.where(f"ts {op} timestamp_ntz'2024-01-16'") for op in ("<", ">=")))
    return upserts.add_counters(state, delta, ["event_type"], "n")


@query("SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Customers' first finished order, and for those without one their first order."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    state = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return upserts.insert_if_absent(state, o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), ["o_custkey"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts from a file stream, drained in complete mode."""
    return pipelines.daily_counts(spark, d, "events", "ts", "event_type")


@query("""SELECT event_type, count(*) FILTER (k IS NOT NULL) AS decoded, count(*) FILTER (k IS NULL) AS rejected
    FROM (SELECT event_type, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY 1""")
def stream_decode_dlq(spark: SparkSession, d: str) -> DataFrame:
    """Messages decoded by schema in micro-batches; malformed ones go to the rejects (every seventh is cut short, every eleventh lacks its field)."""
    return pipelines.decode_counts(spark, d)


_BUCKET = """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    f AS (SELECT user_id, event_id, us, n, 1.0::DOUBLE AS tokens, true AS allowed, 0.0::DOUBLE AS wait_s FROM r WHERE n = 1
      UNION ALL SELECT user_id, event_id, us, n, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN 0.0 ELSE (1 - t) / 0.5 END::DOUBLE
      FROM (SELECT r.*, least(2.0, f.tokens + (r.us - f.us) / 1e6 * 0.5)::DOUBLE AS t FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))"""


@query(f"{_BUCKET} SELECT user_id, event_id, allowed, wait_s FROM f")
def token_bucket_admission(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event of a user passes a token bucket of 2 with half a token a second."""
    e = read_table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return token_bucket(e, "user_id", "event_id", "us", rate=0.5, burst=2.0)


@query("""SELECT url_id, arg_max(outcome, (attempted_at, id)) AS outcome, max(epoch_us(attempted_at)) // 1000000 AS at_s FROM crawl_attempts
    WHERE url_id IS NOT NULL GROUP BY 1""")
def stream_latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    """The last attempt at each URL, kept up to date by an idempotent upsert of micro-batches."""
    rows = pipelines.table_stream(spark, d, "crawl_attempts").where("url_id is not null").select("url_id", "id", "attempted_at", "outcome")
    latest = pipelines.fold_table(rows, pipelines.latest_by_key("url_id", "attempted_at", "id"))
    return latest.select("url_id", "outcome", C.epoch_s(F.col("attempted_at")).alias("at_s"))
