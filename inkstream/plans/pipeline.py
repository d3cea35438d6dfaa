"""From pages to stored articles, the crawl's state, retention cycles and gauges over the news tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import columns as C
from inkstream.operators import analysis, articles, crawl, duplicates, listing, retention, search, stats, upserts
from inkstream.plans.articles import _BANDS, _FLAT, _LD_SQL, _META, _NORM, _PLAIN, _SIM, _VECTOR, _first_vector
from inkstream.plans.operations import _BUCKET, _US, NOW
from inkstream.sources.tables import read_table
from inkstream.streaming import pipelines, stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TIDY = r"nullif(trim(regexp_replace({0}, '[\s\x{{a0}}]+', ' ', 'g')), '')"
_H1 = _TIDY.format(_PLAIN.format("regexp_replace(regexp_extract(raw_html, '(?i)<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')"))
_OWN = "regexp_extract(raw_html, '(?i)<article(?:[ ][^>]*)?>(.*)</article>', 1, 's')"


@query(rf"""WITH {_LD_SQL}, x AS (SELECT p.page_id, raw_html, a.page_id IS NOT NULL AS has_ld, a.title AS ld_title, {_PLAIN.format("coalesce(a.body, '')")} AS b,
      {_PLAIN.format(_META.format("og:title"))} AS og, {_H1} AS h1,
      len(list_filter(regexp_extract_all({_OWN}, '(?i)<p(?:[ ][^>]*)?>(.*?)(?:</p>|<p[ >]|$)', 1, 's'), lambda t: {_TIDY.format("regexp_replace(t, '<[^>]*>', '', 'g')")} IS NOT NULL)) > 0 AS has_p
      FROM p LEFT JOIN art a USING (page_id)), m AS (SELECT *, trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g')) <> '' AS own FROM x)
    SELECT page_id, coalesce(ld_title, og, h1) AS title, CASE WHEN own THEN 'json_ld' WHEN has_p THEN 'selectors' ELSE 'opengraph' END AS method,
      CASE WHEN own THEN 0.95 WHEN has_p AND has_ld THEN 0.85 WHEN has_p THEN 0.75 WHEN coalesce(ld_title, og, h1) IS NOT NULL THEN 0.3 ELSE 0 END::DOUBLE AS confidence FROM m""")
def extract_article(spark: SparkSession, d: str) -> DataFrame:
    """Title, method and confidence of every article page, by layers."""
    p = read_table(spark, d, "pages").where("url_type = 'article' and http_status = 200").select("page_id", "raw_html").distinct()
    found = articles.extract_articles(p, "page_id", "raw_html")
    return found.select("page_id", "title", F.col("extraction_method").alias("method"), F.col("extraction_confidence").alias("confidence"))


_BODY = f"array_to_string(list_filter(list_transform(string_split(nfc_normalize(coalesce(body, '')), chr(10)), lambda x: {_FLAT.format('x')}), lambda x: x <> ''), chr(10) || chr(10))"
_CLEANED = f"""WITH c AS (SELECT page_id, {", ".join(f"nullif({_NORM.format(x)}, '') AS {x}" for x in ("title", "subtitle", "author", "category"))}, {_BODY} AS body,
      published_at, image_urls, tags, extraction_method, extraction_confidence FROM extracted_articles)"""


@query(f"""{_CLEANED}, k AS (SELECT *, len(regexp_extract_all(coalesce(title || ' ', '') || left(body, 2000), '[ঀ-৿]')) AS b, len(regexp_extract_all(coalesce(title || ' ', '') || left(body, 2000), '[A-Za-z]')) AS l FROM c)
    SELECT page_id, title, subtitle, author, category, CASE WHEN b + l < 10 THEN 'unknown' WHEN b >= 0.25 * l THEN 'bn' ELSE 'en' END AS language,
      len(string_split(regexp_replace(body, '\\s+', ' ', 'g'), ' '))::INT AS word_count,
      sha256(coalesce(title, '') || chr(30) || coalesce(author, '') || chr(30) || {_FLAT.format("published_at")} || chr(30) || {_FLAT.format("body")}) AS content_hash,
      least(20, len(list_filter(coalesce(image_urls, []), lambda x: coalesce(x, '') <> '')))::INT AS images, least(50, len(list_filter(coalesce(tags, []), lambda x: coalesce(x, '') <> '')))::INT AS tags
    FROM k WHERE length(coalesce(title, '')) >= 5 AND length(body) >= 100""")
def clean_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Extracted records in clean form."""
    c = articles.clean_extracted(read_table(spark, d, "extracted_articles"), "page_id")[0]
    sizes = [F.size("image_urls").alias("images"), F.size("tags").alias("tags")]
    return c.select("page_id", "title", "subtitle", "author", "category", "language", "word_count", "content_hash", *sizes)


@query(f"""{_CLEANED} SELECT page_id, CASE WHEN length(coalesce(title, '')) < 5 THEN 'title too short' ELSE 'body too short' END AS reason FROM c
    WHERE length(coalesce(title, '')) < 5 OR length(body) < 100""")
def clean_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Extracted records that can't be used, with the reason."""
    return articles.clean_extracted(read_table(spark, d, "extracted_articles"), "page_id")[1]


@query("""WITH p AS (SELECT page_id, any_value(url_id) AS url_id, any_value(fetched_at) AS fetched_at, any_value(raw_html_location) AS loc FROM pages WHERE url_type = 'article' AND http_status = 200 GROUP BY 1),
    r AS (SELECT p.page_id, title, body, loc, md5(body) IS DISTINCT FROM lag(md5(body)) OVER (PARTITION BY p.url_id ORDER BY fetched_at, p.page_id) OR body IS NULL AS changed FROM p LEFT JOIN extracted_articles e USING (page_id))
    SELECT page_id, CASE WHEN coalesce(title, '') = '' OR coalesce(body, '') = '' THEN 'no_content' WHEN NOT changed THEN 'unchanged' WHEN coalesce(loc, '') = '' THEN 'no_location' ELSE 'pass' END AS gate FROM r""")
def crawl_gate(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each fetched article page: no content, same as the fetch before, not stored, or on to processing."""
    p = read_table(spark, d, "pages").where("url_type = 'article' and http_status = 200").select("page_id", "url_id", "fetched_at", "raw_html_location").dropDuplicates(["page_id"])
    e = read_table(spark, d, "extracted_articles").select("page_id", "title", "body", F.md5("body").alias("hash"))
    before = F.lag("hash").over(W.partitionBy("url_id").orderBy("fetched_at", "page_id"))  # the fetches of one URL
    rows = p.join(e, "page_id", "left").withColumn("changed", ~F.col("hash").eqNullSafe(before) | F.col("hash").isNull())
    return articles.crawl_gate(rows, F.col("changed"), "raw_html_location").select("page_id", "gate")


@query("""WITH u AS (SELECT canonical_url, min(article_id) AS by_url, arg_min(content_hash, article_id) AS known FROM articles WHERE canonical_url IS NOT NULL GROUP BY 1),
    h AS (SELECT content_hash, min(article_id) AS by_hash FROM articles WHERE content_hash IS NOT NULL GROUP BY 1), f AS (SELECT simhash, min(article_id) AS id FROM articles WHERE simhash IS NOT NULL AND simhash <> 0 GROUP BY 1),
    q AS (SELECT i.article_id, arg_min(f.id, (bit_count(xor(i.simhash, f.simhash)), f.id)) AS by_print FROM incoming_articles i JOIN f ON bit_count(xor(i.simhash, f.simhash)) <= 3 WHERE i.simhash <> 0 GROUP BY 1)
    SELECT i.article_id, CASE WHEN by_url IS NOT NULL THEN CASE WHEN known IS NOT DISTINCT FROM i.content_hash THEN 'unchanged' ELSE 'updated' END WHEN by_hash IS NOT NULL THEN 'duplicate_exact'
      WHEN by_print IS NOT NULL THEN 'duplicate_near' ELSE 'created' END AS verdict, coalesce(by_url, by_hash, by_print) AS other
    FROM incoming_articles i LEFT JOIN u USING (canonical_url) LEFT JOIN h ON h.content_hash = i.content_hash LEFT JOIN q ON q.article_id = i.article_id""")
def persist_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether each incoming article is new, an update, unchanged, or a duplicate, and of which."""
    return articles.persist_verdicts(read_table(spark, d, "incoming_articles"), read_table(spark, d, "articles"))


_BOTH = "b2 AS (SELECT a AS id, b AS other, distance FROM p UNION ALL SELECT b, a, distance FROM p)"


@query(f"""{_BANDS}, {_BOTH} SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other)::INT AS rank FROM b2 WHERE distance BETWEEN 4 AND 6 QUALIFY rank <= 10""")
def gray_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest gray-zone candidates of each article (a top ten is the feature)."""
    return duplicates.nearest_of(duplicates.gray_pairs(read_table(spark, d, "articles"), "article_id", "simhash"), 10)


@query(f"""{_BANDS}, {_BOTH}, s AS (SELECT id, other AS best, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity
      FROM b2 JOIN embeddings x ON x.vec_id = id JOIN embeddings y ON y.vec_id = other WHERE distance BETWEEN 1 AND 6)
    SELECT * FROM s WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, best) = 1 AND similarity >= 0.1""")
def semantic_best(spark: SparkSession, d: str) -> DataFrame:
    """The most similar gray-zone candidate of each article, by its vector."""
    pairs = duplicates.gray_pairs(read_table(spark, d, "articles"), "article_id", "simhash", 1, 6)
    return duplicates.semantic_verdict(pairs.select("a", "b"), read_table(spark, d, "embeddings"), 0.1)


@query(f"""SELECT article_id, title, {_SIM.format(_VECTOR)} AS similarity FROM embeddings JOIN articles ON article_id = vec_id
    WHERE duplicate_of IS NULL AND label IN (1, 2, 3) ORDER BY similarity DESC, article_id LIMIT 20""")
def knn_articles(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest articles among the vectors of a slot (labels stand for kind, model and version)."""
    v = read_table(spark, d, "embeddings")
    return search.knn_articles(v, read_table(spark, d, "articles"), _first_vector(v), 20, "label in (1, 2, 3)")


_BLOB = "coalesce(title, '') || chr(10) || left(coalesce(body, ''), 800)"


@query(rf"""WITH a AS (SELECT article_id, trim(coalesce(title, '')) AS t, trim(regexp_replace(coalesce(body, ''), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS b,
      list_sort(list_filter(list_distinct(regexp_extract_all(lower({_BLOB}), '[\p{{L}}\p{{N}}_ঀ-৿]+')), lambda w: length(w) > 2 AND regexp_full_match(w, '[\p{{L}}\p{{M}}]+'))) AS k FROM articles),
    c AS (SELECT *, CASE WHEN length(b) < 40 THEN t WHEN length(b) > 400 THEN regexp_replace(left(b, 400), ' [^ ]*$', '') ELSE b END AS s FROM a),
    e AS (SELECT *, CASE WHEN length(s) >= 10 THEN s WHEN t <> '' THEN left(t, 200) ELSE 'Article summary unavailable.' END AS s2 FROM c)
    SELECT article_id, CASE WHEN length(s2) < 10 THEN 'Article summary unavailable.' ELSE s2 END AS summary, k[1:12] AS keywords FROM e""")
def heuristic_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Summary and keywords of every article without a model."""
    x = read_table(spark, d, "articles").select("article_id", analysis.heuristic_analysis(F.col("title"), F.col("body")).alias("x"))
    return x.select("article_id", "x.summary", "x.keywords")


@query("""WITH r AS (SELECT article_id, left(title, article_id % 30) AS s, [category, ' ', author] AS t, CASE article_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Positive ' WHEN 2 THEN 'angry' ELSE '' END AS m, article_id % 9 = 0 AS broken FROM articles)
    SELECT article_id, CASE WHEN broken THEN 'no object' WHEN length(coalesce(s, '')) < 10 THEN 'summary' WHEN m = 'angry' THEN 'sentiment' END AS reason,
      CASE WHEN reason IS NULL THEN CASE WHEN m = ' Positive ' THEN 'positive' ELSE 'neutral' END END AS sentiment, CASE WHEN reason IS NULL THEN len(list_filter(t, lambda x: trim(coalesce(x, '')) <> ''))::INT END AS topics,
      CASE WHEN reason IS NULL THEN 'org' || article_id END AS entity FROM r""")
def validate_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Model replies checked and brought to one form (made from articles: every ninth is cut, every fourth has an unknown sentiment)."""
    a = read_table(spark, d, "articles")
    i = F.col("article_id")
    mood = F.when(i % 4 == 1, " Positive ").when(i % 4 == 2, "angry").when(i % 4 == 3, "")
    entity = F.create_map(F.lit("Board"), F.concat(F.lit(" org"), i.cast("string")))
    fields = [F.substring(F.col("title"), F.lit(1), (i % 30).cast("int")).alias("summary"), F.array("category", F.lit(" "), "author").alias("topics"), entity.alias("entities"), mood.alias("sentiment")]
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(*fields)), F.lit("\n```"))
    rows = a.select("article_id", F.when(i % 9 == 0, F.substring(reply, 1, 30)).otherwise(reply).alias("reply"))
    x = analysis.validate_analyses(rows, "reply")
    return x.select("article_id", "reason", "analysis.sentiment", F.size("analysis.topics").alias("topics"), F.get("analysis.entities", F.lit(0))["name"].alias("entity")).withColumn("topics", F.when(F.col("reason").isNull(), F.col("topics")))


@query("SELECT article_id FROM articles WHERE sentiment IS NULL OR coalesce(summary, '') = ''")
def enrichment_todo(spark: SparkSession, d: str) -> DataFrame:
    return analysis.to_enrich(read_table(spark, d, "articles")).select("article_id")


@query("SELECT article_id, 'Title: ' || coalesce(title, '') || chr(10) || chr(10) || 'Body: ' || left(coalesce(body, ''), 1200) AS prompt FROM articles")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "articles").select("article_id", analysis.prompt(F.col("title"), F.col("body")).alias("prompt"))


@query("""SELECT slug, 'default' AS run FROM sources WHERE enabled AND crawl_enabled UNION ALL
    SELECT slug, 'named' FROM sources WHERE slug = (SELECT min(slug) FROM sources WHERE NOT (enabled AND crawl_enabled))""")
def sources_to_crawl(spark: SparkSession, d: str) -> DataFrame:
    """The sources of a default run, and of a run that names one that is switched off."""
    s = read_table(spark, d, "sources")
    off = s.where("not (enabled and crawl_enabled)").agg(F.min("slug")).first()[0] or ""
    runs = {"default": crawl.sources_to_crawl(s), "named": crawl.sources_to_crawl(s, off)}
    return runs["default"].select("slug", F.lit("default").alias("run")).unionByName(runs["named"].select("slug", F.lit("named").alias("run")))


@query("""WITH n AS (SELECT CASE WHEN length(slug) % 3 = 0 THEN slug WHEN length(slug) % 3 = 1 THEN slug || '-new' ELSE upper(slug) END AS slug FROM sources)
    SELECT slug, CASE WHEN NOT regexp_full_match(slug, '[a-z0-9-]+') THEN 'invalid' WHEN slug IN (SELECT slug FROM sources) THEN 'conflict' ELSE 'inserted' END AS verdict FROM n""")
def source_insert(spark: SparkSession, d: str) -> DataFrame:
    """New sources: some with a slug that is taken, some with one that isn't well formed."""
    s = read_table(spark, d, "sources")
    size = F.length("slug") % 3
    named = F.when(size == 0, F.col("slug")).when(size == 1, F.concat("slug", F.lit("-new"))).otherwise(F.upper("slug"))
    return crawl.insert_sources(s, s.select(named.alias("slug"), "base_url", "name"))[1]


@query("SELECT slug, CASE WHEN crawl_frequency_minutes > 30 THEN 30 ELSE crawl_frequency_minutes END::INT AS crawl_frequency_minutes, CASE WHEN crawl_frequency_minutes > 30 AND country IS NOT NULL THEN lower(country) ELSE country END AS country FROM sources")
def source_patch(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a partial update; what it leaves null stays."""
    s = read_table(spark, d, "sources")
    patches = s.where("crawl_frequency_minutes > 30").select("slug", F.lit(30).alias("crawl_frequency_minutes"), F.lower("country").alias("country"))
    return crawl.patch(s, patches, "slug").select("slug", "crawl_frequency_minutes", "country")


@query(r"""WITH p AS (SELECT DISTINCT page_id, source_slug, normalized_url AS url, raw_html FROM pages WHERE url_type = 'section' AND raw_html IS NOT NULL),
    h AS (SELECT page_id, source_slug, url, unnest(regexp_extract_all(raw_html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#]+)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(raw_html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#]+)["'']', 1), 1) - 1 AS place FROM p),
    l AS (SELECT page_id, source_slug, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_replace(url, '[^/]*$', '') || href END AS link, min(place)::INT AS place FROM h GROUP BY ALL)
    SELECT page_id, link, place FROM l JOIN sources s ON s.slug = source_slug WHERE len(list_filter(article_url_patterns, lambda x: regexp_full_match(link, '(?:' || x || ').*'))) > 0""")
def article_links(spark: SparkSession, d: str) -> DataFrame:
    """Article links of section pages, absolute, at their first place."""
    p = read_table(spark, d, "pages").where("url_type = 'section' and raw_html is not null")
    p = p.select("page_id", "source_slug", F.col("normalized_url").alias("url"), F.col("raw_html").alias("html")).distinct()
    return crawl.article_links(p, read_table(spark, d, "sources"))


@query("""SELECT page_id, CASE WHEN http_status BETWEEN 200 AND 399 THEN NULL WHEN http_status = 403 THEN 'http_403' WHEN http_status = 429 THEN 'http_429' WHEN http_status BETWEEN 500 AND 599 THEN 'http_5xx'
    WHEN http_status IS NOT NULL THEN 'http_other' END AS category FROM (SELECT DISTINCT page_id, http_status FROM pages)""")
def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages").select("page_id", "http_status").distinct()
    return p.select("page_id", crawl.failure_category(F.col("http_status"), F.lit(None).cast("string")).alias("category"))


@query("""SELECT page_id, count(*) AS requests, count(*) FILTER (kind = 'image' OR contains(url, 'facebook.net')) AS blocked FROM
    (SELECT page_id, 'image' AS kind, unnest(image_urls) AS url FROM extracted_articles UNION ALL SELECT page_id, 'document', canonical_url FROM extracted_articles) GROUP BY 1""")
def blocked_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each article page, and how many of them rendering leaves out."""
    e = read_table(spark, d, "extracted_articles")
    all_ = e.select("page_id", F.lit("image").alias("kind"), F.explode("image_urls").alias("url")).unionByName(e.select("page_id", F.lit("document").alias("kind"), F.col("canonical_url").alias("url")))
    return all_.groupBy("page_id").agg(F.count("*").alias("requests"), F.count_if(crawl.blocked(F.col("kind"), F.col("url"))).alias("blocked"))


@query("""WITH r AS (SELECT DISTINCT a.id, url_id, outcome, epoch_us(attempted_at) AS us, coalesce(u.url_type <> 'article', false) AS hub FROM crawl_attempts a LEFT JOIN crawl_urls u ON u.id = a.url_id WHERE url_id IS NOT NULL AND attempted_at IS NOT NULL),
    k AS (SELECT url_id, max(us) FILTER (outcome = 'success') AS ok FROM r GROUP BY 1),
    s AS (SELECT url_id, count(*) AS attempts, arg_max(outcome, (us, id)) AS last_outcome, count(*) FILTER (outcome IS DISTINCT FROM 'success' AND us > coalesce(ok, -1)) AS failures, max(us) // 1000000 AS last_s, bool_or(hub) AS hub FROM r JOIN k USING (url_id) GROUP BY 1)
    SELECT url_id, attempts, last_outcome, failures, last_s, last_s + CASE WHEN failures = 0 THEN CASE WHEN hub THEN 1800 ELSE 86400 END ELSE least(60 * pow(2, least(failures - 1, 20)), 21600)::BIGINT END AS due_s FROM s""")
def fold_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The state of each URL after all its attempts."""
    kinds = read_table(spark, d, "crawl_urls").select(F.col("id").alias("url_id"), (F.col("url_type") != "article").alias("hub"))
    a = read_table(spark, d, "crawl_attempts").select("id", "url_id", "outcome", "attempted_at").join(kinds, "url_id", "left")
    return crawl.fold_attempts(a, F.coalesce("hub", F.lit(False)))


@query("""SELECT id, CASE WHEN lease_owner IS NOT NULL AND id % 2 = 0 THEN 'queued' ELSE status END AS status, CASE WHEN lease_owner IS NOT NULL AND id % 2 = 0 THEN NULL ELSE lease_owner END AS lease_owner FROM crawl_urls""")
def release_leases(spark: SparkSession, d: str) -> DataFrame:
    """Leases that their owners give back; what another owner names stays."""
    u = read_table(spark, d, "crawl_urls").select("id", "status", "lease_owner")
    asked = u.where("lease_owner is not null").select("id", F.when(F.col("id") % 2 == 0, F.col("lease_owner")).otherwise("somebody").alias("lease_owner"))
    return crawl.set_state(u, asked, "queued")


@query("""WITH o AS (SELECT article_id, epoch_us(created_at) AS us, row_number() OVER (ORDER BY created_at, article_id) AS n FROM articles WHERE epoch_us(created_at) < epoch_us(TIMESTAMP '2025-07-01'))
    SELECT ((n - 1) // 200 + 1)::BIGINT AS batch, count(*) AS n, min(us) // 1000000 AS oldest_s, max(us) // 1000000 AS newest_s FROM o WHERE (n - 1) // 200 < 500 GROUP BY 1""")
def retention_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batches of a purge cycle, oldest articles first."""
    b = retention.purge_batches(read_table(spark, d, "articles"), "article_id", "created_at", F.lit("2025-07-01").cast("timestamp"))
    return b.groupBy("batch").agg(F.count("*").alias("n"), C.epoch_s(F.min("created_at")).alias("oldest_s"), C.epoch_s(F.max("created_at")).alias("newest_s"))


@query("""SELECT crawl_job_id, min(epoch_us(attempted_at)) // 1000000 AS started_s, max(epoch_us(recorded_at)) // 1000000 AS finished_s, greatest(0, (max(epoch_us(recorded_at)) - min(epoch_us(attempted_at))) / 1e6)::DOUBLE AS duration_s
    FROM crawl_attempts WHERE crawl_job_id IS NOT NULL GROUP BY 1 ORDER BY started_s DESC, crawl_job_id LIMIT 20 OFFSET 20""")
def recent_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the latest cycles with their duration (crawl jobs stand for cycles; a page is the feature)."""
    t = read_table(spark, d, "crawl_attempts").where("crawl_job_id is not null")
    c = t.groupBy("crawl_job_id").agg(F.min("attempted_at").alias("a"), F.max("recorded_at").alias("b"))
    spans = c.select("crawl_job_id", C.epoch_s(F.col("a")).alias("started_s"), C.epoch_s(F.col("b")).alias("finished_s"), F.greatest(F.lit(0.0), (F.unix_micros("b") - F.unix_micros("a")) / 1e6).alias("duration_s"))
    return retention.recent(spans, "started_s", "crawl_job_id", 20, 20)


@query("""WITH l AS (SELECT trim(raw_html_location) AS x FROM pages), b AS (SELECT DISTINCT CASE WHEN x LIKE 's3://%' THEN split_part(x, '/', 3) ELSE 'raw' END AS bucket,
      CASE WHEN x LIKE 's3://%' THEN substr(x, 7 + length(split_part(x, '/', 3))) ELSE ltrim(x, '/') END AS key FROM l WHERE x <> ''),
    r AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM b) SELECT bucket, ((n - 1) // 1000 + 1)::BIGINT AS chunk, count(*) AS n FROM r GROUP BY ALL""")
def blob_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Delete requests for all stored pages: at most 1,000 keys of one bucket each."""
    p = read_table(spark, d, "pages").select(retention.blob_address(F.col("raw_html_location"), "raw").alias("x")).select("x.*")
    return retention.delete_chunks(p).groupBy("bucket", "chunk").agg(F.count("*").alias("n"))


@query("""SELECT crawl_job_id, count(*) AS attempts, coalesce(sum(bytes_downloaded), 0)::BIGINT AS bytes, coalesce(sum(duration_ms), 0)::BIGINT AS ms, count(*) FILTER (outcome <> 'success') AS errors
    FROM (SELECT DISTINCT id, crawl_job_id, bytes_downloaded, duration_ms, outcome FROM crawl_attempts) WHERE crawl_job_id IS NOT NULL GROUP BY 1""")
def usage_by_job(spark: SparkSession, d: str) -> DataFrame:
    """Usage summed over the attempts of each job; a row logged twice counts once."""
    t = read_table(spark, d, "crawl_attempts").where("crawl_job_id is not null").select("id", "crawl_job_id", "bytes_downloaded", "duration_ms", "outcome").dropDuplicates(["id"])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("bytes_downloaded", "bytes"), ("duration_ms", "ms"))]
    return t.groupBy("crawl_job_id").agg(F.count("*").alias("attempts"), *sums, F.count_if(F.col("outcome") != "success").alias("errors"))


_EDGES = [100, 250, 500, 1000, 2500, 5000, 10000, 30000]


@query(f"""WITH o AS (SELECT DISTINCT id, source_slug, duration_ms FROM crawl_attempts WHERE duration_ms IS NOT NULL), e AS (SELECT unnest({_EDGES}) AS le, unnest({[0, *_EDGES[:-1]]}) AS low),
    h AS (SELECT source_slug, le, low, count(*) FILTER (duration_ms <= le) AS n, count(*) FILTER (duration_ms <= low) AS under FROM o, e GROUP BY ALL),
    t AS (SELECT source_slug, max(n) * 0.95 AS rank FROM h GROUP BY 1), f AS (SELECT source_slug, min(le) AS le, any_value(rank) AS rank FROM h JOIN t USING (source_slug) WHERE n >= rank GROUP BY 1)
    SELECT source_slug, round(low + (le - low) * least((rank - CASE WHEN low = 0 THEN 0 ELSE under END) / (n - CASE WHEN low = 0 THEN 0 ELSE under END), 1), 6)::DOUBLE AS quantile FROM f JOIN h USING (source_slug, le)""")
def p95_from_buckets(spark: SparkSession, d: str) -> DataFrame:
    """95th percentile of fetch durations by source, from cumulative buckets."""
    t = read_table(spark, d, "crawl_attempts").select("id", "source_slug", "duration_ms").dropDuplicates(["id"])
    return stats.histogram_quantile(stats.histogram(t, "source_slug", "duration_ms", _EDGES), "source_slug", 0.95)


@query(f"""WITH w AS (SELECT fetch_method, worker_id, max(epoch_us(recorded_at)) AS last FROM crawl_attempts WHERE epoch_us(recorded_at) <= {_US} GROUP BY ALL), c AS (SELECT fetch_method, count(*) AS alive FROM w WHERE worker_id IS NOT NULL AND {_US} - last < 86400000000 GROUP BY 1)
    SELECT k AS fetch_method, coalesce(alive, 0) AS alive FROM (SELECT unnest(['http', 'browser', 'feed']) AS k) LEFT JOIN c ON fetch_method = k""")
def alive_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Workers that gave a sign of life within a day, by kind of fetch; kinds without any have 0."""
    now = F.lit(NOW).cast("timestamp")
    t = read_table(spark, d, "crawl_attempts").where((F.col("recorded_at") <= now) & F.col("worker_id").isNotNull())
    last = t.groupBy("fetch_method", "worker_id").agg(F.max("recorded_at").alias("last"))
    alive = last.where(F.unix_micros(now) - F.unix_micros("last") < 86_400_000_000).groupBy("fetch_method").agg(F.count("*").alias("alive"))
    return stats.zero_filled(alive, "fetch_method", "alive", ["http", "browser", "feed"])


@query("SELECT count(*) AS total FROM crawl_urls WHERE regexp_full_match(status, 'queued|retry_.*')")
def backlog_sum(spark: SparkSession, d: str) -> DataFrame:
    """URLs in the states whose name matches a pattern, from the gauge by status."""
    gauge = stats.count_by(read_table(spark, d, "crawl_urls"), ["status"], "n")
    return stats.labelled_sum(gauge, "status", "n", "queued|retry_.*")


@query("""SELECT crawl_job_id AS job, 'pages_successful' AS name, count(*) FILTER (outcome = 'success') AS n FROM crawl_attempts WHERE crawl_job_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (outcome = 'success') > 0
    UNION ALL SELECT crawl_job_id, 'pages_requested', count(*) FROM crawl_attempts WHERE crawl_job_id IS NOT NULL GROUP BY 1""")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    """Named counters of each job, added up from two halves of the log."""
    t = read_table(spark, d, "crawl_attempts").where("crawl_job_id is not null").select(F.col("crawl_job_id").alias("job"), "outcome", "id")
    half = lambda k: t.where(F.col("id") % 2 == k)
    counts = lambda x: x.select("job", F.lit("pages_requested").alias("name")).unionByName(x.where("outcome = 'success'").select("job", F.lit("pages_successful").alias("name"))).groupBy("job", "name").agg(F.count("*").alias("n"))
    return upserts.add_named_counters(counts(half(0)), counts(half(1)), ["job"], "name", "n", ["pages_requested", "pages_successful", "pages_failed"])


@query("""WITH v AS (SELECT _d AS day, language, source_id FROM (SELECT strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%d') AS _d, * FROM articles) WHERE epoch_us(created_at) < epoch_us(TIMESTAMP '2025-10-01'))
    SELECT day, 'language' AS key, coalesce(language, 'none') AS value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT day, 'source_id', coalesce(source_id, 'none'), count(*) FROM v GROUP BY ALL""")
def purge_record(spark: SparkSession, d: str) -> DataFrame:
    """What two purge cycles took away by day, language and source: the second is added to what the first recorded."""
    a = read_table(spark, d, "articles").select("created_at", "language", "source_id")
    first, second = (F.lit(x).cast("timestamp") for x in ("2025-07-01", "2025-10-01"))
    counts = [retention.purge_counts(x, "created_at", ["language", "source_id"]) for x in (a.where(F.col("created_at") < first), a.where((F.col("created_at") >= first) & (F.col("created_at") < second)))]
    return upserts.add_counters(*counts, ["day", "key", "value"], "n")


@query("""SELECT article_id, title, (SELECT count(*) FROM articles WHERE duplicate_of IS NULL AND language = 'en') AS total FROM articles WHERE duplicate_of IS NULL AND language = 'en'
    ORDER BY published_at DESC NULLS LAST, article_id LIMIT 20 OFFSET 20""")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """A page of a listing with the total beside it (a page is the feature)."""
    a = read_table(spark, d, "articles").where(listing.article_filter(language="en")).select("article_id", "title", "published_at")
    return listing.page_with_total(a, [F.desc_nulls_last("published_at"), "article_id"], 2, 20).select("article_id", "title", "total")


@query("""SELECT 'frontier_urls{domain="' || domain || '",status="' || status || '"} ' || count(*) AS line FROM crawl_urls WHERE domain IS NOT NULL AND status IS NOT NULL GROUP BY domain, status""")
def metrics_text(spark: SparkSession, d: str) -> DataFrame:
    """The frontier gauge by domain and status in the form that scrapers read."""
    g = read_table(spark, d, "crawl_urls").where("domain is not null and status is not null").groupBy("domain", "status").agg(F.count("*").alias("value"))
    labels = F.create_map(F.lit("status"), "status", F.lit("domain"), "domain")
    return stats.exposition(g.select(F.lit("frontier_urls").alias("name"), labels.alias("labels"), "value"))


@query("""SELECT name, depth FROM (SELECT 'backlog' AS name, count(*) FILTER (event_type <> 'error') AS depth FROM events UNION ALL SELECT 'dead', count(*) FILTER (event_type = 'error') FROM events
    UNION ALL SELECT 'delayed', count(*) FILTER (event_type <> 'error' AND ts > TIMESTAMP '2024-01-20') FROM events)""")
def queue_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Backlog, delayed and dead messages over all streams (event types stand for streams, errors for dead messages)."""
    e = read_table(spark, d, "events")
    live = F.col("event_type") != "error"
    c = e.agg(F.count_if(live).alias("backlog"), F.count_if(~live).alias("dead"), F.count_if(live & (F.col("ts") > F.expr("timestamp_ntz'2024-01-20'"))).alias("delayed"))
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("depth")) for n in ("backlog", "dead", "delayed")])
    return c.select(F.explode(cells).alias("x")).select("x.*")


@query("SELECT slug, name, row_number() OVER (ORDER BY name, slug)::INT AS place FROM sources")
def sources_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the order of their names (a row a source, so one task numbers them)."""
    s = read_table(spark, d, "sources").select("slug", "name")
    return s.withColumn("place", F.row_number().over(W.orderBy("name", "slug")))


@query(f"{_BUCKET} SELECT user_id, event_id, allowed FROM f")
def stream_admission(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event of a user passes a token bucket, from a stream with keyed state."""
    e = pipelines.table_stream(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return pipelines.drain(stateful.stream_token_bucket(e, "user_id", "event_id", "us", rate=0.5, burst=2.0, idle_out=False), "append")
