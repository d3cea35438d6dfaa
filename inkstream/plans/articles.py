"""Listing, search, text functions, duplicates and versions over the news tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import columns as C
from inkstream.functions.pages import ld_fields, linked_data, opengraph, unescape_udf
from inkstream.functions.pages import plain_text as page_text
from inkstream.functions.vectorised import article_simhash, normalize_text_udf, normalize_url_udf
from inkstream.functions.embedding import embed
from inkstream.operators import duplicates, extraction, listing, search, upserts
from inkstream.sources.sinks import messages
from inkstream.sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ARTICLE = "article_id, source_id, title, language, epoch_us(published_at) // 1000000 AS published_s, epoch_us(created_at) // 1000000 AS created_s"


def _short(df: DataFrame) -> DataFrame:
    return df.select(
        "article_id", "source_id", "title", "language", C.epoch_s(F.col("published_at")).alias("published_s"), C.epoch_s(F.col("created_at")).alias("created_s")
    )


@query(f"""SELECT {_ARTICLE} FROM articles WHERE duplicate_of IS NULL AND language = 'en'
    ORDER BY published_at DESC NULLS LAST, created_at DESC, article_id LIMIT 20 OFFSET 20""")
def list_articles_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of the English articles (a listing's page is the feature)."""
    return _short(listing.list_articles(read_table(spark, d, "articles"), page=2, page_size=20, language="en"))


@query("SELECT count(*) AS total FROM articles WHERE duplicate_of IS NULL AND title ILIKE '%council%'")
def list_articles_total(spark: SparkSession, d: str) -> DataFrame:
    return listing.count_articles(read_table(spark, d, "articles"), q="council")


@query("SELECT article_id, title, body, content_hash FROM articles WHERE article_id = 7")
def get_article(spark: SparkSession, d: str) -> DataFrame:
    return listing.get_article(read_table(spark, d, "articles"), 7).select("article_id", "title", "body", "content_hash")


@query(f"""SELECT {_ARTICLE} FROM articles
    WHERE epoch_us(published_at) BETWEEN epoch_us(TIMESTAMP '2025-06-01') AND epoch_us(TIMESTAMP '2025-12-31 12:00:00')""")
def published_range(spark: SparkSession, d: str) -> DataFrame:
    bounds = {"published_after": datetime.fromisoformat("2025-06-01T00:00:00+00:00"), "published_before": datetime.fromisoformat("2025-12-31T12:00:00+00:00")}
    return _short(read_table(spark, d, "articles").where(listing.article_filter(include_duplicates=True, **bounds)))


@query("""SELECT article_id, title, CASE WHEN title ILIKE '%bridge%' THEN 1.0 ELSE 0.85 END::DOUBLE AS score FROM articles
    WHERE duplicate_of IS NULL AND (title ILIKE '%bridge%' OR body ILIKE '%bridge%')
    ORDER BY score DESC, published_at DESC NULLS LAST, article_id LIMIT 50""")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """Top 50 hits of a word, title hits first."""
    return listing.lexical_search(read_table(spark, d, "articles"), "bridge", 50)


_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _first_vector(vectors: DataFrame) -> list[float]:
    return vectors.orderBy("vec_id").select("embedding").first()[0]


_SIM = "round(list_cosine_similarity(embedding::DOUBLE[], {0}), 6)"


@query(f"SELECT vec_id, {_SIM.format(_VECTOR)} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")
def knn_search(spark: SparkSession, d: str) -> DataFrame:
    v = read_table(spark, d, "embeddings")
    return search.knn(v, _first_vector(v), 10)


@query(f"""SELECT vec_id, {_SIM.format(_VECTOR)} AS similarity FROM embeddings
    WHERE label = 3 AND {_SIM.format(_VECTOR)} >= 0.05 ORDER BY similarity DESC, vec_id LIMIT 10""")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = read_table(spark, d, "embeddings")
    return search.knn(v, _first_vector(v), 10, where="label = 3", least=0.05)


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
    SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM p
    QUALIFY rank <= 5""")
def similar_to(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every hundredth vector, the stated query set, among all vectors."""
    v = read_table(spark, d, "embeddings")
    return search.similar_to(v, v.where("vec_id % 100 = 0"), 5)


@query(f"""WITH lex AS (SELECT article_id AS id, CASE WHEN title ILIKE '%bridge%' THEN 1.0 ELSE 0.85 END AS score FROM articles
      WHERE duplicate_of IS NULL AND (title ILIKE '%bridge%' OR body ILIKE '%bridge%')
      ORDER BY score DESC, published_at DESC NULLS LAST, article_id LIMIT 40),
    sem AS (SELECT vec_id AS id, {_SIM.format(_VECTOR)} AS score FROM embeddings ORDER BY score DESC, id LIMIT 40),
    al AS (SELECT id, score, CASE WHEN score >= 1 THEN 0 ELSE 2 END AS kind FROM lex UNION ALL SELECT id, score, 1 FROM sem WHERE score >= 0.2),
    one AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind, score DESC) = 1)
    SELECT id, score::DOUBLE AS score, kind::INT AS kind FROM one ORDER BY kind, score DESC, id LIMIT 50""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Title hits, strong vector hits, body hits, each article once (vectors stand for the articles of the same number)."""
    v = read_table(spark, d, "embeddings")
    lexical = listing.lexical_search(read_table(spark, d, "articles"), "bridge", 40).select(F.col("article_id").alias("id"), "score")
    semantic = search.knn(v, _first_vector(v), 40).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    return search.hybrid(lexical, semantic, 50, 0.2)


_NORM = r"trim(regexp_replace(replace(replace(nfc_normalize(coalesce({0}, '')), chr(8203), ''), chr(65279), ''), '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_FLAT = _NORM.replace("nfc_normalize(coalesce({0}, ''))", "coalesce({0}, '')")


@query(f"SELECT article_id, {_NORM.format('title')} AS title, {_NORM.format('body')} AS body FROM articles")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "articles")
    return a.select("article_id", normalize_text_udf(F.coalesce("title", F.lit(""))).alias("title"), normalize_text_udf(F.coalesce("body", F.lit(""))).alias("body"))


@query(f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(coalesce(body, ''), chr(10)), lambda x: {_FLAT.format('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS body
    FROM extracted_articles""")
def clean_body(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "extracted_articles").select("page_id", C.clean_body(F.col("body")).alias("body"))


@query(f"""SELECT doc_id, CASE WHEN {_FLAT.format('text')} = '' THEN 0 ELSE len(string_split({_FLAT.format('text')}, ' ')) END::INT AS words FROM documents""")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", C.word_count(F.col("text")).alias("words"))


@query(f"""SELECT article_id, sha256({_FLAT.format('title')} || chr(30) || {_FLAT.format('author')} || chr(30)
      || coalesce(strftime(make_timestamp(epoch_us(published_at)), '%Y-%m-%dT%H:%M:%S+00:00'), '') || chr(30) || {_FLAT.format('body')}
      || chr(30) || 'category=' || {_FLAT.format('category')} || chr(30) || 'country=' || {_FLAT.format('country')}) AS hash FROM articles""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    extra = {"country": F.col("country"), "category": F.col("category")}
    return read_table(spark, d, "articles").select("article_id", C.content_hash(F.col("title"), F.col("author"), at, F.col("body"), extra=extra).alias("hash"))


@query("""WITH f AS (SELECT content_hash, min(article_id) AS original FROM articles WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    SELECT article_id, original FROM articles JOIN f USING (content_hash) WHERE article_id > original""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_copies(read_table(spark, d, "articles"), "article_id", "content_hash")


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[ঀ-৿]')) AS b, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
    SELECT doc_id, CASE WHEN b + l < 10 THEN 'unknown' WHEN b >= 0.25 * l THEN 'bn' ELSE 'en' END AS language FROM c""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", C.script_language(F.col("text")).alias("language"))


@query("""WITH c AS (SELECT article_id, len(regexp_extract_all(title, '[ঀ-৿]')) AS b, len(regexp_extract_all(title, '[A-Za-z]')) AS l FROM articles)
    SELECT article_id, CASE WHEN b >= 2 AND b >= l THEN 'bn' WHEN l >= 2 AND l > b THEN 'en' END AS language FROM c""")
def query_language(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "articles").select("article_id", C.query_language(F.col("title")).alias("language"))


@query(r"""SELECT DISTINCT title, left(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\P{P}-]|\p{S}', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), 200) AS slug
    FROM (SELECT p_name AS title FROM part UNION ALL SELECT name FROM sources)""")
def topic_slug(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "part").select(F.col("p_name").alias("title")).unionByName(read_table(spark, d, "sources").select(F.col("name").alias("title")))
    return names.distinct().select("title", C.slug(F.col("title")).alias("slug"))


@query(r"""SELECT page_id, CASE WHEN hit THEN regexp_extract(u, '^s3://([^/]+)/(.+)$', 1) END AS bucket, CASE WHEN hit THEN regexp_extract(u, '^s3://([^/]+)/(.+)$', 2) END AS key
    FROM (SELECT DISTINCT page_id, trim(raw_html_location) AS u, regexp_matches(trim(raw_html_location), '^s3://([^/]+)/(.+)$') AS hit FROM pages)""")
def s3_uri_parse(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages").select("page_id", F.trim("raw_html_location").alias("u")).distinct()
    return p.select("page_id", C.bucket_and_key(F.col("u")).alias("x")).select("page_id", "x.bucket", "x.key")


@query("""SELECT page_id, 'raw/' || source_slug || '/' || strftime(make_timestamp(epoch_us(fetched_at)), '%Y/%m/%d') || '/' || url_id || '-'
    || strftime(make_timestamp(epoch_us(fetched_at)), '%H%M%S') || '.html' AS key FROM pages WHERE url_type = 'article' AND NOT not_modified""")
def raw_html_key(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages").where("url_type = 'article' and not not_modified")
    return p.select("page_id", C.raw_key(F.col("source_slug"), F.col("fetched_at"), F.col("url_id")).alias("key"))


@query("""SELECT id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    sha256(normalized_url) AS hash FROM crawl_urls""")
def url_hash(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "crawl_urls").select("id", C.url_domain(F.col("url")).alias("host"), F.sha2("normalized_url", 256).alias("hash"))


@query()
def url_normalize_full(spark: SparkSession, d: str) -> DataFrame:
    """Every frontier URL in canonical form, each distinct one normalised once."""
    u = read_table(spark, d, "crawl_urls")
    forms = u.select("url").distinct().withColumn("canonical", normalize_url_udf("url"))
    return u.select("id", "url").join(forms, "url").select("id", "url", "canonical")


@query("""WITH s AS (SELECT id AS source_id, allowed_domains FROM sources)
    SELECT u.id, (len(coalesce(allowed_domains, [])) = 0 OR len(list_filter(allowed_domains, lambda x: u.domain = x OR ends_with(u.domain, '.' || x))) > 0) AS allowed
    FROM crawl_urls u JOIN s USING (source_id)""")
def domain_allowlist(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "sources").select(F.col("id").alias("source_id"), "allowed_domains")
    u = read_table(spark, d, "crawl_urls").select("id", "source_id", "domain").join(s, "source_id")
    return u.select("id", C.domain_allowed(F.col("domain"), F.col("allowed_domains")).alias("allowed"))


@query("""SELECT u.id, CASE WHEN len(list_filter(s.article_url_patterns, lambda x: regexp_full_match(u.normalized_url, '(?s)(?:' || x || ').*'))) > 0 THEN 'article'
      WHEN contains(u.normalized_url, 'sitemap') AND ends_with(u.normalized_url, '.xml') THEN 'sitemap' ELSE 'other' END AS kind
    FROM crawl_urls u JOIN sources s ON s.id = u.source_id""")
def classify_url(spark: SparkSession, d: str) -> DataFrame:
    """A URL is an article's where a pattern of its source matches the normalised form from its start."""
    s = read_table(spark, d, "sources").select(F.col("id").alias("source_id"), "article_url_patterns")
    u = read_table(spark, d, "crawl_urls").select("id", "source_id", "normalized_url").join(s, "source_id")
    anchored = lambda p: F.regexp_like(F.col("normalized_url"), F.concat(F.lit("^(?:"), p, F.lit(")")))
    article = F.coalesce(F.exists("article_url_patterns", anchored), F.lit(False))
    sitemap = F.col("normalized_url").contains("sitemap") & F.col("normalized_url").endswith(".xml")
    return u.select("id", F.when(article, "article").when(sitemap, "sitemap").otherwise("other").alias("kind"))


@query("""SELECT page_id, left(title, 80) AS title, left(body, 2000) AS body, tags[1:5] AS tags FROM extracted_articles""")
def truncate_fields(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "extracted_articles")
    return e.select("page_id", F.substring("title", 1, 80).alias("title"), F.substring("body", 1, 2000).alias("body"), F.slice("tags", 1, 5).alias("tags"))


@query("""SELECT doc_id, greatest(len(string_split(t, ' ')) - 1, CASE WHEN t = '' THEN 0 ELSE 1 END)::INT AS shingles FROM (SELECT doc_id, """ + _FLAT.format("text") + """ AS t FROM documents)""")
def shingles_count(spark: SparkSession, d: str) -> DataFrame:
    """Number of word 2-grams of each document; a text of one word has one."""
    w = C.word_count(F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", F.greatest(w - 1, F.least(w, F.lit(1))).cast("int").alias("shingles"))


@query()
def simhash(spark: SparkSession, d: str) -> DataFrame:
    """64-bit SimHash and its four blocks of every article."""
    a = read_table(spark, d, "articles").select("article_id", article_simhash(F.col("title"), F.col("body")).alias("simhash"))
    return a.withColumn("bands", C.bands(F.col("simhash")))


_BANDS = """WITH one AS (SELECT simhash AS f, min(article_id) AS id FROM articles WHERE simhash IS NOT NULL AND simhash <> 0 GROUP BY 1),
    cut AS (SELECT id, f, unnest([0, 1, 2, 3]) AS band FROM one), b AS (SELECT id, f, band, (f >> (16 * band)) & 65535 AS v FROM cut),
    p AS (SELECT DISTINCT x.id AS a, y.id AS b, bit_count(xor(x.f, y.f))::INT AS distance FROM b x JOIN b y ON x.band = y.band AND x.v = y.v AND x.id < y.id)
"""


@query(_BANDS + """SELECT * FROM p WHERE distance <= 3
    UNION ALL SELECT id, article_id, 0 FROM articles JOIN one ON simhash = f WHERE article_id > id""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stored fingerprints within 3 bits."""
    return duplicates.banded_pairs(read_table(spark, d, "articles").select("article_id", "simhash"), "article_id", "simhash", 3)


@query(_BANDS + "SELECT * FROM p WHERE distance BETWEEN 4 AND 6")
def gray_zone(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.gray_pairs(read_table(spark, d, "articles").select("article_id", "simhash"), "article_id", "simhash")


@query(_BANDS + """SELECT a, b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity
    FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE distance BETWEEN 1 AND 6 AND similarity >= 0.1""")
def semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Gray-zone candidates verified by their vectors (no two vectors of the tables reach 0.92, so at 0.1)."""
    pairs = duplicates.gray_pairs(read_table(spark, d, "articles"), "article_id", "simhash", 1, 6)
    return duplicates.vector_duplicates(pairs.select("a", "b"), read_table(spark, d, "embeddings"), 0.1)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w AS version,
      lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_custkey, o_orderkey, version::INT AS version, (version > 1 AND o_orderstatus IS DISTINCT FROM s) AS o_orderstatus_changed,
      (version > 1 AND o_orderpriority IS DISTINCT FROM p) AS o_orderpriority_changed FROM r""")
def article_versions(spark: SparkSession, d: str) -> DataFrame:
    """Version history with change flags (orders of a customer stand for versions of an article)."""
    o = read_table(spark, d, "orders")
    v = upserts.with_versions(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return v.select("o_custkey", "o_orderkey", "version", "o_orderstatus_changed", "o_orderpriority_changed")


@query("""SELECT page_id, CASE WHEN length(coalesce(trim(title), '')) < 5 THEN 'title' WHEN length(coalesce(trim(body), '')) < 100 THEN 'body' ELSE 'usable' END AS verdict
    FROM extracted_articles""")
def unusable_split(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "extracted_articles")
    size = lambda c: F.length(F.coalesce(F.trim(c), F.lit("")))
    return e.select("page_id", F.when(size("title") < 5, "title").when(size("body") < 100, "body").otherwise("usable").alias("verdict"))


@query("""WITH k AS (SELECT article_id, unnest([{'kind': 'title', 'text': title}, {'kind': 'summary', 'text': summary},
      {'kind': 'body', 'text': title || chr(10) || left(body, 6000)}]) AS x FROM articles)
    SELECT article_id, x.kind AS kind, length(x.text)::INT AS chars FROM k WHERE coalesce(x.text, '') <> ''""")
def embedding_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each article that are embedded: title, summary, and title with body; empty ones are left out."""
    a = read_table(spark, d, "articles")
    kinds = {"title": F.col("title"), "summary": F.col("summary"), "body": F.concat("title", F.lit("\n"), F.substring("body", 1, 6000))}
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in kinds.items()]))
    rows = a.select("article_id", x.alias("x")).where("coalesce(x.text, '') <> ''")
    return rows.select("article_id", "x.kind", F.length("x.text").alias("chars"))


@query("""SELECT vec_id, label, 'new' AS state FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label, 'old' FROM embeddings WHERE label >= 3""")
def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Slots replaced by key: delete, then insert."""
    v = read_table(spark, d, "embeddings").select("vec_id", "label")
    return upserts.replace_by_key(v.withColumn("state", F.lit("old")), v.where("label < 3").withColumn("state", F.lit("new")), ["vec_id"])


_LD_SQL = """p AS (SELECT DISTINCT page_id, raw_html FROM pages WHERE url_type = 'article' AND http_status = 200),
    ld AS (SELECT page_id, try_cast(regexp_extract(raw_html, '<script[^>]*application/ld[+]json[^>]*>(.*?)</script>', 1, 's') AS JSON) AS o FROM p),
    art AS (SELECT page_id, CASE WHEN json_type(o, '$.headline') = 'VARCHAR' THEN nullif(trim(o->>'$.headline'), '') END AS title,
      CASE WHEN json_type(o, '$.articleBody') = 'VARCHAR' THEN nullif(trim(o->>'$.articleBody'), '') END AS body, o->>'$.datePublished' AS published_at
      FROM ld WHERE o->>'$."@type"' IN ('NewsArticle', 'Article', 'BlogPosting', 'ReportageNewsArticle'))"""


@query(f"WITH {_LD_SQL} SELECT * FROM art")
def jsonld_extract(spark: SparkSession, d: str) -> DataFrame:
    """Article metadata of every article page with JSON-LD."""
    p = _article_pages(spark, d).select("page_id", F.get(linked_data(F.col("raw_html")), F.lit(0)).alias("o"))
    x = p.where("o is not null").select("page_id", ld_fields(F.col("o")).alias("x"))
    return x.select("page_id", "x.title", "x.body", "x.published_at")


def _article_pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").where("url_type = 'article' and http_status = 200").select("page_id", "raw_html").distinct()


_PLAIN = "replace(replace(replace(replace(replace({0}, '&quot;', chr(34)), '&#x27;', chr(39)), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>')"
_META = r"""coalesce(nullif(trim(regexp_extract(raw_html, '<meta [^>]*property=["'']{0}["''][^>]*content="([^"]*)"', 1)), ''),
      nullif(trim(regexp_extract(raw_html, '<meta [^>]*content="([^"]*)"[^>]*property=["'']{0}["'']', 1)), ''))"""


@query(f"""WITH p AS (SELECT DISTINCT page_id, raw_html FROM pages WHERE url_type = 'article' AND http_status = 200)
    SELECT page_id, {_PLAIN.format(_META.format('og:title'))} AS og_title, {_PLAIN.format(_META.format('og:description'))} AS og_description,
      {_PLAIN.format(_META.format('og:image'))} AS og_image FROM p""")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    """OpenGraph fields of article pages."""
    p = _article_pages(spark, d).select("page_id", opengraph(F.col("raw_html")).alias("x"))
    return p.select("page_id", F.col("x.title").alias("og_title"), F.col("x.summary").alias("og_description"), F.col("x.image").alias("og_image"))


_SECTION = r"""WITH p AS (SELECT DISTINCT page_id, raw_html FROM pages WHERE url_type = '{0}'),
    l AS (SELECT page_id, unnest(regexp_extract_all(raw_html, '{1}', 1)) AS link FROM p) SELECT DISTINCT page_id, link FROM l"""


@query(_SECTION.format("section", r"""<a href=[''"]([^''"#]+)[''"]"""))
def section_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of section pages, each once a page."""
    p = read_table(spark, d, "pages").where("url_type = 'section'").select("page_id", "raw_html").distinct()
    links = F.regexp_extract_all("raw_html", F.lit(r"""<a href=['"]([^'"#]+)['"]"""), F.lit(1))
    return p.select("page_id", F.explode(links).alias("link")).distinct()


@query(_SECTION.format("sitemap", r"<loc>([^<]*)</loc>"))
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages").where("url_type = 'sitemap'").select("page_id", "raw_html").distinct()
    return p.select("page_id", F.explode(F.regexp_extract_all("raw_html", F.lit(r"<loc>([^<]*)</loc>"), F.lit(1))).alias("link")).distinct()


@query(_SECTION.format("rss", r"<title>([^<]*)</title>"))
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages").where("url_type = 'rss'").select("page_id", "raw_html").distinct()
    return p.select("page_id", F.explode(F.regexp_extract_all("raw_html", F.lit(r"<title>([^<]*)</title>"), F.lit(1))).alias("link")).distinct()


@query("""SELECT i.article_id, CASE WHEN a.article_id IS NULL THEN 'created' WHEN a.content_hash = i.content_hash THEN 'unchanged' ELSE 'updated' END AS verdict
    FROM incoming_articles i LEFT JOIN (SELECT canonical_url, arg_min(content_hash, article_id) AS content_hash, min(article_id) AS article_id FROM articles
      WHERE canonical_url IS NOT NULL GROUP BY 1) a USING (canonical_url)""")
def persist_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether an incoming article is new, an update or unchanged, by its canonical URL."""
    known = read_table(spark, d, "articles").where("canonical_url is not null").groupBy("canonical_url")
    known = known.agg(F.min_by("content_hash", "article_id").alias("known_hash"), F.min("article_id").alias("known_id"))
    i = read_table(spark, d, "incoming_articles").select("article_id", "canonical_url", "content_hash").join(known, "canonical_url", "left")
    same = F.col("known_hash") == F.col("content_hash")
    return i.select("article_id", F.when(F.col("known_id").isNull(), "created").when(same, "unchanged").otherwise("updated").alias("verdict"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY (coalesce(lang, '') = 'en')::INT, crawled_at NULLS LAST, doc_id)::INT AS place FROM documents""")
def language_deferral(spark: SparkSession, d: str) -> DataFrame:
    """The place of every document in the queue that serves other languages before English."""
    late = F.coalesce("lang", F.lit("")) == "en"
    return extraction.deferred_places(read_table(spark, d, "documents"), late, "crawled_at", "doc_id")


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace({_PLAIN.format("coalesce(raw_html, '')")}, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ') AS text
    FROM (SELECT DISTINCT page_id, raw_html FROM pages)""")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages as plain text; the tables' pages hold the five entities of the SQL, others are tested on small texts."""
    p = read_table(spark, d, "pages").select("page_id", "raw_html").distinct()
    return p.select("page_id", page_text(F.col("raw_html")).alias("text"))


@query(r"""WITH p AS (SELECT DISTINCT page_id, raw_html FROM pages WHERE url_type = 'sitemap')
    SELECT page_id, len(regexp_extract_all(raw_html, '<url>'))::INT AS entries,
      least(3, len(regexp_extract_all(raw_html, '<sitemap>')))::INT AS children FROM p""")
def sitemap_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entries of URL sets and newest children of sitemap indexes."""
    p = read_table(spark, d, "pages").where("url_type = 'sitemap'").select("page_id", "raw_html").distinct()
    x = F.col("raw_html")
    return p.select("page_id", F.size(extraction.sitemap_entries(x)).alias("entries"), F.size(extraction.sitemap_children(x)).alias("children"))


@query(r"""WITH p AS (SELECT DISTINCT page_id, raw_html FROM pages WHERE url_type = 'rss'),
    i AS (SELECT page_id, unnest(regexp_extract_all(raw_html, '<item>(.*?)</item>', 1)) AS item FROM p)
    SELECT page_id, regexp_extract(item, '<title>(.*?)</title>', 1) AS title, nullif(regexp_extract(item, '<link>(.*?)</link>', 1), '') AS link,
      coalesce(nullif(regexp_extract(item, '<pubDate>(.*?)</pubDate>', 1), ''), nullif(regexp_extract(item, '<updated>(.*?)</updated>', 1), '')) AS published FROM i""")
def feed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds with their time."""
    p = read_table(spark, d, "pages").where("url_type = 'rss'").select("page_id", "raw_html").distinct()
    x = p.select("page_id", F.explode(extraction.feed_entries(F.col("raw_html"))).alias("x"))
    return x.select("page_id", unescape_udf("x.title").alias("title"), "x.link", "x.published")


@query("""SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT) FILTER (event_id % 5 < 3)::BIGINT AS total FROM events GROUP BY 1""")
def recover_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects recovered from replies: bare, fenced or padded with prose; cut short or without an object there is none."""
    fenced = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    kind = F.col("event_id") % 5
    reply = F.when(kind == 0, F.col("props")).when(kind == 1, fenced).when(kind == 2, F.concat(F.lit("I think "), "props", F.lit(" is right.")))
    reply = reply.when(kind == 3, F.expr("substring(props, 1, length(props) - 1)")).otherwise("no object here")
    e = read_table(spark, d, "events").select("event_type", reply.alias("reply"))
    got = e.select("event_type", extraction.recover_json(F.col("reply"), "k bigint").alias("x"))
    return got.groupBy("event_type").agg(F.sum("x.k").alias("total"))


_BLOB = "coalesce(title, '') || chr(10) || left(coalesce(body, ''), 800)"
_TOKENS = r"list_filter(list_distinct(regexp_extract_all(lower(blob), '[\p{L}\p{N}_ঀ-৿]+')), lambda t: length(t) > 2)"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _among(words: list[str]) -> str:
    return f"len(list_intersect(ts, {_sql_list(words)}))"


def _held(stems: list[str]) -> str:
    return f"len(list_filter({_sql_list(stems)}, lambda s: contains(blob, s)))"


@query(f"""WITH b AS (SELECT article_id, {_BLOB} AS blob FROM articles), t AS (SELECT *, {_TOKENS} AS ts FROM b),
    n AS (SELECT article_id, {_among(extraction.POSITIVE_WORDS)} + len(list_filter(ts, lambda t: len(list_filter({_sql_list(extraction.POSITIVE_STEMS_BN)}, lambda s: contains(t, s))) > 0))
      + {_held(extraction.POSITIVE_STEMS_BN)} AS u, {_among(extraction.NEGATIVE_WORDS)} + {_held(extraction.NEGATIVE_STEMS_BN)} AS d FROM t)
    SELECT article_id, CASE WHEN u > d + 1 THEN 'positive' WHEN d > u + 1 THEN 'negative' ELSE 'neutral' END AS mood FROM n""")
def heuristic_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "articles").select("article_id", extraction.mood(F.col("title"), F.col("body")).alias("mood"))


@query("""WITH k AS (SELECT DISTINCT lower(trim(category)) AS name FROM documents WHERE category IS NOT NULL)
    SELECT doc_id, name, id FROM documents JOIN (SELECT name, row_number() OVER (ORDER BY name) AS id FROM k) ON name = lower(trim(category))""")
def link_topics(spark: SparkSession, d: str) -> DataFrame:
    """Documents linked to topics that are created as they are met."""
    rows = read_table(spark, d, "documents").select("doc_id", F.lower(F.trim("category")).alias("name"))
    dim = spark.createDataFrame([], "id bigint, name string")
    return extraction.link_dimension(rows, dim, ["name"], "id")[1].select("doc_id", "name", "id")


@query()
def embed_articles(spark: SparkSession, d: str) -> DataFrame:
    """A unit vector of each article's title and body."""
    a = read_table(spark, d, "articles")
    return a.select("article_id", embed(F.concat_ws("\n", "title", "body")).alias("embedding"))


@query("""SELECT 'embed' AS kind, to_json({'article_id': article_id, 'language': language})::VARCHAR AS payload, 1 AS attempt FROM articles WHERE language IS NOT NULL""")
def publish_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages(read_table(spark, d, "articles").where("language is not null").select("article_id", "language"), "embed")
