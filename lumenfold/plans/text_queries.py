"""Queries over texts and pages: cleaning, the junk gate, names in texts, and parsed markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import artist_key, event_key, film_core, folded, normalized, profile_hash, sql_norm
from lumenfold.operators import affinity, gazetteer, normalize
from lumenfold.operators.components import new_folder
from lumenfold.operators.search_index import SearchIndex
from lumenfold.plans.registry import query
from lumenfold.plans.views import table
from lumenfold.sources import html, linked_data

_LINE = r"(buy\s+tickets?|get\s+tickets?|tickets?\s+(on\s+sale|available)|doors?\s+open|21\s*\+|18\s*\+|all\s+ages|presented\s+by|follow\s+us|click\s+here|rsvp|sold\s+out|free\s+entry|no\s+refunds?)"


@query(rf"""WITH s AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '), '&#39;', chr(39)), '&quot;', '"'), '&rsquo;', chr(39)), '&ldquo;', '"'), '&rdquo;', '"') AS s FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^\s*{_LINE}.*$')) AS lines FROM s),
c AS (SELECT doc_id, regexp_replace(trim(regexp_replace(array_to_string(lines, ' '), '[\s\p{{Z}}]+', ' ', 'g')), '\s+([.,;:!?])', '\1', 'g') AS s FROM l)
SELECT doc_id, CASE WHEN length(s) < 3 THEN NULL WHEN length(s) > 400 THEN regexp_replace(regexp_replace(substr(s, 1, 400), ' [^ ]*$', ''), '[,;:-]+$', '') || '…' ELSE s END AS detail FROM c""")
def clean_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize.clean_detail("text").alias("detail"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(*patterns: str) -> str:
    return " AND ".join(f"regexp_matches(title, {_sql(p)})" for p in patterns)


@query(f"""WITH t AS (SELECT doc_id, text AS title FROM documents) SELECT doc_id, CASE WHEN {_has(normalize.PHONE)} THEN 'phone number in title (call-center spam)' WHEN {_has(normalize.SERVICE)} THEN 'call-center service phrasing in title'
  WHEN {_has(normalize.TRAVEL_BRAND, normalize.TRAVEL_ACTION)} THEN 'airline-hotline spam title' WHEN {_has(normalize.MONEY_BRAND, normalize.MONEY_ACTION)} THEN 'insurance/account-service spam title'
  WHEN {_has(normalize.FAQ)} THEN 'FAQ-guide hotline spam title' WHEN {_has(normalize.AIRLINE)} AND ({_has(normalize.TRAVEL_ACTION)} OR {_has(normalize.DIGITS)}) THEN 'airline-hotline spam title'
  WHEN {_has(normalize.UPSELL)} OR {_has(normalize.OFFER)} THEN 'ticket add-on / presale-offer listing, not an event' END AS reason FROM t""")
def junk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize.junk_reason("text").alias("reason"))


@query(f"SELECT doc_id, md5({sql_norm('text')}) AS text_key, substr(sha1({sql_norm('text')} || '|' || '' || '|' || {sql_norm('source')}), 1, 12) AS key, substr(sha256('salt:' || lower(trim(source))), 1, 16) AS profile FROM documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(normalized("text")).alias("text_key"), event_key("text", F.lit(""), "source").alias("key"), profile_hash("source", "salt:").alias("profile"))


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded, md5(trim(regexp_replace(lower(strip_accents(text)), '[\\s\\p{Z}]+', ' ', 'g'))) AS key FROM documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folded("text")).alias("folded"), F.md5(artist_key("text")).alias("key"))


@query(f"SELECT p_partkey AS part, {sql_norm('p_name')} AS core FROM part")
def film_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    edition = F.element_at(F.array(*map(F.lit, ("", " (70mm)", " 4K Restoration", " (1999)", " 50th Anniversary"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), film_core(F.concat("p_name", edition)).alias("core"))


@query(r"""WITH words AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS gram FROM words, range(1, 20000) t(i) WHERE i < len(w)), items AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
keys AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] AS gram FROM items, range(1, 20000) t(i) WHERE i < len(w))
SELECT item_id, count(*) AS n FROM keys JOIN grams USING (gram) GROUP BY item_id""")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often documents hold a pair of words of a benchmark item, by a join on runs of two words."""
    keys = affinity.token_grams(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), 2).where("gram like '% %'")
    grams = affinity.token_grams(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 2).where("gram like '% %'")
    return grams.join(keys, "gram").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '&amp;', '&') AS title, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS links,
  len(regexp_extract_all(html, '(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)) AS blocks FROM pages""")
def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.replace(html.title("html"), F.lit("&amp;"), F.lit("&")).alias("title"), F.size(html.hrefs("html")).alias("links"), F.size(html.json_blocks("html")).alias("blocks"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS b FROM pages)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS words FROM b""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.visible_text("html")).alias("words"))


@query("""WITH n AS (SELECT ltrim(substr(s_name, 10), '0') AS name, s_suppkey AS turn, s_nationkey AS nation FROM supplier), t AS (SELECT DISTINCT lower(c_name) AS text FROM customer)
SELECT text, name, turn::BIGINT AS turn, nation::BIGINT AS nation FROM t JOIN n ON name <> '' AND contains(text, name) QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(name) DESC, turn) = 1""")
def longest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' numbers as a gazetteer: the longest in each customer's name."""
    names = table(spark, sf_dir, "supplier").select(F.ltrim(F.substring("s_name", 10, 99), F.lit("0")).alias("name"), F.col("s_suppkey").alias("turn"), F.col("s_nationkey").alias("nation"))
    return gazetteer.longest(table(spark, sf_dir, "customer").select(F.lower("c_name").alias("text")), names)


@query("""SELECT o_custkey AS page, 'Order ' || o_orderkey AS title, o_orderdate::DATE::VARCHAR AS date, c_name AS venue, n_name AS neighborhood, (o_orderkey % 90 + 1)::VARCHAR AS price_min,
CASE WHEN o_orderkey % 3 = 0 THEN '$' || (o_orderkey % 90 + 1) || '-' || (o_orderkey % 90 + 9) ELSE '$' || (o_orderkey % 90 + 1) END AS price, CASE o_orderkey % 2 WHEN 0 THEN 'MusicEvent' END AS category, 2::BIGINT AS blocks, 1::BIGINT AS unread
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer, whose orders are the events of a graph; a second block can't be read."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    key = F.col("o_orderkey")
    kind = F.when(key % 2 == 0, F.to_json(F.array(F.lit("MusicEvent"))).substr(F.lit(2), F.lit(12))).otherwise(F.lit('["Thing","Festival"]'))
    offer = F.concat(F.lit('{"lowPrice":'), key % 90 + 1, F.when(key % 3 == 0, F.concat(F.lit(',"highPrice":"'), key % 90 + 9, F.lit('"'))).otherwise(""), F.lit("}"))
    event = F.concat(
        F.lit('{"@type":'), kind, F.lit(',"name":"Order '), key, F.lit('","startDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), F.lit('","location":{"name":"'), "c_name", F.lit('","address":{"addressLocality":"'), "n_name",
        F.lit('"}},"offers":'), F.when(key % 5 == 0, F.concat(F.lit("["), offer, F.lit("]"))).otherwise(offer), F.lit("}"),
    )
    mark = '<script type="application/ld+json">'
    body = F.concat(F.lit(mark + '{"@graph":[{"@type":"Place"},'), F.array_join(F.collect_list(event), ","), F.lit(f"]}}</script>{mark}{{bad</script>"))
    pages = rows.groupBy(F.col("o_custkey").alias("page")).agg(body.alias("html"))
    events, counts = linked_data.page_events(pages, "page", "html")
    return events.join(counts, "page").select("page", "title", "date", "venue", "neighborhood", "price_min", "price", "category", "blocks", "unread")


@query(f"""WITH c AS (SELECT client_id AS key, {sql_norm("coalesce(name, '') || ' ' || coalesce(split_part(email, '@', 1), '') || ' ' || coalesce(city, '')")} AS hay, string_split(name, ' ') AS w, city FROM clients),
lines AS (SELECT DISTINCT unnest([right(w[1], 3) || ' ' || left(w[2], 3), city || ' ' || w[2], w[2] || ' ' || w[1], substr(city, 2, 3)]) AS line FROM c),
l AS (SELECT line, {sql_norm("line")} AS p FROM lines WHERE line IS NOT NULL), h AS (SELECT DISTINCT key, hay FROM c WHERE key IS NOT NULL)
SELECT line, count(DISTINCT key) AS n, min(key) AS first_key, max(key) AS last_key FROM l JOIN h ON p <> '' AND (contains(hay, p) OR list_has_all(string_split(hay, ' '), string_split(p, ' '))) GROUP BY line""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients as a catalogue, and the lines that its own names and cities suggest: cut at both ends, in another order, or a piece of a word."""
    c, w = table(spark, sf_dir, "clients"), F.split("name", " ")
    rows = c.select(F.col("client_id").alias("key"), F.col("name").alias("title"), F.array(F.coalesce(F.substring_index("email", "@", 1), F.lit(""))).alias("lineup"), F.col("city").alias("venue"))
    first, last = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    typed = [F.concat(F.right(first, F.lit(3)), F.lit(" "), F.left(last, F.lit(3))), F.concat("city", F.lit(" "), last), F.concat(last, F.lit(" "), first), F.substring("city", 2, 3)]
    index = SearchIndex(spark, new_folder(spark), 16)
    index.write(rows)
    found = index.search(c.select(F.explode(F.array(*typed)).alias("line")).where("line is not null").distinct())
    return found.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
