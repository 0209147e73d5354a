"""Queries of search, enrichment, crawl, refresh and reconciliation over the driver's tables in other roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import crawl, enrich, reconcile, search
from ..operators.standardize import FIELDS
from ..sources import html_tables
from .layouts import LEVEL, LINES, PLAIN, gathered, lines
from .layouts import text as cells
from .registry import golden, pick, query, table

c = F.col


@query("""SELECT c_custkey, c_name, o_orderkey, rn - 1 AS row_ord, CASE WHEN o_orderkey % 7 = 0 THEN 'o' || o_orderkey ELSE 'row-' || (rn - 1) END AS row_ref
FROM (SELECT c_custkey, c_name, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey)::INTEGER AS rn FROM customer JOIN orders ON c_custkey = o_custkey)""")
def flattened_rows(spark, d):
    """Entities with each of their rows and its reference; entities without rows vanish."""
    ref = F.when(c("o_orderkey") % 7 == 0, F.concat(F.lit("o"), "o_orderkey")).otherwise(" ")
    rows = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", ref.alias("rowRef")))).alias("rows"))
    entities = table(spark, d, "customer").select("c_custkey", "c_name")
    return search.flatten(entities, rows, "c_custkey").select("c_custkey", "c_name", "o_orderkey", "row_ord", "row_ref")


def _unis(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", pick(["federal", "art", "x"], "c_custkey").alias("kind"), (c("c_custkey") % 4 == 0).alias("dorm"), pick(["ok", "partial"], "c_custkey").alias("status"))


@query("""SELECT c_custkey, 'main' AS page FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 = 0 AND contains(lower(c_name), '00')
UNION ALL SELECT c_custkey, 'catalog' FROM customer WHERE c_custkey % 2 = 0 AND contains(lower(c_name), '12')
UNION ALL SELECT c_custkey, 'entity' FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 1 AND contains('творческий', 'творч')
UNION ALL SELECT c_custkey, 'profile' FROM customer WHERE c_acctbal > 5000 AND c_custkey % 4 = 0
UNION ALL SELECT 7, 'found' UNION ALL (SELECT c_custkey, 'limited' FROM customer ORDER BY c_custkey LIMIT 4) UNION ALL SELECT c_custkey, 'batch' FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) WHERE rn BETWEEN 4 AND 6""")
def page_filters(spark, d):
    """The filters of the main table, the catalogue, an entity's and a profile's rows, look-up by id, and limits."""
    unis, name = _unis(spark, d), [c("c_name")]
    pages = {
        "main": search.Search(name, "00", filters=(("kind", "federal"),), where=(c("dorm"),), limit=None).rows(unis),
        "catalog": search.Search(name, " 12 ", filters=(("status", "ok"),), limit=None, trim=True).rows(unis),
        "entity": search.Search([normalize.type_label("kind")], "ТВОРЧ", filters=(("status", "all"),), where=(search.seats("budget", c("c_acctbal"), F.lit(0)),), limit=None).rows(unis),
        "profile": search.Search(name, "  ", where=(c("dorm"), search.seats("any", c("c_acctbal") - 5000, F.lit(0))), limit=None, trim=True).rows(unis),
        "found": search.by_id(unis, "c_custkey", 7),
        "limited": search.Search(name, ties=("c_custkey",), limit=4).shown(unis),
        "batch": search.batch(unis, "c_custkey", 2, 3),
    }
    out = [df.select("c_custkey", F.lit(n).alias("page")) for n, df in pages.items()]
    for df in out[1:]:
        out[0] = out[0].union(df)
    return out[0]


@query("""WITH t AS (SELECT c_nationkey, c_mktsegment, c_custkey % 6 AS course FROM customer)
SELECT c_nationkey, list_sort(list_distinct(list(CASE WHEN course = 0 THEN 'вечер' ELSE course::VARCHAR END))) AS courses, CASE WHEN bool_or(course = 3) THEN '3' END AS kept, (SELECT count(DISTINCT c_mktsegment) FROM customer)::BIGINT AS segments FROM t GROUP BY c_nationkey""")
def table_facets(spark, d):
    """Each table's own facet values in order, a selection that is kept while offered, and one facet over all."""
    course = F.when(c("c_custkey") % 6 == 0, "вечер").otherwise((c("c_custkey") % 6).cast("string"))
    t = table(spark, d, "customer")
    own = search.facets_of(t.withColumn("course", course), ["c_nationkey"], "course")
    n = search.facet(t, "c_mktsegment").agg(F.count("*").alias("segments"))
    return own.select("c_nationkey", c("values").alias("courses"), search.keep_selection(c("values"), F.lit("3")).alias("kept")).crossJoin(n)  # one row


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['std'] ELSE ['raw'] END AS columns, p_partkey % 3 = 0 AS standardized, greatest(p_size, p_partkey % 100, 7)::BIGINT AS most, CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_size END::BIGINT AS stat FROM part""")
def table_choice(spark, d):
    """The standardised table unless it is empty, the largest number of a row, a stored statistic or the computed one."""
    some, none = F.array(F.array(F.lit("x"))), F.array().cast("array<array<string>>")
    rows = F.when(c("p_partkey") % 3 == 0, some).when(c("p_partkey") % 3 == 1, none)
    active = search.active_table(F.array(F.lit("raw")), some, F.array(F.lit("std")), rows)
    row = F.array(F.concat(F.lit("n"), c("p_size").cast("string"), F.lit("/7")), (c("p_partkey") % 100).cast("string"), F.lit(None).cast("string"))
    stored = F.when(c("p_size") % 2 == 0, F.lit(0)).otherwise(c("p_size")).cast("long")
    return table(spark, d, "part").select("p_partkey", active["columns"].alias("columns"), active["standardized"].alias("standardized"), search.max_number(row).alias("most"), search.stored_or(stored, c("p_partkey")).alias("stat"))



@query(f"""WITH u AS (SELECT c_custkey AS k, 'Вуз ' || c_custkey AS name, c_custkey % 3 <> 0 AS has_p, c_custkey % 5 <> 0 AS has_v FROM customer),
t AS (SELECT *, CASE WHEN has_p AND k % 2 = 0 THEN 'декабрь ' || k WHEN k % 4 <> 3 THEN 'июнь ' || k || '; март' ELSE '' END AS raw, CASE WHEN k = 4 THEN 'http://new' WHEN k % 7 = 0 THEN '' ELSE 'http://d/' || k END AS dsrc FROM u)
SELECT k::INTEGER AS id, name, CASE WHEN dsrc <> '' THEN dsrc WHEN has_v THEN 'http://v' ELSE '' END AS src, CASE WHEN k % 2 = 1 THEN 'art' ELSE 'federal' END AS type,
CASE WHEN k = 2 THEN 'лето' WHEN raw LIKE 'июнь%' THEN 'июнь ' || k WHEN raw <> '' THEN raw ELSE 'Уточнять на официальном сайте' END AS summer, CASE WHEN raw LIKE 'декабрь%' THEN raw ELSE 'Уточнять на официальном сайте' END AS winter,
CASE WHEN raw LIKE 'июнь%' THEN 'примечание; март' ELSE 'примечание' END AS notes, CASE WHEN k = 1 THEN false WHEN has_p AND k % 2 = 1 THEN true WHEN k % 4 = 0 THEN false ELSE has_v END AS dorm,
CASE WHEN k % 4 = 0 THEN 'd' ELSE CASE WHEN has_v THEN 'v' ELSE '' END END AS dorm_info, CASE WHEN NOT has_v THEN 'error' WHEN k % 2 = 0 THEN 'error' ELSE 'ok' END AS status, (CASE WHEN has_v AND k % 2 = 1 THEN k ELSE 0 END)::INTEGER AS n_rows,
CASE WHEN dsrc <> '' OR has_v THEN 'Официальная таблица вакантных мест обновляется на странице вуза; отдельная дата летней публикации не указана' ELSE '' END AS published FROM t""")
def portal_build(spark, d):
    """Entities from four sources by name, by precedence, with overrides by id or name and defaults."""
    u = table(spark, d, "customer").select(c("c_custkey").alias("k"), F.concat(F.lit("Вуз "), c("c_custkey").cast("string")).alias("name"))
    k, key = c("k"), c("k").cast("string")
    link = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("http://d/"), key))
    dates = u.select(k.alias("id"), F.concat(F.lit("  "), "name").alias("name"), F.when(k % 4 != 3, F.concat(F.lit("июнь "), key, F.lit("; март"))).alias("dates_raw"), F.lit("примечание").alias("dates_note"), link.alias("source"), F.when(k % 4 == 0, "нет").alias("dorm_mark"), F.when(k % 4 == 0, "d").alias("dorm_comment"), k.alias("ord"))
    dates = enrich.sources_by_id(dates, u.filter("k = 4").select(k.alias("id"), F.lit("http://new").alias("source")), "id", "source")
    p = u.filter("k % 3 <> 0").select("name", F.when(k % 2 == 0, F.concat(F.lit("декабрь "), key)).alias("deadlines"), F.when(k % 2 == 1, "есть").alias("dorm_mark"), F.lit("").alias("dorm_comment"), F.lit("").alias("procedure"), F.lit("").alias("special"), F.lit("").alias("documents"), F.lit(2).alias("ord"))
    p = p.union(p.withColumn("deadlines", F.lit("январь")).withColumn("dorm_mark", F.lit("нет")).withColumn("ord", F.lit(1)))  # the last of equal names counts
    v = u.filter("k % 5 <> 0").select("name", F.lit("ok").alias("status"), F.lit("").alias("message"), F.lit("http://v").alias("source"), F.lit(True).alias("dorm_flag"), F.lit("v").alias("dorm_details"), F.when(k % 2 == 1, k).otherwise(0).alias("row_count"), F.lit(1).alias("ord"))
    types = u.filter("k % 2 = 1").select("name", F.lit("art").alias("type"))
    over = u.filter("k = 1").select(F.lit("1").alias("key"), F.lit("dorm").alias("field"), F.lit("нет").alias("value")).union(u.filter("k = 2").select("name", F.lit("summer"), F.lit("лето"))).union(u.filter("k = 2").select("name", F.lit("winter"), F.lit("  "))).union(u.filter("k = 3").select(F.lit("3"), F.lit("src"), F.lit("not allowed")))
    out = enrich.portal(dates, p, v, types, over, ["dorm", "summer", "winter"])
    return out.select("id", "name", "src", "type", "summer", "winter", "notes", "dorm", c("dormInfo").alias("dorm_info"), c("vacancyStatus").alias("status"), c("vacancyRowCount").alias("n_rows"), c("vacPubSummer").alias("published"))


def _landed(spark, d):
    """(starts, pages, links, tables): orders as entities whose first page fails, is empty, has a table or links to one."""
    t = gathered(lines(spark, d).withColumn("row", cells("1", c("code"), c("name"), (c("pos") % 6 + 1), "очная", c("q"), c("p"))).withColumn("columns", F.array(*map(F.lit, PLAIN))), "columns")
    k = c("uni_id")
    t = t.select(c("table_id").alias("uni_id"), "columns", "rows")
    url = lambda s: F.concat(F.lit("http://h/"), k.cast("string"), F.lit(s))
    none = [F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("array<array<string>>").alias("rows")]
    moved, html = F.lit(None).cast("string").alias("final_url"), lambda x: F.lit(x).alias("is_html")
    has = k % 4 == 0
    first = t.filter(k % 4 != 3).select(url("").alias("url"), moved, html(True), F.when(has, c("columns")).alias("columns"), F.when(has, c("rows")).alias("rows"))
    file = t.filter(k % 4 == 1).select(url("/b.xlsx").alias("url"), moved, html(False), *none)
    linked = t.filter(k % 4 == 1).select(url("/a").alias("url"), moved, html(True), "columns", "rows")
    links = t.filter(k % 4 == 1).select(url("").alias("url"), F.posexplode(F.array(url("/b.xlsx"), url("/b.xlsx"), url("/a"))).alias("place", "link"))
    return t.select("uni_id", url("").alias("link")), first.union(file).union(linked), links, t


@query(f"""SELECT l_orderkey AS uni_id, CASE l_orderkey % 4 WHEN 2 THEN 'partial' WHEN 3 THEN 'error' ELSE 'ok' END AS status, CASE l_orderkey % 4 WHEN 0 THEN 'http://h/' || l_orderkey WHEN 1 THEN 'http://h/' || l_orderkey || '/a' END AS source_url,
CASE l_orderkey % 4 WHEN 1 THEN ['http://h/' || l_orderkey, 'http://h/' || l_orderkey || '/b.xlsx', 'http://h/' || l_orderkey || '/a'] ELSE ['http://h/' || l_orderkey] END AS tried_urls, CASE WHEN l_orderkey % 4 < 2 THEN count(*)::INTEGER END AS n FROM ({LINES}) GROUP BY l_orderkey""")
def crawl_choice(spark, d):
    """The first table that is reached, and the addresses tried in order, each once."""
    starts, pages, links, _ = _landed(spark, d)
    return crawl.crawled(starts, pages, links).select("uni_id", "status", "source_url", "tried_urls", F.size("rows").alias("n"))


#: The pages as a web: page i links to the pages that its anchors' places and lengths name, in order.
WEB = r"""n AS (SELECT count(*) AS n FROM pages),
a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), 1) - 1 AS place FROM pages),
l AS (SELECT page_id, place, 'http://h/p/' || ((page_id * 7 + place * place * 13 + length(href)) % n) AS link FROM a, n),
best AS (SELECT page_id, link, min(place) AS place FROM l GROUP BY page_id, link QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(place)) <= 10),
f AS (SELECT page_id, 'http://h/p/' || page_id AS url, CASE WHEN page_id % 13 = 4 THEN 'http://h/r/' || page_id ELSE 'http://h/p/' || page_id END AS final, page_id % 97 = 4 AS found,
  coalesce((SELECT list(link ORDER BY place) FROM best b WHERE b.page_id = p.page_id), []) AS links FROM pages p WHERE page_id % 11 <> 5)"""


@query(f"""WITH RECURSIVE {WEB},
q AS (
  SELECT p.page_id AS uni_id, 0 AS step, CASE WHEN f.found THEN f.final END AS hit, f.url IS NOT NULL AS landed, begun AS tried, CASE WHEN f.url IS NULL OR f.found THEN [] ELSE f.links END AS queue
  FROM pages p LEFT JOIN f ON f.page_id = p.page_id, LATERAL (SELECT CASE WHEN f.final IS NULL OR f.final = 'http://h/p/' || p.page_id THEN ['http://h/p/' || p.page_id] ELSE ['http://h/p/' || p.page_id, f.final] END AS begun)
  UNION ALL
  SELECT uni_id, step + 1, CASE WHEN fresh AND f.found THEN f.final END, landed, now,
    CASE WHEN fresh AND f.url IS NOT NULL AND NOT f.found THEN queue[2:] || list_filter(f.links, lambda x: NOT list_contains(now, x))[1 : greatest(0, 50 - (len(queue) - 1))] ELSE queue[2:] END
  FROM q LEFT JOIN f ON f.url = q.queue[1],
    LATERAL (SELECT NOT list_contains(tried, queue[1]) AS fresh), LATERAL (SELECT CASE WHEN NOT fresh THEN tried WHEN f.final IS NULL OR f.final = queue[1] OR list_contains(tried, f.final) THEN tried || [queue[1]] ELSE tried || [queue[1], f.final] END AS now)
  WHERE hit IS NULL AND len(queue) > 0 AND len(tried) < 25),
last AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY uni_id ORDER BY step DESC) = 1)
SELECT uni_id, CASE WHEN hit IS NOT NULL THEN 'ok' WHEN landed THEN 'partial' ELSE 'error' END AS status, hit AS source_url, len(tried)::INTEGER AS n, array_to_string(tried, ' ') AS tried FROM last""")
def crawl_frontier(spark, d):
    """A crawl from every page along the links of the landed pages, with redirects, failures, and both bounds."""
    pages = table(spark, d, "pages")
    n = pages.agg(F.count("*").alias("n"))
    at = lambda x: F.concat(F.lit("http://h/p/"), x.cast("string"))
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    target = lambda href, i: (c("page_id") * 7 + i * i * 13 + F.length(href)) % c("n")
    web = pages.join(F.broadcast(n)).select("page_id", at(c("page_id")).alias("url"), F.array_join(F.transform(anchors, lambda h, i: F.concat(F.lit('<a href="/p/'), target(h, i).cast("string"), F.lit('">see</a>'))), " ").alias("html"))
    landed = web.filter("page_id % 11 <> 5")
    links = html_tables.download_links(landed, words=["/p/"]).join(landed.select("page_id", "url"), "page_id").select("url", c("rank").alias("place"), "link")
    some = c("page_id") % 97 == 4
    facts = landed.select(
        "url", F.when(c("page_id") % 13 == 4, F.concat(F.lit("http://h/r/"), c("page_id").cast("string"))).alias("final_url"), F.lit(True).alias("is_html"),
        F.when(some, F.array(F.lit("a"))).alias("columns"), F.when(some, F.array(F.array(F.lit("x")))).alias("rows"),
    )
    found = crawl.crawled(pages.select(c("page_id").alias("uni_id"), at(c("page_id")).alias("link")), facts, links)
    return found.select("uni_id", "status", "source_url", F.size("tried_urls").alias("n"), F.array_join("tried_urls", " ").alias("tried"))


#: A table that stands in where a source gives none.
FALLBACK = (["Код", "Направление", "Курс", "Бюджет", "Договор"], [["01.03.02", "Математика", "1", "2", "3"], ["01.03.03", "Механика", "2", "нет", "5"]])


@query(f"""WITH l AS ({LINES}), e AS (SELECT l_orderkey AS uni_id, count(*) AS n, l_orderkey % 4 AS v, l_orderkey % 4 >= 2 AND l_orderkey % 3 = 0 AND l_orderkey % 5 <> 0 AS fb FROM l GROUP BY l_orderkey),
r AS (SELECT l_orderkey AS uni_id, code, name AS direction, {LEVEL} AS level, (pos % 6 + 1)::VARCHAR AS course, 'очная' AS form, q::VARCHAR AS budget, p::VARCHAR AS paid FROM l WHERE v < 2
UNION ALL SELECT uni_id, code, direction, 'Высшее образование - бакалавриат', course, '', budget, paid FROM e, (VALUES ('01.03.02', 'Математика', '1', '2', '3'), ('01.03.03', 'Механика', '2', '0', '5')) AS f(code, direction, course, budget, paid) WHERE fb)
SELECT e.uni_id, CASE WHEN v < 2 OR fb THEN 'ok' WHEN v = 2 THEN 'partial' ELSE 'error' END AS status, fb AS is_manual_fallback, CASE WHEN fb THEN 'http://m' WHEN v = 1 THEN 'http://h/' || e.uni_id || '/a' WHEN v = 0 THEN 'http://h/' || e.uni_id ELSE 'http://x/' || e.uni_id END AS source_url,
(CASE WHEN fb THEN 2 WHEN v < 2 THEN n ELSE 0 END)::INTEGER AS row_count, CASE WHEN fb THEN 2 > 4 WHEN v < 2 THEN n > 4 ELSE false END AS truncated, '2024-01-01T00:00:00Z' AS fetched_at, (SELECT count(*) FROM r WHERE r.uni_id = e.uni_id)::BIGINT AS n_rows,
(SELECT coalesce(sum(budget::BIGINT + paid::BIGINT), 0) FROM r WHERE r.uni_id = e.uni_id)::BIGINT AS places FROM e""".replace("FROM l WHERE v < 2", "FROM l WHERE v < 2 AND pos < 4"))
def enriched_entities(spark, d):
    """Crawl, standardisation, fallbacks that the caller gives, and a status for every entity, end to end."""
    starts, pages, links, t = _landed(spark, d)
    k = c("uni_id")
    entities = t.select("uni_id", F.concat(F.lit("http://x/"), k.cast("string")).alias("link"), F.when(k % 5 == 0, False).alias("allow_manual_fallback"))
    columns, rows = F.array(*map(F.lit, FALLBACK[0])), F.array(*(F.array(*map(F.lit, r)) for r in FALLBACK[1]))
    fallbacks = t.filter(k % 3 == 0).select("uni_id", columns.alias("columns"), rows.alias("rows"), F.lit(" вручную ").alias("message"), F.lit("http://m").alias("source_url"))
    found, standard = crawl.enriched(entities, crawl.crawled(starts, pages, links), fallbacks, "2024-01-01T00:00:00Z", cap=4)
    sums = standard.groupBy("uni_id").agg(F.count("*").alias("n_rows"), F.sum(c("budget").cast("long") + c("paid").cast("long")).alias("places"))
    out = found.join(sums, "uni_id", "left").fillna(0, ["n_rows", "places"])
    return out.select("uni_id", "status", "is_manual_fallback", "source_url", "row_count", "truncated", "fetched_at", "n_rows", "places")


@query("""SELECT '2024-01-01T00:00:00Z' AS generated_at, count(*)::BIGINT AS total, count(*) FILTER (WHERE c_custkey % 3 = 0)::BIGINT AS ok, count(*) FILTER (WHERE c_custkey % 3 = 1)::BIGINT AS "partial", count(*) FILTER (WHERE c_custkey % 3 = 2 AND c_custkey % 2 = 0)::BIGINT AS errors FROM customer""")
def dataset_statistics(spark, d):
    rows = table(spark, d, "customer").select(F.when(c("c_custkey") % 3 == 0, "ok").when(c("c_custkey") % 3 == 1, "partial").when(c("c_custkey") % 2 == 0, "error").otherwise("new").alias("status"))
    return crawl.dataset_stats(rows, "2024-01-01T00:00:00Z")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'fb' ELSE 'own' END AS columns, c_custkey % 3 = 0 OR c_custkey % 4 = 0 AS is_manual_fallback FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0)
UNION ALL SELECT c_custkey, 'own', false FROM customer WHERE c_custkey % 2 = 1""")
def conditional_fallback(spark, d):
    """A fallback's columns where the source failed or has no rows, and the fallback has the key."""
    t = table(spark, d, "customer").withColumn("columns", F.lit("own"))
    fb = t.filter("c_custkey % 2 = 0").withColumn("columns", F.lit("fb"))
    return enrich.with_fallback(t, fb, "c_custkey", (c("c_custkey") % 3 == 0) | (c("c_custkey") % 4 == 0), ["columns"]).select("c_custkey", "columns", "is_manual_fallback")


@query("""SELECT p_partkey, code, dir, program, level, course, form, budget, paid FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name ELSE '' END AS code, CASE p_partkey % 4 WHEN 0 THEN p_type ELSE '' END AS dir, '' AS program, '' AS level,
CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR ELSE '' END AS course, '' AS form, (CASE p_partkey % 4 WHEN 0 THEN 2 * p_partkey + 1 WHEN 1 THEN p_partkey ELSE 0 END)::BIGINT AS budget, 0::BIGINT AS paid FROM part) WHERE code <> '' OR budget <> 0""")
def padded_rows(spark, d):
    """Rows of any width as eight typed fields; empty ones go."""
    k = c("p_partkey").cast("string")
    long = F.array(F.concat(F.lit(" "), "p_name"), c("p_type"), F.lit(None), F.lit(""), F.concat(F.lit("курс "), c("p_size").cast("string")), F.lit(""), F.concat(k, F.lit("/1 + "), k), F.lit("нет"), F.lit("more"))
    counted = F.array(*[F.lit("")] * 6, F.concat(k, F.lit(" "), k))
    rows = F.element_at(F.array(long, counted, F.array(F.lit(" "), F.lit("")), F.array().cast("array<string>")), (c("p_partkey") % 4 + 1).cast("int"))
    return enrich.portal_rows(table(spark, d, "part").select("p_partkey", rows.alias("cells")))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 3 = 0 AS fresh, s_suppkey % 2 = 0 AS complete FROM supplier)
SELECT s_suppkey AS id, CASE WHEN NOT fresh THEN 'ok' WHEN complete THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT fresh THEN 'old' WHEN complete THEN 'new' ELSE 'Таблица извлечена без пригодных строк.' END AS message, CASE WHEN fresh THEN 'http://new' ELSE 'http://old' END AS source,
(CASE WHEN NOT fresh THEN 1 WHEN complete THEN 2 ELSE 0 END)::INTEGER AS n, CASE WHEN s_suppkey = 2 THEN 'июль' ELSE '' END AS published, (SELECT count(*) FROM s)::BIGINT AS total, (SELECT count(*) FROM s WHERE NOT fresh OR complete)::BIGINT AS loaded,
(SELECT count(*) FROM s WHERE fresh AND NOT complete)::BIGINT AS errors, (SELECT sum(CASE WHEN NOT fresh THEN 1 WHEN complete THEN 2 ELSE 0 END) FROM s)::BIGINT AS total_rows FROM s""")
def portal_refresh(spark, d):
    """Rows, statuses and stats refreshed together; entities that were not read again stay as they are."""
    s, k = table(spark, d, "supplier"), c("s_suppkey")
    unis = s.select(k.alias("id"), c("s_name").alias("abbr"), F.lit("ok").alias("vacancyStatus"), F.lit("old").alias("vacancyMessage"), F.lit("http://old").alias("vacancySource"), F.lit(1).alias("vacancyRowCount"), F.lit("").alias("vacPubSummer"), F.lit("").alias("vacPubWinter"))
    rows = s.select(k.alias("id"), *(F.lit("x").alias(n) for n in ("code", "dir", "program", "level", "course", "form")), F.lit(1).cast("long").alias("budget"), F.lit(0).cast("long").alias("paid"))
    fresh = s.filter(k % 3 == 0).select(F.concat(F.lit(" "), "s_name").alias("name"), F.lit("ok").alias("status"), F.lit(" new").alias("message"), F.lit("http://new").alias("source"), F.lit(1).alias("ord"))
    some = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("")), F.array(*[F.lit("")] * 7, F.lit("4")))
    fresh_rows = s.filter((k % 3 == 0) & (k % 2 == 0)).select(c("s_name").alias("name"), F.explode(some).alias("cells"))
    over = s.filter("s_suppkey = 2").select(k.cast("string").alias("key"), F.explode(F.array(F.struct(F.lit("vacPubSummer").alias("field"), F.lit("июль").alias("value")), F.struct(F.lit("vacancyStatus").alias("field"), F.lit("no").alias("value")))).alias("f")).select("key", "f.field", "f.value")
    done, _, stats = enrich.refresh(unis, rows, fresh, fresh_rows, over)
    out = done.select("id", c("vacancyStatus").alias("status"), c("vacancyMessage").alias("message"), c("vacancySource").alias("source"), c("vacancyRowCount").alias("n"), c("vacPubSummer").alias("published"))
    return out.crossJoin(stats.select("total", "loaded", "errors", "total_rows"))  # one row


#: What parsing did to an entity's rows, and by the rules the mismatches.
CHANGES = [
    ("none", []),
    ("lost", ["MISS_ROWS", "WRONG_CODE_FORM_COURSE"]),
    ("doubled", ["DUP_ROWS", "NOISE_ROWS", "NUMERIC_MISMATCH", "WRONG_CODE_FORM_COURSE"]),
    ("other amount", ["NUMERIC_MISMATCH"]),
    ("shifted", ["HEADER_SHIFT", "WRONG_CODE_FORM_COURSE"]),
    ("lost page", ["MISS_PAGE", "MISS_ROWS", "WRONG_CODE_FORM_COURSE"]),
    ("source failed", []),
    ("policy", []),
]


def _checked(spark, d):
    """(parsed, expected, sources) of suppliers as entities."""
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("uni_id"), (c("s_suppkey") % 8).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    base = lambda df: df.select("uni_id", "v", "i", F.concat(F.lit("01.03.0"), c("i").cast("string")).alias("code"), F.lit(" Математика ").alias("dir"), F.lit("").alias("program"), F.lit("Бакалавриат").alias("level"), F.concat(c("i").cast("string"), F.lit(" курс")).alias("course"), F.lit("Очная").alias("form"), c("i").cast("string").alias("budget"), F.lit("нет").alias("paid"))
    expected = base(s)
    p = base(s).filter("not (v in (1, 5) and i = 4)")
    p = p.union(p.filter("v = 2 and i = 1"))
    shift = (c("v") == 4) & (c("i") == 2)
    p = p.withColumns({"budget": F.when((c("v") == 3) & (c("i") == 2), "9").otherwise(c("budget")), "code": F.when(shift, "").otherwise(c("code")), "dir": F.when(shift, "").otherwise(c("dir"))})
    empty = s.filter("i = 1").select("uni_id", "v", "i", *[F.lit("").alias(n) for n in FIELDS])
    parsed = p.union(empty)  # rows without any field don't count
    sources = s.filter("i = 1").select("uni_id", F.when(c("v") == 5, "pdf").otherwise("html").alias("source_type"), F.when(c("v") >= 6, "error").otherwise("ok").alias("status"), F.lit(4).alias("expected_rows"))
    return parsed, expected, sources


@query(f"""SELECT s_suppkey AS uni_id, CASE s_suppkey % 8 WHEN 0 THEN 'PASS' WHEN 7 THEN CASE WHEN s_suppkey = 7 THEN 'ERROR' ELSE 'FAIL' END ELSE 'FAIL' END AS verdict,
CASE WHEN s_suppkey = 7 THEN ['SOURCE_UNAVAILABLE'] WHEN s_suppkey % 8 >= 6 THEN ['SOURCE_PARSE_ERROR'] ELSE g.mismatches END AS mismatches FROM supplier JOIN {golden("g", "mismatches", [(m,) for _, m in CHANGES])} ON s_suppkey % 8 = g.i""")
def mismatches(spark, d):
    """Parsed against expected rows: what differs, and the verdict."""
    parsed, expected, sources = _checked(spark, d)
    return reconcile.verdict(reconcile.classify(parsed, expected, sources), sources, policy=(7,))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 8 AS v, CASE s_suppkey % 8 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 5 THEN 4 ELSE 5 END AS before FROM supplier)
SELECT s_suppkey AS uni_id, before::BIGINT AS before, (CASE WHEN v BETWEEN 1 AND 5 THEN 4 ELSE before END)::BIGINT AS after, (CASE WHEN v BETWEEN 1 AND 5 THEN 4 ELSE before END)::BIGINT AS rows,
CASE WHEN v <= 5 THEN 'PASS' WHEN s_suppkey = 7 THEN 'ERROR' ELSE 'FAIL' END AS verdict, CASE WHEN v <= 5 THEN '' WHEN s_suppkey = 7 THEN 'SOURCE_UNAVAILABLE' ELSE 'SOURCE_PARSE_ERROR' END AS mismatches, CASE WHEN v BETWEEN 1 AND 5 THEN 'refresh_from_source' ELSE '' END AS fix FROM s""")
def repaired(spark, d):
    """Failing entities taken anew from their sources, and checked again; the register and the rows that are left."""
    register, rows = reconcile.repair(*_checked(spark, d), "2024-01-01T00:00:00Z", policy=(7,))
    left = rows.groupBy("uni_id").agg(F.count("*").alias("rows"))
    out = register.join(left, "uni_id")
    return out.select("uni_id", c("parsed_rows_before").alias("before"), c("parsed_rows_after").alias("after"), "rows", "verdict", F.array_join("mismatches", ",").alias("mismatches"), c("fix_strategy").alias("fix"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_records(spark, d):
    """The last record of each key in a register."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return reconcile.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")
