"""Queries over the driver's tables, one per capability, and the same rows as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, normalize, numbers, text
from ..operators import enrich, facets as bitmaps, reconcile, search, tables, text_index
from ..sources import documents, html_tables
from ..shared import cut, new_path
from ..sources import versions
from ..streaming import refresh as streams, tracking
from .registry import ORACLE_SQL, QUERIES, query, table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "c_name", "c_mktsegment", "n_name")


ORDERS_SQL = """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, c_name, c_mktsegment, n_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def asked() -> search.Search:
    """A search as a page would ask for it."""
    return search.Search(
        text_columns=[F.col("c_name"), F.col("n_name"), F.col("o_orderpriority"), F.col("c_mktsegment")],
        query="UR",
        filters=(("o_orderstatus", "O"), ("c_mktsegment", "all")),
        where=(F.col("o_totalprice") > 1000,),
        sort="c_name",
        ties=("o_orderkey",),
    )


FOUND_SQL = f"""SELECT * FROM ({ORDERS_SQL}) WHERE o_orderstatus = 'O' AND o_totalprice > 1000
AND (contains(lower(c_name), 'ur') OR contains(lower(n_name), 'ur') OR contains(lower(o_orderpriority), 'ur') OR contains(lower(c_mktsegment), 'ur'))"""


@query(f"SELECT * FROM ({FOUND_SQL}) ORDER BY lower(c_name), o_orderkey LIMIT 1200")
def search_global(spark, d):
    """Join, text match over labels, filters, collated order with ties, limit."""
    return asked().shown(_orders(spark, d))




@query(f"SELECT * FROM ({FOUND_SQL})".replace("'ur'", "'urge'"))
def search_indexed(spark, d):
    """The same match from the trigram index, after a refresh: a tenth of the rows was indexed with other texts, and some are gone."""
    rows, path = cut(_orders(spark, d), "orders"), new_path(spark, "text-index")  # joined once, read for every step
    key, columns = F.col("o_orderkey"), asked().text_columns
    stale = rows.withColumn("c_name", F.when(key % 10 == 3, "turned").otherwise(F.col("c_name")))
    gone = rows.filter(key % 10 == 7).select((-key).alias("o_orderkey"), F.lit("urn").alias("c_name"), *(F.lit("").alias(x) for x in ("n_name", "o_orderpriority", "c_mktsegment")))
    some = ["o_orderkey", "c_name", "n_name", "o_orderpriority", "c_mktsegment"]
    text_index.build(stale.select(*some).unionByName(gone), "o_orderkey", columns, path)
    text_index.refresh(rows.filter(key % 10 == 3).select(*some), "o_orderkey", columns, path, gone=gone.select("o_orderkey"))
    found = text_index.search(spark, path, "URGE")
    rest = rows.filter("o_orderstatus = 'O' and o_totalprice > 1000")
    return rest.join(found, rest.o_orderkey == found.key, "left_semi")


_UNDER = "(c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'O' AND year(o_orderdate) IN (1994, 1995, 1996))"
_FACETED = "FROM orders JOIN customer ON o_custkey = c_custkey"


@query(" UNION ALL ".join(f"SELECT '{name}' AS facet, ({column})::VARCHAR AS value, count(*)::BIGINT AS n, (count(*) FILTER (WHERE {_UNDER}))::BIGINT AS n_under {_FACETED} GROUP BY ALL" for name, column in (("segment", "c_mktsegment"), ("status", "o_orderstatus"), ("year", "year(o_orderdate)"), ("priority", "o_orderpriority"))))
def facets_under_filters(spark, d):
    """Counts of every facet value, of all rows and under three filters, from bitmaps alone."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).withColumn("year", F.year("o_orderdate"))
    index = bitmaps.bitmap_index(rows, "o_orderkey", {"segment": "c_mktsegment", "status": "o_orderstatus", "year": "year", "priority": "o_orderpriority"})
    path = new_path(spark, "facets")
    index.write.parquet(path)
    index = spark.read.parquet(path)
    under = bitmaps.counts_under(index, {"segment": ["BUILDING", "MACHINERY"], "status": ["O"], "year": ["1994", "1995", "1996"]})
    under = under.withColumnRenamed("n", "n_under")
    return bitmaps.counts_under(index).join(under, ["facet", "value"], "left").fillna(0, ["n_under"])


@query("SELECT p_type AS value, min(p_partkey) AS first_seen FROM part GROUP BY p_type")
def facet_first_seen(spark, d):
    return search.facet(table(spark, d, "part"), "p_type", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE (l_quantity > 45 OR l_discount > 0.09) AND l_tax > 0.01")
def seat_filters(spark, d):
    """Either of two amounts, and a third."""
    some = search.seats("any", F.when(F.col("l_quantity") > 45, 1), F.when(F.col("l_discount") > 0.09, 1))
    df = table(spark, d, "lineitem").filter(some & (F.col("l_tax") > 0.01))
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")



@query("""SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'Third' WHEN s_name = (SELECT s_name FROM supplier WHERE s_suppkey = 5) THEN 'Fifth' ELSE s_name END AS s_name, s_acctbal FROM supplier""")
def override_by_id_or_name(spark, d):
    """Overrides by id, else by name; empty values and unknown fields are ignored."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name"), "s_acctbal", F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    fifth = s.filter("s_suppkey = 5").select(F.col("s_name").alias("key"), F.lit("s_name").alias("field"), F.lit("Fifth").alias("value"))
    fixed = spark.createDataFrame([("3", "s_name", "Third"), ("4", "s_name", " "), ("3", "other", "x")], "key string, field string, value string")
    return enrich.override(s, fixed.union(fifth), ["s_name"]).select("s_suppkey", "s_name", "s_acctbal")


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 1
UNION ALL SELECT s_suppkey, upper(s_name), s_nationkey, s_acctbal + 1 FROM supplier WHERE s_suppkey % 10 = 1
UNION ALL SELECT 1000000 + s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 10 = 2""")
def override_upsert(spark, d):
    """Rows replaced by key, and rows of new keys."""
    s = table(spark, d, "supplier")
    new = s.filter("s_suppkey % 10 = 1").withColumns({"s_name": F.upper("s_name"), "s_acctbal": F.col("s_acctbal") + 1})
    more = s.filter("s_suppkey % 10 = 2").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    return enrich.upsert(s, new.union(more), "s_suppkey")


@query("""SELECT count(*)::BIGINT AS n, sum(CASE WHEN s_suppkey % 4 = 0 AND s_acctbal IS DISTINCT FROM round(s_acctbal) THEN 1 ELSE 0 END)::BIGINT AS changed FROM supplier""")
def patch_counts(spark, d):
    """How many values a patch changes."""
    s = table(spark, d, "supplier")
    patch = s.filter("s_suppkey % 4 = 0").select("s_suppkey", F.round("s_acctbal").alias("s_acctbal"))
    return enrich.update(s, patch, "s_suppkey", ["s_acctbal"]).agg(F.count("*").alias("n"), F.sum("changed").cast("long").alias("changed"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def dedupe_last_wins(spark, d):
    return enrich.last_wins(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 0)::BIGINT AS loaded,
count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS "partial", count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'P'))::BIGINT AS errors FROM orders""")
def status_stats(spark, d):
    named = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "partial").otherwise("error")
    o = table(spark, d, "orders").select(named.alias("status"), F.when(F.col("o_totalprice") > 0, 1).otherwise(0).alias("rows"))
    return enrich.status_counts(o, rows="rows").drop("total_rows")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti(spark, d):
    return enrich.misses(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("""WITH a AS (SELECT l_partkey, l_quantity FROM lineitem), b AS (SELECT l_partkey, CASE WHEN l_orderkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 97 <> 0),
x AS (SELECT l_partkey, l_quantity, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT l_partkey, l_quantity, count(*) AS n FROM b GROUP BY ALL)
SELECT coalesce(x.l_partkey, y.l_partkey) AS l_partkey, coalesce(x.l_quantity, y.l_quantity) AS l_quantity, coalesce(x.n, 0)::BIGINT AS n_left, coalesce(y.n, 0)::BIGINT AS n_right
FROM x FULL JOIN y ON x.l_partkey = y.l_partkey AND x.l_quantity = y.l_quantity WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def multiset_diff(spark, d):
    """Rows whose multiplicities differ between a table and a changed copy."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    b = a.filter("l_orderkey % 97 <> 0").withColumn("l_quantity", F.when(F.col("l_orderkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return reconcile.multiset_diff(a, b, ["l_partkey", "l_quantity"])




@query("""SELECT l_suppkey, l_orderkey, l_linenumber, rn, row_count, truncated FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)::INTEGER AS rn,
count(*) OVER (PARTITION BY l_suppkey)::BIGINT AS row_count, count(*) OVER (PARTITION BY l_suppkey) > 12 AS truncated FROM lineitem) WHERE rn <= 12""")
def row_cap(spark, d):
    """The first rows of each group, with the count before the cap."""
    df = search.capped(table(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 12)
    return df.select("l_suppkey", "l_orderkey", "l_linenumber", "rn", "row_count", "truncated")


PRIORITIES = ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED"]


@query(f"""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority {" ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITIES))} ELSE 99 END, o_orderkey LIMIT 500""")
def topk_enum_order(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return df.orderBy(search.enum_rank(F.col("o_orderpriority"), PRIORITIES), "o_orderkey").limit(500)



@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def argmax_first(spark, d):
    df = enrich.argmax_first(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", ["l_orderkey", "l_linenumber"])
    return df.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")



@query("""WITH t AS (SELECT event_id, list_transform(regexp_extract_all(props, '[0-9]{1,9}'), lambda x: x::BIGINT) AS v FROM events)
SELECT event_id, (CASE WHEN len(list_distinct(v)) = 1 THEN v[1] ELSE coalesce(list_sum(v), 0) END)::BIGINT AS number FROM t""")
def parse_number(spark, d):
    """The sum of a text's numbers, one of them where all are equal."""
    short = F.regexp_replace("props", r"(\d{9})(?=\d)", "$1 ")
    return table(spark, d, "events").select("event_id", numbers.digits_sum(short).alias("number"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]+', ' ', 'g'))) AS cleaned FROM documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.clean("text").cast("binary"), 256).alias("cleaned"))


@query("""SELECT p_partkey, p_name AS name FROM part UNION ALL SELECT -p_partkey, p_name || ' x' FROM part""")
def collapse_duplicates(spark, d):
    """A name written twice becomes one; a name with something after it stays."""
    p = table(spark, d, "part")
    twice = p.select("p_partkey", text.collapse_duplicates(F.concat_ws(" ", "p_name", "p_name")).alias("name"))
    return twice.union(p.select(-F.col("p_partkey"), text.collapse_duplicates(F.concat("p_name", F.lit(" x")))))



@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(html, '(?i)https?://[^\s<>\]\)\};,]+') AS first_url FROM pages""")
def url_parts(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"), text.first_url("html").alias("first_url"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1) AS v FROM pages), u AS (SELECT page_id, unnest(v) AS href, unnest(range(len(v))) AS place FROM a),
g AS (SELECT page_id, href, count(*) AS n, min(place) AS place FROM u GROUP BY ALL)
SELECT page_id, href, n::BIGINT AS n, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, place)::INTEGER AS rank FROM g) WHERE rank <= 10""")
def html_links_top10(spark, d):
    """Each page's commonest links, first seen first."""
    rows = html_tables.links(table(spark, d, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("n"), "place"))
    return rows.withColumn("rank", rank).filter("rank <= 10").select("page_id", "href", "n", "rank")




@query("""WITH t AS (SELECT o_orderkey, month(o_orderdate) - 1 AS sm, day(o_orderdate) AS sd, (month(o_orderdate) + 1) % 12 AS em, 15 AS ed FROM orders),
v AS (SELECT o_orderkey, (CASE WHEN em < sm AND 0 <= em THEN 12 ELSE 0 END) * 31 + 20 AS now, (CASE WHEN em < sm AND sm <= em THEN sm + 12 ELSE sm END) * 31 + sd AS s, (CASE WHEN em < sm THEN em + 12 ELSE em END) * 31 + ed AS e FROM t)
SELECT o_orderkey, now >= s AND now <= e AS current FROM v""")
def interval_current(spark, d):
    """Whether the 20th of January lies in a range that may wrap around the year's end."""
    o = table(spark, d, "orders")
    sm, em = F.month("o_orderdate") - 1, (F.month("o_orderdate") + 1) % 12
    return o.select("o_orderkey", dates.is_current(sm, F.dayofmonth("o_orderdate"), em, F.lit(15), F.lit(0), F.lit(20)).alias("current"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM t)
SELECT w[i] AS token, count(*)::BIGINT AS n, min(i)::BIGINT AS first_place FROM u GROUP BY w[i]""")
def multivalue_explode(spark, d):
    """Every text's tokens with their places, counted."""
    rows = table(spark, d, "documents").select(F.posexplode(F.split("text", " ")).alias("i", "token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), (F.min("i") + 1).cast("long").alias("first_place"))


@query(r"""SELECT page_id, round(len(regexp_extract_all(html, '[0-9]')) / greatest(length(html), 1)::DOUBLE, 6) AS digit_ratio, len(regexp_extract_all(html, '<a '))::INTEGER AS anchors, len(regexp_extract_all(html, '<p>'))::INTEGER AS paragraphs FROM pages""")
def html_text_metrics(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, d, "pages").select("page_id", F.round(n("[0-9]") / F.greatest(F.length("html"), F.lit(1)), 6).alias("digit_ratio"), n("<a ").alias("anchors"), n("<p>").alias("paragraphs"))


@query("""SELECT level, form, course, count(*)::BIGINT AS n FROM (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'бакалавриат' WHEN 'AUTOMOBILE' THEN 'высшее' ELSE lower(c_mktsegment) END AS level,
CASE WHEN c_custkey % 2 = 0 THEN 'очная' ELSE 'очно-заочная' END AS form, (c_custkey % 6)::VARCHAR AS c, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE (c_custkey % 6)::VARCHAR END AS course FROM customer) GROUP BY ALL""")
def normalized_levels(spark, d):
    """Display normalisers over coded values."""
    raw = F.when(F.col("c_mktsegment") == "BUILDING", "Высшее: Бакалавриат").when(F.col("c_mktsegment") == "AUTOMOBILE", "Высшее образование - специалитет").otherwise(F.col("c_mktsegment"))
    form = F.when(F.col("c_custkey") % 2 == 0, "ОЧНАЯ форма").otherwise("очно - заочная")
    course = F.concat((F.col("c_custkey") % 6).cast("string"), F.when(F.col("c_custkey") % 6 == 0, "").otherwise(" курс"))
    df = table(spark, d, "customer").select(normalize.ui_level(raw).alias("level"), normalize.ui_form(form).alias("form"), normalize.ui_course(course).alias("course"))
    return df.groupBy("level", "form", "course").agg(F.count("*").alias("n"))


@query("""SELECT source, round(avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS digits, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS long FROM documents GROUP BY source""")
def value_ratio(spark, d):
    share = lambda c, n: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(n)
    return table(spark, d, "documents").groupBy("source").agg(share(F.col("text").rlike("[0-9]"), "digits"), share(F.col("n_chars") > 1000, "long"))


@query(f"SELECT count(*)::BIGINT AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM ({FOUND_SQL})")
def search_totals(spark, d):
    """Totals over all matching rows, before any limit."""
    rows = asked().rows(_orders(spark, d)).withColumn("one", F.lit(1))
    return search.totals(rows, {"n": "one", "total": "o_totalprice"}).select("n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("SELECT 'brand' AS facet, p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*)::BIGINT FROM part GROUP BY p_type UNION ALL SELECT 'size', p_size::VARCHAR, count(*)::BIGINT FROM part GROUP BY p_size")
def facets(spark, d):
    """Facet values with their counts, all facets in one pass over the table."""
    return search.facet_counts(table(spark, d, "part"), {"brand": "p_brand", "type": "p_type", "size": "p_size"})


@query("""SELECT c_custkey, coalesce(nullif(n_name, ''), 'unknown') AS country, coalesce(nullif(r_name, ''), 'unknown') AS region
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_enrich(spark, d):
    """Two left joins with defaults; a third of the nations is missing from the build side."""
    n = table(spark, d, "nation").filter("n_nationkey % 3 <> 0")
    named = enrich.look_up(table(spark, d, "customer"), n, "c_nationkey", "n_nationkey", {"country": ("n_name", "unknown")}, keep=["n_regionkey"])
    named = enrich.look_up(named, table(spark, d, "region"), "n_regionkey", "r_regionkey", {"region": ("r_name", "unknown")})
    return named.select("c_custkey", "country", "region")


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey, l_returnflag, sum(CASE WHEN l_linenumber = 7 THEN l_quantity + 1 ELSE l_quantity END)::BIGINT AS q FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, a.q AS expected, b.q AS parsed FROM a JOIN b USING (l_suppkey, l_returnflag) WHERE a.q <> b.q""")
def weighted_recon(spark, d):
    """Counts to weighted sums over fewer keys, then shared keys with different sums; one pass over either side."""
    li = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    changed = li.withColumn("q", F.when(F.col("l_linenumber") == 7, F.col("q") + 1).otherwise(F.col("q")))
    return reconcile.differing_sums(li, changed, ["l_suppkey", "l_returnflag"], "q", "expected", "parsed")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_forward(spark, d):
    """The last known value of a column with gaps."""
    known = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return enrich.last_known(table(spark, d, "events").withColumn("carried", known), ["user_id"], ["ts", "event_id"], "carried").select("event_id", "user_id", "carried")


@query("""WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, min(turn) AS turn, min(role) AS role, count(*)::BIGINT AS n, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY conv_id, run""")
def continuation_merge(spark, d):
    """Neighbouring rows of one role become one row."""
    return tables.merge_runs(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")


@query("""SELECT l_orderkey, l_linenumber, 1 AS course, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, l_tax FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 3, l_discount FROM lineitem""")
def unpivot_courses(spark, d):
    """Wide to long; rows of zero stay."""
    return tables.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax", "l_discount"], "course", "amount")


@query("""SELECT p_partkey, CASE WHEN n > 1 THEN p_name || ' (' || n || ')' ELSE p_name END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)""")
def header_dup_suffix(spark, d):
    return tables.unique_headers(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_name").select("p_partkey", "unique_name")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN [p_name, p_type] WHEN 1 THEN [p_name, p_type, p_brand] WHEN 2 THEN [p_name, p_brand] WHEN 3 THEN ['1. ' || p_name] [2:1] ELSE [p_name, '1. ' || p_type || ' 2.'] END AS items FROM part""")
def split_items(spark, d):
    """Numbered items, chunks between semicolons, bullets; one chunk is none."""
    n, t, b = "p_name", "p_type", "p_brand"
    raw = [F.concat_ws("", F.lit("1. "), n, F.lit(" 2) "), t), F.concat_ws("", n, F.lit(" ;  "), t, F.lit("; ; "), b, F.lit(";")), F.concat_ws("", F.lit("• "), n, F.lit(" • "), b), F.concat_ws("", F.lit("1. "), n), F.concat_ws("", n, F.lit("  ;1. "), t, F.lit(" 2. ;"))]
    c = F.element_at(F.array(*raw), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.split_items(c).alias("items"))


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events""")
def json_props(spark, d):
    found = documents.json_fields("props", "page string, k string")
    return table(spark, d, "events").select("event_id", found["page"].alias("page"), found["k"].alias("k"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, d):
    """The streaming counts on a batch."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed_counts(events)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS bal, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS seg, c_mktsegment FROM customer),
u AS (SELECT *, c_custkey % 2 = 0 AS hit FROM n)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE hit AND (bal <> c_acctbal OR seg <> c_mktsegment))::BIGINT AS changed_rows, sum(CASE WHEN hit THEN (bal <> c_acctbal)::INTEGER + (seg <> c_mktsegment)::INTEGER ELSE 0 END)::BIGINT AS changed_fields, count(*) FILTER (WHERE hit AND seg = 'X')::BIGINT AS moved FROM u""")
def counted_write(spark, d):
    """What a patch changed, counted while its result is written."""
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    changes = base.filter(k % 2 == 0).select(k, F.when(k % 3 == 0, F.col("c_acctbal")).otherwise(F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(k % 5 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    out, path = enrich.update(base, changes, "c_custkey", ["c_acctbal", "c_mktsegment"]), new_path(spark, "patched")
    counts = {"total": F.count("*"), "changed_rows": F.count_if(F.col("changed") > 0), "changed_fields": F.coalesce(F.sum("changed"), F.lit(0)).cast("long"), "moved": F.count_if(F.col("c_mktsegment") == "X")}
    found = enrich.written_with_counts(out, lambda df: df.write.parquet(path), counts)
    return spark.read.parquet(path).agg(F.count("*").alias("total")).select("total", *(F.lit(found[n]).cast("long").alias(n) for n in counts if n != "total"))


@query("""WITH p AS (SELECT p_partkey, translate(lower(CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN replace(p_type, 'E', 'É') ELSE p_type END), 'é', 'e') AS name, p_size FROM part)
SELECT name, count(*)::BIGINT AS n, (SELECT count(*) FROM part q WHERE lower(q.p_type) = name)::BIGINT AS matched FROM p GROUP BY name""")
def folded_names(spark, d):
    """Names that differ in case and accents, grouped and joined as one by a collation."""
    p = table(spark, d, "part")
    written = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.replace(F.col("p_type"), F.lit("E"), F.lit("É"))).otherwise(F.col("p_type"))
    groups = p.select(normalize.folded(written).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    types = p.groupBy(normalize.folded("p_type").alias("own")).agg(F.count("*").alias("matched"))
    plain = F.translate(F.lower(F.collate("name", "UTF8_BINARY")), "é", "e")
    return groups.join(types, groups["name"] == types["own"], "left").select(plain.alias("name"), "n", F.coalesce("matched", F.lit(0)).alias("matched"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n, max(epoch_ms(ts)) OVER () AS latest FROM events)
SELECT user_id, event_id, event_type, n::BIGINT AS n, CASE WHEN epoch_ms(ts) + 6 * 3600000 <= latest - 3600000 THEN 'stale' ELSE 'active' END AS status FROM r WHERE rn = 1""")
def tracked_register(spark, d):
    """Last record and status of every user, kept by a stream that reads the events from six files one after another.

    The files follow each other in time, whatever the ids, so no record is late. Small row groups let many tasks read a file.
    """
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    at = F.unix_micros("ts")
    ends = [int(x) for x in events.select(at.alias("at")).approxQuantile("at", [i / 6 for i in range(1, 6)], 0.01)]
    source, kept = new_path(spark, "replayed"), new_path(spark, "register")
    for i, (low, high) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
        part = events.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.repartition(1).write.mode("append").option("parquet.block.size", 4 << 20).parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    changes = tracking.tracked(stream, "user_id", "ts", "event_id", ["event_id", "event_type"], "6 hours", "1 hour")
    tracking.keep_register(changes, kept, new_path(spark, "register-checkpoint")).awaitTermination()
    found = versions.read(spark, kept).withColumn("p", F.from_json("payload", "event_id long, event_type string"))
    return found.select(F.col("key").alias("user_id"), "p.event_id", "p.event_type", "n", "status")


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(text, '[\n\t\r]', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM documents),
p AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(list_distinct(x || y)) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(x || y))::DOUBLE ELSE 0 END, 6) AS similarity FROM p""")
def header_jaccard(spark, d):
    """Word Jaccard of each document and the next one; hashes of words move, not the words."""
    words = F.filter(F.split(F.regexp_replace("text", "[\n\t\r]", " "), " "), lambda x: x != "")
    t = table(spark, d, "documents").select("doc_id", F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("w"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("y"))
    return t.join(n, "doc_id").select("doc_id", F.round(tables.jaccard(F.col("w"), F.col("y")), 6).alias("similarity"))


from . import fields, layouts, portals, readers  # noqa: E402,F401  they add their queries
