"""A crawl over landed pages, level by level; fallbacks, standardisation, and a status per entity.

Pages are landed before; the crawl decides which of them an entity reaches, and in what order. Its queue is first in,
first out and holds at most WAITING addresses; at most MAX_TRIED addresses are tried; the first page with a table wins.
All entities take a level at once: a level's addresses meet the landed pages and their links by joins, and what the
queue does one address after another (repeats, both bounds, redirects) are running sums and minima per entity and level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean
from ..shared import cut
from .enrich import first_text, status_counts
from .standardize import cut_rows, standardize

#: Addresses tried before the crawl ends, and addresses that may wait.
MAX_TRIED, WAITING = 25, 50
#: How the crawl's tables meet. All grow with the pages and are written compressed, so what looks small enough to broadcast
#: would pass through the driver at many times its size, once a level.
MERGE = "merge"


def _tried(level: DataFrame, facts: DataFrame, seen: DataFrame | None, key: str, most: int) -> DataFrame:
    """key, at, url, pos, n, table, landed, is_html: what a level adds to the addresses tried, in order.

    An address at place pos is added at 2 * pos, where its page redirects to at 2 * pos + 1, each once in all levels.
    ``n`` counts what the entity has tried with it. No address is taken up once ``most`` are tried.
    """
    met = level.join(facts.hint(MERGE), "url", "left").withColumn("landed", F.coalesce("landed", F.lit(False)))
    rest = [key, "pos", "n_before", "landed", "is_html", "table"]
    own = met.select(*rest, "url", (F.col("pos") * 2).alias("at"))
    moved = met.filter("landed and final <> url").select(*rest, F.col("final").alias("url"), (F.col("pos") * 2 + 1).alias("at"))
    first = F.row_number().over(W.partitionBy(key, "url").orderBy("at"))
    new = own.unionByName(moved).withColumn("_first", first).filter("_first = 1")
    new = new.join(seen.select(key, "url").hint(MERGE), [key, "url"], "left_anti") if seen is not None else new
    new = new.withColumn("n", F.col("n_before") + F.row_number().over(W.partitionBy(key).orderBy("at")))
    begun = F.max(F.when(F.col("at") % 2 == 0, F.col("n"))).over(W.partitionBy(key, "pos"))  # a redirect goes with its address
    new = new.withColumn("begun", begun).filter(F.col("begun") <= most)
    hit = F.min(F.when(F.col("table") & (F.col("at") % 2 == 0), F.col("pos"))).over(W.partitionBy(key))
    new = new.withColumn("hit", hit)
    return new.filter("hit is null or pos <= hit").select(key, "at", "url", "pos", "n", "table", "landed", "is_html", "hit")


def _queued(tried: DataFrame, links: DataFrame, before: DataFrame | None, size: DataFrame, key: str, waiting: int) -> DataFrame:
    """key, pos, url, n_before: the next level, in the order in which the queue takes its addresses up.

    A page appends its links that are not yet tried while the queue has room. With e links to append at each place and
    room for b (``waiting`` less what is left of this level), what is appended up to a place is the running sum of e,
    cut by the least of b - (sum so far) up to there.
    """
    parents = tried.filter("hit is null and landed and is_html and at % 2 = 0")
    found = parents.select(key, "pos", F.col("url").alias("page")).join(links.select(F.col("url").alias("page"), "place", "link").hint(MERGE), "page")
    found = found.filter("link is not null and link <> ''")
    order = W.partitionBy(key).orderBy("pos", "place", "link")
    if before is not None:  # the start's links all wait, whatever they are
        known = tried.select(key, F.col("url").alias("link"), F.col("at").alias("known"))
        found = found.join(known.hint(MERGE), [key, "link"], "left").filter("known is null or known > 2 * pos + 1")
        found = found.join(before.select(key, F.col("url").alias("link")).hint(MERGE), [key, "link"], "left_anti")
        counts = found.groupBy(key, "pos").agg(F.count("*").alias("e")).join(size.hint(MERGE), key)
        so_far = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        counts = counts.withColumn("sum", F.sum("e").over(so_far))
        room = F.greatest(F.lit(0), F.lit(waiting) - F.col("size") + F.col("pos")) - F.col("sum")
        counts = counts.withColumn("appended", F.col("sum") + F.least(F.lit(0), F.min(room).over(so_far)))
        counts = counts.withColumn("most", F.col("appended") - F.lag("appended", 1, 0).over(W.partitionBy(key).orderBy("pos")))
        found = found.join(counts.select(key, "pos", "most").hint(MERGE), [key, "pos"])
        found = found.withColumn("nth", F.row_number().over(W.partitionBy(key, "pos").orderBy("place", "link"))).filter("nth <= most")
    counted = tried.groupBy(key).agg(F.max("n").alias("n_before"))
    return found.withColumn("next", F.row_number().over(order)).join(counted.hint(MERGE), key).select(key, F.col("next").alias("pos"), F.col("link").alias("url"), "n_before")


def crawled(starts: DataFrame, pages: DataFrame, links: DataFrame, key: str = "uni_id", most: int = MAX_TRIED, waiting: int = WAITING) -> DataFrame:
    """key, status, source_url, depth, tried_urls, columns, rows of every entity.

    starts: key, link (blank: nothing is tried). pages: url, final_url (null: no redirect), is_html, columns, rows (null or
    empty: no table), one row per address; an address without a page failed. Where a page redirects to must not redirect
    further. links: url, place, link of the pages, in the order in which they are appended.

    ok: a page with a table was reached, at ``depth`` links from the start. Else partial where the start is an HTML page,
    error where not or where it failed. ``tried_urls`` are in order, redirects after their addresses.
    """
    has = F.coalesce(F.size("rows"), F.lit(0)) > 0
    pages, links = cut(pages.select("url", "final_url", "is_html", "columns", "rows"), "pages"), cut(links.select("url", "place", "link"), "links")
    facts = pages.select("url", F.coalesce("final_url", "url").alias("final"), F.coalesce("is_html", F.lit(False)).alias("is_html"), has.alias("table"), F.lit(True).alias("landed"))
    begun = starts.filter("link is not null and link <> ''")
    level = begun.select(key, F.lit(1).alias("pos"), F.col("link").alias("url"), F.lit(0).alias("n_before"))
    levels: list[DataFrame] = []
    while True:
        seen = reduce(DataFrame.unionByName, levels) if levels else None
        tried = cut(_tried(level, facts, seen, key, most).withColumn("depth", F.lit(len(levels))), "tried")
        size = level.groupBy(key).agg(F.max("pos").alias("size"))
        level = cut(_queued(tried, links, seen, size, key, waiting), "queue")
        levels.append(tried)
        if level.isEmpty():
            break
    tried = reduce(DataFrame.unionByName, levels)
    seen = F.transform(F.array_sort(F.collect_list(F.struct("depth", "at", "url"))), lambda x: x["url"])  # most + 1 at most
    hit = F.max(F.when((F.col("hit") == F.col("pos")) & (F.col("at") % 2 == 0), F.struct("url", "depth")))
    start = F.max(F.when((F.col("depth") == 0) & (F.col("at") % 2 == 0), F.col("is_html")))
    per = tried.groupBy(key).agg(seen.alias("tried_urls"), hit.alias("hit"), start.alias("is_html"))
    out = starts.select(key).join(per.hint(MERGE), key, "left").withColumn("url", F.col("hit.url"))
    tables = pages.filter(has).select("url", F.coalesce("final_url", "url").alias("source_url"), "columns", "rows")
    out = out.join(tables.hint(MERGE), "url", "left")
    status = F.when(F.col("hit").isNotNull(), "ok").when(F.coalesce("is_html", F.lit(False)), "partial").otherwise("error")
    return out.select(key, status.alias("status"), "source_url", "hit.depth", F.coalesce("tried_urls", F.array().cast("array<string>")).alias("tried_urls"), "columns", "rows")


def enriched(entities: DataFrame, found: DataFrame, fallbacks: DataFrame, fetched_at: str, key: str = "uni_id", cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities with what the crawl found, their standardised rows).

    entities: key, link, allow_manual_fallback and more. found: as from ``crawled``. fallbacks (key, columns, rows, message,
    source_url) are data that the caller gives; one is used where the crawl is not ok or its table has no standardised
    row, unless the entity forbids it. ``fetched_at`` is the caller's time of the crawl, so that results can be repeated. Tables are
    taken whole, or ``cap`` rows of each where the caller asks for it.

    Found tables and fallbacks are standardised in one pass, and written: counts and rows are read from there.
    """
    other = fallbacks.select(F.col(key).alias("_key"), F.struct("columns", "rows", clean("message").alias("message"), "source_url").alias("_other"))
    base = entities.join(found.select(key, "status", "source_url", "tried_urls", "columns", "rows"), key, "left").join(other, F.col(key) == F.col("_key"), "left")
    base = cut(base.drop("_key").withColumns({"status": F.coalesce("status", F.lit("error")), "_allowed": F.col("_other").isNotNull() & F.coalesce("allow_manual_fallback", F.lit(True))}), "found")
    kind = base.schema[key].dataType
    own = base.filter("status = 'ok'").select(F.concat(F.lit("+"), F.col(key).cast("string")).alias("_table"), "columns", "rows")
    theirs = base.filter("_allowed").select(F.concat(F.lit("-"), F.col(key).cast("string")).alias("_table"), "_other.columns", "_other.rows")
    rows = standardize(cut_rows(own.unionByName(theirs), cap), "_table")
    rows = cut(rows.select(F.substring("_table", 2, 1 << 30).cast(kind).alias(key), F.col("_table").startswith("-").alias("_theirs"), *rows.columns[1:]), "standardized")
    some = rows.filter("not _theirs").groupBy(key).agg(F.count("*").alias("_own"))
    use = F.col("_allowed") & ((F.col("status") != "ok") | F.col("_own").isNull())
    base = base.join(some, key, "left").withColumn("is_manual_fallback", use)
    pick = lambda c: F.when(F.col("is_manual_fallback"), F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c)
    out = cut_rows(base.select(*entities.columns, "is_manual_fallback", "status", "tried_urls", "source_url", "_other", pick("columns"), pick("rows")), cap)
    out = out.select(
        *entities.columns,
        F.when(F.col("is_manual_fallback"), F.lit("ok")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("is_manual_fallback"), F.col("_other.message")).otherwise(F.lit("")).alias("message"),
        F.when(F.col("is_manual_fallback"), first_text(F.col("_other.source_url"), F.col("link"))).otherwise(first_text(F.col("source_url"), F.col("link"))).alias("source_url"),
        F.coalesce("tried_urls", F.array("link")).alias("tried_urls"),
        "is_manual_fallback",
        F.lit(fetched_at).alias("fetched_at"),
        "row_count",
        "truncated",
    )
    which = base.select(key, F.col("is_manual_fallback").alias("_theirs"))
    return out, rows.join(which, [key, "_theirs"]).drop("_theirs")


def dataset_stats(entities: DataFrame, fetched_at: str) -> DataFrame:
    """One row: generated_at, total, and entities by status."""
    return status_counts(entities).select(F.lit(fetched_at).alias("generated_at"), "total", F.col("loaded").alias("ok"), "partial", "errors")
