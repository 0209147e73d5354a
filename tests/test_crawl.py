"""The crawl, level by level, against a queue that takes one address after another; enrichment end to end."""

import random

import pytest

from tessera.operators import crawl

PAGES = "url string, final_url string, is_html boolean, columns array<string>, rows array<array<string>>"


def one_by_one(start, pages, links, most, waiting):
    """(status, source_url, depth, tried) of one entity."""
    if not start:
        return "error", None, None, []
    tried, depth = [start], {start: 0}

    def add(url):
        if url not in tried:
            tried.append(url)

    page = pages.get(start)
    if page is None:
        return "error", None, None, tried
    add(page["final"])
    if page["table"]:
        return "ok", page["final"], 0, tried
    queue = list(links.get(start, [])) if page["html"] else []  # other files have no links
    depth |= {x: 1 for x in queue if x not in depth}
    while queue and len(tried) < most:
        url = queue.pop(0)
        if url in tried:
            continue
        add(url)
        got = pages.get(url)
        if got is None:
            continue
        add(got["final"])
        if got["table"]:
            return "ok", got["final"], depth[url], tried
        if got["html"]:
            for x in links.get(url, []):
                if x not in tried and len(queue) < waiting:
                    queue.append(x)
                    depth.setdefault(x, depth[url] + 1)
    return ("partial" if page["html"] else "error"), None, None, tried


def web(seed, n=60):
    rng = random.Random(seed)
    pages, links = {}, {}
    for i in range(n):
        if rng.random() < 0.85:
            moved = rng.random() < 0.2
            pages[f"p{i}"] = {"final": rng.choice([f"r{i}", f"r{i % 3}"]) if moved else f"p{i}", "html": rng.random() < 0.9, "table": rng.random() < 0.03}
            links[f"p{i}"] = [rng.choice([f"p{rng.randrange(n)}", f"p{rng.randrange(n)}", f"r{i % 3}", "gone"]) for _ in range(rng.choice([0, 1, 4, 12]))]
    return pages, links


@pytest.mark.parametrize(("seed", "most", "waiting"), [(2, 10, 6), (3, 25, 3), (5, 40, 14)])
def test_as_one_after_another(spark, seed, most, waiting):
    pages, links = web(seed)
    starts = [(i, f"p{i}") for i in range(60)] + [(100, ""), (101, None), (102, "nowhere")]
    landed = [(u, p["final"] if p["final"] != u else None, p["html"], ["c"] if p["table"] else None, [["x"]] if p["table"] else []) for u, p in pages.items()]
    found = crawl.crawled(
        spark.createDataFrame(starts, "uni_id int, link string"),
        spark.createDataFrame(landed, PAGES),
        spark.createDataFrame([(u, i, x) for u, own in links.items() for i, x in enumerate(own)], "url string, place int, link string"),
        most=most, waiting=waiting,
    )
    got = {r["uni_id"]: (r["status"], r["source_url"], r["depth"], r["tried_urls"]) for r in found.collect()}
    assert got == {k: one_by_one(s, pages, links, most, waiting) for k, s in starts}


def test_nothing_to_crawl(spark):
    none = spark.createDataFrame([], PAGES)
    links = spark.createDataFrame([], "url string, place int, link string")
    assert crawl.crawled(spark.createDataFrame([], "uni_id int, link string"), none, links).count() == 0
    [row] = crawl.crawled(spark.createDataFrame([(1, "u")], "uni_id int, link string"), none, links).collect()
    assert (row["status"], row["tried_urls"], row["rows"]) == ("error", ["u"], None)


def test_enriched_prefers_own_rows_then_fallbacks(spark):
    table = (["Код", "Направление", "Бюджет", "Договор"], [["01.03.02", "Математика", "1", "2"]])
    found = [(k, s, f"u{k}", [f"u{k}"], *(t or (None, None))) for k, s, t in [(1, "ok", table), (2, "ok", (["Код"], [["", ""]])), (3, "error", None), (4, "partial", None)]]
    schema = "uni_id long, status string, source_url string, tried_urls array<string>, columns array<string>, rows array<array<string>>"
    entities = spark.createDataFrame([(k, f"l{k}", None if k != 4 else False) for k in range(1, 6)], "uni_id long, link string, allow_manual_fallback boolean")
    fallbacks = spark.createDataFrame([(k, *table, " by hand ", None) for k in (1, 2, 3, 4)], "uni_id long, columns array<string>, rows array<array<string>>, message string, source_url string")
    out, rows = crawl.enriched(entities, spark.createDataFrame(found, schema), fallbacks, "now")
    got = {r["uni_id"]: (r["status"], r["is_manual_fallback"], r["message"], r["source_url"], r["tried_urls"]) for r in out.collect()}
    assert got == {
        1: ("ok", False, "", "u1", ["u1"]), 2: ("ok", True, "by hand", "l2", ["u2"]), 3: ("ok", True, "by hand", "l3", ["u3"]),
        4: ("partial", False, "", "u4", ["u4"]), 5: ("error", False, "", "l5", ["l5"]),
    }
    assert sorted((r["uni_id"], r["code"]) for r in rows.collect()) == [(k, "01.03.02") for k in (1, 2, 3)]
