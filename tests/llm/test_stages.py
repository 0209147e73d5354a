"""The pipeline's stages: odd rows, and brute force on small tables."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_removed, brute_statistics
from test_near_duplicates import exact_links, groups_of, roots
from tokenizers import Tokenizer

from tessera.llm import langid, packing, quality
from tessera.llm.common import table

D = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with null and repeated rows, texts without words, and columns whose names the operators use inside."""
    rows = [(None, "no id " * 60, "en", None, 360), (900, None, None, None, None), (901, "", "en", "x", 0), (902, "1 2 3 " * 30, "en", "x", 180), (903, "привет мир " * 40, None, "x", 440)]
    docs = table(spark, D, "documents")
    docs = docs.union(docs.filter("doc_id in (3, 7)")).union(spark.createDataFrame(rows, SCHEMA))
    return docs.withColumns({n: F.lit(n) for n in ("row", "_words", "d", "th", "found", "kept", "bucket", "n_words", "h", "score")}).cache()


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_odd_rows_and_other_columns(spark, docs, name):
    out = STAGES[name](spark, docs, D)
    assert out.columns == docs.columns
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() and all(r["row"] == "row" and r["_words"] == "_words" and r["th"] == "th" for r in rows)
    assert STAGES[name](spark, docs.filter("false"), D).count() == 0


def test_packing_of_odd_rows(spark, docs):
    packed = STAGES["best_fit_packing"](spark, docs, D).collect()
    assert STAGES["best_fit_packing"](spark, docs.filter("false"), D).count() == 0
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = [len(e.ids) + 1 for e in lib.encode_batch([r["text"] or "" for r in docs.select("text").collect()], add_special_tokens=False)]
    assert sum(r["length"] for r in packed) == sum(sizes)
    by, counts = {}, [0] * 2049
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        counts[r["length"]] += 1
    for parts in by.values():
        assert sorted(parts) == [(sum(n for _, n in sorted(parts)[:i]), n) for i, (_, n) in enumerate(sorted(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(by) == packing.lower_bound(counts, 2048)


def test_quality_rules_by_brute_force(spark, docs):
    plain = docs.select(*(c.split()[0] for c in SCHEMA.split(", ")))
    rules = quality.fit(plain, table(spark, D, "labels"))
    kept = sorted(str((r["doc_id"], r["text"])) for r in STAGES["quality_rules"](spark, plain, D).collect())
    want = []
    for r in plain.collect():
        n, chars, symbols, lines, repeated = brute_statistics(r["text"] or "")
        t = r["text"] or ""
        counts = {"n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated, "n_marks": sum(c in "!?" for c in t), "n_digits": sum(c in "0123456789" for c in t)}
        upper = len([c for c in t if __import__("unicodedata").category(c) == "Lu"])
        per = lambda a, b: a / max(b, 1)
        data = {"symbols_per_word": per(symbols, n), "marks_per_word": per(counts["n_marks"], n), "upper_share": per(upper, chars), "digit_share": per(counts["n_digits"], chars), "chars_per_word": per(chars, n), "repeat_share": per(repeated, n), "dup_lines_per_word": per(lines, n)}
        holds = lambda x, data=data: data[x.feature] >= x.threshold if x.above else data[x.feature] < x.threshold
        if n >= 50 and 100 * repeated <= 50 * n and not any(all(map(holds, rule)) for rule in rules):
            want.append(str((r["doc_id"], r["text"])))
    assert kept == sorted(want)


def test_language_stage_drops_what_has_no_known_script(spark, docs):
    kept = {r["doc_id"] for r in STAGES["language_id"](spark, docs, D).select("doc_id").collect()}
    assert not kept & {900, 901, 902, 903} and None in kept
    model = langid.fit(langid.training_rows(langid.with_split(docs)))
    mixed = spark.createDataFrame([(1, "the house and the garden привет"), (2, "the привет мир привет мир")], "doc_id long, text string")
    unseen = {r["row"]["doc_id"]: r["unseen"] for r in langid.predict(mixed, model).collect()}
    assert unseen[1] == pytest.approx(6 / 26) and unseen[2] == pytest.approx(18 / 21)


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(word() if rng.random() < 0.01 * (i % 4) else w for w in (base if i % 3 else [*base[:60], *(word() for _ in range(60))]))) for i in range(60)]
    found = {r["doc_id"] for r in STAGES["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()}
    groups = groups_of(roots(exact_links(rows), [d for d, _ in rows]))
    assert 3 < len(groups) < 55 and found == {min(g) for g in groups}


def test_repeated_passages_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join([*(word() for _ in range(30)), *([passage] if i % 2 else []), *(word() for _ in range(10))]), "en", "s", 1) for i in range(20)] + [(30, passage, "en", "s", 1), (31, None, "en", "s", None)]
    out = {r["doc_id"]: r for r in STAGES["repeated_passages"](spark, spark.createDataFrame(rows, SCHEMA), D).collect()}
    want = brute_removed([(i, t) for i, t, *_ in rows], 100)
    left = {i: kept.decode() for i, (_, removed, _, kept) in want.items() if kept or not removed}
    assert set(out) == set(left) and all((out[i]["text"] or "") == t for i, t in left.items())
    assert out[31]["text"] is None and all(r["n_chars"] == len(r["text"]) for i, r in out.items() if i != 31)
