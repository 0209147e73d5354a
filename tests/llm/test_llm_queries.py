"""The registered operator queries: against SQL where there is some, else against libraries and brute force, and for their rows."""

import base64
import hashlib
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from tessera.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    names = sorted(df.columns)
    res = c.sql(ORACLE_SQL[name])
    order = [res.columns.index(n) for n in names]
    assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == sorted(tuple(str(r[i]) for i in order) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    table = "pages" if name == "op5_warc" else "documents"
    n = spark.read.parquet(f"{D}/{table}.parquet").count()
    got = QUERIES[name](spark, D)
    assert got.count() >= n if name == "op8_packing" else got.count() == n


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def rows_of(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, D).collect()}


def test_op1_is_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, r in rows_of(spark, "op1_token_counts").items():
        n = len(library.encode(texts[d], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[d].encode()), n, n > 1024)


def test_op2_is_a_table_of_all_windows(spark, texts):
    seen, got = set(), rows_of(spark, "op2_suffix_dedup")
    for d in sorted(texts):
        raw = texts[d].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            h = raw[i : i + 100]
            if h in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(h)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == want


def test_op5_digests_and_revisits(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    last = {}
    for p in sorted(pages):
        last[pages[p]] = p
    for p, r in rows_of(spark, "op5_warc", "page_id").items():
        response = last[pages[p]]
        digest = base64.b32encode(hashlib.sha1(pages[p]).digest()).decode()
        want = (len(pages[p]), digest, "response" if response == p else "revisit", None if response == p else response)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want


def test_op7_is_all_pairs(spark, texts):
    def fingerprint(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    fp = {d: fingerprint(t) for d, t in texts.items()}
    top = {d: d for d in fp}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    for d, r in rows_of(spark, "op7_simhash").items():
        assert (r["fingerprint"], r["component_id"]) == (f"{fp[d]:016x}", root(d))


def test_op8_places_every_token_once(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = {}, {}
    for r in QUERIES["op8_packing"](spark, D).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in texts.items():
        own, n = sorted(pieces[d]), len(library.encode(t, add_special_tokens=False).ids) + 1
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(x for _, _, x in own) == n
        assert [s for _, s, _ in own] == [sum(x for _, _, x in own[:i]) for i in range(len(own))]
        assert len(own) == -(-n // 2048) and all(x == 2048 for _, _, x in own[1:])
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))] and sum(x for _, x in own) <= 2048


def test_op9_statistics(spark, texts):
    for d, r in rows_of(spark, "op9_quality").items():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[d])
        lines, seen, dup = texts[d].split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
        repeat = len({i + k for i, w in enumerate(windows) if w in often for k in range(3)})
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, repeat)
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", texts[d]))
        assert r["base_failed"] == (len(words) < 50 or 100 * repeat > 50 * len(words)) and not (r["kept"] and r["base_failed"])


def test_op10_is_an_encoding_loaded_by_its_own_library(spark, texts):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, r in rows_of(spark, "op10_byte_bpe").items():
        ids = library.encode(texts[d], disallowed_special=())
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[d].encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, corpus_pipeline.cut(stage(spark, out, D), name)
        assert out.columns == docs.columns and 0 < out.count() <= before.count()
        assert out.join(before, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, out, D)
    assert packed.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()
