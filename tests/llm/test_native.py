import math
import zlib
from collections import Counter

import pytest
import xxhash

from tabulon.llm import mixing, preference, queries, sharding, urlfilter

SF = "/root/testdata/sf0.001"


def test_shards(spark, docs):
    rows = queries.op5_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert r["size"] == len(b) + 16 and r["text_crc32"] == zlib.crc32(b) and r["law"] == "key"
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def draw(key, level, children):
    """The child of the least -ln(u) / weight, u from the 64-bit hash of key, level and child's name, chained."""
    best = None
    for name, weight in children:
        h = 42
        for part in (key, level, name):
            h = xxhash.xxh64_intdigest(part.encode(), h)
        d = -math.log(((h >> 11) + 0.5) / 2**53) / weight
        best = min(best or (d, name), (d, name))
    return best[1]


def brute_shard(key, leaves):
    total = lambda xs: sum(x.weight for x in xs)
    region = draw(key, "region", [(r, total([x for x in leaves if x.region == r])) for r in {x.region for x in leaves}])
    mine = [x for x in leaves if x.region == region]
    rack = draw(key, "rack", [(f"{region}/{k}", total([x for x in mine if x.rack == k])) for k in {x.rack for x in mine}])
    return int(draw(key, "shard", [(str(x.shard), x.weight) for x in mine if f"{region}/{x.rack}" == rack]))


def test_shards_against_a_second_implementation(spark, docs):
    old = sharding.topology(40)
    for r in queries.op5_sharding(spark, SF).collect():
        assert r["shard"] == brute_shard(str(r["doc_id"]), old) and r["grown_shard"] == brute_shard(str(r["doc_id"]), sharding.grow(old))
    uneven = [sharding.Leaf(i, f"r{i % 3}", f"k{i % 5}", 0.5 + i) for i in range(11)]
    rows = sharding.with_shard(spark.createDataFrame([(k,) for k in ("a", "é", "", None, "zz")], "key string"), uneven, ["key"]).collect()
    assert all(r["shard"] == brute_shard("\0null" if r["key"] is None else r["key"], uneven) for r in rows)


def test_a_repeated_doc_id_is_cut_into_cells(spark):
    rows = sharding.assign_shards(spark.createDataFrame([(5, f"text {i}") for i in range(400)], "doc_id long, text string")).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(400))


def test_weights_and_confinement(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    old = sharding.topology(16)
    new = [sharding.Leaf(x.shard, x.region, x.rack, 2.0 if x.shard == 5 else 1.0) for x in old]
    rows = sharding.with_shard(sharding.with_shard(keys, old, ["doc_id"], "a"), new, ["doc_id"], "b").collect()
    region = {x.shard: x.region for x in old}
    counts = Counter(r["a"] for r in rows)
    assert all(abs(n - 1250) < 200 for n in counts.values())
    grown = Counter(r["b"] for r in rows)
    assert abs(grown[5] / 20000 - 2 / 17) < 0.02
    for r in rows:  # moves between regions go into the heavier one
        assert region[r["a"]] == region[r["b"]] or region[r["b"]] == region[5]
        assert r["a"] == r["b"] or region[r["b"]] == region[5]


def test_shards_odd(odd_docs, no_docs):
    rows = sharding.assign_shards(odd_docs).collect()
    assert len(rows) == 9 and len({(r["shard"], r["slot"]) for r in rows}) == 9
    assert sharding.assign_shards(no_docs).count() == 0


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("HTTP://WWW.Example.ORG/es/x?a", "www.example.org", "/es/x", "example.org/es/", "block"), ("x://a.org#f/g", "a.org", "", None, "allow"), ("x://b.ORG/", "b.org", "/", "org/", "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("h://a.com/de/1#x", "a.com", "/de/1", "com/de/", "block"), ("h://bad.net/p/", "bad.net", "/p/", None, "block"), ("h://www.bad.net/p.html?q", "www.bad.net", "/p.html", None, "block"),
    ("h://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("h://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("h://É.Ünet/a://b", "É.Ünet", "/a://b", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x"), (1, url, "x")], "page_id long, url string, html string")
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,)], "canonical string")
    for r in urlfilter.judge(pages, listed).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    assert urlfilter.judge(pages, listed).count() == 2 and urlfilter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_has_no_false_negative_and_a_bounded_size(spark):
    listed = spark.range(3000).selectExpr("concat('h/', id) canonical")
    words = urlfilter.bloom(listed, "canonical", 256, 3)
    assert words.count() <= 256
    pages = spark.range(6000).selectExpr("id page_id", "concat('x://h/', id) url")
    got = urlfilter.judge(pages, listed, [], 256, 3)
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(3000))


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_a_filter_dealt_out_says_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MOST_BROADCAST", most)
    listed = spark.range(9000).selectExpr("concat('h.net/', id) canonical")
    assert abs(urlfilter.blocks_for(listed) - 2250) < 300 and urlfilter.blocks_for(listed.limit(0)) == 1 << 10
    pages = spark.range(12000).selectExpr("id page_id", "if(id % 3 = 0, concat('x://h.net/', id, '/'), 'x://a.org/') url", "repeat('long ', 5000) path", "1 Verdict", "2 other")
    got = urlfilter.judge(pages, listed)
    assert sorted(got.columns) == ["host", "listed_hit", "other", "page_id", "path", "rule", "url", "verdict"]
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(0, 9000, 3))
    long = spark.createDataFrame([(1, "x://h.net/" + "a" * 200_000), (2, "x" * 300_000)], "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.judge(long, listed).collect()] == ["allow", "allow"]


@pytest.mark.parametrize("blocks", [1 << 10, 2500])
def test_share_of_other_urls_that_pass(spark, blocks):
    listed = spark.range(4 * blocks).selectExpr("concat('h/', id) canonical")
    words = {r["block"]: r["word"] for r in urlfilter.bloom(listed, "canonical", blocks).collect()}
    from pyspark.sql import functions as F

    key = F.concat(F.lit("o/"), "id")
    others = spark.range(20000).select(urlfilter._block(key, blocks).alias("b"), urlfilter._mask(key, urlfilter.BITS).alias("m")).collect()
    assert sum(words.get(r["b"], 0) & r["m"] == r["m"] for r in others) < 0.03 * 20000


def test_pairs_of_negative_ids(spark):
    rows = [(c, 0, "assistant", f"r{c}") for c in (-3, -2, -1, 0, 1)]
    pairs = preference.swapped_reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["pair_id"]: r["rejected"][0]["text"] for r in pairs} == {-3: "", -2: "r-1", -1: "r-2", 0: "r1", 1: "r0"} and len(pairs) == 5


def test_long_conversations(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], "word " * 4000) for i in range(60)] + [(0, 0, "assistant", "x")]
    (r,) = preference.format_preferences(preference.swapped_reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).where("pair_id = 1").collect()
    assert r["prompt_turns"] == 59 and len(r["prompt"]) > 59 * 20_000 and r["rejected"] == "<|assistant|>\nx<|end|>\n"


def test_mixing_replaces_clashing_columns(spark, odd_docs):
    got = mixing.mix(odd_docs.selectExpr("*", "'x' as part", "'y' as Shuffle_Key"), {"a": 1.0, "*": 1.0})
    assert got.columns == [*odd_docs.columns, "part", "copy", "shuffle_key"] and dict(got.dtypes)["part"] == "int"


def test_preferences(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    rows = [(1, t(("user", "q"), ("assistant", "a1")), t(("user", "q"), ("assistant", "a2"), ("user", "z"))), (2, t(("user", "q")), t(("user", "q"))), (3, None, t(("assistant", None))), (4, [], [])]
    pairs = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r["pair_id"]: r for r in preference.format_preferences(pairs).collect()}
    r = out[1]
    assert r["prompt"] == "<|user|>\nq<|end|>\n" and r["prompt_turns"] == 1 and r["chosen"] == "<|assistant|>\na1<|end|>\n"
    a, b = map(int, r["rejected_mask"].split(":"))
    assert r["rejected"][a:b] == "a2<|end|>" and r["rejected"].endswith("<|user|>\nz<|end|>\n")
    assert (out[2]["prompt_turns"], out[2]["chosen"], out[2]["rejected"], out[2]["chosen_mask"]) == (1, "", "", "")
    assert out[3]["prompt"] == "" and out[3]["rejected_mask"] == "14:21" and out[4]["prompt"] == ""
    odd = spark.createDataFrame([(None, 0, "user", "x"), (1, None, None, None), (1, None, None, None), (2, 0, "assistant", "r"), (3, 0, "user", "u")], "conv_id long, turn long, role string, text string")
    assert preference.format_preferences(preference.swapped_reply_pairs(odd)).count() == 4
    assert preference.format_preferences(preference.swapped_reply_pairs(odd.limit(0))).count() == 0
