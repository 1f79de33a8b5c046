"""Each operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import base_rules, contamination, crc32, judge_url, near_duplicates, turns_digest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from dqspark.llm import bloom, bpe, chat, counting, decontam, jaccard, knn, lm, queries, rules, shard, textbuf, tokenfile, tokens, urlfilter
from dqspark.llm.components import connected

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ROWS = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return " ".join(rng.choice(["w", "é", "Zq"]) + str(rng.randrange(vocabulary)) for _ in range(n))


def corpus(seed=0, n=60):
    """Base texts, near and exact copies, nulls, blanks, repeats and one long text."""
    rng = random.Random(seed)
    docs = [words(rng, rng.choice([1, 2, 3, 5, 30, 80, 200])) for _ in range(n)]
    for k in range(n):
        own = docs[k].split(" ")
        for _ in range(rng.randrange(4)):
            copy = list(own)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    docs += [None, "", " \n\t ", docs[0], docs[0].upper(), words(rng, 30_000, 10**6), "a b", "A  B\n", "a b c"]
    rows = list(enumerate(docs)) + [(None, docs[5]), (3, docs[3]), (3, docs[7])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema).repartition(3)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


# 1


URLS = [
    None, "", "no scheme", "http://", "https://NET", "https://a.NET/", "https://a.net?x", "https://a.net/x#y", "https://example.net/en/1", "https://b.example.net/en", "https://b.Example.net/en/",
    "http://example.com/de/", "http://x.example.com/fr/de/", "https://q.org/fr/?u=://z.net/", "ftp://org/fr/x", "https://forg/fr/x", "https://xnet/", "https://a.b.c.d.e.net//", "x://y://net/", "https://net/\nb",
]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS * 3)), "page_id long, url string").withColumn("Rule", F.lit("clash")).withColumn("_x", F.lit(1))
    out = urlfilter.judge_urls(pages, queries.URL_RULES).collect()
    expected = [(k, *judge_url(u, queries.URL_RULES)) for k, u in enumerate(URLS * 3)]
    assert sorted_rows((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out) == sorted_rows(expected)
    empty = urlfilter.judge_urls(pages.where("false"), queries.URL_RULES)
    assert empty.collect() == [] and {"host", "path", "rule", "verdict"} <= set(empty.columns)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    found = urlfilter.cascade(listed, universe)
    assert len(found.levels) > 1
    assert universe.where(found.contains(F.col("key")) != (F.col("key") % 7 == 0)).count() == 0


def test_long_lists_are_judged_in_parts(spark, monkeypatch):
    # filters of 2000 bits take some 200 keys: the list of 600 needs several passes
    monkeypatch.setattr(urlfilter, "LITERAL_BITS", 2000)
    rules = [("block" if k % 3 else "allow", f"h{k}.example.{'net' if k % 2 else 'org'}/{'x/' * (k % 3)}") for k in range(600)]
    urls = [f"http://{'a.' * (k % 2)}H{k}.example.net/x/x/y?q" for k in range(0, 900, 7)] + [f"ftp://h{k}.example.org/x" for k in range(0, 900, 11)] + [None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "x/"), ("block", None)], "verdict string, rule string")
    out = urlfilter.judge_urls(pages, table).collect()
    expected = [(k, *judge_url(u, rules)) for k, u in enumerate(urls)]
    assert sorted_rows((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out) == sorted_rows(expected)


def test_a_host_of_very_many_labels(spark):
    pages = spark.createDataFrame([(0, "http://" + "a." * 100_000 + "net/x"), (1, "http://" + "." * 100_000 + "/")], "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, queries.URL_RULES).collect()}
    assert out == {0: ("net/", "block"), 1: (None, "allow")}


def test_bloom_never_misses(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    own = bloom.build(keys, 5000, 0.01)
    assert keys.where(~own.contains(F.col("key"))).count() == 0
    others = spark.range(5000, 25_000).select(F.col("id").cast("string").alias("key"))
    assert others.where(own.contains(F.col("key"))).count() < 600


# 2


def test_knn_votes_are_exact_and_learn(spark):
    rng = random.Random(1)
    good = [(k, words(rng, 60)) for k in range(120)]
    bad = [(1000 + k, "### $$ %% " * 20 + words(rng, 10)) for k in range(120)]
    docs = frame(spark, [*good, *bad, (5000, None), (5001, ""), (5002, words(rng, 30_000)), (None, "x")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (0, 1), (7777, 0), (1, None)], "doc_id long, quality int")
    model = knn.train(docs, labels)
    rows = knn.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 5000 and crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all(r["predicted"] == (r["doc_id"] < 1000) for r in held)
    # blocked products against one plain product
    texts = pa.array([t or "" for _, t in good[:9]])
    _, data, offsets = next(textbuf.slices(texts))
    x = knn.features(data, offsets)
    near = model.embed(x) @ model.vectors.T
    for k, row in enumerate(near):
        top = np.argsort(-row)[: knn.NEIGHBOURS]
        vote = np.maximum(row[top], 0).astype(float) ** knn.POWER + 1e-9
        assert abs(model.score(x[k : k + 1])[0] - (vote * model.labels[top]).sum() / vote.sum()) < 1e-3
    assert knn.score(docs.where("false"), model).collect() == []
    blank = knn.train(docs, labels.where("false"))
    assert {r["score"] for r in knn.score(docs, blank).collect()} == {0.5}


# 3


@pytest.mark.parametrize(("size", "num", "frequent"), [(3, 90, 8), (5, 80, 8), (3, 60, 2), (2, 90, 3)])
def test_near_duplicates(spark, monkeypatch, size, num, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(size)
    docs = frame(spark, rows).withColumn("sid", F.lit("clash")).withColumn("n", F.lit(None).cast("void"))
    out = jaccard.near_duplicates(docs, jaccard.Similarity(size, num, 100)).collect()
    assert sorted_rows(out) == sorted_rows(near_duplicates(rows, size, num, 100))


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(9)
    base = words(rng, 150, 10**6).split(" ")
    rows = []
    for k in range(300):
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    out = jaccard.near_duplicates(frame(spark, rows), jaccard.Similarity(3, 90, 100)).collect()
    assert sorted_rows(out) == sorted_rows(near_duplicates(rows, 3, 90, 100))


def test_near_duplicates_have_integer_ids(spark):
    with pytest.raises(TypeError):
        jaccard.near_duplicates(spark.createDataFrame([("a", "x y z")], "doc_id string, text string"), jaccard.Similarity())


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(frame(spark, [(1, "a")]).where("false"), jaccard.Similarity()).collect() == []
    assert sorted_rows(jaccard.near_duplicates(frame(spark, [(1, None), (2, "")]), jaccard.Similarity()).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    s = jaccard.Similarity(3, 80, 100)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        keep = x[: max(1, int(np.ceil(n * rng.uniform(0.85, 1))))]
        y = np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
        x, y = sorted((np.unique(x), np.unique(y)), key=len)
        common = len(np.intersect1d(x, y))
        if s.den * common < s.num * (len(x) + len(y) - common):
            continue
        df = {t: int(d) for t, d in zip(np.union1d(x, y).tolist(), rng.integers(1, 20, 500), strict=False)}

        def keys(own, missing, b):
            d = np.array([df[t] if df[t] >= 8 else 0 for t in own.tolist()])
            order = np.argsort(d, kind="stable")
            t = own[order]
            rare, pairs = jaccard.prefix_keys(t, textbuf.mix(t), d[order] > 0, missing, b, s)
            return {*rare.tolist(), *pairs.tolist()}

        b = jaccard.band(len(x))
        assert keys(x, len(x) - s.least(len(x), len(x)), b) & keys(y, len(y) - s.smallest(len(y)), b)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (1, 2), (1, 2)]
    out = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        up[b] = a
    assert out == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


# 4


def test_contamination(spark):
    rng = random.Random(2)
    items = [(k, words(rng, rng.choice([12, 20, 40]), 60)) for k in range(12)] + [(50, "one"), (51, "two, words!"), (52, None), (53, "--"), (7, "w1 w2 w3"), (54, "É é É w0")]
    docs = [(k, words(rng, 60, 60)) for k in range(30)]
    for k in range(20):
        item = rng.choice(items[:12])[1].split(" ")
        at = rng.randrange(len(item) - 9)
        docs.append((100 + k, words(rng, 15, 60) + " " + " ".join(item[at : at + rng.choice([9, 10, 14])]).upper() + ". " + words(rng, 15, 60)))
    docs += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (203, "ONE one two words one"), (None, items[1][1]), (204, words(rng, 40_000, 60)), (205, "é É é w0")]
    out = decontam.contamination(frame(spark, docs).withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted_rows(out) == sorted_rows(contamination(docs, items))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contamination(frame(spark, docs).where("false"), bench).collect() == []
    assert not any(r["contaminated"] for r in decontam.contamination(frame(spark, docs), bench.where("false")).collect())


def test_contamination_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_INLINE", 3)
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WORDS", 3)
    rng = random.Random(3)
    items = [(k, words(rng, 25, 60)) for k in range(6)]
    docs = [(k, words(rng, 10, 60) + " " + items[k % 6][1]) for k in range(12)]
    out = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted_rows(out) == sorted_rows(contamination(docs, items))


# 5


def test_quality_rules(spark):
    rng = random.Random(5)
    texts = [words(rng, rng.choice([1, 40, 60, 300])) for _ in range(30)]
    texts += [None, "", "\n\n", "a\na\n\na\r\nb", " x\n x\nx", "ab " * 100, "#*$%&|<> é\x0b\x0c\x1c ü", words(rng, 30_000), "same line here\n" * 3, "\n".join([texts[3]] * 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS).withColumn("kept", F.lit("clash")).withColumn("other", F.lit(2)).repartition(3)
    out = rules.judge(docs)
    assert "other" in out.columns
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in out.collect():
        base = base_rules(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == base, texts[r["doc_id"]]
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["kept"] and r["base_failed"])
    assert rules.judge(docs.where("false")).collect() == []


def test_compression_bands(spark):
    rng = random.Random(6)
    noise = base64.b64encode(bytes(rng.randrange(256) for _ in range(30_000))).decode()
    noise = " ".join(noise[k : k + 9] for k in range(0, len(noise), 9))
    clean = " ".join("".join(rng.choice("the an tion re in ou er st nd ha ly ble ing sh wh ea on at es of".split()) for _ in range(rng.choice([1, 2, 3]))) for _ in range(400))
    lines = "\n".join([" ".join(words(rng, 12).split(" "))] * 1 + [f"{k} the same long line of words stands here once more" for k in range(2000)])
    out = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame([(0, noise), (1, clean), (2, lines)], ROWS)).collect()}
    assert out == {0: False, 1: True, 2: False}


def test_compression_bands_reject_half_junk(spark):
    rng = random.Random(7)
    syllables = "the an tion re in ou er st nd ha ly ble ing sh wh ea on at es of".split()
    clean = " ".join("".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3]))) for _ in range(8000))
    junk = "".join(chr(rng.randrange(33, 127)) for _ in range(20_480))
    base = base64.b64encode(bytes(rng.randrange(256) for _ in range(15_360))).decode()
    docs = [clean[:20_480] + junk, clean[:4096] + junk[:4095], clean[:20_480] + base, clean[:40_960], clean[:8191], clean[:5000]]
    out = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(list(enumerate(docs)), ROWS)).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert [out[k]["kept"] for k in range(6)] == [False, False, False, True, True, True]


# 6


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = [
    "'s", "'re", "'ll", "'S", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "é", "ß", "字", "١", "5", "½", "²", "'", '"', "<|endoftext|>", "😀", "e\u0301", "\u200d", "\u0378", "\r\n", "ſ", "\x85", "\x1c", "_", "\x00", "힣", "'ve", "'d", "m", "t",
]


def random_texts(n=400):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)] + [None, "", words(rng, 30_000), "x" * 5000, " " * 999]


def test_bpe_round_trip(spark):
    texts, library = random_texts(), tiktoken_encoding()
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS).withColumn("ids", F.lit("clash")).repartition(3)
    rows = tokens.decode(tokens.encode(docs, JSON, offsets=True), JSON).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        raw, at = text.encode(), 0
        for i, a, b in zip(r["ids"], r["starts"], r["ends"], strict=True):
            piece = library.decode_single_token_bytes(i)
            assert piece in text[a:b].encode()
            at += len(piece)
        assert at == len(raw)
    assert tokens.decode(tokens.encode(docs.where("false"), JSON), JSON).collect() == []
    once = tokens.encode(docs, JSON, decoded=True).collect()
    assert {(r["doc_id"], bytes(r["decoded"]), tuple(r["ids"])) for r in once} == {(r["doc_id"], bytes(r["decoded"]), tuple(r["ids"])) for r in rows}


def test_bpe_cache_may_be_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    library, own = tiktoken_encoding(), bpe.Encoder(JSON)
    texts = random_texts(100)
    got = [ids[a:b].tolist() for _, ids, bounds in own.encode(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [library.encode_ordinary(t or "") for t in texts]


# 7


def test_lm_prefers_the_target(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice("abcdef") for _ in range(50))) for k in range(40)] + [(100 + k, " ".join(rng.choice("uvwxyz") for _ in range(50))) for k in range(40)]
    docs += [(200, None), (201, ""), (202, "new words only"), (0, docs[0][1]), (None, "a b")]
    out = lm.score(frame(spark, docs).withColumn("score", F.lit(1)), spark.createDataFrame([(k,) for k in range(20)] + [(None,), (3,)], "doc_id long")).collect()
    assert len(out) == len(docs)
    score = {r["doc_id"]: r["score"] for r in out}
    assert max(score[k] for k in range(20, 40)) < 0 < min(score[100 + k] for k in range(40))
    assert score[200] == score[201] == 0.0
    for r in out:
        assert abs(r["target_loss"] - r["background_loss"] - r["score"]) < 1e-5
    # the losses of a model are those of its formula
    tokens_ = [(t or "").split() for _, t in docs]
    count, pair = {}, {}
    for w in tokens_:
        for a, b in zip(["<s>", *w], w, strict=False):
            count[b] = count.get(b, 0) + 1
            pair[a, b] = pair.get((a, b), 0) + 1
    vocabulary = {w for w, n in count.items() if n >= 2}
    known = lambda w: w if w in vocabulary or w == "<s>" else "?"
    folded = {}
    for (a, b), n in pair.items():
        folded[known(a), known(b)] = folded.get((known(a), known(b)), 0) + n
    single = {w: 0 for w in (*vocabulary, "?")}
    for w, n in count.items():
        single[known(w)] += n
    total, starts = sum(single.values()), len(docs)
    w = tokens_[1]
    loss = 0.0
    for a, b in zip(["<s>", *w], w, strict=False):
        p = (single[known(b)] + 0.5) / (total + 0.5 * (len(single)))
        c = folded.get((known(a), known(b)), 0)
        before = starts if a == "<s>" else single[known(a)]
        loss -= np.log(((c if c >= 2 else 0) + lm.PRIOR * p) / (before + lm.PRIOR))
    assert abs(next(r["background_loss"] for r in out if r["doc_id"] == 1) - loss / len(w)) < 1e-4


def test_lm_keeps_all_words_and_pairs(spark, monkeypatch):
    # more words and pairs than any fixed table: 2**17 words, each twice, and 2**18 pairs, each twice
    monkeypatch.setattr(lm, "BLOCK_BYTES", 200_000, raising=False)
    size, per = 1 << 17, 1 << 10
    docs = []
    for k in range(0, size, per):
        own = " ".join(f"w{j}" for j in range(k, k + per))
        docs += [(k, own), (k + 1, own)]
    docs += [(-1, "w5 w6 never w6"), (-2, None)]
    out = {r["doc_id"]: r for r in lm.score(frame(spark, docs), spark.createDataFrame([(0,), (per,)], "doc_id long")).collect()}
    assert len(out) == len(docs) and out[-2]["score"] == 0.0
    total = (2 * per, 2 * size + 4)
    for at, starts, unknown in ((0, 2, 0), (1, len(docs), 1)):
        single = lambda n: (n + 0.5) / (total[at] + 0.5 * (size + 1))  # noqa: B023, E731
        loss = lambda pair, n, before: -np.log((pair + lm.PRIOR * single(n)) / (before + lm.PRIOR))  # noqa: B023, E731
        # a document of words 3 * per and on: outside of the target, twice in all
        seen = 0 if at == 0 else 2
        want = (loss(seen, seen, starts) + (per - 1) * loss(seen, seen, seen)) / per
        assert abs(out[3 * per][("target_loss", "background_loss")[at]] - want) < 1e-5
        w5, w6, pair = (1, 1, 1) if at == 0 else (3, 4, 3)
        want = (loss(0, w5, starts) + loss(pair, w6, w5) + loss(0, unknown, w6) + loss(0, w6, unknown)) / 4
        assert abs(out[-1][("target_loss", "background_loss")[at]] - want) < 1e-5


# 8


def test_token_file(spark, tmp_path, monkeypatch):
    texts = random_texts(60)
    rows = [*enumerate(texts), (5, "again"), (5, "again"), (None, "none")]
    docs = frame(spark, rows).withColumn("ids", F.lit("clash"))
    tokenfile.write_tokens(docs, f"{tmp_path}/t", JSON)
    back = tokenfile.read_tokens(spark, f"{tmp_path}/t").collect()
    library = Tokenizer.from_file(JSON)  # as it is: a special token that stands in a text has its own id
    assert any("<|endoftext|>" in (t or "") for t in texts)
    assert sorted_rows((r["doc_id"], r["ids"]) for r in back) == sorted_rows((i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    at = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(back, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    for r in tokenfile.with_checksum(tokenfile.read_tokens(spark, f"{tmp_path}/t")).where("doc_id < 9").collect():
        own = next(b for b in back if b["start"] == r["start"])
        assert r["ids_crc32"] == crc32(np.array(own["ids"], dtype="<u4").tobytes())
    few = tokenfile.find_tokens(spark, f"{tmp_path}/t", [3, 5])
    assert sorted_rows((r["doc_id"], r["ids"]) for r in few.collect()) == sorted_rows((r["doc_id"], r["ids"]) for r in back if r["doc_id"] in (3, 5))
    assert "PushedFilters: [In(doc_id, [3,5])" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tokenfile, "RANGE_BYTES", 1 << 12)  # more ranges than there are rows in some
    tokenfile.write_tokens(docs, f"{tmp_path}/m", JSON)
    assert sorted_rows(tuple(r)[:4] for r in tokenfile.read_tokens(spark, f"{tmp_path}/m").collect()) == sorted_rows(tuple(r)[:4] for r in back)
    tokenfile.write_tokens(docs.where("false"), f"{tmp_path}/e", JSON)
    assert tokenfile.read_tokens(spark, f"{tmp_path}/e").collect() == []


# 9


@pytest.mark.parametrize(("n", "most"), [(1, 4_000_000), (7, 20), (8, 4_000_000)])
def test_shards(spark, monkeypatch, n, most):
    monkeypatch.setattr(shard, "RANGE_ROWS", most)
    rng = random.Random(n)
    rows = [(k, words(rng, rng.choice([0, 1, 30]))) for k in range(300)] + [(300, None), (301, ""), (5, "again"), (5, "again"), (None, "x"), (302, words(rng, 3000))]
    out = shard.shard_by_bytes(frame(spark, rows).withColumn("size", F.lit("clash")), n).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted_rows((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted_rows((i, size(t), crc32((t or "").encode())) for i, t in rows)
    for s in range(n):
        own = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(n):
        assert abs(sum(r["size"] for r in out if r["shard"] == s) - total / n) <= largest
    assert shard.shard_by_bytes(frame(spark, rows).where("false"), n).collect() == []


# 10


def test_prefix_targets(spark):
    rng = random.Random(10)
    bits = ["<|", "|>", "\\", "<\\|", "<\\n", "\n", "<|im_end|>", "<|im_start|>assistant ok", "a", "é😀", "<", "|", "\\n", queries.PROBE]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|"]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for c in range(40) for t in range(rng.randrange(1, 7))]
    turns += [(90, 0, "user", None), (90, 1, None, "x"), (91, 0, "assistant", None), (92, None, "assistant", "first"), (92, 0, "user", "y"), (None, 0, "user", "z"), (93, 0, "user", "tie"), (93, 0, "assistant", "tie"), (94, 0, "assistant", "w " * 40_000)]
    rng.shuffle(turns)
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.examples(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    expected = {c: turns_digest([(r, t) for *_, r, t in sorted(own)]) for c, own in by.items()}
    assert {c: (v[0], v[1], v[2], v[3], v[4]) for c, v in got.items()} == expected
    for r in made.where("target is not null").collect():
        own = sorted(by[r["conv_id"]])[r["target"]]
        part = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
        assert part.replace("<\\|", "<|").replace("\\\\", "\\") == own[3]
    assert chat.examples(rows.where("false")).collect() == []


def test_prefix_targets_of_a_very_long_conversation(spark):
    turns = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(401)]
    made = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert made.where("target is not null").count() == 200
    got = chat.digests(made).collect()[0]
    assert tuple(got)[1:] [:5] == turns_digest([(r, t) for *_, r, t in turns])


# hashes are never taken for texts


def thue_morse(n):
    """A string of a and b on which polynomials modulo 2**64 collide with its complement, and that."""
    found = "a"
    while len(found) < n:
        found += found.translate(str.maketrans("ab", "ba"))
    return found, found.translate(str.maketrans("ab", "ba"))


def test_alike_texts_are_told_apart(spark):
    (a, b), (c, d) = thue_morse(1024), thue_morse(4096)
    for x, y in ((a, b), (c, d)):
        rows = [(1, f"x y {x}"), (2, f"x y {y}"), (3, f"x y {x}")]
        assert sorted_rows(jaccard.near_duplicates(frame(spark, rows), jaccard.Similarity(3, 90, 100)).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
        _, data, offsets = next(textbuf.slices(pa.array([f"{x}\n{y}\n{x}", f"p q {x} p q {y}"])))
        counts = rules.base_counts(data, offsets)
        assert counts["n_dup_lines"].tolist() == [1, 0] and counts["n_repeat_words"].tolist() == [0, 0]
        texts, library = [x, y, f"{x} {y}", x], tiktoken_encoding()
        got = [ids[p:q].tolist() for _, ids, bounds in bpe.Encoder(JSON).encode(pa.array(texts)) for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [library.encode_ordinary(t) for t in texts]


def test_shared_hashes_do_no_harm(spark, monkeypatch):
    plain = textbuf.Spans.hash
    monkeypatch.setattr(textbuf.Spans, "hash", lambda self, a, b, seed=0: plain(self, a, b, seed) & np.uint64(7))
    rng, library = random.Random(12), tiktoken_encoding()
    texts = [" ".join("w" * rng.randrange(1, 14) + str(rng.randrange(9)) for _ in range(rng.randrange(40))) + "abc abc\nabc abc\n def " * rng.randrange(3) for _ in range(150)] + [None, ""]
    got = [ids[p:q].tolist() for _, ids, bounds in bpe.Encoder(JSON).encode(pa.array(texts)) for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [library.encode_ordinary(t or "") for t in texts]
    for _, data, offsets in textbuf.slices(pa.array(texts)):
        counts = rules.base_counts(data, offsets)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert [tuple(int(counts[n][r]) for n in names) for r in range(len(texts))] == [base_rules(t) for t in texts]


def test_sets_of_one_name_are_told_apart(spark):
    rows = [(1, 5, 10), (2, 5, 11), (3, 5, 10), (4, 6, 12), (None, None, None)]
    sets = spark.createDataFrame(rows, "doc_id long, sid long, check long")
    torn = jaccard._torn(sets)
    names = {r["doc_id"]: r["sid"] for r in jaccard._told_apart(sets, torn).collect()}
    assert names[1] == names[3] == 5 and names[4] == 6 and names[None] is None and names[2] not in (5, 6)
    assert jaccard._torn(sets.where("doc_id <> 2")) is None


def test_counts_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(counting, "COARSE_BITS", 2)
    monkeypatch.setattr(counting, "FLUSH_KEYS", 100)
    rng = random.Random(13)
    values = [rng.randrange(2**63) for _ in range(300)]
    rows = [(rng.choice(values),) for _ in range(3000)]

    def keys_of(batch):
        yield np.asarray(batch.column(0)).view(np.uint64).copy(), []

    out = counting.count_keys(spark.createDataFrame(rows, "key long").repartition(5), keys_of, 0, lambda w: w[0] >= 2).collect()
    expected = {v: sum(r[0] == v for r in rows) for v in values}
    assert {r["key"]: r["w0"] for r in out} == {v: n for v, n in expected.items() if n >= 2}
    assert counting.count_keys(spark.createDataFrame(rows, "key long").where("false"), keys_of, 0, lambda w: w[0] >= 2).collect() == []
