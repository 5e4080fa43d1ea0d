"""Brute force, ties, odd rows and planted cases of the operators, one by one."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dewfall.llm import common, embdedup, minhash, mixing, packing, pii, topk, toxicity, urlrules, warc


# ---- shared helpers ----


def least_reachable(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot", [2_000, 5])
def test_components_of_chains_hubs_and_nulls(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(7, k) for k in range(300, 380)] + [(k, 7) for k in range(400, 420)]
    loose = [(rng.randrange(1_000, 1_060), rng.randrange(1_000, 1_060)) for _ in range(40)]
    edges = [*chain, *chain, *hub, *loose, (5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame([*edges, (1, None), (None, 2), (None, None)], "a long, b long")).collect()}
    nodes = {n for e in edges for n in e}
    assert got == least_reachable(edges, nodes)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = common.written(spark.createDataFrame([(1 if k < 50 else k % 7, k) for k in range(80)] + [(None, 99)], "key int, x int"), "rows")
    groups = common.written(rows.where("key is not null and key <> 3").groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("m")), "groups")
    told = lambda df: sorted(tuple(r[c] for c in ("key", "x", "n", "m")) for r in df.collect())
    assert told(common.split_join(rows, groups, "key")) == told(rows.join(groups, "key"))
    common.drop_written(rows, groups)


def test_samples_are_the_same_each_time(spark):
    df = spark.range(5_000).withColumn("v", F.when(F.col("id") % 9 > 0, F.col("id")))
    first = sorted(r.id for r in common.hash_sample(df, 300, "id").collect())
    again = sorted(r.id for r in common.hash_sample(df.repartition(5), 300, "id").collect())
    assert first == again and len(first) == 300
    assert common.hash_sample(df.where("id < 0"), 10, "v").count() == 0 and common.hash_sample(df.limit(4), 10, "v").count() == 4


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), k, rng.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(rows, "s string, k int, v int")
    got = {r.k: int(r.before) for r in common.running_total(df, "s", ["k"], F.col("v").cast("decimal(38,12)"), 7).collect()}
    assert got == {k: sum(v for t, j, v in rows if t == s and j < k) for s, k, _ in rows}


# ---- mixing ----


@pytest.mark.parametrize("values", [{}, {"a": 1, None: math.inf}])
def test_small_tables_start_no_python(spark, capsys, values):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "doc_id long, source string").localCheckpoint()
    out = mixing._per_source(docs, values, "v")
    out.explain()
    assert capsys.readouterr().out.count("ExistingRDD") == 1  # docs alone
    assert {r.doc_id: r.v for r in out.collect()} == {1: values.get("a"), 2: values.get(None), 3: None}


def test_mixing_ties_and_odd_rows(spark):
    rows = [(k, "w " * 5, "a") for k in range(40)] + [(100 + k, "w " * (k + 1), "b") for k in range(30)] + [(200, None, "c"), (201, "", None), (None, "x y", None), (202, "x y", None), (202, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = ([tuple(r) for r in mixing.mix(d).orderBy("source", "size", "doc_id", "copies").collect()] for d in (df, df.repartition(3)))
    assert first == again and len(first) == len(rows)
    taken, goal, size = {}, {}, {}
    for r in mixing.mix(df).collect():
        taken[r.source], goal[r.source], size[r.source] = taken.get(r.source, 0) + r.taken, r.target, r.source_size
        assert r.taken <= 2 * r.size
    longest = {"a": 5, "b": 30, "c": 0, None: 2}
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in taken)
    assert goal == pytest.approx(mixing.targets(size))


def test_rates_tilt_with_size(spark):
    """All of one source's rates are exp of a multiple of size, cut at the cap: the entropy balance."""
    df = spark.createDataFrame([(k, "w " * (1 + k % 13), "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    for s in "ab":
        rows = [r for r in mixing.mix(df).collect() if r.source == s and r.rate < 1.999999]
        slopes = {round(np.log(r.rate) / r.size, 9) for r in rows}
        assert len(slopes) <= 1


# ---- archives ----

PAGES = [
    (1, "http://a\nb/", None), (2, None, ""), (None, " x ", "<p>" + "y" * 400_000), (None, "u", "<p>" + "y" * 400_000),
    (3, "é", ""), (3, "é", ""), (4, "http://x/%0A", "<a>ü</a>"),
]


@pytest.mark.parametrize("size", [1, 16 << 20])
def test_archives_of_odd_pages(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, digest string")
    told = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    assert sum(r.bytes for r in told) > 0
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert all(r.payload_ok for r in got)
    assert sorted(((r.page_id, r.url, r.payload_bytes) for r in got), key=str) == sorted(((i, u, len((h or "").encode())) for i, u, h in PAGES), key=str)
    kinds = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in got}
    assert kinds[1, "http://a\nb/"] == ("response", None) and kinds[2, None] == kinds[3, "é"] == ("revisit", 1) and kinds[4, "http://x/%0A"] == ("response", None)
    data = warc.files(spark, f"file://{tmp_path}/w").first().content
    assert int.from_bytes(data[:4], "little") == warc.MAGIC and int.from_bytes(data[4:8], "little") > 0


def test_no_pages_no_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(pages, f"file://{tmp_path}/w").collect() == [] and warc.read_archives(spark, f"file://{tmp_path}/w").collect() == []


# ---- packing ----


def test_encoder_equals_tokenizer_on_odd_strings():
    path = packing.public_tokenizer()
    encode, rng = packing.Encoder(path), random.Random(5)
    alphabet = [chr(c) for c in [*range(0x180), *range(0x2000, 0x2070), 0x3A3, 0x3C3, 0x130, 0x1F0, 0x30C, 0x301, 0x4E2D, 0x1F600]] + [" "] * 60 + list("'<|sStmdreveLL") * 4 + ["<|startoftext|>", "<|endoftext|>", "'s", "'ll"] * 3
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4_000)]
    for _ in range(2):  # the second time from memory
        ids, bounds = encode(texts)
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def test_known_hashes_are_found_and_take_little_memory():
    rng = np.random.Generator(np.random.PCG64(8))
    known, told = packing.Known(), {}
    for n in (0, 1, 5_000, 3, 0, 20_000, 700, 700):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        known.add(hashes)
        told.update({h: len(told) + k for k, h in enumerate(hashes.tolist())})
    asked = np.concatenate([np.array(list(told), np.uint64), rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    assert len(known) == len(told) and known.find(asked).tolist() == [told.get(h, -1) for h in asked.tolist()]
    assert sum(x.nbytes for x in (*known.long, *known.short)) <= 12 * len(told)


def test_packing_does_not_depend_on_arrow_batches(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('some words ', cast(id % 37 as int)) as text").coalesce(1)
    whole = sorted(packing.pack(docs, 64).collect())
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "512")
    try:
        assert sorted(packing.pack(docs, 64).collect()) == whole
    finally:
        spark.conf.set(name, before)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, bounds = encode(["Hello  there", "", "don't"])
    assert not encode.apart and [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Hello  there", "", "don't")]


def test_best_fit_by_brute_force():
    rng = random.Random(9)
    lengths = np.array(sorted((rng.randint(1, 64) for _ in range(400)), reverse=True))
    seq, off = packing.best_fit(lengths, 64)
    rooms = []
    for n, s, o in zip(lengths.tolist(), seq.tolist(), off.tolist(), strict=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            assert 64 - o == min(fitting)  # the tightest window
            rooms.remove(64 - o)
        else:
            assert o == 0
        rooms.append(64 - o - n)
    assert len(set(seq.tolist())) == len(rooms)


def test_padding_and_waste(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h " * (k % 40)) for k in range(300)] + [(1_000, None)], "doc_id long, text string")
    rows = packing.pack(docs, window=64).collect()
    used, padded = {}, {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        padded[r.sequence_id] = r.padded
    assert all(padded[s] == (n if n & (n - 1) == 0 else 64) for s, n in used.items())
    assert sum(used.values()) >= 0.98 * sum(padded.values())


# ---- toxicity ----


def test_toxicity_separates_held_out_rows(spark):
    from dewfall.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_toxicity(spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    caught = [r.predicted for r in rows if labels[r.doc_id] == 1]
    wrong = [r.predicted for r in rows if labels[r.doc_id] == 0]
    assert sum(caught) >= 0.7 * len(caught) and sum(wrong) <= 0.02 * len(wrong)


# ---- url rules ----


def test_hosts_with_odd_characters(spark):
    urls = ["http://a\nb.net/x", "http://NET", "http://net/", "ftp://x.example.com/de/?q", None, "no scheme", "http://", "http://example.net/en", "http://\0.org/fr/a", "http://a.org/fr/a", "http://a\0b.net/casino"]
    got = {r.url: (r.rule, r.verdict) for r in urlrules.judge(spark.createDataFrame([(u, "r") for u in [*urls, urls[2]]], "url string, rule string")).collect()}
    assert got["http://a\nb.net/x"] == ("net/", "block") and got["http://net/"] == ("net/", "block") and got["http://NET"] == (None, "allow")
    assert got["ftp://x.example.com/de/?q"] == ("example.com/de/", "block") and got["http://example.net/en"] == ("net/", "block")
    assert got["http://\0.org/fr/a"] == ("org/fr/", "allow") and got["http://a\0b.net/casino"] == ("net/", "block")
    assert got["http://a.org/fr/a"] == ("org/fr/", "allow") and got[None] == (None, "allow") and got["http://"] == (None, "allow")
    assert urlrules.judge(spark.createDataFrame([], "url string")).collect() == []


def test_thousands_of_rules_by_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(2))
    rules = tuple(urlrules.prefix_rule(rng.choice(("block", "allow")), f"{word()}.{word()}/{'/'.join(word() for _ in range(rng.randrange(3)))}") for _ in range(3_000))
    urls = [f"http://{word()}.{word()}.{word()}/{word()}/{word()}" for _ in range(300)]
    got = {r.url: (r.rule, r.verdict) for r in urlrules.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    for u in urls:
        host, _, path = u[7:].partition("/")
        best = None
        for k, r in enumerate(rules):
            own, _, start = r.name.partition("/")
            if ("." + host).endswith("." + own) and ("/" + path).startswith("/" + start) and (best is None or (len(r.name), -k) > best[:2]):
                best = (len(r.name), -k, r)
        assert got[u] == ((best[2].name, best[2].action) if best else (None, "allow"))


# ---- personal data ----


def test_marginals_by_enumeration():
    """A tree, where message passing is exact once it has settled."""
    rng = np.random.default_rng(3)
    g = pii.Graph(starts=[0] * 5, ends=[0] * 5, label=[0, 2, 0, 0, 0], features=rng.integers(0, pii.BUCKETS, (5, pii.FEATURES)).tolist(), edges=[(0, 1, 1), (1, 2, 0), (0, 3, 0), (3, 4, 1)])
    edge = rng.normal(0, 1, (2, 5, 5))
    w = pii.Weights(rng.normal(0, 0.5, (pii.BUCKETS, 5)), (edge + edge.transpose(0, 2, 1)) / 2)
    want = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        if y[1] == 2:
            score = sum(w.node[g.features[v], y[v]].sum() for v in range(5) if v != 1) + sum(w.edge[t, y[a], y[b]] for a, b, t in g.edges)
            for v in range(5):
                want[v, y[v]] += np.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    passes, pii.PASSES = pii.PASSES, 80
    try:
        assert pii.marginals(g, w) == pytest.approx(want, abs=1e-6)
    finally:
        pii.PASSES = passes


def trained():
    rng, g = random.Random(12), pii.Graph()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for k in range(400):
        phone, mail = f"+1 {digits(3)} {digits(3)} {digits(4)}", f"user{digits(3)}@mail{k % 9}.org"
        text = rng.choice([f"call {phone} now or {phone} later, item {digits(5)}", f"write to {mail} today, again {mail} order {digits(6)}", f"room {digits(3)} costs {digits(2)}.50 in {digits(4)}"])
        g.add(text, pii.base_spans(text))
    return pii.learn(g)


def test_distant_repeats_gain_spans():
    w = trained()
    far = "word " * 3_000
    texts = [f"call +1 555 201 7788 today. {far} the number 5552017788 again", f"ann.smith@corp.org wrote. {far} so ann.smith@corp did", f"{far} the number 5552017788 alone", "4845168114407329 is no card", None or ""]
    found = list(pii.found_in(texts, w))
    shown = [[(texts[k][s:e], pii.KINDS[kind]) for s, e, kind in more] for k, (_, more) in enumerate(found)]
    assert shown[0] == [("5552017788", "phone")] and shown[1] == [("ann.smith@corp", "email")]
    assert shown[2] == shown[3] == shown[4] == []
    assert pii.redact_text(texts[0], found[0][0] + found[0][1]).count("<phone>") == 2


def test_long_tokens_are_seen_whole():
    a, b = "x" * 70 + "1", "x" * 70 + "12"
    assert pii.Graph.describe(a, 0, len(a), a) != pii.Graph.describe(b, 0, len(b), b)
    many = " ".join(f"a{k}@b.org" for k in range(30))
    g = pii.Graph()
    g.add(many, pii.base_spans(many))
    assert list(g.label) == [1] * 30 and len(g.features) == 30 * pii.FEATURES


# ---- near copies ----


def jaccard_classes(texts):
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.setdefault(i, []).append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    ids = sorted(i for i in sets if i is not None)
    edges = [(a, b) for a, b in itertools.combinations(ids, 2) for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return least_reachable(edges, ids)


def test_planted_near_copies(spark, monkeypatch):
    """Groups of near copies, some without their original, and crowds that share much but not enough; small blocks, hot keys."""
    for module, name, value in ((common, "HOT_ROWS", 20), (minhash, "BLOCK", 12), (minhash, "BLOCKS", 1)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.choice((8, 40, 120, 400)))]
        for k in range(20):
            own = list(base)
            for _ in range(0 if k == 3 and group % 2 else rng.randint(1, max(1, len(base) // (28 if group % 3 else 20)))):
                own[rng.randrange(len(own))] = word()
            rows.append((i, " ".join(own)))
            i += 1
    shared = [word() for _ in range(60)]
    for _ in range(60):  # half the text in common
        rows.append((i, " ".join(shared + [word() for _ in range(25)])))
        i += 1
    rows += [(i + 1, "Same text"), (i + 2, "same TEXT"), (i + 3, None), (i + 4, "  "), (i + 5, "same text"), (i + 5, rows[0][1]), (i + 5, rows[45][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.classes(docs).collect()}
    want = jaccard_classes(rows)
    assert got == want
    assert len(set(want.values())) < len(want) - 100


@pytest.mark.parametrize("common", [0, 4])
def test_members_of_a_very_large_key_that_share_no_other(spark, monkeypatch, common):
    """Near copies whose one common key holds more than its share of blocks; known frequent shingles decide nothing."""
    for name, value in (("BLOCK", 4), ("BLOCKS", 1), ("COMMON", common)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared, rows = [word() for _ in range(30)], []
    for k in range(20):
        own = shared + [word() for _ in range(30)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:-1], word()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = minhash.signatures(docs).withColumn("keys", F.expr("array(7L, 100L + doc_id)"))
    search = minhash.Search(signed, docs, 75)
    search.remainder()
    assert {r.node: r.component for r in search.label.collect()} == jaccard_classes(rows)


def test_sets_that_reach_the_threshold_share_a_rare_shingle():
    rng = np.random.default_rng(29)
    for _ in range(2_000):
        n = int(rng.integers(1, 40))
        both = rng.choice(1_000, n, replace=False)
        x, y = (np.sort(np.r_[both, rng.choice(np.arange(start, start + 1_000), int(rng.integers(0, n // 5 + 1)), replace=False)]).astype(np.uint64) for start in (1_000, 2_000))
        if 100 * n >= 75 * (len(x) + len(y) - n):
            common = rng.permutation(both)[: rng.integers(0, n + 1)].astype(np.uint64)
            assert len(np.intersect1d(minhash.rare_first(x, common, 75), minhash.rare_first(y, common, 75)))


def test_estimate_by_exact_similarity():
    rng = np.random.default_rng(8)
    for n in (6, 40, 2_000):
        whole = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
        x, y = np.sort(whole[: n + n // 2]), np.sort(whole[n // 2 :])
        regs = minhash.registers(np.r_[x, y], np.array([0, len(x), len(x) + len(y)]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert minhash.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([len(x)]), np.array([len(y)]))[0] == pytest.approx(true, abs=0.17)


# ---- vectors ----


def test_vectors_in_large_buckets_and_odd_rows(spark, monkeypatch):
    for module, name, value in ((embdedup, "SMALL", 5), (embdedup, "BLOCK", 16), (common, "HOT_ROWS", 10)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(k, (base + rng.normal(0, 0.2, 8)).tolist(), k) for k in range(90)] + [(100 + k, rng.normal(size=8).tolist(), k) for k in range(60)]
    rows += [(200, [0.0] * 8, 1), (201, None, 1), (202, [float("nan")] * 8, 1), (203, base.tolist(), 1), (204, base.tolist(), 1), (None, base.tolist(), 1), (206, [1.0, 2.0], 1), (207, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), miss=1e-6).collect()}
    sound = {i: np.array(v) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and np.isfinite(v).all() and np.any(v)}
    edges = [(a, b) for a, b in itertools.combinations(sound, 2) if sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= 0.95]
    least = least_reachable(edges, [i for i, _, _ in rows if i is not None])
    for i, root in least.items():
        assert got[i] == (sum(i in e for e in edges), root, i == root)
    assert got[None] == (0, None, True) and len(edges) > 300
    assert embdedup.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_sketches_keep_near_members_and_drop_others():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    across = rng.normal(size=base.shape)
    across -= (across * base).sum(axis=1, keepdims=True) * base
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    x = np.concatenate([0.95 * base + math.sqrt(1 - 0.95**2) * across, base])  # cosine 0.95 between k and 400 + k
    signs = np.packbits(x @ embdedup.planes(64, embdedup.SKETCH_BITS) > 0, axis=1).view("i8")

    def sifted(key, i, j, side):
        columns = {"t": np.zeros(800, "i4"), "key": key, "i": i, "j": j, "side": side, "vec_id": np.arange(800), "s0": signs[:, 0], "s1": signs[:, 1]}
        order = np.lexsort((columns["j"], columns["i"], key))
        batch = pa.RecordBatch.from_pydict({n: np.ascontiguousarray(c[order]) for n, c in columns.items()})
        return set(embdedup.likely(batch, embdedup.sketch_bound(0.95)).column("vec_id").to_pylist())

    every, none = np.arange(800), np.zeros(800, "i8")
    assert sifted(every % 400, none, none, none) == set(range(800))  # pairs
    assert sifted(none, none, none, none) == set(range(800))  # one large bucket, compared as a matrix
    assert sifted(none, none, none + 1, every // 400) == set(range(800))  # the two sides of a block
    assert len(sifted(none, none, none + 1, every % 2)) < 40  # partners are on one side: of 160,000 strange pairs few look near
    assert len(sifted((every + every // 400) % 400, none, none, none)) < 4  # strangers share the buckets
    assert embdedup.sketch_bound(1.0) == 0 and 13 < embdedup.sketch_bound(0.95) < embdedup.sketch_bound(0.5) < 128


def test_top_k_ties_odd_rows_and_huge_values(spark):
    rows = [(k, [1.0, float(k % 3)], "s") for k in range(0, 40, 4)] + [(100, [1.0, 1.0], "s"), (100, [1.0, 1.0], "s"), (7, None, "s"), (9, [float("inf"), 1.0], "s"), (11, [None, 1.0], "s"), (None, [9.0, 9.0], "s"), (13, [1.0], "s"), (200, [], "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = topk.search(df, F.col("vec_id") % 100 == 0, k=4).orderBy("query_id", "rank").collect()
    vectors = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q in (0, 100, 200):
        own = next(v for i, v in vectors if i == q)
        want = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in vectors if i != q and len(v) == len(own)))[:4]
        assert [(-r.score, r.vec_id) for r in found if r.query_id == q] == want
    big = spark.createDataFrame([(100, [1e8, 3.0]), (1, [1e8, 1.0]), (2, [1e8, 2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.search(big, F.col("vec_id") == 100, factor=16.0).orderBy("rank").collect()] == [2, 1]
    assert topk.search(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).collect() == []


def test_shards_by_bytes_and_cores():
    assert topk.shard_count(0, 0, 8) == 1 and topk.shard_count(100_000, 6_400_000, 8) == 3
    assert topk.shard_count(1_000_000, 64_000_000, 8) == 8 and topk.shard_count(10**9, 64 * 10**9, 8) == 7_630


def test_bounds_leave_work_out():
    """Vectors with a few large components: most products are never formed, and the result is that of brute force."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 3, (20_000, 32)))
    x[np.arange(20_000), rng.integers(0, 32, 20_000)] += 400
    shard, q = topk.Shard(np.arange(20_000), x), x[17]
    ids, scores = shard.top(17, q, 10)
    all_scores = x @ q
    want = sorted((-s, i) for i, s in enumerate(all_scores) if i != 17)[:10]
    assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
    assert shard.done < 0.25 * shard.possible


# ---- the pipeline ----


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("stage", [corpus_pipeline.filter_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.redact_personal_data, corpus_pipeline.pack_sequences])
def test_stages_bound_what_a_worker_gets_at_once(spark, tmp_path, stage):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(k, "good words", "en", "a", 10) for k in range(8)], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(k, 1, k % 2) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage(spark, docs, str(tmp_path))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    wide = spark.range(9_000).selectExpr("id", "repeat('abcdefgh', 200) as text").coalesce(1)  # 14 MB, one batch if rows alone are counted
    got = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 14e6 and max(got) < 1.1 * 4 * 2**20


def test_pipeline_by_planted_documents(spark, tmp_path):
    """Toxic documents and near copies go, personal data is replaced, and every id that the mix takes is packed once."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 8)))
    words = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, text(60) + (" idiot" if k % 4 == 0 else ""), "en", "ab"[k % 2], 0) for k in range(400)]
    long = text(200)
    docs += [(1000, long, "en", "a", 0), (1001, long + " end", "en", "b", 0), (1002, text(80) + " ann@example.org", "en", "a", 0), (1003, text(30) + " idiot", "en", "a", 0), (1004, None, "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        kept = common.written(stage(spark, kept, str(tmp_path)), name)
        seen.append({r.doc_id: r for r in kept.collect()})
    toxic, near, private, mixed, packed = seen
    assert set(toxic) == {k for k in range(400) if k % 4} | {1000, 1001, 1002, 1004}
    assert set(toxic) - set(near) == {1001}
    assert private[1002].text.endswith(" <email>") and private[1002].n_chars == len(private[1002].text)
    assert set(packed) == set(mixed) <= set(private)
    assert toxicity.THRESHOLD == 0.7
