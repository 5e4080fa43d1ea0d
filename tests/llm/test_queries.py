"""Each query over the smallest tables against SQL or brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from dewfall.llm import mixing, packing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(compare, name):
    compare(SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_mixing_meets_targets(spark):
    got = queries.op1_source_mixing(spark, SF).collect()
    docs = {r["doc_id"]: r for r in rows("documents")}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r.size == len(WORD.findall(docs[r.doc_id]["text"] or ""))
        assert r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert target == pytest.approx(mixing.targets(sizes))
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)


def test_archives_give_pages_back(spark):
    got = {r.page_id: r for r in queries.op2_warc_archives(spark, SF).collect()}
    first = {}
    for r in sorted(rows("pages"), key=lambda r: r["page_id"]):
        payload = (r["html"] or "").encode()
        g = got.pop(r["page_id"])
        start = first.setdefault(payload, r["page_id"])
        assert g.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert g.payload_bytes == len(payload)
        assert (g.record_type, g.refers_to) == (("response", None) if start == r["page_id"] else ("revisit", start))
    assert not got


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    got = queries.op3_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d in rows("documents"):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc.pop(d["doc_id"]), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            piece = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_toxicity_separates_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert len(got) == len(rows("documents"))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_base_spans_by_brute_force(spark):
    got = {r.doc_id: r for r in queries.op6_personal_data(spark, SF).collect()}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    for d in rows("documents"):
        text, spans, counts = d["text"] or "", [], {}
        for k, (kind, (pattern, ok)) in enumerate(kinds.items()):
            found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m.group())]
            counts[f"n_{kind}"] = len(found)
            spans += found
        base = ",".join(s for _, _, s in sorted(spans))
        r = got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert {c: r[c] for c in counts} == counts
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_near_copies_by_brute_force(spark):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d in rows("documents"):
        words = WORD.findall((d["text"] or "").translate(upper))
        sets[d["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_minhash_dedup(spark, SF).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def linked_by_brute_force(vectors, least=0.95):
    """{vec_id: (links, component, kept)} from all cosines; vectors that can link with nothing stand alone."""
    sound = {i: np.array(v, "f8") for i, v in vectors.items() if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(sound))
    x = np.stack([sound[i] / np.linalg.norm(sound[i]) for i in ids])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], ids.max() + 1).min(axis=1))
        if (new == low).all():
            break
        low = new
    found = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), low, strict=True)}
    return {i: found.get(i, (0, i, True)) for i in vectors}


def test_vector_links_by_brute_force(spark, tmp_path):
    """The table's vectors with planted neighbours, as it has no pair above the threshold itself."""
    own = {r["vec_id"]: r["embedding"] for r in rows("embeddings")}
    rng, vectors = np.random.default_rng(7), dict(own)
    top = max(own) + 1
    for k, i in enumerate(sorted(own)[:60]):
        x = np.array(own[i], "f8")
        for step in range(6):  # a copy, then a chain that drifts away
            vectors[top + 10 * k + step] = x.astype("f4").tolist()
            x = x + rng.normal(0, 0.25 * np.linalg.norm(x) / len(x) ** 0.5, len(x))
    odd = (None, [], [0.0] * 8, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0])
    vectors |= {top + 10_000 + k: v for k, v in enumerate(odd)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = linked_by_brute_force(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op8_embedding_dedup(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    total = sum(w[0] for w in want.values())
    assert total > 500
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * total
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
