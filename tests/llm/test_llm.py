"""The training-data operators against plain versions, on small tables with nulls, ties and repeats."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from evidex.llm import ann, bytebpe, langid, packing, pieces, quality_model, queries, rules, secrets, simhash, tokenfile, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRET = "token = 0123456789abcdef0123456789abcdef01234567"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(4000))
    return [None, "", " \n\t", "one", "a b c", "Ab cD ef", "ab cd ef", long, long, long + " tail", "x" * 5000, "don't  stop\n\nnow. été 你好 12,5", SECRET, "a  b. c,\n d"]


# --- 1 secrets


def test_secrets_edges(spark, odd):
    got = {r["doc_id"]: r for r in secrets.digest_rows(docs(spark, [*odd, "Password: abc token=token:abcdef AKIA" + "A1" * 8, SECRET])).collect()}
    assert len(got) == len(odd) + 2
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0]["base_sha256"] == got[1]["base_sha256"] == empty and got[0]["spans"] == ""
    assert got[12]["n_assign"] == got[12]["n_hex"] == 1 and "entropy" in got[12]["spans"]
    assert got[len(odd)]["n_access"] == 1 and got[len(odd)]["n_assign"] == 0
    assert all("entropy" not in got[i]["spans"] for i in (7, 10, 11))


def test_entropy_is_that_of_each_window():
    rng = random.Random(1)
    for _ in range(30):
        s = "".join(rng.choice("abcdef0123") for _ in range(40))
        want = set()
        for i in range(len(s) - 15):
            w = s[i : i + 16]
            if -sum(n / 16 * np.log2(n / 16) for n in Counter(w).values()) >= 2.9 - 1e-12:
                want |= set(range(i, i + 16))
        got = {i for a, b in secrets.windows_above(s, 16, 2.9) for i in range(a, b)}
        assert got == want


def test_allow_list_and_redaction(spark):
    uuid, key = "123e4567-e89b-12d3-a456-426614174000", "Zx9Kq2LmP4rT7vW1yB3nD5fG8hJ"
    got = [r[0] for r in secrets.redact_secrets(docs(spark, [f"id {uuid} ok", f"key {key} end", None, "plain"])).orderBy("doc_id").select("text").collect()]
    assert got[0] == f"id {uuid} ok" and key not in got[1] and "[REDACTED]" in got[1] and got[2] is None and got[3] == "plain"


def test_keys_after_names_and_paths_are_covered_whole():
    rng, scanner = random.Random(4), secrets.Scanner()
    for digits in ("0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for size in (32, 40, 64):
            for _ in range(60):
                key = "".join(rng.choice(digits) for _ in range(size))
                bare = scanner.entropy_spans(key)
                if not bare:
                    continue
                assert bare == [(0, size)]
                for before in ("AUTH=", "KEY_", "usr/path/", "a-b="):
                    (a, b), *more = scanner.entropy_spans(f"{before}{key}")
                    assert a <= len(before) and b == len(before) + size and not more, (before, key)
    assert not scanner.entropy_spans("123e4567-e89b-12d3-a456-426614174000 some/path-of/words_and/12")


def plain_base(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer("""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(spans)]


def test_base_secrets_of_whole_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = 0
    for r in secrets.op1(spark, "/root/testdata/sf0.01").collect():
        want = plain_base(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, *_ in want) for x in ("assign", "access", "hex")]
        named = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("entropy")] == named
        found += len(want)
    assert found > 20


# --- 2 near duplicates


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(codes, differences):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= differences:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def test_near_duplicates_match_all_pairs(spark, odd):
    texts = [*odd, *odd[3:9]]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    codes = [plain_fingerprint(t) for t in texts]
    roots = plain_components(codes, 4)
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == codes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots


@pytest.mark.parametrize("spread", [1, 2, 5])
def test_tree_finds_every_link_of_a_block(spread):
    rng = random.Random(spread)
    centres = [rng.getrandbits(64) for _ in range(40)]
    codes = {c for x in centres for c in [x] + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread + 1))) for _ in range(40)]}
    codes = np.array(sorted(codes), np.uint64)
    for bits in (0, 3, 13):
        mask = np.uint64(((1 << bits) - 1) << (64 - bits))
        a, b, _ = simhash.forest_of_links(codes, mask, 4)
        ints = [int(c) for c in codes]
        assert all((ints[i] ^ ints[j]).bit_count() <= 4 and (ints[i] ^ ints[j]) & int(mask) == 0 for i, j in zip(a, b, strict=True))
        find = lambda x: x if parent.get(x, x) == x else find(parent[x])
        parent = {}
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            assert i != j  # a forest
            parent[max(i, j)] = min(i, j)
        label = [find(i) for i in range(len(ints))]
        parent = {}
        for i in range(len(ints)):
            for j in range(i):
                if (ints[i] ^ ints[j]).bit_count() <= 4 and (ints[i] ^ ints[j]) & int(mask) == 0:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        want = [find(i) for i in range(len(ints))]
        assert len({(a, b) for a, b in zip(want, label, strict=True)}) == len(set(want)) == len(set(label))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 60: 50}


def test_one_of_each_group_stays(spark, odd):
    table = docs(spark, [odd[7], odd[8], "other words in here now", "other words in here now", odd[7], "alone without id", "alone without id", odd[7]], [5, 3, 9, 9, None, None, None, 3])
    kept = simhash.keep_one_each(table)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, odd[7]), (9, "other words in here now"), (None, "alone without id")], key=str)
    assert simhash.keep_one_each(table.limit(0)).count() == 0


def test_one_id_on_different_texts_keeps_every_group(spark, odd):
    texts = [odd[7], *(f"a text of its own about item{k} and thing{k * k} only" for k in range(8))]
    kept = simhash.keep_one_each(docs(spark, [*texts, odd[8]], [5] * len(texts) + [6]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((5, t) for t in texts)


def mates(rng, n, similarity):
    """Two texts of n shingles of five words, alike to the similarity or just above."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    same = int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-9))
    common = [word() for _ in range(same + 4)]
    return " ".join(common + [word() for _ in range(n - same)]), " ".join([word() for _ in range(n - same)] + common)


def test_groups_at_a_similarity(spark, odd):
    """Pairs on both sides of 0.8 by their exact sets: nine in ten are found from 0.8 on, none below."""
    rng, texts, of = random.Random(9), [*odd, *odd[3:9]], {}
    for likeness in (0.5, 0.65, 0.7, 0.75, 0.77, 0.8, 0.85, 0.9, 0.95):
        for _ in range(80):
            of[len(texts)] = likeness
            texts += mates(rng, rng.choice((60, 300, 900)), likeness)
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) if t else set() for t in texts]
    exact = lambda i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs(spark, texts)).collect()}
    joined = {s: np.mean([got[i] == got[i + 1] == i for i, x in of.items() if x == s]) for s in set(of.values())}
    assert min(joined[s] for s in (0.8, 0.85, 0.9, 0.95)) >= 0.9, joined
    assert all(exact(i) >= 0.8 for i in of if got[i + 1] == i), joined
    assert got[8] == got[7] and all(got[len(odd) + k] <= 3 + k for k in range(6))
    assert simhash.similar_groups(docs(spark, texts).limit(0)).count() == 0


def test_a_chain_of_similar_texts_is_one_group_and_a_false_link_is_none(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    chain = []
    for k in range(12):  # each a step from the one before, the ends far apart
        words[k * 20 : k * 20 + 12] = [f"v{rng.randrange(10**9)}" for _ in range(12)]
        chain.append(" ".join(words))
    got = [r["component_id"] for r in simhash.similar_groups(docs(spark, chain)).collect()]
    assert got == [0] * 12


def test_bits_of_sketches_differ_by_half_of_what_sets_lack():
    rng = random.Random(3)
    for likeness in (0.5, 0.8):
        apart = [np.bitwise_count(simhash.sketch(a, 5, 6) ^ simhash.sketch(b, 5, 6)).sum() for a, b in (mates(rng, 2500, likeness) for _ in range(30))]
        assert abs(np.mean(apart) / 384 - (1 - likeness) / 2) < 0.02


def test_one_of_each_similar_group_stays(spark):
    a, b = mates(random.Random(1), 300, 0.95)
    rows = [("x" * 10, 9), (a, 4), (b, 3), (a, None), (None, 7), ("", 8), ("alone", None)]
    table = docs(spark, [t for t, _ in rows], [i for _, i in rows]).withColumn("_FP_i", F.lit(1)).withColumn("_fp", F.lit(2))
    kept = simhash.keep_one_each(table, shingle=5, similarity=0.8)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(9, "x" * 10), (3, b), (7, None), (None, "alone")], key=str)


# --- 3 nearest vectors


def test_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[100] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 64, 0), (5002, [float("nan")] * 64, 0), (5003, [1.0, None] + [0.0] * 62, 0), (None, x[1].tolist(), 0), (5004, [1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.nearest(table, table.where("vec_id % 50 = 0"), group_rows=700).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 50))
    y = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        score = ann.cosines(y, y[q])
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:5].tolist()
        hits += len(set(best) & {i for i, _ in found})
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and all(abs(s - score[i]) < 1e-15 for i, s in found)
    assert hits / (5 * len(got)) >= 0.9 and got[0][0][0] == 100


@pytest.mark.parametrize("lead", [0, 3, 8])
def test_probing_finds_every_value_within_reach(lead):
    rng = np.random.default_rng(lead)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    values, whole = codes[:, 0], codes.view(np.uint64)
    low = 16 - lead
    for reach in (0, 2, 3):
        got = set()
        for prefix in range(1 << lead):
            inside = np.flatnonzero(values >> low == prefix)
            inside = inside[np.argsort(values[inside], kind="stable")]
            for q, r in ann.probe(values[inside], whole[inside], values[:40], whole[:40], prefix, lead, reach, 24):
                got |= set(zip(q.tolist(), inside[r].tolist(), strict=True))
        near = (np.bitwise_count(values[:40, None] ^ values) <= reach) & (np.bitwise_count(codes[:40, None] ^ codes).sum(axis=2) <= 24)
        assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_probing_prunes():
    x = np.random.default_rng(4).standard_normal((8000, 32))
    x[4000:] = x[:4000] + 0.3 * np.random.default_rng(5).standard_normal((4000, 32))
    model = ann.fit_codes(x)
    codes = model.encode(x)
    share = np.mean([(np.bitwise_count(codes ^ codes[i])[:, : model.tables] <= model.reach).any(axis=1).mean() for i in range(100)])
    assert share < 0.34


def test_equal_vectors_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(900, [0.0, 1.0]), (901, [-1.0, 0.0]), (3, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(table, table.where("vec_id in (0, 3, 900)"), group_rows=50).collect()}
    assert [got[0, k] for k in range(1, 6)] == [(i, 1.0) for i in (1, 2, 3, 4, 5)]
    assert [got[3, k] for k in range(1, 6)] == [(i, 1.0) for i in (0, 1, 2, 4, 5)]
    assert [got[900, k] for k in range(1, 6)] == [(i, 0.0) for i in (0, 1, 2, 3, 4)] and len(got) == 15


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(table, table.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


# --- 4 classifier


def test_held_out_accuracy(spark):
    got = quality_model_rows(spark)
    assert len(got) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(a == b for a, b in out) / len(out) >= 0.85


def quality_model_rows(spark):
    return quality_model.op4(spark, SF).collect()


def test_classifier_edges(spark, odd):
    table = docs(spark, odd)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    assert quality_model.keep_good(table, labels).columns == table.columns
    assert quality_model.keep_good(table.limit(0), labels).count() == 0
    stats = quality_model.with_statistics(table, "text", {"doc_id": "doc_id"})
    none = quality_model.fit(quality_model.training_rows(stats, labels.limit(0), "doc_id", "quality", "doc_id"))
    assert {r["score"] for r in quality_model.score_rows(stats, none, ["doc_id"]).collect()} == {0.5}


def test_model_equals_plain_normal_equations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    y = {r["doc_id"]: float(r["quality"]) for r in labels.collect()}
    bucket = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(i for i in y if i in texts and bucket[i] != 2)
    x = np.array([quality_model.statistics(texts[i]) for i in ids])
    plain = quality_model.Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3))
    f, target = plain.features(x), np.array([y[i] for i in ids])
    weights = np.linalg.solve(f.T @ f + quality_model.RIDGE * len(ids) / quality_model.FEATURES * np.eye(f.shape[1]), f.T @ target)
    stats = quality_model.with_statistics(docs, "text", {"doc_id": "doc_id"})
    model = quality_model.fit(quality_model.training_rows(stats, labels, "doc_id", "quality", "doc_id"))
    assert np.allclose(model.mean, plain.mean) and np.allclose(model.weights, weights, atol=1e-6)
    scored = {r["doc_id"]: r["score"] for r in quality_model.op4(spark, SF).collect()}
    every = quality_model.Model(plain.mean, plain.spread)
    every.weights, every.knots = weights, model.knots
    want = every.score(np.array([quality_model.statistics(texts[i]) for i in sorted(texts)]))
    assert np.allclose([scored[i] for i in sorted(texts)], want, atol=1e-6)
    assert (np.diff(model.knots[1]) >= 0).all()


def test_pool_adjacent_violators():
    assert quality_model.pool_adjacent(np.array([1.0, 3.0, 2.0, 5.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 5.0]


# --- 5 token files


@pytest.mark.parametrize("block", [64, 4096])
def test_simple8b_round_trip(block):
    rng = np.random.default_rng(block)
    for ids in (np.zeros(0), np.zeros(9000), rng.integers(0, 50000, 30001), np.array([1 << 63, 5, (1 << 60) - 1, 1 << 60], np.uint64), np.concatenate([rng.integers(0, 1 << k, 300) for k in range(1, 62)])):
        ids = ids.astype(np.uint64)
        words, offsets, wide = tokenfile.encode(ids, block)
        assert np.array_equal(tokenfile.decode(words, len(ids), offsets, wide, block), ids)
        if len(offsets) > 2:  # one block by itself
            one = tokenfile.decode(words[offsets[1] : offsets[2]], min(block, len(ids) - block), np.array([0, offsets[2] - offsets[1]]), wide, block)
            assert np.array_equal(one, ids[block : 2 * block])


def reference(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files(spark, odd, tmp_path):
    table = docs(spark, odd).orderBy(F.desc("doc_id")).repartition(3)
    tokenfile.write_token_files(table, str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in tokenfile.read_token_files(spark, str(tmp_path / "t")).collect()}
    at = 0
    for i, ids in enumerate(reference("word_bpe_49k.json", odd, 1)):
        assert (got[i]["start"], got[i]["n_tokens"], bytes(got[i]["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)


ODD = ["a", "B", "é", "İ", " ", " ", "\u0301", "\u0307", "'s", ".", ",", "!", "  ", "\n", "\t", "\r", "12", "<|endoftext|>", "<|startoftext|>", "ß", "Σ", "ŉ", "|", "你好", "\U0001f600", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\ufeff", "it's", "Word", "word,", "-", "ﬁ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_the_library(name, odd):
    own = pieces.Pieces(P.path(name), limit=2000)
    rng = random.Random(8)
    texts = [t or "" for t in odd] + ["  x", " x ", "\n \n q.", "a.\nB", "'s it's", "é.\nà,", "x\t.\ny", "wow!?", "a\n", " x  y", "\u0130.", "a\u00a0b\n\u00a0", "y" * 200_000, "word, " * 30_000]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        ids, begin = own.encode(some)
        for i, want in enumerate(reference(name, some, 0)):
            assert ids[begin[i] : begin[i + 1]].tolist() == want[:-1].tolist(), some[i][:40]


def test_other_tokenizer_files_are_read_without_cuts(tmp_path, odd):
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = None  # merges may now cross spaces
    (tmp_path / "t.json").write_text(json.dumps(spec))
    own = pieces.Pieces(str(tmp_path / "t.json"))
    assert own.kind is None
    texts = ["one two. three", "", "a  b\nc"]
    ids, begin = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


# --- 6 urls


def test_url_rules(spark):
    urls = [None, "nothing", "http://A.net/x", "http://a.net", "https://b.example.net/en/1?x", "http://x.example.com/de/2", "http://y.org/fr/", "http://m.casino-win.example.net/en/1", "http://m.casino-win.example.com/1", "http://fine.com/?q=://bad.net/", "http://notexample.net/en/"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string")).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.net", "/x", "net/", "block") and got[3] == ("a.net", "", None, "allow")
    assert got[4][2:] == ("example.net/en/", "allow") and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2:] == ("example.net/en/", "allow") and got[8][2:] == (None, "block") and got[9][0] == "fine.com" and got[10][2] == "net/"


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s: len(s))
    (tmp_path / "d").write_bytes(urlfilter.DigestArray.build(["aa", "bb", "c"]))
    array = urlfilter.DigestArray(str(tmp_path / "d"))
    assert [array.string(int(k)) if k >= 0 else None for k in array.find(["bb", "zz", "aa", "c", "dddd"])] == ["bb", None, "aa", "c", None]


def test_urls_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op6_url_filter"]).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, want)) == sorted(map(key, urlfilter.op6(spark, SF).collect()))


def test_very_long_hosts_and_empty_tables(spark):
    host = "a." * 200_000 + "ads-track.example.com"
    got = urlfilter.judge_urls(spark.createDataFrame([(1, f"http://{host}/x"), (2, "http://" + "b" * 1_000_000)], "page_id long, url string")).orderBy("page_id").collect()
    assert got[0]["verdict"] == "block" and got[0]["host"] == host and got[1]["verdict"] == "allow"
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- 7 byte-level BPE


def test_bytes_match_the_library(spark, odd):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = [*odd, "y" * 3000 + "zq" * 200, "w" * 2_000_000, " ".join(["common words here"] * 50), "a b  c \u0085d", "\U0001f600 " * 20]
    table = docs(spark, texts)
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for limit in (400_000, 100):
        for r in bytebpe.decode(bytebpe.encode(docs(spark, texts), ranks, P.PATTERN, limit=limit), ranks).collect():
            text = texts[r["doc_id"]] or ""
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text)
            assert bytes(r["bytes"]) == text.encode()
    for _ in range(50):
        word = "".join(rng.choice("abtheing") for _ in range(rng.randrange(1, 90)))
        assert bytebpe.merge_long(word.encode(), ranks) == library.encode_ordinary(word)
    assert bytebpe.encode(table.limit(0), ranks, P.PATTERN).count() == 0


def test_tokens_that_are_no_merge_of_lower_ranks(spark):
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"xyz": 258, b"yz": 259, b"abc": 260}
    assert bytebpe.Merges(ranks).odd == {258}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["xyz abc", "axyzb", " xyz xyzxyz abcbc", "yzyz"]
    got = bytebpe.encode(docs(spark, texts), ranks, P.PATTERN).collect()
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


# --- 8 packing


def test_packing_keeps_every_id_once(spark, odd):
    texts = odd + [" ".join(["word"] * n) for n in range(1, 400, 7)]
    rows = packing.pack(docs(spark, texts).repartition(5), P.path("byte_bpe_50k.json"), size=128, windows=4, merge=2).collect()
    want = reference("byte_bpe_50k.json", texts, 0)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in enumerate(want):
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in parts) == ids.tobytes() and {p["doc_tokens"] for p in parts} == {len(ids)}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert sum(map(len, want)) / (128 * len(by_sequence)) > 0.9
    assert packing.pack(docs(spark, odd).limit(0), P.path("byte_bpe_50k.json")).count() == 0


# --- 9 languages


def test_languages(spark, odd):
    got = langid.op9(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = got.where("held_out").join(truth, "doc_id")
    assert out.where("lang_pred = lang").count() / out.count() >= 0.95
    table = docs(spark, [None, "", "123 ..", "abc"])
    assert [r["lang_pred"] for r in langid.predict(table, None).collect()] == ["und"] * 4
    model = langid.fit(table.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert [(r["lang_pred"], r["score"] > 0.9) for r in langid.predict(table, model).orderBy("doc_id").collect()] == [("und", False)] * 3 + [("en", True)]


def plain_features(text):
    low = text.lower().encode()
    letters = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in low)
    counts = np.zeros(langid.DIMENSIONS)
    padded = b" " + letters
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            code = 0
            for b in padded[k : k + n]:
                code = (code * 257 + b) % (1 << 32)
            counts[(code + n * 7919) * 2654435761 % (1 << 32) >> 20] += 1
    root = np.sqrt(counts)
    return root / np.linalg.norm(root)


def test_language_features_and_predictions_equal_plain_ones(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(120).collect()
    x = np.array([plain_features(r["text"][:3000]) for r in rows])
    assert np.allclose(x, [langid.features(r["text"][:3000]) for r in rows], atol=1e-6)
    model = langid.Hierarchy(x.astype(np.float32), [r["lang"] for r in rows], langid.FAMILIES)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(r["doc_id"], r["text"][:3000]) for r in rows], "doc_id long, text string"), model).collect()}

    def winner(pairs, v):
        names, machines = pairs
        votes, least = dict.fromkeys(range(len(names)), 0), dict.fromkeys(range(len(names)), np.inf)
        for a, b, w in machines:
            m = float(v @ w[:-1] + w[-1])
            votes[a if m > 0 else b] += 1
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        return names[max(votes, key=lambda i: (votes[i], least[i]))]

    assert got == {r["doc_id"]: winner(model.within[winner(model.between, v)], v) for r, v in zip(rows, x, strict=True)}


# --- 10 rules


def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, dup, before = [x for x in text.split("\n") if WORD.search(x)], 0, set()
    for x in lines:
        dup += x in before
        before.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_rule_statistics(spark, odd):
    texts = [*odd, "a b c a b c a b c", "x y z q x y z", "l1 a\nl1 a\n \n \nl2", "## $$ | <b>", "a a a a", "a\x0bb\x0cc\rd"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = rules.with_statistics(docs(spark, texts)).collect()
    for r in got:
        assert tuple(r[rules.PREFIX + n] for n in names) == plain_statistics(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_rules_tell_junk_from_text(spark):
    rows = rules.op10(spark, SF).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r["kept"], label[r["doc_id"]], r["base_failed"]) for r in rows if r["doc_id"] in label]
    assert all(not k for k, _, failed in judged if failed)
    assert sum(k for k, q, failed in judged if q == 1 and not failed) >= 0.97 * sum(q == 1 and not failed for _, q, failed in judged)
    assert sum(not k for k, q, _ in judged if q == 0) >= 0.9 * sum(q == 0 for _, q, _ in judged)


def plain_em(votes, rounds=200):
    """The same model, document by document."""
    m = len(votes[0])
    share0 = [rules.SHARE_GOOD] + [(1 - rules.SHARE_GOOD) / m] * m
    odds0 = [[list(rules.GOOD if c == 0 else rules.OWN if c == k + 1 else rules.OTHER) for k in range(m)] for c in range(m + 1)]
    share, odds = share0, odds0
    weight = max(1.0, rules.STRENGTH * len(votes))
    place = {-2: 0, -1: 1, 1: 2}
    for _ in range(rounds):
        belief = []
        for v in votes:
            p = [share[c] * np.prod([odds[c][k][place[x]] for k, x in enumerate(v) if x]) for c in range(m + 1)]
            belief.append([x / sum(p) for x in p])
        share = [(sum(b[c] for b in belief) + weight * share0[c]) / (len(votes) + weight) for c in range(m + 1)]
        odds = []
        for c in range(m + 1):
            of_rule = []
            for k in range(m):
                n = [weight * share0[c] * odds0[c][k][x] + sum(b[c] for b, v in zip(belief, votes, strict=True) if place.get(v[k]) == x) for x in range(3)]
                n = [x / sum(n) for x in n]
                if c == k + 1 and n[0] + n[1] < 0.5:
                    n = [n[0] / (n[0] + n[1]) / 2, n[1] / (n[0] + n[1]) / 2, 0.5]
                of_rule.append(n)
            odds.append(of_rule)
    return [b[0] for b in belief]


def test_votes_by_pattern_equal_votes_by_document():
    rng = random.Random(6)
    cast = [tuple(rng.choice([1, 1, 1, 1, 0, -1, -2]) if rng.random() < 0.3 else 1 for _ in range(4)) for _ in range(150)]
    shares, odds = rules.fit_votes(sorted(Counter(cast).items()), rounds=40)
    got = rules.beliefs(shares, odds, np.array(cast))[:, 0]
    assert np.allclose(got, plain_em(cast, 41), atol=0.02)


def judged(patterns):
    shares, odds = rules.fit_votes(patterns)
    return {v: float(p) for (v, _), p in zip(patterns, rules.beliefs(shares, odds, np.array([v for v, _ in patterns]))[:, 0], strict=True)}


def test_an_unreliable_rule_is_outvoted_and_junk_is_not():
    clean, weak, glaring, several = (1,) * 7, (1, 1, 1, -1, 1, 1, 1), (-2, 1, 1, 1, 1, 1, 1), (1, -1, 1, 1, -1, -1, 1)
    got = judged([(clean, 7000), (weak, 2500), (glaring, 400), (several, 100)])
    assert got[clean] > 0.99 and got[weak] > 0.5 and got[glaring] < 0.1 and got[several] < 0.1


def test_no_kind_of_junk_takes_over_the_model():
    clean, marks, shout = (1,) * 7, (-2, 1, 1, 1, 1, 1, 1), (1, -2, -2, 1, 1, 1, 1)
    got = judged([(clean, 100), (marks, 5), (shout, 200)])
    assert got[clean] > 0.5 > max(got[marks], got[shout])
    assert rules.fit_votes([])[0].sum() == pytest.approx(1)


def test_verdict_is_not_all_must_pass(spark):
    from evidex.llm.common import checkpointed

    big = "/root/testdata/sf0.01"
    stats = rules.judge(checkpointed(rules.with_statistics(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")).drop("text")))
    rows = stats.where("not _q_base_failed").select("_q_kept", F.array(*rules.votes()).alias("v")).collect()
    assert any(r["_q_kept"] and min(r["v"]) < 0 for r in rows) and all(r["_q_kept"] for r in rows if min(r["v"]) >= 0)
    assert all(not r["_q_kept"] for r in rows if sum(x < 0 for x in r["v"]) > 1)


def test_rules_with_clashing_columns_and_long_texts(spark, odd):
    table = docs(spark, [*odd, "so many words of one kind and another " * 20_000]).select("*", F.lit("keep").alias("_q_n_words"), F.lit("w").alias("_Q_words"), F.lit("t").alias("_q_text"))
    kept = rules.keep_good(table)
    assert kept.columns == table.columns and {tuple(r)[-3:] for r in kept.collect()} == {("keep", "w", "t")}


def test_rules_edges(spark, odd):
    table = docs(spark, odd)
    kept = rules.keep_good(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {7, 8, 9}
    assert rules.keep_good(table.limit(0)).count() == 0


# --- all: empty tables and very long texts


def test_empty_tables(spark, tmp_path):
    none = docs(spark, ["x"]).limit(0)
    assert secrets.digest_rows(none).count() == secrets.redact_secrets(none).count() == simhash.near_duplicates(none).count() == langid.predict(none, None).count() == 0
    tokenfile.write_token_files(none, str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    assert tokenfile.read_token_files(spark, str(tmp_path / "t")).count() == 0
    assert langid.fit(none.select(F.col("doc_id").alias("id"), "text", "lang")) is None


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(12)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(900_000))  # 5 million characters
    table = docs(spark, [f"{long} {SECRET}", long])
    got = {r["doc_id"]: r for r in secrets.digest_rows(table).collect()}
    assert got[0]["n_hex"] == 1 and got[1]["spans"] == "" and got[0]["spans"].split(",")[0] == f"assign:{len(long) + 1}:{len(long) + len(SECRET) + 1}"
    stats = {r["doc_id"]: r["_q_n_words"] for r in rules.with_statistics(table).select("doc_id", "_q_n_words").collect()}
    assert stats == {0: 900_003, 1: 900_000}
    assert quality_model.with_statistics(table, "text", {"doc_id": "doc_id"}).count() == 2
    model = langid.Hierarchy(np.array([langid.features("der die das"), langid.features("the of and")]), ["de", "en"], langid.FAMILIES)
    assert {r["lang_pred"] for r in langid.predict(table, model).collect()} <= {"de", "en"}
    tokenfile.write_token_files(table, str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    for r in tokenfile.read_token_files(spark, str(tmp_path / "t")).collect():
        assert bytes(r["ids"]) == reference("word_bpe_49k.json", [long if r["doc_id"] else f"{long} {SECRET}"], 1)[0].tobytes()
