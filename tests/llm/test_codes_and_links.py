"""Vector codes, bit-sliced SimHash and token links, each against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash, token_links, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- op11


def plain_codes(vectors, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd rounds from scratch, in Python's integers. vectors: (vec_id, components, label)."""
    kept = []
    for i, v, label in vectors:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [max(-vector_codes.MOST, min(vector_codes.MOST, math.floor(c * scale))) for c in v], label))
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v, label) for i, v, label in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    pad = lambda v: v + [0] * (parts * width - len(v))
    cut = lambda v, p: tuple(pad(v)[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[best(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if members[k] else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found, by = [], Counter()
    for i, v, label in kept:
        got = [best(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
        by[label] += found[-1][2]
    return sorted(((i, code, error, by[label], digest) for i, code, error, label in found), key=repr)


def codes(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows(df)), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, v string, code int, error string, moved int"


def made(spark, vectors):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in vectors], VECTORS)


def test_codes_against_plain_lloyd(spark):
    rng = random.Random(1)
    vectors = [(k, [rng.gauss(k % 5, 0.3) for _ in range(8)], (None, 0, 1)[k % 3]) for k in range(400)]
    vectors += [(500, None, 1), (501, [float("nan")] + [0.0] * 7, 1), (502, [None] + [0.0] * 7, 1), (503, [float("-inf")] * 8, 1), (504, [], 2), (505, [1.0] * 6, 2)]
    vectors += [(None, [0.25] * 8, 1), (7, vectors[7][1], 1), (7, [9.0] * 8, 1), (600, [1e300, -1e300] + [0.0] * 6, 3)]
    small = vector_codes.Codec(entries=20, rounds=3)
    for n in (1, 7):
        assert codes(vector_codes.compress(made(spark, vectors).repartition(n), small)) == plain_codes(vectors, entries=20, rounds=3)


def test_codes_of_few_equal_and_no_vectors(spark):
    same = [(k, [0.5, -0.5, 1.0, 0.0], 1) for k in range(30)]
    assert codes(vector_codes.compress(made(spark, same))) == plain_codes(same)
    assert codes(vector_codes.compress(made(spark, [(1, None, 1), (2, [float("inf")], None)]))) == []
    assert codes(vector_codes.compress(made(spark, same).limit(0))) == []
    assert codes(vector_codes.compress(made(spark, [(1, [], 1), (2, [], None)]))) == plain_codes([(1, [], 1), (2, [], None)])


def test_only_moved_parts_contribute():
    rng = np.random.default_rng(3)
    x, old = rng.integers(-5000, 5000, (300, 4)), rng.integers(0, 9, 300)
    new = old.copy()
    new[:40] = rng.integers(0, 9, 40)
    sums = lambda at: np.stack([np.concatenate([[(at == e).sum()], x[at == e].sum(0)]) for e in range(9)])
    first = vector_codes.contributions(x, None, old, 9)
    assert (first == sums(old)).all()
    assert (first + vector_codes.contributions(x, old, new, 9) == sums(new)).all()
    assert not vector_codes.contributions(x, new, new, 9).any()
    assert (vector_codes.contributions(x, old, new, 9) == vector_codes.contributions(x[:40], old[:40], new[:40], 9)).all()


def test_distances_are_exact_at_any_size():
    rng = np.random.default_rng(5)
    for top in (50, vector_codes.MOST):
        x, book = rng.integers(-top, top, (200, 16)), rng.integers(-top, top, (30, 16))
        book[7] = book[3]
        at, far = vector_codes.nearest(x, book)
        wanted = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(book)) for r in x]
        assert [(d, k) for k, d in zip(at.tolist(), far.tolist())] == wanted


def test_labels_join_by_shuffle_too(spark, monkeypatch):
    vectors = [(k, [float(k % 7), 1.0, float(k % 3), 0.0], (None, 1)[k % 2]) for k in range(50)]
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    assert codes(vector_codes.compress(made(spark, vectors), vector_codes.Codec(entries=4))) == plain_codes(vectors, entries=4)


def test_codes_of_all_embeddings_against_sql(spark, sf):
    wanted = duckdb.connect().sql(vector_codes.SQL["op11_vector_codes"].replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'"))
    got = vector_codes.op11_vector_codes(spark, sf).select(wanted.columns)
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


# ---------------------------------------------------------------- op12


def plain_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """prints: (doc_id, fingerprint) rows. The least doc_id reachable, by all pairs."""
    parent = {i: i for i, _ in prints if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, p) for i, p in prints if i is not None]
    for n, (i, p) in enumerate(own):
        for j, q in own[:n]:
            if i == j or bin(p ^ q).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def test_simhash_of_all_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in docs.items()}
    wanted = plain_components(list(prints.items()))
    got = rows(simhash.op12_simhash(spark, sf))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", wanted[i]) for i in docs} and len(got) == len(docs)


def test_a_shingles_hash_is_sparks(spark):
    texts = ["one", "one two three", "ünï 🙂 x"]
    got = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [simhash.fingerprint(t.encode()) for t in texts]


@pytest.mark.parametrize("hot", [256, 5])
def test_links_of_planted_fingerprints(spark, monkeypatch, hot):
    """Hubs with all their neighbours, chains, and fingerprints of one long common run of bits."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "TILE", 300 if hot == 5 else 1 << 16)
    rng = random.Random(hot)
    found = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(3):
        hub = rng.getrandbits(64)
        found |= {hub} | {hub ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)}
        found |= {hub ^ 7 ^ 1 << rng.randrange(64) for _ in range(5)}
        chain = rng.getrandbits(64)
        for _ in range(12):
            found.add(chain)
            chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    low = rng.getrandbits(48) << 16
    found |= {low | rng.getrandbits(16) for _ in range(250)}
    prints = list(enumerate(sorted(found)))
    rng.shuffle(prints)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "prints", lambda docs, near: docs.select("doc_id", "fp"))
    for radius in (2, 3):
        got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_groups(df, simhash.Near(radius=radius)))}
        assert got == plain_components(prints, radius)


def test_sliced_distances():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    for i in range(0, 900, 3):
        fp[i + 70] = fp[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    planes = simhash.planes_of(fp, 200)
    for shift in (1, 63, 64, 65, 70, 128, 200):
        lanes = np.arange(1000) < 1000 - shift
        for radius in (0, 1, 2, 3, 4):
            near = np.unpackbits(simhash.within(planes, simhash._packed(lanes), shift, radius).view(np.uint8), bitorder="little")[:1000]
            assert np.flatnonzero(near).tolist() == [i for i in range(1000 - shift) if bin(int(fp[i]) ^ int(fp[i + shift])).count("1") <= radius]


def test_simhash_on_odd_rows(odd, none):
    got = rows(simhash.near_groups(odd))
    assert len(got) == odd.count() and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0 and {by[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert rows(simhash.near_groups(none)) == []


def test_fingerprints_of_one_doc_id_belong_together(spark):
    docs = [(1, "some words that stand alone here"), (2, "other words of another text at all"), (2, "some words that stand alone here"), (3, "other words of another text at all"), (4, "nothing like any of these is here")]
    assert {(r["doc_id"], r["component_id"]) for r in rows(simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")))} == {(1, 1), (2, 1), (3, 1), (4, 4)}


# ---------------------------------------------------------------- op13


@pytest.fixture(scope="module")
def libraries():
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    path_a, path_b = token_links.default_paths()
    a = tokenizers.Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def plain_links(texts, a, b):
    """Each text whole, by both libraries, with loops over all tokens."""
    shown = token_links.byte_symbols()
    as_byte = {c: i for i, c in enumerate(shown)}
    held, counts = [], Counter()
    for text in texts:
        held.append(None)
        if not text:
            continue
        ids_a, ids_b, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        of_a = [bytes(as_byte[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(of_a) != want or b"".join(of_b) != want:
            continue
        ends_a = [sum(map(len, of_a[: k + 1])) for k in range(len(of_a))] if len(of_a) < 2000 else np.cumsum(list(map(len, of_a))).tolist()
        ends_b = np.cumsum(list(map(len, of_b))).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append([[i for i, e in zip(ids, ends) if low < e <= cut] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))] if len(cuts) < 400 else None)
            low = cut
        if len(cuts) >= 400:
            groups = [[[], []] for _ in cuts]
            for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
                at = 0
                for i, e in zip(ids, ends):
                    while cuts[at] < e:
                        at += 1
                    groups[at][side].append(i)
        at_b = dict(zip(ends_b, ids_b))
        links = [(i, at_b[e]) for i, e in zip(ids_a, ends_a) if e in at_b]
        counts.update(links)
        held[-1] = (len(ids_a), len(ids_b), groups, links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = h
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out, counts


def links_row(r):
    return r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]


HARD = [
    "", None, " ", "a", "two  spaces", " leading", "trailing ", "line\nbreaks \n and\ttabs\t x", "<|endoftext|> <s> </s> <unk> <0x41>", "wide ▁ mark▁in words", "nbsp  x  y  z", "ünï cödé 日本語 🙂👍🏽 ﬁ ½",
    "don't I'LL we've 'quoted' 's", "x" * 3000, "1234567 89,0.5", "a\x00b \x1c c\x1f d", "é ́x ​ ﻿", "\r\n \r", "same words same words", "same words same words", "� \U0010ffff",
]


def test_links_against_the_libraries(spark, libraries, monkeypatch):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(HARD)], "doc_id long, text string, chunk int, count string")
    wanted, counts = plain_links(HARD, *libraries)
    assert sum(w[0] > 0 for w in wanted) > 12
    for size in (token_links.CHUNK, 40):
        monkeypatch.setattr(token_links, "CHUNK", size)
        found, pairs = token_links.align(df.repartition(3))
        assert {r["doc_id"]: links_row(r) for r in rows(found)} == dict(enumerate(wanted))
        assert {(r["a"], r["b"]): r["count"] for r in rows(pairs)} == dict(counts)


def test_links_of_all_documents(spark, sf, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted, _ = plain_links([t for _, t in docs], *libraries)
    assert {r["doc_id"]: links_row(r) for r in rows(token_links.op13_token_links(spark, sf))} == {i: w for (i, _), w in zip(docs, wanted)}


def test_links_on_odd_rows(odd, none):
    found = rows(token_links.align(odd)[0])
    assert len(found) == odd.count() and sum(r["doc_id"] == 2 for r in found) == 2
    by = {r["doc_id"]: r for r in found}
    assert by[3]["groups_sha256"] == by[4]["groups_sha256"] == "" and by[6]["n_links"] > 60_000 and by[6]["n_groups"] == by[6]["n_links"]
    assert rows(token_links.align(none)[0]) == [] == rows(token_links.align(none)[1])


def test_runs_and_whole_texts_change_nothing(monkeypatch):
    texts = [t for t in HARD if t] + ["words of another text, some long", "a b c d e f g h i j"]
    got = []
    for run, divisible in ((token_links.RUN, True), (10, True), (token_links.RUN, False)):
        monkeypatch.setattr(token_links, "RUN", run)
        aligner = token_links.Aligner(*token_links.default_paths())
        assert aligner.divisible
        aligner.divisible = divisible
        names, split = aligner.parts_of(texts)
        parts = aligner.align(names)
        stops = np.concatenate([[0], np.cumsum(parts.totals[:, 3])])
        got.append([(";".join(parts.groups[i] for i in at), [x for i in at for x in parts.links[stops[i] : stops[i + 1]].tolist()]) if parts.ok[at].all() else None for at in split])
    assert got[0] == got[1] == got[2] and None in got[0]


def test_tokens_that_end_together_all_link():
    """Ends that several tokens share, as tokens without bytes would make."""
    ends_a, ends_b = np.array([2, 3, 3, 5]), np.array([3, 5, 5])
    cuts, group_a, group_b = token_links.cuts_of(ends_a, ends_b)
    assert cuts.tolist() == [3, 5] and group_a.tolist() == [0, 0, 0, 1] and group_b.tolist() == [0, 1, 1]
    cut, i, j = token_links.links_of(cuts, ends_a, ends_b)
    assert list(zip(cut.tolist(), i.tolist(), j.tolist())) == [(0, 1, 0), (0, 2, 0), (1, 3, 1), (1, 3, 2)]
