"""The corpus operators against brute force, with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.llm import crf_langid, entropy_mix, license_scan, markov_secrets, odd_minhash, sp_lattice, substring_dedup, topk_search, url_rules, wav_media
from traitloom.llm._common import components, rolling, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score double, spans string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with extra columns named like results."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a null id with some words"), (4, "one"), (4, "one"), (5, "é ☃ 😀 ▁ \u00a0x"), (6, "word " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_split_like_the_pattern():
    texts = ["a b  c", "", " lead", "trail ", "a", "\tA\u00a0b\n"]
    raw = [t.encode() for t in texts]
    bounds = np.append(0, np.cumsum([len(r) for r in raw]))
    h, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [int(n) for n in np.diff(first)] == [len(WORDS.findall(t)) for t in texts]
    assert h[0] == h[first[4]] and len(set(h[:3].tolist())) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 50])
def test_rolling_is_a_window_hash(n):
    x = np.arange(100, dtype=np.uint64) % np.uint64(7)
    r = rolling(x, n, 31)
    same = {}
    for i in range(len(x) - n + 1):
        assert same.setdefault(tuple(x[i : i + n]), r[i]) == r[i]
    assert len(set(same.values())) == len(same)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 110)] + [(7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 100 for i in range(100, 110))


# language identification


def samples():
    return [("the cat and the dog with that", "en"), ("der hund und die katze mit dem", "de"), ("le chien et la chatte avec les", "fr")] * 5


def test_block_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(40, 3)), rng.normal(size=(3, 3))
    bounds = np.array([0, 1, 33, 65, 66, 250])
    ids = rng.integers(0, 40, 250)
    got = crf_langid._marginals(ids, bounds, scores, moves)
    for a, b in itertools.pairwise(bounds):
        want = crf_langid._forward_backward(scores[ids[a:b]][None], moves)[0][0]
        assert np.allclose(got[a:b], want)


def test_crf_labels_switches_and_odd_rows(spark, odd, empty):
    model = crf_langid.fit(samples(), epochs=10)
    rows = table(spark, [(1, "the dog and the cat with that der hund und die katze mit dem"), (2, "12 34 !"), (3, None), (4, "²")])
    got = {r["doc_id"]: r for r in crf_langid.identify(rows, model).collect()}
    assert got[1]["segments"] == "en*7 de*7" and 0 <= got[1]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    assert crf_langid.identify(odd, model).count() == len(ODD)
    kept = crf_langid.identify(odd, model, keep=True)
    assert set(kept.columns) == {"doc_id", "text", "lang", "source", "spans", "lang_pred", "score", "n_words", "segments"} and kept.count() == len(ODD)
    assert crf_langid.identify(empty, model).count() == 0
    assert crf_langid.train(empty) is None and crf_langid.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_held_out_documents_are_never_learned_from(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in rows.select("doc_id", crf_langid.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_crf_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = crf_langid.train(docs)
    got = crf_langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crf_langid.held_out())
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


# licenses


def test_license_places_by_brute_force(spark, odd, empty):
    texts = ["Under the MIT license, and under the mit License!", "apache license version 2.0 apache License, Version 2", "CC-BY-NC cc by nc", "under the mit", "x " * 50 + "the GNU general public license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    rows = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in license_scan.scan(rows).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        places, labels = [], set()
        for label, phrase in license_scan.BASE_PHRASES:
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted(labels)) and labels <= set(got[i]["labels"].split(","))  or not labels
    assert "gpl" not in got[3]["labels"] and got[5]["labels"] == "mit" and got[5]["n_base"] == 0
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0


# urls


def test_listed_rules_and_hosts(spark):
    urls = [None, "nothing", "http://Example.COM/en/1", "http://www.example.com/en/", "https://a.net/es/?x", "x://net", "http://com", "http://y.com/?q", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judge(pages).collect()}
    assert [got[i]["rule"] for i in range(9)] == [None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/", "com/"]
    assert (got[2]["host"], got[2]["path"], got[6]["path"]) == ("example.com", "/en/1", "")
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_equal_counting_all_combinations(spark):
    rows = [(["a", "b"], "block")] * 30 + [(["a", "c"], "allow")] * 30 + [(["b"], "allow")] * 5 + [(["c", "d"], "allow")] * 20
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), support=0.05, confidence=0.9)
    got = {(tuple(r["tokens"]), r["verdict"]) for r in rules.collect()}
    want = {}
    for size in (1, 2):
        for combo in itertools.combinations("abcd", size):
            hits = [label for tokens, label in rows if set(combo) <= set(tokens)]
            for label in ("allow", "block"):
                n = hits.count(label)
                if n >= max(0.05 * len(rows), 10) and n / len(hits) >= 0.9:
                    want[(combo, label)] = n / len(hits)
    pruned = {k for k, c in want.items() if not any(set(o[0]) < set(k[0]) and o[1] == k[1] and oc >= c for o, oc in want.items())}
    assert got == pruned
    urls = spark.createDataFrame([("u", ["a", "b", "x"]), ("v", ["x"])], "url string, tokens array<string>")
    assert [tuple(r) for r in url_rules.fire(urls, rules).collect()] == [("u", "a b", "block")]


# mixing


def test_targets_are_capped_and_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 100, None: 50}
    got = {r["source"]: r["target"] for r in entropy_mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        level = (total - sum(held.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > 3 * sizes[s]]
        if not over:
            break
        held |= {s: 3 * sizes[s] for s in over}
    want = {s: held.get(s, weights[s] * level) for s in sizes}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_mix_meets_targets_and_never_drifts(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "en", f"s{i % 4}" if i % 9 else None, 1, 0.0, "") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = entropy_mix.mix(docs).collect()
    assert len(got) == 600 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 60
    again = entropy_mix.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert entropy_mix.mix(odd).count() == len(ODD) and entropy_mix.mix(empty).count() == 0
    taken = entropy_mix.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got)


def test_balance_with_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 20.0), ("b", "y", 40.0)], "one string, two string, words double")
    targets = {"one": spark.createDataFrame([("a", 60.0), ("b", 40.0)], "value string, target double"), "two": spark.createDataFrame([("x", 50.0), ("y", 50.0)], "value string, target double")}
    m = {(r["name"], r["value"]): r["multiplier"] for r in entropy_mix.balance(cells, ["one", "two"], targets, near=1e-6).collect()}
    reached = Counter()
    for r in cells.collect():
        w = r["words"] * np.exp(m["one", r["one"]] + m["two", r["two"]])
        reached["one", r["one"]] += w
        reached["two", r["two"]] += w
    assert [reached[k] for k in (("one", "a"), ("one", "b"), ("two", "x"), ("two", "y"))] == pytest.approx([60, 40, 50, 50], rel=1e-4)


# media


def test_wav_round_trip_is_lossless(spark, odd, empty):
    heard = wav_media.fingerprint(wav_media.store(odd)).collect()
    want = Counter()
    for _, text in ODD:
        raw = (text or "").encode()
        want[raw + bytes(-len(raw) % 64 or (0 if raw else 64))] += 1
    assert Counter(bytes(r["payload"]) for r in heard) == want
    assert all(r["payload_bytes"] == len(r["payload"]) and r["tail_crc32"] == zlib.crc32(r["payload"][-64:]) for r in heard)
    assert wav_media.fingerprint(wav_media.store(empty)).count() == 0


def test_peaks_find_a_tone():
    t = np.arange(4096)
    tone = (128 + 60 * np.sin(2 * np.pi * 32 * t / 512)).astype(np.uint8)
    codes = wav_media.peak_pairs(tone, 512, 512, 1)
    assert len(codes) == 7 * 4 and 31 in {int(c) >> 12 & 0xFF for c in codes}


def test_unequal_short_texts_have_unequal_peaks(spark):
    texts = ["The leaf is ovate.", "Petiole 4 cm long, glabrous.", "Margin serrate, apex acute.", "Specimen from the north slope. " * 8, "", "abc " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    peaks = [tuple(r["peaks"]) for r in wav_media.fingerprint(wav_media.store(docs)).collect()]
    assert all(peaks) and len(set(peaks)) == len(texts)


def test_shifted_text_keeps_most_pairs(spark):
    words = np.random.default_rng(3).choice(["leaf", "ovate", "petiole", "margin", "serrate", "collected", "slope", "river"], 400)
    text = " ".join(words)
    docs = spark.createDataFrame([(0, text), (1, "a few " + text), (2, " ".join(words[::-1]))], "doc_id long, text string")
    pairs = {r["doc_id"]: set(r["peaks"]) for r in wav_media.fingerprint(wav_media.store(docs)).collect()}
    shared = lambda k: len(pairs[0] & pairs[k]) / len(pairs[0])
    assert shared(1) > 0.5 > 3 * shared(2)


def test_blocks_of_frames_give_the_same_pairs(monkeypatch):
    noise = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    whole = wav_media.peak_pairs(noise, 128, 32, 3)
    monkeypatch.setattr(wav_media, "FRAMES", 7)
    assert (wav_media.peak_pairs(noise, 128, 32, 3) == whole).all()


# substrings


def brute_windows(rows, size):
    first = {}
    for i, text in rows:
        w = WORDS.findall(text or "")
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = WORDS.findall(text or "")
        gone = set()
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size,gram", [(50, 8), (6, 3), (4, 4)])
def test_repeated_windows_by_brute_force(spark, size, gram):
    rng = np.random.default_rng(size)
    passages = [" ".join(rng.choice(list("abcdefgh"), 80)) for _ in range(4)]
    rows = list(ODD)
    for i in range(10, 60):
        parts = [" ".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(0, 70))))]
        if i % 2:
            parts.append(passages[i % 4])
        if i % 5 == 0:
            parts.append("same " * 120)
        rows.append((i, "  ".join(parts)))
    rows += [(80, rows[-1][1]), (81, rows[-1][1]), (81, rows[-2][1])]
    got = substring_dedup.remove_repeated_windows(table(spark, rows), size, gram)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute_windows(rows, size)


def test_repeated_windows_of_nothing(spark, empty):
    assert substring_dedup.remove_repeated_windows(empty).count() == 0


# near duplicates


def brute_components(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_by_brute_force(spark, words):
    rng = np.random.default_rng(words)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    rows = [(i, t) for i, t in ODD if i is not None and i != 4] + [(4, "one"), (7, "ONE")]
    for group in range(6):
        base = rng.choice(vocabulary, 120)
        for k in range(25):
            text = base.copy()
            edits = int(rng.integers(0, 16 // words + 2))
            text[rng.integers(0, 120, edits)] = rng.choice(vocabulary, edits)
            rows.append((100 * group + 20 + k, " ".join(text)))
    rows.append((999, rows[-1][1].upper()))
    got = odd_minhash.near_duplicates(table(spark, rows), words=words)
    want = brute_components(rows, words, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = odd_minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got)
    assert odd_minhash.near_duplicates(empty).count() == 0


# pieces


def test_decoding_is_lossless_and_keys_repeat(spark, odd, empty):
    encoded = sp_lattice.encode(odd)
    assert Counter(r["text"] for r in sp_lattice.decode(encoded).collect()) == Counter(t or "" for _, t in ODD)
    one, two = (sorted(map(str, sp_lattice.encode(odd.repartition(n)).collect())) for n in (1, 5))
    assert one == two
    assert sp_lattice.decode(sp_lattice.encode(empty)).count() == 0


def test_samples_follow_the_lattice():
    vocab = sp_lattice.vocabulary()
    held = sp_lattice._Lattices(vocab)
    held.add(["dog", " the", "x"])
    kind = held.known[" the"]
    n = 20_000
    codes, count = held.sample(np.full(n, kind), np.arange(n, dtype=np.uint64))
    got = Counter(tuple(codes[e - c : e].tolist()) for e, c in zip(np.cumsum(count), count, strict=True))
    weights = {}
    for cuts in itertools.product([0, 1], repeat=3):
        pieces, start = [], 0
        for end in [i + 1 for i, c in enumerate(cuts) if c] + [4]:
            pieces.append(" the"[start:end])
            start = end
        if all(vocab.pieces.get(p) for p in pieces):
            weights[tuple(vocab.pieces[p][0] for p in pieces)] = np.prod([vocab.pieces[p][1] for p in pieces])
    total = sum(weights.values())
    for path, w in weights.items():
        assert got[path] / n == pytest.approx(w / total, abs=0.015)
    assert set(got) <= set(weights)


def test_lattices_together_equal_one_by_one():
    vocab = sp_lattice.vocabulary()
    chunks = [" there", "é☃", "   ", "\n", " ,;!", "internationalization" * 3, "x"]
    end, length, code, weight = sp_lattice.lattices(chunks, vocab)
    want = [e for c in chunks for e in sp_lattice.lattice(c, vocab)]
    for i, edges in enumerate(want):
        mine = end == i
        assert [(a, b) for a, b, _ in edges] == list(zip(length[mine].tolist(), code[mine].tolist(), strict=True))
        assert np.allclose(weight[mine] / weight[mine].sum(), np.array([w for *_, w in edges]) / sum(w for *_, w in edges))


def test_long_chunks_do_not_underflow():
    vocab = sp_lattice.vocabulary()
    for chunk in ("x" * 5000, "☃" * 400, "|" * 3000):
        ends = sp_lattice.lattice(chunk, vocab)
        assert len(ends) == len(chunk) and all(e and all(0 < w < float("inf") for _, _, w in e) for e in ends)


# secrets


def brute_spans(text):
    assign = re.compile(markov_secrets.ASSIGN, re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans_by_brute_force(spark, odd, empty):
    texts = ["Password: 'abc' token=token:abcdef API_KEY=abcdef1", "☃😀 secret = \"" + "f0" * 20 + "\" x", "AKIA" + "A1" * 8 + " AKIA" + "B2" * 7, "token=abcdef token=abcdef", "deadbeef" * 3 + "g" + "0" * 23, "", None]
    flat = [0.0] * 4096
    got = {r["doc_id"]: r for r in markov_secrets.scan(table(spark, list(enumerate(texts))), table=flat).collect()}
    for i, text in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]] == brute_spans(text or "")
    assert markov_secrets.scan(odd).count() == len(ODD) and markov_secrets.scan(empty).count() == 0


def test_markov_models_tell_random_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ratios = markov_secrets.train(docs)
    rows = table(spark, [(1, "see aGVsbG8gd29ybGQhIHRoaXMgaXM5Qz7 here"), (2, "thingthereandtheothertionthatwas here"), (3, "k=Zx81Qm0PvR77tYw2LkD9sB4nC6h")])
    found = {r["doc_id"]: r for r in markov_secrets.scan(rows, table=ratios).select("doc_id", "spans", markov_secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert found[1]["clean"] == "see [SECRET] here" and found[2]["spans"] == [] and found[3]["clean"] == "k=[SECRET]"


def test_redaction_of_overlaps(spark):
    rows = table(spark, [(1, "x token = \"" + "ab12" * 10 + "\" y")])
    found = markov_secrets.scan(rows, table=[0.0] * 4096)
    assert found.select(markov_secrets.redacted(F.col("text"), F.col("spans"))).first()[0] == 'x [SECRET]" y'


# search


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=6).round(2).tolist(), 0) for i in range(300)] + [(300 + i, [0.5] * 6, 1) for i in range(80)]
    vectors += [(1000, None, 0), (1001, [1.0, None, 0, 0, 0, 0], 0), (1002, [float("nan")] * 6, 0), (1003, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    rows = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v else None, s) for i, v, s in vectors], "vec_id long, embedding array<double>, score int")
    got = topk_search.exact_top_k(rows, F.col("vec_id") % 20 == 0, k=7, bins=16, query_rows=4, block_rows=50)
    good = {i: np.floor(64 * np.array(v)) for i, v, _ in vectors[:380]}
    want = set()
    for q in good:
        if q % 20 == 0:
            ranked = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:7]
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(ranked)}
    assert {tuple(r) for r in got.collect()} == want


def test_top_k_of_few_and_none(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (20, [])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk_search.exact_top_k(rows, F.col("vec_id") % 20 == 0, k=5).collect()}
    assert got == {(0, 1, 1, 64 * 192), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)}
    assert topk_search.exact_top_k(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0
