"""Token alignment, ranked search, quality rules and the mends of earlier operators against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traitloom.llm import lexical_search, license_scan, quality_rules, substring_dedup, token_alignment, topk_search, url_rules
from traitloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score long, rank int, kept boolean, n_a string, whole int, words int"
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a null id with some words"), (4, "one"), (4, "one"), (5, "é ☃ 😀 ▁  x"), (6, "word " * 30_000), (7, "a\0b <|endoftext|> <s>"), (8, "x" * 50_000), (9, "\t\n  x")]


def table(spark, rows):
    """Documents with extra columns named like results and like inner columns."""
    return spark.createDataFrame([(i, t, "en", 7, 1, True, "x", 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# token alignment


def aligned_by_hand(rows):
    """The contract, token by token, with the libraries' own encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    folder = token_alignment.FOLDER
    left = Tokenizer.from_file(f"{folder}/{token_alignment.BYTES}")
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{token_alignment.PIECES}")
    spelled = {i: k for k, i in token_alignment.byte_tokens(f"{folder}/{token_alignment.BYTES}").items()}
    piece = lambda i: bytes([int(right.id_to_piece(i)[1:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()

    def spans(tokens):
        ends = list(itertools.accumulate(map(len, tokens)))
        return list(zip([0, *ends], ends))

    out, held = [], Counter()
    for doc, text in rows:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        bytes_a, bytes_b = [spelled[i] for i in a], [piece(i) for i in b]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            out.append((doc, [], [], [], ""))
            continue
        at, bt = spans(bytes_a), spans(bytes_b)
        links, first = [], 0
        for i, (s, e) in enumerate(at):
            while bt[first][1] <= s:
                first += 1
            j = first
            while j < len(bt) and bt[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, x, y = [], 0, 0
        for end in sorted({e for _, e in at} & {e for _, e in bt}):
            u, v = x, y
            while u < len(at) and at[u][1] <= end:
                u += 1
            while v < len(bt) and bt[v][1] <= end:
                v += 1
            groups.append(f"{','.join(map(str, a[x:u]))}|{','.join(map(str, b[y:v]))}")
            x, y = u, v
        out.append((doc, a, b, links, ";".join(groups)))
        held.update(set(links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(d, len(a), len(b), g.count(";") + 1 if g else 0, len(k), sum(held[x] == most[x[0]] for x in k), sum(held[x] for x in k), sha(g)) for d, a, b, k, g in out]


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.mark.parametrize("frequent", [1 << 20, 100, 0])
def test_alignment_equals_brute_force(spark, docs, odd, frequent):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = aligned_by_hand([tuple(r) for r in rows.collect()])
    found = token_alignment.score_links(token_alignment.align(rows), frequent).select("doc_id", *COUNTS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_alignment_keeps_columns_and_odd_rows(odd, empty):
    got = token_alignment.score_links(token_alignment.align(odd))
    assert set(got.columns) == set(odd.columns) - {"text"} | {"groups", *COUNTS}
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ODD) and all(by[i][c] == 0 for i in (1, 2, 5) for c in COUNTS) and by[1]["groups"] == ""
    assert by[7]["n_a"] > 0 and by[6]["n_links"] >= 30_000 and by[7]["whole"] == 3
    assert token_alignment.score_links(token_alignment.align(empty)).count() == 0


# ranked search

TERM = re.compile(lexical_search.WORD)


def ranked_by_hand(rows, items, k=20):
    terms = lambda t: TERM.findall((t or "").translate(str.maketrans(lexical_search._UPPER, lexical_search._LOWER)))
    held = [(d, Counter(w), len(w)) for d, t in rows if (w := terms(t))]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("share", [0.0, 0.5, 100.0])
def test_search_equals_brute_force_whatever_is_accumulated(spark, docs, odd, monkeypatch, share):
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 150)
    monkeypatch.setattr(lexical_search, "STRIDE", 64)
    monkeypatch.setattr(lexical_search, "WINDOW", 16)
    monkeypatch.setattr(lexical_search, "QUERY_ROWS", 3)
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Word one ONE word words"), (-4, "unheardofterm"), (None, "null one")], "item_id long, text string")
    items = items.unionByName(extra)
    got = [tuple(r) for r in lexical_search.search(rows, items, budget_share=share).collect()]
    want = ranked_by_hand([tuple(r) for r in rows.collect()], [tuple(r) for r in items.collect()])
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(d is None for _, _, d, _ in want)


def test_search_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "one word")], "item_id long, text string")
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0


def test_search_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, "same words here") for i in range(60, 0, -1)] + [(100, "other")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "same same words")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical_search.search(rows, items).orderBy("rank").collect()] == list(range(1, 21))


# quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted_by_hand(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs, odd):
    extra = [(20, "a b c d e f g h " * 3), (21, "w " * 8), (22, "w " * 9), (23, "one\ntwo\n\none\r\none\n \n"), (24, "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8")]
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(odd.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    got = quality_rules.measured(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(r["doc_id"], *counted_by_hand(r["text"])) for r in rows.collect()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def labelled(spark, n=600):
    """Texts whose label follows two rules: many symbols, or capitals in short words; one in fifty is wrong."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice("gggsc")
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
        if kind == "s":
            words = [w + "#$" for w in words]
        if kind == "c":
            words = [w[:4].upper() for w in words]
        if kind == "g":
            words[3] += "%"  # a symbol alone is no fault
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == "g") if rng.random() > 0.02 else int(kind != "g")))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_list_finds_planted_rules(spark):
    docs, labels = labelled(spark)
    train = labels.where("doc_id < 400")
    got = quality_rules.judge(docs, train, precision=0.9).where("doc_id >= 400").join(labels, "doc_id")
    right = got.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right >= 0.95
    assert got.where("kept and rule is not null").count() == 0


def test_growth_and_pruning_by_hand(spark):
    found = quality_rules._best([{"name": "words", "cell": 0, "p": 8, "n": 0}, {"name": "words", "cell": 1, "p": 2, "n": 10}], {"words": [5.0]}, (10, 10))
    assert found[1] == quality_rules.Literal("words", False, 5.0) and found[0] == pytest.approx(8 * 1.0)
    rows = spark.createDataFrame([(30, 1, True, 1.0), (0, 40, True, 3.0), (12, 0, False, 1.0), (1, 20, False, 3.0)], "p long, n long, prunes boolean, words double")
    rule = [quality_rules.Literal("words", False, 2.0), quality_rules.Literal("words", True, 0.0)]
    assert quality_rules._pruned(rows, rule, {"words": F.col("words")}, 0.9, 10) == rule[:1]
    assert quality_rules._pruned(rows, rule, {"words": F.col("words")}, 0.99, 10) == []


def test_list_is_one_ordered_conditional(spark):
    a, b = quality_rules.Literal("words", False, 10.0), quality_rules.Literal("words", False, 20.0)
    rows = spark.createDataFrame([(5,), (15,), (25,)], "n_words long")
    rows = rows.select(*[(F.col("n_words") if c == "n_words" else F.lit(0)).alias(c) for c in quality_rules.COUNTS])
    assert [r[0] for r in rows.select(quality_rules.as_column([[a], [b]])).collect()] == ["words <= 10", "words <= 20", None]


def test_judge_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, None), (99, 0), (None, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(odd, labels).collect()}
    assert len(got) == 10 and quality_rules.judge(odd, labels).count() == len(ODD)
    assert got[1]["base_failed"] and not got[1]["kept"] and got[6]["n_repeat_words"] == 30_000 and got[6]["lang"] == "en"
    assert quality_rules.judge(odd, labels.limit(0)).where("rule is not null").count() == 0
    assert quality_rules.judge(empty, labels).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    judged = QUERIES["op13_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()


def test_quality_rules_run_without_python(spark):
    plan = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    measured = quality_rules.measured(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan + measured)


# complete URL rules


def rules_by_hand(rows, support, confidence, least):
    rows = [(frozenset(t), label == "block") for t, label in rows]
    hits = max(least, math.ceil(support * len(rows) - 1e-9))
    same: dict = {}
    for t in sorted({x for r, _ in rows for x in r}):
        same.setdefault(tuple(i for i, (r, _) in enumerate(rows) if t in r), t)
    asked = {frozenset(c) for t, _ in set(rows) for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k) if k == 1 or set(c) <= set(same.values())}
    rules = []
    for c in asked:
        held = [bad for t, bad in rows if c <= t]
        for verdict, n in (("block", sum(held)), ("allow", len(held) - sum(held))):
            if n >= hits and n / len(held) >= confidence:
                rules.append((c, verdict, n / len(held)))
    return {(tuple(sorted(c)), v) for c, v, x in rules if not any(d < c and w == v and y >= x for d, w, y in rules)}


def wide_rows(seed):
    rng = random.Random(seed)
    tokens = [f"t{i:02d}" for i in range(13)]
    rows = []
    for _ in range(90):
        some = sorted(rng.sample(tokens, rng.randrange(3, 11)))
        five = set(tokens[1:6]) <= set(some)
        rows += [(some, "block" if five or {"t06", "t07"} <= set(some) or rng.random() < 0.2 else "allow")] * rng.choice((1, 1, 3))
    hot = sorted(rng.sample(tokens, 11))
    return rows + [(hot, "block")] * 12 + [(hot[:-2], "allow")] * 5


@pytest.mark.parametrize("widest", [10, 2])
def test_rules_are_complete_for_wide_rows(spark, widest):
    rows = wide_rows(5)
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.01, 0.9, 5, widest)
    assert {(tuple(r["tokens"]), r["verdict"]) for r in got.collect()} == rules_by_hand(rows, 0.01, 0.9, 5)


def test_a_rule_beside_twelve_stronger_tokens_is_found(spark):
    s = [f"s{i}" for i in range(12)]
    rows = [(["x", "y", *s], "block")] * 200 + [(["x", *s[:6]], "allow")] * 180 + [(["y", *s[6:]], "allow")] * 180 + [([t], "block") for t in s] * 30
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert (["x", "y"], "block") in [(r["tokens"], r["verdict"]) for r in got.collect()]


def test_tokens_with_spaces_do_not_share_a_name(spark):
    rows = [(["a b", "c"], "block")] * 20 + [(["a", "b c"], "allow")] * 20 + [(["a b"], "allow"), (["c"], "allow"), (["a"], "block"), (["b c"], "block")] * 8
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert {(tuple(r["tokens"]), r["verdict"]) for r in got.collect()} >= {(("a b", "c"), "block"), (("a", "b c"), "allow")}
    assert got.select("rule").distinct().count() == got.count()


# scores at the ends of the long range


@pytest.mark.parametrize("large", [[1e10, 2.0], [1e8, -1e8], [1e18, 3e17], [3e38, -3e38], [2.0**57 / 64, 2.0**57 / 64], [1e308, 1e308]])
def test_large_components_keep_all_ranks(spark, large):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(60)]
    rows[7], rows[20] = (7, large), (20, [v / 2 for v in large])
    rows += [(100 + i, [2.0**55 / 64 * (1 + i / 9), 2.0**56 / 64 + i]) for i in range(9)]
    most = topk_search._MOST
    whole = {i: [math.floor(64 * x) if abs(64 * x) < 2**52 else int(max(-most, min(most, 64 * x))) for x in v] for i, v in rows}
    score = lambda a, b: max(-topk_search.TOP, min(topk_search.TOP, sum(x * y for x, y in zip(whole[a], whole[b]))))
    want = [(q, r + 1, c, s) for q in whole if q % 20 == 0 for r, (s, c) in enumerate((-a, b) for a, b in sorted((-score(q, c), c) for c in whole if c != q)[:20])]
    got = topk_search.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_vectors_no_ranks(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<double>, rank int, score long, id long")
    assert topk_search.exact_top_k(rows, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0], 2, 3, 4)], rows.schema)
    assert topk_search.exact_top_k(one, F.col("vec_id") % 20 == 0).count() == 0


# very long texts of earlier operators


def test_long_texts_of_earlier_operators(spark):
    long = "filler words go here " * 60_000 + "Under the MIT license."
    rows = spark.createDataFrame([(1, long), (2, "x " + long)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan(rows).collect()}
    assert found[1]["last_word"] == 240_000 and found[2]["base_labels"] == "mit"
    left = {r["doc_id"]: r for r in substring_dedup.remove_repeated_windows(rows, keep_text=False).collect()}
    assert left[2]["n_words"] == 240_005 and left[2]["n_removed"] >= 240_000 - 50
