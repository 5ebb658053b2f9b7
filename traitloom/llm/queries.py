"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import crf_langid, entropy_mix, lexical_search, license_scan, markov_secrets, odd_minhash, quality_rules, sp_lattice, substring_dedup, token_alignment, topk_search, url_rules, wav_media
from ._common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def op6_substring_dedup(spark, sf_dir):
    """Words of ``documents`` left after removing repeated 50-word windows."""
    return substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), keep_text=False)


QUERIES["op6_substring_dedup"] = op6_substring_dedup
ORACLE_SQL["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
bad AS (SELECT doc_id, i FROM win JOIN least_doc USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM bad, (SELECT unnest(range(0, 50)) AS o)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op7_odd_minhash(spark, sf_dir):
    """Near-duplicate components of ``documents`` on two-word shingles at 0.8."""
    return odd_minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


QUERIES["op7_odd_minhash"] = op7_odd_minhash
ORACLE_SQL["op7_odd_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a),
low AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d JOIN low ON low.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op5_wav_media(spark, sf_dir):
    """Digests of every text of ``documents`` stored as WAV and read back."""
    heard = wav_media.fingerprint(wav_media.store(table(spark, sf_dir, "documents")))
    return heard.select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%d:%016x", F.size("peaks"), F.xxhash64("peaks")).alias("feature"),
    )


QUERIES["op5_wav_media"] = op5_wav_media


def op10_topk_search(spark, sf_dir):
    """The 20 highest inner products of every 20th vector of ``embeddings``."""
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES["op10_topk_search"] = op10_topk_search
ORACLE_SQL["op10_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""


def equals(i: int):
    """A condition on one array element."""
    return lambda x: x == i


def op9_markov_secrets(spark, sf_dir):
    """Secret spans of every text of ``documents``."""
    found = markov_secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda b: b["kind"])
    count = [F.size(F.filter(kinds, equals(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(markov_secrets.KINDS[:3])]
    return found.select("doc_id", *count, F.sha2(markov_secrets.as_text(F.col("base")), 256).alias("base_sha256"), markov_secrets.as_text(F.col("spans")).alias("spans"))


QUERIES["op9_markov_secrets"] = op9_markov_secrets


def op2_license_scan(spark, sf_dir):
    """License labels of every text of ``documents``."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES["op2_license_scan"] = op2_license_scan


def _license_sql() -> str:
    """Every template as a row of DuckDB lists, met with ``w``, the words of a text."""

    def words(items):
        return "[" + ", ".join(f"'{x}'" for x in items) + "]"

    rows = []
    for t in license_scan.templates():
        (at, key), *others = t["keys"]
        placed = "[" + ", ".join(f"{{'pos': {k - at}, 'key': {words(other)}}}" for k, other in others) + "]" if others else "CAST([] AS STRUCT(pos INTEGER, key VARCHAR[])[])"
        rows.append(f"('{t['label']}', {t['base']}, {at}, {words(key)}, {placed}, {words(t['words'])})")
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, base, pos, key, others, passage) AS (VALUES {", ".join(rows)}),
start AS (SELECT doc_id, w, t.*, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = key[1] AND w[i:i + len(key) - 1] = key)) AS i FROM d JOIN t ON list_has_all(w, key)),
hit AS (SELECT doc_id, i - 1 AS p, label, base,
               len(list_filter(range(1, len(passage) + 1), lambda k: i - pos + k - 1 >= 1 AND w[i - pos + k - 1] = passage[k])) / CAST(len(passage) AS DOUBLE) AS share
        FROM start WHERE len(list_filter(others, lambda o: i + o.pos >= 1 AND w[i + o.pos:i + o.pos + len(o.key) - 1] = o.key)) = len(others)),
place AS (SELECT * FROM hit WHERE share >= 0.6)
SELECT d.doc_id, len(w) AS n_words, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN place USING (doc_id) GROUP BY d.doc_id, w
"""


ORACLE_SQL["op2_license_scan"] = _license_sql()


def op4_entropy_mix(spark, sf_dir):
    """The mix of all ``documents`` whose sources weigh 5, 2, 1."""
    return entropy_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op4_entropy_mix"] = op4_entropy_mix


def op1_crf_langid(spark, sf_dir):
    """Language of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = crf_langid.train(docs.select("doc_id", "text", "lang"))
    return crf_langid.identify(docs, model).select("doc_id", crf_langid.held_out().alias("held_out"), "lang_pred", "score", "n_words", "segments")


QUERIES["op1_crf_langid"] = op1_crf_langid


def op3_url_rules(spark, sf_dir):
    """Verdict on the URL of every row of ``pages``."""
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES["op3_url_rules"] = op3_url_rules


def op8_sp_lattice(spark, sf_dir):
    """Sampled pieces of every text of ``documents``, and the text they decode to."""
    decoded = sp_lattice.round_trip(table(spark, sf_dir, "documents"))
    return decoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.sha2("text", 256).alias("text_sha256"))


QUERIES["op8_sp_lattice"] = op8_sp_lattice


def op13_quality_rules(spark, sf_dir):
    """Counts and verdict of the learned decision list for every text of ``documents``."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES["op13_quality_rules"] = op13_quality_rules


def op12_lexical_search(spark, sf_dir):
    """The 20 highest-scoring documents of every ``benchmark`` item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op12_lexical_search"] = op12_lexical_search
ORACLE_SQL["op12_lexical_search"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
held AS (SELECT doc_id, r, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS (SELECT doc_id, r, n, term, count(*) AS times FROM (SELECT doc_id, r, n, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, n_docs),
scored AS (SELECT item_id, doc_id, r, sum(repeats * weight * ((1000000000 * times) // (1000 * times + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))))) AS score
           FROM tf JOIN weight USING (term) JOIN asked USING (term), total GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0) WHERE k <= 20
"""


def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizers over every text of ``documents``."""
    aligned = token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    digested = aligned.withColumn("groups_sha256", digest).drop("groups")
    return token_alignment.score_links(digested).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES["op11_token_alignment"] = op11_token_alignment
