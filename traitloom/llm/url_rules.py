"""URL filtering by listed rules and by mined association rules.

Listed rules (host, path prefix) decide the pages they fit; the longest wins.
For all others, rules are mined from labelled URLs: FP-growth finds
combinations of URL tokens and a label, and rules from tokens to a label are
kept by support and confidence.  Kept rules are matched through an inverted
index: a URL's tokens are joined with the index, and a rule fires where all its
tokens were met.  Tokens are looked up once per distinct URL, so hot URLs cost
no more than others.

A URL of many tokens that occurs often has exponentially many frequent
combinations, nearly all of which say nothing new.  What says nothing new is
taken away before the search, without loss: single tokens are counted exactly
by an aggregation, and those whose rows all have one label need no company;
tokens that occur in exactly the same rows are one item; an item of all rows
tells nothing.  Where rows still have more than ``WIDEST`` items, the search
goes on in projections: the rows that hold an item, with the more frequent
items beside it.  More says nothing new there, and is taken away again: after
two or three items, a hot URL's others are mostly in all rows.
Every combination belongs to one projection, so none is lost.  All projections
of one depth are handled by the same jobs.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

# The listed rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Items of a row up to which FP-growth searches a projection; wider ones are projected further.  Rules do not depend on it.
WIDEST = 10
_LABEL = "="  # no token holds it
_COPIES = 10_000  # of one token set that one row is spread to
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; null where none fits.

    A rule fits its host and all subdomains where the path starts with its own.
    """
    name = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, path words and query keys, each marked by its part."""
    host = F.filter(F.split(host_of(url), r"\."), lambda t: t != "")
    path = F.filter(F.regexp_extract_all(path_of(url), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: ~F.regexp_like(t, F.lit("^[0-9]+$")))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1))
    mark = lambda part, items: F.transform(items, lambda t: F.concat(F.lit(part), F.replace(t, F.lit(_LABEL), F.lit(""))))
    return F.array_distinct(F.concat(mark("h:", host), mark("p:", path), mark("q:", keys)))


def _counted(sets: DataFrame, sought: DataFrame) -> DataFrame:
    """(tokens, n, bad): rows of ``sets(set_id, tokens, n, bad)`` that hold all tokens of each combination."""
    index = sought.select("rule", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    met = sets.select("set_id", "n", "bad", F.explode("tokens").alias("token")).join(index, "token")
    whole = met.groupBy("set_id", "rule", "needed").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("bad").alias("bad")).where("met = needed")
    return sought.join(whole.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "rule").select("tokens", "n", "bad")


def _rules(counted: DataFrame, rows: int, support: float, confidence: float, least: int) -> DataFrame:
    """Rules (rule, verdict, tokens, confidence, support) of the labels that a counted combination supports."""
    said = F.explode(F.array(F.struct(F.lit("block").alias("verdict"), F.col("bad").alias("hits")), F.struct(F.lit("allow").alias("verdict"), (F.col("n") - F.col("bad")).alias("hits"))))
    out = counted.select("rule", "tokens", "n", said.alias("s")).select("rule", "tokens", "s.verdict", (F.col("s.hits") / F.col("n")).alias("confidence"), F.col("s.hits").alias("hits"))
    return out.where((F.col("hits") >= least) & (F.col("hits") >= support * rows) & (F.col("confidence") >= confidence)).select("rule", "verdict", "tokens", "confidence", (F.col("hits") / rows).alias("support"))


def _named(tokens: Column) -> Column:
    """One text for a combination; spaces in tokens are escaped, so that no two share it."""
    return F.array_join(F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("\\ "))), " ")


def _pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that a rule on fewer of their tokens makes needless: it says the same at the same confidence or better.

    A rule is looked up under the one of its tokens that fewest rules hold.
    """
    tokens = rules.select("rule", "verdict", "tokens", "confidence", F.explode("tokens").alias("token"))
    use = tokens.groupBy("token").agg(F.count("*").alias("uses"))
    rare = tokens.join(use, "token").groupBy("rule", "verdict").agg(F.min_by("token", F.struct("uses", "token")).alias("token"), F.first("tokens").alias("part"), F.first("confidence").alias("reached"))
    met = tokens.join(rare.select("verdict", "token", "part", "reached"), ["token", "verdict"])
    needless = met.where((F.size("part") < F.size("tokens")) & (F.col("reached") >= F.col("confidence")) & (F.size(F.array_intersect("part", "tokens")) == F.size("part")))
    return rules.join(needless.select("rule", "verdict").distinct(), ["rule", "verdict"], "left_anti")


def _projected(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """One depth of the search in ``rows(prefix, set_id, n, bad, items)``: exact counts (tokens, n, bad) of prefixes with
    one more item, and the rows with the items that can still tell something beside others, most frequent first."""
    each = rows.select("prefix", "set_id", "n", "bad", F.explode("items").alias("token"))
    whole = rows.groupBy("prefix").agg(F.sum("n").alias("whole"))
    tokens = each.groupBy("prefix", "token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).alias("mark"))
    tokens = cut(tokens.where(F.greatest(F.col("bad"), F.col("n") - F.col("bad")) >= least).join(whole, "prefix"))
    alike = F.when(F.size("prefix") == 0, F.struct("bad", "mark"))  # tokens of the same rows are one item, in the whole table only
    telling = tokens.where("bad > 0 and bad < n and n < whole").groupBy("prefix", "n", alike.alias("alike"), F.when(F.size("prefix") > 0, F.col("token")).alias("own"))
    telling = telling.agg(F.min("token").alias("token"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("all")).alias("a"), "token")))
    items = each.join(telling.select("prefix", "token", F.col("n").alias("all")), ["prefix", "token"])
    left = items.groupBy("prefix", "set_id").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), order["token"].alias("items"))
    return tokens.select(F.array_sort(F.array_append("prefix", F.col("token"))).alias("tokens"), "n", "bad"), cut(left.where(F.size("items") > 1))


def _transactions(rows: DataFrame) -> DataFrame:
    """A row of items per labelled URL, as FP-growth knows no weights; items carry their prefix, so that projections stay apart."""
    label = lambda said: F.concat("marked", F.array(F.lit(_LABEL + said)))
    prefix = F.col("prefix")
    marked = rows.withColumn("marked", F.transform("items", lambda t: F.to_json(F.struct(prefix.alias("prefix"), t.alias("token")))))
    both = marked.select(F.col("bad").alias("copies"), label("block").alias("items")).unionAll(marked.select(F.col("n") - F.col("bad"), label("allow")))
    # blocks keep one set's copies apart
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _COPIES)))
    spread = both.where("copies > 0").select("items", "copies", block.alias("block")).repartition(F.col("items"), F.col("block"))
    return cut(spread.select("items", F.explode(F.sequence(F.lit(1), F.least(F.lit(_COPIES), F.col("copies") - F.col("block") * _COPIES))).alias("nth")).select("items"))


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.9, least: int = 10, widest: int = WIDEST) -> DataFrame:
    """Pruned rules (rule, verdict, tokens, confidence, support) from ``labelled(tokens, label)``.

    Labels are ``allow`` and ``block``; ``support`` is a share of the labelled
    rows, and of at least ``least`` rows.  A rule is dropped where a rule on
    fewer of its tokens says the same at the same confidence or better.

    Rules are complete, however many tokens they or rows have, and do not
    depend on ``widest``.  Of tokens that occur in exactly the same rows, rules
    of several tokens name the first in code point order.  Null labels and rows
    without tokens teach nothing; an empty table gives no rules.
    """
    rows = labelled.where("label is not null").select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), (F.col("label") == "block").cast("long").alias("bad"))
    sets = rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    sets = cut(sets.select(F.xxhash64("tokens").alias("set_id"), "tokens", "n", "bad"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hits = max(least, ceil(support * total - 1e-9))

    counted, ready, depth = None, None, sets.select(F.array().cast("array<string>").alias("prefix"), "set_id", "n", "bad", F.col("tokens").alias("items"))
    while True:
        single, left = _projected(depth, hits)
        counted = single if counted is None else counted.unionByName(single)
        wide = left.groupBy("prefix").agg(F.max(F.size("items")).alias("width")).where(F.col("width") > widest).select("prefix")
        narrow = left.join(wide, "prefix", "left_anti")
        ready = narrow if ready is None else ready.unionByName(narrow)
        at = F.posexplode("items").alias("at", "last")
        depth = left.join(wide, "prefix", "left_semi").select("prefix", "set_id", "n", "bad", "items", at).where("at > 0")
        depth = cut(depth.select(F.array_append("prefix", F.col("last")).alias("prefix"), "set_id", "n", "bad", F.expr("slice(items, 1, at)").alias("items")))
        if depth.isEmpty():
            break
    transactions = _transactions(ready)
    there = transactions.count()
    if there:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (hits - 0.5) / there), minConfidence=0.0).fit(transactions)
        marks = F.transform(F.filter("items", lambda t: ~t.startswith(_LABEL)), lambda t: F.from_json(t, "prefix array<string>, token string"))
        found = model.freqItemsets.select(marks.alias("marks"), "items").where((F.size("marks") < F.size("items")) & (F.size("marks") > 1))
        found = found.select(F.array_sort(F.concat(F.col("marks")[0]["prefix"], F.col("marks")["token"])).alias("tokens")).distinct()
        counted = counted.unionByName(_counted(sets, cut(found.select(_named(F.col("tokens")).alias("rule"), "tokens"))))
    named = counted.withColumn("rule", _named(F.col("tokens"))).dropDuplicates(["rule"])
    return _pruned(cut(_rules(named, total, support, confidence, least)))


def fire(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The strongest firing rule of each distinct URL: (url, mined_rule, mined_verdict), others absent.

    ``urls`` has url and tokens.  Strength: confidence, then support, then the
    longer token set, then ``block`` before ``allow``, then the rule's name.
    """
    index = rules.select("rule", "verdict", F.size("tokens").alias("needed"), "confidence", "support", F.explode("tokens").alias("token"))
    met = urls.select("url", F.explode("tokens").alias("token")).join(index, "token")
    whole = met.groupBy("url", "rule", "verdict", "needed", "confidence", "support").agg(F.count("*").alias("n")).where("n = needed")
    strength = F.struct("confidence", "support", "needed", "verdict", "rule")
    best = whole.groupBy("url").agg(F.max(strength).alias("best"))
    return best.select("url", F.col("best.rule").alias("mined_rule"), F.col("best.verdict").alias("mined_verdict"))


def labelled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url)`` that a listed rule decides: page_id, url, tokens, label."""
    _, said = listed(host_of(F.col("url")), path_of(F.col("url")), rules)
    return pages.select("page_id", "url", tokens_of(F.col("url")).alias("tokens"), said.alias("label")).where("label is not null and size(tokens) > 0")


def held_out_scores(pages: DataFrame, rules=RULES, support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """How mined rules fare on labelled pages they were not mined from: one row (n, fired, precision, recall).

    Pages whose crc32(page_id as text) mod 5 is 0 are held out.  precision is
    the share of right verdicts among held-out pages that a mined rule
    blocks, recall the share of pages to be blocked that it blocks.
    """
    known = cut(labelled(pages, rules).withColumn("held", F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))))
    held = known.where("held")
    fired = fire(held.select("url", "tokens").distinct(), mine(known.where("not held").select("tokens", "label"), support, confidence))
    said, true = F.col("mined_verdict") == "block", F.col("label") == "block"
    return held.join(fired, "url", "left").agg(
        F.count("*").alias("n"), F.count("mined_verdict").alias("fired"),
        (F.count_if(said & true) / F.count_if(said)).alias("precision"), (F.count_if(said & true) / F.count_if(true)).alias("recall"),
    )


def judge(pages: DataFrame, rules=RULES, support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """Verdict on every page's URL.

    ``pages`` needs page_id and url; other columns are ignored.  Mining learns
    from the pages that a listed rule decides.  Result per row: page_id, host,
    path, rule (of the list, else null), verdict (the list's, else the firing
    mined rule's, else allow) and mined_rule.

    A null URL or one without ``://`` has empty host and path, fits no rule
    and is allowed unless mined rules on its other tokens fire.  Null ids are
    judged like others.  Repeated pages are judged alike; an empty table gives
    an empty result.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    name, said = listed(host_of(F.col("url")), path_of(F.col("url")), rules)
    urls = base.where("url is not null").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    fired = cut(fire(urls, mine(labelled(base, rules).select("tokens", "label"), support, confidence)))  # written, so that a hot URL's pages can be split
    out = base.join(fired, "url", "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), name.alias("rule"), F.coalesce(said, "mined_verdict", F.lit("allow")).alias("verdict"), "mined_rule")
