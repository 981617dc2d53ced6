"""Entity resolution: mentions to firms by exact key, alias, then scored candidates.

Rungs 1 and 2 are equi-joins with deduplicated keys. Rung 3 requires a shared
distinctive word, so candidates come from an equi-join of distinct keys on exploded
words, split where very many mentions share a word. Lengths and character counts bound a
pair's score; subsequences are worked out only where they can matter, once for each two
texts, over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import fuzzy, naming
from plinth.operators.upsert import first_rows, new_only
from plinth.schemas import row_id
from plinth.session import kept, spread

# Thresholds.
AUTO_ACCEPT, REVIEW_FLOOR, BONUS, SORT_FLOOR, MOST_CANDIDATES, TIE = 92.0, 80.0, 12.0, 60.0, 25, 2.0
#: Mentions of one word that one task meets with its firms; shares over which the firms of one name are ranked first.
SPLIT, SHARES = 4096, 64
#: Rarest trigrams of a key that are looked up first.
SEEDS = 3
_PARTS = ("__shared", "__first", "__second")
CANDIDATE = "firm_id string, name string, score double, effective double, corroborated boolean, corroboration array<string>"


def firm_records(firms: DataFrame, aliases: DataFrame, permits: DataFrame | None = None) -> DataFrame:
    """id, name, canonical_name, aliases, address, phone, parcel_ids: what the resolver needs of each firm."""
    named = aliases.groupBy(F.col("firm_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    out = firms.select("id", "name", "canonical_name", F.col("hq_address").alias("address"), "phone").join(named, "id", "left")
    if permits is None:
        out = out.withColumn("parcel_ids", F.array().cast("array<string>"))
    else:
        parcels = permits.where("firm_id IS NOT NULL AND parcel_id IS NOT NULL").groupBy(F.col("firm_id").alias("id")).agg(F.array_sort(F.collect_set("parcel_id")).alias("parcel_ids"))
        out = out.join(parcels, "id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"aliases": F.coalesce("aliases", empty), "parcel_ids": F.coalesce("parcel_ids", empty)})


def exact_and_alias(mentions: DataFrame, firms: DataFrame) -> DataFrame:
    """``mentions`` (with canonical) and exact_id, alias_id: the first firm, by id, with that key or alias."""
    exact = firms.where("canonical_name <> ''").groupBy(F.col("canonical_name").alias("canonical")).agg(F.min("id").alias("exact_id"))
    named = firms.select("id", F.explode("aliases").alias("alias")).withColumn("canonical", naming.canonicalize(F.col("alias"))).where("canonical <> ''")
    alias = named.groupBy("canonical").agg(F.min("id").alias("alias_id"))
    return mentions.join(exact, "canonical", "left").join(alias, "canonical", "left")


def _met(m: DataFrame, f: DataFrame, on: str, key: str) -> DataFrame:
    """Inner join of ``m`` and ``f`` on a value that very many rows may have: those of ``m`` are dealt over salts by ``key``, as many as each value needs, and only its rows of ``f`` are copied."""
    salts = m.groupBy(on).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("__n"))
    m = m.join(salts, on).withColumn("__salt", F.pmod(F.xxhash64(key), F.col("__n")).cast("int")).drop("__n")
    f = f.join(salts, on).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    # Few rows make many pairs, so the tasks are told apart by number and not merged by their sizes.
    n = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return m.repartition(n, on, "__salt").join(f.repartition(n, on, "__salt"), [on, "__salt"]).drop("__salt")


def met_pairs(mentions: DataFrame, firms: DataFrame) -> DataFrame:
    """canonical, canonical_name and their words (__a, __b): distinct keys that share a distinctive word, each pair once, at the first such word.

    A word of more than ``SPLIT`` mentions is many tasks' work: they are dealt over as many
    salts as they need, and only the firms of such a word are copied.
    """
    each = lambda df, key, words, all_: df.where(f"{key} <> ''").select(key).distinct().withColumns({words: naming.distinctive_words(F.col(key)), all_: fuzzy.set_words(F.col(key))})
    m, f = each(mentions, "canonical", "__m", "__a"), each(firms, "canonical_name", "__f", "__b")
    m, f = (x.withColumn("token", F.explode(words)) for x, words in ((m, "__m"), (f, "__f")))
    met = _met(m, f, "token", "canonical")
    return met.where(F.col("token") == F.array_min(F.array_intersect("__m", "__f"))).select("canonical", "canonical_name", "__a", "__b")


def open_pairs(met: DataFrame, floor: float) -> DataFrame:
    """The pairs that may score ``floor``: canonical, canonical_name, __shared, __first, __second (token_set_parts), __known, __need, __may.

    Lengths tell a part of the score (__known). __may is whether a common subsequence of
    the words that a pair doesn't share, of __need characters at least, can raise it.
    """
    # A generator holds the parts, so that the conditions on them don't work them out again.
    p = met.select("canonical", "canonical_name", F.inline(F.array(fuzzy.token_set_parts(F.col("__a"), F.col("__b")))))
    p = p.select("canonical", "canonical_name", F.col("shared").alias("__shared"), F.get("texts", F.lit(0)).alias("__first"), F.get("texts", F.lit(1)).alias("__second"))
    p = p.withColumn("__known", fuzzy.token_set_known(*_PARTS))
    p = p.withColumn("__need", fuzzy.token_set_need(*_PARTS, F.greatest(F.col("__known"), F.lit(floor))))
    # A subsequence is no longer than the shorter text; a score of 100 can't rise.
    may = (F.col("__known") < 100) & (F.col("__need") <= F.least(F.length("__first"), F.length("__second")))
    return p.withColumn("__may", may).where((F.col("__known") >= floor) | F.col("__may"))


def subsequences(pairs: DataFrame) -> DataFrame:
    """__first, __second, __common: each two texts once, however many pairs have them, and only if the characters that both have don't rule a rise out."""
    texts = pairs.where("__may").groupBy("__first", "__second").agg(F.min("__need").alias("__need"))
    return texts.select("__first", "__second", fuzzy.lcs_column(F.col("__first"), F.col("__second"), F.col("__need")).alias("__common")).where("__common IS NOT NULL")


def scored_pairs(met: DataFrame, floor: float) -> DataFrame:
    """canonical, canonical_name, score: the pairs whose token-set score is ``floor`` or more."""
    p = kept(open_pairs(met, floor), "pairs")  # read twice
    scored = p.where("__may").join(subsequences(p), ["__first", "__second"], "left").withColumn("score", fuzzy.token_set_score(*_PARTS, F.col("__common")))
    sure = p.where("NOT __may").withColumn("score", F.col("__known"))
    return scored.where(F.col("score") >= floor).select("canonical", "canonical_name", "score").unionByName(sure.select("canonical", "canonical_name", "score"))


def _first_ids(firms: DataFrame, most: int) -> DataFrame:
    """canonical_name, firm_id: of each name the ``most`` firms with the smallest ids; a name of very many firms is ranked over shares first."""
    f = firms.select("canonical_name", F.col("id").alias("firm_id")).withColumn("__share", F.pmod(F.xxhash64("firm_id"), F.lit(SHARES)))
    for by in (["canonical_name", "__share"], ["canonical_name"]):
        f = f.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("firm_id"))).where(F.col("__n") <= most)
    return f.select("canonical_name", "firm_id")


def best_firms(scored: DataFrame, firms: DataFrame, most: int) -> DataFrame:
    """canonical, canonical_name, score, firm_id: of each key of ``scored`` (canonical, canonical_name, score) the ``most`` firms with the best scores, then the smallest ids.

    A name that as many others come before, by score and their firms' smallest ids, has
    none of these firms, so only the ``most`` first names of a key are met with all their firms.
    """
    ids = _first_ids(firms, most)
    named = scored.join(ids.groupBy("canonical_name").agg(F.min("firm_id").alias("firm_id")), "canonical_name")
    best = Window.partitionBy("canonical").orderBy(F.desc("score"), "firm_id")
    first = lambda df: df.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most).drop("__n")
    return first(first(named).drop("firm_id").join(ids, "canonical_name"))


def scored_candidates(mentions: DataFrame, firms: DataFrame, floor: float = REVIEW_FLOOR) -> DataFrame:
    """mention_id and candidates (by effective score, then id) of mentions (mention_id, canonical, text, address, phone, parcel_id)."""
    named = best_firms(scored_pairs(met_pairs(mentions, firms), floor), firms, MOST_CANDIDATES)
    named = named.where(fuzzy.token_sort_column(F.col("canonical"), F.col("canonical_name")) >= SORT_FLOOR).select("canonical", "firm_id", "score")
    told = firms.select(F.col("id").alias("firm_id"), "name", F.col("address").alias("firm_address"), F.col("phone").alias("firm_phone"), "parcel_ids")
    pairs = mentions.select("mention_id", "canonical", "address", "phone", "parcel_id").join(named.join(told, "firm_id"), "canonical")
    evidence = F.array_compact(
        F.array(
            F.when(naming.normalize_phone(F.col("phone")) == naming.normalize_phone(F.col("firm_phone")), "phone"),
            F.when(naming.normalize_address(F.col("address")) == naming.normalize_address(F.col("firm_address")), "address"),
            F.when((F.col("parcel_id") != "") & F.array_contains("parcel_ids", F.col("parcel_id")), "parcel"),
        )
    )
    effective = F.least(F.lit(100.0), F.col("score") + F.when(F.size("corroboration") > 0, BONUS).otherwise(0.0))
    # A mention's candidates hold much that compresses well, so their tasks are told apart by number and not merged by their sizes.
    pairs = spread(pairs, "mention_id").withColumn("corroboration", evidence).withColumn("effective", effective)
    one = F.struct((-F.col("effective")).alias("order"), F.col("firm_id").cast("string").alias("firm_id"), "name", "score", "effective", (F.size("corroboration") > 0).alias("corroborated"), "corroboration")
    ranked = pairs.groupBy("mention_id").agg(F.sort_array(F.collect_list(one)).alias("c"))
    return ranked.select("mention_id", F.transform("c", lambda x: F.struct(*[x[k].alias(k) for k in ("firm_id", "name", "score", "effective", "corroborated", "corroboration")])).alias("candidates"))


def resolve(mentions: DataFrame, firms: DataFrame, auto_accept: float = AUTO_ACCEPT, floor: float = REVIEW_FLOOR, adjudicator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each mention's status, firm_id, method, confidence, candidates and reason.

    ``mentions``: mention_id, text, address, phone, parcel_id. ``firms``: as of
    :func:`firm_records`. ``adjudicator`` maps (mention_id, text, candidates) to
    (mention_id, chosen_id, certainty, rationale) for mentions that scores leave open.
    """
    # Both are read several times and a small file of them is one task, so they are dealt and stored, with their keys, once.
    mentions = spread(mentions.select("mention_id", "text", "address", "phone", "parcel_id"), "mention_id")
    keyed = kept(mentions.withColumn("canonical", naming.canonicalize(F.coalesce("text", F.lit("")))), "mentions")
    firms = kept(spread(firms.select("id", "name", "canonical_name", "aliases", "address", "phone", "parcel_ids"), "id"), "firms")
    rungs = exact_and_alias(keyed, firms)
    open_ = rungs.where("canonical <> '' AND exact_id IS NULL AND alias_id IS NULL")
    told = rungs.join(scored_candidates(open_, firms, floor), "mention_id", "left")
    best, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    told = told.withColumn("tie", F.coalesce(F.abs(best["effective"] - second["effective"]) < TIE, F.lit(False)))
    accepted = (best["effective"] >= auto_accept) & ~F.col("tie")
    if adjudicator is not None:
        asked = told.where(F.col("candidates").isNotNull() & ~accepted).select("mention_id", "text", "candidates")
        told = told.join(adjudicator(asked), "mention_id", "left")
    else:
        told = told.withColumns({"chosen_id": F.lit(None).cast("string"), "certainty": F.lit(None).cast("double"), "rationale": F.lit(None).cast("string")})
    cases = [
        (F.col("canonical") == "", ("unmatched", None, None, 0.0, F.lit("mention normalized to empty"))),
        (F.col("exact_id").isNotNull(), ("resolved", F.col("exact_id").cast("string"), F.lit("exact"), 1.0, F.lit("canonical name matched exactly"))),
        (F.col("alias_id").isNotNull(), ("resolved", F.col("alias_id").cast("string"), F.lit("alias"), 1.0, F.lit("matched a known alias"))),
        (F.col("candidates").isNull(), ("unmatched", None, None, 0.0, F.lit("no candidate above the review floor"))),
        (
            accepted,
            (
                "resolved",
                best["firm_id"],
                F.when(best["corroborated"], "corroborated").otherwise("fuzzy"),
                best["effective"] / 100,
                F.concat(F.lit("fuzzy score "), F.format_string("%.1f", best["score"]), F.when(best["corroborated"], F.concat(F.lit(" corroborated by "), F.array_join(best["corroboration"], ", "))).otherwise("")),
            ),
        ),
        (F.col("chosen_id").isNotNull(), ("resolved", F.col("chosen_id"), F.lit("llm"), F.col("certainty"), F.col("rationale"))),
    ]
    doubt = F.when(F.col("tie"), "top candidates too close to separate").otherwise(F.concat(F.lit("best score "), F.format_string("%.1f", best["effective"]), F.lit(" below auto-accept")))
    last = ("ambiguous", None, None, 0.0, F.coalesce("rationale", doubt))
    names = ("status", "firm_id", "method", "confidence", "reason")
    kinds = ("string", "string", "string", "double", "string")
    columns = {}
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        value = None
        for condition, values in cases:
            v = values[i] if not isinstance(values[i], (str, float, type(None))) else F.lit(values[i])
            value = F.when(condition, v) if value is None else value.when(condition, v)
        v = last[i] if not isinstance(last[i], (str, float, type(None))) else F.lit(last[i])
        columns[name] = value.otherwise(v).cast(kind)
    return told.withColumns(columns).select("mention_id", "text", "canonical", *names, "candidates")


def with_alias_memory(resolutions: DataFrame, order: str = "mention_id") -> DataFrame:
    """What a batch says when each accepted match is remembered at once.

    ``resolutions`` in the order of ``order``: after the first row of a key that a score or
    an adjudicator resolved, all later rows of this key are matched as aliases, also
    those that would not have been resolved by themselves.
    """
    memo = F.col("method").isin("fuzzy", "corroborated", "llm") & (F.col("canonical") != "")
    first = resolutions.where(memo).groupBy("canonical").agg(F.min_by("firm_id", order).alias("__firm"), F.min(order).alias("__from"))
    later = (F.col(order) > F.col("__from")) & ~F.coalesce(F.col("method").isin("exact", "alias"), F.lit(False))
    out = resolutions.join(first, "canonical", "left").withColumn("__learned", F.when(later, F.col("__firm"))).select(*resolutions.columns, "__learned")
    was = F.col("__learned").isNotNull()
    return out.withColumns(
        {
            "status": F.when(was, "resolved").otherwise(F.col("status")),
            "firm_id": F.when(was, F.col("__learned")).otherwise(F.col("firm_id")),
            "method": F.when(was, "alias").otherwise(F.col("method")),
            "confidence": F.when(was, 1.0).otherwise(F.col("confidence")),
            "reason": F.when(was, "matched a known alias").otherwise(F.col("reason")),
        }
    ).drop("__learned")


def learned_aliases(resolutions: DataFrame, known: DataFrame, order: str = "mention_id") -> DataFrame:
    """Alias rows that accepted matches add: the first of each key that isn't known yet."""
    found = resolutions.where(F.col("method").isin("fuzzy", "corroborated", "llm") & (F.col("canonical") != ""))
    rows = found.select(
        row_id(F.col("canonical")).alias("id"), "firm_id", F.col("text").alias("alias"), F.col("canonical").alias("canonical_alias"), F.lit("llc_holding").alias("alias_type"),
        "confidence", F.col("method").alias("resolution_method"), F.col(order).alias("__order"),
    )
    return new_only(rows, known, ["canonical_alias"], ["__order"]).drop("__order")


def review_queue(resolutions: DataFrame, known: DataFrame, origin_table: str, origin: str = "origin_id", order: str = "mention_id") -> DataFrame:
    """Candidate rows for ambiguous mentions: the first of each key that isn't queued yet, with five suggestions."""
    rows = resolutions.where("status = 'ambiguous' AND canonical <> ''").select(
        row_id(F.col("canonical")).alias("id"),
        F.col("text").alias("mention"),
        F.col("canonical").alias("canonical_mention"),
        F.lit(origin_table).alias("origin_table"),
        F.col(origin).alias("origin_id"),
        F.lit("ambiguous").alias("status"),
        (F.get("candidates", F.lit(0))["effective"] / 100).alias("best_score"),
        F.transform(F.slice("candidates", 1, 5), lambda c: F.struct(c["firm_id"].alias("firm_id"), c["name"].alias("name"), F.bround(c["effective"], 1).alias("score"))).alias("suggestions"),
        F.col(order).alias("__order"),
    )
    return new_only(rows, known, ["canonical_mention"], ["__order"]).drop("__order")


def accuracy(resolutions: DataFrame, expected: DataFrame) -> DataFrame:
    """n, correct, wrong (resolved to another firm) and share over (mention_id, expected_id)."""
    both = resolutions.join(expected, "mention_id")
    right = F.col("firm_id").eqNullSafe(F.col("expected_id"))
    return both.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(~right & F.col("firm_id").isNotNull()).alias("wrong"), F.avg(right.cast("double")).alias("share"))


def _ordered_grams(keys: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
    """``keys`` with their trigrams, the rarest among the firms first (those that no firm has before them), and how many no firm has."""
    each = keys.select(key, F.explode(fuzzy.trigrams(F.col(key))).alias("g")).join(counts, "g", "left")
    ordered = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("__c", F.lit(0)).alias("c"), "g"))).alias("__o"))
    return ordered.select(key, F.transform("__o", lambda x: x["g"]).alias(name), F.size(F.filter("__o", lambda x: x["c"] == 0)).alias("__unknown"))


def gram_pairs(m: DataFrame, f: DataFrame) -> DataFrame:
    """canonical, canonical_name, similarity of pairs that may reach the mention's ``__least``, each made once, at its first shared trigram.

    ``m``: canonical, __x (its trigrams, rarest first), __unknown, __least, __upto (how many
    trigrams are looked up). ``f``: canonical_name, __y. Sizes bound a similarity, and the
    places of the first shared trigram bound how many more can be shared: what they rule
    out isn't made.
    """
    start = F.col("__unknown")
    mine = m.where(F.col("__upto") > start).select("canonical", "__x", "__least", start, F.posexplode(F.slice("__x", start + 1, F.col("__upto") - start)).alias("__i", "g")).withColumn("__i", F.col("__i") + start).drop("__unknown")
    theirs = f.select("canonical_name", "__y", F.posexplode("__y").alias("__j", "g"))
    x, y = F.size("__x"), F.size("__y")
    needed = F.ceil(F.col("__least") / (1 + F.col("__least")) * (x + y) - 1e-9)
    possible = F.least(x - F.col("__i"), y - F.col("__j"))
    met = _met(mine, theirs, "g", "canonical").where((possible >= needed) & (F.least(x, y) >= needed))
    # A generator holds the shared trigrams, so that what follows doesn't work them out again.
    met = met.select("canonical", "canonical_name", "__least", "g", (x + y).alias("__both"), F.explode(F.array(F.array_intersect("__x", "__y"))).alias("__s"))
    met = met.where(F.col("g") == F.get("__s", F.lit(0)))
    return met.withColumn("similarity", F.size("__s") / (F.col("__both") - F.size("__s"))).where(F.col("similarity") >= F.col("__least")).select("canonical", "canonical_name", "similarity")


def trigram_candidates(mentions: DataFrame, firms: DataFrame, least: float = 0.1, most: int = MOST_CANDIDATES) -> DataFrame:
    """mention_id, firm_id, similarity: firms whose key shares trigrams with a mention's, the best ``most`` of each, over ``least``.

    First each key meets the firms of its few rarest trigrams only; the last of the best
    ``most`` raises what a pair must reach, and a pair that reaches it shares one of the
    first trigrams, as many as that similarity leaves. Keys are met once, however often
    they occur. Keys without trigrams have no rows.
    """
    names, keys = firms.select("canonical_name").distinct(), mentions.select("canonical").distinct()
    counts = names.select(F.explode(fuzzy.trigrams(F.col("canonical_name"))).alias("g")).groupBy("g").agg(F.count("*").alias("__c"))
    f = kept(_ordered_grams(names, "canonical_name", counts, "__y"), "firm-grams").drop("__unknown")
    m = kept(_ordered_grams(keys, "canonical", counts, "__x"), "mention-grams").withColumn("__least", F.lit(least))
    first = gram_pairs(m.withColumn("__upto", F.least(F.col("__unknown") + SEEDS, F.size("__x"))), f)
    # Of each key the similarity that ``most`` names reach already.
    rank = Window.partitionBy("canonical").orderBy(F.desc("similarity"), "canonical_name")
    reached = first.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") == most).select("canonical", F.col("similarity").alias("__reached"))
    m = m.join(reached, "canonical", "left").withColumn("__least", F.greatest("__least", F.coalesce("__reached", F.lit(0.0)))).drop("__reached")
    pairs = gram_pairs(m.withColumn("__upto", F.size("__x") - F.ceil(F.col("__least") * F.size("__x") - 1e-9).cast("int") + 1), f).where(F.col("similarity") > least)
    best = Window.partitionBy("canonical").orderBy(F.desc("similarity"), "firm_id")
    told = pairs.join(_first_ids(firms, most), "canonical_name").withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most)
    return mentions.select("mention_id", "canonical").join(told, "canonical").select("mention_id", "firm_id", "similarity")


__all__ = ["accuracy", "exact_and_alias", "firm_records", "first_rows", "learned_aliases", "resolve", "review_queue", "scored_candidates", "trigram_candidates", "with_alias_memory"]
