"""Mining of conventions: associations, avoidance, displacement, sequences, samples and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .stage import dealt


def frequent(events: DataFrame, basket: str, symbol: str, least: int) -> DataFrame:
    """(symbol, df): symbols in ``least`` baskets or more."""
    return events.groupBy(F.col(symbol).alias("symbol")).agg(F.count_distinct(basket).alias("df")).where(F.col("df") >= least)


def associations(events: DataFrame, basket: str, symbol: str, support: int = 20, confidence: float = 0.9, lift: float = 3.0) -> DataFrame:
    """(a, b, support, confidence, lift) of rules a -> b between symbols of one basket.

    Rare symbols go before the self join, which bounds the pairs by what can reach the support at all.
    """
    common = frequent(events, basket, symbol, support)
    kept = events.select(F.col(basket).alias("basket"), F.col(symbol).alias("symbol")).distinct().join(common.select("symbol"), "symbol", "left_semi")
    left, right = kept.select("basket", F.col("symbol").alias("a")), kept.select("basket", F.col("symbol").alias("b"))
    pairs = left.join(right, "basket").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    n = events.agg(F.count_distinct(basket).alias("n"))
    dfs = common.select(F.col("symbol").alias("a"), F.col("df").alias("df_a")), common.select(F.col("symbol").alias("b"), F.col("df").alias("df_b"))
    rules = pairs.join(dfs[0], "a").join(dfs[1], "b").crossJoin(F.broadcast(n))
    rules = rules.withColumn("confidence", F.col("support") / F.col("df_a")).withColumn("lift", F.col("support") * F.col("n") / (F.col("df_a") * F.col("df_b")))
    return rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift)).select("a", "b", "support", "confidence", "lift")


def pair_relations(events: DataFrame, basket: str, symbol: str, position: str, support: int) -> DataFrame:
    """(a, b, n, first_before, all_before, once_each, adjacent): in what shares of common baskets a relates to b so."""
    common = frequent(events, basket, symbol, support).select("symbol")
    kept = events.select(F.col(basket).alias("basket"), F.col(symbol).alias("symbol"), F.col(position).alias("pos")).join(common, "symbol", "left_semi")
    spans = kept.groupBy("basket", "symbol").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("c"))
    a, b = spans.toDF("basket", "a", "alo", "ahi", "ac"), spans.toDF("basket", "b", "blo", "bhi", "bc")
    per = a.join(b, "basket").where("a <> b")
    share = lambda c: F.avg(c.cast("double"))
    return per.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("alo") < F.col("blo")).alias("first_before"), share(F.col("ahi") < F.col("blo")).alias("all_before"),
        share((F.col("ac") == 1) & (F.col("bc") == 1)).alias("once_each"), share((F.col("ac") == 1) & (F.col("bc") == 1) & (F.col("blo") == F.col("ahi") + 1)).alias("adjacent"),
    ).where(F.col("n") >= support)


def contexts(events: DataFrame, basket: str, symbol: str, context: str, least: int, least_expected: float = 0.0) -> DataFrame:
    """(symbol, context, observed, expected, n_symbol, n_context, total) for every frequent symbol in every context; unseen pairs count 0.

    Contexts are few (directives, module kinds); their table is checked to be small before it is broadcast.  Pairs of which less than
    ``least_expected`` is expected (an avoidance needs 6.9) go before the counts are joined.
    """
    rows = events.select(F.col(basket).alias("basket"), F.col(symbol).alias("symbol"), F.col(context).alias("context"))
    rows = dealt(rows, "basket").distinct()
    in_context = rows.groupBy("context").agg(F.count_distinct("basket").alias("n_context"))
    total = rows.agg(F.count_distinct("basket").alias("total"))
    of_symbol = rows.groupBy("symbol").agg(F.count_distinct("basket").alias("n_symbol")).where(F.col("n_symbol") >= least)
    seen = rows.groupBy("symbol", "context").agg(F.count_distinct("basket").alias("observed"))
    few = in_context.limit(10_001).count() <= 10_000
    grid = of_symbol.crossJoin(F.broadcast(in_context) if few else in_context).crossJoin(F.broadcast(total))
    grid = grid.where(F.col("n_symbol") * F.col("n_context") >= least_expected * F.col("total"))
    full = grid.join(seen, ["symbol", "context"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return full.withColumn("expected", F.col("n_symbol") * F.col("n_context") / F.col("total"))


def avoided(found: DataFrame) -> DataFrame:
    return found.where(S.avoids(F.col("observed"), F.col("expected")))


def required(found: DataFrame, least: int = 20, share: float = 0.85, elsewhere: float = 0.2) -> DataFrame:
    """Contexts in which a symbol is nearly always present though it is rare over all."""
    return found.where((F.col("n_context") >= least) & (F.col("observed") >= share * F.col("n_context")) & (F.col("n_symbol") / F.col("total") < elsewhere))


def avoided_within_roots(events: DataFrame, basket: str, symbol: str, context: str, root: Column, least: int = 30, least_context: int = 20) -> DataFrame:
    """(root, symbol, context, observed, expected): symbols that baskets of a context avoid though they use the symbol's root.

    What is expected in the context is the share of the root's other baskets that use the symbol.  Only (symbol, context) pairs of one root meet.
    """
    rows = events.select(F.col(basket).alias("basket"), F.col(symbol).alias("symbol"), F.col(context).alias("context"), root.alias("root")).where("root IS NOT NULL")
    rows = dealt(rows, "basket").distinct()
    n_root = rows.groupBy("root").agg(F.count_distinct("basket").alias("n_root"))
    n_context = rows.groupBy("root", "context").agg(F.count_distinct("basket").alias("n_context")).where(F.col("n_context") >= least_context)
    n_symbol = rows.groupBy("root", "symbol").agg(F.count_distinct("basket").alias("n_symbol")).where(F.col("n_symbol") >= least)
    seen = rows.groupBy("root", "symbol", "context").agg(F.count_distinct("basket").alias("observed"))
    grid = n_symbol.join(n_context, "root").join(n_root, "root").where("n_root > n_context").join(seen, ["root", "symbol", "context"], "left")
    grid = grid.withColumn("observed", F.coalesce("observed", F.lit(0)))
    grid = grid.withColumn("expected", F.col("n_context") * (F.col("n_symbol") - F.col("observed")) / (F.col("n_root") - F.col("n_context")))
    return avoided(grid).select("root", "symbol", "context", "observed", "expected")


def bracketed(events: DataFrame, basket: str, symbol: str, position: str, brackets: DataFrame) -> DataFrame:
    """``events`` once for each block of their basket, with ``block`` and whether they stand ``inside``.

    ``brackets``: (opening, closing) pairs of symbols; a block reaches from the first opening to the last closing symbol of a basket.
    """
    events = dealt(events, basket)
    ends = F.explode(F.array(F.struct(F.col("opening").alias("__s"), F.lit(True).alias("__o")), F.struct(F.col("closing").alias("__s"), F.lit(False).alias("__o"))))
    sides = brackets.select("opening", "closing").distinct().select("opening", "closing", ends.alias("e")).select("opening", "closing", "e.*")
    at = events.select(F.col(basket).alias("__b"), F.col(symbol).alias("__x"), F.col(position).alias("__p")).join(F.broadcast(sides), F.col("__x") == F.col("__s"))
    spans = at.groupBy("__b", "opening", "closing").agg(F.min(F.when(F.col("__o"), F.col("__p"))).alias("__from"), F.max(F.when(~F.col("__o"), F.col("__p"))).alias("__to")).where("__to > __from")
    spans = spans.select("__b", F.concat(F.lit("["), "opening", F.lit(".."), "closing", F.lit("]")).alias("block"), "__from", "__to")
    found = events.join(spans, F.col(basket) == F.col("__b"))
    return found.withColumn("inside", (F.col(position) > F.col("__from")) & (F.col(position) < F.col("__to"))).drop("__b", "__from", "__to")


def block_contexts(events: DataFrame, basket: str, symbol: str, block: str, inside: str) -> DataFrame:
    """(block, symbol, observed, expected, n, share): uses of a symbol inside a kind of block, against the share of all uses that stand inside.

    Only baskets that hold such a block with something in it count.
    """
    rows = events.select(F.col(basket).alias("basket"), F.col(block).alias("block"), F.col(symbol).alias("symbol"), F.col(inside).cast("long").alias("inside")).where("basket IS NOT NULL AND block IS NOT NULL")
    own = dealt(rows, "basket").groupBy("basket", "block", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("inside").alias("observed"))
    live = own.withColumn("__in", F.sum("observed").over(Window.partitionBy("basket", "block"))).where("__in > 0")
    per = live.groupBy("block", "symbol").agg(F.sum("n").alias("n"), F.sum("observed").alias("observed"))
    total = per.groupBy("block").agg(F.sum("n").alias("all_n"), F.sum("observed").alias("all_inside"))
    return per.join(total, "block").select("block", "symbol", "observed", (F.col("n") * F.col("all_inside") / F.col("all_n")).alias("expected"), "n", (F.col("observed") / F.col("n")).alias("share"))


def operator_usage(events: DataFrame, basket: str, symbol: str, directive: str) -> DataFrame:
    """(symbol, directive, n_symbol, n_directive, observed, expected, total): baskets that use an operator, by directive; what is expected follows from the other directives."""
    rows = dealt(events.select(F.col(basket).alias("basket"), F.col(symbol).alias("symbol"), F.col(directive).alias("directive")), "basket").distinct()
    n_directive = rows.groupBy("directive").agg(F.count_distinct("basket").alias("n_directive"))
    n_symbol = rows.groupBy("symbol").agg(F.count_distinct("basket").alias("n_symbol"))
    seen = rows.groupBy("symbol", "directive").agg(F.count(F.lit(1)).alias("observed"))
    total = rows.agg(F.count_distinct("basket").alias("total"))
    grid = n_symbol.crossJoin(F.broadcast(n_directive)).crossJoin(F.broadcast(total))  # directives are the few of the language
    grid = grid.join(seen, ["symbol", "directive"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    expected = F.col("n_directive") * (F.col("n_symbol") - F.col("observed")) / F.greatest(F.col("total") - F.col("n_directive"), F.lit(1))
    return grid.withColumn("expected", expected).select("symbol", "directive", "n_symbol", "n_directive", "observed", "expected", "total")


def avoided_operators(usage: DataFrame, least_directive: int = 500, least: int = 30) -> DataFrame:
    """Operators that a directive avoids."""
    return avoided(usage.where((F.col("n_directive") >= least_directive) & (F.col("n_symbol") >= least)))


def signature_diversity(events: DataFrame, basket: str, symbol: str) -> DataFrame:
    """(symbol, baskets, signatures, diversity): distinct symbol sets among the baskets that use a symbol; copies of one body count once."""
    rows = dealt(events.select(F.col(basket).alias("basket"), F.struct(F.col(symbol).alias("symbol")).alias("s")).where("basket IS NOT NULL"), "basket")
    sets = rows.groupBy("basket").agg(F.collect_set("s").alias("set"))  # of structs, which keeps a null symbol
    signature = F.xxhash64(F.concat_ws("\x1f", F.array_sort(F.col("set.symbol"))))
    uses = dealt(sets.select(F.explode("set.symbol").alias("symbol"), signature.alias("signature")), "symbol", "signature")
    kinds = uses.groupBy("symbol", "signature").agg(F.count(F.lit(1)).alias("n"))
    per = kinds.groupBy("symbol").agg(F.sum("n").alias("baskets"), F.count(F.lit(1)).alias("signatures"))
    return per.withColumn("diversity", F.col("signatures") / F.col("baskets"))


def avoided_directives(found: DataFrame, least: int = 500, share: float = 0.02) -> DataFrame:
    return found.where((F.col("n_context") >= least) & (F.col("observed") <= share * F.col("expected")))


def wrappers(edges: DataFrame, least: int = 30, outside: float = 0.1) -> DataFrame:
    """(wrapped, wrapper, inside, total): nearly all calls of the wrapped name come from one caller."""
    calls = edges.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("inside"))
    total = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("total"))
    both = calls.join(total, "dst").where((F.col("inside") >= least) & (F.col("total") - F.col("inside") <= outside * F.col("total")))
    return both.select(F.col("dst").alias("wrapped"), F.col("src").alias("wrapper"), "inside", "total")


def similar_pairs(names: DataFrame, name: str, count: str, jaccard: float = 0.5, least: int = 100, ratio: float = 10.0, stem: int = 5) -> DataFrame:
    """(rare, common, similarity): names that share half of their word stems while one is far more used; blocked on stems."""
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower(F.col(name)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0), lambda w: F.left(w, F.lit(stem))))
    n = names.select(F.col(name).alias("name"), F.col(count).alias("cnt"), words.alias("stems"))
    blocked = n.select("name", "cnt", "stems", F.explode("stems").alias("stem"))
    a = blocked.toDF("common", "c_cnt", "c_stems", "stem").where(F.col("c_cnt") >= least)
    b = blocked.toDF("rare", "r_cnt", "r_stems", "stem")
    pairs = a.join(b, "stem").where((F.col("common") != F.col("rare")) & (F.col("c_cnt") >= ratio * F.col("r_cnt"))).dropDuplicates(["common", "rare"])
    scored = pairs.withColumn("similarity", F.size(F.array_intersect("c_stems", "r_stems")) / F.size(F.array_union("c_stems", "r_stems")))
    return scored.where(F.col("similarity") >= jaccard).select("rare", "common", "similarity")


def dominant_form(events: DataFrame, symbol: str, form: str, least: int = 30, share: float = 0.95) -> DataFrame:
    """(symbol, form, n, share): the form that nearly all uses take."""
    counts = events.groupBy(F.col(symbol).alias("symbol"), F.col(form).alias("form")).agg(F.count(F.lit(1)).alias("k"))
    per = counts.groupBy("symbol").agg(F.sum("k").alias("n"), F.max_by("form", F.struct("k", "form")).alias("form"), F.max("k").alias("k"))
    return per.where((F.col("n") >= least) & (F.col("k") >= share * F.col("n"))).select("symbol", "form", "n", (F.col("k") / F.col("n")).alias("share"))


def unused_shares(nodes: DataFrame, edges: DataFrame, key: str, group: str) -> DataFrame:
    """(group, nodes, unused_share, self_only_share): nodes that nothing calls, and that only their own group calls."""
    owner = nodes.select(F.col(key).alias("__n"), F.col(group).alias("__g"))
    called = edges.join(owner.toDF("__dn", "__dg"), F.col("dst") == F.col("__dn")).join(owner.toDF("__sn", "__sg"), F.col("src") == F.col("__sn"))
    state = called.groupBy(F.col("dst").alias("__c")).agg(F.max((~F.col("__dg").eqNullSafe(F.col("__sg"))).cast("int")).alias("foreign"))
    joined = owner.join(state, F.col("__n") == F.col("__c"), "left")
    return joined.groupBy(F.col("__g").alias("grp")).agg(
        F.count(F.lit(1)).alias("nodes"), F.avg(F.col("foreign").isNull().cast("double")).alias("unused_share"), F.avg(F.coalesce(F.col("foreign") == 0, F.lit(False)).cast("double")).alias("self_only_share")
    )


def nested_shares(events: DataFrame, symbol: str, parent: str, least: int = 100, share: float = 0.5) -> DataFrame:
    """(symbol, parent, n, share): uses that mostly stand inside one parent."""
    total = events.groupBy(F.col(symbol).alias("symbol")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    inside = events.where(F.col(parent).isNotNull()).groupBy(F.col(symbol).alias("symbol"), F.col(parent).alias("parent")).agg(F.count(F.lit(1)).alias("k"))
    return inside.join(total, "symbol").where(F.col("k") >= share * F.col("n")).select("symbol", "parent", "n", (F.col("k") / F.col("n")).alias("share"))


def argument_forms(uses: DataFrame, symbol: str, place: str, form: str, least: int = 30, share: float = 0.95) -> DataFrame:
    """(symbol, place, value, share, n): what nearly all uses hand over at one place of their arguments.

    The form itself where it says something (a literal word, a name, a called function, a coarse text), else its kind.
    """
    full = F.col(form)
    kind = F.left(full, F.lit(2))
    coarse = F.when(full.startswith("S:"), F.substring_index(full, "~", 1)).when(kind.isin("C:", "I:") | full.startswith("="), full).otherwise(F.left(full, F.lit(1)))
    counts = uses.groupBy(F.col(symbol).alias("symbol"), F.col(place).alias("place"), coarse.alias("value")).agg(F.count(F.lit(1)).alias("k"))
    general = F.when(F.left("value", F.lit(2)).isin("S:", "I:", "C:"), F.left("value", F.lit(2))).otherwise(F.col("value"))
    levels = F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("value").alias("value")), F.struct(F.lit(2).alias("level"), general.alias("value"))))
    per = counts.select("symbol", "place", "k", levels.alias("l")).groupBy("symbol", "place", "l.level", "l.value").agg(F.sum("k").alias("k"))
    total = counts.groupBy("symbol", "place").agg(F.sum("k").alias("n")).where(F.col("n") >= least)
    said = F.when(F.col("level") == 1, ~F.col("value").isin("-", "N", "E")).otherwise(F.col("value").isin("S:", "I:", "C:"))
    found = per.join(total, ["symbol", "place"]).where(said & (F.col("k") >= share * F.col("n")))
    best = found.groupBy("symbol", "place").agg(F.min_by(F.struct("value", "k", "n"), "level").alias("b"))
    return best.select("symbol", "place", "b.value", (F.col("b.k") / F.col("b.n")).alias("share"), "b.n")


def avoided_keys(literals: DataFrame, symbol: str, place: str, keys: str, least: int = 100, related: int = 100, seen: int = 30, own: float = 0.01) -> DataFrame:
    """(symbol, place, key, observed, expected, n, related): keys that related literals use and a symbol's literals avoid.

    A literal of another symbol or place is related if it holds one of the keys that the symbol uses itself.  Equal literals of
    one symbol are counted before anything meets.
    """
    sets = literals.where(F.size(keys) > 0).groupBy(F.col(symbol).alias("symbol"), F.col(place).alias("place"), F.array_sort(F.array_distinct(keys)).alias("keys")).agg(F.count(F.lit(1)).alias("w"))
    target = sets.groupBy("symbol", "place").agg(F.sum("w").alias("n")).where(F.col("n") >= least)
    used = sets.select("symbol", "place", "w", F.explode("keys").alias("key")).groupBy("symbol", "place", "key").agg(F.sum("w").alias("observed"))
    vocabulary = used.join(target, ["symbol", "place"]).where(F.col("observed") >= own * F.col("n")).select("symbol", "place", "key", "n")
    other = sets.groupBy(F.col("symbol").alias("__s"), F.col("place").alias("__p"), "keys").agg(F.sum("w").alias("w"))
    meets = other.select("__s", "__p", "keys", "w", F.explode("keys").alias("key")).join(vocabulary, "key").where("NOT (__s <=> symbol AND __p <=> place)")
    pairs = meets.select("symbol", "place", "n", "__s", "__p", "keys", "w").distinct()
    around = pairs.groupBy("symbol", "place").agg(F.sum("w").alias("related")).where(F.col("related") >= related)
    theirs = pairs.select("symbol", "place", "n", "w", F.explode("keys").alias("key")).groupBy("symbol", "place", "n", "key").agg(F.sum("w").alias("k")).where(F.col("k") >= seen)
    grid = theirs.join(vocabulary.drop("n"), ["symbol", "place", "key"], "left_anti").join(around, ["symbol", "place"]).join(used, ["symbol", "place", "key"], "left")
    grid = grid.withColumn("observed", F.coalesce("observed", F.lit(0))).withColumn("expected", F.col("n") * F.col("k") / F.col("related"))
    return avoided(grid).select("symbol", "place", "key", "observed", "expected", "n", "related")


def never_joined(events: DataFrame, symbol: str, parent: str, joined: str, least: int = 100, most: float = 0.1, inside: float = 0.2, top: int = 4) -> DataFrame:
    """(symbol, concat_share, parents, n): symbols that are handed over as arguments and hardly ever joined to texts.

    ``parents``: the most frequent of the ``top`` surroundings that are calls, with their shares.
    """
    per = events.groupBy(F.col(symbol).alias("symbol"), F.coalesce(F.col(parent), F.lit("")).alias("parent")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col(joined).cast("long")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("k"), "parent"))
    called = (F.col("rank") <= top) & (F.col("parent") != "")
    total = per.withColumn("rank", rank).groupBy("symbol").agg(
        F.sum("k").alias("n"), F.sum("c").alias("c"), F.coalesce(F.sum(F.when(called, F.col("k"))), F.lit(0)).alias("__in"), F.array_sort(F.collect_list(F.when(called, F.struct("rank", "parent", "k")))).alias("p"),
    )
    kept = total.where((F.col("n") >= least) & (F.col("c") <= most * F.col("n")) & (F.col("__in") >= inside * F.col("n")))
    parents = F.transform("p", lambda x: F.struct(x["parent"].alias("parent"), (x["k"] / F.col("n")).alias("share")))
    return kept.select("symbol", (F.col("c") / F.col("n")).alias("concat_share"), parents.alias("parents"), "n")


def rank_practices(found: DataFrame, family: str, evidence: str, diversity: str, spread: str, modules: int, fit: str) -> DataFrame:
    """Score min(e * d, 50) / 50 * ln(1 + spread) / ln(modules) * max(fit, 0), and the best of each family (ties by name)."""
    score = F.least(F.col(evidence) * F.col(diversity), F.lit(50.0)) / 50 * F.log1p(F.col(spread)) / F.log(F.lit(float(modules))) * F.greatest(F.col(fit), F.lit(0.0))
    first = Window.partitionBy(family).orderBy(F.desc("score"), "name")
    return found.withColumn("score", score).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def context_penalty(n_context: Column, n_symbol: Column) -> Column:
    return 1 / (1 + F.log(n_context)) / (1 + F.log(n_symbol))


def ordered_pairs(events: DataFrame, basket: str, symbol: str, position: str, observed: int = 10, consistency: float = 0.9, category: str | None = None, categories: int = 1) -> DataFrame:
    """(a, b, observed, inverse, consistency): symbols whose first uses keep one order, in baskets of at least so many categories (a basket lies in one)."""
    rows = events.select(F.col(basket).alias("basket"), F.col(symbol).alias("symbol"), F.col(position).alias("pos"), (F.col(category) if category else F.lit(0)).alias("kind"))
    first = dealt(rows, "basket").groupBy("basket", "symbol").agg(F.min("pos").alias("pos"), F.min("kind").alias("kind"))
    both_first = first.toDF("basket", "a", "pa", "ka").join(first.toDF("basket", "b", "pb", "kb"), "basket").where("pa < pb")
    pairs = both_first.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed"), F.count_distinct("ka").alias("__kinds"))
    back = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("observed").alias("inverse"))
    both = pairs.join(back, ["a", "b"], "left").withColumn("inverse", F.coalesce("inverse", F.lit(0)))
    scored = both.withColumn("consistency", F.col("observed") / (F.col("observed") + F.col("inverse")))
    return scored.where((F.col("observed") >= observed) & (F.col("consistency") >= consistency) & (F.col("__kinds") >= categories)).drop("__kinds")


def sequences(events: DataFrame, basket: str, symbol: str, position: str, width: int = 3, least: int = 10, qualified: str | None = None) -> DataFrame:
    """(gram, baskets): runs of ``width`` symbols, not all equal, each once a basket; with ``qualified``, at least one of them matches that pattern."""
    events = dealt(events.select(*dict.fromkeys([basket, symbol, position])), basket)
    w = Window.partitionBy(basket).orderBy(position, symbol)
    parts = [F.col(symbol)] + [F.lead(symbol, i).over(w) for i in range(1, width)]
    rows = events.select(F.col(basket).alias("basket"), *[p.alias(f"s{i}") for i, p in enumerate(parts)]).where(F.col(f"s{width - 1}").isNotNull())
    if qualified:
        rows = rows.where(F.exists(F.array(*[f"s{i}" for i in range(width)]), lambda s: s.rlike(qualified)))
    rows = rows.where(" OR ".join(f"s{i} <> s0" for i in range(1, width)) or "true").select("basket", F.concat_ws(" > ", *[f"s{i}" for i in range(width)]).alias("gram")).distinct()
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("baskets")).where(F.col("baskets") >= least)


class TooMany(RuntimeError):
    """More distinct fragments than a profile may hold; nothing is returned."""


def fragments(events: DataFrame, module: str, basket: str, symbol: str, position: str, context: Column, widths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(family, context, signature, module, basket): runs of symbols of each width, and the symbol that each basket begins with."""
    order = Window.partitionBy(basket).orderBy(position, symbol)
    rows = dealt(events, basket).select(F.col(module).alias("module"), F.col(basket).alias("basket"), context.alias("context"), F.col(symbol).alias("s0"), *[F.lead(symbol, i).over(order).alias(f"s{i}") for i in range(1, max(widths))], F.row_number().over(order).alias("__rn"))
    runs = F.array(*[F.when(F.col(f"s{w - 1}").isNotNull(), F.struct(F.lit(f"run{w}").alias("family"), F.concat_ws(" > ", *[f"s{i}" for i in range(w)]).alias("signature"))) for w in widths], F.when(F.col("__rn") == 1, F.struct(F.lit("first").alias("family"), F.col("s0").alias("signature"))))
    return rows.select("context", "module", "basket", F.explode(F.filter(runs, lambda r: r.isNotNull())).alias("r")).select("r.family", "context", "r.signature", "module", "basket")


def profile(found: DataFrame, observed: int = 10, modules: int = 3, top: int = 300, most_keys: int = 3_000_000) -> DataFrame:
    """(family, context, signature, observed, modules, rank) of ``fragments``: seen often enough in enough modules, the most frequent of each family.

    A corpus with more than ``most_keys`` distinct fragments raises ``TooMany`` before anything is kept.
    """
    per = found.groupBy("family", "context", "signature").agg(F.count(F.lit(1)).alias("observed"), F.count_distinct("module").alias("modules"))
    if per.limit(most_keys + 1).count() > most_keys:
        raise TooMany(f"more than {most_keys} distinct fragments")
    best = Window.partitionBy("family").orderBy(F.desc("observed"), F.desc("modules"), "context", "signature")
    kept = per.where((F.col("observed") >= observed) & (F.col("modules") >= modules)).withColumn("rank", F.row_number().over(best).cast("long"))
    return kept.where(F.col("rank") <= top)


def evidence_sample(events: DataFrame, group: list[str], address: list[Column], n: int = 10) -> DataFrame:
    """The n rows of each group with the smallest hash of their address: the same sample on every run."""
    key = F.substring(F.sha2(F.concat_ws("|", *address).cast("binary"), 256), 1, 16)
    first = Window.partitionBy(*group).orderBy("hash_key", *group)
    return events.withColumn("hash_key", key).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= n)


def stratified_sample(rows: DataFrame, stratum: str, key: Column, n: int = 100) -> DataFrame:
    """n rows dealt in turn from the strata, in hash order within each."""
    hashed = rows.withColumn("hash_key", F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 16))
    dealt = hashed.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy("hash_key")))
    return dealt.where(F.col("rn") <= n).orderBy("rn", stratum).limit(n)


def most_common(events: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """Each group's most frequent value; ties go to the one seen first."""
    counts = events.groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"), F.min(position).alias("__p"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("__c", F.negative("__p"))).alias(value), F.max("__c").alias("n"))


def pair_flags(events: DataFrame, basket: str, symbol: str, a: str, b: str) -> DataFrame:
    """(basket, has_a, has_b) of baskets with both."""
    flag = lambda v: F.max(F.when(F.col(symbol) == v, 1).otherwise(0))
    return events.groupBy(basket).agg(flag(a).alias("has_a"), flag(b).alias("has_b")).where("has_a = 1 AND has_b = 1")
