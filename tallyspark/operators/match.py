"""Matching of work names with catalogue items: a token-weighted fuzzy join.

How it is dealt. Queries and items are reduced to distinct (name, unit) first. Their
vocabularies meet in equi-joins: on beginnings, on what is left of words of up to SHORTENED letters
without a few of them (two words are alike if they have that in common), and for longer words on a piece
that a small edit distance must leave intact.

Then queries meet items on words, the rarest one first. Each pair has bounds of its score before
the phrases are compared. The best lower bounds of a query say how much weight an item must hold to
get among its best: only the commoner words without which that cannot be reached make more pairs.
Phrases are compared for pairs whose upper bound is among the best. So cost follows the
postings of rare words, not the product of queries and items, and nothing that could be among the best is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import alike, fixed
from tallyspark.functions import similarity as S
from tallyspark.functions import text as T
from tallyspark.operators.fill import fill
from tallyspark.sources.shared import written

#: (shorter word has fewer than 6 letters) -> least ratio
SHORT_RATIO, LONG_RATIO, SHORT_WORD = 90.0, 82.0, 6
#: Words of more letters meet by pieces: what may be left of them without some letters is too much.
SHORTENED = 12
#: No score is shown above TOP_SCORE; scores this much apart may be shown as the same.
TOP_SCORE, ROUNDING = 99.9, 0.1


def least_ratio(a: Column, b: Column) -> Column:
    return F.when(F.least(F.length(a), F.length(b)) < SHORT_WORD, F.lit(SHORT_RATIO)).otherwise(F.lit(LONG_RATIO))


def token_hit(q: Column, w: Column) -> Column:
    """Whether a query word counts as found by an item's word."""
    starts = (F.startswith(w, q) & (F.length(q) >= 4)) | (F.startswith(q, w) & (F.length(w) >= 5))
    return starts | ((F.length(q) >= 4) & (F.length(w) >= 4) & (S.ratio(q, w) >= least_ratio(q, w)))


def _pieces(word: str, own: str, other: str, shifts: bool) -> str:
    """SQL of the keys of a word: for each length of the other word, pieces of the item's
    word (lw letters), or what may be those pieces in the query's word."""
    lw, lq = ("length(w)", "l") if own == "w" else ("l", "length(q)")
    least = f"if(least({lw}, {lq}) < {SHORT_WORD}, {SHORT_RATIO}, {LONG_RATIO})"
    edits = f"cast(floor((100 - {least}) / 100 * ({lw} + {lq}) + 1e-9) as int)"
    start = f"cast(floor(k * {lw} / (d + 1)) as int)"
    size = f"(cast(floor((k + 1) * {lw} / (d + 1)) as int) - {start})"
    key = f"concat_ws('|', {lw}, {lq}, k, substring({word}, {start} + s + 1, {size}))"
    spread = "sequence(-d, d)" if shifts else "array(0)"
    inner = f"flatten(transform(sequence(0, d), k -> transform(filter({spread}, s -> {start} + s >= 0 and {start} + s + {size} <= length({word})), s -> {key})))"
    lengths = f"filter(sequence(greatest(4, cast(ceil(length({word}) * 0.69) as int)), cast(floor(length({word}) * 1.45) as int)), l -> greatest(l, length({word})) > {SHORTENED} AND abs(length({word}) - l) <= element_at(transform(array({edits}), d -> d), 1))"
    return f"flatten(transform({lengths}, l -> element_at(transform(array({edits}), d -> {inner}), 1)))"


def _shortened(df: DataFrame, word: str) -> DataFrame:
    """word, key: what is left of words of 4 to SHORTENED letters without any of the letters
    that a like word may lack. Two words of n and m letters are alike if 2 c / (n + m) reaches the
    ratio for c common letters, so at most 0.305 n go."""
    drop = "array_distinct(flatten(transform({0}, x -> transform(sequence(1, length(x)), i -> concat(substring(x, 1, i - 1), substring(x, i + 1))))))"
    least = f"cast(floor(0.305 * length({word}) + 1e-9) as int)"
    steps = df.where(F.length(word).between(4, SHORTENED)).withColumn("v0", F.array(word))
    for k in range(1, int(0.305 * SHORTENED) + 1):
        steps = steps.withColumn(f"v{k}", F.expr(f"if({least} >= {k}, {drop.format(f'v{k - 1}')}, array())"))
    every = F.concat(*(f"v{k}" for k in range(int(0.305 * SHORTENED) + 1)))
    return steps.select(word, F.explode(every).alias("key"))


def vocabulary_hits(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(q, w) for which token_hit holds. queries: q; words: w; both distinct."""
    common = _shortened(queries, "q").join(_shortened(words, "w"), "key")
    near = common.where(200.0 * F.length("key") / (F.length("q") + F.length("w")) >= least_ratio(F.col("q"), F.col("w"))).select("q", "w")
    return _other_hits(queries, words).union(near).distinct()


def _other_hits(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Hits by beginnings, and those with a word of more than SHORTENED letters."""
    begin = lambda df, c, n: df.where(F.length(c) >= n).select(c, F.explode(F.transform(F.sequence(F.lit(n), F.length(c)), lambda k: F.substring(c, F.lit(1), k))).alias("key"))
    longer = begin(words, "w", 4).join(queries.select("q", F.col("q").alias("key")), "key").select("q", "w")
    shorter = begin(queries, "q", 5).join(words.select("w", F.col("w").alias("key")), "key").select("q", "w")
    long = "length({0}) >= 4"
    qs = queries.where(long.format("q")).select("q", F.explode(F.array_distinct(F.expr(_pieces("q", "q", "w", True)))).alias("key"))
    ws = words.where(long.format("w")).select("w", F.explode(F.array_distinct(F.expr(_pieces("w", "w", "q", False)))).alias("key"))
    # Written, or else Spark compares a pair once for each piece that it shares.
    met = written(qs.join(ws, "key").select("q", "w").distinct(), "met")
    far = met.where(S.ratio(F.col("q"), F.col("w")) >= least_ratio(F.col("q"), F.col("w")))
    return longer.union(shorter).union(far).distinct()


def with_name_parts(df: DataFrame) -> DataFrame:
    """Adds stems, phrase, action and canonical unit of the columns name and unit."""
    normal = F.col("_normal")  # each name is normalised once
    return df.withColumn("_normal", T.normalise_name(F.col("name"))).withColumns({
        "stems": T.stems(normal, True), "phrase": T.stem_phrase(normal, True), "action": T.action_class(normal, True), "unit_n": T.normalise_unit(F.col("unit")),
    }).drop("_normal")


def item_forms(items: DataFrame, keep: int = 1) -> DataFrame:
    """The first so many items of each distinct (name, unit, category), with their parts.

    items: ord, code, name, unit, category, prices.
    """
    w = Window.partitionBy("name", "unit", "category").orderBy("ord", "code")
    return with_name_parts(items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n"))


def exact_index(items: DataFrame) -> DataFrame:
    """key, item: work key and bare phrase of each item; the first item of a key stays.

    Names and units may be few next to items: each pair's first item is found before keys are made. item_forms hold each
    first item and have their parts already.
    """
    whole = F.struct("ord", "code", "name", "unit", "category", "labor", "material", "machines")
    if "phrase" in items.columns:
        parts = items.select("phrase", "unit_n", whole.alias("item"))
    else:
        first = items.groupBy("name", "unit").agg(F.min(whole).alias("item"))
        parts = first.select(T.stem_phrase(F.col("name")).alias("phrase"), T.normalise_unit(F.col("unit")).alias("unit_n"), "item")
    keys = F.explode(F.array(F.when(F.col("unit_n") != "", F.concat_ws("|", "phrase", "unit_n")).otherwise(F.col("phrase")), F.col("phrase"))).alias("key")
    return parts.select(keys, "item").groupBy("key").agg(F.min("item").alias("item"))


def token_weights(hits: DataFrame, items: DataFrame) -> DataFrame:
    """q, weight: ln(1 + items / items with a hit). items: one row per catalogue row, with name."""
    names = items.groupBy("name").count().select(T.stems(F.col("name")).alias("stems"), "name", F.col("count").alias("n"))
    total = F.greatest(F.lit(1), F.sum("n"))
    size = names.agg(total.alias("total"))
    post = names.select("name", "n", F.explode(F.array_distinct("stems")).alias("w"))
    found = hits.join(post, "w").select("q", "name", "n").distinct().groupBy("q").agg(F.sum("n").alias("found"))
    return found.join(F.broadcast(size)).select("q", F.log1p(F.col("total") / F.col("found")).alias("weight"))  # one row


def _listed(queries: DataFrame, words: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """q, words, weight, dense; and the words of the items that a dense q may be near to.

    Words of a large vocabulary are near very many others: those are counted where they meet and not
    listed (dense). A row of the catalogue counts at the commonest of its words that q hits.
    queries: q; words: w; both distinct. items: as token_weights.
    """
    hits = written(_other_hits(queries, words), "hits")
    names = written(items.groupBy("name").agg(F.count("*").alias("n")).withColumn("stems", F.array_distinct(T.stems(F.col("name")))), "names")  # read three times
    size = names.agg(F.greatest(F.lit(1), F.sum("n")).alias("total"))
    post = names.select("name", "n", F.explode("stems").alias("w"))
    over = hits.where((F.length("q") > F.length("w")) & (F.length("w") >= 5) & F.startswith("q", "w")).groupBy("w").agg(F.max(F.length("q")).alias("over"))
    rows = post.groupBy("w").agg(F.sum("n").alias("rows")).join(over, "w", "left").select("w", "rows", F.coalesce("over", F.lit(0)).alias("over"))
    together = post.join(rows, "w").groupBy("name", "n").agg(F.collect_list(F.struct("w", F.col("rows").alias("n"), "over")).alias("words"))
    sets = together.select("n", F.explode(alike.apart("words")).alias("a")).select("a.w", "a.before", "n").where(F.size("before") > 0)
    sets = sets.groupBy("w", "before").agg(F.sum("n").alias("n")).groupBy("w").agg(F.collect_list(F.struct("before", "n")).alias("sets"))
    of_word = written(rows.join(sets, "w", "left").select(F.col("w").alias("word"), F.col("rows").alias("n"), "sets"), "words")
    near = written(alike.near_counts(queries.select(F.col("q").alias("word")), of_word), "near")
    of_q = near.where("q IS NOT NULL").groupBy("q").agg(F.sum("found").alias("found"), F.max("more").alias("dense"), F.flatten(F.collect_list("words")).alias("near"))
    of_hits = hits.join(of_word.withColumnRenamed("word", "w"), "w").groupBy("q").agg(F.sum(F.col("n") - alike.counted_before("q", "sets")).alias("found"), F.collect_list("w").alias("begun"))
    both = of_q.select("q", "found", "dense", "near", F.array().cast("array<string>").alias("begun")).unionByName(of_hits.withColumns({"dense": F.lit(False), "near": F.array().cast("array<string>")}))
    both = both.groupBy("q").agg(F.sum("found").alias("found"), F.max("dense").alias("dense"), F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("begun")).alias("begun"))
    every = F.when(F.col("dense"), F.col("begun")).otherwise(F.concat("near", "begun"))
    listed = both.join(F.broadcast(size)).select("q", F.array_sort(F.array_distinct(every)).alias("words"), F.log1p(F.col("total") / F.col("found")).alias("weight"), "dense")  # one row
    often = near.where("q IS NULL").select(F.explode("words").alias("word")).distinct()
    rare = of_word.where(F.col("n") <= alike.COMMON).select("word").union(often)
    return listed, rare


def token_lists(queries: DataFrame, items: DataFrame, all_items: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """qid, tokens (struct at, q, weight, words: the items' words that it finds, dense: not all of them), total weight;
    and, unless whole, the items' words that a dense one may be near to.

    Words for actions do not count where a query has others.
    """
    words = lambda df, c: df.select(F.explode("stems").alias(c)).distinct()
    near = None
    if whole:
        hits = written(vocabulary_hits(words(queries, "q"), words(items, "w")), "hits")
        found = hits.groupBy("q").agg(F.array_sort(F.collect_set("w")).alias("words")).join(token_weights(hits, all_items), "q").withColumn("dense", F.lit(False))
    else:
        found, near = _listed(words(queries, "q"), words(items, "w"), all_items)
    tokens = queries.select("qid", "stems", F.posexplode("stems").alias("at", "q"))
    tokens = tokens.join(found, "q", "left").withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "words": F.coalesce("words", F.array().cast("array<string>")), "dense": F.coalesce("dense", F.lit(False))})
    lists = tokens.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "q", "weight", "words", "dense"))).alias("all"))
    plain = F.filter("all", lambda t: ~T.is_action_word(t["q"]))
    lists = lists.select("qid", F.when(F.size(plain) > 0, plain).otherwise(F.col("all")).alias("tokens"))
    return written(lists.withColumn("total", F.aggregate("tokens", F.lit(0.0), lambda s, t: s + t["weight"])), "lists"), near


def scored_pairs(queries: DataFrame, items: DataFrame, found: tuple[DataFrame, DataFrame | None], limit: int, least: float | None = None, actions: bool = True, units: bool = True, opposite: bool = True, capped: bool = False) -> DataFrame:
    """Pairs of a query and an item form that share a hit, with raw score: the best `limit` of
    each query that reach `least`, and few others.

    queries: qid, name, stems, phrase, action, unit_n. found: their token_lists. opposite: whether
    pairs of opposite actions count. capped: scores of TOP_SCORE and more are the same, and then shorter names and lower ords are better.
    """
    lists, near = found
    some_dense = near is not None and not lists.where(F.exists("tokens", lambda t: t["dense"])).isEmpty()
    beyond = fixed.SIMILARITY_SHARE + (fixed.UNIT_BONUS if units else 0.0)  # the most besides coverage
    share = lambda score: (score - ROUNDING - beyond) / fixed.COVERAGE_SHARE
    floor = 0.0 if least is None else max(0.0, share(least))
    apart = (fixed.UNIT_BONUS + fixed.UNIT_PENALTY) / fixed.COVERAGE_SHARE if units else 0.0  # what an item of another unit must hold more
    order = F.reverse(F.array_sort(F.transform(F.filter("tokens", lambda t: t["weight"] > 0), lambda t: F.struct(t["weight"].alias("weight"), t["at"].alias("at"), t["words"].alias("words"), t["q"].alias("q"), t["dense"].alias("dense")))))
    dealt = lists.where("total > 0").withColumn("order", order)  # rarest first
    asked = queries.join(lists.select("qid", "tokens", "total"), "qid").select("qid", "tokens", "total", F.col("phrase").alias("q_phrase"), F.col("action").alias("q_action"), F.col("unit_n").alias("q_unit"))
    post = items.select("iid", F.explode(F.array_distinct("stems")).alias("w"))
    differ = (F.col("q_action") != "") & (F.col("action") != "") & (F.col("q_action") != F.col("action"))

    def by_words(makers: DataFrame) -> DataFrame:
        """Pairs by the words of makers (qid, words, need)."""
        return makers.select("qid", "need", F.explode(F.array_distinct("words")).alias("w")).join(post, "w").select("qid", "iid", "need")

    def by_near(makers: DataFrame) -> DataFrame:
        """Pairs by words near the dense ones of makers (qid, order, need, need_apart, most, total) that an item must hold one of."""
        unit, action = (lambda c: c if units else F.lit("")), (lambda c: F.lit("") if opposite else c)
        makers = makers.join(queries.select("qid", unit(F.col("unit_n")).alias("unit"), action(F.col("action")).alias("action")), "qid")
        made = makers.select("*", F.posexplode("order").alias("i", "t")).where(F.col("t.dense") & (F.aggregate(F.slice("order", F.col("i") + 1, F.size("order")), F.lit(0.0), lambda s, t: s + t["weight"]) >= F.col("need") * F.col("total") - 1e-9))
        others = F.filter("order", lambda t: ~t["dense"])
        made = made.select(F.col("t.q").alias("word"), "qid", "need", (F.col("total") * (1 - F.col("need"))).alias("spare"), (F.col("total") * (1 - F.col("need_apart"))).alias("spare_apart"), "unit", "action", "most", F.array_join(F.transform(others, lambda t: t["q"]), " ").alias("others"), F.transform(others, lambda t: t["weight"]).alias("weights"))
        place = F.struct(F.length("name").cast("long").alias("length"), F.col("ord").cast("long").alias("ord")).alias("place")
        held = items.select("iid", "stems", unit(F.col("unit_n")).alias("unit"), action(F.col("action")).alias("action"), place, F.explode(F.array_distinct("stems")).alias("word")).join(near, "word", "left_semi")
        return alike.near_pairs(made, held.select("word", "iid", "unit", "action", "place", F.array_join(F.array_except("stems", F.array("word")), " ").alias("others")))

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs (qid, iid, need) with bounds of the score; those below need are left out."""
        pairs = pairs.groupBy("qid", "iid").agg(F.min("need").alias("need"))
        joined = pairs.join(items, "iid").join(asked, "qid")  # lists of words come last: they travel with queries, not with pairs
        by_list = lambda t: F.arrays_overlap(t["words"], F.col("stems"))
        holds = by_list
        if some_dense:
            unsure = F.transform(F.filter("tokens", lambda t: t["dense"] & ~by_list(t)), lambda t: t["q"])
            joined = joined.withColumn("sure", alike.found_of(unsure, "stems"))
            holds = lambda t: by_list(t) | F.array_contains(F.col("sure"), t["q"])
        held = F.aggregate(F.filter("tokens", holds), F.lit(0.0), lambda s, t: s + t["weight"])
        joined = joined.withColumn("coverage", held / F.col("total")).where(F.col("coverage") >= F.col("need") - 1e-9)
        joined = (joined if opposite else joined.where(~differ)).withColumn("sets", S.token_sets(F.col("q_phrase"), F.col("phrase")))
        score = lambda common: _score(F.col("coverage"), S.of_token_sets(F.col("sets"), common), actions, units)
        shorter = F.least(F.length("sets.jx"), F.length("sets.jy"))
        return joined.withColumns({"low": score(F.lit(0)), "high": score(shorter)}).drop("tokens", "total", "stems", "need", "sure", "q_phrase", "phrase")

    def kth(pairs: DataFrame) -> DataFrame:
        """qid, bar: what a pair must reach to be among the best `limit` of its query."""
        best = pairs.select("qid", "low").withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low")))).where(F.col("_n") <= limit)
        return best.groupBy("qid").agg(F.min("low").alias("bar"), F.count("*").alias("n")).where(F.col("n") == limit).select("qid", F.least("bar", F.lit(TOP_SCORE)).alias("bar"))

    def most(pairs: DataFrame) -> DataFrame:
        """qid, most: the length of the name and the ord of the k-th of the pairs that surely reach the top, k = limit: none that comes after it is among the best."""
        place = F.struct(F.length("name").cast("long").alias("length"), F.col("ord").cast("long").alias("ord"))
        sure = pairs.where(F.col("low") >= TOP_SCORE).select("qid", place.alias("most"))
        return sure.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("most"))).where(F.col("_n") == limit).drop("_n")

    first = written(bounded(by_words(dealt.select("qid", F.col("order")[0]["words"].alias("words"), F.lit(floor).alias("need")))), "first")
    rest = lambda i: F.aggregate(F.slice("order", i + 1, F.size("order")), F.lit(0.0), lambda s, t: s + t["weight"])
    more = dealt.where((F.size("order") > 1) | F.col("order")[0]["dense"]).join(kth(first), "qid", "left").withColumn("need", F.greatest(F.lit(floor), F.coalesce(share(F.col("bar")), F.lit(0.0))))
    # What a score needs besides coverage is the less the more units give; without a bar or a least score nothing is needed.
    given = F.lit(least is not None) | F.col("bar").isNotNull()
    least_apart = F.greatest(F.lit(-1e9 if least is None else share(least)), F.coalesce(share(F.col("bar")), F.lit(-1e9))) + apart
    more = more.withColumn("need_apart", F.when(given, F.greatest(F.col("need"), least_apart)).otherwise(F.col("need")))
    makers = F.filter("order", lambda t, i: (i > 0) & (rest(i) >= F.col("need") * F.col("total") - 1e-9))
    pairs = by_words(more.select("qid", F.flatten(F.transform(makers, lambda t: t["words"])).alias("words"), "need").where(F.size("words") > 0))
    if some_dense:
        more = more.join(most(first), "qid", "left") if capped else more.withColumn("most", F.lit(None).cast("struct<length:long,ord:long>"))
        pairs = pairs.unionByName(by_near(more))
    seen = first.unionByName(bounded(pairs.join(first.select("qid", "iid"), ["qid", "iid"], "left_anti")))
    seen = written(seen, "seen")
    bars = seen.join(kth(seen), "qid", "left").where(F.least("high", F.lit(TOP_SCORE)) >= F.coalesce("bar", F.lit(-1e9)) - ROUNDING)
    kept = bars if least is None else bars.where(F.col("high") >= least - ROUNDING)
    similarity = S.of_token_sets(F.col("sets"), S.common_length(F.col("sets.jx"), F.col("sets.jy")))
    return kept.withColumn("raw", _score(F.col("coverage"), similarity, actions, units)).drop("sets", "low", "high", "bar")


def _score(coverage: Column, similarity: Column, actions: bool, units: bool) -> Column:
    score = fixed.COVERAGE_SHARE * coverage + fixed.SIMILARITY_SHARE / 100 * similarity
    if actions:
        differ = (F.col("q_action") != "") & (F.col("action") != "") & (F.col("q_action") != F.col("action"))
        score = score - F.when(differ, fixed.ACTION_PENALTY).otherwise(0.0)
    if units:
        both = (F.col("q_unit") != "") & (F.col("unit_n") != "")
        score = score + F.when(both & (F.col("q_unit") == F.col("unit_n")), fixed.UNIT_BONUS).when(both, -fixed.UNIT_PENALTY).otherwise(0.0)
    return score


def asked_names(df: DataFrame) -> DataFrame:
    """The distinct (name, unit) of df with their parts: what match makes of its queries; several matches can share it."""
    distinct = df.select("name", "unit").distinct().where(F.trim(F.coalesce("name", F.lit(""))) != "")
    # Distinct names are few next to rows and used many times over: written once, with a number that no other has.
    return written(with_name_parts(distinct).withColumn("qid", F.monotonically_increasing_id()), "queries")


def _queries(df: DataFrame) -> DataFrame:
    return df if "qid" in df.columns else asked_names(df)


def _items(items: DataFrame, keep: int) -> DataFrame:
    return written(item_forms(items, keep).withColumn("iid", F.monotonically_increasing_id()), "items")


def _ranked(pairs: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.length("name"), "ord")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


RESULT = ("code", "score", "match_name", "match_unit", "category", "labor", "material", "machines")


def _result(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "code", "score", F.col("name").alias("match_name"), F.col("unit").alias("match_unit"), "category", "labor", "material", "machines")


def match(queries: DataFrame, items: DataFrame, limit: int = 1) -> DataFrame:
    """Best items for each distinct (name, unit): name, unit, rank and RESULT.

    An exact key whose unit agrees scores 100; else pairs of MIN_SCORE or more, to one
    decimal, opposite actions left out.
    """
    q, forms = _queries(queries), _items(items, limit)
    # The key with the unit is tried before the bare phrase; the index is read once, for both.
    key = F.when(F.col("unit_n") != "", F.concat_ws("|", "phrase", "unit_n")).otherwise(F.col("phrase"))
    named = q.select("qid", "unit_n", F.posexplode(F.array(key, "phrase")).alias("at", "key")).join(exact_index(forms), "key")
    named = named.groupBy("qid", "unit_n").agg(F.min(F.struct("at", "item")).alias("first")).select("qid", "unit_n", "first.item")
    sure = (F.col("unit_n") == "") | (T.normalise_unit(F.col("item.unit")) == F.col("unit_n"))
    exact = named.where(sure).select("qid", F.lit(1).alias("rank"), "item.code", F.lit(100.0).alias("score"), F.col("item.name").alias("match_name"), F.col("item.unit").alias("match_unit"), "item.category", "item.labor", "item.material", "item.machines")
    exact = written(exact, "exact")
    rest = q.join(exact.select("qid"), "qid", "left_anti")
    pairs = scored_pairs(rest, forms, token_lists(rest, forms, items, whole=False), limit, fixed.MIN_SCORE, opposite=False, capped=True)
    pairs = pairs.withColumn("score", F.round(F.least("raw", F.lit(TOP_SCORE)), 1)).where(F.col("score") >= fixed.MIN_SCORE)
    found = exact.unionByName(_result(_ranked(pairs, limit)))
    return q.select("qid", "name", "unit").join(found, "qid").drop("qid")


def candidates(queries: DataFrame, items: DataFrame, limit: int = 5) -> DataFrame:
    """The best so many items of each distinct (name, unit), whatever they score.

    Items that share no word with a query score by similarity and unit only, at most `most`;
    queries with fewer than `limit` better pairs are filled up with the best of them.
    """
    q = _queries(queries)
    q = q.where(F.size("stems") > 0)
    forms = _items(items, limit)
    lists, _ = token_lists(q, forms, items)
    pairs = written(scored_pairs(q, forms, (lists, None), limit).select("qid", "raw", "code", "name", "unit", "category", "labor", "material", "machines", "ord"), "pairs")
    most = fixed.SIMILARITY_SHARE + fixed.UNIT_BONUS
    few = q.join(pairs.where(F.col("raw") > most).groupBy("qid").count().where(F.col("count") >= limit), "qid", "left_anti")
    found = lists.select("qid", F.array_distinct(F.flatten(F.transform("tokens", lambda t: t["words"]))).alias("found"))
    kth = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("raw")))).where(F.col("_n") == limit).select("qid", F.col("raw").alias("bar"))
    side = few.join(found, "qid").join(kth, "qid", "left").select("qid", "found", F.col("phrase").alias("q_phrase"), F.col("action").alias("q_action"), F.col("unit_n").alias("q_unit"), "bar")
    side = written(side, "few")
    both = pairs
    if not side.isEmpty():
        both = pairs.unionByName(fill(side, forms, limit).join(forms, "iid").select(*pairs.columns))
    both = both.withColumn("score", F.round(F.least("raw", F.lit(TOP_SCORE)), 1))
    return q.select("qid", F.col("name").alias("query_name"), F.col("unit").alias("query_unit")).join(_result(_ranked(both, limit)), "qid").drop("qid").withColumnsRenamed({"query_name": "name", "query_unit": "unit"})


def search(texts: DataFrame, items: DataFrame, limit: int = 20, category: str | None = None) -> DataFrame:
    """Items for search texts (column text); an empty text lists the first items, score 0.

    With a category, three times as many are fetched, then filtered, made distinct by code
    and cut: the order in which the catalogue's search has always worked.
    """
    fetch = limit * 3 if category else limit
    q = texts.select(F.trim(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    asked = with_name_parts(q.where("text <> ''").select("text", F.col("text").alias("name"), F.lit("").alias("unit"))).where(F.size("stems") > 0)
    asked = written(asked.withColumn("qid", F.monotonically_increasing_id()), "asked")
    forms = _items(items, fetch).withColumn("category_stems", T.stems(F.col("category")))
    named = scored_pairs(asked, forms, token_lists(asked, forms, items, whole=False), fetch, fixed.SEARCH_SCORE, actions=False, units=False).select("qid", "iid", "raw")
    hits = vocabulary_hits(asked.select(F.explode("stems").alias("q")).distinct(), forms.select(F.explode("category_stems").alias("w")).distinct())
    by_category = (
        asked.select("qid", F.explode("stems").alias("q")).join(hits, "q").select("qid", "w").distinct()
        .join(forms.select("iid", F.explode(F.array_distinct("category_stems")).alias("w")), "w").select("qid", "iid", F.lit(fixed.CATEGORY_SCORE).alias("raw"))
    )
    best = named.unionByName(by_category).groupBy("qid", "iid").agg(F.max("raw").alias("raw")).where(F.col("raw") >= fixed.SEARCH_SCORE)
    ranked = _ranked(best.join(forms, "iid").withColumn("score", F.round(F.least("raw", F.lit(100.0)), 1)), fetch)
    found = asked.select("qid", "text").join(_result(ranked), "qid").drop("qid")
    first = items.orderBy("ord", "code").limit(fetch) if category is None else items.where(F.col("category") == category).orderBy("ord", "code").limit(limit)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy("ord", "code")))  # at most `limit` rows
    blank = q.where("text = ''").join(first, F.lit(True)).select("text", "rank", "code", F.lit(0.0).alias("score"), F.col("name").alias("match_name"), F.col("unit").alias("match_unit"), "category", "labor", "material", "machines")
    if category is not None:
        found = found.where(F.col("category") == category)
        once = Window.partitionBy("text", "code").orderBy("rank")
        found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy("rank"))).where(F.col("rank") <= limit)
    return found.unionByName(blank)


def search_totals(texts: DataFrame, items: DataFrame, limit: int = 20, category: str | None = None) -> DataFrame:
    """text, total: how many items a search gives; for an empty text, how many there are."""
    found = search(texts, items, limit, category).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    kept = items if category is None else items.where(F.col("category") == category)
    every = kept.agg(F.count("*").alias("every"))  # one row
    asked = texts.select(F.trim(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    total = F.when(F.col("text") == "", F.col("every")).otherwise(F.coalesce("n", F.lit(0)))
    return asked.join(found, "text", "left").join(F.broadcast(every)).select("text", total.alias("total"))


def site_items(site_prices: DataFrame) -> DataFrame:
    """Rows of a site's price list as items: their price is for labour."""
    zero = F.lit(0).cast("decimal(18,6)")
    return site_prices.select("ord", F.concat(F.lit("site-"), F.col("ord").cast("string")).alias("code"), "name", "unit", "category", F.col("price").cast("decimal(18,6)").alias("labor"), zero.alias("material"), zero.alias("machines"))


def scaled(price: Column, factor: Column) -> Column:
    return F.round(price.cast("decimal(18,6)") * factor.cast("decimal(6,3)"), 2).cast("decimal(18,2)")


def bulk_match(positions: DataFrame, items: DataFrame, min_score: float = fixed.MIN_SCORE, keep_manual: bool = True) -> DataFrame:
    """Positions with the catalogue's price where one matches, and a status each.

    positions: position_id, name, unit, manual, factor and price columns. status: manual
    (skipped), confident, review or not_found.
    """
    best = match(positions, items).where(F.col("score") >= min_score).drop("rank")
    names = {c: f"m_{c}" for c in RESULT}
    joined = positions.join(best.withColumnsRenamed(names), ["name", "unit"], "left")
    skip = F.col("manual") if keep_manual else F.lit(False)
    status = F.when(skip, "manual").when(F.col("m_code").isNull(), "not_found").when(F.col("m_score") >= fixed.CONFIDENT, "confident").otherwise("review")
    found = ~skip & F.col("m_code").isNotNull()
    price = lambda p: F.when(found, scaled(F.col(f"m_{p}"), F.col("factor"))).otherwise(F.col(f"{p}_price").cast("decimal(18,2)"))
    return joined.withColumns(
        {"status": status, "match_code": F.when(found, F.col("m_code")).otherwise(F.lit("")), "match_score": F.when(found, F.col("m_score")).otherwise(F.lit(0.0))}
        | {f"{p}_price": price(p) for p in ("labor", "material", "machines")}
    ).drop(*names.values())


def match_statistics(matched: DataFrame, *by: str) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    return matched.groupBy(*by).agg(
        F.count("*").alias("total"), n("confident", "review")("applied"), n("confident")("confident"), n("review")("review"), n("not_found")("not_found"), n("manual")("skipped_manual")
    )


def review_list(matched: DataFrame, items: DataFrame, limit: int = 6) -> DataFrame:
    """Positions to look at, each with its best candidates, their units and scaled prices.

    Columns number (through the estimate) and quantity are passed on where the positions have them.
    """
    look = matched.where(F.col("status").isin("review", "not_found"))
    found = candidates(look, items, limit)
    own = ["position_id", "name", "unit", *(c for c in ("number", "quantity") if c in look.columns), "match_code", "match_score"]
    joined = look.select(*own, "factor").join(found, ["name", "unit"], "left")
    one = F.struct("rank", "code", "match_name", "match_unit", "score", *(scaled(F.col(p), F.col("factor")).alias(p) for p in ("labor", "material", "machines")))
    return joined.groupBy(*own).agg(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), one))).alias("candidates"))


def position_candidates(positions: DataFrame, items: DataFrame, limit: int = 6) -> DataFrame:
    """position_id, rank, code, match_name, match_unit, score and prices scaled by the
    position's factor: the best items of every position."""
    found = candidates(positions, items, limit)
    joined = positions.select("position_id", "name", "unit", "factor").join(found, ["name", "unit"])
    return joined.select("position_id", "rank", "code", "match_name", "match_unit", "score", *(scaled(F.col(p), F.col("factor")).alias(p) for p in ("labor", "material", "machines")))


def apply_choices(positions: DataFrame, choices: DataFrame, items: DataFrame) -> DataFrame:
    """Positions with the items that were chosen for them (position_id, code)."""
    chosen = choices.join(items.select("code", F.col("unit").alias("c_unit"), *(F.col(p).alias(f"c_{p}") for p in ("labor", "material", "machines"))), "code")
    joined = positions.join(chosen.withColumnRenamed("code", "c_code"), "position_id", "left")
    hit = F.col("c_code").isNotNull()
    return joined.withColumns(
        {f"{p}_price": F.when(hit, scaled(F.col(f"c_{p}"), F.col("factor"))).otherwise(F.col(f"{p}_price").cast("decimal(18,2)")) for p in ("labor", "material", "machines")}
        | {
            "unit": F.when(hit & (F.coalesce("unit", F.lit("")) == ""), F.col("c_unit")).otherwise(F.col("unit")),
            "price_source": F.when(hit, "catalog").otherwise(F.col("price_source")), "match_code": F.when(hit, F.col("c_code")).otherwise(F.col("match_code")),
            "match_score": F.when(hit, 100.0).otherwise(F.col("match_score")), "manual": F.when(hit, False).otherwise(F.col("manual")),
        }
    ).drop("c_code", "c_unit", "c_labor", "c_material", "c_machines")
