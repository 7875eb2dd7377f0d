"""Where a price comes from: history, site, web or catalogue, and the budget of live queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import fixed
from tallyspark.functions import text as T
from tallyspark.operators import catalog, match
from tallyspark.sources import snapshots
from tallyspark.sources.shared import written

PRICES = ("labor", "material", "machines")


def money_round(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def keyed(df: DataFrame) -> DataFrame:
    """Adds work_key to rows with name and unit: made once for each distinct pair of them, which
    are few next to rows, and joined back."""
    n, u = F.col("name"), F.col("unit")
    keys = written(df.select("name", "unit").distinct().select(n.alias("n"), u.alias("u"), T.work_key(n, u).alias("work_key")), "keys")
    return df.join(keys, n.eqNullSafe(F.col("n")) & u.eqNullSafe(F.col("u"))).drop("n", "u")


def history_facts(positions: DataFrame) -> DataFrame:
    """Facts to append to the price history: positions with any price, cleaned, with their key.

    positions: name, unit, city, region, labor_price, material_price, machines_price, ...
    """
    any_price = sum((F.coalesce(F.col(f"{p}_price"), F.lit(0)) != 0).cast("int") for p in PRICES) > 0
    facts = positions.where(any_price)
    # Names and units are few next to positions: their forms are made once for each and joined back.
    n, u = F.col("name"), F.col("unit")
    forms = facts.select("name", "unit").distinct().select(n.alias("n"), u.alias("u"), T.work_key(n, u).alias("work_key"), T.clean_text(n).alias("f_name"), T.normalise_unit(u).alias("f_unit"))
    joined = facts.join(written(forms, "forms"), n.eqNullSafe(F.col("n")) & u.eqNullSafe(F.col("u"))).drop("n", "u")
    changed = {"name": F.col("f_name"), "unit": F.col("f_unit"), "city": T.clean_once(F.col("city")), "region": T.clean_once(F.col("region"))}
    return joined.withColumns(changed).drop("f_name", "f_unit")


#: Tasks that the facts of one key are dealt to, at most, when they are appended.
SALTS = 16


def append_history(facts: DataFrame, path: str, state: str | None = None) -> None:
    """Append-only, sorted by key within files so that reads for a key skip row groups; facts of a
    key that very many have go to several files. state: a table of the latest facts (see
    latest_facts) that is brought up to date, so that prices need no read of all history."""
    salt = F.pmod(F.xxhash64("created_at", *(f"{p}_price" for p in PRICES), "name"), F.lit(SALTS))
    dealt = facts.withColumn("_salt", salt).repartition("work_key", "_salt").drop("_salt")
    dealt.sortWithinPartitions("work_key", "created_at").write.mode("append").parquet(path)
    if state is not None:
        new = latest_facts(facts)
        old = snapshots.read(facts.sparkSession, state)
        snapshots.replace_all(new if old is None else merge_facts(old, new), state)


#: Scopes of history prices in the order in which they are tried, and their labels.
SCOPES = {"city": "місто ", "region": "область ", "all": "уся історія"}


def _scopes(city: Column, region: Column) -> Column:
    """array<struct<rank, place>>: the scopes of a row; a city or region that is not known is none."""
    known = lambda c: F.coalesce(c, F.lit(""))
    every = F.array(*(F.struct(F.lit(i).alias("rank"), known(c).alias("place")) for i, c in enumerate((city, region, F.lit("")))))
    return F.filter(every, lambda s: (s["rank"] == 2) | (s["place"] != ""))


_FACT = ("work_key", "rank", "place", "id", "created_at", *(f"{p}_price" for p in PRICES))


def _latest(facts: DataFrame, window: int) -> DataFrame:
    """The last so many of each key and scope: row_number <= window is pushed below the shuffle as
    a group limit, so a key with very many facts sends few rows."""
    order = Window.partitionBy("work_key", "rank", "place").orderBy(F.desc("created_at"), F.desc("id"))
    return facts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= window).drop("_n")


def latest_facts(history: DataFrame, window: int = fixed.HISTORY_WINDOW) -> DataFrame:
    """The latest facts of each key and scope (rank, place): all that prices are made of."""
    scoped = history.select("work_key", "id", "created_at", *(f"{p}_price" for p in PRICES), F.inline(_scopes(F.col("city"), F.col("region"))))
    return _latest(scoped, window).select(*_FACT)


def merge_facts(state: DataFrame, new: DataFrame, window: int = fixed.HISTORY_WINDOW) -> DataFrame:
    """The latest facts of two states, whatever their order: what latest_facts gives for both histories."""
    return _latest(state.select(*_FACT).unionByName(new.select(*_FACT)), window)


def history_price(asked: DataFrame, history: DataFrame, window: int = fixed.HISTORY_WINDOW) -> DataFrame:
    """For each distinct (work_key, city, region): medians of the first scope with facts,
    tried in the order city, region, all. history: id, work_key, city, region, prices, created_at.

    Only facts of asked keys are dealt, all scopes in one pass.
    """
    asked = written(asked.select("work_key", "city", "region").distinct(), "asked")  # read twice
    keys = written(asked.select("work_key").distinct(), "keys")  # Spark compares its size with its broadcast threshold
    return price_from_facts(asked, latest_facts(history.join(keys, "work_key", "left_semi"), window))


def price_from_facts(asked: DataFrame, latest: DataFrame) -> DataFrame:
    """The same from a state of latest facts."""
    found = latest.groupBy("work_key", "rank", "place").agg(
        *(money_round(F.median(f"{p}_price").cast("decimal(18,6)")).alias(p) for p in PRICES),
        F.count("*").alias("samples"), F.max("created_at").alias("last_used"),
    )
    wanted = asked.select("work_key", "city", "region").distinct().select("*", F.inline(_scopes(F.col("city"), F.col("region"))))
    best = wanted.join(found, ["work_key", "rank", "place"]).groupBy("work_key", "city", "region").agg(F.min(F.struct("rank", "place", *PRICES, "samples", "last_used")).alias("h"))
    labels = list(SCOPES.values())
    label = F.when(F.col("h.rank") == 2, labels[2]).otherwise(F.concat(F.when(F.col("h.rank") == 0, labels[0]).otherwise(labels[1]), "h.place"))
    return best.select("work_key", "city", "region", *(f"h.{p}" for p in PRICES), "h.samples", label.alias("scope"), "h.last_used")


def fresh_cache(asked: DataFrame, cache: DataFrame, as_of: str, days: int = fixed.CACHE_DAYS) -> DataFrame:
    """Cached prices of (work_key, city, provider) younger than so many days at a given time."""
    young = cache.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days"))
    return asked.join(young, ["work_key", "city", "provider"])


def update_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row by (work_key, city, provider); only new rows with a price count."""
    both = cache.unionByName(new.where((F.col("labor") != 0) | (F.col("material") != 0)).select(*cache.columns))
    order = Window.partitionBy("work_key", "city", "provider").orderBy(F.desc("created_at"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def site_age(site_prices: DataFrame, as_of: str, limit: int = fixed.SITE_DAYS) -> DataFrame:
    """site, days since its oldest row, whether it is due."""
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.min("fetched_at").cast("timestamp").cast("double")) / 86400
    return site_prices.groupBy("site").agg(F.round(age, 6).alias("age_days")).withColumn("stale", F.col("age_days").isNull() | (F.col("age_days") >= limit))


def overwrite_site(rows: DataFrame, path: str) -> None:
    """Replace the snapshots of the sites in rows, and only those, in one step: readers see the
    old rows until the new ones are all there."""
    keyed = rows.withColumns({"price": F.col("price").cast("decimal(18,2)"), "work_key": T.work_key(F.col("name"), F.col("unit"))})
    snapshots.replace_parts(keyed, path, "site")


def read_site(spark, path: str, site: str) -> DataFrame:
    """Rows of one site in the order of the snapshot; other sites' folders are not read."""
    return snapshots.read_part(spark, path, "site", site).orderBy("ord")


def store_cache(new: DataFrame, path: str) -> None:
    """Upsert web answers into the stored cache, in one step."""
    old = snapshots.read(new.sparkSession, path)
    snapshots.replace_all(update_cache(new.limit(0) if old is None else old, new), path)


#: What is told about a price beside its source: fields of other sources are null.
DETAILS = {
    "samples": "long", "scope": "string", "last_used": "string", "provider": "string", "cached": "boolean", "found_prices": "array<struct<value:double,unit:string,kind:string>>",
    "site": "string", "matched": "string", "unit": "string", "category": "string", "score": "double", "factor": "double", "code": "string", "base_labor": "decimal(18,6)",
}
#: Prices of a web answer that its details show.
SHOWN_PRICES = 6
_SOURCE = f"struct<source:string,{','.join(f'{p}:decimal(18,2)' for p in PRICES)},details:struct<{','.join(f'{k}:{v}' for k, v in DETAILS.items())}>>"


def _source(name: str, prices: list[Column], **details: Column) -> Column:
    told = F.struct(*(details.get(k, F.lit(None)).cast(t).alias(k) for k, t in DETAILS.items()))
    return F.struct(F.lit(name), *prices, told).cast(_SOURCE)


def _web_source(web: DataFrame, cached: bool) -> DataFrame:
    """work_key, city, s_web or s_cache: what a web answer gives; answers without a price are none."""
    zero = F.lit(0).cast("decimal(18,2)")
    more = {"provider": F.col("provider")} if "provider" in web.columns else {}
    if "samples" in web.columns:
        more["found_prices"] = F.transform(F.slice("samples", 1, SHOWN_PRICES), lambda x: F.struct(x["value"].cast("double").alias("value"), x["unit"].alias("unit"), x["kind"].alias("kind")))
    found = web.where((F.col("labor") != 0) | (F.col("material") != 0))
    source = _source("web", [F.col("labor").cast("decimal(18,2)"), F.col("material").cast("decimal(18,2)"), zero], cached=F.lit(cached), **more)
    return found.select("work_key", "city", source.alias("s_cache" if cached else "s_web"))


def _sources(asked: DataFrame, history: DataFrame, items: DataFrame, site_prices: DataFrame | None, web: DataFrame | None, order: list[str]) -> DataFrame:
    """For each distinct (name, unit, city, region): work_key, factor, region_label, c (the
    catalogue's item) and s_<source>, the price that each source of the order has, or null."""
    asked = written(asked.select("name", "unit", "city", "region").distinct(), "requests")  # read by each source
    names = match.asked_names(asked)
    factor, label = catalog.region_factor(F.col("city"), F.col("region"))
    base = keyed(asked).withColumns({"factor": factor, "region_label": label})
    zero, by_factor = F.lit(0).cast("decimal(18,2)"), F.col("factor").cast("double")
    scaled = lambda c: match.scaled(c, F.col("factor"))
    best = match.match(names, items).select("name", "unit", F.struct("code", "match_name", "score", "category", *PRICES).alias("c"))
    base = base.join(best, ["name", "unit"], "left")
    base = base.withColumn("s_catalog", F.when(F.col("c").isNotNull(), _source("catalog", [scaled(F.col(f"c.{p}")) for p in PRICES], code=F.col("c.code"), category=F.col("c.category"), base_labor=F.col("c.labor"), factor=by_factor, score=F.col("c.score"))))
    if "history" in order:
        facts = history_price(base, history).select("work_key", "city", "region", F.struct(*PRICES, "samples", "scope", "last_used").alias("h"))
        base = base.join(facts, ["work_key", "city", "region"], "left")
        base = base.withColumn("s_history", F.when(F.col("h").isNotNull(), _source("history", [F.col(f"h.{p}") for p in PRICES], samples=F.col("h.samples"), scope=F.col("h.scope"), last_used=F.col("h.last_used")))).drop("h")
    if "site" in order and site_prices is not None:
        site = match.match(names, match.site_items(site_prices)).where(F.col("labor") != 0)
        of = site_prices.select(F.concat(F.lit("site-"), F.col("ord").cast("string")).alias("code"), F.col("site") if "site" in site_prices.columns else F.lit(None).cast("string").alias("site"))
        site = site.join(of, "code").select("name", "unit", F.struct("labor", "site", "match_name", "match_unit", "category", "score").alias("s"))
        base = base.join(site, ["name", "unit"], "left")
        told = {"site": F.col("s.site"), "matched": F.col("s.match_name"), "unit": F.col("s.match_unit"), "category": F.col("s.category"), "score": F.col("s.score"), "factor": by_factor}
        base = base.withColumn("s_site", F.when(F.col("s").isNotNull(), _source("site", [scaled(F.col("s.labor")), zero, zero], **told))).drop("s")
    if "web" in order and web is not None:
        base = base.join(_web_source(web, False), ["work_key", "city"], "left")
    none = [s for s in ("catalog", "history", "site", "web") if f"s_{s}" not in base.columns]
    return base.withColumns({f"s_{s}": F.lit(None).cast(_SOURCE) for s in none})


def _chosen(order: list[str]) -> Column:
    """The first source of the order that has a price."""
    zero = F.lit(0).cast("decimal(18,2)")
    return F.coalesce(*(F.col(f"s_{s}") for s in order), _source("none", [zero, zero, zero]))


def resolve(asked: DataFrame, history: DataFrame, items: DataFrame, site_prices: DataFrame | None = None, web: DataFrame | None = None, strategy: str = fixed.DEFAULT_STRATEGY) -> DataFrame:
    """A price for each distinct (name, unit, city, region), from the first source that has one,
    with details of where it comes from.

    web: work_key, city, labor, material, and if known provider and samples. Each source is one
    join per distinct request. Nothing is spent here: see reprice_in_order for a budget.
    """
    order = fixed.STRATEGIES.get(strategy, fixed.STRATEGIES[fixed.DEFAULT_STRATEGY])
    parts = ["source", *PRICES]
    return _sources(asked, history, items, site_prices, web, order).withColumn("r", _chosen(order)).select(
        "name", "unit", "city", "region", "factor", "region_label", *(f"r.{p}" for p in parts), T.source_label(F.col("r.source")).alias("source_label"),
        F.coalesce("c.code", F.lit("")).alias("match_code"), F.coalesce("c.match_name", F.lit("")).alias("match_name"), F.coalesce("c.score", F.lit(0.0)).alias("match_score"), "r.details",
    )


def reprice_in_order(
    positions: DataFrame, history: DataFrame, items: DataFrame, site_prices: DataFrame | None, web: DataFrame, cache: DataFrame | None = None, strategy: str = fixed.DEFAULT_STRATEGY,
    limit: int = fixed.QUERY_LIMIT, use_cache: bool = True, keep_manual: bool = True, run: str = "object_id", seq: tuple[str, ...] = ("estimate_ord", "division_ord", "ordinal", "position_id"),
) -> tuple[DataFrame, DataFrame]:
    """Positions repriced under a budget of live queries, and statistics of each run.

    Positions of a run are taken in the order of `seq` (which names each). One reaches the web if no
    source before it has a price; cache (work_key, city, labor, material: fresh answers) and what
    was found before in the run cost nothing; a request beyond the limit falls through to the
    next source. Without the cache each request that reaches the web is live.
    """
    order = fixed.STRATEGIES.get(strategy, fixed.STRATEGIES[fixed.DEFAULT_STRATEGY])
    keys = ["name", "unit", "city", "region"]
    sources = _sources(positions, history, items, site_prices, web, order).drop("factor", "region_label")
    if cache is not None and use_cache:
        sources = sources.join(_web_source(cache, True), ["work_key", "city"], "left")
    else:
        sources = sources.withColumn("s_cache", F.lit(None).cast(_SOURCE))
    # Requests are few next to positions: they are written with a number each, and positions carry
    # that number and what is asked about it; what the sources say is joined at the end.
    sources = written(sources.withColumn("_rid", F.monotonically_increasing_id()), "sources")
    skip = F.coalesce(F.col("manual"), F.lit(False)) if keep_manual else F.lit(False)
    if "web" in order:
        before = [F.col(f"s_{s}").isNull() for s in order[: order.index("web")]]
        first = F.lit(True)
        for b in before:
            first = first & b
        told = {"_first": first, "_cached": F.col("s_cache").isNotNull(), "_found": F.col("s_web").isNotNull()}
        rows = positions.join(sources.select(*keys, "_rid", F.col("work_key").alias("_work"), *(c.alias(k) for k, c in told.items())), keys, "left")
        rows = rows.withColumn("_reach", ~skip & F.coalesce("_first", F.lit(True))).drop("_first")
        rows = written(rows, "reached").withColumns(
            {"_run": F.col(run), "_seq": F.struct(*seq), "_skip": skip, "_key": F.concat_ws("\n", "_work", "city"), **{c: F.coalesce(c, F.lit(False)) for c in ("_cached", "_found")}}
        )
        asked = _with_status(rows.where("_reach"), limit, use_cache, ("_run", "_seq", "_key", "_cached", "_found"), "_status")
        rest = rows.where("NOT _reach").withColumn("_status", F.lit(None).cast("string"))
        told = sources.select("_rid", "c", *(f"s_{s}" for s in dict.fromkeys((*order, "cache", "web"))))
        joined = asked.unionByName(rest).join(told, "_rid", "left")
        again = F.col("s_web").withField("details", F.col("s_web.details").withField("cached", F.lit(True)))
        answer = F.when(F.col("_status") == "used", F.col("s_web")).when(F.col("_status") == "cached", F.coalesce("s_cache", again))
        joined = joined.withColumn("s_web", answer)
        spent = budget(asked.select(F.col("_run").alias("run"), F.col("_status").alias("status")), limit)
    else:
        joined = positions.join(sources, keys, "left").withColumns({"_run": F.col(run), "_skip": skip})
        spent = joined.select(F.col("_run").alias("run"), F.lit(limit).alias("limit"), *(F.lit(0).cast("long").alias(c) for c in ("used", "blocked", "from_cache"))).limit(0)
    r = joined.withColumn("r", _chosen(order))
    set_to = lambda old, new: F.when(F.col("_skip"), old).otherwise(new)
    none = F.lit(None).cast(_SOURCE)["details"]
    out = r.withColumns(
        {f"{p}_price": set_to(F.col(f"{p}_price").cast("decimal(18,2)"), F.col(f"r.{p}")) for p in PRICES}
        | {
            "price_source": set_to(F.lit("manual"), F.col("r.source")), "match_code": set_to(F.lit(""), F.coalesce("c.code", F.lit(""))), "match_score": set_to(F.lit(0.0), F.coalesce("c.score", F.lit(0.0))),
            "details": set_to(none, F.col("r.details")), "skipped": F.col("_skip"), "manual": F.col("_skip"),
        }
    )
    added = ["price_source", "match_code", "match_score", "details", "skipped"]
    out = out.select(*positions.columns, *(c for c in added if c not in positions.columns))
    statistics = reprice_statistics(out, run).join(spent.withColumnRenamed("run", run), run, "left")
    return out, statistics.withColumns({"limit": F.lit(limit), **{c: F.coalesce(c, F.lit(0)) for c in ("used", "blocked", "from_cache")}})


def live_queries(asked: DataFrame, limit: int = fixed.QUERY_LIMIT, use_cache: bool = True) -> DataFrame:
    """Which requests reach the web. asked: run, seq, work_key, cached, found.

    A request is live if nothing fresh is cached and it is the first of its key in the run, or
    its key is never found (what is not found is not cached). The first `limit` live ones
    are used (0: all); later requests of a key whose first one was blocked are blocked too.
    Without the cache each request is live.
    """
    return _with_status(asked, limit, use_cache, ("run", "seq", "work_key", "cached", "found"), "status")


def _with_status(asked: DataFrame, limit: int, use_cache: bool, names: tuple[str, str, str, str, str], out: str) -> DataFrame:
    """live_queries with the names of its columns. Rows stay where they are: what is known of a run
    and of its keys is written, so that Spark can send it to them if it is small."""
    run, seq, key, cached, found = names
    columns = asked.columns
    if not use_cache:
        asked = asked.withColumn(cached, F.lit(False))
    firsts = written(asked.groupBy(run, key).agg(F.min(seq).alias("_first_seq")), "firsts")  # combined before the shuffle
    known = asked.join(firsts, [run, key])
    first = ~F.col(cached) & (~F.col(found) | (F.col(seq) == F.col("_first_seq")))
    known = known.withColumn("_live", first if use_cache else F.lit(True))
    if limit:
        # The last live request that is used: a group limit below the shuffle leaves `limit` rows a run.
        order = Window.partitionBy(run).orderBy(seq)
        used = known.where("_live").select(run, seq).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
        last = written(used.groupBy(run).agg(F.max(seq).alias("_last_seq")), "last")  # fewer live ones than the limit: all of them
        known = known.join(last, run, "left")
        allowed = lambda c: F.col(c) <= F.col("_last_seq")
    else:
        allowed = lambda c: F.lit(True)
    status = (
        F.when(F.col(cached), "cached").when(F.col("_live") & allowed(seq), "used").when(F.col("_live"), "blocked")
        .when(allowed("_first_seq"), "cached").otherwise("blocked")
    )
    return known.withColumn(out, status).select(*columns, out)


def budget(statuses: DataFrame, limit: int = fixed.QUERY_LIMIT) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.groupBy("run").agg(F.lit(limit).alias("limit"), n("used").alias("used"), n("blocked").alias("blocked"), n("cached").alias("from_cache"))


def reprice(positions: DataFrame, resolved: DataFrame, keep_manual: bool = True) -> DataFrame:
    """Positions with new prices and sources; manual ones stay if asked to."""
    keys = ["name", "unit", "city", "region"]
    renamed = resolved.select(*keys, *(F.col(p).alias(f"r_{p}") for p in PRICES), F.col("source").alias("r_source"), F.col("match_code").alias("r_code"), F.col("match_score").alias("r_score"))
    skip = F.col("manual") if keep_manual else F.lit(False)
    joined = positions.join(written(renamed, "resolved"), keys, "left")  # few next to positions: Spark sees its size
    set_to = lambda old, new: F.when(skip, old).otherwise(new)
    return joined.withColumns(
        {f"{p}_price": set_to(F.col(f"{p}_price").cast("decimal(18,2)"), F.col(f"r_{p}")) for p in PRICES}
        | {
            "price_source": set_to(F.col("price_source"), F.col("r_source")), "match_code": set_to(F.lit(""), F.col("r_code")),
            "match_score": set_to(F.lit(0.0), F.col("r_score")), "skipped": skip, "manual": skip,
        }
    ).drop("r_labor", "r_material", "r_machines", "r_source", "r_code", "r_score")


def reprice_statistics(repriced: DataFrame, *by: str) -> DataFrame:
    done = ~F.col("skipped")
    return repriced.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("skipped")).alias("skipped_manual"),
        F.count_if(done & (F.col("price_source") == "none")).alias("not_found"), F.count_if(done & (F.col("price_source") != "none")).alias("priced"),
    )


def by_source(repriced: DataFrame, *by: str) -> DataFrame:
    return repriced.where(~F.col("skipped")).groupBy(*by, T.source_label(F.col("price_source")).alias("source_label")).count().withColumnRenamed("count", "n")


def fill_added(new: DataFrame, resolved: DataFrame, items: DataFrame) -> DataFrame:
    """Prices of positions that are added: given labour wins if manual, else the resolved price.

    A blank unit is taken from the matched item; quantity is 0 where none is given.
    """
    keys = ["name", "unit", "city", "region"]
    given = F.col("manual") & F.col("labor_price").isNotNull()
    r = resolved.select(*keys, *(F.col(p).alias(f"r_{p}") for p in PRICES), F.col("source").alias("r_source"), F.col("match_code").alias("r_code"), F.col("match_score").alias("r_score"), T.normalise_unit(F.col("unit")).alias("r_unit"))
    unit = items.groupBy("code").agg(F.min_by("unit", "ord").alias("i_unit")).withColumnRenamed("code", "r_code")
    joined = new.join(written(r.join(unit, "r_code", "left"), "resolved"), keys, "left")
    own = F.coalesce("r_unit", T.normalise_unit(F.col("unit")))  # made once for each request
    zero = F.lit(0).cast("decimal(18,2)")
    return joined.select(
        *[c for c in new.columns if c not in {"unit", "quantity", "manual", *(f"{p}_price" for p in PRICES)}],
        F.when(~given & (own == ""), F.coalesce("i_unit", F.lit(""))).otherwise(own).alias("unit"),
        F.coalesce(F.col("quantity").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")).alias("quantity"),
        *(F.when(given, F.coalesce(F.col(f"{p}_price").cast("decimal(18,2)"), zero)).otherwise(F.coalesce(F.col(f"r_{p}"), zero)).alias(f"{p}_price") for p in PRICES),
        F.when(given, "manual").otherwise(F.coalesce("r_source", F.lit("none"))).alias("price_source"),
        F.when(given, 0.0).otherwise(F.coalesce("r_score", F.lit(0.0))).alias("match_score"),
        given.alias("manual"),
    )


def manual_edit(positions: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply patches (position_id and the columns to change, null for unchanged)."""
    p = patches.withColumnsRenamed({c: f"p_{c}" for c in patches.columns if c != "position_id"}).withColumn("p_hit", F.lit(True))
    joined = positions.join(p, "position_id", "left")
    priced = F.coalesce(F.col("p_hit"), F.lit(False)) & F.coalesce(*(F.col(f"p_{x}_price") for x in PRICES)).isNotNull()
    return joined.withColumns(
        {c: F.coalesce(T.normalise_unit(F.col("p_unit")) if c == "unit" else F.col(f"p_{c}").cast(positions.schema[c].dataType), F.col(c)) for c in patches.columns if c not in ("position_id", "unit")}
        | ({"unit": F.when(F.col("p_unit").isNotNull(), T.normalise_unit(F.col("p_unit"))).otherwise(F.col("unit"))} if "unit" in patches.columns else {})
        | {"manual": priced | F.col("manual"), "price_source": F.when(priced, "manual").otherwise(F.col("price_source"))}
    ).select(*positions.columns)
