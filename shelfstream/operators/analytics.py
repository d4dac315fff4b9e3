"""Search analytics: click-through, classes of queries, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import analytics_fold, round_half_up
from .lineage import settled, small
from .ranking import ranked, top

# When a class of queries counts as abnormal.
MIN_SEARCHES_EXCLUSIVE, MAX_CTR = 20, 0.05


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)


def clicked_logs(logs: DataFrame, clicks: DataFrame) -> DataFrame:
    """Each log with its number of clicks; clicks are counted before the join."""
    n = clicks.groupBy("log_id").agg(F.count("*").alias("n_clicks"))
    return logs.join(n, "log_id", "left").withColumn("n_clicks", F.coalesce("n_clicks", F.lit(0)))


def abnormal_class(searches: Column, clicked: Column, faceted_empty: Column) -> Column:
    low = (searches > MIN_SEARCHES_EXCLUSIVE) & (clicked / searches < MAX_CTR)
    return F.when(faceted_empty > 0, "SEMANTIC_NO_RESULTS").when(low, "LOW_CTR").otherwise("HEALTHY")


def query_classes(logs: DataFrame, clicks: DataFrame) -> DataFrame:
    """A row per shop and folded query text: searches, clicks, spellings, results, label."""
    per = clicked_logs(logs, clicks).withColumn("norm_query", analytics_fold(F.col("query")))
    faceted = (F.col("result_count") == 0) & F.col("has_facets")
    out = per.groupBy("shop", "norm_query").agg(
        F.count("*").alias("searches"),
        F.count_if(F.col("n_clicks") > 0).alias("clicked_searches"),
        F.sum("n_clicks").alias("clicks"),
        F.countDistinct("query").alias("variants"),
        F.round(F.avg("result_count"), 6).alias("mean_results"),
        F.count_if(faceted).alias("faceted_empty"),
    )
    return out.withColumn("class", abnormal_class(F.col("searches"), F.col("clicked_searches"), F.col("faceted_empty")))


def abnormal_logs(logs: DataFrame, classes: DataFrame) -> DataFrame:
    """All logs of classes with few clicks, the faceted empty ones of the other abnormal class."""
    bad = classes.where("class <> 'HEALTHY'").select("shop", "norm_query", "class")
    rows = logs.withColumn("norm_query", analytics_fold(F.col("query"))).join(bad, ["shop", "norm_query"])
    return rows.where((F.col("class") == "LOW_CTR") | ((F.col("result_count") == 0) & F.col("has_facets")))


def daily_series(logs: DataFrame, clicks: DataFrame, abnormal: DataFrame, now: Column, days: int) -> DataFrame:
    """A row per shop and UTC day of the window, days without searches included."""
    days = max(14, min(90, days))
    start = F.date_sub(F.to_date(now), days - 1)
    per = clicked_logs(logs, clicks).join(abnormal.select("log_id", F.lit(True).alias("bad")), "log_id", "left")
    per = per.withColumn("day", F.to_date("created_at")).where(F.col("day") >= start)
    daily = per.groupBy("shop", "day").agg(F.count("*").alias("searches"), F.count_if(F.col("n_clicks") > 0).alias("clicked"), F.count_if("bad").alias("abnormal"))
    calendar = logs.select("shop").distinct().withColumn("day", F.explode(F.sequence(start, F.to_date(now))))
    out = calendar.join(daily, ["shop", "day"], "left").fillna(0, ["searches", "clicked", "abnormal"])
    return out.withColumn("ctr", round_half_up(percent(F.col("clicked"), F.col("searches")), 1))


def click_ranks(clicks: DataFrame, ranked_rows: DataFrame, receipts: DataFrame, most: int = 20) -> DataFrame:
    """Each log's first click on a product, with the product's rank and score.

    clicks: click_id, log_id, product_id, clicked_at; ranked_rows: shop,
    log_id, product_id, rnk, score, of which a log keeps the first ``most``;
    receipts: receipt_id, log_id, product_id, position, score, created_at, the
    whole list. A product beyond the log's list takes rank and score from the log's
    newest receipt; a click on a product that neither has does not count.
    """
    kept = top(ranked_rows.where(F.col("rnk") <= most), ["log_id", "product_id"], ["rnk"]).select("log_id", "product_id", "rnk", F.col("score").alias("score"))
    newest = receipts.groupBy("log_id").agg(F.max_by("receipt_id", F.struct("created_at", "receipt_id")).alias("receipt_id"))
    late = receipts.join(newest, ["log_id", "receipt_id"], "left_semi").groupBy("log_id", "product_id").agg(F.min_by(F.struct("position", "score"), "position").alias("late"))
    shops = ranked_rows.select("log_id", "shop").distinct()
    rows = clicks.join(kept, ["log_id", "product_id"], "left").join(late, ["log_id", "product_id"], "left").join(shops, "log_id")
    rows = rows.withColumns({"score": F.when(F.col("rnk").isNotNull(), F.col("score")).otherwise(F.coalesce("late.score", F.lit(0.0))), "rnk": F.coalesce("rnk", "late.position")})
    hits = rows.where("rnk IS NOT NULL").select("click_id", "log_id", "clicked_at", "rnk", "product_id", "score", "shop")
    return top(hits, ["log_id", "product_id"], ["clicked_at", "click_id"])


def totals(logs: DataFrame, hits: DataFrame) -> DataFrame:
    """Per shop: searches, clicked searches, CTR, clicks, mean clicked rank."""
    per = hits.groupBy("log_id").agg(F.count("*").alias("clicks"), F.sum("rnk").alias("rank_sum"))
    rows = logs.join(per, "log_id", "left")
    out = rows.groupBy("shop").agg(F.count("*").alias("searches"), F.count("clicks").alias("clicked"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.sum("rank_sum").alias("rank_sum"))
    mean = F.when(F.col("clicks") > 0, round_half_up(F.col("rank_sum") / F.col("clicks"), 1))
    return out.select("shop", "searches", "clicked", "clicks", round_half_up(percent(F.col("clicked"), F.col("searches")), 1).alias("ctr"), mean.alias("mean_rank"))


def weekly_change(logs: DataFrame, clicks: DataFrame, now: Column) -> DataFrame:
    """CTR of the last 7 UTC days and the 7 before, their difference and relative change in percent."""
    current = F.date_sub(F.to_date(now), 6)
    previous = F.date_sub(current, 7)
    per = clicked_logs(logs, clicks).withColumn("day", F.to_date("created_at"))
    is_current, is_previous = F.col("day") >= current, (F.col("day") >= previous) & (F.col("day") < current)
    hit = F.col("n_clicks") > 0
    out = per.groupBy("shop").agg(
        F.count_if(is_current).alias("n1"), F.count_if(is_current & hit).alias("k1"), F.count_if(is_previous).alias("n0"), F.count_if(is_previous & hit).alias("k0")
    )
    c1, c0 = percent(F.col("k1"), F.col("n1")), percent(F.col("k0"), F.col("n0"))
    relative = F.when(c0 > 0, (c1 - c0) / c0 * 100)
    return out.select("shop", "n1", "n0", round_half_up(c1, 1).alias("current_ctr"), round_half_up(c0, 1).alias("previous_ctr"), round_half_up(c1 - c0, 1).alias("delta_points"), F.round(relative, 6).alias("delta_percent"))


def alerts(classes: DataFrame, change: DataFrame, most: int = 6) -> DataFrame:
    """Per shop at most ``most`` alerts: a drop of the CTR first, then abnormal classes by volume."""
    n = F.when(F.col("class") == "LOW_CTR", F.col("searches")).otherwise(F.col("faceted_empty"))
    rows = top(classes.where("class <> 'HEALTHY'"), "shop", [F.desc("searches"), "norm_query"], most)
    rows = rows.select("shop", F.lit(1).alias("tier"), F.col("class").alias("type"), F.col("norm_query").alias("query"), n.alias("count"), "searches", F.when(n >= 10, "HIGH").otherwise("MEDIUM").alias("severity"))
    drop = change.where("n1 >= 30 AND n0 >= 30 AND delta_percent <= -20").select(
        "shop", F.lit(0).alias("tier"), F.lit("CTR_DROP").alias("type"), F.lit(None).cast("string").alias("query"), F.col("n1").alias("count"), F.col("n1").alias("searches"), F.lit("HIGH").alias("severity")
    )
    out = ranked(drop.unionByName(rows), "shop", ["tier", F.desc("searches"), "query"], "position")
    return out.where(F.col("position") <= most).drop("tier", "searches")


def class_variants(logs: DataFrame) -> DataFrame:
    """Spellings of each cluster (shop, leader) by count, recency, text; the first is the label."""
    per = logs.groupBy("shop", "leader", "query").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    return ranked(per, ["shop", "leader"], [F.desc("n"), F.desc("last"), "query"], "position").drop("last")


def common_products(logs: DataFrame, ranked_rows: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """Products of each cluster (logs: log_id, shop, leader) by appearances, mean rank, clicks; the first ``most``."""
    clicks = hits.groupBy("log_id", "product_id").agg(F.count("*").alias("k"))
    rows = ranked_rows.drop("shop").join(logs.select("log_id", "shop", "leader"), "log_id").join(clicks, ["log_id", "product_id"], "left")
    per = rows.groupBy("shop", "leader", "product_id").agg(F.count("*").alias("appearances"), F.round(F.avg("rnk"), 6).alias("mean_rank"), F.coalesce(F.sum("k"), F.lit(0)).alias("clicks"))
    return top(per, ["shop", "leader"], [F.desc("appearances"), "mean_rank", F.desc("clicks"), "product_id"], most)


def product_lists(ranked_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items) with the first 20 products of each key and their best ranks, in order of product."""
    rows = ranked_rows.where("rnk <= 20").groupBy(*keys, "product_id").agg(F.min("rnk").alias("rnk"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("product_id", "rnk"))).alias("items"))


def rank_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of 1/rank of two lists of (product_id, rnk)."""
    mass = lambda x: F.aggregate(x, F.lit(0.0), lambda s, i: s + 1 / i["rnk"])
    other = F.map_from_entries(b)
    low = F.aggregate(a, F.lit(0.0), lambda s, i: s + F.when(F.map_contains_key(other, i["product_id"]), F.least(1 / i["rnk"], 1 / F.try_element_at(other, i["product_id"]))).otherwise(0.0))
    return low / (mass(a) + mass(b) - low)


#: Lists that meet at one product in one task.
HOT_LISTS = 2000


def similar_lists(lists: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (a, b), a before b, of lists of a shop with a rank-weighted Jaccard of at least ``least`` and a common product.

    lists: shop, key, items. Products go from those of the fewest lists to
    those of the most. Pairs that reach ``least`` share a product before the
    point from which the rest of a list has less than that share of its
    weight, and at the first one they share the lighter of the two rests is
    enough for it; only such pairs are compared. A product of many lists is
    dealt to several tasks, each with a part of the lists on one side.
    """
    rows = lists.select("shop", key, F.explode("items").alias("i")).select("shop", key, "i.product_id", (1 / F.col("i.rnk")).alias("w"))
    rows = rows.join(small(rows.groupBy("shop", "product_id").agg(F.count("*").alias("n"))), ["shop", "product_id"])
    whole = W.partitionBy("shop", key)
    rest = whole.orderBy("n", "product_id").rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumns({"rest": F.sum("w").over(rest), "mass": F.sum("w").over(whole)}).where(F.col("rest") >= F.col("mass") * least - 1e-9)
    parts = F.ceil(F.col("n") / HOT_LISTS).cast("int")
    side = lambda k, part: rows.select("shop", "product_id", F.col(key).alias(k), F.col("rest").alias(f"rest_{k}"), F.col("mass").alias(f"mass_{k}"), part.alias("part"))
    met = side("a", F.pmod(F.xxhash64(key), parts).cast("int")).join(side("b", F.explode(F.sequence(F.lit(0), parts - 1))), ["shop", "product_id", "part"])
    enough = F.least("rest_a", "rest_b") * (1 + least) >= least * (F.col("mass_a") + F.col("mass_b")) - 1e-9
    pairs = met.where(F.col("a") < F.col("b")).where(enough).select("shop", "a", "b").distinct()
    x, y = (lists.select("shop", F.col(key).alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    out = pairs.join(x, ["shop", "a"]).join(y, ["shop", "b"]).select("shop", "a", "b", F.round(rank_similarity(F.col("items_a"), F.col("items_b")), 6).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def distinct_lists(ranked_rows: DataFrame) -> DataFrame:
    """Searches by equal lists: shop, items, log_id (the least of the list) and members (how many logs)."""
    return product_lists(ranked_rows, ["shop", "log_id"]).groupBy("shop", "items").agg(F.min("log_id").alias("log_id"), F.count("*").alias("members"))


def list_members(ranked_rows: DataFrame) -> DataFrame:
    """Each log's list by its least log: shop, log_id, list_id."""
    lists = product_lists(ranked_rows, ["shop", "log_id"]).select("shop", "log_id", F.sha2(F.to_json("items"), 256).alias("list"))
    least = lists.groupBy("shop", "list").agg(F.min("log_id").alias("list_id"))
    return lists.join(least, ["shop", "list"]).select("shop", "log_id", "list_id")


def weighted_jaccard(ranked_rows: DataFrame, least: float = 0.0) -> DataFrame:
    """Rank-weighted Jaccard of at least ``least`` of all searches that share a product: pairs of distinct lists, each
    named by its least log, with how many logs have either list. ``list_members`` tells which; equal lists have similarity 1."""
    classes = settled(distinct_lists(ranked_rows))
    pairs = similar_lists(classes, "log_id", least)
    of = lambda k: classes.select("shop", F.col("log_id").alias(k), F.col("members").alias(f"members_{k}"))
    return pairs.join(of("a"), ["shop", "a"]).join(of("b"), ["shop", "b"]).withColumnsRenamed({"a": "log_a", "b": "log_b"})


def leaders(nodes: DataFrame, links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Greedy leaders: (id, leader). nodes: id, place (unique, first come first); links: id, other, both ways or one.

    In order of place a node joins its linked leader of least place, else it
    leads itself. Found in rounds: a node leads once all its linked nodes of
    lower place have joined others, and joins once one of them leads. A node
    that waits for a single other does the opposite of it; such waits point
    at each other, and each round doubles how far they point, so that a chain
    of n waits takes about log2(n) rounds. Only nodes that wait for several
    undecided ones at once need a round for each step of these. A round is
    one checkpoint.
    """
    place = lambda k: nodes.select(F.col("id").alias(k), F.col("place").alias(f"{k}_place"))
    both = links.select("id", "other").unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    earlier = settled(both.join(place("id"), "id").join(place("other"), "other").where("other_place < id_place").select("id", "other", "other_place"))
    kind = nodes.schema["id"].dataType
    state = settled(nodes.select("id", F.lit(None).cast("boolean").alias("leads"), F.lit(None).cast(kind).alias("ptr"), F.lit(None).cast("boolean").alias("odd")))
    for _ in range(most_rounds):
        known = state.select(F.col("id").alias("other"), F.col("leads").alias("other_leads"))
        seen = earlier.join(state.where("leads IS NULL").select("id"), "id", "left_semi").join(known, "other")
        open_ = F.col("other_leads").isNull()
        seen = seen.groupBy("id").agg(F.coalesce(F.bool_or("other_leads"), F.lit(False)).alias("joins"), F.count_if(open_).alias("waits"), F.min(F.when(open_, F.col("other"))).alias("one"))
        told = F.when(F.coalesce("joins", F.lit(False)), False).when(F.coalesce("waits", F.lit(0)) == 0, True)
        single = ~F.coalesce("joins", F.lit(True)) & (F.col("waits") == 1)
        now = state.join(seen, "id", "left").select("id", F.coalesce("leads", told).alias("leads"), F.coalesce("ptr", F.when(single, F.col("one"))).alias("ptr"), F.coalesce("odd", F.when(single, True)).alias("odd"))
        ahead = now.select(F.col("id").alias("ptr"), F.col("leads").alias("its"), F.col("ptr").alias("next"), F.col("odd").alias("turn"))
        now = now.join(ahead, "ptr", "left")
        far = F.col("next").isNotNull()
        state = settled(now.select("id", F.coalesce("leads", F.col("its") != F.col("odd")).alias("leads"), F.coalesce("next", "ptr").alias("ptr"), F.when(far, F.col("odd") != F.col("turn")).otherwise(F.col("odd")).alias("odd")))
        if state.where("leads IS NULL").isEmpty():
            break
    else:
        raise RuntimeError("leaders did not settle")
    led = earlier.join(state.where("leads").select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.min_by("other", "other_place").alias("other"))
    return nodes.select("id").join(led, "id", "left").select("id", F.coalesce("other", "id").alias("leader"))


def lead_clusters(logs: DataFrame, ranked_rows: DataFrame, fingerprints: DataFrame, jaccard: float = 0.70, cosine: float = 0.82) -> DataFrame:
    """Leader clustering of searches, newest first: (shop, norm_query, empty, leader, is_leader).

    logs: log_id, shop, query, result_count; ranked_rows: log_id, product_id,
    rnk; fingerprints: log_id, embedding. A class is all searches of a shop
    with one folded text and with, or without, results; its newest search
    speaks for it. A class joins the newest leader of its kind whose products
    reach the rank-weighted Jaccard, or, without results, whose fingerprint
    reaches the cosine.
    """
    from .retrieval import dense_top

    own = logs.select("log_id", "shop", analytics_fold(F.col("query")).alias("norm_query"), (F.col("result_count") == 0).alias("empty"))
    classes = own.groupBy("shop", "norm_query", "empty").agg(F.max("log_id").alias("id"))
    classes = settled(classes)
    items = settled(product_lists(ranked_rows.join(classes.where("NOT empty").select(F.col("id").alias("log_id")), "log_id", "left_semi"), ["shop", "log_id"]))
    by_rank = similar_lists(items, "log_id", jaccard).select(F.col("a").alias("id"), F.col("b").alias("other"))
    vectors = classes.where("empty").select("id", "shop").join(fingerprints, F.col("id") == F.col("log_id")).select("id", "shop", "embedding")
    near = dense_top(vectors.withColumnRenamed("id", "query_id"), vectors.withColumnRenamed("id", "product_id"), None, cosine)
    by_text = near.where("query_id < product_id").select(F.col("query_id").alias("id"), F.col("product_id").alias("other"))
    led = leaders(classes.select("id", (-F.col("id")).alias("place")), by_rank.unionByName(by_text))
    names = classes.select(F.col("id").alias("leader"), F.col("norm_query").alias("name"))
    return classes.join(led, "id").join(names, "leader").select("shop", "norm_query", "empty", F.col("name").alias("leader"), (F.col("id") == F.col("leader")).alias("is_leader"))
