"""Digests, mail and notification audiences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressline.functions import text as tx
from pressline.operators.feeds import hours_before
from pressline.operators.joins import id_map_join, meeting, slices
from pressline.operators.ranking import freshness_order, list_depths, pick_places, rank_all, ranked_places, top_n

# --- fixed values: wording and limits ---
BREAKING_CATEGORIES = ["breaking", "urgent", "alert", "latest", "developing", "live", "just in", "update", "flash", "bulletin"]
BREAKING_PREFIXES = ["breaking:", "urgent:", "alert:", "developing:", "just in:", "live:", "update:", "flash:", "exclusive:"]
BREAKING_KEYWORDS = ["breaking", "urgent", "just in", "developing story", "live update", "flash", "alert", "exclusive", "confirmed"]
OLDER_BREAKING_KEYWORDS = ["breaking", "urgent", "alert", "crisis", "disaster"]
BREAKING_PRIORITIES = ["low", "medium", "high", "critical"]
POST_LIMIT = 280
MESSAGES_PER_BATCH = 100
AUDIENCE_SALTS = 16  # parts into which the receivers of alerts are split
BREAKING_SALTS = 64  # parts into which the users of one target key are split
ITEM_PARTS = 16  # parts into which the items with one set of targets are split
LISTED_ITEMS = 256  # items of a list that meets a list of users
LISTED_USERS = 512  # users of such a list; it recurs for each item, which stored rows make use of


# --- digest ----------------------------------------------------------------------------


def digest_candidates(enrichments: DataFrame, as_of: Column, limit: int = 50, thin: int = 10) -> DataFrame:
    """Best of the last 27 hours, to 48 hours when thin, all when there is nothing.

    The best ``limit`` of each age class are enough to decide and to fill the list.
    """
    tier = (
        F.when(F.col("analyzed_at") >= hours_before(as_of, 27), 0)
        .when(F.col("analyzed_at") >= hours_before(as_of, 48), 1).otherwise(2)
    )
    order = [F.desc_nulls_first("importance_score"), F.desc_nulls_first("analyzed_at"), F.desc("article_id")]
    tiered = enrichments.filter("status = 'completed'").withColumn("tier", tier)
    best = top_n(tiered, ["tier"], order, limit)
    fresh = best.agg(F.count_if(F.col("tier") == 0)).scalar()
    recent = best.agg(F.count_if(F.col("tier") <= 1)).scalar()
    wanted = (F.col("tier") == 0) | ((F.col("tier") == 1) & (fresh < thin)) | ((F.col("tier") == 2) & (recent == 0))
    chosen = best.filter(wanted).drop("rank")
    return chosen.orderBy("tier", *order).limit(limit)


def length_guidance(count: Column) -> Column:
    return F.when(count < 5, "1-2 paragraph briefing").when(count < 15, "2-3 paragraph briefing").otherwise("3-4 paragraph briefing")


def digest_payload(candidates: DataFrame, articles: DataFrame, sources: DataFrame, trending: DataFrame, date: Column) -> DataFrame:
    """One row with the facts for the writer, as JSON. At most 50 articles go in."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    facts = articles.select(F.col("id").alias("article_id"), "title", "source_id").join(names, "source_id", "left")
    ranked = candidates.join(facts, "article_id")
    entry = F.struct(
        F.col("article_id").alias("id"), "title", "source", "summary", "sentiment", F.col("importance_score").alias("importance"), "themes",
        F.col("related_themes").alias("story_arcs"), F.slice("key_facts", 1, 3).alias("key_facts"), F.col("follow_up_worthy").alias("follow_up"),
    )
    place = F.struct("tier", (-F.col("importance_score")).alias("i"), (-F.unix_micros("analyzed_at")).alias("a"), (-F.col("article_id")).alias("d"))
    listed = ranked.groupBy().agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), entry.alias("e")))).alias("_l"))
    entities = trending.groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("mention_count")).alias("k"), "entity_name", "entity_type", "mention_count"))).alias("_t")
    )
    return listed.withColumn("_t", entities.scalar()).select(
        date.alias("digest_date"), F.size("_l").alias("article_count"), length_guidance(F.size("_l")).alias("guidance"),
        F.to_json(F.transform("_l", lambda x: x["e"])).alias("articles_json"),
        F.to_json(F.transform("_t", lambda t: F.struct(t["entity_name"], t["entity_type"], t["mention_count"]))).alias("trending_json"),
    )


def digest_detail(digests: DataFrame, snippets: DataFrame) -> DataFrame:
    """Stored digests with article ids replaced by article snippets.

    Top stories keep an entry without an article when it is unknown; threads drop
    unknown articles.
    """
    fields = [c for c in snippets.columns if c != "id"]
    tops = digests.withColumn("_ids", F.transform("top_stories", lambda s: s["article_id"]))
    with_tops = id_map_join(tops, "digest_date", "_ids", snippets, fields, drop_unknown=False, out="_found").drop("_ids")
    merged = with_tops.withColumn(
        "top_stories", F.zip_with("top_stories", "_found", lambda s, a: F.struct(s["headline"].alias("headline"), a.alias("article")))
    ).drop("_found")
    threads = digests.select("digest_date", F.posexplode("story_threads").alias("_t", "thread")).select(
        "digest_date", "_t", F.col("thread.title").alias("title"), F.col("thread.article_ids").alias("ids"),
        F.concat_ws("#", F.col("digest_date").cast("string"), "_t").alias("_key"),
    )
    filled = id_map_join(threads, "_key", "ids", snippets, fields, out="articles")
    lists = filled.groupBy("digest_date").agg(F.array_sort(F.collect_list(F.struct("_t", "title", "articles"))).alias("_threads"))
    radar = snippets.select(F.col("id").alias("under_radar_id"), F.struct("id", *fields).alias("under_radar_article"))
    return merged.drop("story_threads").join(lists, "digest_date", "left").withColumn(
        "story_threads", F.transform("_threads", lambda t: F.struct(t["title"].alias("title"), t["articles"].alias("articles")))
    ).drop("_threads").join(radar, "under_radar_id", "left")


def mail_stories(digests: DataFrame, articles: DataFrame, sources: DataFrame, authors: DataFrame) -> DataFrame:
    """J8 in mail form: one row per digest and story with link, picture, outlet and author."""
    stories = digests.select("digest_date", F.posexplode("top_stories").alias("pos", "s")).select("digest_date", "pos", "s.article_id", "s.headline")
    outlet = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("base_url").alias("source_url"))
    writer = authors.select(F.col("id").alias("author_id"), F.col("name").alias("author_name"))
    facts = articles.select(F.col("id").alias("article_id"), F.col("url").alias("article_url"), "image_url", "source_id", "author_id")
    joined = stories.join(facts, "article_id", "left").join(outlet, "source_id", "left").join(writer, "author_id", "left")
    shown = ["image_url", "article_url", "source_name", "source_url", "author_name"]
    return joined.select("digest_date", "pos", "article_id", "headline", *[F.coalesce(c, F.lit("")).alias(c) for c in shown])


def flash_articles(enrichments: DataFrame, articles: DataFrame, as_of: Column, window_hours: int, min_importance: int = 7, limit: int = 5) -> DataFrame:
    """N4."""
    fresh = enrichments.filter(
        (F.col("status") == "completed") & (F.col("importance_score") >= min_importance) & (F.col("analyzed_at") >= hours_before(as_of, window_hours))
    )
    best = fresh.orderBy(F.desc("importance_score"), F.desc("analyzed_at"), F.desc("article_id")).limit(limit)
    return best.join(articles.select(F.col("id").alias("article_id"), "title", "url", "image_url", "source_id", "author_id"), "article_id")


def digest_audience(subscribers: DataFrame, date: Column) -> DataFrame:
    """Confirmed readers of the morning digest who have not got this date's yet."""
    open_ = F.col("is_active") & F.col("confirmed") & ~F.col("frequency").eqNullSafe(F.lit("evening"))
    return subscribers.filter(open_ & ~F.col("last_digest_date").eqNullSafe(date))


def flash_audience(subscribers: DataFrame, date: Column, slot: str) -> DataFrame:
    """Confirmed evening readers who have not got this date's slot yet."""
    open_ = F.col("is_active") & F.col("confirmed") & F.col("frequency").isin("morning_evening", "evening")
    sent = F.col("last_digest_date").eqNullSafe(date) & F.col("last_slot_sent").eqNullSafe(F.lit(slot))
    return subscribers.filter(open_ & ~sent)


def digest_page(digests: DataFrame, stories: DataFrame, as_of: Column, zone: str, date: Column | None = None) -> DataFrame:
    """The page of the latest (or a dated) digest: text, age label, earlier dates and,
    while today's is missing, the six newest active stories. One row."""
    published = digests.filter("is_published")
    shown = published.filter(F.col("digest_date") == date) if date is not None else published
    newest = shown.orderBy(F.desc("digest_date")).limit(1).select(F.col("digest_date").alias("shown_date"), "digest_text")
    earlier = published.orderBy(F.desc("digest_date")).limit(15).groupBy().agg(
        F.sort_array(F.collect_list("digest_date"), asc=False).alias("_dates")
    )
    active = (
        stories.filter((F.col("status") == "active") & (F.coalesce("short_summary", F.lit("")) != ""))
        .orderBy(F.desc_nulls_first("last_seen_at"), F.asc("id")).limit(6).groupBy()
        .agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("last_seen_at")).alias("k"), "id"))).alias("_stories"))
    )
    today = F.to_date(F.from_utc_timestamp(as_of, zone))
    waiting = (F.lit(date is None)) & (F.col("shown_date") < today)
    age = F.datediff(today, "shown_date")
    label = F.when(age == 1, "Yesterday's brief").otherwise(F.concat(F.lit("Brief from "), F.date_format("shown_date", "d MMMM")))
    paragraphs = F.filter(F.transform(F.split("digest_text", "\n"), tx.strip), lambda p: p != "")
    return newest.withColumns({"_dates": earlier.scalar(), "_stories": active.scalar()}).select(
        "shown_date", paragraphs.alias("paragraphs"), F.slice(F.filter("_dates", lambda d: d != F.col("shown_date")), 1, 14).alias("previous"),
        waiting.alias("waiting_for_today"), F.when(waiting, label).otherwise("").alias("digest_label"),
        F.when(waiting, F.transform("_stories", lambda s: s["id"])).otherwise(F.array().cast("array<bigint>")).alias("latest_stories"),
    )


def thread_chunks(digests: DataFrame, brand: str, hashtags: str, site: str, limit: int = POST_LIMIT) -> DataFrame:
    """Posts of a digest thread: opener, packed sentences, link; one row per post."""
    head = f"🗞 {brand} — Daily Brief\n\n"
    budget = limit - len(head) - len(hashtags) - 10
    hook = tx.strip(F.coalesce(F.nullif("key_concern", F.lit("")), F.lit("")))
    short = F.when(F.length(hook) > budget, tx.first_sentences(hook, budget, 1)).otherwise(hook)
    opener = F.concat(F.lit(head), short, F.lit("\n\n"), F.lit(hashtags))
    body = tx.pack_sentences(tx.strip(F.coalesce("digest_text", F.lit(""))), limit)
    link = F.concat(F.lit(f"📖 Read the full brief → {site}/digest/"), F.col("digest_date").cast("string"))
    return digests.select("digest_date", F.posexplode(F.concat(F.array(opener), body, F.array(link))).alias("pos", "post"))


# --- scheduled notifications -----------------------------------------------------------


def due_schedules(schedules: DataFrame, as_of: Column) -> DataFrame:
    """N6."""
    return schedules.filter((F.col("next_send_at") <= as_of) & F.col("is_active"))


def schedule_articles(schedules: DataFrame, articles: DataFrame, history: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """N7 for all due schedules: the newest articles each user has not been sent.

    A schedule's own categories come before the user's preferred ones, and likewise for
    outlets; without any, all count. Articles are ranked once per (category, outlet)
    list; a user who was sent v articles in seven days needs v more places of each list.
    """
    weekly = F.when(F.col("frequency") == "weekly", as_of - F.expr("INTERVAL 7 DAYS")).otherwise(as_of - F.expr("INTERVAL 24 HOURS"))
    joined = schedules.join(profiles, "user_id", "left")
    given = lambda own, liked: F.when(F.size(own) > 0, F.col(own)).when(F.size(liked) > 0, F.col(liked)).otherwise(F.array(F.lit(-1)))
    sent = history.filter(F.col("sent_at") >= as_of - F.expr("INTERVAL 7 DAYS")).select("user_id", F.col("article_id").alias("id")).distinct()
    counts = sent.groupBy("user_id").agg(F.count(F.lit(1)).alias("_sent"))
    due = joined.withColumns(
        {
            "since": F.coalesce("last_sent_at", weekly), "cats": given("include_categories", "preferred_categories"),
            "srcs": given("include_sources", "followed_sources"),
        }
    ).join(counts, "user_id", "left")
    name = lambda c, s: F.concat(F.lit("c"), c, F.lit("s"), s)
    lists = F.flatten(F.transform("cats", lambda c: F.transform("srcs", lambda s: name(c, s))))
    requests = due.select("id", (F.coalesce("_sent", F.lit(0)) + F.col("max_articles")).alias("need"), lists.alias("lists")).withColumnRenamed("id", "schedule_id")
    earliest = due.agg(F.min("since")).scalar()
    fresh = articles.filter(~F.col("is_processed")).select("id", "category_id", "source_id", "scraped_at")
    fresh = fresh.filter(F.col("scraped_at") > earliest)
    everyone = F.lit(-1)
    named = [name(c, s) for c in (F.col("category_id"), everyone) for s in (F.col("source_id"), everyone)]
    hourly = fresh.withColumn("_hour", F.date_trunc("hour", "scraped_at"))
    places = ranked_places(hourly, named, [("_hour", True)], freshness_order(), ["id", "scraped_at"], list_depths(requests))
    hits = pick_places(requests, places, "schedule_id")
    facts = due.select(F.col("id").alias("schedule_id"), "user_id", "since", "max_articles")
    open_ = hits.join(facts, "schedule_id").filter("scraped_at > since").join(sent, ["user_id", "id"], "left_anti")
    ranked = open_.withColumn("rank", F.row_number().over(Window.partitionBy("schedule_id").orderBy(*freshness_order())))
    return ranked.filter("rank <= max_articles").select("schedule_id", "user_id", F.col("id").alias("article_id"), "rank")


def schedule_messages(selected: DataFrame, articles: DataFrame, sources: DataFrame, tokens: DataFrame) -> DataFrame:
    """One message per active token of every schedule with articles."""
    outlet = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    facts = articles.select(F.col("id").alias("article_id"), "title", "source_id").join(outlet, "source_id", "left")
    entry = F.struct("rank", "article_id", F.col("title").alias("headline"), "source_name")
    grouped = selected.join(facts, "article_id").groupBy("schedule_id", "user_id").agg(F.array_sort(F.collect_list(entry)).alias("a"))
    count, first = F.size("a"), F.get("a", F.lit(0))
    names = F.array_join(F.array_distinct(F.transform(F.slice("a", 1, 3), lambda x: x["source_name"])), ", ")
    title = F.when(count == 1, F.concat(F.lit("Featured Story — "), first["source_name"])).otherwise("News Highlights")
    body = F.when(count == 1, F.concat(first["headline"], F.lit(" — tap to read the details."))).otherwise(
        F.concat(count, F.lit(" fresh stories from "), names, F.lit(" — don’t miss out!"))
    )
    texts = grouped.select(
        "schedule_id", "user_id", title.alias("title"), body.alias("body"), count.alias("article_count"),
        F.transform("a", lambda x: x["article_id"]).alias("article_ids"),
    )
    return texts.join(tokens.filter("is_active").select("user_id", "token"), "user_id")


def alert_messages(alerts: DataFrame, tokens: DataFrame) -> DataFrame:
    """N8 for story alerts: every active token gets every alert.

    The fan-out is the result itself. Alerts and tokens meet on a salt, so neither list is
    ever one row or one task.
    """
    sent = alerts.select(
        F.col("id").alias("alert_id"), "story_id", "article_id", "title", F.substring("reason", 1, 180).alias("body"), "importance_score",
        F.explode(F.sequence(F.lit(0), F.lit(AUDIENCE_SALTS - 1))).alias("_salt"),
    )
    to = tokens.filter("is_active").select("user_id", "token", F.pmod(F.xxhash64("token"), F.lit(AUDIENCE_SALTS)).cast("int").alias("_salt"))
    return to.join(sent, "_salt").select("user_id", "token", *[c for c in sent.columns if c != "_salt"])


def message_batches(messages: DataFrame, per: str, size: int = MESSAGES_PER_BATCH, bucket: int = 10000) -> DataFrame:
    """Number the messages of each ``per`` key into batches of ``size``, in user and
    token order.

    Users are counted in buckets first, so no task numbers all messages of a key.
    """
    tagged = messages.withColumn("_bucket", F.floor(F.col("user_id") / bucket))
    ranked = rank_all(tagged, [per], [("_bucket", False)], [F.asc("user_id"), F.asc("token")], rank="_n")
    return ranked.withColumn("batch_no", F.floor((F.col("_n") - 1) / size)).drop("_bucket", "_n")


def send_history(selected: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """New (user, article) sends; pairs on record stay as they are."""
    pairs = selected.select("user_id", "article_id").distinct()
    return pairs.join(history.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti").withColumn("sent_at", as_of)


# --- breaking news ---------------------------------------------------------------------


def classify_breaking(title: Column, category_name: Column) -> Column:
    """High or medium for breaking news, NULL otherwise."""
    lower = F.lower(F.coalesce(title, F.lit("")))
    section = F.lower(F.coalesce(category_name, F.lit("")))
    in_category = section.isin(BREAKING_CATEGORIES)
    prefix = lower.rlike("^(?:" + "|".join(BREAKING_PREFIXES) + ")")
    keyword = lower.rlike("|".join(BREAKING_KEYWORDS))
    return F.when(prefix | (in_category & section.contains("breaking")), "high").when(in_category | keyword, "medium")


def classify_breaking_older(title: Column) -> Column:
    """N11, the older rule: any keyword in the title."""
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(OLDER_BREAKING_KEYWORDS))


def breaking_order() -> list[Column]:
    """Priority by rank, then newest."""
    level = F.array_position(F.array(*[F.lit(p) for p in BREAKING_PRIORITIES]), F.col("priority"))
    return [level.desc(), F.desc("created_at"), F.desc("id")]


def _keys(prefix: str, values: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(values, lambda v: F.concat(F.lit(prefix), v.cast("string"))), none)


def breaking_audience(
    breaking: DataFrame, tokens: DataFrame, history: DataFrame, profiles: DataFrame, as_of: Column, salts: int = BREAKING_SALTS, counted: bool = False
) -> DataFrame:
    """``(breaking_id, article_id, user_id)`` for every unsent item.

    Targets restrict the audience when an item has any. Items and users meet in an
    equi-join on a target key: a category, else an outlet, else the key that everyone has.
    Each key is split into ``salts`` parts of its users, so a key that all users share is
    many join keys. An item with several matching keys counts at the first of them.

    Items with the same targets travel as one list, as do users who read the same; the rows
    arise when the lists have met, and are never shuffled. An item brings along the users that
    got its article within the last day. With ``counted`` there are counts for
    :func:`breaking_delivery_stats` instead, and no pairs.
    """
    everyone = F.array(F.lit("all"))
    unsent = breaking.filter("NOT is_sent")
    items = unsent.select(
        F.col("id").alias("breaking_id"), "article_id", _keys("c", F.col("target_categories")).alias("_c"), _keys("s", F.col("target_sources")).alias("_s")
    )
    wanted = F.when(F.size("_c") > 0, F.col("_c")).when(F.size("_s") > 0, F.col("_s")).otherwise(everyone)
    offers = items.select("breaking_id", "article_id", F.array_distinct(wanted).alias("_wanted"), "_s")
    keys = F.concat(everyone, _keys("c", F.col("preferred_categories")), _keys("s", F.col("followed_sources")))
    per_user = tokens.filter("is_active").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    users = per_user.join(profiles.select("user_id", "preferred_categories", "followed_sources"), "user_id", "left").select("user_id", "n_tokens", keys.alias("_own"))
    recent = history.filter((F.col("sent_at") >= hours_before(as_of, 24)) & F.col("user_id").isNotNull()).select("user_id", "article_id")
    recent = recent.join(unsent.select("article_id"), "article_id", "left_semi")
    if counted:
        return _breaking_counts(offers, users.filter(F.col("user_id").isNotNull()), recent, salts)

    salt = F.pmod(F.xxhash64("user_id"), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    seen = recent.groupBy("article_id", salt.alias("_salt")).agg(F.collect_set("user_id").alias("_seen"))
    item_part = F.pmod(F.xxhash64("breaking_id", "article_id"), F.lit(ITEM_PARTS))
    item_lists = offers.withColumn("_salt", every_salt).join(seen, ["article_id", "_salt"], "left").groupBy("_wanted", "_s", "_salt", item_part).agg(
        F.collect_list(F.struct("breaking_id", "article_id", "_seen")).alias("_items")
    )
    offered = item_lists.select("_wanted", "_s", "_salt", slices("_items", LISTED_ITEMS).alias("_items")).withColumn("_key", F.explode("_wanted"))
    # A user is in a list once, with further copies of the whole list for further equal profiles.
    user_lists = users.groupBy("user_id", "_own").agg(F.count(F.lit(1)).cast("int").alias("_times")).groupBy("_own", salt.alias("_salt"), "_times").agg(
        F.transform(F.collect_list(F.struct("user_id")), lambda u: u["user_id"]).alias("_users")
    )
    copies = user_lists.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    reading = copies.select("_own", "_salt", slices("_users", LISTED_USERS).alias("_users")).withColumn("_key", F.explode(F.array_distinct("_own")))
    first = (F.size("_wanted") == 1) | (F.get(F.array_intersect("_wanted", "_own"), F.lit(0)) == F.col("_key"))
    from_outlet = (F.size("_s") == 0) | F.arrays_overlap("_s", "_own")
    met = meeting(offered, reading, ["_key", "_salt"], salts).filter(first & from_outlet)
    unseen = F.when(F.isnull("_seen"), F.col("_users")).otherwise(F.array_except("_users", "_seen"))
    reached = met.select(F.inline("_items"), "_users").select("breaking_id", "article_id", unseen.alias("_users"))
    return reached.select("breaking_id", "article_id", F.explode("_users").alias("user_id"))


def _n_fitting(targets: Column, profiles: Column) -> Column:
    """The pairs of an item's rows and a user's profiles that fit, by the rules of :func:`breaking_audience`."""
    fits = lambda t, own: F.get(F.array_intersect(t["_wanted"], own), F.lit(0)).isNotNull() & (
        (F.size(t["_s"]) == 0) | F.coalesce(F.arrays_overlap(t["_s"], own), F.lit(False))
    )
    of_row = lambda t: F.size(F.filter(profiles, lambda own: fits(t, own))).cast("bigint")
    return F.aggregate(targets, F.lit(0).cast("bigint"), lambda n, t: n + of_row(t))


def _breaking_counts(offers: DataFrame, users: DataFrame, recent: DataFrame, salts: int) -> DataFrame:
    """``(breaking_id, recipients, deliveries)``, to be added up per item.

    Items with the same targets and users with the same profiles are counted as classes, as if
    no one had got anything; rows with negative counts take off the users that had got the
    article within the last day. All rows of an id are one item, and all profiles of a user one
    user, so each user is a recipient once, while every fitting row counts for the deliveries.
    """
    asked = offers.groupBy("breaking_id").agg(F.collect_list(F.struct("article_id", F.struct("_wanted", "_s").alias("t"))).alias("_rows"))
    asked = asked.withColumn("_targets", F.array_sort(F.transform("_rows", lambda r: r["t"])))
    fans = users.groupBy("user_id", "n_tokens").agg(F.array_sort(F.collect_list("_own")).alias("_profiles"))

    wanted, own = F.array_distinct(F.flatten(F.transform("_targets", lambda t: t["_wanted"]))), F.array_distinct(F.flatten("_profiles"))
    offered = asked.select("_targets").distinct().withColumn("_wanted", wanted).withColumn("_key", F.explode("_wanted")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    reading = fans.groupBy("_profiles").agg(F.count(F.lit(1)).alias("n_users"), F.sum("n_tokens").alias("n_tokens")).withColumn("_own", own).withColumn(
        "_key", F.explode("_own")
    ).withColumn("_salt", F.pmod(F.xxhash64("_profiles"), F.lit(salts)).cast("int"))
    first = F.get(F.filter(F.array_intersect("_wanted", "_own"), lambda k: k.isNotNull()), F.lit(0)) == F.col("_key")
    met = offered.join(reading, ["_key", "_salt"]).filter(first).withColumn("_n", _n_fitting(F.col("_targets"), F.col("_profiles"))).filter("_n > 0")
    reach = met.groupBy("_targets").agg(F.sum("n_users").alias("recipients"), F.sum(F.col("_n") * F.col("n_tokens")).alias("deliveries"))
    counts = asked.join(reach, "_targets").select("breaking_id", "recipients", "deliveries")

    pairs = recent.distinct().join(offers.select("article_id", "breaking_id").distinct(), "article_id")
    known = pairs.groupBy("breaking_id", "user_id").agg(F.collect_set("article_id").alias("_seen")).join(fans, "user_id")
    known = known.alias("k").join(asked.alias("a"), F.expr("k.breaking_id <=> a.breaking_id")).select("k.*", "a._rows")
    had = lambda r: F.coalesce(F.array_contains("_seen", r["article_id"]), F.lit(False))
    fitting = lambda keep: _n_fitting(F.transform(F.filter("_rows", keep), lambda r: r["t"]), F.col("_profiles"))
    known = known.select("breaking_id", "n_tokens", fitting(had).alias("_lost"), fitting(lambda r: ~had(r)).alias("_left"))
    taken = known.filter("_lost > 0").select(
        "breaking_id", F.when(F.col("_left") == 0, F.lit(-1)).otherwise(0).cast("bigint").alias("recipients"), (-F.col("_lost") * F.col("n_tokens")).alias("deliveries")
    )
    return counts.unionByName(taken)


def breaking_delivery_stats(audience: DataFrame) -> DataFrame:
    """Recipients and deliveries per item that reaches anyone, of a :func:`breaking_audience` with ``counted``."""
    totals = audience.groupBy("breaking_id").agg(F.sum("recipients").alias("total_recipients"), F.sum("deliveries").alias("successful_deliveries"))
    return totals.filter("total_recipients > 0")


def pending_alerts(alerts: DataFrame, limit: int = 20) -> DataFrame:
    """By importance, oldest first."""
    return alerts.filter("status = 'pending'").orderBy(F.desc_nulls_first("importance_score"), "created_at", "id").limit(limit)


# --- read state ------------------------------------------------------------------------


def unread(notifications: DataFrame) -> DataFrame:
    """N13."""
    return notifications.filter(~F.col("is_read"))


def mark_read(notifications: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """New snapshot; ``requests`` is ``(id, user_id)`` and only owners may mark."""
    asked = requests.select("id", "user_id").distinct().withColumn("_asked", F.lit(True))
    return _with_read(notifications.join(asked, ["id", "user_id"], "left"), as_of)


def mark_all_read(notifications: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """New snapshot with everything read for the given users."""
    asked = users.select("user_id").distinct().withColumn("_asked", F.lit(True))
    return _with_read(notifications.join(asked, "user_id", "left"), as_of)


def _with_read(joined: DataFrame, as_of: Column) -> DataFrame:
    newly = F.coalesce("_asked", F.lit(False)) & ~F.col("is_read")
    before = F.col("read_at") if "read_at" in joined.columns else F.lit(None).cast("timestamp")
    return joined.withColumns({"read_at": F.when(newly, as_of).otherwise(before), "is_read": F.col("is_read") | newly}).drop("_asked")
