"""Story clustering, synthesis and maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pressline.functions import text as tx
from pressline.functions import vectors as vec
from pressline.operators import similarity as sim
from pressline.operators.entities import verbatim_entities
from pressline.operators.feeds import exclude_themes, hours_before
from pressline.operators.graph import connected_components
from pressline.operators.ranking import card_image, first_seen, gap_sessions, rank_all, top_n
from pressline.operators.trends import mean_vector, set_union, story_counts
from pressline.session import cut_lineage, shared_dir

# --- fixed values: matching thresholds ---
ATTACH_SCORE = 0.66
STRONG_COSINE = 0.86
COSINE_FLOOR = 0.52
MIN_ENTITY_OVERLAP = 0.04
EVENT_WINDOW_DAYS = 14
COSINE_WEIGHT = 0.70
ENTITY_WEIGHT = 0.30
REVIVAL_LOOKBACK_DAYS = 365
REVIVAL_COSINE = 0.80
REVIVAL_ENTITY = 0.10
ADJUDICATION_COSINE = 0.62
ADJUDICATION_CANDIDATES = 2
SYNTHESIS_MIN_ARTICLES = 2
SYNTHESIS_IMPORTANCE = 7

SEED_ARTICLES = 1024  # articles that all are compared with first
SEED_GROWTH = 8

DAY = 86400


# --- inputs ----------------------------------------------------------------------------


def embedding_text(
    articles: DataFrame, enrichments: DataFrame, body_length: int | None = None, max_names: int | None = None, text_length: int | None = None
) -> DataFrame:
    """The text to embed: headline, body or summary, entities, topics.

    The limits belong to the embedding model a user plugs in; without them nothing is cut.
    """
    joined = articles.select(F.col("id").alias("article_id"), "title", "content").join(enrichments, "article_id")
    body = tx.strip(F.coalesce("content", F.lit("")))
    names = F.concat("entities_people", "entities_organizations", "entities_locations")
    filled = lambda c, value: F.when(c, value)
    parts = F.array_compact(
        F.array(
            F.coalesce("title", F.lit("")),
            F.when(body != "", F.substring(body, 1, body_length) if body_length else body).when(F.coalesce("summary", F.lit("")) != "", F.col("summary")),
            filled(F.size(names) > 0, F.concat(F.lit("Entities: "), F.array_join(F.slice(names, 1, max_names) if max_names else names, ", "))),
            filled(F.size("themes") > 0, F.concat(F.lit("Topics: "), F.array_join("themes", ", "))),
        )
    )
    text = F.array_join(parts, "\n")
    return joined.select("article_id", (F.substring(text, 1, text_length) if text_length else text).alias("text"))


def pending_embeddings(enrichments: DataFrame, embeddings: DataFrame, batch: int | None = None) -> DataFrame:
    """Completed annotations without a vector, without excluded themes."""
    done = exclude_themes(enrichments.filter("status = 'completed'"))
    waiting = done.join(embeddings.select("article_id"), "article_id", "left_anti")
    return waiting.orderBy("article_id").limit(batch) if batch else waiting


def embed_pending(pending: DataFrame, articles: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Vectors for waiting annotations from a user's function of the text to embed.

    ``embed`` is a pandas UDF (or any column function) from text to ``array<float>``.
    """
    texts = embedding_text(articles, pending)
    return texts.select("article_id", embed(F.col("text")).alias("embedding"))


def unassigned(enrichments: DataFrame, embeddings: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """Embedded, completed, not yet in a story; with vector, date and entity set."""
    done = exclude_themes(enrichments.filter("status = 'completed'"))
    dates = articles.select(F.col("id").alias("article_id"), "published_at", "scraped_at")
    free = done.join(links.select("article_id"), "article_id", "left_anti")
    entity_set = vec.entity_set(F.col("entities_people"), F.col("entities_organizations"), F.col("entities_locations"))
    return free.join(embeddings.select("article_id", "embedding"), "article_id").join(dates, "article_id").select(
        "article_id", "embedding", "published_at", "scraped_at", "importance_score", entity_set.alias("entity_set")
    )


def story_entity_sets(links: DataFrame, enrichments: DataFrame, articles: DataFrame, members: int | None = None) -> DataFrame:
    """A17 for stories: names of all completed members, or of the newest ``members``."""
    names = vec.entity_set(F.col("entities_people"), F.col("entities_organizations"), F.col("entities_locations"))
    done = enrichments.filter("status = 'completed'").select("article_id", names.alias("entity_set"))
    dates = articles.select(F.col("id").alias("article_id"), "published_at")
    rows = links.join(done, "article_id").join(dates, "article_id")
    return set_union(rows, "story_id", "entity_set", [F.desc_nulls_first("published_at"), F.desc("article_id")], members)


def update_centroids(links: DataFrame, enrichments: DataFrame, embeddings: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Mean of all completed members' vectors per story."""
    wanted = links.join(touched.select("story_id"), "story_id", "left_semi") if touched is not None else links
    done = enrichments.filter("status = 'completed'").select("article_id", "analyzed_at")
    members = wanted.join(done, "article_id").join(embeddings.select("article_id", "embedding"), "article_id")
    return mean_vector(members, "story_id")


# --- matching --------------------------------------------------------------------------

_MATCH_SCHEMA = (
    "article_id bigint, story_id bigint, strong boolean, score double, cosine double, entity double, last_seen bigint, importance int"
)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _match_block(articles: pd.DataFrame, stories: pd.DataFrame) -> pd.DataFrame:
    """The best story of this block for every article that has one above the floor."""
    names = ["article_id", "story_id", "strong", "score", "cosine", "entity", "last_seen", "importance"]
    if articles.empty or stories.empty:
        return pd.DataFrame(columns=names)
    stories = stories.sort_values(["last_seen", "importance", "story_id"], ascending=[False, False, True], ignore_index=True)
    cosine = sim.unit_rows(articles["embedding"]) @ sim.unit_rows(stories["centroid"]).T
    published = articles["published"].to_numpy(dtype="float64")
    days = np.abs(np.floor((published[:, None] - stories["last_seen"].to_numpy(dtype="float64")[None, :]) / (DAY * 1e6)))
    strong = cosine >= STRONG_COSINE
    undated = np.isnan(published)[:, None]
    open_ = (cosine >= COSINE_FLOOR) & np.where(undated, strong, days <= EVENT_WINDOW_DAYS)
    strong &= open_
    entity = sim.jaccard_matrix(articles["entity_set"], stories["entity_set"])
    combined = COSINE_WEIGHT * cosine + ENTITY_WEIGHT * entity
    combined = np.where(open_ & (entity >= MIN_ENTITY_OVERLAP), combined, 0.0)
    is_strong = strong.any(axis=1)
    pick = np.where(is_strong, strong.argmax(axis=1), combined.argmax(axis=1))
    rows = np.arange(len(articles))
    score = np.where(is_strong, cosine[rows, pick], combined[rows, pick])
    keep = score > 0
    best = stories.iloc[pick]
    out = pd.DataFrame(
        {
            "article_id": articles["article_id"].to_numpy(), "story_id": best["story_id"].to_numpy(), "strong": is_strong, "score": score,
            "cosine": cosine[rows, pick], "entity": entity[rows, pick], "last_seen": best["last_seen"].to_numpy(),
            "importance": best["importance"].to_numpy(),
        }
    )
    return out[keep][names]


_PAIR_SCHEMA = "article_id bigint, story_id bigint, cosine double, days int"


def interval_similarity_join(
    articles: DataFrame, stories: DataFrame, floor: float = COSINE_FLOOR, days: int = EVENT_WINDOW_DAYS, rows: int = sim.NEAR_ROWS,
    top: int | None = None,
) -> DataFrame:
    """Pairs of article and story within ``days`` whole days and at least ``floor`` similar.

    With ``top`` only the most similar stories of an article, by id where equal: no block emits
    more than that many per article.
    """
    width = (2 * days + 1) * DAY * 1_000_000

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["article_id", "story_id", "cosine", "days"])
        cosine = sim.unit_rows(left["embedding"]) @ sim.unit_rows(right["centroid"]).T
        apart = np.floor((left["published"].to_numpy()[:, None] - right["last_seen"].to_numpy()[None, :]) / (DAY * 1e6))
        close = (cosine >= floor) & (np.abs(apart) <= days)
        if top is not None:
            rank = np.lexsort((np.broadcast_to(right["story_id"].to_numpy(), cosine.shape), -np.where(close, cosine, -2.0)), axis=1)[:, :top]
            first = np.zeros_like(close)
            np.put_along_axis(first, rank, True, axis=1)
            close &= first
        i, j = np.nonzero(close)
        return pd.DataFrame(
            {"article_id": left["article_id"].to_numpy()[i], "story_id": right["story_id"].to_numpy()[j], "cosine": cosine[i, j],
             "days": apart[i, j].astype("int32")}
        )

    seen = _micros("last_seen_at")
    reach = F.array_distinct(
        F.array(F.floor((seen - days * DAY * 1_000_000) / width), F.floor((seen + (days + 1) * DAY * 1_000_000 - 1) / width))
    )
    right = stories.filter("centroid IS NOT NULL").select(
        F.col("id").alias("story_id"), "centroid", seen.alias("last_seen"), F.explode(reach).alias("cell")
    )
    published = _micros("published_at")
    left = articles.filter("embedding IS NOT NULL AND published_at IS NOT NULL").select(
        "article_id", "embedding", published.alias("published"), F.floor(published / width).alias("cell")
    )
    pairs = sim.compare_near(left, right, compare, _PAIR_SCHEMA, "article_id", "story_id", "embedding", "centroid", floor, rows)
    return pairs if top is None else top_n(pairs, ["article_id"], [F.desc("cosine"), F.asc("story_id")], top)


def match_active(articles: DataFrame, stories: DataFrame, as_of: Column, rows: int = sim.NEAR_ROWS) -> DataFrame:
    """The best active story per article, ``attached`` when it is good enough.

    A strong cosine wins at once, by story order (newest, then most important), before
    any combined score. Only articles with some score are returned.
    ``articles``: article_id, embedding, published_at, entity_set. ``stories``: id,
    centroid, entity_set, last_seen_at, importance_score, status.
    """
    window = as_of - F.make_dt_interval(days=F.lit(EVENT_WINDOW_DAYS))
    active = stories.filter((F.col("status") == "active") & (F.col("last_seen_at") >= window) & F.col("centroid").isNotNull())
    # An article can join a story from 14 days before to just under 15 days after its
    # last sight: a span of one cell, so a story lies in at most two cells.
    width = (2 * EVENT_WINDOW_DAYS + 1) * DAY * 1_000_000
    seen = _micros("last_seen_at")
    reach = F.array_distinct(
        F.array(
            F.floor((seen - EVENT_WINDOW_DAYS * DAY * 1_000_000) / width), F.floor((seen + (EVENT_WINDOW_DAYS + 1) * DAY * 1_000_000 - 1) / width),
            F.lit(None).cast("bigint"),
        )
    )
    undated = F.lit(-(10**12))
    right = active.select(
        F.col("id").alias("story_id"), "centroid", F.coalesce("entity_set", F.array().cast("array<string>")).alias("entity_set"),
        seen.alias("last_seen"), F.coalesce("importance_score", F.lit(0)).cast("int").alias("importance"), F.explode(reach).alias("cell"),
    ).withColumn("cell", F.coalesce("cell", undated))
    left = articles.filter(F.col("embedding").isNotNull()).select(
        "article_id", "embedding", "entity_set", _micros("published_at").alias("published"),
        F.coalesce(F.floor(_micros("published_at") / width), undated).alias("cell"),
    )
    hits = sim.compare_near(left, right, _match_block, _MATCH_SCHEMA, "article_id", "story_id", "embedding", "centroid", COSINE_FLOOR, rows)
    by_rank = F.struct(
        F.col("strong").alias("a"), F.when(F.col("strong"), 0.0).otherwise(F.col("score")).alias("b"), F.col("last_seen").alias("c"),
        F.col("importance").alias("d"), (-F.col("story_id")).alias("e"),
    )
    best = hits.groupBy("article_id").agg(F.max_by(F.struct("story_id", "strong", "score", "cosine", "entity"), by_rank).alias("m"))
    return best.select("article_id", "m.*").withColumn("attached", F.col("strong") | (F.col("score") >= ATTACH_SCORE))


_REVIVAL_SCHEMA = "article_id bigint, story_id bigint, cosine double, entity double, last_seen bigint, importance int"


def _revival_block(articles: pd.DataFrame, stories: pd.DataFrame) -> pd.DataFrame:
    names = ["article_id", "story_id", "cosine", "entity", "last_seen", "importance"]
    if articles.empty or stories.empty:
        return pd.DataFrame(columns=names)
    stories = stories.sort_values(["last_seen", "importance", "story_id"], ascending=[False, False, True], ignore_index=True)
    cosine = sim.unit_rows(articles["embedding"]) @ sim.unit_rows(stories["centroid"]).T
    left_over = np.where(np.isnan(cosine), -np.inf, cosine)
    first = np.empty((len(articles), min(ADJUDICATION_CANDIDATES, len(stories))), dtype=int)
    for place in range(first.shape[1]):  # the first of equal ones, as in a stable sort
        first[:, place] = left_over.argmax(axis=1)
        left_over[np.arange(len(articles)), first[:, place]] = -np.inf
    at = np.repeat(np.arange(len(articles)), first.shape[1])
    pick = first.ravel()
    keep = cosine[at, pick] >= ADJUDICATION_COSINE
    at, pick = at[keep], pick[keep]
    sets_a, sets_b = articles["entity_set"].to_list(), stories["entity_set"].to_list()
    entity = [sim.jaccard_matrix([sets_a[i]], [sets_b[j]])[0, 0] for i, j in zip(at, pick)]
    best = stories.iloc[pick]
    return pd.DataFrame(
        {
            "article_id": articles["article_id"].to_numpy()[at], "story_id": best["story_id"].to_numpy(), "cosine": cosine[at, pick],
            "entity": entity, "last_seen": best["last_seen"].to_numpy(), "importance": best["importance"].to_numpy(),
        }
    )


def revival_candidates(articles: DataFrame, stories: DataFrame, as_of: Column, rows: int = sim.NEAR_ROWS) -> DataFrame:
    """C6 input: the two most similar stories last seen 14 to 365 days ago, per article."""
    window = as_of - F.make_dt_interval(days=F.lit(EVENT_WINDOW_DAYS))
    oldest = as_of - F.make_dt_interval(days=F.lit(REVIVAL_LOOKBACK_DAYS))
    older = stories.filter((F.col("last_seen_at") >= oldest) & (F.col("last_seen_at") < window) & F.col("centroid").isNotNull())
    right = older.select(
        F.col("id").alias("story_id"), "centroid", F.coalesce("entity_set", F.array().cast("array<string>")).alias("entity_set"),
        _micros("last_seen_at").alias("last_seen"), F.coalesce("importance_score", F.lit(0)).cast("int").alias("importance"),
    )
    left = articles.filter(F.col("embedding").isNotNull()).select("article_id", "embedding", "entity_set")
    hits = sim.compare_near(left, right, _revival_block, _REVIVAL_SCHEMA, "article_id", "story_id", "embedding", "centroid", ADJUDICATION_COSINE, rows)
    order = [F.desc("cosine"), F.desc("last_seen"), F.desc("importance"), F.asc("story_id")]
    return top_n(hits, ["article_id"], order, ADJUDICATION_CANDIDATES)


Adjudicator = Callable[[DataFrame], DataFrame]


def verdicts_from(table: DataFrame) -> Adjudicator:
    """Verdicts looked up in a table ``(article_id, story_id, verdict)``."""
    return lambda candidates: candidates.join(table, ["article_id", "story_id"], "left")


def verdicts_by(judge: Callable[[Column, Column], Column]) -> Adjudicator:
    """Verdicts from a user's function of (article_id, story_id), e.g. a pandas UDF."""
    return lambda candidates: candidates.withColumn("verdict", judge(F.col("article_id"), F.col("story_id")))


def match_revival(articles: DataFrame, stories: DataFrame, adjudicate: Adjudicator, as_of: Column, rows: int = sim.NEAR_ROWS) -> DataFrame:
    """``(article_id, story_id, action)`` with action attach or related.

    The most similar older story is revived directly when vector and names agree;
    otherwise the first of two candidates decides that is judged same_story or
    related_story. Only these candidates, at most two per article, are adjudicated.
    """
    found = adjudicate(revival_candidates(articles, stories, as_of, rows))
    direct = (F.col("rank") == 1) & (F.col("cosine") >= REVIVAL_COSINE) & (F.col("entity") >= REVIVAL_ENTITY)
    action = F.when(direct, "attach").when(F.col("verdict") == "same_story", "attach").when(F.col("verdict") == "related_story", "related")
    decided = found.withColumn("action", action).filter("action IS NOT NULL")
    first = F.min_by(F.struct("story_id", "action", "cosine", "entity"), F.col("rank")).alias("m")
    return decided.groupBy("article_id").agg(first).select("article_id", "m.*")


def _same_event_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest, over labels, of the pairs in this block that belong to one event and have two labels."""
    if left.empty or right.empty:
        return pd.DataFrame(columns=["src", "dst"])
    cosine = sim.unit_rows(left["embedding"]) @ sim.unit_rows(right["embedding"]).T
    linked = cosine >= STRONG_COSINE
    i, j, entity = sim.jaccard_pairs(left["entity_set"], right["entity_set"])
    between = cosine[i, j]
    joined = (between >= COSINE_FLOOR) & (entity >= MIN_ENTITY_OVERLAP) & (COSINE_WEIGHT * between + ENTITY_WEIGHT * entity >= ATTACH_SCORE)
    linked[i[joined], j[joined]] = True
    dates, others = left["date"].to_numpy(), right["date"].to_numpy()
    if max(dates.max() - others.min(), others.max() - dates.min()) >= (EVENT_WINDOW_DAYS + 1) * DAY * 1_000_000:
        linked &= np.floor(np.abs(dates[:, None] - others[None, :]) / (DAY * 1e6)) <= EVENT_WINDOW_DAYS
    label, other = left["label"].to_numpy(), right["label"].to_numpy()
    linked &= label[:, None] != other[None, :]
    return sim.forest(linked, label, other)


def _event_links(heads: DataFrame, rows: int) -> DataFrame:
    """Edges that connect articles of one event; ``heads``: article_id, embedding, entity_set, date, cell.

    Close dates lie in the same or the next cell. Where there are many articles all are first
    compared with a few of them. What this connects has one label from then on, and links
    inside a label are not looked for again: while one label holds most articles, only the others
    are compared with more and more articles, and those still left at the end with all.
    """
    beside = lambda df, *more: df.withColumn("cell", F.explode(F.array("cell", *[F.col("cell") + n for n in more])))
    schema = "src bigint, dst bigint"
    labelled = heads.withColumn("label", F.col("article_id"))
    left, n, seeds, most = labelled, heads.count(), SEED_ARTICLES, 0
    while seeds * SEED_GROWTH <= n:
        few = labelled.filter(F.pmod(F.xxhash64("article_id"), F.lit(n)) < seeds)
        found = sim.compare_blocks(left, beside(few, -1, 1), _same_event_block, schema, "article_id", "article_id")
        joined = connected_components(found).select(F.col("id").alias("label"), "component")
        labelled = cut_lineage(labelled.join(joined, "label", "left").select(*heads.columns, F.coalesce("component", "label").alias("label")))
        largest = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("label", "n").alias("label"), F.max("n").alias("n")).first()
        most = largest["n"]
        if 2 * most <= n:
            break
        left, seeds = labelled.filter(F.col("label") != largest["label"]), seeds * SEED_GROWTH
    left, right = (left, beside(labelled, -1, 1)) if 2 * most > n else (labelled, beside(labelled, -1))
    edges = sim.compare_near(left, right, _same_event_block, schema, "article_id", "article_id", "embedding", "embedding", COSINE_FLOOR, rows)
    return edges.unionByName(labelled.select(F.col("article_id").alias("src"), F.col("label").alias("dst")))


def same_event_groups(articles: DataFrame, as_of: Column, rows: int = sim.NEAR_ROWS) -> DataFrame:
    """C7 residue: ``(article_id, group_id)``; articles of one event share a group.

    Two articles belong together under the thresholds that let an article join a story,
    up to 14 whole days apart; groups are closed over such pairs. Articles with equal
    vector, names and day are one representative, so copies are compared once.
    """
    date = _micros("date")
    base = articles.withColumn("date", tx.event_date(F.col("published_at"), F.col("scraped_at"), as_of)).select(
        "article_id", "embedding", "entity_set", date.alias("date"),
        # A vector of zeros is similar to nothing, so it is no copy of another.
        F.xxhash64(
            "embedding", F.array_sort("entity_set"), F.to_date("date"),
            F.when(F.exists("embedding", lambda x: x != 0), F.lit(0)).otherwise(F.col("article_id")),
        ).alias("copy"),
    )
    first = base.groupBy("copy").agg(F.min("article_id").alias("head"))
    copies = base.join(first, "copy").select(F.col("article_id").alias("src"), F.col("head").alias("dst"))
    heads = base.join(first.select("copy", F.col("head").alias("article_id")), ["copy", "article_id"], "left_semi")
    width = (EVENT_WINDOW_DAYS + 1) * DAY * 1_000_000
    edges = _event_links(cut_lineage(heads.withColumn("cell", F.floor(F.col("date") / width)).drop("copy")), rows)
    groups = connected_components(edges.unionByName(copies))
    labelled = articles.select("article_id").join(groups.withColumnRenamed("id", "article_id"), "article_id", "left")
    return labelled.select("article_id", F.coalesce("component", "article_id").alias("group_id"))


def story_key(*parts: Column) -> Column:
    """A stable id for a new story."""
    return F.xxhash64(F.lit("story"), *parts)


def assign_batch(
    articles: DataFrame, stories: DataFrame, adjudicate: Adjudicator, as_of: Column, rows: int = sim.NEAR_ROWS
) -> DataFrame:
    """One row per article: story, action, relevance and an older related story.

    Actions: attached (active story), revived (older story), created (first article of a
    new story), grouped (later article of a new story). Articles are matched against the
    stories as they are before the batch; within a batch centroids do not drift, and
    articles that match no story are grouped among themselves. A batch of one article
    gives the reference's result.
    """
    unmatched = lambda df, done: df.join(done.select("article_id"), "article_id", "left_anti")
    scored = cut_lineage(match_active(articles, stories, as_of, rows))
    attached = scored.filter("attached")
    rest = unmatched(articles, attached)
    revival = cut_lineage(match_revival(rest, stories, adjudicate, as_of, rows))
    revived = revival.filter("action = 'attach'")
    residue = cut_lineage(unmatched(rest, revived))
    date = tx.event_date(F.col("published_at"), F.col("scraped_at"), as_of)
    grouped = residue.withColumn("date", date).join(same_event_groups(residue, as_of, rows), "article_id")
    seeds = grouped.groupBy("group_id").agg(
        F.min_by(F.struct("article_id", "embedding"), F.struct("date", "article_id")).alias("seed")
    )
    seen = scored.select("article_id", F.col("score").alias("best_seen"))
    parents = revival.filter("action = 'related'").select("article_id", F.col("story_id").alias("related_story_id"))
    made = grouped.join(seeds, "group_id").join(seen, "article_id", "left").join(parents, "article_id", "left")
    is_seed = F.col("article_id") == F.col("seed.article_id")
    relevance = F.when(is_seed, F.greatest(F.coalesce("best_seen", F.lit(0.0)), F.lit(0.5))).otherwise(
        F.greatest(vec.cosine(F.col("embedding"), F.col("seed.embedding")), F.lit(0.5))
    )
    none = F.lit(None).cast("bigint")
    created = made.select(
        "article_id", story_key(F.col("seed.article_id")).alias("story_id"), F.when(is_seed, "created").otherwise("grouped").alias("action"),
        relevance.alias("relevance_score"), "related_story_id",
    )
    joined = attached.select(
        "article_id", "story_id", F.lit("attached").alias("action"), F.col("score").alias("relevance_score"), none.alias("related_story_id")
    )
    resumed = revived.select(
        "article_id", "story_id", F.lit("revived").alias("action"), F.lit(0.8).alias("relevance_score"), none.alias("related_story_id")
    )
    return joined.unionByName(resumed).unionByName(created)


# --- story rows ------------------------------------------------------------------------


def new_story_card(assignments: DataFrame, articles: DataFrame, enrichments: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """A row per new story from its first article; dates and importance from all."""
    new = assignments.filter(F.col("action").isin("created", "grouped"))
    rows = articles.withColumnRenamed("id", "article_id").join(enrichments, "article_id")
    date = tx.event_date(F.col("published_at"), F.col("scraped_at"), as_of)
    dates = new.join(rows.select("article_id", date.alias("date"), "importance_score"), "article_id").groupBy("story_id").agg(
        F.min("date").alias("first_seen_at"), F.max("date").alias("last_seen_at"),
        F.greatest(F.lit(0), F.max("importance_score")).alias("importance_score"), F.count(F.lit(1)).alias("article_count"),
    )
    outlet = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    seed = new.filter("action = 'created'").select("story_id", "article_id", "related_story_id").join(
        rows.drop("importance_score"), "article_id"
    ).join(outlet, "source_id", "left")
    title = F.substring(F.coalesce(F.nullif("neutral_title", F.lit("")), "title"), 1, 300)
    facts = F.filter(F.slice("key_facts", 1, 6), lambda f: tx.strip(f) != "")
    why = F.coalesce(F.nullif(F.col("why_it_matters"), F.lit("")) if "why_it_matters" in enrichments.columns else F.lit(None), "impact_note", F.lit(""))
    carded = seed.withColumns({"card_title": title, "facts": facts, "why_this_matters": why, "summary": F.coalesce("summary", F.lit(""))})
    text = F.concat_ws(" ", "card_title", "summary", "why_this_matters", F.array_join("facts", " "))
    cited = F.struct(
        F.col("article_id"), F.coalesce("source_name", F.lit("Unknown source")).alias("source"), F.col("url").alias("url")
    )
    cards = carded.select(
        "story_id", F.col("card_title").alias("title"), "summary", "why_this_matters",
        F.transform("facts", lambda f: F.struct(f.alias("text"), F.lit(1).alias("sources_count"), F.array(cited).alias("citations"))).alias("key_highlights"),
        verbatim_entities(F.col("entities_people"), F.col("entities_organizations"), F.col("entities_locations"), text).alias("entities"),
        F.coalesce(F.get("themes", F.lit(0)), F.lit("general")).alias("primary_theme"), F.lit("active").alias("status"), "related_story_id",
    )
    return cards.join(dates, "story_id")


def story_links(assignments: DataFrame, existing: DataFrame) -> DataFrame:
    """Article links that are not stored yet."""
    fresh = assignments.select("story_id", "article_id", "relevance_score")
    return fresh.join(existing.select("article_id"), "article_id", "left_anti")


def story_perspectives(assignments: DataFrame, articles: DataFrame, enrichments: DataFrame) -> DataFrame:
    """How each outlet frames the story."""
    outlet = articles.filter("source_id IS NOT NULL").select(F.col("id").alias("article_id"), "source_id")
    notes = enrichments.select("article_id", F.col("summary").alias("framing_summary"), F.col("themes").alias("notable_emphasis"), "sentiment_score")
    return assignments.select("story_id", "article_id").join(outlet, "article_id").join(notes, "article_id")


def story_timeline(assignments: DataFrame, articles: DataFrame, enrichments: DataFrame, as_of: Column) -> DataFrame:
    """One dated event per article."""
    date = tx.event_date(F.col("published_at"), F.col("scraped_at"), as_of)
    events = articles.select(
        F.col("id").alias("article_id"), F.substring("title", 1, 240).alias("title"), date.alias("event_date"),
        F.array(F.struct(F.col("url"), F.col("title"))).alias("citations"),
    )
    notes = enrichments.select("article_id", F.col("summary").alias("description"))
    return assignments.select("story_id", "article_id").join(events, "article_id").join(notes, "article_id")


def refreshed_stories(stories: DataFrame, assignments: DataFrame, articles: DataFrame, enrichments: DataFrame, as_of: Column) -> DataFrame:
    """C7 for stories that gained articles: last sight, importance and status."""
    date = tx.event_date(F.col("published_at"), F.col("scraped_at"), as_of)
    gained = (
        assignments.filter(F.col("action").isin("attached", "revived"))
        .join(articles.select(F.col("id").alias("article_id"), date.alias("date")), "article_id")
        .join(enrichments.select("article_id", F.col("importance_score").alias("importance")), "article_id")
        .groupBy(F.col("story_id").alias("id")).agg(F.max("date").alias("_date"), F.max("importance").alias("_importance"), F.count(F.lit(1)).alias("n_new"))
    )
    return stories.join(gained, "id").withColumns(
        {
            "last_seen_at": F.greatest("last_seen_at", "_date"),
            "importance_score": F.greatest("importance_score", F.coalesce("_importance", F.lit(0))), "status": F.lit("active"),
        }
    ).drop("_date", "_importance")


def _latest() -> Column:
    """Sort key of members from oldest to latest: undated ones come last."""
    return F.struct(F.col("published_at").isNull(), "published_at", "article_id")


def needs_synthesis(stories: DataFrame, links: DataFrame, enrichments: DataFrame, articles: DataFrame) -> DataFrame:
    """C11: stories to write anew, with the reason."""
    counts = links.groupBy("story_id").agg(F.countDistinct("article_id").alias("article_count"))
    dates = articles.select(F.col("id").alias("article_id"), "published_at")
    newest = (
        links.join(enrichments.filter("status = 'completed'").select("article_id", "importance_score"), "article_id").join(dates, "article_id")
        .groupBy("story_id").agg(F.max_by("importance_score", _latest()).alias("latest_importance"))
    )
    joined = stories.select(F.col("id").alias("story_id"), "version", "articles_at_synthesis").join(counts, "story_id").join(newest, "story_id", "left")
    new = F.col("article_count") - F.col("articles_at_synthesis")
    reason = (
        F.when(F.col("version") == 0, F.concat(F.lit("first synthesis ("), F.col("article_count"), F.lit(" articles)")))
        .when(new >= 1, F.concat(new, F.lit(" new articles since v"), F.col("version")))
        .when((new > 0) & (F.col("latest_importance") >= SYNTHESIS_IMPORTANCE), F.concat(F.lit("high-importance update (score="), F.col("latest_importance"), F.lit(")")))
    )
    due = joined.filter(F.col("article_count") >= SYNTHESIS_MIN_ARTICLES).withColumn("reason", reason)
    return due.filter("reason IS NOT NULL").select("story_id", "article_count", "reason")


def synthesis_payload(
    stories: DataFrame, links: DataFrame, articles: DataFrame, enrichments: DataFrame, sources: DataFrame, relations: DataFrame,
    text_limit: int | None = None,
) -> DataFrame:
    """The facts a writer gets per story: members in order, earlier stories, latest news.

    A writer that takes a limited text gives ``text_limit``: the member list is cut after
    that many characters, and only members that start before it are collected. Entries are
    measured as they are, whatever fields are null.
    """
    outlet = sources.select(F.col("id").alias("source_id"), F.coalesce("name", F.lit("unknown")).alias("source"))
    done = enrichments.filter("status = 'completed'").select("article_id", "summary", "key_facts", "importance_score")
    rows = links.join(done, "article_id").join(
        articles.select(F.col("id").alias("article_id"), "title", "published_at", "scraped_at", "source_id"), "article_id"
    ).join(outlet, "source_id", "left")
    published = F.date_format(F.coalesce("published_at", "scraped_at"), "yyyy-MM-dd HH:mm:ss")
    entry = F.to_json(
        F.struct(
            "article_id", "source", F.coalesce(published, F.lit("")).alias("published"), "title", "summary", "key_facts",
            F.col("importance_score").alias("importance"),
        )
    )
    place = F.struct(F.col("published_at").isNull().alias("u"), F.col("published_at").alias("d"), F.col("article_id").alias("a"))
    entered = rows.select("story_id", place.alias("place"), entry.alias("entry"))
    if text_limit:
        # An entry takes two characters at least, so no more than half the limit can show.
        few = top_n(entered, ["story_id"], [F.asc("place")], text_limit // 2)
        before = Window.partitionBy("story_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        entered = few.withColumn("_used", F.coalesce(F.sum(F.length("entry") + 1).over(before), F.lit(0))).filter(F.col("_used") < text_limit)
    members = entered.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("place", "entry"))).alias("_m"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("_m", lambda m: m["entry"]), ","), F.lit("]"))
    newest = F.max_by(F.struct("source", "title", "summary"), _latest()).alias("n")
    latest = rows.groupBy("story_id").agg(newest, F.count(F.lit(1)).alias("article_count")).select(
        "story_id", "article_count", F.concat(F.lit("["), F.col("n.source"), F.lit("] "), F.col("n.title"), F.lit(" — "), F.col("n.summary")).alias("latest"),
    )
    parent = stories.select(
        F.col("id").alias("to_story_id"),
        F.substring(F.concat(F.lit("- ["), F.to_date("last_seen_at").cast("string"), F.lit("] "), F.col("title"), F.lit(": "),
                             F.coalesce("short_summary", F.lit(""))), 1, 300).alias("line"),
    )
    few = top_n(relations.select(F.col("from_story_id").alias("story_id"), "to_story_id"), ["story_id"], [F.asc("to_story_id")], 5)
    lines = few.join(parent, "to_story_id").groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_r"))
    joined = members.join(latest, "story_id").join(lines, "story_id", "left")
    related = F.coalesce(F.array_join(F.transform("_r", lambda r: r["line"]), "\n"), F.lit("(none)"))
    return joined.select(
        "story_id", "article_count", (F.substring(listed, 1, text_limit) if text_limit else listed).alias("articles_json"), related.alias("related_stories"),
        F.col("latest").alias("latest_article"),
    )


def apply_synthesis(
    stories: DataFrame, synthesis: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, versions: DataFrame
) -> DataFrame:
    """New story versions from written texts.

    ``synthesis``: story_id, title, short_summary, overview, why_it_matters, reason,
    highlights ``array<struct<text, article_ids>>`` and entities ``array<struct<name,
    type>>``. Cited ids become citations when the article is a member; others vanish.
    """
    outlet = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    cited = articles.select(F.col("id").alias("article_id"), "url", "source_id").join(outlet, "source_id", "left")
    members = links.select("story_id", "article_id").distinct()
    listed = F.filter("highlights", lambda h: F.coalesce(h["text"], F.lit("")) != "")
    numbered = synthesis.select("story_id", F.posexplode_outer(listed).alias("at", "h")).filter("at IS NOT NULL")
    ids = numbered.select("story_id", "at", "h.text", F.posexplode_outer("h.article_ids").alias("pos", "article_id"))
    resolved = ids.join(members.withColumn("_member", F.lit(True)), ["story_id", "article_id"], "left").join(cited, "article_id", "left")
    citation = F.struct("pos", F.struct("article_id", F.coalesce("source", F.lit("Unknown source")).alias("source"), "url").alias("c"))
    regrouped = resolved.groupBy("story_id", "at", "text").agg(F.array_sort(F.collect_list(F.when(F.col("_member"), citation))).alias("_c"))
    found = F.transform("_c", lambda c: c["c"])
    highlight = F.struct("at", F.struct(F.col("text"), F.greatest(F.size(found), F.lit(1)).alias("sources_count"), found.alias("citations")).alias("h"))
    highlights = regrouped.groupBy("story_id").agg(F.array_sort(F.collect_list(highlight)).alias("_h"))
    counts = members.groupBy("story_id").agg(F.count(F.lit(1)).alias("article_count"))
    latest = versions.groupBy("story_id").agg(F.max("version").alias("_max"))
    current = stories.select(F.col("id").alias("story_id"), F.col("title").alias("_title"), F.col("version").alias("_version"), F.col("why_this_matters").alias("_why"))
    joined = (
        synthesis.drop("highlights").join(current, "story_id").join(highlights, "story_id", "left").join(counts, "story_id")
        .join(latest, "story_id", "left")
    )
    none = F.array().cast(highlights.schema["_h"].dataType)
    title = F.substring(F.coalesce(F.nullif("title", F.lit("")), "_title"), 1, 300)
    shaped = joined.withColumns(
        {
            "title": title, "key_highlights": F.transform(F.coalesce("_h", none), lambda h: h["h"]),
            "version": F.greatest("_version", F.coalesce("_max", F.lit(0))) + 1,
            "why_this_matters": F.coalesce(F.nullif("why_it_matters", F.lit("")), "_why"),
        }
    )
    text = F.concat_ws(" ", "title", "short_summary", "overview", "why_it_matters", F.array_join(F.transform("key_highlights", lambda h: h["text"]), " "))
    kinds = ["person", "organization", "location"]
    bare = F.transform("entities", lambda e: F.struct(F.trim(F.coalesce(e["name"], F.lit(""))).alias("name"), e["type"].alias("type")))
    return shaped.withColumn("_text", text).withColumn(
        "_e", F.filter(bare, lambda e: (e["name"] != "") & e["type"].isin(kinds) & F.col("_text").contains(e["name"]))
    ).withColumn("_n", F.transform("_e", lambda e: e["name"])).select(
        "story_id", "version", "title", "short_summary", "overview", "why_this_matters", "key_highlights",
        F.filter("_e", lambda e, i: F.array_position(F.col("_n"), e["name"]) == i + 1).alias("entities"), "article_count",
        F.substring("reason", 1, 300).alias("change_note"),
    )


def split_contaminated(
    links: DataFrame, articles: DataFrame, enrichments: DataFrame, embeddings: DataFrame, gap_days: int = 30, min_articles: int = 2
) -> DataFrame:
    """C14: stories whose articles fall into disjoint time groups, one row per group.

    Groups are more than ``gap_days`` whole days apart. The largest (first on a tie)
    keeps the story id, the others get a new one; dates, importance and centroid are
    computed per group, and ``version`` 0 asks for a new synthesis.
    """
    dated = links.join(
        articles.select(F.col("id").alias("article_id"), F.coalesce("published_at", "scraped_at").alias("date")), "article_id"
    )
    runs = gap_sessions(dated, ["story_id"], "date", (gap_days + 1) * DAY, break_at_gap=True)
    groups = split_groups(runs, min_articles)
    members = runs.join(groups.select("story_id", "session_no", "new_story_id", "kept"), ["story_id", "session_no"])
    facts = members.join(enrichments.select("article_id", "importance_score"), "article_id", "left").groupBy("new_story_id").agg(
        F.min("date").alias("first_seen_at"), F.max("date").alias("last_seen_at"), F.count(F.lit(1)).alias("article_count"),
        F.greatest(F.lit(0), F.max("importance_score")).alias("importance_score"),
    )
    vectors = members.select("new_story_id", "article_id").join(embeddings.select("article_id", "embedding"), "article_id")
    centroid = mean_vector(vectors, "new_story_id").drop("n_members")
    return (
        groups.join(facts, "new_story_id").join(centroid, "new_story_id", "left")
        .select("story_id", "session_no", "new_story_id", "kept", "article_count", "first_seen_at", "last_seen_at", "importance_score",
                F.lit(0).alias("version"), "centroid")
    )


def split_groups(runs: DataFrame, min_articles: int = 2) -> DataFrame:
    """Time groups of the stories that have several: size, kept flag and new story id."""
    sizes = runs.groupBy("story_id", "session_no").agg(F.count(F.lit(1)).alias("n"))
    per_story = sizes.groupBy("story_id").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_groups"),
        F.max_by("session_no", F.struct("n", (-F.col("session_no")).alias("first"))).alias("keep_no"),
    )
    split = per_story.filter((F.col("n_groups") > 1) & (F.col("total") >= min_articles))
    kept = F.col("session_no") == F.col("keep_no")
    return sizes.join(split, "story_id").select(
        "story_id", "session_no", "n", kept.alias("kept"),
        F.when(kept, F.col("story_id")).otherwise(story_key(F.col("story_id"), F.col("session_no"))).alias("new_story_id"),
    )


def prune_by_theme(stories: DataFrame, theme: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stories of a theme and their rows removed from all child tables.

    Every child table refers to its story in ``story_id``.
    """
    doomed = stories.filter(F.col("primary_theme") == theme).select(F.col("id").alias("story_id"))
    kept = {name: df.join(doomed, "story_id", "left_anti") for name, df in children.items()}
    return {"stories": stories.filter(~F.col("primary_theme").eqNullSafe(F.lit(theme))), **kept}


_ASSIGNMENT = "article_id bigint, story_id bigint, action string, relevance_score double, related_story_id bigint"
_STATE = "id bigint, total array<double>, n bigint, entity_set array<string>, last_seen_at timestamp, importance_score int"


def _record(spark: SparkSession, path: str) -> str | None:
    """The settings a finished pass has left, if it has."""
    try:
        row = spark.read.schema("settings string").parquet(path).first()
    except AnalysisException:
        return None
    return row and row["settings"]


def rebuild_all(
    articles: DataFrame, enrichments: DataFrame, embeddings: DataFrame, adjudicate: Adjudicator, as_of: Column, batch_days: int = 1,
    replay: bool = True, rows: int = sim.NEAR_ROWS, folder: str | None = None,
) -> DataFrame:
    """All assignments from scratch, one pass per ``batch_days`` of publication dates.

    Articles without a publication date come last, by the day they were scraped, which is
    also their event date. Stories are carried from pass to pass as a table with the sums of
    their vectors; a pass adds its own articles to it, stories too old to be revived leave
    it, and the assignments of every pass are a table of their own. Work is thus linear in
    the passes, and a lost executor never replays earlier ones. With ``replay`` a pass runs
    as of the end of its own days; otherwise every pass uses ``as_of``, as the reference
    does, and stories older than the event window can only be revived.

    ``folder`` (by default a new one below the shared folder) keeps a ledger: a pass leaves its
    assignments, the stories after it and, last of all, a record. A run on a folder with
    records goes on after the last one; a pass that was broken off is done again. Records of
    other articles or settings are an error.
    """
    spark = articles.sparkSession
    root = folder or f"{shared_dir(spark)}/rebuild-{uuid.uuid4().hex}"
    waiting = unassigned(enrichments, embeddings, spark.createDataFrame([], "article_id bigint"), articles)
    event = F.coalesce("published_at", "scraped_at")
    work = cut_lineage(waiting.withColumns({"_undated": F.col("published_at").isNull(), "_day": F.to_date(event)}))
    days = [(r["_undated"], r["_day"]) for r in work.select("_undated", "_day").distinct().collect()]  # one row per calendar day
    passes = sorted({(undated, (day.toordinal() if day else 0) // batch_days) for undated, day in days})
    stories = spark.createDataFrame([], _STATE)
    done = [spark.createDataFrame([], _ASSIGNMENT)]
    facts = work.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("article_id", "embedding", "entity_set", "_day")).alias("h")).first()
    settings = f"{facts['n']}/{facts['h']}/{batch_days}/{replay}"
    for number, (undated, span) in enumerate(passes):
        place = f"{root}/pass-{number}"
        record = _record(spark, f"{place}/record")
        if record is not None:
            if record != settings:
                raise ValueError(f"{root} holds a rebuild of other articles or settings")
            stories = spark.read.schema(_STATE).parquet(f"{place}/stories")
            done.append(spark.read.schema(_ASSIGNMENT).parquet(f"{place}/assigned"))
            continue
        ordinal = F.coalesce(F.datediff("_day", F.lit("0001-01-01").cast("date")) + 1, F.lit(0))
        batch = work.filter((F.col("_undated") == undated) & (F.floor(ordinal / batch_days) == span)).drop("_undated", "_day")
        end = F.date_add(F.lit("0001-01-01").cast("date"), (span + 1) * batch_days - 1).cast("timestamp")
        newest = F.least(as_of, end) if replay and not undated else as_of
        known = stories.select("id", F.transform("total", lambda x: x / F.col("n")).alias("centroid"), "entity_set", "last_seen_at", "importance_score", F.lit("active").alias("status"))
        made = assign_batch(batch, known, adjudicate, newest, rows).select("article_id", "story_id", "action", "relevance_score", "related_story_id")
        made.write.mode("overwrite").parquet(f"{place}/assigned")
        assigned = spark.read.schema(_ASSIGNMENT).parquet(f"{place}/assigned")
        grown_stories(stories, assigned, work, newest if replay and not undated else None).write.mode("overwrite").parquet(f"{place}/stories")
        stories = spark.read.schema(_STATE).parquet(f"{place}/stories")
        spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{place}/record")
        done.append(assigned)
    return reduce(DataFrame.unionByName, done)


def grown_stories(stories: DataFrame, assigned: DataFrame, work: DataFrame, as_of: Column | None) -> DataFrame:
    """The table of stories after a pass: new members' vectors, names, dates and importance added.

    With ``as_of`` the stories that no later article can revive are left out.
    """
    members = assigned.select("story_id", "article_id").join(work, "article_id")
    sums = members.groupBy(F.col("story_id").alias("_id")).agg(
        Summarizer.sum(array_to_vector(F.col("embedding").cast("array<double>"))).alias("_sum"), F.count(F.lit(1)).alias("_n"),
        F.max(F.coalesce("published_at", "scraped_at")).alias("_last"), F.max("importance_score").alias("_importance"),
    )
    names = set_union(members.select(F.col("story_id").alias("_id"), F.col("entity_set").alias("_names")), "_id", "_names")
    none = F.array().cast("array<string>")
    both = stories.join(sums.withColumn("_sum", vector_to_array("_sum")).join(names, "_id", "left"), F.col("id") == F.col("_id"), "full_outer")
    merged = both.select(
        F.coalesce("id", "_id").alias("id"),
        F.when(F.col("total").isNull(), F.col("_sum")).when(F.col("_sum").isNull(), F.col("total")).otherwise(F.zip_with("total", "_sum", lambda x, y: x + y)).alias("total"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
        F.array_sort(F.array_union(F.coalesce("entity_set", none), F.coalesce("_names", none))).alias("entity_set"),
        F.greatest("last_seen_at", "_last").alias("last_seen_at"), F.greatest("importance_score", "_importance").alias("importance_score"),
    )
    return merged if as_of is None else merged.filter(F.col("last_seen_at") >= hours_before(as_of, 24 * (REVIVAL_LOOKBACK_DAYS + 1)))


# --- reading ---------------------------------------------------------------------------


def story_card(stories: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """C17: a feed card per story: counts, outlets by relevance and picture."""
    full = articles.filter("has_full_content").select(F.col("id").alias("article_id"), "source_id")
    outlets = first_seen(links.join(full, "article_id"), ["story_id"], "source_id", [F.desc("relevance_score"), F.asc("article_id")])
    named = outlets.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    entry = F.struct((-F.col("relevance_score")).alias("r"), "article_id", F.col("source_id").alias("id"), "name")
    listed = named.groupBy("story_id").agg(F.array_sort(F.collect_list(entry)).alias("_s"))  # one entry per outlet
    counts = story_counts(links, articles, full_content_only=True)
    return (
        stories.withColumnRenamed("id", "story_id").join(counts, "story_id", "left").join(listed, "story_id", "left")
        .join(card_image(links, articles), "story_id", "left")
        .select(
            "story_id", "title", "slug", "status", "importance_score", "first_seen_at", "last_seen_at", "short_summary", "overview",
            "primary_theme", tx.theme_label(F.col("primary_theme")).alias("theme_display"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("article_count", "source_count")],
            F.transform(F.coalesce("_s", F.array().cast(listed.schema["_s"].dataType)), lambda s: s["name"]).alias("sources"), "card_image_url", "version",
        )
    )


def story_articles(links: DataFrame, articles: DataFrame, enrichments: DataFrame, perspectives: DataFrame) -> DataFrame:
    """C17 detail: members in reading order with framing, one row each.

    A story may hold any number of articles, so they stay rows with a position instead
    of one nested list.
    """
    full = articles.filter("has_full_content").select(F.col("id").alias("article_id"), "title", "url", "published_at")
    notes = enrichments.select(
        "article_id", "importance_score", F.when(F.col("status") == "completed", F.col("summary")).alias("summary"),
        F.when(F.col("status") == "completed", F.slice("key_facts", 1, 2)).alias("key_facts"),
    )
    framing = perspectives.select("story_id", "article_id", "sentiment_score", "notable_emphasis")
    rows = links.join(full, "article_id").join(notes, "article_id", "left").join(framing, ["story_id", "article_id"], "left")
    order = [F.desc("relevance_score"), F.desc_nulls_first("importance_score"), F.desc("published_at"), F.asc("article_id")]
    # Many members share one relevance; nulls must sort in cells as they do in rows.
    level = F.coalesce(F.col("importance_score").cast("double"), F.lit(float("inf")))
    day = F.coalesce(F.to_date("published_at"), F.lit("0001-01-01").cast("date"))
    celled = rows.withColumns({"_level": level, "_day": day})
    return rank_all(celled, ["story_id"], [("relevance_score", True), ("_level", True), ("_day", True)], order, rank="position").drop("_level", "_day")


def story_versions(versions: DataFrame, limit: int = 10) -> DataFrame:
    """C17 detail: the newest versions."""
    return top_n(versions, ["story_id"], [F.desc("version")], limit)


def related_stories(stories: DataFrame, relations: DataFrame) -> DataFrame:
    """Stories linked in either direction."""
    facts = stories.select("id", "slug", "title", "last_seen_at")
    out = relations.select(F.col("from_story_id").alias("story_id"), F.col("to_story_id").alias("id"), "relation_type", F.lit("earlier").alias("direction"))
    back = relations.select(F.col("to_story_id").alias("story_id"), F.col("from_story_id").alias("id"), "relation_type", F.lit("later").alias("direction"))
    return out.unionByName(back).join(facts, "id")


def eli5_stale(stories: DataFrame) -> DataFrame:
    """Stories whose plain explanation is missing or older than the text."""
    return stories.filter(F.col("eli5_version").isNull() | (F.col("eli5_version") < F.col("version")))
