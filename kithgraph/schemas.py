"""Constants and schemas of the interaction graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Bounds of edge timestamps, seconds.
EPOCH, RELATIVE_MAX = 1_672_531_200, (1 << 29) - 1
#: Decay and windows, seconds.
DECAY, VELOCITY_WINDOW, FATIGUE_WINDOW, FATIGUE_TAU, FATIGUE_FLOOR = 43_200.0, 21_600, 21_600, 7_200.0, 0.15
#: Social proof, consensus and shrinkage.
PROOF_ALPHA, PROOF_LAMBDA, PROOF_PLATEAU, CONSENSUS_MU, SHRINK_BETA = 0.15, 0.10, 500, 0.45, 3.0
#: Bounds of the walks.
SEEDS, POST_EDGES, SCANNED, KEPT, NEIGHBOUR_EDGES, SCORED, MIN_OVERLAP = 50, 500, 5_000, 100, 2_000, 10_000, 2
TIER1_POSTS, FOLLOW_BOOST, POOL, CEILING, PER_AUTHOR = 10, 1.5, 100, 0.95, 2
IMPRESSION_ENTRIES, IMPRESSION_COUNT = 1_000, 8
SIGNALS, VERBS = {1: "like", 2: "quote", 3: "repost"}, {1: "liked", 2: "quoted", 3: "reposted"}
TOPICS = ("art", "tech", "science", "news", "culture", "general")

EVENT_SCHEMA = "kind string, user string, post string, other string, signal int, ts long, root string, parent string, nsfw boolean, topic string, time_us long"


@dataclass
class Graph:
    """Canonical tables; edges are distinct by user, post and signal.  seq is the arrival order."""

    raw: DataFrame  # user_id, post_id, signal, ts, seq
    edges: DataFrame
    meta: DataFrame  # post_id, author_id, root_id, parent_id, created_at, is_nsfw
    topics: DataFrame  # post_id, topic
    users: DataFrame  # user_id of everyone that a feed is made for
    follows: DataFrame  # follower_id, followed_id, seq
    blocks: DataFrame  # blocker_id, blocked_id
    impressions: DataFrame  # viewer_id, post_id, served_at, seq
