"""Request dials: parsing, precedence, validation, fingerprints and page sessions."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.schemas import TOPICS

HOUR = 3600.0
#: Names of presets.
FRESHNESS = {"realtime": 2, "fast": 2, "2h": 2, "1h": 1, "4h": 4, "6h": 6, "8h": 8, "balanced": 12, "12h": 12, "24h": 24, "deep_dive": 48, "deepdive": 48, "48h": 48, "weekly": 72, "slow": 72, "72h": 72, "168h": 168}
DISCOVERY = {"familiar": 0.05, "low": 0.05, "5%": 0.05, "balanced": 0.15, "med": 0.15, "15%": 0.15, "deep_dive": 0.35, "deepdive": 0.35, "high": 0.35, "35%": 0.35}
FLOORS = {"emerging": 1, "emerge": 1, "1": 1, "1+": 1, "balanced": 3, "default": 3, "3": 3, "3+": 3, "curated": 10, "high": 10, "10": 10, "10+": 10, "all": 0, "none": 0, "off": 0, "0": 0, "0+": 0}
DEFAULT_TAU, DEFAULT_EXPLORE, DEFAULT_FLOOR, DEFAULT_LIMIT, MAX_LIMIT, MAX_FLOOR, MAX_WEIGHT = 12 * HOUR, 0.15, 3, 30, 100, 100, 5.0


@dataclass(frozen=True)
class Dials:
    tau: float = DEFAULT_TAU
    explore: float = DEFAULT_EXPLORE
    weights: dict[str, float] = field(default_factory=lambda: {t: 1.0 for t in TOPICS[:5]})
    explain: bool = False
    include_replies: bool = False
    no_nsfw: bool = False
    min_likes: int = DEFAULT_FLOOR
    limit: int = DEFAULT_LIMIT
    cursor: str | None = None

    def fingerprint(self) -> str:
        """Equal for dials that rank alike: cursor and limit don't count."""
        own = asdict(self)
        del own["cursor"], own["limit"]
        return hashlib.sha256(repr(sorted(own.items())).encode()).hexdigest()


def _number(text: str, default: float, low: float, high: float) -> float:
    try:
        value = float(text)
    except ValueError:
        value = default
    return value if math.isnan(value) else min(max(value, low), high)


def parse_freshness(text: str | None, default: float = DEFAULT_TAU) -> float:
    """Seconds; a bare number is seconds, clamped to an hour and a week."""
    if text is None:
        return default
    name = text.strip().lower()
    return FRESHNESS[name] * HOUR if name in FRESHNESS else _number(name, default, HOUR, 168 * HOUR)


def parse_discovery(text: str | None, default: float = DEFAULT_EXPLORE, most: float = 1.0, normalise: bool = True) -> float:
    if text is None:
        return default
    name = text.strip().lower() if normalise else text
    return DISCOVERY[name] if name in DISCOVERY else _number(name, default, 0.0, most)


def parse_floor(text: str | None) -> int:
    if text is None:
        return DEFAULT_FLOOR
    name = text.strip().lower()
    if name in FLOORS:
        return FLOORS[name]
    digits = name.rstrip("+")
    return min(int(digits), MAX_FLOOR) if digits.isascii() and digits.isdigit() and int(digits) < 1 << 32 else DEFAULT_FLOOR


def parse_flag(text: str | None, yes: tuple[str, ...] = ("true", "all", "include", "1"), no: tuple[str, ...] = ("false", "root_only", "root", "0")) -> bool | None:
    return True if text in yes else False if text in no else None


def clamp_weight(x: float) -> float:
    return min(max(x, 0.0), MAX_WEIGHT)


def from_query(query: dict) -> Dials:
    """Dials of a preview request, without saved ones."""
    replies = query.get("replies") in ("true", "all", "include", "1") or query.get("include_replies") is True
    safe = bool(query.get("no_nsfw")) or (query.get("safe_mode") or "").strip().lower() in ("1", "true", "on", "yes")
    floor = min(max(query["min_likes"], 0), MAX_FLOOR) if query.get("min_likes") is not None else parse_floor(query.get("engagement_floor"))
    weights = {t: clamp_weight(1.0 if query.get(t) is None else query[t]) for t in TOPICS[:5]}
    limit = min(max(DEFAULT_LIMIT if query.get("limit") is None else query["limit"], 1), MAX_LIMIT)
    return Dials(parse_freshness(query.get("freshness")), parse_discovery(query.get("discovery")), weights, bool(query.get("explain")), replies, safe, floor, limit, query.get("cursor"))


def resolve(query: dict, saved: Dials | None = None) -> Dials:
    """Dials of a feed request: query, else saved, else default, field by field."""
    base = saved or Dials()
    replies = parse_flag(query.get("replies"))
    if replies is not True and query.get("include_replies") is True:
        replies = True
    if replies is None:
        replies = query.get("include_replies")
    safe = query.get("no_nsfw")
    if safe is None:
        safe = parse_flag(query.get("safe_mode"), ("1", "true", "on", "yes"), ("0", "false", "off", "no"))
    return replace(
        base,
        tau=parse_freshness(query.get("freshness"), base.tau),
        explore=parse_discovery(query.get("discovery"), base.explore, 0.5, normalise=False),
        weights={t: clamp_weight(base.weights[t] if query.get(t) is None else query[t]) for t in TOPICS[:5]},
        explain=bool(query.get("explain")),
        include_replies=base.include_replies if replies is None else replies,
        no_nsfw=base.no_nsfw if safe is None else safe,
        min_likes=base.min_likes if query.get("min_likes") is None else parse_floor(query["min_likes"]),
        limit=min(max(DEFAULT_LIMIT if query.get("limit") is None else query["limit"], 1), MAX_LIMIT),
        cursor=query.get("cursor"),
    )


def problem(d: Dials) -> str | None:
    """Why dials can't be saved, or None."""
    if not (math.isfinite(d.tau) and HOUR <= d.tau <= 168 * HOUR):
        return "freshness"
    if not (math.isfinite(d.explore) and 0 <= d.explore <= 0.5):
        return "discovery"
    for t in TOPICS[:5]:
        if not (math.isfinite(d.weights[t]) and 0 <= d.weights[t] <= MAX_WEIGHT):
            return t
    return None if 0 <= d.min_likes <= MAX_FLOOR else "min_likes"


def valid_row() -> Column:
    """The same rule as a predicate on a user_dials table."""
    ok = F.col("half_life_s").between(HOUR, 168 * HOUR) & F.col("explore").between(0, 0.5) & F.col("min_likes").between(0, MAX_FLOOR)
    for t in TOPICS[:5]:
        ok = ok & F.col(t).between(0, MAX_WEIGHT)
    return F.coalesce(ok, F.lit(False))


def to_row(user_id: int, d: Dials) -> dict:
    """A user_dials row; raises where the dials can't be saved."""
    if wrong := problem(d):
        raise ValueError(f"{wrong} is out of range")
    return {"user_id": user_id, "half_life_s": d.tau, "explore": d.explore, **{t: d.weights[t] for t in TOPICS[:5]}, "include_replies": d.include_replies, "no_nsfw": d.no_nsfw, "min_likes": d.min_likes}


def from_row(row: dict) -> Dials:
    return Dials(tau=row["half_life_s"], explore=row["explore"], weights={t: row[t] for t in TOPICS[:5]}, include_replies=row["include_replies"], no_nsfw=row["no_nsfw"], min_likes=row["min_likes"])


def saved_after(log: DataFrame) -> DataFrame:
    """user_dials after a log of rows with `deleted` and `seq`: each user's last change, if it isn't a
    deletion.  Rows that fail valid_row() never count.

    One map-side aggregate; a saved table joins the log as rows of seq -1.
    """
    fields = [c for c in log.columns if c not in ("user_id", "deleted", "seq")]
    last = log.where(F.col("deleted") | valid_row()).groupBy("user_id").agg(F.max(F.struct("seq", "deleted", *fields)).alias("x"))
    return last.where(~F.col("x.deleted")).select("user_id", *(F.col(f"x.{c}") for c in fields))


def precedence(requests: DataFrame, saved: DataFrame, key: str, fields: dict[str, object]) -> DataFrame:
    """Left join of requests to saved rows: request, else saved, else default, for every field."""
    s = saved.select(key, *(F.col(f).alias(f"__s_{f}") for f in fields))
    joined = requests.join(s, key, "left")
    return joined.select(key, *(F.coalesce(F.col(f), F.col(f"__s_{f}"), F.lit(d)).alias(f) for f, d in fields.items()))


class Sessions:
    """Rankings kept for paging: by viewer and dials, for ttl seconds, the oldest go first."""

    def __init__(self, ttl: int = 300, most: int = 128):
        self.ttl, self.most, self.held = ttl, most, OrderedDict()

    def put(self, viewer: object, dials: Dials, now: int, ranked: DataFrame) -> None:
        self.held[(viewer, dials.fingerprint())] = (now, ranked)
        self.held.move_to_end((viewer, dials.fingerprint()))
        while len(self.held) > self.most:
            self.held.popitem(last=False)

    def get(self, viewer: object, dials: Dials, now: int) -> DataFrame | None:
        at, ranked = self.held.get((viewer, dials.fingerprint()), (None, None))
        return ranked if at is not None and 0 <= now - at <= self.ttl else None
