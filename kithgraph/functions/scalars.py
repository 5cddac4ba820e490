"""Scalar formulas as Column functions, and as SQL functions that the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kithgraph.schemas import CONSENSUS_MU, DECAY, EPOCH, FATIGUE_FLOOR, FATIGUE_TAU, FATIGUE_WINDOW, IMPRESSION_COUNT, PROOF_ALPHA, PROOF_LAMBDA, PROOF_PLATEAU, RELATIVE_MAX, SHRINK_BETA, SIGNALS, TOPICS, VERBS


def choose(value: Column, table: dict, default: Column | None = None) -> Column:
    """CASE over a dictionary of literals."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default) if default is not None else out


def weight(signal: Column) -> Column:
    return choose(signal, {1: 1.0, 2: 2.0, 3: 3.0})


def signal_of(code: Column) -> Column:
    """Low three bits as a signal; null for others."""
    bits = code.bitwiseAND(F.lit(7))
    return F.when(bits.between(1, 3), bits)


def signal_name(signal: Column) -> Column:
    return choose(signal, SIGNALS)


def verb(signal: Column) -> Column:
    return choose(signal, VERBS)


def clamp_ts(ts: Column) -> Column:
    return F.lit(EPOCH) + F.least(F.greatest(ts - EPOCH, F.lit(0)), F.lit(RELATIVE_MAX))


def pack_edge(target: Column, signal: Column, ts: Column) -> Column:
    """target in the high 32 bits; 29 bits of clamped relative seconds and 3 of signal in the low ones."""
    low = F.shiftleft(clamp_ts(ts) - EPOCH, 3).bitwiseOR(signal.cast("long"))
    return F.shiftleft(target.cast("long"), 32).bitwiseOR(low)


def unpack_edge(packed: Column) -> Column:
    low = packed.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.struct(F.shiftrightunsigned(packed, 32).alias("target"), F.coalesce(signal_of(low), F.lit(1).cast("long")).cast("int").alias("signal"), (F.shiftright(low, 3) + EPOCH).alias("ts"))


def decay(signal: Column, ts: Column, now: Column, tau: float = DECAY) -> Column:
    """weight * e^(-age / tau); future events have age 0, and a tau that isn't positive is the default."""
    tau = tau if tau > 0 else DECAY
    return weight(signal) * F.exp(-F.greatest(now - ts, F.lit(0)).cast("double") / F.lit(float(tau)))


def social_proof(n: Column) -> Column:
    n = n.cast("double")
    rise = 1 + PROOF_ALPHA * F.log1p(F.least(n, F.lit(float(PROOF_PLATEAU))))
    fall = 1 + PROOF_LAMBDA * F.log1p(F.greatest(F.lit(0.0), n - PROOF_PLATEAU) / PROOF_PLATEAU)
    return (n + 1) / (n + 3) * rise / fall


popularity = social_proof


def consensus(k: Column) -> Column:
    return F.when(k <= 1, 1.0).otherwise(1 + CONSENSUS_MU * F.ln(F.greatest(k, F.lit(1)).cast("double")))


def shrinkage(shared: Column, beta: float = SHRINK_BETA) -> Column:
    beta = beta if beta > 0 else SHRINK_BETA
    return F.when(shared <= 0, 0.0).otherwise(shared / (shared + F.lit(beta)))


def cosine(shared: Column, a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), shared / F.sqrt((a * b).cast("double"))).otherwise(0.0)


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(0.0)


def confidence(shared: Column, a: Column, b: Column, beta: float = SHRINK_BETA) -> Column:
    return cosine(shared, a, b) * shrinkage(shared, beta)


def fatigue(age: Column) -> Column:
    """Score multiplier `age` seconds after a post was served; 1 for unseen posts (null)."""
    # greatest() skips nulls, so unseen posts are told apart by the age itself.
    curve = FATIGUE_FLOOR + (1 - FATIGUE_FLOOR) * (1 - F.exp(-F.greatest(age, F.lit(0)) / FATIGUE_TAU))
    return F.when(age.isNull() | (age >= FATIGUE_WINDOW), 1.0).otherwise(curve)


def compounded_fatigue(age: Column, count: Column) -> Column:
    times = F.least(F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)), F.lit(IMPRESSION_COUNT))
    return F.pow(fatigue(age), times)


def is_reply(parent: Column) -> Column:
    return parent.isNotNull()


def is_root(root: Column, parent: Column) -> Column:
    return root.isNull() & parent.isNull()


def topic_weight(topic: Column, weights: dict[str, float]) -> Column:
    """General and unknown topics weigh 1."""
    return choose(topic, {t: float(weights.get(t, 1.0)) for t in TOPICS[:5]}, F.lit(1.0))


def topic_bucket(topic: Column) -> Column:
    """Interleaving bucket; general shares the first."""
    return choose(topic, {t: k % 5 for k, t in enumerate(TOPICS)}, F.lit(0))


#: Other names of topics.
ALIASES = {
    "art": "art arts illustration photography design",
    "tech": "tech technology software programming code ai",
    "science": "science physics astronomy biology space",
    "news": "news press journalism breaking worldnews",
    "culture": "culture books music film movies history philosophy",
    "general": "general misc other",
}


def topic_named(name: Column) -> Column:
    return choose(F.lower(F.trim(name)), {alias: t for t, names in ALIASES.items() for alias in names.split()})


def topic_code(topic: Column) -> Column:
    """Number of a topic, null for other names."""
    return choose(topic, {t: k for k, t in enumerate(TOPICS)})


def topic_of_code(code: Column) -> Column:
    return choose(code, dict(enumerate(TOPICS)))


def topic_flag(topic: Column) -> Column:
    """Bits 1 to 3 of a metadata byte: the topic's number plus one, 0 without a topic."""
    return F.shiftleft(F.coalesce(topic_code(topic) + 1, F.lit(0)), 1)


def topic_of_flag(flags: Column) -> Column:
    return topic_of_code(F.shiftright(flags, 1).bitwiseAND(F.lit(7)) - 1)


def bytes_text(n: Column) -> Column:
    d = n.cast("double")
    scaled = lambda unit, digits, name: F.concat(F.format_string(f"%.{digits}f", d / float(unit)), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, 1, "KB")).when(n < 1 << 30, scaled(1 << 20, 1, "MB")).otherwise(scaled(1 << 30, 2, "GB"))


def identifier(text: Column) -> Column:
    """Trimmed, without leading @."""
    return F.regexp_replace(F.trim(text), "^@+", "")


#: What precedes a handle in a pasted link, and the domain of a bare name.
PREFIXES, DOMAIN = ("at://", "https://bsky.app/profile/", "http://bsky.app/profile/"), "bsky.social"
#: Bare names that are no handles.
RESERVED = ("localhost", "local", "invalid", "test", "example", "internal", "intranet", "corp", "lan", "home", "arpa")


def handle(text: Column) -> Column:
    """A handle or did from what a user typed or pasted: in lower case, and a bare name with DOMAIN."""
    trimmed = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    raw = trimmed(text)
    link = F.regexp_extract(raw, "^https?://bsky\\.app/profile/([^/?#]*)", 1)
    rest = F.when(raw.startswith(PREFIXES[0]), F.substring(raw, F.lit(len(PREFIXES[0]) + 1), F.length(raw))).when(raw.startswith(PREFIXES[1]) | raw.startswith(PREFIXES[2]), link).otherwise(raw)
    clean = trimmed(F.regexp_replace(F.regexp_replace(trimmed(rest), "^@+", ""), "/+$", ""))
    lower = F.translate(clean, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = lower.rlike("^[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?$") & ~lower.rlike("^[0-9]+$") & ~lower.isin(*RESERVED)
    return F.when(clean.startswith("did:"), clean).when(bare, F.concat(lower, F.lit(f".{DOMAIN}"))).otherwise(lower)


def rfc3339(ts: Column) -> Column:
    """Seconds since 1970 as a time in UTC, whatever the session's zone."""
    return F.date_format(F.timestamp_add("SECOND", ts, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: name(arguments) -> expression, for register().
SQL_FUNCTIONS = {
    "kg_signal_weight(signal INT)": "DOUBLE RETURN CAST(signal AS DOUBLE)",
    "kg_decay(signal INT, ts BIGINT, now BIGINT, tau DOUBLE)": f"DOUBLE RETURN signal * exp(-greatest(now - ts, 0) / CASE WHEN tau > 0 THEN tau ELSE {DECAY}D END)",
    "kg_social_proof(n BIGINT)": f"DOUBLE RETURN (n + 1D) / (n + 3D) * (1 + {PROOF_ALPHA}D * log1p(least(n, {PROOF_PLATEAU}))) / (1 + {PROOF_LAMBDA}D * log1p(greatest(0, n - {PROOF_PLATEAU}) / {PROOF_PLATEAU}D))",
    "kg_consensus(k BIGINT)": f"DOUBLE RETURN CASE WHEN k <= 1 THEN 1D ELSE 1 + {CONSENSUS_MU}D * ln(k) END",
    "kg_shrinkage(shared BIGINT)": f"DOUBLE RETURN CASE WHEN shared <= 0 THEN 0D ELSE shared / (shared + {SHRINK_BETA}D) END",
    "kg_fatigue(age BIGINT)": f"DOUBLE RETURN CASE WHEN age IS NULL OR age >= {FATIGUE_WINDOW} THEN 1D ELSE {FATIGUE_FLOOR}D + {1 - FATIGUE_FLOOR}D * (1 - exp(-greatest(age, 0) / {FATIGUE_TAU}D)) END",
}


def register(spark: SparkSession) -> None:
    """Makes the formulas temporary SQL functions."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")
