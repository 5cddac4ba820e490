import random
import re

import numpy as np
import pytest

from kithgraph.llm import shingles


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i if i is not None else 10**9, least.get(top(k), 10**9))
    return sorted((i if i is not None else -1, len(s), least[top(k)] if i is not None else -1) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(3))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 90, 200]))]
        if rng.random() < 0.5:
            base[:0] = passage
        for _ in range(rng.choice([1, 1, 2, 8])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            out.append(rng.choice([" ", "\n", " \t"]).join(own) if rng.random() < 0.9 else " ".join(own).upper())
    out += ["", None, "  ", "a", "A", "a b c", "a\x1cb", "a b", "x " * 5000] + [" ".join(passage)] * 3
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + [(7, out[9]), (None, out[3]), (3, out[3])]


@pytest.mark.parametrize("seed,bucket,members,flag", [(1, 1024, 2048, 8), (2, 3, 4, 8), (3, 3, 4, 0), (4, 1024, 2048, 2), (5, 3, 4, 3)])
def test_against_brute_force(spark, monkeypatch, seed, bucket, members, flag):
    monkeypatch.setattr(shingles, "FLAG", flag)
    monkeypatch.setattr(shingles, "BUCKET", bucket)
    monkeypatch.setattr(shingles, "MEMBERS", members)
    monkeypatch.setattr(shingles, "FEW", 12 if bucket > 3 else 2)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, n int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in shingles.link_documents(df).collect())
    assert got == brute(rows)


def test_one_of_each(spark):
    t = " ".join(f"w{k}" for k in range(50))
    rows = [(3, t, "s"), (1, t, "s"), (1, t, "s"), (1, "another text under that id", "s"), (2, t + " more", "s"), (4, "other text", "s"), (5, "", "s"), (6, None, "s"), (None, t, "s"), (None, "its own text", "s"), (None, "its own text", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = shingles.one_of_each(df)
    want = [(1, t), (1, "another text under that id"), (4, "other text"), (5, ""), (6, None), (None, "its own text")]
    order = lambda r: (r[0] or 99, r[1] or "")
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == sorted(want, key=order)
    assert shingles.one_of_each(df.limit(0)).count() == 0


def test_rows_link_by_earlier_versions(spark):
    story = [f"w{k}" for k in range(60)]
    before = [(1, " ".join(story)), (2, " ".join(story[:-1])), (3, " ".join(f"v{k}" for k in range(60))), (4, "footer " + "same rest of it here"), (9, " ".join(story))]
    now = [(1, "w1"), (2, ""), (3, before[2][1]), (4, "same rest of it here"), (5, "same rest of it here")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(frame(now), also=frame(before)).collect()) == [1, 3, 4]


def test_common_shingles_are_not_candidates(spark, monkeypatch):
    """Texts that share half of their shingles with thousands: no group holds them once counts are exact."""
    monkeypatch.setattr(shingles, "FLAG", 0)
    groups = []
    resolved = shingles._resolved
    monkeypatch.setattr(shingles, "_resolved", lambda sets, link: groups.append(sets.count()) or resolved(sets, link))
    common = " ".join(f"c{k}" for k in range(33))
    rows = [(k, common + " " + " ".join(f"d{k}x{j}" for j in range(30))) for k in range(3000)] + [(5000, common + " " + " ".join(f"d7x{j}" for j in range(30)) + " end")]
    got = shingles.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.where("component_id <> doc_id").collect()) == [5000] and groups == [2]


def test_large_groups_are_dealt(spark, monkeypatch):
    """Chains of variants in one candidate group: no task holds many more than MEMBERS (dealt by hash), and no link is lost."""
    monkeypatch.setattr(shingles, "MEMBERS", 40)
    seen = spark.sparkContext.accumulator(0)
    edges = shingles._group_edges

    def watched(rows, link):
        most = rows.groupBy("grp", "block", "other").count().agg({"count": "max"}).first()[0] or 0
        seen.add(int(most > 60))
        return edges(rows, link)

    monkeypatch.setattr(shingles, "_group_edges", watched)
    rng = random.Random(9)
    rows = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(40)]
        for k in range(50):
            own = list(base)
            own[rng.randrange(40)] = f"e{family}x{k % 20}"
            rows.append((len(rows), " ".join(own)))
    sets = [(k, np.sort(np.array([hash(x) & ((1 << 62) - 1) for x in shingle_set(t)], np.uint64))) for k, t in rows]
    frame = spark.createDataFrame([(0, k, bytearray(own.tobytes())) for k, own in sets], "grp long, cls long, set binary")
    found = shingles.connected(shingles._resolved(frame, 70)).collect()
    got = {r.node: r.component for r in found}
    own = {k: set(s.tolist()) for k, s in sets}
    root = {k: k for k in own}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in range(a):
            if 170 * len(own[a] & own[b]) >= 70 * (len(own[a]) + len(own[b])):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert all(got.get(k, k) == top(k) for k in own) and seen.value == 0


def test_prefix_and_tree_lose_no_pair():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
    sets = [base]
    for k in range(120):
        drop = rng.integers(1, 60)
        own = np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])
        sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    tree = shingles.PointTree(np.frombuffer(b"".join(shingles.point(sets[o]) for o in order), np.uint8).reshape(-1, shingles.GROUPS), sizes[order])
    for k in range(1, len(order)):
        found = set(tree.search(k).tolist())
        for j in range(k):
            a, b = sets[order[k]], sets[order[j]]
            if shingles.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert j in found
                assert len(np.intersect1d(a[: shingles.prefix_size(len(a))], b[: shingles.prefix_size(len(b))]))


def test_sets_beyond_a_byte_per_group_are_compared():
    base = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2))
    sets = [base, base[1:], base[::2]]
    points = shingles._points([shingles.point(s) for s in sets])
    assert (points == 255).all() and shingles.exact_pairs(sets, points) == [(0, 1)]


def test_stage_links_at_five_words_and_four_fifths(spark, tmp_path):
    import corpus_pipeline

    own = [f"w{k}" for k in range(104)]
    edited = list(own)
    for k in (10, 50, 51):  # 0.802 on five words, 0.836 on four
        edited[k] = f"changed{k}"
    ends = ["x", *own[:18]]
    far = own[:18] + [f"v{k}" for k in range(3)]  # 14 of 18 of five words
    rows = [(1, own), (2, edited), (3, [f"u{k}" for k in range(30)]), (4, [f"u{k}" for k in range(36)]), (5, ends), (6, far)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")

    def brute_pairs(words, link):
        sets = {i: {tuple(t[k : k + words]) for k in range(len(t) - words + 1)} for i, t in rows}
        return {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= link * len(sets[a] | sets[b])}

    pairs = brute_pairs(5, 80)
    assert pairs != brute_pairs(4, 85)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, str(tmp_path)).collect())
    assert kept == [i for i, _ in rows if i not in {b for _, b in pairs}]


def test_texts_stay_where_they_lie_and_prefixes_move_once(spark, monkeypatch):
    plans, written = [], shingles.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(shingles, "written", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(6)
        got = shingles.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in got) == brute(rows)
    assert not any("hashpartitioning(doc_id" in p for p in plans)
    prefixes = [p for p in plans if "Window" in p and "hashpartitioning(shingle" in p]
    assert prefixes and all(p.count("Exchange") == 1 for p in prefixes[:1])


def test_marks_leave_out_no_id(spark, monkeypatch):
    ids = spark.range(-3000, 3000, 3).toDF("first")
    docs = spark.range(-3000, 3000).selectExpr("id as doc_id", "concat('w', id) as text")
    wanted = {shingles.digest(shingles.Hasher()(f"w{k}")) for k in range(-3000, 3000, 3)}
    for most in (1 << 29, 1 << 19):
        monkeypatch.setattr(shingles, "MOST_MARKS", most)
        found = {r["cls"] for r in shingles._sets(docs, ids, 4).collect()}
        assert wanted <= found and len(found) < 2 * len(wanted)


def test_reach_holds_every_link():
    rng = random.Random(7)
    for link in (80, 85):
        for _ in range(3000):
            whole = list(range(rng.randrange(1, 80)))
            rng.shuffle(whole)
            a, b = (sorted(x for x in whole if rng.random() < 0.96) for _ in range(2))
            common = set(a) & set(b)
            if common and 100 * len(common) >= link * len(set(a) | set(b)):
                i, j = a.index(min(common)), b.index(min(common))
                assert shingles.reach(len(a), link)[i] >= len(b) and shingles.reach(len(b), link)[j] >= len(a)
    assert shingles.reach(20).tolist() == [23, 21, 19, 17]
