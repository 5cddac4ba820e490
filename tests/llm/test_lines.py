import pytest

from kithgraph.llm import lines


def brute(rows, least):
    sites, texts = {}, {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(s)
                texts.setdefault(x.strip(" "), set()).add(t)
    wide = {x for x, own in sites.items() if len(own - {None}) >= least and len(texts[x]) >= least}
    out = []
    for i, t, s in rows:
        own = t.split("\n") if t is not None else []
        kept = [x for x in own if x.strip(" ") not in wide]
        out.append((i, None if t is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_against_brute_force(spark, most):
    common, rows = "Subscribe to our newsletter", []
    for k in range(40):
        rows.append((k, f"Some own text of page {k} that is longer than the rest\n{common} \n\nseen on {k % 4}", f"site{k % 9}"))
    rows += [(100 + k, "copied text\nall of it", f"site{k}") for k in range(12)]
    rows += [(200, "", "site1"), (201, None, "site1"), (202, common, None), (None, f"a text without an id\n{common}", "site2"), (3, rows[3][1], "site3"), (203, "x" * 100_000, "site1")]
    rows += [(204, "\n".join([common, *(f"line {k}" for k in range(20_000)), common]), "site1"), (205, f"{common}\n{common}\nown", "site2")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, n_lines string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.remove_boilerplate(df, most=most).collect()], key=key)
    assert got == sorted(brute(rows, 6), key=key)
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def test_sure_and_near_lines(spark):
    rows = [(k, "\n".join(f"line {n}" for n in range(1, 40) if k < n), f"site{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lines.wide_lines(df, 20).count()
    assert found == 20


def test_copied_texts_keep_their_lines_and_pages_lose_all_footers(spark):
    foot = [f"Footer line {k} that all of the sites show to their readers" for k in range(4)]
    rows = [(k, f"Page {k} holds own words {k} times\n" + "\n".join(foot), f"site{k}") for k in range(8)]
    rows += [(21, foot[2] + "\n" + foot[3] + "\na few own words", "site2"), (22, foot[1], "site3")]
    story = "\n".join(f"Sentence {k} of the story." for k in range(30))
    rows += [(30 + k, story, f"site{k}") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_boilerplate(df).collect()}
    assert got[21] == ("a few own words", 2) and got[22] == ("", 1) and all(got[k][1] == 4 for k in range(8))
    assert all(got[30 + k] == (story, 0) for k in range(9)) and len(got) == len(rows)
