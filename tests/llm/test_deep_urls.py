"""Paths of any depth grow whole templates."""

import random

from pyspark.sql import functions as F

from tessella.llm import urls


def test_deep_branches_are_judged_apart(spark):
    rows = [(i, f"http://site.org/a/b/c/d/e/f/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "key long, label int")
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert all(out[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(200))
    assert out[1]["template"] == "/a/b/c/d/e/f/bad/{n}" and out[2]["template"] == "/a/b/c/d/e/f/good/{n}"
    assert out[1]["purity"] < 0.1 < 0.9 < out[2]["purity"]


def test_only_parting_levels_are_grown(spark, monkeypatch):
    deep = "/".join(f"s{k}" for k in range(300))
    rows = [(1, f"http://a.org/x/{deep}"), (2, f"http://a.org/y/{deep}/"), (3, f"http://a.org/y/{deep}/"), (4, "http://a.org/"), (5, "http://a.org"), (6, "http://a.org/y")]
    passes, along = [], urls._along
    monkeypatch.setattr(urls, "_along", lambda rows: passes.append(1) or along(rows))
    pages = spark.createDataFrame(rows, "key long, url string").select("key", F.lit("a.org").alias("host"), urls.path_of(F.col("url")).alias("path"), F.lit(None).cast("int").alias("label"))
    got = {r["key"]: r["template"] for r in urls.grow(pages).collect()}
    assert got == {1: f"/*/{deep}", 2: f"/*/{deep}/", 3: f"/*/{deep}/", 4: "/*", 5: "", 6: "/*"} and len(passes) <= 3


def test_alike_branches_among_others_merge(spark):
    """Two bad branches among good ones are one group, and the good ones another."""
    kinds = ["a", "b", "c", "worse", "d", "bad", "e"]
    rows = [(i, f"http://site.org/{kinds[i % 7]}/{i}") for i in range(700)]
    labels = spark.createDataFrame([(i, int(kinds[i % 7] in ("worse", "bad"))) for i in range(700)], "key long, label int")
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    templates = {}
    for i, r in out.items():
        templates.setdefault(r["template"], set()).add(kinds[i % 7])
    assert sorted(map(sorted, templates.values())) == [["a", "b", "c", "d", "e"], ["bad", "worse"]]
    assert all((out[i]["verdict"] == "block") == (kinds[i % 7] in ("worse", "bad")) for i in out)


def brute_groups(branches):
    """Names by branch for {branch: (n, labelled, bad)}, in plain Python."""
    labelled, bad = sum(x[1] for x in branches.values()), sum(x[2] for x in branches.values())
    mean = bad / labelled if labelled else 0.0
    bins = {}
    for name, (_, k, b) in branches.items():
        bins.setdefault(int(urls.BINS * (b + urls.BRANCH_WEIGHT * mean) / (k + urls.BRANCH_WEIGHT)), []).append(name)
    groups, k, b = [], 0, 0
    for i in sorted(bins):
        x, y = (sum(branches[n][j] for n in bins[i]) for j in (1, 2))
        p = (b + y) / (k + x) if k + x else 0
        if not groups or not k or not x or abs(b / k - y / x) <= urls.SAME * (p * (1 - p) * (1 / k + 1 / x)) ** 0.5:
            groups = groups[:-1] + [(groups[-1] if groups else []) + bins[i]]
            k, b = k + x, b + y
        else:
            groups.append(list(bins[i]))
            k, b = x, y
    return {n: n if len(g) == 1 else "*" + (str(j) if j else "") for j, g in enumerate(groups) for n in g}


def test_a_level_equals_plain_python(spark):
    """One level of many hosts: shares, groups by one half of the labels, purity by the other."""
    draw, rows, want, chosen = random.Random(4), [], {}, {}
    for h in range(30):
        branches = {}
        for x in range(draw.randrange(2, 8)):
            k, share = draw.choice([0, 1, 5, 30, 120]), draw.choice([0.0, 0.1, 0.5, 0.9, 1.0])
            own = [(f"h{h}", f"/b{x}", (1 if draw.random() < share else 0) if j < k else None, draw.randrange(2)) for j in range(k + 3)]
            told = [r[2] for r in own if r[3] == 0 and r[2] is not None]
            branches[f"b{x}"] = (k + 3, len(told), sum(told))
            rows += own
        names = brute_groups(branches)
        want |= {(f"h{h}", f"/{n}"): "/" + names[n] for n in branches}
        chosen |= {(f"h{h}", "/" + n): n.startswith("*") and len(set(names.values())) > 1 for n in names.values()}
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, host string, path string, label int, fold int")
    grown = urls.grow(frame)
    got = {(r["host"], r["path"]): r["template"] for r in grown.collect()}
    assert got == want and len(set(want.values())) > 4
    used = [(*r[:2], r[2]) for r in rows if r[2] is not None and (r[3] == 1 or not chosen[r[0], want[r[:2]]])]
    total = sum(r[2] for r in used) / len(used)
    for r in urls.purity(grown).collect():
        on_host = [x[2] for x in used if x[0] == r["host"]]
        own = [x[2] for x in used if want[x[:2]] == r["template"] and x[0] == r["host"]]
        host = (sum(on_host) + urls.WEIGHT * total) / (len(on_host) + urls.WEIGHT)
        assert abs(r["purity"] - (1 - (sum(own) + urls.WEIGHT * host) / (len(own) + urls.WEIGHT))) < 2e-6


def test_labels_of_chance_block_nothing(spark):
    """Many branches of few labels, which say nothing about the branches: grouping them by those labels mustn't."""
    draw = random.Random(8)
    rows = [(f"h{i % 5}", f"/b{i // 5 % 120}", int(draw.random() < 0.3), draw.randrange(2)) for i in range(3000)]
    grown = urls.grow(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, host string, path string, label int, fold int"))
    templates = urls.purity(grown).collect()
    assert len(templates) > 5 and all(0.5 < r["purity"] < 0.9 for r in templates)
