"""Model replies, dedupe, ranking, verdicts and comments."""

from __future__ import annotations

import json

from revlens.operators import merge
from revlens.operators.respond import decode_replies, reply_findings

A = {"severity": "HIGH", "category": "xss", "file": "a.py", "line": 3, "message": "m", "suggestion": "s"}
B = {"severity": "warning", "line": "7"}
BAD = {"severity": None, "line": "abc"}


def replies(spark, rows):
    return spark.createDataFrame(
        [(f"r{i}", agent, 0, text, 10, 5, err) for i, (agent, text, err) in enumerate(rows)],
        "review_id string, agent string, chunk_index long, text string, tokens_in long, tokens_out long, error string",
    )


def test_reply_shapes(spark):
    rows = [
        ("security", json.dumps({"findings": [A, B]}), None),  # bare
        ("security", json.dumps({"findings": []}), None),  # empty
        ("security", "Here:\n```json\n" + json.dumps({"findings": [A]}) + "\n```\nbye", None),  # fenced
        ("security", "no json here", None),  # not JSON
        ("security", None, "ThrottlingException"),  # model error
        ("security", json.dumps({"findings": None}), None),  # null findings
        ("security", json.dumps({"findings": [A, BAD, B]}), None),  # bad element: security drops chunk
        ("style", json.dumps({"findings": [A, BAD, B]}), None),  # others keep prefix
        ("style", json.dumps({"findings": [A]}) + " trailing words", None),  # text after JSON
        ("style", json.dumps({"findings": [{"line": None}]}), None),  # null line
        ("test", json.dumps({}), None),  # no findings key
    ]
    d = {r.review_id: r for r in decode_replies(replies(spark, rows)).collect()}
    out = [(d[f"r{i}"].outcome, len(d[f"r{i}"].findings), d[f"r{i}"].tokens_in_counted) for i in range(len(rows))]
    assert out == [
        ("ok", 2, 10), ("ok", 0, 10), ("ok", 1, 10), ("bad_json", 0, 10), ("model_error", 0, 0),
        ("invalid", 0, 0), ("invalid", 0, 0), ("invalid", 1, 10), ("bad_json", 0, 10), ("invalid", 0, 10), ("ok", 0, 10),
    ]
    f = {(r.review_id, r.pos): r for r in reply_findings(decode_replies(replies(spark, rows))).collect()}
    a = f[("r0", 0)]
    assert (a.severity, a.category, a.file, a.line) == ("info", "xss", "a.py", 3)  # unknown severity -> info
    b = f[("r0", 1)]
    assert (b.severity, b.category, b.file, b.line, b.message) == ("warning", "other", "unknown", 7, "")
    assert f[("r7", 0)].category == "xss"


def findings_df(spark, rows):
    return spark.createDataFrame(
        rows, "review_id string, agent string, sk string, severity string, category string, file string, line long, "
        "message string, suggestion string",
    )


def test_security_dedupe_regex_first(spark):
    rows = [
        ("r", "a.py", 3, "hardcoded_secret", 0, -1, 3, "warning"),
        ("r", "a.py", 3, "hardcoded_secret", 1, 0, 0, "critical"),
        ("r", "a.py", 3, "xss", 1, 0, 1, "info"),
    ]
    df = spark.createDataFrame(rows, "review_id string, file string, line long, category string, source_rank int, chunk_index long, ordinal long, severity string")
    got = merge.security_dedupe(df).collect()
    assert sorted((r.category, r.source_rank) for r in got) == [("hardcoded_secret", 0), ("xss", 1)]


def test_cross_reviewer_rules(spark):
    rows = [
        ("r", "style", "FINDING#style#0", "warning", "c", "a.py", 1, "m", "s"),
        ("r", "test", "FINDING#test#0", "critical", "c", "a.py", 1, "m", "s"),  # displaces the warning
        ("r", "perf", "FINDING#perf#0", "info", "c", "b.py", 2, "m", "s"),
        ("r", "style", "FINDING#style#1", "warning", "c", "b.py", 2, "m", "s"),  # does not displace info
        ("r", "perf", "FINDING#perf#10", "CRITICAL", "c", "c.py", 0, "m", "s"),  # '#10' sorts before '#2'
        ("r", "perf", "FINDING#perf#2", "critical", "c", "c.py", 0, "m", "s"),  # exact 'critical' displaces
    ]
    got = {(r.file, r.line): r.sk for r in merge.cross_reviewer_dedupe(findings_df(spark, rows)).collect()}
    assert got == {("a.py", 1): "FINDING#test#0", ("b.py", 2): "FINDING#perf#0", ("c.py", 0): "FINDING#perf#2"}


def test_finding_keys_string_order(spark):
    rows = [("r", "style", i) for i in range(12)]
    df = spark.createDataFrame(rows, "review_id string, agent string, ordinal long")
    keys = [r.sk for r in merge.assign_finding_keys(df, ["ordinal"]).orderBy("ordinal").collect()]
    assert keys == [f"FINDING#style#{i}" for i in range(12)]
    assert sorted(keys)[2] == "FINDING#style#10"


def test_three_verdicts_and_comment(spark):
    reviews = spark.createDataFrame([("crit",), ("warn",), ("clean",)], "review_id string")
    rows = [
        ("crit", "security", "FINDING#security#0", "critical", "sql_injection", "a.py", 4, "Injection", "Bind it"),
        ("crit", "style", "FINDING#style#0", "urgent", "naming", "b.py", 0, "Odd", ""),
        ("warn", "style", "FINDING#style#0", "warning", "n-plus-one", "c.py", 0, "Loop", "Batch"),
    ]
    ranked = merge.rank_findings(merge.cross_reviewer_dedupe(findings_df(spark, rows)))
    v = {r.review_id: r.verdict for r in merge.verdicts(reviews, ranked).collect()}
    assert v == {"crit": "request_changes", "warn": "comment", "clean": "approve"}
    st = {r.review_id: (r.state, r.description) for r in merge.commit_status(merge.verdicts(reviews, ranked)).collect()}
    assert st["crit"] == ("failure", "Found 1 critical issues")
    assert st["clean"] == ("success", "Review complete: no critical issues")
    comments = {r.review_id: r.comment for r in merge.review_comments(merge.verdicts(reviews, ranked), merge.rendered_findings(ranked), brand="Bot").collect()}
    crit = comments["crit"]
    assert crit.startswith("## Bot Code Review\n\n❌ **Changes Requested.**")
    assert "#### 🚨 [Sql_injection] a.py (Line 4)\nInjection\n\n**Recommendation:**\n> Bind it\n" in crit
    # unknown severity: info bucket, one-line fallback with the raw category
    assert "<summary>Click to view minor suggestions</summary>\n\n- **naming**: Odd\n</details>\n" in crit
    assert "*No warnings found.*" in crit
    assert comments["warn"].count("<summary><b>[N-Plus-One]</b> c.py</summary>") == 1
    assert comments["clean"].endswith("*Bot analyzed 1 files (0 additions) in 0ms.*")


def py_cross_dedupe(items):
    """Sequential model: walk findings in sk order; first per (file, line)
    wins unless a later exact 'critical' displaces a non-critical winner (the
    displacer moves to the end of the list)."""
    unique, seen = [], set()
    for f in items:
        key = (f["file"], f["line"])
        if key not in seen:
            seen.add(key)
            unique.append(f)
            continue
        for existing in unique:
            if (existing["file"], existing["line"]) == key:
                if existing["severity"] != "critical" and f["severity"] == "critical":
                    unique.remove(existing)
                    unique.append(f)
                break
    return unique


def test_cross_reviewer_dedupe_random_parity(spark):
    import random

    rnd = random.Random(17)
    rows = []
    for r in range(40):
        for a in ("security", "performance", "style", "test"):
            for i in range(rnd.randint(0, 14)):
                rows.append((f"r{r}", a, f"FINDING#{a}#{i}", rnd.choice(["critical", "CRITICAL", "warning", "info", "x"]),
                             "c", rnd.choice(["a.py", "b.py"]), rnd.randint(0, 3), "m", "s"))
    got = merge.cross_reviewer_dedupe(findings_df(spark, rows)).collect()
    by_review = {}
    for g in got:
        by_review.setdefault(g.review_id, []).append(g.sk)
    for r in {row[0] for row in rows}:
        items = sorted(
            ({"sk": x[2], "severity": x[3], "file": x[5], "line": x[6]} for x in rows if x[0] == r), key=lambda d: d["sk"]
        )
        want = [d["sk"] for d in py_cross_dedupe(items)]
        assert sorted(by_review.get(r, []), key=lambda s: s) == sorted(want)
        # the model's output order is the winners' sk order, which is what
        # ranking and rendering sort by
        assert want == sorted(want)
