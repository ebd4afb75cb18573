"""Chunk packing (incl. the tree path) and the secret scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators.chunk import assign_chunks, chunk_table, number_files
from revlens.operators.parse import file_changes
from revlens.operators.scan import secret_scan


def py_chunks(lines, max_lines=500):
    """Next-fit packing model: chunk index per file."""
    out, cur, idx, started = [], 0, -1, False
    for n in lines:
        if not started or (cur + n > max_lines):
            idx += 1
            cur = 0
            started = True
        cur += n
        out.append(idx)
    return out


def run_chunks(spark, reviews, **kw):
    rows = [(rid, i, n, 0) for rid, lines in reviews.items() for i, n in enumerate(lines)]
    df = spark.createDataFrame(rows, "review_id string, ordinal long, additions long, deletions long")
    got = assign_chunks(df, **kw).select("review_id", "ordinal", "chunk_index", "total_chunks").collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.review_id, r.ordinal)):
        res.setdefault(r.review_id, []).append((r.chunk_index, r.total_chunks))
    return res


def test_chunk_cases(spark):
    reviews = {"small": [10], "five": [10] * 5, "big": [200] * 5, "huge": [1000], "mixed": [100, 1000, 5, 600, 0, 500]}
    got = run_chunks(spark, reviews)
    assert got["small"] == [(0, 1)]
    assert got["five"] == [(0, 1)] * 5
    assert [c for c, _ in got["big"]] == [0, 0, 1, 1, 2] and {t for _, t in got["big"]} == {3}
    assert got["huge"] == [(0, 1)]
    assert [c for c, _ in got["mixed"]] == py_chunks(reviews["mixed"])


def test_chunk_empty(spark):
    df = spark.createDataFrame([], "review_id string, ordinal long, additions long, deletions long")
    assert assign_chunks(df).count() == 0


@pytest.mark.parametrize("block_files,fan_in", [(2048, 256), (3, 2), (1, 3)])
def test_chunk_random_parity(spark, block_files, fan_in):
    rnd = random.Random(block_files * 31 + fan_in)
    reviews = {f"r{i}": [rnd.choice([0, 1, 50, 120, 250, 499, 500, 501, 900]) for _ in range(rnd.randint(1, 40))] for i in range(25)}
    got = run_chunks(spark, reviews, block_files=block_files, fan_in=fan_in)
    for rid, lines in reviews.items():
        want = py_chunks(lines)
        assert [c for c, _ in got[rid]] == want, rid
        assert {t for _, t in got[rid]} == {max(want) + 1}


def test_chunk_table(spark):
    rows = [("r", i, n, 0) for i, n in enumerate([200] * 5)]
    df = spark.createDataFrame(rows, "review_id string, ordinal long, additions long, deletions long")
    t = sorted(chunk_table(assign_chunks(df)).collect(), key=lambda r: r.chunk_index)
    assert [(r.chunk_index, r.total_lines, r.n_files, r.total_chunks) for r in t] == [(0, 400, 2, 3), (1, 400, 2, 3), (2, 200, 1, 3)]


def _patch(*lines):
    return "\n".join(["@@ -1,2 +1,3 @@", *lines])


AK = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
CASES = [
    ("+key = '" + AK + "'", "AWS Access Key", "critical"),
    ("+aws_secret_access_key = '" + "a" * 40 + "'", "AWS Secret Key", "critical"),
    ("+api_key = \"" + "k" * 24 + "\"", "Generic API Key", "critical"),
    ("+password = \"hunter2hunter2\"", "Generic Password", "warning"),
    ("+-----BEGIN RSA " + "PRIVATE KEY-----", "Private Key", "critical"),
    ("+t = gh" + "p_" + "x" * 36, "GitHub Token", "critical"),
    ("+jwt = ey" + "J" + "a" * 12 + ".ey" + "J" + "b" * 12 + ".sig", "JWT Token", "warning"),
    ("+url = post" + "gres://user:pw@host/db", "Database Connection String", "critical"),
    ("+x = '" + AK + "' password = \"longenough\"", "AWS Access Key", "critical"),  # two rules: earlier wins
]


def test_secret_rules(spark):
    rows = [("r", i, f"f{i}.py", "added", 1, 0, _patch(" ctx", line), None) for i, (line, _, _) in enumerate(CASES)]
    rows.append(("r", 99, "clean.py", "added", 1, 0, _patch("+x = compute(1)"), None))
    rows.append(("r", 98, "removed.py", "modified", 0, 1, _patch("-password = \"hunter2hunter2\""), None))
    rows.append(("r", 97, "empty.py", "modified", 0, 0, "", None))
    df = spark.createDataFrame(
        rows, "review_id string, ordinal long, filename string, status string, additions long, deletions long, "
        "patch string, previous_filename string",
    )
    got = {r.ordinal: r for r in secret_scan(file_changes(df)).collect()}
    assert set(got) == set(range(len(CASES)))
    for i, (_, name, sev) in enumerate(CASES):
        assert got[i].message == f"{name} detected in code"
        assert got[i].severity == sev
        assert got[i].line == 3  # hunk header is line 1
        assert got[i].category == "hardcoded_secret" and got[i].agent == "security"


def test_prefilter_is_exact(spark):
    """Every line a rule matches passes the literal prefilter."""
    import random

    from revlens.functions.secrets import secret_candidate, secret_rule_index

    rnd = random.Random(11)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-=:'\"/.+ "
    lines = [line for line, _, _ in CASES]
    for _ in range(3000):
        base = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        lines.append(base)
        lines.append(rnd.choice(lines[: len(CASES)]).replace("a", rnd.choice("aAxX")).upper() if rnd.random() < 0.3 else base)
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    bad = df.filter(secret_rule_index(F.col("t")).isNotNull() & ~secret_candidate(F.col("t"))).count()
    assert bad == 0


def test_chunk_sparse_ordinals_tree(spark):
    """Sparse ordinals: every file in its own block, blocks spread over parents."""
    rnd = random.Random(5)
    lines = [rnd.choice([10, 200, 499, 700]) for _ in range(40)]
    rows = [("r", i * 1000, n, 0) for i, n in enumerate(lines)]
    df = spark.createDataFrame(rows, "review_id string, ordinal long, additions long, deletions long")
    got = assign_chunks(df, block_files=1, fan_in=3).orderBy("ordinal").collect()
    assert [r.chunk_index for r in got] == py_chunks(lines)


def test_nested_parsed_event(spark):
    from revlens.schemas import nest_parsed_event
    from revlens.operators.parse import pr_stats, drop_generated

    rows = [("r", i, f"f{i}.py", "added", n, 0, "+x", None) for i, n in enumerate([300, 300, 10])]
    df = spark.createDataFrame(
        rows, "review_id string, ordinal long, filename string, status string, additions long, deletions long, "
        "patch string, previous_filename string",
    )
    ch = file_changes(df)
    ev = nest_parsed_event(assign_chunks(drop_generated(ch)), pr_stats(ch)).first()
    assert ev.event_type == "pr.parsed" and ev.stats.total_files == 3
    assert [len(c.files) for c in ev.chunks] == [1, 2] and [c.total_lines for c in ev.chunks] == [300, 310]
    assert ev.chunks[1].files[0].path == "f1.py"


def test_steps_stay_few(spark):
    """A block's table has at most max_lines + 2 steps, whatever its files are."""
    from revlens.operators import chunk

    lines = [0, 0, *[1] * 900, 0, 700, 0, 0, 3] * 2
    files = spark.createDataFrame([(i, n) for i, n in enumerate(lines)], "ordinal long, lines long")
    rows = files.agg(F.sort_array(F.collect_list(F.struct("ordinal", "lines"))).alias("files"))
    for limit in (5, 500):
        table = rows.select(F.aggregate("files", chunk._empty_table(), chunk._add_file(limit)).alias("t")).first()["t"]
        reaches = [s["reach"] for s in table["steps"]]
        assert reaches == sorted(set(reaches)) and len(reaches) <= limit + 2
        assert sum(r > limit for r in reaches) == 1 and table["lines"] == sum(lines)


def test_null_lines_count_as_none(spark):
    df = spark.createDataFrame([("r", 0, 400), ("r", 1, None), ("r", 2, 200)], "review_id string, ordinal long, lines long")
    nowhere = spark.createDataFrame([(None, 0, 9), ("r", None, 9)], df.schema)
    got = {r.ordinal: (r.lines, r.chunk_index, r.total_chunks) for r in number_files(df.unionByName(nowhere)).collect()}
    assert got == {0: (400, 0, 2), 1: (0, 0, 2), 2: (200, 1, 2)}
