"""Secret scans with corpus-wide ownership frequency (operator 7), JVM only.

Three base kinds are found by pattern in every whole text. A fourth, `bare`, is a
long run of letters and digits that stands alone. Hashes of all candidate values are
aggregated over the corpus by distinct repositories and owners: a value that many
owners hold is a widely copied example, one that few owners hold and that looks
random is a live credential. A bare run counts only where its value is live
somewhere under a base kind: the same credential, pasted without its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import stored

# The three base patterns, in their order.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "bare")
#: A value that several owners hold is an example from this many repositories on.
MAX_REPOS = 10


def candidates(docs: DataFrame, repo: Column, owner: Column, uid: Column | None = None) -> DataFrame:
    """Stored rows (uid, doc_id, repo, owner, kind arrays) of all documents; `uid` names
    a row, by default a new number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        (F.monotonically_increasing_id() if uid is None else uid).alias("uid"), "doc_id", repo.alias("repo"), owner.alias("owner"), text.alias("t"),
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("m_assign"),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)).alias("m_access"),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("m_hex"),
        F.regexp_extract_all(text, F.lit(BARE), F.lit(0)).alias("m_bare"),
    )
    live_looking = F.exists("m_bare", lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    wanted = {k: F.size(f"m_{k}") > 0 for k in KINDS[:3]} | {"bare": live_looking}
    return stored(
        found.select(
            "uid", "doc_id", "repo", "owner",
            *[F.when(wanted[k], F.col(f"m_{k}")).alias(f"m_{k}") for k in KINDS],
            F.when(wanted["assign"], F.regexp_extract_all(F.col("t"), F.lit(ASSIGN), F.lit(2))).alias("v_assign"),
            *[
                F.when(wanted[k], F.transform(F.split(F.col("t"), p, -1), lambda x: F.length(x))).alias(f"p_{k}")
                for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, BARE), strict=True)
            ],
        ),
        "secrets",
    )


def spans_of(cand: DataFrame) -> DataFrame:
    """(uid, doc_id, repo, owner, rank, start, end, value): spans that pass, ends
    exclusive, in code points. The n-th match starts after n pieces and n - 1
    matches, a running sum per document and kind."""
    out = None
    for rank, kind in enumerate(KINDS):
        value = f"v_{kind}" if kind == "assign" else f"m_{kind}"
        rows = cand.where(F.col(f"m_{kind}").isNotNull()).select(
            "uid", "doc_id", "repo", "owner",
            F.posexplode(F.arrays_zip(
                F.col(f"m_{kind}").alias("m"), F.col(value).alias("v"),
                F.slice(f"p_{kind}", F.lit(1), F.size(f"m_{kind}")).alias("p"),
            )).alias("i", "x"),
        ).select(
            "uid", "doc_id", "repo", "owner", "i", F.lit(rank).alias("rank"),
            F.length("x.m").alias("len"), F.col("x.v").alias("value"), F.col("x.p").alias("gap"),
        )
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy("uid", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(w)
    spans = out.select(
        "uid", "doc_id", "repo", "owner", "rank", (end - F.col("len")).alias("start"), end.alias("end"), "value"
    )
    size = F.length("value")
    passes = (
        F.when(F.col("rank") == 0, size >= 6)
        .when(F.col("rank") == 1, size >= 20)
        .when(F.col("rank") == 2, size >= 24)
        .otherwise(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    )
    return spans.where(passes)


def looks_random(value: Column) -> Column:
    """At least 12 characters, 8 different ones, digits and letters: not a word or
    a placeholder such as xxxxxx."""
    return (
        (F.length(value) >= 12)
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
    )


def ownership(spans: DataFrame, max_owners: int, max_repos: int = MAX_REPOS) -> DataFrame:
    """(value_hash, n_repos, n_owners, verdict) of all candidate values held under
    a base kind: an example if more than `max_owners` owners hold it, or several owners
    in more than `max_repos` repositories together; what one owner copies into all of
    theirs stays owner-specific. Distinct pairs come first, so that a value which a third
    of all documents hold is combined before it is shuffled."""
    base = spans.where("rank < 3")
    hashed = base.select(F.sha2("value", 256).alias("value_hash"), "repo", "owner", looks_random(F.col("value")).alias("random"))
    pairs = hashed.groupBy("value_hash", "owner", "repo").agg(F.max("random").alias("random"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("random").alias("random"))
    return owners.groupBy("value_hash").agg(
        F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("random").alias("random")
    ).select(
        "value_hash", "n_repos", "n_owners",
        F.when((F.col("n_owners") > max_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") > max_repos)), "example").when(F.col("random"), "live").otherwise("weak").alias("verdict"),
    )


def judged_spans(
    docs: DataFrame, repo: Column, owner: Column, max_owners: int, uid: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(candidate rows of all documents, judged spans of all candidates)."""
    cand = candidates(docs, repo, owner, uid)
    spans = stored(spans_of(cand), "secret-spans")
    owned = ownership(spans, max_owners)
    hashed = spans.withColumn("value_hash", F.sha2("value", 256))
    judged = hashed.join(owned, "value_hash", "left").where((F.col("rank") < 3) | (F.col("verdict") == "live"))
    return cand, judged


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame, repo: Column | None = None, owner: Column | None = None, max_owners: int = 3
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_bare, n_live, n_example, n_weak.

    A null or empty text has no spans (base_sha256 is that of the empty string). A
    null owner or repository counts as one of its own. Repeated rows are scanned
    one by one and hold a value as the same owner; a null doc_id passes through. An
    empty table gives an empty result. Only doc_id, text and the columns inside
    `repo` and `owner` are read.
    """
    cand, judged = judged_spans(
        docs, F.col("source") if repo is None else repo, F.col("source") if owner is None else owner, max_owners
    )
    per_doc = judged.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "verdict"))).alias("all")
    )
    base = F.filter("all", lambda s: s["rank"] < 3)
    bare = F.filter(
        "all",
        lambda s: (s["rank"] == 3)
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    found = per_doc.withColumn("base", base).withColumn("bare", bare)
    found = found.withColumn("kept", F.array_sort(F.concat("base", "bare")))

    def count(spans: str, field: str, value) -> Column:
        return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")

    found = found.select(
        "uid",
        *[count("base", "rank", r).alias(f"n_{k}") for r, k in enumerate(KINDS[:3])],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("kept")).alias("spans"),
        F.size("bare").cast("long").alias("n_bare"),
        *[count("kept", "verdict", v).alias(f"n_{v}") for v in ("live", "example", "weak")],
    )
    zero = {k: 0 for k in ("n_assign", "n_access", "n_hex", "n_bare", "n_live", "n_example", "n_weak")}
    out = cand.select("uid", "doc_id").join(found, "uid", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("n_assign", "n_access", "n_hex")],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in list(zero)[3:]],
    )


def without(text: Column, spans: Column, mark: str) -> Column:
    """`text` with each of `spans` (start, end: code points) replaced by `mark`; spans
    that overlap or touch inside one another become one."""

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        inside = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"])
        return F.when(inside, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), join)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def cut(acc: Column, x: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], piece, F.lit(mark)).alias("out"), x["end"].alias("at"))

    return F.aggregate(merged, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redact_live(docs: DataFrame, mark: str = "[secret]", max_owners: int = 3) -> DataFrame:
    """`docs` with every live credential in `text` replaced by `mark` (and n_chars
    counted anew); examples and weak values stay. What is replaced are the spans that the
    scan finds, by row: of an assignment the value, of other kinds the whole span; the
    same characters inside a longer word stay. Only rows in which a pattern is found take
    part in the join, the others pass straight through."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16}"
    )
    # the rows with a pattern are stored once with a number, which all steps agree on
    hits = stored(docs.where(hit).select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "secret-rows")
    scanned = hits.select(F.col("uid").alias("__uid"), "row.doc_id", "row.text", "row.source")
    _, judged = judged_spans(scanned, F.col("source"), F.col("source"), max_owners, F.col("__uid"))
    begins = F.when(F.col("rank") == 0, F.col("end") - F.length("value")).otherwise(F.col("start"))
    live = judged.where("verdict = 'live'").select("uid", F.struct(begins.alias("start"), "end").alias("span"))
    per_row = live.groupBy(F.col("uid").alias("__live")).agg(F.collect_set("span").alias("__spans"))
    found = hits.join(per_row, F.col("uid") == F.col("__live"), "left")
    clean = F.when(F.col("__spans").isNotNull(), without(F.col("row.text"), F.col("__spans"), mark)).otherwise(F.col("row.text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": clean}
    if "n_chars" in docs.columns:
        n = F.length(clean).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("__spans").isNotNull(), n).otherwise(F.col("row.n_chars"))
    return found.select(*[columns[c].alias(c) for c in docs.columns]).unionByName(docs.where(~hit))
