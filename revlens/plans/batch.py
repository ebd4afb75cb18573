"""End-to-end batch review: changed files -> comments.

files -> typed changes -> stats + generated filter -> chunks -> prompts ->
(chunk x reviewer) scoring -> decoded replies -> per-reviewer findings
(security: regex + model, first wins) -> store keys -> cross-reviewer dedupe
-> severity ranking -> verdict -> commit status -> comment.

Shuffles: one aggregation per review for stats, the chunk scan (bounded
groups), one gather per chunk for its prompt, the finding numbering (range
shuffle) and the partial aggregations of dedupe / verdict. No step gathers a
whole review except the final comment text, which is one string by definition.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import merge
from revlens.operators.chunk import assign_chunks
from revlens.operators.parse import drop_generated, file_changes, pr_stats
from revlens.operators.respond import decode_replies, reply_findings
from revlens.operators.scan import secret_scan
from revlens.operators.score import chunk_prompts, score_chunks
from revlens.session import materialise

# Order of a reviewer's findings: a regex finding by its file's ordinal and its
# line, a model finding by its chunk and its place in the reply.
FINDING_ORDER = ["source_rank", "chunk_index", "ordinal", "line"]


class BatchReview:
    """The stages of a review. Each is built when it is asked for, from the stages
    it needs: prompts never call the model, replies never scan for secrets."""

    def __init__(self, pr_files: DataFrame, scorer_factory: Callable, sleep, calls_per_second, brand):
        self._files, self._scorer_factory, self._sleep = pr_files, scorer_factory, sleep
        self._calls_per_second, self._brand = calls_per_second, brand

    @cached_property
    def changes(self) -> DataFrame:
        return file_changes(self._files)

    @cached_property
    def stats(self) -> DataFrame:
        return pr_stats(self.changes)

    @cached_property
    def kept(self) -> DataFrame:
        return drop_generated(self.changes)

    @cached_property
    def assigned(self) -> DataFrame:
        return assign_chunks(self.kept)

    @cached_property
    def chunk_counts(self) -> DataFrame:
        """(review_id, total_chunks) of the reviews that have chunks, from the stored
        replies: each chunk is scored by every reviewer, failures included."""
        return self.scored.groupBy("review_id").agg((F.max("chunk_index") + 1).cast("bigint").alias("total_chunks"))

    def store_small(self) -> None:
        """Store what has a row per review and several readers: statistics and verdicts."""
        self.stats = materialise(self.stats)
        self.verdicts = materialise(self.verdicts)

    @cached_property
    def prompts(self) -> DataFrame:
        return chunk_prompts(self.assigned)

    @cached_property
    def scored(self) -> DataFrame:
        """Replies of every reviewer to every chunk, stored before any later stage
        (or the sampling job of a range shuffle) could call the model again. A
        task that is run anew repeats its calls, with the same request keys."""
        return materialise(
            score_chunks(self.prompts, self._scorer_factory, sleep=self._sleep, calls_per_second=self._calls_per_second)
        )

    @cached_property
    def decoded(self) -> DataFrame:
        return decode_replies(self.scored)

    @cached_property
    def findings(self) -> DataFrame:
        return reviewer_findings(self.kept, self.decoded)

    @cached_property
    def ranked(self) -> DataFrame:
        return merge.rank_findings(merge.cross_reviewer_dedupe(self.findings))

    @cached_property
    def verdicts(self) -> DataFrame:
        return merge.verdicts(self.stats.select("review_id"), self.ranked)

    @cached_property
    def status(self) -> DataFrame:
        return merge.commit_status(self.verdicts)

    @cached_property
    def rendered(self) -> DataFrame:
        return merge.rendered_findings(self.ranked)

    @cached_property
    def comments(self) -> DataFrame:
        return merge.review_comments(self.verdicts, self.rendered, **({} if self._brand is None else {"brand": self._brand}))

    def comment_pages(self, page_bytes: int = merge.PAGE_BYTES) -> DataFrame:
        """The comments in pages; no row holds a review."""
        brand = {} if self._brand is None else {"brand": self._brand}
        return merge.comment_pages(self.verdicts, self.rendered, page_bytes, **brand)


def reviewer_findings(kept: DataFrame, decoded: DataFrame) -> DataFrame:
    """All reviewers' findings with store keys, in each reviewer's order."""
    model = reply_findings(decoded).withColumn("source_rank", F.lit(1)).withColumnRenamed("pos", "ordinal")
    regex = secret_scan(kept).select(
        "review_id",
        "agent",
        F.lit(-1).cast("bigint").alias("chunk_index"),
        "ordinal",
        "severity", "category", "file", "line", "message", "suggestion",
        F.lit(0).alias("source_rank"),
    )
    security = merge.security_dedupe(
        regex.unionByName(model.filter(F.col("agent") == "security"))
    )
    others = model.filter(F.col("agent") != "security")
    # The findings are small next to the diffs that produced them (regex scan
    # over every patch + reply decode + dedupe): store them once, so the range
    # sampler, the position join and every later stage read them instead of
    # re-running that work.
    every = materialise(security.unionByName(others))
    return merge.assign_finding_keys(every, FINDING_ORDER)


def review_batch(
    pr_files: DataFrame,
    scorer_factory: Callable,
    sleep: Callable[[float], None] = time.sleep,
    calls_per_second: float | None = None,
    brand: str | None = None,
) -> BatchReview:
    """The stages of reviewing `pr_files`, see `BatchReview`."""
    return BatchReview(pr_files, scorer_factory, sleep, calls_per_second, brand)
