"""Pull requests: records, addresses and the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import age, truncate

PAGE = 100
#: Branches that a change may be based on, in order.
BASES = ("main", "master", "origin/main", "origin/master")


def pull_requests(raw: DataFrame, now: Column) -> DataFrame:
    """Records of the hosting service's JSON (number, title, user.login, merged_at, closed_at, draft, head.ref, base.ref,
    html_url, created_at, updated_at, additions, deletions, labels.name): Merged, else Closed, else Open; empty texts,
    false and now for what is missing. The list does not say how reviews stand, so review_status is None."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    state = F.when(F.col("merged_at").isNotNull(), "Merged").when(F.col("closed_at").isNotNull(), "Closed").otherwise("Open")
    return raw.select(
        F.col("number").cast("long"),
        text("title").alias("title"),
        text("user.login").alias("author"),
        state.alias("state"),
        F.coalesce("draft", F.lit(False)).alias("draft"),
        text("head.ref").alias("head_branch"),
        text("base.ref").alias("base_branch"),
        text("html_url").alias("url"),
        F.coalesce(F.col("created_at").cast("timestamp"), now).alias("created_at"),
        F.coalesce(F.col("updated_at").cast("timestamp"), now).alias("updated_at"),
        F.col("additions").cast("long"),
        F.col("deletions").cast("long"),
        F.lit("None").alias("review_status"),
        F.coalesce(F.transform("labels", lambda x: x["name"]), F.array().cast("array<string>")).alias("labels"),
    )


def list_pull_requests(prs: DataFrame, author: str | None = None, state: str | None = "Open", reviewer: str | None = None, page: int | None = PAGE) -> DataFrame:
    """The first page by number, then the filters that are given. reviewer needs a column reviewers."""
    out = prs if state is None else prs.filter(F.col("state") == state)
    out = out if page is None else out.orderBy(F.desc("number")).limit(page)
    out = out if author is None else out.filter(F.col("author") == author)
    return out if reviewer is None else out.filter(F.array_contains("reviewers", reviewer))


def pull_request(prs: DataFrame, number: int) -> DataFrame:
    return prs.filter(F.col("number") == number)


def inbox(prs: DataFrame, user: str) -> DataFrame:
    """Adds box: mine for the user's own pull requests, review for all others."""
    return prs.withColumn("box", F.when(F.col("author") == user, "mine").otherwise("review"))


#: How the state of a review is shown.
REVIEW_TAGS = {"Approved": "[approved]", "ChangesRequested": "[changes]", "Pending": "[pending]"}


def _padded(c: Column, width: int, left: bool) -> Column:
    """c with blanks on its left or right up to width; never cut."""
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c)))
    return F.concat(blanks, c) if left else F.concat(c, blanks)


def line(now: Column, width: int = 40) -> Column:
    """A pull request as a line of the list: number, title, review, sizes if both are known, age, draft."""
    tag = F.coalesce(*(F.when(F.col("review_status") == k, v) for k, v in REVIEW_TAGS.items()), F.lit("[no review]"))
    sizes = F.when(F.col("additions").isNotNull() & F.col("deletions").isNotNull(), F.format_string("+%d/-%d", "additions", "deletions")).otherwise("")
    draft = F.when(F.col("draft"), " (draft)").otherwise("")
    cells = [_padded(F.col("number").cast("string"), 5, False), _padded(truncate(F.col("title"), width), width, False), _padded(tag, 12, True), _padded(sizes, 10, True), _padded(age(F.col("updated_at"), now), 6, True)]
    return F.concat(F.lit("  #"), F.concat_ws(" ", *cells), draft)


def repository_of(url: Column) -> Column:
    """owner and repo of a remote's address, over SSH or HTTPS; null for another host. The repo may hold a '/'."""
    clean = F.regexp_replace(F.regexp_replace(url, r"/$", ""), r"\.git$", "")
    rest = F.coalesce(F.nullif(F.regexp_extract(clean, r"^git@github\.com:(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(clean, r"github\.com/(.+)$", 1), F.lit("")))
    owner, repo = F.regexp_extract(rest, r"^([^/]+)/(.+)$", 1), F.regexp_extract(rest, r"^([^/]+)/(.+)$", 2)
    return F.when(F.length(owner) > 0, F.struct(owner.alias("owner"), repo.alias("repo")))


def provider_of(url: Column, configured: str | None = None) -> Column:
    """GitHub or GitLab by address or configuration, else null."""
    named = F.lit(configured or "")
    return F.when(F.contains(url, F.lit("github.com")) | (named == "github"), "GitHub").when(F.contains(url, F.lit("gitlab")) | (named == "gitlab"), "GitLab")


def web_url(owner: Column, repo: Column, number: Column) -> Column:
    return F.format_string("https://github.com/%s/%s/pull/%d", owner, repo, number)


def base_branch(refs: DataFrame) -> DataFrame:
    """The first of BASES among a repository's refs (change_id, name); repositories without one have no row."""
    rank = F.coalesce(*(F.when(F.col("name") == b, i) for i, b in enumerate(BASES)))
    return refs.withColumn("rank", rank).filter("rank is not null").groupBy("change_id").agg(F.min_by("name", "rank").alias("base"))
