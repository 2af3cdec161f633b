"""Rows of upstream systems as items. Ids are hashes of a name, so that a row synced again keeps its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.route import detect_language


def stable_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _item(rows: DataFrame, id: Column, source_id: str, kind: str, content_type: Column, content: Column, created_at: Column, **metadata: Column) -> DataFrame:
    return rows.select(
        id.alias("id"), F.lit(source_id).alias("source_id"), F.lit(kind).alias("source_kind"), content_type.alias("content_type"), content.alias("content"),
        F.to_json(F.struct(*[c.alias(n) for n, c in metadata.items()])).alias("metadata"), created_at.cast("timestamp").alias("created_at"))


def _listed(comments: str) -> Column:
    return F.array_join(F.transform(comments, lambda c: F.concat(F.lit("- "), c["author"], F.lit(": "), c["body"])), "\n")


def code_files(rows: DataFrame, source_id: str, repo: str, branch: str, provider: str = "github") -> DataFrame:
    """Files (path, content, sha)."""
    lang = F.coalesce(detect_language(F.col("path")), F.lit("text"))
    return _item(rows, stable_id(F.lit(repo), F.col("path")), source_id, "code_repo", F.concat(F.lit("text/code:"), lang), F.col("content"), F.lit(None),
                 provider=F.lit(provider), repo=F.lit(repo), branch=F.lit(branch), path=F.col("path"), sha=F.col("sha"), language=lang)


def issues(rows: DataFrame, source_id: str, provider: str = "github") -> DataFrame:
    """Issues (key, title, state, priority, body, author, url, created_at, comments array<struct<author,body>>) as structured text.

    The type is plain text, for Markdown would route them to the document strategy.
    """
    text = F.concat(F.lit("Title: "), F.col("title"), F.lit("\nStatus: "), F.col("state"), F.coalesce(F.concat(F.lit("\nPriority: "), F.col("priority")), F.lit("")),
                    F.lit("\n\nDescription:\n"), F.coalesce("body", F.lit("")), F.lit("\n\nComments:\n"), F.coalesce(_listed("comments"), F.lit("")))
    return _item(rows, stable_id(F.lit(provider), F.lit("issue"), F.col("key")), source_id, "ticketing", F.lit("text/plain"), text, F.col("created_at"),
                 provider=F.lit(provider), issue_key=F.col("key"), state=F.col("state"), author=F.col("author"), url=F.col("url"))


def pull_requests(rows: DataFrame, source_id: str, provider: str = "github") -> DataFrame:
    """Pull requests (number, title, body, state, author, url, created_at, reviews array<struct<author,state,body>>) as Markdown."""
    reviews = F.array_join(F.transform("reviews", lambda r: F.concat(F.lit("**"), r["author"], F.lit("** ("), r["state"], F.lit("): "), r["body"])), "\n\n")
    text = F.concat(F.lit("# PR #"), F.col("number").cast("string"), F.lit(": "), F.col("title"), F.lit("\n\n## Description\n"), F.coalesce("body", F.lit("")),
                    F.lit("\n\n## Reviews\n"), F.coalesce(reviews, F.lit("")))
    return _item(rows, stable_id(F.lit(provider), F.lit("pr"), F.col("number").cast("string")), source_id, "ticketing", F.lit("text/markdown"), text, F.col("created_at"),
                 provider=F.lit(provider), pr_number=F.col("number"), state=F.col("state"), author=F.col("author"), url=F.col("url"))


def threads(rows: DataFrame, source_id: Column | str, provider: str = "slack") -> DataFrame:
    """Threads (channel, thread_ts, messages array<struct<user,text,ts>>) as JSON items; the time is the first message's, where it is an epoch."""
    first = F.coalesce("thread_ts", F.try_element_at("messages", F.lit(1))["ts"])
    at = F.timestamp_micros((F.try_to_number(first, F.lit("9999999999.999999")) * 1_000_000).cast("bigint"))
    owner = F.lit(source_id) if isinstance(source_id, str) else source_id
    return rows.select(stable_id(F.lit(provider), F.coalesce("channel", F.lit("")), first).alias("id"), owner.alias("source_id"), F.lit("chat").alias("source_kind"),
                       F.lit("application/json").alias("content_type"), F.to_json(F.struct("channel", "thread_ts", "messages")).alias("content"),
                       F.to_json(F.struct(F.lit(provider).alias("provider"), F.col("channel").alias("channel_name"))).alias("metadata"), at.alias("created_at"))


def pages(rows: DataFrame, source_id: str, kind: str = "wiki", content_type: str = "text/markdown", provider: str = "notion") -> DataFrame:
    """Pages (key, title, body, url, created_at) of wikis, or of the web with kind web and type text/html."""
    return _item(rows, stable_id(F.lit(provider), F.col("key")), source_id, kind, F.lit(content_type), F.col("body"), F.col("created_at"),
                 provider=F.lit(provider), title=F.col("title"), url=F.col("url"))


def mails(rows: DataFrame, source_id: str, provider: str = "imap") -> DataFrame:
    """Mail threads (key, subject, created_at, mails array<struct<author,body>>) as a conversation."""
    text = F.array_join(F.transform("mails", lambda m: F.concat(m["author"], F.lit(": "), m["body"])), "\n\n")
    return _item(rows, stable_id(F.lit(provider), F.col("key")), source_id, "email", F.lit("text/plain"), text, F.col("created_at"), provider=F.lit(provider), subject=F.col("subject"))
