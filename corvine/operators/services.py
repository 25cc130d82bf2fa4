"""Service functions over the operational tables: look-ups, status changes, conversations.

Reads return rows; changes return the table's next snapshot, which the caller writes as a whole (a new
folder, then the switch of a pointer), so a crash never leaves half a change behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.config import JOB_STATUS, LIMITS, MESSAGE_ROLES, REPO_STATUS
from corvine.functions import scalars as S
from corvine.operators import dml


def _one_of(value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ValueError(f"{value!r} is none of {', '.join(known)}")
    return value


# Look-ups


def by_id(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col("id") == key).limit(1)


def repo_by_url(repos: DataFrame, url: str) -> DataFrame:
    """The repository of an address, in any of its spellings."""
    return repos.filter(S.normalize_remote(F.col("github_url")) == S.normalize_remote(F.lit(url))).orderBy("id").limit(1)


def files_of(files: DataFrame, repo_id: str) -> DataFrame:
    return files.filter(F.col("repo_id") == repo_id).orderBy("path", "id")


def messages_of(messages: DataFrame, conversation_id: str) -> DataFrame:
    return messages.filter(F.col("conversation_id") == conversation_id).orderBy(F.asc_nulls_last("created_at"), "id")


def conversations_of(conversations: DataFrame, repo_id: str) -> DataFrame:
    return conversations.filter(F.col("repo_id") == repo_id).orderBy(F.desc_nulls_last("updated_at"), "id")


def conversation_for_repo(conversations: DataFrame, conversation_id: str, repo_id: str) -> DataFrame:
    """The conversation only if it belongs to the repository."""
    return conversations.filter((F.col("id") == conversation_id) & (F.col("repo_id") == repo_id)).limit(1)


def latest_job(jobs: DataFrame, repo_id: str) -> DataFrame:
    return jobs.filter(F.col("repo_id") == repo_id).orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(1)


# Repositories


def mark_repo(repos: DataFrame, repo_id: str, status: str, now: Column) -> DataFrame:
    """Status and updated_at of one repository; ready also stamps last_indexed_at."""
    values = {"status": F.lit(_one_of(status, REPO_STATUS)), "updated_at": now}
    if status == "ready":
        values["last_indexed_at"] = now
    return dml.update_where(repos, F.col("id") == repo_id, values)


def set_default_branch(repos: DataFrame, repo_id: str, branch: str, now: Column) -> DataFrame:
    return dml.update_where(repos, F.col("id") == repo_id, {"default_branch": F.lit(branch), "updated_at": now})


def set_guide(repos: DataFrame, repo_id: str, guide: str, now: Column) -> DataFrame:
    return dml.update_where(repos, F.col("id") == repo_id, {"onboarding_guide": F.lit(guide), "onboarding_guide_generated_at": now, "updated_at": now})


# Jobs


def create_job(jobs: DataFrame, job_id: str, repo_id: str, now: Column) -> DataFrame:
    spark = jobs.sparkSession
    row = spark.range(1).select(F.lit(job_id).alias("id"), F.lit(repo_id).alias("repo_id"), F.lit("queued").alias("status"), F.lit(0).alias("progress"), now.alias("created_at"))
    return jobs.unionByName(row, allowMissingColumns=True)


def mark_job_failed(jobs: DataFrame, job_id: str, message: str, now: Column) -> DataFrame:
    values = {"status": F.lit(_one_of("failed", JOB_STATUS)), "error": F.lit(message[: LIMITS.error_chars]), "finished_at": now}
    return dml.update_where(jobs, F.col("id") == job_id, values)


def enqueue(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that the queue does not hold yet, one for each job id."""
    return dml.insert_ignore(queue, requests, ["job_id"])


# Conversations


def create_conversations(conversations: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The table with a conversation for each row of ``asked`` (id, repo_id, title); no title gives the standard one."""
    title = F.substring(F.coalesce("title", F.lit("New conversation")), 1, 200)
    new = asked.select("id", "repo_id", title.alias("title"), now.alias("created_at"), now.alias("updated_at"))
    return dml.insert_rows(conversations, new)


def recent_conversations(conversations: DataFrame, per_repo: int = 20) -> DataFrame:
    """(repo_id, place, id): the conversations of each repository that were changed last."""
    order = Window.partitionBy("repo_id").orderBy(F.desc_nulls_last("updated_at"), "id")
    return conversations.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_repo).select("repo_id", "place", "id")


def first_messages(messages: DataFrame, most: int = 50) -> DataFrame:
    """(conversation_id, place, id): the first messages of each conversation, oldest first."""
    order = Window.partitionBy("conversation_id").orderBy(F.asc_nulls_last("created_at"), "id")
    rows = messages.filter("conversation_id is not null").withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("place") <= most).select("conversation_id", "place", "id")


def repos_for_page(repos: DataFrame, url: str, most: int = 50) -> DataFrame:
    """(place, id, matched): a short list of repositories, the one of the page first, then by last change."""
    hit = F.coalesce(S.normalize_remote(F.col("github_url")) == S.normalize_remote(F.lit(url)), F.lit(False))
    order = [F.desc("matched"), F.desc_nulls_last("updated_at"), F.asc("id")]
    few = repos.select("id", "updated_at", hit.alias("matched")).orderBy(*order).limit(most)
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "id", "matched")


def append_messages(conversations: DataFrame, messages: DataFrame, added: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) after adding rows; parents get a new updated_at, unknown roles are refused."""
    known = added.filter(F.col("role").isin(*MESSAGE_ROLES))
    hit = known.select(F.col("conversation_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    bumped = conversations.join(hit, "id", "left").withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).drop("_hit")
    return bumped, messages.unionByName(known, allowMissingColumns=True)


def rename_conversation(conversations: DataFrame, conversation_id: str, title: str) -> DataFrame:
    return dml.update_where(conversations, F.col("id") == conversation_id, {"title": F.lit(title[:200])})


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``gone`` (id) and their messages."""
    ids = gone.select("id").distinct()
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


# Texts


def ask_with_context(question: Column, path: Column, selection: Column) -> Column:
    """A question with the code that its author looks at, fenced; the bare question without a selection."""
    # fixed format
    folded = F.concat(question, F.lit("\n\nThe user is looking at this code in `"), path, F.lit("`:\n```\n"), selection, F.lit("\n```"))
    return F.when(selection.isNotNull(), folded).otherwise(question)


def same_repo(owner_a: Column, repo_a: Column, owner_b: Column, repo_b: Column) -> Column:
    return (F.lower(owner_a) == F.lower(owner_b)) & (F.lower(repo_a) == F.lower(repo_b))


def pull_request_files(files: DataFrame) -> DataFrame:
    """(pull_id, sections, n_files) over (pull_id, filename, status, additions, deletions, patch): first 50 files, patches cut.

    Each section is the file's header and its fenced patch; at most 50 are gathered for a pull request.
    """
    order = Window.partitionBy("pull_id").orderBy("filename")
    first = files.withColumn("n", F.row_number().over(order)).filter("n <= 50")
    patch = S.clipped(F.col("patch"), LIMITS.patch_chars, "\n… (patch truncated)")
    head = F.concat(F.lit("**"), "filename", F.lit("** ("), "status", F.lit(", +"), F.col("additions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"), F.lit(")"))
    body = F.when(F.col("patch").isNull(), F.lit(" *(binary file or patch unavailable)*")).otherwise(F.concat(F.lit("\n```diff\n"), patch, F.lit("\n```")))
    rows = first.groupBy("pull_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(head, body).alias("section")))).alias("s"))
    return rows.select("pull_id", F.array_join(F.transform("s", lambda x: x["section"]), "\n\n").alias("sections"), F.size("s").alias("n_files"))


def pull_request_message(pulls: DataFrame, sections: DataFrame) -> DataFrame:
    """(pull_id, message): the whole request for a review, from ``pulls`` and the sections of its files.

    ``pulls`` has pull_id, title, repo, head, base, additions, deletions, changed, state, merged, body;
    the description is cut at 800 characters and left out where it is blank.
    """
    rows = pulls.join(sections, "pull_id", "left")
    shown = F.coalesce("n_files", F.lit(0))
    files = lambda n: F.concat(n.cast("string"), F.when(n == 1, " file").otherwise(" files"))
    about = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "").otherwise(F.concat(F.lit("\n**Description:**\n"), F.substring("body", 1, 800), F.lit("\n")))
    # fixed format
    message = F.concat(
        F.lit("Please review this pull request:\n\n## "), "title", F.lit("\n- **Repo:** "), "repo", F.lit("  branch `"), "head", F.lit("` → `"), "base",
        F.lit("`\n- **Stats:** +"), F.col("additions").cast("string"), F.lit(" / -"), F.col("deletions").cast("string"), F.lit(" across "), files(F.col("changed")),
        F.lit("\n- **Status:** "), F.when(F.col("merged"), "Merged").otherwise(F.col("state")), about, F.lit("\n\n## Diff ("), files(shown), F.lit(" shown)\n\n"),
        F.coalesce("sections", F.lit("")),
    )
    return rows.select("pull_id", message.alias("message"))
