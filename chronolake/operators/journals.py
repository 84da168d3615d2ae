"""Append-only journals and paged captures: breaks, terminal states, gaps against a declared scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breaks(journal: DataFrame, key: str, sequence: str, clock: str, first: int = 0) -> DataFrame:
    """All rows with broken: the sequence is not dense from ``first``, or the clock goes back."""
    by = Window.partitionBy(key).orderBy(sequence)
    dense = F.row_number().over(by) == F.col(sequence) - first + 1
    back = F.lag(clock).over(by) > F.col(clock)
    return journal.withColumn("broken", ~F.coalesce(dense, F.lit(False)) | F.coalesce(back, F.lit(False)))


def page_states(pages: DataFrame, job: str, index: str, next_token: str) -> DataFrame:
    """job, pages, state, reason: how far a paged capture was read and why it ended there.

    A page without a next token ends a job as complete_pages; a token that an earlier page gave ends it as
    incomplete with pagination_cycle; a job whose pages end before either is incomplete with page_limit."""
    again = F.row_number().over(Window.partitionBy(job, next_token).orderBy(index)) > 1
    reason = F.when(F.col(next_token).isNull(), "terminal_page").when(again, "pagination_cycle")
    ended = Window.partitionBy(job).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select(job, index, reason.alias("_reason"))
    read = rows.withColumn("_over", F.count("_reason").over(ended) > 0).where("NOT _over")
    end = read.groupBy(job).agg(F.count("*").alias("pages"), F.max("_reason").alias("_end"))  # only the last page read has one
    why = F.coalesce("_end", F.lit("page_limit"))
    state = F.when(why == "terminal_page", "complete_pages").otherwise("incomplete")
    return end.select(job, "pages", state.alias("state"), why.alias("reason"))


def missing_kinds(known: DataFrame, keys: list[str], kind: str, required: list[str]) -> DataFrame:
    """keys, missing: the required kinds that a key lacks, in order, for keys that lack some."""
    absent = F.array_except(F.array(*map(F.lit, required)), F.collect_set(kind))
    return known.groupBy(*keys).agg(absent.alias("missing")).where("size(missing) > 0")


def chain_breaks(journal: DataFrame, key: str, sequence: str, digest: str, previous: str) -> DataFrame:
    """All rows with unchained: ``previous`` is not the ``digest`` of the row before; the first row has none."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(sequence))
    return journal.withColumn("unchained", ~F.col(previous).eqNullSafe(before))


def entry_digest(key: str, sequence: Column, body: str, previous: str) -> Column:
    """What the digest of a journal's entry has to be: of its key, place, body and the digest of the entry before, as canonical JSON."""
    content = F.sha2(F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary"), 256)
    return F.sha2(F.to_json(F.struct(content.alias("body"), F.col(key).cast("string").alias("key"), F.col(previous).alias("previous"), sequence.cast("long").alias("sequence")), {"ignoreNullFields": "false"}), 256)


def verify_chain(journal: DataFrame, heads: DataFrame, key: str, sequence: str, body: str, digest: str, previous: str, first: int = 0) -> DataFrame:
    """key, sequence, fault of every entry, and of heads that are not there: what was done to a journal, with all digests computed again.

    heads: key, sequence, digest of the last entry that is known to have been written.  Faults in order: repeated (the place is taken twice), swapped (the digest is
    right for the place before or after), altered (it is right for neither), first_with_previous, gap (no entry before), unchained (``previous`` is not the digest of the entry before), and tail_cut or
    tail_altered for a head that is missing or different; null where all is well.  An entry is checked from itself and the one before, found by a
    join on key and place, so a journal of any length is checked in parallel."""
    at = F.col(sequence).cast("long")
    good = lambda shift: F.col(digest).eqNullSafe(entry_digest(key, at + shift, body, previous))
    rows = journal.select(F.col(key).alias("_key"), at.alias("_at"), F.col(digest).alias("_digest"), F.col(previous).alias("_previous"), good(0).alias("_good"), (good(1) | good(-1)).alias("_near"))
    places = rows.groupBy("_key", "_at").agg(F.count("*").alias("_n"), F.max("_digest").alias("_before"))
    earlier = places.select(F.col("_key").alias("_k"), (F.col("_at") + 1).alias("_a"), "_before")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_a"))
    found = rows.join(places.where("_n > 1").select(F.col("_key").alias("_k2"), F.col("_at").alias("_a2"), F.lit(True).alias("_twice")), F.col("_key").eqNullSafe(F.col("_k2")) & F.col("_at").eqNullSafe(F.col("_a2")), "left").join(earlier, same, "left")
    fault = (
        F.when(F.col("_twice"), "repeated").when(~F.col("_good") & F.col("_near"), "swapped").when(~F.col("_good"), "altered")
        .when(F.col("_at") == first, F.when(F.col("_previous").isNotNull(), "first_with_previous")).when(F.col("_before").isNull(), "gap").when(~F.col("_previous").eqNullSafe(F.col("_before")), "unchained")
    )
    entries = found.select(F.col("_key").alias(key), F.col("_at").alias(sequence), fault.alias("fault"))
    last = heads.select(F.col(key).alias("_k"), F.col(sequence).cast("long").alias("_a"), F.col(digest).alias("_head"))
    ends = last.join(places, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_a")), "left")
    tail = F.when(F.col("_at").isNull(), "tail_cut").when(~F.col("_before").eqNullSafe(F.col("_head")), "tail_altered")
    return entries.unionByName(ends.select(F.col("_k").alias(key), F.col("_a").alias(sequence), tail.alias("fault")).where("fault IS NOT NULL"))


def append_once(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outcome of the incoming keys: new, same or conflict (differs from the stored row, or within the batch).

    Only new rows are appended: ``incoming.dropDuplicates(keys)`` joined to them.  Stored rows are reduced to digests first."""
    fields = sorted(set(incoming.columns) - set(keys))
    body = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in fields]), {"ignoreNullFields": "false"}), 256)
    both = incoming.select(*keys, body.alias("_sha"), F.lit(True).alias("_new")).unionByName(existing.select(*keys, body.alias("_sha"), F.lit(False).alias("_new")))
    found = both.groupBy(*keys).agg(F.min("_sha").alias("a"), F.max("_sha").alias("b"), F.bool_or("_new").alias("came"), F.bool_and("_new").alias("fresh"))
    return found.where("came").select(*keys, F.when(F.col("a") != F.col("b"), "conflict").when(F.col("fresh"), "new").otherwise("same").alias("outcome"))
