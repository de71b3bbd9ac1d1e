"""Rule-based routing into clean, review and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.policy import Policies, Policy, by_kind


def hard_reasons(policy: Policy, title: Column, category: Column, author: Column, text: Column) -> Column:
    """Ordered reasons to quarantine."""
    size, solid = F.length(text), F.length(T.compact(text))
    everything = F.concat(title, author, category, text)
    unfit = category.isin(*policy.unfit) if policy.unfit else F.lit(False)
    rules = [
        ("unknown_dynasty", category == ""),
        ("non_ancient_dynasty", unfit),
        ("unsupported_dynasty", (category != "") & ~unfit & ~category.isin(*policy.allowed)),
        (f"body_shorter_than_{policy.min_length}", size < policy.min_length),
        (f"body_longer_than_{policy.max_length}", size > policy.max_length),
        ("contains_url", text.rlike(f"(?iu){policy.url}")),
    ]
    if policy.ascii_alnum:
        rules += [("contains_ascii_alphanumeric", text.rlike(policy.ascii_alnum)), ("contains_ascii_alphanumeric_metadata", F.concat(title, author, category).rlike(policy.ascii_alnum))]
    if policy.placeholder:
        rules.append(("contains_missing_character_placeholder", everything.rlike(policy.placeholder)))
    if policy.corruption:
        rules.append(("contains_corruption_symbol", everything.rlike(policy.corruption)))
    if policy.latin_rules:
        heavy = (solid >= policy.latin_least) & (T.latin_count(text) > policy.latin_share * solid)
        rules += [("latin_heavy_body", heavy), ("latin_heavy_prefix", ~heavy & (T.latin_count(F.substring(text, 1, policy.prefix_length)) >= policy.prefix_latin))]
    return T.reasons(rules)


def clause_shape(policy: Policy, text: Column) -> Column:
    """Struct of clauses, total, short, prose_like and prose_signal."""
    marks = "[" + "".join(T.quoted(c) for c in policy.clause_marks) + "]"
    lengths = F.transform(F.filter(F.transform(F.split(text, marks, -1), T.strip), lambda c: c != ""), F.length)
    counted = F.transform(
        F.array(lengths),
        lambda x: F.struct(F.size(x).cast("long").alias("clauses"), F.aggregate(x, F.lit(0), lambda n, c: n + c).cast("long").alias("total"), F.size(F.filter(x, lambda c: c <= policy.short_clause)).cast("long").alias("short")),
    )
    signal = F.lit(False)
    for mark in policy.prose_signals:
        signal = signal | F.contains(text, F.lit(mark))

    def judged(x: Column) -> Column:
        enough = (F.length(text) >= policy.prose_least) & (x["clauses"] >= policy.prose_clauses)
        prose = enough & (x["total"] > policy.prose_mean * x["clauses"]) & (x["short"] < policy.prose_short_share * x["clauses"])
        return F.struct(x["clauses"].alias("clauses"), x["total"].alias("total"), x["short"].alias("short"), prose.alias("prose_like"), (prose | signal).alias("prose_signal"))

    return F.element_at(F.transform(counted, judged), 1)


def review_reasons(policy: Policy, title: Column, text: Column, shape: Column) -> Column:
    """Ordered reasons to look at a record; ``shape`` is the text's ``clause_shape``."""
    size = F.length(text)
    rules = [(f"body_longer_than_{policy.review_length}", (size > policy.review_length) & (size <= policy.max_length))]
    rules += [(f"contains_marker:{m}", F.contains(text, F.lit(m))) for m in policy.body_markers]
    if policy.source_explanation:
        rules.append(("contains_source_explanation", text.rlike(policy.source_explanation)))
    rules += [(f"title_marker:{m}", F.contains(title, F.lit(m))) for m in policy.title_markers]
    rules += [("possible_html_or_character_placeholder", text.rlike(policy.html)), ("underscore_joined_title_metadata", F.contains(title, F.lit("_")))]
    if policy.citation:
        rules.append(("contains_parenthetical_citation", text.rlike(policy.citation)))
    if policy.ascii_punctuation:
        rules.append(("contains_ascii_punctuation", text.rlike(policy.ascii_punctuation)))
    rules.append(("prose_like_clause_lengths", shape["prose_like"]))
    if policy.title_suffixes:
        suffix = "(?:" + "|".join(policy.title_suffixes) + r")\n?\z"
        rules.append(("prose_genre_title_with_prose_signals", title.rlike(suffix) & shape["prose_signal"]))
    return T.reasons(rules)


def route_by_quality(df: DataFrame, policy: Policies, title: str = "title", category: str = "dynasty", author: str = "author", text: str = "text", kind: str | None = None) -> DataFrame:
    """``df`` with status, reasons (hard before review), hard and review; records unchanged.

    Nulls in the four fields count as empty. Statuses partition the input. With
    several policies, ``kind`` is the column that names each record's.
    """
    t, c, a, b = (F.coalesce(F.col(x), F.lit("")) for x in (title, category, author, text))
    each = lambda body: by_kind(policy, F.col(kind) if kind else None, body)
    shaped = T.bind(df, __shape=each(lambda p: clause_shape(p, b)))
    marked = T.bind(shaped, hard=each(lambda p: hard_reasons(p, t, c, a, b)), review=each(lambda p: review_reasons(p, t, b, F.col("__shape")))).drop("__shape")
    status = F.when(F.size("hard") > 0, "quarantine").when(F.size("review") > 0, "review").otherwise("clean")
    return marked.withColumn("status", status).withColumn("reasons", F.concat("hard", "review"))


def reason_counts(routed: DataFrame) -> DataFrame:
    """(section, key, n): records by status and by reason."""
    by_status = routed.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n")).select(F.lit("status").alias("section"), "key", "n")
    by_reason = routed.select(F.explode("reasons").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("reason").alias("section"), "key", "n")
    return by_status.unionByName(by_reason)


def write_routed(routed: DataFrame, path: str) -> None:
    """One write of all statuses, a folder for each, and a check that no record was lost."""
    records = routed.drop("hard", "review")
    records.write.partitionBy("status").json(path, ignoreNullFields=False)
    written, given = routed.sparkSession.read.json(path).count(), routed.count()
    if written != given:
        raise ValueError(f"{written} records written, {given} given")
