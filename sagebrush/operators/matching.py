"""Best match of two lists of texts of one row: argmax of topic and token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrush.functions.text import first_where, let, match_score, polarity, squeezed, tokens, topics


def best_match(issues: DataFrame, changes: DataFrame, key: str, allowed: list[str] | None = None, source: str = "competitor") -> DataFrame:
    """The best-scoring issue and change of each key, scores above 0; ties go to the first issue, then change.

    Both sides have the key, pos and text; of the changes only those of an ``allowed`` polarity count. The join is on the
    key, and topics and tokens are made once for each text, before it.
    """
    if allowed is not None:
        changes = changes.filter(polarity(F.col("text"), source).isin(allowed))
    made = lambda df, s: df.select(key, F.col("pos").alias(f"{s}_pos"), F.col("text").alias(s), topics(F.col("text")).alias(f"{s}_topics"), tokens(F.col("text")).alias(f"{s}_tokens"))
    pairs = made(issues, "issue").join(made(changes, "change"), key)
    scored = pairs.withColumn("score", match_score(*(F.col(c) for c in ("issue_topics", "issue_tokens", "change_topics", "change_tokens")))).filter("score > 0")
    order = F.struct("score", -F.col("issue_pos"), -F.col("change_pos"))
    return scored.groupBy(key).agg(F.max_by(F.struct("issue", "change", "issue_pos", "change_pos", "score"), order).alias("m")).select(key, "m.*")


def first_of_each(df: DataFrame, content: str, order: str) -> DataFrame:
    """One row of each content, the first in ``order``; contents are compared by hash, so they aren't shuffled twice."""
    rest = [c for c in df.columns if c != "_md5"]
    keyed = df.withColumn("_md5", F.md5(F.col(content)))
    return keyed.groupBy("_md5").agg(F.min_by(F.struct(*rest), order).alias("r")).select("r.*")


def pivot_steps(df: DataFrame, key: str, step: str, value: str, steps: list[str], order: str) -> DataFrame:
    """One row of each key that has every step, with each step's last value."""
    aggs = [F.max_by(F.when(F.col(step) == s, F.col(value)), F.when(F.col(step) == s, F.col(order))).alias(s) for s in steps]
    return df.groupBy(key).agg(*aggs).dropna(subset=steps)


def entries(texts: Column, source: str) -> Column:
    """Texts with their place, topics, tokens and polarity; blank ones are left out."""
    clean = F.filter(F.transform(texts, squeezed), lambda x: x != "")

    def told(x: Column, i: Column) -> Column:
        made = lambda t: F.struct(F.lit(source).alias("source"), i.alias("pos"), x.alias("text"), t.alias("topics"), tokens(x).alias("tokens"), polarity(x, source, t).alias("polarity"))
        return let(topics(x), made)

    return F.transform(clean, told)


def best_within(issues: Column, changes: Column) -> Column:
    """issue and change of the best-scoring pair of two lists of entries, or null; ties go to the first issue, then change.

    Of each issue only its best change is kept, so what is held at a time grows with one list, not with the product.
    """

    def best_change(i: Column) -> Column:
        def scored(x: Column) -> Column:
            score = match_score(i["topics"], i["tokens"], x["topics"], x["tokens"])
            return F.struct(score.alias("score"), (-i["pos"]).alias("issue_pos"), (-x["pos"]).alias("change_pos"), i["text"].alias("issue"), x["text"].alias("change"))

        return F.array_max(F.transform(changes, scored))

    found = F.array_max(F.filter(F.transform(issues, best_change), lambda b: b["score"] > 0))
    return F.get(F.transform(F.filter(F.array(found), lambda b: b.isNotNull()), lambda b: F.struct(b["issue"].alias("issue"), b["change"].alias("change"))), 0)


def semantic_view(df: DataFrame, issues: str, changes: str, tools: str) -> DataFrame:
    """How the changes of each row meet its issues; ``df`` with the columns of the view added.

    positive_pull, pending_pull, positive_tool, negative_tool are the best matches (issue, change) or null; primary_issue,
    primary_pull and primary_tool_change are the texts that matter most; has_positive_pull, has_pending_pull,
    has_positive_tool, has_negative_tool tell of any entry. All of it is told within the row: nothing is shuffled.
    """
    made = df.withColumns({"_i": entries(F.col(issues), "issue"), "_c": entries(F.col(changes), "competitor"), "_t": entries(F.col(tools), "tool")})
    kinds = {"positive_pull": ("_c", "positive"), "pending_pull": ("_c", "pending"), "positive_tool": ("_t", "positive"), "negative_tool": ("_t", "negative")}
    of = lambda column, p: F.filter(column, lambda e: e["polarity"] == p)
    best = made.withColumns({name: best_within(F.col("_i"), of(column, p)) for name, (column, p) in kinds.items()})
    by = lambda column, p: first_where(F.col(column), lambda e: e["polarity"] == p)["text"]
    view = {
        "primary_issue": F.coalesce("positive_pull.issue", "pending_pull.issue", "negative_tool.issue", "positive_tool.issue", F.get("_i", 0)["text"]),
        "primary_pull": F.coalesce("positive_pull.change", "pending_pull.change", by("_c", "positive"), by("_c", "pending"), F.get("_c", 0)["text"]),
        "primary_tool_change": F.coalesce("negative_tool.change", "positive_tool.change", by("_t", "negative"), by("_t", "positive"), F.get("_t", 0)["text"]),
    }
    view |= {f"has_{name}": F.size(of(column, p)) > 0 for name, (column, p) in kinds.items()}
    return best.withColumns(view).drop("_i", "_c", "_t")
