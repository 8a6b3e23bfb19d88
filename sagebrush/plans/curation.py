"""Curation of training data: classes, matches, dedup, balance, splits, batches, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import text as X
from sagebrush.functions import words as W
from sagebrush.operators.latest import last_rows
from sagebrush.operators.matching import best_match, first_of_each, pivot_steps
from sagebrush.operators.sampling import balanced, diverse, diverse_balanced, grouped_split, interleaved_batches

from .registry import query, table


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_hits(text: str, words: list[str]) -> str:
    return f"len(list_filter({sql_list(words)}, lambda k: contains({text}, k)))"


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CASE WHEN {sql_hits('t', W.CONCRETE)} > {sql_hits('t', W.VAGUE)} THEN 'CONCRETE' ELSE 'VAGUE' END AS substance,
CASE WHEN {sql_hits('t', W.HIGH_SEVERITY)} > 0 THEN 'HIGH' WHEN {sql_hits('t', W.MEDIUM_SEVERITY)} > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM d""")
def q_keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.substance(t).alias("substance"), X.severity(t).alias("severity"))


@query(f"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) || ' ' AS t FROM documents),
s AS (SELECT doc_id, {sql_hits('t', W.PENDING)} AS pending, {sql_hits('t', W.POSITIVE_OVERRIDES)} AS o, {sql_hits('t', W.POSITIVE)} AS p, {sql_hits('t', W.NEGATIVE)} AS n, starts_with(t, ' no ') AS no FROM d),
c AS (SELECT doc_id, pending, p + CASE WHEN o > 0 THEN 3 ELSE 0 END AS good, n + CASE WHEN no AND o = 0 THEN 2 ELSE 0 END AS bad FROM s)
SELECT doc_id, CASE WHEN pending > 0 THEN 'pending' WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS polarity FROM c""")
def q_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.polarity(F.col("text"), "tool").alias("polarity"))


@query(f"""WITH line AS (SELECT doc_id, lower(text[1:len(text) // 2]) AS a, lower(text[len(text) // 2 + 1:]) AS b FROM documents),
t AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(a, '[a-z0-9]+')), lambda x: len(x) > 2 AND NOT list_contains({sql_list(W.GENERIC)}, x)) AS a, list_filter(list_distinct(regexp_extract_all(b, '[a-z0-9]+')), lambda x: len(x) > 2 AND NOT list_contains({sql_list(W.GENERIC)}, x)) AS b FROM line)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared FROM t""")
def q_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared tokens of a text's two halves."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(X.tokens(first), X.tokens(second))).cast("long").alias("shared"))


def topic_sql(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_hits(text, p)} > 0 THEN '{n}' END" for n, p in W.TOPICS.items()) + "], lambda x: x IS NOT NULL)"


def token_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({text}, '[a-z0-9]+')), lambda x: len(x) > 2 AND NOT list_contains({sql_list(W.GENERIC)}, x))"


@query(f"""WITH turns AS (SELECT conv_id, turn, role, text, regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS t FROM conversations WHERE role IN ('user', 'assistant')),
x AS (SELECT conv_id, turn, role, text, {topic_sql('t')} AS topics, {token_sql('t')} AS tokens FROM turns),
p AS (SELECT u.conv_id, u.turn AS issue_pos, a.turn AS change_pos, len(list_intersect(u.topics, a.topics)) AS n, len(list_intersect(u.tokens, a.tokens)) AS k FROM x u JOIN x a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant'),
s AS (SELECT *, 10 * n + CASE WHEN k >= 2 THEN k ELSE 0 END + CASE WHEN n > 0 THEN 2 ELSE 0 END AS score FROM p)
SELECT conv_id, CAST(issue_pos AS BIGINT) AS issue_pos, CAST(change_pos AS BIGINT) AS change_pos, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, issue_pos, change_pos) AS r FROM s WHERE score > 0) WHERE r = 1""")
def q_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turn and the answer of each conversation that overlap most."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", "text")
    found = best_match(turns.filter("role = 'user'"), turns.filter("role = 'assistant'"), "conv_id")
    return found.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("issue_pos", "change_pos", "score")))


@query("SELECT min(doc_id) AS doc_id, CAST(sum(1) AS BIGINT) AS copies FROM documents GROUP BY md5(text)")
def q_dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each content, and how many rows have it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content"))
    return d.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("content")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def q_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "text", "doc_id").select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)")
def q_holdout_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows without the ids held out for evaluation."""
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(held, "doc_id", "left_anti")


@query("""WITH x AS (SELECT d.doc_id, l.quality AS grp FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT min(c) AS target FROM (SELECT count(*) AS c FROM x GROUP BY grp))
SELECT doc_id, grp, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY md5('99|' || doc_id), doc_id) AS BIGINT) AS place FROM x), t WHERE place <= target""")
def q_balance_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("grp"))
    return balanced(x, "grp", 99, "doc_id")


@query("""WITH x AS (SELECT d.doc_id, l.quality, d.lang, d.source FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT DISTINCT quality, lang, source FROM x),
n AS (SELECT *, count(*) OVER (PARTITION BY quality, lang) AS n, row_number() OVER (PARTITION BY quality, lang ORDER BY md5('123|' || source), source) AS place FROM g),
w AS (SELECT *, least(greatest(CAST(round_even(n * 0.15, 0) AS INTEGER), CASE WHEN n >= 3 THEN 1 ELSE 0 END), n - 1) AS want FROM n)
SELECT doc_id, x.quality, x.lang, x.source, CASE WHEN n >= 2 AND place <= want THEN 'val' ELSE 'train' END AS split FROM x JOIN w USING (quality, lang, source)""")
def q_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "lang", "source")
    return grouped_split(x, ["quality", "lang"], "source", 0.15, 123)


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS round FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY source) - 1 AS slot FROM d), n AS (SELECT *, slot // 4 AS part FROM p), c AS (SELECT *, count(*) OVER (PARTITION BY round, part) AS n FROM n)
SELECT doc_id, source, CAST(round AS BIGINT) AS round, CAST(part AS BIGINT) AS part FROM c WHERE n = 4""")
def q_interleave_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = interleaved_batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 4, 7, "doc_id")
    return b.select("doc_id", "source", F.col("round").cast("long").alias("round"), F.col("part").cast("long").alias("part"))


@query("SELECT p_partkey, v AS variant, p_brand || '/' || v AS name FROM part, generate_series(0, p_size % 3) s(v)")
def q_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each variant of a part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("p_size") % 3).cast("long"))).alias("variant"))
    return p.select("p_partkey", "variant", F.concat_ws("/", "p_brand", "variant").alias("name"))


@query("SELECT lang, source, count(*) AS n, count(DISTINCT doc_id) AS n_ids, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def q_dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over several dimensions in one pass."""
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.sum("n_chars").alias("chars"))


@query("SELECT word, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, first_id, word LIMIT 20")
def q_top_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most common words; ties go to the one seen first."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return last_rows(counts, 20, F.desc("n"), F.asc("first_id"), F.asc("word"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'system') AS system, arg_max(text, turn) FILTER (role = 'user') AS \"user\", arg_max(text, turn) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id HAVING system IS NOT NULL AND \"user\" IS NOT NULL AND assistant IS NOT NULL")
def q_step_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each role, of conversations that have all three."""
    return pivot_steps(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", ["system", "user", "assistant"], "turn")


@query("SELECT conv_id, count(*) AS n_turns, coalesce(bool_or(turn = 0 AND role = 'system'), false) AS has_system, arg_max(role, turn) = 'assistant' AS ends_well, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY conv_id")
def q_messages_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role shape of conversations."""
    c = table(spark, sf_dir, "conversations")
    roles = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.bool_or((F.col("turn") == 0) & (F.col("role") == "system")), F.lit(False)).alias("has_system"), (F.max_by("role", "turn") == "assistant").alias("ends_well"), F.array_join(F.transform(roles, lambda r: r["role"]), ",").alias("roles"))


@query("""WITH a AS (SELECT conv_id, arg_max(text, turn) AS chosen FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT 'sample' AS source, conv_id AS id, chosen, CASE WHEN strpos(chosen, 'the') > 0 THEN left(chosen, strpos(chosen, 'the') - 1) || 'THE' || substr(chosen, strpos(chosen, 'the') + 3) ELSE chosen END AS rejected FROM a
UNION ALL SELECT 'labelled', doc_id, NULL, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END FROM labels WHERE quality = 0""")
def q_pairs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of two sources; a rejected answer differs in the first occurrence of a word."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("chosen"))
    sample = c.select(F.lit("sample").alias("source"), F.col("conv_id").alias("id"), "chosen", X.replace_first(F.col("chosen"), "the", "THE").alias("rejected"))
    labelled = table(spark, sf_dir, "labels").filter("quality = 0").select(F.lit("labelled").alias("source"), F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("rejected"))
    return sample.unionByName(labelled, allowMissingColumns=True)


@query()
def q_diverse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice of parts of each size that spreads over brands and types, whose combinations bound the groups."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    return diverse(p, "p_size", ["p_brand", "p_type"], 10, "p_partkey")


@query()
def q_diverse_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents of each language as the rarest has, spread over sources and lengths."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.log10(F.col("n_chars") + 1)).alias("size"))
    return diverse_balanced(d, "lang", ["source", "size"], 17, "doc_id")
