"""Chat formatting with prefix-target expansion (operator 7, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template: ``### role: text</turn>\n`` for each turn.
START, MIDDLE, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """No text holds ``##`` or ``</`` afterwards, so none can look like a marker."""
    return F.regexp_replace(text, r"\\|(?<=#)#|(?<=<)/", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"\\|(?<=#)#|(?<=<)/|:", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each turn with its formatted segment and its place.

    Adds to (conv_id, turn, role, text): ``segment``, ``seg_start`` (code points before
    it in its conversation), ``position`` (from 0) and ``trainable`` (an assistant's).
    Null text or role: empty. Turns go by ``turn`` (nulls first), ties by role, then
    text; repeated rows stay. A null conv_id is a conversation of its own. The turns of
    one conversation meet in one task, as its digests need them in order.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    segment = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(END))
    turns = turns.withColumn("segment", segment).withColumn("_n", F.length("segment").cast("long"))
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("seg_start", F.coalesce(before, F.lit(0))).withColumn("position", F.row_number().over(order) - 1)
    return turns.withColumn("trainable", F.col("role") == "assistant").drop("_n")


def write_examples(formatted: DataFrame) -> DataFrame:
    """The output: every assistant turn as an example whose context is all before it and
    whose reply alone is trained on.

    (conv_id, example, context_chars, body, loss_start, loss_chars, example_chars): the
    text of example k is the first ``context_chars`` code points of its conversation (the
    text of example k - 1, k > 0) followed by ``body``; the mask covers ``loss_chars`` code
    points of it from ``loss_start``. So a shared prefix is written once and a
    conversation of n turns takes O(n) space, not O(n^2); :func:`render` writes the
    examples out in full. Turns after the last reply belong to no example; they are a
    last row with ``example`` null and nothing under its mask.
    """
    earlier = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = formatted.withColumn("_e", F.coalesce(F.sum(F.col("trainable").cast("int")).over(earlier), F.lit(0)))
    header = F.length(F.lit(START)) + F.length(escape_role(F.col("role"))) + F.length(F.lit(MIDDLE))
    reply = F.struct((F.col("seg_start") + header).alias("at"), (F.length("segment") - header - len(END)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    rows = rows.groupBy("conv_id", "_e").agg(F.min("seg_start").alias("context_chars"), parts.alias("_p"), F.max(F.when(F.col("trainable"), reply)).alias("_r"))
    rows = rows.withColumn("body", F.concat_ws("", F.col("_p.segment")))
    return rows.select("conv_id", F.when(F.col("_r").isNotNull(), F.col("_e")).alias("example"), "context_chars", "body", F.coalesce("_r.at", F.lit(0)).cast("long").alias("loss_start"), F.coalesce("_r.n", F.lit(0)).cast("long").alias("loss_chars"), (F.col("context_chars") + F.length("body")).alias("example_chars"))


def expand(examples: DataFrame) -> DataFrame:
    """The rows of :func:`write_examples` with ``text``: prefix and target written out in full.
    The row of the turns after the last reply has the whole conversation."""
    before = Window.partitionBy("conv_id").orderBy(F.col("example").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return examples.withColumn("text", F.concat_ws("", F.collect_list("body").over(before)))


def render(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars): :func:`write_examples` in full."""
    return expand(examples).filter("example IS NOT NULL").select("conv_id", "example", "text", "loss_start", "loss_chars")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in formatted text, unescaped."""
    parts = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    # The role ends at the first ": ", as colons within it are escaped (":" never follows a bare backslash there).
    role = lambda p: F.regexp_extract(p, r"(?s)^### ((?:[^\\:]|\\.)*): ", 1)
    return F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(p.substr(F.length(role(p)) + len(START) + len(MIDDLE) + 1, F.length(p))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars) from the examples in full alone
    (:func:`expand`): the turns parsed from the longest text, the texts under the masks in
    order, unescaped, and the code points of all examples."""
    real = F.col("example").isNotNull()
    masked = F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_chars as int))")
    rows = expand(examples).select("conv_id", "loss_start", "text", F.length("text").cast("long").alias("n"), F.when(real, unescape(masked)).alias("said"), F.when(real, F.length("text")).alias("chars"))
    parts = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("loss_start", "said"))))
    rows = rows.groupBy("conv_id").agg(F.max_by("text", "n").alias("_t"), parts.alias("_p"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("formatted_chars"))
    rows = rows.withColumn("turns", parse(F.col("_t")))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", F.concat_ws("", F.col("_p.said")).alias("loss_text"), "formatted_chars")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = read_back(write_examples(format_turns(turns.unionByName(extra))))
    digest = F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256)
    return read.select("conv_id", "n_turns", digest.alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


#: DuckDB: the digests from the input; formatted_chars from the template's arithmetic.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '</', '<' || chr(1) || '/', 'g'))
    + length(regexp_replace(text, '[^#]', '', 'g')) - length(regexp_replace(regexp_replace(text, '#+', '#', 'g'), '[^#]', '', 'g')) AS escaped,
    length(replace(role, ':', '::')) AS role_chars FROM t),
s AS (SELECT *, sum(4 + role_chars + 2 + escaped + 8) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
