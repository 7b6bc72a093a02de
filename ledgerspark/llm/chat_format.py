"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its
text under the loss mask. What follows the last assistant turn (or the whole conversation, if none
speaks) becomes one more example without loss, so that the output holds every turn.

A turn is written as ``<turn>role\\ntext</turn>\\n``. In texts and roles ``&`` and ``<`` become
``&amp;`` and ``&lt;``, and in roles a line feed becomes ``&#10;``; so no text can hold a mark, and
reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def expand(turns: DataFrame, answerer: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) to examples (conv_id, example, n_turns, formatted, loss_start, loss_end).

    The loss mask is the span [loss_start, loss_end) of formatted, in code points; it is empty in
    the example that has no target. A null text or role counts as empty. Turns are taken by turn
    (null first), equal ones by role and escaped text; rows that repeat are turns of their own. All rows of
    null conv_id are one conversation. Other columns are dropped; an empty table gives an empty one.
    A conversation's text is held once while it is expanded; examples are made row by row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = lambda r: F.concat(F.lit(OPEN), F.replace(escape(r), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    pieces = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            escape(text).alias("body"),
        ).alias("t"),
    )
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rendered = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(head(t["role"]), t["body"], F.lit(CLOSE))).alias("parts"),
        # the assistant turns' places, and past the end if anything follows the last of them
        F.filter(F.transform("ts", lambda t, i: F.when(t["role"] == answerer, i + 1)), lambda i: i.isNotNull()).alias("targets"),
        F.transform("ts", lambda t: F.length(t["body"])).alias("body_chars"),
    )
    last = F.coalesce(F.array_max("targets"), F.lit(0))
    rendered = rendered.withColumn(
        "ends",
        F.concat(
            F.transform("targets", lambda i: F.struct(i.alias("n"), F.lit(True).alias("target"))),
            F.when(last < F.size("parts"), F.array(F.struct(F.size("parts").alias("n"), F.lit(False).alias("target")))).otherwise(
                F.array().cast("array<struct<n:int,target:boolean>>")
            ),
        ),
    )
    examples = rendered.select("conv_id", "parts", "body_chars", F.posexplode("ends").alias("example", "end"))
    examples = examples.select(
        "conv_id",
        "example",
        F.col("end.n").alias("n_turns"),
        F.array_join(F.slice("parts", 1, F.col("end.n")), "").alias("formatted"),
        F.when(F.col("end.target"), F.get("body_chars", F.col("end.n") - 1)).otherwise(0).alias("loss_chars"),
    )
    loss_end = F.length("formatted") - len(CLOSE)
    return examples.select(
        "conv_id",
        "example",
        "n_turns",
        "formatted",
        (loss_end - F.col("loss_chars")).alias("loss_start"),
        loss_end.alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    marked = F.slice(F.split(formatted, CLOSE), 1, F.size(F.split(formatted, CLOSE)) - 1)
    return F.transform(
        marked,
        lambda p: F.struct(
            unescape(F.substring_index(F.replace(p, F.lit(OPEN), F.lit("")), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^<turn>[^\n]*\n", "")).alias("text"),
        ),
    )


def _masked(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, end - start))


PROBE = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(PROBE).alias("text"),
    )
    examples = expand(turns.unionByName(extra.withColumn("turn", F.col("turn").cast("long"))))
    loss = _masked(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    whole = examples.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max_by("formatted", "example").alias("formatted"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("text")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    read = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    all_loss = F.array_join(F.transform("losses", lambda x: x["text"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(read, 256).alias("turns_sha256"),
        F.length(all_loss).cast("long").alias("loss_chars"),
        F.sha2(all_loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS i,
         length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 15 AS chars
  FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
         i = max(i) OVER (PARTITION BY conv_id) AND role <> 'assistant' AS tail FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR tail) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR tail) AS n_examples
FROM c GROUP BY conv_id
"""
