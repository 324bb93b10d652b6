"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context and only that reply trainable. A turn is written as

    ### role LF text </turn> LF

and the strings that could be taken for the template are escaped in roles and texts: backslash as two, `</turn>` as \\E, `###`
as \\H, and in roles a line feed as \\N. `parse` reads a formatted text back into its turns.
If turns follow the last assistant turn (or there is none), a last example without a target holds the whole conversation, so
no turn is lost.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), nulls first, repeated rows kept;
a row with a null conversation id is a conversation by itself, and is never gathered with others; no rows give no rows. Other columns are ignored.
The result grows with the square of the turns of a conversation; that is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
HEAD, TAIL = "### ", "</turn>\n"


def escape(text: Column, *, line_feeds: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("\\E")), F.lit("###"), F.lit("\\H"))
    return F.replace(out, F.lit("\n"), F.lit("\\N")) if line_feeds else out


def unescape(text: Column) -> Column:
    """Pairs of backslashes are cut out first, so what is left of a backslash begins an escape."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\E"), F.lit("</turn>")), F.lit("\\H"), F.lit("###")), F.lit("\\N"), F.lit("\n")))
    return F.array_join(plain, "\\")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.split(formatted, "</turn>\n", -1)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(unescape(F.substring(role, len(HEAD) + 1, 1 << 30)).alias("role"), unescape(F.substr(piece, F.length(role) + 2)).alias("text"))

    return F.transform(turns, turn)


def expand(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_end: code points of formatted, equal where nothing trains."""
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text")).alias("t"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    written = F.transform("turns", lambda t: F.struct((t["role"] == target_role).alias("target"), F.concat(F.lit(HEAD), escape(t["role"], line_feeds=True), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    whole = whole.select("conv_id", written.alias("turns"))
    indices = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.element_at("turns", k)["target"] | (k == F.size("turns")))
    each = whole.select("conv_id", "turns", F.posexplode(indices).alias("example", "k"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("k") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    each = each.select("conv_id", "example", before.alias("before"), F.element_at("turns", F.col("k")).alias("last"))
    formatted = F.concat("before", "last.head", "last.body", F.lit(TAIL))
    start = F.length("before") + F.length("last.head")
    return each.select(
        "conv_id",
        "example",
        formatted.alias("formatted"),
        F.when(F.col("last.target"), start).otherwise(F.lit(0)).alias("loss_start"),
        F.when(F.col("last.target"), start + F.length("last.body")).otherwise(F.lit(0)).alias("loss_end"),
    )


def digest(examples: DataFrame) -> DataFrame:
    """What can be read back from the examples of each conversation; each without an id has one example."""
    reply = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), reply.alias("reply"), "formatted")
    per = read.where("conv_id is not null").groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted")).alias("longest"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda e: e["reply"]), "").alias("loss"),
    )
    per = per.select("conv_id", F.col("longest.formatted").alias("formatted"), "formatted_chars", "loss")
    per = per.unionByName(read.where("conv_id is null").select("conv_id", "formatted", F.col("chars").alias("formatted_chars"), F.col("reply").alias("loss")))
    per = per.select("conv_id", parse(F.col("formatted")).alias("turns"), "formatted_chars", "loss")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The digests in DuckDB SQL, for the table and one more conversation.
DIGEST_SQL = """
WITH rows_of AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {probe}, NULL, 0, 'user', '{text}' UNION ALL SELECT {probe}, NULL, 1, 'assistant', '{text}'),
ranked AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, lone) AS n,
    replace(replace(replace(text, '\\', '\\\\'), '</turn>', '\\E'), '###', '\\H') AS body,
    replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '\\E'), '###', '\\H'), chr(10), '\\N') AS head
  FROM rows_of WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text)),
running AS (SELECT *, sum(length(head) + length(body) + 13) OVER (PARTITION BY conv_id, lone ORDER BY k) AS upto FROM ranked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto END)::BIGINT AS formatted_chars
FROM running GROUP BY conv_id, lone
"""
